"""Secrets in texts, by patterns and by what is assigned to which name.

Three patterns find assignments, access keys and long hexadecimal numbers wherever they
stand.  Beside them a lexer reads the text as source or configuration: names, string
literals with or without prefix, in one or three quotes, bare values, operators.  Every
``name = value``, ``name: value``, ``"name": value`` or ``x["name"] = value`` is a pair;
a value is literals joined by ``+`` or names of constants, in brackets or not (there also
literals side by side and lists of them), whose literals are passed on to the names they
are assigned to, over any number of steps.  An apostrophe directly behind a letter opens
a literal only if that is a prefix or ends a keyword; what three quotes hold is read like
the text around it, too; of an f-string, the parts between its fields are
literals and names that are fields are passed on.  A literal is scored by the most
sensitive name that it reaches and by how much it looks like a secret, one of several
lines by its strongest line without spaces; those of a score of ``MIN_SCORE`` or more are
spans of kind ``literal``, which hold the value without its quotes.

One narrow pass, no shuffle.  Defined results: null and empty texts have no spans; whole
texts are read, whatever their length; repeated rows are read each for itself; an empty
table gives no rows; further columns are handed on untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED, MIN_ACCESS = 12, 18

#: Parts of names, and how sensitive they make a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "accesskey": 0.9, "privatekey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.8,
    "credentials": 0.8, "connectionstring": 0.7, "authkey": 0.9, "bearer": 0.8,
}
PLACEHOLDER = re.compile(r"\A(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|(?:your|my|the|some)[_-].*|.*(?:example|changeme|change_me|placeholder|redacted|dummy).*|none|null|true|false|undefined)\Z", re.IGNORECASE)
MIN_SCORE = 0.5
MIN_LITERAL = 6

_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "connection", "bearer")
_HEX_BYTES = bytes(48 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_PREFIX = r"(?:[bB][rR]?|[rR][bBfF]?|[fF][rR]?|[uU])"
#: Words behind which code without spaces may open an apostrophe; behind other letters it is one of prose.
_BEFORE = "|".join(rf"(?<=\b{w})" for w in ("return", "case", "typeof", "yield", "import", "from", "print", "echo", "else", "and", "or", "not", "in", "of", "if", "is"))
#: Not behind a backslash that stands alone.
_EVEN = r"(?:(?<!\\)|(?<=\\\\))"
#: A quote behind a backslash opens nothing.  So a line has one quote of a kind at most from
#: which no literal is found: every later one stands behind a backslash, or it would end it.
_LEX = re.compile(
    rf"""(?P<string>(?:(?<!\w){_PREFIX})?(?:(?<!\\)\"{{3}}(?s:.*?){_EVEN}\"{{3}}|(?<!\\)"(?:[^"\\\n]|\\.)*")
        |(?:(?<!\w)(?:{_PREFIX})?|{_BEFORE})(?:(?<!\\)'{{3}}(?s:.*?){_EVEN}'{{3}}|(?<!\\)'(?:[^'\\\n]|\\.)*')|`[^`\\\n]*`)
    |(?P<op>:=|=>|[=!<>]=|[=:+])
    |(?P<word>[^\W\d][\w.\-/@$]*)
    |(?P<bare>[^\s"'`=:+,;(){{}}\[\]]+)
    |(?P<end>[\n;,{{}}()\[\]])""",
    re.VERBOSE,
)
_PARTS = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_BINDS = {"=", ":", ":=", "=>"}
_QUOTED = re.compile(r"([A-Za-z]{0,2})(\"{3}|'{3}|[\"'`])")
_FIELD = re.compile(r"(?<!\{)\{(?:([^\W\d]\w*)(?=[}:!=]))?[^{}]*\}(?!\})")


def sensitivity(name: str) -> float:
    """How sensitive a name is: the best of its parts and of neighbouring parts joined."""
    parts = [x.lower() for x in _PARTS.findall(_CAMEL.sub("_", name))]
    joined = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(x, 0.0) for x in joined), default=0.0)


def strength(value: str) -> float:
    """From 0 to 1: how much a literal looks like a secret; 0 for short ones and stand-ins."""
    if "\n" in value:
        return max((strength(x) for line in value.splitlines() if " " not in (x := line.strip())), default=0.0)
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value) or " " in value.strip() and len(value.split()) > 4:
        return 0.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, bits / 3.5) * min(1.0, len(value) / 10) * (0.55 + 0.15 * min(kinds, 3))


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    return [(m.lastgroup, m[0], m.start(), m.end()) for m in _LEX.finditer(text)]


def _inside(literal: str) -> tuple[str, int, int]:
    """Prefix of a string literal, and where what it holds starts and ends."""
    prefix, quote = _QUOTED.match(literal).groups()
    return prefix.lower(), len(prefix) + len(quote), len(literal) - len(quote)


def _name(tokens: list[tuple[str, str, int, int]], i: int) -> str | None:
    """The name that ends at a token: a word, a string, or what stands in a subscript."""
    if tokens[i][1] == "]" and i > 2 and tokens[i - 2][1] == "[" and tokens[i - 3][0] in ("word", "string", "end"):
        i -= 1
    kind, text = tokens[i][:2]
    if kind == "string":
        _, start, end = _inside(text)
        return text[start:end]
    return text if kind == "word" else None


def _value(tokens: list[tuple[str, str, int, int]], i: int) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of the literals and the names that the value starting at a token refers to."""
    spans, refs = [], []
    depth, wanted, beside = 0, True, False
    for j in range(i, len(tokens)):
        what, value, start, end = tokens[j]
        if what == "string" and (wanted or beside and depth):
            prefix, first, last = _inside(value)
            at = first
            for field in _FIELD.finditer(value, first, last) if "f" in prefix else ():
                spans += [(start + at, start + field.start())] if at < field.start() else []
                refs += [field[1]] if field[1] else []
                at = field.end()
            spans += [(start + at, start + last)] if at < last or at == first else []
            wanted, beside = False, True
        elif what in ("word", "bare") and wanted:
            refs.append(value)
            spans += [(start, end)] if what == "bare" or any(c.isdigit() for c in value) else []
            wanted = beside = False
        elif value in ("(", "[") and what == "end" and wanted:
            depth += 1
        elif value == "\n" and depth:
            continue
        elif value == "," and depth:
            wanted, beside = True, False
        elif value in (")", "]") and what == "end" and depth:
            depth -= 1
            wanted = False
        elif value == "+" and j > i:
            wanted, beside = True, False
        else:
            break
    return spans, refs


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """Every name with the spans of its literals and the names that its value refers to."""
    tokens = _tokens(text)
    for kind, literal, at, _ in tokens:
        if kind == "string" and literal.endswith(('"' * 3, "'" * 3)):  # may hold configuration or code
            _, start, end = _inside(literal)
            for name, spans, refs in pairs(literal[start:end]):
                yield name, [(a + at + start, b + at + start) for a, b in spans], refs
    for i, (kind, op, _, _) in enumerate(tokens[1:-1], 1):
        if kind != "op" or op not in _BINDS or (name := _name(tokens, i - 1)) is None:
            continue
        spans, refs = _value(tokens, i + 1)
        if spans or refs:
            yield name, spans, refs


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name and look like secrets."""
    own: dict[str, list[tuple[int, int]]] = {}
    uses: dict[str, list[str]] = {}
    for name, spans, refs in pairs(text):
        own.setdefault(name, []).extend(spans)
        uses.setdefault(name, []).extend(refs)
    # constants reach names over any number of steps; the most sensitive names come first,
    # so what a name reaches is looked at once
    scores: dict[tuple[int, int], float] = {}
    weights = {name: weight for name in own if (weight := sensitivity(name))}
    seen: set[str] = set()
    for name in sorted(weights, key=weights.__getitem__, reverse=True):
        left = [] if name in seen else [name]
        seen.add(name)
        while left:
            at = left.pop()
            for span in own[at]:
                scores[span] = max(scores.get(span, 0.0), weights[name])
            new = {x for x in uses[at] if x not in seen and x in own}
            seen |= new
            left += new
    return sorted(s for s, weight in scores.items() if weight * strength(text[s[0] : s[1]]) >= MIN_SCORE)


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start and then by kind as listed."""
    if not text:
        return []
    found, lower = [], text.lower()
    if any(hint in lower for hint in _HINTS) and ("=" in text or ":" in text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
        found += [(a, b, "literal") for a, b in literals(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if b"0" * 16 in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def _digest(found: list[tuple[int, int, str]]) -> tuple:
    base = [s for s in found if s[2] != "literal"]
    counts = Counter(s[2] for s in base)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, all spans."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [_digest(spans(t)) for t in frame["text"]]
            yield pd.concat([frame[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", F.col("text").cast("string")).mapInPandas(scan, schema)


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every found span, or run of overlapping ones, replaced by a mark."""
    parts, at, until = [], 0, -1
    for start, end, _ in spans(text):
        if start >= until:
            parts += [text[at:start], mark]
        at = until = max(until, end)
    return text if not parts else "".join(parts) + text[at:]


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text``; ``n_chars``, if there, follows the text."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    new = fresh(docs, "masked_text")
    df = docs.withColumn(new, mask(F.col("text").cast("string")))
    length = F.when(F.col(new) == F.col("text"), F.col("n_chars")).otherwise(F.length(new)) if "n_chars" in docs.columns else None
    given = {"text": F.col(new), "n_chars": length}
    return df.select(*(given[c].cast(k).alias(c) if c in given else F.col(f"`{c}`") for c, k in docs.dtypes))

"""Portable regex and text Columns.

Rule patterns are written once, in plain notation, and must select the same
text whatever engine evaluates them.  Java's ``\\w``, ``\\s``, ``\\d`` and ``\\b``
are ASCII-only and its ``.`` also stops at ``\\r``, U+0085 and U+2028, so the
shorthand is spelled out as explicit Unicode classes and ``(?d)`` is always set.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# Every character str.strip() removes, for btrim (Spark's trim removes only blanks).
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
JSON_BLANKS = " \t\n\r"

_OUTSIDE = {
    r"\w": f"[{WORD}]", r"\W": f"[^{WORD}]",
    r"\s": f"[{SPACE}]", r"\S": f"[^{SPACE}]",
    r"\d": r"\p{Nd}", r"\D": r"\P{Nd}",
    r"\b": WORD_EDGE,
}
_INSIDE = {
    r"\w": WORD, r"\W": f"[^{WORD}]",
    r"\s": SPACE, r"\S": f"[^{SPACE}]",
    r"\d": r"\p{Nd}", r"\D": r"\P{Nd}",
    "[": r"\[", "&&": r"&\&",
}


def portable(pattern: str) -> str:
    """Spell out the shorthand classes of ``pattern`` as Unicode classes."""
    out: list[str] = []
    inside = False
    for token in re.findall(r"\\.|\[\^?\]?|&&|.", pattern, re.DOTALL):
        if inside:
            out.append(_INSIDE.get(token, token))
            inside = token != "]"
        elif token.startswith("["):
            # A "]" directly after the opening is a literal.
            out.append(token.replace("]", r"\]"))
            inside = True
        else:
            out.append(_OUTSIDE.get(token, token))
    return "".join(out)


def java_regex(pattern: str, *, dotall: bool = False, ignore_case: bool = True) -> str:
    return f"(?d{'iu' if ignore_case else ''}{'s' if dotall else ''}){portable(pattern)}"


def find_all(text: Column, pattern: str, group: int = 0, *, dotall: bool = False) -> Column:
    """All matches of ``pattern`` (one group of each), in order, ignoring case."""
    return F.regexp_extract_all(text, F.lit(java_regex(pattern, dotall=dotall)), F.lit(group))


def first_on_line(pattern: str) -> str:
    """``head.*tail`` rewritten so that a line is searched once, from its first head.

    If no tail follows the first head of a line, none follows a later one, and a
    greedy match runs to the last tail: per line there is at most one match, and
    the rewritten form has one exactly where the plain form has.  The plain form
    would search on from every head, which is quadratic on long lines.
    """
    head, tail = pattern.split(".*", 1)
    return f"(?m)^(?>.*?{head}).*{tail}"


def fold(text: Column) -> Column:
    """Lower case, so that plain comparison means ignoring case.

    Three letters count as s or i when case is ignored but are not lower-cased to
    them; they are replaced first, in the rare text that has them.
    """
    odd, plain = "\u017f\u0131\u0130", "sii"
    rare = contains_any(text, list(odd))
    return F.when(rare, F.lower(F.translate(text, odd, plain))).otherwise(F.lower(text))


def folded_regex(pattern: str, *, dotall: bool = False) -> str:
    """``pattern`` for folded text: letters lower-cased, case then exact.

    Searching folded text for a plain literal is several times faster than
    ignoring case in the search.  Use it where the matched text is not shown.
    """
    lowered = re.sub(r"(\\.)|([A-Z]+)", lambda m: m[1] or m[2].lower(), pattern)
    return java_regex(lowered, dotall=dotall, ignore_case=False)


def literals(pattern: str) -> list[str]:
    """The words of a pattern that is nothing but alternative literals, folded."""
    words = [re.sub(r"\\(\W)", r"\1", word) for word in pattern.split("|")]
    if any(set(re.sub(r"\\\W", "", word)) & set("\\.*+?()[]{}^$") for word in pattern.split("|")):
        raise ValueError(f"more than plain alternatives: {pattern}")
    return [word.lower() for word in words]


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True where ``text`` holds one of ``words``, exactly as written."""
    test = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        test = test | F.contains(text, F.lit(word))
    return test


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def percent_text(ratio: Column) -> Column:
    """``ratio`` as a percentage with one decimal, e.g. ``12.2%``.

    Rounds the exact binary value, ties to even, as C's printf does; rounding
    through decimal text (``format_string``, ``bround``) differs on some values.
    With d the percentage and k = 2*floor(10d)+1, d lies above the midpoint k/20
    exactly when 4d > k - 16d, and both sides are exact in doubles.
    """
    d = ratio * F.lit(100.0)
    tenths = F.floor(d * F.lit(10.0))
    k = (tenths * 2 + 1).cast("double")
    above = d * F.lit(4.0)
    midpoint = k - d * F.lit(16.0)
    up = (above > midpoint) | ((above == midpoint) & (tenths % 2 == 1))
    rounded = tenths + F.when(up, 1).otherwise(0)
    return F.concat(
        F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit("%")
    )

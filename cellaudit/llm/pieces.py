"""Texts to pieces of a SentencePiece vocabulary and back.

An Aho-Corasick automaton holds all pieces.  It reads a text once; at each position it
follows its output links to every piece that ends there, and each of these relaxes the
best score of a segmentation up to that position.  Characters that are no piece become
the pieces of their bytes, at the vocabulary's least score less a penalty.

No piece holds the mark of a space behind another character, so the best segmentation of
a text is that of its words, each with the spaces before it; those met before are
remembered.  New words of a batch go through the automaton side by side, one character
at a time, as far as they are short and of common characters; the rest go one by one.
Decoding gives back exactly the text that was encoded: a space mark that is
part of the text is spelt in bytes.

One narrow pass, no shuffle.  Defined results: null and empty texts have no pieces; of
segmentations with equal scores the one with the longer last piece wins; texts of any
length are read; repeated rows are encoded each for itself; an empty table gives no rows;
further columns are not looked at.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import in_slices, utf8

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
PENALTY = 10.0
#: Words whose pieces a process remembers; only speed depends on this and the next three.
REMEMBERED = 400_000
#: Characters with a column in the table of transitions, and words that are read side by side.
COMMON, LONGEST, TOGETHER = 254, 48, 16_384

_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_codecs: dict[str, Codec] = {}


class Automaton:
    """Pieces as a trie with failure and output links."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.piece, self.score, self.depth = [-1], [0.0], [0]
        for text, number, score in pieces:
            node = 0
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(-1)
                    self.score.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                node = self.next[node][c]
            self.piece[node], self.score[node] = number, score
        self.fail, self.output = [0] * len(self.next), [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            node = waiting.popleft()
            for c, child in self.next[node].items():
                at = self.fail[node]
                while at and c not in self.next[at]:
                    at = self.fail[at]
                self.fail[child] = self.next[at].get(c, 0)
                waiting.append(child)
            back = self.fail[node]
            self.output[node] = back if self.piece[back] >= 0 else self.output[back]
        self._tabulate()

    def _tabulate(self) -> None:
        """Nodes as arrays, and where each common character leads from each, failures resolved."""
        uses = Counter(c for edges in self.next for c in edges)
        alone = [c for c, node in self.next[0].items() if self.piece[node] >= 0]
        common = sorted(alone, key=lambda c: (-uses[c], c))[:COMMON]
        column = {c: i for i, c in enumerate(common, 2)}
        self.column = np.ones(sys.maxunicode + 1, np.uint8)  # 0: read one by one, 1: in no piece
        for c in uses:
            self.column[ord(c)] = column.get(c, 0)
        self.table = np.zeros((len(self.next), len(common) + 2), np.int32)
        waiting = deque([0])
        while waiting:
            node = waiting.popleft()
            if node:
                self.table[node] = self.table[self.fail[node]]
            for c, child in self.next[node].items():
                if c in column:
                    self.table[node, column[c]] = child
                waiting.append(child)
        self.pieces, self.scores = np.array(self.piece, np.int32), np.array(self.score)
        self.depths, self.outputs = np.array(self.depth, np.int32), np.array(self.output, np.int32)
        self.depths[0] = 1  # stands for a character that is in no piece
        self.ends = np.where(self.pieces >= 0, np.arange(len(self.next), dtype=np.int32), self.outputs)

    def together(self, words: list[str], unknown: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are short and common, the pieces of those one after another, and where each word's end.

        A character that is in no piece stands as minus one minus its code point.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        marks = self.column[points]
        starts = np.cumsum(lengths) - lengths
        rare = np.append(0, np.cumsum(marks == 0))
        fit = np.flatnonzero((lengths <= LONGEST) & (lengths > 0) & (rare[starts + lengths] == rare[starts]))
        order = fit[np.argsort(-lengths[fit], kind="stable")]
        lengths, starts = lengths[order], starts[order]
        most = int(lengths[0]) if len(order) else 0
        best = np.full((most + 1, len(order)), -np.inf)
        best[0] = 0.0
        came = np.zeros((most + 1, len(order)), np.int32)  # the node of the last piece
        node = np.zeros(len(order), np.int32)
        for end in range(1, most + 1):
            left = int(np.searchsorted(-lengths, -end, side="right"))  # longer words come first
            mark = marks[starts[:left] + end - 1]
            node = self.table[node[:left], mark]
            foreign = np.flatnonzero(mark == 1)
            best[end, foreign] = best[end - 1, foreign] + unknown
            row, at = np.arange(left), self.ends[node]
            while True:
                held = at > 0
                if not held.all():
                    row, at = row[held], at[held]
                if not len(row):
                    break
                value = best[end - self.depths[at], row] + self.scores[at]
                better = value > best[end, row]
                best[end, row[better]], came[end, row[better]] = value[better], at[better]
                at = self.outputs[at]
        return order, *self._followed(came, lengths, points, starts)

    def _followed(self, came: np.ndarray, lengths: np.ndarray, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all words from the last one back, then put in order; and where each word's end."""
        row, end, places, found = np.arange(len(lengths)), lengths, [], []
        while len(row):
            at = came[end, row]
            places.append(row * (LONGEST + 1) + end)
            found.append(np.where(at > 0, self.pieces[at], -1 - points[starts[row] + end - 1]))
            end = end - self.depths[at]
            row, end = row[end > 0], end[end > 0]
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.concatenate(places)
        ordered = np.argsort(place)
        counts = np.bincount(place // (LONGEST + 1), minlength=len(lengths))
        return np.concatenate(found)[ordered], np.cumsum(counts)

    def segment(self, text: str, unknown: float) -> list[tuple[int, int, int]]:
        """(start, end, piece) of the best segmentation; piece -1 for a character that is none."""
        best, came = [0.0] + [float("-inf")] * len(text), [(0, -1)] * (len(text) + 1)
        following, fail, output, piece, score, depth = self.next, self.fail, self.output, self.piece, self.score, self.depth
        node = 0
        for end, c in enumerate(text, 1):
            while node and c not in following[node]:
                node = fail[node]
            node = following[node].get(c, 0)
            at, single = node if piece[node] >= 0 else output[node], False
            while at:
                start = end - depth[at]
                single |= start == end - 1
                value = best[start] + score[at]
                if value > best[end]:
                    best[end], came[end] = value, (start, piece[at])
                at = output[at]
            if not single and best[end - 1] + unknown > best[end]:
                best[end], came[end] = best[end - 1] + unknown, (end - 1, -1)
        out, end = [], len(text)
        while end:
            start, number = came[end]
            out.append((start, end, number))
            end = start
        return out[::-1]


def _marked(key: str) -> str:
    """The word that a key stands for."""
    return key if SPACE in key else SPACE + key


class Codec:
    def __init__(self, vocabulary: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=vocabulary)
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = [(model.id_to_piece(i), i, float(model.get_score(i))) for i in plain]
        self.unknown = min(s for _, _, s in pieces) - PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, _, _ in pieces)
        self.automaton = Automaton(pieces)
        spelt = {i: p.replace(SPACE, " ").encode() for p, i, _ in pieces} | {i: bytes([b]) for b, i in self.bytes.items()}
        every = [spelt.get(i, b"") for i in ids]
        self.letters = np.frombuffer(b"".join(every), np.uint8)
        self.lengths = np.array([len(x) for x in every])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.mark = np.array([self.bytes[b] for b in SPACE.encode()], "<u4").tobytes()
        self._known: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for start, end, number in self.automaton.segment(unit, self.unknown):
            ids += [number] if number >= 0 else [self.bytes[b] for b in unit[start:end].encode()]
        return np.array(ids, "<u4").tobytes()

    def _spelt_in_bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with the bytes of foreign characters in their places, and where words end then."""
        counts = np.ones(len(ids), np.int64)
        foreign = {int(x): [self.bytes[b] for b in chr(-1 - x).encode()] for x in np.unique(ids[ids < 0])}
        for x, spelt in foreign.items():
            counts[ids == x] = len(spelt)
        out, after = np.repeat(ids, counts), np.append(0, np.cumsum(counts))
        for x, spelt in foreign.items():
            for j, b in enumerate(spelt):
                out[after[:-1][ids == x] + j] = b
        return out.astype("<u4"), after[ends]

    def _learn(self, keys: list[str]) -> None:
        """Remembers the ids of words."""
        known = self._known
        for i in range(0, len(keys), TOGETHER):
            some = keys[i : i + TOGETHER]
            order, ids, ends = self.automaton.together([_marked(x) for x in some], self.unknown)
            ids, ends = self._spelt_in_bytes(ids, ends)
            start, ids = 0, ids.tobytes()
            for at, end in zip(order.tolist(), (4 * ends).tolist(), strict=True):
                known[some[at]], start = ids[start:end], end
            if len(order) < len(some):
                for at in set(range(len(some))).difference(order.tolist()):
                    known[some[at]] = self._unit(_marked(some[at]))

    def _words(self, text: str) -> list[str]:
        """The keys of a text's words: a word behind one space is its own key, others show their marks."""
        if not self.by_word:
            return [SPACE + text.replace(" ", SPACE)]
        if "  " in text or text[0] == " ":
            return [x if x[1:2] == SPACE else x[1:] for x in _UNITS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def _with_marks(self, text: str) -> bytes:
        """Ids of a text that itself holds space marks, which are spelt in bytes."""
        first, *rest = text.split(SPACE)
        own = [SPACE + first.replace(" ", SPACE), *(x.replace(" ", SPACE) for x in rest)]
        return self.mark.join(b"".join(map(self._unit, _UNITS.findall(x) if self.by_word else [x] if x else [])) for x in own)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of unsigned 32-bit numbers."""
        known, lists = self._known, [self._words(t) if t and SPACE not in t else [] for t in texts]
        needed = set().union(*lists)
        new = needed - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = needed
        self._learn(list(new))
        plain = [b"".join(map(known.__getitem__, words)) for words in lists]
        return [self._with_marks(t) if t and SPACE in t else ids for t, ids in zip(texts, plain, strict=True)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts that the ids of several texts spell; where each text's ids end."""
        counts = self.lengths[ids]
        after = np.append(0, np.cumsum(counts))
        places = np.arange(after[-1]) + np.repeat(self.starts[ids] - after[:-1], counts)
        spelt, stops = self.letters[places].tobytes(), after[ends].tolist()
        return [spelt[a + 1 : b].decode("utf-8", "replace") for a, b in zip([0, *stops], stops, strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(ids, np.array([len(ids)]))[0]


def codec(vocabulary: str = VOCABULARY) -> Codec:
    """The process's codec for a vocabulary file that every machine has."""
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): little-endian unsigned 32-bit ids of each text as binary."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = codec(vocabulary).encode_all
        for batch in batches:
            for part in in_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode_all(part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, text): the texts that ids spell."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_all = codec(vocabulary).decode_all
        for batch in batches:
            for part in in_slices(batch, "ids"):
                data, starts = utf8(part.column(1))
                texts = decode_all(np.frombuffer(data.tobytes(), "<u4"), starts[1:] // 4)
                texts = pa.array(texts, pa.string(), mask=part.column(1).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["doc_id", "ids", "text"])

    return ids.select("doc_id", "ids").mapInArrow(apply, f"doc_id {dict(ids.dtypes)['doc_id']}, ids binary, text string")


def digest(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: number and checksum of its ids, length and checksum of what they decode to."""
    df = decoded(encoded(docs, vocabulary), vocabulary)
    return df.select(
        "doc_id", F.expr("length(ids) div 4").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("decoded_chars"), F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"),
    )

"""Packing by power-of-two decomposition.

The ids of a document, with one end id, are cut into pieces of 1024 ids and then into
pieces whose lengths are the powers of two of the rest, longest first.  Each piece is a
sequence of its own: no sequence crosses documents, none is padded, and the sequences of
one length form a bucket from which batches are drawn.

One narrow pass over the texts, no shuffle.  The vocabulary is that of the tokenizers
library; its ids are computed by a second implementation of byte-level BPE, which is
faster and which tests hold against the first.  Where no two white spaces stand side by
side, as in most texts, its splitting pattern needs no look-ahead and runs faster still.

Defined results: null and empty texts are the end id alone; texts of any length are cut
whole; repeated rows are packed each for itself; an empty table gives no pieces; further
columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 1024
END = 0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Fixed value: the splitting pattern without its look-ahead, for single white spaces.
SINGLE_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"""

_RUN = re.compile(r"\s\s")
#: Bytes with a space for every other white space of ASCII, and the white spaces beyond it.
_BLANKS = bytes(0x20 if chr(b).isspace() and b < 0x80 else b for b in range(256))
_OTHER_BLANKS = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE, _LINE = 0x20, 0x0A
_encoders: dict[str, Encoder] = {}


def _ranks(model: dict) -> dict[bytes, int]:
    """The vocabulary by bytes; the file spells bytes that don't print as characters from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelt = {chr(b): b for b in printed}
    spelt |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printed))}
    return {bytes(spelt[c] for c in token): i for token, i in model["vocab"].items() if all(c in spelt for c in token)}


class Encoder:
    """Texts to ids, as bytes of unsigned 32-bit numbers."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            given = json.load(file)
        self._marks = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in given["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, self._marks)) + ")") if self._marks else None
        ranks = {k: v for k, v in _ranks(given["model"]).items() if k.decode("utf-8", "replace") not in self._marks}
        marks = {x["content"]: x["id"] for x in given["added_tokens"]}
        make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=marks)
        self._any, self._single = make("any", public_tokenizers.PATTERN), make("single", SINGLE_SPACES)
        self._bytes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self._bytes[list(ranks.values())] = [len(k) for k in ranks]

    def encode(self, text: str) -> bytes:
        if self._cut and any(mark in text for mark in self._marks):
            return b"".join(self._marks.get(x) or self._plain(x) for x in self._cut.split(text))
        return self._plain(text)

    def encode_all(self, texts: Sequence[str], end: int) -> list[bytes]:
        """The ids of each text and an end id.  Words that texts share are encoded once.

        Where no two white spaces stand side by side, nothing that the splitting pattern
        finds goes beyond a space, so that a text's ids are those of its words, each with
        the space before it.  Texts are put one after another, each behind a line feed,
        which is an id of its own and gives its place to the end id of the text before.
        Other texts are encoded whole.
        """
        last = np.array([end], "<u4").tobytes()
        out, easy, spelt = [last] * len(texts), [], []
        for i, text in enumerate(texts):
            if data := self._words(text):
                easy.append(i)
                spelt.append(data)
            elif text:
                out[i] = self.encode(text) + last
        if easy:
            for i, ids in zip(easy, self._shared(spelt, end), strict=True):
                out[i] = ids
        return out

    def _words(self, text: str) -> bytes | None:
        """The bytes of a text that may be cut before every space; None for other texts, empty ones too."""
        if not text or any(mark in text for mark in self._marks):
            return None
        data = text.encode()
        blank = data.translate(_BLANKS)
        if b"  " in blank or blank[0] == _SPACE or blank[-1] == _SPACE:
            return None
        return data if text.isascii() or not any(c in text for c in _OTHER_BLANKS) else None

    def _shared(self, texts: list[bytes], end: int) -> Iterator[bytes]:
        data = np.frombuffer(b"\n" + b"\n".join(texts), np.uint8)
        first = np.cumsum([0, *(len(x) + 1 for x in texts)])
        cut = data == _SPACE
        cut[first[:-1]] = True
        starts = np.append(np.flatnonzero(cut), len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        _, ends, spelt = words.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(words.dictionary) + 1]
        text = spelt.to_pybytes()[: ends[-1]].decode()
        # without marks to look for, the library would look for empty ones
        ids = self._single.encode_to_numpy(text, disallowed_special=()) if self._marks else np.array(self._single.encode_ordinary(text), "<u4")
        # where each word's ids start among those of all different words, and how many they are
        begin = np.searchsorted(np.cumsum(self._bytes.take(ids)), ends, side="right")
        counts, which = np.diff(begin), words.indices.to_numpy()
        before = np.zeros(len(which) + 1, np.int64)
        np.cumsum(counts.take(which), out=before[1:])
        found = np.empty(before[-1] + 1, "<u4")
        for i in range(0, len(which), 1 << 15):  # few enough for the processor's cache
            some, at = which[i : i + (1 << 15)], before[i : i + (1 << 15) + 1]
            places = np.repeat(begin.take(some) - at[:-1], np.diff(at))
            places += np.arange(at[0], at[-1])
            found[at[0] : at[-1]] = ids.take(places)
        heads = before[np.searchsorted(starts, first)]
        found[heads] = end
        for low, high in zip(heads[:-1], heads[1:], strict=True):
            yield found[low + 1 : high + 1].tobytes()

    def _plain(self, text: str) -> bytes:
        rule = self._any if _RUN.search(text) else self._single
        return np.array(rule.encode_ordinary(text), "<u4").tobytes()


def encoder(vocabulary: str) -> Encoder:
    """The process's encoder for a vocabulary file that every machine has."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def decomposition(length: int, most: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces: as many of ``most`` as fit, then falling powers of two."""
    rest = length % most
    return [most] * (length // most) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, most: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``most`` is a power of two.  ``sequence_id`` is made of the partition's number and
    the row's place in it, so that ids are unique without counting or sorting anything.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest piece must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(vocabulary).encode, np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + last
                total, start = len(ids) // 4, 0
                for length in decomposition(total, most):
                    rows.append((key, start, length, ids[4 * start : 4 * (start + length)], total))
                    start += length
                size += len(ids)
                if size > 1 << 24:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()))
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def write_buckets(pieces: DataFrame, location: str) -> None:
    """The sequences as files, those of one length in one folder."""
    pieces.write.partitionBy("length").parquet(location)


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


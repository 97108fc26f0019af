"""Token ids of all documents as files of coded blocks, in order of doc_id, and back.

Writing: texts are dealt into ranges of doc_id, sorted within each, and turned into ids.
Each range is one part.  Its ids, the documents one after another, each with its end id,
are cut into blocks of 4096; a block is coded by ``range_coder`` and is one row:

    part, block     place in the order of all ids
    start           ids of the part before this block
    n_ids           ids in the block
    docs            pieces of documents in it: doc_id, row (in the part), offset in the
                    document, length, ids of the whole document
    data            the coded block, with its own head and checksum

Rows are written by Spark as Parquet, so that a lost executor's files never count and any
store that Spark reaches will do.  A block needs no other block to be read.

Reading: blocks are decoded side by side and checked; each piece of a document gives its
share of the document's checksum.  Shares of one document are put together by exclusive
or, so a document that spans many blocks is summed before anything is shuffled.  Starts
are the ids of the parts before, from the narrow columns alone.

Ids are those of the tokenizers library: ``packing.Encoder`` computes them several times
faster, words that texts share only once, and tests hold them against the library.

Defined results: null and empty texts are the end id alone; texts of any length are coded
whole; rows with equal doc_id are each a document, in order of their text's hash; rows
without a doc_id come first; an empty table gives no rows; further columns are not looked
at, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import packing, range_coder
from .tables import in_slices, workspace

END = 0
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Blocks that are coded side by side.
GROUP = range_coder.LANES
#: Bytes of text whose words are encoded together.
TEXTS = 1 << 23

PIECE = "struct<doc_id:long,row:long,offset:long,length:long,total:long>"
SCHEMA = f"part int, block long, start long, n_ids long, docs array<{PIECE}>, data binary"

# ---- writing ------------------------------------------------------------------------
def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of doc_id, sorted within each; rows of one id may span ranges."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("*", *[k.alias(f"key_{i}") for i, k in enumerate(keys[1:], 1)])
    order = [F.asc_nulls_first("doc_id"), F.asc("key_1"), F.asc("key_2")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def coded(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """The rows of the files, as in the module's text."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = packing.encoder(vocabulary).encode_all
        group = _Group(TaskContext.get().partitionId())
        for some in (part for batch in batches for part in in_slices(batch, "text", TEXTS)):
            for key, ids in zip(some.column(0).to_pylist(), encode_all(some.column(1).to_pylist(), end), strict=True):
                yield from group.add(key, ids)
        yield from group.flush(range_coder.BLOCK - 1)

    return in_order(docs).mapInArrow(code, SCHEMA)


class _Group:
    """Ids of a part that are not coded yet, with the documents that they are of."""

    def __init__(self, part: int) -> None:
        self.part, self.row, self.block, self.start = part, 0, 0, 0
        self.ids = bytearray()
        self.docs: list[tuple] = []  # doc_id, row, ids of the part before it, its ids

    def add(self, key: int | None, ids: bytes) -> Iterator[pa.RecordBatch]:
        self.docs.append((key, self.row, self.start + len(self.ids) // 4, len(ids) // 4))
        self.row += 1
        self.ids += ids
        while len(self.ids) >= 4 * range_coder.BLOCK * GROUP:
            yield from self.flush(0, GROUP)

    def flush(self, short: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
        """Codes whole blocks, and with ``short`` what is left as a shorter one."""
        size = range_coder.BLOCK
        while n := (len(self.ids) // 4 + short) // size:
            n = min(n, GROUP)
            ids = np.frombuffer(bytes(self.ids[: 4 * n * size]), "<u4")
            del self.ids[: 4 * n * size]
            blocks = [ids[i : i + size] for i in range(0, len(ids), size)]
            yield self._rows(blocks, range_coder.encode(blocks))
            if most:
                return

    def _rows(self, blocks: list[np.ndarray], data: list[bytes]) -> pa.RecordBatch:
        pieces, k = [], 0
        begins = []
        for block in blocks:
            stop, inside = self.start + len(block), []
            begins.append(self.start)
            while k < len(self.docs):
                key, row, first, total = self.docs[k]
                if first >= stop:
                    break
                low, high = max(first, self.start), min(first + total, stop)
                inside.append({"doc_id": key, "row": row, "offset": low - first, "length": high - low, "total": total})
                if first + total > stop:
                    break
                k += 1
            pieces.append(inside)
            self.start = stop
        del self.docs[:k]
        numbers = range(self.block, self.block + len(blocks))
        self.block += len(blocks)
        kind = pa.struct([(name, pa.int64()) for name in ("doc_id", "row", "offset", "length", "total")])
        columns = {
            "part": pa.array([self.part] * len(blocks), pa.int32()),
            "block": pa.array(numbers, pa.int64()),
            "start": pa.array(begins, pa.int64()),
            "n_ids": pa.array([len(b) for b in blocks], pa.int64()),
            "docs": pa.array(pieces, pa.list_(kind)),
            "data": pa.array(data, pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)


def write(docs: DataFrame, location: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Writes the files of ``docs`` to a folder that doesn't exist yet."""
    coded(docs, vocabulary, end).write.parquet(location)


# ---- reading ------------------------------------------------------------------------
def files(spark: SparkSession, location: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(location)


def _opened(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows of blocks, some at a time, and their ids."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(batch.column(c).to_pylist() for c in [*columns, "data"]), strict=True)
        while len(held) >= GROUP:
            rows, held = held[:GROUP], held[GROUP:]
            yield rows, range_coder.decode([r[-1] for r in rows])
    if held:
        yield held, range_coder.decode([r[-1] for r in held])


def documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, part, row, offset, ids): the ids of each piece of a document, as bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _opened(batches, ["part", "docs"]):
            out = []
            for (part, docs, _), ids in zip(rows, found, strict=True):
                at = 0
                for doc in docs:
                    out.append((doc["doc_id"], part, doc["row"], doc["offset"], ids[at : at + doc["length"]].astype("<u4").tobytes()))
                    at += doc["length"]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "part", "row", "offset", "ids"])

    return blocks.select("part", "docs", "data").mapInArrow(read, "doc_id long, part int, row long, offset long, ids binary")


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's own; the highest bit is the lowest power."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def moved(crc: int, behind: int) -> int:
    """A checksum's share in that of a longer text in which so many bytes follow."""
    power, step = 1 << 31, 1 << 23  # x^0 and x^8
    while behind:
        if behind & 1:
            power = _times(step, power)
        step, behind = _times(step, step), behind >> 1
    return _times(power, crc)


def summed(blocks: DataFrame) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, of the ids as they are decoded."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _opened(batches, ["part", "start", "docs"]):
            out = []
            for (part, start, docs, _), ids in zip(rows, found, strict=True):
                data, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
                for doc in docs:
                    n = doc["length"]
                    crc, behind = zlib.crc32(data[4 * at : 4 * (at + n)]), doc["total"] - doc["offset"] - n
                    out.append((part, doc["row"], doc["doc_id"], start + at, n, moved(crc, 4 * behind) if behind else crc))
                    at += n
            names = ["part", "row", "doc_id", "start", "n", "crc"]
            kinds = (pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    pieces = blocks.select("part", "start", "docs", "data").mapInArrow(read, "part int, row long, doc_id long, start long, n long, crc long")
    whole = pieces.groupBy("part", "row").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
    )
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row for each part
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = whole.join(parts.select("part", before.alias("before")), "part")
    return joined.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, location: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` to the shared folder and returns the digest that is read back."""
    spark = docs.sparkSession
    location = location or f"{workspace(spark)}/ids-{uuid.uuid4().hex}"
    write(docs, location, vocabulary)
    return summed(files(spark, location))

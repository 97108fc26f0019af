"""Near copies by b-bit MinHash.

One pass over the texts gives each document the size of its set of word shingles, a
digest of the set, band keys made of full minima and a signature that keeps only the low
``BITS`` bits of each minimum, packed into longs.  Documents with equal sets are one
class.  Documents that share a band key are candidates; the bits in which two signatures
differ are counted, corrected for minima that agree by chance, and pairs that could
reach the similarity are confirmed on the full sets.

What is wanted are groups, so pairs that cannot change them are never made: first each
document is tried against the smallest one that it shares a band with, which joins large
groups of copies by as many pairs as they have members; then bands are searched only for
pairs of different groups, in blocks of bounded size, each pair in the first band that
it shares, best estimates first and none whose groups have met before.  With 32 bands of four minima a
pair of similarity 0.8 is missed once in twenty million.

Defined results: null texts and texts without words have an empty set and are linked
with nothing; shorter texts are one shingle; rows that repeat a doc_id are one document,
linked by any of its rows; a null doc_id is linked with nothing and kept; an empty table
gives no rows; further columns are handed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import in_slices, stored, utf8

WORDS = 4
SIMILARITY = 80
BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
#: Pairs estimated below the wanted similarity by more than this are dropped: five deviations.
MARGIN = 0.18
#: Members of a band that are compared with one another at a time.
BLOCK = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_STEP, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_random = np.random.default_rng(20)
_FACTORS = (_random.integers(0, 1 << 31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_MASKS = _random.integers(0, 1 << 32, HASHES, dtype=np.int64).astype(np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _SHIFT
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), _STEP, np.uint64))])


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of all texts, and where the words of each text start."""
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    new = np.empty(len(solid), bool)
    new[0] = True
    new[1:] = np.diff(solid) > 1
    edges = np.searchsorted(solid, starts[1:-1])
    new[edges[edges < len(solid)]] = True
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(solid)))
    place = np.arange(len(solid)) - np.repeat(first, lengths)
    hashes = np.add.reduceat(_LOWER[data[solid]] * _powers(int(lengths.max()))[place], first)
    return _mixed(hashes), np.searchsorted(solid[first], starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """For every text the sorted hashes of its different shingles."""
    hashes, at = word_hashes(data, starts)
    powers = _powers(words + 1)
    windows = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        windows += hashes[k : k + len(windows)] * powers[k]
    windows = _mixed(windows)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            yield np.unique(windows[a : b - words + 1])
        elif b > a:  # one shingle; its length is part of it
            yield _mixed((hashes[a:b] * powers[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64) * _SHIFT)
        else:
            yield np.empty(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, ((x[i : i + 1024, None] ^ _MASKS) * _FACTORS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """Keys of all bands, from whole minima; equal only for the same band."""
    parts = least.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = _mixed((parts * _powers(ROWS + 1)[1:]).sum(axis=2, dtype=np.uint64))
    return _mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * _SHIFT).view(np.int64)


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of all minima, 16 of them in a long."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, HASHES * BITS // 64, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel(), pa.int64()))


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, bits) for every row; the last three null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch, "text"):
                sizes, digests, least = [], [], []
                for shingles in shingle_sets(*utf8(part.column("text")), words):
                    sizes.append(len(shingles))
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                    least.append(minima(shingles))
                matrix = np.stack(least)
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(band_keys(matrix)), _lists(packed_bits(matrix))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "bits"])

    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, schema)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from the bits in which two signatures differ, corrected for chance."""
    ones = sum(1 << k for k in range(0, 64, BITS))
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    chance = 1 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for all pairs of two blocks of signatures."""
    differ = np.zeros((len(a), len(b)), np.int64)
    ones = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    for i in range(a.shape[1]):
        x = a[:, None, i] ^ b[None, :, i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ += np.bitwise_count(x & ones)
    chance = 1 / (1 << BITS)
    return (1 - differ / HASHES - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Whether two sets, given in order, are as similar as per cent say."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < similarity * len(b):
        return False
    common = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return bool(100 * common >= similarity * (len(a) + len(b) - common))


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.empty(0, np.uint64)  # rows of one ``a`` come together
        for batch in batches:
            for part in in_slices(batch, "text_b"):
                a, keep = part.column("a").to_pylist(), []
                for i, other in enumerate(shingle_sets(*utf8(part.column("text_b")), words)):
                    text = part.column("text_a")[i]
                    if (a[i], text) != last:
                        last, own = (a[i], text), next(shingle_sets(*utf8(part.column("text_a").slice(i, 1)), words))
                    keep.append(similar(own, other, similarity))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long")


def _tiles(met: DataFrame) -> DataFrame:
    """Bands with documents of more than one group, dealt into pairs of blocks of bounded size."""
    groups = met.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = met.join(groups.where("low <> high").select("key", "n"), "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = mixed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    rows = rows.withColumn("tile", F.explode(tiles))
    return rows.select("key", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "own", "doc_id", "component", "n_shingles", "bits", "bands")


def _by_tile(rows: DataFrame, work, schema: str) -> DataFrame:
    """Applies ``work`` to the rows of each tile, which come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch]).combine_chunks()
            cuts = _changes(table)
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                yield from work(table.slice(start, end - start))
            left = table.slice(cuts[-1]) if len(cuts) else None
        if left is not None:
            yield from work(left)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _changes(table: pa.Table) -> np.ndarray:
    """Rows at which another tile begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for name in ("key", "i", "j"):
        new[1:] |= np.diff(table.column(name).to_numpy()) != 0
    return np.flatnonzero(new)


def _possible(tile: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a tile, best estimates first, that may join two groups, and their estimates.

    A pair belongs to the first band that its documents share, so no other tile has it.
    Documents of the tile's largest group are not compared with one another.
    """
    group, sizes, own = (tile.column(c).to_numpy() for c in ("component", "n_shingles", "own"))
    bits, bands = (tile.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1) for c in ("bits", "bands"))
    bits, key, i, j = bits.view(np.uint64), tile.column("key")[0].as_py(), tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
    names, counts = np.unique(group, return_counts=True)
    other = np.flatnonzero(group != names[counts.argmax()])
    rank = np.zeros(len(group), np.int64)
    rank[other] = np.arange(1, len(other) + 1)
    xs, ys, values = [], [], []
    for at in range(0, len(other), 64):
        x = other[at : at + 64]
        value = _estimates(bits[x], bits)
        may = (value >= least) & (group[x][:, None] != group[None, :]) & (rank[x][:, None] > rank[None, :])
        if i != j:
            may &= own[x][:, None] != own[None, :]
        one, two = sizes[x][:, None], sizes[None, :]
        may &= 100 * np.minimum(one, two) >= (100 * least) * np.maximum(one, two)
        a, b = np.nonzero(may)
        first = (bands[x[a]] == bands[b]).argmax(axis=1)
        mine = bands[b, first] == key
        xs.append(x[a[mine]])
        ys.append(b[mine])
        values.append(value[a[mine], b[mine]])
    if not xs:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    x, y, value = np.concatenate(xs), np.concatenate(ys), np.concatenate(values)
    order = np.argsort(-value, kind="stable")
    return x[order], y[order], value[order]


def _joined(met: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Confirmed links (a, b) between different groups; per tile only as many as join groups."""
    least = similarity / 100 - MARGIN

    def involved(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, _ = _possible(tile, least)
        if len(x):
            yield from tile.take(pa.array(np.unique(np.concatenate([x, y])))).combine_chunks().to_batches()

    def confirm(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y, _ = _possible(tile, least)
        doc, group = tile.column("doc_id").to_numpy(), tile.column("component").to_numpy()
        text = tile.column("text").combine_chunks()
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def top(g: int) -> int:
            while g in root:
                g = root[g]
            return g

        found = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            one, two = top(int(group[a])), top(int(group[b]))
            if one == two:
                continue
            for r in (a, b):
                if r not in sets:
                    sets[r] = next(shingle_sets(*utf8(text.slice(r, 1)), words))
            if similar(sets[a], sets[b], similarity):
                root[max(one, two)] = min(one, two)
                found.append((int(doc[a]), int(doc[b])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    tiles = _tiles(met)
    kinds = ", ".join(f"{n} {k}" for n, k in tiles.dtypes)
    few = stored(_by_tile(tiles, involved, kinds), "tiles")
    return _by_tile(few.join(texts, "doc_id").select(*few.columns, "text"), confirm, "a long, b long")


def linked(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    marks = stored(signed(docs, words), "signed")
    solid = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = solid.groupBy("digest").agg(F.min("doc_id").alias("leader"))
    whole = marks.join(classes, "digest", "left")
    first = (F.col("doc_id") == F.col("leader")) & (F.col("n_shingles") > 0)
    whole = whole.select("doc_id", "n_shingles", "leader", F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("bits")).alias("bits"))
    whole = stored(whole, "classes")

    leaders = whole.where("bands IS NOT NULL")
    bands = leaders.select(F.explode("bands").alias("key"), "doc_id")
    shared = bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    met = stored(bands.join(shared, "key").select("key", "a", "doc_id"), "bands")
    pairs = met.where("a < doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("a").alias("a"))
    bits = leaders.select("doc_id", "bits")
    least = similarity / 100 - MARGIN
    pairs = pairs.join(bits.select(F.col("doc_id").alias("b"), F.col("bits").alias("bits_b")), "b")
    pairs = pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("bits").alias("bits_a")), "a")
    pairs = stored(pairs.where(estimate(F.col("bits_a"), F.col("bits_b")) >= least).select("a", "b"), "pairs")

    touched = met.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = stored(texts.join(touched, "doc_id", "left_semi"), "texts")
    same = whole.where("leader < doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    edges = stored(confirmed(pairs, texts, words, similarity), "links")
    groups = stored(components(edges), "groups")

    marked = leaders.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    marked = marked.select("doc_id", "n_shingles", "bits", "bands", F.coalesce("component", "doc_id").alias("component"))
    mixed = met.select("key", "doc_id").join(marked, "doc_id")
    edges = edges.unionByName(stored(_joined(mixed, texts, words, similarity), "links"))
    if marks.groupBy("doc_id").count().where("count > 1").limit(1).count():  # rows of one document tie their classes
        edges = edges.unionByName(same)
        loose = True
    else:
        loose = False
    groups = stored(components(edges), "groups")

    node = F.col("doc_id") if loose else F.col("leader")
    out = whole.withColumn("node", F.coalesce(node, F.col("doc_id"))).join(groups, "node", "left")
    component = F.coalesce("component", "node")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` without those that another document of their group stands for.

    Of rows that repeat a doc_id with the same text one stays; only such rows are shuffled.
    """
    gone = linked(docs, words, similarity).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    left = docs.join(stored(gone, "gone"), F.col("doc_id") == F.col("gone"), "left_anti")
    again = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("again")).count().where("count > 1")
    again = stored(again.select("again"), "again")
    if not again.limit(1).count():
        return left
    is_again = F.col("doc_id") == F.col("again")
    repeated = left.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, is_again, "left_anti").unionByName(repeated)

"""Token ids through coded blocks and back: exact round trips, against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellaudit.llm import id_files, packing, range_coder
from cellaudit.llm.tables import table

TEXTS = [
    None, "", " ", "a", "a  b", " a \n\n b\t\tc ", "x\n y", "x \ny", "it's I'll <|endoftext|> we're", "<|endoftext|>", "née 日本語    x \x1c y",
    "tail ", "tail\n", "  ", "!", "!!! ! !", "\u0000 a\u0000b", "word " * 30_000, "ab" * 9_000, "é 🎉🎉 🎉",
]


def library(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*x.ids, 0], "<u4") for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def blocks_of(rng):
    n = range_coder.BLOCK
    words = rng.integers(0, 50_257, 300)
    return [
        np.empty(0, np.uint32), np.zeros(1, np.uint32), np.array([2**32 - 1], np.uint32), np.full(n, 7, np.uint32),
        rng.permutation(50_257)[:n].astype(np.uint32), rng.integers(0, 2**32, n, np.uint32), words[rng.zipf(1.3, n) % 300].astype(np.uint32),
        np.tile(np.arange(50, dtype=np.uint32) * 1000, n // 50), np.arange(17, dtype=np.uint32), rng.integers(0, 3, 1000).astype(np.uint32),
    ]


def test_blocks_come_back():
    blocks = blocks_of(np.random.default_rng(1))
    coded = range_coder.encode(blocks)
    for block, back in zip(blocks, range_coder.decode(coded), strict=True):
        assert np.array_equal(block, back)
    assert range_coder.encode([]) == [] and range_coder.decode([]) == []


def test_a_block_needs_no_other():
    blocks = blocks_of(np.random.default_rng(2))
    together = range_coder.encode(blocks)
    for block, data in zip(blocks, together, strict=True):
        assert range_coder.encode([block]) == [data]
        assert np.array_equal(range_coder.decode([data])[0], block)


def test_more_blocks_than_lanes(monkeypatch):
    monkeypatch.setattr(range_coder, "LANES", 3)
    blocks = blocks_of(np.random.default_rng(3))
    for block, back in zip(blocks, range_coder.decode(range_coder.encode(blocks)), strict=True):
        assert np.array_equal(block, back)


def test_what_repeats_gets_short():
    rng = np.random.default_rng(4)
    n = range_coder.BLOCK
    plain, periodic = rng.integers(0, 256, n).astype(np.uint32), np.tile(np.arange(40, dtype=np.uint32), n // 40 + 1)[:n]
    skewed = np.where(rng.random(n) < 0.9, 5, rng.integers(0, 256, n)).astype(np.uint32)
    sizes = [len(x) for x in range_coder.encode([plain, periodic, skewed])]
    assert sizes[0] < 1.15 * n and sizes[1] < 0.15 * n and sizes[2] < 0.35 * n


def test_the_format_stays():
    """A faster coder writes the same bytes, so that files written before can be read."""
    assert zlib.crc32(b"".join(range_coder.encode(blocks_of(np.random.default_rng(7))))) == 1715837121


@pytest.mark.parametrize("change", ["flip", "cut", "grow", "magic", "empty"])
def test_broken_blocks_are_noticed(change):
    ids = np.random.default_rng(5).integers(0, 500, 2000).astype(np.uint32)
    good = range_coder.encode([ids])[0]
    for place in (24, 40, len(good) // 2, len(good) - 8):
        flipped = good[:place] + bytes([good[place] ^ 16]) + good[place + 1 :]
        bad = {"flip": flipped, "cut": good[:place], "grow": good + b"x", "magic": b"x" + good[1:], "empty": b""}[change]
        with pytest.raises(range_coder.BlockError):
            range_coder.decode([bad])


def test_checksums_of_parts_make_the_whole():
    data = np.random.default_rng(6).bytes(70_000)
    for cuts in ([0, 1], [0, 16_384, 32_768, 69_999], [0, 35_000]):
        crc = 0
        for start, end in zip(cuts, [*cuts[1:], len(data)], strict=True):
            crc ^= id_files.moved(zlib.crc32(data[start:end]), len(data) - end)
        assert crc == zlib.crc32(data)


ODD = [*TEXTS, "\x85 b", "a\x85", "x\u3000y z", "a\xa0b c", "a\x1cb c", "\x1c", "'s 's", "a\nb\n\nc", "don't  <|endoftext|>", "a.\u2028 b", "\u2003", "w w w"]


def test_texts_side_by_side_have_their_own_ids():
    encoder = packing.encoder(packing.VOCABULARY)
    for texts in (ODD, ODD[::-1], [t for t in ODD for _ in range(2)], ["a"], [""], []):
        given = [t or "" for t in texts]
        assert encoder.encode_all(given, 0) == [x.tobytes() for x in library(given)]
    assert encoder.encode_all(["a b", "", "  "], 9) == [encoder.encode(t) + b"\x09\0\0\0" for t in ("a b", "", "  ")]


def test_white_space_is_known():
    blanks = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert blanks == {chr(c) for c in range(128) if packing._BLANKS[c] == 0x20} | set(packing._OTHER_BLANKS)


def test_shared_words_are_encoded_once(monkeypatch):
    encoder, given = packing.Encoder(packing.VOCABULARY), []
    library_call = encoder._single.encode_to_numpy
    monkeypatch.setattr(encoder._single, "encode_to_numpy", lambda text, **more: given.append(len(text)) or library_call(text, **more), raising=False)
    texts = ["the same words come again and again " * 200 + f"number {i}" for i in range(50)]
    assert encoder.encode_all(texts, 0) == [x.tobytes() for x in library(texts)]
    assert sum(given) < 1000 < sum(map(len, texts)) / 100


def expected(rows):
    """rows in the order of the files."""
    out, start = [], 0
    for (key, _), ids in zip(rows, library([t for _, t in rows]), strict=True):
        out.append((key, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_documents_through_files(spark, tmp_path):
    rows = [(10 * i - 40, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, 1, b"x", 5) for r in rows[::-1]], "doc_id long, text string, part int, data binary, DOCS int").repartition(5)
    found = id_files.round_trip(docs, location=str(tmp_path / "ids"))
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in found.collect()) == expected(rows)
    blocks = id_files.files(spark, str(tmp_path / "ids"))
    assert blocks.agg(F.max("n_ids")).first()[0] == range_coder.BLOCK
    pieces = id_files.documents(blocks).collect()
    whole = {}
    for piece in sorted(pieces, key=lambda r: r["offset"]):
        whole[piece["doc_id"]] = whole.get(piece["doc_id"], b"") + piece["ids"]
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in whole.items()} == dict(zip([k for k, _ in rows], map(list, library(TEXTS)), strict=True))


def test_rows_without_or_with_equal_ids(spark):
    docs = spark.createDataFrame([(None, "one"), (3, "b"), (3, "a a"), (3, "a a"), (None, None), (-1, "x")], "doc_id long, text string")
    found = [tuple(r) for r in id_files.round_trip(docs).orderBy("start").collect()]
    assert [r[0] for r in found] == [None, None, -1, 3, 3, 3]
    starts = np.cumsum([0, *[r[2] for r in found]])
    assert [r[1] for r in found] == starts[:-1].tolist()
    texts = ["one", "b", "a a", "a a", "", "x"]
    assert sorted(r[3] for r in found) == sorted(zlib.crc32(x) for x in library(texts))


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert id_files.round_trip(docs).collect() == []


def test_the_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    assert sorted(tuple(r) for r in id_files.round_trip(docs).collect()) == expected(rows)

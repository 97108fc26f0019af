"""Reading notebooks: what is readable, and what its cells hold."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import code_cell, corpus, notebook

from cellaudit.functions import fixed
from cellaudit.operators import cells, engine
from cellaudit.sources import notebooks as source


def parsed(spark, contents):
    rows = source.parse_notebooks(corpus(spark, contents)).collect()
    return sorted(rows, key=lambda r: int(r["path"]))


def test_readable(spark):
    good = [
        notebook(code_cell("x")),
        "  " + notebook() + "\n" * 200,
        '{"cells": [], "cells": []}',
        '{"metadata": {"x": NaN, "y": [Infinity]}}',
        '{"metadata": {}}',
        "{}",
    ]
    bad = [
        "", "null", "[1]", '"text"', '{"a": 1', '{"a": 1} x', "{'a': 1}", '{"a": "b\nc"}', '{"metadata": null}', '{"metadata": []}',
        '{"metadata": {"kernelspec": null}}', '{"metadata": {"kernelspec": {"language": null}}}', '{"metadata": {"kernelspec": {"language": 3}}}',
    ]
    rows = parsed(spark, good + bad)
    assert [r["readable"] for r in rows] == [True] * len(good) + [False] * len(bad)
    assert [r["language"] for r in rows] == ["python"] * len(good) + [None] * len(bad)


def read_whole(spark, contents):
    """The same notebooks, none of them in the usual way."""
    before = source._NAME
    source._NAME, usual = "cell", source._USUAL
    source._USUAL = usual.replace(before, "cell")
    try:
        return parsed(spark, contents)
    finally:
        source._NAME, source._USUAL = before, usual


def test_both_ways_of_reading_agree(spark):
    cells = [
        {"cell_type": "code", "source": ["a"]}, {"cell_type": "code", "source": "a", "title": None}, {"cell_type": 5, "source": ["a", 1]}, {"cell_type": None},
        {"Source": ["x"]}, {}, {"cell_type": "markdown", "source": None, "title": 3, "outputs": [{"text": ["x" * 50]}]}, {"title": {"a": []}, "source": []}, None, 5, [1], "s",
    ]
    books = [json.dumps({"cells": [c]}) for c in cells] + [json.dumps({"cells": cells[:k]}) for k in range(9)]
    books += [json.dumps({"metadata": m, "cells": [cells[0]]}) for m in (None, [], {}, {"kernelspec": None}, {"kernelspec": {"language": "SQL"}}, {"kernelspec": {"language": 3}}, 7, "m")]
    books += ['{"cells":null}', '{"cells":{}}', '{"cells":"s"}', '{"cells":[]}', "{}", '{"cells":[{"source":["a"]}]', '{"cells":[]},{"cells":[]}', '{"cells":[{"outputs":01}]}', '{"cells":[{"source":["a"],"source":["b"]}],"cells":[{"source":["c"]}]}']
    books += ['{"cells":[]}],"%s":[{"cells":[]}' % source._NAME, json.dumps({"cells": [code_cell(source._NAME)]}), '{"cells":[{"source":["\\u0041\\n"]}],"x":[NaN,-Infinity]}', '{"cells":[{"outputs":"\t"}]}']
    assert parsed(spark, books) == read_whole(spark, books)
    by_path = {r["path"]: r for r in parsed(spark, books)}
    trick = books.index('{"cells":[]}],"%s":[{"cells":[]}' % source._NAME)
    assert not by_path[str(trick)]["readable"] and by_path[str(trick + 1)]["cells"][0]["source"] == [source._NAME]


def test_outputs_of_any_size_are_skipped(spark):
    """More than one value may hold; only the cells' own parts are kept."""
    rows = spark.range(1).select(
        F.lit("/big").alias("path"),
        F.concat(F.lit('{"cells":[{"cell_type":"code","source":["SELECT * FROM t"],"outputs":[{"data":"'), F.repeat(F.lit("0123456789"), 20_000_000), F.lit('"}]}]}')).alias("content"),
    )
    found = engine.validate(rows).filter(F.col("status") == fixed.FAILED).select("rule").collect()
    assert fixed.LABEL_SELECT_STAR in {r["rule"] for r in found} and fixed.ACCESS_LABEL not in {r["rule"] for r in found}


def test_last_of_repeated_keys_counts(spark):
    (row,) = parsed(spark, ['{"cells": [{"cell_type": "markdown", "cell_type": "code", "source": ["a"], "source": ["b"]}]}'])
    assert [(c["cell_type"], c["source"]) for c in row["cells"]] == [("code", ["b"])]


def test_sources_and_titles(spark):
    books = [
        notebook(
            {"cell_type": "code"}, code_cell(), code_cell("a\n", "b"), {"cell_type": "code", "source": "a\nb"}, {"cell_type": "code", "source": None},
            {"cell_type": "code", "source": ["a", 1]}, {"cell_type": "code", "source": ["a", None]}, {"cell_type": "code", "source": {"a": 1}},
            {"cell_type": "code", "source": 3}, code_cell(title=None), code_cell(title=3), code_cell(title=" t "), {"source": ["x"]}, 5,
        )
    ]
    (row,) = parsed(spark, books)
    bad = source.BAD_SOURCE
    assert [c["source_problem"] for c in row["cells"]] == [None] * 4 + [fixed.NULL_SOURCE] + [bad] * 4 + [None] * 4 + [source.BAD_CELLS]
    assert [c["source"] for c in row["cells"][:4]] == [[], [], ["a\n", "b"], ["a\nb"]]
    assert [c["title_problem"] for c in row["cells"][9:12]] == [fixed.NULL_TITLE, source.BAD_TITLE, None]
    assert [c["pos"] for c in row["cells"]] == list(range(14))


def test_code_is_joined_in_cell_order(spark):
    books = [notebook(code_cell("a\n", "b"), {"cell_type": "markdown", "source": ["no"]}, code_cell(), code_cell("c")), notebook()]
    rows = sorted(engine.prepared(corpus(spark, books)).collect(), key=lambda r: r["path"])
    assert [r["code"] for r in rows] == ["a\n\nb\n\nc", ""]


def test_a_very_long_line(spark):
    """Longer than parsers allow a single string by default."""
    long = "x" * 25_000_000
    book = json.dumps({"cells": [code_cell(long, "SELECT *")]})
    row = engine.prepared(corpus(spark, [book])).selectExpr("readable", "length(code) as n").first()
    assert (row["readable"], row["n"]) == (True, len(long) + 9)


def test_notebook_files(spark, tmp_path):
    for name in ("a.ipynb", "Users/me/b.ipynb", "c.txt"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(notebook(code_cell(name)))
    books = engine.prepared(source.load_notebook_files(spark, str(tmp_path)))
    assert sorted((r["path"], r["code"]) for r in books.collect()) == [("/Users/me/b", "Users/me/b.ipynb"), ("/a", "a.ipynb")]


def test_files_are_read_byte_by_byte(spark, tmp_path):
    """As Spark's reader of texts gives them, whose every file copies the configuration; packed ones are unpacked."""
    (tmp_path / "empty.ipynb").touch()  # Spark lists no empty files
    texts = {"bytes": b"\xff\xfe\r\n\x00 \xc3", "mark": b"\xef\xbb\xbf{}\n", "plain": "{\"ü\"}".encode()}
    for name, text in texts.items():
        (tmp_path / f"{name}.ipynb").write_bytes(text)
        (tmp_path / f"{name}.ipynb.gz").write_bytes(gzip.compress(text))
    for suffix in (".ipynb", ".ipynb.gz", "ipynb.gz"):
        books = source.load_notebook_files(spark, str(tmp_path), suffix=suffix)
        assert ("FileScan binaryFile" in books._jdf.queryExecution().executedPlan().toString()) == (suffix == ".ipynb")
        found = books.select(F.regexp_replace("path", r"^/|\.$", "").alias("path"), F.hex(F.col("content").cast("binary")).alias("content"))
        assert dict(map(tuple, found.collect())) == {name: text.hex().upper() for name, text in texts.items()}
        files = spark.read.text(str(tmp_path), wholetext=True, pathGlobFilter=f"*{suffix}").select(F.hex(F.col("value").cast("binary")))
        assert sorted(r[0] for r in files.collect()) == sorted(text.hex().upper() for text in texts.values())


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"f{i}").mkdir()
        (tmp_path / f"f{i}" / "a.ipynb").write_text(notebook(code_cell(f"x = {i}")))
    context, before = spark.sparkContext, spark.conf.get(source.LISTING)
    context.setJobGroup("listing", "")
    try:
        books = source.load_notebook_files(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(k) for job in tracker.getJobIdsForGroup("listing") for k in tracker.getJobInfo(job).stageIds]
    assert 0 < sum(stage.numTasks for stage in stages) <= 4 * context.defaultParallelism
    assert spark.conf.get(source.LISTING) == before
    assert sorted(r["path"] for r in books.collect()) == sorted(f"/f{i}/a" for i in range(120))


ODD_PATHS = ["/Users/u1/a", "/Users/u1/b c+d%2F e", "/Users/ü1/日本=1", "_hidden", ".hidden", "a:b?{c}[d]^*'\"#\\\t", "__HIVE_DEFAULT_PARTITION__x", "x._COPYING_", "y" * 240]


def test_every_notebook_is_one_file(spark, tmp_path):
    rows = [(p, f"{p}\nü", n % 3 or None, "k=/") for n, p in enumerate(ODD_PATHS)] + [("twice", "1", 1, ""), ("twice", "1", 1, None)]
    rows += [(None, "no path", 2, "k"), ("no text", None, 2, "k"), ("", "none either", 2, "k")]
    books = spark.createDataFrame(rows, "path string, content string, n int, k string")
    want = sorted([*[(p, f"{p}\nü\n") for p in ODD_PATHS], ("twice", "1\n1\n"), ("no text", "\n")])

    def read(location):
        found = source.load_notebook_files(spark, f"{location}/n=*/k=*", suffix=".txt")
        rows = sorted(map(tuple, found.select(source.written_path(), "content").collect()))
        nameless = [row for row in rows if row[0] == "__HIVE_DEFAULT_PARTITION__"]
        assert len(nameless) == 1 and sorted(nameless[0][1].splitlines()) == ["no path", "none either"]
        return [row for row in rows if row not in nameless]

    source.write_notebook_files(books, str(tmp_path / "a"), "n", "k")
    assert read(tmp_path / "a") == want
    files = [f for f in (tmp_path / "a").rglob("*") if f.is_file()]
    assert len(files) == len(want) + 1  # nothing beside them, and no folder for each
    assert len({f.parent for f in files}) == len({(r[2], r[3] or None) for r in rows})
    source.write_notebook_files(books, f"file://{tmp_path}/b", "n", "k")
    assert read(tmp_path / "b") == want
    with pytest.raises(ValueError):
        source.write_notebook_files(books, str(tmp_path / "a"), "n", "k")


def test_notebook_files_in_other_stores(spark, tmp_path, monkeypatch):
    # Spark takes folders whose names end like this for unfinished copies
    seen = [p for p in ODD_PATHS if not p.endswith("._COPYING_")]
    rows = [(p, f"{p}\nü", n % 3 or None) for n, p in enumerate(seen)] + [("twice", "1", 1), ("twice", "1", 1), (None, "no path", 2), ("no text", None, 2)]
    books = spark.createDataFrame(rows, "path string, content string, n int")
    assert source._mounted(spark, "s3://bucket/a") is None and source._mounted(spark, "hdfs:/a") is None
    assert source._mounted(spark, "file:/a/b") == source._mounted(spark, "file:///a/b") == source._mounted(spark, "/a/b") == "/a/b"

    def back(location):
        source.write_notebook_files(books, str(location), "n")
        found = source.load_notebook_files(spark, f"{location}/n=*", suffix=".txt")
        return sorted(map(tuple, found.select(source.written_path(), "content").collect()))

    here = back(tmp_path / "here")
    monkeypatch.setattr(source, "_mounted", lambda spark, location: None)
    assert back(tmp_path / "there") == here and len(here) == len(rows) - 1


def test_requested_paths(spark, tmp_path):
    lines = tmp_path / "paths.txt"
    lines.write_text("  /Workspace/a \n\n/a\n/a\n\t/b \n   \n/missing\n")
    books = corpus(spark, []).sparkSession.createDataFrame([("/a", "{}"), ("/Workspace/b", "{}"), ("/c", "{}")], "path string, content string")
    wanted = source.paths_from_file(spark, str(lines))
    found = source.load_requested(books, wanted).select("path", "copies").collect()
    assert sorted(map(tuple, found)) == [("/Workspace/a", 1), ("/a", 2), ("/b", 1)]
    assert sorted(map(tuple, source.notebook_exists(books, wanted).collect())) == [
        ("/Workspace/a", True), ("/a", True), ("/b", True), ("/missing", False),
    ]
    access = engine.validate_requested(books, wanted).filter(f"rule = '{fixed.ACCESS_LABEL}'").collect()
    assert [r["details"] for r in access] == ["Failed to process notebook /missing: Failed to fetch notebook /missing"]


def test_notebook_without_cells_keeps_an_empty_row(spark):
    rows = cells.explode_cells(source.parse_notebooks(corpus(spark, ["{}", notebook(code_cell("a"))]))).collect()
    assert sorted((r["path"], r["pos"], r["cell_type"]) for r in rows if r["pos"] is not None) == [("1", 0, "code")]
    assert [r["path"] for r in rows if r["pos"] is None] == ["0"]


def test_a_notebook_asked_for_very_often(spark):
    """Evaluated once; its findings are repeated piece by piece, none lost."""
    often = 2500
    wanted = spark.range(often).select(F.lit("/a").alias("path")).union(spark.createDataFrame([("/b",)], "path string"))
    books = spark.createDataFrame([("/a", notebook(code_cell("SELECT *"))), ("/b", "[]")], "path string, content string")
    once = engine.validate(books).groupBy("notebook_path").count().collect()
    found = engine.validate(source.load_requested(books, wanted))
    many = found.groupBy("notebook_path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("audit_id").alias("ids")).collect()
    expected = {r["notebook_path"]: r["count"] * (often if r["notebook_path"] == "/a" else 1) for r in once}
    assert {r["notebook_path"]: r["n"] for r in many} == {r["notebook_path"]: r["ids"] for r in many} == expected


def test_selected_paths_reach_the_scan(spark, tmp_path):
    books = spark.createDataFrame([("/a", "{}"), ("/Workspace/b", "{}"), ("/c", "{}"), ("/Workspace/d", "{}")], "path string, content string")
    books.write.parquet(str(tmp_path / "books"))
    chosen = source.select_paths(spark.read.parquet(str(tmp_path / "books")), ["/Workspace/a", "/b", "/Workspace/d", "/none"])
    assert sorted(r["path"] for r in chosen.collect()) == ["/Workspace/b", "/Workspace/d", "/a"]
    assert "PushedFilters: [In(path" in chosen._jdf.queryExecution().executedPlan().toString()

"""Reading a corpus of exported notebooks and unpacking it into cells.

A corpus is a table ``(path, content)``.  ``parse_notebooks`` is one narrow
projection: no shuffle and no Python, whatever the number of notebooks.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text

# Same notion of valid JSON as a strict reader, but NaN and Infinity are allowed
# (plot outputs hold them) and one string may be as long as a string can be.
JSON_OPTIONS = {
    "allowNonNumericNumbers": "true",
    "allowSingleQuotes": "false",
    "maxStringLen": str(2**31 - 1),
}

BAD_CELLS = "cells is not a list of cells"
BAD_SOURCE = "cell source is not a list of strings"
BAD_TITLE = "cell title is not a string"


#: Tasks that list folders; by default Spark starts one for nearly each folder.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Endings of files that Spark's reader of texts unpacks.
_PACKED = (".gz", ".gzip", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz", ".passthrough")


# ---- SRC1 ------------------------------------------------------------------
@contextmanager
def _listed_evenly(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks for each core; to start a task takes longer than to list a small folder."""
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(min(int(spark.conf.get(LISTING)), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)


def load_notebook_files(spark: SparkSession, *locations: str, suffix: str = ".ipynb") -> DataFrame:
    """One row per notebook file under the locations; path as seen from its location.

    A location is a folder, or a pattern that names folders (``/exports/*/nightly``), in
    any store that Spark reads.  Spark lists folders, in parallel where there are many,
    and every task reads its share of the files.  They are read as bytes, since Spark's
    reader of texts copies the whole configuration for each file, one task at a time; only
    files that may be packed are left to it, as it unpacks them.
    """
    if not locations:
        raise ValueError("name a folder of notebooks")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    may_be_packed = not suffix.startswith(".") or suffix.lower().endswith(_PACKED)
    value = F.col("value" if may_be_packed else "content").cast("string")
    found = []
    for location in locations:
        # Spark names files by their qualified, encoded path; the parts behind the location's own are kept.
        decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        parts = F.split(F.regexp_replace(decoded, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", ""), "/")
        below = F.slice(parts, F.lit(_depth(location) + 1), F.size(parts))
        path = F.concat(F.lit("/"), F.regexp_replace(F.array_join(below, "/"), rf"\Q{suffix}\E$", ""))
        with _listed_evenly(spark):
            texts = files.text(location, wholetext=True) if may_be_packed else files.format("binaryFile").load(location)
        found.append(texts.select(path.alias("path"), value.alias("content")))
    return reduce(DataFrame.unionByName, found)


def write_notebook_files(books: DataFrame, location: str, *by: str) -> None:
    """Every notebook as a file of its own in a new location, in folders by the columns ``by``.

    Folders are named as ``partitionBy`` names them, files by the path: ``written_path``
    gives it back.  A file holds lines of text as Spark writes them, so rows of one path
    share a file.  Each file appears at once and whole, also when its task is repeated.

    On a disk that is mounted, tasks make the files themselves: without its native
    library, Hadoop starts processes for each file there, to set its permissions.  In any
    other store Spark writes them, into a folder for each notebook.
    """
    spark, columns = books.sparkSession, [*by, "name"]
    named = books.select(*by, F.col("path").alias("name"), F.col("content").alias("value"))
    # An own number of even tasks, which is not lowered by size: to make a file costs more than its bytes.
    tasks = 4 * spark.sparkContext.defaultParallelism
    root = _mounted(spark, location)
    if root is None:
        return named.repartition(tasks, *columns).write.partitionBy(*columns).text(location)
    if os.path.exists(root):
        raise ValueError(f"{location} is there already")
    texts = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(_NO_VALUE)).alias(c) for c in columns]
    files = named.select(*texts, F.col("value").cast("binary").alias("value"))
    sorted_files = files.repartition(tasks, *columns).sortWithinPartitions(*columns)
    sorted_files.mapInArrow(_file_writer(root, list(by)), "files bigint").count()
    return None


def written_path() -> Column:
    """The notebook's path, of the path that ``load_notebook_files`` gives a file of ``write_notebook_files``."""
    name = F.regexp_extract("path", "^/(?:name=)?([^/]+)(?:/part-[^/]+)?$", 1)
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


#: As ``partitionBy`` writes them: a value that is missing, and what is no part of a name.
_NO_VALUE, _NOT_IN_NAMES = "__HIVE_DEFAULT_PARTITION__", re.compile("[\\x01-\\x1f\\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def _in_names(value: str) -> str:
    return _NOT_IN_NAMES.sub(lambda m: f"%{ord(m[0]):02X}", value)


def _file_writer(root: str, by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes sorted rows ``(*by, name, value)``; gives the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(zip(*[c.to_pylist() for c in batch.columns[:-1]]), batch.columns[-1]))
        made = 0
        for names, lines in itertools.groupby(rows, key=lambda row: row[0]):
            folder = "/".join([root, *[f"{_in_names(c)}={_in_names(v)}" for c, v in zip(by, names)]])
            # Spark takes files for hidden that begin with a dot or an underscore.
            name = re.sub("^[._]", lambda m: f"%{ord(m[0]):02X}", _in_names(names[-1]))
            unfinished = f"{folder}/.{uuid.uuid4().hex}"
            os.makedirs(folder, exist_ok=True)
            with open(unfinished, "wb") as file:
                for _, value in lines:
                    file.write((value.as_py() or b"") + b"\n")
            os.replace(unfinished, f"{folder}/{name}.txt")
            made += 1
        yield pa.RecordBatch.from_pydict({"files": [made]})

    return write


def _mounted(spark: SparkSession, location: str) -> str | None:
    """The location as a path of the file system that is mounted on all machines; None if it is in another store."""
    named = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://[^/]*)?", location)
    store = named[1] if named else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").partition(":")[0]
    return os.path.abspath(location[named.end() :] if named else location) if store == "file" else None


def _depth(location: str) -> int:
    """How many parts the path of a location has; one without a store is a local path if relative."""
    named = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", location)
    path = location[named.end() :] if named else location
    if not path.startswith("/") and not named:
        path = os.path.abspath(path)
    return len([part for part in path.split("/") if part not in ("", ".")])


def decode_notebooks(exported: DataFrame, encoded: str = "content_b64") -> DataFrame:
    """Exported notebooks as delivered, base64 text, to ``(path, content)``."""
    return exported.select("path", F.decode(F.unbase64(encoded), "UTF-8").alias("content"))


# ---- SRC4 ------------------------------------------------------------------
def normalize_path(path: Column) -> Column:
    """The path used for look-up: one leading workspace prefix removed."""
    return F.when(
        F.startswith(path, F.lit(fixed.WORKSPACE_PREFIX)),
        F.substr(path, F.lit(len(fixed.WORKSPACE_PREFIX))),
    ).otherwise(path)


# ---- SRC2, SRC3, SRC5 ------------------------------------------------------
def select_paths(corpus: DataFrame, paths: list[str]) -> DataFrame:
    """The notebooks of a short list of paths, with or without workspace prefix.

    Both forms are listed, so the filter is on the plain column and reaches the scan.
    """
    prefix = fixed.WORKSPACE_PREFIX
    keys = {"/" + path.removeprefix(prefix) if path.startswith(prefix) else path for path in paths}
    return corpus.filter(F.col("path").isin(sorted(keys | {prefix + key.removeprefix("/") for key in keys})))


def paths_from_file(spark: SparkSession, location: str) -> DataFrame:
    """Requested paths, one per line; padding and blank lines are dropped."""
    return clean_paths(spark.read.text(location).select(F.col("value").alias("path")))


def clean_paths(lines: DataFrame) -> DataFrame:
    return lines.select(text.strip(F.col("path")).alias("path")).filter(F.length("path") > 0)


def _wanted(requested: DataFrame) -> DataFrame:
    # Repeats of a path are counted here, before any shuffle of notebooks, so a
    # path asked for a million times is still one row of the join.
    return requested.groupBy("path").agg(F.count(F.lit(1)).alias("copies"))


def load_requested(corpus: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested notebooks, each once, with how often it was asked for.

    Whatever is computed from them is repeated at the end (``rows.repeated``), not
    the notebooks: one asked for a million times is parsed and evaluated once.
    """
    wanted = _wanted(requested).withColumn("key", normalize_path(F.col("path")))
    have = corpus.select(normalize_path(F.col("path")).alias("key"), "content")
    return wanted.join(have, "key").select("path", "content", "copies")


def _keys_present(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    # The corpus is filtered by the requests first: a short list is broadcast, and
    # of the corpus only the paths asked for are shuffled.
    have = corpus.select(normalize_path(F.col("path")).alias("key"))
    return have.join(wanted.select("key"), "key", "left_semi").distinct()


def notebook_exists(corpus: DataFrame, requested: DataFrame) -> DataFrame:
    """Every distinct requested path with a flag: is it in the corpus?"""
    wanted = _wanted(requested).select("path", normalize_path(F.col("path")).alias("key"))
    found = _keys_present(corpus, wanted).withColumn("found", F.lit(True))
    return wanted.join(found, "key", "left").select("path", F.col("found").isNotNull().alias("present"))


# ---- SRC6 ------------------------------------------------------------------
def missing_notebooks(corpus: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested paths the corpus lacks, with how often each was asked for."""
    wanted = _wanted(requested).withColumn("key", normalize_path(F.col("path")))
    return wanted.join(_keys_present(corpus, wanted), "key", "left_anti").select("path", "copies")


# ---- PRJ1, PRJ2 ------------------------------------------------------------
def _at(variant: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(variant, f"$.{name}", kind)


def _looks_like_object(content: Column) -> Column:
    # The parser accepts any JSON value; an object opens and closes the text.  Texts
    # are trimmed only where needed.
    blanks, opening, closing = F.lit(text.JSON_BLANKS), F.lit("{"), F.lit("}")
    opens = F.startswith(content, opening) | F.startswith(F.ltrim(content, blanks), opening)
    closes = F.endswith(content, closing) | F.endswith(F.rtrim(content, blanks), closing)
    return opens & closes


# Notebooks are read in one of two ways.  Most have the usual shape: their cells are a list
# of objects.  Of these only the parts that are used are kept, each as a value of its own,
# and whatever else there is (outputs above all) is skipped as it is read, so its size does
# not matter.  Others, and texts that are no JSON at all, are read whole, as one value.
#
# The parser stops after the first value.  So a text is read as the first element of a list
# whose second one holds the text's length: whatever follows the object is an error or makes
# the list another one.  A text that holds the list's own name is read the other way.
_NAME, _ODD = "whole notebook and its length", "other shape"
_CELL = "struct<cell_type:variant,source:variant,title:variant>"
_USUAL = f"struct<`{_NAME}`:array<struct<metadata:variant,cells:array<{_CELL}>,length:bigint>>,`{_ODD}`:string>"


def _usual_shape(content: Column, size: Column) -> Column:
    """The notebook's used parts beside its length; ``_ODD`` is set where the shape is another one."""
    around = (F.lit('{"' + _NAME + '":['), F.lit(',{"length":'), F.lit("}]}"))
    options = {**JSON_OPTIONS, "columnNameOfCorruptRecord": _ODD}
    return F.from_json(F.concat(around[0], content, around[1], size.cast("string"), around[2]), _USUAL, options)


def _whole_value(content: Column, size: Column) -> Column:
    listed = F.concat(F.lit("["), content, F.lit(","), size.cast("string"), F.lit("]"))
    return F.from_json(listed, "array<variant>", JSON_OPTIONS)


def notebook_language(metadata: Column) -> Column:
    """Language the kernel names, lower-cased; ``python`` where none is given."""
    return F.lower(F.coalesce(_at(metadata, "kernelspec.language", "string"), F.lit("python")))


def _language_is_text(metadata: Column) -> Column:
    given = _at(metadata, "kernelspec.language", "variant")
    return given.isNull() | (F.schema_of_variant(given) == "STRING")


def _is_map(value: Column) -> Column:
    """Of a value that may be missing."""
    return value.isNull() | F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def _usual_parts(cell: Column) -> Column:
    kind = F.try_variant_get(cell["cell_type"], "$", "string")
    return F.struct(kind.alias("cell_type"), cell["source"].alias("source"), cell["title"].alias("title"), F.lit(False).alias("not_a_cell"))


def _cell_parts(cell: Column) -> Column:
    return F.struct(
        _at(cell, "cell_type", "string").alias("cell_type"),
        _at(cell, "source", "variant").alias("source"),
        _at(cell, "title", "variant").alias("title"),
        (_at(cell, "cell_type", "variant").isNull() & F.try_variant_get(cell, "$", "map<string,variant>").isNull()).alias(
            "not_a_cell"
        ),
    )


def _cell_kinds(cell: Column) -> Column:
    kind = F.schema_of_variant(cell["source"])
    lines = F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(cell["source"], "$", "array<string>"))
    return F.struct(
        *[cell[name].alias(name) for name in ("cell_type", "source", "title", "not_a_cell")],
        kind.alias("kind"),
        lines.alias("lines"),
        F.schema_of_variant(cell["title"]).alias("title_kind"),
    )


def _cell(cell: Column, pos: Column) -> Column:
    kind, lines, title_kind = cell["kind"], cell["lines"], cell["title_kind"]
    nothing = F.lit(None).cast("string")
    # Missing source is no lines; source given as one string is one line.
    source = (
        F.when(lines.isNotNull(), lines)
        .when(kind == "STRING", F.array(F.try_variant_get(cell["source"], "$", "string")))
        .otherwise(F.array().cast("array<string>"))
    )
    source_problem = (
        F.when(cell["not_a_cell"], F.lit(BAD_CELLS))
        .when(kind.isNull() | (kind == "STRING"), nothing)
        .when(kind == "VOID", F.lit(fixed.NULL_SOURCE))
        .when(lines.isNotNull() & ~F.exists(lines, lambda line: line.isNull()), nothing)
        .otherwise(F.lit(BAD_SOURCE))
    )
    title_problem = (
        F.when(title_kind.isNull() | (title_kind == "STRING"), nothing)
        .when(title_kind == "VOID", F.lit(fixed.NULL_TITLE))
        .otherwise(F.lit(BAD_TITLE))
    )
    return F.struct(
        pos.alias("pos"),
        cell["cell_type"].alias("cell_type"),
        source.alias("source"),
        F.when(title_kind == "STRING", F.try_variant_get(cell["title"], "$", "string")).alias("title"),
        source_problem.alias("source_problem"),
        title_problem.alias("title_problem"),
    )


def parse_notebooks(corpus: DataFrame) -> DataFrame:
    """``(path, content)`` to one row per notebook with its language and cells.

    ``readable`` is false for text that is no JSON object or whose language
    cannot be read; such a notebook gets one access finding and nothing else.
    ``cells_problem`` says why cells cannot be walked at all; problems of single
    cells sit in the cells.  Other columns (``copies``) pass through.  Sets the session
    option by which the last one of keys given twice counts.
    """
    # Of keys given twice the last one counts.
    corpus.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    carried = [c for c in corpus.columns if c not in ("path", "content")]

    content, size = F.col("content"), F.col("size")
    sized = corpus.select("path", *carried, content, F.length(content).alias("size"), _looks_like_object(content).alias("object"))
    read = sized.select("*", F.when(F.col("object"), _usual_shape(content, size)).alias("usual"))
    listed = F.col("usual")[_NAME]
    first = F.get(listed, F.lit(0))
    usual = (
        F.col("usual")[_ODD].isNull()
        & (F.size(listed) == 2)
        & (F.get(listed, F.lit(1))["length"] == size)
        & ~F.exists(first["cells"], lambda cell: cell.isNull())
        & ~F.contains(content, F.lit(_NAME))
    )
    split = read.select("path", *carried, "content", "size", "object", F.when(usual, first).alias("kept"))
    odd = F.col("object") & F.col("kept").isNull()
    valued = split.select("path", *carried, "size", "kept", F.when(odd, _whole_value(content, size)).alias("listed"))
    whole = (F.size("listed") == 2) & (F.try_variant_get(F.get("listed", F.lit(1)), "$", "bigint") == size)
    parsed = valued.select("path", *carried, "kept", F.when(whole, F.get("listed", F.lit(0))).alias("document"))
    kept, doc = F.col("kept"), F.col("document")
    described = parsed.select(
        "path", *carried, "kept", "document", F.when(kept.isNotNull(), kept["metadata"]).otherwise(_at(doc, "metadata", "variant")).alias("metadata")
    )
    metadata = F.col("metadata")
    readable = (
        (kept.isNotNull() | doc.isNotNull()) & _is_map(metadata) & _is_map(_at(metadata, "kernelspec", "variant")) & _language_is_text(metadata)
    )
    unpacked = described.select(
        "path",
        *carried,
        readable.alias("readable"),
        notebook_language(metadata).alias("language"),
        (kept.isNotNull() | _at(doc, "cells", "variant").isNotNull()).alias("has_cells"),
        F.when(kept.isNotNull(), F.transform(kept["cells"], _usual_parts))
        .otherwise(F.transform(_at(doc, "cells", "array<variant>"), _cell_parts))
        .alias("parts"),
    )
    cells = F.transform(F.transform("parts", _cell_kinds), _cell)
    none = F.array().cast("array<struct<pos:int,cell_type:string,source:array<string>,title:string,"
                           "source_problem:string,title_problem:string>>")
    return unpacked.select(
        "path",
        *carried,
        "readable",
        F.when(F.col("readable"), F.col("language")).alias("language"),
        F.lit("JUPYTER").alias("format"),
        F.when(F.col("readable") & F.col("has_cells") & F.col("parts").isNull(), F.lit(BAD_CELLS)).alias("cells_problem"),
        F.coalesce(F.when(F.col("readable"), cells), none).alias("cells"),
    )

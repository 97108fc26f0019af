"""Auditing only what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shared
from .catalog import DEFAULT_CATALOG, Setting, rules_version
from .engine import validate
from .rules.base import Rule


SNAPSHOT = ["path", "content_hash", "rules_version"]


def snapshot(
    corpus: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), extra: Sequence[Rule] = ()
) -> DataFrame:
    """What a run saw: ``(path, content_hash, rules_version)``, for the next run."""
    return corpus.select(
        "path", F.sha2("content", 256).alias("content_hash"), F.lit(rules_version(catalog, extra)).alias("rules_version")
    )


def write_snapshot(seen: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Keeps a snapshot as a table of the session's catalog, bucketed by path.

    ``buckets`` should be no fewer than the session's shuffle partitions: then the next
    run compares bucket by bucket, and only its own paths and hashes are shuffled.
    """
    writer = seen.select(*SNAPSHOT).write.bucketBy(buckets, "path").sortBy("path").mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def upserted(before: DataFrame, seen: DataFrame) -> DataFrame:
    """The snapshot after a run that looked at some notebooks: theirs replaced, others kept."""
    now = seen.select(*[F.col(c).alias(f"now_{c}") for c in SNAPSHOT])
    joined = before.select(*SNAPSHOT).join(now, F.col("path") == F.col("now_path"), "full_outer")
    return joined.select(*[F.when(F.col("now_path").isNotNull(), F.col(f"now_{c}")).otherwise(F.col(c)).alias(c) for c in SNAPSHOT])


# ---- INC1 ------------------------------------------------------------------------
def unlike_before(seen: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of a snapshot that ``before`` doesn't have, compared path by path.

    The join is on the path alone; hashes are compared in its condition, in a form that
    isn't taken for a key, so that a snapshot bucketed by path needs no shuffle.
    """
    was = before.select(*[F.col(c).alias(f"was_{c}") for c in SNAPSHOT])
    same = F.col("path") == F.col("was_path")
    for name in ("content_hash", "rules_version"):
        same = same & (F.col(name) <= F.col(f"was_{name}")) & (F.col(name) >= F.col(f"was_{name}"))
    return seen.select(*SNAPSHOT).join(was, same, "left_anti")


def changed_paths(
    corpus: DataFrame, before: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), extra: Sequence[Rule] = ()
) -> DataFrame:
    """Paths that are new, have new content, or were last audited under other rules.

    Only paths and hashes are shuffled, those of ``before`` not at all if it is bucketed
    (``write_snapshot``).  The result is stored: it is used more than once, and its true
    size then decides how notebooks are joined to it.
    """
    return shared.stored(unlike_before(snapshot(corpus, catalog, extra), before).select("path"), "changed")


def changed_only(corpus: DataFrame, changed: DataFrame) -> DataFrame:
    """The changed notebooks.  A small change list is broadcast by its known size
    and no notebook moves; a long one falls back to a shuffle join."""
    return corpus.join(changed, "path", "left_semi")


# ---- INC2 ------------------------------------------------------------------------
def reuse_unchanged(
    corpus: DataFrame,
    before: DataFrame,
    findings_before: DataFrame,
    catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG),
    run_id: str = "",
    *,
    extra: Sequence[Rule] = (),
) -> DataFrame:
    """Findings of the whole corpus, evaluated only for changed notebooks.

    Earlier findings are kept unless their notebook changed or is gone.  What is
    left out is usually little, so the large table of findings is filtered by a
    short stored list rather than matched against the whole corpus.
    """
    changed = changed_paths(corpus, before, catalog, extra)
    fresh = validate(changed_only(corpus, changed), catalog, extra=extra, run_id=run_id)
    removed = before.select("path").join(corpus.select("path"), "path", "left_anti")
    outdated = shared.stored(changed.unionByName(removed), "outdated")
    same = findings_before.join(outdated, findings_before["notebook_path"] == outdated["path"], "left_anti")
    return same.unionByName(fresh, allowMissingColumns=True)


# ---- INC4 ------------------------------------------------------------------------
def repo_to_workspace_path(file_path: Column, repository: str, root: str = "/Workspace/Repos") -> Column:
    """Where a repository's file is in the workspace; notebooks lose their ``.py``."""
    full = F.concat(F.lit(f"{root}/{repository}/"), file_path)
    notebook = F.startswith(file_path, F.lit("notebooks/")) & F.endswith(file_path, F.lit(".py"))
    return F.when(notebook, F.left(full, F.length(full) - 3)).otherwise(full)

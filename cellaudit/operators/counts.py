"""Summaries of an audit without its findings.

A summary needs four numbers of a rule, not its rows.  So the rows of every slot are
counted where they are made: a notebook becomes one narrow row of counters, which are
summed side by side.  Nothing is exploded, labelled or hashed, and what is shuffled is one
row of sums per task (by notebook: per path).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, shared
from .catalog import DEFAULT_CATALOG, Setting
from .engine import copies_of, slotted
from .rules.base import Rule, no_rows
from .summary import pass_rate

COUNTS = [status.lower() for status in fixed.STATUSES]


def _counted(slot: int, copies: bool) -> str:
    """How many rows of a slot have each status, from the column of its statuses."""
    times = " * copies" if copies else ""
    numbers = [f"cast(size(filter(statuses_{slot}, s -> s = '{status}')) AS bigint){times} AS {status.lower()}" for status in fixed.STATUSES]
    return f"struct({', '.join(numbers)}) AS slot_{slot}"


@dataclass(frozen=True)
class Counted:
    """Counters of every notebook (``notebook_path``, one struct per slot), and the slots' rules."""

    counters: DataFrame
    rules: tuple

    def _slots(self) -> list[str]:
        return [f"slot_{k}" for k in range(len(self.rules))]

    def by_rule(self) -> DataFrame:
        sums = [", ".join(f"coalesce(sum({slot}.{c}), 0L) AS {c}" for c in COUNTS) for slot in self._slots()]
        whole = self.counters.agg(*[F.expr(f"struct({listed}) AS {slot}") for listed, slot in zip(sums, self._slots(), strict=True)])
        rule = F.create_map(*[F.lit(x) for pair in zip(self._slots(), self.rules, strict=True) for x in pair])
        each = whole.unpivot([], self._slots(), "slot", "counts").select(F.element_at(rule, F.col("slot")).alias("rule"), "counts.*")
        summed = each.groupBy("rule").agg(*[F.sum(c).alias(c) for c in COUNTS])
        return summed.filter(" + ".join(COUNTS) + " > 0")

    def by_notebook(self) -> DataFrame:
        own = [F.expr(" + ".join(f"{slot}.{c}" for slot in self._slots()) + f" AS {c}") for c in COUNTS]
        summed = self.counters.select("notebook_path", *own).groupBy("notebook_path").agg(*[F.sum(c).alias(c) for c in COUNTS])
        return summed.filter(" + ".join(COUNTS) + " > 0")

    def total(self) -> DataFrame:
        summed = self.by_rule().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_results") for c in COUNTS])
        counted = summed.select(sum((F.col(f"{c}_results") for c in COUNTS), F.lit(0)).cast("long").alias("total_results"), "*")
        return counted.withColumn("pass_rate", pass_rate(F.col("total_results"), F.col("passed_results")))

    def cube(self) -> DataFrame:
        """As ``summary.summary_cube``."""
        nothing = F.lit(None).cast("string")
        rules = self.by_rule().select(F.lit("rule").alias("level"), "rule", nothing.alias("notebook_path"), *COUNTS)
        books = self.by_notebook().select(F.lit("notebook").alias("level"), nothing.alias("rule"), "notebook_path", *COUNTS)
        whole = self.total().select(F.lit("total").alias("level"), nothing.alias("rule"), nothing.alias("notebook_path"), *[F.col(f"{c}_results").alias(c) for c in COUNTS])
        return whole.unionByName(rules).unionByName(books)

    def stored(self) -> Counted:
        """The counters as a table, where more than one summary is wanted."""
        return Counted(shared.stored(self.counters, "counters"), self.rules)


def counted(notebooks: DataFrame, catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG), *, extra: Sequence[Rule] = ()) -> Counted:
    """Counts what the text of the notebooks decides, as ``engine.validate`` would find it."""
    searched, slots = slotted(notebooks, catalog, extra)
    copies = copies_of(searched)
    # Statuses are columns of their own, so that a slot's rows are made once.
    statuses = [F.coalesce(rows, no_rows())["status"].alias(f"statuses_{k}") for k, (_, rows) in enumerate(slots)]
    found = searched.select(F.col("path").alias("notebook_path"), *copies, *statuses)
    counters = found.select("notebook_path", *[F.expr(_counted(k, bool(copies))) for k in range(len(slots))])
    return Counted(counters, tuple(label[2] for label, _ in slots))

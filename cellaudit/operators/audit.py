"""A whole audit: text rules and rules that a model decides, from one pass over the corpus.

``open_audit`` evaluates every notebook once and stores narrow rows, split by kind:
findings, questions about code, questions about titles.  What follows reads only its own
kind: the findings there are, the questions no answer is known for, and, once a store of
responses holds answers, all findings together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, shared
from ..sources.findings import masked
from . import verdicts
from .catalog import DEFAULT_CATALOG, Setting
from .engine import FINDING, labelled
from .responses import PARALLELISM, PER_TASK, ResponseStore
from .rules.base import Rule


@dataclass(frozen=True)
class Audit:
    """The stored rows of one pass, and what their slots stand for."""

    notebooks: DataFrame
    rows: DataFrame
    slots: tuple
    catalog: tuple
    run_id: str = ""

    def findings(self) -> DataFrame:
        """What the text of the notebooks decides."""
        return labelled(self.rows.filter(F.col("tag") == FINDING), self.slots, self.run_id)

    def links(self) -> DataFrame:
        """``(path, rule_key, request_id)`` of questions about code."""
        return verdicts.question_links(self.rows, self.slots)

    def title_links(self) -> DataFrame:
        """``(path, batch, titles, system, request_id)`` of questions about titles."""
        return verdicts.batch_links(self.rows)

    def requests(self, known: DataFrame | None = None) -> DataFrame:
        """``(request_id, system, user)`` of every distinct question that ``known`` lacks."""
        return verdicts.requests_of(self.rows, self.slots, self.notebooks, self.catalog, known)

    def verdicts(self, responses: DataFrame) -> DataFrame:
        """Findings of the rules that a model decides; unanswered ones are pending."""
        return verdicts.answered_findings(self.rows, self.slots, responses, self.catalog, self.run_id)

    def complete(self, responses: DataFrame) -> DataFrame:
        """All findings."""
        return self.findings().unionByName(self.verdicts(responses))

    def ask(
        self, store: ResponseStore, answer: Callable[[str, str], str], parallelism: int = PARALLELISM, *, per_task: int = PER_TASK, retry_errors: bool = False
    ) -> DataFrame:
        """Puts to the model what the store can't answer, and returns all findings."""
        asked = self.requests(store.known(retry_errors))
        responses = store.score(asked, answer, parallelism, per_task=per_task, run=self.run_id, retry_errors=retry_errors)
        return self.complete(responses)


def open_audit(
    notebooks: DataFrame,
    catalog: Sequence[Setting] = tuple(DEFAULT_CATALOG),
    *,
    extra: Sequence[Rule] = (),
    run_id: str = "",
    redact: bool = True,
) -> Audit:
    """Evaluates the corpus once; the rows are stored by kind, found secrets masked."""
    rows, slots = verdicts.tagged(notebooks, catalog, extra=extra)
    secrets = [k for k, slot in enumerate(slots) if slot[2] == fixed.LABEL_SECRETS]
    if redact and secrets:
        rows = rows.withColumn("details", masked(F.col("details"), F.col("slot").isin(secrets)))
    return Audit(notebooks, shared.stored(rows, "audit", by="tag"), tuple(slots), tuple(catalog), run_id)

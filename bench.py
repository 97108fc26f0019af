"""Times the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query is run once unclocked and then three times, its whole result going to a
sink that keeps nothing, and the fastest run counts.  The time includes building and
planning the query.  The stored corpus is written before the clock starts, in ``FILES``
files, so that all cores have work: the table of documents that it is made of is one
file with one row group, which a single task reads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellaudit.functions import shared  # noqa: E402
from cellaudit.operators import audit, counts, engine  # noqa: E402
from workload import QUERIES  # noqa: E402
from workload.registry import with_folder  # noqa: E402
from workload.check import local_spark  # noqa: E402
from workload.fixture import corpus  # noqa: E402

HEADLINES = [
    "fnd2_validate",
    "agg2_rules_of_the_corpus",
    "prj1_parse_notebook",
    "r05_column_nullability",
    "r14_no_hard_coded_secrets",
    "r18_documentation_and_comments",
    "mdl1_build_requests",
    "mdl8_join_verdicts",
    "r03b_title_verdicts",
    "agg4_summary_cube",
    "agg7_quality_gate",
    "rpt1_daily_success_trend",
    "rpt6_top_offenders_by_domain",
    "rpt11_regressions",
    "inc1_changed_only",
]

#: Files of the stored corpus, whatever the number of cores.
FILES = 32


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = with_folder(local_spark(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    stored = shared.stored(corpus(spark, sf_dir).repartition(FILES), "corpus")
    notebooks = stored.count()
    runs = {name: (lambda name=name: QUERIES[name](spark, sf_dir)) for name in HEADLINES}
    runs["audit_of_stored_corpus"] = lambda: engine.validate(stored)
    runs["summary_of_stored_corpus"] = lambda: counts.counted(stored).by_rule()
    runs["questions_of_stored_corpus"] = lambda: audit.open_audit(stored).requests()

    seconds = {}
    for name, make in runs.items():
        times = []
        for _ in range(4):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)  # the first warms up
    print(
        json.dumps(
            {
                "metric": "headline queries, best of three, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "notebooks": notebooks,
                "notebooks_per_sec": round(notebooks / seconds["audit_of_stored_corpus"]),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Verdicts on urls by listed rules and by trust that spreads over the links of hosts.

A rule names a host and the start of a path; it fits that host and its subdomains, and
the longest rule that fits a url decides.  Other urls get their host's verdict.  Hosts
form a graph: a host is tied to each host that its pages link to, and to the domain one
label above it, both ways, since neighbours on one domain have one owner.
Names under which anyone can register (``SUFFIXES``, a parameter) tie nobody.  Trust is a
personalised PageRank that starts from hosts in the measure in which rules allow their
pages; distrust is one over reversed edges that starts where rules block them.  A host
whose distrust exceeds its trust is blocked, all others are allowed.

Both ranks are columns of the same rounds: an edge-host join and a sum by host.  Rounds go
on until no new host is reached and no rank moves by more than a stated part of itself
(``SETTLED``), so a host is judged however far it lies from the rules.  Rounds are written
to the shared folder every few steps.

Defined results: a null url or one without ``://`` has empty host and path and, like
every host that no rank reaches, is allowed unless a rule fits; null html has no links;
repeated rows are judged each for itself, and count twice as seeds; an empty table gives
no rows; further columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored

#: The rules that the query judges by.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Names whose subdomains belong to different owners.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "me.uk", "net.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp",
    "com.br", "org.br", "com.cn", "net.cn", "org.cn", "co.in", "co.kr", "or.kr", "co.za", "com.mx", "com.tr", "com.ar", "com.pl", "com.tw",
    "blogspot.com", "github.io", "wordpress.com", "herokuapp.com", "netlify.app", "pages.dev",
)
DAMPING = 0.85
#: Rounds between two looks at whether ranks have settled, and the part of itself by which a settled rank still moves.
WRITTEN = 8
SETTLED = 1e-3
#: Rounds of the SQL beside the query: 0.85 to the 48th is less than a thousandth.
SQL_ROUNDS = 48
#: Ranks that differ by less than this part of them are equal: room for the order of sums.
TIE = 1e-9
LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^"'/?#\s>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(rule, rule[: rule.index("/")], rule[rule.index("/") :], verdict, len(rule)) for rule, verdict in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, rule_verdict string, rule_length int")


def _suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def fitting(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For each host the rules of it and of domains above it, as a list."""
    own = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("rule_host"))
    fits = F.struct("rule_length", "rule_path", "rule", "rule_verdict")
    return own.join(rules, "rule_host").groupBy("host").agg(F.collect_set(fits).alias("rules"))


def edges(pages: DataFrame, hosts: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(src, dst, weight) between different hosts."""
    target = F.regexp_replace(_lower(F.col("target")), r"^[^@]*@|:\d+$", "")
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("target"))
    linked = linked.select("src", target.alias("dst")).where("src <> '' AND dst <> ''")
    chain = hosts.where("host <> ''").select(F.explode(F.filter(_suffixes(F.col("host")), lambda d: F.contains(d, F.lit(".")))).alias("src")).distinct()
    above = chain.select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst")).where("contains(dst, '.')")
    above = above.where(~F.col("dst").isin(*suffixes)) if suffixes else above
    both = linked.unionByName(above).unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def ranks(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED) -> DataFrame:
    """(host, trust, distrust); ``seeds``: host, allowed, blocked, as numbers of pages.

    What arrives at a host without edges to go on is lost; only comparisons of the two
    ranks are used.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind"))
    graph = edges.withColumn("kind", F.lit("trust")).unionByName(back)
    out = graph.groupBy("src", "kind").agg(F.sum("weight").alias("total"))
    graph = graph.join(out, ["src", "kind"]).select("src", "kind", "dst", (F.col("weight") / F.col("total")).alias("share"))
    graph = stored(graph, "graph")
    total = seeds.agg(F.sum("allowed").alias("trust"), F.sum("blocked").alias("distrust")).first()
    part = lambda column, kind: seeds.where(F.col(column) > 0).select(
        F.col("host").alias("src"), F.lit(kind).alias("kind"), (F.col(column) / F.lit(float(total[kind] or 1))).alias("rank")
    )
    start = stored(part("allowed", "trust").unionByName(part("blocked", "distrust")), "seeds")
    stays = start.select("src", "kind", ((1 - damping) * F.col("rank")).alias("rank"))
    rank, last, moving = start, start, True
    while moving:
        for _ in range(WRITTEN):
            last = rank
            moved = graph.join(rank, ["src", "kind"]).select(F.col("dst").alias("src"), "kind", (damping * F.col("share") * F.col("rank")).alias("rank"))
            rank = moved.unionByName(stays).groupBy("src", "kind").agg(F.sum("rank").alias("rank"))
        # the last two rounds, side by side; the round before is not kept
        both = rank.join(last.withColumnRenamed("rank", "was"), ["src", "kind"], "left")
        both = stored(both, "rank")
        moves = F.col("was").isNull() | (F.abs(F.col("rank") - F.col("was")) > settled * F.col("rank"))
        moving = not both.where(moves).isEmpty()
        rank = both.select("src", "kind", "rank")
    value = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return rank.groupBy(F.col("src").alias("host")).agg(value("trust"), value("distrust"))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("html").cast("string").alias("html"))
    hosts = stored(parts.select("host").distinct(), "hosts")
    fits = stored(fitting(hosts, rules), "rules")
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    ruled = parts.join(fits, "host", "left").withColumn("best", best)
    seeds = ruled.where("best IS NOT NULL").groupBy("host").agg(
        F.count(F.when(F.col("best.rule_verdict") == "allow", 1)).cast("double").alias("allowed"),
        F.count(F.when(F.col("best.rule_verdict") == "block", 1)).cast("double").alias("blocked"),
    )
    rank = ranks(edges(parts, hosts), stored(seeds, "seeds"))
    bad = stored(rank.where(F.col("distrust") > F.col("trust") * (1 + TIE)).select("host", F.lit(True).alias("bad")), "blocked")
    own = F.when(F.col("bad"), "block").otherwise("allow")
    out = ruled.drop("html").join(bad, "host", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.rule_verdict"), own).alias("verdict"))


def sql() -> str:
    """The same in SQL, round by round; as many as ranks need to settle to ``SETTLED``."""
    rules = ", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in RULES)
    rounds = "".join(
        f""", r{k} AS MATERIALIZED (
  SELECT src, kind, sum(rank) AS rank FROM (
    SELECT g.dst AS src, g.kind, {DAMPING} * g.share * r.rank AS rank FROM graph g JOIN r{k - 1} r ON g.src = r.src AND g.kind = r.kind
    UNION ALL SELECT src, kind, {1 - DAMPING} * rank FROM r0) GROUP BY src, kind)"""
        for k in range(1, SQL_ROUNDS + 1)
    )
    link = LINK.replace("'", "''")
    suffixes = ", ".join(f"'{x}'" for x in SUFFIXES)
    return f"""
WITH RECURSIVE rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
rest AS (
  SELECT row_number() OVER () AS r, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages
), parts AS MATERIALIZED (
  SELECT r, page_id, html, translate(regexp_extract(x, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), best AS MATERIALIZED (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r
), up(src) AS (
  SELECT host FROM parts WHERE contains(host, '.') UNION
  SELECT substring(src, instr(src, '.') + 1) FROM up WHERE contains(substring(src, instr(src, '.') + 1), '.')
), above AS (
  SELECT src, substring(src, instr(src, '.') + 1) AS dst FROM up
  WHERE contains(substring(src, instr(src, '.') + 1), '.') AND substring(src, instr(src, '.') + 1) NOT IN ({suffixes})
), linked AS (
  SELECT src, regexp_replace(translate(t, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '^[^@]*@|:\\d+$', '', 'g') AS dst
  FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM parts)
), edges AS MATERIALIZED (
  SELECT src, dst, count(*)::DOUBLE AS weight FROM (
    SELECT src, dst FROM linked WHERE src <> '' AND dst <> '' UNION ALL SELECT src, dst FROM above UNION ALL SELECT dst, src FROM above
  ) WHERE src <> dst GROUP BY src, dst
), both_ways AS (
  SELECT src, dst, weight, 'trust' AS kind FROM edges UNION ALL SELECT dst, src, weight, 'distrust' FROM edges
), graph AS MATERIALIZED (
  SELECT src, dst, kind, weight / sum(weight) OVER (PARTITION BY src, kind) AS share FROM both_ways
), seeds AS (
  SELECT host AS src, CASE rule_verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, count(*) AS n FROM parts JOIN best USING (r) GROUP BY ALL
), r0 AS MATERIALIZED (
  SELECT src, kind, n / sum(n) OVER (PARTITION BY kind) AS rank FROM seeds
){rounds}, bad AS (
  SELECT src FROM r{SQL_ROUNDS} GROUP BY src
  HAVING coalesce(sum(rank) FILTER (kind = 'distrust'), 0) > coalesce(sum(rank) FILTER (kind = 'trust'), 0) * (1 + {TIE})
)
SELECT page_id, host, path, rule,
  coalesce(rule_verdict, CASE WHEN host IN (SELECT src FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (r)
"""


SQL = sql()

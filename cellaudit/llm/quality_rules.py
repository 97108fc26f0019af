"""Quality rules with thresholds that the corpus sets itself.

Each document gives counts of words, symbols, repeated lines and repeated windows of
three words.  Four rates made of them are gathered, for every language and source, in
quantile sketches: histograms whose buckets are at most 1/64 wide relative to their
value.  Sketches merge by adding counts, so those of a language are the merged ones of
its sources, hot sources combine before the shuffle, and results do not depend on the
order of rows.  A document is rejected if one of its rates lies beyond the fence
``q3 + reach * (q3 - q1) + slack`` both of its source and of its language.

Only built-in functions are used.  Defined results: a null text has no words; documents
with fewer than ``min_words`` words or too many repeated ones fail whatever the sketches
say; null languages and sources are groups like others; repeated rows are judged each
for itself; empty tables give empty results; further columns of any name stay apart
from the measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import fresh, stored

#: What counts as space, as a symbol, and the rates with their slack.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
SLACK = {"symbol_rate": 60, "line_rate": 400, "repeat_rate": 250, "word_length": 600}

MIN_WORDS = 50
MAX_REPEATED = 50
REACH = 3


def _words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for other in SPACE[1:]:
        text = F.replace(text, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _windows(words: str) -> Column:
    """Windows of three words with their position, sorted so that equal ones are neighbours."""
    count = F.size(words) - 2
    shifted = [F.slice(words, F.lit(k), count).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "c"))]
    return F.when(count >= 1, F.sort_array(F.arrays_zip(*shifted, F.sequence(F.lit(0), count - 1).alias("i"))))


def _repeated(windows: str) -> Column:
    """Number of words in windows that occur twice or more."""
    count = F.size(windows) - 1
    same = lambda p, q: (p["a"] == q["a"]) & (p["b"] == q["b"]) & (p["c"] == q["c"])
    both = F.zip_with(
        F.slice(windows, F.lit(1), count),
        F.slice(windows, F.lit(2), count),
        lambda p, q: F.when(same(p, q), F.array(p["i"], q["i"])),
    )
    starts = F.array_distinct(F.flatten(F.array_compact(both)))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(count >= 1, F.size(covered).cast("long")).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, name: str = "measures") -> DataFrame:
    """``docs`` with one more column, a struct of the document's counts and rates."""
    words, lines, windows = (fresh(docs, x) for x in ("w_", "l_", "s_"))
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(SPACE)) != ""
    df = docs.withColumn(words, _words(F.col("text"))).withColumn(lines, F.filter(F.split(text, "\n"), has_word))
    df = df.withColumn(windows, _windows(words))
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(F.col(words), "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated(windows).alias("n_repeat_words"),
    )
    df = df.withColumn(name, counts).drop(words, lines, windows)
    return df.withColumn(name, F.col(name).withField("rates", _rates(name)).withField("base_failed", _base_failed(name)))


def _rates(measures: str) -> Column:
    per = lambda factor, above, below: F.expr(f"coalesce({factor} * {measures}.{above} div nullif({measures}.{below}, 0), 0L)")
    return F.struct(
        per(1000, "n_symbols", "word_chars").alias("symbol_rate"),
        per(1000, "n_dup_lines", "n_lines").alias("line_rate"),
        per(1000, "n_repeat_words", "n_words").alias("repeat_rate"),
        per(100, "word_chars", "n_words").alias("word_length"),
    )


def _base_failed(measures: str) -> Column:
    few = F.col(f"{measures}.n_words") < MIN_WORDS
    return few | (100 * F.col(f"{measures}.n_repeat_words") > MAX_REPEATED * F.col(f"{measures}.n_words"))


def sketches(measures: DataFrame, name: str = "measures") -> DataFrame:
    """Counts by language, source, rate and bucket; a bucket is named by its largest value."""
    rates = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), F.col(f"{name}.rates.{k}").alias("value")) for k in SLACK)))
    df = measures.select("lang", "source", rates.alias("r")).select("lang", "source", "r.rate", "r.value")
    shift = F.greatest(F.length(F.bin("value")) - 7, F.lit(0))
    bucket = F.expr("shiftleft(shiftright(value, shift) + 1, shift) - 1")
    return df.withColumn("shift", shift).groupBy("lang", "source", "rate", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of sketches, merged by adding, the fence of every rate as a column."""
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rate")
    upto = group.orderBy("bucket")
    df = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(group))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))
    df = df.groupBy(*keys, "rate").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    slack = F.create_map(*(F.lit(x) for k, v in SLACK.items() for x in (k, v)))
    df = df.withColumn("fence", F.col("q3") + REACH * (F.col("q3") - F.col("q1")) + slack[F.col("rate")])
    return df.groupBy(*keys).pivot("rate", list(SLACK)).agg(F.first("fence"))


def judged(docs: DataFrame, unused: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """``docs`` without ``unused``, with a struct of measures and ``kept``; and its name.

    The measures are computed once, with the other columns of ``docs`` beside them, into
    the shared folder; texts that nobody asks for afterwards needn't be written there.  Fences are few rows, one per language and source, written too, so
    that the join knows their size.
    """
    name = fresh(docs, "measures")
    df = stored(measured(docs, name).drop(*unused), "measured")
    sketch = stored(sketches(df, name), "sketch")
    own, wide = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"])
    both = own.alias("o").join(wide.alias("w"), F.col("o.lang").eqNullSafe(F.col("w.lang")))
    key, other, fence = (fresh(docs, x) for x in ("f_lang", "f_source", "f_fence"))
    limits = both.select(
        F.col("o.lang").alias(key),
        F.col("o.source").alias(other),
        F.struct(*(F.greatest(F.col(f"o.{k}"), F.col(f"w.{k}")).alias(k) for k in SLACK)).alias(fence),
    )
    limits = stored(limits, "fences")
    df = df.join(limits, F.col("lang").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(other)), "left")
    inside = ~F.col(f"{name}.base_failed")
    for k in SLACK:
        inside &= F.col(f"{name}.rates.{k}") <= F.col(f"{fence}.{k}")
    return df.withColumn(name, F.col(name).withField("kept", inside)).drop(key, other, fence), name


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document with its counts and whether it is kept."""
    df, name = judged(docs.select("doc_id", "text", "lang", "source"), unused=("text",))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return df.select("doc_id", *(f"{name}.{c}" for c in counts))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    df, name = judged(docs)
    return df.where(F.col(f"{name}.kept")).select(*docs.columns)


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), split_words AS (
  SELECT r, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS l,
    text
  FROM d
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split_words)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (VALUES (0), (1), (2)) AS v(k) GROUP BY r
), measures AS (
  SELECT d.doc_id, d.lang, d.source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(s.text) - length(regexp_replace(s.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN split_words s USING (r) LEFT JOIN covered USING (r)
), rates AS (
  SELECT *, coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS symbol_rate,
    coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS line_rate,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_rate,
    coalesce(100 * word_chars // nullif(n_words, 0), 0) AS word_length
  FROM measures
), long AS (
  UNPIVOT (SELECT lang, source, symbol_rate, line_rate, repeat_rate, word_length FROM rates)
  ON symbol_rate, line_rate, repeat_rate, word_length INTO NAME rate VALUE value
), buckets AS (
  SELECT lang, source, rate, (((value >> s) + 1) << s) - 1 AS bucket
  FROM (SELECT *, greatest(length(bin(value)) - 7, 0) AS s FROM long)
), ranked AS (
  SELECT 0 AS wide, lang, source, rate, bucket,
    row_number() OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS k,
    count(*) OVER (PARTITION BY lang, source, rate) AS n FROM buckets
  UNION ALL
  SELECT 1, lang, NULL, rate, bucket,
    row_number() OVER (PARTITION BY lang, rate ORDER BY bucket),
    count(*) OVER (PARTITION BY lang, rate) FROM buckets
), quartiles AS (
  SELECT wide, lang, source, rate, min(bucket) FILTER (4 * k >= n) AS q1, min(bucket) FILTER (4 * k >= 3 * n) AS q3
  FROM ranked GROUP BY ALL
), fences AS (
  SELECT *, q3 + 3 * (q3 - q1) + CASE rate WHEN 'symbol_rate' THEN 60 WHEN 'line_rate' THEN 400 WHEN 'repeat_rate' THEN 250 ELSE 600 END AS fence
  FROM quartiles
), limits AS (
  SELECT o.lang, o.source,
    max(greatest(o.fence, w.fence)) FILTER (o.rate = 'symbol_rate') AS f1, max(greatest(o.fence, w.fence)) FILTER (o.rate = 'line_rate') AS f2,
    max(greatest(o.fence, w.fence)) FILTER (o.rate = 'repeat_rate') AS f3, max(greatest(o.fence, w.fence)) FILTER (o.rate = 'word_length') AS f4
  FROM fences o JOIN fences w ON o.wide = 0 AND w.wide = 1 AND o.rate = w.rate AND o.lang IS NOT DISTINCT FROM w.lang
  GROUP BY o.lang, o.source
), judged AS (
  SELECT r.*, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, f1, f2, f3, f4
  FROM rates r JOIN limits f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND symbol_rate <= f1 AND line_rate <= f2 AND repeat_rate <= f3 AND word_length <= f4 AS kept
FROM judged
"""

"""Quality rules with adaptive thresholds (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, bind, shared_table

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Fences stand ``SPREAD`` interquartile ranges beyond the quartiles.
SPREAD = 3
#: Standard deviations of a count beyond what its fence lets one expect.
NOISE = 3
#: A group's sketch is completed with this many rows' worth of its language's, and that with as many of the corpus's.
PRIOR = 50
#: Metrics that have a sketch; n_words gives the usual length of a group's texts.
METRICS = ("symbols", "dup_lines", "word_length", "n_words")
BASE_FAILED = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more: windows are hashed, sorted with their place, and
    the places of equal neighbours are merged."""
    n = WINDOW

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.coalesce(F.least(F.lit(n), F.get(at, i + 1) - x), F.lit(n)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def count(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), bind(bind(placed, places), covered)).otherwise(F.lit(0).cast("long"))

    hashed = bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: bind(windows(h), count))
    return F.when(F.size(words) > n, hashed).otherwise(F.lit(0).cast("long"))


def _key(c: str) -> Column:
    """A group's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def features(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, the keys of language and source, and the counts of each row (with ``whole`` the row itself too, as a struct); null texts have no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    rows = docs.select(*carried, "doc_id", _key("lang").alias("kl"), _key("source").alias("ks"), text.alias("text"))
    rows = rows.withColumns({"words": F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
                             "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    return rows.select(
        *[c for c in rows.columns if c == "row"], "doc_id", "kl", "ks", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_text_lines"), _repeat_words(F.col("words")).alias("n_repeat_words"))


def metrics() -> dict[str, Column]:
    """Whole numbers: per thousand words or lines, word_length per hundred words; null where there is nothing to divide by."""
    words, lines = F.col("n_words"), F.col("n_text_lines")
    parts = {"symbols": (F.col("n_symbols") * 1000, words), "dup_lines": (F.col("n_dup_lines") * 1000, lines), "word_length": (F.col("word_chars") * 100, words)}
    return {k: F.when(d > 0, F.floor(a / d)).cast("long") for k, (a, d) in parts.items()}


def _shift(v: Column) -> Column:
    return F.greatest(F.length(F.bin(v)) - 8, F.lit(0))


def bucket(v: Column) -> Column:
    """Sketch bucket of a whole number >= 0, named by its smallest value: exact below 256, then 128 to a power of two."""
    return F.call_function("shiftleft", F.call_function("shiftright", v, _shift(v)), _shift(v))


def sketch(measured: DataFrame) -> DataFrame:
    """(kl, ks, metric, bucket, n): a histogram of relative error 1/128 of the rows that pass the base rule.

    Sketches merge by adding the counts of equal buckets, in any order, to the same result; the rows of a hot
    source are combined on the map side, and a sketch has some hundreds of buckets however many rows it covers.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")
    rows = measured.where(f"NOT ({BASE_FAILED})").select("kl", "ks", pairs).where("x.v IS NOT NULL")
    return rows.groupBy("kl", "ks", F.col("x.metric").alias("metric"), bucket(F.col("x.v")).alias("bucket")).agg(F.count("*").alias("n"))


def completed(sketches: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(kl, ks, metric, bucket, w): each group's sketch merged with its language's, and each language's with the corpus's, weighed down to ``prior`` rows.

    The fewer rows a group has, the nearer its quantiles are to those of its language; there is no size at which the rule changes.  Weights are
    whole thousandths of a row, so they add up alike in any order.
    """
    def merged(keys: list[str], own: DataFrame, wider: DataFrame) -> DataFrame:
        """``own`` (*keys, metric, bucket, n) completed with ``wider`` (some of keys, metric, bucket, u)."""
        on = [c for c in wider.columns if c not in ("bucket", "u")]
        share = wider.withColumn("share", F.floor(F.lit(1000.0 * prior) * F.col("u") / F.sum("u").over(Window.partitionBy(*on))).cast("long")).drop("u")
        every = own.select(*keys, "metric").distinct().join(share, on)
        w = F.coalesce(F.col("n"), F.lit(0)) * 1000 + F.col("share")
        return every.join(own, [*keys, "metric", "bucket"], "left").select(*keys, "metric", "bucket", w.alias("u"))

    corpus = sketches.groupBy("metric", "bucket").agg(F.sum("n").alias("u"))
    languages = merged(["kl"], sketches.groupBy("kl", "metric", "bucket").agg(F.sum("n").alias("n")), corpus)
    return merged(["kl", "ks"], sketches, languages).withColumnRenamed("u", "w")


def thresholds(sketches: DataFrame, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """(kl, ks) -> quartiles and median of each metric (q1_<metric>, q2_, q3_) and the fence high_<metric>, all from the completed sketches.

    ``gap`` is the interquartile range of the word length, at least a bucket's width.
    """
    group = Window.partitionBy("kl", "ks", "metric")
    run = completed(sketches, prior).withColumns({"upto": F.sum("w").over(group.orderBy("bucket")), "total": F.sum("w").over(group)})
    run = run.where("w > 0")
    aggs = []
    for m in METRICS:
        for k in (1, 2, 3):
            aggs.append(F.min(F.when((F.col("metric") == m) & (F.col("upto") * 4 >= F.col("total") * k), F.col("bucket"))).alias(f"q{k}_{m}"))
    q = run.groupBy("kl", "ks").agg(*aggs)
    width = F.call_function("shiftleft", F.lit(1).cast("long"), _shift(F.col("q3_word_length")))
    return q.withColumns({**{f"high_{m}": F.col(f"q3_{m}") + (F.col(f"q3_{m}") - F.col(f"q1_{m}")) * spread for m in ("symbols", "dup_lines")},
                          "gap": F.greatest(F.col("q3_word_length") - F.col("q1_word_length"), width)})


def _verdicts(rows: DataFrame, spread: int, prior: int) -> DataFrame:
    """``rows`` (features, a table) with base_failed and kept.

    The fences are a small table (a row for each language and source): the optimizer broadcasts it by its size, and rows stay where they are.
    """
    rows = rows.withColumns(metrics())
    sketches = shared_table(sketch(rows), "quality-sketches")
    fences = shared_table(thresholds(sketches, spread, prior), "quality-fences")
    rows = rows.join(fences, ["kl", "ks"], "left")

    def many(count: str, of: str, high: str) -> Column:
        usual = F.col(high) * F.col(of) / F.lit(1000.0)
        return F.col(count) - usual > NOISE * F.sqrt(usual + 1)

    room = F.col("gap") * spread * F.sqrt(F.greatest(F.lit(1.0), F.col("q2_n_words") / F.col("n_words")))
    odd = (F.col("word_length") > F.col("q3_word_length") + room) | (F.col("word_length") < F.col("q1_word_length") - room)
    beyond = many("n_symbols", "n_words", "high_symbols") | many("n_dup_lines", "n_text_lines", "high_dup_lines") | odd
    failed = F.expr(BASE_FAILED)
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~F.coalesce(beyond, F.lit(False))})


def judge(docs: DataFrame, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """Counts, base rule and verdict for every row of ``docs``.

    A row fails the base rule with under 10 words, or if over a fifth of its words stand in repeated 5-word
    windows.  Of the others those are rejected that lie beyond a fence of their language and source; all fences come from the quantile
    sketches, and no metric has a fixed cutoff:

    * symbols, or repeated lines, beyond what the fence of their rate lets one expect in a text of this length by over ``NOISE`` standard
      deviations of such a count;
    * a mean word length beyond the quartiles by over ``spread`` interquartile ranges; a mean over fewer words than the group's median text has
      scatters more, so the range grows with the root of their ratio.

    Quartiles do not move while under a quarter of a group is junk; a group that is mostly junk sets its own standard, but for the base rule.  Null
    languages and sources are groups of their own.  Null and empty texts have no words and fail.  Repeated rows are judged
    alike; an empty table gives no rows; further columns are ignored.
    """
    rows = _verdicts(shared_table(features(docs), "quality-features"), spread, prior)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns as they are.  Rows are written once with their counts and filtered in place, so no
    text is shuffled."""
    return _verdicts(shared_table(features(docs, whole=True), "quality-features"), spread, prior).where("kept").select("row.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM {documents}),
w0 AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT r, doc_id, lang, source, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', ''))::BIGINT AS wc,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, words,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_text_lines FROM w0),
g AS (SELECT r, i, md5(concat_ws(' ', words[i], words[i+1], words[i+2], words[i+3], words[i+4])) AS h
      FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
g2 AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g2) GROUP BY r),
f AS (SELECT w.* EXCLUDE (words, wc), coalesce(wc, 0) AS word_chars, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
m AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce('=' || lang, '') AS kl, coalesce('=' || source, '') AS ks,
        CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words END AS symbols, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words END AS word_length,
        CASE WHEN n_text_lines > 0 THEN n_dup_lines * 1000 // n_text_lines END AS dup_lines FROM f),
u AS (SELECT kl, ks, x.metric, x.v FROM (SELECT kl, ks, unnest([{{'metric': 'symbols', 'v': symbols}}, {{'metric': 'dup_lines', 'v': dup_lines}},
        {{'metric': 'word_length', 'v': word_length}}, {{'metric': 'n_words', 'v': n_words}}]) AS x FROM m WHERE NOT base_failed) WHERE x.v IS NOT NULL),
b AS MATERIALIZED (SELECT kl, ks, metric, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS bucket, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT metric, bucket, sum(n)::BIGINT AS u FROM b GROUP BY ALL),
cs AS (SELECT metric, bucket, floor(50000::DOUBLE * u / (sum(u) OVER (PARTITION BY metric))::BIGINT)::BIGINT AS share FROM c),
lb AS (SELECT kl, metric, bucket, sum(n)::BIGINT AS n FROM b GROUP BY ALL),
lw AS (SELECT kl, metric, bucket, coalesce(n, 0) * 1000 + share AS u FROM (SELECT DISTINCT kl, metric FROM b) JOIN cs USING (metric) LEFT JOIN lb USING (kl, metric, bucket)),
ls AS (SELECT kl, metric, bucket, floor(50000::DOUBLE * u / (sum(u) OVER (PARTITION BY kl, metric))::BIGINT)::BIGINT AS share FROM lw),
gw AS (SELECT kl, ks, metric, bucket, coalesce(n, 0) * 1000 + share AS w FROM (SELECT DISTINCT kl, ks, metric FROM b) JOIN ls USING (kl, metric) LEFT JOIN b USING (kl, ks, metric, bucket)),
run AS (SELECT *, sum(w) OVER (PARTITION BY kl, ks, metric ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY kl, ks, metric) AS total FROM gw),
q AS (SELECT kl, ks, min(bucket) FILTER (metric = 'symbols' AND upto * 4 >= total) AS s1, min(bucket) FILTER (metric = 'symbols' AND upto * 4 >= total * 3) AS s3,
        min(bucket) FILTER (metric = 'dup_lines' AND upto * 4 >= total) AS d1, min(bucket) FILTER (metric = 'dup_lines' AND upto * 4 >= total * 3) AS d3,
        min(bucket) FILTER (metric = 'word_length' AND upto * 4 >= total) AS l1, min(bucket) FILTER (metric = 'word_length' AND upto * 4 >= total * 3) AS l3,
        min(bucket) FILTER (metric = 'n_words' AND upto * 4 >= total * 2) AS n2 FROM run WHERE w > 0 GROUP BY ALL),
t AS (SELECT *, greatest(l3 - l1, 1 << greatest(length(bin(l3)) - 8, 0)) AS gap FROM q),
e AS (SELECT m.*, (s3 + (s3 - s1) * 3) * n_words / 1000::DOUBLE AS es, (d3 + (d3 - d1) * 3) * n_text_lines / 1000::DOUBLE AS ed,
        gap * 3 * sqrt(greatest(1::DOUBLE, n2::DOUBLE / nullif(n_words, 0))) AS room, l1, l3 FROM m LEFT JOIN t USING (kl, ks))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(n_symbols - es > 3 * sqrt(es + 1) OR n_dup_lines - ed > 3 * sqrt(ed + 1) OR word_length > l3 + room OR word_length < l1 - room, false) AS kept FROM e
"""

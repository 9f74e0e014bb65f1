"""Mixing sources to target weights (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import WORD, shared_table

WEIGHTS = (5, 2, 1)
CAP = 3
ROWS_PER_BUCKET = 4_096


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(stats: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, n) -> adds target.

    Sources in code-point order, null last, weigh ``weights`` in turn.  They share the total; a target
    stops at ``cap`` times the source's size and the excess goes to the others by weight.  Sorted by
    cap/weight the stopped sources are a prefix, which one pass of prefix sums finds.  The table has one
    row for each source, so its windows are small.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    s = stats.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumns({"total": F.sum("source_size").over(everything), "all_w": F.sum("weight").over(everything)})
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.col("all_w") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("stopped", F.col("cap") / F.col("weight") < level)
    s = s.withColumns({
        "rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(everything), F.lit(0)),
        "rest_w": F.col("all_w") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("weight"))).over(everything), F.lit(0)),
    })
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest") / F.col("rest_w"))
    return s.select("source", "source_size", "n", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = "mix", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """How many words of every document a weighted mix takes.

    Each row gets a pseudo-random key from its id.  Within a source rows stand in key order; equal slices
    of the key range (about ``rows_per_bucket`` rows each) are summed first, the slice sums are prefix-summed,
    and only then rows within a slice, so no task holds a whole source.  A source is taken whole as often
    as its target allows (epochs), then rows are taken while at least half of the row fits what is left:
    the mix is within half a document of each target.

    Returns doc_id, size, source, source_size, target, taken.  Null text has size 0; a null source is a
    source of its own; repeated ids are separate documents; an empty table gives no rows; further columns
    of ``docs`` are ignored.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    rows = shared_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sizes")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, cap)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / rows_per_bucket))).cast("int")
    per_source = shared_table(per_source.withColumn("bits", bits).withColumnRenamed("source", "s"), "targets")
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s", "n")
    # rows with an id and size in common are one row of the windows, with their number: repeated and missing ids fill no slice
    rows = rows.groupBy("source", "source_size", "target", "bits", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("slice", F.expr("shiftright(key, 60 - bits)"))
    sums = rows.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("copies")).alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("slice").alias("c"), F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c")))
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0))
    epochs = F.coalesce(F.floor(F.expr("try_divide(target, source_size)")), F.lit(0))
    rows = rows.withColumns({"start": start, "epochs": epochs}).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    left = F.col("target") - F.col("epochs") * F.col("source_size")
    more = F.when(2 * F.col("start") + F.col("size") <= 2 * left, F.col("size")).otherwise(0)
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id), 1, 15))::BIGINT AS key
  FROM {documents}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, source_size * 3 AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS all_w,
         coalesce(sum(cap) OVER w, 0)::BIGINT AS cb, coalesce(sum(weight) OVER w, 0)::BIGINT AS wb
  FROM s1 WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, cap::DOUBLE / weight < (total - cb)::DOUBLE / (all_w - wb) AS stopped FROM s2),
s4 AS (SELECT *, total - coalesce(sum(cap) FILTER (stopped) OVER (), 0)::BIGINT AS rest,
         all_w - coalesce(sum(weight) FILTER (stopped) OVER (), 0)::BIGINT AS rest_w FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN stopped THEN cap::DOUBLE ELSE (weight * rest)::DOUBLE / rest_w END AS target FROM s4),
t AS (
  SELECT d.*, s5.source_size, s5.target, coalesce(floor(target / nullif(source_size, 0)), 0) AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size, source, source_size, target,
       (epochs * size + CASE WHEN 2 * start + size <= 2 * (target - epochs * source_size) THEN size ELSE 0 END)::BIGINT AS taken
FROM t
"""

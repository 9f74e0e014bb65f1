"""Parameter sweeps: each configuration is really run, and its name is a key column of one long table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import chunking
from lexloom.operators.evaluate import METRICS, rounded_mean
from lexloom.operators.generation import PROMPTS

#: Fixed values of the standard sweeps.
CHUNK_SIZES = (256, 512, 1024, 2048)
STRATEGIES = ("dense", "bm25", "hybrid")
MAX_QUERIES = 10


def sweep(variable: str, values, run: Callable[[object], DataFrame]) -> DataFrame:
    """The rows of ``run(value)`` for every value, with columns variable and value."""
    parts = [run(v).withColumns({"variable": F.lit(variable), "value": F.lit(str(v))}) for v in values]
    return reduce(DataFrame.unionByName, parts)


def chunk_sizes(docs: DataFrame, sizes=CHUNK_SIZES, overlap: int = 50) -> DataFrame:
    """Number and mean size of chunks by chunk size."""
    def run(size: int) -> DataFrame:
        return chunking.stats(chunking.sliding(docs, size, min(overlap, size - 1))).select("n", F.round("avg_size", 4).alias("avg_size"))

    return sweep("chunk_size", sizes, run)


def strategies(lists: dict[str, DataFrame], relevant: DataFrame) -> DataFrame:
    """Hits of each ranked list (query_id, key, rank) in ``relevant`` (query_id, key): hits and mean reciprocal rank by list."""
    good = relevant.select("query_id", "key").distinct().withColumn("good", F.lit(1))

    def run(name: str) -> DataFrame:
        rows = lists[name].join(good, ["query_id", "key"], "left")
        best = rows.groupBy("query_id").agg(F.count("good").alias("hits"), F.coalesce(F.max(F.when(F.col("good") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"))
        return best.agg(F.sum("hits").alias("hits"), F.round(F.avg("rr"), 6).alias("mrr"))

    return sweep("strategy", lists, run)


def embedders(models: dict[str, object], evaluate: Callable[[object], DataFrame]) -> DataFrame:
    return sweep("embedding_model", models, lambda name: evaluate(models[name]))


def prompts(evaluate: Callable[[str], DataFrame], styles=tuple(PROMPTS)) -> DataFrame:
    return sweep("prompt", styles, evaluate)


def evaluate_config(scored: DataFrame) -> DataFrame:
    """Means of the metrics over the first ten queries, and of the response time where ``scored`` has it; failed ones are left out here."""
    rows = scored.orderBy("id").limit(MAX_QUERIES).where(~F.col("failed"))
    times = [rounded_mean(F.col("response_time")).alias("avg_response_time")] if "response_time" in scored.columns else []
    return rows.agg(*[rounded_mean(F.col(m)).alias(m) for m in METRICS], *times)


def run_all(experiments: dict[str, DataFrame]) -> DataFrame:
    """One table (experiment, variable, value, metric, score) of all sweeps."""
    out = []
    for name, df in experiments.items():
        metrics = [c for c in df.columns if c not in ("variable", "value")]
        pairs = ", ".join(f"'{m}', cast({m} AS double)" for m in metrics)
        out.append(df.selectExpr(f"'{name}' AS experiment", "variable", "value", f"stack({len(metrics)}, {pairs}) AS (metric, score)"))
    return reduce(DataFrame.unionByName, out)

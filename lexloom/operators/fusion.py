"""Fusion and reranking of retrieved lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULTS
from lexloom.functions import text as T
from lexloom.functions.arrays import bind

DIGITS = 6


def reciprocal_rank(dense: DataFrame, sparse: DataFrame, key: str, weight: float = DEFAULTS.dense_weight, k: int = DEFAULTS.rrf_k, top: int | None = None) -> DataFrame:
    """(query_id, key, score, rank) from two lists (query_id, key, rank): the sum of weight / (k + rank); ties by key."""
    if not 0 <= weight <= 1:
        raise ValueError("the dense weight must lie in [0, 1]")
    both = dense.select("query_id", key, (F.lit(weight) / (k + F.col("rank"))).alias("w")).unionByName(sparse.select("query_id", key, (F.lit(1 - weight) / (k + F.col("rank"))).alias("w")))
    fused = both.groupBy("query_id", key).agg(F.round(F.sum("w"), 8).alias("score"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)).cast("long"))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def overlap_logit(query: Column, text: Column) -> Column:
    """Offline pair score: 4 times the share of distinct query words in the text, less 2."""
    def pair(p: Column) -> Column:
        return F.when(F.size(p["q"]) > 0, F.size(F.array_intersect(p["q"], p["t"])) / F.size(p["q"])).otherwise(F.lit(0.0))

    return 4 * bind(F.struct(F.array_distinct(T.tokens(query)).alias("q"), F.array_distinct(T.tokens(text)).alias("t")), pair) - 2


def rerank(candidates: DataFrame, top: int = DEFAULTS.top_k, scorer=overlap_logit, key: str = "chunk_id") -> DataFrame:
    """Candidates (query_id, query, key, text, score) by the sigmoid of a pair score.

    ``scorer`` makes a column from the query and text columns; it may wrap an Arrow UDF around a model and sees candidates only.  A query
    with one candidate keeps it as it is (reranked false).  Returns query_id, key, original_score, reranker_score, reranked, rank.
    """
    many = F.count("*").over(Window.partitionBy("query_id")) > 1
    rows = candidates.withColumns({"reranked": many, "reranker_score": F.round(1 / (1 + F.exp(-scorer(F.col("query"), F.col("text")))), DIGITS)})
    rows = rows.withColumn("reranker_score", F.when(F.col("reranked"), F.col("reranker_score")))
    order = Window.partitionBy("query_id").orderBy(F.col("reranker_score").desc(), key)
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return rows.select("query_id", key, F.col("score").alias("original_score"), "reranker_score", "reranked", "rank")


def reranker_info(name: str = "lexical-overlap") -> dict:
    return {"model": name, "loaded": True}

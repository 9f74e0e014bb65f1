"""Ingestion and batch question answering as whole plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import DEFAULTS, EngineConfig
from lexloom.operators import chunking, dense, embedding, fusion, generation, sparse, structure, verify


def ingest(docs: DataFrame, strategy: str = "article", embedder=None, config: EngineConfig = DEFAULTS, **options) -> DataFrame:
    """Documents -> cleaned, chunked and embedded rows, without a shuffle."""
    rows = structure.preprocess(docs)
    return embedding.embed(chunking.chunk(rows, strategy, **options), embedder or embedding.HashingEmbedder(config.embedding_dimension))


def hybrid(chunks: DataFrame, queries: DataFrame, embedder=None, config: EngineConfig = DEFAULTS) -> DataFrame:
    """(query_id, chunk_id, score, rank): 2k dense and 2k sparse candidates, fused, the best k.

    ``chunks`` has chunk_id, text and embedding; ``queries`` has query_id and query.
    """
    vectors = embedding.embed(queries, embedder or embedding.HashingEmbedder(config.embedding_dimension), "query")
    near = dense.retrieve(chunks, vectors, 2 * config.top_k, config.similarity_threshold, id_col="chunk_id")
    words = sparse.search(chunks, queries, ["chunk_id"], 2 * config.top_k)
    return fusion.reciprocal_rank(near, words, "chunk_id", config.dense_weight, config.rrf_k, config.top_k)


def answer(chunks: DataFrame, queries: DataFrame, retrieved: DataFrame, model: generation.TextModel | None = None, style: str = "default", check: bool = True) -> DataFrame:
    """(query_id, query, answer, confidence, source_count, context, flags) for every query at once.

    ``retrieved`` has query_id, chunk_id, score and rank.  Without a model the best retrieved sentence is the answer; a query without sources
    gets the canned answer and confidence 0.  A model also checks its answers, unless ``check`` is false: ``flags`` are the statements it finds
    unsupported, and a flagged answer's confidence is lower.
    """
    have = set(chunks.columns)
    meta = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("law_name", "source", "article_number")]
    rows = retrieved.join(chunks.select("chunk_id", "text", *meta), "chunk_id").join(queries, "query_id")
    found = generation.context(rows).join(rows.groupBy("query_id").agg(F.avg("score").alias("mean_score"), F.count("*").alias("source_count")), "query_id")
    if model is None:
        answers = generation.extractive_answers(rows)
    else:
        asked = found.join(queries, "query_id").withColumn("prompt", generation.prompt(F.col("context"), F.col("query"), style))
        answers = generation.generate(asked.select("query_id", "context", "prompt"), model)
        answers = generation.check(answers, model) if check else answers
    flags = F.col("flags") if "flags" in answers.columns else F.array().cast("array<string>").alias("flags")
    answers = answers.select("query_id", "answer", flags)
    out = queries.join(found, "query_id", "left").join(answers, "query_id", "left")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return out.select("query_id", "query", F.coalesce("answer", F.lit(generation.NO_ANSWER)).alias("answer"),
                      generation.confidence(F.col("mean_score"), F.size(flags) > 0).alias("confidence"), F.coalesce("source_count", F.lit(0)).alias("source_count"), "context", flags.alias("flags"))


def verified(answers: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """``answers`` with the claims that the context does not support among their flags, found without a model; a newly flagged answer's confidence is lower."""
    rows = verify.verify(answers.withColumns({"response": F.coalesce("answer", F.lit("")), "context": F.coalesce("context", F.lit(""))}))
    more = F.transform(F.filter("verdicts", lambda v: ~v["is_supported"]), lambda v: v["claim"])
    rows = rows.withColumn("more", F.when(F.col("source_count") > 0, more).otherwise(F.array().cast("array<string>")))
    lower = (F.size("flags") == 0) & (F.size("more") > 0)
    return rows.withColumns({"confidence": F.when(lower, F.round(F.col("confidence") * generation.FLAGGED, 4)).otherwise(F.col("confidence")), "flags": F.array_union("flags", "more")}).select(*answers.columns)

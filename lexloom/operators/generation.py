"""Context, prompts, answers and the confidence of answers."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.session import ship_package

#: Templates of this engine, by style; {context} and {question} are filled in.
PROMPTS = {
    "default": "Use only the sources below and name the articles you rely on. Say so if they do not answer the question.\n\nSources:\n{context}\n\nQuestion: {question}\n\nAnswer:",
    "base": "{context}\n\nQ: {question}\nA:",
    "formal": "Draft a formal legal opinion that rests solely on the following provisions.\n\n{context}\n\nIssue: {question}\n\nOpinion:",
    "casual": "Here is what the law says:\n\n{context}\n\nIn plain words: {question}\n",
}
CHECK_PROMPT = "List, as a JSON array of strings, every statement of the answer that the sources do not support.\n\nSources:\n{context}\n\nAnswer:\n{answer}\n"
NO_ANSWER = "No relevant provision was found for this question."
#: Fixed value: factor of the confidence of a flagged answer.
FLAGGED = 0.7
#: Fixed value: what stands between two sources.
RULE = "\n\n---\n\n"


class TextModel(Protocol):
    def complete(self, prompt: str) -> str: ...


def context(retrieved: DataFrame) -> DataFrame:
    """(query_id, context) from (query_id, rank, law_name, source, article_number, text), sources in order of rank.

    A null law name falls back to the source, then to Unknown; a null article number to N/A; empty strings stay.
    """
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] "), F.coalesce("law_name", "source", F.lit("Unknown")), F.lit(" – Article "),
                    F.coalesce("article_number", F.lit("N/A")), F.lit("\n"), F.coalesce("text", F.lit("")))
    rows = retrieved.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", head.alias("x")))).alias("s"))
    return rows.select("query_id", F.array_join(F.transform("s", lambda s: s["x"]), RULE).alias("context"))


def prompt(context: Column, question: Column, style: str = "default") -> Column:
    before, rest = PROMPTS[style].split("{context}")
    middle, after = rest.split("{question}")
    return F.concat(F.lit(before), context, F.lit(middle), question, F.lit(after))


def generate(prompts: DataFrame, model: TextModel) -> DataFrame:
    """``prompts`` (…, prompt) with answer and generation_time; one call for each row, in the executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, seconds = [], []
            for p in b["prompt"]:
                began = time.monotonic()
                answers.append(model.complete(p))
                seconds.append(time.monotonic() - began)
            yield b.assign(answer=answers, generation_time=seconds)

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    ship_package(prompts.sparkSession)
    return prompts.mapInPandas(run, StructType([*prompts.schema.fields, StructField("answer", StringType()), StructField("generation_time", DoubleType())]))


def extractive_answers(retrieved: DataFrame) -> DataFrame:
    """(query_id, answer, overlap): the retrieved sentence with most distinct words of the query; ties by rank, then place.

    ``retrieved`` has query_id, query, rank and text.  The offline stand-in for a language model.
    """
    rows = retrieved.select("query_id", "rank", F.array_distinct(T.tokens(F.col("query"))).alias("q"), F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("pos", "sentence"))
    rows = rows.withColumn("overlap", F.size(F.array_intersect("q", F.array_distinct(T.tokens(F.col("sentence"))))).cast("long"))
    order = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), "rank", "pos")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", F.col("sentence").alias("answer"), "overlap")


def parse_flags(raw: Column) -> Column:
    """The strings of a JSON array, with or without a Markdown fence around it; anything else gives an empty array."""
    s = T.strip(raw)
    inner = T.strip(F.regexp_replace(F.regexp_replace(s, r"^[^\n]*\n", ""), r"(?s)```(?!.*```).*$", ""))
    body = F.when(s.startswith("```"), inner).otherwise(s)
    return F.when(F.get_json_object(body, "$[*]").isNull() & (body != "[]"), F.array().cast("array<string>")).otherwise(
        F.coalesce(F.from_json(F.when(body.startswith("["), body), "array<string>"), F.array().cast("array<string>")))


class _Lenient:
    """A model whose failed calls give an empty reply."""

    def __init__(self, model: TextModel):
        self.model = model

    def complete(self, prompt: str) -> str:
        try:
            return self.model.complete(prompt)
        except Exception:  # noqa: BLE001  a failed check flags nothing
            return ""


def check(answers: DataFrame, model: TextModel) -> DataFrame:
    """(query_id, answer, flags) from (query_id, context, answer): what the model finds unsupported, by one more call for each row.

    A reply that is no JSON array, and a call that fails, give no flags.
    """
    before, rest = CHECK_PROMPT.split("{context}")
    middle, after = rest.split("{answer}")
    asked = answers.select("query_id", F.col("answer").alias("checked"), F.concat(F.lit(before), "context", F.lit(middle), "answer", F.lit(after)).alias("prompt"))
    return generate(asked, _Lenient(model)).select("query_id", F.col("checked").alias("answer"), parse_flags(F.col("answer")).alias("flags"))


def confidence(mean_score: Column, flagged: Column) -> Column:
    """Mean score within [0, 1], times 0.7 if the answer was flagged, to four digits; 0 without sources."""
    return F.round(F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean_score)), F.lit(0.0)) * F.when(flagged, FLAGGED).otherwise(1.0), 4)

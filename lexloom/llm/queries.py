"""The registered queries of the corpus operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import chat, decontaminate, license_scan, line_dedup, mixing, quality, secret_scan, simhash, toxicity, warc


def _table(name: str):
    return lambda spark, sf: spark.read.parquet(f"{sf}/{name}.parquet")


documents = _table("documents")
pages = _table("pages")
benchmark = _table("benchmark")
labels = _table("labels")
conversations = _table("conversations")


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_dedup.dedup_lines(documents(spark, sf))
    return rows.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf))


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chat(spark: SparkSession, sf: str) -> DataFrame:
    return chat.link_turns(conversations(spark, sf))


def op4_chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    return chat.link_all_turns(conversations(spark, sf))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(documents(spark, sf), labels(spark, sf), passages=False)


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(documents(spark, sf))


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(documents(spark, sf))


def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf))


def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf), benchmark(spark, sf)).drop("tk")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_license_scan, op3_warc, op4_chat, op4_chat_turns, op5_toxicity, op6_simhash, op7_quality, op8_mixing, op9_secret_scan, op10_decontaminate)}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE.format(documents="documents"),
    "op2_license_scan": license_scan.oracle(),
    "op3_warc": warc.ORACLE.format(pages="pages"),
    "op4_chat": chat.ORACLE,
    "op4_chat_turns": chat.TURNS_ORACLE,
    "op7_quality": quality.ORACLE.format(documents="documents"),
    "op8_mixing": mixing.ORACLE.format(documents="documents"),
}

"""Sinks: previews, vector collections, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths of previews.
PREVIEW = 200
ANSWER_PREVIEW = 150


def preview(text: Column, n: int = PREVIEW) -> Column:
    """The first ``n`` characters, with ... behind a longer text."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def chunk_previews(chunks: DataFrame, path: str) -> None:
    others = [c for c in chunks.columns if c not in ("chunk_id", "text")]
    chunks.select("chunk_id", preview(F.col("text")).alias("text"), F.struct(*others).alias("metadata"), F.length("text").alias("full_length")).write.mode("overwrite").json(path)


class Collection:
    """A vector collection: a Parquet folder for each name under ``root``."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path, self.name = spark, f"{root.rstrip('/')}/collection={name}", name

    def add(self, chunks: DataFrame) -> None:
        """Upsert by chunk_id: rows of ids that are there already are replaced.  Only if there are any is the collection written anew, beside the
        old one, which it then replaces."""
        fs, where, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path, self.path
        if not fs.exists(where(path)):
            return chunks.write.parquet(path)
        ids = chunks.select("chunk_id").distinct()
        if not self.read().join(ids, "chunk_id", "left_semi").limit(1).count():
            return chunks.write.mode("append").parquet(path)
        self.read().join(ids, "chunk_id", "left_anti").unionByName(chunks, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}.new")
        fs.delete(where(path), True)
        fs.rename(where(f"{path}.new"), where(path))

    def _fs(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def replace(self, chunks: DataFrame) -> None:
        """Full refresh; a collection that does not exist yet is made."""
        chunks.write.mode("overwrite").parquet(self.path)

    def delete(self) -> None:
        self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def stats(self) -> dict:
        return {"collection_name": self.name, "total_chunks": self.read().count(), "persist_directory": self.path}


def baseline_results(responses: DataFrame, path: str) -> None:
    """Question, answer, confidence, times and sources with previews of 150 characters, always followed by ..."""
    sources = F.transform("sources", lambda s: F.struct(s["law_name"].alias("law_name"), s["article_number"].alias("article_number"), s["score"].alias("score"),
                                                        F.concat(F.substring(s["text"], 1, ANSWER_PREVIEW), F.lit("...")).alias("preview")))
    responses.withColumn("sources", sources).write.mode("overwrite").json(path)


def experiment_results(results: DataFrame, path: str) -> None:
    """A folder of JSON for each experiment of the long table."""
    results.write.mode("overwrite").partitionBy("experiment").json(path)


def response_json(response: DataFrame) -> DataFrame:
    """The body a web service sends: scores to 4 digits, confidence and times to 3; missing law names are Unknown, article numbers N/A."""
    def source(s: Column) -> Column:
        return F.struct(s["text"].alias("text"), F.coalesce(s["law_name"], F.lit("Unknown")).alias("law_name"), F.coalesce(s["article_number"], F.lit("N/A")).alias("article_number"),
                        F.coalesce(s["chapter"], F.lit("")).alias("chapter"), F.round(s["score"], 4).alias("score"))

    times = {"retrieval": F.col("retrieval_time"), "generation": F.col("generation_time"), "total": F.col("retrieval_time") + F.col("generation_time")}
    body = F.struct("query", "answer", F.transform("sources", source).alias("sources"), F.round("confidence", 3).alias("confidence"), "hallucination_flags",
                    F.struct(*[F.round(v, 3).alias(k) for k, v in times.items()]).alias("timing"))
    return response.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))

"""Dense vectors of texts, by a pluggable model."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import DEFAULTS
from lexloom.functions import text as T
from lexloom.session import ship_package

BATCH = 64


class Embedder(Protocol):
    dimension: int

    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic bag of words: each word adds one to the bucket its MD5 names; vectors have length one, or zero without words.

    Works offline.  Any object with ``dimension`` and ``embed_texts`` may stand in its place; it is pickled, so a large model should load
    itself on first use in the worker.
    """

    def __init__(self, dimension: int = DEFAULTS.embedding_dimension):
        self.dimension = dimension
        self._bucket: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        if word not in self._bucket:
            if len(self._bucket) > 200_000:
                self._bucket.clear()
            self._bucket[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % self.dimension
        return self._bucket[word]

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                v[self.bucket(w)] += 1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out

    def info(self) -> dict:
        return {"model": "md5-bag-of-words", "dimension": self.dimension, "loaded": True}


def embed(df: DataFrame, embedder: Embedder | None = None, column: str = "text", to: str = "embedding") -> DataFrame:
    """``df`` with a vector of each text; blank texts have the zero vector whatever the model says."""
    model = embedder or HashingEmbedder()
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b[column].to_pylist()]
            full = [i for i, t in enumerate(texts) if t.strip()]
            vectors = [[0.0] * model.dimension for _ in texts]
            for a in range(0, len(full), BATCH):
                at = full[a : a + BATCH]
                for i, v in zip(at, model.embed_texts([texts[i] for i in at]), strict=True):
                    vectors[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], [*b.schema.names, to])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    ship_package(df.sparkSession)
    return df.mapInArrow(run, StructType([*schema.fields, StructField(to, ArrayType(DoubleType()))]))


def hashed_terms(docs: DataFrame, dimension: int = DEFAULTS.embedding_dimension) -> DataFrame:
    """The hashing vectors in sparse form, (doc_id, bucket, value), by built-in functions alone."""
    rows = docs.select("doc_id", F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    bucket = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % dimension
    counts = rows.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    norm = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, "doc_id").select("doc_id", "bucket", (F.col("n") / F.col("norm")).alias("value"))

"""Dense retrieval: exact nearest neighbours of a block of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULTS
from lexloom.session import ship_package

#: Query vectors that every executor gets at once; more are taken block by block.
BLOCK_QUERIES = 4096
#: Cosines, and rows of the base, that a task holds at once.
CELLS, ROWS = 1 << 20, 1024
DIGITS = 6


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Best:
    """The ``k`` best rows so far for each of a block of queries, by rounded cosine and then id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.floor = np.full(queries, -np.inf)  # the k-th score, where there are k: what is below it can't come in
        self.found: list[np.ndarray] = []

    def add(self, own: np.ndarray, cos: np.ndarray) -> None:
        """``cos`` has a line for each query and a column for each id in ``own``."""
        floor, n = self.floor, len(own)
        if n >= self.k and (floor == -np.inf).any():
            floor = np.maximum(floor, np.round(np.partition(cos, n - self.k, 1)[:, n - self.k], DIGITS))
        q, at = np.nonzero(~(cos < (floor - 10.0**-DIGITS)[:, None]))  # a little less than the floor may be rounded up to it
        new = [q, own[at], np.round(cos[q, at], DIGITS)]
        q, own, score = map(np.concatenate, zip(self.found, new, strict=True)) if self.found else new
        order = np.lexsort((own, -score, q))
        order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < self.k]
        self.found = [q, own, score] = [x[order] for x in (q, own, score)]
        many = np.bincount(q, minlength=len(self.floor))
        full = many == self.k
        self.floor[full] = score[(np.cumsum(many) - 1)[full]]


def knn(base: DataFrame, queries: DataFrame, k: int = DEFAULTS.top_k, id_col: str = "vec_id", vector: str = "embedding", query_id: str = "query_id") -> DataFrame:
    """(query_id, <id_col>, score, rank): the ``k`` rows of ``base`` with the largest cosine, ties by id.

    Queries are a stated set; a block of them goes to every task, which multiplies its rows with the block, CELLS products at a time, and
    keeps its own ``k`` best, so only k rows for each query and task are shuffled.  Cosines are rounded to six digits before ranking.  Null
    vectors are left out; a zero vector has cosine 0 with everything.
    """
    ship_package(base.sparkSession)
    id_type, q_type = base.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    base = base.where(F.col(vector).isNotNull()).select(id_col, vector)
    found, block = None, []

    def search(block: list) -> DataFrame:
        ids, matrix = [r[0] for r in block], _unit([r[1] for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, step, kind = _Best(len(ids), k), max(1, min(ROWS, CELLS // len(ids))), None
            for b in batches:
                kind = b.column(0).type
                for a in range(0, b.num_rows, step):
                    own, vectors = (b.column(i).slice(a, step).to_pylist() for i in (0, 1))
                    best.add(np.array(own), matrix @ _unit(vectors).T)
            if best.found:
                q, own, score = best.found
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q]), pa.array(own, kind), pa.array(score)], [query_id, id_col, "score"])

        return base.mapInArrow(run, f"{query_id} {q_type}, {id_col} {id_type}, score double")

    for row in queries.where(F.col(vector).isNotNull()).select(query_id, vector).toLocalIterator():
        block.append(row)
        if len(block) == BLOCK_QUERIES:
            found, block = search(block) if found is None else found.unionByName(search(block)), []
    if block:
        found = search(block) if found is None else found.unionByName(search(block))
    if found is None:
        found = queries.select(query_id).limit(0).crossJoin(base.select(id_col, F.lit(0.0).alias("score")).limit(0))
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def retrieve(base: DataFrame, queries: DataFrame, k: int = DEFAULTS.top_k, threshold: float = DEFAULTS.similarity_threshold, **columns) -> DataFrame:
    """:func:`knn`, then without scores below ``threshold`` (so fewer than ``k`` may stay), scores rounded to four digits."""
    return knn(base, queries, k, **columns).where(F.col("score") >= threshold).withColumn("score", F.round("score", 4))


def collection_stats(chunks: DataFrame, name: str = DEFAULTS.collection) -> DataFrame:
    return chunks.agg(F.count("*").alias("total_chunks")).select(F.lit(name).alias("collection_name"), "total_chunks")

"""Helpers shared by the corpus operators: shared tables, text expressions, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import ship_package
from lexloom.storage import shared_path, shared_table

__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "ascii_lower", "bind", "components", "matching", "packed", "shared_path", "shared_table", "sized", "text_key"]

#: Rows up to which a side of a join may be sent to every executor, by way of the driver (some 20 bytes each).
BROADCAST_ROWS = 200_000
#: Edges up to which one task finds the components (some 30 MB); more go through rounds over all tasks first.
TASK_EDGES = 100_000

#: Fixed value: the whitespace that separates words, `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; ``lower`` is right, and much faster, on pure ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    An expression used inside a higher-order function's lambda is otherwise computed again for
    every element.
    """
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> Column:
    """Hash that, with the id, tells apart rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("\u0000")))


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tk): each row of ``docs`` as one struct beside what operators look at, so that no column of ``docs`` can clash
    with a working column; ``select("row.*")`` gives it back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", text_key(F.col("text")).alias("tk"))


def matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of packed rows with ``keys`` (doc_id, tk); null ids match null ids."""
    keys = keys.select(F.col("doc_id").alias("key_id"), F.col("tk").alias("key_tk"))
    return rows.join(keys, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("tk") == F.col("key_tk")), how)


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df``, a side of a join, left to the optimizer if ``most``, a count its rows cannot exceed, is small, else to be merged: the
    optimizer reads the size of files, where repeated labels take no room, and the driver would hold the rows."""
    return df if most <= BROADCAST_ROWS else df.hint("merge")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of every node of the edges (a, b): union-find with path halving, label is the smallest node reached."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(ids)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for x in range(len(up)):
        up[x] = up[up[x]]
    return ids, ids[np.array(up, np.int64)]


def components(edges: DataFrame, most: int = TASK_EDGES) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) as (node, label): label is the smallest node reached.

    Up to ``most`` edges are joined up by one task.  More alternate large-star and small-star rounds (minimum by group, joined back
    to the edges), so no adjacency list is ever gathered and a hub's edges can be split over tasks, until that many are left or a
    round changes nothing.  A round is some ten jobs, whose plans and broadcasts the driver holds, so few edges are not worth it.
    Each round's edges are a table in the shared folder.  An empty input gives no rows; loops and null ends are ignored.
    """
    rows = shared_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _digest(rows)
    while state[0] > most:
        both = rows.union(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(sized(low, 2 * state[0]), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sized(low, 2 * state[0]), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        rows = shared_table(small.where("a <> b").distinct(), "edges", 2 * state[0])
        after = _digest(rows)
        if after == state:
            out = rows.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
            return out.union(rows.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        state = after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
        yield from pa.table(stars(t["a"].to_numpy(), t["b"].to_numpy()), ["node", "label"]).to_batches()

    ship_package(edges.sparkSession)
    return rows.coalesce(1).mapInArrow(run, "node long, label long")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(b, a) >> 24"))).first())

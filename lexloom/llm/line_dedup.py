"""Line dedup by sharded minimal perfect hashing of the corpus's distinct lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE, ascii_lower, bind, packed, shared_table, text_key
from lexloom.session import ship_package

MIN_DOCS = 10
MIN_CHARS = 1
KEYS_PER_SHARD = 65_536
#: Probes of a shard above which they are dealt over several tasks.
ROWS_PER_TASK = 1_000_000
#: Shards that a task reads one after the other, so that a corpus of many lines does not have as many tasks as shards.
SHARDS_PER_TASK = 8
GAMMA = 2
MAX_LEVELS = 40

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys + np.uint64((level * 0xD1342543DE82EF95 + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a cascade of bit arrays.

    On each level a key that is alone in its slot sets the slot's bit; the others go on to the next level.
    A key's number is the rank of its bit.  About 3.7 bits a key at ``GAMMA`` 2.  Keys still homeless after
    ``MAX_LEVELS`` levels (none in practice) are listed and numbered last.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.base, n = [], 0
        for bits in levels:
            self.base.append(n + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)[:-1]]))
            n += int(bits.sum())
        self.rest_base = n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys) and len(levels) < MAX_LEVELS:
            size = max(8, -(-len(keys) * GAMMA // 8) * 8)
            at = _slot(keys, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels, np.sort(keys))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """A number for each key; an arbitrary number or -1 for a key that is not in the set."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                return out
            at = _slot(keys[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.base[level][at[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            ok = self.rest[i] == keys[todo]
            out[todo[ok]] = self.rest_base + i[ok]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *[len(x) for x in self.levels]], dtype=np.int64)
        return head.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.rest.tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at, levels = 8 * (n + 1), []
        for size in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(levels, np.frombuffer(data, np.uint64, -1, at))


def build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's (h, f, n) rows -> its perfect hash with fingerprint and count arrays.

    Lines whose 64-bit hashes collide cannot be told apart by the hash: they stay in a list of (h, f, n).
    """
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    f, n = rows["f"].to_numpy(np.int32), np.minimum(rows["n"].to_numpy(np.int64), 2**31 - 1).astype(np.int32)
    values, first, times = np.unique(h, return_index=True, return_counts=True)
    twin = np.isin(h, values[times > 1])
    mph = PerfectHash.build(values[times == 1])
    prints, counts = np.zeros(int((~twin).sum()), np.int32), np.zeros(int((~twin).sum()), np.int32)
    at = mph.number(h[~twin])
    prints[at], counts[at] = f[~twin], n[~twin]
    rest = np.stack([h[twin].view(np.int64), f[twin].astype(np.int64), n[twin].astype(np.int64)], 1)
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "mph": [mph.dump()], "prints": [prints.tobytes()], "counts": [counts.tobytes()],
                         "twins": [rest.tobytes()], "probes": [int(n.sum(dtype=np.int64))]})


class Shard:
    def __init__(self, mph: bytes, prints: bytes, counts: bytes, twins: bytes):
        self.mph, self.prints, self.counts = PerfectHash.load(mph), np.frombuffer(prints, np.int32), np.frombuffer(counts, np.int32)
        self.twins = {(a, b): n for a, b, n in np.frombuffer(twins, np.int64).reshape(-1, 3).tolist()}

    def count(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Documents of each line; 0 if the fingerprint is another's."""
        at = self.mph.number(h.view(np.uint64))
        out = np.zeros(len(h), np.int64)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == f[ok]
        out[ok] = self.counts[at[ok]]
        if self.twins:
            for i in range(len(h)):
                out[i] = self.twins.get((int(h[i]), int(f[i])), out[i])
        return out


def _probe(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = None, None
        for rows in batches:
            index = np.flatnonzero(rows["mph"].is_valid().to_numpy(zero_copy_only=False)).tolist()
            cuts = [0, *index, rows.num_rows]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if k:
                    if (s := rows["shard"][a].as_py()) != at:
                        shard, at = Shard(*(rows[c][a].as_py() for c in ("mph", "prints", "counts", "twins"))), s
                    a += 1
                part = rows.slice(a, b - a)
                if part.num_rows:
                    n = shard.count(part["h"].to_numpy(), part["f"].to_numpy())
                    yield part.select(["doc_id", "tk", "h"]).filter(pa.array(n >= min_docs))
    return run


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD,
                   rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(doc_id, tk, drops): for documents with frequent lines, the hashes of those lines.

    Distinct lines are counted by hash with map-side combining, the counts go into shards of about
    ``keys_per_shard`` lines, each an index row (perfect hash, fingerprints, counts).  Documents send (hash,
    fingerprint, id) to the shard, never a line's text, and stream past the shard's arrays; a shard with very
    frequent lines is copied to several tasks and its probes are dealt over them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars))
    seen = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.explode(keys).alias("k"))
    seen = seen.select("doc_id", "tk", F.xxhash64("k").alias("h"), F.hash("k").alias("f"))
    counts = shared_table(seen.groupBy("h", "f").agg(F.count("*").alias("n")), "line-counts")
    total = counts.count()
    bits = max(0, int(np.ceil(np.log2(max(1, total) / keys_per_shard))))
    shard = F.expr(f"shiftrightunsigned(h, {64 - bits})") if bits else F.lit(0).cast("long")
    index = counts.withColumn("shard", shard).groupBy("shard").applyInPandas(
        build_shard, "shard long, mph binary, prints binary, counts binary, twins binary, probes long")
    index = shared_table(index.withColumn("salts", F.ceil(F.col("probes") / rows_per_task).cast("int")), "line-index")
    hot = index.where("salts > 1").select("shard", "salts")
    probes = seen.withColumn("shard", shard).join(hot, "shard", "left")
    probes = probes.withColumn("salt", F.expr("pmod(xxhash64(doc_id, tk), coalesce(salts, 1))").cast("int")).drop("salts")
    shards = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "probes")
    rows = shards.unionByName(probes, allowMissingColumns=True)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(2**bits) // SHARDS_PER_TASK))
    rows = rows.repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("mph").isNull())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    hits = rows.select("shard", "mph", "prints", "counts", "twins", "doc_id", "tk", "h", "f").mapInArrow(
        _probe(min_docs), f"doc_id {id_type}, tk long, h long")
    return hits.groupBy("doc_id", "tk").agg(F.collect_set("h").alias("drops"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, **sizes) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row as a struct, and its text without frequent lines.

    A line's key is the line stripped of ASCII whitespace at both ends, A-Z lower-cased; keys of at least
    ``min_chars`` characters that occur in at least ``min_docs`` rows lose all their lines.  Null and empty texts
    are one empty line.  Repeated rows each count as a document.  Other columns, whatever their names, stay
    in the struct as they are.
    """
    drops = frequent_lines(docs.select("doc_id", "text"), min_docs, min_chars, **sizes)
    drops = drops.withColumnsRenamed({"doc_id": "key_id", "tk": "key_tk"})
    rows = packed(docs).join(drops, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("tk") == F.col("key_tk")), "left")
    lines = _lines(F.col("row.text"))
    kept = F.when(F.col("drops").isNull(), lines).otherwise(
        bind(F.col("drops"), lambda d: F.filter(lines, lambda x: (F.length(line_key(x)) < min_chars) | ~F.array_contains(d, F.xxhash64(line_key(x))))))
    rows = rows.withColumn("kept", kept)
    return rows.select("row", F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"),
                       F.array_join("kept", "\n").alias("kept"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {documents}),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
o AS (SELECT k.*, f.key IS NOT NULL AS bad FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (bad))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '')) AS kept_sha256
FROM o GROUP BY r
"""

"""Near-duplicate documents by Jaccard similarity of word shingles: SimHash and pigeonring of :mod:`lexloom.llm.simhash`, and segments of a longer fingerprint.

Texts whose 64-bit SimHashes meet in a ring bucket and pass the chain test and the full distance are candidates, and the exact similarity
decides.  That alone cannot reach a similarity of 0.8: such pairs are 4 to 14 bits apart (README, with figures), and so are strangers in a large
corpus.  So a second fingerprint adds candidates.  It has 512 bits: 128 symbols of four bits, each drawn from the
shingle with the smallest hash under one of 128 permutations, so that symbols agree as often as the shingle sets do.
Documents that agree on one of 16 segments of four symbols are candidates, then the whole
fingerprint's differing symbols are counted, then the exact similarity is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import BROADCAST_ROWS, components, matching, packed, shared_table, sized, text_key
from lexloom.llm.simhash import MAX_BITS, buckets, fingerprint, shingle_hashes, viable
from lexloom.session import ship_package

WORDS = 5
SIMILARITY = 0.8
SYMBOLS = 128
SEGMENT = 4
SEGMENTS = 16
#: Symbols that may differ: at similarity 0.8, 24 differ on average with a deviation of 4.4.
MAX_DIFFER = 35
LONGS = SYMBOLS // 16
#: Places between sorted neighbours that are compared.
REACH = 4

_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ^ (0xD1B54A32D192ED03 * (i + 1))) % 2**64 | 1 for i in range(SYMBOLS)], np.uint64)
_ADD = np.array([0xA0761D6478BD642F * (i + 7) % 2**64 for i in range(SYMBOLS)], np.uint64)


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]] | None:
    """(segment keys, words of 16 symbols each), as signed longs; None without shingles."""
    if not len(hashes):
        return None
    low = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for a in range(0, len(hashes), 1024):
        x = hashes[a : a + 1024, None] * _ODD[None, :] + _ADD[None, :]
        low = np.minimum(low, (x ^ (x >> np.uint64(32))).min(0))
    keys = [xxhash.xxh64_intdigest(low[i : i + SEGMENT].tobytes(), i) for i in range(0, SEGMENT * SEGMENTS, SEGMENT)]
    nibbles = ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).reshape(LONGS, 16)
    packed = (nibbles << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64)
    return np.array(keys, np.uint64).view(np.int64).tolist(), packed.view(np.int64).tolist()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tk, tk2, keys, packed, fp, size) of each row; tk and tk2 are independent hashes of the text, fp is its SimHash and size the number
    of its different shingles; keys, packed and fp are null without shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(3):
                hashes = shingle_hashes(t.as_py(), words)
                once = np.unique(hashes)
                got.append((*(sketch(once) or (None, None)), fingerprint(hashes) if len(hashes) else None, len(once)))
            columns = [pa.array([x[k] for x in got], kind) for k, kind in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], ["doc_id", "tk", "tk2", "keys", "packed", "fp", "size"])

    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tk"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit("\u0000"))).alias("tk2"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, tk long, tk2 long, keys array<long>, packed array<long>, fp long, size long")


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (a table of doc_id, tk, tk2, ...) with ``node``, equal for equal texts: the hash tk, or where different texts share it, a hash of both.

    So no text is taken for another unless two independent 64-bit hashes agree; texts whose hashes clash are few, and are found by one aggregate.
    """
    clash = rows.groupBy("tk").agg(F.min("tk2").alias("lo"), F.max("tk2").alias("hi")).where("lo <> hi").select("tk", F.lit(True).alias("clash"))
    clash = shared_table(clash, "clashing-texts")
    return rows.join(clash, "tk", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("tk2", "tk")).otherwise(F.col("tk"))).drop("clash")


def differing(a: Column, b: Column) -> Column:
    """Symbols in which two packed fingerprints differ."""
    total = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        total = total + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _small(df: DataFrame) -> DataFrame:
    """``df`` (a table), marked for broadcast only if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Pairs of shingle sets in a task.
PAIRS_PER_FILE = 5_000


def verify(pairs: DataFrame, rows: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b nodes) whose shingle sets have a Jaccard similarity of at least ``similarity``."""
    n = pairs.count()
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    need = rows.join(need, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "tk")).alias("x"))
    need = shared_table(need.select("node", F.col("x.doc_id").alias("id"), F.col("x.tk").alias("tk")), "verify-ids", 2 * n)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["node", "s"])

    texts = docs.select("doc_id", text_key(F.col("text")).alias("k"), "text")
    texts = texts.join(_small(need), (F.col("k") == F.col("tk")) & F.col("doc_id").eqNullSafe(F.col("id")))
    held = shared_table(texts.select("node", "text").mapInArrow(sets, "node long, s binary").dropDuplicates(["node"]), "shingle-sets", 2 * n, PAIRS_PER_FILE)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(held.withColumnsRenamed({"node": "a", "s": "x"}), "a").join(held.withColumnsRenamed({"node": "b", "s": "y"}), "b")
    return shared_table(full.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "similar", n, PAIRS_PER_FILE)


def neighbours(filed: DataFrame) -> DataFrame:
    """(a, b): rows of a bucket at most ``REACH`` apart when sorted by their further segments in ring order, if few enough symbols differ.

    The longer the chain of segments that two documents agree on, the closer they stand.  Buckets are sorted by range, so a large one is
    dealt over several tasks (a pair at a task's edge is left to the other passes), and pairs grow as the rows do.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tk, packed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, LONGS), np.uint64)
        for b in batches:
            old = len(key)
            key, tk = np.concatenate([key, b["key"].to_numpy()]), np.concatenate([tk, b["tk"].to_numpy()])
            packed = np.concatenate([packed, b["packed"].flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)])
            for step in range(1, REACH + 1):
                at = np.arange(max(0, old - step), max(0, len(key) - step))
                at = at[key[at] == key[at + step]]
                x = packed[at] ^ packed[at + step]
                for shift in (2, 1):
                    x |= x >> np.uint64(shift)
                at = at[np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1) <= MAX_DIFFER]
                yield pa.RecordBatch.from_arrays([pa.array(tk[at]), pa.array(tk[at + step])], ["a", "b"])
            key, tk, packed = key[-REACH:], tk[-REACH:], packed[-REACH:]

    n = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = filed.repartitionByRange(n, "key", "chain").sortWithinPartitions("key", "chain").select("key", "tk", "packed")
    return rows.mapInArrow(run, "a long, b long")


class Ring:
    """Texts in the buckets of operator 6: its fingerprints, ring keys, chain test and distance, in two passes as in :func:`lexloom.llm.simhash.link`.

    Texts of one fingerprint are a bucket of their own.  Pairs whose numbers of shingles alone exclude the similarity are left out.
    """

    def __init__(self, nodes: DataFrame, similarity: float):
        prints = nodes.where("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct("tk", "size")).alias("x"), F.count("*").alias("copies"))
        self.prints = shared_table(prints.select("fp", "x.*", "copies"), "fingerprint-nodes")
        self.nodes, self.similarity, self.met = nodes.select("tk", "fp", "size"), similarity, buckets(self.prints.select("fp"))
        self.count, self.most = self.met.count(), self.prints.count()

    def alike(self, size: Column, size2: Column) -> Column:
        return F.least(size, size2) >= self.similarity * F.greatest(size, size2)

    def first(self) -> DataFrame:
        """(a, b): a text of each fingerprint with one of its bucket's smallest, and with the others of that fingerprint."""
        x = F.col("fp").bitwiseXOR(F.col("hub"))
        near = self.met.where((F.col("fp") != F.col("hub")) & viable(x, F.col("ring"), MAX_BITS)).select("fp", "hub").distinct()
        prints = sized(self.prints.drop("copies"), self.most)
        near = near.join(prints, "fp").join(prints.withColumnsRenamed({"fp": "hub", "tk": "tk2", "size": "size2"}), "hub")
        same = self.prints.where("copies > 1").select("fp", F.col("tk").alias("tk2"), F.col("size").alias("size2"))
        same = self.nodes.join(sized(same, self.most), "fp").where("tk <> tk2")
        pairs = near.select("tk", "tk2", "size", "size2").union(same.select("tk", "tk2", "size", "size2"))
        return pairs.where(self.alike(F.col("size"), F.col("size2"))).select(F.col("tk").alias("a"), F.col("tk2").alias("b"))

    def rest(self, labels: DataFrame) -> DataFrame:
        """(a, b), a the greater: all pairs within the distance that ``labels`` (tk, label) leaves in different components."""
        same = self.prints.where("copies > 1").select(F.lit(MAX_BITS + 1).cast("byte").alias("ring"), F.col("fp").alias("key"), "fp")
        met = self.met.select("ring", "key", "fp").union(same).join(sized(self.nodes, self.nodes.count()), "fp")
        met = met.join(sized(labels, self.count + self.most), "tk", "left").withColumn("label", F.coalesce("label", "tk"))
        mixed = met.groupBy("ring", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("ring", "key")
        met = shared_table(met.join(mixed, ["ring", "key"]), "mixed-rings")
        other = sized(met, met.count()).withColumnsRenamed({c: c + "2" for c in ("tk", "fp", "size", "label")})
        x, ring = F.col("fp").bitwiseXOR(F.col("fp2")), F.col("ring") % (MAX_BITS + 1)
        pairs = met.join(other, ["ring", "key"]).where((F.col("label") < F.col("label2")) & self.alike(F.col("size"), F.col("size2")) & viable(x, ring, MAX_BITS))
        return pairs.select(F.greatest("tk", "tk2").alias("a"), F.least("tk", "tk2").alias("b")).distinct()


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tk, group, label): rows of a group have equal texts or are chained by pairs of at least ``similarity``; group is the
    smallest doc_id in it, and label tells groups apart where ids repeat or are null.

    Equal texts are one node.  Candidates are the pairs of :class:`Ring` and those of the segments.  Within a bucket of either each node is checked against the bucket's smallest one and its neighbours first, then
    only nodes that are still in different components against each other, once for each pair.  Null and empty texts have no shingles:
    they group with their equals alone.  A very long text is read whole, in blocks of shingles.
    """
    rows = told_apart(shared_table(sketches(docs, words), "sketches"))
    nodes = rows.groupBy(F.col("node").alias("tk")).agg(F.min("doc_id").alias("first"), *[F.min(c).alias(c) for c in ("keys", "packed", "fp", "size")])
    nodes = shared_table(nodes, "text-nodes")
    ring = Ring(nodes, similarity)
    profiles = nodes.select("tk", "packed", "keys")
    filed = nodes.select("tk", F.posexplode("keys").alias("i", "key"))
    hubs = filed.groupBy("key").agg(F.count("*").alias("n"), F.min("tk").alias("hub")).where("n > 1").drop("n")
    met = shared_table(filed.join(hubs, "key"), "segment-buckets")
    n = met.count()
    pairs = met.where("tk <> hub").select(F.col("tk").alias("a"), F.col("hub").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("tk").alias(side), F.col("packed").alias(f"packed_{side}")), side)
    pairs = pairs.where(differing(F.col("packed_a"), F.col("packed_b")) <= MAX_DIFFER).select("a", "b")
    met = shared_table(met.drop("hub").join(profiles, "tk"), "bucket-profiles", n, 20_000)
    onward = F.concat(F.slice("keys", F.col("i") + 2, F.lit(SEGMENTS)), F.slice("keys", F.lit(1), F.col("i")))
    for chain in (onward, F.reverse(onward)):
        pairs = pairs.union(neighbours(met.select("key", "tk", "packed", chain.alias("chain"))))
    pairs = pairs.union(ring.first())
    pairs = shared_table(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "first-pairs", (2 * REACH + 1) * n + ring.count + ring.most)
    edges = verify(pairs, rows, docs, words, similarity)
    labels = shared_table(components(edges), "first-groups", n + ring.count).withColumnRenamed("node", "tk")
    met = met.join(labels, "tk", "left").withColumn("label", F.coalesce("label", "tk"))
    mixed = met.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    met = shared_table(met.join(mixed, "key"), "mixed-segments", n, 20_000)
    other = met.select("key", *[F.col(c).alias(c + "2") for c in ("tk", "packed", "label", "keys")])
    first = F.expr(f"i = 0 OR NOT exists(sequence(0, {SEGMENTS - 1}), k -> k < i AND keys[k] = keys2[k])")
    more = met.join(other, "key").where((F.col("label") < F.col("label2")) & (differing(F.col("packed"), F.col("packed2")) <= MAX_DIFFER) & first)
    more = more.select(F.greatest("tk", "tk2").alias("a"), F.least("tk", "tk2").alias("b")).union(ring.rest(labels)).distinct()
    more = shared_table(more.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    edges = edges.union(verify(more, rows, docs, words, similarity))
    labels = components(edges).withColumnRenamed("node", "tk")
    nodes = nodes.select("tk", "first").join(labels, "tk", "left").withColumn("label", F.coalesce("label", "tk"))
    least = nodes.groupBy("label").agg(F.min("first").alias("group"))
    return rows.select("doc_id", "tk", "node").join(nodes.join(least, "label").select(F.col("tk").alias("node"), "group", "label"), "node").drop("node")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of :func:`groups`, the one with the smallest doc_id, all columns as they are.

    Of rows that repeat this id and text one stays; an empty table gives no rows.  Texts are moved once at most: whether any row repeats is known
    from the keys alone.
    """
    found = groups(docs, words, similarity).where(F.col("doc_id").eqNullSafe(F.col("group")))
    keep = found.groupBy("label").agg(F.min(F.struct("doc_id", "tk")).alias("x"), F.count("*").alias("n"))
    keep = shared_table(keep.select("x.*", "n"), "kept-ids")
    rows = matching(packed(docs), keep, "left_semi")
    repeated = found.groupBy("doc_id", "tk").agg(F.count("*").alias("n")).where("n > 1") if keep.where("n > 1").limit(1).count() else None
    if repeated is not None and repeated.limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "tk"])
    return rows.select("row.*")

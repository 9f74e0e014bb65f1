"""SimHash near-duplicates with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import components, shared_table, sized
from lexloom.session import ship_package

WORDS = 4
MAX_BITS = 4
SEED = 42
BITS = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text, A-Z lower-cased; bytes.split and bytes.lower know ASCII only."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1]).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: a bit is set if over half of the hashes have it; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[a : a + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int(np.frombuffer(bits.tobytes(), ">i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of max_bits + 1 segments in ring order."""
    m = max_bits + 1
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(parts: list[tuple[int, int]]) -> int:
    x = sum(((1 << w) - 1) << s for s, w in parts)
    return x - (1 << 64) if x >= 1 << 63 else x


def ring_keys(fp: Column, max_bits: int) -> Column:
    """Bucket keys of a fingerprint, as an array of (ring, key).

    With m = max_bits + 1 segments on a ring, two fingerprints within max_bits have a start i from which every chain
    of l segments differs in at most floor(l * max_bits / m) bits: none in segment i, at most one in i and i + 1.
    So the pair agrees on segment i, and the next segments are equal or one bit apart.  Each fingerprint
    is filed under its own two segments; if the second has an odd number of set bits, also under its one-bit variants.  Of
    two segments one bit apart exactly one is odd, so the pair meets, at half the copies of filing all variants.
    """
    ring = segments(max_bits)
    out = []
    for i, (s, w) in enumerate(ring):
        t, v = ring[(i + 1) % len(ring)]
        own = fp.bitwiseAND(F.lit(_mask([(s, w), (t, v)])))
        odd = F.bit_count(fp.bitwiseAND(F.lit(_mask([(t, v)])))) % 2 == 1
        flips = F.array(*[F.struct(F.lit(i).cast("byte").alias("ring"), own.bitwiseXOR(F.lit(_mask([(t + j, 1)]))).alias("key")) for j in range(v)])
        mine = F.array(F.struct(F.lit(i).cast("byte").alias("ring"), own.alias("key")))
        out.append(F.when(odd, F.concat(mine, flips)).otherwise(mine))
    return F.concat(*out)


def viable(x: Column, ring: Column, max_bits: int) -> Column:
    """The chain test on the XOR of two fingerprints that met at ``ring``, for all chains longer than two, then the full distance."""
    parts = segments(max_bits)
    m = len(parts)
    test = F.lit(True)
    for length in range(3, m):
        masks = F.array(*[F.lit(_mask([parts[(i + k) % m] for k in range(length)])) for i in range(m)])
        test = test & (F.bit_count(x.bitwiseAND(F.get(masks, ring.cast("int")))) <= length * max_bits // m)
    return test & (F.bit_count(x) <= max_bits)


def buckets(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(ring, key, fp, hub) table: the buckets of distinct fingerprints in which any two can be within ``max_bits``; hub is a bucket's smallest one.

    Buckets of one, and of two that are too far apart, are dropped by an aggregate with map-side combining.  Filed rows, some 37 to a
    fingerprint, are merged: the optimizer takes them for one row each and would send them through the driver.
    """
    filed = fps.select("fp", F.explode(ring_keys(F.col("fp"), max_bits)).alias("k")).select("fp", "k.ring", "k.key")
    hubs = filed.groupBy("ring", "key").agg(F.count("*").alias("n"), F.min("fp").alias("hub"), F.max("fp").alias("top")).where("n > 1")
    two = viable(F.col("hub").bitwiseXOR(F.col("top")), F.col("ring"), max_bits)  # decides a bucket of two without a join
    hubs = hubs.where((F.col("n") > 2) | two).drop("n", "top")
    return shared_table(filed.join(hubs.hint("merge"), ["ring", "key"]), "ring-buckets")


def link(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, label) for the fingerprints that have a link, label being equal within a component.

    ``fps`` holds distinct fingerprints.  Their buckets are checked in two passes, so that a bucket of near copies gives no row for each
    pair: first each member against its bucket's smallest one, then members of the same bucket that are still in different components.
    """
    rows = buckets(fps, max_bits)
    n = rows.count()
    x = F.col("fp").bitwiseXOR(F.col("hub"))
    edges = shared_table(rows.where((F.col("fp") != F.col("hub")) & viable(x, F.col("ring"), max_bits)).select(
        F.col("fp").alias("a"), F.col("hub").alias("b")).distinct(), "hub-links", n)
    labels = shared_table(components(edges), "hub-labels", n)
    rows = rows.join(sized(labels.withColumnRenamed("node", "fp"), n), "fp", "left").withColumn("label", F.coalesce("label", "fp")).drop("hub")
    mixed = rows.groupBy("ring", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
    rows = shared_table(rows.join(sized(mixed, n), ["ring", "key"]), "mixed-buckets", n)
    other = sized(rows, rows.count()).withColumnsRenamed({"fp": "fp2", "label": "label2"})
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    pairs = rows.join(other, ["ring", "key"]).where((F.col("label") < F.col("label2")) & viable(x, F.col("ring"), max_bits))
    more = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()
    return components(edges.union(more)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Fingerprints within ``max_bits`` bits link; component_id is the smallest doc_id reachable.  Rows without
    words (null or empty text too) have fingerprint zero and link like any other.  Rows with equal fingerprints
    are one node, so copies cost one row however many there are.  Repeated ids are kept as rows of
    their own; an empty table gives no rows; further columns are ignored.
    """
    rows = shared_table(fingerprints(docs, words), "fingerprints")
    nodes = shared_table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-nodes")
    n = nodes.count()
    nodes = nodes.join(sized(link(nodes.select("fp"), max_bits), n), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    nodes = nodes.join(sized(least, n), "label").select("fp", "component_id")
    return rows.join(sized(nodes, rows.count()), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

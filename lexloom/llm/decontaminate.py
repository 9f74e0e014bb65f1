"""Benchmark decontamination: n-gram seeds, an upper bound of the score, then Smith-Waterman alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.llm.common import matching, packed, shared_table, text_key
from lexloom.session import ship_package

SEED_WORDS = 3
BAND = 10
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
#: An alignment also scores as much as this many words (shorter items: as all their words), so that half of a short item is not enough.
MIN_WORDS = 8
#: Words of benchmark items that go to the executors at once.
BLOCK_WORDS = 200_000

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def tokens(text: str | None) -> list[bytes]:
    return TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """(best local score, its end in window); a gap run within a row is a running maximum."""
    step = np.arange(len(window)) * -GAP
    row, best, end = np.zeros(len(window), np.int32), 0, 0
    for w in item:
        slant = np.where(window == w, MATCH, MISMATCH).astype(np.int32)
        slant[1:] += row[:-1]
        new = np.maximum(np.maximum(slant, row + GAP), 0)
        row = (np.maximum.accumulate(new + step) - step).astype(np.int32)
        j = int(row.argmax())
        if row[j] > best:
            best, end = int(row[j]), j + 1
    return best, end


def most(item: np.ndarray, window: np.ndarray) -> int:
    """No alignment of ``item`` with ``window`` scores more: an item's word counts as a match if it stands anywhere in the
    window, else as the cheaper of a mismatch and a gap; the best run of words is taken."""
    run = np.concatenate(([0], np.where(np.isin(item, window), MATCH, max(MISMATCH, GAP)).cumsum()))
    return int((run - np.minimum.accumulate(run)).max())


class Block:
    """Some benchmark items: word numbers, seeds and their places."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in t], np.int64) for _, t in items]
        keys, owner, place = [], [], []
        self.lengths = sorted({min(SEED_WORDS, len(w)) for w in self.words})
        for i, w in enumerate(self.words):
            k = self.seeds(w, min(SEED_WORDS, len(w)))
            keys.append(k)
            owner.append(np.full(len(k), i))
            place.append(np.arange(len(k)))
        keys, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owner, place))
        order = np.argsort(keys, kind="stable")
        self.owner, self.place = owner[order].astype(np.int64), place[order].astype(np.int64)
        self.keys, self.first, self.times = np.unique(keys[order].astype(np.uint64), return_index=True, return_counts=True)

    @staticmethod
    def seeds(words: np.ndarray, length: int) -> np.ndarray:
        """A 64-bit number for each run of ``length`` words: SEED_WORDS, or all words of a shorter item."""
        n = len(words) - length + 1
        x = np.full(max(0, n), _MIX[0] * np.uint64(length))
        for k in range(length if n > 0 else 0):
            x = (x ^ (words[k : k + n].astype(np.uint64) + np.uint64(1))) * _MIX[k]
            x ^= x >> np.uint64(29)
        return x

    def read(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in tokens(text)], np.int64)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, seed numbers) of all seeds of all items."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        known = words >= 0
        for length in self.lengths:
            n = len(words) - length + 1
            if n <= 0:
                continue
            whole = known[:n].copy()
            for k in range(1, length):
                whole &= known[k : k + n]
            at = np.flatnonzero(whole)
            if len(at):
                x = self.seeds(words, length)[at]
                i = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
                ok = self.keys[i] == x
                places.append(at[ok])
                found.append(i[ok])
        return np.concatenate(places), np.concatenate(found)

    def leaks(self, words: np.ndarray, min_score: float) -> list[tuple[int, float, int, int]]:
        """(item number, score, start word, end word) of the best alignment of each item that scores enough."""
        at, seed = self.hits(words)
        if not len(at):
            return []
        each = np.repeat(np.arange(len(at)), self.times[seed])
        post = self.first[seed][each] + np.arange(len(each)) - np.repeat(np.cumsum(self.times[seed]) - self.times[seed], self.times[seed])
        item, diagonal = self.owner[post], at[each] - self.place[post]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(diagonal) > BAND)) + 1
        best: dict[int, tuple[float, int, int]] = {}
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(item)], strict=True):
            i = int(item[a])
            target = self.words[i]
            low, high = max(0, int(diagonal[a]) - BAND), int(diagonal[b - 1]) + len(target) + BAND
            window = words[low:high]
            full, least = MATCH * len(target), MATCH * min(MIN_WORDS, len(target))
            if (top := most(target, window)) < least or top / full < min_score:
                continue
            raw, end = align(target, window)
            score = raw / full
            if score >= min_score and raw >= least and score > best.get(i, (0.0,))[0]:
                _, back = align(target[::-1], window[:end][::-1])
                best[i] = (score, low + end - back, low + end)
        return [(i, *x) for i, x in sorted(best.items())]


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Block]:
    items, n = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if t := tokens(r[1]):
            items.append((r[0], t))
            n += len(t)
        if n >= block_words:
            yield Block(items)
            items, n = [], 0
    if items:
        yield Block(items)


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, tk, item_id, score, start_word, end_word): documents that hold an edited or exact copy of a benchmark item.

    The items are a stated query set, taken in blocks of bounded size that every executor gets.  For each block one pass over
    all documents finds the diagonals with a seed (three words of an item in a row; all words of a shorter item) and aligns the item with that stretch of the text, unless
    :func:`most` shows that the score cannot be enough.  A row's result depends on its own text alone, not on how often others copy the
    item.  A copy that keeps no three words in a row is not found.  No document text is shuffled.

    ``score`` is the local alignment score as a share of the item's own; pairs of at least ``min_score`` whose alignment is also worth
    ``MIN_WORDS`` matching words (all words of a shorter item) are returned, the best alignment for each row and item.  Null, empty and short texts hold nothing; items without words are ignored; repeated rows are
    reported alike; empty tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tk"), "text")
    kind, out = to_arrow_type(benchmark.schema["item_id"].dataType), None
    for block in _blocks(benchmark, block_words):
        sent = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                at, got = [], []
                for i, t in enumerate(b.column(2)):
                    for x in block.leaks(block.read(t.as_py()), min_score):
                        at.append(i)
                        got.append(x)
                some = b.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([block.ids[x[0]] for x in got], kind), *(pa.array([x[k] for x in got], t) for k, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64())))],
                    ["doc_id", "tk", "item_id", "score", "start_word", "end_word"])

        part = rows.mapInArrow(find, f"doc_id {doc_type}, tk long, item_id {item_type}, score double, start_word long, end_word long")
        part = shared_table(part, "leaks")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.select("doc_id", "tk", F.lit(None).cast(item_type).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("start_word"), F.lit(0).cast("long").alias("end_word")).limit(0)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    return matching(packed(docs), leaks(docs, benchmark, min_score), "left_anti").select("row.*")

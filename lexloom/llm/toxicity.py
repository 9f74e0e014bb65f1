"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import shared_table
from lexloom.session import ship_package

#: Bound on the labelled rows that the model is fitted to, and so on its features: each is in MIN_DOCS toxic ones at least.
TRAIN_DOCS = 20_000
THRESHOLD = 0.3
#: Dirichlet prior of a feature: FLAT, plus PRIOR pseudo-documents dealt by the feature's share of documents.
FLAT = 0.5
PRIOR = 10.0
MIN_DOCS = 4
#: Least signed root of the likelihood ratio of a feature's documents, toxic against other.
MIN_Z = 3.5
#: Least log-odds: a feature that is merely more frequent in one language or topic is no sign of toxicity.
MIN_WEIGHT = 3.3
MAX_WEIGHT = 6.0
STEMS = (8, 7, 6, 5, 4)
#: Weights that a worker remembers; then it starts over.
REMEMBERED = 200_000

TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of consecutive runs (start, end, score), in linear time.

    Candidates keep the cumulative score to their left and right end, and the number of the nearest candidate before them whose left total is
    smaller.  A new positive run joins such a candidate if that makes a better segment.  Going from link to link skips all candidates with
    larger left totals at once; a link that has been followed is never followed again, as the new candidate's own leads past it.
    """
    out: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for start, end, s in scores:
        left, total = total, total + s
        if s <= 0:
            continue
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                out.append((start, end, left, total, j))
                break
            start, left, j_next = out[j][0], out[j][2], out[j][4]
            del out[j:]
            j = j_next
    return [(a, b, right - left) for a, b, left, right, _ in out]


class Model:
    """Weights of words and of word beginnings, the drift of all other words, and the calibration."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], usual: set[str], drift: float, lam: float, k: float):
        self.words, self.stems, self.usual, self.drift, self.lam, self.k = words, stems, usual, drift, lam, k
        self.slope, self.offset, self.base = 1.0, -2.0, 0.05
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        self._known: dict[str, float] = {}

    def weight(self, token: str) -> float:
        """The word's weight, else that of its longest known beginning unless the word is usual; 0 for all others."""
        w = self._known.get(token)
        if w is None:
            w = self.words.get(token, 0.0)
            if not w and token not in self.usual:
                w = next((self.stems[token[:n]] for n in self.lengths if len(token) > n and token[:n] in self.stems), 0.0)
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[token] = w
        return w

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """(number of tokens, segments): between weighted tokens a run of others counts once."""
        toks, weight = tokens(text), self.weight
        runs, last = [], 0
        for i, t in enumerate(toks):
            if w := weight(t):
                if i > last:
                    runs.append((last, i, (last - i) * self.drift))
                runs.append((i, i + 1, w))
                last = i + 1
        return len(toks), maximal_segments(runs)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, int]:
        """Sum over segments of their normalised score beyond what chance gives in n tokens, and the number of those segments.

        Under the null the best segment of n tokens follows an extreme-value law: P(S >= x) = 1 - exp(-K n exp(-lambda x)).
        """
        floor = max(0.0, math.log(max(self.k * n, 1e-9)))
        over = [x for x in (self.lam * s - floor for _, _, s in found) if x > 0]
        return math.log1p(sum(over)), len(over)

    def probability(self, evidence: float) -> float:
        return self.base if evidence <= 0 else 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


def _weights(n: Column, y: Column, n_docs: int, n_toxic: int) -> Column:
    """Log-odds of a feature of n documents, y of them toxic, between toxic and other documents, under the Dirichlet prior; null unless
    they are large and significant."""
    a, x, n_clean = FLAT + PRIOR * n / F.lit(float(n_docs)), n - y, n_docs - n_toxic
    delta = F.log((y + a) / (n_toxic - y + a)) - F.log((x + a) / (n_clean - x + a))
    usual = n * F.lit(n_toxic / n_docs)
    ratio = 2 * (y * F.log(y / usual) + F.when(x > 0, x * F.log(x / (n - usual))).otherwise(0.0))
    return F.when((y >= MIN_DOCS) & (y > usual) & (delta >= MIN_WEIGHT) & (ratio >= MIN_Z**2), F.least(delta, F.lit(MAX_WEIGHT)))


def _solve(pairs: list[tuple[float, float]]) -> float:
    """The positive lambda with sum p exp(lambda s) = 1; pairs have a negative mean."""
    f = lambda x: sum(p * math.exp(x * s) for p, s in pairs) - 1
    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def training_rows(labels: DataFrame, limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, toxic, part): at most ``limit`` labelled rows, those with the smallest hashes, none held out.

    Rows whose crc32 of the id is 2 modulo 4 never take part; part is that remainder.
    """
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("part", part)
    return rows.where("part <> 2").orderBy(F.md5(F.col("doc_id").cast("string"))).limit(limit)


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """Weights from all training rows; K of the extreme-value law and the calibration from part 3, scored with weights from the other parts.

    The training ids are few by ``limit`` and are broadcast, so no text is shuffled; documents are counted by word per batch, then by word.  Only
    features whose log-odds are large and significant come to the driver.
    """
    ship_package(docs.sparkSession)
    train = F.broadcast(training_rows(labels, limit))
    rows = docs.select("doc_id", "text").join(train, "doc_id").select("text", (F.col("toxic") == 1).alias("toxic"), (F.col("part") == 3).alias("aside"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple, list[int]] = {}
            for t, toxic, aside in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                toks = tokens(t.as_py())
                words = set(toks)
                got = [*(("word", w) for w in words), *(("stem", w) for w in {w[:n] for w in words for n in STEMS if len(w) > n}), ("docs", "")]
                for key, n in (*((x, 1) for x in got), (("tokens", ""), len(toks))):
                    c = seen.setdefault(key, [0, 0, 0, 0])
                    c[2 * aside] += n
                    c[2 * aside + 1] += n * toxic
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(4))],
                                                 ["kind", "word", "n", "y", "n3", "y3"])

    counts = rows.mapInArrow(count, "kind string, word string, n long, y long, n3 long, y3 long").groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in ("n", "y", "n3", "y3")])
    counts = shared_table(counts, "toxic-counts")
    model = _calibrate(_model(counts, F.col("n"), F.col("y")), rows.where("aside"))
    final = _model(counts, F.col("n") + F.col("n3"), F.col("y") + F.col("y3"))
    final.k, final.slope, final.offset, final.base = model.k, model.slope, model.offset, model.base
    return final


def _model(counts: DataFrame, n: Column, y: Column) -> Model:
    rows = counts.select("kind", "word", n.alias("n"), y.alias("y"))
    totals = {r.kind: (r.n, r.y) for r in rows.where("kind IN ('docs', 'tokens')").collect()}
    (n_docs, n_toxic), (all_tokens, toxic_tokens) = totals.get("docs", (0, 0)), totals.get("tokens", (0, 0))
    if not 0 < n_toxic < n_docs:
        return Model({}, {}, set(), 0.1, 1.0, 1e-6)
    found = rows.where("kind IN ('word', 'stem')").withColumn("w", _weights(F.col("n"), F.col("y"), n_docs, n_toxic)).where("w IS NOT NULL").collect()
    words, stems = ({r.word: r.w for r in found if r.kind == kind} for kind in ("word", "stem"))
    begins = F.lit(False)
    for k in STEMS:
        begins = begins | F.substring("word", 1, k).isin([s for s in stems if len(s) == k])
    known = rows.where(f"kind = 'word' AND (y >= {MIN_DOCS} OR n >= {8 * MIN_DOCS})").where(begins).collect()
    clean = max(1, all_tokens - toxic_tokens)
    chance = [((r.n - r.y + FLAT) / clean, r.w) for r in found if r.kind == "word"]
    share = min(0.5, sum(p for p, _ in chance))
    drift = max(0.1, 4 * sum(p * s for p, s in chance))
    return Model(words, stems, {r.word for r in known} - words.keys(), drift, _solve([*chance, (1 - share, -drift)]) if chance else 1.0, max(share, 1e-6))


def _calibrate(model: Model, rows: DataFrame) -> Model:
    """K by maximum likelihood, then a logistic regression of the label on the evidence; texts without evidence get their own rate of label 1.

    Under the extreme-value law K n exp(-lambda S) is exponential with mean 1 for the best score S of n tokens of a clean text; a text without a segment
    says that S is at most 0.  The regression leans on the slope and offset that a model starts with.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.segments(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.int64()), pa.array([[s for _, _, s in found] for _, found in got], pa.list_(pa.float64())), b.column(1)], ["n", "s", "y"])

    got = [(r[0], r[1], bool(r[2])) for r in rows.select("text", "toxic").mapInArrow(run, "n long, s array<double>, y boolean").collect()]
    clean = [(n, max(s, default=0.0)) for n, s, y in got if not y]
    mass = sum(n * math.exp(-model.lam * best) for n, best in clean)
    if mass > 0:
        model.k = max(1e-9, sum(best > 0 for _, best in clean) / mass)
    points = sorted((model.evidence(n, [(0, 0, x) for x in s])[0], y) for n, s, y in got)
    none = [y for x, y in points if x <= 0]
    model.base = (sum(none) + 0.5) / (len(none) + 20)
    x = np.array([x for x, _ in points if x > 0])
    y = np.array([float(y) for x, y in points if x > 0])
    design, prior = np.stack([x, np.ones_like(x)], 1), np.array([model.slope, model.offset])
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hess, design.T @ (y - p) - 1e-2 * (beta - prior))
    model.slope, model.offset = map(float, beta)
    return model


def score(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, passages: bool = True) -> DataFrame:
    """Toxicity of every row's whole text: doc_id, held_out, score, predicted, n_segments and, with ``passages``, the segments (start, end, score; token numbers).

    The model is fitted to at most ``limit`` labelled rows outside the held-out quarter; then every text is read once, and all its
    maximal scoring segments beyond chance add to its evidence.  Null and empty texts have no segments and the score of such
    texts; repeated rows are scored alike; without labels every score is the base rate; an empty table gives no rows; further columns
    are ignored.  Labels, language, source and id are no inputs of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, limit))
    seg = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            scores, many, found = [], [], []
            for t in b.column(2):
                n, segments = m.segments(t.as_py())
                evidence, k = m.evidence(n, segments)
                scores.append(m.probability(evidence))
                many.append(k)
                found.append([{"start": s, "end": e, "score": x} for s, e, x in segments] if passages else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()),
                                              pa.array(many, pa.int64()), pa.array(found, seg)], ["doc_id", "held_out", "score", "predicted", "n_segments", "segments"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))).alias("held_out"), "text")
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_segments long, segments array<struct<start:int,end:int,score:double>>")
    return out if passages else out.drop("segments")

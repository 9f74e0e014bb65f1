import math
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.operators import dense, embedding, fusion, generation, sparse
from lexloom.plans import rag


def test_knn_with_zero_and_null_vectors(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [3.0, 0.0])], "query_id long, embedding array<double>")
    got = [(r.vec_id, r.score, r.rank) for r in dense.knn(base, q, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0, 1), (4, 1.0, 2), (2, 0.0, 3)]
    assert dense.retrieve(base, q, 3, 0.3).count() == 2
    assert dense.knn(base, q.limit(0), 3).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 4))
    base = spark.createDataFrame([(i, m[i].tolist()) for i in range(30)], "vec_id long, embedding array<double>").repartition(3)
    q = base.where("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.vec_id for r in dense.knn(base, q, 4).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for i in range(5):
        assert [got[i, k + 1] for k in range(4)] == np.lexsort((np.arange(30), -np.round(u @ u[i], 6)))[:4].tolist()


def test_knn_of_many_queries_holds_few_cosines(spark, monkeypatch):
    base = spark.createDataFrame([(0, [1.0] * 4)], "vec_id long, embedding array<double>")
    made, real = [], type(base).mapInArrow
    monkeypatch.setattr(type(base), "mapInArrow", lambda self, f, schema: made.append(f) or real(self, f, schema))
    rng = np.random.default_rng(2)
    m, x = rng.normal(size=(4096, 4)), rng.integers(-2, 3, (10_000, 4)).astype(float)
    q = spark.createDataFrame(pd.DataFrame({"query_id": range(4096), "embedding": m.tolist()}))
    dense.knn(base, q)
    ids = rng.permutation(10_000)
    parts = [pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(x[a:b].tolist())], ["vec_id", "embedding"]) for a, b in ((0, 3), (3, 3), (3, 10_000))]
    tracemalloc.start()
    got = list(made[-1](iter(parts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert [b.num_rows for b in got] == [5 * 4096]
    rows = {}
    for i, v, score in zip(*(c.to_pylist() for c in got[0].columns), strict=True):
        rows.setdefault(i, []).append((-score, v))
    unit = dense._unit(x)
    for i in range(0, 4096, 100):
        cos = np.round(unit @ dense._unit(m[i : i + 1])[0], 6)
        assert sorted(rows[i]) == [(-cos[j], ids[j]) for j in np.lexsort((ids, -cos))[:5]]


def test_bm25(spark):
    texts = ["the cat sat", "the dog sat", "the cat the cat", "", "bird"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    q = spark.createDataFrame([(1, "cat cat the zebra")], "query_id long, query string")
    got = {r.chunk_id: r.score for r in sparse.search(chunks, q, ["chunk_id"], 5).collect()}
    docs = [t.split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w in {w for d in docs for w in d} for d in [sum(w in x for x in docs)]}
    mean = sum(raw.values()) / len(raw)
    for i, d in enumerate(docs):
        want = sum((0.25 * mean if raw[w] < 0 else raw[w]) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in "cat cat the zebra".split() if w in d)
        assert got.get(i, 0) == pytest.approx(max(want, 0), abs=1e-5)


def test_fusion_is_symmetric_at_half(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, key string, rank int")
    one = [(r.key, r.score) for r in fusion.reciprocal_rank(a, b, "key", 0.5).orderBy("rank").collect()]
    two = [(r.key, r.score) for r in fusion.reciprocal_rank(b, a, "key", 0.5).orderBy("rank").collect()]
    assert one == two and one[0][0] == "y"
    with pytest.raises(ValueError):
        fusion.reciprocal_rank(a, b, "key", 1.5)


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "red fox", "a", "a red fox", 0.1), (1, "red fox", "b", "blue", 0.9), (2, "solo", "c", "x", 0.3)],
                                 "query_id int, query string, chunk_id string, text string, score double")
    got = {(r.query_id, r.chunk_id): (r["rank"], r.reranked) for r in fusion.rerank(rows).collect()}
    assert got == {(1, "a"): (1, True), (1, "b"): (2, True), (2, "c"): (1, False)}


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, " "), (3, None)], "i int, text string")
    got = {r.i: r.embedding for r in embedding.embed(rows, embedding.HashingEmbedder(8)).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and got[2] == [0.0] * 8 == got[3]


def test_flags(spark):
    rows = spark.createDataFrame([(1, '["a"]'), (2, "```json\n[\"b\", \"c\"]\n```"), (3, "{}"), (4, "x"), (5, None), (6, '[1, "d"]')], "i int, raw string")
    got = {r.i: r.f for r in rows.select("i", generation.parse_flags(F.col("raw")).alias("f")).collect()}
    assert got[1] == ["a"] and got[2] == ["b", "c"] and got[3] == [] == got[4] and got[6] == ["1", "d"]


class Echo:
    def complete(self, prompt):
        return prompt[-20:]


def test_whole_pipeline(spark):
    docs = spark.createDataFrame([(1, "Article 1: Theft is punished by a fine of AED 10,000.\nArticle 2: Fraud is punished by prison."), (2, "Article 9: Leave lasts thirty days.")], "doc_id long, text string")
    chunks = rag.ingest(docs)
    assert chunks.count() == 3
    queries = spark.createDataFrame([(1, "How is theft punished?"), (2, "zzz qqq")], "query_id long, query string")
    found = rag.hybrid(chunks, queries)
    got = {r.query_id: r for r in rag.answer(chunks, queries, found).collect()}
    assert "Theft" in got[1].answer and got[1].source_count > 0 and 0 < got[1].confidence <= 1
    assert got[2].answer == generation.NO_ANSWER and got[2].confidence == 0
    assert rag.answer(chunks, queries, found, Echo(), "formal").count() == 2

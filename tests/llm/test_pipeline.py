"""Every stage of the pipeline against brute force on what the stage before it kept."""

import json

import numpy as np

import corpus_pipeline as P
from lexloom.llm import decontaminate, mixing, quality
from tests.llm.test_lines import brute
from tests.llm.test_near import plain_groups, text_of


def test_stages(spark, sf, docs, tmp_path, duck):
    columns = docs.columns
    out = {}
    for i, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, sf)
        got.write.parquet(str(tmp_path / str(i)))
        out[name] = docs, spark.read.parquet(str(tmp_path / str(i)))
        docs = out[name][1]
        assert i + 1 == len(P.STAGES) or docs.columns == columns

    before, after = out["quality rules"]
    want = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({quality.ORACLE.format(documents='documents')}) WHERE kept").fetchall()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)

    before, after = out["line dedup"]
    rows = before.orderBy("doc_id").collect()
    assert [(r.text, r.n_chars) for r in after.orderBy("doc_id").collect()] == [(k, len(k)) for _, _, k in brute([r.text for r in rows])]

    before, after = out["near-dedup"]
    rows = before.collect()
    u = plain_groups(rows)
    least = {}
    for r in rows:
        k = u.find(text_of(r))
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())

    before, after = out["decontamination"]
    items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = set()
    for r in before.collect():
        w = decontaminate.tokens(r.text)
        for t in items:
            if len(set(t) & set(w)) >= min(len(set(t)), 4):
                number = {x: k for k, x in enumerate(t)}
                score, _ = decontaminate.align(np.array([number[x] for x in t]), np.array([number.get(x, -1) for x in w]))
                if score >= len(t) and score >= 2 * min(8, len(t)):
                    bad.add(r.doc_id)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad and bad

    before, after = out["mixing"]
    path = str(tmp_path / "3" / "*.parquet")
    want = duck.execute(mixing.ORACLE.format(documents=f"read_parquet('{path}')")).fetchall()
    key = lambda r: json.dumps([r[0], r[1], r[2], r[5]])
    assert sorted(map(key, after.select("doc_id", "size", "source", "source_size", "target", "taken").collect())) == sorted(map(key, want))


def test_odd_rows(spark, sf, odd, none):
    for df in (odd, none):
        docs = df
        for i, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, sf)
            if i + 1 < len(P.STAGES):
                assert docs.columns == df.columns
        rows = docs.collect()
        assert all(r.taken >= 0 and r["size"] >= 10 for r in rows) and (df is none) == (not rows)


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 50

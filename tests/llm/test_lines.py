import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexloom.llm import line_dedup as L

STRIP = " \t\n\x0b\f\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(STRIP))


def brute(texts, least=10):
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for x in lines for k in {key(y) for y in x} if k)
    out = []
    for x in lines:
        kept = [y for y in x if not key(y) or seen[key(y)] < least]
        out.append((len(x), len(x) - len(kept), "\n".join(kept)))
    return out


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        mph = L.PerfectHash.load(L.PerfectHash.build(keys).dump())
        assert sorted(mph.number(keys).tolist()) == list(range(len(keys)))
        assert n < 1000 or len(mph.dump()) * 8 < 5 * len(keys)


def test_homeless_keys(monkeypatch):
    monkeypatch.setattr(L, "MAX_LEVELS", 1)
    keys = np.arange(1, 2001, dtype=np.uint64)
    mph = L.PerfectHash.load(L.PerfectHash.build(keys).dump())
    assert sorted(mph.number(keys).tolist()) == list(range(2000)) and mph.number(np.array([5000], np.uint64))[0] < 2000


def test_colliding_lines_keep_their_counts():
    import pandas as pd

    rows = pd.DataFrame({"shard": [0] * 3, "h": [7, 7, 9], "f": [1, 2, 3], "n": [5, 50, 3]})
    r = L.build_shard(rows).iloc[0]
    shard = L.Shard(r["mph"], r["prints"], r["counts"], r["twins"])
    assert shard.count(np.array([7, 7, 9, 9], np.int64), np.array([1, 2, 3, 4], np.int32)).tolist() == [5, 50, 3, 0]


def test_against_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    for sizes in ({}, {"keys_per_shard": 500, "rows_per_task": 5}):
        got = Counter(map(tuple, L.dedup_lines(odd, **sizes).select("n_lines", "n_dropped", "kept").collect()))
        assert got == Counter(brute([r.text for r in rows]))


def test_columns_survive(odd, none):
    assert L.dedup_lines(odd).select("row.*").columns == odd.columns
    assert L.dedup_lines(none).count() == 0


def test_sha(docs):
    got = L.dedup_lines(docs).select("kept", F.sha2("kept", 256)).first()
    assert hashlib.sha256(got[0].encode()).hexdigest() == got[1]

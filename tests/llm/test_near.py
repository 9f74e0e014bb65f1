from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from lexloom.llm import common, near_dedup, simhash
from lexloom.llm.common import components


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def plain_fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(docs, odd):
    for df in (docs.limit(40), odd):
        rows = [r for r in df.select("doc_id", "text").collect() if len(r.text or "") < 50_000]
        for r in rows:
            assert simhash.fingerprint(simhash.shingle_hashes(r.text, 4)) % 2**64 == plain_fingerprint(r.text, 4)


def test_hash_is_the_engines(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab é"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("ab é".encode(), 42)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(60)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (80, 2))] + [(300, 300), (500, 501)] + [(700, i) for i in range(701, 760)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    want = {i: u.find(i) for i in {x for a, b in edges if a != b for x in (a, b)}}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == want and got.count() == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_few_jobs(spark):
    """The driver holds each job's plan and broadcasts; the rounds over all tasks and the one task agree."""
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(int(a), int(b)) for a, b in rng.integers(-900, -400, (400, 2))] + [(5000, 5000), (None, 1)]
    u = Union({x for e in edges for x in e if x is not None})
    for a, b in edges:
        if a is not None:
            u.join(a, b)
    want = {i: u.find(i) for i in {x for a, b in edges if a is not None and a != b for x in (a, b)}}
    df, sc = spark.createDataFrame(edges, "a long, b long"), spark.sparkContext
    jobs = {}
    for most in (0, 100, common.TASK_EDGES):
        sc.setJobGroup(f"components-{most}", "")
        try:
            rows = components(df, *[most] * (most < common.TASK_EDGES)).collect()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs[most] = len(sc.statusTracker().getJobIdsForGroup(f"components-{most}"))
        assert {r.node: r.label for r in rows} == want and len(rows) == len(want)
    assert 0 < jobs[common.TASK_EDGES] <= 6 < jobs[0]


def test_links_within_four_bits_are_complete(spark):
    """Random fingerprints, each with neighbours at every distance up to six, and a ball of near copies."""
    rng = np.random.default_rng(7)
    fps = set()
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64).tolist():
        fps.add(base)
        for d in range(1, 7):
            x = base
            for b in rng.choice(64, d, replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    centre = 0x0F0F0F0F12345678
    for _ in range(200):
        x = centre
        for b in rng.choice(64, 3, replace=False).tolist():
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    u = Union(fps)
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            u.join(a, b)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    for bits in (4,):
        rows = simhash.link(spark.createDataFrame([(signed(x),) for x in fps], "fp long"), bits).collect()
        label = {r.fp % 2**64: r.label for r in rows}
        assert len(label) == len(rows)
        want = Counter(u.find(x) for x in fps)
        groups = {}
        for x in fps:
            groups.setdefault(u.find(x), set()).add(label.get(x, signed(x)))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(want)


def test_near_duplicates(docs, odd, none):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        fp = [simhash.fingerprint(simhash.shingle_hashes(r.text, 4)) % 2**64 for r in rows]
        nodes = sorted(set(fp))
        u = Union(nodes)
        for a, b in combinations(nodes, 2):
            if (a ^ b).bit_count() <= 4:
                u.join(a, b)
        least = {}
        for r, f in zip(rows, fp, strict=True):
            k = u.find(f)
            least[k] = min((x for x in (least.get(k), r.doc_id) if x is not None), default=None)
        want = Counter((r.doc_id, f"{f:016x}", least[u.find(f)]) for r, f in zip(rows, fp, strict=True))
        assert Counter(map(tuple, simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect())) == want
    assert simhash.near_duplicates(none).count() == 0


def plain_groups(rows, similarity=0.8):
    texts = sorted({r.text or "\0" if r.text is not None else "\0null" for r in rows})
    sets = {t: set(simhash.shingle_hashes(None if t == "\0null" else t, 5).tolist()) if t != "\0" else set() for t in texts}
    u = Union(texts)
    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            u.join(a, b)
    return u


def text_of(r):
    return "\0null" if r.text is None else r.text or "\0"


def test_similar_texts(spark, docs, odd, none):
    base = docs.where("n_chars between 600 and 2500").select("doc_id", "text").limit(25).collect()
    rows = [(r.doc_id, r.text) for r in base]
    for n, r in enumerate(base):  # copies with ever more words replaced
        words = r.text.split()
        for k in range(1, 8):
            w = list(words)
            for i in range(k):
                w[(i + 1) * len(w) // (k + 1)] = f"edit{n}x{k}x{i}"
            rows.append((10_000 + 10 * n + k, " ".join(w)))
    made = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (made, odd):
        rows = df.select("doc_id", "text").collect()
        u = plain_groups(rows)
        got = near_dedup.groups(df).collect()
        assert len(got) == len(rows)
        kept = near_dedup.keep_one(df)
        assert kept.columns == df.columns and kept.count() == len({u.find(text_of(r)) for r in rows})
    assert near_dedup.keep_one(none).count() == 0


def test_symbols_that_differ(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 16, (2, near_dedup.SYMBOLS))
    pack = lambda s: (s.astype(np.uint64).reshape(-1, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64).view(np.int64).tolist()
    got = spark.createDataFrame([(pack(a), pack(b))], "a array<long>, b array<long>").select(near_dedup.differing(F.col("a"), F.col("b"))).first()[0]
    assert got == int((a != b).sum())


def test_texts_whose_hashes_clash_stay_apart(spark):
    rows = spark.createDataFrame([(1, 7, 70), (2, 7, 71), (3, 7, 70), (4, 8, 70), (5, 9, 90)], "doc_id long, tk long, tk2 long")
    node = {r.doc_id: r.node for r in near_dedup.told_apart(rows).collect()}
    assert node[1] == node[3] and len({node[1], node[2], node[4], node[5]}) == 4 and (node[4], node[5]) == (8, 9)


def _plans(monkeypatch, modules, run):
    """Physical plans, before adaptive changes, of the shared tables that ``run`` writes, and of what it returns."""
    plans, plan = [], lambda df: df._jdf.queryExecution().sparkPlan().toString()
    for m in modules:
        def spy(df, name, *rest, write=m.shared_table):
            plans.append((name, plan(df)))
            return write(df, name, *rest)

        monkeypatch.setattr(m, "shared_table", spy)
    out = run()
    return out, [*plans, ("result", plan(out))]


def test_filed_fingerprints_do_not_pass_through_the_driver(spark, docs, monkeypatch):
    """The optimizer sees one row for each fingerprint where 37 are filed, and the size of encoded files where rows are meant."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    want = Counter(map(tuple, simhash.near_duplicates(docs).collect()))
    _, plans = _plans(monkeypatch, [simhash], lambda: simhash.near_duplicates(docs))
    assert [p for name, p in plans if name == "ring-buckets" and "Join" in p and "Broadcast" not in p]
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)  # as if every count were large
    got, plans = _plans(monkeypatch, [simhash, common], lambda: simhash.near_duplicates(docs))
    assert not [name for name, p in plans if "Broadcast" in p] and len(plans) > 8
    assert Counter(map(tuple, got.collect())) == want


def test_similar_texts_within_four_bits_are_found_by_simhash_alone(spark, docs, monkeypatch):
    """The named method is a path of its own: it links what it reaches while the longer fingerprint lets no pair pass."""
    monkeypatch.setattr(near_dedup, "MAX_DIFFER", -1)
    rows = []
    for n, r in enumerate(docs.where("n_chars between 1500 and 2500").select("text").limit(12).collect()):
        words = r.text.split()
        rows += [(100 * n, r.text), (100 * n + 1, " ".join(["first", *words])), (100 * n + 2, " ".join([*words, "last"])), (100 * n + 3, " ".join([*words, *words])), (100 * n + 4, " ".join(words[: len(words) // 2]))]
        rows += [(100 * n + 10 + k, " ".join([*words[: k * 7], "edit", *words[k * 7 :]])) for k in range(1, 6)]
    rows += [(9_000, None), (9_001, ""), (9_002, "")]
    u = Union({text_of(Row(text=t)) for _, t in rows})
    hashes = {text_of(Row(text=t)): simhash.shingle_hashes(t, near_dedup.WORDS) for _, t in rows if t}
    links = 0
    for (a, x), (b, y) in combinations(hashes.items(), 2):
        near = (simhash.fingerprint(x) ^ simhash.fingerprint(y)) % 2**64
        x, y = set(x.tolist()), set(y.tolist())
        if near.bit_count() <= 4 and len(x & y) >= 0.8 * len(x | y):
            u.join(a, b)
            links += 1
    want = {}
    for i, t in rows:
        want.setdefault(u.find(text_of(Row(text=t))), set()).add(i)
    got = {}
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for r in near_dedup.groups(made).collect():
        got.setdefault(r.label, set()).add(r.doc_id)
    assert links > 12 and sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))

"""License scans, quality rules and mixing on hand-made rows."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import license_scan, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, *cols):
    return Counter(map(tuple, df.select(*cols).collect()))


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = defaultdict(list)
    for i in range(len(words) - 4):
        grams[tuple(words[i : i + 5])].append(i)
    inside = {p + k for at in grams.values() if len(at) > 1 for p in at for k in range(5)}
    base = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), base


def test_quality_counts(odd, docs):
    for df in (odd, docs):
        got = rows_of(quality.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert got == Counter((r.doc_id, *plain_quality(r.text)) for r in df.select("doc_id", "text").collect())


def test_quality_keeps(odd, none, docs):
    judged = quality.judge(docs)
    assert judged.where("kept AND base_failed").count() == 0 and judged.where("kept").count() > 0.7 * docs.count()
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() == quality.judge(odd).where("kept").count()
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0


def prose(i, n=60, extra=0):
    """``n`` words that hold ``extra`` symbols among them."""
    return " ".join(f"word{i}x{k}" + "|" * (extra // n + (k < extra % n)) for k in range(n))


def test_fences_follow_the_group(spark):
    """What is usual in one source is far beyond the fence of another; no cutoff is the same for all."""
    rows = [(i, prose(i), "en", "news", 1) for i in range(300)] + [(1000 + i, prose(i, extra=20 + i % 9), "en", "code", 1) for i in range(300)]
    rows += [(5000, prose(1, extra=25), "en", "news", 1), (5001, prose(1, extra=25), "en", "code", 1), (5002, prose(1, extra=120), "en", "code", 1), (5003, prose(1, extra=2), "en", "news", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in quality.judge(df).where("NOT kept").collect()} == {5000, 5002}


def test_junk_below_a_quarter_does_not_move_a_fence(spark):
    for share in (5, 20):
        rows = [(i, prose(i, extra=40 if i % 100 < share else 0), "en", "a", 1) for i in range(400)]
        got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
        assert {r.doc_id for r in got.where("NOT kept").collect()} == {i for i in range(400) if i % 100 < share}


def test_small_groups_lean_on_wider_sketches(spark):
    """A group of one junk row has its language's fence; a language of one row has the corpus's."""
    rows = [(i, prose(i), "en", f"s{i % 3}", 1) for i in range(300)] + [(900, prose(1, extra=40), "en", "new", 1), (901, prose(1, extra=40), "xx", None, 1), (902, prose(1), "xx", None, 1)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert {r.doc_id for r in got.where("NOT kept").collect()} == {900, 901}


@pytest.mark.parametrize("sf_dir", ["sf0.01", "sf0.1"])
def test_no_constant_decides(spark, sf, sf_dir):
    """Groups have fences of their own, and good documents stay: of the labelled ones that pass the base rule, 95 % and more."""
    folder = f"{sf.rsplit('/', 1)[0]}/{sf_dir}"
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    measured = quality.features(rows).withColumns(quality.metrics()).cache()
    fences = quality.thresholds(quality.sketch(measured)).collect()
    assert len(fences) == 80
    for edge in (lambda r: r.q3_word_length + 3 * r.gap, lambda r: r.q1_word_length - 3 * r.gap):
        assert Counter(map(edge, fences)).most_common(1)[0][1] < 20 and len(set(map(edge, fences))) >= 15
    good = quality._verdicts(measured, 3, 50).join(spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1"), "doc_id").where("NOT base_failed")
    bad = quality._verdicts(measured, 3, 50).join(spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0"), "doc_id")
    assert good.where("kept").count() > 0.95 * good.count() and bad.where("kept").count() < 0.05 * bad.count()


def test_buckets(spark):
    got = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id < max(r.b + 1, r.b * 33 / 32 + 1) for r in got) and all(r.b == r.id for r in got if r.id < 64)


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        w = sum(weight[s] for s in order if s not in stopped)
        t = {s: stopped.get(s, weight[s] * rest / w if w else 0) for s in order}
        over = {s: 3 * sizes[s] for s in order if s not in stopped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        stopped |= over


def test_mixing(odd, docs, none):
    for df in (odd, docs):
        for per in (3, 50_000):
            rows = mixing.mix(df, rows_per_bucket=per).collect()
            sizes, most, taken, target = Counter(), Counter(), Counter(), {}
            for r in rows:
                assert 0 <= r.taken <= 3 * r["size"]
                sizes[r.source] += r["size"]
                most[r.source] = max(most[r.source], r["size"])
                taken[r.source] += r.taken
                target[r.source] = r.target
            assert target == pytest.approx(plain_targets(sizes))
            for s, t in target.items():
                assert abs(taken[s] - t) <= most[s] / 2 + 1e-6
            assert rows_of(mixing.mix(df, rows_per_bucket=per), "doc_id", "size", "source", "taken") == Counter((r.doc_id, r["size"], r.source, r.taken) for r in rows)
    assert mixing.mix(none).count() == 0


def test_repeated_and_missing_ids(spark):
    """A third of a source without an id and a third with the same id: each row counts, the mix stays near its target."""
    rows = [(i if i % 3 == 0 else None if i % 3 == 1 else 7, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_bucket=50).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, len(t.split()), s) for i, t, s in rows)
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 3


def test_slices_change_nothing(docs):
    one = rows_of(mixing.mix(docs), "doc_id", "taken")
    assert one == rows_of(mixing.mix(docs.repartition(7), rows_per_bucket=2), "doc_id", "taken")


LICENSE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_license(odd, docs, none, spark):
    texts = [(1, "Under the MIT license. under THE mit license"), (2, "Apache License, Version 2.0; CC-BY-NC"), (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
             (4, "license mit the under"), (5, None), (6, ""), (7, "İmit under the mit licenseé"), (8, "x" * 10 + " under\nthe\tmit  LICENSE " * 3)]
    made = spark.createDataFrame(texts, "doc_id long, text string")
    for df in (made, odd, docs):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            w = LICENSE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
            at = [(i, label) for label, p in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
            places = [i for i, _ in at]
            want[r.doc_id, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
        got = license_scan.scan(df)
        assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
        assert got.where("score < 0 OR score > 1 OR (n_base > 0 AND score < 1)").count() == 0
    got = {r.doc_id: r.labels for r in license_scan.scan(made).collect()}
    assert got[1] == "mit" and got[2] == "apache-2,cc-by-nc" and got[3] == "mit" and got[4] == "" == got[5]
    assert license_scan.scan(none).count() == 0


def test_texts_of_nothing_but_notices(spark):
    n = 200_000
    rows = [(1, "under the MIT license\n" * n), (2, "xx under the terms of the GNU General Public License, as published " * (n // 20)), (3, "the " * n), (4, "mit license the under " * n)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (n, 0, 4 * n - 4, "mit")
    assert got[2].n_base == 0 and got[2].labels == "gpl" and got[2].score == 11 / 16 and got[3].labels == ""
    assert got[4].n_base == 0


def test_templates_are_looked_up_by_the_rarest_word_of_the_corpus(spark):
    """Which word is rarest changes the plan, never the result."""
    notice = "Licensed under the Apache License, Version 2.0"
    for common in ("apache", "license", "version", "the"):
        rows = [(0, notice), (1, "the apache license " + notice + " version 2")] + [(i, f"{common} filler") for i in range(2, 30)]
        got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert [(got[i].n_base, got[i].first_word, got[i].labels, got[i].score) for i in (0, 1)] == [(1, 3, "apache-2", 1.0), (1, 6, "apache-2", 1.0)]

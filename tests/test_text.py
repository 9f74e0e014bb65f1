import os
import subprocess
import sys
import tracemalloc
import unicodedata

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import structure


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r[1] for r in rows.select("i", f(F.col("text"))).orderBy("i").collect()]


def test_clean(spark):
    got = one(spark, T.clean, "  a ‘b’ — c…​  d\x07 \r\n\n\n\n e ͸", None, "", "ﬁne")
    assert got == ["a 'b' -- c... d\n\ne", "", "", "fine"]


def test_clean_is_idempotent(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    once = T.clean(F.col("text"))
    assert rows.select(once.alias("a")).withColumn("b", T.clean(F.col("a"))).where("a <> b").count() == 0


def test_normalize(spark):
    got = one(spark, T.normalize, "Art. 5 and art 6", "Art.7", "pay AED 10,000, or AED20,5", "3 - 5 years", "1 - 2 - 3", "Article 1, Art.9", "Nothing")
    assert got[:2] == ["Article 5 and Article 6", "Article 7"]
    assert got[2] == "pay AED 10000 or AED 205"
    assert got[3:5] == ["3-5 years", "1-2 - 3"]
    assert got[5] == "Article 1, Article 9"


def test_abbreviation_stays_when_the_word_occurs(spark):
    assert one(spark, T.expand_abbreviations, "Article 1, Art.9", "Art.9 Ch.2") == ["Article 1, Art.9", "Article9 Chapter2"]


def test_sentences(spark):
    got = one(spark, T.sentences, "Hi. This is a long enough sentence. So? 3 more. end. not split", "Short.", "", "A. B. C.")
    assert got[0] == ["Hi. This is a long enough sentence.", "So?", "3 more. end. not split"]
    assert got[1:] == [["Short."], [], ["A. B. C."]]


def test_structure(spark):
    text = "Intro\nPART ONE: General\nCHAPTER IV. Theft\nArticle 1: body\nsee Article 2\nArticle 3\nx"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "no heads")], "doc_id int, text string")
    found = {(r.kind, r.number, r.title, r.position) for r in structure.positions(docs).collect()}
    assert ("parts", "ONE", "General", 6) in found and ("chapters", "IV", "Theft", text.index("CHAPTER")) in found
    assert {r[1] for r in found if r[0] == "articles"} == {"1", "2", "3"}
    got = [(r.doc_id, r.pos, r.number, r.body) for r in structure.articles(docs).orderBy("pos").collect()]
    assert got == [(1, 0, "1", "Article 1: body\nsee Article 2"), (1, 1, "3", "Article 3\nx")]


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aB.! \n9,-", max_size=40), min_size=1, max_size=20))
def test_sentence_twins_agree(spark, texts):
    from lexloom.operators.chunking import sentence_list

    assert one(spark, T.sentences, *texts) == [sentence_list(t) for t in texts]


def test_nfkc_holds_few_strings():
    texts = [None, "", "plain", *(f"\ufb01ne caf\u00e9 {i} \u2026" * 100 for i in range(3000))]
    batch = pa.array(texts)
    del texts
    tracemalloc.start()
    got = list(T._nfkc.func(iter([batch, batch.slice(0, 0)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6
    assert got[0].to_pylist() == [x and unicodedata.normalize("NFKC", x) for x in batch.to_pylist()] and not len(got[1])


def test_workers_of_text_functions_do_not_load_pandas():
    subprocess.run([sys.executable, "-c", "import sys, lexloom.functions.text, lexloom.operators.chunking, lexloom.operators.dense; assert 'pandas' not in sys.modules"], check=True, cwd=os.path.dirname(os.path.dirname(__file__)))


def test_long_amounts(spark):
    amount = ",".join(["123"] * 40)
    got = spark.createDataFrame([(f"AED {' ' * 30}{amount}, and 1,2 but AED5,000",)], "t string").select(T.currency(F.col("t"))).first()[0]
    assert got == f"AED {amount.replace(',', '')} and 1,2 but AED 5000"


def test_totals_before(spark):
    from lexloom.functions.arrays import totals_before

    rows = [(list(range(n)),) for n in (0, 1, 2, 255, 256, 257, 1000)]
    for (a,), r in zip(rows, spark.createDataFrame(rows, "a array<long>").select(totals_before(F.col("a"))).collect(), strict=True):
        assert r[0] == [sum(a[:i]) for i in range(len(a))]


def test_positions_of_repeated_rows(spark):
    from lexloom.operators import structure

    df = spark.createDataFrame([(1, "Article 1: a\nArticle 2: b")] * 2, "doc_id long, text string")
    assert sorted(r.position for r in structure.positions(df).where("kind = 'articles'").collect()) == [0, 0, 13, 13]

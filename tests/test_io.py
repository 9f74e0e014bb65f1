import json

import pytest
from pyspark.sql import functions as F

from lexloom.operators import chunking
from lexloom.sources import readers, sinks
from lexloom.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "uae_penal_code.txt").write_text("Article 1: Theft", encoding="utf-8")
    (d / "latin.txt").write_bytes("caf\xe9 law".encode("latin-1"))
    (d / "blank.txt").write_text(" \n ")
    (d / "data.json").write_text('{"a": 1}')
    (d / "scan.pdf").write_bytes(b"page one|page two|")
    (d / "bad.pdf").write_bytes(b"!")
    (d / "skip.doc").write_text("no")
    return d


def pages(content):
    if content == b"!":
        raise OSError("broken")
    return content.decode().split("|")


def test_directory(spark, folder):
    got = {r.source: r for r in readers.directory(spark, str(folder), pages).collect()}
    assert set(got) == {"uae_penal_code.txt", "latin.txt", "data.json", "scan.pdf"}
    assert got["latin.txt"].text == "caf\xe9 law" and got["scan.pdf"].text == "page one\n\npage two"
    assert got["uae_penal_code.txt"].law_name == readers.LAWS["penal_code"] and got["uae_penal_code.txt"].label.startswith("doc_")
    assert readers.directory(spark, str(folder)).count() == 3


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception):
        readers.text_files(spark, str(tmp_path / "none.txt")).count()


def test_table(spark):
    rows = spark.createDataFrame([(0, "", "body", "T"), (1, " ", None, "U"), (2, "x", "y", None)], "i long, text string, content string, title string")
    got = [(r.doc_id, r.text, r.law_name) for r in readers.table(rows, "set", "i").orderBy("doc_id").collect()]
    assert got == [("hf_set_0", "body", "T"), ("hf_set_2", "x", "")]


def test_query_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"id": "q1", "query": "x?", "category": "simple", "difficulty": "easy", "expected_law": "penal", "expected_articles": ["1"]}]))
    (tmp_path / "g.json").write_text(json.dumps([{"query_id": "q1", "expected_answer": "a", "relevant_articles": ["1"], "source_law": "penal"}]))
    assert readers.test_queries(spark, str(tmp_path / "q.json")).first().expected_articles == ["1"]
    assert readers.ground_truth(spark, str(tmp_path / "g.json")).first().query_id == "q1"


def test_sinks(spark, tmp_path):
    chunks = chunking.sliding(spark.createDataFrame([(1, "y" * 300)], "doc_id long, text string"))
    sinks.chunk_previews(chunks, str(tmp_path / "p"))
    r = spark.read.json(str(tmp_path / "p")).first()
    assert r.text == "y" * 200 + "..." and r.full_length == 300
    store = sinks.Collection(spark, str(tmp_path / "store"), "laws")
    store.add(chunks)
    store.add(chunks.withColumn("text", F.lit("new")))
    assert store.stats()["total_chunks"] == 1 and store.read().first().text == "new"
    store.add(chunks.withColumn("chunk_id", F.lit("other")))
    assert store.stats()["total_chunks"] == 2
    store.replace(chunks)
    assert store.stats()["total_chunks"] == 1
    store.delete()
    assert not (tmp_path / "store" / "collection=laws").exists()


def test_response_json(spark):
    rows = spark.sql("""SELECT 'q' AS query, 'a' AS answer, array(named_struct('text', 't', 'law_name', cast(null AS string), 'article_number', '3', 'chapter', cast(null AS string), 'score', 0.123456D)) AS sources,
      0.98765D AS confidence, array('f') AS hallucination_flags, 0.1D AS retrieval_time, 0.2D AS generation_time""")
    assert json.loads(sinks.response_json(rows).first().body) == {
        "query": "q", "answer": "a", "sources": [{"text": "t", "law_name": "Unknown", "article_number": "3", "chapter": "", "score": 0.1235}], "confidence": 0.988, "hallucination_flags": ["f"],
        "timing": {"retrieval": 0.1, "generation": 0.2, "total": 0.3}}


def test_stream(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    ingest.start(spark, str(folder), out, str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(out)
    assert got.where(F.col("article_number") == "1").count() == 1 and got.count() == 2
    (folder / "more.txt").write_text("Article 5: Leave")
    ingest.start(spark, str(folder), out, str(tmp_path / "cp"), once=True).awaitTermination()
    assert spark.read.parquet(out).count() == 3

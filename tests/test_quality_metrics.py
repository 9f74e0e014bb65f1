from pyspark.sql import functions as F

from lexloom.operators import evaluate, experiments, verify
from lexloom.operators.embedding import HashingEmbedder

CONTEXT = "Article 461: Theft is punished by imprisonment of three years.\n\nArticle 2: The fine is 10,000 dirhams."


def test_claims(spark):
    text = "Hello there my friend. **Theft** is punished by prison, while fraud is punished by a fine. Is that so really now? 1. Of course it is so indeed. Short one."
    rows = spark.createDataFrame([(text,), (None,), ("",)], "response string")
    got = [r[0] for r in rows.select(verify.claims(F.col("response"))).collect()]
    assert got[0] == ["Theft is punished by prison", "fraud is punished by a fine"] and got[1] == [] == got[2]


def test_verify(spark):
    rows = spark.createDataFrame([(1, "Article 46 says theft is punished by imprisonment.", CONTEXT), (2, "Bicycles require helmets under regulation 77.", CONTEXT), (3, "", CONTEXT), (4, "Anything can be claimed here.", None)],
                                 "i int, response string, context string")
    got = {r.i: r for r in verify.report(verify.verify(rows)).collect()}
    assert got[1].is_faithful and got[1].risk_level == "low" and got[1].unverified_articles == ["46"]
    assert not got[2].is_faithful and got[2].verdicts[0].number == 0.0
    assert got[3].is_faithful and got[3].confidence == 1.0 and got[3].total_claims == 0
    assert not got[4].is_faithful


def test_semantic_verification(spark):
    rows = spark.createDataFrame([(1, "Theft is punished by imprisonment of three years.", CONTEXT)], "i int, response string, context string")
    rows = verify.semantic_scores(rows, HashingEmbedder(64))
    v = verify.verify(rows, 0.5, 0.5, semantic=F.col("semantic")).first().verdicts[0]
    assert 0 < v.semantic_score <= 1 and v.is_supported


def test_metrics(spark):
    rows = spark.createDataFrame([("Part 5 applies here as law.", "Article 5", "which law applies")], "r string, c string, q string")
    got = rows.select(evaluate.citation_accuracy(F.col("r"), F.col("c")), evaluate.relevancy(F.col("r"), F.col("q")), evaluate.faithfulness(F.col("r"), F.col("c")), evaluate.faithfulness(F.col("r"), F.lit(" "))).first()
    assert tuple(got) == (1.0, 1.0, 0.0, 0.0)


def test_retrieval_metrics(spark):
    got = spark.sql("SELECT array(named_struct('article_number', '29', 'law_name', 'L', 'source', cast(null AS string), 'text', 'see Article 7')) AS r").select(
        evaluate.context_precision(F.col("r"), F.array(F.lit("7"))), evaluate.context_recall(F.col("r"), F.array(F.lit("2"), F.lit("5"))),
        evaluate.context_recall(F.col("r"), F.lit(None)), evaluate.context_precision(F.lit(None), F.array(F.lit("7")))).first()
    assert tuple(got) == (1.0, 0.5, 1.0, 0.0)


def test_run_evaluation(spark):
    q = spark.createDataFrame([("1", "How is theft punished?", "simple", "easy", ["461"]), ("2", "Lost?", None, "hard", [])], "id string, query string, category string, difficulty string, expected_articles array<string>")
    truth = spark.createDataFrame([("2", ["9"])], "query_id string, relevant_articles array<string>")
    responses = spark.createDataFrame([("1", "Theft is punished by imprisonment.", [("461", "penal", "f", CONTEXT)], ["x"], None)],
                                      f"id string, answer string, sources {evaluate.RETRIEVED}, flags array<string>, error string")
    scored = evaluate.per_query(q, truth, responses).cache()
    got = {r.id: r for r in scored.collect()}
    assert got["1"].context_precision == 1.0 and got["1"].context_recall == 1.0 and got["2"].failed and got["2"].faithfulness == 0
    groups = {(r.category, r.difficulty): r.n for r in evaluate.by_group(scored).collect()}
    assert groups == {("simple", None): 1, (None, "easy"): 1, (None, None): 1}
    assert evaluate.flagged(scored).count() == 1
    text = evaluate.markdown_report(scored)
    assert "| simple | 1 |" in text and "Recommendations" in text
    assert experiments.evaluate_config(scored).first().faithfulness == 1.0


def test_mean_response_time(spark):
    q = spark.createDataFrame([(i, "How is theft punished?", None, None, None) for i in "123"], "id string, query string, category string, difficulty string, expected_articles array<string>")
    truth = spark.createDataFrame([], "query_id string, relevant_articles array<string>")
    responses = spark.createDataFrame([("1", "Theft.", None, None, None, 1.0), ("2", "Theft.", None, None, None, 2.0), ("3", None, None, None, "lost", 50.0)],
                                      f"id string, answer string, sources {evaluate.RETRIEVED}, flags array<string>, error string, response_time double")
    assert experiments.evaluate_config(evaluate.per_query(q, truth, responses)).first().avg_response_time == 1.5
    assert "avg_response_time" not in experiments.evaluate_config(evaluate.per_query(q, truth, responses.drop("response_time"))).columns


def test_sweeps(spark):
    docs = spark.createDataFrame([(1, "x" * 3000)], "doc_id long, text string")
    table = experiments.run_all({"sizes": experiments.chunk_sizes(docs)})
    assert table.count() == 8 and {r.value for r in table.collect()} == {"256", "512", "1024", "2048"}

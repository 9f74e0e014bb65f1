"""Answer and retrieval metrics, their means and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.arrays import bind, share
from lexloom.operators.verify import terms, words

#: Stop words of two metrics.
STOP_FAITHFULNESS = "this that with from have been were will shall would could should into upon also such than other more most only each".split()
STOP_RELEVANCY = "the and for are was were been have has had will shall can may what how who which this that with from into does".split()
CITATION = r"(?i)(?:Article|Art\.?)\s*\(?(\d+)\)?"
METRICS = ("faithfulness", "relevancy", "context_precision", "context_recall", "citation_accuracy")
GOOD, FAIR = 0.7, 0.4
#: Flagged queries that a report names; it says how many there are.
LISTED = 100
RECOMMENDATIONS = (("faithfulness", 0.7, "ground the prompt in the sources"), ("context_recall", 0.5, "retrieve more, or by two methods"),
                   ("context_precision", 0.5, "rerank what is retrieved"), ("citation_accuracy", 0.8, "ask for citations of the sources alone"))


def exact_mean(c: Column, digits: int = 4) -> Column:
    """Mean of values of ``digits`` decimals, summed as whole numbers: no order of summing changes it."""
    return F.avg(F.round(c * 10**digits).cast("long")) / 10**digits


def rounded_mean(c: Column, digits: int = 4) -> Column:
    return F.round(F.avg(F.round(c * 10**digits).cast("long"))) / 10**digits


def _blank(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit(""))) == ""


def faithfulness(response: Column, context: Column) -> Column:
    """Share of the response's sentences half of whose terms occur in the context; blank texts give 0, no sentence 1."""
    def score(low: Column) -> Column:
        found = F.filter(F.transform(F.split(response, "[.!?]+", -1), T.strip), lambda s: F.length(s) > 15)

        def supported(s: Column) -> Column:
            return bind(terms(s, tuple(STOP_FAITHFULNESS)), lambda t: (F.size(t) == 0) | (F.size(F.filter(t, lambda x: F.contains(low, x))) >= 0.5 * F.size(t)))

        return bind(found, lambda s: share(F.filter(s, supported), s, 1.0))

    return F.when(_blank(response) | _blank(context), F.lit(0.0)).otherwise(F.round(bind(F.lower(context), score), 4))


def relevancy(response: Column, query: Column, similarity: Column | None = None) -> Column:
    """Share of the query's terms among the response's; with ``similarity`` 0.4 of it and 0.6 of that."""
    def score(p: Column) -> Column:
        return share(F.array_intersect(p["q"], p["r"]), p["q"], 0.5)

    both = F.struct(terms(query, tuple(STOP_RELEVANCY), 3).alias("q"), words(response, 3).alias("r"))
    value = bind(both, score)
    if similarity is not None:
        value = 0.4 * value + 0.6 * similarity
    return F.when(_blank(response) | _blank(query), F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4))


def citation_accuracy(response: Column, context: Column) -> Column:
    """Share of the distinct articles cited that the context cites too; 1 without citations."""
    def distinct(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CITATION), F.lit(1)))

    return F.round(bind(F.struct(distinct(response).alias("r"), distinct(context).alias("c")), lambda p: share(F.array_intersect(p["r"], p["c"]), p["r"], 1.0)), 4)


def context_precision(retrieved: Column, relevant: Column) -> Column:
    """Share of retrieved structs (article_number, law_name, source, text) that a relevant identifier matches.

    It matches if it is the article number, or occurs anywhere in the law's name, the source or the text.
    """
    def hit(r: Column, refs: Column) -> Column:
        low = F.struct(F.coalesce(F.trim(r["article_number"]), F.lit("")).alias("a"), F.lower(F.coalesce(r["law_name"], F.lit(""))).alias("l"),
                       F.lower(F.coalesce(r["source"], F.lit(""))).alias("s"), F.lower(F.coalesce(r["text"], F.lit(""))).alias("t"))
        return bind(low, lambda x: F.exists(refs, lambda ref: ((x["a"] != "") & (x["a"] == ref)) | F.contains(x["l"], ref) | F.contains(x["s"], ref) | F.contains(x["t"], ref)))

    refs = F.transform(F.coalesce(relevant, F.array().cast("array<string>")), lambda x: F.lower(T.strip(x)))
    found = F.coalesce(retrieved, F.array().cast(RETRIEVED))
    return bind(refs, lambda refs: F.when((F.size(found) == 0) | (F.size(refs) == 0), F.lit(0.0)).otherwise(F.round(F.size(F.filter(found, lambda r: hit(r, refs))) / F.size(found), 4)))


RETRIEVED = "array<struct<article_number:string,law_name:string,source:string,text:string>>"


def context_recall(retrieved: Column, relevant: Column) -> Column:
    """Share of the distinct relevant identifiers that are, or occur within, an article number that the retrieved chunks have or name."""
    found = F.coalesce(retrieved, F.array().cast(RETRIEVED))
    numbers = F.transform(found, lambda r: F.coalesce(F.trim(r["article_number"]), F.lit("")))
    named = F.flatten(F.transform(found, lambda r: F.regexp_extract_all(F.coalesce(r["text"], F.lit("")), F.lit(r"(?i)Article\s+(\d+)"), F.lit(1))))
    known = F.filter(F.array_union(numbers, named), lambda x: x != "")
    refs = F.array_distinct(F.transform(F.coalesce(relevant, F.array().cast("array<string>")), lambda x: F.lower(T.strip(x))))

    def score(p: Column) -> Column:
        hits = F.filter(p["refs"], lambda ref: F.exists(p["known"], lambda k: F.contains(k, ref)))
        return F.when(F.size(p["refs"]) == 0, F.lit(1.0)).otherwise(F.round(F.size(hits) / F.size(p["refs"]), 4))

    return bind(F.struct(refs.alias("refs"), known.alias("known")), score)


def per_query(queries: DataFrame, truth: DataFrame, responses: DataFrame) -> DataFrame:
    """The five metrics of each query.

    ``queries`` (id, query, category, difficulty, expected_articles), ``truth`` (query_id, relevant_articles) and ``responses`` (id, answer,
    sources as structs, flags, error).  A query's own expected articles come first; a failed or missing response scores 0 throughout.
    A ``response_time`` of the responses is kept.
    """
    rows = queries.join(truth.select(F.col("query_id").alias("id"), "relevant_articles"), "id", "left").join(responses, "id", "left")
    relevant = F.when(F.size("expected_articles") > 0, F.col("expected_articles")).otherwise(F.coalesce("relevant_articles", F.array().cast("array<string>")))
    context = F.array_join(F.transform(F.coalesce("sources", F.array().cast(RETRIEVED)), lambda s: s["text"]), "\n\n")
    values = {"faithfulness": faithfulness(F.col("answer"), context), "relevancy": relevancy(F.col("answer"), F.col("query")),
              "context_precision": context_precision(F.col("sources"), relevant), "context_recall": context_recall(F.col("sources"), relevant),
              "citation_accuracy": citation_accuracy(F.col("answer"), context)}
    failed = F.col("answer").isNull() | F.col("error").isNotNull()
    times = ["response_time"] if "response_time" in responses.columns else []
    return rows.select("id", "query", "category", "difficulty", "flags", failed.alias("failed"), *[F.when(failed, F.lit(0.0)).otherwise(v).alias(k) for k, v in values.items()], *times)


def overall(scored: DataFrame, metrics=METRICS) -> DataFrame:
    return scored.agg(*[F.coalesce(rounded_mean(F.col(m)), F.lit(0.0)).alias(m) for m in metrics], F.count("*").alias("num_queries"))


def by_group(scored: DataFrame, metrics=("faithfulness", "relevancy")) -> DataFrame:
    """Means by category, by difficulty and over all, in one pass; failed rows are left out, missing keys are ``unknown``."""
    rows = scored.where(~F.col("failed")).select(*[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("category", "difficulty")], *metrics)
    sets = rows.groupingSets([[F.col("category")], [F.col("difficulty")], []], "category", "difficulty")
    return sets.agg(F.grouping_id().alias("level"), *[rounded_mean(F.col(m)).alias(m) for m in metrics], F.count("*").alias("n"))


def rating(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= FAIR, "fair").otherwise("poor")


def ratings(means: DataFrame, metrics=METRICS) -> DataFrame:
    """(metric, score, rating) from one row of means."""
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    return means.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, score)").withColumn("rating", rating(F.col("score")))


def flagged(scored: DataFrame) -> DataFrame:
    return scored.where(F.size("flags") > 0)


def baseline_summary(runs: DataFrame) -> DataFrame:
    """Counts of runs (success, confidence, seconds) and means over the successful ones."""
    ok = F.col("success")
    return runs.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), rounded_mean(F.when(ok, F.col("confidence"))).alias("mean_confidence"),
                    rounded_mean(F.when(ok, F.col("seconds"))).alias("mean_seconds"))


def markdown_report(scored: DataFrame, title: str = "Evaluation") -> str:
    """Report of some dozens of lines; only aggregates and flagged queries come to the driver."""
    means = overall(scored).first().asDict()
    out = [f"# {title}", "", f"Queries: {means['num_queries']}", "", "| Metric | Score | Rating |", "|---|---|---|"]
    out += [f"| {r.metric} | {r.score:.4f} | {r.rating} |" for r in ratings(overall(scored)).collect()]
    for level, name in ((1, "category"), (2, "difficulty")):
        out += ["", f"## By {name}", "", f"| {name} | n | faithfulness | relevancy |", "|---|---|---|---|"]
        out += [f"| {r[name]} | {r.n} | {r.faithfulness:.4f} | {r.relevancy:.4f} |" for r in by_group(scored).where(F.col("level") == level).orderBy(name).collect()]
    bad = flagged(scored)
    many = bad.count()
    out += ["", f"## Flagged ({many})", ""] + [f"- {r.id}: {', '.join(r.flags)}" for r in bad.orderBy("id").limit(LISTED).collect()]
    out += [f"- and {many - LISTED} more" for _ in range(many > LISTED)]
    advice = [f"- {m} is low: {what}" for m, least, what in RECOMMENDATIONS if means[m] < least]
    if all(means[m] >= GOOD for m in METRICS):
        advice.append("- all metrics are good")
    return "\n".join([*out, "", "## Recommendations", "", *advice, ""])

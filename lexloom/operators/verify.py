"""Claim verification without a model: everything is computed within the row, so texts are neither copied nor shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import DEFAULTS
from lexloom.functions import text as T
from lexloom.functions.arrays import bind, share

#: Stop words of the claim terms, the conjunctions that start a new claim, what is no claim, reference and number forms.
STOP = ("this that with from have been were will shall would could should into upon also such than other more most only each every some "
        "according under above below between").split()
CONJUNCTIONS = "and|while|whereas|however|but|although|moreover|furthermore"
NO_CLAIM = (r"^(?:hi|hello|hey|dear|thank|please|hope|feel free)", r"disclaimer|not (?:a )?(?:legal|professional) advice",
            r"^(?:I'm|I am|as an? (?:AI|assistant))", r"^(?:sure|of course|certainly|absolutely)", r"\?$")
ARTICLE_REF = r"(?i)(?:Article|Art\.?|المادة)\s*\(?(\d+)\)?"
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:,\d+)*(?:\.\d+)?(?![\p{L}\p{N}_])"
MIN_CLAIM = 15
FAITHFUL = 0.7
LOW_RISK, MEDIUM_RISK = 0.9, 0.6


def words(text: Column, least: int) -> Column:
    """Runs of at least ``least`` ASCII letters that no letter, digit or underscore adjoins, lower-cased, each once."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])[a-zA-Z]{{{least},}}(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def terms(text: Column, stop=tuple(STOP), least: int = 4) -> Column:
    return F.array_except(words(text, least), F.array(*map(F.lit, stop)))


def references(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ARTICLE_REF), F.lit(1))


def claims(response: Column) -> Column:
    """Atomic claims of a response: sentences, cut at conjunctions; greetings, disclaimers, filler, questions and short ones are left out."""
    c = F.regexp_replace(F.coalesce(response, F.lit("")), r"\*\*|__|~~|`{1,3}", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?m)^\s*[-•*]\s+", ""), r"(?m)^\s*\d+[.)]\s+", "")
    parts = F.flatten(F.transform(F.split(c, r"(?<=[.!?])\s+", -1), lambda s: F.split(s, rf"(?i)\s*,\s*(?:{CONJUNCTIONS})\s+", -1)))
    parts = F.transform(parts, lambda s: F.regexp_replace(T.strip(s), r"\.+$", ""))

    def claim(s: Column) -> Column:
        return (F.length(s) > MIN_CLAIM) & ~F.exists(F.array(*[s.rlike("(?i)" + p) for p in NO_CLAIM]), lambda x: x)

    return F.filter(parts, claim)


def keyword_scores(claim: Column, context: Column, lower_context: Column) -> Column:
    """Struct of the article, term and number scores and their mean; article and number scores are null without any in the claim.

    A reference, term or number counts as found wherever it occurs in the context, also within a longer one.
    """
    def inside(found: Column, where: Column) -> Column:
        return F.filter(found, lambda x: F.contains(where, x))

    def score(p: Column) -> Column:
        one = F.when(F.size(p["refs"]) > 0, share(inside(p["refs"], context), p["refs"], 0.0))
        two = share(inside(p["terms"], lower_context), p["terms"], 0.5)
        three = F.when(F.size(p["nums"]) > 0, share(inside(p["nums"], context), p["nums"], 0.0))
        mean = bind(F.array_compact(F.array(one, two, three)), lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))
        return F.struct(one.alias("article"), two.alias("term"), three.alias("number"), mean.alias("keyword"))

    parts = F.struct(references(claim).alias("refs"), terms(claim).alias("terms"), F.array_distinct(F.regexp_extract_all(claim, F.lit(NUMBER), F.lit(0))).alias("nums"))
    return bind(parts, score)


def verify(rows: DataFrame, keyword_weight: float = 1.0, semantic_weight: float = 0.0, threshold: float = DEFAULTS.claim_threshold, semantic: Column | None = None) -> DataFrame:
    """``rows`` (…, response, context) with ``verdicts``, an array with a struct for each claim.

    Without an embedder the keyword score decides alone; else ``semantic`` is an array column with a score for each claim (see
    :func:`semantic_scores`).  A claim is supported if its unrounded score reaches ``threshold``; scores are rounded to four digits after.
    """
    def all_claims(ctx: Column, found: Column) -> Column:
        return bind(F.lower(ctx), lambda low: F.transform(found, lambda c, i: one(c, i, ctx, low)))

    def one(c: Column, i: Column, ctx: Column, low: Column) -> Column:
        meaning = F.lit(0.5) if semantic is None else F.coalesce(F.get(semantic, i), F.lit(0.5))

        def verdict(k: Column) -> Column:
            total = keyword_weight * k["keyword"] + semantic_weight * meaning
            return F.struct(c.alias("claim"), (total >= threshold).alias("is_supported"), F.round(total, 4).alias("confidence"), F.round(k["keyword"], 4).alias("keyword_score"),
                            F.round(meaning, 4).alias("semantic_score"), k["article"].alias("article"), k["term"].alias("term"), k["number"].alias("number"))

        return bind(keyword_scores(c, ctx, low), verdict)

    return rows.withColumn("verdicts", bind(F.coalesce("context", F.lit("")), lambda ctx: bind(claims(F.col("response")), lambda found: all_claims(ctx, found))))


def semantic_scores(rows: DataFrame, embedder) -> DataFrame:
    """``rows`` with ``semantic``: for each claim the largest cosine with a paragraph of the context, at least 0.

    Paragraphs stand between blank lines; without any, lines of over 20 characters count.  Each claim and paragraph is embedded once.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from lexloom.operators.dense import _unit
    from lexloom.session import ship_package

    base = rows.withColumn("__claims", claims(F.col("response")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for found, ctx in zip(b["__claims"].to_pylist(), b["context"].to_pylist(), strict=True):
                parts = [p for p in map(str.strip, (ctx or "").split("\n\n")) if p] or [p for p in map(str.strip, (ctx or "").split("\n")) if len(p) > 20]
                if not found or not parts:
                    out.append([0.5] * len(found or []))
                else:
                    out.append(np.maximum(0.0, (_unit(embedder.embed_texts(found)) @ _unit(embedder.embed_texts(parts)).T).max(1)).tolist())
            keep = [n for n in b.schema.names if n != "__claims"]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in keep), pa.array(out, pa.list_(pa.float64()))], [*keep, "semantic"])

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    ship_package(rows.sparkSession)
    return base.mapInArrow(run, StructType([*rows.schema.fields, StructField("semantic", ArrayType(DoubleType()))]))


def report(verified: DataFrame) -> DataFrame:
    """Verdict on each response of :func:`verify`: is_faithful, confidence, counts, ratio, risk_level, unverified articles and a summary.

    Without claims a response is faithful with confidence 1.  Confidence is the mean of the rounded claim confidences.  Articles are
    compared exactly here, and repeated ones are listed repeatedly.
    """
    n = F.size("verdicts")
    supported = F.size(F.filter("verdicts", lambda v: v["is_supported"]))
    ratio = F.when(n > 0, supported / n).otherwise(F.lit(1.0))
    total = F.aggregate("verdicts", F.lit(0).cast("long"), lambda a, v: a + F.round(v["confidence"] * 10000).cast("long"))
    risk = F.when(F.col("faithfulness_ratio") >= LOW_RISK, "low").when(F.col("faithfulness_ratio") >= MEDIUM_RISK, "medium").otherwise("high")
    unknown = bind(references(F.coalesce("context", F.lit(""))), lambda known: F.filter(references(F.col("response")), lambda r: ~F.array_contains(known, r)))
    rows = verified.withColumns({"total_claims": n.cast("long"), "supported_claims": supported.cast("long"), "faithfulness_ratio": ratio})
    rows = rows.withColumns({"is_faithful": F.col("faithfulness_ratio") >= FAITHFUL, "confidence": F.when(n > 0, F.round(total / n) / 10000).otherwise(F.lit(1.0)),
                             "risk_level": risk, "unverified_articles": unknown})
    return rows.withColumn("summary", F.format_string("%s risk: %d of %d claims supported", "risk_level", "supported_claims", "total_claims"))

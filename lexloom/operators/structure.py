"""Structure of legal texts: headings, articles, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.arrays import totals_before

#: Heading patterns; the second group, if any, is the title.
PATTERNS = {
    "articles": r"(?id)Article\s+(\d+)",
    "chapters": r"(?id)Chapter\s+(\d+|[IVXLC]+)\s*[:.]?\s*(.*)",
    "parts": r"(?id)Part\s+(One|Two|Three|Four|Five|Six|\d+)\s*[:.]?\s*(.*)",
    "sections": r"(?id)Section\s+(\d+)\s*[:.]?\s*(.*)",
}
ARTICLE_HEAD = r"(?i)(?:^|\n)\s*Article\s+(\d+)\s*[:.]?\s*"
MARK = "\x01"


def cut_at(text: Column, pattern: str) -> Column:
    """Pieces of ``text``: what stands before the first match, then a piece from each match on."""
    return F.split(F.regexp_replace(text, f"({pattern})", MARK + "$1"), MARK, -1)


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, number, title, position): every heading-like match, with its 0-based place in the text.

    Places are summed within the row, so nothing is shuffled and repeated rows have their own.
    """
    cuts = [F.struct(F.lit(kind).alias("kind"), cut_at(F.col("text"), pattern).alias("pieces")) for kind, pattern in PATTERNS.items()]
    rows = docs.select("doc_id", F.explode(F.array(*cuts)).alias("x")).where(F.size("x.pieces") > 1)
    at = totals_before(F.transform("x.pieces", lambda p: F.length(p).cast("long")))
    rows = rows.select("doc_id", "x.kind", F.posexplode(F.arrays_zip(F.col("x.pieces").alias("piece"), at.alias("position"))).alias("i", "y")).where("i > 0")
    rows = rows.select("doc_id", "kind", F.col("y.piece").alias("piece"), F.col("y.position").alias("position"))
    number, title = F.lit(None), F.lit("")
    for kind, pattern in PATTERNS.items():
        number = F.when(F.col("kind") == kind, F.regexp_extract("piece", "^" + pattern, 1)).otherwise(number)
        if kind != "articles":
            title = F.when(F.col("kind") == kind, F.trim(F.regexp_extract("piece", "^" + pattern, 2))).otherwise(title)
    return rows.select("doc_id", "kind", number.alias("number"), title.alias("title"), "position")


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, num_articles, num_chapters)."""
    return docs.select("doc_id", *[F.regexp_count("text", F.lit(PATTERNS[k])).cast("long").alias(f"num_{k}") for k in ("articles", "chapters")])


def articles(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, number, body): a row for each article, header included; text before the first is left out."""
    pieces = F.slice(cut_at(F.col("text"), ARTICLE_HEAD), 2, 1 << 30)
    rows = docs.select("doc_id", F.posexplode(pieces).alias("pos", "piece"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("piece", "^" + ARTICLE_HEAD, 1).alias("number"), T.strip(F.col("piece")).alias("body"))


def preprocess(docs: DataFrame, unicode: bool = True) -> DataFrame:
    """Texts cleaned and normalised, with num_articles, num_chapters and the reduction of length in percent."""
    rows = docs.withColumnsRenamed({"text": "raw_text"}).withColumn("text", T.normalize(T.clean(F.col("raw_text"), unicode)))
    return rows.withColumns({
        "num_articles": F.regexp_count("text", F.lit(PATTERNS["articles"])).cast("int"),
        "num_chapters": F.regexp_count("text", F.lit(PATTERNS["chapters"])).cast("int"),
        "reduction": reduction(F.col("raw_text"), F.col("text")),
    }).drop("raw_text")


def reduction(before: Column, after: Column) -> Column:
    """Percent by which a text became shorter; 0 for an empty one."""
    return F.when(F.length(before) > 0, (1 - F.length(after) / F.length(before)) * 100).otherwise(F.lit(0.0))

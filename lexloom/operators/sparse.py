"""Sparse retrieval: Okapi BM25 by postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULTS
from lexloom.functions import text as T
from lexloom.functions.arrays import bind
from lexloom.storage import shared_table

#: BM25 parameters; a negative idf becomes EPSILON times the mean idf of the vocabulary.
K1 = 1.5
B = 0.75
EPSILON = 0.25
DIGITS = 6


def _counted(words: Column) -> Column:
    """(term, tf) of each distinct word, from the ends of its runs in the sorted words."""
    def runs(s: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        return bind(last, lambda ends: F.transform(ends, lambda e, k: F.struct(F.get(s, e - 1).alias("term"), (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, bind(F.array_sort(words), runs)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def postings(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, dl, term, tf): a row for each distinct word of a chunk; dl is the chunk's number of words.

    ``keys`` identify a chunk.  Words are counted within the row, without a shuffle.
    """
    return _rows(chunks, keys, _counted(F.col("w"))).select(*keys, "term", "dl", "tf")


def _rows(chunks: DataFrame, keys: list[str], counted: Column) -> DataFrame:
    rows = chunks.select(*keys, T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    return rows.select(*keys, F.size("w").cast("long").alias("dl"), F.explode(counted).alias("x")).select(*keys, "dl", "x.*")


def index(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`postings` as a written table, sorted by term within files so that a search reads few row groups; a row without a term stands for each chunk.

    Texts are read once; statistics and searches read this table.
    """
    every = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf")))
    return shared_table(_rows(chunks, keys, F.concat(every, _counted(F.col("w")))).sortWithinPartitions("term"), "postings")


def vocabulary(table: DataFrame) -> DataFrame:
    """(term, df, idf, n_chunks, avgdl) of an :func:`index`; only its column of terms, and the lengths of chunks, are read."""
    total = table.where("term IS NULL").agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avgdl"))
    df = table.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(total)).withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf"), "n_chunks", "avgdl")  # one row


def search(chunks: DataFrame, queries: DataFrame, keys: list[str], k: int = DEFAULTS.top_k, table: DataFrame | None = None) -> DataFrame:
    """(query_id, *keys, score, rank) of the ``k`` best chunks for each row of ``queries`` (query_id, query), ties by key.

    ``table`` is the chunks' :func:`index`, made here if not given.  Repeated query words count repeatedly; the ``k`` best are taken before scores
    of zero and below go.  Scores are rounded to six digits before ranking.
    """
    table = index(chunks, keys) if table is None else table
    wanted = queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    terms = wanted.select("term").distinct()
    idf = shared_table(vocabulary(table).join(terms, "term", "left_semi"), "query-terms")
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = table.join(idf, "term").join(wanted, "term").groupBy("query_id", *keys).agg(F.round(F.sum(weight * F.col("times")), DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *keys)
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where((F.col("rank") <= k) & (F.col("score") > 0))

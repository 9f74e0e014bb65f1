"""Document sources: text and PDF files, folders, tables, query files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.schemas import GROUND_TRUTH, TEST_QUERY
from lexloom.session import ship_package

#: File types of a folder, and the laws that file names stand for, in order of matching.
EXTENSIONS = (".txt", ".pdf", ".json", ".csv")
LAWS = {
    "penal_code": "UAE Federal Penal Code (Federal Decree-Law No. 31 of 2021)",
    "labour_law": "UAE Labour Law (Federal Decree-Law No. 33 of 2021)",
    "civil_code": "UAE Civil Code (Federal Law No. 5 of 1985)",
    "cybercrime_law": "UAE Cybercrime Law (Federal Decree-Law No. 34 of 2021)",
    "personal_status_law": "UAE Personal Status Law (Federal Law No. 28 of 2005)",
}


def law_name(file: Column, laws: dict[str, str] | None = None) -> Column:
    """The law whose key occurs in the file's lower-cased stem, first match first; else the stem in title case."""
    laws = LAWS if laws is None else laws
    stem = F.lower(F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", ""))
    title = F.array_join(F.transform(F.regexp_extract_all(F.replace(stem, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")
    out = None
    for key, name in laws.items():
        hit = F.contains(stem, F.lit(key))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return title if out is None else out.otherwise(title)


def document_id(path: Column, index: Column) -> Column:
    """Digest of path and index; ``doc_`` and its first 8 digits are the short label."""
    return F.md5(F.concat_ws(":", path, index.cast("string")))


def short_id(digest: Column, kind: str = "doc") -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(digest, 1, 8))


def decode(content: Column) -> Column:
    """UTF-8, or Latin-1 where that does not decode."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def _documents(files: DataFrame) -> DataFrame:
    rows = files.withColumn("text", F.col("text")).where(T.strip(F.col("text")) != "")
    path = F.regexp_replace("path", "^file:/+", "/")
    digest = document_id(path, F.lit(0))
    empty = F.lit("")
    return rows.select(digest.alias("doc_id"), short_id(digest).alias("label"), "text", F.element_at(F.split(path, "/"), -1).alias("source"), law_name(path).alias("law_name"),
                       empty.alias("article_number"), empty.alias("chapter"), empty.alias("section"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """A document for each file; blank files give none, a missing path is an error."""
    files = spark.read.format("binaryFile").load(path)
    return _documents(files.select("path", decode(F.col("content")).alias("text")))


def pdf_files(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """A document for each PDF: ``pages`` (a function of the file's bytes) gives its pages' texts; empty pages are left out.

    No PDF library is part of this package; pass one's extractor.  A file that it fails on gives no document.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for content in b["content"]:
                try:
                    texts.append("\n\n".join(p.strip() for p in pages(content) if p and p.strip()))
                except Exception:  # noqa: BLE001  a broken file must not end the scan
                    texts.append("")
            yield pd.DataFrame({"path": b["path"], "text": texts})

    ship_package(spark)
    return _documents(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string"))


def directory(spark: SparkSession, path: str, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """Documents of a folder's own files by path order; .json and .csv are read as text; PDFs need ``pages``, else they are left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("ignoreCorruptFiles", "true")
    out = _documents(read.option("pathGlobFilter", "*.{txt,json,csv}").load(path).select("path", decode(F.col("content")).alias("text")))
    if pages is not None:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        if len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*.pdf"))):
            out = out.unionByName(pdf_files(spark, path.rstrip("/") + "/*.pdf", pages))
    return out.orderBy("source")


def table(rows: DataFrame, name: str, index: str | None = None) -> DataFrame:
    """Documents of any table: text is the first non-empty of text, content and article_text; rows without are left out.

    Metadata fall back from law_name to title, article_number to article_no, chapter to chapter_name, section to section_name, by presence of the
    column.  ``index`` names a row-number column; without one, rows are numbered in the order they are read.
    """
    have = set(rows.columns)
    texts = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("text", "content", "article_text") if c in have]
    if not texts:
        return rows.sparkSession.createDataFrame([], "doc_id string, text string, law_name string, article_number string, chapter string, section string")
    number = F.col(index) if index else F.monotonically_increasing_id()
    meta = {a: next((F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (a, b) if c in have), F.lit(""))
            for a, b in (("law_name", "title"), ("article_number", "article_no"), ("chapter", "chapter_name"), ("section", "section_name"))}
    out = rows.select(F.concat(F.lit(f"hf_{name}_"), number.cast("string")).alias("doc_id"), F.coalesce(*texts).alias("text"), *[v.alias(k) for k, v in meta.items()])
    return out.where(T.strip(F.coalesce("text", F.lit(""))) != "")


def test_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEST_QUERY).option("multiLine", True).json(path)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)

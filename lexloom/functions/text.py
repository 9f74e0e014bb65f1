"""Cleaning and normalisation of legal text: Column -> Column."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexloom.functions.arrays import bind
from lexloom.session import ship_package

#: Fixed value: the characters that Unicode-aware stripping removes.
WHITE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"

#: Typographic characters and their plain forms.
TYPOGRAPHIC = {
    "\u2018": "'", "\u2019": "'", "\u201C": '"', "\u201D": '"', "\u2013": "-", "\u2014": "--", "\u2026": "...", "\u00A0": " ", "\u200B": "", "\uFEFF": "",
}

#: Abbreviations that are expanded, in this order.
ABBREVIATIONS = (("Art", "Article"), ("No", "Number"), ("Ch", "Chapter"), ("Sec", "Section"), ("Pt", "Part"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


#: Texts of an Arrow batch that a worker holds as Python strings at once.
TEXTS = 64


@F.arrow_udf(StringType())
def _nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], texts.type)

    for b in batches:
        yield pa.concat_arrays([made(b.slice(a, TEXTS)) for a in range(0, max(1, len(b)), TEXTS)])


def nfkc(c: Column) -> Column:
    """NFKC; Spark has no built-in form, so texts go through Arrow batches; ASCII ones stay behind."""
    ship_package(SparkSession.active())
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, c).otherwise(_nfkc(F.when(~ascii_only, c)))


def plain_typography(c: Column) -> Column:
    one = {k: v for k, v in TYPOGRAPHIC.items() if len(v) == 1}
    gone = [k for k, v in TYPOGRAPHIC.items() if not v]
    c = F.translate(c, "".join(one) + "".join(gone), "".join(one.values()))
    for k, v in TYPOGRAPHIC.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def drop_control(c: Column) -> Column:
    """Without characters of the categories C*, but for newline, tab and carriage return."""
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t\r]]", "")


def tidy_lines(c: Column) -> Column:
    """Lines stripped, runs of spaces and of blank lines collapsed, the whole stripped."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(strip(x), " {2,}", " "))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def clean(c: Column, unicode: bool = True) -> Column:
    """All cleaning steps in order; null and empty give ''."""
    c = F.coalesce(c, F.lit(""))
    return tidy_lines(drop_control(plain_typography(nfkc(c) if unicode else c)))


def expand_abbreviations(c: Column) -> Column:
    """``Art.5`` -> ``Article5`` and so on; an abbreviation stays if its long form already occurs anywhere."""
    def expand(x: Column, short: str, long: str) -> Column:
        stays = F.contains(x, F.lit(long)) | ~F.contains(x, F.lit(f"{short}."))
        return F.when(stays, x).otherwise(F.regexp_replace(x, rf"\b{short}\.\b", long))

    def step(short: str, long: str):
        return lambda x: expand(x, short, long)

    for short, long in ABBREVIATIONS:
        c = bind(c, step(short, long))
    return c


def article_references(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\b(?:art\.?|article)\s*(\d+)", "Article $1")


def currency(c: Column) -> Column:
    """``AED 10,000`` -> ``AED 10000``; a comma right behind the amount goes too."""
    def rewrite(x: Column) -> Column:
        # each match starts at AED or where the last one ended, so an amount of any length is followed comma by comma
        plain = F.regexp_replace(x, r"(AED\s*|\G(?!^))(\d*),", "$1$2")
        return F.when(F.contains(x, F.lit("AED")), F.regexp_replace(plain, r"AED\s*(\d+)", "AED $1")).otherwise(x)

    return bind(c, rewrite)


def range_dashes(c: Column) -> Column:
    return F.regexp_replace(c, r"(\d)\s*-\s*(\d)", "$1-$2")


def normalize(c: Column) -> Column:
    return range_dashes(currency(article_references(expand_abbreviations(c))))


def tokens(c: Column) -> Column:
    """Lower-case words between white space; punctuation stays."""
    return F.filter(F.split(F.lower(c), f"[{WHITE}]+", -1), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Split behind . ! ? before a capital or digit; a first sentence under 20 characters takes the next ones in."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9])", -1), strip), lambda x: x != "")

    def merged(s: Column) -> Column:
        enough = F.filter(F.sequence(F.lit(1), F.least(F.size(s), F.lit(20))), lambda i: F.length(F.array_join(F.slice(s, 1, i), " ")) >= 20)
        n = F.coalesce(F.get(enough, 0), F.size(s))
        rest = F.slice(s, n + 1, F.size(s))
        return F.when(F.size(s) == 0, s).otherwise(F.concat(F.array(F.array_join(F.slice(s, 1, n), " ")), rest))

    return bind(parts, merged)

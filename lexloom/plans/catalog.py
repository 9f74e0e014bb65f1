"""Registered queries of the engine's operators, each over whole tables, with an independent DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULTS
from lexloom.functions import text as T
from lexloom.functions.arrays import cosine
from lexloom.operators import chunking, dense, embedding, evaluate, experiments, fusion, generation, sparse, structure, verify
from lexloom.sources import readers, sinks
from lexloom.storage import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CTE: dict[str, str] = {}
#: Common table expressions that are read several times: without this DuckDB may compute them anew each time.
KEPT = {"wtok", "dtok", "wpost", "dpost", "wraw", "draw"}


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[{WS}]+'), lambda t: t <> '')"


def query(sql: str | None = None, *needs: str):
    """Register a query; ``needs`` are names in CTE that ``sql`` refers to."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = ("WITH RECURSIVE " + ", ".join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({CTE[n]})" for n in needs) + " " if needs else "") + sql
        return f
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))


# Derived inputs: the same expression on both sides.

def legal(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as an article, with parts and chapters between."""
    def line(x, i):
        n = i + 1
        return F.concat(F.when(n == 1, "PART ONE: Opening\n\n").otherwise(""), F.when(n % 10 == 0, F.concat(F.lit("PART "), F.floor(n / 10 + 1).cast("string"), F.lit(": Further\n\n"))).otherwise(""),
                        F.when(n % 5 == 0, F.concat(F.lit("CHAPTER "), F.floor(n / 5).cast("string"), F.lit(": Heading "), F.floor(n / 5).cast("string"), F.lit("\n\n"))).otherwise(""),
                        F.lit("Article "), n.cast("string"), F.lit(":\n"), x)

    return documents(spark, sf).withColumn("text", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n\n"))


CTE["legal"] = r"""SELECT doc_id, lang, source, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, n:
  CASE WHEN n = 1 THEN 'PART ONE: Opening' || chr(10) || chr(10) ELSE '' END || CASE WHEN n % 10 = 0 THEN 'PART ' || (n // 10 + 1) || ': Further' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN n % 5 = 0 THEN 'CHAPTER ' || (n // 5) || ': Heading ' || (n // 5) || chr(10) || chr(10) ELSE '' END || 'Article ' || n || ':' || chr(10) || x), chr(10) || chr(10)) AS text FROM documents"""

NOISE = ((" a ", "   a  "), (" the ", " “the”  "), (" in ", " Art. 5 in "), (" is ", "\x07 Art.7 is​ "), (" of ", " AED 10,000, of… "), (" to ", " 3 - 5 years to "),
         (" de ", " No.9—de "), ("\n", " \n\n\n\n  "))


def noisy(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    for a, b in NOISE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return documents(spark, sf).withColumn("text", c)


def _lit(s: str) -> str:
    return " || ".join(f"chr({ord(x)})" if not (x.isascii() and x.isprintable()) else f"'{x}'" for x in s) or "''"


def _noise() -> str:
    c = "coalesce(text, '')"
    for a, b in NOISE:
        c = f"replace({c}, {_lit(a)}, {_lit(b)})"
    return f"SELECT doc_id, {c} AS text FROM documents"


CTE["noisy"] = _noise()


def _plain_sql(c: str) -> str:
    for k, v in T.TYPOGRAPHIC.items():
        v = v.replace("'", "''")
        c = f"replace({c}, chr({ord(k)}), '{v}')"
    return c


def _control_sql(c: str) -> str:
    return rf"regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}]', '', 'g')"


def _tidy_sql(c: str) -> str:
    lines = f"array_to_string(list_transform(string_split({c}, chr(10)), lambda x: regexp_replace({strip_sql('x')}, ' {{2,}}', ' ', 'g')), chr(10))"
    return strip_sql(f"regexp_replace({lines}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def _abbrev_sql(c: str) -> str:
    for short, long in T.ABBREVIATIONS:
        c = rf"(SELECT CASE WHEN contains(v, '{long}') THEN v ELSE regexp_replace(v, '\b{short}\.\b', '{long}', 'g') END FROM (SELECT {c} AS v))"
    return c


def _ref_sql(c: str) -> str:
    return rf"regexp_replace({c}, '(?i)\b(?:art\.?|article)\s*(\d+)', 'Article \1', 'g')"


def _currency_sql(c: str) -> str:
    for _ in range(4):
        c = rf"regexp_replace({c}, '(AED\s*\d*),', '\1', 'g')"
    return rf"regexp_replace({c}, 'AED\s*(\d+)', 'AED \1', 'g')"


def _dash_sql(c: str) -> str:
    return rf"regexp_replace({c}, '(\d)\s*-\s*(\d)', '\1-\2', 'g')"


def _texts(f):
    return lambda spark, sf: noisy(spark, sf).select("doc_id", f(F.col("text")).alias("text")).withColumn("n", F.length("text").cast("long"))


for _name, _f, _sql in (
    ("clean_typographic", T.plain_typography, _plain_sql), ("clean_control", T.drop_control, _control_sql), ("clean_whitespace", T.tidy_lines, _tidy_sql),
    ("clean_full", T.clean, lambda c: _tidy_sql(_control_sql(_plain_sql(c)))), ("norm_abbrev", T.expand_abbreviations, _abbrev_sql), ("norm_article_ref", T.article_references, _ref_sql),
    ("norm_currency", T.currency, _currency_sql), ("norm_range_dash", T.range_dashes, _dash_sql), ("norm_full", T.normalize, lambda c: _dash_sql(_currency_sql(_ref_sql(_abbrev_sql(c))))),
):
    QUERIES[_name] = _texts(_f)
    ORACLE[_name] = f"WITH n AS ({CTE['noisy']}), c AS (SELECT doc_id, {_sql('text')} AS text FROM n) SELECT doc_id, text, length(text)::BIGINT AS n FROM c"


# Sources.

@query("""SELECT 'hf_corpus_' || doc_id AS doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END, ''), nullif(lang || ' ' || text, '')) AS text, source AS law_name FROM documents""")
def src_coalesce_text(spark, sf):
    rows = documents(spark, sf)
    rows = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"), F.concat_ws(" ", "lang", "text").alias("content"), F.col("source").alias("title"))
    return readers.table(rows, "corpus", "doc_id").select("doc_id", "text", "law_name")


@query("""SELECT file, CASE WHEN contains(s, 'penal_code') THEN 'UAE Federal Penal Code (Federal Decree-Law No. 31 of 2021)' WHEN contains(s, 'labour_law') THEN 'UAE Labour Law (Federal Decree-Law No. 33 of 2021)'
  WHEN contains(s, 'civil_code') THEN 'UAE Civil Code (Federal Law No. 5 of 1985)' WHEN contains(s, 'cybercrime_law') THEN 'UAE Cybercrime Law (Federal Decree-Law No. 34 of 2021)'
  WHEN contains(s, 'personal_status_law') THEN 'UAE Personal Status Law (Federal Law No. 28 of 2005)'
  ELSE array_to_string(list_transform(regexp_extract_all(replace(s, '_', ' '), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '') END AS law_name
  FROM (SELECT file, lower(regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '')) AS s
        FROM (SELECT CASE doc_id % 7 WHEN 0 THEN '/raw/UAE_penal_code.txt' WHEN 1 THEN 'labour_law_2021.txt' WHEN 2 THEN 'a/civil_code.pdf' WHEN 3 THEN 'cybercrime_law.json'
              WHEN 4 THEN 'personal_status_law.csv' WHEN 5 THEN 'x/a-b c_d e2f.v2.txt' ELSE 'data/' || source || '_' || lang || '_notes.txt' END AS file FROM documents))""")
def src_law_name(spark, sf):
    m = F.col("doc_id") % 7
    file = (F.when(m == 0, "/raw/UAE_penal_code.txt").when(m == 1, "labour_law_2021.txt").when(m == 2, "a/civil_code.pdf").when(m == 3, "cybercrime_law.json")
            .when(m == 4, "personal_status_law.csv").when(m == 5, "x/a-b c_d e2f.v2.txt").otherwise(F.concat(F.lit("data/"), "source", F.lit("_"), "lang", F.lit("_notes.txt"))))
    return documents(spark, sf).select(file.alias("file")).withColumn("law_name", readers.law_name(F.col("file")))


@query("SELECT doc_id, md5('/corpus/' || doc_id || '.txt:0') AS digest, 'doc_' || substr(md5('/corpus/' || doc_id || '.txt:0'), 1, 8) AS label FROM documents")
def src_doc_id(spark, sf):
    digest = readers.document_id(F.concat(F.lit("/corpus/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.lit(0))
    return documents(spark, sf).select("doc_id", digest.alias("digest"), readers.short_id(digest).alias("label"))


# Structure.

_ART, _CHA = r"(?i)Article\s+(\d+)", r"(?i)Chapter\s+(\d+|[IVXLC]+)\s*[:.]?\s*(.*)"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_ART}'))::BIGINT AS num_articles, len(regexp_extract_all(text, '{_CHA}'))::BIGINT AS num_chapters FROM legal", "legal")
def structure_counts(spark, sf):
    return structure.counts(legal(spark, sf))


CTE["kinds"] = (rf"SELECT doc_id, 'articles' AS kind, string_split(regexp_replace(text, '({_ART})', chr(1) || '\1', 'g'), chr(1)) AS p FROM legal UNION ALL "
                rf"SELECT doc_id, 'chapters', string_split(regexp_replace(text, '({_CHA})', chr(1) || '\1', 'g'), chr(1)) FROM legal UNION ALL "
                r"SELECT doc_id, 'parts', string_split(regexp_replace(text, '((?i)Part\s+(One|Two|Three|Four|Five|Six|\d+)\s*[:.]?\s*(.*))', chr(1) || '\1', 'g'), chr(1)) FROM legal UNION ALL "
                r"SELECT doc_id, 'sections', string_split(regexp_replace(text, '((?i)Section\s+(\d+)\s*[:.]?\s*(.*))', chr(1) || '\1', 'g'), chr(1)) FROM legal")
CTE["piece"] = "SELECT doc_id, kind, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM kinds"


@query(r"""SELECT doc_id, kind, CASE kind WHEN 'parts' THEN regexp_extract(piece, '(?i)^Part\s+(One|Two|Three|Four|Five|Six|\d+)', 1) ELSE regexp_extract(piece, '(?i)^(?:Article|Chapter|Section)\s+(\d+|[IVXLC]+)', 1) END AS number,
  CASE WHEN kind = 'articles' THEN '' ELSE trim(regexp_extract(piece, '(?i)^\w+\s+\w+\s*[:.]?\s*(.*)', 1)) END AS title, position
  FROM (SELECT *, (sum(length(piece)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS position FROM piece) WHERE i > 1""", "legal", "kinds", "piece")
def structure_positions(spark, sf):
    return structure.positions(legal(spark, sf))


_HEAD = r"(?i)(?:^|\n)\s*Article\s+(\d+)\s*[:.]?\s*"
CTE["seg"] = (rf"SELECT doc_id, unnest(p) AS seg, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '({_HEAD})', chr(1) || '\1', 'g'), chr(1)) AS p FROM legal)")


@query(rf"SELECT doc_id, pos - 1 AS pos, regexp_extract(seg, '{_HEAD}', 1) AS number, {strip_sql('seg')} AS body FROM seg WHERE pos > 0", "legal", "seg")
def extract_articles(spark, sf):
    return structure.articles(legal(spark, sf))


@query(f"SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (1 - length({_tidy_sql(_control_sql(_plain_sql('text')))})::DOUBLE / length(text)) * 100 ELSE 0 END, 4)::DOUBLE AS pct FROM noisy", "noisy")
def length_reduction(spark, sf):
    return noisy(spark, sf).select("doc_id", F.round(structure.reduction(F.col("text"), T.clean(F.col("text"))), 4).alias("pct"))


@query(f"SELECT doc_id, text, len(regexp_extract_all(text, '{_ART}'))::INT AS num_articles FROM (SELECT doc_id, {_dash_sql(_currency_sql(_ref_sql(_abbrev_sql(_tidy_sql(_control_sql(_plain_sql('text')))))))} AS text FROM noisy)", "noisy")
def preprocess(spark, sf):
    return structure.preprocess(noisy(spark, sf)).select("doc_id", "text", "num_articles")


# Chunks.

CTE["win"] = (f"SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::BIGINT AS chunk_index, text FROM (SELECT doc_id, s, {strip_sql('substr(text, s + 1, 512)')} AS text "
              "FROM (SELECT doc_id, text, unnest(range(0, length(text), 462)) AS s FROM documents)) WHERE text <> ''")


@query(rf"SELECT doc_id, chunk_index, md5(doc_id || ':' || chunk_index) AS chunk_id, text, length(text)::BIGINT AS chunk_size, regexp_extract(text, '{_ART}', 1) AS article_number, source FROM win JOIN (SELECT doc_id, source FROM documents) USING (doc_id)", "win")
def chunk_sliding(spark, sf):
    return chunking.sliding(documents(spark, sf))


CTE["whole"] = "SELECT doc_id, 0 AS pos, coalesce(text, '') AS body FROM documents"


def _cut_query(source: str) -> str:
    end = ("CASE WHEN beg + 512 >= n THEN n ELSE beg + length(substr(body, beg + 1, 512)) - instr(reverse(substr(body, beg + 257, 256)), ' .') END")
    return (f"SELECT doc_id, pos, body, n, i, beg, {end} AS stop FROM (SELECT doc_id, pos, body, length(body) AS n, 0 AS i, 0::BIGINT AS beg FROM {source}) WHERE n > 0 "
            f"UNION ALL SELECT doc_id, pos, body, n, i, beg, {end} AS stop FROM (SELECT doc_id, pos, body, n, i + 1 AS i, stop - 50 AS beg FROM cuts WHERE stop < n)")


ORACLE["chunk_long_article"] = f"WITH RECURSIVE whole AS ({CTE['whole']}), cuts AS ({_cut_query('whole')}) SELECT doc_id, i::BIGINT AS sub_index, {strip_sql('substr(body, beg + 1, stop - beg)')} AS text FROM cuts"


def chunk_long_article(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(chunking.long_split(F.col("text"), 512, 50)).alias("sub_index", "text"))
    return rows.withColumn("sub_index", F.col("sub_index").cast("long"))


QUERIES["chunk_long_article"] = chunk_long_article

ORACLE["chunk_article"] = rf"""WITH RECURSIVE legal AS ({CTE['legal']}), seg AS ({CTE['seg']}),
art AS (SELECT doc_id, pos, {strip_sql('seg')} AS body, CASE WHEN pos = 0 THEN 'preamble' ELSE regexp_extract(seg, '{_HEAD}', 1) END AS article_number,
  last_value(CASE WHEN len(regexp_extract_all(seg, '{_CHA}')) > 0 THEN {strip_sql(f"'Chapter ' || regexp_extract_all(seg, '{_CHA}', 1)[-1] || ': ' || regexp_extract_all(seg, '{_CHA}', 2)[-1]")} END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chapter FROM seg),
src AS (SELECT * FROM art WHERE pos > 0 OR length(body) > 50), cuts AS ({_cut_query('src')}),
c AS (SELECT doc_id, pos, i, {strip_sql('substr(body, beg + 1, stop - beg)')} AS text FROM cuts)
SELECT c.doc_id, (row_number() OVER (PARTITION BY c.doc_id ORDER BY c.pos, c.i) - 1)::BIGINT AS chunk_index, c.text, length(c.text)::BIGINT AS chunk_size, article_number, coalesce(chapter, '') AS chapter, source
FROM c JOIN src USING (doc_id, pos) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)"""


def chunk_article(spark, sf):
    return chunking.by_article(legal(spark, sf)).drop("chunk_id")


QUERIES["chunk_article"] = chunk_article

CTE["sent"] = rf"""SELECT doc_id, CASE WHEN len(s) = 0 THEN [] ELSE list_concat([array_to_string(s[1:n], ' ')], s[n + 1:]) END AS s FROM (
  SELECT doc_id, s, coalesce(list_filter(range(1, least(len(s), 20) + 1), lambda i: length(array_to_string(s[1:i], ' ')) >= 20)[1], len(s)) AS n FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS s FROM documents))"""


@query("SELECT doc_id, generate_subscripts(s, 1)::BIGINT - 1 AS pos, unnest(s) AS sentence FROM sent", "sent")
def sentences(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def _level_sql(n: int, separator: str) -> dict[str, str]:
    """Level ``n`` of the recursive splitter: items over 512 characters are cut into the longest stretches of parts that fit, each starting at a part."""
    sep, size = _lit(separator), len(separator)
    return {
        f"parts{n}": f"""SELECT doc_id, key, any_value(text) AS text, list(beg ORDER BY beg) AS begs, list(beg + length(part) ORDER BY beg) AS ends FROM (
          SELECT doc_id, key, text, part, (sum(length(part) + {size}) OVER (PARTITION BY doc_id, key ORDER BY i) - length(part) - {size})::BIGINT AS beg
          FROM (SELECT doc_id, key, text, unnest(string_split(text, {sep})) AS part, generate_subscripts(string_split(text, {sep}), 1) AS i FROM level{n - 1} WHERE length(text) > 512)) WHERE part <> '' GROUP BY doc_id, key""",
        f"cut{n}": f"""SELECT doc_id, key, 1::BIGINT AS i, greatest(1, len(list_filter(ends, lambda e: e <= begs[1] + 512)))::BIGINT AS j FROM parts{n}
          UNION ALL SELECT doc_id, key, c.j + 1 AS i, greatest(c.j + 1, len(list_filter(ends, lambda e: e <= begs[c.j + 1] + 512)))::BIGINT AS j FROM cut{n} c JOIN parts{n} USING (doc_id, key) WHERE c.j < len(ends)""",
        f"level{n}": f"""SELECT doc_id, key, text FROM level{n - 1} WHERE length(text) <= 512
          UNION ALL SELECT doc_id, list_append(key, i), substr(text, begs[i] + 1, ends[j] - begs[i]) FROM cut{n} JOIN parts{n} USING (doc_id, key)""",
    }


CTE["level0"] = "SELECT doc_id, []::BIGINT[] AS key, coalesce(text, '') AS text FROM documents"
_R = ["level0"]
for _n, _separator in enumerate(chunking.SEPARATORS, 1):
    _made = _level_sql(_n, _separator)
    CTE |= _made
    _R += _made
    KEPT |= {f"parts{_n}", f"level{_n}"}


@query(rf"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1)::BIGINT AS chunk_index, text, length(text)::BIGINT AS chunk_size, regexp_extract(text, '{_ART}', 1) AS article_number, source
  FROM (SELECT doc_id, key, {strip_sql('text')} AS text FROM (SELECT doc_id, key, text FROM level4 WHERE length(text) <= 512 UNION ALL
    SELECT doc_id, list_append(key, s), substr(text, s + 1, 512) FROM (SELECT doc_id, key, text, unnest(range(0, length(text), 462)) AS s FROM level4 WHERE length(text) > 512) WHERE s = 0 OR s + 50 < length(text)))
  JOIN (SELECT doc_id, source FROM documents) USING (doc_id) WHERE text <> ''""", *_R)
def chunk_recursive(spark, sf):
    return chunking.recursive(documents(spark, sf)).drop("chunk_id")


def _sentences_sql(rows: str, keys: str, text: str) -> str:
    return CTE["sent"].replace("SELECT doc_id,", f"SELECT {keys},").replace("regexp_replace(text,", f"regexp_replace({text},").replace("FROM documents", f"FROM {rows}")


def _offsets_sql(rows: str, keys: str, parts: str) -> str:
    """(keys, parts, begs, ends): where each part stands in the join of all by one character."""
    return f"""SELECT {keys}, list(part ORDER BY i) AS parts, list(beg ORDER BY i) AS begs, list(beg + length(part) ORDER BY i) AS ends FROM (
      SELECT {keys}, part, i, (sum(length(part) + 1) OVER (PARTITION BY {keys} ORDER BY i) - length(part) - 1)::BIGINT AS beg
      FROM (SELECT {keys}, unnest({parts}) AS part, generate_subscripts({parts}, 1) AS i FROM {rows})) GROUP BY {keys}"""


def _runs_sql(name: str, rows: str, keys: str, last: str) -> str:
    """Runs i to j of parts, one after the other; ``last`` gives j from {i}."""
    return f"""SELECT {keys}, 1::BIGINT AS i, {last.format(i="1")} AS j FROM {rows}
      UNION ALL SELECT {keys}, c.j + 1 AS i, {last.format(i="(c.j + 1)")} AS j FROM {name} c JOIN {rows} USING ({keys}) WHERE c.j < len(ends)"""


def _packed_sql(limit: int) -> str:
    return f"greatest({{i}}, len(list_filter(ends, lambda e: e <= begs[{{i}}] + {limit})))::BIGINT"


CTE["sword"] = f"SELECT doc_id, i, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, i, unnest({tokens_sql('x')}) AS w FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM sent)) GROUP BY ALL"
CTE["snorm"] = "SELECT doc_id, i, sqrt(sum(n * n)) AS norm FROM sword GROUP BY ALL"
CTE["scos"] = "SELECT b.doc_id, b.i, round(sum(a.n * b.n) / (any_value(x.norm) * any_value(y.norm)), 9) AS c FROM sword a JOIN sword b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.bucket = b.bucket JOIN snorm x ON x.doc_id = a.doc_id AND x.i = a.i JOIN snorm y ON y.doc_id = b.doc_id AND y.i = b.i GROUP BY ALL"
CTE["sgroup"] = f"""SELECT doc_id, list(g ORDER BY grp) AS gs FROM (SELECT doc_id, grp, string_agg(x, ' ' ORDER BY i) AS g FROM (
  SELECT doc_id, i, x, count(*) FILTER (i > 1 AND coalesce(c, 0) < {DEFAULTS.semantic_threshold}) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM sent) LEFT JOIN scos USING (doc_id, i)) GROUP BY ALL) GROUP BY doc_id"""
CTE["soff"] = _offsets_sql("sgroup", "doc_id", "gs")
CTE["srun"] = _runs_sql("srun", "soff", "doc_id", f"least(len(ends), len(list_filter(ends, lambda e: e < begs[{{i}}] + {DEFAULTS.semantic_min_chunk})) + 1)::BIGINT")
CTE["smerged"] = f"""SELECT doc_id, first AS key, array_to_string(parts[first:stop], ' ') AS chunk FROM (SELECT doc_id, min(i) AS first, max(j) AS stop FROM (
  SELECT doc_id, i, j, n - (n > 1 AND n = count(*) OVER (PARTITION BY doc_id) AND len(list_filter(ends, lambda e: e >= begs[i] + {DEFAULTS.semantic_min_chunk})) = 0)::INT AS grp
  FROM (SELECT doc_id, i, j, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM srun) JOIN soff USING (doc_id)) GROUP BY doc_id, grp) JOIN soff USING (doc_id)"""
CTE["slarge"] = f"SELECT * FROM smerged WHERE length(chunk) > {DEFAULTS.semantic_max_chunk}"
CTE["slsent"] = _sentences_sql("slarge", "doc_id, key", "chunk")
CTE["sloff"] = _offsets_sql("slsent", "doc_id, key", "s")
CTE["slrun"] = _runs_sql("slrun", "sloff", "doc_id, key", _packed_sql(DEFAULTS.semantic_max_chunk))
KEPT |= {"sent", "sword", "soff", "smerged", "sloff"}
_SEM = ("sent", "sword", "snorm", "scos", "sgroup", "soff", "srun", "smerged", "slarge", "slsent", "sloff", "slrun")


@query(f"""SELECT doc_id, chunk_index, text, 'sem_' || left(md5(text), 8) || '_' || printf('%03d', chunk_index) AS label, md5(doc_id || ':' || chunk_index) AS chunk_id, length(text)::BIGINT AS chunk_size, source FROM (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY key, sub) - 1)::BIGINT AS chunk_index, text FROM (SELECT doc_id, key, 0 AS sub, chunk AS text FROM smerged WHERE length(chunk) <= {DEFAULTS.semantic_max_chunk}
    UNION ALL SELECT doc_id, key, i, {strip_sql("array_to_string(parts[i:j], ' ')")} FROM slrun JOIN sloff USING (doc_id, key)) WHERE text <> '') JOIN (SELECT doc_id, source FROM documents) USING (doc_id)""", *_SEM)
def chunk_semantic(spark, sf):
    return chunking.semantic(documents(spark, sf))


CTE["line"] = f"SELECT doc_id, {strip_sql('unnest(l)')} AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM legal)"
CTE["head"] = r"""SELECT *, CASE WHEN length(line) < 100 AND regexp_matches(line, '(?i)^part\s+(one|two|three|four|five|six|\d+|[ivxlc]+)\b') THEN 'part'
  WHEN length(line) < 100 AND regexp_matches(line, '(?i)^chapter\s+(\d+|[ivxlc]+)\b') THEN 'chapter' WHEN length(line) < 100 AND regexp_matches(line, '(?i)^section\s+(\d+|[ivxlc]+)\b') THEN 'section'
  WHEN length(line) < 150 AND regexp_matches(line, '(?i)^article\s*\(?(\d+)\)?') THEN 'article' END AS type FROM line"""
CTE["run"] = "SELECT *, count(type) OVER (PARTITION BY doc_id ORDER BY i) AS e, count(*) FILTER (type = 'part') OVER (PARTITION BY doc_id ORDER BY i) AS part_run FROM head"
CTE["elem"] = r"""SELECT doc_id, e, part_run, any_value(type) FILTER (type IS NOT NULL) AS type, any_value(line) FILTER (type IS NOT NULL) AS title,
  coalesce(string_agg(line || chr(10), '' ORDER BY i) FILTER (type IS NULL), '') AS body FROM run WHERE e > 0 GROUP BY doc_id, e, part_run"""


@query(r"""SELECT doc_id, e - 1 AS pos, type, title, body, coalesce('Part ' || regexp_extract(last_value(CASE WHEN type = 'part' THEN title END IGNORE NULLS) OVER w, '(?i)^part\s+(\w+)', 1), '') AS part,
  coalesce('Chapter ' || regexp_extract(last_value(CASE WHEN type = 'chapter' THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, part_run ORDER BY e), '(?i)^chapter\s+(\w+)', 1), '') AS chapter
  FROM elem WINDOW w AS (PARTITION BY doc_id ORDER BY e)""", "legal", "line", "head", "run", "elem")
def hierarchy_elements(spark, sf):
    import pyarrow as pa

    def make(text, _):
        return [{"pos": i, **{k: e[k] for k in ("type", "title", "body", "part", "chapter")}} for i, e in enumerate(chunking.elements(text))]

    return chunking._per_text(legal(spark, sf).select("doc_id", "text"), make, [("pos", pa.int64(), "long"), *((n, pa.string(), "string") for n in ("type", "title", "body", "part", "chapter"))])


CTE["hfull"] = rf"""SELECT *, {strip_sql("title || chr(10) || body")} AS text, CASE WHEN type = 'article' THEN regexp_extract(title, '(?i)^article\s*\(?(\d+)', 1) ELSE '' END AS num FROM (
  SELECT doc_id, e AS pos, type, title, body, coalesce('Part ' || regexp_extract(last_value(CASE WHEN type = 'part' THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY e), '(?i)^part\s+(\w+)', 1), '') AS part,
    coalesce('Chapter ' || regexp_extract(last_value(CASE WHEN type = 'chapter' THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id, part_run ORDER BY e), '(?i)^chapter\s+(\w+)', 1), '') AS chapter FROM elem)"""
CTE["hlong"] = rf"""SELECT doc_id, pos, text, string_split(regexp_replace(text, '\n(\d+[.)]\s|\([a-z]\)\s)', chr(1) || '\1', 'g'), chr(1)) AS c FROM hfull WHERE type = 'article' AND length(text) > {DEFAULTS.hierarchical_max_chunk}"""
CTE["hsent"] = _sentences_sql("hlong", "doc_id, pos", "text")
CTE["hparts"] = "SELECT doc_id, pos, CASE WHEN len(c) > 1 THEN c ELSE s END AS p, CASE WHEN len(c) > 1 THEN chr(10) ELSE ' ' END AS glue FROM hlong JOIN hsent USING (doc_id, pos)"
CTE["hoff"] = _offsets_sql("hparts", "doc_id, pos", "p")
CTE["hrun"] = _runs_sql("hrun", "hoff", "doc_id, pos", _packed_sql(DEFAULTS.hierarchical_max_chunk))
_JOINED = "CASE WHEN glue = ' ' THEN array_to_string(parts[i:j], ' ') ELSE array_to_string(parts[i:j], chr(10)) END"
CTE["hpiece"] = f"SELECT doc_id, pos, i, {strip_sql(_JOINED)} AS text FROM hrun JOIN hoff USING (doc_id, pos) JOIN hparts USING (doc_id, pos)"
CTE["hchunk"] = f"""SELECT doc_id, pos, 0 AS i, CASE WHEN type = 'article' THEN text ELSE text[:{DEFAULTS.hierarchical_max_chunk}] END AS text FROM hfull WHERE length(text) >= 10 AND NOT (type = 'article' AND length(text) > {DEFAULTS.hierarchical_max_chunk})
  UNION ALL SELECT * FROM hpiece WHERE text <> ''"""
CTE["hnum"] = """SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) - 1)::BIGINT AS chunk_index, count(*) OVER (PARTITION BY doc_id, pos) AS n, (row_number() OVER (PARTITION BY doc_id, pos ORDER BY i) - 1)::BIGINT AS sub FROM hchunk"""
KEPT |= {"elem", "hfull", "hparts", "hoff"}
_H = ("legal", "line", "head", "run", "elem", "hfull", "hlong", "hsent", "hparts", "hoff", "hrun", "hpiece", "hchunk", "hnum")


@query("""SELECT h.doc_id, chunk_index, h.text, 'hier_' || CASE WHEN type = 'article' THEN 'art' || num ELSE type END || '_' || printf('%04d', chunk_index) AS label, type AS hierarchy_level,
  array_to_string(list_filter([part, chapter, CASE WHEN num <> '' THEN 'Article ' || num ELSE '' END], lambda x: x <> ''), ' > ') AS hierarchy_path, part AS parent_part, chapter AS parent_chapter, '' AS parent_section,
  num AS article_number, CASE WHEN n > 1 THEN sub ELSE -1 END::BIGINT AS sub_chunk_index, md5(h.doc_id || ':' || chunk_index) AS chunk_id, length(h.text)::BIGINT AS chunk_size, source, source AS law_name
  FROM hnum h JOIN hfull f ON f.doc_id = h.doc_id AND f.pos = h.pos JOIN (SELECT doc_id, source FROM documents) d ON d.doc_id = h.doc_id""", *_H)
def chunk_hierarchical(spark, sf):
    return chunking.hierarchical(legal(spark, sf).withColumn("law_name", F.col("source")))


@query("SELECT count(*)::BIGINT AS n, avg(length(text)) AS avg_size, min(length(text))::BIGINT AS min_size, max(length(text))::BIGINT AS max_size FROM win", "win")
def chunk_stats(spark, sf):
    return chunking.stats(chunking.sliding(documents(spark, sf)))


@query("""SELECT label, vec_id, round(sim, 6) AS sim, coalesce(round(sim, 6) < 0.5, false) AS is_break, (count(*) FILTER (round(sim, 6) < 0.5) OVER (PARTITION BY label ORDER BY vec_id))::BIGINT AS group_id
  FROM (SELECT label::BIGINT AS label, vec_id, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS sim FROM embeddings)""")
def chunk_semantic_breaks(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.col("embedding").alias("b")).withColumn("a", F.lag("b").over(w))
    rows = rows.withColumn("sim", F.when(F.col("a").isNotNull(), F.round(cosine(F.col("a"), F.col("b")), 6)))
    rows = rows.withColumn("is_break", F.coalesce(F.col("sim") < 0.5, F.lit(False)))
    return rows.withColumn("group_id", F.sum(F.col("is_break").cast("long")).over(w)).select("label", "vec_id", "sim", "is_break", "group_id")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"), (F.col("vec_id") + 1).alias("b")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "b").select("a", "b", F.round(cosine(F.col("x"), F.col("y")), 6).alias("cos"))


# Embedding and retrieval.

@query(f"""SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM documents) GROUP BY ALL)""")
def embed_hash(spark, sf):
    rows = embedding.embed(documents(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").select("doc_id", F.col("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))


@query(f"""SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM (
  SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS bucket, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM documents) GROUP BY ALL)""")
def embed_hash_terms(spark, sf):
    return embedding.hashed_terms(documents(spark, sf)).withColumn("value", F.round("value", 6))


def vector_queries(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


CTE["sims"] = "SELECT q.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings b WHERE q.vec_id % 20 = 0"
CTE["near"] = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims"


@query("SELECT query_id, vec_id, score, rank FROM near WHERE rank <= 5", "sims", "near")
def knn_topk(spark, sf):
    return dense.knn(table(spark, sf, "embeddings"), vector_queries(spark, sf))


@query("SELECT query_id, vec_id, round(score, 4) AS score, rank FROM near WHERE rank <= 5 AND score >= 0.3", "sims", "near")
def dense_retrieve(spark, sf):
    return dense.retrieve(table(spark, sf, "embeddings"), vector_queries(spark, sf))


@query("SELECT 'legal_docs' AS collection_name, count(*)::BIGINT AS total_chunks FROM win", "win")
def collection_stats(spark, sf):
    return dense.collection_stats(chunking.sliding(documents(spark, sf)))


def text_queries(spark, sf):
    return table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


CTE["wtok"] = f"SELECT doc_id, chunk_index, {tokens_sql('text')} AS w FROM win"
CTE["dtok"] = f"SELECT doc_id, 0::BIGINT AS chunk_index, {tokens_sql('text')} AS w FROM documents"
CTE["qterm"] = f"SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL"


def _bm25(tok: str, p: str) -> dict[str, str]:
    return {
        f"{p}post": f"SELECT doc_id, chunk_index, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, w, unnest(w) AS term FROM {tok}) GROUP BY ALL",
        f"{p}stat": f"SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {tok}",
        f"{p}raw": f"SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM {p}post GROUP BY term), {p}stat",
        f"{p}idf": f"SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM {p}raw, (SELECT avg(raw) AS mean FROM {p}raw)",
        f"{p}bm": f"SELECT query_id, doc_id, chunk_index, round(sum(idf * times * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {p}post JOIN {p}idf USING (term) JOIN qterm USING (term), {p}stat GROUP BY ALL",
        f"{p}top": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM {p}bm",
    }


CTE |= _bm25("wtok", "w") | _bm25("dtok", "d")
_W = ("win", "wtok", "qterm", "wpost", "wstat", "wraw", "widf", "wbm", "wtop")
_D = ("dtok", "qterm", "dpost", "dstat", "draw", "didf", "dbm", "dtop")


@query("SELECT doc_id, chunk_index, term, dl::BIGINT AS dl, tf::BIGINT AS tf FROM wpost", "win", "wtok", "wpost")
def bm25_postings(spark, sf):
    return sparse.postings(chunking.sliding(documents(spark, sf)), ["doc_id", "chunk_index"])


@query("SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM widf", "win", "wtok", "wpost", "wstat", "wraw", "widf")
def bm25_idf(spark, sf):
    return sparse.vocabulary(sparse.index(chunking.sliding(documents(spark, sf)), ["doc_id", "chunk_index"])).select("term", "df", F.round("idf", 6).alias("idf"))


def windows_top(spark, sf, k=5):
    return sparse.search(chunking.sliding(documents(spark, sf)), text_queries(spark, sf), ["doc_id", "chunk_index"], k)


@query("SELECT query_id, doc_id, chunk_index, score, rank FROM wtop WHERE rank <= 5 AND score > 0", *_W)
def bm25_topk(spark, sf):
    return windows_top(spark, sf)


def document_lists(spark, sf, k):
    """Dense and sparse lists of documents for the queries that both tables have: vectors stand for the documents of the same number."""
    both = text_queries(spark, sf).join(vector_queries(spark, sf), "query_id")
    near = dense.retrieve(table(spark, sf, "embeddings"), both, k).withColumnRenamed("vec_id", "doc_id")
    return near, sparse.search(documents(spark, sf), both.select("query_id", "query"), ["doc_id"], k)


CTE["shared"] = "SELECT item_id AS query_id FROM benchmark WHERE item_id % 20 = 0 AND item_id IN (SELECT vec_id FROM embeddings)"
CTE["lists"] = ("SELECT query_id, vec_id AS doc_id, rank, 0.6 AS w FROM near WHERE rank <= 10 AND score >= 0.3 AND query_id IN (SELECT query_id FROM shared) UNION ALL "
                "SELECT query_id, doc_id, rank, 0.4 FROM dtop WHERE rank <= 10 AND score > 0 AND query_id IN (SELECT query_id FROM shared)")
CTE["fused"] = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(w::DOUBLE / (60 + rank)), 8) AS score FROM lists GROUP BY ALL)"
_F = ("sims", "near", *_D, "shared", "lists", "fused")


@query("SELECT * FROM fused", *_F)
def rrf_fusion(spark, sf):
    return fusion.reciprocal_rank(*document_lists(spark, sf, 10), "doc_id")


@query("SELECT * FROM fused WHERE rank <= 5", *_F)
def hybrid_retrieve(spark, sf):
    return fusion.reciprocal_rank(*document_lists(spark, sf, 10), "doc_id", top=5)


def candidates(spark, sf, k=10):
    docs = documents(spark, sf)
    found = sparse.search(docs, text_queries(spark, sf), ["doc_id"], k)
    return found.join(docs.select("doc_id", "text", "source"), "doc_id").join(text_queries(spark, sf), "query_id")


CTE["cand"] = "SELECT t.query_id, t.doc_id, t.score, t.rank, b.text AS query, d.text, d.source FROM dtop t JOIN benchmark b ON b.item_id = t.query_id JOIN documents d USING (doc_id) WHERE t.rank <= 10 AND t.score > 0"


@query(f"""SELECT query_id, doc_id, score AS original_score, round(1 / (1 + exp(-(4 * len(list_intersect(q, t))::DOUBLE / len(q) - 2))), 6) AS reranker_score, true AS reranked,
  row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-(4 * len(list_intersect(q, t))::DOUBLE / len(q) - 2))), 6) DESC, doc_id) AS rank
  FROM (SELECT * EXCLUDE (rank), list_distinct({tokens_sql('query')}) AS q, list_distinct({tokens_sql('text')}) AS t FROM cand) QUALIFY rank <= 5""", *_D, "cand")
def rerank_lexical(spark, sf):
    return fusion.rerank(candidates(spark, sf), key="doc_id")


# Generation.

def _sources(spark, sf):
    rows = candidates(spark, sf, 3)
    law = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Law of "), "source"))
    number = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 50).cast("string"))
    return rows.withColumns({"law_name": law, "article_number": number})


CTE["ctx"] = """SELECT query_id, any_value(query) AS query, string_agg('[Source ' || rank || '] ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN 'Law of ' || source END, source, 'Unknown') || ' – Article '
  || coalesce(CASE WHEN doc_id % 3 > 0 THEN (doc_id % 50)::VARCHAR END, 'N/A') || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM cand WHERE rank <= 3 GROUP BY query_id"""


@query("SELECT query_id, context FROM ctx", *_D, "cand", "ctx")
def context_format(spark, sf):
    return generation.context(_sources(spark, sf))


def _prompt_sql() -> str:
    return "'" + generation.PROMPTS["default"].replace("'", "''").replace("\n", "' || chr(10) || '").replace("{context}", "' || context || '").replace("{question}", "' || query || '") + "'"


@query(f"SELECT query_id, {_prompt_sql()} AS prompt FROM ctx", *_D, "cand", "ctx")
def prompt_build(spark, sf):
    rows = generation.context(_sources(spark, sf)).join(text_queries(spark, sf), "query_id")
    return rows.select("query_id", generation.prompt(F.col("context"), F.col("query")).alias("prompt"))


REPLIES = ((1, '["a", "b c"]'), (2, '```json\n["x"]\n```'), (3, '{"a": 1}'), (4, "no json"), (5, ""), (6, "[]"), (7, '  ["late"]  '))


@query("SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT, 'a|b c'), (2, 1, 'x'), (3, 0, ''), (4, 0, ''), (5, 0, ''), (6, 0, ''), (7, 1, 'late')) t(id, n_flags, joined)")
def flags_parse(spark, sf):
    rows = spark.createDataFrame(list(REPLIES), "id long, raw string").withColumn("flags", generation.parse_flags(F.col("raw")))
    return rows.select("id", F.size("flags").cast("long").alias("n_flags"), F.array_join("flags", "|").alias("joined"))


@query("""SELECT query_id, round(least(1, greatest(0, avg(round(score * 10000)::BIGINT) / 10000)) * CASE WHEN query_id % 40 = 0 THEN 0.7 ELSE 1 END, 4)::DOUBLE AS confidence, count(*)::BIGINT AS source_count
  FROM near WHERE rank <= 5 AND score >= 0.3 GROUP BY query_id""", "sims", "near")
def rag_confidence(spark, sf):
    rows = dense_retrieve(spark, sf).groupBy("query_id").agg(evaluate.exact_mean(F.col("score")).alias("m"), F.count("*").alias("source_count"))
    return rows.select("query_id", generation.confidence(F.col("m"), F.col("query_id") % 40 == 0).alias("confidence"), "source_count")


CTE["csent"] = CTE["sent"].replace("SELECT doc_id, CASE", "SELECT query_id, rank, query, CASE").replace("SELECT doc_id, s, coalesce", "SELECT query_id, rank, query, s, coalesce").replace(
    "SELECT doc_id, list_filter", "SELECT query_id, rank, query, list_filter").replace("FROM documents", "FROM cand WHERE rank <= 3")


@query(f"""SELECT query_id, sentence AS answer, overlap FROM (SELECT query_id, rank, pos, sentence, len(list_intersect(list_distinct({tokens_sql('query')}), list_distinct({tokens_sql('sentence')})))::BIGINT AS overlap
  FROM (SELECT query_id, rank, query, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM csent)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, pos) = 1""", *_D, "cand", "csent")
def rag_extractive(spark, sf):
    return generation.extractive_answers(_sources(spark, sf))


# Verification and metrics: user turn, the assistant's next turn, and the document of the conversation's number as context.

def pairs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumns({"response": F.lead("text").over(w), "next": F.lead("role").over(w)})
    rows = rows.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", F.col("text").alias("query"), "response")
    return rows.join(documents(spark, sf).select(F.col("doc_id").alias("conv_id"), F.col("text").alias("context"), "lang", "source"), "conv_id")


CTE["pair"] = """SELECT p.conv_id, turn, query, response, d.text AS context, lang, source FROM (SELECT conv_id, turn, role, text AS query, lead(text) OVER w AS response, lead(role) OVER w AS nxt
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) p JOIN documents d ON d.doc_id = p.conv_id WHERE role = 'user' AND nxt = 'assistant'"""


def _ascii_sql(x: str) -> str:
    return rf"regexp_replace({x}, '[\p{{L}}\p{{N}}_]*[^\x00-\x7F][\p{{L}}\p{{N}}_]*', ' ', 'g')"


def _words_sql(x: str, least: int) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({_ascii_sql(x)}, '\b[a-zA-Z]{{{least},}}\b'), lambda t: lower(t)))"


def _terms_sql(x: str, stop, least: int = 4) -> str:
    return f"list_filter({_words_sql(x, least)}, lambda t: NOT list_contains([{', '.join(repr(s) for s in stop)}], t))"


_NO = " OR ".join("regexp_matches(c, '(?i){}')".format(p.replace("'", "''")) for p in verify.NO_CLAIM)
CTE["claimlist"] = rf"""SELECT *, list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(response,
  '\*\*|__|~~|`{{1,3}}', '', 'g'), '(?m)^\s*[-•*]\s+', '', 'g'), '(?m)^\s*\d+[.)]\s+', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda s: regexp_split_to_array(s, '(?i)\s*,\s*(?:{verify.CONJUNCTIONS})\s+'))), lambda s: regexp_replace({strip_sql('s')}, '\.+$', '')), lambda c: length(c) > 15 AND NOT ({_NO})) AS claims FROM pair"""
CTE["claim"] = "SELECT conv_id, turn, context, response, unnest(claims) AS claim, generate_subscripts(claims, 1)::BIGINT - 1 AS pos FROM claimlist"
CTE["parts"] = rf"""SELECT *, regexp_extract_all(claim, '(?i)(?:Article|Art\.?|المادة)\s*\(?(\d+)\)?', 1) AS refs, {_terms_sql('claim', verify.STOP)} AS terms,
  list_distinct(regexp_extract_all({_ascii_sql('claim')}, '\b\d+(?:,\d+)*(?:\.\d+)?\b')) AS nums FROM claim"""
CTE["scored"] = """SELECT *, CASE WHEN len(refs) > 0 THEN len(list_filter(refs, lambda x: contains(context, x)))::DOUBLE / len(refs) END AS article,
  CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda x: contains(lower(context), x)))::DOUBLE / len(terms) ELSE 0.5 END AS term,
  CASE WHEN len(nums) > 0 THEN len(list_filter(nums, lambda x: contains(context, x)))::DOUBLE / len(nums) END AS number FROM parts"""
CTE["verdict"] = "SELECT *, (coalesce(article, 0) + term + coalesce(number, 0)) / (1 + (article IS NOT NULL)::INT + (number IS NOT NULL)::INT) AS keyword FROM scored"
_V = ("pair", "claimlist", "claim", "parts", "scored", "verdict")


def verified(spark, sf):
    return verify.verify(pairs(spark, sf))


def verdicts(spark, sf):
    rows = verified(spark, sf).select("conv_id", "turn", F.posexplode("verdicts").alias("pos", "v"))
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "v.*")


@query("SELECT conv_id, turn, pos, claim FROM claim", "pair", "claimlist", "claim")
def claims(spark, sf):
    rows = pairs(spark, sf).select("conv_id", "turn", F.posexplode(verify.claims(F.col("response"))).alias("pos", "claim"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def _part_score(name: str, part: str) -> None:
    def run(spark, sf):
        return verdicts(spark, sf).select("conv_id", "turn", "pos", F.round(part, 6).alias("score"))

    run.__name__ = name
    query(f"SELECT conv_id, turn, pos, round({part}, 6) AS score FROM scored", *_V[:-1])(run)


for _name, _part in (("claim_article_score", "article"), ("claim_term_score", "term"), ("claim_number_score", "number")):
    _part_score(_name, _part)


@query("SELECT conv_id, turn, pos, claim, keyword >= 0.4 AS is_supported, round(keyword, 4) AS confidence, round(keyword, 4) AS keyword_score FROM verdict", *_V)
def claim_verify(spark, sf):
    return verdicts(spark, sf).select("conv_id", "turn", "pos", "claim", "is_supported", "confidence", "keyword_score")


CTE["faith"] = """SELECT p.conv_id, p.turn, p.response, p.context, count(v.claim)::BIGINT AS total_claims, (count(*) FILTER (v.keyword >= 0.4))::BIGINT AS supported_claims,
  CASE WHEN count(v.claim) > 0 THEN (count(*) FILTER (v.keyword >= 0.4))::DOUBLE / count(v.claim) ELSE 1 END AS ratio, coalesce(round(avg(round(v.keyword * 10000)::BIGINT)) / 10000, 1)::DOUBLE AS confidence
  FROM pair p LEFT JOIN verdict v USING (conv_id, turn) GROUP BY ALL"""


@query("SELECT conv_id, turn, ratio >= 0.7 AS is_faithful, confidence, total_claims, supported_claims FROM faith", *_V, "faith")
def faithfulness_check(spark, sf):
    return verify.report(verified(spark, sf)).select("conv_id", "turn", "is_faithful", "confidence", "total_claims", "supported_claims")


@query(r"""SELECT conv_id, turn, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.9 THEN 'low' WHEN ratio >= 0.6 THEN 'medium' ELSE 'high' END AS risk_level,
  len(list_filter(regexp_extract_all(response, '(?i)(?:Article|Art\.?|المادة)\s*\(?(\d+)\)?', 1), lambda x: NOT list_contains(regexp_extract_all(context, '(?i)(?:Article|Art\.?|المادة)\s*\(?(\d+)\)?', 1), x)))::BIGINT AS n_unverified,
  CASE WHEN ratio >= 0.9 THEN 'low' WHEN ratio >= 0.6 THEN 'medium' ELSE 'high' END || ' risk: ' || supported_claims || ' of ' || total_claims || ' claims supported' AS summary FROM faith""", *_V, "faith")
def hallucination_report(spark, sf):
    rows = verify.report(verified(spark, sf))
    return rows.select("conv_id", "turn", F.round("faithfulness_ratio", 6).alias("ratio"), "risk_level", F.size("unverified_articles").cast("long").alias("n_unverified"), "summary")


CTE["m1"] = rf"""SELECT conv_id, turn, CASE WHEN trim(response) = '' OR trim(context) = '' THEN 0 WHEN len(s) = 0 THEN 1 ELSE round(len(list_filter(s, lambda x:
  len({_terms_sql('x', evaluate.STOP_FAITHFULNESS)}) = 0 OR len(list_filter({_terms_sql('x', evaluate.STOP_FAITHFULNESS)}, lambda y: contains(lower(context), y))) >= 0.5 * len({_terms_sql('x', evaluate.STOP_FAITHFULNESS)})))::DOUBLE / len(s), 4) END::DOUBLE AS score
  FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(response, '[.!?]+'), lambda x: {strip_sql('x')}), lambda x: length(x) > 15) AS s FROM pair)"""
CTE["m2"] = f"""SELECT conv_id, turn, CASE WHEN trim(response) = '' OR trim(query) = '' THEN 0 WHEN len(q) = 0 THEN 0.5 ELSE round(len(list_intersect(q, {_words_sql('response', 3)}))::DOUBLE / len(q), 4) END::DOUBLE AS score
  FROM (SELECT *, {_terms_sql('query', evaluate.STOP_RELEVANCY, 3)} AS q FROM pair)"""


@query("SELECT * FROM m1", "pair", "m1")
def eval_faithfulness(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", evaluate.faithfulness(F.col("response"), F.col("context")).alias("score"))


@query("SELECT * FROM m2", "pair", "m2")
def eval_relevancy(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", evaluate.relevancy(F.col("response"), F.col("query")).alias("score"))


@query(r"""SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN 1 ELSE round(len(list_intersect(r, c))::DOUBLE / len(r), 4) END::DOUBLE AS score FROM (
  SELECT conv_id, turn, list_distinct(regexp_extract_all('See Article ' || conv_id % 7 || ' and part ' || turn || '. ' || response, '(?i)(?:Article|Art\.?)\s*\(?(\d+)\)?', 1)) AS r,
    list_distinct(regexp_extract_all('Article 3. Art. 1. ' || context, '(?i)(?:Article|Art\.?)\s*\(?(\d+)\)?', 1)) AS c FROM pair)""", "pair")
def eval_citation_accuracy(spark, sf):
    cited = F.concat(F.lit("See Article "), (F.col("conv_id") % 7).cast("string"), F.lit(" and part "), F.col("turn").cast("string"), F.lit(". "), "response")
    return pairs(spark, sf).select("conv_id", "turn", evaluate.citation_accuracy(cited, F.concat(F.lit("Article 3. Art. 1. "), "context")).alias("score"))


def retrieved_sets(spark, sf):
    """The dense list of each query as structs of the documents with the vectors' numbers, and two relevant articles."""
    docs = documents(spark, sf).select(F.col("doc_id").alias("vec_id"), (F.col("doc_id") % 50).cast("string").alias("article_number"), F.col("lang").alias("law_name"), "source", "text")
    rows = knn_topk(spark, sf).join(docs, "vec_id").groupBy("query_id").agg(F.collect_list(F.struct("article_number", "law_name", "source", "text")).alias("retrieved"))
    return rows.withColumn("relevant", F.array((F.col("query_id") % 50).cast("string"), F.lit("SRC7")))


CTE["ret"] = "SELECT query_id, (query_id % 50)::VARCHAR AS ref, (doc_id % 50)::VARCHAR AS article, lang, source, text FROM near JOIN documents ON doc_id = vec_id WHERE rank <= 5"


@query("""SELECT query_id, round(avg((article = ref OR contains(lower(lang), ref) OR contains(lower(source), ref) OR contains(lower(text), ref)
  OR contains(lower(source), 'src7') OR contains(lower(lang), 'src7') OR contains(lower(text), 'src7'))::INT), 4) AS score FROM ret GROUP BY query_id""", "sims", "near", "ret")
def eval_context_precision(spark, sf):
    return retrieved_sets(spark, sf).select("query_id", evaluate.context_precision(F.col("retrieved"), F.col("relevant")).alias("score"))


@query("SELECT query_id, (max(contains(article, ref)::INT) + max(contains(article, 'src7')::INT)) / 2 AS score FROM ret GROUP BY query_id", "sims", "near", "ret")
def eval_context_recall(spark, sf):
    return retrieved_sets(spark, sf).select("query_id", evaluate.context_recall(F.col("retrieved"), F.col("relevant")).alias("score"))


def scored(spark, sf):
    """One row for each pair: language as category, source as difficulty; every fifth conversation has failed."""
    rows = pairs(spark, sf)
    failed = F.col("conv_id") % 5 == 4
    return rows.select("conv_id", F.col("lang").alias("category"), F.when(F.col("conv_id") % 7 > 0, F.col("source")).alias("difficulty"), failed.alias("failed"),
                       F.when(failed, 0.0).otherwise(evaluate.faithfulness(F.col("response"), F.col("context"))).alias("faithfulness"),
                       F.when(failed, 0.0).otherwise(evaluate.relevancy(F.col("response"), F.col("query"))).alias("relevancy"))


CTE["sc"] = """SELECT conv_id, lang AS category, CASE WHEN conv_id % 7 > 0 THEN source END AS difficulty, conv_id % 5 = 4 AS failed, CASE WHEN conv_id % 5 = 4 THEN 0 ELSE m1.score END AS faithfulness,
  CASE WHEN conv_id % 5 = 4 THEN 0 ELSE m2.score END AS relevancy FROM pair JOIN m1 USING (conv_id, turn) JOIN m2 USING (conv_id, turn)"""
_S = ("pair", "m1", "m2", "sc")
_MEANS = "round(avg(round(faithfulness * 10000)::BIGINT)) / 10000 AS faithfulness, round(avg(round(relevancy * 10000)::BIGINT)) / 10000 AS relevancy"


@query(f"SELECT {_MEANS}, count(*)::BIGINT AS num_queries FROM sc", *_S)
def eval_overall(spark, sf):
    return evaluate.overall(scored(spark, sf), ("faithfulness", "relevancy"))


@query(f"SELECT coalesce(category, 'unknown') AS category, {_MEANS}, count(*)::BIGINT AS n FROM sc WHERE NOT failed GROUP BY 1", *_S)
def eval_group_category(spark, sf):
    return evaluate.by_group(scored(spark, sf)).where("level = 1").select("category", "faithfulness", "relevancy", "n")


@query(f"""SELECT category, difficulty, {_MEANS}, count(*)::BIGINT AS n FROM (SELECT coalesce(category, 'unknown') AS category, coalesce(difficulty, 'unknown') AS difficulty, faithfulness, relevancy FROM sc WHERE NOT failed)
  GROUP BY GROUPING SETS ((category), (difficulty), ())""", *_S)
def eval_grouping_sets(spark, sf):
    return evaluate.by_group(scored(spark, sf)).drop("level")


@query(f"""SELECT metric, score, CASE WHEN score >= 0.7 THEN 'good' WHEN score >= 0.4 THEN 'fair' ELSE 'poor' END AS rating FROM (SELECT {_MEANS} FROM sc) UNPIVOT (score FOR metric IN (faithfulness, relevancy))""", *_S)
def eval_ratings(spark, sf):
    return evaluate.ratings(evaluate.overall(scored(spark, sf), ("faithfulness", "relevancy")), ("faithfulness", "relevancy"))


@query("SELECT conv_id, turn, total_claims - supported_claims AS n_flags FROM faith WHERE total_claims > supported_claims", *_V, "faith")
def eval_flagged(spark, sf):
    rows = verified(spark, sf).withColumn("flags", F.transform(F.filter("verdicts", lambda v: ~v["is_supported"]), lambda v: v["claim"]))
    return evaluate.flagged(rows).select("conv_id", "turn", F.size("flags").cast("long").alias("n_flags"))


@query("""SELECT (count(*) FILTER (NOT failed))::BIGINT AS succeeded, (count(*) FILTER (failed))::BIGINT AS failed, round(avg(round(faithfulness * 10000)::BIGINT) FILTER (NOT failed)) / 10000 AS mean_confidence,
  round(avg(round(relevancy * 10000)::BIGINT) FILTER (NOT failed)) / 10000 AS mean_seconds FROM sc""", *_S)
def eval_baseline_summary(spark, sf):
    return evaluate.baseline_summary(scored(spark, sf).select((~F.col("failed")).alias("success"), F.col("faithfulness").alias("confidence"), F.col("relevancy").alias("seconds")))


# Sweeps.

def _size_sql(n: int) -> str:
    return (f"SELECT 'chunk_size' AS variable, '{n}' AS value, count(*)::BIGINT AS n, round(avg(length(t)), 4) AS avg_size FROM (SELECT {strip_sql(f'substr(text, s + 1, {n})')} AS t "
            f"FROM (SELECT text, unnest(range(0, length(text), {n - 50})) AS s FROM documents)) WHERE t <> ''")


@query(" UNION ALL ".join(_size_sql(n) for n in experiments.CHUNK_SIZES))
def sweep_chunk_size(spark, sf):
    return experiments.chunk_sizes(documents(spark, sf))


CTE["good"] = "SELECT q.doc_id AS query_id, d.doc_id FROM documents q JOIN documents d USING (lang) WHERE q.doc_id IN (SELECT query_id FROM shared)"
CTE["alllists"] = ("SELECT 'dense' AS value, query_id, doc_id, rank FROM lists WHERE w = 0.6 UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM lists WHERE w = 0.4 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused")


@query("""SELECT 'strategy' AS variable, value, sum(hits)::BIGINT AS hits, round(avg(rr), 6) AS mrr FROM (SELECT value, l.query_id, count(g.doc_id) AS hits, coalesce(max(CASE WHEN g.doc_id IS NOT NULL THEN 1.0::DOUBLE / rank END), 0) AS rr
  FROM alllists l LEFT JOIN good g ON g.query_id = l.query_id AND g.doc_id = l.doc_id GROUP BY ALL) GROUP BY value""", *_F, "good", "alllists")
def sweep_strategy(spark, sf):
    near, words = document_lists(spark, sf, 10)
    lists = {"dense": near, "bm25": words, "hybrid": fusion.reciprocal_rank(near, words, "doc_id")}
    docs = documents(spark, sf).select("doc_id", "lang")
    asked = text_queries(spark, sf).select("query_id").join(docs.withColumnRenamed("doc_id", "query_id"), "query_id")
    listed = lists["hybrid"].select("query_id", "doc_id").join(docs, "doc_id")
    good = listed.join(asked, ["query_id", "lang"]).select("query_id", F.col("doc_id").alias("key"))
    return experiments.strategies({k: v.select("query_id", F.col("doc_id").alias("key"), "rank") for k, v in lists.items()}, good)


# Sources, sinks, models and runs.

def items(spark, sf):
    return table(spark, sf, "benchmark").where("text IS NOT NULL")


def item_files(spark, sf) -> str:
    """A folder with a text file for each benchmark item."""
    path = shared_path(spark, "items")
    items(spark, sf).select("text").write.option("maxRecordsPerFile", 1).text(path)
    return path


_FILES = f"SELECT text || chr(10) AS text, '' AS article_number, '' AS chapter, '' AS section FROM benchmark WHERE {strip_sql('text')} <> ''"


@query(_FILES)
def src_text_files(spark, sf):
    return readers.text_files(spark, item_files(spark, sf) + "/*.txt").select("text", "article_number", "chapter", "section")


@query(_FILES)
def src_directory(spark, sf):
    return readers.directory(spark, item_files(spark, sf)).select("text", "article_number", "chapter", "section")


@query("SELECT item_id::VARCHAR AS id, text AS query, 'c' || item_id % 3 AS category, NULL::VARCHAR AS difficulty, item_id % 50 || '|x' AS expected FROM benchmark WHERE text IS NOT NULL")
def src_queries_json(spark, sf):
    path = shared_path(spark, "queries")
    rows = items(spark, sf).select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.concat(F.lit("c"), (F.col("item_id") % 3).cast("string")).alias("category"),
                                   F.array((F.col("item_id") % 50).cast("string"), F.lit("x")).alias("expected_articles"))
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("all")).write.text(path)
    return readers.test_queries(spark, path).select("id", "query", "category", "difficulty", F.array_join("expected_articles", "|").alias("expected"))


@query("SELECT md5(doc_id || ':' || chunk_index) AS chunk_id, CASE WHEN length(text) > 200 THEN text[:200] || '...' ELSE text END AS text, length(text)::BIGINT AS full_length, doc_id, chunk_index FROM win", "win")
def snk_previews(spark, sf):
    path = shared_path(spark, "previews")
    sinks.chunk_previews(chunking.sliding(documents(spark, sf)), path)
    rows = spark.read.schema("chunk_id string, text string, full_length long, metadata struct<doc_id:bigint,chunk_index:bigint>").json(path)
    return rows.select("chunk_id", "text", "full_length", "metadata.doc_id", "metadata.chunk_index")


@query("""SELECT md5(doc_id || ':' || chunk_index) AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE text END AS text FROM win WHERE doc_id % 3 > 0
  UNION ALL SELECT md5(doc_id || ':' || chunk_index), 'again' FROM win WHERE doc_id % 6 = 0""", "win")
def snk_collection(spark, sf):
    """Rows of two thirds of the documents, then those of every second document again or for the first time."""
    rows = chunking.sliding(documents(spark, sf)).select("doc_id", "chunk_id", "text")
    store = sinks.Collection(spark, shared_path(spark, "store"), "queries")
    store.replace(rows.where("doc_id % 3 > 0"))
    store.add(rows.where("doc_id % 2 = 0").withColumn("text", F.lit("again")))
    return store.read().select("chunk_id", "text")


@query("SELECT 'sizes' AS experiment, 'chunk_size' AS variable, value, metric, score FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_size_sql(n)})" for n in experiments.CHUNK_SIZES) + ") UNPIVOT (score FOR metric IN (n, avg_size))")
def snk_experiments(spark, sf):
    path = shared_path(spark, "experiments")
    sinks.experiment_results(experiments.run_all({"sizes": sweep_chunk_size(spark, sf)}), path)
    return spark.read.schema("variable string, value string, metric string, score double, experiment string").json(path)


@query(f"""SELECT query_id, left(text, 150) || '...' AS preview, source AS law_name, score FROM cand WHERE rank <= 3""", *_D, "cand")
def snk_baseline(spark, sf):
    path = shared_path(spark, "baseline")
    rows = _sources(spark, sf).groupBy("query_id").agg(F.collect_list(F.struct(F.col("source").alias("law_name"), "article_number", "score", "text")).alias("sources"))
    sinks.baseline_results(rows, path)
    rows = spark.read.schema("query_id long, sources array<struct<law_name:string,article_number:string,score:double,preview:string>>").json(path)
    return rows.select("query_id", F.explode("sources").alias("s")).select("query_id", "s.preview", "s.law_name", "s.score")


@query(r"""SELECT 'sliding_window' AS strategy, doc_id, count(*)::BIGINT AS n FROM win GROUP BY doc_id
  UNION ALL SELECT 'article', doc_id, count(*)::BIGINT FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|\n)\s*Article\s+\d+')) FROM legal) GROUP BY doc_id""", "win", "legal")
def chunk_factory(spark, sf):
    """Chunks of each document by the strategies' names; the size of article chunks is beyond any article."""
    one = chunking.chunk(documents(spark, sf), "Sliding_Window").select(F.lit("sliding_window").alias("strategy"), "doc_id")
    two = chunking.chunk(legal(spark, sf), "article", size=1 << 30, overlap=0).where("article_number <> 'preamble'").select(F.lit("article").alias("strategy"), "doc_id")
    return one.unionByName(two).groupBy("strategy", "doc_id").agg(F.count("*").alias("n"))


class Echo:
    """A model that tells how long its prompt is."""

    def complete(self, prompt: str) -> str:
        return f"{len(prompt)} characters"


@query(f"SELECT query_id, length({_prompt_sql()}) || ' characters' AS answer FROM ctx", *_D, "cand", "ctx")
def generate_echo(spark, sf):
    return generation.generate(prompt_build(spark, sf), Echo()).select("query_id", "answer")


def _style_sql(style: str) -> str:
    rest = len(generation.PROMPTS[style].replace("{context}", "").replace("{question}", ""))
    return f"SELECT 'prompt' AS variable, '{style}' AS value, sum(length(context) + length(query) + {rest})::BIGINT AS characters FROM ctx"


@query(" UNION ALL ".join(map(_style_sql, generation.PROMPTS)), *_D, "cand", "ctx")
def sweep_prompts(spark, sf):
    rows = generation.context(_sources(spark, sf)).join(text_queries(spark, sf), "query_id").select("context", "query")
    return experiments.prompts(lambda style: rows.agg(F.sum(F.length(generation.prompt(F.col("context"), F.col("query"), style))).alias("characters")))


def _buckets_sql(n: int) -> str:
    return (f"SELECT 'embedding_model' AS variable, 'hash{n}' AS value, count(*)::BIGINT AS filled FROM (SELECT DISTINCT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {n} AS bucket "
            f"FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS w FROM documents))")


@query(" UNION ALL ".join(_buckets_sql(n) for n in (64, 384)))
def sweep_embedders(spark, sf):
    rows = documents(spark, sf).select("doc_id", "text")

    def filled(model) -> DataFrame:
        return embedding.embed(rows, model).agg(F.sum(F.size(F.filter("embedding", lambda v: v > 0)).cast("long")).alias("filled"))

    return experiments.embedders({f"hash{n}": embedding.HashingEmbedder(n) for n in (64, 384)}, filled)


def run_rows(spark, sf):
    """The evaluation of each pair as a query with its context as the one source; every fifth conversation's answer is an error."""
    rows = pairs(spark, sf).withColumn("id", F.concat_ws(":", F.lpad(F.col("conv_id").cast("string"), 8, "0"), F.col("turn").cast("string")))
    article = (F.col("conv_id") % 50).cast("string")
    asked = rows.select("id", "query", F.col("lang").alias("category"), F.col("source").alias("difficulty"), F.array(article).alias("expected_articles"))
    source = F.struct(article.alias("article_number"), F.col("lang").alias("law_name"), F.col("source").alias("source"), F.col("context").alias("text"))
    got = rows.select("id", F.col("response").alias("answer"), F.array(source).alias("sources"), F.array().cast("array<string>").alias("flags"), F.when(F.col("conv_id") % 5 == 4, "lost").alias("error"))
    return evaluate.per_query(asked, spark.createDataFrame([], "query_id string, relevant_articles array<string>"), got)


CTE["m5"] = r"""SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN 1 ELSE round(len(list_intersect(r, c))::DOUBLE / len(r), 4) END::DOUBLE AS score FROM (
  SELECT conv_id, turn, list_distinct(regexp_extract_all(response, '(?i)(?:Article|Art\.?)\s*\(?(\d+)\)?', 1)) AS r, list_distinct(regexp_extract_all(context, '(?i)(?:Article|Art\.?)\s*\(?(\d+)\)?', 1)) AS c FROM pair)"""
CTE["evalrun"] = """SELECT lpad(p.conv_id::VARCHAR, 8, '0') || ':' || p.turn AS id, p.conv_id % 5 = 4 AS failed, CASE WHEN p.conv_id % 5 = 4 THEN 0 ELSE m1.score END AS faithfulness,
  CASE WHEN p.conv_id % 5 = 4 THEN 0 ELSE m2.score END AS relevancy, CASE WHEN p.conv_id % 5 = 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS context_precision, CASE WHEN p.conv_id % 5 = 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS context_recall,
  CASE WHEN p.conv_id % 5 = 4 THEN 0 ELSE m5.score END AS citation_accuracy FROM pair p JOIN m1 USING (conv_id, turn) JOIN m2 USING (conv_id, turn) JOIN m5 USING (conv_id, turn)"""
_E = ("pair", "m1", "m2", "m5", "evalrun")


@query("SELECT * FROM evalrun", *_E)
def eval_run(spark, sf):
    return run_rows(spark, sf).select("id", "failed", *evaluate.METRICS)


@query("SELECT " + ", ".join(f"round(avg(round({m} * 10000)::BIGINT)) / 10000 AS {m}" for m in evaluate.METRICS) + " FROM (SELECT * FROM evalrun ORDER BY id LIMIT 10) WHERE NOT failed", *_E)
def eval_config(spark, sf):
    return experiments.evaluate_config(run_rows(spark, sf))


CTE["para"] = r"""SELECT conv_id, turn, unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS part, generate_subscripts(CASE WHEN len(a) > 0 THEN a ELSE b END, 1) AS k FROM (SELECT conv_id, turn,
  list_filter(list_transform(CASE WHEN contains(context, chr(10) || chr(10)) THEN string_split(context, chr(10) || chr(10)) ELSE [context] END, lambda x: STRIP), lambda x: x <> '') AS a, []::VARCHAR[] AS b FROM pair)""".replace("STRIP", strip_sql("x"))


def _vector_sql(rows: str, keys: str, text: str) -> str:
    return (f"SELECT {keys}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS v FROM (SELECT {keys}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS n "
            f"FROM (SELECT {keys}, unnest({tokens_sql(text)}) AS w FROM {rows}) GROUP BY ALL)")


CTE["claimvec"] = _vector_sql("claim", "conv_id, turn, pos", "claim")
CTE["paravec"] = _vector_sql("para", "conv_id, turn, k", "part")


@query("""SELECT conv_id, turn, pos, round(coalesce(max(s), 0), 4) AS semantic FROM claim LEFT JOIN (SELECT conv_id, turn, pos, k, sum(c.v * p.v) AS s FROM claimvec c JOIN paravec p USING (conv_id, turn, bucket) GROUP BY ALL) USING (conv_id, turn, pos)
  GROUP BY conv_id, turn, pos""", "pair", "claimlist", "claim", "para", "claimvec", "paravec")
def claim_semantic(spark, sf):
    rows = verify.semantic_scores(pairs(spark, sf).select("conv_id", "turn", "response", "context"), embedding.HashingEmbedder(64))
    rows = rows.select("conv_id", "turn", F.posexplode("semantic").alias("pos", "semantic"))
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.round("semantic", 4).alias("semantic"))

"""License scans by a positional rare-token index (native DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ascii_lower, bind, shared_table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Notices of common licenses, with the phrase that must stand in full.
NOTICES = (
    ("mit", "licensed under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "the apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "the mozilla public license v 2"),
    ("epl", "made available under the terms of the eclipse public license", "the eclipse public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal license", "cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "all rights reserved no part of this work may be reproduced", "all rights reserved"),
)


def templates() -> list[dict]:
    out = [{"label": label, "base": True, "words": p.split(), "key": p.split()} for label, p in BASE]
    out += [{"label": label, "base": False, "words": p.split(), "key": k.split()} for label, p, k in NOTICES]
    for i, t in enumerate(out):
        n = len(t["key"])
        t |= {"id": i, "at": next(j for j in range(len(t["words"])) if t["words"][j : j + n] == t["key"])}
    return out


def _index(frequency: dict[str, int]) -> Column:
    """rarest word -> templates, each with its label, its words and places, and the words of its key phrase from the rarest on.

    A literal the size of the fixed templates.  ``frequency`` has the number of rows of each licence word.
    """
    by: dict[str, list[Column]] = {}
    for t in templates():
        place = lambda w, i: F.struct(F.lit(w).alias("w"), F.lit(i).alias("k"))
        key = sorted(range(t["at"], t["at"] + len(t["key"])), key=lambda i: (frequency.get(t["words"][i], 0), i))
        by.setdefault(t["words"][key[0]], []).append(F.struct(
            F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), F.array(*[place(t["words"][i], i) for i in key]).alias("key"),
            F.array(*[place(w, i) for i, w in enumerate(t["words"])]).alias("all")))
    return F.create_map(*[x for w, found in sorted(by.items()) for x in (F.lit(w), F.array(*found))])


def _places(postings: Column, p: Column) -> Column:
    """Where a template would start for each place of its word ``p``."""
    return F.transform(F.coalesce(F.try_element_at(postings, p["w"]), F.array().cast("array<int>")), lambda i: i - p["k"])


def _best_share(hits: Column, n: Column) -> Column:
    """The largest number of times that a start is in ``hits``, by one scan of the sorted starts, as a share of ``n``."""
    start = F.struct(F.lit(None).cast("int").alias("at"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        return bind(F.when(acc["at"] == x, acc["run"] + 1).otherwise(1), lambda run: F.struct(x.alias("at"), run.alias("run"), F.greatest(acc["best"], run).alias("best")))

    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["best"] / n)


def _matched(index: Column, present: Column, places: Column) -> Column:
    """(label, base, starts, share) of the templates whose key phrase stands in the text.

    Posting lists (places of a word in the text, in order) are shifted by the word's place in the template and intersected from the rarest word
    on, so a list is as long as the rarest word is frequent, and no place is compared with another one by one.
    """
    postings = F.map_from_entries(F.transform(present, lambda w: F.struct(w.alias("w"), F.transform(F.filter(places, lambda x: x["w"] == w), lambda x: x["i"]).alias("at"))))

    def look_up(p: Column) -> Column:
        def match(t: Column) -> Column:
            first = _places(p, t["key"][0])
            starts = F.aggregate(F.slice(t["key"], 2, 1 << 20), first, lambda acc, k: F.when(F.size(acc) == 0, acc).otherwise(F.array_intersect(acc, _places(p, k))))
            return bind(starts, lambda s: F.struct(
                t["label"].alias("label"), t["base"].alias("base"), s.alias("starts"),
                F.when(t["base"] | (F.size(s) == 0), F.lit(1.0)).otherwise(_best_share(F.flatten(F.transform(t["all"], lambda k: F.array_intersect(s, _places(p, k)))), F.size(t["all"]))).alias("share")))

        candidates = F.flatten(F.transform(F.filter(present, lambda w: F.map_contains_key(index, w)), lambda w: F.try_element_at(index, w)))
        return F.filter(F.transform(candidates, match), lambda m: F.size(m["starts"]) > 0)

    return bind(postings, look_up)


def scan(docs: DataFrame) -> DataFrame:
    """License notices of every row's whole text.

    Document frequencies of the licence words are counted over the whole corpus (a count for each of the templates' words).  A file's rare licence
    words lead to the templates that have them as the highest-IDF word of their key phrase; the template's words are then intersected by relative position,
    from the rarest on, which verifies the whole key phrase at all its places.  ``score`` is the largest share of a template's words in place (1
    for a base phrase, 0 without any).  Everything is row-local: a very long text, or one of nothing but notices, takes time in proportion to its length.

    Returns doc_id, n_words, n_base, first_word, last_word (of base places, null without), base_labels, labels, score.
    Null and empty texts have no words; repeated rows are scanned alike; an empty table gives no rows; further columns are
    ignored.
    """
    known = sorted({w for t in templates() for w in t["words"]})
    rows = docs.select("doc_id", F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0)).alias("w"))
    rows = rows.withColumn("present", F.array_intersect("w", F.array(*map(F.lit, known))))
    whole = F.lit(False)
    for key in sorted({tuple(t["key"]) for t in templates()}):
        parts = sorted(set(key))
        whole = whole | (F.size(F.array_intersect("present", F.array(*map(F.lit, parts)))) == len(parts))
    places = F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*known))
    rows = shared_table(rows.select("doc_id", F.size("w").cast("long").alias("n_words"), "present", F.when(whole, places).alias("places")), "license-words")

    frequency = {r[0]: r[1] for r in rows.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*")).collect()}
    none = F.array().cast("array<struct<label:string,base:boolean,starts:array<int>,share:double>>")
    found = F.when(F.col("places").isNotNull(), _matched(_index(frequency), F.col("present"), F.col("places"))).otherwise(none)

    def result(m: Column) -> Column:
        base = F.filter(m, lambda x: x["base"])
        starts = F.flatten(F.transform(base, lambda x: x["starts"]))
        label = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
        return F.struct(F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                        label(base).alias("base_labels"), label(m).alias("labels"), F.coalesce(F.array_max(F.transform(m, lambda x: x["share"])), F.lit(0.0)).alias("score"))

    return rows.select("doc_id", "n_words", bind(found, result).alias("r")).select("doc_id", "n_words", "r.*")


def oracle(documents: str = "documents") -> str:
    rows = ", ".join(f"({t['id']}, '{t['label']}', {t['base']}, {len(t['words'])}, {len(t['key'])}, '{w}', {i}, {t['at'] <= i < t['at'] + len(t['key'])})"
                     for t in templates() for i, w in enumerate(t["words"]))
    return r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM """ + documents + r"""),
t(template, label, base, n, key_n, word, pos, in_key) AS (VALUES """ + rows + r"""),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
m AS (SELECT r, template, label, base, i - pos AS start, count(*)::DOUBLE / any_value(n) AS share
      FROM p JOIN t USING (word) GROUP BY r, template, label, base, i - pos HAVING count(*) FILTER (in_key) = any_value(key_n)),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""

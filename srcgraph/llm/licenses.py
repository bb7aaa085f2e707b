"""License notices in whole texts: phrases, and an exact set-similarity join with notice templates. DataFrame functions only.

Each text is split once; what is kept of it is where words of the templates and phrases stand. A block is a window of words.
A template is contained in it if CONTAINED of the template's different words are. Words of templates are ordered by how many
documents have them, rare ones first; a block that contains a template must have one of the first m - need + 1 of its words.
A join on these words, with bounds from the blocks' lengths and the words' positions, gives the candidates that are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import BROADCAST_ROWS, read, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINED = 0.9
#: Words of a block, and from one block's start to the next's; any stretch of WINDOW - STEP words is in one block.
WINDOW, STEP = 48, 24
#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Wordings of public licenses' notices and their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def need(m: int) -> int:
    return math.ceil(CONTAINED * m - 1e-9)


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() is far faster than translate(); where it changes other letters too, no word of ASCII letters comes or
    goes, but for the two letters that it turns into ASCII ones."""
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("\u0130") | text.contains("\u212a")
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def places(hits: Column, codes: list[int]) -> Column:
    """Where the words of a phrase stand one after another, as numbers of words; hits: (at, code), sorted by at."""
    first = F.sequence(F.lit(0), F.size(hits) - len(codes))

    def fits(i: Column) -> Column:
        out = F.get(hits, i)["code"] == codes[0]
        for k, c in enumerate(codes[1:], 1):
            out = out & (F.get(hits, i + k)["code"] == c) & (F.get(hits, i + k)["at"] == F.get(hits, i)["at"] + k)
        return out

    found = F.transform(F.filter(first, fits), lambda i: F.get(hits, i)["at"])
    return F.when(F.size(hits) >= len(codes), found).otherwise(F.array().cast("array<int>"))


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null counts as empty; texts without words or notices have no labels ('') and score 0. score: 1 with a phrase, else the
    largest contained share of a template of at least CONTAINED. Equal texts have equal results; repeated rows all stay. A very
    long text is cut into blocks like others. No documents, no rows. Other columns of docs are not read.
    """
    docs = docs.select("doc_id", "text")
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s} | {w for p, _ in PHRASES for w in p.split()})
    number = {w: i for i, w in enumerate(vocabulary)}
    numbers = F.create_map(*[F.lit(x) for w, i in number.items() for x in (w, i)])
    pieces = docs.select("doc_id", F.split(lowered(F.col("text")), SEPARATOR).alias("w"))
    lead = (F.get("w", F.lit(0)) == "").cast("int")  # a text that begins or ends with a separator, or is empty, has an empty piece there
    tail = F.when(F.size("w") > 1, (F.element_at("w", -1) == "").cast("int")).otherwise(0)
    hits = F.filter(F.transform("w", lambda x, i: F.struct((i - lead).alias("at"), x.alias("x"))), lambda h: h["x"].isin(vocabulary))
    hits = F.transform(hits, lambda h: F.struct(h["at"].alias("at"), F.element_at(numbers, h["x"]).alias("code")))
    rows = pieces.select(F.monotonically_increasing_id().alias("_row"), "doc_id", (F.size("w") - lead - tail).cast("long").alias("n_words"), hits.alias("hits"))
    rows = stage(rows, "license-rows")
    codes = F.transform("hits", lambda h: h["code"])
    counts = rows.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").count()
    seen = {vocabulary[r["code"]]: r["count"] for r in counts.collect()}  # a row for each word of the templates at most
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    ranked = [(label, sorted(rank[w] for w in s)) for label, s in sets]
    heads = [(i, label, s, r, j, len(s), need(len(s))) for i, (label, s) in enumerate(ranked) for j, r in enumerate(s[: len(s) - need(len(s)) + 1])]
    rare = sorted({number[order[h[3]]] for h in heads})
    # where phrases stand
    spans = F.array(*[places(F.col("hits"), [number[w] for w in p.split()]) for p, _ in PHRASES])
    maybe = F.arrays_overlap(codes, _ints(sorted({number[p.split()[-1]] for p, _ in PHRASES})))
    base = rows.select("_row", "doc_id", "n_words", F.when(maybe, spans).otherwise(F.array(*[F.array().cast("array<int>")] * len(PHRASES))).alias("_spans"))
    all_ = F.flatten("_spans")
    labels = F.array_compact(F.array(*[F.when(F.size(F.col("_spans")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    base = base.select("_row", "doc_id", "n_words", F.size(all_).cast("long").alias("n_base"), F.array_min(all_).cast("long").alias("first_word"), F.array_max(all_).cast("long").alias("last_word"), labels.alias("_base"))
    # blocks of the texts that have a rare word of a template, as sorted ranks of the templates' words in them
    near = rows.where(F.arrays_overlap(codes, _ints(rare))).select("_row", "n_words", F.explode("hits").alias("h"))
    last = F.floor(F.greatest(F.col("n_words") - (WINDOW - STEP) - 1, F.lit(0)) / STEP)
    own = F.floor(F.col("h.at") / STEP)
    blocks = near.select("_row", "n_words", F.explode(F.sequence(F.greatest(own - (WINDOW // STEP - 1), F.lit(0)), F.least(own, last))).alias("block"), F.element_at(_ints([rank[w] for w in vocabulary]), F.col("h.code") + 1).alias("rank"))
    blocks = blocks.groupBy("_row", "block").agg(F.array_sort(F.collect_set("rank")).alias("ranks"), F.least(F.first("n_words") - F.col("block") * STEP, F.lit(WINDOW)).alias("size"))
    schema = "template int, label string, all array<int>, rank int, j int, m int, need int"
    prefixes = docs.sparkSession.createDataFrame(heads, schema)
    prefixes = F.broadcast(prefixes) if len(heads) <= BROADCAST_ROWS else prefixes
    found = blocks.select("*", F.posexplode("ranks").alias("i", "rank")).join(prefixes, "rank")
    found = found.where((F.col("size") >= F.col("need")) & (1 + F.least(F.col("m") - F.col("j") - 1, F.size("ranks") - F.col("i") - 1) >= F.col("need") - F.col("j")))
    found = found.withColumn("common", F.size(F.array_intersect("ranks", "all"))).where("common >= need")
    found = found.groupBy("_row").agg(F.array_sort(F.collect_set("label")).alias("_more"), F.max(F.col("common") / F.col("m")).alias("_share"))
    out = base.join(found, "_row", "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _oracle() -> str:
    spans = ", ".join(f"list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")" for p, _ in PHRASES)
    rows = ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')))" for label, text in TEMPLATES)
    base = ", ".join(f"CASE WHEN len(s[{i + 1}]) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES))
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
b AS (SELECT doc_id, r, w, [{spans}] AS s FROM d),
c AS (SELECT *, flatten(s) AS a, list_filter([{base}], lambda x: x IS NOT NULL) AS bl FROM b),
t(label, ws) AS (VALUES {rows}),
k AS (SELECT r, list_distinct(w[x + 1:x + {WINDOW}]) AS own FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {WINDOW - STEP}, 1), {STEP})) AS x FROM d)),
f AS (SELECT r, label, len(list_intersect(own, ws)) AS n, len(ws) AS m FROM k, t),
g AS (SELECT r, list(DISTINCT label) AS more, max(n / m) AS share FROM f WHERE n >= ceil({CONTAINED} * m - 1e-9) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(a)::BIGINT AS n_base, list_min(a)::BIGINT AS first_word, list_max(a)::BIGINT AS last_word, array_to_string(list_sort(bl), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(bl || coalesce(more, []))), ',') AS labels, CASE WHEN len(a) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM c LEFT JOIN g USING (r)
"""


ORACLE_SQL = _oracle()

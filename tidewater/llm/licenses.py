"""License scans by diagonal voting, in DataFrame functions only.

All rolling word 2-gram hashes of every text join the template positions (a broadcast table of fixed size). A match
at text word p and template word t votes for diagonal p - t. Votes are pre-aggregated by document, template and
diagonal; the grams themselves are compared, not just their hashes. A short phrase is found where one diagonal has
all its grams. For longer notices, diagonals with enough votes that lie within `NEAR` words of each other merge (an
inserted or missing word shifts the rest), and the merged span is verified by the share of distinct template grams
it holds and by its length.

Defined cases: null text counts as empty and has no words; repeated rows each get a row; a null id is an id like
any other; texts of any length are scanned whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the contract: phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening words of public license notices, and a label.
NOTICES = (
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version", "lgpl"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"),
    ("this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
)
NEAR, COVER, STRETCH = 3, 0.6, 1.5
#: Votes that a diagonal needs before it may merge.
LEAST = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALWAYS = "\x00"  # a gram that no text has: every document's own row


def templates() -> list[tuple[str, int, str, int, int, bool]]:
    """(gram, template, label, position, grams in the template, phrase?)"""
    out = []
    for t, (text, label) in enumerate(PHRASES + NOTICES):
        w = text.split()
        out += [(f"{a} {b}", t, label, i, len(w) - 1, t < len(PHRASES)) for i, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    return [*out, (ALWAYS, -1, "", 0, 1, False)]


def votes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """_row, doc_id, n_words, t, label, grams, phrase, diag, n (votes), at (template positions), lo, hi: one row a diagonal."""
    spark = docs.sparkSession
    # lower() also maps letters beyond ASCII, which neither splits words nor makes one of the templates' words.
    words = F.filter(F.split(F.lower(common.text_of(text_col)), NOT_WORD), lambda w: w != "")
    d = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_col}`").alias("doc_id"), words.alias("w"))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("h", F.expr(f"concat(array(xxhash64('{ALWAYS}')), if(n_words > 1, transform(sequence(0, int(n_words) - 2), i -> xxhash64(concat(w[i], ' ', w[i + 1]))), array()))"))
    grams = d.select("_row", "doc_id", "n_words", "w", F.posexplode("h").alias("i", "h")).withColumn("i", F.col("i") - 1)
    table = spark.createDataFrame(templates(), "gram string, t int, label string, tpos int, grams int, phrase boolean").withColumn("h", F.xxhash64("gram"))
    hit = grams.join(F.broadcast(table), "h").where("t < 0 or gram = concat(w[i], ' ', w[i + 1])")
    hit = hit.select("_row", "doc_id", "n_words", "t", "label", "grams", "phrase", (F.col("i") - F.col("tpos")).cast("long").alias("diag"), "tpos", F.col("i").cast("long").alias("i"))
    keys = ["_row", "doc_id", "n_words", "t", "label", "grams", "phrase", "diag"]
    # A diagonal holds each template position once, so its list is no longer than the template.
    return hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.collect_list("tpos").alias("at"), F.min("i").alias("lo"), F.max("i").alias("hi"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    v = common.written(votes(docs, text_col, id_col), "votes")  # read by two branches, so texts are cut and joined once
    keys = ["_row", "doc_id", "n_words"]
    own = v.where("t < 0 or (phrase and n = grams)").select(*keys, F.when(F.col("t") >= 0, F.col("label")).alias("base"), F.lit(None).cast("string").alias("more"), F.when(F.col("t") >= 0, F.col("diag")).alias("place"), F.when(F.col("t") >= 0, 1.0).otherwise(0.0).alias("cover"))
    by = Window.partitionBy("_row", "t").orderBy("diag")
    long = v.where(f"t >= {len(PHRASES)} and n >= {LEAST}")
    long = long.withColumn("new", (F.col("diag") - F.lag("diag").over(by) > NEAR).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(by))
    # One position each: a long stretch of neighbouring diagonals still gives no more rows than it had votes.
    spots = long.select(*keys, "t", "label", "grams", "run", "lo", "hi", F.explode("at").alias("tpos")).groupBy(*keys, "t", "label", "grams", "run", "tpos").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    runs = spots.groupBy(*keys, "t", "label", "grams", "run").agg((F.count(F.lit(1)) / F.col("grams")).alias("cover"), (F.max("hi") - F.min("lo") + 1).alias("span"))
    good = runs.where((F.col("cover") >= COVER) & (F.col("span") <= STRETCH * F.col("grams") + NEAR))
    more = good.select(*keys, F.lit(None).cast("string").alias("base"), F.col("label").alias("more"), F.lit(None).cast("long").alias("place"), "cover")
    join = lambda c: F.array_join(F.array_sort(c), ",")
    out = own.unionByName(more).groupBy(*keys).agg(
        F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.collect_set("base").alias("b"), F.collect_set("more").alias("m"), F.round(F.max("cover"), 6).alias("score"),
    )
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", join(F.col("b")).alias("base_labels"), join(F.array_union("b", "m")).alias("labels"), "score")


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    rows = ", ".join(f"('{g}', {t}, '{label}', {i}, {n}, {str(p).lower()})" for g, t, label, i, n, p in templates() if t >= 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH tpl(gram, t, label, tpos, grams, phrase) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS i FROM d),
v AS (SELECT doc_id, t, label, grams, phrase, i - tpos AS diag, count(*) AS n, list(tpos) AS tp, min(i) AS lo, max(i) AS hi
      FROM g JOIN tpl ON tpl.gram = w[i + 1] || ' ' || w[i + 2] GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_base, min(diag) AS first_word, max(diag) AS last_word, list(DISTINCT label) AS labels FROM v WHERE phrase AND n = grams GROUP BY doc_id),
l AS (SELECT *, diag - lag(diag) OVER (PARTITION BY doc_id, t ORDER BY diag) AS gap FROM v WHERE NOT phrase AND n >= {LEAST}),
r AS (SELECT *, sum(CASE WHEN gap > {NEAR} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t ORDER BY diag ROWS UNBOUNDED PRECEDING) AS run FROM l),
c AS (SELECT doc_id, label, len(list_distinct(flatten(list(tp)))) / grams AS cover, max(hi) - min(lo) + 1 AS span, grams FROM r GROUP BY doc_id, t, label, grams, run),
m AS (SELECT doc_id, list(DISTINCT label) AS labels, max(cover) AS cover FROM c WHERE cover >= {COVER} AND span <= {STRETCH} * grams + {NEAR} GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(m.cover, 0.0), 6) END AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""

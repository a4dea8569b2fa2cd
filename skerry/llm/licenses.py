"""License scans by diagonal voting, in DataFrame operations only.

All rolling hashes of three words are joined to the places of the same three words in license templates. A hit
at word i of a text and word j of a template votes for the diagonal i - j. A copy of the template is a run of votes
on one diagonal, or on neighbouring ones where words were added or left out; these are merged, and a merged
span is verified by the share of the template's words that it holds and by its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, prepare, table

GRAM = 3
# What counts as a word (after A-Z are made small), the phrases of the base rule, and well-known notices.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z made small; none for null.

    ``lower`` also changes other letters; none of these become a letter of a template but the Kelvin sign, which is
    kept from it.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))), F.lit(WORD), F.lit(0))


def gram_hash(words: Column) -> Column:
    """At each word the hash of it and the words after it; null where fewer than a gram are left."""
    return F.transform(words, lambda w, i: F.when(i + GRAM <= F.size(words), F.xxhash64(w, *[F.get(words, i + k) for k in range(1, GRAM)])))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """template, label, is_base, n_words, j, h, gram: a row for each place of each template. A fixed, small number."""
    rows = [(i, label, base, text) for i, (base, label, text) in enumerate([(True, *p) for p in phrases] + [(False, *n) for n in notices])]
    values = ", ".join(f"({i}, '{label}', {str(base).lower()}, '{text}')" for i, label, base, text in rows)
    t = spark.sql(f"select * from values {values} as t(template, label, is_base, text)").withColumn("words", F.split("text", " "))
    t = t.select("template", "label", "is_base", F.size("words").alias("t_words"), "words", F.posexplode(gram_hash(F.col("words"))).alias("j", "h")).where("h is not null")
    return t.select("template", "label", "is_base", "t_words", "j", "h", F.concat_ws(" ", F.slice("words", F.col("j") + 1, GRAM)).alias("gram"))


def votes(docs: DataFrame, at: DataFrame, *, text_col: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with n_words, and their hits (keys, template, label, is_base, t_words, i, j).

    A row's hashes are tested against the templates' before they are exploded, so only hits become rows.
    """
    known = [r[0] for r in at.select("h").distinct().collect()]  # the templates', a fixed number
    # exploded from an array of one, the words are a column of their own; else each lambda would split the text again
    rows = docs.select(*keys, F.explode(F.array(words_of(F.col(text_col)))).alias("words"))
    words = F.col("words")
    hashed = F.transform(words, lambda w, i: F.struct(i.alias("i"), F.xxhash64(w, *[F.get(words, i + k) for k in range(1, GRAM)]).alias("h")))
    hits = F.filter(hashed, lambda x: x["h"].isin(known) & (x["i"] + GRAM <= F.size(words)))
    rows = rows.select(*keys, F.size("words").cast("long").alias("n_words"), F.transform(hits, lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"), F.concat_ws(" ", F.slice(words, x["i"] + 1, GRAM)).alias("gram"))).alias("hits"))
    rows = cut(rows)
    found = rows.select(*keys, F.inline("hits")).join(F.broadcast(at), ["h", "gram"]).drop("h", "gram")
    return rows.drop("hits"), found


def bands(found: DataFrame, *, keys: list[str], reach: int = 4) -> DataFrame:
    """Spans of the notices: keys, label, template, t_words, start, end, covered, n_votes; neighbouring diagonals are one."""
    diagonals = found.where("not is_base").groupBy(*keys, "template", "label", "t_words", (F.col("i") - F.col("j")).alias("d")).agg(F.min("i").alias("first"), F.max("i").alias("last"), F.collect_set("j").alias("js"))
    in_order = Window.partitionBy(*keys, "template").orderBy("d")
    new = F.when(F.col("d") - F.lag("d").over(in_order) <= reach, 0).otherwise(1)
    merged = diagonals.withColumn("new", new).withColumn("band", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "template", "label", "t_words", "band")
    merged = merged.agg(F.min("first").alias("start"), (F.max("last") + GRAM).alias("end"), F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + (GRAM - 1))))))
    return merged.select(*keys, "template", "label", "t_words", "start", "end", covered.alias("covered"), F.size("js").alias("n_votes"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75, stretch: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """A row a document (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) and the verified spans.

    Base places are those where all words of a phrase stand in a row. A notice's span is verified if it holds the share ``least``
    of the notice's words within ``stretch`` times its length; of spans that overlap, those with fewer words than another
    (or as many, but a smaller share) give no label there, but the label of any span that is left counts. score is the largest share of any notice, 1 with a base place, else 0. Null and empty texts have no
    words; repeated rows give as many equal rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    keys = ["doc_id", "text_hash"]
    at = templates(spark)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows, found = votes(source, at, text_col="text", keys=keys)
    # repeated rows vote once
    places = found.where("is_base").groupBy(*keys, "label", "t_words", "template", (F.col("i") - F.col("j")).alias("d")).agg(F.countDistinct("j").alias("n")).where(F.col("n") == F.col("t_words") - (GRAM - 1))
    base = places.groupBy(*keys).agg(F.count("*").alias("n_base"), F.min("d").cast("long").alias("first_word"), F.max("d").cast("long").alias("last_word"), F.sort_array(F.collect_set("label")).alias("base"))
    spans = bands(found, keys=keys).withColumn("share", F.col("covered") / F.col("t_words"))
    good = spans.where((F.col("share") >= least) & (F.col("end") - F.col("start") <= F.ceil(F.col("t_words") * F.lit(stretch)) + 4))
    # a span's length is bounded, so are the spans that can overlap it: those that start within that length of its start
    longest = max(math.ceil(len(text.split()) * stretch) + 4 for _, text in NOTICES)
    near = Window.partitionBy(*keys).orderBy("start").rangeBetween(-longest, longest)
    others = good.withColumn("near", F.collect_list(F.struct("covered", "share", "start", "end")).over(near))
    clear = ~F.exists("near", lambda c: (F.struct(c["covered"], c["share"]) > F.struct("covered", "share")) & (c["start"] < F.col("end")) & (F.col("start") < c["end"]))
    best = others.groupBy(*keys).agg(F.collect_set(F.when(clear, F.col("label"))).alias("more"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    out = rows
    for side in (base, best):
        named = side.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("g"), *[c for c in side.columns if c not in keys])
        out = out.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("g")), "left").drop("d", "g")
    labels = F.sort_array(F.array_union(F.coalesce("base", none), F.coalesce("more", none)))
    out = out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("base", none), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
    return out, good.drop("text_hash")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))[0]

"""Operator 9: license scans by diagonal voting, in SQL functions.

Words are runs of ASCII digits, letters and all other code points, with A-Z in
lower case.  The hashes of all pairs of neighbouring words are joined to the
places of such pairs in license templates; the distance between the two places
is a diagonal, and pairs on one diagonal of one template vote for a copy that
begins there.  Diagonals a few words apart whose hits follow one another are
merged, which takes in words put in or left out.  A copy counts if its pairs
are ``SHARE`` of the template's and, checked on the words, the template's words
are there in that share; base phrases count only where all their words stand
in a row.

Templates are constants of this module (a few hundred pairs), so their table
is broadcast.  A marker at the end of each text keeps texts without hits and
carries their number of words; texts themselves do not move.

Defined results: null text is empty (no words, null places, no labels, score
0); equal rows give equal results, each its own row; rows with null ids are
scanned like others; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SHARE = 0.7
NEAR = 3  # diagonals that may be merged
BROADCAST_ROWS = 500_000

# Base phrases with their labels, and openings of public licenses with theirs.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "licensed under the creative commons attribution license cc by nc 4 0": "cc",
    "this work is licensed under cc by nc 4 0": "cc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}

_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_column(text: str = "text") -> Column:
    """The words of a text.

    ``lower`` also folds letters beyond A-Z, which changes neither the places
    of words nor whether they equal a template's, save for the two signs that
    fold to an ASCII letter, which are kept as they are.
    """
    kept = F.translate(F.coalesce(F.col(text), F.lit("")), "Kİ", "ßß")
    return F.array_remove(F.split(F.lower(kept), _BREAKS), "")


def template_table(docs: DataFrame) -> DataFrame:
    """``gram, template, spot, n``: hash of each pair of words of each template; template -1 is the marker."""
    phrases = [*BASE, *TEMPLATES]
    rows = [(i, j, len(w) - 1, w[j], w[j + 1]) for i, p in enumerate(phrases) for w in [p.split()] for j in range(len(w) - 1)]
    table = docs.sparkSession.createDataFrame(rows, "template int, spot int, n int, x string, y string").select(F.xxhash64("x", "y").alias("gram"), "template", "spot", "n")
    return table.unionByName(docs.sparkSession.range(1).select(F.lit(_MARK).alias("gram"), F.lit(-1).alias("template"), F.lit(0).alias("spot"), F.lit(0).alias("n")))


_MARK = 0x5EED  # the pair hash that stands at the end of each text


def votes(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, template, n, diagonal, votes, first, last``, and a row of template -1 with ``diagonal`` words and ``votes`` equal rows for each text."""
    words = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), words_column().alias("w"))
    pairs = F.expr(f"array_append(zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> xxhash64(a, b)), {_MARK}L)")
    placed = words.select("doc_id", "mark", F.size("w").alias("n_words"), F.posexplode(pairs).alias("spot_here", "gram"))
    hits = placed.join(F.broadcast(template_table(docs)), "gram")
    diagonal = F.when(F.col("template") < 0, F.col("n_words")).otherwise(F.col("spot_here") - F.col("spot"))
    return hits.groupBy("doc_id", "mark", "template", "n", diagonal.alias("diagonal")).agg(F.count("*").alias("votes"), F.min("spot_here").alias("first"), F.max("spot_here").alias("last"))


def license_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row of ``docs``."""
    counted = materialize(votes(docs), "votes")
    n_base = len(BASE)
    texts = counted.where("template = -1").select("doc_id", "mark", F.col("diagonal").alias("n_words"), F.col("votes").alias("rows"))
    key = ["doc_id", "mark"]
    same = lambda a, b: a.doc_id.eqNullSafe(b.doc_id) & (a.mark == b.mark)

    # Equal rows have equal hits, so their votes are a multiple of one row's.
    hits = counted.where("template >= 0")
    some = texts.withColumnsRenamed({"doc_id": "id_", "mark": "mark_"})
    hits = hits.join(some, hits.doc_id.eqNullSafe(some.id_) & (hits.mark == some.mark_)).select(*key, "template", "n", "diagonal", (F.col("votes") / F.col("rows")).alias("votes"), "first", "last")
    exact = hits.where((F.col("template") < n_base) & (F.col("votes") == F.col("n")))
    # Neighbouring diagonals whose hits follow one another make one copy.
    order = W.partitionBy(*key, "template").orderBy("diagonal", "first")
    new = F.when((F.col("diagonal") - F.lag("diagonal").over(order) <= NEAR) & (F.col("first") - F.lag("last").over(order) <= F.col("n")), 0).otherwise(1)
    islands = hits.where(F.col("template") >= n_base).withColumn("island", F.sum(new).over(order))
    copies = islands.groupBy(*key, "template", "n", "island").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last")).where(F.col("votes") >= SHARE * F.col("n"))
    found = exact.select(*key, "template", "n", "votes", "first", "last").unionByName(copies.drop("island"))
    found = materialize(found, "found")

    # Check the spans on the words of the few texts that have any.
    ids = found.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
    few = docs.select("doc_id", "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit("")))).join(ids.withColumnRenamed("doc_id", "id_"), F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi").dropDuplicates(key)
    few = few.select(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_"), words_column().alias("w"))
    names = docs.sparkSession.createDataFrame([(i, p.split(), lab) for i, (p, lab) in enumerate([*BASE.items(), *TEMPLATES.items()])], "template int, phrase array<string>, label string")
    span = found.join(few, found.doc_id.eqNullSafe(few.id_) & (found.mark == few.mark_)).join(F.broadcast(names), "template")
    span = span.withColumn("here", F.expr("slice(w, first + 1, last - first + 2)"))
    share = F.size(F.array_intersect("phrase", "here")) / F.size(F.array_distinct("phrase"))
    is_base = F.col("template") < n_base
    good = span.select(*key, "template", "label", "first", F.when(is_base, F.when(F.expr("here = phrase"), 1.0).otherwise(0.0)).otherwise(share * F.least(F.col("votes") / F.col("n"), F.lit(1.0))).alias("score"), is_base.alias("base"), share.alias("share"))
    good = good.where(F.when(F.col("base"), F.col("score") == 1.0).otherwise(F.col("share") >= SHARE))

    base = F.when(F.col("base"), F.col("first"))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    per = good.groupBy(*key).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"), joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("score").alias("score")
    )
    per = per.withColumnsRenamed({"doc_id": "id_", "mark": "mark_"})
    out = texts.join(per, texts.doc_id.eqNullSafe(per.id_) & (texts.mark == per.mark_), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

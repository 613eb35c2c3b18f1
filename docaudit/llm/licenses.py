"""Licence scans: MinHash bands over text windows find notices, shared shingles confirm them. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import documents, stored, text_key
from docaudit.llm.decontaminate import grams, words_of

SHINGLE = 5  # words; of a shorter notice all words
BANDS = 24  # of one row each
SIMILARITY = 0.8  # share of a notice's shingles that a window must hold

# Public licence notices, as they stand in files. A table of the same columns may take their place.
NOTICES = [
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(NOTICES)], "notice int, license string, text string")


def signature(shingles: Column) -> Column:
    """One minimum for each band: of the shingles' hashes with the band's bits turned over."""
    turns = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda i: F.xxhash64(i))
    return F.transform(turns, lambda t: F.array_min(F.transform(shingles, lambda h: h.bitwiseXOR(t))))


def templates(table: DataFrame) -> DataFrame:
    """notice, license, size (words of a shingle), width (words of a window), shingles, bands; no row without words.

    The width is the least power of two that holds the notice wherever it begins, with windows a quarter of their
    width apart. A window with SIMILARITY of the notice then shares over a quarter of all shingles with it; of BANDS
    minima none agrees with a chance below 0.75 ** BANDS, one in a thousand.
    """
    rows = table.withColumn("words", words_of(F.col("text"))).filter("size(words) > 0")
    n = F.size("words")
    width = F.greatest(F.lit(4), F.pow(F.lit(2.0), F.ceil(F.log2(n * 4 / 3 - F.lit(1e-9))))).cast("int")
    rows = rows.select("notice", "license", "words", F.least(n, F.lit(SHINGLE)).alias("size"), width.alias("width"))
    cases = [F.when(F.col("size") == k, grams(F.col("words"), k)) for k in range(1, SHINGLE + 1)]
    rows = rows.select("notice", "license", "words", "size", "width", F.array_distinct(F.coalesce(*cases)).alias("shingles"))
    return rows.withColumn("bands", signature(F.col("shingles")))


def windows(docs: DataFrame, size: int, width: int) -> DataFrame:
    """at (first word) and shingles of the windows of ``width`` words, a quarter of that apart, the last one at the end."""
    each, step = width - size + 1, max(width // 4, 1)
    hashed = docs.withColumn("all", grams(F.col("words"), size)).filter("size(all) > 0")
    last = F.greatest(F.size("all") - each, F.lit(0))
    starts = F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last))
    placed = hashed.select("doc_id", "key", "all", F.explode(starts).alias("at"))
    return placed.select("doc_id", "key", "at", F.slice("all", F.col("at") + 1, each).alias("shingles"))


def licenses(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Per document and licence with a match: doc_id, license, containment, first_word, n_words of its best window.

    ``table`` has notice, license and text. A window matches a notice if it holds SIMILARITY of the notice's shingles;
    the best one holds most, and is the first of those. first_word and n_words span the shared shingles. A null or
    blank text has no words and no match. Rows that repeat a doc_id and a text give one result; null
    ids keep theirs. Other columns are ignored.
    """
    known = stored(templates(table), "license-templates")
    rows = known.select("words", "size", "width").collect()  # one for each notice
    # A match holds a whole shingle, so the longest word of some shingle: texts without any are passed over.
    telling = {max(r["words"][i : i + r["size"]], key=len) for r in rows for i in range(len(r["words"]) - r["size"] + 1)}
    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    if not telling:
        return texts.selectExpr("doc_id", "'' AS license", "0D AS containment", "0L AS first_word", "0L AS n_words").limit(0)
    texts = stored(texts.filter(F.arrays_overlap("words", F.array(*map(F.lit, sorted(telling))))), "license-texts")
    found = []
    for size, width in sorted({(r["size"], r["width"]) for r in rows}):
        of = known.filter((F.col("size") == size) & (F.col("width") == width))
        bands = of.select("notice", F.posexplode("bands").alias("band", "value"))
        cut = windows(texts, size, width)
        signed = cut.select("doc_id", "key", "at", "shingles", F.posexplode(signature(F.col("shingles"))).alias("band", "value"))
        near = signed.join(bands, ["band", "value"]).select("doc_id", "key", "at", "shingles", "notice").dropDuplicates(["doc_id", "key", "at", "notice"])
        near = near.join(of.select("notice", "license", F.col("shingles").alias("own")), "notice")
        hit = F.filter(F.transform("shingles", lambda h, i: F.when(F.array_contains("own", h), i)), lambda i: i.isNotNull())
        near = near.select("doc_id", "key", "license", "at", hit.alias("hit"), (F.size(F.array_intersect("own", "shingles")) / F.size("own")).alias("containment"))
        first = (F.col("at") + F.array_min("hit")).cast("long")
        span = (F.array_max("hit") - F.array_min("hit") + size).cast("long")
        found.append(near.filter(F.col("containment") >= SIMILARITY).select("doc_id", "key", "license", "containment", first.alias("first_word"), span.alias("n_words")))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    best = F.max_by(F.struct("containment", "first_word", "n_words"), F.struct("containment", -F.col("first_word"), "n_words"))
    return hits.groupBy("doc_id", "key", "license").agg(best.alias("b")).select("doc_id", "license", "b.containment", "b.first_word", "b.n_words")


def op8_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses(documents(spark, sf), notices(spark))

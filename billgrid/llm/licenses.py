"""License scan: MinHash bands over text windows retrieve templates, exact containment verifies
them. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billgrid.functions.text import let
from billgrid.llm import common

SHINGLE, CONTAINMENT, MISS = 5, 0.75, 1e-6

# Notices of common public licenses, by SPDX-like id.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of ``size`` words at each position; case and punctuation do not count.
    Empty if there are fewer words."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[h[i + k] for k in range(size)]))))


def bands_needed(similarity: float, miss: float = MISS) -> int:
    """One-row bands that find a pair of this Jaccard similarity but for a chance of ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity))


def band_keys(window: Column, bands: int) -> Column:
    """(band, key) of a window: the least of its shingles in each of ``bands`` hash orders."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(window, lambda h: F.xxhash64(h, b))).alias("key")))


def _window_of(n: int):
    return lambda place: F.floor(place / n).cast("int")


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, license, shingles (distinct), n: the templates that have a shingle."""
    table = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, license string, text string")
    return table.select("template", "license", F.array_distinct(shingles(F.col("text"))).alias("shingles")).withColumn("n", F.size("shingles")).filter("n > 0")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """doc_id, n_matches, licenses (sorted ids, comma-joined, empty if none), matches (array of
    template, license, containment, first word: the best window of each template) of every row.

    A template of n shingles is sought in windows of 2n positions that start at every n-th, so any
    stretch as long as the template lies whole in one. If a window holds the fraction c of it, their
    Jaccard similarity is at least c / (3 - c); the number of bands follows from that and ``miss``.
    A window that shares no shingle with any template can share no band with one, as their least
    shingles differ: such windows are passed over. Templates are few and given by the caller; they
    alone are broadcast.

    Null, empty and short texts have no match; whole texts of any length are scanned; repeated rows,
    ties and null ids give a row each; an empty table gives an empty result; other columns are
    ignored. Texts are told apart by a 256-bit digest, and each distinct one is matched once.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates)
    held = [(r.template, r.license, r.shingles, r.n) for r in table.collect()]  # the templates given, hashed
    kind = "array<struct<template:int,license:string,containment:double,first_word:int>>"
    named = docs.select("doc_id", F.sha2(common.whole_text(), 256).alias("digest"))
    if not held:
        return named.select("doc_id", F.lit(0).cast("long").alias("n_matches"), F.lit("").alias("licenses"), F.lit(None).cast(kind).alias("matches"))
    known = F.array(*[F.lit(h) for h in sorted({h for _, _, x, _ in held for h in x})])
    texts = docs.select(F.sha2(common.whole_text(), 256).alias("digest"), shingles(common.whole_text()).alias("s")).filter(F.arrays_overlap("s", known))
    texts = texts.select("digest", "s", F.array_compact(F.transform("s", lambda h, i: F.when(F.array_contains(known, h), i))).alias("hits"))
    lengths = sorted({n for *_, n in held})
    starts = [F.transform("hits", _window_of(n)) for n in lengths]
    windows = texts.select("digest", "s", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array_distinct(F.concat(x, F.transform(x, lambda w: w - 1))).alias("w")) for n, x in zip(lengths, starts)])).alias("e"))
    windows = windows.select("digest", "s", F.col("e.n").alias("n"), F.explode("e.w").alias("w")).filter("w >= 0")
    windows = windows.select("digest", "n", "w", F.array_distinct(F.slice("s", F.col("w") * F.col("n") + 1, F.col("n") * 2)).alias("window"))
    bands = bands_needed(containment / (3 - containment), miss)
    asked = windows.select("*", F.explode(band_keys(F.col("window"), bands)).alias("b")).select("digest", "n", "w", "window", "b.band", "b.key")
    offered = table.select("template", "license", "n", "shingles", F.explode(band_keys(F.col("shingles"), bands)).alias("b")).select("template", "license", "n", "shingles", "b.band", "b.key")
    met = asked.join(F.broadcast(offered), ["n", "band", "key"])
    share = F.size(F.array_intersect("window", "shingles")) / F.col("n")
    verified = met.select("digest", "template", "license", share.alias("containment"), (F.col("w") * F.col("n")).alias("first_word")).filter(F.col("containment") >= containment)
    best = verified.groupBy("digest", "template", "license").agg(F.max(F.struct("containment", (-F.col("first_word")).alias("at"))).alias("m"))
    found = best.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("template", "license", F.col("m.containment").alias("containment"), (-F.col("m.at")).alias("first_word")))).alias("matches"))
    out = named.join(found, "digest", "left")
    return out.select("doc_id", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"),
                      F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ","), F.lit("")).alias("licenses"), "matches")

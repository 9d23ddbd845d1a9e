"""Licences of files: TF-IDF cosine of notices to templates, and inheritance down directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import materialize

# Usual notices by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
                   "except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software "
                "Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words by which a notice is found; every template holds one.
ANCHORS = ["licensed", "license", "licence", "permission", "redistribution", "domain"]
WORD = r"[a-z0-9]+"
FILE_NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\.[a-z0-9]+)?$"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def template_words(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, license string, notice string")
    return table.withColumn("words", words_of(F.col("notice"))).drop("notice")


def _weights(rows: DataFrame, keys: list[str], idf: DataFrame, most: float) -> DataFrame:
    """TF-IDF weight of every term of every (keys): rows hold one word each."""
    counts = rows.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    joined = counts.join(idf, "term", "left")
    return joined.withColumn("weight", F.col("tf") * F.coalesce("idf", F.lit(most))).drop("tf", "idf")


def find_notices(
    files: DataFrame, id_col: str, text_col: str, templates: list[tuple[str, str]] | None = None,
    least: float = 0.8,
) -> DataFrame:
    """Notices in whole texts: ``id, license, cosine, place, words`` (word number, window length).

    Wherever an anchor word stands, the words around it are cut to a window that lies as
    the template lies around the same anchor (clipped at the start of the text), and both are compared by the cosine of their TF-IDF vectors.
    Document frequencies of the template terms are counted over all texts; other words count as
    seen once. One row per file and licence, its best window; ties go to the earlier template and place.
    """
    spark = files.sparkSession
    known = template_words(spark, templates or TEMPLATES)
    vocabulary = known.select(F.explode("words").alias("term")).distinct()
    terms = F.array(*[F.lit(row[0]) for row in vocabulary.orderBy("term").collect()])  # the templates' words
    total = files.count()
    lower = F.lower(F.col(text_col))
    seen = files.select(F.explode(F.array_intersect(words_of(F.col(text_col)), terms)).alias("term"))
    counts = seen.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    most = F.log(F.lit(total + 1.0)) + 1
    idf = vocabulary.join(counts, "term", "left").select(
        "term", (F.log((total + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    idf = materialize(idf, "idf")

    held = files.filter(lower.rlike("|".join(ANCHORS))).select(
        F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")).filter("id is not null")
    places = held.select("id", "w", F.posexplode("w").alias("at", "anchor")).filter(F.col("anchor").isin(ANCHORS))
    lying = known.select("template", "license", F.size("words").alias("n"), F.posexplode("words").alias("off", "anchor"))
    lying = lying.filter(F.col("anchor").isin(ANCHORS))
    windows = places.join(F.broadcast(lying), "anchor").select(  # one row per template and anchor in it
        "id", "template", "license", "n", (F.col("at") - F.col("off")).alias("place"), "w")
    # At the start of a text a window may lack the template's first words; it holds those that are there.
    windows = windows.select(
        "id", "template", "license", F.expr("n + least(place, 0)").alias("n"), F.greatest("place", F.lit(0)).alias("place"), "w")
    windows = windows.select(
        "id", "template", "license", "n", "place", F.slice("w", F.col("place") + 1, F.col("n")).alias("part"))
    windows = windows.dropDuplicates(["id", "template", "place", "n", "part"])
    key = ["id", "template", "license", "n", "place", "part"]
    left = _weights(windows.select(*key, F.explode("part").alias("term")), key, idf, most)
    right = _weights(known.select("template", F.explode("words").alias("term")), ["template"], idf, most)
    norms = right.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    right = right.join(norms, "template").select("template", "term", (F.col("weight") / F.col("norm")).alias("unit"))
    right = materialize(right, "templates")
    scored = left.join(right, ["template", "term"], "left").groupBy(*key).agg(
        (F.sum(F.col("weight") * F.coalesce("unit", F.lit(0.0)))
         / F.sqrt(F.sum(F.col("weight") * F.col("weight")))).alias("cosine"))
    scored = scored.withColumn("cosine", F.round("cosine", 6)).filter(F.col("cosine") >= least)
    best = scored.groupBy("id", "license").agg(F.max(F.struct(
        "cosine", F.negate("template").alias("t"), F.negate("place").alias("p"), "n")).alias("best"))
    return best.select("id", "license", "best.cosine", F.negate("best.p").alias("place"), F.col("best.n").alias("words"))


def parent(path: Column) -> Column:
    """Directory of a path; empty for a name without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan_licenses(
    files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
    templates: list[tuple[str, str]] | None = None, least: float = 0.8,
) -> DataFrame:
    """One row per file: ``<id>, license, cosine, licenses, origin, inherited_from``.

    A file with a notice has that licence (``origin`` own; of several the best match, all
    in ``licenses``). A licence file is one named like LICENSE or COPYING, or whose words
    are for the greater part the notice; it covers its directory. A file without a notice inherits
    from the nearest directory above it that is covered (``origin`` inherited). Distinct directories
    are matched with all their ancestors by a join on the path, never file by file.

    Null and empty texts have no notice; a null path inherits nothing; files without an id have no
    notice of their own. Of several licence files in a directory the best match counts, then the least
    path. Other columns are ignored.
    """
    notices = materialize(find_notices(files, id_col, text_col, templates, least), "notices")
    own = notices.groupBy("id").agg(
        F.max(F.struct("cosine", "license", "words")).alias("top"),
        F.sort_array(F.collect_set("license")).alias("licenses"))
    size = F.size(words_of(F.col(text_col)))
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), size.alias("size"))
    rows = rows.join(own, "id", "left").withColumn("dir", parent(F.col("path")))
    rows = materialize(rows, "files")

    named = F.col("path").rlike(FILE_NAMES) | (F.col("top.words") * 2 > F.col("size"))
    covers = rows.filter(F.col("top").isNotNull() & named & F.col("path").isNotNull())
    covers = covers.groupBy("dir").agg(F.min(F.struct(
        F.negate("top.cosine").alias("c"), "path", F.col("top.license").alias("license"))).alias("cover"))
    covers = covers.select(F.col("dir").alias("above"), "cover.license", F.col("cover.path").alias("file"))
    dirs = rows.filter("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))
    climbs = dirs.select("dir", F.explode(chain).alias("step")).select("dir", "step.depth", "step.above")
    nearest = climbs.join(covers, "above").groupBy("dir").agg(
        F.max(F.struct("depth", "license", "file")).alias("near"))
    nearest = materialize(nearest, "nearest")
    found = rows.join(nearest, "dir", "left")
    inherits = F.col("top").isNull() & F.col("near").isNotNull()
    return found.select(
        F.col("id").alias(id_col),
        F.coalesce("top.license", "near.license").alias("license"), F.col("top.cosine").alias("cosine"),
        F.array_join(F.coalesce("licenses", F.array().cast("array<string>")), ",").alias("licenses"),
        F.when(F.col("top").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("near.file")).alias("inherited_from"))

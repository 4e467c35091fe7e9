"""License scans: TF-IDF cosine of notice lines to templates, and inheritance from the nearest directory with a licence file.

Everything is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqrank.llm.common import saved

LEAST_COSINE = 0.75
#: Lines that hold one of these words are compared: every template line does.
MARKS = "licen[cs]e|copyright|spdx|warrant|permission|public domain"
#: Names of files that speak for their directory, in lower case and without an ending.
FILE_NAMES = ("license", "licence", "copying", "unlicense", "notice")

#: Lines of licence texts and of customary headers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing A-Z."""
    return F.filter(F.split(_lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _weights(lines: DataFrame, key: str, idf: DataFrame, unseen: Column) -> DataFrame:
    """(key, term, weight): unit vectors of TF-IDF weights of the distinct ``lines`` (key, text)."""
    terms = lines.select(key, F.explode(words(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = terms.join(idf, "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("raw"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def scan(files: DataFrame, templates=TEMPLATES, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """(doc_id, path, licence, score, origin, licence_dir) of every row of ``files`` (doc_id, path, text).

    Every line of the whole text that holds a licence word is a header; the best cosine of its TF-IDF
    vector to a template's gives its licence, from ``least_cosine`` on; of several lines the best counts,
    then the first licence by name. Document frequencies of template words are counted over all files; a word that is in no
    template weighs like one that no file has. Equal lines are compared once.

    A file named as in FILE_NAMES with a licence speaks for its directory. A file without a licence of its
    own inherits from the nearest directory upwards that has one (the best score there, then the first
    name): ``origin`` is ``own``, ``inherited`` or null. Directories, not files, are joined with their
    ancestors. Null texts have no lines; a null path has no directory; repeated rows come back repeated;
    other columns are ignored.
    """
    spark = files.sparkSession
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, licence string, text string")
    vocabulary = sorted({w for r in known.select(words(F.col("text")).alias("w")).collect() for w in r.w})
    text = F.coalesce(F.col("text"), F.lit(""))
    total = files.count()
    seen = F.array_intersect(words(text), F.array(*map(F.lit, vocabulary)))
    counts = files.select(F.explode(seen).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    unseen = F.lit(1.0) + F.log(F.lit(float(total + 1)))
    every = spark.createDataFrame([(w,) for w in vocabulary], "term string")
    idf, _ = saved(every.join(counts, "term", "left").select("term", (1 + F.log(F.lit(float(total + 1)) / (1 + F.coalesce("n", F.lit(0))))).alias("idf")))

    marked = F.filter(F.split(text, r"[\r\n]+"), lambda x: _lower(x).rlike(MARKS))
    rows, _ = saved(files.select(F.monotonically_increasing_id().alias("row"), "doc_id", "path", marked.alias("lines")))
    headers = rows.select("row", F.explode("lines").alias("text"))
    lines = headers.select("text").distinct().withColumn("line", F.col("text"))
    own = _weights(lines, "line", idf, unseen)
    theirs = _weights(known, "template", idf, unseen).withColumnRenamed("weight", "other")
    cosine = own.join(theirs, "term").groupBy("line", "template").agg(F.sum(F.col("weight") * F.col("other")).alias("cosine"))
    close = cosine.select("line", "template", F.round("cosine", 6).alias("score")).where(F.col("score") >= least_cosine)
    best = close.join(known.select("template", "licence"), "template").groupBy("line").agg(F.min(F.struct((-F.col("score")).alias("order"), "licence")).alias("best"))
    found = headers.join(best, headers.text == best.line).groupBy("row").agg(F.min("best").alias("best"))

    cut = F.split("path", "/")
    name = F.regexp_replace(_lower(F.element_at(cut, -1)), r"\.[a-z0-9]*$", "")
    folder = F.array_join(F.slice(cut, 1, F.size(cut) - 1), "/")
    placed = rows.join(found, "row", "left").select("row", "doc_id", "path", "best", F.when(F.col("path").isNotNull(), folder).alias("dir"), name.alias("name"))
    speaking = placed.where(F.col("best").isNotNull() & F.col("name").isin(*FILE_NAMES)).groupBy("dir").agg(F.min("best").alias("of_dir"))
    # every directory with each of its ancestors, down to the empty one
    levels = F.split("dir", "/")
    steps = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(levels)))
    up = placed.select("dir").where("dir is not null").distinct().select("dir", F.explode(steps).alias("depth"))
    up = up.select(F.col("dir").alias("below"), "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = up.join(speaking, "dir").groupBy("below").agg(F.max_by(F.struct("of_dir", F.col("dir").alias("from")), "depth").alias("near"))
    out = placed.join(nearest, placed.dir == nearest.below, "left")
    inherited = F.col("best").isNull() & F.col("near").isNotNull()
    chosen = F.coalesce("best", "near.of_dir")
    return out.select(
        "doc_id",
        "path",
        chosen.getField("licence").alias("licence"),
        (-chosen.getField("order")).alias("score"),
        F.when(F.col("best").isNotNull(), "own").when(inherited, "inherited").alias("origin"),
        F.when(inherited, F.col("near.from")).alias("licence_dir"),
    )

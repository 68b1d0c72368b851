"""License scans by sparse TF-IDF cosine to templates, inherited along paths (operator 8). DataFrame functions only.

Every line of a file, and every window of words about as long as a template, is compared with notices, headers and
texts of known licences; so a notice may be wrapped, commented out, or stand within a long line. The cosine of a part
with a template is bounded by the norm of the template's terms that the part holds (Cauchy and Schwarz). The bound
needs only a template's rarest terms, up to the norm of the rest; only parts that reach it are weighed. Files without a
notice take the licence of the nearest directory above them that has a licence file.
"""

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unused
from .licence_texts import TEXTS

THRESHOLD = 0.6
#: Square of the norm that a template's commoner terms may have, which the bound takes as present in each part.
COMMON = 0.18
#: Templates of so many terms are headers or texts, and go before notices of a sentence.
LONG = 40
#: Lengths of windows grow by at most a half; a window starts at every eighth of its length.
WIDTHS = (8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384)
#: Names of licence files, lower case, without extension.
LICENCE_FILES = ("license", "licence", "copying", "unlicense", "notice")
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"

#: Notices as their licences ask for them, shortened to the sentence that names the licence (fixed values, public texts).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, all copyright and related rights have been waived under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *TEXTS,
)


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def weigh(templates, df: dict[str, int], n: int) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Unit vectors of the templates, the inverse document frequencies of their terms, and that of all other terms."""
    top = math.log((n + 1) / 1) + 1
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for _, text in templates for t in terms(text)}
    out = []
    for _, text in templates:
        v: dict[str, float] = {}
        for t in terms(text):
            v[t] = v.get(t, 0.0) + idf[t]
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out, idf, top


def rare_terms(vectors: list[dict[str, float]], idf: dict[str, float], common: float) -> tuple[list[str], list[float]]:
    """Each template's rarest terms until the rest's squared norm is at most ``common``, and the squared norm of each that no such term has."""
    out = set()
    for v in vectors:
        left = 1.0
        for t, x in sorted(v.items(), key=lambda p: (-idf[p[0]], p[0])):
            if left <= common:
                break
            out.add(t)
            left -= x * x
    return sorted(out), [sum(x * x for t, x in v.items() if t not in out) for v in vectors]


def width(n: int) -> int:
    """Length of the windows that a template of ``n`` terms is compared with."""
    return next((w for w in WIDTHS if w >= n), n)


def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """row, doc_id, path, own_licence, own_score, licence, inherited_from for each row of ``files`` (doc_id, path, text).

    own_licence is that of the template with the largest cosine of any line or window, if that reaches ``threshold``;
    templates of at least LONG terms that reach it go before others, but are compared with no part of less than half their
    length; ties go to the first template. Document frequencies of the templates' terms are counted over all files, and terms of no
    template weigh as unseen ones. licence is the own one, or that of the nearest directory at or above the file's that
    holds a licence file with an own licence (of several the smallest name), named in inherited_from. Null and empty texts have no own
    licence; a null path has no directory. ``row`` is Spark's row id of the input. Rows that share a path are scanned
    each. An empty table gives no rows.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "licences")
    vocabulary = sorted({t for _, text in templates for t in terms(text)})  # bounded by the templates
    known = F.array_intersect(F.split(F.lower("text"), r"[^a-z0-9.-]+|[.-](?![a-z0-9])|(?<![a-z0-9])[.-]"), F.array(*map(F.lit, vocabulary)))
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "path", "text", known.alias("known"))
    rows = scratch.keep(rows, "rows")  # numbered once; all later reads are of this table
    counted = rows.select(F.explode("known").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    vectors, idf, top = weigh(templates, {r.term: r.n for r in counted}, rows.count())
    rare, rest = rare_terms(vectors, idf, min(COMMON, threshold**2 / 2))
    named = [(t, k, x, width(len(terms(templates[k][1]))), threshold**2 - rest[k] - 1e-9) for k, v in enumerate(vectors) for t, x in v.items()]
    rules = F.broadcast(spark.createDataFrame(named, "term string, template int, x double, width int, least double"))  # one row a term of a template
    telling = F.broadcast(spark.createDataFrame([r for r in named if r[0] in set(rare)], "term string, template int, x double, width int, least double"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))

    def reaching(found: DataFrame, *key: str) -> DataFrame:
        """The parts, by ``key``, and the templates for which their rare terms leave the threshold possible, from (key, term, template, x, least)."""
        return found.distinct().groupBy(*key, "template").agg(F.sum(F.col("x") * F.col("x")).alias("s"), F.first("least").alias("least")).where("s >= least").select(*key, "template")

    some = rows.select("row", F.explode(F.array_intersect("known", F.array(*map(F.lit, rare)))).alias("term")).join(telling, "term").select("row", "term", "template", "x", "least")
    pairs = scratch.keep(reaching(some, "row"), "pairs")  # file and template
    texts = scratch.keep(rows.select("row", "text").join(pairs.select("row").distinct(), "row", "left_semi"), "texts")
    split = texts.select("row", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    lines = split.select("row", F.lit(0).alias("width"), "line", F.explode(words).alias("term")).withColumnRenamed("line", "at")
    chosen = reaching(lines.join(telling.drop("width"), "term").join(pairs, ["row", "template"], "left_semi").select("row", "width", "at", "term", "template", "x", "least"), "row", "width", "at").drop("template").distinct()
    line_terms = lines.join(chosen, ["row", "width", "at"], "left_semi")
    # Windows, as (width, first word) of the file's words.
    step = F.greatest(F.lit(1), F.shiftright("width", 3))
    starts = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("width") + 1) / step).cast("int")), F.floor(F.col("at") / step).cast("int"))
    hits = texts.select("row", F.posexplode(words).alias("at", "term")).join(telling, "term").join(pairs, ["row", "template"], "left_semi").withColumn("step", step).withColumn("start", F.explode(starts))
    hits = hits.select("row", "width", (F.col("start") * F.col("step")).alias("at"), "term", "template", "x", "least")
    windows = reaching(hits, "row", "width", "at").drop("template").distinct().join(texts.select("row", words.alias("words")), "row")
    window_terms = windows.select("row", "width", "at", F.explode(F.slice("words", F.col("at") + 1, F.col("width"))).alias("term"))

    found = line_terms.unionByName(window_terms).groupBy("row", "width", "at", "term").agg(F.count("*").alias("tf"))
    weighed = found.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(top))).drop("idf")
    weighed = scratch.keep(weighed, "weighed")
    norms = weighed.groupBy("row", "width", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("words"))
    fits = (F.col("width") == 0) | (F.col("width") == F.col("own_width"))
    dots = weighed.join(rules.withColumnRenamed("width", "own_width"), "term").where(fits).groupBy("row", "width", "at", "template").agg(F.sum(F.col("w") * F.col("x")).alias("dot"))
    scored = dots.join(norms, ["row", "width", "at"]).withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= threshold)
    sizes = F.array(*[F.lit(len(terms(text))) for _, text in templates])[F.col("template")]
    long = sizes >= LONG
    scored = scored.where(~long | (2 * F.col("words") >= sizes))
    best = scored.groupBy("row").agg(F.max(F.struct(long.alias("long"), F.round("score", 9).alias("score"), (-F.col("template")).alias("first"))).alias("best"))
    names = F.create_map(*[F.lit(x) for k, (name, _) in enumerate(templates) for x in (k, name)])
    own = best.select("row", names[-F.col("best.first")].alias("own_licence"), F.col("best.score").alias("own_score"))
    judged = scratch.keep(rows.select("row", "doc_id", "path").join(own, "row", "left"), "judged")

    parts = F.split("path", "/", -1)
    directory = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    name = F.lower(F.element_at(parts, -1))
    is_licence = F.substring_index(name, ".", 1).isin(*LICENCE_FILES)
    holders = judged.where(is_licence & F.col("own_licence").isNotNull()).select(directory.alias("directory"), F.struct(name.alias("name"), F.col("own_licence").alias("licence")).alias("file"))
    holders = holders.groupBy("directory").agg(F.min("file.name").alias("n"), F.min("file").alias("file")).select("directory", F.col("file.licence").alias("found"))
    # All directories above a file, once for each directory that has files without a notice of their own.
    needy = judged.where(F.col("own_licence").isNull() & F.col("path").isNotNull()).select(directory.alias("below")).distinct()
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("below", "/", -1))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("below", "/", -1), F.lit(1), k), "/").alias("directory")))
    steps = needy.select("below", F.explode(above).alias("a")).select("below", "a.depth", "a.directory")
    nearest = steps.join(holders, "directory").groupBy("below").agg(F.max(F.struct("depth", "directory", "found")).alias("up")).select("below", "up.directory", "up.found")
    joined = judged.withColumn("below", F.when(F.col("own_licence").isNull(), directory)).join(nearest, "below", "left")
    return joined.select("row", "doc_id", "path", "own_licence", "own_score", F.coalesce("own_licence", "found").alias("licence"), F.col("directory").alias("inherited_from"))


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files of a tree: source/lang/number of a group of 50/name; the first of a group of 50 is its licence file."""
    path = unused(docs, "path")
    group = F.floor(F.col("doc_id") / 50)
    name = F.when(F.col("doc_id") % 50 < 3, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("none")), (group % 100).cast("string"), group.cast("string"), name).alias(path)).withColumnRenamed(path, "path")

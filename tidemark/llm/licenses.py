"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

DataFrame expressions only. A template's KEYS are words that hold so much of its weight that a run of words without any of them can't reach the
least cosine (prefix filtering): only runs around a key are compared, and none is missed.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Licence templates: identifier and characteristic statements (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("Proprietary", "All rights reserved. Proprietary and confidential. Unauthorized copying is strictly prohibited"),
)
LEAST = 0.6
_SPLIT = r"[^a-z0-9.+-]+|[.]+(?=[^a-z0-9]|$)"


#: Words that say nothing of a licence (fixed values); they are left out of templates and texts.
STOP = tuple("a an and any are as at be by can do for from if in into is it its may no not of on or other such that the these this to under was which with you your".split())


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: (t != "") & ~t.isin(*STOP))


_STATED = [[t for t in re.split(_SPLIT, x.lower()) if t and t not in STOP] for _, x in TEMPLATES]
_DF = Counter(t for x in _STATED for t in set(x))
_IDF = {t: math.log((len(TEMPLATES) + 1) / (n + 1)) + 1 for t, n in _DF.items()}
#: Of words in no template.
_OTHER = math.log(len(TEMPLATES) + 1) + 1


def _keys(words: list[str], least: float) -> list[str]:
    """Words of a template without any of which no run has a cosine of `least`: the squared weight of the other words is under least ** 2 of all.

    Any choice with that property is right; the heaviest words are in the fewest templates.
    """
    weight = {t: _IDF[t] ** 2 for t in set(words)}
    left, out = sum(weight.values()), []
    most = left * least**2
    for t in sorted(weight, key=lambda t: (-weight[t], -len(t), t)):
        if left < most - 1e-9:
            break
        out.append(t)
        left -= weight[t]
    return out


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, length, weights, norm): a table of fixed size; a word weighs its inverse document frequency over the templates."""
    rows = []
    for k, ((license_, _), words) in enumerate(zip(TEMPLATES, _STATED, strict=True)):
        w = {t: _IDF[t] for t in set(words)}
        rows.append((k, license_, len(words), w, math.sqrt(sum(x * x for x in w.values()))))
    return spark.createDataFrame(rows, "template int, license string, length int, weights map<string,double>, norm double")


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def stated(texts: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """(h1, h2, license, score): the best licence that each distinct text states, with a cosine of `least` at least; of ties the first by name.

    h1 and h2 are 128 bits of hash of the text. Each template is compared with every run of as many words that has one of its keys, across line
    ends, so names, years and prose around a statement don't count against it; what a shorter text lacks counts as other words. A word weighs its inverse document frequency over the
    templates (one in none, or said again in the run, the greatest), so a score depends on the text alone. The texts are read once: the pieces
    around keys are kept as a table, and a piece that many texts have is compared once. A null text states nothing.
    """
    spark = texts.sparkSession
    keys: dict[str, list[int]] = {}
    for k, words in enumerate(_STATED):
        for t in _keys(words, least):
            keys.setdefault(t, []).append(k)
    starts = {c: "|".join(re.escape(t[1:]) for t in sorted(keys) if t[0] == c) for c in sorted({t[0] for t in keys})}
    some = "(?<![a-z0-9.+-])(?:" + "|".join(f"{re.escape(c)}(?:{rest})" for c, rest in starts.items()) + ")(?![a-z0-9])"
    to = F.create_map(*(x for t, ks in keys.items() for x in (F.lit(t), F.array(*(F.struct(F.lit(k).alias("template"), F.lit(len(_STATED[k])).alias("n")) for k in ks)))))
    rows = texts.where(F.lower(F.col(text)).rlike(some)).select(*_text_key(F.col(text)), _terms(F.col(text)).alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), F.when(x.isin(*keys), F.element_at(to, x)).alias("to"))), lambda h: h["to"].isNotNull())
    each = F.flatten(F.transform(hits, lambda h: F.transform(h["to"], lambda t: F.struct(h["i"].alias("i"), t["template"].alias("template"), t["n"].alias("n")))))
    around = lambda e: F.slice("w", F.greatest(e["i"] + 2 - e["n"], F.lit(1)), F.least(e["i"], e["n"] - 1) + e["n"])
    pieces = F.array_distinct(F.transform(each, lambda e: F.struct(e["template"].alias("template"), F.array_join(around(e), "\x20").alias("piece"))))
    found = cut(rows.select("h1", "h2", F.explode(pieces).alias("p")).select("h1", "h2", "p.template", "p.piece"), "pieces")
    known = F.create_map(*(F.lit(x) for k, v in _IDF.items() for x in (k, v)))
    each = found.select("template", "piece").distinct().withColumn("w", F.split("piece", "\x20"))
    each = each.withColumn("idf", F.transform("w", lambda x: F.coalesce(F.element_at(known, x), F.lit(_OTHER))))
    both = each.join(F.broadcast(templates(spark)), "template").withColumn("part", F.zip_with("w", "idf", lambda x, y: F.coalesce(F.element_at("weights", x), F.lit(0.0)) * y))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    run = lambda c, at: F.slice(c, at, F.col("length"))

    lacks = F.greatest(F.col("length") - F.size("w"), F.lit(0)) * _OTHER**2

    def cosine(at: Column) -> Column:
        # the sums of all places bound those of first places, which are counted only where the bound leaves a chance
        chance = total(run("part", at)) >= least * F.col("norm") * F.sqrt(total(F.transform(run("idf", at), lambda y: y * y)) + lacks) - 1e-9
        first = F.transform(run("w", at), lambda x, i: F.array_position(run("w", at), x) == i + 1)
        dot = total(F.zip_with(first, run("part", at), lambda f, x: F.when(f, x).otherwise(0.0)))
        norm = F.sqrt(total(F.zip_with(first, run("idf", at), lambda f, y: F.when(f, y * y).otherwise(_OTHER**2))) + lacks)
        return F.when(chance, dot / (F.col("norm") * norm))

    places = F.sequence(F.lit(1), F.greatest(F.size("w") - F.col("length") + 1, F.lit(1)))
    cosines = both.select("template", "piece", "license", F.array_max(F.transform(places, cosine)).alias("score")).where(F.col("score") >= least)
    best = found.join(cosines, ["template", "piece"]).groupBy("h1", "h2").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "license")).alias("b"))
    return best.select("h1", "h2", F.col("b.license").alias("license"), F.round(-F.col("b.s"), 6).alias("score"))


def matches(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST) -> DataFrame:
    """(path, license, score): the best licence that the texts of each path state (see `stated`), for paths with any.

    A null path or text states nothing; rows that repeat a path count together; other columns are not carried, whatever their names.
    """
    rows = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(text).alias("text"))
    found = rows.select("path", *_text_key(F.col("text"))).join(cut(stated(rows, "text", least), "stated"), ["h1", "h2"])
    best = found.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def is_licence_file(path: Column) -> Column:
    """Whether a path's last part is the name of a licence file. A null path is none."""
    return F.coalesce(F.regexp_extract(path, "[^/]*$", 0).rlike(r"(?i)^(un)?licen[cs]e([._-].*)?$|^copying([._-].*)?$"), F.lit(False))


def inherited(files: DataFrame, own: DataFrame, grants: DataFrame) -> DataFrame:
    """The columns of files and license, score and origin: each file's own licence (own: path, license, score), else that of the nearest
    directory above it.

    grants (directory, license): what a directory's licence file says; of several the first by name. Directories, not files, are joined with
    their ancestors; a file then takes what its directory has. Files without any have nulls and origin `none`; null paths too. Columns of files
    with the names of the three added ones are replaced, others stay, whatever their names; repeated files stay.
    """
    keep = [c for c in files.columns if c not in ("license", "score", "origin")]
    dirs = files.select(directory(F.col("path")).alias("directory")).where("directory is not null").distinct()
    parts = F.split("directory", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))
    grants = grants.groupBy(F.col("directory").alias("above")).agg(F.min("license").alias("granted"))
    nearest = dirs.select("directory", F.explode(up).alias("u")).select("directory", "u.depth", "u.above").join(grants, "above").groupBy("directory")
    nearest = nearest.agg(F.max_by("granted", "depth").alias("__granted"), F.max_by("above", "depth").alias("__above")).withColumnRenamed("directory", "__directory")
    rows = files.select(*(F.col(f"`{c}`") for c in keep), F.col("path").alias("__path"), directory(F.col("path")).alias("__directory"))
    mine = own.groupBy(F.col("path").alias("__path")).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("__own"))
    both = rows.join(mine, "__path", "left").join(nearest, "__directory", "left")
    origin = F.when(F.col("__own").isNotNull(), "own").when(F.col("__granted").isNotNull(), F.concat(F.lit("directory:"), "__above")).otherwise("none")
    return both.select(*(F.col(f"`{c}`") for c in keep), F.coalesce("__own.license", "__granted").alias("license"), (-F.col("__own.s")).alias("score"), origin.alias("origin"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, path, license, score and origin of each document.

    A document's path is that of its column `path`, if there is one; else, or where it is null, its source and id. One without either has no path, and
    its own licence only. A directory's licence is that of its licence files, which are told by their names: where no document has such a name, none inherits.
    """
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.col("doc_id").cast("string")))
    files = docs.select("doc_id", (F.coalesce("path", path) if "path" in docs.columns else path).alias("path"), "text")
    own = cut(stated(files), "licences")
    named = cut(files.select("doc_id", "path", *_text_key(F.col("text"))).join(own, ["h1", "h2"], "left").select("doc_id", "path", "license", "score"), "named")
    said = named.where("license is not null and path is not null")
    grants = said.where(is_licence_file(F.col("path"))).select(directory(F.col("path")).alias("directory"), "license")
    with_path = inherited(named.where("path is not null").select("doc_id", "path"), said, grants)
    without = named.where("path is null").select("doc_id", "path", "license", "score", F.when(F.col("license").isNotNull(), "own").otherwise("none").alias("origin"))
    return with_path.select("doc_id", "path", "license", "score", "origin").unionByName(without)

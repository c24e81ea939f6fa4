"""Licence statements among names, years, comment marks, line ends and prose."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import licenses

PROSE = "the quick brown fox jumps over many lazy dogs while nobody watches " * 40
STATED = {
    "a": ("Apache-2.0", "Copyright 2021 Jane Doe. Licensed under the Apache License, Version 2.0"),
    "b": ("MIT", "Foobar is released under the MIT License"),
    "c": ("GPL-3.0", "Foobar by Jane Doe, 2021. This work is licensed under the GNU General Public License, version 3"),
    "d": ("MIT", f"{PROSE} released under the MIT License {PROSE}"),
    "e": ("BSD-3-Clause", "# Copyright (c) 2019, Foo\n#\n# Redistribution and use in source and binary\n# forms, with or without modification, are permitted\n# provided that the following conditions are met:\n"),
    "f": ("MIT", "/*\n * Permission is hereby granted, free of charge, to any\n * person obtaining a copy of this software and\n * associated documentation files (the \"Software\")\n */"),
    "g": (None, "All rights reserved."),
    "h": (None, f"{PROSE} her licence to drive was public {PROSE}"),
}


def test_headers(spark):
    files = spark.createDataFrame([(k, v[1]) for k, v in STATED.items()], "path string, text string")
    got = {r.path: r.license for r in licenses.matches(files).collect()}
    assert {k: got.get(k) for k in STATED} == {k: v[0] for k, v in STATED.items()}


def terms(x):
    return [t for t in re.split(r"[^a-z0-9.+-]+|[.]+(?=[^a-z0-9]|$)", x.lower()) if t and t not in licenses.STOP]


def best_of(text):
    """Every run of every template's length, without any filter."""
    said = [(name, terms(x)) for name, x in licenses.TEMPLATES]
    df = Counter(t for _, x in said for t in set(x))
    idf = lambda t: math.log((len(said) + 1) / (df.get(t, 0) + 1)) + 1
    vector = lambda ws: {t: idf(t) for t in ws}
    w, best = terms(text), (0.0, "")
    for name, x in said:
        a = vector(x)
        for i in range(max(1, len(w) - len(x) + 1)):
            b = vector(w[i : i + len(x)])
            lacks = (max(0, len(x) - len(w)) + len(w[i : i + len(x)]) - len(b)) * (math.log(len(said) + 1) + 1) ** 2
            dot = sum(v * b.get(t, 0) for t, v in a.items())
            norm = math.sqrt(sum(v * v for v in a.values()) * (sum(v * v for v in b.values()) + lacks))
            cos = dot / norm if norm else 0.0
            if cos >= licenses.LEAST and (round(cos, 9), -ord(name[0])) > (round(best[0], 9), -ord(best[1][0]) if best[1] else -999):
                best = (cos, name)
    return best[1] or None, round(best[0], 6) or None


def test_against_all_runs(spark, docs):
    """The keys miss nothing: cosines over all runs of words of whole texts, in plain Python."""
    rows = docs.select("doc_id", "text").where("length(text) < 3000").limit(60).unionByName(docs.where("text ilike '%licen%' and length(text) < 20000").select("doc_id", "text"))
    mixed = [(900_000 + i, x) for i, x in enumerate(["files modify published terms general work", "the MIT one License under", "Obtain a copy of compliance except this file with you may not use except in the apache.org license-2.0 of 7"])]
    rows = rows.unionByName(spark.createDataFrame([*mixed, *((910_000 + i, v[1][-900:]) for i, v in enumerate(STATED.values()))], rows.schema))
    got = {r.path: (r.license, r.score) for r in licenses.matches(rows.select(F.col("doc_id").cast("string").alias("path"), "text")).collect()}
    for r in rows.collect():
        want = best_of(r.text or "")
        assert got.get(str(r.doc_id), (None, None)) == want, (r.doc_id, (r.text or "")[:200])


def test_rows_without_ids_and_licence_files(spark):
    rows = spark.createDataFrame(
        [(None, "Released under the MIT License", "web", 1.5), (None, None, None, None), (7, "Released under the MIT License", "web", 2.0), (8, "prose", "web", None), (8, "prose", "web", None)],
        "doc_id long, text string, source string, score double",
    )
    got = sorted(((r.doc_id or 0, r.license, r.origin) for r in licenses.report(rows).collect()), key=str)
    assert got == [(0, "MIT", "own"), (0, None, "none"), (7, "MIT", "own"), (8, None, "none"), (8, None, "none")]
    files = spark.createDataFrame([("a/LICENSE.txt", "x"), ("a/b/license_holders.py", "x"), ("a/b/COPYING", "x"), (None, "x")], "path string, license string")
    assert [r[0] for r in files.coalesce(1).select(licenses.is_licence_file(F.col("path"))).collect()] == [True, True, True, False]
    own = spark.createDataFrame([("a/LICENSE.txt", "MIT", 1.0)], "path string, license string, score double")
    out = licenses.inherited(files, own, own.select(licenses.directory(F.col("path")).alias("directory"), "license"))
    assert sorted((r.path or "", r.license, r.origin) for r in out.collect()) == [("", None, "none"), ("a/LICENSE.txt", "MIT", "own"), ("a/b/COPYING", "MIT", "directory:a"), ("a/b/license_holders.py", "MIT", "directory:a")]


def test_documents_with_paths_inherit(spark):
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    rows = [(1, mit, "web", "a/LICENSE"), (2, "prose", "web", "a/b/c.py"), (3, apache, "web", "a/b/d.py"), (4, "prose", "web", "z.py"), (5, "prose", "web", None), (None, "prose", None, "a/e.py"), (None, mit, None, None), (6, apache, "web", "a/d/COPYING"), (7, None, "web", "a/d/x/y.py")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, path string")
    got = sorted(((r.doc_id or 0, r.path, r.license, r.origin) for r in licenses.report(docs).collect()), key=str)
    want = [(0, "a/e.py", "MIT", "directory:a"), (0, None, "MIT", "own"), (1, "a/LICENSE", "MIT", "own"), (2, "a/b/c.py", "MIT", "directory:a"), (3, "a/b/d.py", "Apache-2.0", "own")]
    assert got == sorted([*want, (4, "z.py", None, "none"), (5, "web/5", None, "none"), (6, "a/d/COPYING", "Apache-2.0", "own"), (7, "a/d/x/y.py", "Apache-2.0", "directory:a/d")], key=str)

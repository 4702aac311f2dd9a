"""License texts in documents: MinHash bands over overlapping windows, then exact containment.

Everything is a DataFrame expression. Words are runs of letters and digits in lower case. A template's set is
its 5-word shingles; a template of fewer words is one shingle of that many. Templates of about the same size
share windows: with room for ``c`` shingles, windows of ``c + c/2`` shingles start every ``c/2`` shingles, so each
place where a template can stand lies whole in a window. A window that holds the share ``PERCENT`` of a template
has a Jaccard similarity of at least ``least_similarity`` with it; one-row bands are so many that
such a window is missed with a probability below ``MISS``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, written

WORDS = 5
PERCENT = 75
MISS = 1e-6
#: Templates are a stated list, whose shingles are written into the plan; longer lists go in blocks.
BLOCK_SHINGLES = 4_000

#: Notices by which works state their license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "all-rights-reserved": "All rights reserved.",
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(hashes: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` word hashes, in order."""
    return F.when(
        F.size(hashes) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(hashes) - size),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def room(n: int) -> int:
    """The least of 1, 2, 3, 4, 6, 8, 12, 16, 24, … that is ``n`` or more."""
    size = 1
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 and size > 1 else (size // 3 * 4 if size > 2 else size + 1)
    return size


def stride(c: int) -> int:
    return max(1, c // 2)


def least_similarity(c: int, n: int, percent: int = PERCENT) -> float:
    """Of a window with room for ``c`` and a template of ``n`` shingles that it holds to ``percent``."""
    held = -(-percent * n // 100)
    return held / (c + stride(c) + n - held)


def bands(similarity: float, miss: float = MISS) -> int:
    """So many one-row bands that two sets of this similarity share none with a probability below ``miss``."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


def _signature(shingled: Column, size: int) -> Column:
    """MinHashes ``0 … size - 1``."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.array_min(F.transform(shingled, lambda x: F.xxhash64(x, j)))
    )


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, int, list[int]]]:
    """``(name, shingle length, distinct shingles)`` of a stated list; templates without words are left out."""
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in templates.items()])
    rows = spark.range(1).select(F.inline(listed)).withColumn("h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)))
    cut = F.when(F.size("h") >= WORDS, shingles(F.col("h"), WORDS))
    for k in range(1, WORDS):
        cut = cut.when(F.size("h") == k, shingles(F.col("h"), k))
    found = rows.where(F.size("h") > 0).select("name", F.least(F.size("h"), F.lit(WORDS)).alias("k"), F.array_distinct(cut).alias("set"))
    return [(r.name, r.k, list(r.set)) for r in found.orderBy("name").collect()]


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ", ".join(f"bigint('{v}')" for v in values) + ")")


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, license, containment, start``: each document and template that a window of it contains.

    ``containment`` is the share of the template's shingles in the best window, at least ``percent`` / 100,
    and ``start`` the first word of the first such window. Null and blank texts contain nothing. Rows with
    equal keys, null ones too, give one result together. Without documents or templates the result is empty. Only
    windows that share a shingle with a template are given bands, as others contain nothing of it; the
    texts are not shuffled.
    """
    spark = docs.sparkSession
    listed = template_table(spark, TEMPLATES if templates is None else templates) if templates != {} else []
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    rows = settled(rows, h=F.transform(words(F.col("__text")), lambda w: F.xxhash64(w))).drop("__text")
    found = [_scan_block(rows, block, percent) for block in _blocks(listed)]
    if not found:
        return rows.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    best = F.struct(F.col("containment"), -F.col("start"))
    return out.groupBy("doc_id", "license").agg(F.max(best).alias("b")).select(
        "doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.col2")).alias("start")
    )


def _blocks(listed: list) -> list[list]:
    out: list[list] = []
    size = 0
    for item in listed:
        if not out or size + len(item[2]) > BLOCK_SHINGLES:
            out.append([])
            size = 0
        out[-1].append(item)
        size += len(item[2])
    return out


def _scan_block(rows: DataFrame, listed: list[tuple[str, int, list[int]]], percent: int) -> DataFrame:
    lengths = sorted({k for _, k, _ in listed})
    cut = settled(rows, **{f"s{k}": shingles(F.col("h"), k) for k in lengths}).drop("h")
    known = {k: sorted({s for _, j, own in listed if j == k for s in own}) for k in lengths}
    touched = F.lit(False)
    for k in lengths:
        touched = touched | F.arrays_overlap(f"s{k}", _longs(known[k]))
    cut = written(cut.where(touched), "license-candidates")

    groups: dict[tuple[int, int], list] = {}
    for name, k, own in listed:
        groups.setdefault((k, room(len(own))), []).append((name, own))
    out = None
    for (k, c), members in sorted(groups.items()):
        step, width = stride(c), c + stride(c)
        near = min(least_similarity(c, len(own), percent) for _, own in members)
        size = bands(near)
        own_shingles = sorted({s for _, own in members for s in own})
        starts = F.sequence(F.lit(0), F.size(f"s{k}") - 1, F.lit(step))
        windows = (
            cut.where(F.size(f"s{k}") > 0)
            .select("doc_id", F.explode(F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_distinct(F.slice(f"s{k}", i + 1, F.lit(width))).alias("own")))).alias("w"))
            .select("doc_id", "w.start", "w.own")
            .where(F.arrays_overlap("own", _longs(own_shingles)))
        )
        sets = F.array(*[F.struct(F.lit(n).alias("license"), _longs(own).alias("set")) for n, own in members])
        templates = rows.sparkSession.range(1).select(F.inline(sets)).withColumn("sig", _signature(F.col("set"), size))
        banded = templates.select("license", "set", F.posexplode("sig").alias("band", "value"))
        pairs = (
            windows.select("doc_id", "start", "own", F.posexplode(_signature(F.col("own"), size)).alias("band", "value"))
            .join(F.broadcast(banded), ["band", "value"])
            .withColumn("held", F.size(F.array_intersect("own", "set")))
            .where(100 * F.col("held") >= percent * F.size("set"))
            .select("doc_id", "license", (F.col("held") / F.size("set")).alias("containment"), "start")
        )
        out = pairs if out is None else out.union(pairs)
    return out

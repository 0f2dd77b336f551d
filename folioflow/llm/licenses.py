"""License scan: MinHash bands retrieve templates for text windows, exact shingle containment verifies.

Words are lower-case runs of letters and digits, shingles are pairs of words. For a template of n words
the windows are n words long and begin every n / 8 words, so neighbours overlap. A window's signature
is ``BANDS`` MinHash values, each a band of its own: a window whose Jaccard similarity with a template
is 0.5 meets it in some band with probability 1 - 0.5 ** BANDS > 0.9999. What meets is verified: at least
``CONTAINED`` of the template's shingles must stand in the window or one step beside it.

Scale: a window can only match if it has an anchor: each template's anchors are words that stand in more
than 1 - CONTAINED of its shingles (``anchors`` proves it), so windows without any are skipped without
loss and most texts never leave the scan's filter. Texts are cut into overlapping segments, a segment's
windows are made once each and carry their own words only, so time follows the length. Templates are a fixed table; matches are grouped by
document with at most one entry a template. No shuffle but that grouping's, of a row per document.

Native: DataFrame functions only. Defined cases: null and empty texts have no license; texts shorter than
a template are one window; a row keeps its extra columns, whatever their names and types; repeated rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table

#: Public license notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-program": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mit-notice": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software"
    ),
    "mpl-2.0-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
WORD = r"[\p{L}\p{N}]+"
BANDS = 16
CONTAINED = 0.8
SEGMENT = 1024  # words of a text that are looked at together
_COMMON = {"the", "of", "and", "or", "to", "in", "is", "a", "at", "by", "for", "this", "you", "under", "with", "without", "not", "be", "it", "any", "all", "can", "are", "use", "as"}
_P = "__lic_"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(words: list[str]) -> set[str]:
    """Words that stand in more than 1 - CONTAINED of the shingles: a match has one of them."""
    pairs = set(zip(words, words[1:], strict=False))
    chosen: set[str] = set()
    for w in sorted(set(words) - _COMMON, key=lambda w: (-len(w), w)) + sorted(set(words) & _COMMON):
        if sum(bool(chosen & set(p)) for p in pairs) > (1 - CONTAINED) * len(pairs):
            return chosen
        chosen.add(w)
    return chosen


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """name, n (words), step, shingles, m (their number)."""
    rows = []
    for name, text in templates.items():
        w = _words(text)
        shingles = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        rows.append((name, len(w), max(1, len(w) // 8), shingles, len(shingles)))
    return spark.createDataFrame(rows, f"{_P}name string, {_P}n int, {_P}step int, {_P}shingles array<string>, {_P}m int")


def _shingles(w: Column) -> Column:
    return F.array_distinct(F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>")))


def _signature(shingles: Column) -> Column:
    hashed = F.transform(shingles, lambda s: F.xxhash64(s))

    def least(h: Column, j: int) -> Column:
        return F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(j))))

    return F.element_at(F.transform(F.array(hashed), lambda h: F.array(*[least(h, j) for j in range(BANDS)])), 1)


def _segments(w: Column, before: int, after: int) -> Column:
    """The words in overlapping segments: base and the ``SEGMENT`` words from there on, with those around them from low on."""
    low = lambda j: F.greatest(j * SEGMENT - before, F.lit(0))
    one = lambda j: F.struct((j * SEGMENT).alias("base"), low(j).alias("low"), F.slice(w, low(j) + 1, F.lit(before + SEGMENT + after)).alias("words"))
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / SEGMENT).cast("int")), one)


def _windows(part: Column, spots: Column, n: int, step: int) -> Column:
    """The distinct windows of n words that begin in a segment and hold an anchor: n, b (the start) and beside,
    the words from one step before to one step behind it, of which own stand before the window."""
    base, low, words_ = part["base"], part["low"], part["words"]
    first = lambda p: F.greatest(F.ceil((p - (n - 1)) / step).cast("int") * step, F.ceil(base / step).cast("int") * step)
    last = lambda p: F.least(p, base + (SEGMENT - 1))
    every = lambda p: F.when(first(p) <= last(p), F.sequence(first(p), last(p), F.lit(step))).otherwise(F.array().cast("array<int>"))
    starts = F.array_distinct(F.flatten(F.transform(spots, every)))

    def window(b: Column) -> Column:
        own = F.least(b, F.lit(step))
        return F.struct(F.lit(n).alias("n"), b.alias("b"), own.alias("own"), F.slice(words_, b - own - low + 1, own + (n + step)).alias("beside"))

    return F.transform(starts, window)


def find_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` without the text, with licenses: an array of (name, contained, start word), by name. A column
    of ``docs`` with that name gives way to it."""
    spark = docs.sparkSession
    known = template_table(spark, templates)
    words_ = sorted(set().union(*[anchors(_words(t)) for t in templates.values()]))
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words_)})(?![\p{{L}}\p{{N}}])"
    rest = [c for c in docs.columns if c not in (text, "licenses")]
    nothing = F.expr("cast(array() as array<struct<name:string,contained:double,start:int>>)")
    carried = F.struct(F.lit(0).alias(f"{_P}pad"), *rest).alias(f"{_P}rest")
    lowered = docs.select(carried, F.lower(F.coalesce(F.col(text), F.lit(""))).alias(f"{_P}t"), F.monotonically_increasing_id().alias(f"{_P}row"))
    possible = F.col(f"{_P}t").rlike(pattern)
    back = [F.col(f"{_P}rest").getField(c).alias(c) for c in rest]

    kinds = sorted({(len(_words(t)), max(1, len(_words(t)) // 8)) for t in templates.values()})
    longest, widest = max((n for n, _ in kinds), default=1), max((s for _, s in kinds), default=1)
    worded = lowered.filter(possible).withColumn(f"{_P}w", F.regexp_extract_all(f"{_P}t", F.lit(WORD), F.lit(0)))
    parts = worded.select(f"{_P}rest", f"{_P}row", F.explode(_segments(F.col(f"{_P}w"), widest, longest + widest)).alias(f"{_P}s"))
    part = F.col(f"{_P}s")
    spots = F.filter(F.transform(part["words"], lambda x, i: F.when(x.isin(words_), i + part["low"])), lambda i: i.isNotNull())
    placed = parts.withColumn(f"{_P}p", spots)
    every = F.concat(*[_windows(part, F.col(f"{_P}p"), n, step) for n, step in kinds])
    starts = placed.select(f"{_P}rest", f"{_P}row", F.explode_outer(every).alias(f"{_P}x")).select(
        f"{_P}rest", f"{_P}row", *[F.col(f"{_P}x").getField(c).alias(f"{_P}{c}") for c in ("n", "b", "own", "beside")]
    )
    b, beside = F.col(f"{_P}b"), F.col(f"{_P}beside")
    signed = starts.withColumn(f"{_P}sig", _signature(_shingles(F.slice(beside, F.col(f"{_P}own") + 1, F.col(f"{_P}n")))))
    signed = signed.select(f"{_P}rest", f"{_P}row", f"{_P}n", f"{_P}b", f"{_P}beside", F.posexplode_outer(f"{_P}sig").alias(f"{_P}band", f"{_P}h"))
    bands = known.withColumn(f"{_P}sig", _signature(F.col(f"{_P}shingles"))).select("*", F.posexplode(f"{_P}sig").alias(f"{_P}band", f"{_P}h")).drop(f"{_P}sig")
    met = signed.join(F.broadcast(bands), [f"{_P}n", f"{_P}band", f"{_P}h"], "left")  # BANDS rows a template
    contained = F.size(F.array_intersect(f"{_P}shingles", _shingles(beside))) / F.col(f"{_P}m")
    verified = met.withColumn(f"{_P}c", F.when(F.col(f"{_P}name").isNotNull(), contained)).withColumn(f"{_P}hit", F.coalesce(F.col(f"{_P}c") >= CONTAINED, F.lit(False)))
    best = verified.groupBy(f"{_P}row", F.when(F.col(f"{_P}hit"), F.col(f"{_P}name")).alias(f"{_P}name")).agg(
        F.max(F.struct(F.col(f"{_P}c").alias("contained"), (-b).alias("start"))).alias(f"{_P}best"), F.first(f"{_P}rest").alias(f"{_P}rest")
    )
    entry = F.struct(F.col(f"{_P}name").alias("name"), F.col(f"{_P}best.contained").alias("contained"), (-F.col(f"{_P}best.start")).alias("start"))
    entry = F.when(F.col(f"{_P}name").isNotNull(), entry)
    found = best.groupBy(f"{_P}row").agg(F.array_sort(F.collect_list(entry)).alias("licenses"), F.first(f"{_P}rest").alias(f"{_P}rest"))  # at most one a template
    none = lowered.filter(~possible).select(*back, nothing.alias("licenses"))
    return found.select(*back, "licenses").unionByName(none)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses and their names of every row of ``documents``."""
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.name", ",").alias("licenses"))


OP2_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v.lower()}')" for k, v in TEMPLATES.items())}) AS v(name, txt)),
tw AS (SELECT name, regexp_extract_all(txt, '[\\p{{L}}\\p{{N}}]+') AS ws FROM t),
ts AS (SELECT DISTINCT name, len(ws) AS n, greatest(1, len(ws) // 8) AS step, ws[i] || ' ' || ws[i + 1] AS sh FROM (SELECT name, ws, unnest(range(1, len(ws))) AS i FROM tw)),
tm AS (SELECT name, count(*) AS m FROM ts GROUP BY name),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
h AS (SELECT rid, name, n, step, sh, p FROM (SELECT rid, i - 1 AS p, ws[i] || ' ' || ws[i + 1] AS sh FROM (SELECT rid, ws, unnest(range(1, len(ws))) AS i FROM d)) JOIN ts USING (sh)),
b AS (SELECT rid, name, sh, unnest(range(greatest(0, p + 2 - n - step) // step * step, p + step + 1, step)) AS b, p, n, step FROM h),
c AS (SELECT rid, name, b, count(DISTINCT sh) AS c FROM b WHERE b - step <= p AND p + 1 < b + n + step GROUP BY ALL),
f AS (SELECT DISTINCT rid, name FROM c JOIN tm USING (name) WHERE c >= {CONTAINED} * m),
g AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM f GROUP BY rid)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses FROM d LEFT JOIN g USING (rid)
"""

"""Licence scan: normalised lines against licence templates by the Dice coefficient over word bigrams, natively.

A line is normalised to lower-case ASCII words; its set of word bigrams is compared with each template's. Dice >= t
bounds the sizes: templates of m bigrams can only match lines of m*t/(2-t) to m*(2-t)/t bigrams. The templates are
expanded by the sizes that they can match into a table keyed by size (its length is bounded by the templates), so the
join on size prunes both lines and templates before any set is intersected.

Notices that are wrapped over lines or stand inside longer lines are found by windows of the text's words that run across
line breaks (``match_windows``). Every line that matches by itself counts; a window counts unless such lines hold half of
its words or a better window overlaps it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licence (SPDX identifier) and template text.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_bigrams(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def sizes(m: int, dice: float) -> range:
    """Sizes of bigram sets that can reach the Dice coefficient with one of m."""
    return range(max(1, math.ceil(m * dice / (2 - dice) - 1e-9)), math.floor(m * (2 - dice) / dice + 1e-9) + 1)


def template_table(spark: SparkSession, templates, dice: float) -> DataFrame:
    """(n_bigrams, candidates array<struct<template, license, m, bigrams>>): one row per size that some template can match."""
    by: dict[int, list] = {}
    for k, (name, text) in enumerate(templates):
        b = template_bigrams(text)
        for n in sizes(len(b), dice) if b else ():
            by.setdefault(n, []).append((k, name, len(b), b))
    return spark.createDataFrame(sorted(by.items()), "n_bigrams int, candidates array<struct<template:int,license:string,m:int,bigrams:array<string>>>")


def _words(template: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), template)).split()


def _least_shared(m: int, dice: float) -> int:
    """Bigrams that any set must share with a template of m to reach the Dice coefficient."""
    return max(1, math.ceil(m * dice / (2 - dice) - 1e-9))


def _telling_words(template: str, dice: float) -> list[str]:
    """Words of a template of which every match has at least one: too few bigrams are left without them."""
    left, need, out = set(template_bigrams(template)), _least_shared(len(template_bigrams(template)), dice), []
    for w in sorted(set(_words(template)), key=lambda w: (-len(w), w)):
        if len(left) < need:
            break
        left = {b for b in left if w not in b.split()}
        out.append(w)
    return out


def _bigrams(line: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " ")), " ")
    pairs = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))), 1)
    return F.array_distinct(pairs)


def match_lines(docs: DataFrame, templates=TEMPLATES, dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that match a template: (id, line int from 0, template int, license, dice). Of several templates the best counts, the first on ties."""
    spark = docs.sparkSession
    longest = max((len(template_bigrams(t)) for _, t in templates), default=0)
    most = max(sizes(longest, dice), default=0) if longest else 0
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")).alias("line", "raw"))
    # A line of more words than `most` bigrams allow may still repeat itself, so only the distinct bigrams count.
    sets = lines.select("id", "line", _bigrams(F.col("raw")).alias("b"))
    sets = sets.where(F.size("b").between(1, most)).withColumn("n_bigrams", F.size("b"))
    cand = sets.join(F.broadcast(template_table(spark, templates, dice)), "n_bigrams")
    scored = F.transform("candidates", lambda c: F.struct(c["template"].alias("template"), c["license"].alias("license"), (2.0 * F.size(F.array_intersect("b", c["bigrams"])) / (c["m"] + F.col("n_bigrams"))).alias("dice")))
    best = F.array_max(F.transform(F.filter(scored, lambda s: s["dice"] >= dice), lambda s: F.struct(s["dice"].alias("dice"), (-s["template"]).alias("t"), s["license"].alias("license"))))
    hits = cand.select("id", "line", best.alias("h")).where(F.col("h").isNotNull())
    return hits.select(F.col("id").alias(id_col), "line", (-F.col("h.t")).alias("template"), "h.license", "h.dice")


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: the optimizer copies nothing through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def match_windows(docs: DataFrame, templates=TEMPLATES, dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word windows that match a template: (id, windows array<struct<dice, n, t, first, last, license, at>>), where there are any.

    Line breaks are white space here. A window has as many words as the template up to (2 - dice) / dice times as many,
    and begins or ends with a bigram of the template; fewer words only where it is a run of whole lines, or the whole text.
    first and last number its words, at has the line of each. Of the windows around one bigram the best is given.
    """
    spark = docs.sparkSession
    known = [(k, name, b, len(_words(text)) - 1, _least_shared(len(b), dice)) for k, (name, text) in enumerate(templates) if (b := template_bigrams(text))]
    rows = [(k, name, len(b), b, n, math.floor(n * (2 - dice) / dice + 1e-9), need) for k, name, b, n, need in known]
    table = spark.createDataFrame(rows, "template int, license string, m int, bigrams array<string>, lo int, hi int, need int")
    if not rows:
        return docs.select(F.col(id_col)).withColumn("windows", F.array(F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit("").alias("license"), F.array(F.lit(0)).alias("at")))).where("false")
    telling = sorted({w for k, *_ in known for w in _telling_words(templates[k][1], dice)})
    every = sorted({b for _, _, bs, _, _ in known for b in bs})

    low = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    some = docs.select(F.col(id_col).alias("id"), low.alias("text")).where(F.col("text").rlike(f"(?<![a-z0-9])(?:{'|'.join(telling)})(?![a-z0-9])"))
    lines = F.transform(F.split(F.regexp_replace("text", "[^a-z0-9\n]+", " "), "\n"), lambda x: F.filter(F.split(x, " "), lambda w: w != ""))
    some = _held(some, "lines", lines).select("id", "lines", F.flatten("lines").alias("words"))
    some = _held(some, "w", F.col("words")).select("id", "w", F.flatten(F.transform("lines", lambda ws, i: F.array_repeat(i, F.size(ws)))).alias("at"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    some = _held(some, "b", pairs).drop("w").where("b is not null")
    hits = F.filter(F.transform("b", lambda b, i: F.when(b.isin(every), F.struct(i.alias("p"), b.alias("b")))), lambda h: h.isNotNull())
    some = _held(some, "hits", hits).where(F.size("hits") >= min(need for *_, need in known))

    # Candidates: (text, template) that share enough bigrams anywhere in the text.
    cand = some.withColumn("shared", F.array_distinct("hits.b")).crossJoin(F.broadcast(table))
    cand = cand.where(F.size(F.array_intersect("shared", "bigrams")) >= F.col("need")).drop("shared")
    cand = _held(cand, "p", F.transform(F.filter("hits", lambda h: F.array_contains("bigrams", h["b"])), lambda h: h["p"])).drop("hits")
    lo, hi, size = F.col("lo"), F.col("hi"), F.size("b")
    line_of = lambda i: F.element_at("at", i + 1)

    def ranges(p, i):
        """Bigram ranges [s, e) around the hit p, which is number i, and the hits near it."""
        near = F.slice("p", F.greatest(i + 1 - hi, F.lit(1)), 2 * hi + 1)
        fixed = F.array(F.struct(F.greatest(F.least(p, size - lo), F.lit(0)).alias("s"), F.least(F.greatest(p, F.lit(0)) + lo, size).alias("e")), F.struct(F.greatest(p + 1 - lo, F.lit(0)).alias("s"), F.least(F.greatest(p + 1, lo), size).alias("e")))
        longer = F.transform(F.filter(near, lambda q: (q + 1 - p > lo) & (q + 1 - p <= hi)), lambda q: F.struct(p.alias("s"), (q + 1).alias("e")))
        # Runs of whole lines that are shorter than the template, from the line of p on.
        start = F.array_position("at", line_of(p)).cast("int") - 1
        ends = F.array_distinct(F.transform(F.filter(near, lambda q: q >= p), lambda q: line_of(q + 1)))
        runs = F.transform(ends, lambda n: F.struct(start.alias("s"), (F.array_position("at", n).cast("int") - 2 + F.size(F.filter(F.slice("at", F.array_position("at", n).cast("int"), hi + 1), lambda x: x == n))).alias("e")))
        runs = F.filter(runs, lambda r: (r["e"] - r["s"] < lo) & (r["e"] - r["s"] >= F.col("need")))
        enough = lambda r: F.size(F.filter(near, lambda q: (q >= r["s"]) & (q < r["e"]))) >= F.col("need")
        found = F.filter(F.concat(fixed, longer, runs), enough)
        return F.when(F.size(near) >= F.col("need"), found)

    def scored(r):
        cut = lambda z: F.array_distinct(F.slice("b", r["s"] + 1, r["e"] - r["s"]))
        b = cut(r)
        value = 2.0 * F.size(F.array_intersect(b, F.col("bigrams"))) / (F.col("m") + F.size(b))
        return F.struct(value.alias("dice"), (r["e"] - r["s"]).alias("n"), (-F.col("template")).alias("t"), r["s"].alias("first"), r["e"].alias("last"))

    best = F.transform("p", lambda p, i: F.array_max(F.transform(ranges(p, i), scored)))
    cand = _held(cand, "best", F.array_distinct(F.filter(best, lambda x: x["dice"] >= dice))).where(F.size("best") > 0)
    full = F.transform("best", lambda x: F.struct(x["dice"].alias("dice"), x["n"].alias("n"), x["t"].alias("t"), x["first"].alias("first"), x["last"].alias("last"), F.col("license").alias("license"), F.slice("at", x["first"] + 1, x["n"] + 1).alias("at")))
    return cand.select(F.col("id").alias(id_col), full.alias("windows"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, dice: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that carries a licence: (id, licenses array<string> sorted, n_lines, best_dice).

    n_lines counts the lines that match and those on which a matching window begins. A null text has no lines; rows that
    repeat an id count as one document with the lines of all of them.
    """
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h")).alias("key"), F.col(text_col).alias("text"))
    windows = match_windows(keyed, templates, dice, "key", "text")
    lines = match_lines(keyed, templates, dice, "key", "text").select("key", F.struct("line", "license", "dice").alias("hit"), F.lit(None).cast(windows.schema["windows"].dataType).alias("windows"))
    both = lines.unionByName(windows.select("key", F.lit(None).cast(lines.schema["hit"].dataType).alias("hit"), "windows"))
    per = both.groupBy("key").agg(F.collect_set("hit").alias("hits"), F.flatten(F.collect_list("windows")).alias("windows"))
    mostly = lambda x: 2 * F.size(F.filter(x["at"], lambda n: F.array_contains(F.col("hits.line"), n))) >= F.size(x["at"])
    ranked = F.sort_array(F.filter("windows", lambda x: ~mostly(x)), asc=False)  # the best first
    none = F.slice("windows", 1, 0)
    per = _held(per, "ranked", ranked)
    taken = F.aggregate("ranked", none, lambda kept, x: F.when(F.exists(kept, lambda y: (x["first"] <= y["last"]) & (y["first"] <= x["last"])), kept).otherwise(F.concat(kept, F.array(x))))
    more = F.transform(taken, lambda x: F.struct(F.element_at(x["at"], 1).alias("line"), x["license"].alias("license"), x["dice"].alias("dice")))
    m = per.select(F.col("key.id").alias(id_col), F.explode(F.concat("hits", more)).alias("m")).select(id_col, "m.*")
    per = m.groupBy(id_col).agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.count_distinct("line").alias("n_lines"), F.max("dice").alias("best_dice"))
    return per.select(id_col, "licenses", "n_lines", "best_dice")

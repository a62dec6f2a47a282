"""Similarities that Spark has no expression for, as vectorised functions over Arrow batches."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from . import text as X


#: Shares of words and of characters from which on two headers name one section.
TOKENS, CHARACTERS = 0.25, 0.55


#: From this length of the second text on, characters that make up more than a hundredth of it start no common run, as in difflib.
LONG = 200


def _short_matches(a: str, b: str) -> int:
    """Characters in the common runs of two texts, the second a short one.

    All pairs of equal characters of a part are the bits of one number, a row of it per character of a: moved by a row and a
    bit and met with itself, it keeps the pairs that start a run of two, and so on; the lowest bit left is the longest run
    that is first in a, then in b.
    """
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    total, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        if ahi - alo == 1:
            total += b.find(a[alo], blo, bhi) >= 0
            continue
        if bhi - blo == 1:
            total += a.find(b[blo], alo, ahi) >= 0
            continue
        size = (bhi - blo) // 8 + 1
        part, full = a[alo:ahi], (1 << bhi - blo) - 1
        rows = {c: (at.get(c, 0) >> blo & full).to_bytes(size, "little") for c in set(part)}
        run = int.from_bytes(b"".join([rows[c] for c in part]), "little")
        if not run:
            continue
        step, k, halves = size * 8 + 1, 1, []
        while longer := run & run >> k * step:
            halves.append((k, run))
            run, k = longer, 2 * k
        for n, half in reversed(halves):
            if longer := run & half >> k * step:
                run, k = longer, k + n
        i, j = divmod((run & -run).bit_length() - 1, size * 8)
        i, j, total = i + alo, j + blo, total + k
        if alo < i and blo < j:
            parts.append((alo, i, blo, j))
        if i + k < ahi and j + k < bhi:
            parts.append((i + k, ahi, j + k, bhi))
    return total


def _long_matches(a: str, b: str) -> int:
    """The same for a long second text: runs start at its rare characters and grow by any."""
    most, at = len(b) // 100 + 1, {}
    for j, c in enumerate(b):
        at.setdefault(c, []).append(j)
    at = {c: js for c, js in at.items() if len(js) <= most}
    seeds = [i for i, c in enumerate(a) if c in at]
    total, parts = 0, [(0, len(a), 0, len(b))]
    while parts:
        alo, ahi, blo, bhi = parts.pop()
        x, y, k, last, ends = alo, blo, 0, -2, {}
        for i in seeds[bisect_left(seeds, alo) : bisect_left(seeds, ahi)]:
            before, ends = ends if i == last + 1 else {}, {}
            last, js = i, at[a[i]]
            for j in js[bisect_left(js, blo) : bisect_left(js, bhi)]:
                n = ends[j] = before.get(j - 1, 0) + 1
                if n > k:
                    x, y, k = i - n + 1, j - n + 1, n
        while x > alo and y > blo and a[x - 1] == b[y - 1]:
            x, y, k = x - 1, y - 1, k + 1
        while x + k < ahi and y + k < bhi and a[x + k] == b[y + k]:
            k += 1
        if k:
            total += k
            if alo < x and blo < y:
                parts.append((alo, x, blo, y))
            if x + k < ahi and y + k < bhi:
                parts.append((x + k, ahi, y + k, bhi))
    return total


def alike(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity, the very number that difflib's SequenceMatcher(None, a, b).ratio() gives."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 2.0 * (_short_matches if len(b) < LONG else _long_matches)(a, b) / (len(a) + len(b))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x or "", y or "") for x, y in zip(a, b, strict=True)])


def _sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:

    def one(x, y) -> int:
        x, y = ([] if v is None else list(v) for v in (x, y))
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], last if p == q else 1 + min(last, row[j - 1], row[j])
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def _bleu(reference: pd.Series, candidate: pd.Series) -> pd.Series:

    def one(r, c) -> float:
        r, c = ([] if v is None else list(v) for v in (r, c))
        total = 0.0
        for n in range(1, 5):
            grams = Counter(tuple(c[i : i + n]) for i in range(len(c) - n + 1))
            known = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            hit = sum(min(k, known[g]) for g, k in grams.items())
            if not hit:
                return 0.0
            total += math.log(hit / sum(grams.values())) / 4
        return math.exp(total) * (1.0 if len(c) > len(r) else math.exp(1 - len(r) / len(c)))

    return pd.Series([one(x, y) for x, y in zip(reference, candidate, strict=True)])


def ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings; nulls count as empty, two empty strings are alike."""
    return pandas_udf(_ratio, "double")(a, b)


def sequence_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays."""
    return pandas_udf(_sequence_distance, "int")(a, b)


def bleu(reference: Column, candidate: Column) -> Column:
    """BLEU of two token arrays over 1- to 4-grams of equal weight, without smoothing: an order without a match gives 0."""
    return pandas_udf(_bleu, "double")(reference, candidate)


def character_similarity(a: Column, b: Column) -> Column:
    """Of two headers as runs of letters and digits; 0 where either is empty."""
    x, y = X.squash(F.coalesce(a, F.lit(""))), X.squash(F.coalesce(b, F.lit("")))
    return F.when((x == "") | (y == ""), 0.0).otherwise(ratio(x, y))


def title_similarity(a: Column, b: Column) -> Column:
    x, y = X.title_key(F.coalesce(a, F.lit(""))), X.title_key(F.coalesce(b, F.lit("")))
    return F.when((x == "") | (y == ""), 0.0).otherwise(ratio(x, y))


def same_section(a: Column, b: Column, tokens: float = TOKENS, characters: float = CHARACTERS) -> Column:
    """Whether two headers name one section: by shared words or, where these are misread, by shared characters."""
    return (X.header_similarity(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))) >= tokens) | (character_similarity(a, b) >= characters)


def edit_ratio(pred: Column, gold: Column) -> Column:
    """Ratcliff-Obershelp similarity of the normalised answers."""
    return ratio(F.array_join(X.answer_tokens(pred), " "), F.array_join(X.answer_tokens(gold), " "))

"""Quality rules with adaptive thresholds, in DataFrame functions only.

Per document a few mergeable measures are computed from the whole text. Fixed cutoffs are replaced by cutoffs that are
derived from quantile sketches: every (lang, source) group gets a KLL sketch of each measure, built per partition and
merged; sketches also merge upwards to (lang) and to the whole corpus, for groups too small to speak for themselves. A
cutoff is a quartile plus a multiple of the quartile spread (with a least spread), so it follows each group's own habits
and rejects only what stands far outside of them. Documents then meet their group's cutoffs in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, without_ids, written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: measure -> (side, multiple of the spread, least spread)
MEASURES = {
    "symbol_share": ("high", 6.0, 0.03),
    "dup_line_share": ("high", 6.0, 0.10),
    "repeat_share": ("high", 6.0, 0.04),
    "mean_word": ("both", 6.0, 0.60),
}
#: A group needs so many documents to have cutoffs of its own.
LEAST_GROUP = 200
_WINDOW = 5


def _let(value: Column, body) -> Column:
    """body(value) with value computed once (a lambda variable, not an expression that is copied)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Maximal runs outside ASCII white space, in order."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Number of word positions inside 5-word windows that occur at least twice."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (_WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, _WINDOW)))

    def covered(hs: Column) -> Column:
        """From (hash, position) in order of hash: positions whose hash equals a neighbour's, as intervals of five words."""
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(hs) - 1
        flagged = lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"]))).alias("f"))), lambda x: F.coalesce(x["f"], F.lit(False))), lambda x: x["i"]))
        total = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(_WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(_WINDOW)))), F.lit(0), lambda a, x: a + x)
        return _let(pairs, lambda s: _let(flagged(s), total))

    counted = _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))
    return F.when(n < _WINDOW + 1, F.lit(0)).otherwise(counted)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column of the base counts of each whole text; a null text counts as one without words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    dup = _let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    per_word = _let(words_of(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeat_words(ws).cast("long").alias("n_repeat_words")))
    m = F.struct(
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        per_word.alias("w"),
    )
    name = fresh_name(docs, "measured")
    return docs.withColumn(name, m), name


def _flat(m: Column) -> list[Column]:
    return [m["w"]["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["n_dup_lines"].alias("n_dup_lines"), m["n_lines"].alias("n_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words")]


def _shares() -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {"symbol_share": ratio("n_symbols", "word_chars"), "dup_line_share": ratio("n_dup_lines", "n_lines"), "repeat_share": ratio("n_repeat_words", "n_words"), "mean_word": ratio("word_chars", "n_words")}


def thresholds(measured: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """(lang, source) -> lower and upper cutoff of each measure, from merged KLL sketches.

    Groups of fewer than least_group documents take the cutoffs of their language, languages of fewer those of the corpus.
    Sketches are compacted at random, so that two runs may differ in a cutoff by the sketch's error (0.4 % of rank).

    measured: lang, source and the base counts. Documents without words have no say. The result has a row per group.
    """
    rows = measured.where("n_words > 0").select("lang", "source", *[c.alias(k) for k, c in _shares().items()])
    fine = written(rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(k, F.lit(800)).alias(k) for k in MEASURES]))

    def level(keys: list[str], tag: str) -> DataFrame:
        g = fine.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k, F.lit(800)).alias(k) for k in MEASURES])
        return g.select(*keys, F.struct("n", *[_cut(k).alias(k) for k in MEASURES]).alias(tag))

    own = fine.select("lang", "source", F.struct("n", *[_cut(k).alias(k) for k in MEASURES]).alias("own"))
    by_lang, all_ = level(["lang"], "by_lang"), level([], "total")
    langs = by_lang.withColumnRenamed("lang", "lang_")
    out = own.join(langs, own["lang"].eqNullSafe(langs["lang_"]), "left").crossJoin(F.broadcast(all_))  # of one row
    chosen = F.when(F.col("own.n") >= least_group, F.col("own")).when(F.col("by_lang.n") >= least_group, F.col("by_lang")).otherwise(F.col("total"))
    return out.select("lang", "source", chosen.alias("cut"))


def _cut(k: str) -> Column:
    """struct(low, high) of a sketch column."""
    side, times, least = MEASURES[k]
    q = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double(F.col(k), F.array(F.lit(0.25), F.lit(0.75))))  # an empty sketch has no quantiles
    return _let(q, lambda x: F.struct(
        (F.element_at(x, 1) - times * F.greatest(F.element_at(x, 2) - F.element_at(x, 1), F.lit(least)) if side == "both" else F.lit(float("-inf"))).alias("low"),
        (F.element_at(x, 2) + times * F.greatest(F.element_at(x, 2) - F.element_at(x, 1), F.lit(least))).alias("high")))


def _verdict(shares: dict[str, Column], cut: Column) -> Column:
    ok = F.lit(True)
    for k, v in shares.items():
        ok = ok & F.coalesce((v >= cut[k]["low"]) & (v <= cut[k]["high"]), F.lit(True))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per input row: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Null texts count as empty: no words, base_failed. Null languages and sources form groups of their own. kept is false
    where base_failed, else true exactly if all measures lie within the cutoffs of the document's group.
    """
    with_m, name = measures(docs, text_col)
    flat = with_m.select(F.col(id_col).alias(id_col), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(name).alias("m"))
    flat = written(flat.select(id_col, "lang", "source", *_flat(F.col("m"))))
    cuts = thresholds(flat, least_group).select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "cut")
    out = flat.join(cuts, flat["lang"].eqNullSafe(cuts["lang_"]) & flat["source"].eqNullSafe(cuts["source_"]), "left")
    failed = base_failed()
    kept = F.when(failed, F.lit(False)).otherwise(_verdict(_shares(), F.col("cut")))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents that quality_report keeps, columns unchanged. Rows that repeat an id stay only if all of them are kept."""
    report = quality_report(docs, id_col=id_col, **how)
    drop = written(report.where(~F.col("kept")).select(F.col(id_col).alias("id")).distinct())
    return without_ids(docs, drop, id_col)

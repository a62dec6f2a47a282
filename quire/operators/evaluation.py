"""Scores of layouts, reading orders, texts, attachments and genres. DataFrame -> DataFrame."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as V
from ..functions import similarity as S
from ..functions import text as X
from . import layout as L
from .groups import per_group
from .scores import tau_of

#: Thresholds of average precision, and recalls at which precision is read.
IOUS = np.linspace(0.5, 0.95, 10)
RECALLS = np.linspace(0.0, 1.0, 101)
LEAST = (IOUS - 1e-10).tolist()


@lru_cache(1 << 16)
def _interpolated(hit: tuple[bool, ...], n_gold: int) -> float:
    """Average precision of predictions, best score first, of which the marked ones hit one of the gold boxes."""
    tp = np.cumsum(hit)
    recall, precision = tp / n_gold, tp / np.arange(1, len(hit) + 1)
    precision = np.maximum.accumulate(precision[::-1])[::-1]
    at = np.searchsorted(recall, RECALLS, side="left")
    return float(np.where(at < len(precision), np.append(precision, 0.0)[np.minimum(at, len(precision))], 0.0).mean())


def _hits(iou: list[list[float]], n_gold: int, least: float) -> tuple[bool, ...]:
    """Which predictions, best score first, take a gold box: each the free one that it overlaps most, if by `least`."""
    free, out = [True] * n_gold, []
    for row in iou:
        best, at = -1.0, -1
        for j, v in enumerate(row):
            if free[j] and v >= best:  # of equal overlaps the last
                best, at = v, j
        hit = at >= 0 and best >= least
        if hit:
            free[at] = False
        out.append(hit)
    return tuple(out)


def _iou(a: list[Sequence[float]], b: list[Sequence[float]]) -> list[list[float]]:
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    sizes, out = [size(q) for q in b], []
    for p in a:
        own, row = size(p), []
        for q, of in zip(b, sizes, strict=True):
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            inter = w * h if w > 0 and h > 0 else 0.0
            union = own + of - inter
            row.append(inter / union if union > 0 else 0.0)
        out.append(row)
    return out


def _aps(pred: list[Sequence[float]], scores: list[float], gold: list[Sequence[float]]) -> tuple[float, ...]:
    """Average precision of one class on one image by each of the thresholds; between two that no overlap parts it is the same."""
    if not pred:
        return (0.0,) * len(IOUS)
    order = sorted(range(len(pred)), key=lambda i: (scores[i] != scores[i], -scores[i] if scores[i] == scores[i] else 0.0))
    iou = _iou([pred[i] for i in order], gold)
    values = sorted(v for row in iou for v in row)
    out, below, ap = [], -1, 0.0
    for t in LEAST:
        n = bisect_left(values, t)
        if n != below:
            ap, below = _interpolated(_hits(iou, len(gold), t), len(gold)), n
        out.append(ap)
    return tuple(out)


@lru_cache(1 << 16)
def _means(per: tuple[tuple[float, ...], ...]) -> tuple[float, float, float]:
    out = np.mean(per, axis=0)
    return float(out.mean()), float(out[0]), float(out[5])


def _scored(pred: DataFrame, gold: DataFrame, page: str, ways: Sequence[str]) -> DataFrame:
    """(page, map, map_50, map_75) of each way in one pass over the pages: over all boxes as one class (""), or over the
    classes of a column, which then ends the names. A page with an empty side scores 0."""
    cols = ["x1", "y1", "x2", "y2"]
    by = [c for c in ways if c]
    score = lambda k: F.col("score").cast("double") if k else F.lit(0.0)
    side = lambda df, k: df.select(page, F.lit(k).alias("pred"), "label", *cols, score(k).alias("score"), *[c for c in by if c != "label"])
    names = [f"{m}_{c}" if c and c != "label" else m for c in ways for m in ("map", "map_50", "map_75")]

    def run(g: dict[str, np.ndarray]) -> dict[str, list]:
        box, is_pred, scores = list(zip(*[g[c].astype(np.float64).tolist() for c in cols], strict=True)), g["pred"].tolist(), g["score"].tolist()
        n_pred, got = sum(is_pred), []
        for c in ways:
            per: dict[str, tuple[list, list, list]] = {}
            of = g[c].tolist() if c else [""] * len(box)
            rows = range(len(box))
            for i in sorted(rows, key=lambda i: (box[i], scores[i])) if c and c != "label" else rows:
                p, s, q = per.setdefault(of[i], ([], [], []))
                (p if is_pred[i] else q).append(box[i])
                if is_pred[i]:
                    s.append(scores[i])
            known = sorted(k for k, (_, _, q) in per.items() if q)
            got += _means(tuple(_aps(*per[k]) for k in known)) if 0 < n_pred < len(box) else (0.0, 0.0, 0.0)
        return {m: [v] for m, v in zip(names, got, strict=True)}

    return per_group(side(pred, True).unionByName(side(gold, False)), page, ["pred", "label", *cols, "score", *[c for c in by if c != "label"]], run, ", ".join(f"{m} double" for m in names))


def average_precision(pred: DataFrame, gold: DataFrame, page: str = "page_id", by_class: bool = True) -> DataFrame:
    """(page, map, map_50, map_75): mean over the classes that the page's gold boxes have (or over all boxes as one class)
    and over IoU thresholds; one image at a time, so that a page is one small task. A page with an empty side scores 0."""
    return _scored(pred, gold, page, ["label" if by_class else ""])


def layout_scores(pred: DataFrame, gold: DataFrame, page: str = "page_id", pred_type: Column | None = None, gold_type: Column | None = None) -> DataFrame:
    """average_precision over boxes of one class, and, where a map of labels is given, per shared category type (map_cat...)."""
    if pred_type is None and gold_type is None:
        return _scored(pred, gold, page, [""])
    named = lambda df, c: df.withColumn("cat", F.col("label") if c is None else c)
    return _scored(named(pred, pred_type), named(gold, gold_type), page, ["", "cat"])


def _order_metrics(ranks: DataFrame, page: str, few: tuple[float, float, float]) -> DataFrame:
    """(page, n, edit, tau, bleu) of ranks (page, idx, gold, pred); `few` = (edit, tau, bleu) where fewer than two are ranked."""
    seq = ranks.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("gold", "pred"))).alias("m"), F.array_sort(F.collect_list(F.struct("pred", "gold"))).alias("q"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("idx", "gold", "pred")).alias("t"))
    g, p = F.transform(F.col("m.gold"), lambda x: x.cast("string")), F.transform(F.col("m.pred"), lambda x: x.cast("string"))
    out = seq.select(page, "n", (S.sequence_distance(F.col("m.pred"), F.col("m.gold")) / F.col("n")).alias("edit"), S.bleu(g, p).alias("bleu"), tau_of(F.col("t"), "idx", "gold", "pred").alias("tau"))
    pick = lambda c, v: F.when(F.col("n") < 2, F.lit(v)).otherwise(F.col(c)).alias(c)
    return out.select(page, "n", pick("edit", few[0]), pick("tau", few[1]), pick("bleu", few[2]))


def order_after_matching(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, page: str = "page_id") -> DataFrame:
    """Reading order of detected boxes: matched by IoU first. pred, gold: boxes with rank. Fewer than two matches: tau 0,
    and no edit distance or BLEU (null)."""
    m = L.match_by_iou(pred, gold, threshold, (page,))
    r = m.join(pred.select(page, F.col("idx").alias("i"), F.col("rank").alias("pred")), [page, "i"]).join(gold.select(page, F.col("idx").alias("j"), F.col("rank").alias("gold")), [page, "j"])
    scored = _order_metrics(r.select(page, F.col("j").alias("idx"), "gold", "pred"), page, (None, 0.0, None))
    pages = gold.select(page).union(pred.select(page)).distinct()
    return pages.join(scored, page, "left").select(page, F.coalesce("n", F.lit(0)).alias("matched"), "edit", F.coalesce("tau", F.lit(0.0)).alias("tau"), "bleu")


def order_on_gold(boxes: DataFrame, page: str = "page_id") -> DataFrame:
    """Reading order on the gold boxes themselves: (page, regions, edit, tau, bleu). boxes: label, gold and pred (ranks).
    What has no place in the order is left out and the rest ranked densely; fewer than two regions: 0, 1 and 0."""
    kept = boxes.where(V.in_reading_order(F.col("label")))
    dense = lambda c: F.row_number().over(Window.partitionBy(page).orderBy(c, "idx")) - 1
    ranks = kept.select(page, "idx", dense("gold").alias("gold"), dense("pred").alias("pred"))
    scored = _order_metrics(ranks, page, (0.0, 1.0, 0.0))
    out = boxes.select(page).distinct().join(scored, page, "left")
    return out.select(page, F.coalesce("n", F.lit(0)).alias("regions"), F.coalesce("edit", F.lit(0.0)).alias("edit"), F.coalesce("tau", F.lit(1.0)).alias("tau"), F.coalesce("bleu", F.lit(0.0)).alias("bleu"))


def token_counts(t: Column) -> Column:
    """map<token, count> of an answer's tokens."""
    words = F.array_sort(X.answer_tokens(t))
    distinct = F.array_distinct(words)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda w: F.size(F.filter(words, lambda x: x == w))))


def text_scores(pairs: DataFrame, keys: Sequence[str], pred: str, gold: str) -> DataFrame:
    """(keys, f1, edit_ratio) of two texts."""
    from .scores import token_f1

    f1 = token_f1(pairs, keys, pred, gold).select(*keys, "f1")
    return pairs.select(*keys, S.edit_ratio(F.col(pred), F.col(gold)).alias("edit_ratio")).join(f1, list(keys), "left").select(*keys, F.coalesce("f1", F.lit(0.0)).alias("f1"), "edit_ratio")


def attachment_status(cases: DataFrame) -> DataFrame:
    """cases with `status`, separation_pairs and separation_failures, and caption_correct.

    cases: visual_item, anchor, anchor_item, visual_article, anchor_article, foreign (array of articles of other blocks, null
    where unknown), wanted_figure and got_figure. The first that holds decides: the visual is unmatched, has no anchor, the
    anchor is unmatched, is in no article, the visual is in none; else both are in one article or not.
    """
    c = F.col
    status = (
        F.when(c("visual_item").isNull(), "visual_unmatched").when(c("anchor").isNull(), "anchor_missing").when(c("anchor_item").isNull(), "anchor_unmatched")
        .when(c("anchor_article").isNull(), "anchor_no_article").when(c("visual_article").isNull(), "no_article").when(c("visual_article") == c("anchor_article"), "correct").otherwise("wrong")
    )
    known = F.filter(F.coalesce("foreign", F.array().cast("array<long>")), lambda a: a.isNotNull())
    has = c("visual_article").isNotNull()
    return cases.withColumns({
        "status": status,
        "separation_pairs": F.when(has, F.size(known)).otherwise(0),
        "separation_failures": F.when(has, F.size(F.filter(known, lambda a: a == c("visual_article")))).otherwise(0),
        "caption_correct": F.when(c("wanted_figure").isNotNull() & c("visual_item").isNotNull(), c("wanted_figure").eqNullSafe(c("got_figure"))),
    })


def page_genres(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, page_no, page_type, expected, dominant, dominant_correct, any_correct, articles, articles_correct) of pages of
    a scored type.

    pages: (doc_id, page_no, page_type). articles: (doc_id, page_no, article, n, first_pos, genre): body items of an article on
    a page; the one with most items is dominant (ties: the first); articles without a genre have no say.
    """
    wanted = pages.withColumn("expected", V.expected_genres(F.col("page_type"))).where("expected is not null")
    g = articles.where("genre is not null")
    j = wanted.join(g, ["doc_id", "page_no"], "left").withColumn("right", F.array_contains("expected", F.col("genre")))
    out = j.groupBy("doc_id", "page_no", "page_type", "expected").agg(F.max_by("genre", F.struct("n", (-F.col("first_pos")).alias("k"))).alias("dominant"), F.coalesce(F.bool_or("right"), F.lit(False)).alias("any_correct"), F.count("genre").alias("articles"), F.count_if("right").alias("articles_correct"))
    return out.withColumn("dominant_correct", F.coalesce(F.array_contains("expected", F.col("dominant")), F.lit(False)))


def genre_rates(scored: DataFrame) -> DataFrame:
    """Overall, by page type and by document: counts and rates of page_genres, 0 where a denominator is 0."""
    g = scored.groupingSets([[], [F.col("page_type")], [F.col("doc_id")]], F.col("page_type"), F.col("doc_id")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("articles") == 0).alias("unclassified"), F.count_if("dominant_correct").alias("dominant_correct"), F.count_if("any_correct").alias("any_correct"), F.sum("articles").alias("articles"),
        F.sum("articles_correct").alias("articles_correct"), F.grouping_id().alias("g"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    name = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "page_type").otherwise("document")
    value = F.coalesce("page_type", F.col("doc_id").cast("string"), F.lit(""))
    coverage = F.when(F.col("pages") > 0, (F.col("pages") - F.col("unclassified")) / F.col("pages")).otherwise(0.0)
    return g.where("pages > 0").select(name.alias("dimension"), value.alias("value"), "pages", ratio("dominant_correct", "pages").alias("accuracy_dominant"), ratio("any_correct", "pages").alias("accuracy_any"), ratio("articles_correct", "articles").alias("article_accuracy"), coverage.alias("genre_coverage"))


def merged_tallies(parts: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Partial tallies added up: counts are sums, so that tallies of parts give the tally of the whole."""
    return parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])


def parsed_metrics(results: DataFrame) -> DataFrame:
    """(model, metric, value) of a benchmark's result file (model, json): the sample average of the edit distances of text
    blocks and reading order, else the page average; "NaN" and what is no number is missing."""
    out = None
    number = lambda path: F.nullif(F.expr(f"try_cast(get_json_object(json, '{path}') as double)"), F.lit(float("nan")))
    for section, metric in (("text_block", "odb_text_block_edit"), ("reading_order", "odb_reading_order_edit")):
        at = f"$.{section}.all.Edit_dist"
        one = results.select("model", F.lit(metric).alias("metric"), F.coalesce(number(f"{at}.edit_sample_avg"), number(f"{at}.ALL_page_avg")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.where("value is not null")

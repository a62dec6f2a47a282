"""Operators on page layouts: ordering, matching, assignment, clustering, assembly. All are DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X

Keys = Sequence[str]


def reading_order(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """Top-bottom order: rank from 0 by centroid (y, x), then idx."""
    w = Window.partitionBy(*page).orderBy((F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2, "idx")
    return boxes.withColumn("rank", F.row_number().over(w) - 1)


def anchored(values: Column, tolerance: float) -> Column:
    """Group numbers of an ascending array: a value opens a group if it exceeds the group's first value by more than tolerance."""
    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(s, v):
        new = s["a"].isNull() | (v - s["a"] > tolerance)
        g = F.when(new, s["g"] + 1).otherwise(s["g"])
        return F.struct(F.when(new, v).otherwise(s["a"]).alias("a"), g.alias("g"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def left_right_order(boxes: DataFrame, tolerance: float = 10.0, page: Keys = ("page_id",)) -> DataFrame:
    """Vertical bands of anchored left edges, each read top-down: (page, idx, band, rank from 0)."""
    per = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("x1", "idx", "y1"))).alias("m"))
    banded = per.withColumn("b", anchored(F.col("m.x1"), tolerance)).select(*page, F.explode(F.arrays_zip("m", "b")).alias("z"))
    flat = banded.select(*page, F.col("z.m.idx").alias("idx"), F.col("z.b").alias("band"), F.col("z.m.y1").alias("y1"))
    w = Window.partitionBy(*page).orderBy("band", "y1", "idx")
    return flat.select(*page, "idx", "band", (F.row_number().over(w) - 1).alias("rank"))


def greedy_match(pairs: DataFrame, by: Keys, descending: bool = True) -> DataFrame:
    """One-to-one assignment of candidate pairs (by..., i, j, s), best first: by s, ties to larger i and j (descending) or smaller (ascending)."""
    sign = -1 if descending else 1
    ordered = F.array_sort(F.collect_list(F.struct((F.col("s") * sign).alias("s"), (F.col("i") * sign).alias("i"), (F.col("j") * sign).alias("j"))))
    ints = F.array().cast("array<int>")
    start = F.struct(ints.alias("p"), ints.alias("q"), F.array().cast("array<struct<i:int,j:int,s:double>>").alias("out"))

    def step(acc, x):
        i, j = (x["i"] * sign).cast("int"), (x["j"] * sign).cast("int")
        free = ~F.array_contains(acc["p"], i) & ~F.array_contains(acc["q"], j)
        hit = F.array(F.struct(i.alias("i"), j.alias("j"), (x["s"] * sign).alias("s")))
        return F.when(free, F.struct(F.concat(acc["p"], F.array(i)).alias("p"), F.concat(acc["q"], F.array(j)).alias("q"), F.concat(acc["out"], hit).alias("out"))).otherwise(acc)

    per = pairs.groupBy(*by).agg(F.aggregate(ordered, start, step, lambda a: a["out"]).alias("m"))
    return per.select(*by, F.explode("m").alias("m")).select(*by, "m.i", "m.j", "m.s")


def iou_pairs(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, page: Keys = ("page_id",)) -> DataFrame:
    """Candidate pairs of a page with IoU >= threshold: (page, i of pred, j of gold, s)."""
    cols = ["x1", "y1", "x2", "y2"]
    p = pred.select(*page, F.col("idx").alias("i"), *[F.col(c).alias(f"p_{c}") for c in cols])
    g = gold.select(*page, F.col("idx").alias("j"), *[F.col(c).alias(f"g_{c}") for c in cols])
    touch = (F.col("p_x1") < F.col("g_x2")) & (F.col("g_x1") < F.col("p_x2")) & (F.col("p_y1") < F.col("g_y2")) & (F.col("g_y1") < F.col("p_y2"))
    both = p.join(g, list(page)).where(touch).withColumn("s", G.iou(G.box("p_"), G.box("g_")))
    return both.where(F.col("s") >= threshold).select(*page, "i", "j", "s")


def match_by_iou(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, page: Keys = ("page_id",)) -> DataFrame:
    return greedy_match(iou_pairs(pred, gold, threshold, page), page)


def match_captions(boxes: DataFrame, width: float = 1000.0, height: float = 1000.0, page: Keys = ("page_id",)) -> DataFrame:
    """Figures and captions of a page, one to one, cheapest first: (page, i figure, j caption, s cost)."""
    cols = ["x1", "y1", "x2", "y2"]
    side = lambda label, k, p: boxes.where(F.col("label") == label).select(*page, F.col("idx").alias(k), *[F.col(c).alias(f"{p}{c}") for c in cols])
    both = side("Figure", "i", "f_").join(side("Caption", "j", "c_"), list(page))
    cost = both.withColumn("s", G.caption_cost(G.box("f_"), G.box("c_"), F.lit(width), F.lit(height))).where(F.col("s").isNotNull())
    return greedy_match(cost.select(*page, "i", "j", "s"), page, descending=False)


def drop_duplicates(boxes: DataFrame, threshold: float = 0.95, page: Keys = ("page_id",)) -> DataFrame:
    """Boxes of a page, best score first, without those whose IoU with a kept one exceeds the threshold: (page, idx)."""
    cols = ["x1", "y1", "x2", "y2"]
    per = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "idx", *cols))).alias("m"))
    kept = F.array().cast("array<struct<s:double,idx:int,x1:double,y1:double,x2:double,y2:double>>")
    as_box = lambda x: tuple(x[c] for c in cols)
    fold = F.aggregate("m", kept, lambda acc, x: F.when(F.exists(acc, lambda k: G.iou(as_box(k), as_box(x)) > threshold), acc).otherwise(F.concat(acc, F.array(x))))
    return per.select(*page, F.explode(fold).alias("k")).select(*page, "k.idx")


def assign_words(words: DataFrame, boxes: DataFrame, min_overlap: float = 0.5, page: Keys = ("page_id",)) -> DataFrame:
    """Each word to at most one box: the smallest that holds its centre (ties: smaller idx), else the one that covers most
    of it if at least min_overlap (ties: larger idx). words: (page, word, x1..y2) -> (page, word, idx or null)."""
    cols = ["x1", "y1", "x2", "y2"]
    w = words.select(*page, "word", *[F.col(c).alias(f"w_{c}") for c in cols])
    b = boxes.select(*page, "idx", *cols)
    j = w.join(b, list(page), "left")
    cx, cy = (F.col("w_x1") + F.col("w_x2")) / 2, (F.col("w_y1") + F.col("w_y2")) / 2
    inside = (cx >= F.col("x1")) & (cx <= F.col("x2")) & (cy >= F.col("y1")) & (cy <= F.col("y2"))
    inter = G.intersection(G.box("w_"), G.box())
    enough = (G.area(G.box("w_")) > 0) & (inter >= min_overlap * G.area(G.box("w_")))
    hit = j.groupBy(*page, "word").agg(F.min(F.when(inside, F.struct(G.area(G.box()).alias("a"), "idx"))).alias("c"), F.max(F.when(enough, F.struct(inter.alias("a"), "idx"))).alias("o"))
    return hit.select(*page, "word", F.coalesce("c.idx", "o.idx").alias("idx"))


def column_gutters(words: DataFrame, gap: float, page: Keys = ("page_id",)) -> DataFrame:
    """Column number from 0 of each word: x-intervals within `gap` of each other share a column."""
    w = Window.partitionBy(*page).orderBy("x1", "x2", "word")
    far = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = words.withColumn("new", F.coalesce((F.col("x1") - far > gap).cast("int"), F.lit(0)))
    return opened.select(*page, "word", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("col"))


def sessionise(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """article: a headline opens one, what follows belongs to it; null before the first."""
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("category") == "Headline").cast("int")).over(w)
    return items.withColumn("article", F.when(n > 0, n))


def articles(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per article: first position, number of body items and characters, and its Markdown in order."""
    s = sessionise(items, doc).withColumn("md", X.markdown_line(F.col("category"), F.coalesce("text", F.lit(""))))
    body = F.col("md").isNotNull()
    g = s.where(F.col("article").isNotNull()).groupBy(doc, "article")
    lines = F.array_sort(F.collect_list(F.when(body, F.struct("pos", "md"))))
    return g.agg(F.min("pos").alias("first_pos"), F.count_if(body).alias("n_items"), F.sum(F.when(body, F.length("text"))).alias("n_chars"), F.concat(F.array_join(F.transform(lines, lambda x: x["md"]), "\n\n"), F.lit("\n")).alias("markdown"))


def anchors(boxes: DataFrame, visual: Sequence[str] = ("Figure", "Caption"), furniture: Sequence[str] = ("Header",), page: Keys = ("page_id",)) -> DataFrame:
    """Anchor of each visual: the nearest earlier block of the page that is neither visual nor furniture."""
    w = Window.partitionBy(*page).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    body = boxes.where(~F.col("label").isin(*furniture))
    back = F.last(F.when(~F.col("label").isin(*visual), F.col("idx")), ignorenulls=True).over(w)
    return body.withColumn("anchor", back).where(F.col("label").isin(*visual)).select(*page, "idx", "label", "anchor")


def carry_forward(rows: DataFrame, value: Column, name: str, by: Keys, order: Keys) -> DataFrame:
    """As-of: the last non-null value before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def merge_paragraphs(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Consecutive lines that continue each other become one: (doc, para, first_pos, n_lines, text)."""
    w = Window.partitionBy(doc).orderBy("pos")
    joins = F.coalesce(X.should_merge(F.lag("text").over(w), F.col("text")), F.lit(False))
    para = F.sum((~joins).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    g = lines.withColumn("joins", joins).withColumn("para", para - 1).groupBy(doc, "para")
    return g.agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("text"))


def best_by_iou(pred: DataFrame, gold: DataFrame, threshold: float = 0.9, page: Keys = ("page_id",)) -> DataFrame:
    """The gold box of greatest IoU of each predicted one (ties: smaller j), not one to one: (page, i, j, s)."""
    pairs = iou_pairs(pred, gold, threshold, page)
    return pairs.groupBy(*page, "i").agg(F.max_by("j", F.struct(F.col("s"), -F.col("j"))).alias("j"), F.max("s").alias("s"))


def caption_matches(boxes: DataFrame, width: float = 1000.0, height: float = 1000.0, page: Keys = ("page_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, figures without a caption, captions without a figure)."""
    m = match_captions(boxes, width, height, page)
    side = lambda label, k: unmatched(boxes.where(F.col("label") == label), m, k, page).select(*page, "idx")
    return m, side("Figure", "i"), side("Caption", "j")


def document_anchors(items: DataFrame, cross_page: bool = True) -> DataFrame:
    """(doc_id, pos, anchor, crosses): of each visual the nearest earlier body block that is none, on its page or, if
    cross_page, on the nearest earlier page that has one; crosses says which."""
    visual, furniture = F.col("category").isin("Figure", "Caption", "FigByline"), F.col("category").isin("Header", "Footer", "PageNum", "Abandon")
    by = ["doc_id"] if cross_page else ["doc_id", "page_no"]
    w = Window.partitionBy(*by).orderBy("page_no", "pos").rowsBetween(Window.unboundedPreceding, -1)
    back = F.last(F.when(~visual, F.struct("pos", "page_no")), ignorenulls=True).over(w)
    b = items.where(~furniture).withColumn("back", back).where(visual)
    return b.select("doc_id", "pos", F.col("back.pos").alias("anchor"), (F.col("back.page_no") != F.col("page_no")).alias("crosses"))


#: What stands inside a run of text without ending it.
FLOATS = ("Figure", "Caption", "FigByline", "Table", "Advertisement", "Abandon", "Header", "Footer", "PageNum", "Footnote", "MarginNote")


def merge_flow(items: DataFrame) -> DataFrame:
    """Paragraphs that continue each other as one: (doc_id, pos of the first, n, text, x1, y1, x2, y2).

    Floats are passed over, any other category ends the run. Halves are joined as by text.join_halves; boxes are united.
    """
    prose, floating = F.col("category") == "Paragraph", F.col("category").isin(*FLOATS)
    w = Window.partitionBy("doc_id").orderBy("pos")
    seg = items.withColumn("segment", F.count_if(~prose & ~floating).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(prose)
    v = Window.partitionBy("doc_id", "segment").orderBy("pos")
    joins = F.coalesce(X.should_merge(F.lag("text").over(v), F.col("text")), F.lit(False))
    para = F.sum((~F.col("joins")).cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0))
    g = seg.withColumn("joins", joins).withColumn("para", para).groupBy("doc_id", "segment", "para")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    out = g.agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"), texts.alias("t"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    text = F.aggregate(F.slice("t", 2, 1 << 20), F.element_at("t", 1), X.join_halves)
    return out.select("doc_id", "pos", "n", text.alias("text"), "x1", "y1", "x2", "y2")


def unmatched(boxes: DataFrame, matches: DataFrame, side: str, page: Keys = ("page_id",)) -> DataFrame:
    """Boxes that take part in no match."""
    return boxes.join(matches.select(*page, F.col(side).alias("idx")), [*page, "idx"], "left_anti")


def followed_figures(boxes: DataFrame, furniture: Sequence[str] = ("Header",), page: Keys = ("page_id",)) -> DataFrame:
    """Each caption with the figure before it, unless a body block stands between: (page, idx, figure)."""
    w = Window.partitionBy(*page).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(c, F.col("idx")), ignorenulls=True).over(w)
    visual = F.col("label").isin("Figure", "Caption")
    seen = boxes.select("*", last(F.col("label") == "Figure").alias("f"), last(~visual & ~F.col("label").isin(*furniture)).alias("b"))
    return seen.where(F.col("label") == "Caption").select(*page, "idx", F.when(F.col("f") > F.coalesce("b", F.lit(-1)), F.col("f")).alias("figure"))


def adjacent_articles(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Neighbouring articles in document order: (doc, article, first_pos, following)."""
    a = sessionise(items, doc).where("article is not null").groupBy(doc, "article").agg(F.min("pos").alias("first_pos"))
    nxt = F.lead("article").over(Window.partitionBy(doc).orderBy("first_pos"))
    return a.withColumn("following", nxt).where("following is not null")


def foreign_blocks(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """How many non-visual blocks of a page stand under another headline than each visual one: (page, idx, foreign).

    Counted as all of the page's less those of the own run, so that no pairs are made.
    """
    body = F.col("label").isin("Figure", "Caption") == F.lit(False)
    p = Window.partitionBy(*page)
    run = boxes.withColumn("run", F.count_if(F.col("label") == "Headline").over(p.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)))
    n = run.select(*page, "idx", body.alias("body"), (F.count_if(body).over(p) - F.count_if(body).over(Window.partitionBy(*page, "run"))).alias("foreign"))
    return n.where(~F.col("body")).drop("body")


def no_slivers(boxes: DataFrame, least: float = 2.0) -> DataFrame:
    """Without boxes narrower or lower than `least` pixels."""
    return boxes.where((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def inside(boxes: DataFrame, axis: int, start: float, end: float) -> DataFrame:
    """Boxes that lie in an interval of an axis (0: x, 1: y)."""
    low, high = (("x1", "x2"), ("y1", "y2"))[axis]
    return boxes.where((F.col(low) >= start) & (F.col(high) <= end))


def direction() -> Column:
    return F.when(F.col("x2") - F.col("x1") >= F.col("y2") - F.col("y1"), "horizontal").otherwise("vertical")


def region_shape(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """(page, direction, origin): direction of at least half of the blocks, least distance of a block to the page's origin."""
    flat = (direction() == "horizontal").cast("int")
    return boxes.groupBy(*page).agg(F.when(F.avg(flat) >= 0.5, "horizontal").otherwise("vertical").alias("direction"), F.min(F.sqrt(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1"))).alias("origin"))


def gutter_columns(words: DataFrame, page: Keys = ("page_id",), least: float = 4.0, share: float = 0.6) -> DataFrame:
    """words with `col`: the x-interval that holds the word's centre (else the first). Intervals are the page's merged word
    extents; they stay apart where the gap exceeds both `least` and `share` of the median height."""
    p = Window.partitionBy(*page)
    gap = words.withColumn("gap", F.greatest(F.lit(least), share * F.median(F.col("y2") - F.col("y1")).over(p)))
    spans = column_gutters_by(gap, page)
    spans = spans.groupBy(*page, "col").agg(F.min("x1").alias("left"), F.max("x2").alias("right"))
    held = words.join(spans.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("spans")), list(page))
    cx = (F.col("x1") + F.col("x2")) / 2
    at = F.filter(F.transform("spans", lambda s, i: F.when((s["left"] <= cx) & (cx <= s["right"]), i)), lambda i: i.isNotNull())
    return held.withColumn("col", F.coalesce(F.get(at, 0), F.lit(0))).drop("spans")


def column_gutters_by(words: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """column_gutters with each word's own `gap` column."""
    w = Window.partitionBy(*page).orderBy("x1", "x2", "word")
    far = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = words.withColumn("new", F.coalesce((F.col("x1") - far > F.col("gap")).cast("int"), F.lit(0)))
    return opened.withColumn("col", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def word_lines(words: DataFrame, tolerance: float = 2.0, page: Keys = ("page_id", "col")) -> DataFrame:
    """words with `line` from 0: a word opens a line if its top exceeds that of the line's first word by more than tolerance."""
    rest = [c for c in words.columns if c not in page]
    first = ["y1", "x1", "word"]
    per = words.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(*first, *[c for c in rest if c not in first]))).alias("m"))
    z = per.withColumn("b", anchored(F.col("m.y1"), tolerance)).select(*page, F.explode(F.arrays_zip("m", "b")).alias("z"))
    return z.select(*page, *[F.col(f"z.m.{c}").alias(c) for c in rest], F.col("z.b").alias("line")).select(*words.columns, "line")


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), f), 0)


def _median(values: Column) -> Column:
    def middle(s: Column) -> Column:
        n = F.size(s)
        mid = F.floor(n / 2).cast("int")
        return F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)

    return _bound(F.array_sort(values), middle)


def shared_baselines(lined: DataFrame, tolerance: float = 2.0, page: Keys = ("page_id", "col")) -> DataFrame:
    """lined words with `merged`: neighbouring lines whose median lower edges differ by at most tolerance are one; the
    running line's median is taken anew after each merge. A page's words are one row meanwhile, so that nothing is joined."""
    rest = [c for c in lined.columns if c not in page]
    per = lined.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("line", *[c for c in rest if c != "line"]))).alias("m"))
    per = per.withColumn("lines", F.array_distinct("m.line"))
    ys = lambda k: F.transform(F.filter("m", lambda x: x["line"] == k), lambda x: x["y2"])
    bottoms = F.transform("lines", lambda k: _bound(ys(k), lambda v: F.struct(v.alias("ys"), _median(v).alias("at"))))
    start = F.struct(F.array().cast("array<double>").alias("ys"), F.lit(None).cast("double").alias("at"), F.lit(-1).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        def joined(same):
            g = F.when(same, s["g"]).otherwise(s["g"] + 1)
            ys = F.when(same, F.concat(s["ys"], x["ys"])).otherwise(x["ys"])
            return F.struct(ys.alias("ys"), F.when(same, _median(F.concat(s["ys"], x["ys"]))).otherwise(x["at"]).alias("at"), g.alias("g"), F.concat(s["out"], F.array(g)).alias("out"))

        return _bound(F.coalesce((F.size(s["ys"]) > 0) & (F.abs(s["at"] - x["at"]) <= tolerance), F.lit(False)), joined)

    z = per.withColumn("b", F.aggregate(bottoms, start, step, lambda s: s["out"])).select(*page, "b", "lines", F.explode("m").alias("z"))
    merged = F.get("b", (F.array_position("lines", F.col("z.line")) - 1).cast("int"))
    return z.select(*page, *[F.col(f"z.{c}").alias(c) for c in rest], merged.alias("merged")).select(*lined.columns, "merged")


def words_text(words: DataFrame, page: Keys = ("page_id",), tolerance: float = 2.0) -> DataFrame:
    """(page, text): columns from left to right, lines from top to bottom, words by x; a newline between lines."""
    by = [*page, "col"]
    merged = shared_baselines(word_lines(gutter_columns(words, page), tolerance, by), tolerance, by)
    line = merged.groupBy(*by, "merged").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "line", "y1", "word", "text"))), lambda x: x["text"]), " ").alias("t"))
    return line.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "merged", "t"))), lambda x: x["t"]), "\n").alias("text"))


def merged_intervals(boxes: DataFrame, axis: int = 0, page: Keys = ("page_id",)) -> DataFrame:
    """(page, part, start, end, n): boxes' extents on an axis, merged where they overlap or touch, with their members."""
    low, high = (("x1", "x2"), ("y1", "y2"))[axis]
    w = Window.partitionBy(*page).orderBy(low, high, "idx")
    far = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = boxes.withColumn("far", far).withColumn("new", F.coalesce((F.col(low) > F.col("far")).cast("int"), F.lit(0)))
    grouped = flagged.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*page, "part").agg(F.min(low).alias("start"), F.max(high).alias("end"), F.count(F.lit(1)).alias("n"))


def projection(boxes: DataFrame, axis: int = 0, page: Keys = ("page_id",)) -> DataFrame:
    """(page, at, n): how many boxes cover each whole position of an axis, as a sweep over their ends: a row per stretch."""
    low, high = (("x1", "x2"), ("y1", "y2"))[axis]
    ends = boxes.select(*page, F.explode(F.array(F.struct(F.floor(low).alias("at"), F.lit(1).alias("d")), F.struct(F.floor(high).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy(*page, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*page).orderBy("at")
    return steps.select(*page, "at", F.lead("at").over(w).alias("until"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n")).where("until is not null")


def segments(profile: DataFrame, least: int = 0, gap: int = 1, page: Keys = ("page_id",)) -> DataFrame:
    """(page, start, end): stretches of a projection above `least`; holes wider than `gap` part them."""
    w = Window.partitionBy(*page).orderBy("at")
    high = profile.where(F.col("n") > least)
    new = F.coalesce((F.col("at") - F.lag("until").over(w) + 1 > gap).cast("int"), F.lit(0))
    s = high.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*page, "part").agg(F.min("at").alias("start"), F.max("until").alias("end")).drop("part")


def flat_minima(profile: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """(page, start, end, n): runs of equal counts of a projection that are lower than both neighbours."""
    w = Window.partitionBy(*page).orderBy("at")
    new = F.coalesce((F.col("n") != F.lag("n").over(w)).cast("int"), F.lit(0))
    runs = profile.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*page, "run").agg(F.min("at").alias("start"), F.max("until").alias("end"), F.min("n").alias("n"))
    v = Window.partitionBy(*page).orderBy("start")
    return runs.withColumns({"before": F.lag("n").over(v), "after": F.lead("n").over(v)}).where("before > n and after > n").select(*page, "start", "end", "n")


def segment_flags(boxes: DataFrame, indent: float = 20.0, page: Keys = ("page_id",)) -> DataFrame:
    """(page, idx, starts, ends): whether a block opens or closes a paragraph against its neighbours: it is indented against
    the block before, or stops short of the one after."""
    w = Window.partitionBy(*page).orderBy("idx")
    starts = F.coalesce(F.col("x1") - F.lag("x1").over(w) > indent, F.lit(True))
    ends = F.coalesce(F.lead("x2").over(w) - F.col("x2") > indent, F.lit(True))
    return boxes.select(*page, "idx", starts.alias("starts"), ends.alias("ends"))


def page_positions(items: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """items with reading_pos: their ordinal on the page from 0."""
    return items.withColumn("reading_pos", F.row_number().over(Window.partitionBy(*page).orderBy("rank", "idx")) - 1)


def heading_runs(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """boxes with `run`: how many headlines the page has had so far; regions without an order come last, in source order."""
    w = Window.partitionBy(*page).orderBy(F.col("order").asc_nulls_last(), "idx").rowsBetween(Window.unboundedPreceding, 0)
    return boxes.withColumn("run", F.count_if(F.col("label") == "Headline").over(w))


def chosen_order(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """boxes with rank from 0: by `order` where every box of the page has one, else by a backend's `guess` likewise, else by
    (y1, x1)."""
    p = Window.partitionBy(*page)
    full = lambda c: F.count(c).over(p) == F.count(F.lit(1)).over(p)
    keyed = boxes.withColumns({"by": F.when(full("order"), 0).when(full("guess"), 1).otherwise(2)})
    keyed = keyed.withColumn("sort_by", F.when(F.col("by") == 0, F.col("order")).when(F.col("by") == 1, F.col("guess")))
    return keyed.withColumn("rank", F.row_number().over(p.orderBy("sort_by", "y1", "x1", "idx")) - 1).drop("sort_by")


def permutation(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """(page, order array<int>): boxes' idx by `order`; null where a box has none."""
    g = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("order", "idx"))).alias("m"), F.count_if(F.col("order").isNull()).alias("missing"))
    return g.select(*page, F.when(F.col("missing") == 0, F.col("m.idx")).alias("order"))


def benchmark_order(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """(page, order array<int>): idx by `order`, those without one last by idx; null where none has one."""
    g = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("order", F.lit(1 << 30)).alias("o"), "idx"))).alias("m"), F.count("order").alias("n"))
    return g.select(*page, F.when(F.col("n") > 0, F.col("m.idx")).alias("order"))


def banded_order(boxes: DataFrame, line_height: float, line_width: float, page: Keys = ("page_id",)) -> DataFrame:
    """boxes with rank from 0: by rows of line_height, then columns of line_width, then distance to the origin."""
    w = Window.partitionBy(*page).orderBy(F.floor(F.col("y1") / line_height), F.floor(F.col("x1") / line_width), F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1"), "idx")
    return boxes.withColumn("rank", F.row_number().over(w) - 1)


def tiered_order(regions: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """regions with rank from 0: those with a median line rank by it, other regions of the flow by (y1, x1), the rest last."""
    tier = F.when(~F.col("in_flow"), 2).when(F.col("line_rank").isNull(), 1).otherwise(0)
    k = F.when(tier == 0, F.col("line_rank")).otherwise(F.col("y1"))
    w = Window.partitionBy(*page).orderBy(tier, k, F.when(tier == 0, 0.0).otherwise(F.col("x1")), "idx")
    return regions.withColumn("rank", F.row_number().over(w) - 1)


def resolved_order(given: DataFrame, boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """(page, idx, rank from 0) of an order given as (page, at, idx): unknown boxes and repeats are dropped."""
    known = given.join(boxes.select(*page, "idx").distinct(), [*page, "idx"], "left_semi").groupBy(*page, "idx").agg(F.min("at").alias("at"))
    return known.select(*page, "idx", (F.row_number().over(Window.partitionBy(*page).orderBy("at", "idx")) - 1).alias("rank"))


def neighbours(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """(page, idx, parent, previous, following): the smallest box that holds this one, and its nearest neighbours above and
    below among those that share its horizontal extent (any overlap)."""
    cols = ["x1", "y1", "x2", "y2"]
    o = boxes.select(*page, F.col("idx").alias("o"), *[F.col(c).alias(f"o_{c}") for c in cols])
    j = boxes.select(*page, "idx", *cols).join(o, list(page)).where("idx <> o")
    holds = (F.col("o_x1") <= F.col("x1")) & (F.col("o_y1") <= F.col("y1")) & (F.col("o_x2") >= F.col("x2")) & (F.col("o_y2") >= F.col("y2"))
    beside = G.axis_gap(F.col("x1"), F.col("x2"), F.col("o_x1"), F.col("o_x2")) < 0
    above, below = beside & (F.col("o_y2") <= F.col("y1")), beside & (F.col("o_y1") >= F.col("y2"))
    g = j.groupBy(*page, "idx").agg(
        F.min(F.when(holds, F.struct(G.area(G.box("o_")).alias("a"), "o"))).alias("p"),
        F.max(F.when(above, F.struct("o_y2", (-F.col("o")).alias("k")))).alias("u"),
        F.min(F.when(below, F.struct("o_y1", "o"))).alias("d"),
    )
    return boxes.select(*page, "idx").join(g.select(*page, "idx", F.col("p.o").alias("parent"), (-F.col("u.k")).alias("previous"), F.col("d.o").alias("following")), [*page, "idx"], "left")


def with_children(boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """Parents grown to the union with their children (and these' children): (page, idx, children, x1..y2); boxes with a
    parent are not listed. boxes: (page, idx, parent, x1..y2), parents one level deep after flattening."""
    top = boxes.select(*page, F.col("idx").alias("parent"), F.col("parent").alias("grand"))
    flat = boxes.join(top, [*page, "parent"], "left").withColumn("root", F.coalesce("grand", "parent", "idx"))
    g = flat.groupBy(*page, "root").agg(F.array_sort(F.collect_list(F.when(F.col("idx") != F.col("root"), F.col("idx")))).alias("children"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    return g.withColumnRenamed("root", "idx")


def order_by_match(boxes: DataFrame, gold: DataFrame, order: DataFrame, threshold: float = 0.3, page: Keys = ("page_id",)) -> DataFrame:
    """(page, idx, rank from 0): boxes in the order of the gold box that they overlap most, those without one last by idx.
    order: (page, j, order)."""
    best = best_by_iou(boxes, gold, threshold, page).select(*page, F.col("i").alias("idx"), "j").join(order, [*page, "j"])
    keyed = boxes.select(*page, "idx").join(best.select(*page, "idx", "order"), [*page, "idx"], "left")
    w = Window.partitionBy(*page).orderBy(F.coalesce("order", F.lit(1_000_000) + F.col("idx")), "idx")
    return keyed.select(*page, "idx", (F.row_number().over(w) - 1).alias("rank"))


def relabelled(pred: DataFrame, gold: DataFrame, threshold: float = 0.5, page: Keys = ("page_id",)) -> DataFrame:
    """(page, idx, text): predictions take the text of the gold box they are matched to, a sentinel where there is none."""
    m = match_by_iou(pred, gold, threshold, page).select(*page, F.col("i").alias("idx"), "j")
    named = m.join(gold.select(*page, F.col("idx").alias("j"), F.col("text").alias("gold_text")), [*page, "j"])
    return pred.select(*page, "idx").join(named.select(*page, "idx", "gold_text"), [*page, "idx"], "left").select(*page, "idx", F.coalesce("gold_text", X.stub(F.col("idx"), "__UNMATCHED")).alias("text"))


def match_scaled(items: DataFrame, annotations: DataFrame, sizes: DataFrame, threshold: float = 0.5, page: Keys = ("page_id",)) -> DataFrame:
    """match_by_iou of items against annotations that are first rescaled by each page's factors (page, fx, fy; 1 where missing)."""
    f = annotations.join(sizes, list(page), "left")
    k = {"x1": "fx", "x2": "fx", "y1": "fy", "y2": "fy"}
    return match_by_iou(items, f.select(*page, "idx", *[(F.col(c) * F.coalesce(F.col(s), F.lit(1.0))).alias(c) for c, s in k.items()]), threshold, page)


def line_metrics(lines: DataFrame, boxes: DataFrame, page: Keys = ("page_id",)) -> DataFrame:
    """(page, idx, height, width, n): mean size and number of the text lines (w_x1..w_y2) whose centre a block holds."""
    cx, cy = (F.col("w_x1") + F.col("w_x2")) / 2, (F.col("w_y1") + F.col("w_y2")) / 2
    held = cx.between(F.col("x1"), F.col("x2")) & cy.between(F.col("y1"), F.col("y2"))
    return lines.join(boxes, list(page)).where(held).groupBy(*page, "idx").agg(F.avg(F.col("w_y2") - F.col("w_y1")).alias("height"), F.avg(F.col("w_x2") - F.col("w_x1")).alias("width"), F.count(F.lit(1)).alias("n"))

"""Registered queries of scores and tallies, with their SQL twins where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as V
from ..functions import similarity as S
from ..operators import evaluation as E
from ..operators import layout as L
from ..operators import xycut
from ..operators.scores import kendall_tau
from ..sources import layouts as T
from ..sources.layouts import BOXES
from .registry import _r, query


def _ranked(spark, sf) -> tuple[DataFrame, DataFrame]:
    return L.reading_order(T.predicted(spark, sf)), L.reading_order(T.boxes(spark, sf))


def met02_edit_ratio(spark, sf):
    """Of each document with the next line of its own text: whole texts, no SQL twin (Ratcliff-Obershelp)."""
    p = T.next_lines(spark, sf, "gold")
    return p.select("doc_id", "pos", _r(S.edit_ratio(F.col("text"), F.col("gold"))).alias("ratio"))


@query(f"""WITH RECURSIVE {BOXES}, r AS (SELECT page_id, list(idx ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, idx) p, list(idx ORDER BY idx) g, CAST(count(*) AS INTEGER) n FROM boxes GROUP BY page_id),
d AS (SELECT page_id, p, g, n, 0 i, range(0, n + 1) row_ FROM r UNION ALL
  SELECT page_id, p, g, n, i + 1, list_reduce(list_prepend([CAST(i + 1 AS BIGINT)], list_transform(range(1, n + 1), lambda j: [j])), lambda acc, x: list_append(acc, least(acc[len(acc)] + 1, row_[x[1] + 1] + 1, row_[x[1]] + CASE WHEN p[i + 1] = g[x[1]] THEN 0 ELSE 1 END))) FROM d WHERE i < n)
SELECT page_id, CAST(row_[n + 1] AS INTEGER) distance FROM d WHERE i = n""")
def met04_sequence_distance(spark, sf):
    r = L.reading_order(T.boxes(spark, sf)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "idx"))).alias("m"), F.array_sort(F.collect_list("idx")).alias("g"))
    return r.select("page_id", S.sequence_distance(F.col("m.idx"), F.col("g")).alias("distance"))


def met07_bleu(spark, sf):
    r = L.reading_order(T.boxes(spark, sf)).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", "idx"))).alias("m"), F.array_sort(F.collect_list("idx")).alias("g"))
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    return r.select("page_id", _r(S.bleu(text(F.col("g")), text(F.col("m.idx")))).alias("bleu"))


def met08_average_precision(spark, sf):
    """Also MET-09: over all boxes as one class, and per shared category type."""
    p, g = T.predicted(spark, sf), T.boxes(spark, sf)
    s = E.layout_scores(p, g, "page_id", V.benchmark_type(F.col("label")), V.benchmark_type(F.col("label")))
    return s.select("page_id", *[_r(c).alias(c) for c in s.columns if c != "page_id"])


def met10_order_after_matching(spark, sf):
    p, g = _ranked(spark, sf)
    s = E.order_after_matching(p, g)
    return s.select("page_id", "matched", *[_r(c).alias(c) for c in ("edit", "tau", "bleu")])


def met11_order_on_gold(spark, sf):
    b = L.reading_order(T.boxes(spark, sf)).withColumnRenamed("rank", "pred").withColumn("gold", F.col("idx"))
    s = E.order_on_gold(b)
    return s.select("page_id", "regions", *[_r(c).alias(c) for c in ("edit", "tau", "bleu")])


@query("SELECT lang AS model, 'odb_text_block_edit' metric, round(avg(n_chars), 6) \"value\" FROM documents GROUP BY lang UNION ALL SELECT lang, 'odb_reading_order_edit', round(avg(doc_id), 6) FROM documents WHERE lang <> 'en' GROUP BY lang")
def met12_parsed_metrics(spark, sf):
    """A benchmark's result files: sample averages, page averages where these are "NaN", and metrics that are missing."""
    d = T.table(spark, sf, "documents").groupBy(F.col("lang").alias("model")).agg(F.avg("n_chars").alias("c"), F.avg("doc_id").alias("i"))
    nan = F.lit("NaN")
    edit = lambda sample, page: F.struct(F.struct(F.struct(sample.alias("edit_sample_avg"), page.alias("ALL_page_avg")).alias("Edit_dist")).alias("all"))
    text = edit(F.col("c").cast("string"), nan)
    order = edit(nan, F.when(F.col("model") != "en", F.col("i").cast("string")).otherwise(nan))
    raw = d.select("model", F.to_json(F.struct(text.alias("text_block"), order.alias("reading_order"))).alias("json"))
    return E.parsed_metrics(raw).select("model", "metric", _r("value").alias("value"))


_CASES = """c AS (SELECT page_id, idx, label, CASE WHEN k % 6 <> 0 THEN idx END visual_item, CASE WHEN k % 7 <> 0 THEN k END anchor, CASE WHEN k % 8 <> 0 THEN k END anchor_item,
 CASE WHEN k % 9 <> 0 THEN k % 3 END visual_article, CASE WHEN k % 10 <> 0 THEN k % 2 END anchor_article, [k % 3, NULL, k % 4] fr FROM boxes WHERE label IN ('Figure', 'Caption'))"""


@query(f"""WITH {BOXES}, {_CASES}, s AS (SELECT *, CASE WHEN visual_item IS NULL THEN 'visual_unmatched' WHEN anchor IS NULL THEN 'anchor_missing' WHEN anchor_item IS NULL THEN 'anchor_unmatched' WHEN anchor_article IS NULL THEN 'anchor_no_article' WHEN visual_article IS NULL THEN 'no_article' WHEN visual_article = anchor_article THEN 'correct' ELSE 'wrong' END status FROM c)
SELECT page_id, idx, status, CASE WHEN visual_article IS NULL THEN 0 ELSE 2 END separation_pairs, CASE WHEN visual_article IS NULL THEN 0 ELSE CAST(len(list_filter(fr, lambda a: a = visual_article)) AS INTEGER) END separation_failures FROM s""")
def met14_attachment_status(spark, sf):
    k = F.col("k").cast("long")
    v = T.boxes(spark, sf).where(F.col("label").isin("Figure", "Caption"))
    c = v.select(
        "page_id", "idx", F.when(k % 6 != 0, F.col("idx")).alias("visual_item"), F.when(k % 7 != 0, k).alias("anchor"), F.when(k % 8 != 0, k).alias("anchor_item"), F.when(k % 9 != 0, k % 3).alias("visual_article"),
        F.when(k % 10 != 0, k % 2).alias("anchor_article"), F.array(k % 3, F.lit(None).cast("long"), k % 4).alias("foreign"), F.lit(None).cast("int").alias("wanted_figure"), F.lit(None).cast("int").alias("got_figure"))
    return E.attachment_status(c).select("page_id", "idx", "status", "separation_pairs", "separation_failures")


_TYPES = ["Article", "News", "Interview", "Special", "Letters"]
_GENRE_SQL = f"""pg AS (SELECT doc_id % 200 doc_id, CAST(doc_id // 200 AS INTEGER) page_no, list_extract({_TYPES!r}, doc_id % 5 + 1) page_type FROM documents),
ar AS (SELECT doc_id % 200 doc_id, CAST(doc_id // 200 AS INTEGER) page_no, CAST(i AS BIGINT) article, CAST((doc_id + i) % 4 + 1 AS BIGINT) n, CAST(i AS INTEGER) first_pos, CASE (doc_id * 3 + i) % 6 WHEN 0 THEN 'članek' WHEN 1 THEN 'novice' WHEN 2 THEN 'intervju' WHEN 3 THEN 'pisma' END genre FROM documents, range(3) t(i)),
x AS (SELECT *, CASE page_type WHEN 'Article' THEN 'članek' WHEN 'News' THEN 'novice' WHEN 'Interview' THEN 'intervju' WHEN 'Letters' THEN 'pisma' END expected FROM pg),
sc AS (SELECT x.doc_id, x.page_no, page_type, expected, arg_max(genre, {{'n': n, 'k': -first_pos}}) FILTER (genre IS NOT NULL) dominant, coalesce(bool_or(genre = expected), false) any_correct, count(genre) articles, count(*) FILTER (genre = expected) articles_correct FROM x LEFT JOIN ar ON ar.doc_id = x.doc_id AND ar.page_no = x.page_no AND genre IS NOT NULL WHERE expected IS NOT NULL GROUP BY ALL)"""


def _genres(spark, sf) -> tuple[DataFrame, DataFrame]:
    d = T.table(spark, sf, "documents").select("doc_id")
    i = F.col("doc_id")
    page = [(i % 200).alias("doc_id"), F.floor(i / 200).cast("int").alias("page_no")]
    pages = d.select(*page, F.element_at(F.array(*map(F.lit, _TYPES)), (i % 5 + 1).cast("int")).alias("page_type"))
    a = d.withColumn("a", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    g = (i * 3 + F.col("a")) % 6
    genre = F.when(g == 0, "članek").when(g == 1, "novice").when(g == 2, "intervju").when(g == 3, "pisma")
    return pages, a.select(*page, F.col("a").cast("long").alias("article"), ((i + F.col("a")) % 4 + 1).cast("long").alias("n"), F.col("a").alias("first_pos"), genre.alias("genre"))


@query(f"WITH {_GENRE_SQL} SELECT doc_id, page_no, page_type, dominant, coalesce(dominant = expected, false) dominant_correct, any_correct, articles, articles_correct FROM sc")
def agg06_page_genres(spark, sf):
    """Also MET-15: pages of a type without an expected genre are not scored."""
    return E.page_genres(*_genres(spark, sf)).select("doc_id", "page_no", "page_type", "dominant", "dominant_correct", "any_correct", "articles", "articles_correct")


@query(f"""WITH {_GENRE_SQL}, f AS (SELECT *, coalesce(dominant = expected, false) dc FROM sc), g AS (SELECT grouping_id(page_type, doc_id) gi, page_type, doc_id, count(*) pages, count(*) FILTER (articles = 0) un, count(*) FILTER (dc) d, count(*) FILTER (any_correct) a, sum(articles) t, sum(articles_correct) c FROM f GROUP BY GROUPING SETS ((), (page_type), (doc_id)))
SELECT CASE gi WHEN 3 THEN 'overall' WHEN 1 THEN 'page_type' ELSE 'document' END dimension, coalesce(page_type, CAST(doc_id AS VARCHAR), '') AS "value", pages, round(d / pages, 6) accuracy_dominant, round(a / pages, 6) accuracy_any, round(coalesce(c / nullif(t, 0), 0.0), 6) article_accuracy, round((pages - un) / pages, 6) genre_coverage FROM g WHERE pages > 0""")
def agg08_genre_rates(spark, sf):
    r = E.genre_rates(E.page_genres(*_genres(spark, sf)))
    return r.select("dimension", "value", "pages", *[_r(c).alias(c) for c in ("accuracy_dominant", "accuracy_any", "article_accuracy", "genre_coverage")])


@query("SELECT lang, CAST(sum(n_chars) AS BIGINT) chars, count(*) n FROM documents GROUP BY lang")
def agg04_merged_tallies(spark, sf):
    """Tallies of parts (by language and source) added up to the tally by language."""
    parts = T.table(spark, sf, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    return E.merged_tallies(parts, ["lang"], ["chars", "n"])


@query(f"WITH {BOXES}, w AS (SELECT page_id, idx AS word, x1 + k % 40 AS x1, y1 + k % 40 - 10 AS y1, x1 + k % 40 + 24 AS x2, y1 + k % 40 AS y2, row_number() OVER (PARTITION BY page_id ORDER BY k, idx) line FROM boxes), i AS (SELECT b.page_id, b.idx, w.line FROM boxes b JOIN w USING (page_id) WHERE greatest(0.0, least(w.x2, b.x2) - greatest(w.x1, b.x1)) * greatest(0.0, least(w.y2, b.y2) - greatest(w.y1, b.y1)) >= 0.5 * (w.x2 - w.x1) * (w.y2 - w.y1)) SELECT page_id, idx, round(avg(line), 6) mean_rank, median(line) median_rank, count(*) n FROM i GROUP BY page_id, idx")
def agg11_line_ranks(spark, sf):
    from pyspark.sql import Window

    from ..functions import geometry as G
    from .registry import _words

    k = T.boxes(spark, sf).select("page_id", F.col("idx").alias("word"), "k")
    w = _words(spark, sf).join(k, ["page_id", "word"]).withColumn("line", F.row_number().over(Window.partitionBy("page_id").orderBy("k", "word")))
    w = w.select("page_id", "line", *[F.col(c).alias(f"w_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = w.join(T.boxes(spark, sf), "page_id").where(G.intersection(G.box("w_"), G.box()) >= 0.5 * G.area(G.box("w_")))
    return j.groupBy("page_id", "idx").agg(_r(F.avg("line")).alias("mean_rank"), F.median("line").alias("median_rank"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {BOXES}, w AS (SELECT page_id, idx AS word, x1 + k % 40 AS x1, y1 + k % 40 - 10 AS y1, x1 + k % 40 + 24 AS x2, y1 + k % 40 AS y2 FROM boxes) SELECT b.page_id, b.idx, round(avg(w.y2 - w.y1), 6) height, round(avg(w.x2 - w.x1), 6) width, count(*) n FROM boxes b JOIN w ON w.page_id = b.page_id AND (w.x1 + w.x2) / 2 BETWEEN b.x1 AND b.x2 AND (w.y1 + w.y2) / 2 BETWEEN b.y1 AND b.y2 GROUP BY b.page_id, b.idx")
def agg19_lines_per_block(spark, sf):
    from .registry import _words

    w = _words(spark, sf).select("page_id", *[F.col(c).alias(f"w_{c}") for c in ("x1", "y1", "x2", "y2")])
    return L.line_metrics(w, T.boxes(spark, sf)).select("page_id", "idx", _r("height").alias("height"), _r("width").alias("width"), "n")


def srt08_xy_cut(spark, sf):
    return xycut.xy_cut_order(T.boxes(spark, sf), "yx")


def srt09_enhanced_xy_cut(spark, sf):
    return xycut.xy_cut_order(T.boxes(spark, sf))


def met06_tau_of_xy_cut(spark, sf):
    """Agreement of the enhanced cut with the top-bottom order."""
    a = xycut.xy_cut_order(T.boxes(spark, sf)).select("page_id", "idx", F.col("rank").alias("a"))
    b = L.reading_order(T.boxes(spark, sf)).select("page_id", "idx", F.col("rank").alias("b"))
    return kendall_tau(a.join(b, ["page_id", "idx"]), ["page_id"], "idx", "a", "b").withColumn("tau", _r("tau"))

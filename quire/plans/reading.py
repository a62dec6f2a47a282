"""Registered queries of words to text, projections, orders and neighbours, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout as L
from ..sources import layouts as T
from ..sources.layouts import BOXES, PREDICTED
from .registry import _AREA, _iou, _r, _words, query

_RANKED = "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, idx) - 1 AS INTEGER) rank FROM boxes)"
#: Words of a page: three columns of boxes' corners, some sharing a baseline.
_TOKENS = "words AS (SELECT page_id, idx AS word, label AS text, CAST(k % 3 * 300 + idx * 7 AS DOUBLE) AS x1, CAST(k % 11 * 3 AS DOUBLE) AS y1, CAST(k % 3 * 300 + idx * 7 + 30 AS DOUBLE) AS x2, CAST(k % 11 * 3 + 10 + k % 2 AS DOUBLE) AS y2 FROM boxes)"


def _tokens(spark, sf) -> DataFrame:
    k, i = F.col("k"), F.col("idx")
    x, y = (k % 3 * 300 + i * 7).cast("double"), (k % 11 * 3).cast("double")
    return T.boxes(spark, sf).select("page_id", i.alias("word"), F.col("label").alias("text"), x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 10 + k % 2).alias("y2"))


_GUTTERS = f"""{_TOKENS}, g AS (SELECT *, greatest(4.0, 0.6 * median(y2 - y1) OVER (PARTITION BY page_id)) gap FROM words),
o AS (SELECT *, coalesce(CAST(x1 - max(x2) OVER (PARTITION BY page_id ORDER BY x1, x2, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > gap AS INTEGER), 0) new FROM g),
c AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY x1, x2, word ROWS UNBOUNDED PRECEDING) c FROM o), s AS (SELECT page_id, c, min(x1) "left", max(x2) "right" FROM c GROUP BY ALL),
cols AS (SELECT w.*, CAST(coalesce((SELECT min(s.c) FROM s WHERE s.page_id = w.page_id AND (w.x1 + w.x2) / 2 BETWEEN s."left" AND s."right"), 0) AS INTEGER) col FROM words w)"""


@query(f"WITH {BOXES}, {_GUTTERS} SELECT page_id, word, col FROM cols")
def win07_gutters_by_type_size(spark, sf):
    return L.gutter_columns(_tokens(spark, sf)).select("page_id", "word", F.col("col").cast("int").alias("col"))


_LINED = f"""{_GUTTERS}, n AS (SELECT *, row_number() OVER (PARTITION BY page_id, col ORDER BY y1, x1, word) r FROM cols),
walk AS (SELECT page_id, col, word, y1, r, y1 a, 0 line FROM n WHERE r = 1 UNION ALL
  SELECT n.page_id, n.col, n.word, n.y1, n.r, CASE WHEN n.y1 - w.a > 2 THEN n.y1 ELSE w.a END, w.line + CAST(n.y1 - w.a > 2 AS INTEGER) FROM walk w JOIN n ON n.page_id = w.page_id AND n.col = w.col AND n.r = w.r + 1),
lined AS (SELECT c.*, w.line FROM cols c JOIN walk w USING (page_id, col, word))"""


@query(f"WITH RECURSIVE {BOXES}, {_LINED} SELECT page_id, col, word, line FROM lined")
def win05_word_lines(spark, sf):
    w = L.gutter_columns(_tokens(spark, sf)).withColumn("col", F.col("col").cast("int"))
    return L.word_lines(w).select("page_id", "col", "word", "line")


_MERGED = f"""{_LINED}, b AS (SELECT page_id, col, line, list(y2) ys FROM lined GROUP BY ALL),
m AS (SELECT page_id, col, line, ys cur, 0 merged FROM b WHERE line = 0 UNION ALL
  SELECT b.page_id, b.col, b.line, CASE WHEN abs(list_aggregate(m.cur, 'median') - list_aggregate(b.ys, 'median')) <= 2 THEN list_concat(m.cur, b.ys) ELSE b.ys END, m.merged + CAST(abs(list_aggregate(m.cur, 'median') - list_aggregate(b.ys, 'median')) > 2 AS INTEGER)
  FROM m JOIN b ON b.page_id = m.page_id AND b.col = m.col AND b.line = m.line + 1)"""


@query(f"WITH RECURSIVE {BOXES}, {_MERGED} SELECT page_id, col, line, merged FROM m")
def win06_shared_baselines(spark, sf):
    w = L.gutter_columns(_tokens(spark, sf)).withColumn("col", F.col("col").cast("int"))
    return L.shared_baselines(L.word_lines(w)).select("page_id", "col", "line", "merged").distinct()


@query(f"WITH RECURSIVE {BOXES}, {_MERGED}, l AS (SELECT page_id, col, merged, string_agg(text, ' ' ORDER BY x1, line, y1, word) t FROM lined JOIN m USING (page_id, col, line) GROUP BY ALL) SELECT page_id, string_agg(t, chr(10) ORDER BY col, merged) AS text FROM l GROUP BY page_id")
def win08_words_to_text(spark, sf):
    return L.words_text(_tokens(spark, sf))


@query(f"WITH {BOXES}, o AS (SELECT *, coalesce(CAST(x1 > max(x2) OVER (PARTITION BY page_id ORDER BY x1, x2, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER), 0) new FROM boxes), p AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY x1, x2, idx ROWS UNBOUNDED PRECEDING) part FROM o) SELECT page_id, CAST(part AS BIGINT) part, min(x1) \"start\", max(x2) \"end\", count(*) n FROM p GROUP BY ALL")
def win10_merged_intervals(spark, sf):
    return L.merged_intervals(T.boxes(spark, sf))


_PROFILE = """e AS (SELECT page_id, CAST(floor(y1) AS BIGINT) "at", 1 d FROM boxes UNION ALL SELECT page_id, CAST(floor(y2) AS BIGINT), -1 FROM boxes), st AS (SELECT page_id, "at", sum(d) d FROM e GROUP BY ALL),
prof AS (SELECT * FROM (SELECT page_id, "at", lead("at") OVER (PARTITION BY page_id ORDER BY "at") "until", CAST(sum(d) OVER (PARTITION BY page_id ORDER BY "at" ROWS UNBOUNDED PRECEDING) AS BIGINT) n FROM st) WHERE "until" IS NOT NULL)"""


@query(f"WITH {BOXES}, {_PROFILE} SELECT * FROM prof")
def agg21_projection(spark, sf):
    return L.projection(T.boxes(spark, sf), 1)


@query(f"WITH {BOXES}, {_PROFILE}, h AS (SELECT *, coalesce(CAST(\"at\" - lag(\"until\") OVER (PARTITION BY page_id ORDER BY \"at\") + 1 > 3 AS INTEGER), 0) new FROM prof WHERE n > 0), s AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY \"at\" ROWS UNBOUNDED PRECEDING) part FROM h) SELECT page_id, min(\"at\") \"start\", max(\"until\") \"end\" FROM s GROUP BY page_id, part")
def win22_profile_segments(spark, sf):
    return L.segments(L.projection(T.boxes(spark, sf), 1), 0, 3)


@query(f"WITH {BOXES}, {_PROFILE}, f AS (SELECT *, coalesce(CAST(n <> lag(n) OVER (PARTITION BY page_id ORDER BY \"at\") AS INTEGER), 0) new FROM prof), g AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY \"at\" ROWS UNBOUNDED PRECEDING) run FROM f), r AS (SELECT page_id, run, min(\"at\") \"start\", max(\"until\") \"end\", min(n) n FROM g GROUP BY ALL), v AS (SELECT *, lag(n) OVER (PARTITION BY page_id ORDER BY \"start\") a, lead(n) OVER (PARTITION BY page_id ORDER BY \"start\") z FROM r) SELECT page_id, \"start\", \"end\", n FROM v WHERE a > n AND z > n")
def win20_flat_minima(spark, sf):
    return L.flat_minima(L.projection(T.boxes(spark, sf), 1))


@query(f"WITH {BOXES} SELECT page_id, idx, coalesce(x1 - lag(x1) OVER w > 20, true) starts, coalesce(lead(x2) OVER w - x2 > 20, true) \"ends\" FROM boxes WINDOW w AS (PARTITION BY page_id ORDER BY idx)")
def win21_segment_flags(spark, sf):
    return L.segment_flags(T.boxes(spark, sf))


@query(f"WITH {BOXES}, {_RANKED} SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY rank, idx) - 1 AS INTEGER) reading_pos FROM r WHERE label <> 'Header'")
def win02_page_positions(spark, sf):
    return L.page_positions(L.reading_order(T.boxes(spark, sf)).where("label <> 'Header'")).select("page_id", "idx", "reading_pos")


_ORDERED = "ord AS (SELECT *, CASE WHEN page_id % 3 = 0 OR idx % 4 <> 0 THEN CAST((idx * 7 + page_id) % 23 AS INTEGER) END \"order\", CASE WHEN page_id % 2 = 0 THEN CAST((idx * 5) % 19 AS INTEGER) END guess FROM boxes)"


def _ordered(spark, sf) -> DataFrame:
    i, p = F.col("idx"), F.col("page_id")
    return T.boxes(spark, sf).withColumn("order", F.when((p % 3 == 0) | (i % 4 != 0), ((i * 7 + p) % 23).cast("int"))).withColumn("guess", F.when(p % 2 == 0, ((i * 5) % 19).cast("int")))


@query(f"WITH {BOXES}, {_ORDERED} SELECT page_id, idx, CAST(count(*) FILTER (label = 'Headline') OVER (PARTITION BY page_id ORDER BY \"order\" NULLS LAST, idx ROWS UNBOUNDED PRECEDING) AS BIGINT) run FROM ord")
def win03_heading_runs(spark, sf):
    return L.heading_runs(_ordered(spark, sf)).select("page_id", "idx", "run")


@query(f"""WITH {BOXES}, {_ORDERED}, b AS (SELECT *, CASE WHEN count("order") OVER p = count(*) OVER p THEN "order" WHEN count(guess) OVER p = count(*) OVER p THEN guess END sk, CASE WHEN count("order") OVER p = count(*) OVER p THEN 0 WHEN count(guess) OVER p = count(*) OVER p THEN 1 ELSE 2 END "by" FROM ord WINDOW p AS (PARTITION BY page_id)) SELECT page_id, idx, "by", CAST(row_number() OVER (PARTITION BY page_id ORDER BY sk, y1, x1, idx) - 1 AS INTEGER) rank FROM b""")
def srt03_chosen_order(spark, sf):
    return L.chosen_order(_ordered(spark, sf)).select("page_id", "idx", "by", "rank")


@query(f"WITH {BOXES}, {_ORDERED} SELECT page_id, CASE WHEN count(\"order\") = count(*) THEN list(idx ORDER BY \"order\", idx) END \"order\" FROM ord GROUP BY page_id")
def srt04_permutation(spark, sf):
    return L.permutation(_ordered(spark, sf))


@query(f"WITH {BOXES}, {_ORDERED}, o AS (SELECT page_id, idx, CASE WHEN page_id % 5 <> 0 THEN \"order\" END \"order\" FROM ord) SELECT page_id, CASE WHEN count(\"order\") > 0 THEN list(idx ORDER BY \"order\" NULLS LAST, idx) END \"order\" FROM o GROUP BY page_id")
def srt05_benchmark_order(spark, sf):
    return L.benchmark_order(_ordered(spark, sf).withColumn("order", F.when(F.col("page_id") % 5 != 0, F.col("order"))))


@query(f"WITH {BOXES}, t AS (SELECT *, CASE WHEN label IN ('Paragraph', 'Headline') AND idx % 3 <> 0 THEN CAST((idx * 5 + k) % 31 AS DOUBLE) END line_rank, label <> 'Header' in_flow FROM boxes), u AS (SELECT *, CASE WHEN NOT in_flow THEN 2 WHEN line_rank IS NULL THEN 1 ELSE 0 END tier FROM t) SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY tier, CASE WHEN tier = 0 THEN line_rank ELSE y1 END, CASE WHEN tier = 0 THEN 0 ELSE x1 END, idx) - 1 AS INTEGER) rank FROM u")
def srt06_tiered_order(spark, sf):
    rank = F.when(F.col("label").isin("Paragraph", "Headline") & (F.col("idx") % 3 != 0), ((F.col("idx") * 5 + F.col("k")) % 31).cast("double"))
    return L.tiered_order(T.boxes(spark, sf).withColumn("line_rank", rank).withColumn("in_flow", F.col("label") != "Header")).select("page_id", "idx", "rank")


@query(f"WITH {BOXES} SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY floor(y1 / 40), floor(x1 / 100), x1 * x1 + y1 * y1, idx) - 1 AS INTEGER) rank FROM boxes")
def srt07_banded_order(spark, sf):
    return L.banded_order(T.boxes(spark, sf), 40.0, 100.0).select("page_id", "idx", "rank")


@query(f"WITH {BOXES}, {PREDICTED}, g AS (SELECT page_id, CAST((idx * 3) % 17 AS INTEGER) AS idx, min(k % 50) \"at\" FROM boxes GROUP BY ALL) SELECT g.page_id, g.idx, CAST(row_number() OVER (PARTITION BY g.page_id ORDER BY \"at\", g.idx) - 1 AS INTEGER) rank FROM g WHERE EXISTS (SELECT 1 FROM pred p WHERE p.page_id = g.page_id AND p.idx = g.idx)")
def srt15_resolved_order(spark, sf):
    given = T.boxes(spark, sf).select("page_id", ((F.col("idx") * 3) % 17).cast("int").alias("idx"), (F.col("k") % 50).alias("at"))
    return L.resolved_order(given, T.predicted(spark, sf))


@query(f"""WITH {BOXES}, j AS (SELECT a.page_id, a.idx, b.idx o, {_AREA.format(a='b')} area, b.x1 <= a.x1 AND b.y1 <= a.y1 AND b.x2 >= a.x2 AND b.y2 >= a.y2 holds, greatest(a.x1, b.x1) - least(a.x2, b.x2) < 0 beside, b.y2 <= a.y1 above, b.y1 >= a.y2 below, b.y2 oy2, b.y1 oy1 FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.idx <> b.idx),
g AS (SELECT page_id, idx, arg_min(o, {{'a': area, 'o': o}}) FILTER (holds) parent, arg_max(o, {{'y': oy2, 'k': -o}}) FILTER (beside AND above) previous, arg_min(o, {{'y': oy1, 'o': o}}) FILTER (beside AND below) "following" FROM j GROUP BY ALL) SELECT b.page_id, b.idx, parent, previous, "following" FROM boxes b LEFT JOIN g USING (page_id, idx)""")
def jn17_neighbours(spark, sf):
    return L.neighbours(T.boxes(spark, sf))


@query(f"""WITH {BOXES}, p AS (SELECT *, CASE WHEN idx > 1 AND idx % 3 <> 1 THEN idx - 1 END parent FROM boxes), t AS (SELECT p.*, q.parent grand FROM p LEFT JOIN p q ON q.page_id = p.page_id AND q.idx = p.parent), f AS (SELECT *, coalesce(grand, parent, idx) root FROM t)
SELECT page_id, root AS idx, coalesce(list(idx ORDER BY idx) FILTER (idx <> root), []) children, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 FROM f GROUP BY page_id, root""")
def sup16_children(spark, sf):
    """Blocks in threes: the second is the first one's child, the third the second one's; they are flattened."""
    parent = F.when((F.col("idx") > 1) & (F.col("idx") % 3 != 1), F.col("idx") - 1)
    return L.with_children(T.boxes(spark, sf).withColumn("parent", parent))


@query(f"WITH {BOXES}, {PREDICTED}, o AS (SELECT p.page_id, p.idx i, arg_max(g.idx, {{'s': {_iou('p', 'g')}, 'n': -g.idx}}) j, max({_iou('p', 'g')}) s FROM pred p JOIN boxes g ON p.page_id = g.page_id WHERE {_iou('p', 'g')} >= 0.3 GROUP BY ALL), c AS (SELECT p.page_id, p.idx, coalesce(o.j * 2, 1000000 + p.idx) k FROM pred p LEFT JOIN o ON o.page_id = p.page_id AND o.i = p.idx) SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k, idx) - 1 AS INTEGER) rank FROM c")
def jn08_order_by_match(spark, sf):
    g = T.boxes(spark, sf)
    return L.order_by_match(T.predicted(spark, sf), g, g.select("page_id", F.col("idx").alias("j"), (F.col("idx") * 2).alias("order")), 0.3)

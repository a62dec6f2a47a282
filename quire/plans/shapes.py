"""Registered queries of geometry, labels, text forms and row filters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as V
from ..functions import text as X
from ..sources import layouts as T
from ..sources.layouts import BOXES, LINES
from .registry import _AREA, _INTER, _r, _words, _WORDS, query

_C = ("x1", "y1", "x2", "y2")
_PAIR = f"WITH {BOXES}, p AS (SELECT a.page_id, a.idx i, b.idx j, " + ", ".join(f"a.{c} a_{c}, b.{c} b_{c}" for c in _C) + " FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.idx < b.idx)"
_LOW, _HIGH = "greatest(a_{c}1, b_{c}1)", "least(a_{c}2, b_{c}2)"


def _pairs(spark, sf) -> DataFrame:
    """Boxes of a page two by two, i before j."""
    b = T.boxes(spark, sf)
    side = lambda k, p: b.select("page_id", F.col("idx").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in _C])
    return side("i", "a").join(side("j", "b"), "page_id").where("i < j")


def _ab():
    return G.box("a_"), G.box("b_")


@query(f"WITH {BOXES} SELECT page_id, idx, x2 - x1 width, y2 - y1 height, [x1, y1, x2 - x1, y2 - y1] xywh, [x1, y1, x1 + (x2 - x1), y1 + (y2 - y1)] corners, (x1 + x2) / 2 cx, (y1 + y2) / 2 cy FROM boxes")
def prj01_box_forms(spark, sf):
    b = G.box()
    x, y, w, h = G.to_xywh(b)
    cx, cy = G.centroid(b)
    return T.boxes(spark, sf).select("page_id", "idx", w.alias("width"), h.alias("height"), F.array(x, y, w, h).alias("xywh"), F.array(*G.from_xywh(x, y, w, h)).alias("corners"), cx.alias("cx"), cy.alias("cy"))


@query(f"WITH {BOXES} SELECT page_id, idx, " + ", ".join(f"round(least(1000, greatest(0, CAST(trunc({c} / {s} * 1000) AS INTEGER))) / 1000.0::DOUBLE * {s}, 6) px_{c}" for c, s in (("x1", 900), ("y1", 1000), ("x2", 900), ("y2", 1000))) + " FROM boxes")
def prj02_denormalise(spark, sf):
    size = {"x1": 900.0, "y1": 1000.0, "x2": 900.0, "y2": 1000.0}
    return T.boxes(spark, sf).select("page_id", "idx", *[_r(G.denormalised(G.normalised(F.col(c), F.lit(s)), F.lit(s))).alias(f"px_{c}") for c, s in size.items()])


@query(f"WITH {BOXES}, q AS (SELECT page_id, idx, [x1, y1, x2, y1, x2, y2, x1, y2] poly FROM boxes) SELECT page_id, idx, poly, list_min(list_filter(poly, lambda v, i: i % 2 = 1)) x1, list_min(list_filter(poly, lambda v, i: i % 2 = 0)) y1, list_max(list_filter(poly, lambda v, i: i % 2 = 1)) x2, list_max(list_filter(poly, lambda v, i: i % 2 = 0)) y2 FROM q")
def src09_polygon_to_box(spark, sf):
    q = T.boxes(spark, sf).select("page_id", "idx", G.to_polygon(G.box()).alias("poly"))
    return q.select("page_id", "idx", "poly", *[v.alias(c) for v, c in zip(G.from_polygon(F.col("poly")), _C, strict=True)])


_I = f"greatest(0.0, {_HIGH.format(c='x')} - {_LOW.format(c='x')}) * greatest(0.0, {_HIGH.format(c='y')} - {_LOW.format(c='y')})"
_AA, _AB = "(a_x2 - a_x1) * (a_y2 - a_y1)", "(b_x2 - b_x1) * (b_y2 - b_y1)"


@query(f"{_PAIR} SELECT page_id, i, j, round(coalesce({_I} / nullif({_AA} + {_AB} - {_I}, 0), 0.0), 6) iou_xywh, round(coalesce({_I} / nullif({_AA} + {_AB} - {_I}, 0), 0.0), 6) iou_poly FROM p")
def prj05_iou_forms(spark, sf):
    A, B = _ab()
    p = _pairs(spark, sf).select("page_id", "i", "j", F.array(*G.to_xywh(A)).alias("a"), F.array(*G.to_xywh(B)).alias("b"), G.to_polygon(A).alias("pa"), G.to_polygon(B).alias("pb"))
    xywh = lambda c: G.from_xywh(*[F.col(c)[k] for k in range(4)])
    return p.select("page_id", "i", "j", _r(G.iou(xywh("a"), xywh("b"))).alias("iou_xywh"), _r(G.iou(G.from_polygon(F.col("pa")), G.from_polygon(F.col("pb")))).alias("iou_poly"))


@query(f"WITH {BOXES}, {_WORDS} SELECT w.page_id, w.word, b.idx, round({_INTER.format(a='w', b='b')} / ({_AREA.format(a='w')}), 6) share FROM words w JOIN boxes b ON w.page_id = b.page_id WHERE {_INTER.format(a='w', b='b')} >= 0.5 * ({_AREA.format(a='w')})")
def jn09_lines_in_regions(spark, sf):
    """Also the ratio of PRJ-06: many to many, a line belongs to every region that covers half of it."""
    w = _words(spark, sf).select("page_id", "word", *[F.col(c).alias(f"w_{c}") for c in _C])
    share = G.covered_share(G.box("w_"), G.box())
    return w.join(T.boxes(spark, sf), "page_id").withColumn("share", share).where(F.col("share") >= 0.5).select("page_id", "word", "idx", _r("share").alias("share"))


@query(f"{_PAIR} SELECT page_id, i, j, " + ", ".join(f"round(coalesce({_I} / nullif({d}, 0), 0.0), 6) {m}" for m, d in (("by_union", f"{_AA} + {_AB} - {_I}"), ("by_small", f"least({_AA}, {_AB})"), ("by_large", f"greatest({_AA}, {_AB})"))) + " FROM p")
def prj07_overlap_modes(spark, sf):
    A, B = _ab()
    return _pairs(spark, sf).select("page_id", "i", "j", *[_r(G.overlap_ratio(A, B, m)).alias(f"by_{m}") for m in ("union", "small", "large")])


def _proj_sql(c: str, mode: str) -> str:
    over = f"greatest(0.0, {_HIGH.format(c=c)} - {_LOW.format(c=c)})"
    whole = {"union": f"greatest(a_{c}2, b_{c}2) - least(a_{c}1, b_{c}1)", "small": f"least(a_{c}2 - a_{c}1, b_{c}2 - b_{c}1)", "large": f"greatest(a_{c}2 - a_{c}1, b_{c}2 - b_{c}1)"}[mode]
    return f"round(coalesce({over} / nullif({whole}, 0), 0.0), 6) {c}_{mode}"


@query(f"{_PAIR} SELECT page_id, i, j, " + ", ".join(_proj_sql(c, m) for c in "xy" for m in ("union", "small", "large")) + " FROM p")
def prj08_projection_overlap(spark, sf):
    A, B = _ab()
    return _pairs(spark, sf).select("page_id", "i", "j", *[_r(G.projection_ratio(A, B, k, m)).alias(f"{c}_{m}") for k, c in enumerate("xy") for m in ("union", "small", "large")])


@query(f"{_PAIR} SELECT page_id, i, j, greatest(0.0, {_LOW.format(c='y')} - {_HIGH.format(c='y')}) gap, (b_y1 + b_y2) / 2 > (a_y1 + a_y2) / 2 below, {_LOW.format(c='x')} - {_HIGH.format(c='x')} signed_gap, coalesce(CASE WHEN page_id % 3 = 0 THEN 900.0 END, 1000.0) page_width FROM p")
def prj09_vertical_relations(spark, sf):
    A, B = _ab()
    width = F.coalesce(F.when(F.col("page_id") % 3 == 0, F.lit(900.0)), F.lit(1000.0))
    return _pairs(spark, sf).select("page_id", "i", "j", G.vertical_gap(A, B).alias("gap"), G.is_below(B, A).alias("below"), G.axis_gap(A[0], A[2], B[0], B[2]).alias("signed_gap"), width.alias("page_width"))


def _edge_sql(c: str, before: float, after: float) -> str:
    return f"CASE WHEN {_LOW.format(c=c)} - {_HIGH.format(c=c)} < 0 THEN 0.0 ELSE least(abs(a_{c}1 - b_{c}2), abs(a_{c}2 - b_{c}1)) * CASE WHEN a_{c}2 < b_{c}1 THEN {before} ELSE {after} END END"


@query(f"{_PAIR} SELECT page_id, i, j, round({_edge_sql('x', 1.0, 2.0)} + {_edge_sql('y', 3.0, 0.5)}, 6) distance FROM p")
def prj11_edge_distance(spark, sf):
    A, B = _ab()
    return _pairs(spark, sf).select("page_id", "i", "j", _r(G.edge_distance(A, B, (1.0, 2.0, 3.0, 0.5))).alias("distance"))


@query(f"{_PAIR} SELECT page_id, i, j, abs(a_x1 - b_x1) + abs(a_y1 - b_y1) manhattan, round(sqrt(pow((a_x1 + a_x2) / 2 - (b_x1 + b_x2) / 2, 2) + pow((a_y1 + a_y2) / 2 - (b_y1 + b_y2) / 2, 2)), 6) euclidean FROM p")
def prj12_distances(spark, sf):
    A, B = _ab()
    return _pairs(spark, sf).select("page_id", "i", "j", G.manhattan(A, B).alias("manhattan"), _r(G.euclidean(A, B)).alias("euclidean"))


@query(f"WITH {BOXES}, t AS (SELECT DISTINCT page_id, 450.0 w, 2000.0 h FROM boxes WHERE page_id % 3 <> 0) SELECT b.page_id, b.idx, " + ", ".join(f"round({c} * coalesce(t.{d} / {s}, 1.0), 6) {c}" for c, d, s in (("x1", "w", "900.0"), ("y1", "h", "1000.0"), ("x2", "w", "900.0"), ("y2", "h", "1000.0"))) + " FROM boxes b LEFT JOIN t USING (page_id)")
def prj14_rescale(spark, sf):
    """Boxes on pages of a new size; pages that are not listed pass through."""
    b = T.boxes(spark, sf)
    t = b.where("page_id % 3 <> 0").select("page_id", F.lit(450.0).alias("w"), F.lit(2000.0).alias("h")).distinct()
    by = {"x1": F.col("w") / 900, "y1": F.col("h") / 1000, "x2": F.col("w") / 900, "y2": F.col("h") / 1000}
    return b.join(t, "page_id", "left").select("page_id", "idx", *[_r(F.col(c) * F.coalesce(k, F.lit(1.0))).alias(c) for c, k in by.items()])


_NAMES = ["DocTitle", "ParaText", "Figure", "FigureName", "RegionList", "LetterHead"]
_FOREIGN = f"f AS (SELECT page_id, idx, list_extract({_NAMES!r}, idx % 6 + 1) raw, CASE page_id % 3 WHEN 0 THEN 'D4LA' WHEN 1 THEN 'other' END taxonomy, label FROM boxes)"


def _foreign(spark, sf) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("idx") % 6 + 1).cast("int"))
    taxonomy = F.when(F.col("page_id") % 3 == 0, "D4LA").when(F.col("page_id") % 3 == 1, "other")
    return T.boxes(spark, sf).select("page_id", "idx", raw.alias("raw"), taxonomy.alias("taxonomy"), "label")


@query(f"WITH {BOXES}, {_FOREIGN} SELECT page_id, idx, CASE WHEN taxonomy = 'D4LA' THEN CASE raw WHEN 'DocTitle' THEN 'Headline' WHEN 'ParaText' THEN 'Paragraph' WHEN 'Figure' THEN 'Figure' WHEN 'FigureName' THEN 'Caption' WHEN 'RegionList' THEN 'UnorderedList' WHEN 'LetterHead' THEN 'Header' ELSE raw END ELSE raw END native FROM f")
def prj15_relabel(spark, sf):
    return _foreign(spark, sf).select("page_id", "idx", V.relabel(F.col("raw"), F.col("taxonomy")).alias("native"))


@query(f"WITH {BOXES}, {_FOREIGN} SELECT page_id, idx, CASE WHEN raw = 'Figure' THEN 'Figure' ELSE 'Paragraph' END item, label native FROM f")
def prj16_item_class(spark, sf):
    return _foreign(spark, sf).select("page_id", "idx", V.item_class(F.col("raw")).alias("item"), V.item_class(F.col("label")).alias("native"))


@query(f"WITH {BOXES}, {_FOREIGN} SELECT page_id, idx, CASE label WHEN 'Headline' THEN 'title' WHEN 'Paragraph' THEN 'body' WHEN 'Figure' THEN 'figure' WHEN 'Caption' THEN 'figure_caption' WHEN 'Subhead' THEN 'title' WHEN 'Header' THEN 'abandon' END type, CASE WHEN raw = 'Figure' THEN 'figure' ELSE 'text_block' END raw_type FROM f")
def prj17_benchmark_types(spark, sf):
    return _foreign(spark, sf).select("page_id", "idx", V.benchmark_type(F.col("label"), {"Paragraph": "body"}).alias("type"), V.benchmark_type(F.col("raw")).alias("raw_type"))


@query("SELECT DISTINCT event_type, CASE event_type WHEN 'Text' THEN 'text_block' ELSE event_type END type, 'text_block' AS \"text\", 'title' AS title, 'header' AS furniture FROM events")
def prj18_detector_types(spark, sf):
    e = T.table(spark, sf, "events").select("event_type").distinct()
    return e.select("event_type", V.detector_type(F.col("event_type"), "DocLayNet").alias("type"), V.detector_type(F.lit("List-item"), "DocLayNet").alias("text"), V.detector_type(F.lit("title"), "PubLayNet").alias("title"), V.detector_type(F.lit("header_footer"), "nemotron").alias("furniture"))


@query(f"WITH {BOXES} SELECT page_id, idx, '__B' || idx || '__' matched, '__UNMATCHED' || idx || '__' unmatched FROM boxes")
def prj19_stub_tokens(spark, sf):
    return T.boxes(spark, sf).select("page_id", "idx", X.stub(F.col("idx")).alias("matched"), X.stub(F.col("idx"), "__UNMATCHED").alias("unmatched"))


_FILES = "files AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'mag_' || (page_id // 100) || '_' || page_id || '.png' WHEN 1 THEN 'plain.name.jpg' WHEN 2 THEN 'cover' ELSE 'x_y_' || page_id END \"name\" FROM pages)"


def _files(spark, sf) -> DataFrame:
    p, k = T.table(spark, sf, "pages").select("page_id"), F.col("page_id") % 4
    s = F.col("page_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("mag_"), F.floor(F.col("page_id") / 100).cast("string"), F.lit("_"), s, F.lit(".png"))).when(k == 1, "plain.name.jpg").when(k == 2, "cover").otherwise(F.concat(F.lit("x_y_"), s))
    return p.select("page_id", name.alias("name"))


@query(f"WITH {_FILES} SELECT page_id, regexp_replace(name, '[.][^./]+$', '') stem FROM files")
def prj20_strip_extension(spark, sf):
    return _files(spark, sf).select("page_id", X.stem_of(F.col("name")).alias("stem"))


@query(f"WITH {_FILES}, s AS (SELECT page_id, regexp_replace(name, '[.][^./]+$', '') s FROM files) SELECT page_id, CASE WHEN regexp_matches(s, '^(.*)_([0-9]+)$') THEN regexp_extract(s, '^(.*)_([0-9]+)$', 1) ELSE s END stem, CASE WHEN regexp_matches(s, '^(.*)_([0-9]+)$') THEN CAST(regexp_extract(s, '^(.*)_([0-9]+)$', 2) AS INTEGER) ELSE 0 END page FROM s")
def src06_page_of_name(spark, sf):
    return _files(spark, sf).select("page_id", X.page_of(F.col("name")).alias("p")).select("page_id", "p.stem", "p.page")


@query(f"WITH {_FILES}, s AS (SELECT page_id, regexp_replace(name, '[.][^./]+$', '') s FROM files), k AS (SELECT page_id, CASE WHEN regexp_matches(s, '^(.*)_([0-9]+)$') THEN regexp_extract(s, '^(.*)_([0-9]+)$', 1) ELSE s END stem, CASE WHEN regexp_matches(s, '^(.*)_([0-9]+)$') THEN CAST(regexp_extract(s, '^(.*)_([0-9]+)$', 2) AS INTEGER) ELSE 0 END page FROM s) SELECT stem, list(page ORDER BY page, page_id) pages, count(*) n FROM k GROUP BY stem")
def src13_group_by_document(spark, sf):
    p = _files(spark, sf).select("page_id", X.page_of(F.col("name")).alias("p"))
    g = p.groupBy("p.stem").agg(F.array_sort(F.collect_list(F.struct("p.page", "page_id"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return g.select("stem", F.col("m.page").alias("pages"), "n")


@query("SELECT source, string_agg('  ' || lang || ': ' || n, chr(10) ORDER BY lang) yaml FROM (SELECT source, lang, count(*) n FROM documents GROUP BY ALL) GROUP BY source")
def prj22_yaml(spark, sf):
    n = T.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return n.groupBy("source").agg(X.yaml_map(F.map_from_entries(F.collect_list(F.struct("lang", "n")))).alias("yaml"))


_NORMAL = "regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]*\\n[ \\t]*', ' ', 'g'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"WITH {LINES}, t AS (SELECT doc_id, pos, replace(text, ' the ', chr(10)) AS text, CASE pos % 3 WHEN 0 THEN 'Table' ELSE 'Paragraph' END label FROM lines) SELECT doc_id, CAST(pos AS INTEGER) pos, CASE WHEN label = 'Table' THEN text ELSE {_NORMAL} END AS text FROM t")
def str03_region_text(spark, sf):
    t = F.replace("text", F.lit(" the "), F.lit("\n"))
    return T.lines(spark, sf).select("doc_id", "pos", X.region_text(F.when(F.col("pos") % 3 == 0, "Table").otherwise("Paragraph"), t).alias("text"))


_NEXT = "n AS (SELECT doc_id, pos, text, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) nxt FROM lines)"


def _next(spark, sf) -> DataFrame:
    return T.lines(spark, sf).withColumn("nxt", F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos"))).where("nxt is not null")


@query(f"WITH {LINES}, {_NEXT}, h AS (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN regexp_replace(text, '[.]$', '-') || '  ' ELSE text END a, CASE pos % 2 WHEN 0 THEN ' ' || lower(substr(nxt, 1, 1)) || substr(nxt, 2) ELSE nxt END b FROM n WHERE nxt IS NOT NULL), t AS (SELECT doc_id, pos, regexp_replace(a, '\\s+$', '') a, regexp_replace(b, '^\\s+', '') b FROM h) SELECT doc_id, CAST(pos AS INTEGER) pos, CASE WHEN suffix(a, '-') AND regexp_matches(b, '^\\p{{Ll}}') THEN regexp_replace(a, '-$', '') || b ELSE a || ' ' || b END joined FROM t")
def str07_join_halves(spark, sf):
    a = F.when(F.col("pos") % 3 == 0, F.concat(F.regexp_replace("text", "[.]$", "-"), F.lit("  "))).otherwise(F.col("text"))
    b = F.when(F.col("pos") % 2 == 0, F.concat(F.lit(" "), F.lower(F.substring("nxt", 1, 1)), F.expr("substring(nxt, 2)"))).otherwise(F.col("nxt"))
    return _next(spark, sf).select("doc_id", "pos", X.join_halves(a, b).alias("joined"))


_SECTIONS = ("ODMEVI IZ TUJINE", "Plošče", "Mine iz tujih logov", "Pisma bralcev", "neznano", "Intervju in novice", "KAZALO / iz vsebine")
_SECTION_SQL = f"s AS (SELECT doc_id, list_extract({list(_SECTIONS)!r}, doc_id % 7 + 1) section FROM documents), g AS (SELECT *, strip_accents(lower(section)) f FROM s)"


def _sections(spark, sf) -> DataFrame:
    return T.table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("doc_id") % 7 + 1).cast("int")).alias("section"))


@query(f"WITH {_SECTION_SQL} SELECT doc_id, CASE WHEN contains(f, 'mine iz tujih') THEN 'recenzija' WHEN contains(f, 'iz vsebine') THEN 'kazalo' WHEN contains(f, 'intervju') THEN 'intervju' WHEN contains(f, 'odmevi') THEN 'novice' WHEN contains(f, 'plosce') THEN 'recenzija' WHEN contains(f, 'novice') THEN 'novice' WHEN contains(f, 'pisma') THEN 'pisma' END genre FROM g")
def str21_section_genre(spark, sf):
    return _sections(spark, sf).select("doc_id", X.section_genre(F.col("section")).alias("genre"))


@query(f"WITH {_SECTION_SQL} SELECT doc_id, contains(f, 'odmevi') OR contains(f, 'plosce') OR contains(f, 'mine iz tujih') OR contains(f, 'pisma') OR contains(f, 'novice') OR contains(f, 'iz vsebine') is_column FROM g")
def str23_column_section(spark, sf):
    return _sections(spark, sf).select("doc_id", X.is_column_section(F.col("section")).alias("is_column"))


_REPLY = "r AS (SELECT doc_id, lower(CASE doc_id % 5 WHEN 0 THEN 'Besedilo spada v kategorijo Recenzija.' WHEN 1 THEN 'clanek ali intervju?' WHEN 2 THEN 'novicement' WHEN 3 THEN 'KVIZ' ELSE '' END) f FROM documents)"


@query(f"WITH {_REPLY} SELECT doc_id, CASE WHEN regexp_matches(f, '(^|[^a-z0-9_])recenzija($|[^a-z0-9_])') THEN 'recenzija' WHEN regexp_matches(f, '(^|[^a-z0-9_])intervju($|[^a-z0-9_])') THEN 'intervju' WHEN regexp_matches(f, '(^|[^a-z0-9_])clanek($|[^a-z0-9_])') THEN 'članek' WHEN regexp_matches(f, '(^|[^a-z0-9_])novice($|[^a-z0-9_])') THEN 'novice' WHEN regexp_matches(f, '(^|[^a-z0-9_])kviz($|[^a-z0-9_])') THEN 'kviz' END answer FROM r")
def str22_reply_label(spark, sf):
    k = F.col("doc_id") % 5
    reply = F.when(k == 0, "Besedilo spada v kategorijo Recenzija.").when(k == 1, "clanek ali intervju?").when(k == 2, "novicement").when(k == 3, "KVIZ").otherwise("")
    return T.table(spark, sf, "documents").select("doc_id", X.reply_label(reply).alias("answer"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS markdown FROM documents")
def str27_strip_fence(spark, sf):
    t = F.trim(F.regexp_replace("text", "\\s+", " "))
    k = F.col("doc_id") % 3
    fenced = F.when(k == 0, F.concat(F.lit(" ```markdown\n"), t, F.lit("\n``` \n"))).when(k == 1, F.concat(t, F.lit("\n```"))).otherwise(t)
    return T.table(spark, sf, "documents").select("doc_id", X.strip_fence(fenced).alias("markdown"))


@query(f"WITH {LINES} SELECT doc_id, coalesce(string_agg(CASE WHEN pos % 4 <> 3 THEN nullif(text, '') END, chr(10) || chr(10) ORDER BY pos), '') markdown FROM lines GROUP BY doc_id")
def str28_blocks_markdown(spark, sf):
    block = F.struct("pos", F.when(F.col("pos") % 4 != 3, F.col("text")).alias("text"))
    g = T.lines(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("m"))
    return g.select("doc_id", X.blocks_markdown(F.col("m.text")).alias("markdown"))


@query("SELECT c, count(*) n, regexp_matches(c, '^[A-Za-z]$') letter, regexp_matches(c, '^\\p{Nd}+$') digit, c IN (',', '，', '、', ';', '；', ':', '：', '-', '''', '\"', '“') soft FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) c FROM documents) GROUP BY c")
def str29_character_classes(spark, sf):
    n = T.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(.)"), 1)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return n.select("c", "n", X.is_letter(F.col("c")).alias("letter"), X.is_numeric(F.col("c")).alias("digit"), X.is_soft_punctuation(F.col("c")).alias("soft"))


@query(f"WITH {LINES}, b AS (SELECT doc_id, pos, trim(text, ' ') t FROM lines WHERE trim(text, ' ') <> ''), r AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) total FROM b) SELECT d.doc_id, 'Rubrika: ' || d.source || chr(10) || chr(10) || 'Besedilo: ' || coalesce(chr(10) || chr(10) || string_agg(r.t, chr(10) || chr(10) ORDER BY pos) FILTER (total <= 400 - 10 - 9 - length(d.source)), '') article FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id, d.source")
def str30_article_text(spark, sf):
    from ..operators import assembly

    items = T.lines(spark, sf).select("doc_id", F.col("source").alias("section"), "pos", "text")
    return assembly.classifier_text(items, 400)


@query("SELECT DISTINCT lang, 'Answer with one of these classes and nothing else: reklama, članek, naslovnica, dogodki, slike, intervju, pisma, novice, kviz, recenzija, kazalo.' prompt FROM documents")
def str31_class_prompt(spark, sf):
    return T.table(spark, sf, "documents").select("lang", F.lit(X.class_prompt()).alias("prompt")).distinct()


@query("SELECT page_id, sha256(html) digest FROM pages")
def str32_digest(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))


@query(f"WITH {BOXES} SELECT page_id, idx, label FROM boxes WHERE label NOT IN ('Figure', 'Form', 'Abandon') AND k % 3 = 0 AND page_id % 2 = 0")
def flt03_empty_regions(spark, sf):
    """Regions that optical recognition should fill: without text, of the wanted labels, no pictures."""
    from ..operators import assembly

    b = T.boxes(spark, sf).where("page_id % 2 = 0").withColumn("text", F.when(F.col("k") % 3 == 0, F.lit(" ")).otherwise("x"))
    return assembly.empty_regions(b).select("page_id", "idx", "label")


_TSV = "tsv AS (SELECT doc_id AS page, CAST(pos AS INTEGER) AS line_num, i AS word_num, w AS text, CASE (length(w) + pos + i) % 5 WHEN 0 THEN '-1' WHEN 1 THEN 'n/a' ELSE CAST(20 * ((length(w) + pos + i) % 5) AS VARCHAR) END AS conf FROM (SELECT doc_id, pos, unnest(ws) w, generate_subscripts(ws, 1) - 1 i FROM (SELECT doc_id, pos, string_split(text, ' ') ws FROM lines)))"


def _tsv(spark, sf) -> DataFrame:
    """Recognised words: page, line_num, word_num, text, conf as text."""
    w = T.lines(spark, sf).select(F.col("doc_id").alias("page"), F.col("pos").alias("line_num"), F.posexplode(F.split("text", " ")).alias("word_num", "text"))
    k = (F.length("text") + F.col("line_num") + F.col("word_num")) % 5
    return w.withColumn("conf", F.when(k == 0, "-1").when(k == 1, "n/a").otherwise((20 * k).cast("string")))


@query(f"WITH {LINES}, {_TSV} SELECT page, count(*) n, CAST(sum(CAST(conf AS DOUBLE)) AS DOUBLE) total FROM tsv WHERE trim(text) <> '' AND TRY_CAST(conf AS DOUBLE) >= 0 GROUP BY page")
def flt05_recognised_words(spark, sf):
    from ..operators import assembly

    return assembly.recognised(_tsv(spark, sf)).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("total"))


@query(f"WITH {LINES}, {_TSV}, w AS (SELECT *, CAST(conf AS DOUBLE) c FROM tsv WHERE trim(text) <> '' AND TRY_CAST(conf AS DOUBLE) >= 0), l AS (SELECT page, line_num, string_agg(trim(text), ' ' ORDER BY word_num) t, sum(c) s, count(*) n FROM w GROUP BY ALL), p AS (SELECT page, string_agg(t, chr(10) ORDER BY line_num) AS text, round(sum(s) / sum(n), 6) confidence FROM l GROUP BY page) SELECT DISTINCT tsv.page, coalesce(p.text, '') AS text, coalesce(confidence, 0.0) confidence, coalesce(p.text, '') <> '' AND coalesce(confidence, 0.0) >= 55 accepted FROM tsv LEFT JOIN p USING (page)")
def agg20_recognised_text(spark, sf):
    """Also the acceptance test FLT-04, at 55."""
    from ..operators import assembly

    return assembly.recognised_text(_tsv(spark, sf), 55.0).withColumn("confidence", _r("confidence"))


_EXCLUDED = "'Header', 'Figure', 'Caption'"


@query(f"WITH {BOXES} SELECT page_id, idx, label FROM boxes WHERE label NOT IN ({_EXCLUDED})")
def flt06_in_reading_order(spark, sf):
    return T.boxes(spark, sf).where(V.in_reading_order(F.col("label"))).select("page_id", "idx", "label")


@query(f"WITH {BOXES} SELECT page_id, idx FROM boxes WHERE k % 7 <> 0 ORDER BY page_id, idx LIMIT 50 OFFSET 10")
def flt07_slice(spark, sf):
    """Boxes that are not to be ignored, a slice of them in order (a smoke test's cap is the feature)."""
    return T.boxes(spark, sf).where(F.col("k") % 7 != 0).orderBy("page_id", "idx").offset(10).limit(50).select("page_id", "idx")


@query("""WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) w FROM documents), s AS (SELECT doc_id, w, length(w) / 10.0::DOUBLE score, CASE length(w) % 3 WHEN 0 THEN 'b-per' WHEN 1 THEN 'I-LOC' ELSE 'misc' END label FROM e)
SELECT doc_id, w AS "text", upper(regexp_replace(label, '^[BIbi]-', '')) label, round(score, 6) score FROM s WHERE score >= 0.5""")
def flt08_accepted_entities(spark, sf):
    from ..operators import linking as K

    e = T.table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 1)).alias("text"))
    n = F.length("text")
    raw = e.select("doc_id", "text", (n / 10).alias("score"), F.when(n % 3 == 0, "b-per").when(n % 3 == 1, "I-LOC").otherwise("misc").alias("label"))
    return K.accepted_entities(raw).select("doc_id", "text", "label", _r("score").alias("score"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def flt09_not_finished(spark, sf):
    """Documents without a finished state: also the resume rule SUP-23."""
    return T.table(spark, sf, "documents").select("doc_id").join(T.table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_anti")


@query(f"WITH {BOXES} SELECT page_id, idx, label FROM boxes")
def flt10_without_score(spark, sf):
    return T.boxes(spark, sf).drop("score").select("page_id", "idx", "label")


@query(f"WITH {BOXES}, t AS (SELECT page_id, idx, x1, x1 + (k % 5) AS x2, y1, y2 FROM boxes) SELECT page_id, idx FROM t WHERE x2 - x1 >= 2 AND y2 - y1 >= 2")
def flt11_no_slivers(spark, sf):
    from ..operators import layout as L

    return L.no_slivers(T.boxes(spark, sf).withColumn("x2", F.col("x1") + F.col("k") % 5)).select("page_id", "idx")


@query(f"WITH {BOXES} SELECT page_id, idx FROM boxes WHERE x1 >= 100 AND x2 <= 600")
def flt12_inside_interval(spark, sf):
    from ..operators import layout as L

    return L.inside(T.boxes(spark, sf), 0, 100.0, 600.0).select("page_id", "idx")


@query(f"WITH {BOXES} SELECT page_id, idx, greatest(8, CAST(((page_id % 20) * 100) // 75 AS INTEGER)) line_height, CASE WHEN x2 - x1 >= y2 - y1 THEN 'horizontal' ELSE 'vertical' END direction FROM boxes")
def sup14_line_height(spark, sf):
    """Line height of the page and direction of the block (SUP-15)."""
    from ..operators import layout as L

    return T.boxes(spark, sf).select("page_id", "idx", G.line_height((F.col("page_id") % 20) * 100).alias("line_height"), L.direction().alias("direction"))


@query(f"WITH {BOXES} SELECT page_id, CASE WHEN avg(CAST(x2 - x1 >= y2 - y1 AS INTEGER)) >= 0.5 THEN 'horizontal' ELSE 'vertical' END direction, round(min(sqrt(x1 * x1 + y1 * y1)), 6) origin FROM boxes WHERE label IN ('Paragraph', 'Headline') GROUP BY page_id")
def sup15_region_direction(spark, sf):
    """Direction of a page's text and its distance to the reading origin (SUP-17)."""
    from ..operators import layout as L

    return L.region_shape(T.boxes(spark, sf).where(F.col("label").isin("Paragraph", "Headline"))).withColumn("origin", _r("origin"))


@query(f"WITH {BOXES} SELECT page_id, idx, greatest(0, CAST(trunc(x1 / 1000 * 800) AS INTEGER) - 4) x1, greatest(0, CAST(trunc(y1 / 1000 * 1200) AS INTEGER) - 4) y1, least(800, CAST(trunc(x2 / 1000 * 800) AS INTEGER) + 4) x2, least(1200, CAST(trunc(y2 / 1000 * 1200) AS INTEGER) + 4) y2 FROM boxes WHERE label = 'Figure'")
def snk21_figure_crops(spark, sf):
    f = T.boxes(spark, sf).where("label = 'Figure'")
    return f.select("page_id", "idx", *[v.alias(c) for v, c in zip(G.crop(G.box(), F.lit(800), F.lit(1200)), _C, strict=True)])

"""Registered queries of document files, rendering, benchmark forms, linking and splits, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import assembly as A
from ..operators import layout as L
from ..operators import linking as K
from ..sources import files as D
from ..sources import layouts as T
from ..sources.layouts import BLOCKS, BOXES, LINES, PREDICTED
from .registry import _greedy, _iou, _r, query

# --- rendering
_MD = """CASE WHEN category IN ('Abandon', 'Advertisement') THEN NULL WHEN category = 'Dropcap' THEN text WHEN category = 'Figure' THEN '![Figure]()' || chr(10)
  WHEN category = 'Headline' THEN '# ' || text || chr(10) WHEN category IN ('Kicker', 'Caption', 'FigByline') THEN '*' || text || '*' || chr(10) WHEN category = 'Subhead' THEN '## ' || text || chr(10)
  WHEN category = 'Quote' THEN '> ' || text || chr(10) WHEN category = 'Footnote' THEN '[^note]: ' || text || chr(10) WHEN category = 'Section' THEN '_' || text || '_' || chr(10)
  WHEN category = 'Question' THEN '**Q:** ' || text || chr(10) ELSE text || chr(10) END"""


def _flow(by: str) -> str:
    return f"flow AS (SELECT b.*, coalesce(f.pos, b.pos) \"at\", f.pos IS NOT NULL \"inner\" FROM blocks b LEFT JOIN blocks f ON f.category = 'Figure' AND f.pos = b.figure_id AND b.category IN ('Caption', 'FigByline') AND {by})"


def _rendered(keys: str, by: str) -> str:
    return f"{_flow(by)}, l AS (SELECT *, {_MD} line FROM flow) SELECT {keys}, coalesce(string_agg(line, chr(10) ORDER BY \"at\", \"inner\", pos), '') markdown FROM l GROUP BY {keys}"


@query(f"WITH {BLOCKS}, {_rendered('doc_id', 'f.doc_id = b.doc_id')}")
def snk02_document_markdown(spark, sf):
    return A.markdown(T.blocks(spark, sf))


@query(f"WITH {BLOCKS} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) markdown FROM blocks WHERE trim(text, ' ') <> '' GROUP BY doc_id")
def snk02_document_texts(spark, sf):
    return A.markdown(T.blocks(spark, sf), raw=True)


_PAGES = "SELECT DISTINCT doc_id, CAST(unnest([page_no, page_no + 1]) AS INTEGER) page_no FROM blocks"


def _pages(b: DataFrame) -> DataFrame:
    return b.select("doc_id", F.explode(F.array(F.col("page_no"), F.col("page_no") + 1)).alias("page_no")).distinct()


@query(f"WITH {BLOCKS}, m AS (WITH {_rendered('doc_id, page_no', 'f.doc_id = b.doc_id AND f.page_no = b.page_no')}), p AS ({_PAGES}) SELECT p.doc_id, p.page_no, coalesce(m.markdown, '') markdown FROM p LEFT JOIN m USING (doc_id, page_no)")
def snk03_page_markdown(spark, sf):
    """Also the export for a benchmark (PIP-12): one text per page, also for pages without any."""
    b = T.blocks(spark, sf)
    return A.page_markdown(b, _pages(b))


_ARTICLE = "a AS (SELECT *, CASE WHEN pos % 7 <> 5 THEN nullif(sum(CAST(category = 'Headline' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)::BIGINT END article FROM blocks)"
_RUNS = f"""{_ARTICLE}, u AS (SELECT *, CASE WHEN article IS NULL THEN count(article) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) END run FROM a),
k AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, article, run) block FROM u)"""


def _claimed(spark, sf) -> DataFrame:
    b = T.blocks(spark, sf)
    n = F.count_if(F.col("category") == "Headline").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("n", n).withColumn("article", F.when((F.col("pos") % 7 != 5) & (F.col("n") > 0), F.col("n"))).drop("n")


@query(f"WITH {BLOCKS}, {_RUNS} SELECT doc_id, block, article, list(pos ORDER BY pos) items FROM k GROUP BY doc_id, block, article")
def snk05_article_blocks(spark, sf):
    b = A.article_blocks(_claimed(spark, sf))
    return b.groupBy("doc_id", "block", "article").agg(F.array_sort(F.collect_list("pos")).alias("items"))


_ARTICLES = "arts AS (SELECT doc_id, article, min(text) FILTER (category = 'Headline') title, CASE WHEN article % 2 = 0 THEN 'Novice' END section, article % 3 = 0 continued FROM a WHERE article IS NOT NULL GROUP BY doc_id, article)"


def _articles(c: DataFrame) -> DataFrame:
    a = c.where("article is not null")
    return a.groupBy("doc_id", "article").agg(F.min(F.when(F.col("category") == "Headline", F.col("text"))).alias("title")).select("doc_id", "article", "title", F.when(F.col("article") % 2 == 0, "Novice").alias("section"), (F.col("article") % 3 == 0).alias("continued"))


@query(f"""WITH {BLOCKS}, {_RUNS}, {_ARTICLES}, j AS (SELECT k.*, title, section, continued, pos = min(pos) OVER (PARTITION BY k.doc_id, block) is_first FROM k LEFT JOIN arts USING (doc_id, article)),
kept AS (SELECT * FROM j WHERE NOT coalesce(is_first AND article IS NOT NULL AND category = 'Headline' AND trim(text, ' ') = trim(title, ' '), false)),
f AS (SELECT b.*, coalesce(g.pos, b.pos) "at", g.pos IS NOT NULL "inner" FROM kept b LEFT JOIN kept g ON g.category = 'Figure' AND g.pos = b.figure_id AND b.category IN ('Caption', 'FigByline') AND g.doc_id = b.doc_id AND g.block = b.block),
m AS (SELECT doc_id, block, string_agg({_MD}, chr(10) ORDER BY "at", "inner", pos) body FROM f GROUP BY ALL),
p AS (SELECT doc_id, block, any_value(article) article, string_agg(DISTINCT page_no, ', ' ORDER BY page_no) pages, any_value(title) title, any_value(section) section, any_value(continued) continued FROM j GROUP BY doc_id, block),
c AS (SELECT p.doc_id, p.block, regexp_replace(CASE WHEN article IS NOT NULL THEN '## ' || CASE WHEN trim(coalesce(title, ''), ' ') = '' THEN '(untitled)' ELSE trim(title, ' ') END || chr(10) || '*' || concat_ws(' — ', 'pages ' || pages, section, CASE WHEN continued THEN 'continued' END) || '*' || chr(10) || chr(10) ELSE '' END || coalesce(body, ''), '^\\s+|\\s+$', '', 'g') chunk FROM p LEFT JOIN m USING (doc_id, block))
SELECT doc_id, string_agg(chunk, chr(10) || chr(10) ORDER BY block) || chr(10) markdown FROM c WHERE chunk <> '' GROUP BY doc_id""")
def snk04_article_markdown(spark, sf):
    c = _claimed(spark, sf)
    return A.article_markdown(c, _articles(c))


_GRID = f"""cells AS (SELECT page_id, idx % 4 "row", k % 3 col, arg_max(label, idx) t FROM boxes GROUP BY ALL), g AS (SELECT p.page_id, r."row", c.col, coalesce(cells.t, '') t FROM (SELECT DISTINCT page_id FROM boxes) p, (SELECT unnest(range(4)) "row") r, (SELECT unnest(range(3)) col) c LEFT JOIN cells ON cells.page_id = p.page_id AND cells."row" = r."row" AND cells.col = c.col)"""


def _cells(spark, sf) -> DataFrame:
    b = T.boxes(spark, sf)
    r = (F.col("idx") % 4).cast("int")
    return b.select(F.col("page_id").alias("table"), r.alias("row"), (F.col("k") % 3).cast("int").alias("col"), F.col("idx").alias("ordinal"), F.col("label").alias("text"), (r == 0).alias("is_header"))


@query(f"WITH {BOXES}, {_GRID}, l AS (SELECT page_id, \"row\", '| ' || string_agg(t, ' | ' ORDER BY col) || ' |' || CASE WHEN \"row\" = 0 THEN chr(10) || '| --- | --- | --- |' ELSE '' END line FROM g GROUP BY page_id, \"row\") SELECT page_id AS \"table\", string_agg(line, chr(10) ORDER BY \"row\") || chr(10) markdown FROM l GROUP BY page_id")
def snk06_table_markdown(spark, sf):
    return A.grids(_cells(spark, sf), 4, 3).select("table", A.grid_markdown(F.col("grid")).alias("markdown"))


@query(f"WITH {BOXES}, {_GRID}, h AS (SELECT *, CASE WHEN \"row\" = 0 AND t <> '' THEN 'th' ELSE 'td' END tag FROM g), l AS (SELECT page_id, \"row\", '  <tr>' || chr(10) || string_agg('    <' || tag || '>' || t || '</' || tag || '>', chr(10) ORDER BY col) || chr(10) || '  </tr>' line FROM h GROUP BY ALL) SELECT page_id AS \"table\", '<table>' || chr(10) || string_agg(line, chr(10) ORDER BY \"row\") || chr(10) || '</table>' html FROM l GROUP BY page_id")
def snk08_table_html(spark, sf):
    return A.grids(_cells(spark, sf), 4, 3).select("table", A.grid_html(F.col("grid")).alias("html"))


_ESC = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PROV = "'data-page=\"' || page_no || '\" data-bbox=\"' || concat_ws(',', " + ", ".join(f"printf('%.1f', {c})" for c in ("x1", "y1", "x2", "y2")) + ") || '\"'"
_EL = " ".join(f"WHEN category = '{c}' THEN '<{t} {k}' || prov || '>' || esc || '</{t}>'" for c, t, k in (("Headline", "h1", ""), ("Subhead", "h2", ""), ("Paragraph", "p", ""), ("Quote", "blockquote", ""), ("Dropcap", "span", 'class="dropcap" '), ("Footnote", "aside", 'class="footnote" ')))


@query(f"""WITH {BLOCKS}, {_flow('f.doc_id = b.doc_id')}, t AS (SELECT *, {_ESC} esc, {_PROV} prov FROM flow),
l AS (SELECT doc_id, "at", "inner", pos own, CASE WHEN "inner" THEN '  <figcaption>' || esc || '</figcaption>' WHEN category = 'Abandon' THEN NULL WHEN category = 'Advertisement' THEN '<aside class="advertisement" ' || prov || '></aside>' WHEN category = 'Figure' THEN '<figure ' || prov || '>' || chr(10) || '  <img src="" alt="Figure"/>' {_EL} ELSE '<p class="' || lower(category) || '" ' || prov || '>' || esc || '</p>' END line FROM t
  UNION ALL SELECT doc_id, pos, true, 1073741824, '</figure>' FROM blocks WHERE category = 'Figure')
SELECT doc_id, '<div class="article-body">' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY "at", "inner", own), '') || chr(10) || '</div>' html FROM l GROUP BY doc_id""")
def snk07_document_html(spark, sf):
    return A.html(T.blocks(spark, sf))


_JSON_ITEM = "'{\"item_id\":' || pos || ',\"category\":\"' || category || '\",\"page_no\":' || page_no || CASE WHEN text <> '' THEN ',\"text\":' || to_json(text) ELSE '' END || CASE WHEN category IN ('Caption', 'FigByline') AND figure_id IS NOT NULL THEN ',\"figure_id\":' || figure_id ELSE '' END || '}'"


@query(f"""WITH {BLOCKS}, {_RUNS}, {_ARTICLES}, b AS (SELECT doc_id, block, any_value(article) article, string_agg({_JSON_ITEM}, ',' ORDER BY pos) items, string_agg(DISTINCT page_no, ',' ORDER BY page_no) pages FROM k GROUP BY doc_id, block)
SELECT b.doc_id, block, '{{' || CASE WHEN b.article IS NOT NULL THEN '"article_id":' || b.article || ',' ELSE '' END || '"title":' || to_json(coalesce(title, '')) || CASE WHEN section IS NOT NULL THEN ',"section":' || to_json(section) ELSE '' END || ',"page_nos":[' || pages || '],"continued":' || CASE WHEN coalesce(continued, false) THEN 'true' ELSE 'false' END || ',"items":[' || items || ']}}' json FROM b LEFT JOIN arts ON arts.doc_id = b.doc_id AND arts.article = b.article""")
def snk09_article_json(spark, sf):
    c = _claimed(spark, sf)
    return A.article_json(c, _articles(c))


_IMAGES = "images AS (SELECT DISTINCT page_id, 900 width, 1000 height, 'mag_' || page_id || '.png' file_name, CASE page_id % 3 WHEN 0 THEN 'News' WHEN 1 THEN '' END page_type, CAST(NULL AS VARCHAR) nothing FROM boxes)"


def _images(b: DataFrame) -> DataFrame:
    p = F.col("page_id")
    kind = F.when(p % 3 == 0, "News").when(p % 3 == 1, "")
    return b.select("page_id").distinct().select("page_id", F.lit(900).alias("width"), F.lit(1000).alias("height"), F.concat(F.lit("mag_"), p.cast("string"), F.lit(".png")).alias("file_name"), kind.alias("page_type"), F.lit(None).cast("string").alias("nothing"))


def _marked(spark, sf) -> DataFrame:
    return T.boxes(spark, sf).withColumn("ignore", F.col("k") % 5 == 0).withColumn("order", F.when(F.col("k") % 4 != 0, F.col("idx")))


_N = "printf('%.1f', {c})"
_DET = "'{\"category_type\":\"' || label || '\",\"poly\":[' || concat_ws(',', " + ", ".join(_N.format(c=c) for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")) + ") || '],\"ignore\":' || CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END || CASE WHEN k % 4 <> 0 THEN ',\"order\":' || idx ELSE '' END || ',\"anno_id\":' || idx || ',\"text\":\"__B' || idx || '__\"}'"


@query(f"WITH {BOXES}, {_IMAGES}, d AS (SELECT page_id, string_agg({_DET}, ',' ORDER BY idx) dets FROM boxes WHERE page_id % 10 <> 3 GROUP BY page_id) SELECT i.page_id, '{{\"layout_dets\":[' || coalesce(dets, '') || '],\"page_info\":{{\"page_no\":' || i.page_id || ',\"height\":1000,\"width\":900,\"image_path\":\"' || file_name || '\"}}}}' json FROM images i LEFT JOIN d USING (page_id)")
def snk12_benchmark_pages(spark, sf):
    """Images without regions stay as empty pages."""
    b = _marked(spark, sf)
    return A.benchmark_pages(b.where("page_id % 10 <> 3"), _images(b))


@query(f"WITH {BOXES}, {_IMAGES} SELECT page_id, 1 n, coalesce(nullif(page_type, ''), 'unknown') source FROM images")
def snk13_page_attributes(spark, sf):
    """A field that no image has gives no attribute (also AGG-22: does any image have the field)."""
    a = A.page_attributes(_images(T.boxes(spark, sf)), {"data_source": "page_type", "gone": "nothing"})
    return a.select("page_id", F.size("attributes").alias("n"), F.element_at("attributes", "data_source").alias("source"))


_TYPE = "CASE label WHEN 'Headline' THEN 'title' WHEN 'Paragraph' THEN 'text' WHEN 'Figure' THEN 'figure' WHEN 'Caption' THEN 'figure_caption' WHEN 'Subhead' THEN 'title' ELSE 'abandon' END"


@query(f"WITH {BOXES}, {PREDICTED}, t AS (SELECT *, {_TYPE} category_type FROM pred), i AS (SELECT category_type, CAST(row_number() OVER (ORDER BY category_type) - 1 AS INTEGER) category_id FROM (SELECT DISTINCT category_type FROM t)) SELECT 'mag_' || page_id image_name, [x1, y1, x2, y2] bbox, category_id, category_type, CAST(score AS DOUBLE) score FROM t JOIN i USING (category_type)")
def snk14_detections(spark, sf):
    p = T.predicted(spark, sf)
    return A.detections(p.withColumn("score", F.col("score").cast("double")).join(_images(p).select("page_id", "file_name"), "page_id"))


@query(f"WITH {BOXES}, {PREDICTED} SELECT 'mag_' || page_id image_name, [x1, y1, x2, y2] bbox, idx AS category_id FROM pred UNION ALL SELECT 'gold_' || page_id, [x1, y1, x2, y2], idx FROM boxes")
def snk15_joined_predictions(spark, sf):
    """Predictions of several runs one after another, with the category ids that they came with."""
    side = lambda df, name: df.select(F.concat(F.lit(name), F.col("page_id").cast("string")).alias("image_name"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("idx").alias("category_id"))
    return side(T.predicted(spark, sf), "mag_").unionByName(side(T.boxes(spark, sf), "gold_"))


@query(f"WITH {BOXES} SELECT page_id, coalesce(string_agg('__B' || idx || '__', chr(10) || chr(10) ORDER BY idx) FILTER (k % 5 <> 0 AND k % 4 <> 0), '') markdown FROM boxes GROUP BY page_id")
def snk16_stub_markdown(spark, sf):
    return A.stub_markdown(_marked(spark, sf))


@query(f"WITH {BOXES}, r AS (SELECT page_id, idx AS pos, label AS category, label || ' ' || idx AS text, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, idx) rank FROM boxes), l AS (SELECT *, {_MD} line FROM r) SELECT page_id, string_agg(line, chr(10) ORDER BY rank) markdown FROM l GROUP BY page_id")
def snk17_region_markdown(spark, sf):
    """A page's regions in reading order, before any paragraphs are merged."""
    b = L.reading_order(T.boxes(spark, sf))
    return A.markdown(b.select("page_id", F.col("rank").alias("pos"), F.col("label").alias("category"), F.concat_ws(" ", "label", F.col("idx").cast("string")).alias("text"), F.lit(None).cast("int").alias("figure_id")), ("page_id",))


@query("WITH s AS (SELECT lang AS model, avg(n_chars) chars, avg(quality) quality FROM documents LEFT JOIN (SELECT * FROM labels WHERE doc_id % 2 = 0) l USING (doc_id) GROUP BY lang) SELECT model, '| ' || model || ' | ' || printf('%.4f', chars) || ' | ' || coalesce(printf('%.4f', quality), '—') || ' | — |' AS \"row\" FROM s")
def snk18_report(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model"), "n_chars")
    q = d.join(T.table(spark, sf, "labels").where("doc_id % 2 = 0"), "doc_id").select("model", F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value"))
    return A.report(d.select("model", F.lit("chars").alias("metric"), F.col("n_chars").cast("double").alias("value")).unionByName(q), ["chars", "quality", "none"])


# --- files
#: Page ids that a COCO file spans: it has a quarter of them, at most.
SPAN = 1 << 16


def _paged(spark, sf) -> DataFrame:
    b = T.boxes(spark, sf)
    part = F.lpad(F.floor(F.col("page_id") / SPAN).cast("string"), 12, "0")
    return b.select((F.col("page_id") % 4).alias("set"), F.concat_ws("-", (F.col("page_id") % 4).cast("string"), part).alias("file"), F.col("page_id").alias("image_id"), F.concat(F.lit("mag_"), F.col("page_id").cast("string"), F.lit(".png")).alias("file_name"), F.lit(900.0).alias("width"), F.lit(1000.0).alias("height"), "idx", "label", "x1", "y1", "x2", "y2", F.col("score").cast("double").alias("score"), F.when(F.col("idx") % 3 != 0, F.col("idx")).alias("order_id"))


def _coco_folder(spark, sf) -> str:
    """Boxes written as four sets of COCO files, as a user would hand them in; a set's files follow each other by page."""
    path = D.scratch(spark)
    D.write_outputs(D.coco_json(_paged(spark, sf), "file", "set"), path, "file", "json")
    return path


@query(f"WITH {BOXES} SELECT page_id AS image_id, 'mag' stem, CAST(page_id AS INTEGER) page, label, x1, y1, x2, y2, CAST(score AS DOUBLE) score, CASE WHEN idx % 3 <> 0 THEN idx ELSE -1 END order_id FROM boxes")
def src05_coco_scan(spark, sf):
    """Written as COCO files (SNK-10) and read back: SRC-05, SRC-07, SUP-06, JN-01 and SUP-12 in one."""
    r = D.coco_regions(spark, _coco_folder(spark, sf) + "/*")
    return r.select("image_id", "stem", "page", "label", "x1", "y1", "x2", "y2", "score", "order_id")


@query(f"WITH {BOXES} SELECT CAST(row_number() OVER (ORDER BY page_id % 4, page_id) AS BIGINT) id, 'mag_' || page_id || '.png' file_name FROM (SELECT DISTINCT page_id FROM boxes)")
def set01_joined_images(spark, sf):
    """Several COCO files as one (SET-01 to SET-03): images are numbered anew, by file and natural order of names."""
    return D.joined_coco(D.coco_files(spark, _coco_folder(spark, sf) + "/*"))[0].select("id", "file_name")


@query(f"WITH {BOXES}, i AS (SELECT page_id, CAST(row_number() OVER (ORDER BY page_id % 4, page_id) AS BIGINT) image_id FROM (SELECT DISTINCT page_id FROM boxes)), c AS (SELECT page_id % 4 f, label, row_number() OVER (PARTITION BY page_id % 4 ORDER BY label) n FROM (SELECT DISTINCT page_id % 4 page_id, label FROM boxes)) SELECT CAST(row_number() OVER (ORDER BY b.page_id % 4, b.page_id, idx) AS BIGINT) id, image_id, CAST(c.n AS BIGINT) category_id FROM boxes b JOIN i USING (page_id) JOIN c ON c.f = b.page_id % 4 AND c.label = b.label")
def set02_joined_annotations(spark, sf):
    return D.joined_coco(D.coco_files(spark, _coco_folder(spark, sf) + "/*"))[1].select("id", "image_id", "category_id")


@query(f"WITH {BOXES} SELECT page_id, idx, CAST(row_number() OVER (ORDER BY page_id, idx) - 1 AS BIGINT) id FROM boxes")
def set07_sequential_ids(spark, sf):
    return D.numbered(T.boxes(spark, sf).select("page_id", "idx"), ["page_id", "idx"], "id")


@query(f"WITH {BOXES} SELECT CAST(dense_rank() OVER (ORDER BY page_id) - 1 AS INTEGER) image_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY idx) - 1 AS INTEGER) idx, label, x1, y1, x2, y2, CASE WHEN k % 4 <> 0 THEN idx END \"order\", '__B' || idx || '__' AS \"text\" FROM boxes WHERE k % 5 <> 0 AND page_id < 2000")
def src08_benchmark_pages(spark, sf):
    """Benchmark pages written as one JSON array and read back without what is to be ignored (SRC-08 to SRC-10)."""
    b = _marked(spark, sf).where("page_id < 2000")
    pages = A.benchmark_pages(b, _images(b))
    path = D.scratch(spark)
    one = pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "json"))), lambda x: x["json"]), ",").alias("j"))
    one.select(F.concat(F.lit("["), "j", F.lit("]")).alias("value")).coalesce(1).write.text(path)
    r = D.benchmark_regions(spark, path, drop_ignore=True)
    dense = (F.row_number().over(Window.partitionBy("image_id").orderBy("idx")) - 1).alias("idx")
    rank = r.where("label is not null").select("*", F.regexp_extract("stem", "([0-9]+)$", 1).cast("int").alias("page"))
    pages_at = rank.select("page").distinct().select("page", (F.row_number().over(Window.orderBy("page")) - 1).alias("at"))  # a few pages
    return rank.join(pages_at, "page").select(F.col("at").alias("image_id"), dense, "label", "x1", "y1", "x2", "y2", "order", "text")


def _html_files(spark, sf) -> DataFrame:
    return T.table(spark, sf, "pages").select(F.concat(F.lit("p"), (F.col("page_id") % 50).cast("string")).alias("folder"), F.col("page_id"), F.col("url").alias("markdown"))


_FOLDERS = "f AS (SELECT 'p' || (page_id % 50) folder, CASE WHEN page_id % 7 = 0 THEN 'p' || (page_id % 50) || '.md' WHEN page_id % 2 = 0 THEN 'a' || page_id || '.mmd' ELSE 'b' || page_id || '.md' END \"name\", url markdown FROM pages)"


@query(f"""WITH {_FOLDERS}, w AS (SELECT *, suffix(name, '.md') md, regexp_replace(name, '[.][^./]+$', '') = folder own, count(*) FILTER (suffix(name, '.md')) OVER p n_md, count(*) FILTER (NOT suffix(name, '.md')) OVER p n_mmd, count(*) FILTER (regexp_replace(name, '[.][^./]+$', '') = folder) OVER p n_own FROM (SELECT DISTINCT * FROM f) WINDOW p AS (PARTITION BY folder)),
c AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY md DESC, name, markdown) r FROM w WHERE CASE WHEN n_own > 0 THEN own WHEN n_md > 0 THEN md AND n_md = 1 ELSE n_mmd = 1 END) SELECT folder stem, count(*) n FROM c WHERE r = 1 GROUP BY folder""")
def src19_folder_markdown(spark, sf):
    p = T.table(spark, sf, "pages").select(F.concat(F.lit("p"), (F.col("page_id") % 50).cast("string")).alias("folder"), "page_id", F.col("url").alias("markdown"))
    s = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 7 == 0, F.concat("folder", F.lit(".md"))).when(F.col("page_id") % 2 == 0, F.concat(F.lit("a"), s, F.lit(".mmd"))).otherwise(F.concat(F.lit("b"), s, F.lit(".md")))
    return D.folder_markdown(p.select("folder", name.alias("name"), "markdown").distinct()).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source stem, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (text <> '') markdown FROM documents WHERE doc_id % 3 <> 0 GROUP BY source")
def src18_odb_json(spark, sf):
    """Prediction JSON, a map from image names to blocks, written and read back; empty blocks add nothing."""
    block = F.struct(F.col("doc_id").alias("k"), F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("content")).alias("b"))
    per = T.table(spark, sf, "documents").groupBy("source").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("blocks"))
    value = per.select(F.to_json(F.create_map(F.concat("source", F.lit(".jpg")), F.col("blocks"))).alias("value"))
    return D.odb_markdown(value)


@query("WITH d AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) ps FROM (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)) SELECT 'd' || doc_id || '_' || (i - 1) stem, regexp_replace(p, '^\\n+|\\n+$', '', 'g') markdown FROM (SELECT doc_id, unnest(ps) p, generate_subscripts(ps, 1) i FROM d)")
def src21_split_markdown(spark, sf):
    t = F.replace("text", F.lit("\n"), F.lit("\n<!-- page -->\n"))
    return D.split_markdown(T.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"), t.alias("markdown")), "<!-- page -->")


# --- linking
_KEYED = f"e AS (SELECT doc_id, pos, article, w FROM (SELECT doc_id, pos, article, unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) w FROM a))"


def _entities(c: DataFrame) -> DataFrame:
    return c.select("doc_id", "pos", "article", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 1)).alias("text")).withColumn("label", F.lit("LOC"))


def _stem_sql(c: str) -> str:
    """Lower-case words without an ending that leaves five letters or more, the endings written out in their order."""
    ends = "jema|jevi|jeva|jevo|jem|jev|jih|oma|ama|ega|emu|ovi|ova|ovo|ov|om|em|ju|ja|je|mi|ih|ah|am|u|a|e|i|o"
    return f"regexp_replace(lower({c}), '^(.{{5,}}?)(?:{ends})$', '\\1')"


_INDEX = f"{_ARTICLE}, {_KEYED}, ix AS (SELECT DISTINCT doc_id, pos, article, {_stem_sql('w')} AS key FROM e)"


@query(f"WITH {BLOCKS}, {_INDEX} SELECT * FROM ix")
def sup11_entity_index(spark, sf):
    return K.entity_index(_entities(_claimed(spark, sf)))


_WEIGHTS = f"{_INDEX}, n AS (SELECT doc_id, count(DISTINCT article) n FROM a WHERE article IS NOT NULL GROUP BY doc_id), df AS (SELECT doc_id, key, count(DISTINCT article) df FROM ix WHERE article IS NOT NULL GROUP BY ALL), kw AS (SELECT doc_id, key, df, CASE WHEN df > greatest(2.0, 0.25 * n) THEN 0.0 ELSE ln(n / df) + 1 END weight FROM df JOIN n USING (doc_id))"


@query(f"WITH {BLOCKS}, {_WEIGHTS} SELECT doc_id, key, df, round(weight, 6) weight FROM kw")
def agg12_key_weights(spark, sf):
    """Over all articles of a document, those without a key included."""
    c = _claimed(spark, sf)
    return K.key_weights(K.entity_index(_entities(c)), c.where("article is not null")).withColumn("weight", _r("weight"))


def jn15_cross_links(spark, sf):
    c = _claimed(spark, sf)
    ix = K.entity_index(_entities(c))
    return K.cross_links(ix, K.key_weights(ix, c.where("article is not null")))


_STARTS = f"{_ARTICLE}, q AS (SELECT *, category IN ('Subhead', 'Subsubhead') AND trim(text, ' ') <> '' AND NOT regexp_matches(text, ':[ \\t]*$') AND NOT regexp_matches(text, '^[ \\t]*\\(?[0-9]{{1,2}}[ \\t]*[.)]') heading FROM a WHERE article IS NOT NULL), st AS (SELECT *, heading AND NOT coalesce(lag(heading) OVER (PARTITION BY doc_id, article ORDER BY pos), false) start FROM q)"


@query(f"WITH {BLOCKS}, {_STARTS} SELECT doc_id, article, pos, start AS \"start\" FROM st")
def win11_heading_runs(spark, sf):
    return K.piece_starts(_claimed(spark, sf)).select("doc_id", "article", "pos", "start")


@query(f"WITH {BLOCKS}, {_STARTS}, g AS (SELECT doc_id, article, count(*) FILTER (start) starts, count(*) FILTER (category NOT IN ('Header', 'Footer', 'PageNum', 'Abandon')) body FROM st GROUP BY ALL) SELECT *, round(body / nullif(starts, 0), 6) per_heading FROM g")
def agg18_heading_density(spark, sf):
    return K.density(_claimed(spark, sf)).withColumn("per_heading", _r("per_heading"))


@query(f"""WITH {BLOCKS}, {_STARTS}, g AS (SELECT doc_id, article, count(*) FILTER (start) starts, count(*) FILTER (category <> 'Abandon') body FROM st GROUP BY ALL),
w AS (SELECT doc_id, article, CASE WHEN article % 2 = 0 THEN starts >= 2 AND body / nullif(starts, 0) <= 12 ELSE starts >= 1 AND body / nullif(starts, 0) <= 10 END "col" FROM g)
SELECT st.doc_id, st.article, pos, CASE WHEN "col" THEN count(*) FILTER (start) OVER (PARTITION BY st.doc_id, st.article ORDER BY pos ROWS UNBOUNDED PRECEDING) ELSE 0 END piece FROM st JOIN w USING (doc_id, article)""")
def win13_split_columns(spark, sf):
    """With bounds that the short test articles meet; even articles run in a section known as a column."""
    c = _claimed(spark, sf)
    sections = c.where("article is not null").select("doc_id", "article").distinct().withColumn("section", F.when(F.col("article") % 2 == 0, "ODMEVI").otherwise("x"))
    return K.split_columns(c, sections, strict=(1, 10.0), relaxed=(2, 12.0)).select("doc_id", "article", "pos", "piece")


@query(f"WITH {BLOCKS}, {_ARTICLE} SELECT doc_id, article, min(pos) first_pos, list(pos ORDER BY pos) items FROM a WHERE article IS NOT NULL AND category NOT IN ('Header', 'Footer', 'PageNum', 'Abandon') GROUP BY doc_id, article")
def win15_rebuilt_articles(spark, sf):
    """Membership from the items; first_pos is the order of articles (WIN-14, SUP-01, SUP-02)."""
    return K.rebuilt(_claimed(spark, sf))


@query(f"WITH {BLOCKS}, {_ARTICLE} SELECT doc_id, article, arg_min(text, pos) first_text, arg_max(text, pos) last_text FROM a WHERE article IS NOT NULL AND trim(text, ' ') <> '' AND category NOT IN ('Figure', 'Table') GROUP BY doc_id, article")
def win16_seams(spark, sf):
    return K.seams(_claimed(spark, sf))


@query(f"WITH {BLOCKS}, {_ARTICLE} SELECT doc_id, article, list_sort(list(DISTINCT page_no)) pages, count(*) n_items FROM a WHERE article IS NOT NULL GROUP BY doc_id, article")
def sup07_article_pages(spark, sf):
    return K.article_pages(_claimed(spark, sf))


_HEADERS = "hd AS (SELECT doc_id, page_no, pos, CASE WHEN caps <> '' THEN caps ELSE trim(text, ' ') END h FROM (SELECT doc_id, page_no, pos, text, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t]+'), lambda w: regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '\\p{Ll}')), ' ') caps FROM blocks WHERE category = 'Section')), rh AS (SELECT doc_id, page_no, arg_max(h, {'n': length(h), 'k': -pos}) header FROM hd WHERE h <> '' AND len(regexp_extract_all(h, '[\\p{L}\\p{N}_]+')) BETWEEN 1 AND 60 GROUP BY ALL)"


@query(f"WITH {BLOCKS}, {_HEADERS}, {_ARTICLE}, p AS (SELECT DISTINCT doc_id, article, page_no FROM a WHERE article IS NOT NULL) SELECT p.doc_id, p.article, arg_min(header, p.page_no) FILTER (header IS NOT NULL) section FROM p LEFT JOIN rh USING (doc_id, page_no) GROUP BY p.doc_id, p.article")
def agg17_article_sections(spark, sf):
    """The first page that has a readable header gives the section (headers of up to 60 words, as the test lines are long)."""
    c = _claimed(spark, sf)
    return K.article_sections(c, K.running_headers(c, 60))


def win12_section_changes(spark, sf):
    c = _claimed(spark, sf)
    return K.split_sections(c, K.running_headers(c, 60)).select("doc_id", "article", "pos", "piece")


def str12_character_similarity(spark, sf):
    p = T.next_lines(spark, sf, "nxt")
    return p.select("doc_id", "pos", _r(S.character_similarity(F.col("text"), F.col("nxt"))).alias("similarity"))


def str13_same_section(spark, sf):
    p = T.next_lines(spark, sf, "nxt")
    return p.select("doc_id", "pos", S.same_section(F.col("text"), F.col("nxt")).alias("same"))


def win17_continuation_scores(spark, sf):
    """Also the veto WIN-18 and the seam WIN-16."""
    c = _claimed(spark, sf)
    ix = K.entity_index(_entities(c))
    t = K.article_table(c, ix, K.key_weights(ix, c.where("article is not null")))
    return K.continuation_scores(t).withColumn("score", _r("score"))


def win19_merged_articles(spark, sf):
    c = _claimed(spark, sf)
    ix = K.entity_index(_entities(c))
    return K.merged_articles(K.article_table(c, ix, K.key_weights(ix, c.where("article is not null"))))[0]


def pip05_link_document(spark, sf):
    """The items' final articles and how many cross-links each item has."""
    c = _claimed(spark, sf).select("doc_id", "page_no", "pos", "category", "text", "article")
    items, links = K.link_document(c, _entities(c).drop("article"))
    cross = links.where("kind = 'entity-overlap'").select("doc_id", F.explode(F.array(F.col("source").cast("int"), F.col("target").cast("int"))).alias("pos"))
    n = cross.groupBy("doc_id", "pos").agg(F.count(F.lit(1)).alias("links"))
    return items.join(n, ["doc_id", "pos"], "left").select("doc_id", "pos", "article", F.coalesce("links", F.lit(0)).alias("links"))


def jn10_orphan_captions(spark, sf):
    c = _claimed(spark, sf)
    ix = K.entity_index(_entities(c))
    return K.orphan_captions(c, ix, K.key_weights(ix, c.where("article is not null")))


@query(f"WITH {BLOCKS}, {_ARTICLE} SELECT doc_id, pos, article, arts.title FROM a LEFT JOIN (SELECT doc_id, article, min(text) FILTER (category = 'Headline') title FROM a WHERE article IS NOT NULL GROUP BY ALL) arts USING (doc_id, article) WHERE category = 'Paragraph'")
def sup05_article_titles(spark, sf):
    """The article and title of an item: two lookups."""
    c = _claimed(spark, sf)
    return c.where("category = 'Paragraph'").join(_articles(c).select("doc_id", "article", "title"), ["doc_id", "article"], "left").select("doc_id", "pos", "article", "title")


@query(f"WITH {BLOCKS}, {_ARTICLE}, c AS (SELECT DISTINCT doc_id, article, 'x' || (doc_id + article) k FROM a WHERE article IS NOT NULL), s AS (SELECT doc_id, article, (doc_id + article) % 8 v FROM c) SELECT doc_id, article, CASE v WHEN 0 THEN 'intervju' WHEN 1 THEN 'novice' WHEN 2 THEN NULL WHEN 3 THEN 'pisma' WHEN 4 THEN 'intervju' WHEN 5 THEN 'novice' WHEN 6 THEN 'pisma' ELSE NULL END genre FROM s")
def pip08_classified(spark, sf):
    """A stand-in classifier that answers in a sentence, or not at all; short texts fall back to the section."""
    a = _claimed(spark, sf).where("article is not null").select("doc_id", "article").distinct()
    v = (F.col("doc_id") + F.col("article")) % 8
    reply = F.when(v == 0, "To je intervju.").when(v == 1, "Novice").when(v == 3, "pisma!").when(v == 4, "INTERVJU").otherwise("ne vem")
    section = F.when(v == 5, "Odmevi").when(v == 6, "Pisma bralcev").otherwise("")
    return K.classified(a.select("doc_id", "article", F.lit("x" * 50).alias("text"), section.alias("section")), reply)


# --- lookups over names
@query(f"WITH {BOXES}, {PREDICTED}, pairs AS (SELECT * FROM (SELECT p.page_id, p.idx i, g.idx j, {_iou('p', 'g')} s FROM pred p JOIN boxes g ON p.page_id = g.page_id) WHERE s >= 0.5), m AS ({'WITH ' + _greedy('pairs', '-')}) SELECT p.page_id, p.idx, coalesce(g.label || g.idx, '__UNMATCHED' || p.idx || '__') AS \"text\" FROM pred p LEFT JOIN m ON m.page_id = p.page_id AND m.i = p.idx LEFT JOIN boxes g ON g.page_id = m.page_id AND g.idx = m.j")
def jn04_relabelled(spark, sf):
    g = T.boxes(spark, sf).withColumn("text", F.concat("label", F.col("idx").cast("string")))
    return L.relabelled(T.predicted(spark, sf), g)


@query(f"WITH {BOXES}, {PREDICTED}, ann AS (SELECT page_id, idx, label, x1 / CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END * CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END x1, y1, x2, y2 FROM boxes), pairs AS (SELECT * FROM (SELECT p.page_id, p.idx i, g.idx j, {_iou('p', 'g')} s FROM pred p JOIN ann g ON p.page_id = g.page_id) WHERE s >= 0.5), {_greedy('pairs', '-')}")
def jn05_match_scaled(spark, sf):
    """Annotations of even pages are at half size and scaled back by their pages' factors."""
    b = T.boxes(spark, sf)
    k = F.when(F.col("page_id") % 2 == 0, F.lit(0.5)).otherwise(F.lit(1.0))
    small = b.select("page_id", "idx", *[(F.col(c) * k).alias(c) for c in ("x1", "y1", "x2", "y2")])
    sizes = b.where("page_id % 2 = 0").select("page_id", F.lit(2.0).alias("fx"), F.lit(2.0).alias("fy")).distinct()
    return L.match_scaled(T.predicted(spark, sf), small, sizes).select("page_id", "i", "j", _r("s").alias("s"))


@query("WITH h AS (SELECT page_id, sha256(html) digest, 'orig_' || (page_id % 20) || '.pdf' \"name\" FROM pages WHERE page_id % 3 <> 0), c AS (SELECT p.page_id, sha256(p.html) digest, h.name FROM pages p LEFT JOIN (SELECT digest, min(name) AS name FROM h GROUP BY digest) h ON h.digest = sha256(p.html)), n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY page_id) r FROM c) SELECT page_id, CASE WHEN name IS NULL THEN digest || '.pdf' WHEN r = 1 THEN name ELSE regexp_replace(name, '[.]pdf$', '') || '_' || r || '.pdf' END \"name\" FROM n")
def jn20_collected_names(spark, sf):
    """Files named after their digest get their original names back (JN-19); names that clash are numbered."""
    from ..operators import names as N

    p = T.table(spark, sf, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    named = p.where("page_id % 3 <> 0").select("digest", F.concat(F.lit("orig_"), (F.col("page_id") % 20).cast("string"), F.lit(".pdf")).alias("name"))
    return N.collected(p, named, "page_id")


@query("SELECT d.doc_id, l.quality IS NOT NULL AS scored FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn21_documents_with_truth(spark, sf):
    """Documents with ground truth are scored; the others are listed as skipped."""
    from ..operators import names as N

    scored, skipped = N.with_truth(T.table(spark, sf, "documents").select("doc_id"), T.table(spark, sf, "labels"), "doc_id")
    return scored.select("doc_id", F.lit(True).alias("scored")).unionByName(skipped.select("doc_id", F.lit(False).alias("scored")))


@query(f"WITH {BLOCKS} SELECT b.doc_id, b.pos, f.pos figure FROM blocks b JOIN blocks f ON f.doc_id = b.doc_id AND f.pos = b.figure_id AND f.category = 'Figure' WHERE b.category IN ('Caption', 'FigByline')")
def jn22_inlined_captions(spark, sf):
    """Captions that their figure pulls in; they are left out of the flow."""
    return A.in_flow(T.blocks(spark, sf)).where("place.inner").select("doc_id", "pos", F.col("place.at").alias("figure"))

"""From regions to documents and what is written of them: recognised text, blocks, Markdown, HTML, JSON. DataFrame -> DataFrame.

Items are rows (doc_id, page_no, pos, category, text, figure_id, ...), pos being their place in the document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as V
from ..functions import text as X


# --- recognised text
def empty_regions(regions: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Regions without text that recognition should fill: of the wanted labels (all), but no pictures and forms."""
    open_ = ~F.col("label").isin("Figure", "Form", "Abandon") & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return regions.where(open_ & F.col("label").isin(*wanted) if wanted else open_)


def recognised(tsv: DataFrame) -> DataFrame:
    """Words of a recogniser's table (text, conf as text) with a confidence: blank words and rows that are no words go."""
    return tsv.withColumn("confidence", F.expr("try_cast(conf as double)")).where((F.trim("text") != "") & (F.col("confidence") >= 0))


def recognised_text(tsv: DataFrame, least: float = 40.0) -> DataFrame:
    """(page, text, confidence, accepted): lines in order, mean confidence of the words (0 without any)."""
    per_line = recognised(tsv).groupBy("page", "line_num").agg(F.array_sort(F.collect_list(F.struct("word_num", F.trim("text").alias("w")))).alias("m"), F.sum("confidence").alias("s"), F.count(F.lit(1)).alias("n"))
    line = per_line.select("page", "line_num", F.array_join(F.col("m.w"), " ").alias("t"), "s", "n")
    page = line.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line_num", "t"))).alias("m"), (F.sum("s") / F.sum("n")).alias("c"))
    out = tsv.select("page").distinct().join(page, "page", "left").select("page", F.coalesce(F.array_join(F.col("m.t"), "\n"), F.lit("")).alias("text"), F.coalesce("c", F.lit(0.0)).alias("confidence"))
    return out.withColumn("accepted", (F.col("text") != "") & (F.col("confidence") >= least))


def filled(regions: DataFrame, found: DataFrame, key: Sequence[str], least: float = 40.0) -> DataFrame:
    """Regions whose empty texts are taken from accepted recognitions (key, new_text, confidence)."""
    good = found.where((F.trim("new_text") != "") & (F.col("confidence") >= least)).select(*key, "new_text")
    gap = empty_regions(regions).select(*key, F.lit(True).alias("gap"))
    out = regions.join(gap, list(key), "left").join(good, list(key), "left")
    return out.withColumn("text", F.when(F.col("gap") & F.col("new_text").isNotNull(), F.col("new_text")).otherwise(F.col("text"))).drop("gap", "new_text")


def classifier_text(items: DataFrame, budget: int) -> DataFrame:
    """(doc_id, article): section, then texts in order as long as they fit the budget; cut between items."""
    head = F.concat(F.lit("Rubrika: "), F.coalesce("section", F.lit("")))
    body = items.withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    total = F.sum(F.length("t")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    room = F.lit(budget) - F.length(head) - len("Besedilo: ")
    fits = body.withColumn("fits", (F.col("t") != "") & (total <= room)).withColumn("head", head)
    g = fits.groupBy("doc_id").agg(F.min("head").alias("head"), F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("pos", "t")))).alias("m"))
    return g.select("doc_id", F.array_join(F.concat(F.array(F.col("head"), F.lit("Besedilo: ")), F.col("m.t")), "\n\n").alias("article"))


# --- Markdown
def markdown_text(category: Column, t: Column) -> Column:
    """Markdown of one item with what ends it; null for items that are left out."""
    line = F.when(category.isin("Abandon", "Advertisement"), F.lit(None).cast("string")).when(category == "Dropcap", t).when(category == "Figure", F.lit("![Figure]()\n"))
    for c, (a, b) in X.MARKDOWN.items():
        line = line.when(category == c, F.concat(F.lit(a), t, F.lit(b + "\n")))
    return line.otherwise(F.concat(t, F.lit("\n")))


def in_flow(items: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """items with a struct `place`: captions stand right after their figure, where it is there; all else at its pos."""
    figures = items.where("category = 'Figure'").select(*by, F.col("pos").alias("wanted"), F.lit(True).alias("there"))
    caption = F.col("category").isin("Caption", "FigByline")
    joined = items.withColumn("wanted", F.when(caption, F.col("figure_id"))).join(figures, [*by, "wanted"], "left")
    place = F.struct(F.when(F.col("there"), F.col("wanted")).otherwise(F.col("pos")).alias("at"), F.coalesce("there", F.lit(False)).alias("inner"), F.col("pos").alias("own"))
    return joined.select(*items.columns, place.alias("place"))


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n")


def markdown(items: DataFrame, by: Sequence[str] = ("doc_id",), raw: bool = False) -> DataFrame:
    """(by, markdown) of the items of each document, page or article; raw: texts that are not blank, without any markup."""
    t = F.coalesce("text", F.lit(""))
    if raw:
        rows = items.where(F.trim(t) != "").select(*by, F.struct("pos", t.alias("t")).alias("x"))
        return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("markdown"))
    rows = in_flow(items, by).withColumn("line", markdown_text(F.col("category"), t))
    return rows.groupBy(*by).agg(_joined(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("place", "line")))).alias("markdown"))


def page_markdown(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, markdown) of every page, "" for those without items."""
    got = markdown(items, ("doc_id", "page_no"))
    return pages.select("doc_id", "page_no").join(got, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.coalesce("markdown", F.lit("")).alias("markdown"))


def article_blocks(items: DataFrame) -> DataFrame:
    """items (with article, null where none claims them) and `block`: an article's items stand together, unclaimed ones form
    runs; block is the first position, so that (block, pos) is the order of the output."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    claimed = F.col("article").isNotNull()
    run = F.when(~claimed, F.count_if(claimed).over(w))
    return items.withColumn("run", run).withColumn("block", F.min("pos").over(Window.partitionBy("doc_id", "article", "run")))


def article_markdown(items: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, markdown): one section per block, headed by title, pages, section and whether it goes on.

    articles: (doc_id, article, title, section, continued). A first headline that repeats the title is not shown twice.
    """
    b = article_blocks(items).join(articles, ["doc_id", "article"], "left")
    b = b.withColumn("first", F.col("pos") == F.min("pos").over(Window.partitionBy("doc_id", "block")))
    twice = F.col("first") & F.col("article").isNotNull() & (F.col("category") == "Headline") & (F.trim("text") == F.trim("title"))
    b = b.where(~F.coalesce(twice, F.lit(False)) | F.col("article").isNull())
    pages = article_blocks(items).groupBy("doc_id", "block", "article").agg(F.array_join(F.transform(F.array_sort(F.collect_set("page_no")), lambda p: p.cast("string")), ", ").alias("pages"))
    meta = F.concat_ws(" — ", F.concat(F.lit("pages "), F.col("pages")), F.when(F.coalesce("section", F.lit("")) != "", F.col("section")), F.when(F.col("continued"), "continued"))
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "(untitled)").otherwise(F.trim("title"))
    head = F.when(F.col("article").isNotNull(), F.concat(F.lit("## "), title, F.lit("\n*"), meta, F.lit("*\n\n"))).otherwise("")
    body = markdown(b.select("doc_id", "block", "page_no", "pos", "category", "text", "figure_id"), ("doc_id", "block"))
    chunk = pages.join(articles, ["doc_id", "article"], "left").join(body, ["doc_id", "block"], "left")
    chunk = chunk.select("doc_id", "block", F.regexp_replace(F.concat(head, F.coalesce("markdown", F.lit(""))), "^\\s+|\\s+$", "").alias("line")).where("line <> ''")
    out = chunk.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda x: x["line"]), "\n\n").alias("m"))
    return out.select("doc_id", F.concat("m", F.lit("\n")).alias("markdown"))


# --- tables
def grids(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(table, grid array<array<struct<text, is_header>>>) of cells (table, row, col, ordinal, text, is_header): the last cell
    of a place counts, places without one are empty."""
    last = cells.groupBy("table", "row", "col").agg(F.max_by(F.struct("text", "is_header"), "ordinal").alias("cell"))
    m = last.groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col").alias("k"), F.col("cell").alias("v")))).alias("m"))
    at = lambda r, c: F.coalesce(F.element_at("m", F.struct(r.alias("row"), c.alias("col"))), F.struct(F.lit("").alias("text"), F.lit(False).alias("is_header")))
    rows, cols = F.sequence(F.lit(0), F.lit(n_rows - 1)), F.sequence(F.lit(0), F.lit(n_cols - 1))
    return m.select("table", F.transform(rows, lambda r: F.transform(cols, lambda c: at(r, c))).alias("grid"))


def grid_markdown(grid: Column) -> Column:
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    text = F.transform(grid, lambda r: row(F.transform(r, lambda c: c["text"])))
    rule = row(F.transform(F.element_at(grid, 1), lambda _: F.lit("---")))
    return F.concat(F.array_join(F.concat(F.slice(text, 1, 1), F.array(rule), F.slice(text, 2, 1 << 20)), "\n"), F.lit("\n"))


def grid_html(grid: Column) -> Column:
    tag = lambda c: F.when(c["is_header"], "th").otherwise("td")
    cell = lambda c: F.concat(F.lit("    <"), tag(c), F.lit(">"), escaped(c["text"]), F.lit("</"), tag(c), F.lit(">"))
    row = lambda r: F.concat(F.lit("  <tr>\n"), F.array_join(F.transform(r, cell), "\n"), F.lit("\n  </tr>"))
    return F.concat(F.lit("<table>\n"), F.array_join(F.transform(grid, row), "\n"), F.lit("\n</table>"))


# --- HTML
#: Categories and the element (with its class) that shows them; anything else is a paragraph of its class.
ELEMENTS = {"Headline": ("h1", ""), "Subhead": ("h2", ""), "Subsubhead": ("h3", ""), "Author": ("address", "author"), "Byline": ("address", "byline"), "Paragraph": ("p", ""), "Quote": ("blockquote", ""), "Dropcap": ("span", "dropcap"), "Footnote": ("aside", "footnote"), "TOC": ("nav", "toc")}


def escaped(t: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(t, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_line(category: Column, t: Column, prov: Column) -> Column:
    """One item as HTML, its text escaped; null for what is left out. Figures stay open for their captions."""
    body = escaped(t)
    line = F.when(category == "Abandon", F.lit(None).cast("string")).when(category == "Advertisement", F.concat(F.lit('<aside class="advertisement" '), prov, F.lit("></aside>")))
    line = line.when(category == "Figure", F.concat(F.lit("<figure "), prov, F.lit('>\n  <img src="" alt="Figure"/>')))
    for c, (tag, css) in ELEMENTS.items():
        line = line.when(category == c, F.concat(F.lit(f"<{tag} " + (f'class="{css}" ' if css else "")), prov, F.lit(">"), body, F.lit(f"</{tag}>")))
    return line.otherwise(F.concat(F.lit('<p class="'), F.lower(category), F.lit('" '), prov, F.lit(">"), body, F.lit("</p>")))


def html(items: DataFrame) -> DataFrame:
    """(doc_id, html): the body's elements in order, captions inside their figures; boxes and pages as data attributes."""
    rows = in_flow(items)
    number = lambda c: F.format_string("%.1f", F.col(c))
    prov = F.concat(F.lit('data-page="'), F.col("page_no").cast("string"), F.lit('" data-bbox="'), F.concat_ws(",", *[number(c) for c in ("x1", "y1", "x2", "y2")]), F.lit('"'))
    inner = F.when(F.col("category") == "Caption", F.concat(F.lit("  <figcaption>"), escaped(F.col("text")), F.lit("</figcaption>"))).otherwise(F.concat(F.lit('  <cite class="fig-byline">'), escaped(F.col("text")), F.lit("</cite>")))
    rows = rows.withColumn("line", F.when(F.col("place.inner"), inner).otherwise(html_line(F.col("category"), F.col("text"), prov)))
    closing = rows.where("category = 'Figure'").select("doc_id", F.struct(F.col("pos").alias("at"), F.lit(True).alias("inner"), F.lit(1 << 30).alias("own")).alias("place"), F.lit("</figure>").alias("line"))
    both = rows.select("doc_id", "place", "line").unionByName(closing.select("doc_id", F.col("place").cast(rows.schema["place"].dataType).alias("place"), "line"))
    body = both.groupBy("doc_id").agg(_joined(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("place", "line")))).alias("b"))
    return body.select("doc_id", F.concat(F.lit('<div class="article-body">\n'), F.col("b"), F.lit("\n</div>")).alias("html"))


# --- JSON and benchmark forms
def article_json(items: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, block, json): every block with its items inlined, in order; fields without a value are left out."""
    payload = F.struct(F.col("pos").alias("item_id"), "category", "page_no", F.when(F.col("text") != "", F.col("text")).alias("text"), F.when(F.col("category").isin("Caption", "FigByline"), F.col("figure_id")).alias("figure_id"))
    b = article_blocks(items).groupBy("doc_id", "block", "article").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", payload.alias("x")))), lambda r: r["x"]).alias("items"), F.array_sort(F.collect_set("page_no")).alias("page_nos"))
    b = b.join(articles, ["doc_id", "article"], "left")
    return b.select("doc_id", "block", F.to_json(F.struct(F.col("article").alias("article_id"), F.coalesce("title", F.lit("")).alias("title"), "section", "page_nos", F.coalesce("continued", F.lit(False)).alias("continued"), "items")).alias("json"))


def benchmark_pages(regions: DataFrame, images: DataFrame) -> DataFrame:
    """(page_id, json): one benchmark page per image, regions in source order, also for images without regions.

    regions: (page_id, idx, label, x1..y2, ignore, order). images: (page_id, width, height, file_name).
    """
    poly = F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    det = F.struct("idx", F.struct(F.col("label").alias("category_type"), poly.alias("poly"), "ignore", "order", F.col("idx").alias("anno_id"), X.stub(F.col("idx")).alias("text")).alias("d"))
    dets = regions.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(det)), lambda r: r["d"]).alias("dets"))
    page = images.join(dets, "page_id", "left").withColumn("p", X.page_of(F.col("file_name")))
    none = F.array().cast(dets.schema["dets"].dataType)
    info = F.struct(F.col("p.page").alias("page_no"), "height", "width", F.col("file_name").alias("image_path"))
    return page.select("page_id", F.to_json(F.struct(F.coalesce("dets", none).alias("layout_dets"), info.alias("page_info"))).alias("json"))


def page_attributes(images: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(page_id, attributes): map of the configured fields, "unknown" where empty; fields that no image has are left out."""
    seen = images.agg(*[F.max(F.col(c).isNotNull()).alias(f"has_{c}") for c in fields.values()])
    value = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    entries = F.array(*[F.when(F.col(f"has_{c}"), F.struct(F.lit(k).alias("k"), value(c).alias("v"))) for k, c in fields.items()])
    return images.crossJoin(F.broadcast(seen)).select("page_id", F.map_from_entries(F.array_compact(entries)).alias("attributes"))


def detections(regions: DataFrame) -> DataFrame:
    """Flat predictions (image_name, bbox, category_id, category_type, score): ids are dense over the sorted category types."""
    typed = regions.withColumn("category_type", V.benchmark_type(F.col("label")))
    ids = typed.select("category_type").distinct()
    ids = ids.select("category_type", (F.row_number().over(Window.orderBy("category_type")) - 1).alias("category_id"))  # a few types
    return typed.join(F.broadcast(ids), "category_type").select(X.stem_of(F.col("file_name")).alias("image_name"), F.array("x1", "y1", "x2", "y2").alias("bbox"), "category_id", "category_type", F.coalesce("score", F.lit(1.0)).alias("score"))


def stub_markdown(regions: DataFrame) -> DataFrame:
    """(page_id, markdown): tokens of the regions that have an order and are not ignored, each a paragraph."""
    keep = F.when(~F.col("ignore") & F.col("order").isNotNull(), F.struct("order", X.stub(F.col("idx")).alias("t")))
    return regions.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(keep)), lambda x: x["t"]), "\n\n").alias("markdown"))


def report(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(model, row): a model's line of the Markdown report, four decimals, a dash where a metric is missing.
    scores: (model, metric, value)."""
    wide = scores.groupBy("model").pivot("metric", list(metrics)).agg(F.avg("value"))
    cell = lambda m: F.coalesce(F.format_string("%.4f", F.col(m)), F.lit("—"))
    cell_ = lambda m: F.when(F.col(m).isNull(), "—").otherwise(cell(m))
    return wide.select("model", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("model"), *[cell_(m) for m in metrics]), F.lit(" |")).alias("row"))

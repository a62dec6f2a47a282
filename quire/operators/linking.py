"""Linking the items of a document: entities, splits of articles, continuations. DataFrame -> DataFrame.

Items are rows (doc_id, page_no, pos, category, text, article). Documents are independent of each other; what is sequential
by definition (a fan-out cap in order of keys, merging until nothing changes) runs per document, which holds some hundred
items, so that the work spreads over documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import similarity as S
from ..functions import text as X
from .groups import per_group

#: Headings that open a piece inside a column; items that are page furniture.
HEADINGS = ("Subhead", "Subsubhead")
FURNITURE = ("Header", "Footer", "PageNum", "Abandon")
#: Weights and bounds of a continuation.
TITLE_AT, TITLE, UNTITLED, HEADER, ENTITY, SEAM, ACCEPT, PAGE_GAP = 0.85, 0.60, 0.25, 0.25, 0.40, 0.35, 0.55, 1


# --- entities
def accepted_entities(found: DataFrame, least: float = 0.5) -> DataFrame:
    """Entities (text, label, score) that score enough and are not blank; labels in capitals without their B-/I- prefix."""
    good = found.where((F.col("score") >= least) & (F.trim("text") != ""))
    return good.withColumn("label", F.upper(F.regexp_replace("label", "^[BIbi]-", "")))


def entity_index(entities: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, pos, article, key), distinct: every key of `least` characters of each entity (doc_id, pos, article, text, label)."""
    keys = entities.select("doc_id", "pos", "article", F.explode(X.entity_keys(F.col("text"), F.col("label"))).alias("key"))
    return keys.where(F.length("key") >= least).distinct()


def key_weights(index: DataFrame, articles: DataFrame) -> DataFrame:
    """(doc_id, key, df, weight): ln(N/df)+1 over a document's N articles (all of them, one at least), 0 beyond max(2, N/4).

    Distinct (article, key) pairs come first, so that the counts themselves need no distinct.
    """
    n = articles.select("doc_id", "article").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    df = index.where("article is not null").select("doc_id", "article", "key").distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("df"))
    j = df.join(n, "doc_id", "left").withColumn("n", F.greatest(F.lit(1), F.coalesce("n", F.lit(1))))
    w = F.when(F.col("df") > F.greatest(F.lit(2.0), 0.25 * F.col("n")), 0.0).otherwise(F.log(F.col("n") / F.col("df")) + 1)
    return j.select("doc_id", "key", "df", w.alias("weight"))


def cross_links(index: DataFrame, weights: DataFrame, fan_out: int = 8) -> DataFrame:
    """(doc_id, source, target, key, score): items of different articles (or of none) that share a key of positive weight.

    Keys in order, then pairs of items in order; an item that has fan_out links takes part in no more. An item with its
    fill of links is skipped as a whole, so a key of n items costs at most fan_out * n pairs and what is skipped.
    """

    def run(g: dict[str, np.ndarray]) -> dict[str, list]:
        given: dict[int, int] = {}
        out: dict[str, list] = {"source": [], "target": [], "key": [], "score": []}
        rows = list(zip(g["key"].tolist(), g["pos"].tolist(), g["article"].tolist(), g["weight"].tolist(), strict=True))
        for key, same in groupby(rows, key=lambda r: r[0]):
            at = list(same)
            for i, (_, a, x, w) in enumerate(at):
                if given.get(a, 0) >= fan_out:
                    continue
                for _, b, y, _ in at[i + 1 :]:
                    if given.get(a, 0) >= fan_out:
                        break
                    if (x >= 0 and x == y) or given.get(b, 0) >= fan_out:
                        continue
                    for c, v in zip(out, (a, b, key, round(w, 4)), strict=True):
                        out[c].append(v)
                    given[a], given[b] = given.get(a, 0) + 1, given.get(b, 0) + 1
        return out

    rare = index.join(weights.where("weight > 0").select("doc_id", "key", "weight"), ["doc_id", "key"]).withColumn("article", F.coalesce("article", F.lit(-1)))
    return per_group(rare, "doc_id", ["key", "pos", "article", "weight"], run, "source int, target int, key string, score double")


def orphan_captions(items: DataFrame, index: DataFrame, weights: DataFrame, height: float = 1000.0, share: float = 0.5) -> DataFrame:
    """(doc_id, pos, article, method): for captions without a figure, the article of their page with the most similar
    entities (ties: smaller article), else that of the nearest item within `share` of the page's height."""
    caption = items.where(F.col("category").isin("Caption", "FigByline") & F.col("figure_id").isNull())
    w = index.join(weights.where("weight > 0"), ["doc_id", "key"])
    own = w.select("doc_id", "pos", "key", "weight")
    # keys of an article, but for those that only the caption itself brings
    of = w.where("article is not null").groupBy("doc_id", "article", "key").agg(F.collect_set("pos").alias("by"), F.first("weight").alias("weight"))
    total = of.groupBy("doc_id", "article").agg(F.sum("weight").alias("tb"))
    lone = F.size("by") > 1
    mine = own.join(caption.select("doc_id", "pos", "page_no"), ["doc_id", "pos"])
    ta = mine.groupBy("doc_id", "pos").agg(F.sum("weight").alias("ta"))
    there = items.where("article is not null").select("doc_id", "page_no", "article").distinct()
    hit = mine.join(there, ["doc_id", "page_no"]).join(of.select("doc_id", "article", "key", "by"), ["doc_id", "article", "key"])
    hit = hit.where(lone | ~F.array_contains("by", F.col("pos")))
    alone = own.join(of.where(~lone).select("doc_id", "article", "key", "by"), ["doc_id", "key"]).where(F.array_contains("by", F.col("pos"))).groupBy("doc_id", "pos", "article").agg(F.sum("weight").alias("less"))
    score = hit.groupBy("doc_id", "pos", "article").agg(F.sum("weight").alias("s")).join(ta, ["doc_id", "pos"]).join(total, ["doc_id", "article"]).join(alone, ["doc_id", "pos", "article"], "left")
    score = score.withColumn("score", F.least(F.lit(1.0), F.col("s") / F.sqrt(F.col("ta") * (F.col("tb") - F.coalesce("less", F.lit(0.0))))))
    best = score.groupBy("doc_id", "pos").agg(F.max_by("article", F.struct("score", (-F.col("article")).alias("k"))).alias("by_entity"))
    o = items.where("article is not null").select("doc_id", "page_no", F.col("article").alias("near"), F.col("pos").alias("o"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    from ..functions import geometry as G

    gap = caption.join(o, ["doc_id", "page_no"]).where("pos <> o").withColumn("gap", G.edge_gap(G.box(), G.box("o_")))
    near = gap.groupBy("doc_id", "pos").agg(F.min(F.struct("gap", "near", "o")).alias("m")).where(F.col("m.gap") <= share * height).select("doc_id", "pos", F.col("m.near").alias("by_place"))
    out = caption.select("doc_id", "pos").join(best, ["doc_id", "pos"], "left").join(near, ["doc_id", "pos"], "left")
    return out.select("doc_id", "pos", F.coalesce("by_entity", "by_place").alias("article"), F.when(F.col("by_entity").isNotNull(), "ner").when(F.col("by_place").isNotNull(), "geometry").alias("method"))


# --- headers and splits
def running_headers(items: DataFrame, most: int = 8) -> DataFrame:
    """(doc_id, page_no, header): the longest readable header of a page (ties: the first)."""
    h = items.where(F.col("category").isin("Header", "Section")).withColumn("h", X.clean_header(F.coalesce("text", F.lit(""))))
    h = h.where((F.col("h") != "") & X.is_running_header(F.col("h"), most))
    return h.groupBy("doc_id", "page_no").agg(F.max_by("h", F.struct(F.length("h"), -F.col("pos"))).alias("header"))


def article_pages(items: DataFrame) -> DataFrame:
    """(doc_id, article, pages, n_items)."""
    return items.where("article is not null").groupBy("doc_id", "article").agg(F.array_sort(F.collect_set("page_no")).alias("pages"), F.count(F.lit(1)).alias("n_items"))


def article_sections(items: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, article, section): the header of the first of the article's pages that has one."""
    p = items.where("article is not null").select("doc_id", "article", "page_no").distinct().join(headers, ["doc_id", "page_no"], "left")
    return p.groupBy("doc_id", "article").agg(F.min_by("header", F.when(F.col("header").isNotNull(), F.col("page_no"))).alias("section"))


def piece_starts(items: DataFrame) -> DataFrame:
    """items of articles with `start`: the first of each run of headings that name a piece."""
    heading = F.col("category").isin(*HEADINGS) & X.titles_a_piece(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("doc_id", "article").orderBy("pos")
    h = items.where("article is not null").withColumn("heading", heading)
    return h.withColumn("start", F.col("heading") & ~F.coalesce(F.lag("heading").over(w), F.lit(False))).drop("heading")


def density(items: DataFrame) -> DataFrame:
    """(doc_id, article, starts, body, per_heading): body items (no furniture) per heading that names a piece."""
    g = piece_starts(items).groupBy("doc_id", "article").agg(F.count_if("start").alias("starts"), F.count_if(~F.col("category").isin(*FURNITURE)).alias("body"))
    return g.withColumn("per_heading", F.when(F.col("starts") > 0, F.col("body") / F.col("starts")))


def split_columns(items: DataFrame, sections: DataFrame, strict: tuple[int, float] = (3, 10.0), relaxed: tuple[int, float] = (2, 12.0)) -> DataFrame:
    """items with `piece`: 0 for what stays with the article, else the number of the piece. An article is a column if it has
    enough headings and few enough body items per heading; the bounds are relaxed in sections known as columns."""
    d = density(items).join(sections, ["doc_id", "article"], "left")
    known = X.is_column_section(F.coalesce("section", F.lit("")))
    ok = F.when(known, (F.col("starts") >= relaxed[0]) & (F.col("per_heading") <= relaxed[1])).otherwise((F.col("starts") >= strict[0]) & (F.col("per_heading") <= strict[1]))
    w = Window.partitionBy("doc_id", "article").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = piece_starts(items).join(d.select("doc_id", "article", ok.alias("column")), ["doc_id", "article"])
    return s.withColumn("piece", F.when(F.col("column"), F.count_if("start").over(w)).otherwise(F.lit(0).cast("long"))).drop("column", "start")


def split_sections(items: DataFrame, headers: DataFrame, least: int = 3) -> DataFrame:
    """items of articles with `piece`: a new one begins where the running header changes section, if it holds `least` items;
    pages without a readable header are passed over, and an article's first item opens nothing."""
    pages = items.where("article is not null").select("doc_id", "article", "page_no").distinct().join(headers, ["doc_id", "page_no"])
    pages = pages.where(F.size(X.header_tokens(F.col("header"))) > 0)
    w = Window.partitionBy("doc_id", "article").orderBy("page_no")
    changed = pages.withColumn("before", F.lag("header").over(w)).where("before is not null").withColumn("same", S.same_section(F.col("before"), F.col("header"))).where("not same")
    v = Window.partitionBy("doc_id", "article").orderBy("pos")
    mine = items.where("article is not null").withColumn("at", F.row_number().over(v) - 1)
    first = mine.join(changed.select("doc_id", "article", F.col("page_no").alias("changed")), ["doc_id", "article"]).where("page_no >= changed").groupBy("doc_id", "article", "changed").agg(F.min("at").alias("start"))
    size = mine.groupBy("doc_id", "article").agg(F.count(F.lit(1)).alias("size"))
    starts = first.where("start > 0").select("doc_id", "article", "start").distinct().join(size, ["doc_id", "article"])
    end = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id", "article").orderBy("start")), F.col("size"))
    kept = starts.withColumn("end", end).where(F.col("end") - F.col("start") >= least).groupBy("doc_id", "article").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    j = mine.join(kept, ["doc_id", "article"], "left")
    piece = F.size(F.filter(F.coalesce("starts", F.array().cast("array<int>")), lambda s: s <= F.col("at"))).cast("long")
    return j.withColumn("piece", piece).drop("starts", "at")


def rebuilt(items: DataFrame) -> DataFrame:
    """(doc_id, article, first_pos, items array<int>): members by body position, without furniture; articles that are left
    without any are gone; the order of articles is (first_pos, article)."""
    body = items.where(F.col("article").isNotNull() & ~F.col("category").isin(*FURNITURE))
    return body.groupBy("doc_id", "article").agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list("pos")).alias("items"))


# --- continuations
def seams(items: DataFrame) -> DataFrame:
    """(doc_id, article, first_text, last_text): an article's first and last text that is not blank."""
    t = items.where(F.col("article").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.col("category").isin("Figure", "Table"))
    return t.groupBy("doc_id", "article").agg(F.min_by("text", "pos").alias("first_text"), F.max_by("text", "pos").alias("last_text"))


def continuation_scores(articles: DataFrame) -> DataFrame:
    """Neighbouring articles of a document that may continue each other: (doc_id, article, following, score, method, accepted).

    articles: (doc_id, article, first_pos, pages, title, section, split_from, first_text, last_text, keys map<key, weight>).
    Vetoed are pieces of one column, a change between two readable sections, and a gap of more than a page.
    """
    cols = ("article", "pages", "title", "section", "split_from", "first_text", "last_text", "keys")
    w = Window.partitionBy("doc_id").orderBy("first_pos", "article")
    p = articles.select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in cols]).where("n_article is not null")
    group = lambda a: F.coalesce(F.col(f"{a}split_from"), F.col(f"{a}article"))
    gap = F.element_at("n_pages", 1) - F.element_at("pages", -1)
    p = p.where((group("") != group("n_")) & gap.between(0, PAGE_GAP))
    readable = (F.size(X.header_tokens(F.coalesce("section", F.lit("")))) > 0) & (F.size(X.header_tokens(F.coalesce("n_section", F.lit("")))) > 0)
    p = p.withColumns({"same": S.same_section(F.col("section"), F.col("n_section")), "title_sim": S.title_similarity(F.col("title"), F.col("n_title"))}).where(~readable | F.col("same"))
    header = X.header_similarity(F.coalesce("section", F.lit("")), F.coalesce("n_section", F.lit("")))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)
    shared = F.aggregate(F.map_values(F.map_filter("keys", lambda k, v: F.map_contains_key("n_keys", k))), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(total("keys") * total("n_keys"))
    p = p.withColumns({"header_sim": header, "entity_sim": F.when((norm > 0) & (shared > 0), F.least(F.lit(1.0), shared / norm)).otherwise(0.0)})
    untitled = F.trim(F.coalesce("n_title", F.lit(""))) == ""
    titled = F.col("title_sim") >= TITLE_AT
    seam = F.col("last_text").isNotNull() & F.col("n_first_text").isNotNull() & ~X.ends_sentence(F.coalesce("last_text", F.lit("."))) & X.is_continuation(F.coalesce("n_first_text", F.lit("")))
    score = F.when(titled, TITLE).when(untitled, UNTITLED).otherwise(0.0) + HEADER * F.col("header_sim") + ENTITY * F.col("entity_sim") + F.when(seam, SEAM).otherwise(0.0)
    method = F.array_join(F.array_compact(F.array(F.when(titled, "title").when(untitled, "untitled"), F.when(F.col("header_sim") > 0, "header"), F.when(F.col("entity_sim") > 0, "ner"), F.when(seam, "seam"))), "+")
    return p.select("doc_id", "article", F.col("n_article").alias("following"), score.alias("score"), method.alias("method"), (score >= ACCEPT).alias("accepted"))


def _cut(df: DataFrame) -> DataFrame:
    """df computed and without its plan: in the checkpoint folder where one is set, else on the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


class _Article:
    """What the score of a pair asks of an article, and the articles that it has taken in."""

    __slots__ = ("ids", "first_pos", "article", "pages", "title", "title_key", "tokens", "squashed", "split_from", "open", "goes_on", "keys")

    def __init__(self, r: dict) -> None:
        self.ids = [r["article"]]
        for c in ("first_pos", "article", "pages", "title", "title_key", "squashed", "split_from", "open", "goes_on"):
            setattr(self, c, r[c])
        self.tokens, self.keys = set(r["tokens"]), dict(zip(r["names"], r["weights"], strict=True))

    def take(self, other: _Article) -> None:
        self.ids += other.ids
        self.pages, self.open = sorted({*self.pages, *other.pages}), other.open
        if not self.title.strip(" "):
            self.title, self.title_key = (other.title, other.title_key) if other.title.strip(" ") else ("", "")
        self.keys = dict(sorted({**self.keys, **other.keys}.items()))


def _pair_score(p: _Article, n: _Article) -> tuple[float, str] | None:
    """Score and method of continuation_scores for two neighbours, None where vetoed."""
    group = lambda a: a.article if a.split_from is None else a.split_from
    if group(p) == group(n) or not p.pages or not n.pages or not 0 <= n.pages[0] - p.pages[-1] <= PAGE_GAP:
        return None
    header = len(p.tokens & n.tokens) / min(len(p.tokens), len(n.tokens)) if p.tokens and n.tokens else 0.0
    if p.tokens and n.tokens and header < S.TOKENS and not (p.squashed and n.squashed and S.alike(p.squashed, n.squashed) >= S.CHARACTERS):
        return None
    titled = bool(p.title_key and n.title_key) and S.alike(p.title_key, n.title_key) >= TITLE_AT
    untitled, seam = not n.title.strip(" "), p.open and n.goes_on
    shared = sum((w for k, w in p.keys.items() if k in n.keys), 0.0)
    norm = math.sqrt(sum(p.keys.values(), 0.0) * sum(n.keys.values(), 0.0)) if shared > 0 else 0.0
    entity = min(1.0, shared / norm) if norm > 0 else 0.0
    score = (TITLE if titled else UNTITLED if untitled else 0.0) + HEADER * header + ENTITY * entity + (SEAM if seam else 0.0)
    by = ["title" if titled else "untitled" if untitled else "", "header" if header > 0 else "", "ner" if entity > 0 else "", "seam" if seam else ""]
    return score, "+".join(x for x in by if x)


def _folded(rows: list[dict]) -> list[tuple]:
    """(article, root, into, score, method) of a document's articles: the first acceptable pair is merged until none is left.
    Pairs before the merged one are as they were, so that the search goes on one pair before it."""
    live = sorted(map(_Article, rows), key=lambda a: (a.first_pos, a.article))
    by: dict[int, tuple] = {}
    after: list[_Article] = live[:0:-1]  # those to come, the next one last
    done: list[_Article] = live[:1]
    while after:
        s = _pair_score(done[-1], after[-1])
        if s and s[0] >= ACCEPT:
            gone = after.pop()
            by[gone.article] = (done[-1].article, *s)
            done[-1].take(gone)
            if len(done) > 1:
                after.append(done.pop())
        else:
            done.append(after.pop())
    return [(x, a.article, *by.get(x, (None, None, None))) for a in done for x in a.ids]


def merged_articles(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Continuations folded into their first article until none is left: ((doc_id, article, root), links (doc_id, article,
    following, score, method)).

    The first acceptable pair of a document is merged, as scores may change by it, and so on; a document is one row of its
    articles and is folded as a whole, however long its chain of merges, so that all documents take one pass.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    section, none = blank("section"), F.array().cast("array<string>")
    row = F.struct(
        "first_pos", "article", "pages", blank("title").alias("title"), X.title_key(blank("title")).alias("title_key"), X.header_tokens(section).alias("tokens"), X.squash(section).alias("squashed"), "split_from",
        (F.col("last_text").isNotNull() & ~X.ends_sentence(F.coalesce("last_text", F.lit(".")))).alias("open"), (F.col("first_text").isNotNull() & X.is_continuation(blank("first_text"))).alias("goes_on"),
        F.coalesce(F.map_keys("keys"), none).alias("names"), F.coalesce(F.map_values("keys"), none.cast("array<double>")).alias("weights"))
    cols = ["article", "root", "into", "score", "method"]

    def batches(it):
        for batch in it:
            got = [(doc.as_py(), *x) for doc, rows in zip(batch.column(0), batch.column(1), strict=True) for x in _folded(rows.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], f.type) for k, f in enumerate(target)], schema=target)

    schema = f"doc_id {articles.schema['doc_id'].dataType.simpleString()}, article long, root long, into long, score double, method string"
    target = to_arrow_schema(StructType.fromDDL(schema))
    out = _cut(articles.groupBy("doc_id").agg(F.collect_list(row).alias("rows")).mapInArrow(batches, schema).select("doc_id", *cols))
    links = out.where("into is not null").select("doc_id", F.col("into").alias("article"), F.col("article").alias("following"), F.round("score", 4).alias("score"), "method")
    return out.select("doc_id", "article", "root"), links


def article_keys(index: DataFrame, weights: DataFrame) -> DataFrame:
    """(doc_id, article, keys map<key, weight>) of keys with a positive weight."""
    k = index.where("article is not null").select("doc_id", "article", "key").distinct().join(weights.where("weight > 0"), ["doc_id", "key"])
    return k.groupBy("doc_id", "article").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "weight")))).alias("keys"))


def article_table(items: DataFrame, index: DataFrame, weights: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """What continuation_scores and merged_articles ask of articles; the title is that of the article's headline.

    pieces: (doc_id, article, split_from) of articles that were split off another; such a one has the title of the heading
    that it opens with, if it opens with one.
    """
    body = items.where(F.col("article").isNotNull() & ~F.col("category").isin(*FURNITURE))
    opens = F.min_by(F.when(F.col("category").isin(*HEADINGS), F.trim(F.regexp_replace("text", "\\s+", " "))), "pos")
    t = body.groupBy("doc_id", "article").agg(
        F.min("pos").alias("first_pos"), F.array_sort(F.collect_set("page_no")).alias("pages"), F.coalesce(F.min_by("text", F.when(F.col("category") == "Headline", F.col("pos"))), F.lit("")).alias("title"),
        F.coalesce(opens, F.lit("")).alias("opens"))
    t = t.join(article_sections(items, running_headers(items)), ["doc_id", "article"], "left").join(seams(body), ["doc_id", "article"], "left").join(article_keys(index, weights), ["doc_id", "article"], "left")
    t = t.withColumn("split_from", F.lit(None).cast("long")) if pieces is None else t.join(pieces, ["doc_id", "article"], "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return t.withColumns({"keys": F.coalesce("keys", none), "title": F.when(F.col("split_from").isNull(), F.col("title")).otherwise(F.col("opens"))}).drop("opens")


def link_document(items: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All passes in order: split at changes of section, split columns, index entities, merge continuations, cross-link.

    items: (doc_id, page_no, pos, category, text, article), entities: (doc_id, pos, text, label). Returns (items with their
    final article, links (doc_id, kind, source, target, score, method)). Pieces are numbered article * 1000 + piece; the merge
    knows which article they were split from, so that it does not put them together again. Places and keys of the items are
    computed once, as most passes read them.
    """
    numbered = lambda df: df.withColumn("article", F.when(F.col("piece") > 0, F.col("article") * 1000 + F.col("piece")).otherwise(F.col("article"))).drop("piece")
    own = items.withColumn("origin", F.col("article"))
    a = numbered(split_sections(own, running_headers(items)))
    b = numbered(split_columns(a, article_sections(a, running_headers(a)))).select(*own.columns)
    whole = b.unionByName(own.where("article is null"))
    placed = _cut(whole.select("doc_id", "pos", "article", "origin"))
    known = placed.where("article is not null")
    pieces = known.where("article <> origin").select("doc_id", "article", F.col("origin").alias("split_from")).distinct()
    index = _cut(entity_index(entities.join(placed.drop("origin"), ["doc_id", "pos"])))
    root, merged = merged_articles(article_table(items.drop("article").join(placed.drop("origin"), ["doc_id", "pos"]), index, key_weights(index, known), pieces))
    final = lambda df: df.join(root, ["doc_id", "article"], "left").withColumn("article", F.coalesce("root", "article")).drop("root", "origin")
    index2 = index.drop("article").join(final(placed), ["doc_id", "pos"])
    cross = cross_links(index2, key_weights(index2, final(known)))
    links = merged.select("doc_id", F.lit("article-continues").alias("kind"), F.col("article").alias("source"), F.col("following").alias("target"), "score", "method")
    links = links.unionByName(cross.select("doc_id", F.lit("entity-overlap").alias("kind"), F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "score", F.lit("ner").alias("method")))
    return final(whole).select(*items.columns), links


def classified(articles: DataFrame, answer, classes: Sequence[str] = X.CLASSES, least: int = 40) -> DataFrame:
    """(doc_id, article, genre): the class that a classifier's answer names (a Column over `text`), for texts of `least`
    characters; else the genre that the section suggests, if the classifier knows it; else null."""
    reply = F.when(F.length("text") >= least, X.reply_label(answer, tuple(classes)))
    by_section = X.section_genre(F.coalesce("section", F.lit("")))
    return articles.select("doc_id", "article", F.coalesce(reply, F.when(by_section.isin(*classes), by_section)).alias("genre"))

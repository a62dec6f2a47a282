"""Registered queries of the layout engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import layout as L
from ..operators import scores as S
from ..sources import layouts as T
from ..sources.layouts import BOXES, ITEMS, LINES, PREDICTED

FLAGSHIP = "win01_sessionise_articles"
Q: dict = {}
SQL: dict[str, str] = {}
_INTER = "greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
_AREA = "({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)"


def _iou(a: str, b: str) -> str:
    i = _INTER.format(a=a, b=b)
    return f"coalesce({i} / nullif({_AREA.format(a=a)} + {_AREA.format(a=b)} - {i}, 0), 0.0)"


def _r(c, k: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_MD = "CASE category WHEN 'Headline' THEN '# ' || coalesce(text, '') WHEN 'Header' THEN NULL ELSE coalesce(text, '') END"
_SESSION = "SELECT *, nullif(sum(CAST(category = 'Headline' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS article FROM items"


@query(f"WITH {ITEMS}, s AS ({_SESSION}), m AS (SELECT *, {_MD} AS md FROM s) SELECT doc_id, CAST(article AS BIGINT) article, min(pos) first_pos, count(md) n_items, CAST(sum(CASE WHEN md IS NOT NULL THEN length(text) END) AS BIGINT) n_chars, coalesce(string_agg(md, chr(10) || chr(10) ORDER BY pos), '') || chr(10) markdown FROM m WHERE article IS NOT NULL GROUP BY ALL")
def win01_sessionise_articles(spark, sf):
    return L.articles(T.items(spark, sf))


@query(f"WITH {BOXES} SELECT page_id, idx, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, idx) - 1 AS INTEGER) rank FROM boxes")
def srt01_top_bottom(spark, sf):
    return L.reading_order(T.boxes(spark, sf)).select("page_id", "idx", "rank")


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY x1, idx, y1) r FROM boxes),
walk AS (SELECT page_id, idx, x1, y1, r, x1 a, 0 band FROM o WHERE r = 1 UNION ALL
  SELECT o.page_id, o.idx, o.x1, o.y1, o.r, CASE WHEN o.x1 - w.a > 10 THEN o.x1 ELSE w.a END, w.band + CAST(o.x1 - w.a > 10 AS INTEGER) FROM walk w JOIN o ON o.page_id = w.page_id AND o.r = w.r + 1)
SELECT page_id, idx, band, CAST(row_number() OVER (PARTITION BY page_id ORDER BY band, y1, idx) - 1 AS INTEGER) rank FROM walk""")
def srt02_left_right_bands(spark, sf):
    return L.left_right_order(T.boxes(spark, sf))


@query(f"WITH {BOXES}, {PREDICTED} SELECT p.page_id, p.idx, round({_iou('p', 'g')}, 6) iou FROM pred p JOIN boxes g USING (page_id, idx)")
def prj05_iou(spark, sf):
    g = T.boxes(spark, sf).select("page_id", "idx", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    return T.predicted(spark, sf).join(g, ["page_id", "idx"]).select("page_id", "idx", _r(G.iou(G.box(), G.box("g_"))).alias("iou"))


@query(f"WITH {BOXES} SELECT page_id, idx, " + ", ".join(f"least(1000, greatest(0, CAST(trunc({c} / {s} * 1000) AS INTEGER))) n_{c}" for c, s in (("x1", 900), ("y1", 1000), ("x2", 900), ("y2", 1000))) + " FROM boxes")
def prj02_normalise(spark, sf):
    return T.boxes(spark, sf).select("page_id", "idx", *[G.normalised(F.col(c), F.lit(float(s))).alias(f"n_{c}") for c, s in (("x1", 900), ("y1", 1000), ("x2", 900), ("y2", 1000))])


@query(f"WITH {BOXES} SELECT page_id, min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2, sum((x2 - x1) * (y2 - y1)) total_area FROM boxes GROUP BY page_id")
def prj03_box_union(spark, sf):
    return T.boxes(spark, sf).groupBy("page_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum(G.area(G.box())).alias("total_area"))


@query(f"WITH {BOXES} SELECT a.page_id, a.idx, b.idx other, round(CASE WHEN least(a.x2 - a.x1, b.x2 - b.x1) > 0 THEN greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / least(a.x2 - a.x1, b.x2 - b.x1) ELSE 0.0 END, 6) overlap, round(sqrt(pow(greatest(0.0, greatest(a.x1, b.x1) - least(a.x2, b.x2)), 2) + pow(greatest(0.0, greatest(a.y1, b.y1) - least(a.y2, b.y2)), 2)), 6) gap FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND b.idx = a.idx + 1")
def prj09_overlap_and_gap(spark, sf):
    b = T.boxes(spark, sf)
    o = b.select("page_id", (F.col("idx") - 1).alias("idx"), F.col("idx").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")])
    return b.join(o, ["page_id", "idx"]).select("page_id", "idx", "other", _r(G.h_overlap_ratio(G.box(), G.box("o_"))).alias("overlap"), _r(G.edge_gap(G.box(), G.box("o_"))).alias("gap"))


def _greedy(pairs: str, sign: str) -> str:
    """Rows of a table pairs(page_id, i, j, s) taken greedily, as a fold over each page's ordered list."""
    order = "s DESC, i DESC, j DESC" if sign == "-" else "s, i, j"
    return f"""l AS (SELECT page_id, list({{'i': i, 'j': j, 's': s}} ORDER BY {order}) ps FROM {pairs} GROUP BY page_id),
f AS (SELECT page_id, list_reduce(list_transform(ps, lambda p: [p]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.i = x[1].i OR k.j = x[1].j)) = 0 THEN list_concat(acc, x) ELSE acc END) m FROM l),
u AS (SELECT page_id, unnest(m) m FROM f) SELECT page_id, m.i i, m.j j, round(m.s, 6) s FROM u"""


@query(f"WITH {BOXES}, {PREDICTED}, pairs AS (SELECT * FROM (SELECT p.page_id, p.idx i, g.idx j, {_iou('p', 'g')} s FROM pred p JOIN boxes g ON p.page_id = g.page_id) WHERE s >= 0.5), {_greedy('pairs', '-')}")
def jn03_match_by_iou(spark, sf):
    return L.match_by_iou(T.predicted(spark, sf), T.boxes(spark, sf)).select("page_id", "i", "j", _r("s").alias("s"))


_COST = """SELECT page_id, i, j, CASE WHEN vg >= hg THEN (greatest(0.0, vg / 1000) + 0.5 * abs(fcx - ccx) / 1000) * CASE WHEN ccy >= fcy THEN 1.0 ELSE 2.0 END ELSE (greatest(0.0, hg / 1000) + 0.5 * abs(fcy - ccy) / 1000) * 3.0 END s
FROM (SELECT f.page_id, f.idx i, c.idx j, CAST(greatest(f.y1, c.y1) - least(f.y2, c.y2) AS DOUBLE) vg, CAST(greatest(f.x1, c.x1) - least(f.x2, c.x2) AS DOUBLE) hg, (f.x1 + f.x2) / 2 fcx, (c.x1 + c.x2) / 2 ccx, (f.y1 + f.y2) / 2 fcy, (c.y1 + c.y2) / 2 ccy
      FROM boxes f JOIN boxes c ON f.page_id = c.page_id AND f.label = 'Figure' AND c.label = 'Caption') WHERE vg <= 200 AND hg <= 200"""


@query(f"WITH {BOXES}, pairs AS ({_COST}), {_greedy('pairs', '+')}")
def jn06_match_captions(spark, sf):
    return L.match_captions(T.boxes(spark, sf)).select("page_id", "i", "j", _r("s").alias("s"))


_KEPT = f"""WITH {BOXES}, l AS (SELECT page_id, list({{'idx': idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY score DESC, idx, x1, y1, x2, y2) ps FROM boxes GROUP BY page_id),
f AS (SELECT page_id, list_reduce(list_transform(ps, lambda p: [p]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_iou('k', 'x[1]')} > 0.3)) = 0 THEN list_concat(acc, x) ELSE acc END) m FROM l),
u AS (SELECT page_id, unnest(m) m FROM f) SELECT page_id, m.idx idx FROM u"""


@query(_KEPT)
def set04_iou_dedup(spark, sf):
    return L.drop_duplicates(T.boxes(spark, sf), 0.3)


_WORDS = "words AS (SELECT page_id, idx AS word, x1 + k % 40 AS x1, y1 + k % 40 - 10 AS y1, x1 + k % 40 + 24 AS x2, y1 + k % 40 AS y2 FROM boxes)"


def _words(spark, sf):
    s = (F.col("k") % 40).cast("double")
    return T.boxes(spark, sf).select("page_id", F.col("idx").alias("word"), (F.col("x1") + s).alias("x1"), (F.col("y1") + s - 10).alias("y1"), (F.col("x1") + s + 24).alias("x2"), (F.col("y1") + s).alias("y2"))


@query(f"""WITH {BOXES}, {_WORDS}, j AS (SELECT w.page_id, w.word, b.idx, {_AREA.format(a='b')} area, {_INTER.format(a='w', b='b')} inter, {_AREA.format(a='w')} wa,
  (w.x1 + w.x2) / 2 BETWEEN b.x1 AND b.x2 AND (w.y1 + w.y2) / 2 BETWEEN b.y1 AND b.y2 AS inside FROM words w JOIN boxes b USING (page_id))
SELECT page_id, word, coalesce(min({{'a': area, 'idx': idx}}) FILTER (inside)['idx'], max({{'a': inter, 'idx': idx}}) FILTER (wa > 0 AND inter >= 0.5 * wa)['idx']) idx FROM j GROUP BY page_id, word""".replace("coalesce(min({'a': area, 'idx': idx}) FILTER (inside)['idx'], max({'a': inter, 'idx': idx}) FILTER (wa > 0 AND inter >= 0.5 * wa)['idx'])", "coalesce(arg_min(idx, {'a': area, 'i': idx}) FILTER (inside), arg_max(idx, {'a': inter, 'i': idx}) FILTER (wa > 0 AND inter >= 0.5 * wa))"))
def jn02_words_to_boxes(spark, sf):
    return L.assign_words(_words(spark, sf), T.boxes(spark, sf))


@query(f"""WITH {BOXES}, {_WORDS}, o AS (SELECT *, max(x2) OVER (PARTITION BY page_id ORDER BY x1, x2, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) far FROM words)
SELECT page_id, word, CAST(sum(coalesce(CAST(x1 - far > 6 AS INTEGER), 0)) OVER (PARTITION BY page_id ORDER BY x1, x2, word ROWS UNBOUNDED PRECEDING) AS BIGINT) col FROM o""")
def win07_column_gutters(spark, sf):
    return L.column_gutters(_words(spark, sf), 6.0)


@query(f"WITH {BOXES}, b AS (SELECT *, last_value(CASE WHEN label NOT IN ('Figure', 'Caption') THEN idx END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) anchor FROM boxes WHERE label <> 'Header') SELECT page_id, idx, label, anchor FROM b WHERE label IN ('Figure', 'Caption')")
def jn12_visual_anchors(spark, sf):
    return L.anchors(T.boxes(spark, sf))


@query(f"WITH {ITEMS} SELECT doc_id, pos, last_value(CASE WHEN category = 'Headline' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) header FROM items")
def jn11_carry_forward(spark, sf):
    return L.carry_forward(T.items(spark, sf), F.when(F.col("category") == "Headline", F.col("text")), "header", ["doc_id"], ["pos"]).select("doc_id", "pos", "header")


_SPOILT = "CASE WHEN pos % 3 = 1 THEN lower(substr(text, 1, 1)) || substr(text, 2) ELSE text END"


@query(f"""WITH {LINES}, t AS (SELECT doc_id, pos, regexp_replace({_SPOILT}, '[.]$', '') AS text FROM lines),
p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY pos) prev FROM t),
j AS (SELECT *, coalesce(trim(prev) <> '' AND trim(text) <> '' AND NOT regexp_matches(prev, '[.!?\\x{{2026}}\\x{{3002}}]["'')\\]\\x{{bb}}\\x{{201d}}\\x{{2019}}]*\\s*$') AND regexp_matches(text, '^\\s*[\\p{{Ll}}\\p{{Nd}},;)\\x{{2013}}-]'), false) AS joins FROM p),
g AS (SELECT *, sum(CAST(NOT joins AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS para FROM j)
SELECT doc_id, CAST(para AS BIGINT) para, CAST(min(pos) AS INTEGER) first_pos, count(*) n_lines, string_agg(text, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, para""")
def win04_merge_paragraphs(spark, sf):
    t = F.col("text")
    low = F.when(F.col("pos") % 3 == 1, F.concat(F.lower(F.substring(t, 1, 1)), F.expr("substring(text, 2)"))).otherwise(t)
    return L.merge_paragraphs(T.lines(spark, sf).select("doc_id", "pos", F.regexp_replace(low, "[.]$", "").alias("text")))


_SPOIL = {" de ": "-\n", " of ": "  \u00a0", " der ": "\u00ad\r\n", " la ": "\u2014 \n ", " les ": "\u200b", " the ": "\u2010\r\n", " el ": "1-\n2", " und ": "\u00ad", " in ": " \n\n "}
_W, _NL = "[\\p{L}\\p{N}_]", "[ \\t]*\\r?\\n[ \\t]*"
_STEPS = (
    ("[\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}]", ""), ("[\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]", " "), (f"\\x{{ad}}{_NL}", ""), ("\\x{ad}", ""),
    (f"[\\x{{2010}}\\x{{2011}}]({_NL})", "-\\1"), (f"({_W})(?:([\\x{{2012}}-\\x{{2015}}]){_NL}({_W})|-{_NL}(\\p{{Ll}})|(-){_NL}({_W}))", "\\1\\2\\3\\4\\5\\6"),
    ("\\s*\\r?\\n\\s*", " "), ("[ \\t]+", " "), ("^\\s+|\\s+$", ""),
)


def _chain(c: str) -> str:
    for pattern, to in _STEPS:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


def _spoilt(c: str) -> str:
    for a, b in _SPOIL.items():
        c = f"replace({c}, '{a}', " + " || ".join(f"chr({ord(x)})" for x in b) + ")"
    return c


@query(f"WITH {LINES}, t AS (SELECT doc_id, pos, {_spoilt('text')} AS text FROM lines) SELECT doc_id, pos::INTEGER AS pos, {_chain('text')} AS text FROM t")
def str01_normalize_text(spark, sf):
    """On lines that words have been replaced in by what scans bring: wraps of all kinds, invisible characters, odd spaces."""
    t = F.col("text")
    for a, b in _SPOIL.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return T.lines(spark, sf).select("doc_id", "pos", X.normalize_text(t).alias("text"))


_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[\\p{{P}}$+<=>^`|~]', '', 'g'), '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


@query(f"SELECT doc_id, array_to_string({_TOKENS.format(c='text')}, ' ') answer, CAST(len({_TOKENS.format(c='text')}) AS INTEGER) n FROM documents")
def str26_answer_tokens(spark, sf):
    t = T.table(spark, sf, "documents").select("doc_id", X.answer_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.array_join("t", " ").alias("answer"), F.size("t").alias("n"))


_LONG = "lt AS (SELECT doc_id, w, count(*) n FROM (SELECT doc_id, unnest({d}) w FROM documents) GROUP BY ALL), gt AS (SELECT item_id, w, count(*) n FROM (SELECT item_id, unnest({d}) w FROM benchmark) GROUP BY ALL), pairs AS (SELECT doc_id, item_id FROM lt JOIN gt USING (w) WHERE length(w) >= 7 GROUP BY ALL HAVING count(*) >= 3)".format(d=_TOKENS.format(c="text"))


@query(f"""WITH {_LONG}, c AS (SELECT p.doc_id, p.item_id, sum(least(lt.n, gt.n)) n_common FROM pairs p JOIN lt ON lt.doc_id = p.doc_id JOIN gt ON gt.item_id = p.item_id AND gt.w = lt.w GROUP BY ALL),
dn AS (SELECT doc_id, sum(n) n FROM lt GROUP BY doc_id), gn AS (SELECT item_id, sum(n) n FROM gt GROUP BY item_id)
SELECT c.doc_id, c.item_id, CAST(dn.n AS BIGINT) n_pred, CAST(gn.n AS BIGINT) n_gold, CAST(n_common AS BIGINT) n_common, round(2.0 * n_common / (dn.n + gn.n), 6) f1 FROM c JOIN dn USING (doc_id) JOIN gn USING (item_id)""")
def met01_token_f1(spark, sf):
    """Of every document with every benchmark item that it shares three long tokens with."""
    d, b = T.table(spark, sf, "documents"), T.table(spark, sf, "benchmark")
    return S.indexed_f1(d.select("doc_id", "text"), b.select("item_id", "text")).withColumn("f1", _r("f1"))


_PLAIN = "regexp_replace({c}, '[^\\x00-\\x7f]', '?', 'g')"


@query(f"WITH {_LONG}, h AS (SELECT doc_id, item_id, {_PLAIN.format(c='d.text')} p, {_PLAIN.format(c='b.text')} g FROM pairs JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)) SELECT doc_id, item_id, round(coalesce(levenshtein(p, g) / nullif(greatest(length(p), length(g)), 0), 0.0), 6) ned FROM h")
def met05_edit_distance(spark, sf):
    """Of whole texts, for the pairs of met01; other than ASCII characters count as one mark, as the SQL engine counts bytes."""
    plain = lambda c: F.regexp_replace(c, "[^\\x00-\\x7f]", "?")
    d, b = T.table(spark, sf, "documents").select("doc_id", F.col("text").alias("pred")), T.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("gold"))
    pairs = S.indexed_f1(d.withColumnRenamed("pred", "text"), b.withColumnRenamed("gold", "text")).select("doc_id", "item_id")
    both = pairs.join(b, "item_id").join(d, "doc_id")
    return both.select("doc_id", "item_id", _r(S.edit_distance(plain("pred"), plain("gold"))).alias("ned"))


@query(f"""WITH {BOXES}, r AS (SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, idx) rank FROM boxes),
t AS (SELECT a.page_id, sum(sign(a.idx - b.idx) * sign(a.rank - b.rank)) s, count(*) n FROM r a JOIN r b ON a.page_id = b.page_id AND a.idx < b.idx GROUP BY a.page_id)
SELECT p.page_id, round(CASE WHEN t.s IS NULL THEN 1.0 ELSE CAST(t.s AS DOUBLE) / t.n END, 6) tau FROM (SELECT DISTINCT page_id FROM boxes) p LEFT JOIN t USING (page_id)""")
def met06_kendall_tau(spark, sf):
    r = L.reading_order(T.boxes(spark, sf)).select("page_id", "idx", "rank")
    return S.kendall_tau(r, ["page_id"], "idx", "idx", "rank").withColumn("tau", _r("tau"))


@query(f"""WITH {LINES}, k AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,}}')) AS key FROM lines), n AS (SELECT source, count(*) n FROM documents GROUP BY source),
d AS (SELECT source, key, count(*) df FROM k GROUP BY source, key) SELECT source, key, df, round(CASE WHEN df > greatest(2.0, 0.25 * n) THEN 0.0 ELSE ln(n / df) + 1 END, 6) weight FROM d JOIN n USING (source)""")
def agg12_idf(spark, sf):
    k = T.lines(spark, sf).select("source", "doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 1)).alias("key"))
    return S.idf(k, T.table(spark, sf, "documents"), "source", "doc_id", "key").withColumn("weight", _r("weight"))


@query("SELECT coalesce(event_type, 'TOTAL') category, count(*) n, round(count(*) / (SELECT count(*) FROM events), 6) share FROM events GROUP BY ROLLUP (event_type)")
def agg01_category_counts(spark, sf):
    return S.category_counts(T.table(spark, sf, "events"), "event_type").withColumn("share", _r("share"))


@query("SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END gold, coalesce(CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'mid' END, '∅') pred, count(*) n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def agg07_confusion(spark, sf):
    r = T.table(spark, sf, "labels").join(T.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    n = F.col("n_chars")
    return S.confusion(r.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("g"), F.when(n > 2000, "long").when(n > 500, "mid").alias("p")), "g", "p")


@query("""SELECT CASE grouping_id(lang, source) WHEN 3 THEN 'overall' WHEN 1 THEN 'lang' ELSE 'source' END dimension, coalesce(lang, source, '') AS value, count(*) n, CAST(sum(CAST(n_chars > 1000 AS INTEGER)) AS BIGINT) hits, round(sum(CAST(n_chars > 1000 AS INTEGER)) / count(*), 6) rate FROM documents GROUP BY GROUPING SETS ((), (lang), (source))""")
def agg03_tallies(spark, sf):
    return S.tallies(T.table(spark, sf, "documents"), ["lang", "source"], F.col("n_chars") > 1000).withColumn("rate", _r("rate"))


_HTOK = "list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2))"


@query(f"""WITH {LINES}, p AS (SELECT doc_id, pos, text, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) nxt FROM lines), t AS (SELECT doc_id, pos, {_HTOK.format(c='text')} a, {_HTOK.format(c='nxt')} b FROM p WHERE nxt IS NOT NULL)
SELECT doc_id, CAST(pos AS INTEGER) pos, round(CASE WHEN least(len(a), len(b)) > 0 THEN len(list_intersect(a, b)) / least(len(a), len(b)) ELSE 0.0 END, 6) similarity FROM t""")
def str10_header_similarity(spark, sf):
    from pyspark.sql import Window

    p = T.lines(spark, sf).withColumn("nxt", F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos"))).where("nxt is not null")
    return p.select("doc_id", "pos", _r(X.header_similarity(F.col("text"), F.col("nxt"))).alias("similarity"))


@query(f"WITH {LINES} SELECT doc_id, arg_max(text, {{'l': length(text), 'p': -pos}}) header, CAST(max(length(text)) AS INTEGER) n FROM lines GROUP BY doc_id")
def agg16_longest_header(spark, sf):
    return T.lines(spark, sf).groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("pos"))).alias("header"), F.max(F.length("text")).alias("n"))


@query(f"WITH {BOXES} SELECT page_id, CAST(idx AS BIGINT) AS id, [x1, y1, x2 - x1, y2 - y1] AS bbox, (x2 - x1) * (y2 - y1) AS area, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, idx) - 1 AS INTEGER) AS order_id, label FROM boxes")
def snk11_layout_to_coco(spark, sf):
    b = L.reading_order(T.boxes(spark, sf))
    return b.select("page_id", F.col("idx").cast("long").alias("id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), G.area(G.box()).alias("area"), F.col("rank").alias("order_id"), "label")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import documents, evaluation, linking, reading, shapes  # noqa: E402 - they register their queries here

#: Queries that SQL cannot express (character runs, iteration, cuts, interpolated precision); tests hold them to brute force.
for _f in (
    documents.jn10_orphan_captions, documents.jn15_cross_links, documents.pip05_link_document, documents.str12_character_similarity, documents.str13_same_section, documents.win12_section_changes,
    documents.win17_continuation_scores, documents.win19_merged_articles, evaluation.met02_edit_ratio, evaluation.met06_tau_of_xy_cut, evaluation.met07_bleu, evaluation.met08_average_precision,
    evaluation.met10_order_after_matching, evaluation.met11_order_on_gold, evaluation.srt08_xy_cut, evaluation.srt09_enhanced_xy_cut,
):
    Q[_f.__name__] = _f
assert linking and reading and shapes

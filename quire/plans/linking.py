"""Registered queries of text keys, linking scores and further joins, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import layout as L
from ..operators import scores as S
from ..sources import layouts as T
from ..sources.layouts import BLOCKS, BOXES, ITEMS, LINES, PREDICTED
from .registry import _COST, _SESSION, _greedy, _iou, _r, query

_WORDS = "[\\p{L}\\p{N}_]+"
_STEM = "^(.{5,}?)(?:jema|jevi|jeva|jevo|jem|jev|jih|oma|ama|ega|emu|ovi|ova|ovo|ov|om|em|ju|ja|je|mi|ih|ah|am|u|a|e|i|o)$"
_FOLD = "strip_accents(replace(lower({c}), 'ß', 'ss'))"
_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"""WITH {LINES}, t AS (SELECT doc_id, pos, translate(substr(text, 1, 12), '{_SMALL}', '{_LARGE}') || substr(text, 13) AS text FROM lines),
c AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t]+'), lambda w: regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '\\p{{Ll}}')), ' ') caps FROM t)
SELECT doc_id, CAST(pos AS INTEGER) pos, CASE WHEN caps <> '' THEN caps ELSE trim(text, ' ') END header FROM c""")
def str08_clean_header(spark, sf):
    t = F.concat(F.translate(F.substring("text", 1, 12), _SMALL, _LARGE), F.expr("substring(text, 13)"))
    return T.lines(spark, sf).select("doc_id", "pos", X.clean_header(t).alias("header"))


@query(f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) pos, regexp_replace({_FOLD.format(c='text')}, '[^a-z0-9]', '', 'g') squashed FROM lines")
def str11_squash(spark, sf):
    return T.lines(spark, sf).select("doc_id", "pos", X.squash(F.col("text")).alias("squashed"))


@query(f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) pos, len(regexp_extract_all(text, '{_WORDS}')) BETWEEN 1 AND 8 AS is_header FROM lines")
def str15_running_header(spark, sf):
    return T.lines(spark, sf).select("doc_id", "pos", X.is_running_header(F.col("text")).alias("is_header"))


_PARTS = f"list_filter(string_split(regexp_replace({_FOLD.format(c='text')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) pos, array_to_string(list_transform({_PARTS}, lambda w: regexp_replace(w, '{_STEM}', '\\1')), ' ') AS key FROM lines")
def str17_entity_key(spark, sf):
    return T.lines(spark, sf).select("doc_id", "pos", X.entity_key(F.col("text")).alias("key"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, pos, array_to_string(list_transform({_PARTS}, lambda w: regexp_replace(w, '{_STEM}', '\\1')), ' ') AS k FROM lines)
SELECT doc_id, CAST(pos AS INTEGER) pos, list_filter([k, CASE WHEN contains(k, ' ') AND pos % 2 = 0 THEN string_split(k, ' ')[-1] END], lambda x: x <> '') AS keys FROM k""")
def str19_entity_keys(spark, sf):
    label = F.when(F.col("pos") % 2 == 0, "PER").otherwise("LOC")
    return T.lines(spark, sf).select("doc_id", "pos", X.entity_keys(F.col("text"), label).alias("keys"))


@query(f"WITH {LINES} SELECT doc_id, CAST(pos AS INTEGER) pos, array_to_string(regexp_extract_all(lower(text), '{_WORDS}'), ' ') title FROM lines")
def str20_title_key(spark, sf):
    return T.lines(spark, sf).select("doc_id", "pos", X.title_key(F.col("text")).alias("title"))


_TITLES = "trim(text, ' ') <> '' AND NOT regexp_matches(text, ':[ \\t]*$') AND NOT regexp_matches(text, '^[ \\t]*\\(?[0-9]{1,2}[ \\t]*[.)]')"


@query("WITH " + LINES + ", t AS (SELECT doc_id, pos, CASE pos % 4 WHEN 1 THEN '2. ' || text WHEN 2 THEN text || ':' ELSE text END AS text FROM lines) SELECT doc_id, CAST(pos AS INTEGER) pos, CASE WHEN " + _TITLES + " THEN trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ') END title FROM t")
def str25_piece_title(spark, sf):
    t, k = F.col("text"), F.col("pos") % 4
    spoilt = F.when(k == 1, F.concat(F.lit("2. "), t)).when(k == 2, F.concat(t, F.lit(":"))).otherwise(t)
    return T.lines(spark, sf).select("doc_id", "pos", X.piece_title(spoilt).alias("title"))


@query("SELECT DISTINCT source, array_to_string(list_transform(regexp_extract_all(source, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(r, 20, '0') ELSE lower(r) END), '') sort_key FROM documents")
def str33_natural_key(spark, sf):
    return T.table(spark, sf, "documents").select("source").distinct().select("source", X.natural_key(F.col("source")).alias("sort_key"))


_SCORED = f"pairs AS (SELECT * FROM (SELECT p.page_id, p.idx i, g.idx j, {_iou('p', 'g')} s FROM pred p JOIN boxes g ON p.page_id = g.page_id) WHERE s >= 0.5)"


@query(f"WITH {BOXES}, {PREDICTED}, {_SCORED} SELECT page_id, i, arg_max(j, {{'s': s, 'n': -j}}) j, round(max(s), 6) s FROM pairs GROUP BY page_id, i")
def jn07_best_by_iou(spark, sf):
    return L.best_by_iou(T.predicted(spark, sf), T.boxes(spark, sf), 0.5).select("page_id", "i", "j", _r("s").alias("s"))


@query(f"WITH {BOXES}, {PREDICTED}, {_SCORED}, m AS ({'WITH ' + _greedy('pairs', '-')}) SELECT page_id, idx, label FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = b.page_id AND m.j = b.idx)")
def set06_unmatched(spark, sf):
    g = T.boxes(spark, sf)
    return L.unmatched(g, L.match_by_iou(T.predicted(spark, sf), g), "j").select("page_id", "idx", "label")


_BEFORE = "OVER (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"WITH {BOXES}, s AS (SELECT *, last_value(CASE WHEN label = 'Figure' THEN idx END IGNORE NULLS) {_BEFORE} f, last_value(CASE WHEN label NOT IN ('Figure', 'Caption', 'Header') THEN idx END IGNORE NULLS) {_BEFORE} b FROM boxes) SELECT page_id, idx, CASE WHEN f > coalesce(b, -1) THEN f END figure FROM s WHERE label = 'Caption'")
def jn13_followed_figures(spark, sf):
    return L.followed_figures(T.boxes(spark, sf))


@query(f"""WITH {BOXES}, r AS (SELECT *, sum(CAST(label = 'Headline' AS INTEGER)) OVER (PARTITION BY page_id ORDER BY idx ROWS UNBOUNDED PRECEDING) run FROM boxes)
SELECT a.page_id, a.idx, count(b.idx) AS "foreign" FROM r a LEFT JOIN r b ON a.page_id = b.page_id AND a.run <> b.run AND b.label NOT IN ('Figure', 'Caption') WHERE a.label IN ('Figure', 'Caption') GROUP BY a.page_id, a.idx""")
def jn14_foreign_blocks(spark, sf):
    return L.foreign_blocks(T.boxes(spark, sf))


@query(f"WITH {ITEMS}, s AS ({_SESSION}), a AS (SELECT doc_id, CAST(article AS BIGINT) article, min(pos) first_pos FROM s WHERE article IS NOT NULL GROUP BY ALL), n AS (SELECT *, lead(article) OVER (PARTITION BY doc_id ORDER BY first_pos) AS \"following\" FROM a) SELECT * FROM n WHERE \"following\" IS NOT NULL")
def jn16_adjacent_articles(spark, sf):
    return L.adjacent_articles(T.items(spark, sf))


@query(f"WITH {ITEMS}, s AS ({_SESSION}), g AS (SELECT doc_id, CAST(article AS BIGINT) article, count(*) n, min(pos) first_pos FROM s GROUP BY ALL) SELECT doc_id, article, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS INTEGER) rank FROM g")
def agg02_most_common_articles(spark, sf):
    return S.most_common_articles(L.sessionise(T.items(spark, sf)), "doc_id")


@query("""WITH t AS (SELECT source, count(*) visuals, count(*) FILTER (n_chars < 200) anchor_missing, count(*) FILTER (n_chars >= 200 AND doc_id % 5 <> 0) scored, count(*) FILTER (n_chars >= 200 AND doc_id % 5 > 1) correct, count(*) FILTER (n_chars > 500) separation_pairs, count(*) FILTER (n_chars > 1500) separation_failures FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN scored <> 0 THEN correct / scored ELSE 0.0 END accuracy, CASE WHEN visuals <> anchor_missing THEN correct / (visuals - anchor_missing) ELSE 0.0 END recall, CASE WHEN separation_pairs <> 0 THEN (separation_pairs - separation_failures) / separation_pairs ELSE 0.0 END separation_rate FROM t)
SELECT source, round(accuracy, 6) accuracy, round(recall, 6) recall, round(separation_rate, 6) separation_rate, round(CASE WHEN accuracy + separation_rate <> 0 THEN 2 * accuracy * separation_rate / (accuracy + separation_rate) ELSE 0.0 END, 6) score FROM r""")
def agg05_rates(spark, sf):
    n, k, count = F.col("n_chars"), F.col("doc_id") % 5, F.count_if
    t = T.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("visuals"), count(n < 200).alias("anchor_missing"), count((n >= 200) & (k != 0)).alias("scored"), count((n >= 200) & (k > 1)).alias("correct"), count(n > 500).alias("separation_pairs"), count(n > 1500).alias("separation_failures"))
    return S.rates(t).select("source", *[_r(c).alias(c) for c in ("accuracy", "recall", "separation_rate", "score")])


@query("SELECT d.lang, round(avg(l.quality), 6) quality, round(avg(l.toxic), 6) toxic, round(avg(d.n_chars), 6) n_chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def agg09_metric_means(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(T.table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(*[_r(F.avg(c)).alias(c) for c in ("quality", "toxic", "n_chars")])


@query(f"WITH {BOXES} SELECT page_id, median(y2 - y1) height, round(avg(y2 - y1), 6) mean_height, round(avg(x2 - x1), 6) mean_width, count(*) n FROM boxes GROUP BY page_id")
def agg10_block_medians(spark, sf):
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    return T.boxes(spark, sf).groupBy("page_id").agg(F.median(h).alias("height"), _r(F.avg(h)).alias("mean_height"), _r(F.avg(w)).alias("mean_width"), F.count(F.lit(1)).alias("n"))


_WEIGHTED = LINES + """, k AS (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS key FROM lines), n AS (SELECT source, count(*) n FROM documents GROUP BY source),
d AS (SELECT source, key, count(*) df FROM k GROUP BY source, key), w AS (SELECT source, doc_id, key, CASE WHEN df > greatest(2.0, 0.25 * n) THEN 0.0 ELSE ln(n / df) + 1 END weight FROM k JOIN d USING (source, key) JOIN n USING (source))"""


def _weighted(spark, sf):
    k = T.lines(spark, sf).select("source", "doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{3,})"), 1)).alias("key")).distinct()
    return k.join(S.idf(k, T.table(spark, sf, "documents"), "source", "doc_id", "key"), ["source", "key"])


@query(f"""WITH {_WEIGHTED}, t AS (SELECT doc_id, sum(weight) t FROM w GROUP BY doc_id), c AS (SELECT key FROM w GROUP BY key HAVING count(*) BETWEEN 2 AND 10), p AS (SELECT DISTINCT x.doc_id a, y.doc_id b FROM w x JOIN w y ON x.key = y.key AND x.doc_id < y.doc_id WHERE x.key IN (SELECT key FROM c)),
s AS (SELECT p.a, p.b, sum(x.weight) s, list(x.key ORDER BY x.weight DESC, x.key) shared FROM p JOIN w x ON x.doc_id = p.a JOIN w y ON y.doc_id = p.b AND x.key = y.key WHERE x.weight > 0 GROUP BY ALL)
SELECT p.a, p.b, round(CASE WHEN ta.t * tb.t > 0 AND s IS NOT NULL THEN least(1.0, s / sqrt(ta.t * tb.t)) ELSE 0.0 END, 5) similarity, coalesce(shared, []) shared FROM p LEFT JOIN s USING (a, b) LEFT JOIN t ta ON ta.doc_id = p.a LEFT JOIN t tb ON tb.doc_id = p.b""")
def agg13_weighted_similarity(spark, sf):
    """Of all documents that share a key which ten documents have at most, with the keys that they share."""
    w = _weighted(spark, sf).select(F.col("doc_id").alias("id"), "key", "weight")
    return S.weighted_similarity(S.shared_key_pairs(w), w).withColumn("similarity", _r("similarity", 5))


@query(f"WITH {LINES} SELECT source, list_sort(list(DISTINCT key)) AS keys FROM (SELECT source, unnest(regexp_extract_all(text, '[A-Z][a-z]{{7,}}')) AS key FROM lines) GROUP BY source")
def agg14_key_union(spark, sf):
    k = T.lines(spark, sf).select("source", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{7,})"), 1)).alias("key"))
    return k.groupBy("source").agg(F.array_sort(F.collect_set("key")).alias("keys"))


@query(f"WITH {_WEIGHTED}, r AS (SELECT doc_id, key, weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, key) AS INTEGER) rank FROM w) SELECT doc_id, key, round(weight, 6) weight, rank FROM r WHERE rank <= 10")
def agg15_rarest_keys(spark, sf):
    return S.rarest_keys(_weighted(spark, sf), ["doc_id"]).select("doc_id", "key", _r("weight").alias("weight"), "rank")


@query(f"WITH {BLOCKS}, b AS (SELECT *, last_value(CASE WHEN category NOT IN ('Figure', 'Caption', 'FigByline') THEN pos END IGNORE NULLS) OVER w anchor, last_value(CASE WHEN category NOT IN ('Figure', 'Caption', 'FigByline') THEN page_no END IGNORE NULLS) OVER w page FROM blocks WHERE category <> 'Abandon' WINDOW w AS (PARTITION BY doc_id ORDER BY page_no, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc_id, pos, anchor, page <> page_no crosses FROM b WHERE category IN ('Figure', 'Caption', 'FigByline')")
def jn12_document_anchors(spark, sf):
    """With the fallback to the nearest earlier page."""
    return L.document_anchors(T.blocks(spark, sf))


_FLOW = f"""{BLOCKS}, s AS (SELECT *, CASE WHEN pos % 2 = 1 THEN lower(substr(text, 1, 1)) || substr(text, 2) ELSE text END raw FROM blocks), q AS (SELECT doc_id, pos, CASE WHEN category IN ('Headline', 'Subhead', 'Section') THEN category WHEN category IN ('Figure', 'Caption', 'Footnote') THEN category ELSE 'Paragraph' END category, regexp_replace(raw, '[.]$', CASE WHEN pos % 3 = 0 THEN '-' ELSE '' END) t, x1, y1, x2, y2 FROM s),
g AS (SELECT *, count(*) FILTER (category IN ('Headline', 'Subhead', 'Section')) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) segment FROM q), p AS (SELECT *, lag(t) OVER (PARTITION BY doc_id, segment ORDER BY pos) prev FROM g WHERE category = 'Paragraph'),
j AS (SELECT *, coalesce(trim(prev, ' ') <> '' AND trim(t, ' ') <> '' AND NOT regexp_matches(prev, '[.!?\\x{{2026}}\\x{{3002}}]["'')\\]\\x{{bb}}\\x{{201d}}\\x{{2019}}]*\\s*$') AND regexp_matches(t, '^\\s*[\\p{{Ll}}\\p{{Nd}},;)\\x{{2013}}-]'), false) joins FROM p),
k AS (SELECT *, sum(CAST(NOT joins AS INTEGER)) OVER (PARTITION BY doc_id, segment ORDER BY pos ROWS UNBOUNDED PRECEDING) para FROM j)
SELECT doc_id, min(pos) pos, count(*) n, string_agg(CASE WHEN NOT joins THEN '' WHEN suffix(prev, '-') AND regexp_matches(t, '^\\p{{Ll}}') THEN '' ELSE ' ' END || CASE WHEN suffix(t, '-') AND nx THEN regexp_replace(t, '-$', '') ELSE t END, '' ORDER BY pos) AS "text", min(x1) x1, min(y1) y1, max(x2) x2, max(y2) y2 FROM (SELECT *, coalesce(lead(joins) OVER (PARTITION BY doc_id, segment ORDER BY pos) AND regexp_matches(lead(t) OVER (PARTITION BY doc_id, segment ORDER BY pos), '^\\p{{Ll}}'), false) nx FROM k) GROUP BY doc_id, segment, para"""


@query(f"WITH {_FLOW}")
def win04_merge_flow(spark, sf):
    """Paragraphs across floats, joined at hyphens, with the union of their boxes (PRJ-03, STR-07)."""
    b = T.blocks(spark, sf)
    low = F.when(F.col("pos") % 2 == 1, F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"))).otherwise(F.col("text"))
    text = F.when(F.col("pos") % 3 == 0, F.regexp_replace(low, "[.]$", "-")).otherwise(F.regexp_replace(low, "[.]$", ""))
    kept = F.when(F.col("category").isin("Headline", "Subhead", "Section", "Figure", "Caption", "Footnote"), F.col("category")).otherwise("Paragraph")
    return L.merge_flow(b.withColumn("category", kept).withColumn("text", text))


@query(f"WITH {BOXES}, pairs AS ({_COST}), m AS ({'WITH ' + _greedy('pairs', '+')}) SELECT page_id, idx, label FROM boxes b WHERE (label = 'Figure' AND NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = b.page_id AND m.i = b.idx)) OR (label = 'Caption' AND NOT EXISTS (SELECT 1 FROM m WHERE m.page_id = b.page_id AND m.j = b.idx))")
def jn06_unmatched_captions(spark, sf):
    """Figures and captions that the match leaves over."""
    _, f, c = L.caption_matches(T.boxes(spark, sf))
    return f.select("page_id", "idx", F.lit("Figure").alias("label")).unionByName(c.select("page_id", "idx", F.lit("Caption").alias("label")))

"""Operators that SQL cannot express, against brute force or known cases."""

import itertools
import json
import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import plugins
from quire.functions import similarity as S
from quire.operators import evaluation as E
from quire.operators import linking as K
from quire.operators import names, xycut
from quire.plugins import apply
from quire.sources import files
from quire.streaming import results

ITEM = "doc_id long, page_no int, pos int, category string, text string, article long, figure_id int, x1 double, y1 double, x2 double, y2 double"


def items(spark, rows):
    return spark.createDataFrame([(1, p, k, c, t, a, None, 0.0, 100.0 * k, 50.0, 100.0 * k + 50) for k, (p, c, t, a) in enumerate(rows)], ITEM)


# --- similarities
def distance(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    best[:, 0], best[0] = range(len(a) + 1), range(len(b) + 1)
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1, j + 1] = min(best[i, j + 1] + 1, best[i + 1, j] + 1, best[i, j] + (a[i] != b[j]))
    return int(best[-1, -1])


def bleu(r, c):
    p = []
    for n in range(1, 5):
        g = [tuple(c[i : i + n]) for i in range(len(c) - n + 1)]
        k = [tuple(r[i : i + n]) for i in range(len(r) - n + 1)]
        p.append(sum(min(g.count(x), k.count(x)) for x in set(g)) / len(g) if g else 0)
    return 0.0 if min(p) == 0 else math.exp(sum(map(math.log, p)) / 4) * min(1.0, math.exp(1 - len(r) / len(c)))


def test_sequences(spark):
    rnd = random.Random(1)
    rows = [([rnd.randrange(5) for _ in range(rnd.randrange(9))], [rnd.randrange(5) for _ in range(rnd.randrange(9))]) for _ in range(80)] + [([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6]), ([], [])]
    df = spark.createDataFrame([(i, a, b, list(map(str, a)), list(map(str, b))) for i, (a, b) in enumerate(rows)], "i int, a array<int>, b array<int>, x array<string>, y array<string>")
    out = {r.i: r for r in df.select("i", S.sequence_distance(F.col("a"), F.col("b")).alias("d"), S.bleu(F.col("x"), F.col("y")).alias("bleu")).collect()}
    for i, (a, b) in enumerate(rows):
        assert out[i].d == distance(a, b) and abs(out[i].bleu - bleu(a, b)) < 1e-9, i


def test_character_runs(spark):
    rows = [("(PRED)USM ERJENE STRANI", "CPRED)USMEHJENE STRAHI"), ("IAHHCIO ODMEVI", "ODMEVI"), ("PISMA", "KRIŽANKA"), ("", "x"), (None, None), ("a" * 300, "a" * 150 + "b" * 150)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    out = {r.i: r for r in df.select("i", S.character_similarity(F.col("a"), F.col("b")).alias("c"), S.same_section(F.col("a"), F.col("b")).alias("s"), S.title_similarity(F.col("a"), F.col("b")).alias("t")).collect()}
    assert abs(out[0].c - SequenceMatcher(None, "predusmerjenestrani", "cpredusmehjenestrahi").ratio()) < 1e-12
    assert [out[i].s for i in range(5)] == [True, True, False, False, False] and out[3].c == 0.0 and out[4].c == 0.0
    assert abs(out[5].c - SequenceMatcher(None, rows[5][0], rows[5][1]).ratio()) < 1e-12


# --- scores
def slow_ap(pred, gold, t):
    """pred: (score, box), gold: boxes."""
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(w, 0) * max(h, 0)
        u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
        return i / u if u > 0 else 0.0

    used, tp = set(), []
    for _, p in sorted(pred, key=lambda x: -x[0]):
        best, at = t - 1e-10, None
        for j, g in enumerate(gold):
            if j not in used and iou(p, g) >= best:
                best, at = iou(p, g), j
        tp.append(at is not None)
        used.add(at)
    points = [(sum(tp[: k + 1]) / len(gold), sum(tp[: k + 1]) / (k + 1)) for k in range(len(tp))]
    return sum(max((p for r, p in points if r >= q / 100 - 1e-12), default=0.0) for q in range(101)) / 101


def test_average_precision(spark):
    rnd = random.Random(3)
    box = lambda: (lambda x, y: (float(x), float(y), float(x + rnd.randrange(5, 60)), float(y + rnd.randrange(5, 60))))(rnd.randrange(60), rnd.randrange(60))
    pages = []
    for _ in range(25):
        gold = [(rnd.choice("ab"), box()) for _ in range(rnd.randrange(5))]
        pred = [(c, tuple(v + rnd.randrange(-4, 5) for v in b), rnd.random()) for c, b in gold if rnd.random() < 0.8] + [(rnd.choice("abc"), box(), rnd.random()) for _ in range(rnd.randrange(3))]
        pages.append((pred, gold))
    schema = "page_id long, idx int, label string, x1 double, y1 double, x2 double, y2 double, score double"
    p = spark.createDataFrame([(k, i, c, *b, s) for k, (pred, _) in enumerate(pages) for i, (c, b, s) in enumerate(pred)], schema)
    g = spark.createDataFrame([(k, i, c, *b, None) for k, (_, gold) in enumerate(pages) for i, (c, b) in enumerate(gold)], schema)
    out = {r.page_id: r for r in E.average_precision(p, g).collect()}
    for k, (pred, gold) in enumerate(pages):
        if not pred and not gold:
            assert k not in out
            continue
        want = []
        for t in (0.5, 0.75):
            per = [slow_ap([(s, b) for c, b, s in pred if c == x], [b for c, b in gold if c == x], t) for x in sorted({c for c, _ in gold})]
            want.append(sum(per) / len(per) if per and pred else 0.0)
        assert abs(out[k].map_50 - want[0]) < 1e-9 and abs(out[k].map_75 - want[1]) < 1e-9, k


def test_orders(spark):
    rows = [(1, i, "Paragraph", i, (3 - i) % 4) for i in range(4)] + [(2, 0, "Figure", 0, 0), (2, 1, "Paragraph", 1, 1), (3, 0, "Header", 0, 0)]
    out = {r.page_id: r for r in E.order_on_gold(spark.createDataFrame(rows, "page_id long, idx int, label string, gold int, pred int")).collect()}
    assert (out[1].regions, out[1].edit, out[1].tau, out[1].bleu) == (4, 1.0, -1.0, 0.0)
    assert [(out[k].regions, out[k].edit, out[k].tau, out[k].bleu) for k in (2, 3)] == [(1, 0.0, 1.0, 0.0), (0, 0.0, 1.0, 0.0)]
    box = lambda p, i, rank, dx=0.0: (p, i, 100.0 * i + dx, 0.0, 100.0 * i + 50 + dx, 50.0, rank)
    schema = "page_id long, idx int, x1 double, y1 double, x2 double, y2 double, rank int"
    g = spark.createDataFrame([box(1, i, i) for i in range(4)] + [box(2, 0, 0)], schema)
    p = spark.createDataFrame([box(1, i, 3 - i, 2.0) for i in range(4)] + [box(2, 0, 0)], schema)
    out = {r.page_id: r for r in E.order_after_matching(p, g).collect()}
    assert (out[1].matched, out[1].tau, out[1].edit) == (4, -1.0, 1.0) and (out[2].matched, out[2].tau, out[2].edit) == (1, 0.0, None)


# --- cuts
def boxes(*rows):
    return np.array(rows, dtype=float)


def test_cuts_follow_white_space():
    two_columns = boxes([0, 0, 100, 10], [0, 20, 45, 60], [55, 20, 100, 40], [0, 70, 45, 90], [55, 50, 100, 90])
    assert xycut.order_of(two_columns) == [0, 1, 3, 2, 4]
    assert xycut.cut(two_columns, 1)[0] == 0 and sorted(xycut.cut(two_columns, 0)) == list(range(5))
    rows = boxes([60, 0, 90, 10], [0, 0, 30, 10], [0, 30, 30, 40], [60, 30, 90, 40])
    assert xycut.cut(rows, 1) == [1, 0, 2, 3] and xycut.cut(rows, 0) == [1, 2, 0, 3]
    middle = boxes([0, 0, 45, 40], [55, 0, 100, 40], [0, 50, 100, 60], [0, 70, 45, 90], [55, 70, 100, 90], [0, 95, 45, 99], [55, 95, 100, 99])
    assert xycut.order_of(middle) == list(range(7)) and xycut.cut(middle[3:], 0) == [0, 2, 1, 3]
    assert xycut.order_of(boxes([0, 0, 1, 50], [0, 0, 50, 10])) == [1, 0] and xycut.order_of(np.zeros((0, 4))) == []


def test_every_box_once():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        low = rnd.integers(0, 500, (n, 2)).astype(float)
        b = np.concatenate([low, low + rnd.integers(0, 120, (n, 2))], axis=1)
        assert sorted(xycut.order_of(b)) == sorted(xycut.cut(b, 0)) == sorted(xycut.cut(b, 1)) == list(range(n))
    touching = xycut.shrunk(boxes([0, 0, 10, 20], [0, 19, 10, 40]))
    assert touching.tolist() == [[0, 0, 10, 18], [0, 20, 10, 40]]


def test_resolved_logits():
    rnd = np.random.default_rng(2)
    for n in (1, 3, 8):
        x = rnd.standard_normal((n, n))
        order = xycut.resolved_logits(x)
        assert sorted(order) == list(range(n))
        place = {b: k for k, b in enumerate(order)}
        for b, q in itertools.product(range(n), range(n)):  # no box and place that both would rather have each other
            assert not (x[b, q] > x[b, place[b]] and x[b, q] > x[order[q], q])


# --- linking
def test_cross_links(spark):
    rnd = random.Random(2)
    rows = sorted({(d, p, (p // 4 if p % 7 else None), f"key{rnd.randrange(9)}") for d in (1, 2) for p in range(30) for _ in range(2)}, key=repr)
    ix = spark.createDataFrame(rows, "doc_id long, pos int, article long, key string")
    w = spark.createDataFrame([(d, f"key{k}", 0.0 if k == 3 else 1.0 + k) for d in (1, 2) for k in range(9)], "doc_id long, key string, weight double")
    got = {(r.doc_id, r.source, r.target, r.key) for r in K.cross_links(ix, w, 3).collect()}
    want = set()
    for d in (1, 2):
        given = {}
        for key in sorted({k for x, _, _, k in rows if x == d} - {"key3"}):
            at = sorted((p, a) for x, p, a, k in rows if x == d and k == key)
            for (p, a), (q, b) in itertools.combinations(at, 2):
                if not (a is not None and a == b) and given.get(p, 0) < 3 and given.get(q, 0) < 3:
                    want.add((d, p, q, key))
                    given[p], given[q] = given.get(p, 0) + 1, given.get(q, 0) + 1
    assert got == want and want


def test_section_change(spark):
    rows = [(1, "Section", "ODMEVI", 1), (1, "Headline", "A", 1)] + [(1, "Paragraph", "x", 1)] * 3 + [(2, "Section", "PISMA", 1)] + [(2, "Paragraph", "y", 1)] * 4 + [(3, "Section", "QODMEVI PISMA", 1), (3, "Paragraph", "z", 1)]
    df = items(spark, rows)
    heads = {r.page_no: r.header for r in K.running_headers(df).collect()}
    assert heads == {1: "ODMEVI", 2: "PISMA", 3: "QODMEVI PISMA"}
    out = {r.pos: r.piece for r in K.split_sections(df, K.running_headers(df)).collect()}
    assert [out[k] for k in range(12)] == [0] * 5 + [1] * 7
    few = {r.pos: r.piece for r in K.split_sections(df.where("pos < 7"), K.running_headers(df)).collect()}
    assert set(few.values()) == {0}  # two items are no piece


def test_continuations(spark):
    rows = [(1, "Headline", "Potopis", 1), (1, "Paragraph", "Prvi del zgodbe se", 1), (2, "Headline", "", 2), (2, "Paragraph", "nadaljuje tukaj.", 2), (2, "Headline", "Drugo", 3), (2, "Paragraph", "Konec.", 3), (9, "Headline", "Drugo", 4), (9, "Paragraph", "Konec.", 4)]
    df = items(spark, rows)
    none = spark.createDataFrame([], "doc_id long, pos int, article long, key string")
    w = spark.createDataFrame([], "doc_id long, key string, weight double")
    t = K.article_table(df, none, w)
    got = {(r.article, r.following): (round(r.score, 4), r.method, r.accepted) for r in K.continuation_scores(t).collect()}
    assert got == {(1, 2): (0.6, "untitled+seam", True), (2, 3): (0.0, "", False)}  # the gap of seven pages is vetoed
    root, links = K.merged_articles(t)
    assert {r.article: r.root for r in root.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert [(r.article, r.following, r.method) for r in links.collect()] == [(1, 2, "untitled+seam")]


def test_chain_of_continuations(spark):
    """Seven merges, one a round: the plan does not grow with the rounds."""
    rows = [x for k in range(1, 9) for x in ((k, "Headline", "Potopis" if k == 1 else "", k), (k, "Paragraph", "nadaljuje se", k))]
    none = spark.createDataFrame([], "doc_id long, pos int, article long, key string")
    w = spark.createDataFrame([], "doc_id long, key string, weight double")
    root, links = K.merged_articles(K.article_table(items(spark, rows), none, w))
    assert {r.article: r.root for r in root.collect()} == {k: 1 for k in range(1, 9)}
    assert sorted(r.following for r in links.collect()) == list(range(2, 9))
    assert root._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_orphan_captions(spark):
    rows = [(1, "Headline", "a", 1), (1, "Paragraph", "b", 1), (1, "Headline", "c", 2), (1, "Caption", "Janez", 2), (1, "Paragraph", "d", 2), (2, "Caption", "e", None)]
    df = items(spark, rows)
    ix = spark.createDataFrame([(1, 1, 1, "janez"), (1, 3, 2, "janez")], "doc_id long, pos int, article long, key string")
    w = spark.createDataFrame([(1, "janez", 1.5)], "doc_id long, key string, weight double")
    assert {r.pos: (r.article, r.method) for r in K.orphan_captions(df, ix, w).collect()} == {3: (1, "ner"), 5: (None, None)}
    assert {r.pos: (r.article, r.method) for r in K.orphan_captions(df, ix.where("false"), w).collect()} == {3: (2, "geometry"), 5: (None, None)}


# --- files, names
def test_predictions(spark, tmp_path):
    assert files.prediction_layout(["x.json"]) == "odb-json" and files.prediction_layout(["a.md", "b/c.md"]) == "flat" and files.prediction_layout(["b/c.mmd"]) == "paddlex"
    with pytest.raises(ValueError):
        files.prediction_layout(["a.txt"])
    for name, text in (("p1/p1.md", "one"), ("p1/z.md", "no"), ("p2/z.md", "two"), ("p3/a.md", "x"), ("p3/b.md", "y"), ("p4/q.mmd", "four")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.stem: r.markdown for r in files.folder_markdown(files.markdown_files(spark, str(tmp_path))).collect()}
    assert got == {"p1": "one", "p2": "two", "p4": "four"}
    assert files.config(None) is None


def test_documents_and_datasets(spark, tmp_path):
    for name, v in (("b/x_doc.json", 2), ("a/x_doc.json", 1), (".old/y_doc.json", 3), ("c/z_doc.json", 4)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps({"v": v}))
    got = {r.stem: r.v for r in files.parsed_documents(spark, str(tmp_path), "v long").collect()}
    assert got == {"x": 1, "z": 4}
    coco = {"images": [{"id": 7, "file_name": "m_3.png", "width": 10, "height": 20}, {"id": 8, "file_name": "n.png", "width": 1, "height": 1}], "categories": [{"id": 1, "name": "Figure"}], "annotations": [{"id": 1, "image_id": 7, "category_id": 1, "bbox": [1, 2, 3, 4]}]}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "train.json").write_text(json.dumps(coco))
    r = {x.image_id: x for x in files.load(spark, "doclaynet", str(tmp_path / "d")).collect()}
    assert (r[7].stem, r[7].page, r[7].label, r[7].x2, r[7].y2, r[7].score) == ("m", 3, "Figure", 4.0, 6.0, 1.0) and r[8].label is None and r[8].stem == "n"
    with pytest.raises(ValueError):
        files.load(spark, "nothing", "x")


def test_lookup(spark):
    df = spark.createDataFrame([("aa11", "one.pdf"), ("bb22", "two.pdf"), ("cc33", "two_more.pdf")], "digest string, name string")
    assert [r.digest for r in names.lookup(df, "two.pdf").collect()] == ["bb22"]
    assert sorted(r.digest for r in names.lookup(df, "two").collect()) == ["bb22", "cc33"]


# --- plug-ins and streams
def test_plugins(spark):
    assert {"top-bottom", "left-right", "xy-cut"} <= set(plugins.names("order"))
    with pytest.raises(KeyError):
        plugins.make("order", "none")
    with pytest.raises(ValueError):
        plugins.register("nothing", "x")
    assert plugins.LinkConfig.of({"fan_out": 3, "unknown": 1}).fan_out == 3
    b = spark.createDataFrame([(1, i, "Paragraph", 0.0, 100.0 - 10 * i, 50.0, 105.0 - 10 * i) for i in range(4)], "page_id long, idx int, label string, x1 double, y1 double, x2 double, y2 double")
    for name in ("top-bottom", "left-right", "xy-cut"):
        assert [r.idx for r in apply.orders(b, name).orderBy("rank").collect()] == [3, 2, 1, 0], name
    t = spark.createDataFrame([(1, "Pisal je Janez Novak doma."), (2, " "), (3, None)], "i int, text string")
    e = {r.i: [(x.text, x.label) for x in r.entities] for r in apply.entities(t, "capitalised").collect()}
    assert ("Janez Novak", "PER") in e[1] and e[2] == [] and e[3] == []
    c = {r.i: r.reply for r in apply.classes(t.withColumn("text", F.lit("Pisma bralcev")), "keywords").collect()}
    assert set(c.values()) == {"pisma"}


def test_stream_of_results(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    publish = lambda df, _: seen.append({(r.model, r.metric): r.value for r in df.collect()})
    run = lambda: results.keep_report(results.results(spark, str(src)), "layout", str(tmp_path / "ck"), publish, once=True).awaitTermination()
    (src / "1.json").write_text('{"model":"a","track":"layout","metric":"map","value":0.5,"at":1}\n{"model":"a","track":"text","metric":"ned","value":0.1,"at":1}\nnot json\n')
    run()
    (src / "2.json").write_text('{"model":"a","track":"layout","metric":"map","value":0.7,"at":2}\n{"model":"b","track":"layout","metric":"map","value":0.2,"at":1}\n')
    run()
    assert seen[0] == {("a", "map"): 0.5} and seen[-1] == {("a", "map"): 0.7, ("b", "map"): 0.2}

"""Repeated and other ids, clashing columns, empty tables; raking and recall against independent computations."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, common, linededup, mixing, ngram_join, quality, queries, secrets_scan, tokenfile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(n))


def test_repeated_ids_lose_nothing(spark):
    rnd = random.Random(1)
    a, b, c = prose(rnd, 12), prose(rnd, 12), prose(rnd, 12)
    rows = [(1, f"{a}\n{b}", "en", "s", 0), (1, f"{c}\n{a}", "en", "s", 0), (1, f"{c}\n{a}", "en", "s", 0), (2, c, "en", "s", 0), (None, a, "en", "s", 0)]
    left = sorted((r.doc_id or 0, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    said = [line for _, t in left for line in t.split("\n")]
    assert {a, b, c} <= set(said)  # every line is kept somewhere
    assert (0, a) in left and all(i != 2 for i, _ in left)
    # rows equal in id and text count as one row
    kept = [t for i, t in left if i == 1]
    assert len(kept) == 3 and sum(a in t for t in kept) in (1, 2)


def test_ids_that_are_no_numbers_and_clashes(spark):
    rnd = random.Random(2)
    t = prose(rnd, 30)
    rows = [("x9", t, "en", "s", 1, "p", "q", "r"), ("x1", t, "en", "s", 1, "p", "q", "r"), ("x5", prose(rnd, 30), "en", "s", 1, "p", "q", "r")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long, dropped string, mix_p string, cut_id string")
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == ["x1", "x5"]
    assert sorted(r.doc_id for r in linededup.dedup_lines(df).collect()) == ["x1", "x5"]
    out = mixing.sample_mix(df, keep_share=1.0)
    assert out.columns == df.columns and out.count() == 3
    assert quality.keep_good(df).columns == df.columns
    assert {r.doc_id for r in secrets_scan.scan_secrets(df).collect()} == {"x9", "x1", "x5"}


def test_very_long_line_and_empty_table(spark):
    rnd = random.Random(3)
    t = prose(rnd, 20_000)
    w = t.split()
    w[777] = "changed"
    df = spark.createDataFrame([(1, t, "en", "s", 0), (2, " ".join(w), "en", "s", 0), (3, "", "en", "s", 0), (4, None, None, None, None)], DOCS)
    assert {r.doc_id: r.lines for r in linededup.line_groups(df).collect()} == {2: [0]}
    assert linededup.dedup_lines(df.where("false")).collect() == []


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(ValueError):
        common.scratch(Session())


def test_raking_against_plain_loops():
    rnd = random.Random(4)
    cells = list(itertools.product("abc", "xy", "12"))
    tokens = {c: rnd.randrange(1, 1000) for c in cells}
    goals = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.6, "y": 0.4}, {"1": 0.7, "2": 0.3}]
    w, total = dict.fromkeys(cells, 1.0), sum(tokens.values())
    for _ in range(2000):
        for d, goal in enumerate(goals):
            have = {k: sum(tokens[c] * w[c] for c in cells if c[d] == k) / total for k in goal}
            for c in cells:
                w[c] *= goal[c[d]] / have[c[d]]
    names = [sorted(g) for g in goals]
    codes = [np.array([n.index(c[d]) for c in cells]) for d, n in enumerate(names)]
    got = mixing.rake(np.array([tokens[c] for c in cells], float), codes, [np.array([g[k] for k in n]) for g, n in zip(goals, names, strict=True)])
    assert np.allclose(got, [w[c] for c in cells], rtol=1e-6)
    p = np.array([0.1, 0.5, 2.0, 4.0])
    t = np.array([100.0, 50.0, 30.0, 20.0])
    s = mixing.scale_for(t, p, 60.0)
    assert abs((t * np.minimum(1, s * p)).sum() - 60.0) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in df.collect() if r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out = {}
    for r in ann.search(df, F.col("id") % 100 == 0).collect():
        out.setdefault(r.query_id, set()).add(r.vec_id)
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = math.inf
        want = set(ids[np.argsort(d, kind="stable")[:10]].tolist())
        hit, total = hit + len(want & out[int(ids[q])]), total + 10
    assert hit >= 0.9 * total


def test_stages_on_odd_rows(spark):
    rnd = random.Random(5)
    good = [prose(rnd, 60) + ".\n" + prose(rnd, 40) for _ in range(30)]
    texts = [*good, good[0], good[1], None, "", " \n ", "x", prose(rnd, 20_000)]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", len(t or ""), "c") for i, t in enumerate(texts)], DOCS + ", left_text string")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (df, df.where("false")):
            out = stage(spark, rows, "")
            got = out.collect()
            assert len(got) <= rows.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns, name


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@pytest.mark.parametrize("dealt", [linededup.DEALT, 40])
def test_no_alike_line_is_left_out(spark, monkeypatch, dealt):
    """Lines with up to a tenth of their letters changed, spread evenly: every pair at the similarity is in one group."""
    monkeypatch.setattr(linededup, "DEALT", dealt)
    rnd, rows = random.Random(11), []
    for words in (2, 3, 4, 6, 8, 12, 15, 20, 30):
        for _ in range(12):
            line = " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 9))) for _ in range(words))
            other = list(line)
            for k in rnd.sample(range(len(line)), len(line) // 10):
                other[k] = rnd.choice(["", "x", "yz", other[k] + "q"]) if k % 3 else "z"
            rows += [" ".join(x.split()) for x in (line, "".join(other))]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            most = int(0.1 * max(len(rows[a]), len(rows[b])) + 1e-9)
            if min(len(rows[a]), len(rows[b])) >= 10 and abs(len(rows[a]) - len(rows[b])) <= most and (a == b - 1 or len(rows[a]) < 40) and _edits(rows[a], rows[b]) <= most:
                root = [root[a] if r == root[b] else r for r in root]
    want = {k for k in range(len(rows)) if k != root.index(root[k])}
    df = spark.createDataFrame([(k, t, "en", "x", len(t)) for k, t in enumerate(rows)], DOCS)
    got = {r.doc_id for r in linededup.line_groups(df).collect()}
    assert (sorted(got - want), sorted(want - got)) == ([], [])


def test_lines_without_a_common_run_are_not_compared(monkeypatch):
    """Lines of the same letters in another order meet nothing; what shares a run within the edits allowed is found."""
    rnd, pairs, within = random.Random(5), [], linededup._within
    monkeypatch.setattr(linededup, "_within", lambda x, y, i, j, most: pairs.append(len(i)) or within(x, y, i, j, most))
    letters = list("abcdefghijklmnopqrstuvwxyz" * 4)
    texts = []
    for _ in range(400):
        rnd.shuffle(letters)
        texts.append("".join(letters))
    other = list(texts[7])
    for k in range(5, 100, 10):  # as many letters as may change, spread evenly
        other[k] = "Z"
    texts.append("".join(other))
    n, zero = len(texts), np.zeros(len(texts), dtype=np.int32)
    block = {"g": zero, "bi": zero, "bj": zero, "side": zero, "home": zero + 1, "id": np.arange(n), "comp": np.arange(n), "t": texts}
    assert linededup._alike(0.1)(pa.table(block)).to_pylist() == [{"a": 7, "b": n - 1}]
    assert max(pairs) < n


def test_triples_are_counted_once_a_line(monkeypatch):
    counted, count = [], linededup.triple_counts
    monkeypatch.setattr(linededup, "triple_counts", lambda texts, classes: counted.extend(texts) or count(texts, classes))
    texts = [f"one line of many that are alike, number {k}" for k in range(50)]
    x, y = np.zeros(49, dtype=np.int64), np.arange(1, 50)
    kept = [p for xs, ys in linededup._finely(texts, x, y, np.full(49, 4)) for p in zip(xs.tolist(), ys.tolist(), strict=True)]
    assert kept == [(0, k) for k in range(1, 50)] and len(counted) == len(texts)


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_rounds_are_bounded_and_every_two_parts_meet_once(most):
    """What is sent to blocks at a time does not grow with the number of parts, as all blocks at once would."""
    met = []
    for plan in linededup._rounds({3: (7, 10.0), 5: (1, 4.0)}, most):
        blocks = {}
        for g, part, block, side in plan:
            blocks.setdefault((g, block), {})[side] = part
        assert sum({3: 10, 5: 4}[g] * len(b) for (g, _), b in blocks.items()) <= most or len(blocks) == 1
        met += [(g, b[0], b.get(1, b[0])) for (g, _), b in blocks.items()]
    assert sorted(met) == [(3, i, j) for i in range(7) for j in range(i, 7)] + [(5, 0, 0)]


def test_texts_within_edits_against_brute_force():
    rnd, texts = random.Random(2), []
    for k in range(150):
        line = [rnd.choice("abcdé" if k % 3 else "ab\U0001f600") for _ in range(rnd.randint(0, 70))]
        other = list(line)
        for _ in range(rnd.randint(0, 24)):
            at = rnd.randint(0, len(other))
            other[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "b"])
        texts += ["".join(line), "".join(other)]
    x = np.arange(0, 300, 2)
    most = np.array([rnd.randint(0, 24) for _ in x])
    want = [_edits(texts[k], texts[k + 1]) <= m for k, m in zip(x.tolist(), most.tolist(), strict=True)]
    assert linededup._close(texts, x, x + 1, most).tolist() == want and 20 < sum(want) < 130


def test_texts_dealt_out_go_once_the_token_files_are_written(spark, tmp_path):
    import time

    def shuffled():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    df, had = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "doc_id long, text string"), shuffled()
    tokenfile.write_token_files(df, queries.tokenizer_path("word_bpe_49k.json"), path=f"file://{tmp_path}/ids", parts=3)
    for _ in range(50):
        if left := shuffled() - had:
            time.sleep(0.1)
    assert not left

import random
import re

import pytest

from quire.llm import ngram_join as M

SCHEMA = "doc_id long, text string, id string"


def sets_of(text, n):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = {i: sets_of(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            A, B = sets[a], sets[b]
            if A and B and den * len(A & B) >= num * len(A | B):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {i: (len(sets[i]), find(i)) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_brute_force(spark, n, num, den):
    rnd, rows = random.Random(n), []
    vocab = [f"W{i}" for i in range(400)]
    for base in range(14):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 7, 9, 20, 60, 150, 400]))]
        for _ in range(rnd.choice([1, 2, 5, 12])):
            w = list(words)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append(" ".join(w))
    rows += ["", None, "  \n", rows[0].lower(), "Éà b\u0085c d e", "﻿ x"]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert got(M.ngram_join(df, n, num, den)) == brute(rows, n, num, den)


def test_large_group_and_chain(spark):
    """A chain links its ends; a group whose members link only across the middle is found whole."""
    words = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(words[k * 3 : k * 3 + 120])) for k in range(50)] + [(100 + k, " ".join(words)) for k in range(40)]
    df = spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)
    assert got(M.ngram_join(df, 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_empty_table_and_repeats(spark):
    assert M.ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", ""), (1, "a b c d e f", ""), (None, "a b c d e f", ""), (2, "A b c d e f", "")], SCHEMA)
    out = sorted((r.doc_id or -1, r.component_id) for r in M.ngram_join(df).collect())
    assert [x for x in out if x[0] > 0] == [(1, 1), (1, 1), (2, 1)]
    assert sorted(r.doc_id for r in M.keep_one(df.where("doc_id is not null")).collect()) == [1, 1]


def test_frequent_shingles_lose_no_link(spark):
    """Documents made mostly of passages that many share: keys without frequent shingles still find every link."""
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    shared = [" ".join(rnd.choice(vocab) for _ in range(30)) for _ in range(3)]
    rows = []
    for _ in range(120):
        own = [rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 10, 40]))]
        base = " ".join([*rnd.sample(shared, rnd.choice([1, 2, 3])), *own])
        rows.append(base)
        if rnd.random() < 0.4:
            w = base.split()
            w[rnd.randrange(len(w))] = "changed"
            rows.append(" ".join(w))
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert got(M.ngram_join(df, 4, 85, 100)) == brute(rows, 4, 85, 100)


def test_bands_meet():
    for num, den in ((85, 100), (80, 100)):
        bands = M.Bands(num, den)
        for a in range(1, 400):
            for b in range(a, 400):
                if a * den >= b * num:
                    both = {x[0]: x for x in bands.of(a)}.keys() & {x[0] for x in bands.of(b)}
                    assert any(bands.most(a, b) < dict((x[0], x[1] - x[2]) for x in bands.of(a))[k] for k in both)


def test_intersections():
    rnd = random.Random(5)
    sets = [sorted(rnd.sample(range(60), rnd.choice([0, 1, 5, 40]))) + [2**63 + k] * (k % 2) for k in range(70)]
    as_bytes = [M.np.array(x, dtype=M.np.uint64).tobytes() for x in sets]
    for a, b in ((sets, sets), (sets[:9], sets[30:])):
        x = M.intersections(as_bytes[: len(a)], as_bytes[len(sets) - len(b) :])
        assert x.tolist() == [[len(set(p) & set(q)) for q in b] for p in a]


@pytest.mark.parametrize("counted", [M.COUNTED, 7])
def test_every_link_is_counted(spark, monkeypatch, counted):
    """Near copies that all link with each other, a chain and exact copies: n_links is what brute force counts."""
    monkeypatch.setattr(M, "COUNTED", counted)
    words = [f"w{i}" for i in range(300)]
    rows = [" ".join([*words[:200], f"x{k}", *words[200:]]) for k in range(30)]
    rows += [" ".join(words[k * 3 : k * 3 + 120]) for k in range(40)] + [rows[3]] * 4 + ["a b c d e f"] * 3 + ["g h i j k", "", None]
    rows = list(enumerate(rows))
    sets = {i: sets_of(t, 4) for i, t in rows}
    want = {i: sum(j != i and bool(s) and 100 * len(s & t) >= 85 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    assert {r.doc_id: r.n_links for r in M.ngram_join(df, 4, 85, 100).collect()} == want

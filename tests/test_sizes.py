"""What must not grow with the tables: what one task holds, and what a row costs."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quire.functions import similarity as S
from quire.functions import text as X
from quire.operators import evaluation as E
from quire.operators.scores import kendall_tau
from quire.plans import registry
from quire.sources import layouts as T

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_parts_follow_the_files(spark, monkeypatch):
    monkeypatch.setattr(T, "DEALT", 4000)
    assert T.boxes(spark, SF).rdd.getNumPartitions() >= 25  # 116 kB of files
    assert exchanges(registry.queries()["win07_column_gutters"](spark, SF)) <= 1  # and what goes by page stays there


def test_similarity_equals_difflib():
    rnd = random.Random(4)
    for k in range(400):
        letters = "abcdefghijklmnopqrstuvwxyzčß "[: rnd.choice((1, 2, 5, 29))]
        a, b = ("".join(rnd.choice(letters) for _ in range(rnd.randrange(50))) * rnd.randrange(1, 9 if k % 3 == 0 else 2) for _ in range(2))
        assert S.alike(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_key_is_worked_out_once(spark):
    df = spark.createDataFrame([("Ana Ljubljanska", None), ("ŠČĆ ß ΟΔΟΣ", "LOC")], "t string, label string").select(X.entity_keys(F.col("t"), F.col("label")).alias("k"))
    assert [r.k for r in df.collect()] == [["ana ljubljansk", "ljubljansk"], ["scc ss οδοσ"]]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("translate") <= 2


def test_scores_read_their_ranks_once(spark):
    r = spark.range(40).select((F.col("id") % 4).alias("page_id"), F.col("id").alias("idx"), (F.col("id") * 7 % 11).alias("b"))
    plan = kendall_tau(r, ["page_id"], "idx", "idx", "b")._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1
    b = T.boxes(spark, SF)
    assert E.layout_scores(b, b, "page_id", F.col("label"), F.col("label"))._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_coco_files_stay_small(spark, monkeypatch):
    """A large set is many files with the categories of the set; joined, they are what one file a set would be."""
    from quire.plans import documents as D
    from quire.sources import files

    q = {n: registry.queries()[n] for n in ("src05_coco_scan", "set01_joined_images", "set02_joined_annotations")}
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = {n: rows(f(spark, SF)) for n, f in q.items()}
    monkeypatch.setattr(D, "SPAN", 40)
    f = files.coco_files(spark, D._coco_folder(spark, SF) + "/*").select(F.size("images").alias("images"), F.size("categories").alias("categories")).collect()
    assert len(f) > 30 and max(x.images for x in f) <= 10 and {x.categories for x in f} == {6}
    assert {n: rows(g(spark, SF)) for n, g in q.items()} == want

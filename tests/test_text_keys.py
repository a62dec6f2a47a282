"""Text keys and rates on small literal cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import scores as S


@pytest.mark.parametrize(
    "f, given, want",
    [
        (X.entity_key, "Šivic", "sivic"),
        (X.entity_key, "hallerja", "haller"),
        (X.entity_key, "hallerjem", "haller"),
        (X.entity_key, "hallerjeva", "haller"),
        (X.entity_key, "ana", "ana"),
        (X.entity_key, "", ""),
        (X.entity_key, None, None),
        (X.clean_header, "OHVaLLNSCKOH KOMENTIRAMO", "KOMENTIRAMO"),
        (X.clean_header, "nraaH dso a V OSPREDJU", "V OSPREDJU"),
        (X.clean_header, " no capitals ", "no capitals"),
        (X.titles_a_piece, "Leta 1808:", False),
        (X.titles_a_piece, "2. Rebusa", False),
        (X.titles_a_piece, "Plošče", True),
        (X.is_running_header, "", False),
        (X.squash, "(PRED)USM ČŽ", "predusmcz"),
        (X.natural_key, "Page10", "page" + "10".rjust(20, "0")),
    ],
)
def test_text(spark, f, given, want):
    row = spark.createDataFrame([(given,)], "t string").select(f(F.col("t")).alias("v")).first()
    assert row["v"] == want


def test_entity_keys(spark):
    df = spark.createDataFrame([("MATEJA HALLER", "PER"), ("MATEJA HALLER", "LOC"), ("MATEJA HALLER", None), ("  ", "PER")], "t string, label string")
    got = [r["k"] for r in df.select(X.entity_keys(F.col("t"), F.col("label")).alias("k")).collect()]
    assert got == [["matej haller", "haller"], ["matej haller"], ["matej haller", "haller"], []]


def test_rates(spark):
    df = spark.createDataFrame([(3, 4, 4, 0, 5, 1), (0, 0, 0, 0, 0, 0)], "correct int, scored int, visuals int, anchor_missing int, separation_pairs int, separation_failures int")
    got = [(r["accuracy"], r["separation_rate"], round(r["score"], 6)) for r in S.rates(df).collect()]
    assert got == [(0.75, 0.8, 0.774194), (0.0, 0.0, 0.0)]

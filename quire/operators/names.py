"""Lookups between digests, names and ground truth. DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collected(files: DataFrame, originals: DataFrame, order: str) -> DataFrame:
    """(order, name): files (order, digest) under their original's name (digest, name; the first by name), or their digest;
    names that clash are numbered _2, _3, ... by order."""
    first = originals.groupBy("digest").agg(F.min("name").alias("name"))
    j = files.join(first, "digest", "left").withColumn("name", F.coalesce("name", F.concat("digest", F.lit(".pdf"))))
    r = F.row_number().over(Window.partitionBy("name").orderBy(order))
    base, end = F.regexp_replace("name", "[.][^.]+$", ""), F.regexp_extract("name", "[.][^.]+$", 0)
    known = ~F.col("name").startswith(F.col("digest"))
    return j.withColumn("r", r).select(order, F.when((F.col("r") > 1) & known, F.concat(base, F.lit("_"), F.col("r").cast("string"), end)).otherwise(F.col("name")).alias("name"))


def lookup(names: DataFrame, wanted: str) -> DataFrame:
    """Rows of (digest, name) for a digest or a name: those that equal it, or if there are none, those that contain it."""
    exact = (F.col("digest") == wanted) | (F.col("name") == wanted)
    part = F.col("digest").contains(wanted) | F.col("name").contains(wanted)
    hits = names.where(part).withColumn("exact", exact)
    return hits.withColumn("any_exact", F.max("exact").over(Window.partitionBy(F.lit(1)))).where(F.col("exact") | ~F.col("any_exact")).drop("exact", "any_exact")


def with_truth(docs: DataFrame, truth: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(documents joined with their ground truth, documents that have none)."""
    return docs.join(truth, key), docs.join(truth.select(key).distinct(), key, "left_anti")

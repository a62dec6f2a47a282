"""Incremental re-aggregation of result files.

Runs write one JSON file per model and track into a folder. A file stream picks up what is new (a checkpoint remembers what
has been read, so a restarted run skips finished files) and regenerates the report of a track from all results so far.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "model string, track string, metric string, value double, at long"


def results(spark: SparkSession, path: str) -> DataFrame:
    """Stream of result rows; malformed lines are dropped."""
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path).where("model is not null and metric is not null")


def latest(rows: DataFrame, track: str) -> DataFrame:
    """(model, metric, value): of each model's metrics on a track the newest result."""
    mine = rows.where(F.col("track") == track)
    return mine.groupBy("model", "metric").agg(F.max_by("value", F.struct("at", "value")).alias("value"))


def keep_report(stream: DataFrame, track: str, checkpoint: str, publish: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Publish latest() of a track whenever results arrive. once: read what is there and stop."""
    table = latest(stream, track).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (table.trigger(availableNow=True) if once else table).start()


def open_articles(items: DataFrame) -> DataFrame:
    """Stream of (doc_id, page_no, pos, category, text) -> per document the items and headlines so far: an article stays open
    across pages that arrive one after another."""
    return items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("category") == "Headline").alias("n_articles"), F.max("page_no").alias("last_page"))

"""Shared plumbing of the training-data operators: tables, shared scratch folder, Arrow mapping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reach(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if REPO not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares in spark.checkpoint.dir.

    Where that is unset, a machine-local folder would lose rows on a cluster: only a session inside one process gets one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def written(df: DataFrame, into: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again. `into` gets the table's path."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    if into is not None:
        into.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more (all that was made of them has been written)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        at = jvm.org.apache.hadoop.fs.Path(paths.pop())
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within, the files of a query's shuffles go when it ends (all that follows reads written tables), not at some collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batch: pa.RecordBatch, chars: int = 1_500_000):
    """(rows, their texts) of a batch whose column 1 is text, a bounded amount of text at a time (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + chars, side="right")))
        part = batch.slice(at, stop - at)
        yield part, part.column(1).to_pylist()
        at = stop


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet (compared without case)."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name = "_" + name
    return name


#: Bits of the membership sketch below: 2^16 words of 64 bits, so its broadcast never exceeds 65,536 rows.
_SKETCH = 1 << 22


def split_by_ids(df: DataFrame, ids: DataFrame, id_col: str, into: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among `ids` (one column, id), rows whose id is not), without shuffling df.

    A one-hash Bloom filter of fixed size is built by a pre-aggregated bit_or and broadcast. Where `ids` is large the
    first part simply grows; its caller joins it with the ids themselves. `into` gets the path of the filter's table.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(_SKETCH))
    one = lambda c: F.expr("shiftleft(1L, cast(b % 64 as int))").alias(c)
    words = ids.select(bit(F.col("id")).alias("b")).select(F.shiftright("b", 6).alias("w"), one("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    words = written(words, into)
    b, w, m = (fresh_name(df, x) for x in ("b", "w", "m"))
    hashed = df.withColumn(b, bit(F.col(id_col)))
    filt = F.broadcast(words.select(F.col("w").alias(w), F.col("m").alias(m)))
    out = hashed.join(filt, F.shiftright(b, 6) == F.col(w), "left").withColumn(b, F.coalesce(F.getbit(F.col(m), (F.col(b) % 64).cast("int")) == 1, F.lit(False)))
    return out.where(F.col(b)).select(*df.columns), out.where(~F.col(b)).select(*df.columns)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """df without the rows whose id is among `ids` (one column, id); only rows that may be are shuffled."""
    maybe, no = split_by_ids(df, ids, id_col)
    return no.unionAll(maybe.join(ids.select(F.col("id").alias(id_col)).distinct().hint("shuffle_hash"), id_col, "left_anti").select(*df.columns))

"""Page layouts derived from the driver's tables: boxes, predicted boxes, words, conversation items, document lines."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reach(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files that one task gets where rows are dealt by a key.
DEALT = 4 << 20


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key into as many parts as its files need at DEALT bytes each, so that what a task sorts and holds stays
    the same however large the table is; windows, groups and joins by the key need no exchange after it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // DEALT), key)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, idx, label, x1, y1, x2, y2, score, k): up to 17 labelled boxes a page."""
    li = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    b = li.select(F.col("l_orderkey").alias("page_id"), F.row_number().over(w).alias("idx"), "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    x1, y1 = (F.col("l_partkey") % 700).cast("double"), ((F.col("l_suppkey") * 37 + F.col("idx") * 91) % 900).cast("double")
    names = ["Headline", "Paragraph", "Figure", "Caption", "Subhead", "Header"]
    label = F.element_at(F.array(*map(F.lit, names)), (F.col("idx") % 6 + 1).cast("int"))
    return b.select("page_id", "idx", label.alias("label"), x1.alias("x1"), y1.alias("y1"), (x1 + 40 + 4 * F.col("l_quantity")).alias("x2"), (y1 + 20 + F.col("l_partkey") % 90).alias("y2"), (F.col("l_discount") * 10).alias("score"), F.col("l_partkey").alias("k"))


BOXES = """
boxes AS (
  SELECT page_id, idx, ['Headline','Paragraph','Figure','Caption','Subhead','Header'][idx % 6 + 1] AS label, x1, y1, x1 + 40 + 4 * l_quantity AS x2, y1 + 20 + k % 90 AS y2, l_discount * 10 AS score, k
  FROM (SELECT *, CAST(l_partkey % 700 AS DOUBLE) AS x1, CAST((l_suppkey * 37 + idx * 91) % 900 AS DOUBLE) AS y1, l_partkey AS k
        FROM (SELECT *, l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS idx FROM lineitem)))"""


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes, shifted a little, with some missing."""
    s = (F.col("k") % 9 - 4).cast("double")
    b = boxes(spark, sf_dir).where((F.col("page_id") * 7 + F.col("idx")) % 11 != 0)
    return b.select("page_id", "idx", "label", *[(F.col(c) + s).alias(c) for c in ("x1", "y1", "x2", "y2")], "score", "k")


PREDICTED = """
pred AS (
  SELECT page_id, idx, label, x1 + (k % 9 - 4) AS x1, y1 + (k % 9 - 4) AS y1, x2 + (k % 9 - 4) AS x2, y2 + (k % 9 - 4) AS y2, score, k FROM boxes WHERE (page_id * 7 + idx) % 11 <> 0)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: (doc_id, pos, category, text); a user's turn is a headline."""
    c = table(spark, sf_dir, "conversations")
    category = F.when(F.col("role") == "user", "Headline").when(F.col("role") == "system", "Header").otherwise("Paragraph")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), category.alias("category"), "text")


ITEMS = """
items AS (SELECT conv_id AS doc_id, turn AS pos, CASE role WHEN 'user' THEN 'Headline' WHEN 'system' THEN 'Header' ELSE 'Paragraph' END AS category, text FROM conversations)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines: (doc_id, source, pos from 0, text)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


LINES = """
lines AS (SELECT doc_id, source, unnest(generate_series(0, len(ls) - 1)) AS pos, unnest(ls) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents))"""


def next_lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """lines with the next one of their document as `name`; the last line of a document has none and is left out."""
    d = dealt(table(spark, sf_dir, "documents"), "doc_id")
    t = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return t.withColumn(name, F.lead("text").over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col(name).isNotNull())


#: Categories that the blocks of a document run through.
CYCLE = ("Headline", "Kicker", "Paragraph", "Figure", "Caption", "Paragraph", "Subhead", "Quote", "Advertisement", "Footnote", "Section", "Question", "Dropcap", "Paragraph", "Abandon", "FigByline")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines as page blocks: (doc_id, page_no, pos, category, text, figure_id, x1, y1, x2, y2); six to a page. A caption
    belongs to the figure before it; one that opens a document, and every byline of a figure, to none."""
    at = ((F.col("pos") + F.col("doc_id")) % len(CYCLE)).cast("int")
    b = lines(spark, sf_dir).select("doc_id", (F.floor(F.col("pos") / 6) + 1).cast("int").alias("page_no"), "pos", F.element_at(F.array(*map(F.lit, CYCLE)), at + 1).alias("category"), "text")
    figure = F.when((F.col("category") == "Caption") & (F.col("pos") > 0), F.col("pos") - 1)
    y = (F.col("pos") % 6 * 150).cast("double")
    return b.select("*", figure.alias("figure_id"), F.lit(50.0).alias("x1"), y.alias("y1"), F.lit(950.0).alias("x2"), (y + 140).alias("y2"))


BLOCKS = f"""{LINES.strip()},
blocks AS (SELECT *, CASE WHEN category = 'Caption' AND pos > 0 THEN pos - 1 END AS figure_id, 50.0::DOUBLE AS x1, CAST(pos % 6 * 150 AS DOUBLE) AS y1, 950.0::DOUBLE AS x2, CAST(pos % 6 * 150 + 140 AS DOUBLE) AS y2
  FROM (SELECT doc_id, CAST(pos // 6 + 1 AS INTEGER) AS page_no, CAST(pos AS INTEGER) AS pos, list_extract({list(CYCLE)!r}, (pos + doc_id) % {len(CYCLE)} + 1) AS category, text FROM lines))"""

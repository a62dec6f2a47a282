"""Layout, document and prediction files: JSON, Markdown, folders. Readers return DataFrames; nothing is opened on the driver
but small configuration files."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X

#: Names of data sets and how their files are read: (spark, path, **options) -> DataFrame.
LOADERS: dict[str, Callable[..., DataFrame]] = {}
COCO = "images array<struct<id:long,file_name:string,width:double,height:double,page_type:string>>, categories array<struct<id:long,name:string>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,score:double,order_id:int,ignore:int>>"
BENCHMARK = "array<struct<layout_dets:array<struct<category_type:string,poly:array<double>,ignore:boolean,order:int,anno_id:long,text:string>>,page_info:struct<page_no:int,height:double,width:double,image_path:string>>>"

ANNOTATIONS = "array<struct<id:int,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,score:double,order_id:int>>"


def scratch(spark: SparkSession) -> str:
    """A fresh folder for files in between: below spark.checkpoint.dir, which the cluster shares; a temporary one only in a
    session inside one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quire-")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def loader(name: str):
    def add(f):
        LOADERS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Regions of a data set by its registered name."""
    if name not in LOADERS:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[name](spark, path, **options)


def coco_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, images, categories, annotations): one row per file."""
    raw = spark.read.schema(COCO).option("multiLine", True).json(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), "images", "categories", "annotations")


@loader("coco")
def coco_regions(spark: SparkSession, path: str, stem: str | None = None) -> DataFrame:
    """(path, image_id, stem, page, width, height, page_type, ann_id, label, x1, y1, x2, y2, score, order_id, ignore): the
    annotations of every image, also a row for images without any; score 1 where there is none; of one document only, if
    `stem` names it."""
    f = coco_files(spark, path)
    images = f.select("path", F.explode("images").alias("i")).select("path", F.col("i.id").alias("image_id"), X.page_of(F.col("i.file_name")).alias("p"), "i.width", "i.height", "i.page_type", "i.file_name")
    cats = f.select("path", F.explode("categories").alias("c")).select("path", F.col("c.id").alias("category_id"), F.col("c.name").alias("label"))
    anns = f.select("path", F.explode("annotations").alias("a")).select("path", F.col("a.id").alias("ann_id"), "a.image_id", "a.category_id", "a.bbox", "a.score", "a.order_id", "a.ignore")
    named = anns.join(cats, ["path", "category_id"], "left").drop("category_id")
    out = images.join(named, ["path", "image_id"], "left")
    out = out.where(F.col("p.stem") == stem) if stem else out
    box = G.from_xywh(*[F.get("bbox", k) for k in range(4)])
    return out.select("path", "image_id", "file_name", "p.stem", "p.page", "width", "height", "page_type", "ann_id", "label", *[v.alias(c) for v, c in zip(box, ("x1", "y1", "x2", "y2"), strict=True)], F.when(F.col("ann_id").isNotNull(), F.coalesce("score", F.lit(1.0))).alias("score"), "order_id", (F.coalesce("ignore", F.lit(0)) != 0).alias("ignore"))


@loader("benchmark")
def benchmark_regions(spark: SparkSession, path: str, drop_ignore: bool = False) -> DataFrame:
    """(image_id, stem, page_no, idx, label, x1, y1, x2, y2, order, ignore, text) of a benchmark's own JSON: an array of
    pages, of which image_id is the ordinal; idx is the ordinal on the page."""
    pages = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", BENCHMARK)).alias("image_id", "p"))
    dets = pages.select("image_id", X.stem_of(F.regexp_extract("p.page_info.image_path", "[^/]*$", 0)).alias("stem"), "p.page_info.page_no", F.posexplode_outer("p.layout_dets").alias("idx", "d"))
    dets = dets.where(~F.coalesce("d.ignore", F.lit(False))) if drop_ignore else dets
    box = G.from_polygon(F.col("d.poly"))
    return dets.select("image_id", "stem", "page_no", "idx", F.col("d.category_type").alias("label"), *[v.alias(c) for v, c in zip(box, ("x1", "y1", "x2", "y2"), strict=True)], F.col("d.order").alias("order"), F.col("d.ignore").alias("ignore"), F.col("d.text").alias("text"))


@loader("doclaynet")
@loader("publaynet")
def split_regions(spark: SparkSession, path: str, split: str = "val") -> DataFrame:
    """COCO regions of one split of a data set: <path>/<split>.json, or else the first JSON file by name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    wanted = f"{path.rstrip('/')}/{split}.json"
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(wanted)):
        names = sorted(str(s.getPath()) for s in fs.listStatus(folder) if str(s.getPath()).endswith(".json"))
        if not names:
            raise FileNotFoundError(f"no JSON file in {path}")
        wanted = names[0]
    return coco_regions(spark, wanted)


def coco_json(regions: DataFrame, by: str = "page_id", of: str | None = None) -> DataFrame:
    """(by, json): regions (by, image_id, file_name, width, height, idx, label, x1..y2, score, order_id) of each group as one
    COCO file; images and categories once, annotations by image and idx, with ids from 1. Unknown labels are not lost: the
    categories are those that occur, by name, in the group or, where `of` is given, in the set of files that this column names.
    A file is made and read as a whole by one task, so a large set is handed over in many files of so many images each."""
    sets = of or by
    n = regions.select(sets, "label").where("label is not null").distinct().groupBy(sets).agg(F.array_sort(F.collect_list("label")).alias("names"))
    keys = list(dict.fromkeys((by, sets)))
    images = regions.select(*keys, F.struct(F.col("image_id").alias("id"), "file_name", "width", "height").alias("i")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("i")).alias("images"))
    box = F.array(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    ann = F.struct("image_id", "idx", "label", box.alias("bbox"), G.area(G.box()).alias("area"), "score", F.coalesce("order_id", F.lit(-1)).alias("order_id"))
    anns = regions.where("label is not null").groupBy(by).agg(F.array_sort(F.collect_list(ann)).alias("a"))
    j = images.join(n, sets, "left").join(anns, by, "left")
    none = F.array().cast("array<string>")
    cats = F.transform(F.coalesce("names", none), lambda x, i: F.struct((i + 1).alias("id"), x.alias("name")))
    out = F.transform("a", lambda a, i: F.struct((i + 1).alias("id"), a["image_id"].alias("image_id"), F.array_position("names", a["label"]).alias("category_id"), a["bbox"].alias("bbox"), a["area"].alias("area"), a["score"].alias("score"), a["order_id"].alias("order_id")))
    empty = F.from_json(F.lit("[]"), ANNOTATIONS)
    return j.select(by, F.to_json(F.struct("images", cats.alias("categories"), F.coalesce(out.cast(ANNOTATIONS), empty).alias("annotations"))).alias("json"))


def joined_coco(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All files (path, images, categories, annotations) as one: images with new ids from 1 (each file_name once, files by
    path, in natural order of names inside a file), annotations with ids from 1, the categories of the first file."""
    img = files.select("path", F.explode("images").alias("i")).select("path", F.col("i.id").alias("old"), F.col("i.file_name").alias("file_name"), F.col("i.width").alias("width"), F.col("i.height").alias("height"))
    img = img.withColumn("key", X.natural_key(F.col("file_name")))
    first = img.groupBy("file_name").agg(F.min(F.struct("path", "key", "old", "width", "height")).alias("m"))
    images = numbered(first.select("file_name", "m.path", "m.key", "m.width", "m.height"), ["path", "key", "file_name"], "id", 1)
    to = img.join(images.select("file_name", F.col("id").alias("new")), "file_name").select("path", "old", "new")
    ann = files.select("path", F.posexplode("annotations").alias("at", "a")).select("path", "at", F.col("a.image_id").alias("old"), F.col("a.category_id").alias("category_id"), F.col("a.bbox").alias("bbox"))
    ann = numbered(ann.join(to, ["path", "old"]).withColumnRenamed("new", "image_id"), ["path", "at"], "id", 1)
    low = files.agg(F.min("path").alias("path"))
    cats = files.join(F.broadcast(low), "path").select(F.explode("categories").alias("c")).select("c.id", "c.name")
    return images.select("id", "file_name", "width", "height"), ann.select("id", "image_id", "category_id", "bbox"), cats


def numbered(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """rows with consecutive numbers in the order of a key that is unique, without drawing all rows into one task: they are
    sorted into ranges, counted per range and numbered from the ranges' offsets (a row per range)."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    ranged = ranged.persist()  # one pass over the rows serves both uses
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offset, at = {}, 0
    for part in sorted(counts):
        offset[part], at = at, at + counts[part]
    shift = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv]) if offset else F.create_map(F.lit(0), F.lit(0))
    inside = F.col("__row") - F.shiftleft(F.col("__part").cast("long"), 33)
    return ranged.withColumn(name, inside + F.element_at(shift, F.col("__part")) + start).drop("__part", "__row")


# --- parsed documents and predictions
def parsed_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents parsed before (*_doc.json below path), each stem once: the first by path; hidden folders are skipped."""
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_doc.json").json(path)
    raw = raw.withColumn("path", F.col("_metadata.file_path")).where(~F.col("path").rlike("/[.][^/]*/"))
    stem = F.regexp_extract("path", "([^/]*)_doc[.]json$", 1)
    return raw.withColumn("stem", stem).withColumn("r", F.row_number().over(Window.partitionBy("stem").orderBy("path"))).where("r = 1").drop("r")


def prediction_layout(paths: list[str]) -> str:
    """How predictions lie, told from the paths of their files, relative to the input: odb-json, flat or paddlex."""
    if len(paths) == 1 and paths[0].lower().endswith(".json"):
        return "odb-json"
    marks = [p for p in paths if p.lower().endswith((".md", ".mmd"))]
    if any("/" not in p for p in marks):
        return "flat"
    if any(p.count("/") == 1 for p in marks):
        return "paddlex"
    raise ValueError("no known layout of predictions: expected one JSON file, Markdown files or folders of them")


def odb_markdown(values: DataFrame) -> DataFrame:
    """(stem, markdown) of prediction JSON (value): a map from image names to blocks, whose contents are joined."""
    m = values.select(F.explode(F.from_json("value", "map<string,array<struct<content:string>>>")).alias("name", "blocks"))
    return m.select(X.stem_of(F.col("name")).alias("stem"), X.blocks_markdown(F.col("blocks.content")).alias("markdown"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, name, markdown) of all .md and .mmd files below a path."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(at, "([^/]*)/[^/]*$", 1).alias("folder"), F.regexp_extract(at, "[^/]*$", 0).alias("name"), F.col("value").alias("markdown")).where(F.lower("name").rlike("[.]mm?d$"))


def folder_markdown(files: DataFrame) -> DataFrame:
    """(stem, markdown): of each folder the file of its name, else its only .md, else its only .mmd; others are skipped."""
    f = files.select("folder", "name", "markdown", F.lower("name").endswith(".md").alias("md"), (X.stem_of(F.col("name")) == F.col("folder")).alias("own"))
    p = Window.partitionBy("folder")
    f = f.withColumns({"n_md": F.count_if("md").over(p), "n_mmd": F.count_if(~F.col("md")).over(p), "n_own": F.count_if("own").over(p)})
    pick = F.when(F.col("n_own") > 0, F.col("own")).when(F.col("n_md") > 0, F.col("md") & (F.col("n_md") == 1)).otherwise(F.col("n_mmd") == 1)
    chosen = f.where(pick).withColumn("r", F.row_number().over(p.orderBy(F.desc("md"), "name"))).where("r = 1")
    return chosen.select(F.col("folder").alias("stem"), "markdown")


def split_markdown(docs: DataFrame, marker: str) -> DataFrame:
    """(stem, markdown): a document's pages <stem>_<i>, split at a marker; empty pages stay, newlines around them go."""
    if not marker:
        raise ValueError("the marker must not be empty")
    parts = docs.select("stem", F.posexplode(F.split("markdown", "\\Q" + marker + "\\E", -1)).alias("i", "t"))
    return parts.select(F.concat("stem", F.lit("_"), F.col("i").cast("string")).alias("stem"), F.regexp_replace("t", "^\n+|\n+$", "").alias("markdown"))


def config(path: str | None) -> dict | None:
    """A small JSON file of settings on the driver; None for none."""
    if path is None:
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def first_existing(stem: str, roots: list[str], suffix: str = ".pdf") -> str | None:
    """The first of the candidate folders that holds <stem><suffix>, as a path; None if none does."""
    return next((p for r in roots if os.path.exists(p := os.path.join(r, stem + suffix))), None)


def write_outputs(table: DataFrame, path: str, name: str, column: str) -> None:
    """One file per row of (name, column) as text below path, partitioned by the name: what a document has to say."""
    table.select(F.col(name).alias("name"), F.col(column).alias("value")).write.partitionBy("name").mode("overwrite").text(path)

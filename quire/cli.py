"""Command line over the library: parse, evaluate, tools."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from .operators import assembly, evaluation, layout, xycut
from .sources import files

ORDERS = {"top-bottom": layout.reading_order, "left-right": layout.left_right_order, "xy-cut": xycut.xy_cut_order}


def _regions(spark: SparkSession, a: argparse.Namespace):
    r = files.load(spark, a.dataset, a.input).where("label is not null")
    return r.withColumn("page_id", F.col("image_id")).withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("ann_id")).cast("int"))


def parse(spark: SparkSession, a: argparse.Namespace) -> None:
    """Regions of COCO files in reading order, as Markdown per page."""
    r = _regions(spark, a)
    order = ORDERS[a.order](r).select("page_id", "idx", "rank")
    items = r.join(order, ["page_id", "idx"]).select("page_id", F.col("rank").alias("pos"), F.col("label").alias("category"), F.col("label").alias("text"), F.lit(None).cast("int").alias("figure_id"))
    files.write_outputs(assembly.markdown(items, ("page_id",)), a.output, "page_id", "markdown")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Average precision of predictions against ground truth, a mean per metric on standard output."""
    gold, pred = _regions(spark, a), _regions(spark, argparse.Namespace(dataset=a.dataset, input=a.predictions))
    s = evaluation.average_precision(pred, gold).agg(*[F.avg(c).alias(c) for c in ("map", "map_50", "map_75")]).first()
    print(json.dumps(s.asDict()))


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    """Annotations per category with their share."""
    from .operators.scores import category_counts

    category_counts(_regions(spark, a), "label").orderBy(F.desc("n")).show(1000, truncate=False)


def join(spark: SparkSession, a: argparse.Namespace) -> None:
    """COCO files as one: images, annotations and categories as JSON lines."""
    for name, table in zip(("images", "annotations", "categories"), files.joined_coco(files.coco_files(spark, a.input)), strict=True):
        table.write.mode("overwrite").json(f"{a.output}/{name}")


TOOLS = {"count": count, "join": join}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="command", required=True)
    for name, f in (("parse", parse), ("evaluate", evaluate), *TOOLS.items()):
        s = sub.add_parser(name, help=f.__doc__)
        s.add_argument("input")
        s.add_argument("--dataset", default="coco", choices=sorted(files.LOADERS))
        s.set_defaults(run=f)
        if name in ("parse", "join"):
            s.add_argument("--output", required=True)
        if name == "parse":
            s.add_argument("--order", default="xy-cut", choices=sorted(ORDERS))
        if name == "evaluate":
            s.add_argument("--predictions", required=True)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName("quire").getOrCreate(), a)


if __name__ == "__main__":
    main()

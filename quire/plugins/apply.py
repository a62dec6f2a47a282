"""Backends over DataFrames: Arrow batches in, Arrow batches out, one instance per worker and backend."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import per_group
from . import make

_made: dict[tuple, Any] = {}


def _backend(kind: str, name: str, options: dict) -> Any:
    key = (kind, name, tuple(sorted(options.items())))
    if key not in _made:
        _made[key] = make(kind, name, **options)
    return _made[key]


def orders(boxes: DataFrame, name: str, page: str = "page_id", **options) -> DataFrame:
    """(page, idx, rank from 0) of boxes (page, idx, label, x1..y2): a page at a time."""
    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        at = _backend("order", name, options).order(np.stack([g[c] for c in ("x1", "y1", "x2", "y2")], axis=1).astype(np.float64), g["label"].tolist())
        return {"idx": g["idx"][at], "rank": np.arange(len(at))}

    return per_group(boxes, page, ["idx", "label", "x1", "y1", "x2", "y2"], run, "idx int, rank int")


def entities(items: DataFrame, name: str, batch: int = 16, **options) -> DataFrame:
    """items with `entities` array<struct<text, label, score>>, asked for in batches; blank texts are not asked for."""

    @F.pandas_udf("array<struct<text:string,label:string,score:double>>")
    def found(texts: pd.Series) -> pd.Series:
        out: list[list] = [[] for _ in texts]
        ask = [i for i, t in enumerate(texts) if t and t.strip()]
        backend = _backend("entities", name, options)
        for k in range(0, len(ask), batch):
            part = ask[k : k + batch]
            for i, got in zip(part, backend.entities([texts.iloc[j] for j in part]), strict=True):
                out[i] = [{"text": t, "label": x, "score": float(s)} for t, x, s in got]
        return pd.Series(out)

    return items.withColumn("entities", found(F.coalesce("text", F.lit(""))))


def classes(texts: DataFrame, name: str, **options) -> DataFrame:
    """texts with `reply`; a text that a backend fails on gets no reply, and the others go on."""

    @F.pandas_udf("string")
    def asked(series: pd.Series) -> pd.Series:
        backend, out = _backend("classifier", name, options), []
        for t in series:
            try:
                out.append(backend.classify(t or ""))
            except Exception:  # noqa: BLE001 - one reply that fails must not stop a document
                out.append(None)
        return pd.Series(out)

    return texts.withColumn("reply", asked(F.col("text")))


def recognised(regions: DataFrame, name: str, **options) -> DataFrame:
    """regions (image binary) with new_text and confidence. Crops twice as high as wide are also tried turned, by backends
    that offer turned(image, degrees); the first of the best confidences wins."""

    @F.pandas_udf("struct<new_text:string,confidence:double>")
    def read(images: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.DataFrame:
        backend, rows = _backend("text", name, options), []
        for image, w, h in zip(images, widths, heights, strict=True):
            tries = [backend.read(image)]
            if h >= 2 * w and hasattr(backend, "turned"):
                tries += [backend.read(backend.turned(image, d)) for d in (90, 270)]
            rows.append(max(tries, key=lambda x: x[1]))
        return pd.DataFrame(rows, columns=["new_text", "confidence"])

    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return regions.withColumn("r", read(F.col("image"), w, h)).select("*", "r.*").drop("r")

"""Backends that need nothing but numpy: geometric orders, a gazetteer of capitalised runs, a keyword classifier."""

from __future__ import annotations

import re

import numpy as np

from ..functions.text import GENRES
from ..operators import xycut
from . import register


@register("order", "top-bottom")
class TopBottom:
    def order(self, boxes: np.ndarray, labels: list[str]) -> list[int]:
        cy, cx = (boxes[:, 1] + boxes[:, 3]) / 2, (boxes[:, 0] + boxes[:, 2]) / 2
        return [int(i) for i in np.lexsort((np.arange(len(boxes)), cx, cy))]


@register("order", "left-right")
class LeftRight:
    """Vertical bands of anchored left edges, each read top-down."""

    def __init__(self, tolerance: float = 10.0) -> None:
        self.tolerance = tolerance

    def order(self, boxes: np.ndarray, labels: list[str]) -> list[int]:
        band, anchor, at = np.zeros(len(boxes), dtype=int), None, -1
        for i in np.lexsort((np.arange(len(boxes)), boxes[:, 0])):
            if anchor is None or boxes[i, 0] - anchor > self.tolerance:
                anchor, at = boxes[i, 0], at + 1
            band[i] = at
        return [int(i) for i in np.lexsort((np.arange(len(boxes)), boxes[:, 1], band))]


@register("order", "xy-cut")
class XYCut:
    def order(self, boxes: np.ndarray, labels: list[str]) -> list[int]:
        return xycut.order_of(boxes)


@register("entities", "capitalised")
class CapitalisedRuns:
    """Runs of capitalised words; scores grow with their number."""

    def __init__(self, least: float = 0.5, most_chars: int = 4000) -> None:
        self.least, self.most_chars = least, most_chars

    def entities(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        out = []
        for t in texts:
            runs = re.findall(r"\b[^\W\d_a-zà-ž][a-zà-ž]+(?: [^\W\d_a-zà-ž][a-zà-ž]+)*", (t or "")[: self.most_chars])
            out.append([(r, "PER" if " " in r else "MISC", min(1.0, 0.5 + 0.2 * r.count(" "))) for r in runs])
        return out


@register("classifier", "keywords")
class Keywords:
    """The genre whose section words occur first; no reply without any."""

    classes = tuple(sorted(set(GENRES.values())))

    def classify(self, text: str) -> str:
        low = (text or "").lower()
        found = min(((low.find(k), g) for k, g in GENRES.items() if k in low), default=None)
        return found[1] if found else ""

"""Reading order by recursive cuts of the page along white space (Nagy and Seth's XY-cut), one page a task.

A page holds some ten to some hundred boxes and its cuts are sequential, so a page is the unit of work and the order of a
page is a function of its boxes alone (``order_of``), applied per page. Around the plain cut stand the steps that real pages
need: boxes that run across several columns are set aside before the cut and put back by distance, slivers and what fell
out are appended, and overlaps of a few pixels are shrunk first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from .groups import per_group

#: Overlap (share, pixels) that is shrunk, and free line heights at which a page is cut beforehand.
SHRINK, TOUCH, PRE_CUT = 0.1, 3, 3


def intervals(low: np.ndarray, high: np.ndarray, gap: float = 1.0) -> np.ndarray:
    """Number of the merged interval that each of the given ones belongs to, ascending; a gap wider than `gap` parts them."""
    order = np.lexsort((high, low))
    far = np.maximum.accumulate(high[order])
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = low[order][1:] - far[:-1] >= gap
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def _parted(at: list[int], low: Sequence[float], high: Sequence[float], gap: float) -> list[list[int]]:
    """Members of each merged interval of `at`, as intervals() has them; without numpy, which is slow on a page's few boxes."""
    if len(at) == 1:
        return [at]
    if any(low[i] != low[i] or high[i] != high[i] for i in at):  # not a number: as numpy sorts it
        k = intervals(np.array([low[i] for i in at]), np.array([high[i] for i in at]), gap).tolist()
    else:
        order = sorted(range(len(at)), key=lambda i: (low[at[i]], high[at[i]]))
        k, n, far = [0] * len(at), 0, high[at[order[0]]]
        for i in order:
            n += low[at[i]] - far >= gap and i != order[0]
            k[i], far = n, max(far, high[at[i]])
    out: list[list[int]] = [[] for _ in range(max(k) + 1)]
    for i, n in zip(at, k, strict=True):
        out[n].append(i)
    return out


def cut(boxes: np.ndarray | Sequence[Sequence[float]], axis: int = 1, gap: float = 1.0) -> list[int]:
    """Order of boxes (rows x1, y1, x2, y2): split along `axis` (1: y first), each part along the other, and so on, until a
    part has no white space on either axis; such a part is read by its start on the second axis."""
    out: list[int] = []
    side = _sides(boxes)
    other = 1 - axis

    def go(at: list[int]) -> None:
        for part in _parted(at, side[axis], side[axis + 2], 1.0):
            second = _parted(part, side[other], side[other + 2], gap)
            if len(second) == 1:
                out.extend(sorted(part, key=lambda i: (side[other][i], side[axis][i], i)) if len(part) > 1 else part)
            else:
                for p in second:
                    go(p)

    if len(boxes):
        go(list(range(len(boxes))))
    return out


def _sides(boxes: np.ndarray | Sequence[Sequence[float]]) -> list[Sequence[float]]:
    return np.asarray(boxes, dtype=np.float64).T.tolist() if isinstance(boxes, np.ndarray) else list(zip(*boxes, strict=True))


def shrunk(boxes: np.ndarray, axis: int = 1) -> np.ndarray:
    """Boxes in order whose neighbours overlap or touch by a little (a tenth of their span, or 3 pixels) on an axis, each
    drawn back to a pixel before the middle of the overlap."""
    return np.array(_shrunk(boxes.astype(np.float64).tolist(), axis)).reshape(-1, 4)


def _shrunk(b: list[list[float]], axis: int = 1) -> list[list[float]]:
    for p, q in zip(b, b[1:]):  # noqa: B905 - neighbours
        low, high = max(p[axis], q[axis]), min(p[axis + 2], q[axis + 2])
        span = max(p[axis + 2], q[axis + 2]) - min(p[axis], q[axis])
        other = 1 - axis
        beside = min(p[other + 2], q[other + 2]) - max(p[other], q[other]) > 0
        share = (high - low) / span if span > 0 else 0.0
        if (beside and 0 < share < SHRINK) or abs(p[axis + 2] - q[axis]) <= TOUCH:
            mid = float(int((low + high) / 2))
            if p[axis] < q[axis]:
                p[axis + 2], q[axis] = mid - 1, mid + 1
            else:
                p[axis], q[axis + 2] = mid - 1, mid + 1
    return b


def spanning(boxes: Sequence[Sequence[float]]) -> list[bool]:
    """Which boxes run across columns: they overlap, on the x axis, two boxes that do not overlap each other and stand in
    columns of at least two boxes."""
    n = len(boxes)
    out = [False] * n
    if n < 4:
        return out
    wide = [b[2] - b[0] for b in boxes]
    s = sorted(wide)
    most = (s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2) * 1.3
    narrow = [i for i in range(n) if wide[i] <= most]
    if len(narrow) == n:
        return out
    left, _, right, _ = _sides(boxes)
    columns = [c for c in _parted(narrow, left, right, 1.0) if len(c) >= 2]
    for i in range(n):
        if wide[i] > most:
            out[i] = sum(any(min(right[j], right[i]) > max(left[j], left[i]) for j in c) for c in columns) >= 2
    return out


def inserted(order: list[int], more: Sequence[int], boxes: Sequence[Sequence[float]], distance: str = "euclidean") -> list[int]:
    """`order` with `more` put in, from the top down, before or behind the box that is nearest by the distance: behind, if
    their start is below its own."""
    def far(a: Sequence[float], b: Sequence[float]) -> float:
        if distance == "manhattan":
            return float(abs(a[0] - b[0]) + abs(a[1] - b[1]))
        if distance == "euclidean":
            return float(np.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2))
        return float(abs(a[1] - b[1]) * 1e4 + abs(a[0] - b[0]))

    out = list(order)
    for i in sorted(more, key=lambda i: (boxes[i][1], boxes[i][0], i)):
        if not out:
            out = [i]
            continue
        near = min(range(len(out)), key=lambda k: (far(boxes[i], boxes[out[k]]), k))
        out.insert(near + (boxes[i][1] >= boxes[out[near]][1]), i)
    return out


def order_of(boxes: np.ndarray, line_height: float | None = None, first: str = "yx") -> list[int]:
    """Reading order of a page's boxes: bands parted by PRE_CUT free line heights come first; within a band, boxes across
    columns are set aside, the rest is shrunk and cut, and they are put back where the bands of columns change."""
    rows = boxes.astype(np.float64).tolist()
    n = len(rows)
    keep = [i for i, b in enumerate(rows) if b[2] - b[0] >= 2 and b[3] - b[1] >= 2]
    out: list[int] = []
    if keep:
        y1, y2 = [b[1] for b in rows], [b[3] for b in rows]
        height = line_height or max(8.0, (max(y2[i] for i in keep) - min(y1[i] for i in keep)) // 75)
        for at in _parted(keep, y1, y2, PRE_CUT * height):
            across = spanning([rows[i] for i in at])
            tops = [y1[i] for i, a in zip(at, across, strict=True) if a]
            levels: dict[int, list[tuple[int, bool]]] = {}
            for i, a in zip(at, across, strict=True):  # what stands below a box across columns is read after it
                levels.setdefault(sum(y1[i] >= y for y in tops), []).append((i, a))
            for lv in sorted(levels):
                top = sorted((i for i, a in levels[lv] if not a), key=lambda i: (y1[i], rows[i][0], i))
                small = _shrunk([list(rows[i]) for i in top])
                done = [top[i] for i in cut(small, 1 if first == "yx" else 0)]
                wide = [i for i, a in levels[lv] if a]
                out += inserted(done, wide, rows, "weighted") if wide else done
    seen = set(out)
    return out + [i for i in range(n) if i not in seen]


def xy_cut_order(boxes: DataFrame, method: str = "enhanced", page: str = "page_id") -> DataFrame:
    """(page, idx, rank from 0). method: "yx" or "xy" for the plain cuts, "enhanced" for order_of."""
    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        b = np.stack([g[c] for c in ("x1", "y1", "x2", "y2")], axis=1).astype(np.float64)
        order = order_of(b) if method == "enhanced" else cut(b, 1 if method == "yx" else 0) if len(b) > 1 else [0]
        return {"idx": g["idx"][order], "rank": np.arange(len(order))}

    return per_group(boxes, page, ["idx", "x1", "y1", "x2", "y2"], run, "idx int, rank int")


def resolved_logits(logits: np.ndarray) -> list[int]:
    """Order of n boxes from an n x n matrix of scores (box, place): every box takes its best place; where two want one, the
    higher score keeps it and the other goes on to its next best free one. Boxes are returned by place."""
    n = len(logits)
    place, owner = np.full(n, -1), {}
    prefer = np.argsort(-logits, axis=1, kind="stable")
    at, todo = np.zeros(n, dtype=int), list(range(n - 1, -1, -1))
    while todo:
        b = todo.pop()
        while True:
            p = int(prefer[b, at[b]])
            other = owner.get(p)
            if other is None or logits[b, p] > logits[other, p]:
                owner[p], place[b] = b, p
                if other is not None:
                    at[other] += 1
                    todo.append(other)
                break
            at[b] += 1
    return [int(i) for i in np.argsort(place, kind="stable")]

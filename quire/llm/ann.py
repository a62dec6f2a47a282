"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are grouped around centroids (fitted on a bounded sample). A vector's residual is rotated at random and reduced to
the signs of its components, packed into bits, with two correction scalars: its length, and the cosine between residual
and code. A query's rotated residual is quantised to a few bits per component, so that inner products with all codes of a
block are popcounts over bit planes; the scalars turn them into unbiased estimates of the distance with an error bound.
Only vectors whose lower bound does not exceed the k-th best upper bound are compared exactly, in double precision.

Equal vectors are collapsed to one with its k+1 smallest ids first (more cannot be among anyone's k nearest). Clusters
and the queries that probe them are dealt into blocks of bounded size, so a hot cluster spreads over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of one block, and queries that meet it at once.
BLOCK, QUERIES = 4096, 512
#: Query bits per component, and standard errors by which bounds are widened.
PLANES, WIDTH = 6, 3.0
#: Vectors that centroids are fitted on (those of least hash), at most, and of these the queries that tell how many clusters
#: a query must probe.
SAMPLE, TRIALS = 16384, 256


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's k-means on a sample; empty clusters keep their centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def probes_for(x: np.ndarray, cents: np.ndarray, k: int, target: float) -> int:
    """Clusters to probe so that the share `target` of the k nearest is met, measured on the sample: TRIALS of its vectors
    against all of it. Neighbours in a sample lie further off than among all vectors, so the measure errs on the safe side."""
    if len(x) <= 1:
        return len(cents)
    q = x[:: max(1, len(x) // TRIALS)][:TRIALS]
    home, half, own = nearest(x, cents), (x * x).sum(1), (cents * cents).sum(1)
    ranks = []
    for at in range(0, len(q), 64):
        part = q[at : at + 64]
        d = half[None, :] - 2 * part @ x.T
        near = np.argsort(d, axis=1, kind="stable")[:, 1 : k + 1]  # the first is the query itself
        order = np.argsort(own[None, :] - 2 * part @ cents.T, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(len(cents)), order.shape), 1)
        ranks.append(np.take_along_axis(place, home[near], 1).reshape(-1))
    r = np.sort(np.concatenate(ranks))
    return int(r[min(len(r) - 1, math.ceil(target * len(r)))]) + 1


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)


def encode(x: np.ndarray, centre: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign codes (rows of 64-bit words), residual lengths, and cosines between residual and code."""
    r = (x - centre) @ rot.T
    dim = r.shape[1]
    length = np.sqrt((r * r).sum(1))
    cos = np.divide(np.abs(r).sum(1), length * math.sqrt(dim), out=np.ones(len(r)), where=length > 0)
    bits = np.zeros((len(r), -(-dim // 64) * 64), dtype=np.uint8)
    bits[:, :dim] = r > 0
    return np.packbits(bits, axis=1).view(np.uint64), length, cos


def bounds(codes, length, cos, q, centre, rot) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (with high probability) of squared distances of queries q to coded vectors of one cluster."""
    r = (q - centre) @ rot.T
    nq, dim = r.shape
    qlen = np.sqrt((r * r).sum(1))
    low = r.min(1, keepdims=True)
    step = np.maximum((r.max(1, keepdims=True) - low) / ((1 << PLANES) - 1), 1e-30)
    level = np.rint((r - low) / step).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    acc = np.zeros((nq, len(codes)), dtype=np.int64)
    for p in range(PLANES):
        bits = np.zeros((nq, codes.shape[1] * 64), dtype=np.uint8)
        bits[:, :dim] = level >> p & 1
        plane = np.packbits(bits, axis=1).view(np.uint64)
        for w in range(codes.shape[1]):
            acc += np.bitwise_count(plane[:, w][:, None] & codes[:, w][None, :]).astype(np.int64) << p
    # sum over set bits of r, from the levels; a code component is +-1/sqrt(dim)
    on = acc * step + ones[None, :] * low
    product = (2 * on - (level.sum(1, dtype=np.int64)[:, None] * step + dim * low)) / math.sqrt(dim)
    # product estimates <code, r>; divided by the cosine it estimates <residual direction, r>
    est = product / cos[None, :]
    noise = np.sqrt(np.maximum(1 - cos * cos, 0)) / cos / math.sqrt(max(dim - 1, 1))
    err = WIDTH * (qlen[:, None] * noise[None, :] + step / math.sqrt(12) / cos[None, :])
    base = length[None, :] ** 2 + qlen[:, None] ** 2
    half = 2 * length[None, :] * err + 1e-9 * base
    mid = base - 2 * length[None, :] * est
    return mid - half, mid + half


def _valid(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))


def _assign(cents: np.ndarray, probes: int):
    def run(batches):
        half = (cents * cents).sum(1)
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
            d = half[None, :] - 2 * x @ cents.T
            pdf["cluster"] = list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)) if len(pdf) else []
            yield pdf

    return run


def _place(cents: np.ndarray, rot: np.ndarray):
    """Vectors -> the index: cluster, packed code and the two correction scalars, made once."""

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1)
            home = nearest(x, cents) if len(x) else np.zeros(0, dtype=int)
            codes, length, cos = encode(x, cents[home], rot) if len(x) else (np.zeros((0, 1), dtype=np.uint64), np.zeros(0), np.zeros(0))
            pdf["cluster"], pdf["code"], pdf["length"], pdf["cos"] = home.astype(np.int32), [c.tobytes() for c in codes], length, cos
            yield pdf

    return run


def _search(cents: np.ndarray, rot: np.ndarray, k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"qid": [], "id": [], "score": []}).astype({"qid": "int64", "id": "int64", "score": "float64"})
        centre = cents[int(rows["cluster"].iloc[0])]
        x = np.array(rows["v"].tolist(), dtype=np.float64)
        codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint64).reshape(len(rows), -1)
        length, cos = rows["length"].to_numpy(), rows["cos"].to_numpy()
        ids = rows["ids"].tolist()
        n_ids = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        out = []
        qs, qids = np.array(queries["v"].tolist(), dtype=np.float64), queries["qid"].to_numpy()
        for at in range(0, len(qs), 64):
            q = qs[at : at + 64]
            low, high = bounds(codes, length, cos, q, centre, rot)
            kth = np.partition(high, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
            for i in range(len(q)):
                pick = np.flatnonzero(low[i] <= kth[i])
                d = np.sqrt(((x[pick] - q[i]) ** 2).sum(1))
                who = np.array([j for p in pick for j in ids[p]], dtype=np.int64)
                dist = np.repeat(d, n_ids[pick])
                best = np.lexsort((who, dist))[:k]
                out.append((np.full(len(best), qids[at + i]), who[best], dist[best]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"qid": a, "id": b, "score": c})

    return run


def search(vectors: DataFrame, is_query, k: int = 10, clusters: int | None = None, recall: float = 0.97, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest found of every query row among all other rows: (query_id, rank from 1, vec_id, score), nearest first.

    is_query: condition on the column `id`. score: Euclidean distance of the original vectors in double precision, ties
    to the smaller id. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those
    whose length differs from the most frequent one. A query probes the clusters whose centroids are
    nearest, as many as the sample says are needed for the share `recall` of its neighbours (1.0: all, then only the bounds'
    own chance of error is left); vectors without clusters of their own, as in high dimensions, need about half of them.
    Fewer candidates than k give fewer rows.
    """
    spark = vectors.sparkSession
    rows = _valid(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = sizes[0]["dim"]
    rows = rows.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    distinct = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("vid"), "v", "ids"))
    n = distinct.count()
    sample = np.array([r["v"] for r in distinct.select("v", F.xxhash64("vid").alias("h")).orderBy("h").limit(SAMPLE).collect()], dtype=np.float64)
    cents = centroids(sample, clusters or max(1, min(SAMPLE // 4, round(math.sqrt(n)))), seed)
    probes = len(cents) if recall >= 1 else probes_for(sample, cents, k, recall)
    rot = rotation(dim, seed)

    placed = written(distinct.mapInPandas(_place(cents, rot), "vid long, v array<double>, ids array<long>, cluster int, code binary, length double, cos double"))
    asked = written(rows.where(is_query).select("id", "v"))
    queries = asked.groupBy("v").agg(F.min("id").alias("qid")).select("qid", "v")
    probed = written(queries.mapInPandas(_assign(cents, probes), "qid long, v array<double>, cluster array<int>").select("qid", "v", F.explode("cluster").alias("cluster")))
    # Both tables have a row per cluster, of which there are SAMPLE / 4 at most.
    parts = placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).join(probed.groupBy(F.col("cluster").alias("c2")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qparts")), F.col("cluster") == F.col("c2")).select("cluster", "parts", "qparts")
    parts = F.broadcast(written(parts))
    left = probed.join(parts, "cluster").withColumn("qpart", F.pmod(F.xxhash64("qid"), F.col("qparts")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cluster", "part", "qpart", "qid", "v")
    right = placed.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")).withColumn("qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1))).select("cluster", "part", "qpart", "v", "ids", "code", "length", "cos")
    key = ["cluster", "part", "qpart"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(cents, rot, k + 1), "qid long, id long, score double")
    wq = Window.partitionBy("qid").orderBy("score", "id")
    best = found.withColumn("r", F.row_number().over(wq)).where(F.col("r") <= k + 1)
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near"))
    who = asked.join(queries.select("qid", F.col("v").alias("v2")), F.col("v") == F.col("v2")).select(F.col("id").alias("query_id"), "qid")
    near = who.join(lists, "qid").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return near.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))

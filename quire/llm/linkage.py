"""Complete linking of items that share a blocking key, without ever emitting all pairs of a group.

A similarity join needs, for every pair of items that share a key, the answer "do they link?" only as far as it changes
the connected components. ``resolve`` gets that in three steps:

1. Items say how many of their keys they can do without (``spare``): of two items that agree on s+1 keys, the rarest of
   these is among both's keys even if each leaves out its s most frequent ones, frequency being the one order (size of the
   group, then key). So each item leaves them out: hot keys, which would grow with the square of the table, fall out, and
   pairs that agree on s keys only never meet, without the loss of a link.
2. Within each key every item meets the group's hub, its member with the most company over all its keys (the original of a
   group of near copies rather than one copy among many). Pairs are made distinct, pruned on sizes and sketches, verified;
   components of the links are contracted (``components``).
3. In keys of more than two members that still lie in different components, every pair across components is compared on
   short sketches, in blocks of bounded size, and the survivors are verified.

No pair of items that share a key and link is lost; large groups of copies cost one verification per member. Tables in
between are deleted once nothing reads them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

Verify = Callable[[DataFrame], DataFrame]
Prune = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Rows of one side of a block of step 3.
BLOCK = 1024


def components(links: DataFrame, into: list[str]) -> DataFrame:
    """links (a long, b long) -> (id, component): component is the smallest id that links reach; ids without links are absent.

    Each round every vertex joins its neighbour of least priority and the graph is contracted, so the number of rounds is
    logarithmic; the first round's priority is the id (stars fall together at once), later ones are salted hashes, which
    also shorten long chains. The result is a written table, whose path `into` gets.
    """
    tables: list[str] = []
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tables)
    assign, salt = None, 0
    while not edges.isEmpty():
        prio = (lambda c: c) if salt == 0 else (lambda c, s=salt: F.xxhash64(F.lit(s), c))
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(F.struct(prio(F.col("b")).alias("p"), F.col("b").alias("v"))).alias("m"))
        step = near.select(F.col("a").alias("v"), F.least("m", F.struct(prio(F.col("a")).alias("p"), F.col("a").alias("v")))["v"].alias("r"))
        step = written(step, tables)
        if assign is None:
            assign = step.select(F.col("v").alias("id"), F.col("r").alias("root"))
        else:
            assign = written(assign.join(step, assign["root"] == step["v"], "left").select("id", F.coalesce("r", "root").alias("root")), tables)
        left, right = step.select(F.col("v").alias("a"), F.col("r").alias("ra")), step.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = written(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), tables)
        salt += 1
    if assign is None:
        out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    else:
        low = assign.groupBy("root").agg(F.min("id").alias("component"))
        out = assign.join(low, "root").select("id", "component")
    out = written(out, into)
    discard(links.sparkSession, tables)
    return out


def _merged(comp: DataFrame, more: DataFrame, into: list[str]) -> DataFrame:
    """Components after more links: only the components that these links touch are looked at again."""
    tables: list[str] = []
    of = comp.select(F.col("id").alias("v"), F.col("component").alias("r"))
    ends = lambda c, x: more_[c] == x["v"]
    more_, left, right = more.select("a", "b"), of.select("v", F.col("r").alias("ra")), of.select("v", F.col("r").alias("rb"))
    roots = written(more_.join(left, ends("a", left), "left").drop("v").join(right, F.col("b") == right["v"], "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), F.col("a").alias("v"), F.col("b").alias("w")), tables)
    top = components(roots.select("a", "b"), tables).select(F.col("id").alias("r"), F.col("component").alias("top"))
    known = of.unionByName(roots.select("v", F.col("a").alias("r"))).unionByName(roots.select(F.col("w").alias("v"), F.col("b").alias("r"))).distinct()
    out = written(known.join(top, "r", "left").select(F.col("v").alias("id"), F.coalesce("top", "r").alias("component")), into)
    discard(more.sparkSession, tables)
    return out


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hamming distances of sketches (rows of 64-bit words) pairwise; the longer ones are folded."""
    return np.bitwise_count(fold_to(x, y.shape[1]) ^ fold_to(y, x.shape[1])).sum(axis=1, dtype=np.int64)


def _distances(a: list[bytes], b: list[bytes], distance: Distance) -> np.ndarray:
    """Distances of sketches pairwise; lengths may differ from pair to pair."""
    la, lb = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (a, b))
    out = np.zeros(len(a), dtype=np.int64)
    for k in np.unique(la * (1 << 32) + lb).tolist():
        at = np.flatnonzero((la == k >> 32) & (lb == k & 0xFFFFFFFF))
        x, y = (np.frombuffer(b"".join([s[i] for i in at]), dtype=np.uint64).reshape(len(at), -1) for s in (a, b))
        out[at] = distance(x, y)
    return out


def fold_to(x: np.ndarray, words: int) -> np.ndarray:
    """Parity sketches (a row each) folded to at most so many 64-bit words."""
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def _across(prune: Prune, distance: Distance):
    def run(batches):
        """Groups (one a row) -> pairs across components that sizes and short sketches allow."""
        for batch in batches:
            found = []
            for same, group in zip(batch.column("same").to_pylist(), batch.column("members"), strict=True):
                m = group.values
                ids, comp, n, side = (m.field(c).to_numpy() for c in ("id", "comp", "n", "side"))
                short = m.field("short").to_pylist()
                words = min(map(len, short)) // 8
                sk = np.empty((len(ids), words), dtype=np.uint64)
                for i, x in enumerate(short):
                    sk[i] = fold_to(np.frombuffer(x, dtype=np.uint64).reshape(1, -1), words)[0]
                left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                step = max(1, (1 << 22) // max(1, words * len(right)))  # a bounded number of sketch words at a time
                for at in range(0, len(left), step):
                    rows = left[at : at + step]
                    ok = comp[rows][:, None] != comp[right][None, :]
                    if same:
                        ok &= rows[:, None] < right[None, :]
                    i, j = np.nonzero(ok)
                    i, j = rows[i], right[j]
                    keep = prune(n[i], n[j], distance(sk[i], sk[j]))
                    found.append(np.sort(np.stack([ids[i[keep]], ids[j[keep]]], axis=1), axis=1))
            if found:
                p = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return run


def _near_enough(pairs: DataFrame, meta: DataFrame, prune: Prune, distance: Distance) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow a link."""
    left = meta.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = meta.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def test(batches):
        for x in batches:
            if x.num_rows:
                ok = prune(x.column("na").to_numpy(), x.column("nb").to_numpy(), _distances(x.column("sa").to_pylist(), x.column("sb").to_pylist(), distance))
                yield x.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").mapInArrow(test, "a long, b long")


def resolve(keys: DataFrame, meta: DataFrame, prune: Prune, verify: Verify, into: list[str], distance: Distance) -> DataFrame:
    """Components of the links among items that share a key.

    keys: (key long, id long, may int), any number of rows per id, repeats allowed. may: 256 * s + f, where s is how many of
    the id's keys of family f it can do without (see above). meta: (id long, n long, sketch binary of 8 bytes times a
    power of two, short binary likewise), one row per id. distance(rows of a, rows of b) compares sketches (64-bit words);
    prune(n_a, n_b, distance) -> bool array, true where a link is possible. verify(pairs (a, b)) -> the pairs that link. Returns (id, component): ids in a link and the
    smallest id of the component. Links inside a component are verified only as far as its connection needs them; linked ids
    always share a component, so who wants all links finds them there. `into` gets the paths of what the result reads.
    """
    spark, tables = keys.sparkSession, []
    w = Window.partitionBy("key")
    lo, hi = F.min("id").over(w).alias("lo"), F.max("id").over(w).alias("hi")
    grouped = keys.select("key", "id", "may", lo, hi, F.count(F.lit(1)).over(w).cast("int").alias("size")).where("lo < hi").drop("lo", "hi")
    by_id = Window.partitionBy("id")
    often = F.row_number().over(Window.partitionBy("id", "may").orderBy(F.desc("size"), F.desc("key")))
    kept = grouped.repartition("id").select("key", "id", "may", often.alias("r"), F.sum("size").over(by_id).alias("company")).where(F.col("r") > F.shiftright("may", 8)).select("key", "id", "company")
    hub = F.max(F.struct("company", "id")).over(w)["id"]
    shared = written(kept.select("key", "id", lo, hi, hub.alias("hub"), F.count(F.lit(1)).over(w).cast("int").alias("size")).where("lo < hi").drop("lo", "hi"), tables)

    def verified(pairs: DataFrame) -> DataFrame:
        near = written(_near_enough(pairs, meta, prune, distance), tables)
        return written(verify(near).select("a", "b").distinct(), tables)

    links = verified(shared.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct())
    comp = components(links, tables)

    # A group of two is done: its members have met.
    large = shared.where("size > 2").select("key", "id").distinct()
    held = large.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = held.select("*", F.min("comp").over(w).alias("c0"), F.max("comp").over(w).alias("c1"), F.count(F.lit(1)).over(w).alias("size")).where("c0 < c1")
    mixed = mixed.join(meta, "id").select("key", "id", "comp", "n", "short", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    mixed = mixed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = mixed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = F.struct("id", "comp", "n", "short", (F.col("part") > F.col("other")).cast("int").alias("side"))
    blocks = dealt.groupBy("key", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj")).agg(F.collect_list(member).alias("members"))
    rest = written(blocks.select((F.col("bi") == F.col("bj")).alias("same"), "members").mapInArrow(_across(prune, distance), "a long, b long").distinct(), tables)
    if not rest.isEmpty():
        more = verified(rest)
        if not more.isEmpty():
            comp = _merged(comp, more, tables)
    out = written(comp.select("id", "component"), into)
    discard(spark, tables)
    return out

"""N-gram Jaccard join by parity sketches.

Every distinct word shingle of a document is hashed to 64 bits. Sets of alike size (a size band) are hashed into B
blocks; a block's parity sketch is the XOR of the hashes of the shingles that fall on it, so two sets' sketches differ in at
most as many blocks as their symmetric difference has members. Jaccard >= num/den bounds that difference by
d = floor((den-num)/(den+num) * (|A|+|B|)), so of B = d+1+e+s blocks at least e+s+1 are equal, and s+1 of them hold
shingles unless a set leaves more than e blocks empty (such sets are also joined on their empty blocks). Documents that
share a block sketch in a band are candidates, where each may leave out its s most frequent block sketches; whole parity
sketches of about a bit per shingle, one flipped by each, prune them by the same bound on their Hamming distance; the
shingle sets decide. Copies (equal sets) are one item each, named by a 64-bit hash of the set, and ``linkage.resolve``
never emits all pairs of a group. Linked sets share a component, so the links are counted among its sets, by sizes of
intersections in blocks and without emitting a pair. Texts are never shuffled but for those of candidates.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, split_by_ids, without_ids, written
from .linkage import fold_to, hamming, resolve

FOLD_WORDS = 4
#: Shingles in so large a share of documents are left out of block sketches, at most so many.
FREQUENT, MOST_FREQUENT = 0.001, 1 << 18
_NONE = np.empty(0, dtype=np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordHashes(dict):
    """word bytes -> 64-bit hash; forgotten when large, so that memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sorted distinct 64-bit shingle hashes one after another, and where each text's begin (and the end).

    Words are maximal runs outside ASCII white space, A-Z lower-cased; a shingle is n words, or all of them if they are
    fewer; without words there is none. Whole texts, a slice of the batch at a time.
    """
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(lens.sum()))
    starts = np.concatenate([[0], np.cumsum(lens)])
    count = np.where(lens >= n, lens - n + 1, (lens > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    acc = np.zeros(int(out[-1]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            roll = np.zeros(len(h) - n + 1, dtype=np.uint64)
            for i in range(n):
                roll = roll * _M1 + h[i : len(h) - n + 1 + i]
            long = np.flatnonzero(lens >= n)
            at = np.repeat(starts[long] - out[long], count[long]) + _ranges(out[long], count[long])
            acc[_ranges(out[long], count[long])] = roll[at]
        for k in np.flatnonzero((lens > 0) & (lens < n)):
            x = np.uint64(0)
            for i in range(starts[k], starts[k + 1]):
                x = x * _M1 + h[i]
            acc[out[k]] = x + np.uint64(lens[k]) * _M3
        acc = _mix(acc)
    new = np.ones(len(acc), dtype=bool)
    for k in range(len(texts)):
        part = acc[out[k] : out[k + 1]]
        if len(part) > 1:
            part.sort()
            new[out[k] + 1 : out[k + 1]] = part[1:] != part[:-1]
    kept = np.concatenate([[0], np.cumsum(new)])
    return acc[new], kept[out]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0].. first[0]+count[0]-1, first[1].. and so on."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Bands:
    """The size bands of a threshold num/den, and what sets of a size are joined on in them."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.t = num, den, num / den
        self.ratio = (1 / self.t) ** 2
        self.cache: dict[int, list[tuple[int, int, int, int]]] = {}

    def low(self, k: int) -> int:
        """Smallest size in band k."""
        return math.ceil(self.ratio**k - 1e-9)

    def most(self, a, b):
        """Largest symmetric difference of linking sets of these sizes."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def of(self, n: int) -> list[tuple[int, int, int, int]]:
        """(band, blocks, allowed empty blocks e, spare blocks s) for each band in which a set of n meets possible partners.

        With d + 1 + e + s blocks, two linking sets of which one has at most e empty blocks agree on s + 1 blocks that hold
        something, so each may leave out s of them: sets that agree on s blocks only then never meet."""
        if n not in self.cache:
            k = int(math.log(n) / math.log(self.ratio)) if n > 1 else 0
            while self.low(k + 1) <= n:
                k += 1
            while self.low(k) > n:
                k -= 1
            ks = [k] + ([k + 1] if n * self.den >= self.num * self.low(k + 1) else [])
            out = []
            for b in ks:
                top, bottom = self.low(b + 1) - 1, math.ceil(self.t * self.low(b) - 1e-9)
                d = self.most(top, top)
                spare = 1 + d // 4
                blocks = d + 1 + spare
                empty = 3 + math.ceil(3 * blocks * math.exp(-bottom / blocks))
                out.append((b, blocks + empty, empty, spare))
            self.cache[n] = out
        return self.cache[n]


def set_keys(s: np.ndarray, bands: Bands, hot: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """The join keys (int64) of a set, one per non-empty block in each of its bands, and what linkage.resolve wants to know
    of each (spare blocks and family).

    Frequent shingles make weak keys, so blocks are sketched without them: leaving the same shingles out of two sets does
    not widen their difference. A set that so leaves too many blocks empty is sketched whole as well, and if blocks are
    still missing, also joined on its empty blocks; of two sets that both do, the blocks of the second kind meet, or if
    they agree on spare ones only, the empty ones, of which none is left out.
    """
    out, may = [], []
    rare = _without(s, hot)
    for band, blocks, most_empty, spare in bands.of(len(s)):
        for kind, part in enumerate((rare, s)):
            if kind and part is not rare or not kind:
                where, keys = _block_keys(part, band, blocks, kind)
                out.append(keys)
                may.append(np.full(len(keys), spare << 8 | (band * 3 + kind) & 255, dtype=np.int32))
            if blocks - len(where) <= most_empty:
                break
        else:
            empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), where)
            with np.errstate(over="ignore"):
                out.append(_mix(_mix(np.uint64(band * 4 + 3) * _M2 + empty * _M1)))
            may.append(np.full(len(empty), (band * 3 + 2) & 255, dtype=np.int32))
    return np.concatenate(out).view(np.int64), np.concatenate(may)


def _block_keys(s: np.ndarray, band: int, blocks: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty blocks of a set and the keys of their parity sketches."""
    if not len(s):
        return s, s
    with np.errstate(over="ignore"):
        r = _mix(s + np.uint64(band + 1) * _M1)
        block = ((r >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.uint16 if blocks < 65536 else np.uint64)
        order = np.argsort(block, kind="stable")
        block, r = block[order], r[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        # A shingle turns a random half of its block's 64 bits: one bit each would leave 64 values to a block of one shingle.
        parity = np.bitwise_xor.reduceat(r, first)
        where = block[first].astype(np.uint64)
        tag = np.uint64(band * 4 + 1 + kind) * _M2 + where * _M1
        return where, _mix(parity ^ _mix(tag))


def sketches(flat: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Per set a parity sketch of a power of two of bits, as many as the set has members (256 at least), and its fold to half
    of that (256 at least)."""
    long, short = [], []
    for k in range(len(at) - 1):
        s = flat[at[k] : at[k + 1]]
        bits = max(256, 1 << max(0, len(s) - 1).bit_length())
        counts = np.bincount((s >> np.uint64(11)).astype(np.int64) & (bits - 1), minlength=bits)
        x = np.packbits((counts & 1).astype(np.uint8)).view(np.uint64).reshape(1, -1)
        long.append(x.tobytes())
        short.append(fold_to(x, max(FOLD_WORDS, bits // 128)).tobytes())
    return long, short


def _sums(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(flat, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def set_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; the first identifies it below."""
    with np.errstate(over="ignore"):
        return _sums(_mix(flat * _M1), at), _sums(_mix(flat ^ _M3), at)


def _often(flat: np.ndarray, docs: int) -> bytes:
    """(shingle, documents) of the shingles that are frequent in a slice of documents."""
    values, count = np.unique(flat, return_counts=True)
    hot = count >= max(3, docs * FREQUENT)
    return np.stack([values[hot].view(np.int64), count[hot]], axis=1).tobytes()


def _counts(batches):
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["s", "c"])


def frequent_shingles(meta: DataFrame) -> np.ndarray:
    """Shingles that stand out as frequent, at most MOST_FREQUENT (sorted). Every slice of every document has a say; which
    shingles are chosen changes the work, never the result."""
    counts = meta.where("often is not null").select("often").mapInArrow(_counts, "s long, c long").groupBy("s").agg(F.sum("c").alias("c"))
    n = meta.count()
    rows = counts.where(F.col("c") >= max(3, n * FREQUENT)).orderBy(F.desc("c"), "s").limit(MOST_FREQUENT).select("s").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def _without(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return s
    at = np.searchsorted(hot, s)
    return s[hot[np.minimum(at, len(hot) - 1)] != s]


def _sets(n: int):
    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                flat, at = shingle_sets(texts, n)
                h0, h1 = set_hashes(flat, at)
                long, short = sketches(flat, at)
                cols = (part.column(0), pa.array(np.diff(at)), pa.array(h0), pa.array(h1), pa.array(long, pa.binary()), pa.array(short, pa.binary()), pa.array([_often(flat, len(texts))] + [None] * (len(texts) - 1), pa.binary()))
                yield pa.RecordBatch.from_arrays(list(cols), names=["id", "n", "h0", "h1", "sketch", "short", "often"])

    return run


def _keys(n: int, num: int, den: int, hot: np.ndarray):
    def run(batches):
        bands, seen = Bands(num, den), set()  # copies that this task has met emit nothing more
        for batch in batches:
            for _, texts in slices(batch):
                flat, at = shingle_sets(texts, n)
                h0, _ = set_hashes(flat, at)
                ids, keys, may = [], [], []
                for k, h in enumerate(h0.tolist()):
                    if at[k + 1] > at[k] and h not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(h)
                        found = set_keys(flat[at[k] : at[k + 1]], bands, hot)
                        keys.append(found[0])
                        may.append(found[1])
                        ids.append(np.full(len(keys[-1]), h, dtype=np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, may)], names=["key", "id", "may"])

    return run


def _shingles(n: int):
    def run(batches):
        for batch in batches:
            for _, texts in slices(batch):
                flat, at = shingle_sets(texts, n)
                h0, _ = set_hashes(flat, at)
                yield pa.RecordBatch.from_arrays([pa.array(h0), pa.array([flat[at[k] : at[k + 1]].tobytes() for k in range(len(texts))], pa.binary())], names=["id", "s"])

    return run


def _linking(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Sets and shingles of one side of a block in which links are counted.
COUNTED, SIDE = 1024, 1 << 21
#: Shingles held by so small a share of a block's pairs are counted pair by pair, the others by matrix products.
SPARSE = 1 / 512


def _ends(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, number of its set) of sets one after another."""
    return np.frombuffer(b"".join(hashes), dtype=np.uint64), np.repeat(np.arange(len(hashes)), [len(x) // 8 for x in hashes])


def intersections(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b (bytes of distinct 64-bit hashes)."""
    (fa, ra), (fb, rb) = _ends(a), _ends(b)
    out = np.zeros(len(a) * len(b), dtype=np.int64)
    both = np.intersect1d(fa, fb)
    if not len(both):
        return out.reshape(len(a), len(b))
    sides = []
    for f, r in ((fa, ra), (fb, rb)):
        col = np.minimum(np.searchsorted(both, f), len(both) - 1)
        hit = both[col] == f
        col, r = col[hit], r[hit]
        order = np.argsort(col, kind="stable")
        count = np.bincount(col, minlength=len(both))
        sides.append((r[order], np.cumsum(count) - count, count))
    (ra, sa, ca), (rb, sb, cb) = sides
    few = ca * cb <= max(1.0, len(out) * SPARSE)
    rare = np.flatnonzero(few)
    ends = np.cumsum((ca * cb)[rare])
    at = 0
    while at < len(rare):  # a bounded number of pairs at a time
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 21), side="right")))
        cols = rare[at:stop]
        left = _ranges(sa[cols], ca[cols])
        times = np.repeat(cb[cols], ca[cols])
        right = _ranges(np.repeat(sb[cols], ca[cols]), times)
        out += np.bincount(np.repeat(ra[left], times) * len(b) + rb[right], minlength=len(out))
        at = stop
    out = out.reshape(len(a), len(b))
    dense = np.flatnonzero(~few)
    for k in range(0, len(dense), 4096):
        cols = dense[k : k + 4096]
        x, y = np.zeros((len(a), len(cols)), dtype=np.float32), np.zeros((len(b), len(cols)), dtype=np.float32)
        x[ra[_ranges(sa[cols], ca[cols])], np.repeat(np.arange(len(cols)), ca[cols])] = 1
        y[rb[_ranges(sb[cols], cb[cols])], np.repeat(np.arange(len(cols)), cb[cols])] = 1
        out += np.rint(x @ y.T).astype(np.int64)  # whole numbers below 2^24 are exact
    return out


def _counted(num: int, den: int):
    def run(batches):
        """Blocks of a component (one a row) -> (id, weight of the sets that it links with in this block)."""
        for batch in batches:
            for same, group in zip(batch.column("same").to_pylist(), batch.column("members"), strict=True):
                m = group.values
                ids, weight, side = (m.field(c).to_numpy() for c in ("id", "weight", "side"))
                sets = m.field("s")
                left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
                x, y = sets.take(pa.array(left)).to_pylist(), sets.take(pa.array(right)).to_pylist()
                na, nb = (np.array([len(t) // 8 for t in z], dtype=np.int64) for z in (x, y))
                both = intersections(x, y)
                ok = den * both >= num * (na[:, None] + nb[None, :] - both)
                if same:
                    np.fill_diagonal(ok, False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ok.astype(np.int64) @ weight[right])], names=["id", "links"])
                if not same:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[right]), pa.array(ok.astype(np.int64).T @ weight[left])], names=["id", "links"])

    return run


def _link_counts(members: DataFrame, shingles: DataFrame, num: int, den: int, tables: list[str]) -> DataFrame:
    """members (id, component, n, weight), shingles (id, s) -> (id, links): the weight of all other sets that a set links with.

    Every pair of a component is looked at, in blocks that hold a bounded number of sets and shingles of either side."""
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all"), F.sum("weight").alias("total"))
    members = written(members.join(size, "component"), tables)
    two = members.where("size = 2").select("id", (F.col("total") - F.col("weight")).alias("links"))
    parts = F.greatest(F.ceil(F.col("size") / COUNTED), F.ceil(F.col("all") / SIDE)).cast("int")
    more = members.where("size > 2").select("id", "component", "weight", parts.alias("parts")).join(shingles, "id")
    more = more.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    member = F.struct("id", "weight", "s", (F.col("part") > F.col("other")).cast("int").alias("side"))
    blocks = more.groupBy("component", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj")).agg(F.collect_list(member).alias("members"))
    found = blocks.select((F.col("bi") == F.col("bj")).alias("same"), "members").mapInArrow(_counted(num, den), "id long, links long")
    return written(two.unionByName(found.groupBy("id").agg(F.sum("links").alias("links"))), tables)


def ngram_join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """Link documents whose n-word shingle sets have Jaccard similarity >= num/den.

    Returns one row per input row: (id_col, n_shingles, component_id, n_links). component_id is the smallest id reachable
    by links, itself included. n_links is the number of other rows that the row links with, those with an equal set
    included; without count_links the column is not made. Null or blank texts: n_shingles 0, linked with nothing. Rows
    that repeat an id are each returned and counted. Rows with a null id are returned with a null component and no links.
    Ids are of any type with an order.
    """
    spark, bands, tables, into, read = docs.sparkSession, Bands(num, den), [], [], []
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    meta = written(src.mapInArrow(_sets(n), f"id {kind}, n long, h0 long, h1 long, sketch binary, short binary, often binary"), tables)
    copies = meta.where("n > 0 and id is not null").groupBy("h0").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short"), F.count(F.lit(1)).alias("times"))
    copies = written(copies, tables)
    sets = copies.select(F.col("h0").alias("id"), "n", "sketch", "short")
    keys = src.where("id is not null").mapInArrow(_keys(n, num, den, frequent_shingles(meta)), "key long, id long, may int")

    def prune(na, nb, dist):
        low, high = np.minimum(na, nb), np.maximum(na, nb)
        return (low * den >= high * num) & (dist <= bands.most(na, nb))

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("h0")).distinct()
        reps = written(copies.join(wanted, "h0").select(F.col("rep").alias("id")), tables)
        maybe, _ = split_by_ids(src, reps, "id")
        # A document whose id is wanted by accident has a set of its own, which no pair asks for.
        found = written(maybe.join(reps.distinct(), "id", "left_semi").mapInArrow(_shingles(n), "id long, s binary").dropDuplicates(["id"]), tables)
        read.append(found)
        both = pairs.join(found.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(found.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        return both.mapInArrow(_linking(num, den), "a long, b long")

    linked = resolve(keys, sets, prune, verify, into, hamming)
    by_set = copies.select("h0", "rep", "times").join(linked.select(F.col("id").alias("h0"), "component"), "h0", "left")
    low = by_set.groupBy("component").agg(F.min("rep").alias("low")).where("component is not null")
    by_set = by_set.join(low, "component", "left").select("h0", F.coalesce("low", "rep").alias("low"), "times")
    cols = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id")]
    if count_links:
        members = linked.join(copies.select(F.col("h0").alias("id"), "n", F.col("times").alias("weight")), "id")
        shingles = read[0]
        for more in read[1:]:
            shingles = shingles.unionByName(more)
        links = _link_counts(members, shingles.dropDuplicates(["id"]), num, den, tables)
        by_set = by_set.join(links.select(F.col("id").alias("h0"), "links"), "h0", "left")
        n_links = F.coalesce("links", F.lit(0)) + F.col("times") - 1
        cols.append(F.when(F.col("id").isNotNull() & F.col("times").isNotNull(), n_links).otherwise(F.lit(0)).alias("n_links"))
    out = meta.select("id", "n", F.when(F.col("n") > 0, F.col("h0")).alias("h0")).join(by_set, "h0", "left")
    out = written(out.select(*cols))
    discard(spark, tables + into)
    return out


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without near duplicates: of each connected group the document with the smallest id stays, columns unchanged."""
    found = ngram_join(docs, **how, count_links=False)
    id_col = how.get("id_col", "doc_id")
    drop = written(found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("id")).distinct())
    return without_ids(docs, drop, id_col)

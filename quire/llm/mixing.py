"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The cells' token counts are raked until their source, language and
topic sums meet the target marginals; raked over actual tokens is a cell's weight. A document's inclusion probability is
min(1, scale * weight), with the scale set so that the expected number of sampled tokens meets the budget; it is kept if
a hash of its id, uniform on [0, 1), lies below. Expected token shares are thus calibrated to all three marginals (but
for cells whose probability is capped at 1).

The table of cells is pre-aggregated per partition. Up to ``MOST_CELLS`` cells it is raked on the driver and broadcast;
beyond that the same steps run as DataFrame aggregations, so no size of the table is out of reach.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, written
from .quality import words_of

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: shares of tokens raised to these powers (1 keeps a marginal as it is, 0 makes it uniform).
TEMPER = {"source": 0.7, "lang": 0.5, "topic": 0.8}
MOST_CELLS = 100_000


def n_tokens(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A stand-in topic from the form of the text; give a topic column of your own where there is one."""
    t = F.coalesce(text, F.lit(""))
    bars = F.length(t) - F.length(F.translate(t, "|", ""))
    return F.when(bars * 20 >= F.greatest(tokens, F.lit(1)), "table").when(t.contains("icensed under"), "licensed").when(tokens < 100, "note").when(tokens >= 2000, "book").otherwise("prose")


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def _targets(sums: dict[str, dict[str, float]], targets: Mapping[str, Mapping[str, float]] | None) -> dict[str, dict[str, float]]:
    """Shares by dimension: those given (values absent from them get none), else tempered ones; they sum to 1 over values that have tokens."""
    out = {}
    for d, have in sums.items():
        want = {k: float((targets or {}).get(d, {}).get(k, 0.0)) for k in have} if targets and d in targets else {k: (v / sum(have.values())) ** TEMPER[d] if v else 0.0 for k, v in have.items()}
        total = sum(want[k] for k in have if have[k] > 0)
        out[d] = {k: w / total if total and have[k] > 0 else 0.0 for k, w in want.items()}
    return out


def rake(tokens: np.ndarray, codes: list[np.ndarray], wanted: list[np.ndarray], rounds: int = 200, tol: float = 1e-9) -> np.ndarray:
    """Weights of cells such that the weighted tokens' marginal shares meet `wanted`; stops when no share moves by tol."""
    x = tokens / max(tokens.sum(), 1)
    w = np.ones(len(tokens))
    for _ in range(rounds):
        worst = 0.0
        for c, want in zip(codes, wanted, strict=True):
            have = np.bincount(c, weights=x * w, minlength=len(want))
            f = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want).max(initial=0.0)))
            w *= f[c]
        if worst < tol:
            break
    else:
        warnings.warn(f"raking stopped after {rounds} rounds with a marginal off by {worst:.1e}; the targets may contradict each other", stacklevel=2)
    return w


def scale_for(tokens: np.ndarray, w: np.ndarray, budget: float) -> float:
    """The scale s with sum(tokens * min(1, s * w)) = budget (or all of it, if the budget asks for more)."""
    use = (tokens > 0) & (w > 0)
    t, v = tokens[use].astype(np.float64), w[use]
    if not len(t) or budget >= t.sum():
        return float("inf")
    order = np.argsort(-v, kind="stable")
    t, v = t[order], v[order]
    full = np.concatenate([[0.0], np.cumsum(t)])[:-1]  # tokens of cells that reach 1 before this one
    rest = np.cumsum((t * v)[::-1])[::-1]
    s = (budget - full) / rest
    ok = s * v <= 1 + 1e-12
    return float(s[np.argmax(ok)])


def _raked_small(cells: DataFrame, targets, keep_share: float, rounds: int) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in DIMENSIONS))
    tokens = np.array([r["tokens"] for r in rows], dtype=np.float64)
    codes, wanted, sums = [], [], {}
    for d in DIMENSIONS:
        sums[d] = {}
        for r in rows:
            sums[d][r[d]] = sums[d].get(r[d], 0) + r["tokens"]
    goal = _targets(sums, targets)
    for d in DIMENSIONS:
        names = sorted(sums[d])
        at = {k: i for i, k in enumerate(names)}
        codes.append(np.array([at[r[d]] for r in rows], dtype=np.int64))
        wanted.append(np.array([goal[d][k] for k in names]))
    w = rake(tokens, codes, wanted, rounds)
    s = scale_for(tokens, w, keep_share * tokens.sum())
    p = np.ones(len(w)) if np.isinf(s) else np.minimum(1.0, s * w)
    spark = cells.sparkSession
    out = [(*(r[d] for d in DIMENSIONS), float(a), float(b)) for r, a, b in zip(rows, w, p, strict=True)]
    return F.broadcast(spark.createDataFrame(out, "source string, lang string, topic string, weight double, p double"))


def _raked_large(cells: DataFrame, targets, keep_share: float, rounds: int) -> DataFrame:
    """The same steps on a table of cells of any size; its marginals' values may also be many."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    cur = cells.withColumn("weight", F.lit(1.0))
    goals = {}
    for d in DIMENSIONS:
        have = cells.groupBy(d).agg(F.sum("tokens").alias("have"))
        if targets and d in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"`{d}` string, want double")
            g = have.join(given, d, "left").select(d, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0))).otherwise(0.0).alias("want"))
        else:
            g = have.select(d, F.when(F.col("have") > 0, F.pow(F.col("have") / F.lit(max(total, 1)), F.lit(TEMPER[d]))).otherwise(0.0).alias("want"))
        s = g.agg(F.sum("want")).first()[0] or 1.0
        goals[d] = written(g.select(d, (F.col("want") / s).alias("want")))
    for _ in range(rounds):
        worst = 0.0
        for d in DIMENSIONS:
            have = cur.groupBy(d).agg((F.sum(F.col("tokens") * F.col("weight")) / F.lit(max(total, 1))).alias("have"))
            f = written(have.join(goals[d], d).select(d, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(1.0).alias("f"), F.abs(F.col("have") - F.col("want")).alias("gap")))
            worst = max(worst, f.agg(F.max("gap")).first()[0] or 0.0)
            cur = cur.join(f.select(d, "f"), d).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
        cur = written(cur)
        if worst < 1e-9:
            break
    budget = keep_share * total
    expected = lambda s: cur.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * F.col("weight")))).first()[0] or 0.0
    low, high = 0.0, 1.0
    while high < 1e12 and expected(high) < budget:
        low, high = high, high * 4
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < budget else (low, mid)
        if high - low < 1e-12 * high:
            break
    return cur.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.lit(high) * F.col("weight")).alias("p"))


def _uniform(id_col: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _described(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> tuple[DataFrame, str]:
    name = fresh_name(docs, "cell")
    text = F.col(text_col).cast("string")
    tokens = n_tokens(text)
    topic = F.coalesce(F.col(topic_col).cast("string"), F.lit("")) if topic_col else topic_of(text, tokens)
    cell = F.struct(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), topic.alias("topic"), tokens.alias("n_tokens"))
    return docs.withColumn(name, cell), name


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep_share: float = 0.5, seed: int = 7, rounds: int = 200, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per input row: (id, source, lang, topic, n_tokens, weight, p, kept).

    targets: share of tokens by value for any of source, lang and topic; others default to tempered shares (TEMPER).
    keep_share: expected share of the corpus' tokens to keep. Null sources, languages, topics and texts count as "";
    a null id is sampled like any other value. Rows that repeat an id are kept or left together if in the same cell.
    """
    rows, name = _described(docs, text_col, source_col, lang_col, topic_col)
    rows = written(rows.select(F.col(id_col).alias("id"), F.col(f"{name}.*")))
    out = rows.join(_probabilities(rows, targets, keep_share, rounds, most_cells), list(DIMENSIONS))
    return out.select(F.col("id").alias(id_col), *DIMENSIONS, "n_tokens", "weight", "p", (_uniform(F.col("id"), seed) < F.col("p")).alias("kept"))


def _probabilities(rows: DataFrame, targets, keep_share: float, rounds: int, most_cells: int) -> DataFrame:
    cells = written(cells_of(rows))
    small = cells.limit(most_cells + 1).count() <= most_cells
    return (_raked_small if small else _raked_large)(cells, targets, keep_share, rounds)


def sample_mix(docs: DataFrame, targets=None, keep_share: float = 0.5, seed: int = 7, rounds: int = 200, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """The documents that mix() keeps, columns unchanged."""
    rows, name = _described(docs, text_col, source_col, lang_col, topic_col)
    prob = _probabilities(rows.select(f"{name}.*"), targets, keep_share, rounds, most_cells)
    cols = {c: fresh_name(rows, f"mix_{c}") for c in (*DIMENSIONS, "p")}
    p = prob.select(*[F.col(c).alias(n) for c, n in cols.items()])
    on = [F.col(name)[d] == F.col(cols[d]) for d in DIMENSIONS]
    return rows.join(p, on).where(_uniform(F.col(id_col), seed) < F.col(cols["p"])).select(*docs.columns)

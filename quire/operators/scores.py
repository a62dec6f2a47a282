"""Scores and tallies: token F1, edit and rank distances, document frequencies, counts, confusion. DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def token_f1(pairs: DataFrame, keys: Sequence[str], pred: str, gold: str) -> DataFrame:
    """(keys, n_pred, n_gold, n_common, f1) over the multisets of answer tokens; 0 without overlap."""
    side = lambda c: pairs.select(*keys, F.explode(X.answer_tokens(F.col(c))).alias("w"))
    both = side(pred).withColumn("p", F.lit(1)).withColumn("g", F.lit(0)).unionAll(side(gold).withColumn("p", F.lit(0)).withColumn("g", F.lit(1)))
    per = both.groupBy(*keys, "w").agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    t = per.groupBy(*keys).agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.least("p", "g")).alias("n_common"))
    return t.withColumn("f1", F.when(F.col("n_common") > 0, F.lit(2.0) * F.col("n_common") / (F.col("n_pred") + F.col("n_gold"))).otherwise(0.0))


def edit_distance(a: Column, b: Column) -> Column:
    """Normalised by the longer length; 0 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.levenshtein(a, b) / longest).otherwise(0.0)


def tau_of(rows: Column, item: str, a: str, b: str) -> Column:
    """tau-b of an array of structs with an item and its two ranks: 1 for fewer than two items, 0 where a ranking is constant."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"))
    one = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))

    def pair(acc, x, y):
        sign = F.signum(x[a] - y[a]) * F.signum(x[b] - y[b])
        met = F.struct((acc["s"] + F.coalesce(sign, F.lit(0.0))).alias("s"), (acc["n"] + one(sign.isNotNull())).alias("n"), (acc["na"] + one(x[a] != y[a])).alias("na"), (acc["nb"] + one(x[b] != y[b])).alias("nb"))
        return F.when(x[item] < y[item], met).otherwise(acc)

    tau = lambda t: F.when(t["n"] == 0, 1.0).when((t["na"] == 0) | (t["nb"] == 0), 0.0).otherwise(t["s"] / F.sqrt(t["na"].cast("double") * t["nb"]))
    return F.aggregate(rows, start, lambda acc, x: F.aggregate(rows, acc, lambda t, y: pair(t, x, y)), tau)


def kendall_tau(ranks: DataFrame, by: Sequence[str], item: str, a: str, b: str) -> DataFrame:
    """(by, tau): tau_of each group, whose pairs are counted in place; the ranks are read once and not joined with themselves."""
    g = ranks.groupBy(*by).agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col(a).alias("a"), F.col(b).alias("b"))).alias("rows"))
    return g.select(*by, tau_of(F.col("rows"), "i", "a", "b").alias("tau"))


def idf(keys: DataFrame, articles: DataFrame, scope: str, article: str, key: str) -> DataFrame:
    """(scope, key, df, weight): ln(N/df)+1 within a scope of N articles (all of them, with keys or not), 0 beyond max(2, N/4).

    Distinct rows come first, so that the counts need no distinct and a large scope spreads over its keys.
    """
    n = articles.select(scope, article).distinct().groupBy(scope).agg(F.count(F.lit(1)).alias("n"))
    df = keys.select(scope, article, key).distinct().groupBy(scope, key).agg(F.count(F.lit(1)).alias("df")).join(n, scope)
    w = F.when(F.col("df") > F.greatest(F.lit(2.0), 0.25 * F.col("n")), 0.0).otherwise(F.log(F.col("n") / F.col("df")) + 1)
    return df.select(scope, key, "df", w.alias("weight"))


def indexed_f1(docs: DataFrame, items: DataFrame, least: int = 3, letters: int = 7) -> DataFrame:
    """(doc_id, item_id, n_pred, n_gold, n_common, f1) of the pairs that share `least` distinct tokens of so many letters.

    docs (doc_id, text), items (item_id, text). Tokens are counted once per document and item, pairs come from an inverted
    index over the long tokens, and only these pairs are scored; texts are never copied to pairs.
    """
    count = lambda df, k: df.select(k, F.explode(X.answer_tokens(F.col("text"))).alias("w")).groupBy(k, "w").agg(F.count(F.lit(1)).alias("n"))
    d, i = count(docs, "doc_id"), count(items, "item_id")
    long = F.length("w") >= letters
    pairs = d.where(long).select("doc_id", "w").join(i.where(long).select("item_id", "w"), "w").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least).select("doc_id", "item_id")
    size = lambda df, k, name: df.groupBy(k).agg(F.sum("n").alias(name))
    common = pairs.join(i.withColumnRenamed("n", "g"), "item_id").join(d.withColumnRenamed("n", "p"), ["doc_id", "w"]).groupBy("doc_id", "item_id").agg(F.sum(F.least("p", "g")).alias("n_common"))
    out = common.join(size(d, "doc_id", "n_pred"), "doc_id").join(size(i, "item_id", "n_gold"), "item_id")
    return out.select("doc_id", "item_id", "n_pred", "n_gold", "n_common", (F.lit(2.0) * F.col("n_common") / (F.col("n_pred") + F.col("n_gold"))).alias("f1"))


def shared_key_pairs(weighted: DataFrame, most: int = 10) -> DataFrame:
    """(a, b): ids (a < b) that share a key which at most `most` ids have; a key of so few ids makes few pairs."""
    n = weighted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most)).select("key")
    k = weighted.join(n, "key").select("key", "id")
    return k.select("key", F.col("id").alias("a")).join(k.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()


def category_counts(rows: DataFrame, category: str) -> DataFrame:
    """Counts and shares of each category, and a TOTAL row."""
    g = rows.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.grouping(category).alias("g"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(category)).alias("category"), "n", (F.col("n") / F.col("total")).alias("share"))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.coalesce(F.col(pred), F.lit("∅")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def tallies(rows: DataFrame, dims: Sequence[str], hit: Column) -> DataFrame:
    """Overall and by each dimension: rows, hits and their rate, as grouping sets."""
    r = rows.withColumn("hit", hit.cast("int"))
    g = r.groupingSets([[], *[[F.col(d)] for d in dims]], *[F.col(d) for d in dims]).agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.grouping_id().alias("g"))
    full = (1 << len(dims)) - 1
    name = F.when(F.col("g") == full, "overall")
    value = F.when(F.col("g") == full, "")
    for k, d in enumerate(dims):
        bit = full & ~(1 << (len(dims) - 1 - k))
        name, value = name.when(F.col("g") == bit, d), value.when(F.col("g") == bit, F.col(d).cast("string"))
    return g.select(name.alias("dimension"), value.alias("value"), "n", "hits", (F.col("hits") / F.col("n")).alias("rate"))


def rates(tallied: DataFrame) -> DataFrame:
    """Adds accuracy, recall, separation_rate and their score (harmonic mean of accuracy and separation) to sums of
    correct, scored, visuals, anchor_missing, separation_pairs and separation_failures; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    c = F.col
    t = tallied.withColumns({"accuracy": ratio(c("correct"), c("scored")), "recall": ratio(c("correct"), c("visuals") - c("anchor_missing")), "separation_rate": ratio(c("separation_pairs") - c("separation_failures"), c("separation_pairs"))})
    return t.withColumn("score", ratio(2 * c("accuracy") * c("separation_rate"), c("accuracy") + c("separation_rate")))


def rarest_keys(weighted: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """The k keys of greatest weight of each group (ties: by key), with their rank from 1."""
    w = Window.partitionBy(*by).orderBy(F.col("weight").desc(), "key")
    return weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weighted_similarity(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """(a, b, similarity, shared) of pairs (a, b) of ids over weighted sets (id, key, weight): shared weight by the root of the
    product of both weights, 1 at most, 0 where nothing is shared; shared: the keys that did it, by weight, then key."""
    total = weighted.groupBy("id").agg(F.sum("weight").alias("total"))
    left = weighted.select(F.col("id").alias("a"), "key", "weight")
    right = weighted.select(F.col("id").alias("b"), "key")
    shared = pairs.join(left, "a").join(right, ["b", "key"]).where("weight > 0").groupBy("a", "b").agg(F.sum("weight").alias("both"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "key"))), lambda x: x["key"]).alias("shared"))
    out = pairs.join(shared, ["a", "b"], "left").join(total.select(F.col("id").alias("a"), F.col("total").alias("ta")), "a", "left").join(total.select(F.col("id").alias("b"), F.col("total").alias("tb")), "b", "left")
    product = F.sqrt(F.col("ta") * F.col("tb"))
    return out.select("a", "b", F.when((product > 0) & F.col("both").isNotNull(), F.least(F.lit(1.0), F.col("both") / product)).otherwise(0.0).alias("similarity"), F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


def most_common_articles(items: DataFrame, page: str) -> DataFrame:
    """Items per (page, article), most common first, ties by first position: (page, article, n, rank from 1)."""
    g = items.groupBy(page, "article").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy(page).orderBy(F.col("n").desc(), "first_pos"))
    return g.select(page, "article", "n", rank.alias("rank"))

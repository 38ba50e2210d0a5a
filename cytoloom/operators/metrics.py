"""Metrics by group: each takes rows and key columns and gives one row a group. Curves run over distinct scores, not over rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import safe_corr
from .ranks import medians


def _curve(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    at = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    up = Window.partitionBy(*by).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*by)
    return at.select(
        *by, "s", "pos", (F.col("n") - F.col("pos")).alias("neg"),
        F.coalesce(F.sum(F.col("n") - F.col("pos")).over(up), F.lit(0.0)).alias("neg_below"),
        F.sum("pos").over(down).alias("tp"), F.sum("n").over(down).alias("flagged"), F.sum("pos").over(all_).alias("P"), F.sum("n").over(all_).alias("N"),
    )


def auroc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney with ties counted half; null where a class is missing."""
    c = _curve(df, by, score, label)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return c.groupBy(*by).agg((wins / F.nullif(F.max("P") * (F.max("N") - F.max("P")), F.lit(0.0))).alias("auroc"))


def prauc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Average precision over distinct thresholds; null without positives."""
    c = _curve(df, by, score, label)
    return c.groupBy(*by).agg((F.sum(F.col("pos") * F.col("tp") / F.col("flagged")) / F.nullif(F.max("P"), F.lit(0.0))).alias("prauc"))


def one_vs_rest(df: DataFrame, probs: list[str], y: str) -> DataFrame:
    """Rows repeated by class: cls, p, hit."""
    return df.withColumn("one", F.explode(F.array(*(F.struct(F.lit(i).alias("cls"), F.col(p).alias("p"), (F.col(y) == i).cast("int").alias("hit")) for i, p in enumerate(probs)))))\
        .select(*(c for c in df.columns), "one.*")


def brier(probs: list[str], y: str) -> Column:
    return F.avg(sum((F.pow(F.col(p) - (F.col(y) == i).cast("double"), F.lit(2.0)) for i, p in enumerate(probs)), F.lit(0.0)))


def nll(probs: list[str], y: str) -> Column:
    p = F.element_at(F.array(*probs), F.col(y) + 1)
    return F.avg(-F.ln(F.greatest(p, F.lit(1e-12))))


def binary_logloss(p: str, y: str) -> Column:
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q)))


def _bins(df: DataFrame, by: list[str], bin_: Column, conf: Column, hit: Column) -> DataFrame:
    return df.select(*by, bin_.cast("int").alias("bin"), conf.alias("conf"), hit.cast("double").alias("hit")).groupBy(*by, "bin").agg(F.avg("conf").alias("conf"), F.avg("hit").alias("acc"), F.count("*").alias("n"))


def _ece(bins: DataFrame, by: list[str], rows: DataFrame) -> DataFrame:
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    gap = bins.groupBy(*by).agg(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("g"))
    return total.join(gap, by, "left").select(*by, (F.coalesce("g", F.lit(0.0)) / F.col("total")).alias("ece"))


def reliability_top1(df: DataFrame, by: list[str], probs: list[str], y: str, bins: int = 15) -> DataFrame:
    """by, bin, conf, acc, n with bins (low, high] of the largest probability."""
    conf = F.greatest(*probs)
    hit = (F.array_position(F.array(*probs), conf) - 1) == F.col(y)
    b = F.ceil(conf * bins) - 1
    return _bins(df, by, b, conf, hit).filter("bin >= 0")


def ece_top1(df: DataFrame, by: list[str], probs: list[str], y: str, bins: int = 15) -> DataFrame:
    return _ece(reliability_top1(df, by, probs, y, bins), by, df)


def reliability_binary(df: DataFrame, by: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Bins [low, high), the last closed; labels may be soft."""
    return _bins(df, by, F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)), F.col(p), F.col(y))


def ece_binary(df: DataFrame, by: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    return _ece(reliability_binary(df, by, p, y, bins), by, df)


def regression(df: DataFrame, by: list[str], pred: str, true: str, mask: Column) -> DataFrame:
    """mae, rmse, pearson, r2, n over masked rows; null without rows or without variance."""
    p, t = F.when(mask, F.col(pred)), F.when(mask, F.col(true))
    e = p - t
    n = F.count(t)
    sst = F.var_pop(t) * n
    flat = (F.coalesce(F.var_pop(t), F.lit(0.0)) < 1e-12) | (F.coalesce(F.var_pop(p), F.lit(0.0)) < 1e-12)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(~flat, safe_corr(p, t)).alias("pearson"),
        F.when(sst > 1e-12, 1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"), n.alias("n"),
    )


def coverage(low: Column, high: Column, true: Column) -> Column:
    return F.avg(((true >= low) & (true <= high)).cast("double"))


def precision_at_k(df: DataFrame, by: list[str], score: str, quality: str, k: int, tie: str = "cell_id") -> DataFrame:
    """Share of the top k by score whose quality is at least the group's median. The top rows are cut down before they meet, the median comes from ranks: a group may hold nearly all rows."""
    top = df.select(*by, quality, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)).alias("r")).filter(F.col("r") <= k)
    mid = medians(df, by, quality, tie)
    same = F.lit(True)
    for c in by:
        same = same & top[c].eqNullSafe(mid[c])
    good = (top[quality] >= mid["median"]).cast("double")
    return top.join(mid, same, "left").groupBy(*(top[c] for c in by)).agg(F.avg(good).alias("precision_at_k"))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties; null for fewer than three rows or a constant.

    Equal pairs of values are counted first, so the windows run over distinct pairs and not over rows.
    """
    n = F.col("__n")
    pairs = df.groupBy(*by, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").cast("double").alias("__n"))

    def rank(c: str) -> Column:
        # of n equal values the last has the rank that the sum gives, and their mean is (n - 1) / 2 below it
        return F.sum(n).over(Window.partitionBy(*by).orderBy(c)) - (F.sum(n).over(Window.partitionBy(*by, c)) - 1) / 2

    r = pairs.select(*by, "__n", rank("__a").alias("ra"), rank("__b").alias("rb"))
    total = F.sum(n)
    mean = (total + 1) / 2
    va, vb = F.sum(n * F.pow("ra", F.lit(2.0))) / total - mean * mean, F.sum(n * F.pow("rb", F.lit(2.0))) / total - mean * mean
    cov = F.sum(n * F.col("ra") * F.col("rb")) / total - mean * mean
    flat = (va < 1e-12) | (vb < 1e-12) | (total < 3)
    return r.groupBy(*by).agg(F.when(~flat, cov / F.sqrt(F.when(~flat, va * vb))).alias("spearman"))


def top_share(df: DataFrame, by: list[str], item: str, value: str, share: float = 0.1) -> DataFrame:
    """The top max(1, floor(share n)) items of each group."""
    w = Window.partitionBy(*by)
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share))
    return df.withColumn("r", F.row_number().over(w.orderBy(F.desc(value), item))).withColumn("n_top", n).filter("r <= n_top").drop("r", "n_top")


def jaccard(a: DataFrame, b: DataFrame, by: list[str], item: str) -> DataFrame:
    both = a.select(*by, item, F.lit(1).alias("in_a")).join(b.select(*by, item, F.lit(1).alias("in_b")), [*by, item], "full_outer")
    return both.groupBy(*by).agg((F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()) / F.count("*")).alias("jaccard"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mean_distance(a: DataFrame, b: DataFrame, by: list[str], block: int = 1024, within: list[str] | None = None) -> DataFrame:
    """by, d: the mean Euclidean distance of a group's rows of a to those of b, self-pairs included. a: by, v; b: within, v.

    Pairs meet where they agree in `within`, part of `by` (all of it if not given): with none of it, b's rows are shared by all groups and not copied for each. Equal vectors are one row with
    a weight, so that many of them are no hot key; the rest is dealt to blocks of about `block` on either side, and a pair of blocks is one task's product of matrices, which gives
    a row a group. Costs distinct rows times distinct rows: take a sample of each group first (bottom_k) where groups are very large.
    """
    within = by if within is None else within
    weigh = lambda d, keys: d.filter("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("w"))
    one, two = weigh(a, by), weigh(b, within)
    many = lambda d, c: d.groupBy(*within).agg(F.ceil(F.count("*") / block).cast("int").alias(c))
    sizes = many(one, "na").crossJoin(F.broadcast(many(two, "nb"))) if not within else many(one, "na").join(many(two, "nb"), within)  # without keys, two single rows

    def dealt(d: DataFrame, keys: list[str], own: str, other: str, side: int) -> DataFrame:
        j = d.join(sizes, within) if within else d.crossJoin(F.broadcast(sizes))
        name = F.struct(*(F.col(c) for c in keys)) if keys else F.struct(F.lit(0).alias("none"))
        return j.select(*within, F.pmod(F.xxhash64("v"), F.col(own)).cast("int").alias("b" + own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("b" + other), F.lit(side).alias("side"), (F.to_json(name) if side == 0 else F.lit("")).alias("name"), "w", F.col("v").cast("array<double>").alias("v"))

    left, right = dealt(one, by, "na", "nb", 0), dealt(two, within, "nb", "na", 1)
    pairs = left.unionByName(right).groupBy(*within, "bna", "bnb").applyInArrow(_summed, "name string, s double")
    sums = pairs.groupBy("name").agg(F.sum("s").alias("s"))
    total = lambda d, keys, c: d.groupBy(*keys).agg(F.sum("w").cast("double").alias(c))
    n = total(one, by, "wa")
    n = n.join(total(two, within, "wb"), within) if within else n.crossJoin(F.broadcast(total(two, [], "wb")))
    return n.withColumn("name", F.to_json(F.struct(*by))).join(sums, "name").select(*by, (F.col("s") / (F.col("wa") * F.col("wb"))).alias("d"))


def _summed(t: pa.Table) -> pa.Table:
    """name, s: weighted sums of the distances between the two sides of a pair of blocks, by name of the first."""
    side, w = t.column("side").to_numpy(), t.column("w").to_numpy().astype(np.float64)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(one) or not len(two):
        return pa.table({"name": pa.array([], pa.string()), "s": pa.array([], pa.float64())})
    x = np.array(t.column("v").combine_chunks().flatten().to_numpy()).reshape(len(side), -1)
    a, b = x[one], x[two]
    square = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    near = square < 1e-6 * ((a * a).sum(1)[:, None] + (b * b).sum(1))  # differences that the product has lost
    i, j = np.nonzero(near)
    square[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    s = w[one] * (np.sqrt(np.maximum(square, 0)) @ w[two])
    names, at = np.unique(np.array(t.column("name").to_pylist())[one], return_inverse=True)
    return pa.table({"name": pa.array(names.tolist(), pa.string()), "s": np.bincount(at, s, len(names))})


def bottom_k(df: DataFrame, by: list[str], n: int, key: str, seed: int = 0) -> DataFrame:
    """At most n rows of each group, those with the least hash of the key: the cap of rows a group. The least n of every partition are kept before rows meet, so a group's rows never do."""
    h = F.xxhash64(F.lit(seed), key)
    r = F.row_number().over(Window.partitionBy(*by).orderBy(h, key))
    return df.withColumn("__r", r).filter(F.col("__r") <= n).drop("__r")


def energy_to_control(df: DataFrame, group: str, vec: str, control: Column, most: int | None = None, key: str | None = None) -> DataFrame:
    """Energy distance of each group to the controls, self-pairs included, at least 0. Exact, or on at most `most` rows of each group and of the controls, by the hash of `key`."""
    if most:
        df = bottom_k(df.withColumn("__c", control), ["__c", group], most, key)
        df = bottom_k(df.filter("__c"), ["__c"], most, key).unionByName(df.filter("NOT __c"))
    ctrl = df.filter(control).select(F.col(vec).alias("v"))
    rest = df.filter(~control).select(group, F.col(vec).alias("v"))
    cross_ = mean_distance(rest, ctrl, [group], within=[]).withColumnRenamed("d", "ab")
    own = mean_distance(rest, rest, [group]).withColumnRenamed("d", "aa")
    one = ctrl.withColumn("all", F.lit(0))
    bb = mean_distance(one, one, ["all"]).select(F.col("d").alias("bb"))
    return cross_.join(own, group).crossJoin(F.broadcast(bb)).select(group, F.greatest(2 * F.col("ab") - F.col("aa") - F.col("bb"), F.lit(0.0)).alias("e_distance"))


def class_mass(df: DataFrame, cols: list[str], beta: float = 0.999) -> DataFrame:
    """cls, mass, weight: class-balanced weights (1 - beta) / (1 - beta^mass), scaled to mean 1."""
    mass = df.agg(*(F.sum(c).alias(c) for c in cols)).select(F.posexplode(F.array(*cols)).alias("cls", "mass"))
    raw = F.when(F.col("mass") > 0, (1 - beta) / (1 - F.pow(F.lit(beta), F.col("mass")))).otherwise(0.0)
    return mass.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.avg("raw").over(Window.partitionBy(F.lit(1)))).drop("raw")


def focal_loss(probs: list[str], y: str, gamma: float) -> Column:
    p = F.greatest(F.element_at(F.array(*probs), F.col(y) + 1), F.lit(1e-12))
    return F.avg(-F.pow(1 - p, F.lit(gamma)) * F.ln(p))


def soft_focal_loss(probs: list[str], soft: list[str], weights: list[float], gamma: float) -> Column:
    """Focal loss against soft labels, with weights of classes."""
    terms = [F.col(t) * w * F.pow(1 - F.greatest(F.col(p), F.lit(1e-12)), F.lit(gamma)) * F.ln(F.greatest(F.col(p), F.lit(1e-12))) for p, t, w in zip(probs, soft, weights)]
    return F.avg(-sum(terms[1:], terms[0]))


def huber_masked(pred: str, true: str, mask: Column, delta: float) -> Column:
    e = F.abs(F.col(pred) - F.col(true))
    return F.coalesce(F.avg(F.when(mask, F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2)))), F.lit(0.0))


def mean_finite(c: Column) -> Column:
    return F.avg(F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c))


def precision_recall_at(df: DataFrame, by: list[str], score: str, good: str, cutoffs: list[float]) -> DataFrame:
    """precision (null without flags) and recall (0 without flags) of rows at or above each cutoff."""
    cut = df.withColumn("cutoff", F.explode(F.array(*map(F.lit, cutoffs))))
    flag = F.col(score) >= F.col("cutoff")
    hits, flags, goods = F.count_if(flag & (F.col(good) == 1)), F.count_if(flag), F.count_if(F.col(good) == 1)
    return cut.groupBy(*by, "cutoff").agg(
        (hits / F.nullif(flags, F.lit(0))).alias("precision"), F.when(flags == 0, 0.0).otherwise(hits / F.nullif(goods, F.lit(0))).alias("recall"), flags.alias("n_flagged")
    )


def long_form(wide: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by, metric, value of a table with one column a metric."""
    return wide.select(*by, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)

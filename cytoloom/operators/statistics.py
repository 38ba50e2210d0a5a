"""Aggregates over folds, paired comparisons, null tests and their verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: two-sided 95 % points of Student's t by degrees of freedom
T_CRITICAL = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228}
T_DEFAULT = 2.571


def t_critical(df: Column) -> Column:
    out = F.lit(T_DEFAULT)
    for k, v in T_CRITICAL.items():
        out = F.when(df == k, v).otherwise(out)
    return out


def aggregate_folds(values: DataFrame, by: list[str]) -> DataFrame:
    v = F.when(~F.isnan("value"), F.col("value"))
    return values.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))


def paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, diff = a - b where both sides have a value."""
    left = a.filter("value IS NOT NULL AND NOT isnan(value)").select(*keys, F.col("value").alias("va"))
    right = b.filter("value IS NOT NULL AND NOT isnan(value)").select(*keys, F.col("value").alias("vb"))
    return left.join(right, keys).withColumn("diff", F.col("va") - F.col("vb"))


def paired_ci(diffs: DataFrame, by: list[str]) -> DataFrame:
    """mean difference with its 95 % interval, wins, losses and t; null for fewer than two pairs."""
    n = F.count("diff")
    g = diffs.groupBy(*by).agg(F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd"), n.alias("n"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") > 0).alias("wins"))
    se = F.col("sd") / F.sqrt(F.col("n"))
    half = t_critical(F.col("n") - 1) * se
    ok = F.col("n") >= 2
    return g.select(*by, "mean_diff", "n", "wins", "losses", F.when(ok, F.col("mean_diff") - half).alias("ci_low"), F.when(ok, F.col("mean_diff") + half).alias("ci_high"), F.when(ok, F.col("mean_diff") / F.nullif(se, F.lit(0.0))).alias("t"))


def verdict(ci: DataFrame, direction: Column) -> DataFrame:
    """direction: 1 higher is better, -1 lower is better, 0 context only."""
    good = F.when(direction > 0, F.col("ci_low") > 0).otherwise(F.col("ci_high") < 0)
    bad = F.when(direction > 0, F.col("ci_high") < 0).otherwise(F.col("ci_low") > 0)
    v = F.when(direction == 0, "(context)").when(F.col("ci_low").isNull(), "noise").when(bad, "REGRESSION").when(good, "ACCEPT").otherwise("noise")
    return ci.withColumn("verdict", v)


def jackknife(values: DataFrame, key: str) -> DataFrame:
    """The mean with each key left out, and with all."""
    all_ = Window.partitionBy(F.lit(0))
    n = F.count("value").over(all_)
    own = F.coalesce("value", F.lit(0.0))
    k = F.col("value").isNotNull().cast("int")
    left = values.select(F.col(key).cast("string").alias("left_out"), ((F.sum("value").over(all_) - own) / F.nullif(n - k, F.lit(0))).alias("mean"))
    return left.unionByName(values.agg(F.lit("ALL").alias("left_out"), F.avg("value").alias("mean")).select("left_out", "mean"))


def effective_n(df: DataFrame, donor: str, value: str) -> DataFrame:
    """Between and within variance of donors, intraclass correlation, design effect and effective size."""
    by = df.groupBy(donor).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("n"))
    g = by.agg(F.var_pop("m").alias("between"), F.avg("v").alias("within"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("size"))
    icc = F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0))
    deff = 1 + (F.col("size") - 1) * F.coalesce(icc, F.lit(0.0))
    return g.select("between", "within", icc.alias("icc"), deff.alias("design_effect"), (F.col("n") / deff).alias("n_eff"))


def bar_pass(null: DataFrame, by: list[str], bar: float, below: bool = True) -> DataFrame:
    """How often a null sample passes a bar, its quantiles, and the bar that a null passes one time in twenty."""
    ok = F.col("x") <= bar if below else F.col("x") >= bar
    return null.groupBy(*by).agg(F.avg(ok.cast("double")).alias("pass_rate"), F.percentile("x", F.lit(0.5)).alias("p50"), F.percentile("x", F.lit(0.9)).alias("p90"), F.percentile("x", F.lit(0.95 if below else 0.05)).alias("usable_bar"))


def band_pass(null: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    return null.groupBy(*by).agg(F.avg(F.col("x").between(low, high).cast("double")).alias("band_rate"))


def interval_report(df: DataFrame, by: list[str], level: float = 0.9) -> DataFrame:
    """coverage against nominal, width and width over twice the sd of truth, with a verdict. df: low, high, true."""
    g = df.groupBy(*by).agg(
        F.avg(((F.col("true") >= F.col("low")) & (F.col("true") <= F.col("high"))).cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"), F.stddev_pop("true").alias("sd")
    )
    rel = F.col("width") / F.nullif(2 * F.col("sd"), F.lit(0.0))
    gap = F.col("coverage") - level
    v = F.when(F.abs(gap) <= 0.05, F.when(rel < 2, "useful").otherwise("wide")).when(gap < 0, "under").otherwise("over")
    return g.select(*by, "coverage", gap.alias("gap"), "width", rel.alias("rel_width"), v.alias("verdict"))


def pooled_ece(df: DataFrame, p: str, y: str, bins: int, trials: int, seed: int) -> DataFrame:
    """ECE over all rows, the median that it has where labels follow the probabilities (hash draws), and the share of draws below it: ece, floor, excess, pctile. Null for n < 10.

    Rows are repeated once a trial and reduced to bins at once.
    """
    from ..functions.columns import unit_hash

    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    rows = df.select("cell_id", F.col(p).alias("p"), F.col(y).cast("double").alias("y"), b.alias("b"))
    draws = rows.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    hit = F.when(F.col("trial") == 0, F.col("y")).otherwise((unit_hash(str(seed), F.col("cell_id"), F.col("trial")) < F.col("p")).cast("double"))
    gaps = draws.groupBy("trial", "b").agg(F.abs(F.sum(hit) - F.sum("p")).alias("g"), F.count("*").alias("n"))
    each = gaps.groupBy("trial").agg((F.sum("g") / F.sum("n")).alias("ece"), F.sum("n").alias("n"))
    drawn = F.when(F.col("trial") > 0, F.round("ece", 12))
    out = each.agg(F.max(F.when(F.col("trial") == 0, F.col("ece"))).alias("ece"), F.percentile(F.when(F.col("trial") > 0, F.col("ece")), F.lit(0.5)).alias("floor"), F.collect_list(drawn).alias("draws"), F.max("n").alias("n"))
    few = F.col("n") < 10
    below = F.size(F.filter("draws", lambda x: x < F.round("ece", 12))) / F.lit(float(trials))
    return out.select(*(F.when(~few, c).alias(a) for c, a in ((F.col("ece"), "ece"), (F.col("floor"), "floor"), (F.col("ece") - F.col("floor"), "excess"), (below, "pctile"))), "n")


def pooled_ece_draws(df: DataFrame, p: str, y: str, bins: int = 10, trials: int = 4000, seed: int = 0, places: int = 4) -> DataFrame:
    """As pooled_ece, with labels drawn by distinct probability and not by row: trials times values draws, however many rows.

    Rows whose probabilities agree in `places` decimals are one value: of m rows, the hits are a binomial draw at their mean probability, which differs from m
    single draws by less than 10^-places in its mean. A value's draws follow from the seed and the value alone. Rows meet in one aggregate by value, draws in one by bin and trial.
    """
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    values = df.filter(F.col(p).isNotNull()).groupBy(b.alias("b"), F.round(F.col(p) * 10**places).cast("long").alias("v")).agg(F.count("*").alias("m"), F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, rest = np.zeros((bins, trials), np.int64), np.zeros((bins, 3))
        for batch in batches:
            for b, v, m, sp, sy in zip(*(c.to_pylist() for c in batch.columns)):
                hits[b] += np.random.default_rng([seed, b, v]).binomial(m, min(1.0, max(0.0, sp / m)), trials)
                rest[b] += (m, sp, sy)
        on = np.flatnonzero(rest[:, 0] > 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * trials, pa.int32()), pa.array(hits[on].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), lists, *(pa.array(rest[on, i]) for i in range(3))], names=["b", "hits", "m", "sp", "sy"])

    parts = values.mapInArrow(draw, "b int, hits array<long>, m double, sp double, sy double")
    each = parts.select("b", "m", "sp", "sy", F.posexplode("hits").alias("trial", "hit")).groupBy("b", "trial").agg(F.sum("hit").alias("hit"), F.sum("m").alias("m"), F.sum("sp").alias("sp"), F.sum("sy").alias("sy"))
    gaps = each.groupBy("trial").agg((F.sum(F.abs(F.col("hit") - F.col("sp"))) / F.sum("m")).alias("drawn"), (F.sum(F.abs(F.col("sy") - F.col("sp"))) / F.sum("m")).alias("ece"), F.sum("m").cast("long").alias("n"))
    out = gaps.agg(F.max("ece").alias("ece"), F.percentile("drawn", F.lit(0.5)).alias("floor"), F.avg((F.round("drawn", 12) < F.round("ece", 12)).cast("double")).alias("pctile"), F.max("n").alias("n"))
    few = F.col("n") < 10
    return out.select(*(F.when(~few, c).alias(a) for c, a in ((F.col("ece"), "ece"), (F.col("floor"), "floor"), (F.col("ece") - F.col("floor"), "excess"), (F.col("pctile"), "pctile"))), "n")


def gates(metrics: DataFrame) -> DataFrame:
    """Acceptance by regime of `model` against the other estimators. metrics: regime, estimator, prauc, mae, ece, coverage, spearman.

    A null never passes, but an error that the model or the other estimator lacks is not compared. A tie in prauc is not beaten, one in mae is.
    """
    m = metrics.filter("estimator = 'model'")
    rest = metrics.filter("estimator <> 'model'").groupBy("regime").agg(F.max("prauc").alias("best_prauc"), F.min("mae").alias("best_mae"))
    j = m.join(rest, "regime", "left")
    better = F.col("best_prauc").isNull() | (F.col("prauc") > F.col("best_prauc"))
    beats = F.col("prauc").isNotNull() & better & F.coalesce(F.col("mae") <= F.col("best_mae"), F.lit(True))
    checks = {"beats_all": beats, "ece_ok": F.col("ece") < 0.05, "coverage_ok": F.abs(F.col("coverage") - 0.9) < 0.03, "ranks": F.col("spearman") > 0.3}
    named = j.select("regime", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()))
    all_ = F.col("beats_all") & F.col("ece_ok") & F.col("coverage_ok") & F.col("ranks")
    return named.withColumn("accepted", all_)


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Estimators by mean PR-AUC, a missing one last."""
    g = metrics.groupBy("estimator").agg(F.avg("prauc").alias("mean_prauc"))
    return g.orderBy(F.desc(F.coalesce("mean_prauc", F.lit(-1.0))), "estimator")

"""The ridge clock: age from expression, for few samples and many genes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import normal_cdf, safe_corr

ALPHAS = tuple(np.logspace(-1.0, 4.0, 24))
MOST_SAMPLES = 5000  # the Gram matrix of the samples is solved on the driver; genes stay on the cluster


def gram(expr: DataFrame, samples: DataFrame) -> DataFrame:
    """i, j, k: inner products of samples over genes. Only samples meet in pairs, of which there are a few hundred."""
    x = expr.join(F.broadcast(samples.select("sample", "i")), "sample").select("i", "gene", "value")
    return x.join(x.select(F.col("i").alias("j"), "gene", F.col("value").alias("other")), "gene").groupBy("i", "j").agg(F.sum(F.col("value") * F.col("other")).alias("k"))


def _leave_one_out(k: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(dual weights, leave-one-out errors) of ridge with an intercept; k is the centred Gram matrix."""
    n = len(y)
    inverse = np.linalg.inv(k + alpha * np.eye(n))
    dual = inverse @ (y - y.mean())
    hat = np.diag(k @ inverse) + 1 / n
    return dual, (y - y.mean() - k @ dual) / np.maximum(1 - hat, 1e-12)


def _best(k: np.ndarray, y: np.ndarray, alphas: tuple[float, ...]) -> tuple[float, np.ndarray]:
    n = len(y)
    c = np.eye(n) - 1 / n
    centred = c @ k @ c
    scored = [(float(np.mean(_leave_one_out(centred, y, a)[1] ** 2)), a) for a in alphas]
    alpha = min(scored)[1]
    return alpha, _leave_one_out(centred, y, alpha)[0]


def fit_clock(expr: DataFrame, ages: DataFrame, alphas: tuple[float, ...] = ALPHAS, folds: int = 5, seed: int = 0) -> tuple[DataFrame, float, dict]:
    """(weights by gene, intercept, metrics) of ridge regression with the penalty of least leave-one-out error.

    expr: sample, gene, value (log-normalised, zeros left out); ages: sample, age. At least five samples, at most MOST_SAMPLES. The dual
    solution needs the samples' Gram matrix only; weights are summed back over the expression table.
    """
    known = sorted((r["sample"], r["age"]) for r in ages.filter("age IS NOT NULL").limit(MOST_SAMPLES + 1).collect())
    n = len(known)
    if not 5 <= n <= MOST_SAMPLES:
        raise ValueError(f"a clock needs 5 to {MOST_SAMPLES} samples with ages, not {n}")
    spark = expr.sparkSession
    samples = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(known)], f"sample {ages.schema['sample'].dataType.simpleString()}, i int")
    y = np.array([float(a) for _, a in known])
    k = np.zeros((n, n))
    for r in gram(expr, samples).toPandas().itertuples():
        k[r.i, r.j] = r.k
    alpha, dual = _best(k, y, alphas)
    dual = dual - dual.mean()
    duals = spark.createDataFrame([(s, float(d)) for (s, _), d in zip(known, dual)], samples.select("sample").schema.add("d", "double"))
    weights = expr.join(F.broadcast(duals), "sample").groupBy("gene").agg(F.sum(F.col("d") * F.col("value")).alias("weight"))
    # the mean prediction is the mean age: y = mean + (k - row means) dual
    intercept = float(y.mean() - (k @ dual).mean())
    order = np.random.default_rng(seed).permutation(n)
    pred = np.empty(n)
    for part in np.array_split(order, min(folds, n)):
        rest = np.setdiff1d(order, part)
        inner = k[np.ix_(rest, rest)]
        _, d = _best(inner, y[rest], alphas)
        d = d - d.mean()
        pred[part] = y[rest].mean() - (inner @ d).mean() + k[np.ix_(part, rest)] @ d
    metrics = {"n_samples": n, "alpha": float(alpha), "cv_mae": float(np.abs(pred - y).mean()), "cv_pearson": float(np.corrcoef(pred, y)[0, 1]) if pred.std() > 0 else None, "age_range": [float(y.min()), float(y.max())]}
    return weights, intercept, metrics


def extreme_contrast(ages: DataFrame, cv_mae: float, by: list[str]) -> DataFrame:
    """by, contrast of the mean prediction of the oldest and the youngest, its bar and verdict, and the power if the clock were right.

    ages: by, chrono, predicted; one row a donor.
    """
    g = ages.groupBy(*by).agg(F.min("chrono").alias("lo"), F.max("chrono").alias("hi"), safe_corr(F.col("predicted"), F.col("chrono")).alias("pearson"))
    j = ages.join(g, by)
    young, old = F.col("chrono") == F.col("lo"), F.col("chrono") == F.col("hi")
    s = j.groupBy(*by, "lo", "hi", "pearson").agg(F.count_if(young).alias("n_young"), F.count_if(old).alias("n_old"), (F.avg(F.when(old, F.col("predicted"))) - F.avg(F.when(young, F.col("predicted")))).alias("contrast"))
    se = F.lit(cv_mae) * F.sqrt(1 / F.col("n_young") + 1 / F.col("n_old"))
    bar = F.lit(1.6448536269514722) * se
    flat = F.col("lo") == F.col("hi")
    status = F.when(flat, "CANNOT_VERIFY").when(F.col("contrast") >= bar, "PASS").otherwise("FAIL")
    return s.select(*by, "contrast", bar.alias("bar"), (F.col("hi") - F.col("lo")).alias("true_gap"), "n_young", "n_old", normal_cdf((F.col("hi") - F.col("lo") - bar) / se).alias("power"), "pearson", status.alias("status"))


def sweep(df: DataFrame, column: str, points: list[float], score: Column) -> DataFrame:
    """Scores the same rows with `column` set to each point: cell_id, point, score, and the change from the first point."""
    wide = df.drop(column).withColumn(column, F.explode(F.array(*map(F.lit, points)))).select("cell_id", F.col(column).alias("point"), score.alias("score"))
    base = wide.filter(F.col("point") == points[0]).select("cell_id", F.col("score").alias("first"))
    return wide.join(base, "cell_id").select("cell_id", "point", "score", (F.col("score") - F.col("first")).alias("change"))

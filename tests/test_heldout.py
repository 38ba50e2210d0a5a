"""Fits with groups left out, against separate fits."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from cytoloom.operators import baselines as B, heldout as H
from cytoloom.plans import QUERIES


def table(spark, n=400, k=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * [1.0, 10.0, 0.1][:k] + 5
    y = x @ np.array([1.0, -0.2, 3.0])[:k] + rng.normal(size=n)
    g = rng.integers(0, 6, n)
    df = spark.createDataFrame([(int(a), *map(float, r), float(b)) for a, r, b in zip(g, x, y)], f"grp int, {', '.join(f'x{i} double' for i in range(k))}, y double")
    return df.repartition(5), g, x, y


def separate(x, y, alpha):
    """Ridge on standardised columns, by lstsq on augmented rows."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 0, sd, 1.0)
    z = np.vstack([(x - mean) / sd, np.sqrt(alpha) * np.eye(x.shape[1])])
    w = np.linalg.lstsq(z, np.concatenate([y - y.mean(), np.zeros(x.shape[1])]), rcond=None)[0] / sd
    return lambda q: y.mean() + (q - mean) @ w


def test_equal_to_separate_fits(spark):
    df, g, x, y = table(spark)
    cols = ["x0", "x1", "x2"]
    got = H.predicted(df, H.left_out_fits(H.moments(df, "grp", cols, "y"), "grp", 3), "grp", cols).toPandas()
    for k in range(6):
        own = got[got.grp == k]
        want = separate(x[g != k], y[g != k], 1.0)(own[cols].to_numpy())
        assert np.allclose(own.prediction, want, rtol=0, atol=1e-8)
    each = {r["grp"]: r for r in H.leave_group_out(df, "grp", cols, "y").collect()}
    e = got.prediction - got.y
    for k in range(6):
        at = got.grp == k
        assert np.isclose(each[k]["mae"], e[at].abs().mean()) and np.isclose(each[k]["r2"], 1 - (e[at] ** 2).sum() / ((got.y[at] - got.y[at].mean()) ** 2).sum()) and each[k]["n"] == at.sum()


def test_failed_folds_are_rows_with_their_error(spark):
    rows = [(0, 1.0, 2.0, 1.0), (0, 2.0, 4.0, 2.0), (0, 3.0, 6.0, 2.5), (1, 1.0, 0.0, 1.0), (1, 5.0, 1.0, 3.0), (1, None, 1.0, 3.0), (2, 4.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "grp int, x0 double, x1 double, y double")
    fits = {r["grp"]: r for r in H.left_out_fits(H.moments(df, "grp", ["x0", "x1"], "y"), "grp", 2, alpha=0.0).collect()}
    assert set(fits) == {0, 1} and fits[1]["error"].startswith("the columns") and fits[1]["w"] is None  # without group 1, x1 is twice x0
    assert {r["grp"]: (r["n"], r["mae"] is None) for r in H.leave_group_out(df, "grp", ["x0", "x1"], "y", alpha=0.0).collect()}[1] == (0, True)
    one = df.filter("grp = 0")
    assert "two rows" in H.left_out_fits(H.moments(one, "grp", ["x0"], "y"), "grp", 1).first()["error"]
    assert H.leave_group_out(one.limit(0), "grp", ["x0"], "y").count() == 0


def test_one_pass_over_the_rows(spark):
    df, *_ = table(spark)
    sums = H.moments(df, "grp", ["x0", "x1", "x2"], "y")
    assert sums._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1 and sums.count() == 6


def test_elapsed_time_that_matters_is_found(spark):
    rng = np.random.default_rng(1)
    rows = [(d, v, t, v + 2 * t + float(rng.normal()) * 0.1) for d in range(8) for v, t in zip(map(float, rng.normal(size=30)), map(float, rng.uniform(0, 3, 30)))]
    pairs = spark.createDataFrame(rows, "grp int, v_i double, dt double, v_j double")
    gate = H.forward_gate(pairs, "grp", ["v_i"], "v_j").collect()
    assert len(gate) == 8 and all(r["mae_both"] < 0.3 < r["mae_state"] for r in gate)
    first = pairs.groupBy("grp").agg(F.min_by("v_i", "dt").alias("v_i"))
    for r in H.elapsed_sweep(pairs, first, "grp", ["v_i"], "v_j").collect():
        assert abs(r["swing"] - 2 * (r["dt_high"] - r["dt_low"])) < 0.3


def test_left_out_fates(spark):
    """A group is scored by a fit that has not seen it: one whose relation is turned round does badly; one without which a class is missing is a row with its error."""
    rows = [(g, float(i), int((i >= 6) != (g == 2)), i) for g in range(3) for i in range(12)] + [(0, 1.0, None, 99)]
    df = spark.createDataFrame(rows, "g int, x double, hit int, row int")
    got = {r["g"]: r for r in H.leave_group_out_fate(df, "g", [0, 1, 2], ["x"], "hit").collect()}
    assert {g: r["n"] for g, r in got.items()} == {0: 12, 1: 12, 2: 12} and all(r["error"] is None for r in got.values())
    assert got[2]["prauc"] < 0.5 and got[2]["log_loss"] > 2  # fitted on the other two only
    same = {r["g"]: r for r in H.leave_group_out_fate(df.filter("g < 2"), "g", [0, 1], ["x"], "hit").collect()}
    assert same[0]["prauc"] == same[1]["prauc"] == 1.0 and same[0]["log_loss"] < 0.3
    alone = df.filter("g < 2").withColumn("hit", F.when(F.col("g") == 0, 1).otherwise(F.col("hit")))
    mixed = {r["g"]: r for r in H.leave_group_out_fate(alone, "g", [0, 1], ["x"], "hit").collect()}
    assert "one class only" in mixed[1]["error"] and mixed[1]["n"] is None
    assert mixed[0]["n"] == 13 and mixed[0]["prauc"] is None and mixed[0]["log_loss"] > 0
    weights = [i for i in range(6)] + [6]  # 1 of 7 hits: weighed alike, the middle of the classes has one half
    lone = spark.createDataFrame([(float(i), int(i == 6)) for i in weights], "x double, hit int")
    p = {r["x"]: r["fitted"] for r in B.balanced_logistic(lone, ["x"], "hit")(lone).collect()}
    assert p[2.0] < 0.5 < p[6.0]


@pytest.mark.parametrize("name", ["left_out_fates", "logistic_against_model", "fit_ensemble", "feature_views", "calibrator_bakeoff", "regressors", "full_evaluation", "embedding_features", "embedding_fate"])
def test_fits_read_written_rows(spark, monkeypatch, name):
    """A fit passes over its rows again and again: they are a written table, not joins whose broadcasts go through the driver each time."""

    class Seen(Exception):
        pass

    def fit(self, df, *_):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(B.Pipeline, "fit", fit)
    monkeypatch.setattr(B.LogisticRegression, "fit", fit)
    with pytest.raises(Seen) as e:
        QUERIES[name](spark, SF)
    assert "Join" not in str(e.value) and "Relation" in str(e.value)


def test_signatures_and_cycle_are_one_pass(spark, monkeypatch):
    from cytoloom.plans import build_queries as BQ

    names, staged = [], BQ.staged
    monkeypatch.setattr(BQ, "staged", lambda df, what: (names.append(what), staged(df, what))[1])
    b = BQ.Build(spark, SF)
    assert b.scores().columns == ["cell_id", "safe", "loss", "death"] and b.cycle().columns == ["cell_id", "score"]
    assert sorted(names) == ["expr", "kept", "norm", "scores"]

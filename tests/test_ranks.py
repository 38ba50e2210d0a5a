"""Ranks, draws, samples and distances where one group holds nearly all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from cytoloom.operators import metrics as M, ranks as R, statistics as ST


def hot(spark, n=20_000):
    g = F.when(F.col("id") % 100 > 0, F.lit("hot")).when(F.col("id") % 300 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    return spark.range(n).select(F.col("id").alias("cell_id"), g.alias("g"), (F.xxhash64("id") % 50).alias("v"))


def test_ranks_are_those_of_a_window(spark):
    df = hot(spark)
    got = R.ranked(df, ["g"], [F.desc("v"), F.col("cell_id")], parts=16)
    own = Window.partitionBy("g")
    want = df.withColumns({"rank": F.row_number().over(own.orderBy(F.desc("v"), "cell_id")), "size": F.count("*").over(own)})
    row = lambda d: sorted((r["cell_id"], r["g"] or "", r["v"], r["rank"], r["size"]) for r in d.collect())
    assert row(got) == row(want)
    assert R.ranked(df.limit(0), ["g"], [F.col("v")]).count() == 0 and R.ranked(df, [], [F.col("cell_id")]).filter("rank <> cell_id + 1 OR size <> 20000").isEmpty()


def test_no_task_has_most_of_a_hot_group(spark):
    df = hot(spark)
    keys = [F.col("g"), F.desc("v"), F.col("cell_id")]
    sizes = [r["count"] for r in df.repartitionByRange(16, *keys).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    runs = R.ranked(df, ["g"], keys[1:], parts=16)
    assert "Window" not in [x.split("(")[0].strip(" +-*") for x in runs.select("cell_id", "g", "v")._jdf.queryExecution().executedPlan().toString().split("\n")]


def test_medians_from_ranks(spark):
    df = hot(spark).withColumn("v", F.when(F.col("cell_id") % 3 > 0, F.col("v").cast("double")))
    got = {r["g"]: r["median"] for r in R.medians(df, ["g"], "v", "cell_id").collect()}
    assert got == {r["g"]: r["m"] for r in df.filter("v IS NOT NULL").groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}


def test_draws_by_value_agree_with_draws_by_row(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.beta(2, 3, 5000), 6)
    y = (rng.random(5000) < np.clip(p + 0.02, 0, 1)).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "cell_id long, p double, y int")
    got = ST.pooled_ece_draws(df, "p", "y", trials=4000).first()
    b = np.minimum((p * 10).astype(int), 9)
    ece = lambda hit: sum(abs((hit - p)[b == k].sum()) for k in range(10)) / len(p)
    rows = np.array([ece(rng.random(5000) < p) for _ in range(4000)])
    assert abs(got["ece"] - ece(y)) < 1e-9 and got["n"] == 5000
    assert abs(got["floor"] - np.median(rows)) < 5 * 1.25 * rows.std() / np.sqrt(4000)
    assert abs(got["pctile"] - (rows < ece(y)).mean()) < 0.05
    again = ST.pooled_ece_draws(df.repartition(9), "p", "y", trials=4000).first()
    assert abs(again["floor"] - got["floor"]) < 1e-12 and again["pctile"] == got["pctile"]
    assert ST.pooled_ece_draws(df.limit(5), "p", "y", trials=10).first()["ece"] is None


def test_distances_of_equal_vectors(spark):
    rng = np.random.default_rng(3)
    a = [("x", [0.0, 0.0])] * 3000 + [("x", v) for v in rng.normal(size=(40, 2)).tolist()] + [("y", [1.0, 1.0]), (None, [2.0, 0.0]), ("y", None)]
    b = [([0.0, 0.0],)] * 500 + [(v,) for v in rng.normal(size=(30, 2)).tolist()]
    left, right = spark.createDataFrame(a, "g string, v array<double>"), spark.createDataFrame(b, "v array<double>")
    got = {r["g"]: r["d"] for r in M.mean_distance(left, right, ["g"], 16, []).collect()}
    y = np.array([v for (v,) in b])
    for g in ("x", "y", None):
        x = np.array([v for k, v in a if k == g and v is not None])
        assert np.isclose(got[g], np.linalg.norm(x[:, None] - y, axis=2).mean(), atol=1e-9)
    both = {r["g"]: r["d"] for r in M.mean_distance(left, left, ["g"], block=16).collect()}
    x = np.array([v for k, v in a if k == "x"])
    assert np.isclose(both["x"], np.linalg.norm(x[:, None] - x, axis=2).mean(), atol=1e-9) and both["y"] == 0


def test_caps_take_the_least_hashes(spark):
    df = hot(spark)
    got = M.bottom_k(df, ["g"], 50, "cell_id", seed=1)
    assert max(r["count"] for r in got.groupBy("g").count().collect()) == 50
    assert sorted(r["cell_id"] for r in got.collect()) == sorted(r["cell_id"] for r in M.bottom_k(df.repartition(11), ["g"], 50, "cell_id", seed=1).collect())
    v = df.select("cell_id", F.coalesce("g", F.lit("n")).alias("g"), F.array((F.col("v") / 10), F.col("cell_id") % 13 * 1.0).alias("v"))
    exact = {r["g"]: r["e_distance"] for r in M.energy_to_control(v, "g", "v", F.col("g") == "n").collect()}
    capped = {r["g"]: r["e_distance"] for r in M.energy_to_control(v, "g", "v", F.col("g") == "n", most=400, key="cell_id").collect()}
    whole = {r["g"]: r["e_distance"] for r in M.energy_to_control(v, "g", "v", F.col("g") == "n", most=100_000, key="cell_id").collect()}
    assert set(exact) == set(capped) and abs(exact["hot"] - capped["hot"]) < 0.2 and all(np.isclose(exact[k], whole[k]) for k in exact)

"""Reports against plain Python: coverage, pools, bundles, snapshots, typed features, verdicts."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cytoloom.operators import evaluation as V, reports as RP


def test_coverage(spark):
    rows = [("in_dist", 1.0, 2.0, 1.0 + d, True) for d in (0.0, 3.0, -4.0, 4.5)] + [("in_dist", 1.0, 2.0, 99.0, False), ("xdonor", 0.0, 8.0, None, True), ("xdonor", 0.0, 8.0, 4.0, True)]
    df = spark.createDataFrame(rows, "origin string, mu_age double, sigma_age double, y_age double, age_mask boolean")
    got = {r["origin"]: r for r in RP.coverage_report(df, 4.0, 1.5).collect()}
    a, b = got["in_dist"], got["xdonor"]
    assert (a["n"], a["coverage"], a["abs_residual"], a["sigma_over_q_p50"], a["under_half_q"]) == (4, 0.75, 2.875, 0.75, 0.0)
    assert (b["n"], b["coverage"], b["sigma_over_q_p10"]) == (1, 1.0, 3.0)
    assert RP.coverage_report(df.limit(0), 4.0).count() == 0
    with pytest.raises(ValueError):
        RP.coverage_report(df, 0.0)


def test_pool_of_one_donor_is_no_pool(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0, True), ("a", 1.0, 1.0, True), ("b", 0.0, 1.0, False)], "donor string, mu_age double, y_age double, age_mask boolean")
    assert [tuple(r) for r in RP.pool_composition(df).collect()] == [("a", 2, 1.0, 1.0, False)]
    both = RP.pool_composition(df.withColumn("age_mask", F.lit(True))).orderBy("donor").collect()
    assert [(r["donor"], r["n"], r["share"], r["calibrated"]) for r in both] == [("a", 2, 2 / 3, True), ("b", 1, 1 / 3, True)]


def test_bundle(spark):
    rows = [(1, 10, "test", 0.5, 0.3), (1, 11, "calib", 0.8, 0.1), (1, 12, "train", 0.2, 0.2), (2, 13, "test", 0.25, 0.75), (2, 14, "train", 0.9, 0.05)]
    df = spark.createDataFrame(rows, "fold int, cell_id int, split string, p0 double, p1 double")
    df = df.withColumns({"mu_age": F.lit(0.0), "sigma_age": F.lit(1.0), "in_dist": F.lit(True), "y": F.lit(0), "y_age": F.lit(0.0), "age_mask": F.lit(True)})
    got = {(r["part"], r["arm"], r["cell_id"]): (r["p_safe"], r["p_loss"]) for r in RP.bundle(df, (1.2, -0.1), F.col("fold") == 2).collect()}
    assert {(p, c) for p, _, c in got} == {("test", 10), ("calib", 11), ("test", 13), ("pool", 13), ("pool", 14)}
    for _, cell, _, p0, p1 in rows:
        safe = 1 / (1 + math.exp(-(1.2 * math.log(p0 / (1 - p0)) - 0.1)))
        for part in ("pool", "calib", "test"):
            if (part, "raw", cell) in got:
                assert got[(part, "raw", cell)] == (p0, p1)
                assert got[(part, "calibrated", cell)] == pytest.approx((safe, p1 * (1 - safe) / (1 - p0)), abs=1e-12)


def test_level_shifts(spark, tmp_path):
    df = spark.createDataFrame([("a", "level_shift_model", 1.5), ("a", "n_cells", 3.0), ("b", "level_shift_model", None)], "fold string, metric string, value double")
    df.write.json(str(tmp_path / "s"))
    assert [tuple(r) for r in RP.level_shifts(spark, [str(tmp_path / "none"), str(tmp_path / "s")]).collect()] == [("a", 1.5)]
    assert RP.level_shifts(spark, [str(tmp_path / "none")]).count() == 0


def test_typed_features(spark):
    rows = [(1, [1.0, 2.0], [1, 0], None, [0.2, 0.4, 0.4]), (2, [0.0, 1.0], None, [0.5, 2.0], [1.0, 0.0, 0.0]), (3, [0.0, 1.0], None, None, [1.0, 0.0, 0.0]), (4, [0.0, 1.0], [1, 1], [9.0, 9.0], [0.0, 0.0, 1.0])]
    s = spark.createDataFrame(rows, "cell_id int, x array<double>, fp array<int>, tf array<double>, y_soft array<double>")
    s = s.withColumns({"cell_line": F.lit("L"), "scaffold_id": F.lit("S"), "log_dose": F.lit(0.1), "log_time": F.lit(2.0), "y_age": F.lit(1), "age_mask": F.lit(True)})
    splits = spark.createDataFrame([(1, "random", "val"), (2, "random", "val"), (3, "random", "val"), (4, "random", "test"), (4, "line", "val")], "cell_id int, regime string, split string")
    got = RP.gather_features(s, splits, "random", "val")
    assert dict(got.dtypes)["state"] == dict(got.dtypes)["perturbation"] == dict(got.dtypes)["dose_time"] == "array<float>"
    assert {(r["cell_id"], tuple(r["perturbation"]), r["y"]) for r in got.collect()} == {(1, (1.0, 0.0), 1), (2, (0.5, 2.0), 0)}
    assert RP.gather_features(s, splits, "line", "test").count() == 0


def test_fit_verdict(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 4.0, 10.0), (3, 7.5, 10.0), (4, 8.0, 10.0), (5, None, 9.0), (6, 5.0, None)], "fold int, train_donors double, test double")
    got = {r["fold"]: r["v"] for r in df.select("fold", V.fit_verdict(F.col("train_donors"), F.col("test")).alias("v")).collect()}
    assert got == {1: "MEMORIZING", 2: "PARTIAL", 3: "PARTIAL", 4: "CANNOT_FIT", 5: "PARTIAL", 6: "PARTIAL"}
    s = V.overfit_summary(df).first()
    assert (s["mean_train"], s["mean_test"], s["n_memorizing"], s["n_cannot_fit"], s["n"], s["verdict"]) == (5.125, 10.0, 1, 1, 4, "MIXED")
    assert V.overfit_summary(df.filter("fold IN (1, 4)")).first()["verdict"] == "MEMORIZING"
    assert V.overfit_summary(df.filter("fold IN (2, 4)")).first()["verdict"] == "CANNOT_FIT"
    none = V.overfit_summary(df.limit(0)).first()
    assert none["n"] == 0 and none["verdict"] is None


def test_held_out_pairs(spark):
    df = spark.createDataFrame([(g, float(v)) for g, v in ((i // 4, i) for i in range(12))], "g int, v double")
    fit = lambda train: (lambda m: lambda d: d.withColumn("p", F.lit(m)))(train.agg(F.avg("v").alias("m")).first()["m"])
    got = {(r["g"], r["p"]) for r in RP.held_out_pairs(df, "g", [0, 1, 2], fit, ["g", "p"]).collect()}
    assert got == {(0, 7.5), (1, 5.5), (2, 3.5)}


def test_shifts_and_control_gap(spark):
    rows = [("a", "x", 1, True, 1.0, True), ("a", "x", 1, True, 3.0, True), ("a", "x", 2, False, 5.0, True), ("a", "y", 1, True, 6.0, False), ("b", "z", 1, True, -2.0, True), ("b", "z", 1, False, 4.0, True)]
    rows += [("b", "z", 3, None, 9.0, True), ("b", "z", 3, True, None, True), ("c", "w", 1, False, 7.0, True), (None, None, None, True, 50.0, True)]
    df = spark.createDataFrame(rows, "dataset string, line string, day int, is_control boolean, d_age double, age_mask boolean")
    report = RP.shift_report(df, F.col("age_mask"))
    got = {(r["level"], r["dataset"], r["line"], r["day"]): (r["n_control"], r["mean_control"], r["n_treated"], r["mean_treated"]) for r in report.collect()}
    assert got["time", "a", "x", 1] == (2, 2.0, 0, None)
    assert got["line", "a", "x", None] == (2, 2.0, 1, 5.0)
    assert got["dataset", "b", None, None] == (1, -2.0, 1, 4.0)
    assert got["dataset", None, None, None] == (1, 50.0, 0, None)
    assert got["all", None, None, None] == (4, 13.0, 3, 16 / 3)
    assert ("line", "a", "y", None) not in got and len(got) == 14
    assert [tuple(r) for r in RP.control_gap(report, 4.0).collect()] == [("b", "a", 4.0, "FAIL")]
    assert RP.control_gap(report, 4.1).first()["verdict"] == "PASS"
    assert RP.control_gap(report.filter("dataset = 'a'")).count() == 0
    assert RP.shift_report(df.limit(0)).count() <= 1 and RP.control_gap(RP.shift_report(df.limit(0))).count() == 0

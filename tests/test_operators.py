"""Operators on small tables with values worked out by hand or by numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.functions.columns import normal_cdf, sanitize_id, softmax, unit_hash
from cytoloom.operators import baselines as B, expression as X, metrics as M, perturbation as P, quality as Q, scoring as S, similarity as N, splits as D, statistics as T, timecourse as C
from cytoloom.sources import matrices as R, samples as IO


def one(df):
    return df.first().asDict()


def test_functions(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "a b//c_", 1.96)], "x double, y double, z double, s string, q double")
    p = one(df.select(*(c.alias(f"p{i}") for i, c in enumerate(softmax(F.col("x"), F.col("y"), F.col("z")))), sanitize_id(F.col("s")).alias("s"), normal_cdf(F.col("q")).alias("phi"), unit_hash("1", F.col("s")).alias("u")))
    e = np.exp([1, 2, 3])
    assert np.allclose([p["p0"], p["p1"], p["p2"]], e / e.sum())
    assert p["s"] == "a_b_c" and abs(p["phi"] - 0.9750021) < 1e-6 and 0 <= p["u"] < 1
    with pytest.raises(ValueError):
        softmax(F.col("x"), tau=0)


def test_qc_counts_empty_cells(spark):
    expr = spark.createDataFrame([("a", "MT-1", 2.0), ("a", "G", 6.0), ("b", "G", 0.0)], "cell_id string, gene string, value double")
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell_id string")
    got = {r["cell_id"]: (r["total"], r["n_genes"], r["mito_fraction"]) for r in Q.qc_metrics(expr, cells).collect()}
    assert got == {"a": (8.0, 2, 0.25), "b": (0.0, 0, 0.0), "c": (0.0, 0, 0.0)}
    kept = Q.qc_filter(Q.qc_metrics(expr, cells), 1, 0.25)
    assert [r["cell_id"] for r in kept.collect()] == ["a"]


def _sample(**over):
    row = dict(cell_id="s", X=[0.0] * 8, u_modality="chem", u_chem_fp=[0] * 2048, u_gene_emb=None, u_tf_emb=None, dose_time=[1.0, 1.0], y_cls=[0.8, 0.1, 0.1], y_age=-3.0, age_mask=True, sig_scores=[0.0, 0.0, 0.0], cell_line="L", pert_id="P", scaffold_id="c1", source="S")
    return row | over


@pytest.mark.parametrize("over, rules", [({}, set()), ({"X": []}, {"x_empty"}), ({"X": [float("nan")]}, {"x_finite"}), ({"dose_time": [1.0]}, {"dose_time_size"}), ({"y_cls": [0.5, 0.1, 0.1]}, {"y_cls_sum"}), ({"y_age": None}, {"age_mask"}), ({"u_chem_fp": None}, {"fingerprint"}), ({"u_chem_fp": [2] * 2048}, {"fingerprint_bits"}), ({"scaffold_id": ""}, {"scaffold"}), ({"u_modality": "tf", "u_chem_fp": None}, {"tf_embedding"})])
def test_sample_rules(spark, over, rules):
    from cytoloom.sources.schemas import SAMPLES

    df = spark.createDataFrame([tuple(_sample(**over)[f.name] for f in SAMPLES.fields)], SAMPLES)
    assert {r["rule"] for r in Q.validate_samples(df).collect()} == rules


def test_control_fallbacks(spark):
    rows = [("a", 0, "x", True, 1.0), ("b", 0, "x", True, 3.0), ("c", 0, "x", False, 6.0), ("d", 0, "y", False, 4.0)]
    df = spark.createDataFrame(rows, "cell_id string, chunk_id int, cell_line string, is_control boolean, v double")
    z = {r["cell_id"]: r["z"] for r in X.relative_to_controls(df, {"v": "z"}).collect()}
    assert z["c"] == 4.0 and z["d"] == 2.0  # the line without controls uses the chunk's
    base = {r["cell_id"]: r["b"] for r in X.with_baseline(df, "v", "b").collect()}
    assert base["c"] == 2.0 and base["d"] == 4.0
    one = spark.createDataFrame([("a", 0, "x", True, 1.0), ("b", 0, "x", False, 3.0), ("c", 0, "y", False, 6.0), ("d", 1, "z", False, 2.0), ("e", 1, "z", False, 4.0)], df.schema)
    z = {r["cell_id"]: r["z"] for r in X.relative_to_controls(one, {"v": "z"}).collect()}
    assert z == {"a": 0.0, "b": 2.0, "c": 5.0, "d": -1.0, "e": 1.0}  # a single control of the chunk counts, without a spread; without any, all cells do


def test_harmonizer_cancels_an_offset(spark):
    rng = np.random.default_rng(0)
    base = rng.uniform(1, 3, (20, 4))
    rows, cells = [], []
    for d, shift in ((0, 0.0), (1, 5.0)):
        for i in range(20):
            cid = f"{d}-{i}"
            cells.append((cid, d, True))
            rows += [(cid, f"g{g}", float(base[i, g] + shift)) for g in range(4)]
    expr, cells = spark.createDataFrame(rows, "cell_id string, gene string, value double"), spark.createDataFrame(cells, "cell_id string, dataset_id int, is_control boolean")
    z = X.harmonize(expr, cells, X.fit_harmonizer(expr, cells)).toPandas().pivot(index="cell_id", columns="gene", values="z")
    assert np.allclose(z.loc[[f"0-{i}" for i in range(20)]].to_numpy(), z.loc[[f"1-{i}" for i in range(20)]].to_numpy(), atol=1e-6)


@pytest.mark.parametrize("pert, want", [("OSKM", "POU5F1+SOX2+KLF4+MYC"), ("sox2 + MYC", "SOX2+MYC"), ("KM", "KLF4+MYC"), ("NANOG", "NANOG"), ("control", ""), ("junk!", ""), (None, "")])
def test_factors(spark, pert, want):
    df = spark.createDataFrame([(pert,)], "p string")
    assert one(df.select(F.array_join(P.factors_of(F.col("p")), "+").alias("f")))["f"] == want


def test_obs_and_union(spark):
    df = spark.createDataFrame([("1", "DMSO", 5.0), ("2", "drug", 2.0)], "id string, what string, dose double")
    got = {r["cell_id"]: r for r in P.normalise_obs(df, {"cell_id": "id", "pert_id": "what", "dose_um": "dose"}, ["dmso"]).collect()}
    assert got["1"]["is_control"] and got["1"]["dose_um"] == 0 and got["1"]["scaffold_id"] == "CONTROL" and got["2"]["scaffold_id"] == "drug"
    c = spark.createDataFrame([(1,)], "chunk_id int")
    with pytest.raises(ValueError):
        P.union_sources(c, c)


@pytest.mark.parametrize("n, fracs", [(10, [0.7, 0.1, 0.1, 0.1]), (4, [0.97, 0.01, 0.01, 0.01]), (3, [0.5, 0.5, 0.0, 0.0]), (101, [0.6, 0.2, 0.1, 0.1])])
def test_group_counts(n, fracs):
    c = D.group_counts(n, fracs)
    assert sum(c) == n and (n < 4 or min(c) >= 1)


def test_splits_are_disjoint(spark):
    cells = spark.range(2000).select(F.col("id").alias("cell_id"), (F.col("id") % 37).cast("string").alias("scaffold_id"), (F.col("id") % 11).alias("cell_line"), F.lit("p").alias("pert_id"))
    for regime, col in (("scaffold", "scaffold_id"), ("cell_line", "cell_line")):
        both = cells.join(D.REGIMES[regime](cells, [0.7, 0.1, 0.1, 0.1], 3), "cell_id")
        assert both.groupBy(col).agg(F.count_distinct("split").alias("k")).filter("k > 1").count() == 0
        assert both.count() == 2000
    b = cells.join(D.both_split(cells, [0.6, 0.1, 0.1, 0.2], 3), "cell_id")
    seen = b.filter("split IN ('train', 'val', 'calib')").select("scaffold_id").distinct().join(b.filter("split = 'test'"), "scaffold_id").filter("cell_line IS NOT NULL")
    assert b.filter("split = 'drop'").count() > 0 and seen.count() >= 0
    with pytest.raises(ValueError):
        D.make_splits(cells, ["nope"], [1, 0, 0, 0], 1)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0.9, 1), (0, 0.8, 0), (0, 0.7, 1), (0, 0.7, 0), (1, 0.5, 1)], "g int, p double, y int")
    au = {r["g"]: r["auroc"] for r in M.auroc(df, ["g"], "p", "y").collect()}
    assert abs(au[0] - (2 + 0 + 0.5) / 4) < 1e-12 and au[1] is None
    pr = {r["g"]: r["prauc"] for r in M.prauc(df, ["g"], "p", "y").collect()}
    assert abs(pr[0] - (0.5 * 1 + 0.5 * 0.5)) < 1e-12 and pr[1] == 1
    b = spark.createDataFrame([(0.7, 0.2, 0.1, 0)], "p0 double, p1 double, p2 double, y int")
    assert abs(one(b.agg(M.brier(["p0", "p1", "p2"], "y").alias("b")))["b"] - 0.14) < 1e-12
    s = spark.createDataFrame([(0, float(i), float(-i)) for i in range(5)] + [(1, 1.0, float(i)) for i in range(5)], "g int, a double, b double")
    rho = {r["g"]: r["spearman"] for r in M.spearman(s, ["g"], "a", "b").collect()}
    assert abs(rho[0] + 1) < 1e-12 and rho[1] is None


def test_efficacy_cases(spark):
    rows = [("A", 0.92, 0.05, -6.0, 1.0, True), ("B", 0.60, 0.35, -10.0, 1.0, True), ("C", 0.95, 0.03, -15.0, 1.0, True), ("D", 0.95, 0.03, -2.0, 3.0, True), ("E", 0.95, 0.03, -15.0, 1.0, False)]
    df = S.efficacy(spark.createDataFrame(rows, "cell_id string, s double, p_loss double, mu_age double, sigma_age double, in_dist boolean"))
    got = {r["cell_id"]: r for r in df.collect()}
    assert got["A"]["status"] == got["C"]["status"] == S.APPROVED and got["C"]["res"] > got["A"]["res"]
    assert got["B"]["status"] == S.REJECTED_UNSAFE and got["D"]["status"] == S.REJECTED_NO_REJUVENATION and got["D"]["res"] == 0
    assert got["E"]["status"] == S.REJECTED_OOD and got["E"]["res"] == 0
    top = S.rank_candidates(df.withColumn("score", F.col("res")), 2).collect()
    assert [r["cell_id"] for r in top] == ["C", "A"]
    with pytest.raises(ValueError):
        S.ScoreParams(k=0.5)


def test_conformal_and_temperature(spark):
    r = spark.createDataFrame([(0, float(i)) for i in range(1, 10)], "g int, abs_residual double")
    q = {x["level"]: (x["q"], x["attainable"]) for x in S.fit_conformal(r, ["g"], [0.5, 0.95]).collect()}
    assert q[0.5] == (5.0, True) and q[0.95] == (9.0, False)
    rng = np.random.default_rng(0)
    rows = [(8.0, -4.0, -4.0, int(0 if rng.random() > 0.15 else 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int")
    t = S.fit_temperature(df, ["a", "b", "c"], "y")
    loss = {x["t"]: x["nll"] for x in S.temperature_grid(df, ["a", "b", "c"], "y", [1.0, t]).collect()}
    assert t > 1 and loss[t] < loss[1.0]


def test_platt_recovers_a_shift(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * z - 0.5)))).astype(float)
    df = spark.createDataFrame([(float(1 / (1 + math.exp(-a))), float(b)) for a, b in zip(z, y)], "p double, y double")
    a, b = B.platt_on_logit(df, "p", "y")
    assert abs(a - 2) < 0.25 and abs(b + 0.5) < 0.25
    assert B.platt_on_logit(df.filter("y = 1"), "p", "y") == (1.0, 0.0)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.2] + [0, 3, -1]
    y = x @ [1.0, -0.5, 4.0] + rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    got = B.ridge(df, ["a", "b", "c"], "y", 10.0)(df).toPandas()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(got.prediction, z @ w + y.mean(), atol=0.05)


def test_statistics(spark):
    d = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 3.0), ("k", 1.0)], "metric string, diff double")
    ci = {r["metric"]: r for r in T.paired_ci(d, ["metric"]).collect()}
    assert abs(ci["m"]["ci_low"] - (2 - 4.303 / math.sqrt(3))) < 1e-9 and ci["k"]["ci_low"] is None
    lin = spark.range(10001).select((F.col("id") / 10000).alias("x"))
    assert abs(one(T.bar_pass(lin, [], 0.25))["pass_rate"] - 0.25) < 1e-3
    few = spark.createDataFrame([(i, 0.5, 1) for i in range(5)], "cell_id int, p double, y int")
    assert one(T.pooled_ece(few, "p", "y", 10, 5, 1))["ece"] is None


def test_timecourse(spark):
    rows = [("h", t, float(-((t - 3) ** 2))) for t in range(7)] + [("u", t, float((t - 3) ** 2)) for t in range(7)] + [("l", t, 2.0 * t + (0.01 if t % 2 else 0.0)) for t in range(7)]
    df = spark.createDataFrame(rows, "donor string, t int, value double").withColumn("value", F.col("value") + 0.001 * (F.col("t") % 2))
    shape = {r["donor"]: r["shape"] for r in C.trajectory_shape(df).collect()}
    assert shape == {"h": "HUMP", "u": "U", "l": "monotonic"}
    assert C.forward_pairs(df.filter("donor = 'h'")).count() == 21


def test_knn_fills_and_empty_sets(spark):
    q = spark.createDataFrame([("a", [1, 2]), ("e", [])], "query_id string, bits array<int>")
    r = spark.createDataFrame([("x", [1, 2]), ("y", [9]), ("z", [])], "ref_id string, bits array<int>")
    got = {(x["query_id"], x["ref_id"]): x["distance"] for x in N.jaccard_knn(q, r, 2).collect()}
    assert got == {("a", "x"): 0.0, ("a", "y"): 1.0, ("e", "z"): 0.0, ("e", "x"): 1.0}


def test_readers(spark, tmp_path):
    (tmp_path / "a_matrix.mtx").write_text("%%MatrixMarket\n% c\n4 3 6\n1 1 5\n2 1 3\n3 1 2\n1 2 4\n2 2 1\n1 3 9\n1 3 1\n")
    m = R.read_mtx(spark, str(tmp_path / "a_matrix.mtx"))
    assert {(r["gene_row"], r["barcode"]): r["value"] for r in m.collect()}[(1, 3)] == 10.0 and m.count() == 6
    (tmp_path / "a_features.tsv").write_text("ENSG1\tGENEA\nENSG2\tGENEB\nENSG4\n")
    assert [(r["gene_row"], r["symbol"]) for r in R.read_features(spark, str(tmp_path / "a_features.tsv")).orderBy("gene_row").collect()] == [(1, "GENEA"), (2, "GENEB"), (3, "ENSG4")]
    assert R.discover(spark, str(tmp_path), r"^(.*)_matrix\.mtx$", r"^(.*)_features\.tsv$").count() == 1
    with pytest.raises(ValueError):
        R.discover(spark, str(tmp_path), r"^(.*)_matrix\.mtx$", r"^(.*)_absent\.tsv$")
    head = ["symbol"] + [f"n{i}" for i in range(11)] + ["S1", "S2"]
    rows = [["COL1A1"] + ["-"] * 11 + ["3", "1"], ["FN1"] + ["-"] * 11 + ["2", "0"], ["FN1"] + ["-"] * 11 + ["1", "-1"]]
    (tmp_path / "wide.tsv").write_text("\n".join("\t".join(r) for r in [head, *rows]))
    w = {(r["gene"], r["sample"]): r["value"] for r in R.read_wide_log2(spark, str(tmp_path / "wide.tsv")).collect()}
    assert w[("COL1A1", "S1")] == 7.0 and w[("FN1", "S1")] == 3.0 and len(w) == 4
    (tmp_path / "series.txt").write_text('!Sample_title\t"N2_d11"\t"O1_d3"\n!Sample_characteristics_ch1\t"age: 20"\t"age: 60"\n!Sample_characteristics_ch1\t"age: 99"\t"type: fib"\n')
    s = {r["donor"]: r["characteristics"] for r in R.read_series(spark, str(tmp_path / "series.txt")).collect()}
    assert s == {"N2": {"age": "20"}, "O1": {"age": "60", "type": "fib"}}
    (tmp_path / "vec.txt").write_text("G1 1 2.5\nG2 0 -1\n")
    assert {r["gene"]: r["vec"] for r in R.read_gene_vectors(spark, str(tmp_path / "vec.txt")).collect()} == {"G1": [1.0, 2.5], "G2": [0.0, -1.0]}


def test_samples_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), ("c", 2, 3.0)], "cell_id string, chunk_id int, y double")
    IO.write_samples(df, str(tmp_path / "s"))
    IO.write_samples(df.filter("chunk_id = 2").withColumn("y", F.lit(9.0)), str(tmp_path / "s"))
    assert sorted(r["y"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1.0, 2.0, 9.0]
    with pytest.raises(ValueError):
        IO.write_samples(df.limit(0), str(tmp_path / "s"))
    new = IO.update_column(df, spark.createDataFrame([("a", float("nan")), ("b", 5.0), ("c", 6.0)], "cell_id string, y double"), "y")
    assert {r["cell_id"]: r["y"] for r in new.collect()} == {"a": None, "b": 5.0, "c": 6.0}
    with pytest.raises(ValueError):
        IO.update_column(df, spark.createDataFrame([("a", 1.0)], "cell_id string, y double"), "y")


def test_clock_matches_closed_form(spark):
    from cytoloom.operators import clock as K

    rng = np.random.default_rng(0)
    x = rng.poisson(2.0, (30, 12)).astype(float)
    y = 40 + 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 1, 30)
    expr = spark.createDataFrame([(i, f"g{g:02d}", float(x[i, g])) for i in range(30) for g in range(12) if x[i, g]], "sample int, gene string, value double")
    ages = spark.createDataFrame([(i, float(y[i])) for i in range(30)], "sample int, age double")
    w, b, m = K.fit_clock(expr, ages)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + m["alpha"] * np.eye(12), xc.T @ yc)
    got = {r["gene"]: r["weight"] for r in w.collect()}
    assert np.allclose([got[f"g{g:02d}"] for g in range(12)], want, atol=1e-8)
    assert abs(b - (y.mean() - x.mean(0) @ want)) < 1e-6 and m["cv_pearson"] > 0.5
    with pytest.raises(ValueError):
        K.fit_clock(expr, ages.filter("sample < 3"))


def test_external_model(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2.0)
    out = B.external(df, lambda p: p.assign(y=p.x + 1)[["id", "y"]], "id long, y double")
    assert {r["id"]: r["y"] for r in out.collect()} == {i: 2.0 * i + 1 for i in range(5)}

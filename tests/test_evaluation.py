"""Evaluation operators against plain Python, where the SQL twins leave cases out; sources that no query reads."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import evaluation as V, expression as X, metrics as M, similarity as N, splits as S
from cytoloom.sources import matrices, samples as IO


def long(spark, states, group="g"):
    rows = [(group, i, f"g{k}", float(v)) for i, s in enumerate(states) for k, v in enumerate(s) if v]
    return spark.createDataFrame(rows, "grp string, item int, gene string, value double")


def test_nearest_states(spark):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 3, (6, 8)) * rng.normal(1, 1, (6, 8))
    p = t + rng.normal(0, 1.5, t.shape) * (rng.random(t.shape) < 0.5)
    t[:, 0] = p[:, 0] = 1.0  # every state has an entry
    want = [int(np.argmin(np.abs(p - x).sum(1))) for x in t]
    got = {r["item"]: r["match"] for r in V.nearest_state(long(spark, t), long(spark, p), ["grp"]).collect()}
    assert [got[i] for i in range(6)] == want
    share = V.pds(long(spark, t), long(spark, p), ["grp"]).first()["pds"]
    assert abs(share - np.mean([w == i for i, w in enumerate(want)])) < 1e-12


def test_states_that_share_nothing(spark):
    t = long(spark, [[1, 0, 0, 0]])
    p = long(spark, [[0, 5, 0, 0], [0, 0, 2, 0], [0, 0, 0, 2]])
    r = V.nearest_state(t, p, ["grp"]).first()
    assert (r["match"], r["distance"]) == (1, 3.0)  # the smallest, the first on ties


def test_shift_counts_absent_entries(spark):
    expr = spark.createDataFrame([("c", "A", 4.0), ("x", "A", 6.0), ("x", "B", 1.0)], "cell_id string, gene string, value double")
    cells = spark.createDataFrame([("x", "p"), ("y", "p")], "cell_id string, pert_id string")
    controls = spark.createDataFrame([("c",)], "cell_id string")
    got = {r["gene"]: r["shift"] for r in V.mean_shift(expr, cells, "pert_id", controls).collect()}
    assert got == {"A": (2 + 4) / 2, "B": 0.5}


@pytest.mark.parametrize("offsets, status", [([], "NOT_ESTIMABLE"), ([1.0, 2.0], "INDETERMINATE"), ([5.0, 5.1, 4.9, 5.0], "BATCH_EFFECT"), ([5.0, -5.0, 1.0, -1.0], "NO_BATCH_EFFECT")])
def test_batch_offsets(spark, offsets, status):
    r = V.batch_offset(spark.createDataFrame([(x,) for x in offsets], "offset double")).first()
    assert (r["status"], r["n"]) == (status, len(offsets))
    if status == "BATCH_EFFECT":
        half = 3.182 * np.std(offsets, ddof=1) / 2
        assert np.isclose(r["ci_low"], np.mean(offsets) - half) and np.isclose(r["ci_high"], np.mean(offsets) + half)


@pytest.mark.parametrize("offsets, cv, status", [([1.0, 2.0], 1.0, "CANNOT_VERIFY"), ([1.0] * 5, 1.0, "CANNOT_VERIFY"), ([0.0, 100.0, 200.0, 300.0, 400.0, 500.0], 1.0, "BASELINE_MINOR"), ([0.0, 1.0, 2.0, 3.0, 4.0], 100.0, "BASELINE_DOMINATES"), ([0.0, 10.0, 20.0, 30.0, 40.0], 12.0, "INDETERMINATE")])
def test_variance_shares(spark, offsets, cv, status):
    df = spark.createDataFrame([("g", x) for x in offsets], "g string, offset double")
    assert V.variance_share(df, ["g"], cv).first()["status"] == status


def test_donor_that_owns_the_pool(spark):
    df = spark.createDataFrame([(d, 1.0, 3.0, True, 0.5, 0.7) for d in "aaab"], "donor string, mu_age double, y_age double, age_mask boolean, sigma_age double, sigma_mc double")
    assert {r["donor"]: (r["n"], r["mae"], r["imbalanced"]) for r in V.donor_error_scale(df).collect()} == {"a": (3, 2.0, True), "b": (1, 2.0, False)}


def test_level_correction_leaves_the_references_out(spark):
    rng = np.random.default_rng(1)
    rows = [("a", i, float(10 + y + 0.1 * rng.normal()), float(y), float(i % 5)) for i, y in enumerate(rng.normal(0, 5, 40))]
    df = spark.createDataFrame(rows, "fold string, cell_id int, mu_age double, y_age double, t double")
    got = V.level_correction(df, [1, 5], 4, 3).collect()
    assert {r["k"] for r in got} == {1, 5} and all(r["sc_mae"] < 0.5 < 9 < r["base_mae"] for r in got)
    assert all(r["passed"] == (r["n_reduced"] >= 1) for r in V.correction_verdict(spark.createDataFrame(got), 1).collect())
    assert V.level_correction(df.limit(3), [1], 2, 3).count() == 0  # too few rows beside the reference


def test_small_folds_have_no_card(spark):
    cols = "cell_id int, fold int, s double, p_loss double, mu_age double, sigma_age double, in_dist boolean, mu_ridge double, s_platt double, y int, y_age double, age_mask boolean"
    rows = [(i, i // 4, 0.5 + 0.1 * (i % 4), 0.1, -5.0 - i, 1.0, True, -4.0, 0.6, 0, -6.0 - i, True) for i in range(6)]
    got = V.scorecard(spark.createDataFrame(rows, cols), V.S.ScoreParams(tau_safe=0.4, w=0.05), 9.5).collect()
    assert {r["fold"] for r in got} == {0} and len(got) == 19
    one = {r["metric"]: r["value"] for r in got}
    assert one["fate_prauc"] is None and one["n_cells"] == 4.0  # one class only


def test_fitted_covariance(spark):
    x = np.random.default_rng(2).normal(size=(200, 4)) @ np.random.default_rng(5).normal(size=(4, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    m = N.fit_ood(df, "v")
    p = np.linalg.inv(np.cov(x.T) + 1e-3 * np.eye(4))
    assert np.allclose(m["precision"], p) and np.allclose(m["mean"], x.mean(0))
    d2 = np.einsum("ij,jk,ik->i", x - x.mean(0), p, x - x.mean(0))
    assert np.isclose(m["threshold"], np.quantile(d2, 0.99))


@pytest.mark.parametrize("block", [3, 1024])
def test_distances_in_blocks(spark, block):
    x = np.random.default_rng(4).normal(size=(23, 3))
    df = spark.createDataFrame([("g", i, [float(v) for v in r]) for i, r in enumerate(x)], "g string, id int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.isclose(M.mean_distance(df, df, ["g"], block).first()["d"], d.mean())
    near = N.euclidean_knn(df.withColumnRenamed("id", "query_id"), df.select("g", F.col("id").alias("ref_id"), F.col("v").alias("ref_v")), 4, ["g"], block).collect()
    got = {i: {r["ref_id"] for r in near if r["query_id"] == i} for i in range(23)}
    assert all(got[i] == set(np.argsort(d[i])[:4].tolist()) for i in range(23))


def test_regimes_need_their_lines(spark):
    cells = spark.createDataFrame([(i, i % 3, "s", "p") for i in range(9)], "cell_id int, cell_line int, scaffold_id string, pert_id string")
    with pytest.raises(ValueError):
        S.make_splits(cells, ["holdout"], [0.7, 0.1, 0.1, 0.1], 1)
    got = S.make_splits(cells, ["holdout", "line_holdout"], [0.7, 0.1, 0.1, 0.1], 1, lines=[2], line=1, share=1.0)
    assert {(r["regime"], r["cell_id"] % 3) for r in got.filter("split = 'test'").collect()} == {("holdout", 2), ("line_holdout", 1)}


def test_masked_sources(spark):
    df = spark.createDataFrame([("A549",), ("N2",), (None,)], "source string")
    assert [r[0] for r in df.select(X.age_valid(F.col("source"), ["A549"])).collect()] == [False, True, True]


def test_samples_and_age_matrix(spark, tmp_path):
    from cytoloom.sources.schemas import SAMPLES

    row = ("s", [0.5], "chem", [0, 1], None, None, [1.0, 2.0], [1.0, 0.0, 0.0], -3.0, True, [0.0, 0.0, 0.0], "L", "P", "c", "S")
    spark.createDataFrame([row], SAMPLES).write.parquet(str(tmp_path / "s"))
    back = IO.read_samples(spark, str(tmp_path / "s"))
    assert back.schema.fieldNames() == SAMPLES.fieldNames() and back.first()["u_chem_fp"] == [0, 1]
    meta = spark.createDataFrame([("a", 30.0), ("b", 41.0)], "sample string, age double")
    rows = matrices.read_age_matrix(spark.createDataFrame([("G1", 1, 0), ("G2", 2, 5)], "gene string, a int, b int"), meta, "rows")
    cols = matrices.read_age_matrix(spark.createDataFrame([("a", 1, 2), ("b", 0, 5)], "sample string, G1 int, G2 int"), meta, "columns")
    want = {("a", "G1", 1.0, 30.0), ("a", "G2", 2.0, 30.0), ("b", "G1", 0.0, 41.0), ("b", "G2", 5.0, 41.0)}
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in cols.select("sample", "gene", "value", "age").collect()} == want
    with pytest.raises(ValueError):
        matrices.read_age_matrix(spark.createDataFrame([("G1", 1)], "gene string, c int"), meta, "rows")


def test_calibration_policy_reports_both(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(0.05, 0.95, 400)
    rows = [("xdonor" if i % 4 == 0 else "in_dist", float(x), float(rng.random() < x**2)) for i, x in enumerate(p)]
    got = {r["fitted_on"]: r for r in V.calibration_policy(spark.createDataFrame(rows, "origin string, p double, y double"), "p", "y").collect()}
    assert (got["all"]["n"], got["pool"]["n"]) == (400, 100) and all(0 <= r["safe_ece"] < 0.2 for r in got.values())


def test_sketches_are_near_the_exact_quantiles(spark):
    from cytoloom.operators import scoring as C

    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") % 997).cast("double").alias("abs_residual"), F.lit(2.0).alias("s"))
    exact, near = (C.fit_conformal(df, ["g"], [0.5, 0.9], approx=a).orderBy("level").collect() for a in (False, True))
    assert [abs(a["q"] - b["q"]) <= 2 and a["attainable"] == b["attainable"] for a, b in zip(exact, near)] == [True, True]
    one, two = (C.sigma_scale(df, ["g"], "abs_residual", "s", approx=a).first()["sigma_scale"] for a in (False, True))
    assert abs(one - two) < 0.02 * one


def test_sources_by_name(spark):
    from cytoloom.sources.registry import SOURCES, fetch_all, source

    one = SOURCES["tables"](spark.createDataFrame([("1", "a"), ("2", "b")], "chunk_id string, cell_id string"), spark.createDataFrame([("a", "G", 1.0), ("z", "G", 2.0)], "cell_id string, gene string, value double"))
    two = SOURCES["tables"](spark.createDataFrame([("3", "c")], "chunk_id string, cell_id string"), spark.createDataFrame([("c", "H", 3.0)], "cell_id string, gene string, value double"))
    cells, expr = fetch_all(spark, [one, two])
    assert sorted(r["cell_id"] for r in cells.collect()) == ["a", "b", "c"] and sorted(r["cell_id"] for r in expr.collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        fetch_all(spark, [one, one])
    with pytest.raises(ValueError):
        source("tables")(object)


def test_counts_must_match_their_rows(spark):
    from cytoloom.operators import perturbation as P

    rows = spark.createDataFrame([("a", 2), ("a", 1), ("b", 9)], "d string, t int")
    got = P.label_rows(rows, spark.createDataFrame([("a", 2), ("b", 1)], "d string, n long"), "d", "n", "t")
    assert {(r["d"], r["t"], r["i"]) for r in got.collect()} == {("a", 1, 1), ("a", 2, 2), ("b", 9, 1)}
    for wrong in ([("a", 3), ("b", 1)], [("a", 2)], [("a", 2), ("b", 1), ("c", 1)]):
        with pytest.raises(ValueError):
            P.label_rows(rows, spark.createDataFrame(wrong, "d string, n long"), "d", "n", "t")


def test_leaving_donors_out_needs_two(spark):
    rows = spark.createDataFrame([(i, "bulk" if i < 90 else "a", "train") for i in range(100)], "cell_id int, donor string, split string")
    with pytest.raises(ValueError):
        S.inner_lodo(rows)


def test_panels_that_differ(spark):
    from cytoloom.operators.quality import check_panel_hash

    rows = [("x", 0, "A"), ("x", 1, "B"), ("y", 0, "A"), ("y", 1, "B"), ("z", 0, "B"), ("z", 1, "A")]
    df = spark.createDataFrame(rows, "source string, pos int, gene string")
    assert not check_panel_hash(df).first()["agree"] and check_panel_hash(df.filter("source <> 'z'")).first()["agree"]


def test_kernel_ridge_bends(spark):
    from cytoloom.operators import baselines as B

    x = np.linspace(-3, 3, 120)
    df = spark.createDataFrame([(float(v), float(np.sin(2 * v))) for v in x], "x double, y double")
    err = {n: B.REGRESSORS[n](df, ["x"], "y")(df).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] for n in ("ridge", "kernel")}
    assert err["kernel"] < 0.5 * err["ridge"]


def test_gates_ties_and_nulls(spark):
    from cytoloom.operators import statistics as ST

    rows = [
        (0, "model", 0.5, 2.0), (0, "a", 0.5, 3.0),  # a tie in prauc is not beaten
        (1, "model", None, 2.0), (1, "a", None, 3.0), (1, "b", None, None),  # a null never passes
        (2, "model", 0.6, None), (2, "a", 0.5, 3.0),  # an error that is missing is not compared
        (3, "model", 0.6, 3.0), (3, "a", None, None),
        (4, "model", 0.6, 3.0), (4, "a", 0.5, 3.0),  # a tie in mae is no loss
        (5, "model", 0.6, 3.1), (5, "a", 0.5, 3.0),
    ]
    df = spark.createDataFrame(rows, "regime int, estimator string, prauc double, mae double").withColumns({c: F.lit(v) for c, v in (("ece", 0.01), ("coverage", 0.9), ("spearman", 0.4))})
    assert {r["regime"]: r["beats_all"] for r in ST.gates(df).collect()} == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False}


def test_equal_estimators_tie_in_the_last_digit(spark):
    """The same scores in another order of rows and partitions are a tie, not a win."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(3), 400)
    rows = [(0, e, i, *map(float, p[i]), int(rng.integers(0, 3)) if e == "model" else None, float(i % 7)) for e in ("model", "same") for i in range(400)]
    y = {i: r for (_, e, i, *_, r, _) in rows if e == "model"}
    df = spark.createDataFrame([(*r[:6], y[r[2]], *r[7:]) for r in rows], "regime int, estimator string, cell_id int, p0 double, p1 double, p2 double, y int, mu_age double")
    df = df.withColumns({"sigma_age": F.lit(1.0), "in_dist": F.lit(True), "y_age": F.col("mu_age") * 1.1, "age_mask": F.lit(True)})
    mixed = df.filter("estimator = 'model'").repartition(7).unionByName(df.filter("estimator = 'same'").orderBy(F.desc("cell_id")))
    from cytoloom.operators import scoring as C

    e = V.evaluate(mixed, ["p0", "p1", "p2"], 9.5, C.ScoreParams())
    a, b = e.orderBy("estimator").collect()
    assert a["prauc"] == b["prauc"] and a["mae"] == b["mae"]


def test_near_ties_of_labels_take_the_first(spark):
    from cytoloom.functions.columns import hard_label

    y = spark.createDataFrame([([0.4, 0.4 + 1e-12, 0.2],), ([0.1, 0.2, 0.7],), ([0.3, 0.4, 0.3],)], "y array<double>")
    assert [r[0] for r in y.select(hard_label(F.col("y"))).collect()] == [0, 2, 1]


@pytest.mark.parametrize("block,cells", [(7, 50), (1024, 1 << 20)])
def test_blocks_keep_the_nearest_only(spark, monkeypatch, block, cells):
    """A pair of blocks gives k refs of a query, not its pairs: many ties, copies, gaps, two sizes of vectors and ids of text against plain Python."""
    import math

    monkeypatch.setattr(N, "CELLS", cells)
    rng = np.random.default_rng(8)
    refs = [("g" if i % 5 else None, f"r{i % 37}-{i}", [float(v) for v in rng.integers(-2, 3, 3)]) for i in range(150)] + [("g", f"c{i}", [9.0, 9.0, 9.0]) for i in range(40)]
    refs += [("g", "n", None), ("g", "m", [1.0, None, 0.0]), ("g", "i", [float("inf"), 0.0, 0.0]), ("g", "s", [1.0, 2.0])]
    queries = [("g", i, v) for i, (_, _, v) in enumerate(refs) if i % 3 == 0 or v is None or len(v) != 3] + [("h", 900, [0.0, 0.0, 0.0])]
    q, r = spark.createDataFrame(queries, "g string, query_id int, v array<double>"), spark.createDataFrame(refs, "g string, ref_id string, ref_v array<double>")
    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    want = {}
    for g, i, v in queries:
        near = sorted((math.dist(v, w), o) for h, o, w in refs if g == h and whole(v) and whole(w) and len(v) == len(w))[:4]
        want |= {i: [o for _, o in near]} if near else {}
    got = {}
    for x in N.euclidean_knn(q, r, 4, ["g"], block).orderBy("query_id", "distance", "ref_id").collect():
        got.setdefault(x["query_id"], []).append(x["ref_id"])
    assert got == want
    met = N._in_blocks(q.filter(N._complete("v")), r.filter(N._complete("ref_v")), ["g"], 1024, 4)
    assert met.groupBy("query_id").count().agg(F.max("count")).first()[0] == 4


def test_near_copies_cost_no_more_than_other_rows():
    """Where a product of matrices cannot tell rows apart, not every pair is picked and measured by itself; rows and distances are those of plain sums."""
    import time

    rng = np.random.default_rng(6)
    one = rng.normal(size=(1, 64))
    apart, near = rng.normal(size=(1024, 64)), one + rng.normal(size=(1024, 64)) * 1e-8
    mixed = np.concatenate([near[:300], apart[:300]])

    def took(x):
        times = []
        for _ in range(3):
            began = time.thread_time()
            N._least(x, x, 4)
            times.append(time.thread_time() - began)
        return min(times)

    for x in (near, mixed, mixed + 1e6, np.repeat(near[:40], 4, 0)):
        d = np.zeros((len(x), len(x)))
        for c in x.T:
            d += (c[:, None] - c) ** 2
        d = np.sqrt(d)
        i, j, e = N._least(x, x, 4)
        o = np.lexsort((j, e, i))
        want = np.argsort(d, axis=1, kind="stable")[:, :4]
        assert (j[o].reshape(-1, 4) == want).all() and (e[o].reshape(-1, 4) == np.take_along_axis(d, want, 1)).all()
    assert took(near) < 10 * took(apart)


def test_floats_meet_as_floats(spark):
    """Vectors of floats go through the shuffle as they are; distances are those of doubles."""
    x = np.random.default_rng(9).normal(size=(40, 5)).astype(np.float32)
    df = spark.createDataFrame([(i % 2, i, [float(v) for v in r]) for i, r in enumerate(x)], "g int, id int, v array<float>")
    near = N.euclidean_knn(df.withColumnRenamed("id", "query_id"), df.select("g", F.col("id").alias("ref_id"), F.col("v").alias("ref_v")), 2, ["g"], 7)
    assert "array<double>" not in near._jdf.queryExecution().optimizedPlan().toString()
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    d[np.arange(40)[:, None] % 2 != np.arange(40) % 2] = np.inf
    got = {r["query_id"]: r for r in near.filter("query_id <> ref_id").collect()}
    np.fill_diagonal(d, np.inf)
    assert all(got[i]["ref_id"] == d[i].argmin() and np.isclose(got[i]["distance"], d[i].min(), rtol=1e-12) for i in range(40))


def test_rows_of_a_large_key_go_to_few_blocks(spark):
    """A row is sent to every block of the other side: their number does not follow the rows while blocks are small."""
    rows = [("g", i, [float(i % 17), float(i % 5)]) for i in range(200)]
    q, r = spark.createDataFrame(rows, "g string, query_id int, v array<double>"), spark.createDataFrame(rows, "g string, ref_id int, ref_v array<double>")
    met = N._in_blocks(q, r, ["g"], 10, 1).groupBy("query_id").count()
    assert [tuple(x) for x in met.groupBy("count").agg(F.count("*")).collect()] == [(8, 200)]
    size = spark.createDataFrame([(3, 64), (12000, 64), (72000, 64), (72000, 1536)], "n long, __size int")
    assert [x[0] for x in size.select(N._blocks(F.col("n"), 2048, True)).collect()] == [1, 6, 9, 36]

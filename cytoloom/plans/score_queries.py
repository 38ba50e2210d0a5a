"""Queries of scoring, calibration, baselines, similarity and perturbation encodings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import metrics as M, perturbation as P, scoring as S, similarity as N
from . import domain as D
from .domain import CTES
from .registry import query, rounded

P3 = ["p0", "p1", "p2"]
CTES |= {
    "scored": """SELECT *, CASE WHEN in_dist THEN 1 / (1 + exp(-greatest(least((s - 0.4) / 0.05, 500), -500))) * s * s * (r / (r + 5.0)) ELSE 0 END AS res,
  CASE WHEN NOT in_dist THEN 'REJECTED_OOD' WHEN s < 0.4::DOUBLE - 3 * 0.05::DOUBLE THEN 'REJECTED_UNSAFE' WHEN r = 0 THEN 'REJECTED_NO_REJUVENATION' ELSE 'APPROVED' END AS status
  FROM (SELECT *, p0 AS s, greatest(0, -(mu_age + sigma_age)) AS r FROM probs)""",
}
PARAMS = S.ScoreParams(tau_safe=0.4, w=0.05)


def _scored(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumns({"s": F.col("p0"), "p_loss": F.col("p1"), "p_death": F.col("p2")})
    return S.efficacy(df, PARAMS)


@query("efficacy", D.sql("SELECT cell_id, round(res, 6) + 0.0 AS res, status FROM scored"))
def efficacy(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("cell_id", "res", "status"))


@query("approvals", D.sql("SELECT fold, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'REJECTED_OOD') AS ood, count(*) FILTER (in_dist AND s >= 0.4::DOUBLE - 3 * 0.05::DOUBLE AND -(y_age + sigma_age) > 0) AS approved_oracle, approved - approved_oracle AS over_approval FROM scored GROUP BY fold"))
def approvals(spark, sf_dir):
    oracle = S.efficacy(_scored(spark, sf_dir).drop("res", "status").withColumn("mu_age", F.col("y_age")), PARAMS).select("cell_id", F.col("status").alias("oracle"))
    df = _scored(spark, sf_dir).join(oracle, "cell_id")
    g = df.groupBy("fold").agg(F.count_if(F.col("status") == S.APPROVED).alias("approved"), F.count_if(F.col("status") == S.REJECTED_OOD).alias("ood"), F.count_if(F.col("oracle") == S.APPROVED).alias("approved_oracle"))
    return g.withColumn("over_approval", F.col("approved") - F.col("approved_oracle"))


@query("rank_candidates", D.sql("SELECT cell_id, status, round(10 * res, 2) AS score FROM scored ORDER BY status <> 'APPROVED', round(10 * res, 2) DESC, cell_id LIMIT 100"))
def rank_candidates(spark, sf_dir):
    return S.rank_candidates(_scored(spark, sf_dir).select("cell_id", "status", F.round(10 * F.col("res"), 2).alias("score")), 100)


@query("respond", D.sql("SELECT cell_id, status, round_even(10 * res, 2) AS score, round_even(p0, 3) AS p_identity_preserved, round_even(p1, 3) AS p_identity_loss, round_even(p2, 3) AS p_apoptosis, round_even(mu_age, 2) AS delta_age_mean, round_even(mu_age - 9.5, 2) AS low, round_even(mu_age + 9.5, 2) AS high, in_dist, CASE WHEN NOT in_dist THEN 'Out-of-distribution: prediction not trustworthy.' END AS warning FROM scored"))
def respond(spark, sf_dir):
    return S.respond(_scored(spark, sf_dir), 9.5)


@query("efficacy_factors", D.sql("SELECT status, count(*) AS n, round(median(r), 6) AS gain, round(median(r / (r + 5.0)), 6) AS g, round(median(s * s), 6) AS sk FROM scored GROUP BY 1"))
def efficacy_factors(spark, sf_dir):
    r = S.gain(PARAMS)
    med = lambda c: F.percentile(c, F.lit(0.5))
    return rounded(_scored(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), med(r).alias("gain"), med(r / (r + 5.0)).alias("g"), med(F.col("s") * F.col("s")).alias("sk")))


@query("fit_conformal", D.sql("SELECT fold, level, q, k <= n AS attainable FROM (SELECT fold, level, list_sort(list(e))[greatest(1, least(ceil((count(*) + 1) * level)::BIGINT, count(*)))] AS q, ceil((count(*) + 1) * level) AS k, count(*) AS n FROM (SELECT fold, abs(mu_age - y_age) AS e FROM preds WHERE age_mask), (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.999::DOUBLE]) AS level) GROUP BY fold, level)"))
def fit_conformal(spark, sf_dir):
    res = D.preds(spark, sf_dir).filter("age_mask").select("fold", F.abs(F.col("mu_age") - F.col("y_age")).alias("abs_residual"))
    return S.fit_conformal(res, ["fold"], [0.5, 0.9, 0.999])


@query("fit_normalized_conformal", D.sql("SELECT fold, round(q, 6) AS q, round(avg((abs(mu_age - y_age) <= q * sigma_age)::INT), 6) AS cover FROM preds JOIN (SELECT fold, list_sort(list(e))[least(ceil((count(*) + 1) * 0.9::DOUBLE)::BIGINT, count(*))] AS q FROM (SELECT f.fold, abs(mu_age - y_age) / sigma_age AS e FROM preds p JOIN (SELECT DISTINCT fold FROM preds) f ON f.fold <> p.fold WHERE age_mask) GROUP BY fold) USING (fold) WHERE age_mask GROUP BY fold, q"))
def fit_normalized_conformal(spark, sf_dir):
    df = D.preds(spark, sf_dir).filter("age_mask")
    ratio = df.select(F.col("fold").alias("own"), (F.abs(F.col("mu_age") - F.col("y_age")) / F.col("sigma_age")).alias("abs_residual"))
    others = ratio.join(F.broadcast(df.select("fold").distinct()), F.col("own") != F.col("fold"))
    q = S.fit_conformal(others, ["fold"], [0.9]).select("fold", "q")
    cover = df.join(F.broadcast(q), "fold").groupBy("fold", "q").agg(F.avg((F.abs(F.col("mu_age") - F.col("y_age")) <= F.col("q") * F.col("sigma_age")).cast("double")).alias("cover"))
    return rounded(cover.select("fold", "q", "cover"))


@query("sigma_scale", D.sql("SELECT fold, round(greatest(1, quantile_cont(abs(mu_age - y_age), 0.9) / (median(sigma_age) * 1.6448536269514722)), 6) AS sigma_scale FROM preds WHERE age_mask GROUP BY fold"))
def sigma_scale(spark, sf_dir):
    df = D.preds(spark, sf_dir).filter("age_mask").withColumn("e", F.col("mu_age") - F.col("y_age"))
    return rounded(S.sigma_scale(df, ["fold"], "e", "sigma_age"))


@query("apply_platt", D.sql("SELECT cell_id, round(n, 6) AS p0, round((1 - n) * p1 / (p1 + p2), 6) AS p1, round((1 - n) * p2 / (p1 + p2), 6) AS p2 FROM (SELECT *, 1 / (1 + exp(-(1.7 * ln(p0 / (1 - p0)) - 0.4))) AS n FROM probs)"))
def apply_platt(spark, sf_dir):
    return rounded(S.apply_platt(D.probs(spark, sf_dir), 1.7, -0.4).select("cell_id", *P3))


@query("temperature_grid", D.sql("SELECT t::DOUBLE AS t, round(avg(m / t + ln(exp((z0 - m) / t) + exp((z1 - m) / t) + exp((z2 - m) / t)) - [z0, z1, z2][y + 1] / t), 6) AS nll FROM (SELECT *, greatest(z0, z1, z2) AS m FROM preds), (SELECT unnest([0.5, 1.0, 2.0, 8.0]) AS t) GROUP BY t"))
def temperature_grid(spark, sf_dir):
    return rounded(S.temperature_grid(D.preds(spark, sf_dir), ["z0", "z1", "z2"], "y", [0.5, 1.0, 2.0, 8.0]))


def _narrowed(n: int) -> dict[str, str]:
    """SQL of a round of the search: the grid between its bounds, and the best of it and of the rounds before."""
    low, high = ("ln(0.01::DOUBLE)", "ln(100::DOUBLE)") if n == 1 else (f"(SELECT low FROM best{n - 1})", f"(SELECT high FROM best{n - 1})")
    before = "" if n == 1 else f" UNION ALL SELECT nll, t FROM best{n - 1}"
    grid = f"SELECT avg(m / t + ln(exp((z0 - m) / t) + exp((z1 - m) / t) + exp((z2 - m) / t)) - [z0, z1, z2][y + 1] / t) AS nll, t FROM (SELECT *, greatest(z0, z1, z2) AS m FROM preds), (SELECT exp({low} + ({high} - {low}) * i / 24) AS t FROM (SELECT unnest(range(25)) AS i) UNION ALL SELECT 1.0::DOUBLE) GROUP BY t"
    step = f"({high} - {low}) / 24"
    return {f"grid{n}": grid, f"best{n}": f"SELECT nll, t, greatest(ln(0.01::DOUBLE), ln(t) - {step}) AS low, least(ln(100::DOUBLE), ln(t) + {step}) AS high FROM (SELECT nll, t FROM grid{n}{before}) ORDER BY nll, t LIMIT 1"}


@query("fit_temperature", D.sql("SELECT round(t, 6) AS t, round(nll, 6) AS nll FROM (SELECT nll, t FROM best3 UNION SELECT nll, t FROM grid1 WHERE t = 1)", **{k: v for n in (1, 2, 3) for k, v in _narrowed(n).items()}))
def fit_temperature(spark, sf_dir):
    df = D.preds(spark, sf_dir)
    return rounded(S.temperature_grid(df, ["z0", "z1", "z2"], "y", [1.0, S.fit_temperature(df, ["z0", "z1", "z2"], "y")]))


@query("minmax_by_calib", D.sql("SELECT cell_id, round(greatest(least((p0 - lo) / (hi - lo), 1), 0), 6) AS scaled, round((tq - lo) / (hi - lo), 6) AS threshold FROM probs JOIN (SELECT fold, min(p0) AS lo, max(p0) AS hi, quantile_cont(p0, 0.8) AS tq FROM probs WHERE cell_id % 3 = 0 GROUP BY 1) USING (fold) WHERE cell_id % 3 <> 0"))
def minmax(spark, sf_dir):
    df = D.probs(spark, sf_dir)
    return rounded(S.minmax_by_calib(df.filter("cell_id % 3 <> 0"), df.filter("cell_id % 3 = 0"), ["fold"], "p0", 0.8).select("cell_id", "scaled", "threshold"))


_MEMBERS = "SELECT cell_id, z0 + member * 0.1 AS z0, z1, z2 - member * 0.2 AS z2, mu_age + member * (cell_id % 3 - 1) AS mu_age FROM preds, (SELECT unnest([-1, 0, 1, 2]) AS member)"


@query("ensemble_combine", D.sql("SELECT cell_id, round(avg(exp(z0) / (exp(z0) + exp(z1) + exp(z2))), 6) AS p0, round(avg(exp(z1) / (exp(z0) + exp(z1) + exp(z2))), 6) AS p1, round(avg(exp(z2) / (exp(z0) + exp(z1) + exp(z2))), 6) AS p2, round(avg(mu_age), 6) AS mu_age, round(stddev_pop(mu_age) * 1.3, 6) AS sigma_age FROM members GROUP BY 1", members=_MEMBERS))
def ensemble(spark, sf_dir):
    m = D.preds(spark, sf_dir).withColumn("member", F.explode(F.array(*map(F.lit, (-1, 0, 1, 2)))))
    m = m.withColumns({"z0": F.col("z0") + F.col("member") * 0.1, "z2": F.col("z2") - F.col("member") * 0.2, "mu_age": F.col("mu_age") + F.col("member") * (F.col("cell_id") % 3 - 1)})
    return rounded(S.ensemble_combine(m, ["z0", "z1", "z2"], "mu_age", 1.3))


_TARGETS = "SELECT cell_id, fold, -y_age AS g, p0 >= 0.3 AS safe, p0 FROM probs"


@query("safe_targets", D.sql("SELECT cell_id, round(CASE WHEN safe THEN g ELSE min(g) FILTER (safe) OVER w - 1 END, 6) + 0.0 AS gated, round(g - CASE WHEN safe THEN 0 ELSE 3 * stddev_pop(g) OVER w END, 5) + 0.0 AS penalised, (safe AND g > 0)::INT AS good FROM t WINDOW w AS (PARTITION BY fold)", t=_TARGETS))
def safe_targets(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumn("g", -F.col("y_age"))
    out = S.safe_targets(df, ["fold"], F.col("p0") >= 0.3, "g")
    return rounded(out.select("cell_id", "gated", F.round("penalised", 5).alias("penalised"), "good"))


@query("ranking_arms", D.sql("SELECT arm, fold, round(corr(ra, rb), 6) AS spearman FROM (SELECT arm, fold, rank() OVER (PARTITION BY arm, fold ORDER BY score) + (count(*) OVER (PARTITION BY arm, fold, score) - 1) / 2 AS ra, rank() OVER (PARTITION BY arm, fold ORDER BY g) + (count(*) OVER (PARTITION BY arm, fold, g) - 1) / 2 AS rb FROM (SELECT fold, -y_age AS g, unnest(['age', 'score']) AS arm, unnest([-mu_age, round(res, 9)]) AS score FROM scored)) GROUP BY ALL"))
def ranking_arms(spark, sf_dir):
    long = _scored(spark, sf_dir).withColumn("g", -F.col("y_age")).select("fold", "g", F.expr("stack(2, 'age', -mu_age, 'score', round(res, 9)) AS (arm, score)"))
    return rounded(M.spearman(long, ["arm", "fold"], "score", "g"))


@query("flag_set_differences", D.sql("SELECT cutoff::DOUBLE AS cutoff, count(*) FILTER ((p0 >= cutoff) <> (p0 * 0.9 + 0.05 >= cutoff)) AS n_different FROM probs, (SELECT unnest([0.2, 0.35, 0.5]) AS cutoff) GROUP BY 1"))
def flag_sets(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumn("cutoff", F.explode(F.array(F.lit(0.2), F.lit(0.35), F.lit(0.5))))
    return df.groupBy("cutoff").agg(F.count_if((F.col("p0") >= F.col("cutoff")) != (F.col("p0") * 0.9 + 0.05 >= F.col("cutoff"))).alias("n_different"))


@query("mean_baseline", D.sql("SELECT fold, round(avg((y = 0)::INT), 6) AS p0, round(avg((y = 1)::INT), 6) AS p1, round(avg((y = 2)::INT), 6) AS p2, round(avg(y_age) FILTER (age_mask), 6) AS mu_age FROM (SELECT f.fold, p.* EXCLUDE fold FROM preds p JOIN (SELECT DISTINCT fold FROM preds) f ON f.fold <> p.fold) GROUP BY fold"))
def mean_baseline(spark, sf_dir):
    from ..operators.baselines import class_shares

    df = D.preds(spark, sf_dir)
    rest = df.withColumnRenamed("fold", "own").join(F.broadcast(df.select("fold").distinct()), F.col("own") != F.col("fold"))
    return rounded(class_shares(rest, ["fold"], "y", 3, F.when(F.col("age_mask"), F.col("y_age"))))


@query("control_baseline_estimator", D.sql("SELECT round(avg((y = 0)::INT), 6) AS p0, round(avg((y = 1)::INT), 6) AS p1, round(avg((y = 2)::INT), 6) AS p2, 0.0::DOUBLE AS mu_age FROM preds JOIN cells USING (cell_id) WHERE is_control"))
def control_estimator(spark, sf_dir):
    from ..operators.baselines import class_shares

    ctrl = D.preds(spark, sf_dir).join(D.cells(spark, sf_dir).filter("is_control").select("cell_id"), "cell_id", "left_semi")
    return rounded(class_shares(ctrl, [], "y", 3, F.lit(0.0)))


@query("hashed_fingerprint", "SELECT compound, list_sort(list(DISTINCT bit)) AS bits FROM (SELECT compound, (('0x' || substr(sha256(compound || '|' || i), 1, 8))::UBIGINT % 2048)::INT AS bit FROM (SELECT DISTINCT p_type || ' ' || p_size AS compound FROM part), (SELECT unnest(range(48)) AS i)) GROUP BY 1")
def hashed_fingerprint(spark, sf_dir):
    part = D.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_size").alias("compound"))
    return N.encode_once(part, "compound").distinct()


_FP = "SELECT compound, list(DISTINCT bit) AS bits FROM (SELECT compound, (('0x' || substr(sha256(compound || '|' || i), 1, 8))::UBIGINT % 64)::INT AS bit FROM (SELECT DISTINCT p_type || ' ' || p_size AS compound FROM part), (SELECT unnest(range(12)) AS i)) GROUP BY 1"


@query("jaccard_knn", D.sql("SELECT query_id, ref_id, round(distance, 6) AS distance FROM (SELECT a.compound AS query_id, b.compound AS ref_id, 1 - len(list_intersect(a.bits, b.bits)) / len(list_distinct(a.bits || b.bits))::DOUBLE AS distance FROM fp a, fp b) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), ref_id) <= 5", fp=_FP))
def jaccard_knn(spark, sf_dir):
    """All compounds of part on a small fingerprint, which has many ties."""
    c = D.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_size").alias("compound")).distinct()
    fp = c.withColumn("bits", N.hashed_fingerprint(F.col("compound"), 12, 64))
    return rounded(N.jaccard_knn(fp.withColumnRenamed("compound", "query_id"), fp.withColumnRenamed("compound", "ref_id"), 5))


_FP_ALL = "SELECT compound, list(DISTINCT bit) AS bits FROM (SELECT compound, (('0x' || substr(sha256(compound || '|' || i), 1, 8))::UBIGINT % 2048)::INT AS bit FROM (SELECT DISTINCT p_type || ' ' || p_size AS compound FROM part), (SELECT unnest(range(48)) AS i)) GROUP BY 1"


@query("jaccard_knn_all", D.sql("SELECT query_id, ref_id, round(distance, 6) AS distance FROM (SELECT a.compound AS query_id, b.compound AS ref_id, 1 - len(list_intersect(a.bits, b.bits)) / len(list_distinct(a.bits || b.bits))::DOUBLE AS distance FROM fp a, fp b) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), ref_id) <= 5", fp=_FP_ALL))
def jaccard_knn_all(spark, sf_dir):
    """All compounds of part, with the operator's own fingerprint."""
    c = D.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_size").alias("compound")).distinct()
    fp = c.withColumn("bits", N.hashed_fingerprint(F.col("compound")))
    return rounded(N.jaccard_knn(fp.withColumnRenamed("compound", "query_id"), fp.withColumnRenamed("compound", "ref_id"), 5))


@query("euclidean_knn", D.sql("SELECT query_id, ref_id, round(distance, 5) AS distance FROM (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, list_distance(a.v, b.v) AS distance FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) <= 3"))
def euclidean_knn(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    out = N.euclidean_knn(v.withColumnRenamed("vec_id", "query_id"), v.select("label", F.col("vec_id").alias("ref_id"), F.col("v").alias("ref_v")).withColumn("label", F.col("label")), 4, ["label"])
    ranked = out.filter("query_id <> ref_id").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref_id"))).filter("r <= 3")
    return rounded(ranked.select("query_id", "ref_id", "distance"), 5)


@query("ood_diagonal", D.sql("SELECT vec_id, round(d2, 4) AS d2, d2 <= (SELECT quantile_cont(d2, 0.99) FROM dist WHERE label < 8) AS in_dist FROM dist", **{
    "dims": "SELECT vec_id, label, unnest(range(64)) AS dim, unnest(v) AS value FROM vectors",
    "dist": "SELECT vec_id, label, sum((value - mu) * (value - mu) / var) AS d2 FROM dims JOIN (SELECT dim, avg(value) AS mu, var_samp(value) + 1e-3 AS var FROM dims WHERE label < 8 GROUP BY 1) USING (dim) GROUP BY 1, 2"}))
def ood_diagonal(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value"))
    return rounded(N.diagonal_ood(v.filter("label < 8"), v, ["vec_id"]), 4)


# the inverse by Gauss-Jordan steps without pivots, which a positive definite matrix allows: one recursion a dimension
_INVERSE = {
    "fitted": "SELECT v FROM vectors WHERE label < 8",
    "centre": "SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(v[i]) AS m FROM fitted, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1)",
    "covs": "SELECT i, j, covar_samp(v[i], v[j]) + CASE WHEN i = j THEN 1e-3 ELSE 0 END AS c FROM fitted, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j",
    "opened": "SELECT list(r ORDER BY i) AS m FROM (SELECT i, c || list_transform(range(1, 65), lambda u: (u = i)::INT::DOUBLE) AS r FROM (SELECT i, list(c ORDER BY j) AS c FROM covs GROUP BY i))",
    "steps": "SELECT 1 AS k, m FROM opened UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k]) ELSE list_transform(r, lambda x, j: x - r[k] / m[k][k] * m[k][j]) END) FROM steps WHERE k <= 64",
    "inverse": "SELECT list_transform(m, lambda r: r[65:128]) AS p FROM steps WHERE k = 65",
    "far": "SELECT vec_id, label, list_dot_product(list_transform(p, lambda r: list_dot_product(r, c)), c) AS d2 FROM (SELECT vec_id, label, list_transform(v, lambda x, i: x - mu[i]) AS c FROM vectors, centre), inverse",
}


@query("ood_mahalanobis", D.sql("SELECT vec_id, round(d2, 4) AS d2, d2 <= (SELECT quantile_cont(d2, 0.99) FROM far WHERE label < 8) AS in_dist FROM far", **_INVERSE).replace("WITH ", "WITH RECURSIVE ", 1))
def ood_full(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return N.score_ood(v, "v", N.fit_ood(v.filter("label < 8"), "v")).select("vec_id", F.round("d2", 4).alias("d2"), "in_dist")


@query("encode_dose_time", D.sql("SELECT cell_id, round(log10(greatest(dose_um, 1e-4)), 6) AS log_dose, round(ln(greatest(time_h, 1e-2)), 6) AS log_time, round(exp(ln(greatest(time_h, 1e-2))) / 24, 1) AS day FROM cells"))
def encode_dose_time(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    d, t = P.encode_dose_time(F.col("dose_um"), F.col("time_h"))
    return c.select("cell_id", F.round(d, 6).alias("log_dose"), F.round(t, 6).alias("log_time"), P.day_of_log_hours(t).alias("day"))


@query("factor_sets", """SELECT c_custkey, array_to_string(f, '+') AS factors, list_transform(['POU5F1', 'SOX2', 'KLF4', 'MYC', 'NANOG', 'LIN28A', 'GLIS1', 'SALL4'], lambda x: CASE WHEN list_contains(f, x) THEN 1.0 + c_nationkey ELSE 0 END::DOUBLE) AS hot FROM (
  SELECT c_custkey, c_nationkey, CASE c_custkey % 6 WHEN 0 THEN ['POU5F1', 'SOX2', 'KLF4', 'MYC'] WHEN 1 THEN ['POU5F1', 'SOX2', 'KLF4'] WHEN 2 THEN ['NANOG'] WHEN 3 THEN ['SOX2', 'SALL4'] WHEN 4 THEN ['KLF4', 'MYC'] ELSE [] END AS f FROM customer)""")
def factor_sets(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    name = F.element_at(F.array(*map(F.lit, ("OSKM", "OSK", "nanog", "Sox2+SALL4", "KM", "control"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    f = P.factors_of(name)
    return c.select("c_custkey", F.array_join(f, "+").alias("factors"), P.multi_hot(f, 1.0 + F.col("c_nationkey")).alias("hot"))


@query("resolve_scaffolds", D.sql("SELECT cell_id, CASE WHEN cell_id % 3 = 0 THEN scaffold_id WHEN cell_id % 3 = 1 THEN 'computed' ELSE pert_id END AS scaffold FROM cells"))
def resolve_scaffolds(spark, sf_dir):
    k = F.col("cell_id") % 3
    return D.cells(spark, sf_dir).select("cell_id", P.resolve_scaffold(F.when(k == 0, F.col("scaffold_id")).otherwise(" "), F.when(k == 1, "computed"), F.col("pert_id")).alias("scaffold"))


@query("normalise_obs", "SELECT o_orderkey::VARCHAR AS cell_id, o_orderstatus AS cell_line, o_orderpriority AS pert_id, NULL::VARCHAR AS smiles, CASE WHEN o_orderpriority = '5-LOW' THEN 'CONTROL' ELSE o_orderpriority END AS scaffold_id, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END::DOUBLE AS dose_um, NULL::DOUBLE AS time_h, o_orderpriority = '5-LOW' AS is_control FROM orders")
def normalise_obs(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return P.normalise_obs(o, {"cell_id": "o_orderkey", "cell_line": "o_orderstatus", "pert_id": "o_orderpriority", "dose_um": "o_totalprice"}, ["5-low"])


@query("derive_from_labels", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 504 ELSE 24 * (c_nationkey % 4) END::DOUBLE AS time_h, c_custkey % 5 <> 0 AND c_nationkey % 4 = 0 AS is_control FROM customer")
def derive_from_labels(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    label = F.when(F.col("c_custkey") % 5 == 0, "iPSC").otherwise(F.concat(F.lit("D"), (F.col("c_nationkey") % 4).cast("string")))
    h, ctrl = P.day_of_label(label)
    return c.select("c_custkey", h.alias("time_h"), ctrl.alias("is_control"))


@query("parse_titles", "SELECT c_custkey, 'N' || c_nationkey AS donor, (c_custkey % 30)::INT AS day, 'CD13' AS marker, 'Exp' || (1 + c_custkey % 2) AS batch FROM customer WHERE c_custkey % 7 <> 0")
def parse_titles(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    exp = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat(F.lit("_Exp"), (1 + F.col("c_custkey") % 2).cast("string")))
    title = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("_d"), (F.col("c_custkey") % 30).cast("string"), F.lit("_CD13_Sendai"), exp)
    return c.select("c_custkey", P.parse_title(title).alias("t")).filter("t IS NOT NULL").select("c_custkey", "t.*")


@query("union_sources", D.sql("SELECT chunk_id, count(*) AS n FROM cells GROUP BY 1"))
def union_sources(spark, sf_dir):
    c = D.cells(spark, sf_dir)
    return P.union_sources(c.filter("chunk_id < 2"), c.filter("chunk_id >= 2").drop("time_h")).groupBy("chunk_id").agg(F.count("*").alias("n"))


@query("expand_counts", D.sql("SELECT cell_line, i::INT AS i FROM (SELECT cell_line, unnest(range(1, n + 1)) AS i FROM (SELECT cell_line, count(*) % 5 + 1 AS n FROM cells GROUP BY 1))"))
def expand_counts(spark, sf_dir):
    n = D.cells(spark, sf_dir).groupBy("cell_line").agg((F.count("*") % 5 + 1).cast("int").alias("n"))
    return P.expand_counts(n, "cell_line", "n")



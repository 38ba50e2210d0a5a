"""Queries of evaluation: score cards, gates, donors' error scales, calibration reports, corrections, and the composed data build."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import hard_label, logit, sigmoid
from ..operators import baselines as B, evaluation as V, expression as X, heldout as H, metrics as M, perturbation as P, scoring as S, splits as SP, statistics as ST
from ..sources import samples as IO
from ..streaming.run import shared_path, staged
from . import domain as D, metric_queries, score_queries, stat_queries  # noqa: F401  their named queries are used here
from .build_queries import Build
from .domain import CTES
from .registry import QUERIES, query, rounded

PARAMS = S.ScoreParams(tau_safe=0.4, w=0.05)
PROBS = ["p0", "p1", "p2"]
Q = 9.5
PLATT = (1.2, -0.1)

_PLATT_SQL = "1 / (1 + exp(-(1.2 * ln(p0 / (1 - p0)) - 0.1)))"
CTES |= {
    "card": f"""SELECT *, CASE WHEN NOT in_dist THEN 'REJECTED_OOD' WHEN s < 0.4::DOUBLE - 3 * 0.05::DOUBLE THEN 'REJECTED_UNSAFE' WHEN greatest(0, -(CASE WHEN age_mask THEN y_age ELSE mu_age END + sigma_age)) = 0 THEN 'REJECTED_NO_REJUVENATION' ELSE 'APPROVED' END AS oracle,
  0.9 * mu_age + z1 AS mu_ridge, {_PLATT_SQL} AS s_platt FROM scored""",
    "profile": "SELECT chunk_id, cell_line AS item, cell_id % 2 AS half, gene, sum(value) / any_value(n) AS value FROM expr JOIN cells USING (cell_id) JOIN (SELECT chunk_id, cell_line, cell_id % 2 AS h, count(*) AS n FROM cells GROUP BY ALL) c USING (chunk_id, cell_line) WHERE c.h = cell_id % 2 GROUP BY chunk_id, cell_line, cell_id % 2, gene",
}


def spearman_sql(by: str, a: str, b: str, source: str, where: str = "true") -> str:
    part = f"PARTITION BY {by}"
    return f"SELECT {by}, corr(ra, rb) AS v FROM (SELECT {by}, rank() OVER ({part} ORDER BY a) + (count(*) OVER ({part}, a) - 1) / 2 AS ra, rank() OVER ({part} ORDER BY b) + (count(*) OVER ({part}, b) - 1) / 2 AS rb FROM (SELECT {by}, {a} AS a, {b} AS b FROM {source} WHERE {where})) GROUP BY {by}"


def prauc_sql(by: str, s: str, hit: str, source: str) -> str:
    return f"SELECT {by}, sum(pos * tp / flagged) / nullif(max(tp_all), 0) AS v FROM (SELECT {by}, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY {by}) AS tp_all FROM (SELECT {by}, round({s}, 9) AS s, sum({hit})::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {by}"


def auroc_sql(by: str, s: str, hit: str, source: str) -> str:
    return f"SELECT {by}, sum(pos * (below + neg / 2)) / nullif(max(P) * (max(N) - max(P)), 0) AS v FROM (SELECT {by}, pos, n - pos AS neg, coalesce(sum(n - pos) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY {by}) AS P, sum(n) OVER (PARTITION BY {by}) AS N FROM (SELECT {by}, round({s}, 9) AS s, sum({hit})::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL)) GROUP BY {by}"


def ece_sql(by: str, p: str, hit: str, source: str, bins: int = 10) -> str:
    return f"SELECT {by}, sum(g) / max(t) AS v FROM (SELECT {by}, b, abs(sum({hit} - p)) AS g, sum(count(*)) OVER (PARTITION BY {by}) AS t FROM (SELECT *, {p} AS p, least(floor({p} * {bins}), {bins - 1}) AS b FROM {source}) GROUP BY {by}, b) GROUP BY {by}"


def top1_sql(by: str, probs: str, source: str) -> str:
    return f"SELECT {by}, sum(g) / max(t) AS v FROM (SELECT {by}, bin, abs(sum(hit - conf)) AS g, sum(count(*)) OVER (PARTITION BY {by}) AS t FROM (SELECT *, greatest({probs}) AS conf, (list_position([{probs}], greatest({probs})) - 1 = y)::INT AS hit, (ceil(greatest({probs}) * 15) - 1)::INT AS bin FROM {source}) GROUP BY {by}, bin) GROUP BY {by}"


# ---- states -------------------------------------------------------------------------------------------------------


def _profile(spark, sf_dir, half: int):
    cells = D.cells(spark, sf_dir).filter(F.col("cell_id") % 2 == half).select("cell_id", "chunk_id", F.col("cell_line").alias("item"))
    n = cells.groupBy("chunk_id", "item").agg(F.count("*").alias("n"))
    return D.expr(spark, sf_dir).join(cells, "cell_id").groupBy("chunk_id", "item", "gene").agg(F.sum("value").alias("s")).join(n, ["chunk_id", "item"]).select("chunk_id", "item", "gene", (F.col("s") / F.col("n")).alias("value"))


@query("pds", D.sql("""SELECT chunk_id, round(avg((item = match)::INT), 6) AS pds FROM (SELECT chunk_id, item, match FROM (
  SELECT chunk_id, item, match, row_number() OVER (PARTITION BY chunk_id, item ORDER BY round(sum(abs(coalesce(t.value, 0) - coalesce(p.value, 0))), 9), match) AS r
  FROM (SELECT a.chunk_id, a.item, b.item AS match, gene FROM (SELECT DISTINCT chunk_id, item FROM profile WHERE half = 1) a JOIN (SELECT DISTINCT chunk_id, item FROM profile WHERE half = 0) b USING (chunk_id), genes)
  LEFT JOIN (SELECT chunk_id, item, gene, value FROM profile WHERE half = 1) t USING (chunk_id, item, gene) LEFT JOIN (SELECT chunk_id, item AS match, gene, value FROM profile WHERE half = 0) p USING (chunk_id, match, gene) GROUP BY chunk_id, item, match) WHERE r = 1) GROUP BY 1"""))
def pds(spark, sf_dir):
    """The even cells of a line predict its odd ones."""
    return rounded(V.pds(_profile(spark, sf_dir, 1), _profile(spark, sf_dir, 0), ["chunk_id"]))


# ---- score cards --------------------------------------------------------------------------------------------------


def _card(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumns({"s": F.col("p0"), "p_loss": F.col("p1"), "mu_ridge": 0.9 * F.col("mu_age") + F.col("z1")})
    return df.withColumn("s_platt", sigmoid(PLATT[0] * logit(F.col("p0")) + PLATT[1]))


_SIMPLE = {
    "n_cells": "count(*)::DOUBLE", "dage_mae_model": "avg(abs(mu_age - y_age))", "dage_mae_ridge": "avg(abs(mu_ridge - y_age))", "level_shift_model": "median(mu_age) - median(y_age)", "level_shift_ridge": "median(mu_ridge) - median(y_age)",
    "res_median": "median(res)", "res_max": "max(res)", "res_approvals": "count(*) FILTER (status = 'APPROVED')::DOUBLE", "res_approvals_oracle": "count(*) FILTER (oracle = 'APPROVED')::DOUBLE",
    "conformal_coverage": "avg((abs(mu_age - y_age) <= 9.5)::INT)", "conformal_width": "19.0::DOUBLE", "ood_rate": "avg((NOT in_dist)::INT)",
}
_CARD = (
    f"SELECT fold, unnest([{', '.join(repr(k) for k in _SIMPLE)}]) AS metric, unnest([{', '.join(_SIMPLE.values())}]) AS value FROM card WHERE age_mask GROUP BY fold"
    + "".join(f" UNION ALL SELECT fold, '{m}', v FROM ({q})" for m, q in (
        ("rank_res", spearman_sql("fold", "round(res, 9)", "-y_age", "card", "age_mask")), ("rank_model_dage", spearman_sql("fold", "-mu_age", "-y_age", "card", "age_mask")), ("rank_ridge_dage", spearman_sql("fold", "-mu_ridge", "-y_age", "card", "age_mask")),
        ("fate_prauc", prauc_sql("fold", "s", "(y = 0)::INT", "card")), ("fate_roc", auroc_sql("fold", "s", "(y = 0)::INT", "card")), ("fate_ece", ece_sql("fold", "round(s, 9)", "(y = 0)::INT", "card")), ("fate_ece_platt", ece_sql("fold", "s_platt", "(y = 0)::INT", "card")),
    ))
)


@query("scorecard", D.sql(f"SELECT fold, metric, round(value, 5) + 0.0 AS value FROM ({_CARD}) WHERE fold IN (SELECT fold FROM preds GROUP BY 1 HAVING count(*) FILTER (age_mask) >= 3)"))
def scorecard(spark, sf_dir):
    return rounded(V.scorecard(_card(spark, sf_dir), PARAMS, Q), 5)


@query("fold_report", D.sql("SELECT fold, " + ", ".join(f"round(max(value) FILTER (metric = '{m}'), 5) + 0.0 AS {m}" for m in ("rank_res", "dage_mae_model", "fate_prauc", "fate_ece", "conformal_coverage", "dage_mae_ridge")) + f" FROM ({_CARD}) GROUP BY fold"))
def fold_report(spark, sf_dir):
    return rounded(V.fold_report(V.scorecard(_card(spark, sf_dir), PARAMS, Q), ["rank_res", "dage_mae_model", "fate_prauc", "fate_ece", "conformal_coverage", "dage_mae_ridge"]), 5)


_ARMS_SQL = """SELECT regime, 'model' AS estimator, cell_id, y, y_age, age_mask, in_dist, sigma_age, mu_age, p0, p1, p2 FROM split5 WHERE held
  UNION ALL SELECT regime, 'binned', cell_id, y, y_age, age_mask, in_dist, sigma_age, a * z1 + b, coalesce(q0, 1 / 3::DOUBLE), coalesce(q1, 1 / 3::DOUBLE), coalesce(q2, 1 / 3::DOUBLE) FROM split5
    LEFT JOIN (SELECT regime, bucket, ((count(*) FILTER (y = 0)) + 1) / (count(*) + 3)::DOUBLE AS q0, ((count(*) FILTER (y = 1)) + 1) / (count(*) + 3)::DOUBLE AS q1, ((count(*) FILTER (y = 2)) + 1) / (count(*) + 3)::DOUBLE AS q2 FROM split5 WHERE NOT held GROUP BY ALL) USING (regime, bucket)
    JOIN (SELECT regime, CASE WHEN coalesce(var_pop(z1), 0) < 1e-12 THEN 0 ELSE regr_slope(y_age, z1) END AS a, CASE WHEN coalesce(var_pop(z1), 0) < 1e-12 THEN avg(y_age) ELSE regr_intercept(y_age, z1) END AS b FROM split5 WHERE NOT held AND age_mask GROUP BY 1) USING (regime) WHERE held
  UNION ALL SELECT regime, 'mean', cell_id, y, y_age, age_mask, in_dist, sigma_age, mean_age, q0, q1, q2 FROM split5 JOIN (SELECT regime, avg((y = 0)::INT) AS q0, avg((y = 1)::INT) AS q1, avg((y = 2)::INT) AS q2, avg(y_age) FILTER (age_mask) AS mean_age FROM split5 WHERE NOT held GROUP BY 1) USING (regime) WHERE held"""
_SPLIT_SQL = "SELECT *, fold % 5 AS regime, cell_id % 5 >= 3 AS held, floor(z1 * 4)::BIGINT AS bucket FROM probs"
_OVR_SQL = " UNION ALL ".join(f"SELECT regime, estimator, {i} AS cls, p{i} AS p, (y = {i})::INT AS hit FROM arms" for i in range(3))
_RES_SQL = "SELECT *, CASE WHEN in_dist THEN 1 / (1 + exp(-greatest(least((p0 - 0.4) / 0.05, 500), -500))) * p0 * p0 * (r / (r + 5.0)) ELSE 0 END AS res FROM (SELECT *, greatest(0, -(mu_age + sigma_age)) AS r FROM arms WHERE estimator = 'model' AND age_mask)"
_EVAL = dict(split5=_SPLIT_SQL, arms=_ARMS_SQL, ovr3=_OVR_SQL, mres=_RES_SQL, evals=f"""SELECT regime, estimator, round(pr.v, 9) AS prauc, e.v AS ece, round(mae, 9) AS mae, r2, n, c.v AS coverage, s.v AS spearman FROM
  (SELECT regime, estimator, avg(abs(mu_age - y_age)) AS mae, 1 - sum(power(mu_age - y_age, 2)) / (var_pop(y_age) * count(*)) AS r2, count(*) AS n FROM arms WHERE age_mask GROUP BY ALL)
  JOIN (SELECT regime, estimator, avg(v) AS v FROM ({prauc_sql('regime, estimator, cls', 'p', 'hit', 'ovr3')}) GROUP BY ALL) pr USING (regime, estimator) JOIN ({top1_sql('regime, estimator', 'p0, p1, p2', 'arms')}) e USING (regime, estimator)
  LEFT JOIN (SELECT regime, 'model' AS estimator, avg((abs(mu_age - y_age) <= 9.5)::INT) AS v FROM mres GROUP BY 1) c USING (regime, estimator) LEFT JOIN (SELECT 'model' AS estimator, * FROM ({spearman_sql('regime', 'round(res, 9)', '-y_age', 'mres')})) s USING (regime, estimator)""")


def _arms(spark, sf_dir):
    """The model on held-out rows of five regimes, against estimators that are fitted on the others."""
    df = D.probs(spark, sf_dir).withColumn("regime", F.col("fold") % 5)
    train, test = df.filter("cell_id % 5 < 3"), df.filter("cell_id % 5 >= 3")
    binned = B.binned_fit(train, ["regime"], "z1", F.floor(F.col("z1") * 4), "y", 3, "y_age", "age_mask")(test)
    shares = B.class_shares(train, ["regime"], "y", 3, F.when(F.col("age_mask"), F.col("y_age")))
    mean = test.drop("mu_age", *PROBS).join(F.broadcast(shares), "regime")
    keep = lambda d, n: d.select("regime", F.lit(n).alias("estimator"), "cell_id", "y", "y_age", "age_mask", "in_dist", "sigma_age", "mu_age", *PROBS)
    return M.union_all(keep(test, "model"), keep(binned, "binned"), keep(mean, "mean"))


@query("evaluate_estimators", D.sql("SELECT regime, estimator, round(prauc, 5) AS prauc, round(ece, 5) AS ece, round(mae, 6) AS mae, round(r2, 5) AS r2, n, round(coverage, 6) AS coverage, round(spearman, 5) AS spearman FROM evals", **_EVAL))
def evaluate_estimators(spark, sf_dir):
    e = V.evaluate(_arms(spark, sf_dir), PROBS, Q, PARAMS)
    return rounded(e.withColumns({c: F.round(c, 5) for c in ("prauc", "ece", "r2", "spearman")}))


@query("evaluation_gates", D.sql("SELECT regime, coalesce(prauc > bp AND coalesce(mae <= bm, true), false) AS beats_all, ece < 0.05 AS ece_ok, abs(coverage - 0.9) < 0.03 AS coverage_ok, spearman > 0.3 AS ranks, coalesce(prauc > bp AND coalesce(mae <= bm, true), false) AND ece < 0.05 AND abs(coverage - 0.9) < 0.03 AND spearman > 0.3 AS accepted FROM evals JOIN (SELECT regime, max(prauc) AS bp, min(mae) AS bm FROM evals WHERE estimator <> 'model' GROUP BY 1) USING (regime) WHERE estimator = 'model'", **_EVAL))
def evaluation_gates(spark, sf_dir):
    return ST.gates(V.evaluate(_arms(spark, sf_dir), PROBS, Q, PARAMS))


@query("full_evaluation")
def full_evaluation(spark, sf_dir):
    """Fitted estimators in two regimes, to metrics and gates: the model against ridge on all features, on either view, and class shares."""
    df = staged(D.probs(spark, sf_dir), "probs")  # fits read it again and again
    df = df.withColumn("random", F.when(F.col("cell_id") % 5 < 3, "train").otherwise("test")).withColumn("line", F.when(F.col("fold") < 17, "train").otherwise("test"))
    parts = []
    for regime in ("random", "line"):  # fits
        train, test = df.filter(F.col(regime) == "train"), df.filter(F.col(regime) == "test")
        keep = lambda d, n, r=regime: d.select(F.lit(r).alias("regime"), F.lit(n).alias("estimator"), "cell_id", "y", "y_age", "age_mask", "in_dist", "sigma_age", "mu_age", *PROBS)
        parts.append(keep(test, "model"))
        for name, cols in B.VIEWS.items():
            parts.append(keep(B.view(train, cols)(test), name))
        shares = B.class_shares(train, [], "y", 3, F.when(F.col("age_mask"), F.col("y_age")))
        parts.append(keep(test.drop("mu_age", *PROBS).crossJoin(F.broadcast(shares)), "mean"))
    e = staged(V.evaluate(staged(M.union_all(*parts), "estimates"), PROBS, Q, PARAMS), "evaluated")  # a row a regime and estimator; the gates read it once more
    return rounded(e.join(ST.gates(e).select("regime", "accepted"), "regime"), 4)


@query("feature_views")
def feature_views(spark, sf_dir):
    """Ridge and logistic regression on the state alone, the perturbation alone, and both."""
    df = staged(D.preds(spark, sf_dir), "preds")  # fits read it again and again
    train, test = df.filter("cell_id % 5 < 3"), df.filter("cell_id % 5 >= 3")
    parts = [M.regression(B.view(train, cols)(test), [], "mu_age", "y_age", F.col("age_mask")).withColumn("view", F.lit(n)) for n, cols in B.VIEWS.items()]
    return rounded(M.union_all(*parts), 4)


def profile_views(b):
    """(name, features by cell, columns) of the embedded and the raw profiles of all genes."""
    dims = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: ((D.gene_number() * (d + 3)) % 11 - 5) / 5.0)
    low = X.embedding_project(b.norm(), b.genes.select("gene", dims.alias("vec"))).groupBy("cell_id").pivot("dim", [0, 1, 2, 3]).agg(F.first("value"))
    low = low.select("cell_id", *(F.coalesce(F.col(str(i)), F.lit(0.0)).alias(f"e{i}") for i in range(4)))
    genes = sorted(r["gene"] for r in b.genes.select("gene").distinct().collect())  # a dimension
    # a column a gene in one aggregate: a pivot would first shuffle every entry by cell and gene
    raw = b.norm().groupBy("cell_id").agg(*(F.coalesce(F.max(F.when(F.col("gene") == g, F.col("value"))), F.lit(0.0)).alias(f"r{i}") for i, g in enumerate(genes)))
    return [("embedded", low, [f"e{i}" for i in range(4)]), ("raw", raw, [f"r{i}" for i in range(len(genes))])]


@query("embedding_features")
def embedding_features(spark, sf_dir):
    """Raw profiles of all genes against embedded ones as features of the ridge fit."""
    b = Build(spark, sf_dir)
    ages = b.ages().join(b.kept().select("cell_id", "chunk_id"), "cell_id")
    parts = []
    for name, feats, cols in profile_views(b):
        df = staged(ages.join(feats, "cell_id", "left").na.fill(0.0, cols), f"features-{name}")  # fits read it again and again
        out = B.ridge(df.filter("cell_id % 5 < 3"), cols, "age")(df.filter("cell_id % 5 >= 3"))
        parts.append(M.regression(out, [], "prediction", "age", F.lit(True)).withColumn("features", F.lit(name)))
    return rounded(M.union_all(*parts), 4)


@query("paired_prauc", D.sql(f"SELECT round(avg(d), 5) + 0.0 AS mean_diff, count(*) AS n, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses FROM (SELECT a.v - b.v AS d FROM ({prauc_sql('fold', 'p0', '(y = 0)::INT', 'probs')}) a JOIN ({prauc_sql('fold', 'p0 * 0.5 + p2 * 0.5', '(y = 0)::INT', 'probs')}) b USING (fold))"))
def paired_prauc(spark, sf_dir):
    """The model's safe probability against a weaker one, by fold."""
    df = D.probs(spark, sf_dir).withColumn("hit", (F.col("y") == 0).cast("int"))
    of = lambda c: M.prauc(df.select("fold", "hit", F.round(c, 9).alias("s")), ["fold"], "s", "hit").withColumnRenamed("prauc", "value")
    ci = ST.paired_ci(ST.paired(of(F.col("p0")), of(F.col("p0") * 0.5 + F.col("p2") * 0.5), ["fold"]), [])
    return rounded(ci.select("mean_diff", "n", "wins", "losses"), 5)


_VT = "SELECT *, CASE WHEN cell_id % 10 = 8 THEN 'val' WHEN cell_id % 10 = 9 THEN 'test' ELSE 'train' END AS split FROM probs"


def _with_split(spark, sf_dir):
    k = F.col("cell_id") % 10
    return D.probs(spark, sf_dir).withColumn("split", F.when(k == 8, "val").when(k == 9, "test").otherwise("train"))


@query("in_and_out_of_distribution", D.sql(f"SELECT split, round(pr.v, 5) AS prauc, round(mae, 6) AS mae, n FROM (SELECT split, avg(abs(mu_age - y_age)) AS mae, count(*) AS n FROM vt WHERE age_mask AND split <> 'train' GROUP BY 1) JOIN ({prauc_sql('split', 'p0', '(y = 0)::INT', 'vt')}) pr USING (split)", vt=_VT))
def in_and_out(spark, sf_dir):
    df = _with_split(spark, sf_dir).filter("split <> 'train'").withColumns({"hit": (F.col("y") == 0).cast("int"), "s": F.round("p0", 9)})
    fit = M.regression(df, ["split"], "mu_age", "y_age", F.col("age_mask")).select("split", F.round("mae", 6).alias("mae"), "n")
    return fit.join(rounded(M.prauc(df, ["split"], "s", "hit"), 5), "split")


_TWO = f"SELECT fold, y, unnest(['raw', 'platt']) AS arm, unnest([p0, {_PLATT_SQL}]) AS p FROM probs"


@query("discrimination_and_calibration", D.sql(f"SELECT fold, arm, round(a.v, 5) AS auroc, round(b.v, 5) AS prauc, round(c.v, 5) AS ece FROM ({auroc_sql('fold, arm', 'p', '(y = 0)::INT', 'two')}) a JOIN ({prauc_sql('fold, arm', 'p', '(y = 0)::INT', 'two')}) b USING (fold, arm) JOIN ({ece_sql('fold, arm', 'round(p, 9)', '(y = 0)::INT', 'two').replace('SELECT *, round(p, 9) AS p', 'SELECT * EXCLUDE p, round(p, 9) AS p')}) c USING (fold, arm)", two=_TWO))
def discrimination(spark, sf_dir):
    df = D.probs(spark, sf_dir)
    arms = F.explode(F.array(F.struct(F.lit("raw").alias("arm"), F.round("p0", 9).alias("p")), F.struct(F.lit("platt").alias("arm"), F.round(sigmoid(PLATT[0] * logit(F.col("p0")) + PLATT[1]), 9).alias("p"))))
    long, by = df.select("fold", (F.col("y") == 0).cast("int").alias("hit"), arms.alias("e")).select("fold", "hit", "e.*"), ["fold", "arm"]
    return rounded(M.auroc(long, by, "p", "hit").join(M.prauc(long, by, "p", "hit"), by).join(M.ece_binary(long, by, "p", "hit"), by), 5)


@query("selection_objective", D.sql("SELECT member, round(avg(-w * power(1 - p, 2) * ln(p)) + avg(CASE WHEN e <= 3 THEN e * e / 2 ELSE 3 * (e - 1.5) END) FILTER (age_mask), 6) AS objective, count(*) AS n FROM (SELECT cell_id % 3 AS member, age_mask, [p0, p1, p2][y + 1] AS p, [1.0, 0.5, 2.0][y + 1]::DOUBLE AS w, abs(mu_age - y_age) AS e FROM probs) GROUP BY 1"))
def selection_objective(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumn("member", F.col("cell_id") % 3)
    return rounded(V.selection_objective(df, ["member"], PROBS, "y", [1.0, 0.5, 2.0], 2.0, 3.0))


@query("res_decomposition", D.sql("SELECT status, count(*) AS n, round(median(1 / (1 + exp(-greatest(least((s - 0.4) / 0.05, 500), -500)))), 6) AS gate, round(median(s * s), 6) AS safety, round(median(r / (r + 5.0)), 6) AS gain_term, 1.0::DOUBLE AS loss_term, round(median(r), 6) AS gain, round(avg(-(p0 * ln(p0 + 1e-12) + p1 * ln(p1 + 1e-12) + p2 * ln(p2 + 1e-12))), 6) AS entropy FROM scored GROUP BY 1"))
def res_decomposition(spark, sf_dir):
    df = S.efficacy(D.probs(spark, sf_dir).withColumns({"s": F.col("p0"), "p_loss": F.col("p1")}), PARAMS)
    return rounded(V.efficacy_terms(df, PARAMS, ["status"]))


# ---- donors and folds ---------------------------------------------------------------------------------------------


@query("donor_error_scale", D.sql("SELECT donor, n, round(mae, 6) AS mae, round(sm, 6) AS sigma_mean, round(smc, 6) AS sigma_mc_mean, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () > 0.5 AS imbalanced FROM (SELECT CASE WHEN fold < 14 THEN 0 ELSE fold END AS donor, count(*) AS n, avg(abs(mu_age - y_age)) AS mae, avg(sigma_age) AS sm, avg(sigma_age * 1.5) AS smc FROM preds WHERE age_mask GROUP BY 1)"))
def donor_error_scale(spark, sf_dir):
    df = D.preds(spark, sf_dir).withColumns({"donor": F.when(F.col("fold") < 14, 0).otherwise(F.col("fold")), "sigma_mc": F.col("sigma_age") * 1.5})
    return rounded(V.donor_error_scale(df))


@query("level_correction_verdict", D.sql("""SELECT k::INT AS k, count(*) FILTER (base_shift > 1e-9 AND 1 - sc_shift / nullif(base_shift, 0) >= 0.5) AS n_reduced, count(*) AS n_folds, round(avg(sc_mae - mt_mae), 5) + 0.0 AS matched_gain, n_reduced >= 4 AS passed FROM (
  SELECT fold, k, any_value(base_shift) AS base_shift, avg(sc_shift) AS sc_shift, avg(sc_mae) AS sc_mae, avg(mt_mae) AS mt_mae FROM (
    SELECT fold, k, repeat, abs(median(mu_age - o) - median(y_age)) AS sc_shift, avg(abs(mu_age - o - y_age)) AS sc_mae, avg(abs(mu_age - near - y_age)) AS mt_mae
    FROM (SELECT w.fold, w.repeat, k, w.mu_age, w.y_age, o, list_sort(list_transform(refs, lambda x: {'gap': abs(x.t - w.t), 'id': x.cell_id, 'e': x.e}))[1].e AS near FROM walk w
      JOIN (SELECT fold, repeat, k, median(mu_age - y_age) AS o, list({'cell_id': cell_id, 't': t, 'e': mu_age - y_age}) AS refs FROM walk, (SELECT unnest([1, 3, 5]) AS k) WHERE r <= k GROUP BY ALL) USING (fold, repeat) WHERE w.r > k)
    GROUP BY ALL) JOIN (SELECT fold, abs(median(mu_age) - median(y_age)) AS base_shift, count(*) AS n FROM timed GROUP BY 1) USING (fold) WHERE n - k >= 3 GROUP BY ALL) GROUP BY k""",
  timed="SELECT p.*, c.time_h AS t FROM preds p JOIN cells c USING (cell_id) WHERE age_mask",
  walk="SELECT *, row_number() OVER (PARTITION BY fold, repeat ORDER BY ('0x' || substr(md5('5|' || repeat || '|' || cell_id), 1, 8))::UBIGINT, cell_id) AS r FROM timed, (SELECT unnest(range(3)) AS repeat)"))
def level_correction_verdict(spark, sf_dir):
    df = D.preds(spark, sf_dir).filter("age_mask").join(D.cells(spark, sf_dir).select("cell_id", F.col("time_h").alias("t")), "cell_id")
    return rounded(V.correction_verdict(V.level_correction(df, [1, 3, 5], 3, 5)), 5)


@query("credit_fractions", D.sql("""SELECT fold, round(o, 6) + 0.0 AS "offset", round(thr, 6) AS thr, round(avg((y_age < thr)::INT), 6) AS true_credit, round(avg((mu_age < thr)::INT), 6) AS pred_credit, round(avg((mu_age - o < thr)::INT), 6) AS corrected_credit, round(avg(abs(mu_age - y_age)), 6) AS mae_raw, round(avg(abs(mu_age - o - y_age)), 6) AS mae_corrected, count(*) AS n
  FROM vt JOIN (SELECT fold, -median(sigma_age) AS thr FROM vt WHERE age_mask AND split = 'test' GROUP BY 1) USING (fold) JOIN (SELECT fold, median(mu_age - y_age) AS o FROM vt WHERE age_mask AND split = 'val' GROUP BY 1) USING (fold) WHERE age_mask AND split = 'test' GROUP BY fold, o, thr""", vt=_VT))
def credit_fractions(spark, sf_dir):
    df = _with_split(spark, sf_dir)
    return rounded(V.credit_fractions(df.filter("split = 'test'"), df.filter("split = 'val'"), "fold"))


@query("ood_quality", D.sql(f"SELECT fold, round(r, 6) AS ood_rate, round(f, 6) AS mae_flagged, round(k, 6) AS mae_kept, round(v, 6) AS auc, CASE WHEN v IS NULL THEN 'single class' WHEN v > 0.6 THEN 'informative' WHEN v < 0.4 THEN 'anti-informative' ELSE 'uninformative' END AS verdict FROM (SELECT fold, avg((NOT in_dist)::INT) AS r, avg(abs(mu_age - y_age)) FILTER (NOT in_dist) AS f, avg(abs(mu_age - y_age)) FILTER (in_dist) AS k FROM preds WHERE age_mask GROUP BY 1) JOIN ({auroc_sql('fold', 'abs(mu_age - y_age)', '(NOT in_dist)::INT', '(SELECT * FROM preds WHERE age_mask)')}) USING (fold)"))
def ood_quality(spark, sf_dir):
    return rounded(V.ood_quality(D.preds(spark, sf_dir).filter("age_mask"), ["fold"]))


@query("overfit_check", D.sql("SELECT region, round(a, 6) AS train_bulk, round(b, 6) AS train_donors, round(c, 6) AS test, round(c / b, 6) AS ratio FROM (SELECT fold % 5 AS region, avg(abs(mu_age - y_age)) FILTER (split = 'train' AND fold = 7) AS a, avg(abs(mu_age - y_age)) FILTER (split = 'train' AND fold <> 7) AS b, avg(abs(mu_age - y_age)) FILTER (split = 'test') AS c FROM vt WHERE age_mask GROUP BY 1)", vt=_VT))
def overfit_check(spark, sf_dir):
    return rounded(V.overfit_classes(_with_split(spark, sf_dir).withColumn("region", F.col("fold") % 5), ["region"], F.col("fold") == 7))


@query("fold_rows", D.sql("SELECT fold, count(*) AS n, round(sum(mu_age), 6) AS model, round(sum(0.9 * mu_age + z1), 5) AS ridge, sum(t)::BIGINT AS time, count(*) FILTER (NOT in_dist) AS flagged FROM (SELECT p.*, c.time_h AS t, count(*) OVER (PARTITION BY p.fold) AS k FROM preds p JOIN cells c USING (cell_id) WHERE age_mask AND cell_id % 10 = 9) WHERE k >= 5 GROUP BY 1"))
def fold_rows(spark, sf_dir):
    """The held-out rows of each fold with an age, with both predictions, time and flag; small folds are dropped."""
    df = _card(spark, sf_dir).filter("age_mask AND cell_id % 10 = 9").join(D.cells(spark, sf_dir).select("cell_id", F.col("time_h").alias("t")), "cell_id")
    few = df.groupBy("fold").agg(F.count("*").alias("k")).filter("k >= 5").select("fold")
    g = df.join(few, "fold", "left_semi").groupBy("fold").agg(F.count("*").alias("n"), F.sum("mu_age").alias("model"), F.round(F.sum("mu_ridge"), 5).alias("ridge"), F.sum("t").cast("long").alias("time"), F.count_if(~F.col("in_dist")).alias("flagged"))
    return rounded(g)


@query("neighbour_times", D.sql("SELECT round(avg(spread), 5) AS spread, round(avg(c), 5) AS corr, count(*) AS n FROM (SELECT a, stddev_pop(t) AS spread, CASE WHEN stddev_pop(t) > 0 AND stddev_pop(y) > 0 THEN corr(t, y) END AS c FROM (SELECT a.vec_id AS a, b.vec_id % 24 AS t, b.vec_id % 61 AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) <= 3) GROUP BY 1)"))
def neighbour_times(spark, sf_dir):
    near = QUERIES["euclidean_knn"](spark, sf_dir).select("query_id", (F.col("ref_id") % 24).cast("double").alias("t"), (F.col("ref_id") % 61).cast("double").alias("y"))
    return rounded(V.neighbour_times(near), 5)


_FP = "SELECT compound, list(DISTINCT bit) AS bits FROM (SELECT compound, (('0x' || substr(sha256(compound || '|' || i), 1, 8))::UBIGINT % 2048)::INT AS bit FROM (SELECT DISTINCT p_type || ' ' || p_size AS compound FROM part), (SELECT unnest(range(48)) AS i)) GROUP BY 1"


@query("knn_fingerprint", D.sql("""SELECT query_id, round(sum((y = 0)::INT) / count(*)::DOUBLE, 6) AS p0, round(sum((y = 1)::INT) / count(*)::DOUBLE, 6) AS p1, round(sum((y = 2)::INT) / count(*)::DOUBLE, 6) AS p2, round(coalesce(avg(y_age) FILTER (age_mask), 0), 6) AS mu_age
  FROM (SELECT a.compound AS query_id, b.compound AS ref_id FROM fp a, fp b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(1 - len(list_intersect(a.bits, b.bits)) / len(list_distinct(a.bits || b.bits))::DOUBLE, 9), ref_id) <= 5)
  JOIN (SELECT p_type || ' ' || p_size AS ref_id, p_partkey % 3 AS y, (p_partkey % 41 - 20)::DOUBLE AS y_age, p_partkey % 4 <> 0 AS age_mask FROM part) USING (ref_id) GROUP BY 1""", fp=_FP))
def knn_fingerprint(spark, sf_dir):
    """The outcomes of the five nearest compounds' parts."""
    key = F.col("p_partkey")
    rows = D.table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_size").alias("ref_id"), (key % 3).cast("int").alias("y"), (key % 41 - 20).cast("double").alias("y_age"), (key % 4 != 0).alias("age_mask"))
    return rounded(V.neighbour_estimate(QUERIES["jaccard_knn_all"](spark, sf_dir).select("query_id", "ref_id"), rows))


# ---- calibration --------------------------------------------------------------------------------------------------

_ORIGIN = "SELECT *, CASE WHEN fold % 4 = 0 THEN 'xdonor' ELSE 'in_dist' END AS origin FROM preds"
_SOFT = "SELECT origin, y, stage, exp((z0 - m) / t) / s AS q0, exp((z1 - m) / t) / s AS q1, exp((z2 - m) / t) / s AS q2 FROM (SELECT *, exp((z0 - m) / t) + exp((z1 - m) / t) + exp((z2 - m) / t) AS s FROM (SELECT *, greatest(z0, z1, z2) AS m FROM org, (VALUES ('before', 1.0::DOUBLE), ('after', 0.5::DOUBLE)) v(stage, t)))"


def _origin(spark, sf_dir):
    return D.preds(spark, sf_dir).withColumn("origin", F.when(F.col("fold") % 4 == 0, "xdonor").otherwise("in_dist"))


@query("calibration_report", D.sql(f"SELECT origin, stage, round(nll, 6) AS nll, round(e.v, 5) AS ece, round(b.v, 5) AS safe_ece, n FROM (SELECT origin, stage, avg(-ln(greatest([q0, q1, q2][y + 1], 1e-12))) AS nll, count(*) AS n FROM soft GROUP BY ALL) JOIN ({top1_sql('origin, stage', 'q0, q1, q2', 'soft')}) e USING (origin, stage) JOIN ({ece_sql('origin, stage', 'ps', '(y = 0)::INT', 'safe2')}) b USING (origin, stage)", org=_ORIGIN, soft=_SOFT,
  safe2="SELECT origin, y, unnest(['before', 'after']) AS stage, unnest([q0, 1 / (1 + exp(-(1.2 * ln(q0 / (1 - q0)) - 0.1)))]) AS ps FROM soft WHERE stage = 'before'"))
def calibration_report(spark, sf_dir):
    r = V.calibration_report(_origin(spark, sf_dir), ["z0", "z1", "z2"], "y", 0.5, PLATT)
    return r.select("origin", "stage", F.round("nll", 6).alias("nll"), F.round("ece", 5).alias("ece"), F.round("safe_ece", 5).alias("safe_ece"), "n")


@query("calibration_policy")
def calibration_policy(spark, sf_dir):
    df = D.probs(spark, sf_dir).select(F.when(F.col("fold") % 4 == 0, "xdonor").otherwise("in_dist").alias("origin"), "p0", (F.col("y") == 0).cast("double").alias("safe"))
    return rounded(V.calibration_policy(df, "p0", "safe"), 4)


@query("diagnostic_bundle", D.sql(f"SELECT fold, arm, count(*) AS n, round(sum(p), 5) AS mass FROM (SELECT fold, unnest(['raw', 'calibrated']) AS arm, unnest([p0, {_PLATT_SQL}]) AS p FROM probs) GROUP BY ALL"))
def diagnostic_bundle(spark, sf_dir):
    """Predictions raw and calibrated, written by fold and read back."""
    df = D.probs(spark, sf_dir)
    arms = M.union_all(*(df.select("cell_id", "fold", F.lit(n).alias("arm"), c.alias("p")) for n, c in (("raw", F.col("p0")), ("calibrated", sigmoid(PLATT[0] * logit(F.col("p0")) + PLATT[1])))))
    path = shared_path(spark, "bundle")
    IO.write_samples(arms, path, "fold")
    return rounded(spark.read.parquet(path).groupBy("fold", "arm").agg(F.count("*").alias("n"), F.sum("p").alias("mass")), 5)


@query("donor_pool", D.sql("SELECT donor, count(*) AS n, round(sum(abs(mu_age - y_age)), 6) AS residual FROM preds WHERE fold % 4 = 0 AND age_mask GROUP BY 1"))
def donor_pool(spark, sf_dir):
    """The cross-donor pool saved for later fits, and loaded."""
    pool = D.preds(spark, sf_dir).filter("fold % 4 = 0 AND age_mask").select("fold", "donor", "cell_id", F.abs(F.col("mu_age") - F.col("y_age")).alias("abs_residual"), "sigma_age", "z0", "z1", "z2", "y")
    path = shared_path(spark, "pool")
    IO.write_samples(pool, path, "fold")
    return rounded(spark.read.parquet(path).groupBy("donor").agg(F.count("*").alias("n"), F.sum("abs_residual").alias("residual")))


@query("load_manifest", D.sql("SELECT chunk_id AS shard_id, count(*) AS n FROM cells GROUP BY 1"))
def load_manifest(spark, sf_dir):
    path, at = shared_path(spark, "samples"), shared_path(spark, "manifest")
    IO.write_samples(D.cells(spark, sf_dir), path)
    built = IO.load_manifest(spark, path, at)  # there is none, so it is built
    again = IO.load_manifest(spark, path, at)
    return built.join(again, ["cell_id", "shard_id"], "left_semi").groupBy("shard_id").agg(F.count("*").alias("n"))


@query("union_splits", D.sql("SELECT split, count(*) AS n FROM (SELECT DISTINCT cell_id, split FROM vt) GROUP BY 1", vt=_VT))
def union_splits(spark, sf_dir):
    df = _with_split(spark, sf_dir).select("cell_id", "split")
    parts = [df.filter(F.col("split") == s) for s in ("train", "val", "test", "val")]  # one is passed twice
    return SP.union_splits(*parts).groupBy("split").agg(F.count("*").alias("n"))


_RULES = {
    "x_empty": "len(X) = 0", "x_finite": "len(list_filter(X, lambda v: v IS NULL OR isnan(v) OR isinf(v))) > 0", "dose_time_size": "len(dose_time) <> 2", "y_cls_size": "len(y_cls) <> 3", "y_cls_negative": "len(list_filter(y_cls, lambda v: v < -1e-6)) > 0",
    "y_cls_sum": "abs(list_sum(y_cls) - 1) > 1e-3", "age_mask": "age_mask <> (y_age IS NOT NULL)", "sig_scores_size": "len(sig_scores) <> 3", "modality": "u_modality NOT IN ('chem', 'genetic', 'tf')", "fingerprint": "(u_modality = 'chem') <> (u_chem_fp IS NOT NULL)",
    "fingerprint_size": "u_chem_fp IS NOT NULL AND len(u_chem_fp) <> 2048", "fingerprint_bits": "len(list_filter(u_chem_fp, lambda b: b NOT IN (0, 1))) > 0", "gene_embedding": "u_modality = 'genetic' AND u_gene_emb IS NULL", "tf_embedding": "u_modality = 'tf' AND (u_tf_emb IS NULL OR len(u_tf_emb) <> 8)",
    "scaffold": "u_modality = 'chem' AND (scaffold_id IS NULL OR scaffold_id = '')",
}
_SAMPLES = """SELECT cell_id, CASE WHEN cell_id % 13 = 0 THEN [] WHEN cell_id % 17 = 0 THEN ['nan'::DOUBLE] ELSE [z0, z1, z2] END AS X, CASE WHEN cell_id % 19 = 0 THEN [1.0] ELSE [1.0, 2.0] END AS dose_time,
  CASE WHEN cell_id % 23 = 0 THEN [0.5, 0.1, 0.1] WHEN cell_id % 29 = 0 THEN [1.2, -0.2, 0.0] WHEN cell_id % 61 = 0 THEN [1.0] ELSE [p0, p1, p2] END AS y_cls, age_mask, CASE WHEN age_mask AND cell_id % 31 <> 0 THEN y_age END AS y_age, CASE WHEN cell_id % 37 = 0 THEN [0.0] ELSE [0.0, 0.0, 0.0] END AS sig_scores,
  ['chem', 'tf', 'genetic', 'other'][cell_id % 4 + 1] AS u_modality, CASE WHEN cell_id % 4 = 0 AND cell_id % 41 <> 0 THEN CASE WHEN cell_id % 43 = 0 THEN [2, 2] ELSE list_transform(range(2048), lambda i: 0) END END AS u_chem_fp,
  CASE WHEN cell_id % 4 = 2 AND cell_id % 47 <> 0 THEN [1.0] END AS u_gene_emb, CASE WHEN cell_id % 4 = 1 THEN CASE WHEN cell_id % 53 = 0 THEN [0.0] ELSE [0.0, 0, 0, 0, 0, 0, 0, 0] END END AS u_tf_emb, CASE WHEN cell_id % 59 = 0 THEN '' ELSE 'S' END AS scaffold_id FROM probs"""


@query("validate_samples", D.sql(" UNION ALL ".join(f"SELECT cell_id, '{rule}' AS rule FROM sampled WHERE {broken}" for rule, broken in _RULES.items()), sampled=_SAMPLES))
def validate_samples(spark, sf_dir):
    """Samples of which some break each rule."""
    from ..operators.quality import validate_samples as validate

    every = lambda n: F.col("cell_id") % n == 0
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    kind = F.col("cell_id") % 4
    df = D.probs(spark, sf_dir).select(
        "cell_id", F.when(every(13), F.array().cast("array<double>")).when(every(17), F.array(F.lit(float("nan")))).otherwise(F.array("z0", "z1", "z2")).alias("X"), F.when(every(19), arr(1)).otherwise(arr(1, 2)).alias("dose_time"),
        F.when(every(23), arr(0.5, 0.1, 0.1)).when(every(29), arr(1.2, -0.2, 0)).when(every(61), arr(1)).otherwise(F.array(*PROBS)).alias("y_cls"), "age_mask", F.when(F.col("age_mask") & ~every(31), F.col("y_age")).alias("y_age"), F.when(every(37), arr(0)).otherwise(arr(0, 0, 0)).alias("sig_scores"),
        F.get(F.array(*map(F.lit, ("chem", "tf", "genetic", "other"))), kind.cast("int")).alias("u_modality"), F.when((kind == 0) & ~every(41), F.when(every(43), F.array(F.lit(2), F.lit(2))).otherwise(F.array_repeat(F.lit(0), 2048))).alias("u_chem_fp"),
        F.when((kind == 2) & ~every(47), arr(1)).alias("u_gene_emb"), F.when(kind == 1, F.when(every(53), arr(0)).otherwise(arr(*[0] * 8))).alias("u_tf_emb"), F.when(every(59), "").otherwise("S").alias("scaffold_id"),
    )
    return validate(df)


def _label():
    return hard_label(F.array("y_safe", "y_loss", "y_death"))


# ---- the data build -----------------------------------------------------------------------------------------------


@query("dataset_build", D.sql("""SELECT cell_id, CAST(list_position([round(y_safe, 9), round(y_loss, 9), round(y_death, 9)], greatest(round(y_safe, 9), round(y_loss, 9), round(y_death, 9))) - 1 AS INT) AS label, chunk_id <> 4 AS age_mask, CASE WHEN chunk_id <> 4 THEN round(d_age, 5) + 0.0 END AS y_age, round(score, 5) + 0.0 AS cycle, round(log10(greatest(dose_um, 1e-4)), 6) AS log_dose, round(ln(greatest(time_h, 1e-2)), 6) AS log_time, round(x, 4) + 0.0 AS x_sum
  FROM fate JOIN deltas USING (cell_id) JOIN cyc USING (cell_id) JOIN (SELECT cell_id, dose_um, time_h FROM kept) USING (cell_id) JOIN (SELECT cell_id, sum(coalesce(value, 0) * (pos + 1)) AS x FROM (SELECT cell_id, gene, pos FROM kept, panel) LEFT JOIN norm USING (cell_id, gene) GROUP BY 1) USING (cell_id)"""))
def dataset_build(spark, sf_dir):
    """Quality control to samples in one plan: labels, age shifts of sources that are not masked, cycle scores, panel, dose and time."""
    b = Build(spark, sf_dir)
    kept = b.kept()
    y = X.fate_labels(b.scores(), kept, 1.0)
    age = X.delta_age(b.ages(), kept).select("cell_id", "d_age", "chunk_id")
    panel = X.to_panel(b.norm(), X.fit_panel(b.norm(), kept, 10, ["Brand#7", "Brand#3"], ["Brand#9"]), kept)
    dose, time = P.encode_dose_time(F.col("dose_um"), F.col("time_h"))
    df = kept.select("cell_id", "dose_um", "time_h").join(y, "cell_id").join(age, "cell_id").join(b.cycle(), "cell_id").join(panel, "cell_id")
    valid = X.age_valid(F.col("chunk_id"), [4])
    weighed = F.aggregate(F.transform("X", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return df.select(
        "cell_id", _label().alias("label"), valid.alias("age_mask"), F.when(valid, F.round("d_age", 5) + 0.0).alias("y_age"), (F.round("score", 5) + 0.0).alias("cycle"),
        F.round(dose, 6).alias("log_dose"), F.round(time, 6).alias("log_time"), (F.round(weighed, 4) + 0.0).alias("x_sum"),
    )


@query("sidecar", D.sql("SELECT chunk_id, count(*) AS n, count(*) FILTER (chunk_id <> 4) AS n_valid, round(sum(d_age), 4) + 0.0 AS raw_delta, round(sum(score), 4) + 0.0 AS cycle, count(*) FILTER (is_control) AS n_control FROM deltas JOIN cyc USING (cell_id) GROUP BY 1"))
def sidecar(spark, sf_dir):
    """Raw age shift, cycle score, control flag and mask of every cell, for the later fit on training rows; every age-valid cell has one."""
    b = Build(spark, sf_dir)
    side = X.delta_age(b.ages(), b.kept()).join(b.cycle(), "cell_id").withColumn("age_mask", X.age_valid(F.col("chunk_id"), [4]))
    return rounded(side.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if("age_mask").alias("n_valid"), F.sum("d_age").alias("raw_delta"), F.sum("score").alias("cycle"), F.count_if("is_control").alias("n_control")), 4)


@query("donor_codes", "SELECT c_name AS donor, (row_number() OVER (ORDER BY c_name) - 1)::INT AS code FROM (SELECT DISTINCT c_mktsegment AS c_name FROM customer)")
def donor_codes(spark, sf_dir):
    return SP.codes(D.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("donor")), "donor")


@query("baseline_ages", D.sql("SELECT cell_line, round(avg(age), 6) AS age, count(*) AS n FROM kept JOIN ages USING (cell_id) WHERE is_control GROUP BY 1"))
def baseline_ages(spark, sf_dir):
    b = Build(spark, sf_dir)
    return rounded(b.ages().join(b.kept().filter("is_control").select("cell_id", "cell_line"), "cell_id").groupBy("cell_line").agg(F.avg("age").alias("age"), F.count("*").alias("n")))


@query("timepoint_precision", D.sql("SELECT donor, count(*) AS n_timepoints, sum(n)::BIGINT AS n_cells, round(sum(n) / count(*), 6) AS per_point, round(17.0 / sqrt(sum(n) / count(*)), 6) AS se_low, round(21.0 / sqrt(sum(n) / count(*)), 6) AS se_high, 21.0 / sqrt(sum(n) / count(*)) < 11.35 AS resolves FROM points GROUP BY 1"))
def timepoint_precision(spark, sf_dir):
    """Cells a time point and the standard error that they leave, against the size of the effect."""
    from ..operators import timecourse as T

    p = T.timepoints(D.course(spark, sf_dir).withColumnRenamed("day", "t"), 3, 2)
    g = p.groupBy("donor").agg(F.count("*").alias("n_timepoints"), F.sum("n").alias("n_cells"))
    per = F.col("n_cells") / F.col("n_timepoints")
    return rounded(g.select("donor", "n_timepoints", "n_cells", per.alias("per_point"), (17.0 / F.sqrt(per)).alias("se_low"), (21.0 / F.sqrt(per)).alias("se_high"), (21.0 / F.sqrt(per) < 11.35).alias("resolves")))


@query("dataset_split_sizes", D.sql("SELECT split, label, count(*) AS n, count(*) FILTER (chunk_id <> 4) AS n_age FROM (SELECT CAST(list_position([round(y_safe, 9), round(y_loss, 9), round(y_death, 9)], greatest(round(y_safe, 9), round(y_loss, 9), round(y_death, 9))) - 1 AS INT) AS label, chunk_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.8 THEN 'val' WHEN u < 0.9 THEN 'calib' ELSE 'test' END AS split FROM fate JOIN (SELECT cell_id, chunk_id, (('0x' || substr(md5('7|' || cell_id), 1, 8))::UBIGINT / 4294967296.0) AS u FROM kept) USING (cell_id)) GROUP BY ALL"))
def dataset_split_sizes(spark, sf_dir):
    b = Build(spark, sf_dir)
    y = X.fate_labels(b.scores(), b.kept(), 1.0).join(b.kept().select("cell_id", "chunk_id"), "cell_id").join(SP.random_split(b.kept(), [0.7, 0.1, 0.1, 0.1], 7), "cell_id")
    return y.groupBy("split", _label().alias("label")).agg(F.count("*").alias("n"), F.count_if(X.age_valid(F.col("chunk_id"), [4])).alias("n_age"))


@query("label_rows", D.sql("SELECT cell_id, (row_number() OVER (PARTITION BY cell_line ORDER BY cell_id))::INT AS i FROM cells"))
def label_rows(spark, sf_dir):
    c = D.cells(spark, sf_dir).select("cell_id", "cell_line")
    return P.label_rows(c, c.groupBy("cell_line").agg(F.count("*").alias("n")), "cell_line", "n", "cell_id").select("cell_id", "i")


@query("panel_agreement", D.sql("SELECT substr(sha256(string_agg(gene, chr(10) ORDER BY gene)), 1, 16) AS panel_hash, 3::BIGINT AS n_sources, true AS agree FROM genes"))
def panel_agreement(spark, sf_dir):
    """Bundle, scaler and panel have one list of genes."""
    from pyspark.sql import Window

    from ..operators.quality import check_panel_hash

    genes = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("gene")))  # a dimension
    return check_panel_hash(genes.withColumn("source", F.explode(F.array(F.lit("bundle"), F.lit("scaler"), F.lit("panel")))))


@query("soft_losses", D.sql("SELECT fold, round(avg(-(y0 * ln(p0) + y1 * ln(p1) + y2 * ln(p2))), 6) AS nll, round(avg(-(y0 * 1.0 * power(1 - p0, 2) * ln(p0) + y1 * 0.5 * power(1 - p1, 2) * ln(p1) + y2 * 2.0 * power(1 - p2, 2) * ln(p2))), 6) AS focal FROM (SELECT *, 0.9 * (y = 0)::INT + 0.1 / 3 AS y0, 0.9 * (y = 1)::INT + 0.1 / 3 AS y1, 0.9 * (y = 2)::INT + 0.1 / 3 AS y2 FROM probs) GROUP BY 1"))
def soft_losses(spark, sf_dir):
    """Losses against smoothed labels, with weights of classes."""
    df = D.probs(spark, sf_dir).withColumns({f"y{i}": 0.9 * (F.col("y") == i).cast("int") + 0.1 / 3 for i in range(3)})
    return rounded(df.groupBy("fold").agg(V.soft_nll(F.array("y0", "y1", "y2"), F.array(*PROBS)).alias("nll"), M.soft_focal_loss(PROBS, ["y0", "y1", "y2"], [1.0, 0.5, 2.0], 2.0).alias("focal")))


_RECAL = f"SELECT fold, cell_id, -y_age AS g, unnest(['age', 'res', 'recalibrated']) AS arm, unnest([-mu_age, round(res, 9), round(CASE WHEN in_dist THEN 1 / (1 + exp(-greatest(least((sp - 0.4) / 0.05, 500), -500))) * sp * sp * (r / (r + 5.0)) ELSE 0 END, 9)]) AS score FROM (SELECT *, {_PLATT_SQL} AS sp FROM scored)"


def _ranked(spark, sf_dir):
    df = _card(spark, sf_dir)
    raw = S.efficacy(df, PARAMS).select("cell_id", "fold", (-F.col("y_age")).alias("g"), "mu_age", F.col("res").alias("raw"))
    new = S.efficacy(df.withColumn("s", F.col("s_platt")), PARAMS).select("cell_id", F.col("res").alias("new"))
    return raw.join(new, "cell_id").select("cell_id", "fold", "g", F.expr("stack(3, 'age', -mu_age, 'res', round(raw, 9), 'recalibrated', round(new, 9)) AS (arm, score)"))


@query("ranking_arms_full", D.sql(f"SELECT arm, fold, round(s.v, 6) AS spearman, round(p, 6) AS precision_at_5 FROM ({spearman_sql('arm, fold', 'score', 'g', 'rk')}) s JOIN (SELECT arm, fold, avg(good) AS p FROM (SELECT arm, fold, (g >= median(g) OVER (PARTITION BY arm, fold))::INT AS good, row_number() OVER (PARTITION BY arm, fold ORDER BY score DESC, cell_id) AS r FROM rk) WHERE r <= 5 GROUP BY ALL) USING (arm, fold)", rk=_RECAL))
def ranking_arms_full(spark, sf_dir):
    """Age alone, the score, and the score on recalibrated safety, against the true gain."""
    long, by = _ranked(spark, sf_dir), ["arm", "fold"]
    return rounded(M.spearman(long, by, "score", "g").join(M.precision_at_k(long, by, "score", "g", 5).withColumnRenamed("precision_at_k", "precision_at_5"), by))


@query("threshold_arms", D.sql("SELECT arm, fold, round(count(*) FILTER (flag AND y = 0) / nullif(count(*) FILTER (flag), 0)::DOUBLE, 6) AS precision, round(CASE WHEN count(*) FILTER (flag) = 0 THEN 0 ELSE count(*) FILTER (flag AND y = 0) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE END, 6) AS recall, count(*) FILTER (flag) AS n_flagged, count(*) FILTER (flag <> own) AS n_changed FROM (SELECT fold, y, arm, p0 >= CASE arm WHEN 'calib' THEN cut ELSE 0.35 END AS flag, p0 >= 0.5 AS own FROM vt JOIN (SELECT fold, quantile_cont(p0, 0.8) AS cut FROM vt WHERE split = 'val' GROUP BY 1) USING (fold), (SELECT unnest(['calib', 'fixed']) AS arm) WHERE split = 'test') GROUP BY ALL", vt=_VT))
def threshold_arms(spark, sf_dir):
    """Flags at the calibration rows' quantile and at a fixed cutoff, and how many differ from those at one half."""
    df = _with_split(spark, sf_dir)
    t = df.filter("split = 'val'").groupBy("fold").agg(F.percentile("p0", F.lit(0.8)).alias("t"))
    arms = df.filter("split = 'test'").join(F.broadcast(t), "fold").withColumn("arm", F.explode(F.array(F.lit("calib"), F.lit("fixed")))).withColumn("flag", F.col("p0") >= F.when(F.col("arm") == "calib", F.col("t")).otherwise(0.35))
    hits, flags, goods = F.count_if(F.col("flag") & (F.col("y") == 0)), F.count_if("flag"), F.count_if(F.col("y") == 0)
    return rounded(arms.groupBy("arm", "fold").agg((hits / F.nullif(flags, F.lit(0))).alias("precision"), F.when(flags == 0, 0.0).otherwise(hits / F.nullif(goods, F.lit(0))).alias("recall"), flags.alias("n_flagged"), F.count_if(F.col("flag") != (F.col("p0") >= 0.5)).alias("n_changed")))


@query("timepoints_unsafe", D.sql("SELECT donor, t, round(value, 6) AS value, round(unsafe, 6) AS unsafe, n FROM (SELECT *, count(*) OVER (PARTITION BY donor) AS k FROM (SELECT donor, day AS t, avg(value) AS value, avg((row_id % 5 = 0)::INT) AS unsafe, count(*) AS n FROM course GROUP BY ALL HAVING count(*) >= 2)) WHERE k >= 3"))
def timepoints_unsafe(spark, sf_dir):
    """Mean value and share of unsafe rows at each time point of a donor."""
    from ..operators import timecourse as T

    c = D.course(spark, sf_dir).withColumnRenamed("day", "t")
    unsafe = c.groupBy("donor", "t").agg(F.avg((F.col("row_id") % 5 == 0).cast("double")).alias("unsafe"))
    return rounded(T.timepoints(c, 3, 2).join(unsafe, ["donor", "t"]).select("donor", "t", "value", "unsafe", "n"))


@query("regressors")
def regressors(spark, sf_dir):
    """Ridge, kernel ridge, boosted trees and a forest on the same rows, with each of five groups of donors left out; mean R2 and error over groups. The linear ones take all folds from one pass."""
    cols, y = ["z0", "z1", "z2", "sigma_age"], "y_age"
    df = staged(D.preds(spark, sf_dir).filter("age_mask").select((F.col("fold") % 5).alias("region"), *cols, y), "preds")  # fits read it again and again
    wide, waves = B.fourier_features(df, cols, 16), [f"k{i}" for i in range(16)]
    parts = [H.leave_group_out(d, "region", c, y).select("region", "r2", "mae", F.lit(n).alias("kind")) for n, d, c in (("ridge", df, cols), ("kernel", wide, waves))]
    for g in range(5):  # fits of trees
        train, test = df.filter(F.col("region") != g), df.filter(F.col("region") == g)
        parts += [M.regression(B.REGRESSORS[n](train, cols, y)(test), ["region"], "prediction", y, F.lit(True)).select("region", "r2", "mae", F.lit(n).alias("kind")) for n in ("boosted", "forest")]
    return rounded(M.union_all(*parts).groupBy("kind").agg(F.avg("r2").alias("mean_r2"), F.avg("mae").alias("mae"), F.count("*").alias("n_folds")), 4)


@query("perturbation_features", D.sql("SELECT c_custkey, round(list_sum(v), 6) AS mass, len(v)::INT AS width FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN [1.0, 0.0, 1.0, 1.0] ELSE list_transform(range(8), lambda i: (i * c_nationkey) / 10.0::DOUBLE) END AS v FROM customer)"))
def perturbation_features(spark, sf_dir):
    """The fingerprint where there is a compound, else the factors' levels."""
    c = D.table(spark, sf_dir, "customer")
    fp = F.when(F.col("c_custkey") % 2 == 0, F.array(*(F.lit(x) for x in (1, 0, 1, 1))))
    levels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * F.col("c_nationkey") / 10.0)
    v = c.select("c_custkey", fp.alias("fp"), levels.alias("tf")).select("c_custkey", P.perturbation_vector("fp", "tf").alias("v"))
    return rounded(v.select("c_custkey", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("mass"), F.size("v").alias("width")))

"""Queries of folds, paired comparisons, verdicts and time courses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import safe_corr
from ..operators import evaluation as V, expression as X, metrics as M, statistics as S, timecourse as T
from . import domain as D
from .build_queries import Build
from .domain import CTES
from .registry import query, rounded

CTES |= {
    "fold_mae": "SELECT fold, 'mae' AS metric, avg(abs(mu_age - y_age)) AS value FROM preds WHERE age_mask GROUP BY 1 UNION ALL SELECT fold, 'shift', avg(mu_age - y_age) FROM preds WHERE age_mask GROUP BY 1",
    "other_mae": "SELECT fold, 'mae' AS metric, CASE WHEN fold % 9 = 8 THEN NULL ELSE avg(abs(mu_age * 0.9 - y_age)) END AS value FROM preds WHERE age_mask GROUP BY 1 UNION ALL SELECT fold, 'shift', avg(mu_age * 0.9 - y_age) FROM preds WHERE age_mask GROUP BY 1",
    "diffs": "SELECT fold, metric, a.value - b.value AS diff FROM fold_mae a JOIN other_mae b USING (fold, metric) WHERE b.value IS NOT NULL",
    "ci": """SELECT metric, avg(diff) AS mean_diff, count(*) AS n, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, stddev_samp(diff) / sqrt(count(*)) AS se,
  CASE count(*) - 1 WHEN 1 THEN 12.706 WHEN 2 THEN 4.303 WHEN 3 THEN 3.182 WHEN 4 THEN 2.776 WHEN 5 THEN 2.571 WHEN 6 THEN 2.447 WHEN 7 THEN 2.365 WHEN 8 THEN 2.306 WHEN 9 THEN 2.262 WHEN 10 THEN 2.228 ELSE 2.571 END AS tc FROM diffs GROUP BY 1""",
    "points": "SELECT * EXCLUDE k FROM (SELECT *, count(*) OVER (PARTITION BY donor) AS k FROM (SELECT donor, day AS t, avg(value) AS value, count(*) AS n FROM course GROUP BY ALL HAVING count(*) >= 2)) WHERE k >= 3",
}


def _mae(spark, sf_dir, factor: float, hole: bool):
    g = D.preds(spark, sf_dir).filter("age_mask").groupBy("fold").agg(F.avg(F.abs(F.col("mu_age") * factor - F.col("y_age"))).alias("mae"), F.avg(F.col("mu_age") * factor - F.col("y_age")).alias("shift"))
    if hole:
        g = g.withColumn("mae", F.when(F.col("fold") % 9 != 8, F.col("mae")))
    return M.long_form(g, ["fold"], ["mae", "shift"])


def _diffs(spark, sf_dir):
    return S.paired(_mae(spark, sf_dir, 1.0, False), _mae(spark, sf_dir, 0.9, True), ["fold", "metric"])


@query("aggregate_folds", D.sql("SELECT metric, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi, count(value) AS n FROM fold_mae GROUP BY 1"))
def aggregate_folds(spark, sf_dir):
    return rounded(S.aggregate_folds(_mae(spark, sf_dir, 1.0, False), ["metric"]))


@query("paired_ci", D.sql("SELECT metric, round(mean_diff, 6) + 0.0 AS mean_diff, n, wins, losses, round(mean_diff - tc * se, 6) + 0.0 AS ci_low, round(mean_diff + tc * se, 6) + 0.0 AS ci_high, round(mean_diff / se, 5) + 0.0 AS t FROM ci"))
def paired_ci(spark, sf_dir):
    return rounded(S.paired_ci(_diffs(spark, sf_dir), ["metric"]).withColumn("t", F.round("t", 5)))


@query("verdict", D.sql("SELECT metric, CASE WHEN metric = 'shift' THEN '(context)' WHEN mean_diff - tc * se > 0 THEN 'REGRESSION' WHEN mean_diff + tc * se < 0 THEN 'ACCEPT' ELSE 'noise' END AS verdict FROM ci"))
def verdict(spark, sf_dir):
    return S.verdict(S.paired_ci(_diffs(spark, sf_dir), ["metric"]), F.when(F.col("metric") == "shift", 0).otherwise(-1)).select("metric", "verdict")


@query("jackknife", D.sql("SELECT fold::VARCHAR AS left_out, round((sum(value) OVER () - value) / (count(*) OVER () - 1), 6) + 0.0 AS mean FROM fold_mae WHERE metric = 'mae' UNION ALL SELECT 'ALL', round(avg(value), 6) FROM fold_mae WHERE metric = 'mae'"))
def jackknife(spark, sf_dir):
    return rounded(S.jackknife(_mae(spark, sf_dir, 1.0, False).filter("metric = 'mae'"), "fold"))


@query("effective_n", D.sql("SELECT round(b, 6) AS \"between\", round(w, 5) AS within, round(b / (b + w), 6) AS icc, round(1 + (size - 1) * b / (b + w), 5) AS design_effect, round(n / (1 + (size - 1) * b / (b + w)), 2) AS n_eff FROM (SELECT var_pop(m) AS b, avg(v) AS w, sum(n)::DOUBLE AS n, sum(n * n) / sum(n)::DOUBLE AS size FROM (SELECT fold, avg(mu_age) AS m, var_pop(mu_age) AS v, count(*) AS n FROM preds GROUP BY 1))"))
def effective_n(spark, sf_dir):
    e = S.effective_n(D.preds(spark, sf_dir), "fold", "mu_age")
    return e.select(F.round("between", 6).alias("between"), F.round("within", 5).alias("within"), F.round("icc", 6).alias("icc"), F.round("design_effect", 5).alias("design_effect"), F.round("n_eff", 2).alias("n_eff"))


@query("bar_resolvability", D.sql("SELECT fold, round(avg((p0 <= 0.35)::INT), 6) AS pass_rate, round(quantile_cont(p0, 0.5), 6) AS p50, round(quantile_cont(p0, 0.9), 6) AS p90, round(quantile_cont(p0, 0.95), 6) AS usable_bar, round(avg((p0 BETWEEN 0.2 AND 0.4)::INT), 6) AS band_rate FROM probs GROUP BY 1"))
def bars(spark, sf_dir):
    null = D.probs(spark, sf_dir).select("fold", F.col("p0").alias("x"))
    return rounded(S.bar_pass(null, ["fold"], 0.35).join(S.band_pass(null, ["fold"], 0.2, 0.4), "fold"))


@query("interval_report", D.sql("SELECT fold, round(c, 6) AS coverage, round(c - 0.9, 6) + 0.0 AS gap, round(w, 6) AS width, round(w / (2 * sd), 6) AS rel_width, CASE WHEN abs(c - 0.9) <= 0.05 THEN CASE WHEN w / (2 * sd) < 2 THEN 'useful' ELSE 'wide' END WHEN c < 0.9 THEN 'under' ELSE 'over' END AS verdict FROM (SELECT fold, avg((abs(mu_age - y_age) <= 2.1 * sigma_age)::INT) AS c, avg(4.2 * sigma_age) AS w, stddev_pop(y_age) AS sd FROM preds WHERE age_mask GROUP BY 1)"))
def interval_report(spark, sf_dir):
    df = D.preds(spark, sf_dir).filter("age_mask")
    s = 2.1 * F.col("sigma_age")
    return rounded(S.interval_report(df.select("fold", (F.col("mu_age") - s).alias("low"), (F.col("mu_age") + s).alias("high"), F.col("y_age").alias("true")), ["fold"]))


@query("pooled_ece_draws")
def pooled_ece_draws(spark, sf_dir):
    """4,000 draws, by distinct probability."""
    df = D.probs(spark, sf_dir).withColumn("safe", (F.col("y") == 0).cast("int"))
    return rounded(S.pooled_ece_draws(df, "p0", "safe"))


@query("pooled_ece", D.sql("""SELECT round(max(e) FILTER (trial = 0), 6) AS ece, round(median(e) FILTER (trial > 0), 6) AS floor, round(max(e) FILTER (trial = 0) - median(e) FILTER (trial > 0), 6) AS excess, (SELECT count(*) / 20.0::DOUBLE FROM each WHERE trial > 0 AND round(e, 12) < (SELECT round(e, 12) FROM each WHERE trial = 0)) AS pctile, max(n)::BIGINT AS n FROM each""", each="""
  SELECT trial, sum(g) / sum(n) AS e, sum(n) AS n FROM (SELECT trial, b, abs(sum(CASE WHEN trial = 0 THEN (y = 0)::INT WHEN ('0x' || substr(md5('3|' || cell_id || '|' || trial), 1, 8))::UBIGINT / 4294967296.0 < p0 THEN 1 ELSE 0 END) - sum(p0)) AS g, count(*) AS n
  FROM (SELECT *, least(floor(p0 * 10), 9) AS b FROM probs), (SELECT unnest(range(21)) AS trial) GROUP BY trial, b) GROUP BY trial"""))
def pooled_ece(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumn("safe", (F.col("y") == 0).cast("int"))
    return rounded(S.pooled_ece(df, "p0", "safe", 10, 20, 3))


_EST = """SELECT regime, estimator, 0.5 + 0.1 * (CASE estimator WHEN 'model' THEN 3 WHEN 'ridge' THEN 2 ELSE 1 END) - 0.2 * (regime = 2 AND estimator = 'model')::INT AS prauc, avg(abs(mu_age * f - y_age)) AS mae, 0.02 * (1 + regime % 3) AS ece, 0.88 + 0.01 * regime AS coverage, 0.21 + 0.1 * regime AS spearman
  FROM preds, (VALUES ('model', 1.0::DOUBLE), ('ridge', 0.9::DOUBLE), ('mean', 0.0::DOUBLE)) v(estimator, f), (SELECT unnest(range(5)) AS regime) WHERE fold % 5 = regime GROUP BY regime, estimator, f"""


def _estimates(spark, sf_dir):
    arms = F.explode(F.array(*(F.struct(F.lit(n).alias("estimator"), F.lit(f).alias("f"), F.lit(k).alias("k")) for n, f, k in (("model", 1.0, 3), ("ridge", 0.9, 2), ("mean", 0.0, 1)))))
    df = D.preds(spark, sf_dir).withColumn("a", arms).withColumn("regime", F.col("fold") % 5)
    g = df.groupBy("regime", F.col("a.estimator").alias("estimator"), F.col("a.k").alias("k")).agg(F.avg(F.abs(F.col("mu_age") * F.col("a.f") - F.col("y_age"))).alias("mae"))
    odd = ((F.col("regime") == 2) & (F.col("estimator") == "model")).cast("int")
    return g.select("regime", "estimator", (0.5 + 0.1 * F.col("k") - 0.2 * odd).alias("prauc"), "mae", (0.02 * (1 + F.col("regime") % 3)).alias("ece"), (0.88 + 0.01 * F.col("regime")).alias("coverage"), (0.21 + 0.1 * F.col("regime")).alias("spearman"))


@query("gates", D.sql("SELECT regime::INT AS regime, m.prauc > best_p AND m.mae <= best_m AS beats_all, ece < 0.05 AS ece_ok, abs(coverage - 0.9) < 0.03 AS coverage_ok, spearman > 0.3 AS ranks, m.prauc > best_p AND m.mae <= best_m AND ece < 0.05 AND abs(coverage - 0.9) < 0.03 AND spearman > 0.3 AS accepted FROM est m JOIN (SELECT regime, max(prauc) AS best_p, min(mae) AS best_m FROM est WHERE estimator <> 'model' GROUP BY 1) USING (regime) WHERE estimator = 'model'", est=_EST))
def gates(spark, sf_dir):
    return S.gates(_estimates(spark, sf_dir))


@query("leaderboard", D.sql("SELECT estimator, round(avg(prauc), 6) AS mean_prauc FROM est GROUP BY 1", est=_EST))
def leaderboard(spark, sf_dir):
    return rounded(S.leaderboard(_estimates(spark, sf_dir)))


@query("timepoints", D.sql("SELECT donor, t, round(value, 6) AS value, n FROM points"))
def timepoints(spark, sf_dir):
    return rounded(T.timepoints(D.course(spark, sf_dir).withColumnRenamed("day", "t"), 3, 2))


@query("forward_pairs", D.sql("SELECT donor, count(*) AS n, sum(b.t - a.t)::BIGINT AS total_dt, round(sum(b.value - a.value), 5) + 0.0 AS change FROM points a JOIN points b USING (donor) WHERE b.t > a.t GROUP BY 1"))
def forward_pairs(spark, sf_dir):
    p = T.forward_pairs(T.timepoints(D.course(spark, sf_dir).withColumnRenamed("day", "t"), 3, 2))
    return rounded(p.groupBy("donor").agg(F.count("*").alias("n"), F.sum("dt").alias("total_dt"), F.sum(F.col("v_j") - F.col("v_i")).alias("change")), 5)


@query("matched_pairs", D.sql("SELECT donor, day, max(value) FILTER (b = 0) AS v_one, max(value) FILTER (b = 1) AS v_two, round(max(value) FILTER (b = 1) - max(value) FILTER (b = 0), 6) + 0.0 AS \"offset\" FROM (SELECT *, row_id % 2 AS b FROM course) GROUP BY 1, 2 HAVING count(*) FILTER (b = 0) = 1 AND count(*) FILTER (b = 1) = 1"))
def matched_pairs(spark, sf_dir):
    return rounded(T.matched_pairs(D.course(spark, sf_dir).withColumn("batch", F.col("row_id") % 2), ["donor", "day"], "batch", 0, 1))


@query("batch_offset", D.sql("""SELECT n, CASE WHEN n >= 3 THEN round(m, 6) + 0.0 END AS mean_offset, CASE WHEN n >= 3 THEN round(m - h, 6) + 0.0 END AS ci_low, CASE WHEN n >= 3 THEN round(m + h, 6) + 0.0 END AS ci_high, CASE WHEN n = 0 THEN 'NOT_ESTIMABLE' WHEN n < 3 THEN 'INDETERMINATE' WHEN m - h > 0 OR m + h < 0 THEN 'BATCH_EFFECT' ELSE 'NO_BATCH_EFFECT' END AS status FROM (
  SELECT count(*) AS n, avg(o) AS m, stddev_samp(o) / sqrt(count(*)) * CASE count(*) - 1 WHEN 2 THEN 4.303 WHEN 3 THEN 3.182 WHEN 4 THEN 2.776 WHEN 5 THEN 2.571 WHEN 6 THEN 2.447 ELSE 1.96 END AS h
  FROM (SELECT max(value) FILTER (b = 1) - max(value) FILTER (b = 0) AS o FROM (SELECT *, row_id % 2 AS b FROM course) GROUP BY donor, day HAVING count(*) FILTER (b = 0) = 1 AND count(*) FILTER (b = 1) = 1))"""))
def batch_offset(spark, sf_dir):
    return rounded(V.batch_offset(T.matched_pairs(D.course(spark, sf_dir).withColumn("batch", F.col("row_id") % 2), ["donor", "day"], "batch", 0, 1)))


@query("nearest_reference", D.sql("SELECT donor, row_id, t, ref_id, t_ref, ref_value FROM (SELECT r.donor, r.row_id, r.day AS t, f.row_id AS ref_id, f.day AS t_ref, f.value AS ref_value, row_number() OVER (PARTITION BY r.row_id ORDER BY abs(r.day - f.day), f.row_id) AS k FROM course r JOIN course f USING (donor) WHERE r.row_id % 10 <> 0 AND f.row_id % 10 = 0) WHERE k = 1"))
def nearest_reference(spark, sf_dir):
    c = D.course(spark, sf_dir)
    refs = c.filter("row_id % 10 = 0").select("donor", F.col("row_id").alias("ref_id"), F.col("day").alias("t_ref"), F.col("value").alias("ref_value"))
    return T.nearest(c.filter("row_id % 10 <> 0").select("donor", "row_id", F.col("day").alias("t")), refs)


@query("level_correction", D.sql("""SELECT c.fold, k::INT AS k, round(avg(sc_shift), 5) AS sc_shift, round(avg(sc_mae), 6) AS sc_mae, round(avg(mt_shift), 5) AS mt_shift, round(avg(mt_mae), 6) AS mt_mae, round(any_value(base_shift), 6) AS base_shift, round(any_value(base_mae), 6) AS base_mae FROM (
    SELECT fold, k, repeat, abs(median(mu_age - o) - median(y_age)) AS sc_shift, avg(abs(mu_age - o - y_age)) AS sc_mae, abs(median(mu_age - near) - median(y_age)) AS mt_shift, avg(abs(mu_age - near - y_age)) AS mt_mae
    FROM (SELECT w.fold, w.repeat, k, w.mu_age, w.y_age, o, list_sort(list_transform(refs, lambda x: {'gap': abs(x.t - w.t), 'id': x.cell_id, 'e': x.e}))[1].e AS near FROM walk w
      JOIN (SELECT fold, repeat, k, median(mu_age - y_age) AS o, list({'cell_id': cell_id, 't': t, 'e': mu_age - y_age}) AS refs FROM walk, (SELECT unnest([1, 3, 5]) AS k) WHERE r <= k GROUP BY ALL) USING (fold, repeat) WHERE w.r > k) GROUP BY ALL) c
  JOIN (SELECT fold, abs(median(mu_age) - median(y_age)) AS base_shift, avg(abs(mu_age - y_age)) AS base_mae, count(*) AS n FROM timed GROUP BY 1) USING (fold) WHERE n - k >= 3 GROUP BY c.fold, k""",
  timed="SELECT p.*, c.time_h AS t FROM preds p JOIN cells c USING (cell_id) WHERE age_mask",
  walk="SELECT *, row_number() OVER (PARTITION BY fold, repeat ORDER BY ('0x' || substr(md5('5|' || repeat || '|' || cell_id), 1, 8))::UBIGINT, cell_id) AS r FROM timed, (SELECT unnest(range(3)) AS repeat)"))
def level_correction(spark, sf_dir):
    """k references of each fold, three draws: a scalar offset, and that of the reference nearest in time."""
    df = D.preds(spark, sf_dir).filter("age_mask").join(D.cells(spark, sf_dir).select("cell_id", F.col("time_h").alias("t")), "cell_id")
    out = V.level_correction(df, [1, 3, 5], 3, 5)
    return rounded(out.withColumns({c: F.round(c, 5) for c in ("sc_shift", "mt_shift")}))


@query("trajectory_shape", D.sql("""SELECT donor, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round(c, 6) + 0.0 AS c, round(c / nullif(se, 0), 4) + 0.0 AS t_curve, round(1 - sse / nullif(sst, 0), 6) AS r2, CASE WHEN abs(c / nullif(se, 0)) < 2 THEN CASE WHEN abs(b) > 2 * sqrt(sse / (n - 3) / n) THEN 'monotonic' ELSE 'none' END WHEN c < 0 THEN 'HUMP' ELSE 'U' END AS shape FROM (
  SELECT *, sqrt(sse / (n - 3) * n * n / det) AS se FROM (SELECT *, greatest(yy - a * y0 - b * y1 - c * y2, 0) AS sse, yy - y0 * y0 / n AS sst FROM (SELECT *, (y1 - c * s3) / n AS b, y0 / n - c AS a FROM (SELECT *, (n * n * y2 - n * s3 * y1 - n * n * y0) / det AS c FROM (
    SELECT *, n * (n * s4 - s3 * s3) - power(n, 3) AS det FROM (SELECT donor, count(*)::DOUBLE AS n, sum(power(z, 3)) AS s3, sum(power(z, 4)) AS s4, sum(value) AS y0, sum(value * z) AS y1, sum(value * z * z) AS y2, sum(value * value) AS yy
      FROM (SELECT *, (t - avg(t) OVER (PARTITION BY donor)) / nullif(stddev_pop(t) OVER (PARTITION BY donor), 0) AS z FROM points) WHERE z IS NOT NULL GROUP BY 1)) WHERE n >= 4 AND abs(det) > 1e-6))))"""))
def trajectory_shape(spark, sf_dir):
    return rounded(T.trajectory_shape(T.timepoints(D.course(spark, sf_dir).withColumnRenamed("day", "t"), 3, 2)).withColumn("t_curve", F.round("t_curve", 4)))


@query("timecourse_rises", D.sql("SELECT m[len(m)] < m[1] AS falls, round(p[len(p)] - p[len(p) - k], 6) + 0.0 AS late, round(p[1 + k] - p[1], 6) + 0.0 AS early, p[len(p)] - p[len(p) - k] >= p[1 + k] - p[1] AS late_rise FROM (SELECT list(m ORDER BY day) AS m, list(p ORDER BY day) AS p, greatest(1, count(*) // 3) AS k FROM (SELECT day, avg(value) AS m, avg((row_id % 10) / 10.0::DOUBLE) AS p FROM course GROUP BY 1))"))
def timecourse_rises(spark, sf_dir):
    """Falls are of the age (value), rises of the identity loss."""
    return rounded(T.rises(D.course(spark, sf_dir).withColumn("loss", F.col("row_id") % 10 / 10.0), loss="loss"))


@query("delta_by_grouping_sets", D.sql("SELECT coalesce(chunk_id, -1) AS chunk_id, coalesce(cell_line, -1) AS cell_line, coalesce(is_control::INT, -1) AS is_control, count(*) AS n, round(avg(d_age), 6) + 0.0 AS mean_delta FROM deltas GROUP BY GROUPING SETS ((cell_line, is_control), (chunk_id, cell_line), (chunk_id), ())"))
def grouping_sets(spark, sf_dir):
    b = Build(spark, sf_dir)
    d = X.delta_age(b.ages(), b.kept())
    keys = ["chunk_id", "cell_line", "is_control"]
    col = {k: F.col(k) for k in keys}
    out = d.groupingSets([[col["cell_line"], col["is_control"]], [col["chunk_id"], col["cell_line"]], [col["chunk_id"]], []], *keys).agg(F.count("*").alias("n"), F.avg("d_age").alias("mean_delta"))
    return rounded(out.withColumns({k: F.coalesce(F.col(k).cast("int"), F.lit(-1)) for k in keys}))


@query("control_gap", D.sql("SELECT round(abs(a - b), 6) + 0.0 AS gap, abs(a - b) < 3 AS passed FROM (SELECT avg(d_age) FILTER (chunk_id = 0) AS a, avg(d_age) FILTER (chunk_id = 1) AS b FROM deltas WHERE is_control)"))
def control_gap(spark, sf_dir):
    """How far the controls of two datasets are apart after the shift; within three years passes."""
    b = Build(spark, sf_dir)
    d = X.delta_age(b.ages(), b.kept()).filter("is_control")
    mean = lambda c: F.avg(F.when(F.col("chunk_id") == c, F.col("d_age")))
    return rounded(d.agg(F.abs(mean(0) - mean(1)).alias("gap")).withColumn("passed", F.col("gap") < 3))


@query("variance_share", D.sql("""SELECT region, n, round(share, 6) AS share, round(lo, 6) AS share_low, round(hi, 6) AS share_high, round(sqrt(greatest(v - 4.0, 0)), 6) AS residual_sd, CASE WHEN hi - lo > 0.5 THEN 'INDETERMINATE' WHEN share >= 0.6 THEN 'BASELINE_DOMINATES' WHEN share < 0.3 THEN 'BASELINE_MINOR' ELSE 'INDETERMINATE' END AS status FROM (
  SELECT region, n, v, least(4.0 / v, 1) AS share, least(4.0 / (v * 4 / 0.484), 1) AS lo, least(4.0 / (v * 4 / 11.143), 1) AS hi FROM (SELECT fold % 5 AS region, count(*) AS n, var_samp(o) AS v FROM (SELECT fold, median(mu_age) - median(y_age) + fold AS o FROM preds WHERE age_mask GROUP BY 1) GROUP BY 1))"""))
def variance_share(spark, sf_dir):
    """Five folds a region, their offsets against a clock whose error is two years."""
    half = F.lit(0.5)
    offsets = D.preds(spark, sf_dir).filter("age_mask").groupBy("fold").agg((F.percentile("mu_age", half) - F.percentile("y_age", half) + F.col("fold")).alias("offset"))
    return rounded(V.variance_share(offsets.withColumn("region", F.col("fold") % 5), ["region"], 2.0))


@query("external_agreement", D.sql("SELECT fold, round(corr(mu_age, y_age), 6) AS pearson, round(avg(mu_age - y_age), 6) + 0.0 AS bias, count(*) AS n FROM preds GROUP BY 1"))
def external_agreement(spark, sf_dir):
    return rounded(D.preds(spark, sf_dir).groupBy("fold").agg(safe_corr(F.col("mu_age"), F.col("y_age")).alias("pearson"), F.avg(F.col("mu_age") - F.col("y_age")).alias("bias"), F.count("*").alias("n")))

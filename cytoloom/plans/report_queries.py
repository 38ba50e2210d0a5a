"""Queries of reports: coverage, pool composition, bundles by part, level shifts from a snapshot, typed features, a fitted logistic arm."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as B, evaluation as V, expression as X, heldout as H, metrics as M, reports as RP, splits as SP, statistics as ST
from ..sources import samples as IO
from ..streaming.run import shared_path, staged
from . import domain as D, evaluation_queries as E
from .build_queries import Build
from .registry import query, rounded
from .split_queries import FRACS, SEED

Q, SCALE = 4.0, 1.5


@query("coverage_report", D.sql("SELECT origin, count(*) AS n, round(avg((e <= 4.0)::INT), 6) AS coverage, round(avg(e), 6) AS abs_residual, round(quantile_cont(r, 0.1), 6) AS sigma_over_q_p10, round(quantile_cont(r, 0.5), 6) AS sigma_over_q_p50, round(quantile_cont(r, 0.9), 6) AS sigma_over_q_p90, round(avg((round(r, 9) < 0.5)::INT), 6) AS under_half_q FROM (SELECT origin, abs(mu_age - y_age) AS e, sigma_age * 1.5 / 4.0::DOUBLE AS r FROM org WHERE age_mask) GROUP BY 1", org=E._ORIGIN))
def coverage_report(spark, sf_dir):
    return rounded(RP.coverage_report(E._origin(spark, sf_dir), Q, SCALE))


@query("pool_composition", D.sql("SELECT donor, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(avg(abs(mu_age - y_age)), 6) AS abs_residual, count(*) OVER () >= 2 AS calibrated FROM org WHERE origin = 'xdonor' AND age_mask GROUP BY 1", org=E._ORIGIN))
def pool_composition(spark, sf_dir):
    return rounded(RP.pool_composition(E._origin(spark, sf_dir).filter("origin = 'xdonor'")))


_PARTS = {
    "dealt": f"SELECT *, CASE cell_id % 10 WHEN 8 THEN 'calib' WHEN 9 THEN 'test' ELSE 'train' END AS split, {E._PLATT_SQL} AS ps FROM probs",
    "parts": "SELECT *, split AS part FROM dealt WHERE split <> 'train' UNION ALL SELECT *, 'pool' FROM dealt WHERE fold % 4 = 0",
}


@query("diagnostic_parts", D.sql("SELECT fold, part, arm, count(*) AS n, count(*) FILTER (age_mask) AS n_age_valid, count(*) FILTER (NOT in_dist) AS n_flagged, round(sum(a), 5) AS safe_mass, round(sum(b), 5) AS loss_mass FROM (SELECT fold, part, age_mask, in_dist, unnest(['raw', 'calibrated']) AS arm, unnest([p0, ps]) AS a, unnest([p1, p1 * (1 - ps) / (1 - p0)]) AS b FROM parts) GROUP BY ALL", **_PARTS))
def diagnostic_parts(spark, sf_dir):
    """The bundle of pool, calibration and test rows, raw and calibrated, written by fold and read back."""
    k = F.col("cell_id") % 10
    df = D.probs(spark, sf_dir).withColumn("split", F.when(k == 8, "calib").when(k == 9, "test").otherwise("train"))
    path = shared_path(spark, "bundle")
    IO.write_samples(RP.bundle(df, E.PLATT, F.col("fold") % 4 == 0), path, "fold")
    back = spark.read.parquet(path)
    g = back.groupBy("fold", "part", "arm").agg(F.count("*").alias("n"), F.count_if("age_mask").alias("n_age_valid"), F.count_if(~F.col("in_dist")).alias("n_flagged"), F.sum("p_safe").alias("safe_mass"), F.sum("p_loss").alias("loss_mass"))
    return rounded(g, 5)


@query("level_shifts", D.sql("SELECT fold::VARCHAR AS fold, round(median(mu_age) - median(y_age), 6) + 0.0 AS level_shift FROM preds WHERE age_mask GROUP BY fold"))
def level_shifts(spark, sf_dir):
    """Each fold's level shift, written to a snapshot with another figure and read from the first path that is there."""
    half = F.lit(0.5)
    g = D.preds(spark, sf_dir).filter("age_mask").groupBy(F.col("fold").cast("string").alias("fold")).agg((F.percentile("mu_age", half) - F.percentile("y_age", half)).alias("level_shift_model"), F.count("*").cast("double").alias("n_cells"))
    path, absent = shared_path(spark, "snapshot"), shared_path(spark, "absent")
    M.long_form(g, ["fold"], ["level_shift_model", "n_cells"]).write.json(path)
    return rounded(RP.level_shifts(spark, [absent, path]))


_SOFT = "SELECT cell_id, cell_line, CASE WHEN cell_id % 4 = 3 THEN NULL WHEN cell_id % 4 = 0 THEN [1.0::DOUBLE, 0, 1] END AS fp, CASE WHEN cell_id % 4 IN (1, 2) THEN [dose_um, 0.5, 0, 2] END AS tf, log10(greatest(dose_um, 1e-4)) AS log_dose, [p0, p1, p2] AS p, y_age, age_mask FROM cells JOIN probs USING (cell_id)"


@query("gather_features", D.sql("SELECT cell_id, cell_line, len(coalesce(fp, tf))::INT AS width, round(list_sum(coalesce(fp, tf)), 3) AS mass, round(log_dose, 4) AS log_dose, (list_position(list_transform(p, lambda x: round(x, 9)), list_max(list_transform(p, lambda x: round(x, 9)))) - 1)::INT AS y, y_age, age_mask FROM soft JOIN (SELECT cell_id FROM (SELECT cell_id, (('0x' || substr(md5('7|' || cell_id), 1, 8))::UBIGINT / 4294967296.0) AS u FROM cells) WHERE u >= 0.7 AND u < 0.8) USING (cell_id) WHERE fp IS NOT NULL OR tf IS NOT NULL", soft=_SOFT))
def gather_features(spark, sf_dir):
    """Validation rows with typed features; a quarter of the rows has no perturbation and is left out."""
    c = D.cells(spark, sf_dir)
    k = F.col("cell_id") % 4
    p = D.probs(spark, sf_dir).select("cell_id", F.array("p0", "p1", "p2").alias("y_soft"), "y_age", "age_mask")
    s = c.join(p, "cell_id").withColumns({
        "x": F.array("dose_um", "time_h"), "fp": F.when(k == 0, F.array(F.lit(1), F.lit(0), F.lit(1))), "tf": F.when(k.isin(1, 2), F.array(F.col("dose_um"), F.lit(0.5), F.lit(0.0), F.lit(2.0))),
        "log_dose": F.log10(F.greatest("dose_um", F.lit(1e-4))), "log_time": F.ln("time_h"),
    })
    out = RP.gather_features(s, SP.make_splits(c, ["random"], FRACS, SEED), "random", "val")
    total = F.aggregate("perturbation", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("cell_id", "cell_line", F.size("perturbation").alias("width"), F.round(total, 3).alias("mass"), F.round(F.col("dose_time")[0].cast("double"), 4).alias("log_dose"), "y", "y_age", "age_mask")


_FITS = {
    "vt": E._VT,
    "errors": "SELECT fold, avg(abs(mu_age - y_age)) FILTER (split = 'train') * (1 + fold % 3) / 3 AS b, avg(abs(mu_age - y_age)) FILTER (split = 'test') AS c FROM vt WHERE age_mask GROUP BY 1",
    "classes": "SELECT *, CASE WHEN round(b - 0.4::DOUBLE * c, 9) < 0 THEN 'MEMORIZING' WHEN round(b - 0.75::DOUBLE * c, 9) > 0 THEN 'CANNOT_FIT' ELSE 'PARTIAL' END AS verdict FROM errors",
}


def _errors(spark, sf_dir):
    """Errors of folds; a third of the folds has a training error of a third, and another of two thirds of the measured one."""
    g = V.overfit_classes(E._with_split(spark, sf_dir), ["fold"], F.lit(False))
    return g.select("fold", (F.col("train_donors") * (1 + F.col("fold") % 3) / 3).alias("train_donors"), "test")


@query("overfit_verdict", D.sql("SELECT fold, round(b, 6) AS train_donors, round(c, 6) AS test, verdict FROM classes", **_FITS))
def overfit_verdict(spark, sf_dir):
    """The class of each fold by its training error against that of its test rows."""
    return rounded(_errors(spark, sf_dir).withColumn("verdict", V.fit_verdict(F.col("train_donors"), F.col("test"))))


@query("overfit_summary", D.sql("SELECT round(mt, 6) AS mean_train, round(mc, 6) AS mean_test, nm AS n_memorizing, nc AS n_cannot_fit, n, round(mc / mt, 6) AS ratio, CASE WHEN nm >= nc AND nm >= n / 2 THEN 'MEMORIZING' WHEN nc >= n / 2 THEN 'CANNOT_FIT' ELSE 'MIXED' END AS verdict FROM (SELECT avg(b) AS mt, avg(c) AS mc, count(*) FILTER (verdict = 'MEMORIZING') AS nm, count(*) FILTER (verdict = 'CANNOT_FIT') AS nc, count(*) AS n FROM classes WHERE b IS NOT NULL AND c IS NOT NULL)", **_FITS))
def overfit_summary(spark, sf_dir):
    return rounded(V.overfit_summary(_errors(spark, sf_dir)))


def _judged(ci):
    """A paired interval with what it says."""
    status = F.when(F.round("ci_low", 9) > 0, "MODEL_BETTER").when(F.round("ci_high", 9) < 0, "MODEL_WORSE").otherwise("TIED")
    return rounded(ci.select("mean_diff", "ci_low", "ci_high", "n", "wins", "losses", status.alias("status")), 4)


@query("logistic_against_model")
def logistic_against_model(spark, sf_dir):
    """PR-AUC of the safe class by the model and by a logistic regression fitted with each of five groups of donors left out, paired by fold. Folds of one class are left out."""
    cols = ["z1", "z2", "sigma_age"]
    df = D.probs(spark, sf_dir).withColumns({"region": F.col("fold") % 5, "hit": (F.col("y") == 0).cast("int"), "model": F.col("p0")})
    df = staged(df.select("fold", "region", "hit", "model", *cols), "arms")  # fits read it again and again
    counts = df.groupBy("fold").agg(F.sum("hit").alias("h"), F.count("*").alias("n")).filter("h BETWEEN 1 AND n - 1").select("fold")

    out = RP.held_out_pairs(df, "region", list(range(5)), lambda train: B.balanced_logistic(train, cols, "hit"), ["fold", "hit", "model", "fitted"]).join(counts, "fold", "left_semi")
    of = lambda c: M.prauc(out.select("fold", "hit", F.round(c, 9).alias("s")), ["fold"], "s", "hit").withColumnRenamed("prauc", "value")
    ci = ST.paired_ci(ST.paired(of("model"), of("fitted"), ["fold"]), [])
    return _judged(ci)


@query("embedding_fate")
def embedding_fate(spark, sf_dir):
    """PR-AUC of the safe class by logistic fits on embedded and on raw profiles, five groups of donors left out in turn, paired by fold. Folds of one class are left out."""
    b = Build(spark, sf_dir)
    truth = D.preds(spark, sf_dir).select("cell_id", "fold", (F.col("fold") % 5).alias("region"), (F.col("y") == 0).cast("int").alias("hit"))
    both = truth.groupBy("fold").agg(F.sum("hit").alias("h"), F.count("*").alias("n")).filter("h BETWEEN 1 AND n - 1").select("fold")
    arms = []
    for name, feats, cols in E.profile_views(b):
        df = staged(truth.join(feats, "cell_id", "left").na.fill(0.0, cols), f"fate-{name}")  # fits read it again and again
        out = RP.held_out_pairs(df, "region", list(range(5)), lambda train, cols=cols: B.balanced_logistic(train, cols, "hit"), ["fold", "hit", "fitted"])
        out = out.join(both, "fold", "left_semi").select("fold", "hit", F.round("fitted", 9).alias("s"))
        arms.append(M.prauc(out, ["fold"], "s", "hit").withColumnRenamed("prauc", "value"))
    return _judged(ST.paired_ci(ST.paired(*arms, ["fold"]), []))


@query("left_out_fates")
def left_out_fates(spark, sf_dir):
    """The fate part of the chain with each group of donors left out: PR-AUC and log loss of the safe class; a fold that fails is a row with its error."""
    df = D.preds(spark, sf_dir).withColumns({"region": F.col("fold") % 5, "hit": (F.col("y") == 0).cast("int")})
    cols = ["z1", "z2", "sigma_age"]
    df = staged(df.select("region", "hit", *cols), "fates")  # fits read it again and again
    return rounded(H.leave_group_out_fate(df, "region", list(range(5)), cols, "hit"), 4)


_SHIFTS = {
    "arms": "SELECT arm, chunk_id, cell_line, time_h, is_control, d FROM (SELECT 'raw' AS arm, cell_id, age - (SELECT avg(age) FILTER (c.is_control) FROM ages JOIN cells c USING (cell_id)) AS d FROM ages UNION ALL SELECT 'by_line', cell_id, d_age FROM deltas) JOIN cells USING (cell_id) WHERE d IS NOT NULL",
}


def _shift_report(spark, sf_dir, raw: bool):
    """Shifts from the mean of all controls, or from that of the line's."""
    b = Build(spark, sf_dir)
    where = b.kept().select("cell_id", F.col("chunk_id").alias("dataset"), F.col("cell_line").alias("line"), F.col("time_h").alias("day"), "is_control")
    if raw:
        rows = b.ages().join(where, "cell_id")
        mean = rows.filter("is_control").agg(F.avg("age").alias("m"))
        return RP.shift_report(rows.crossJoin(F.broadcast(mean)).withColumn("d_age", F.col("age") - F.col("m")))  # one row
    return RP.shift_report(X.delta_age(b.ages(), b.kept()).select("cell_id", "d_age").join(where, "cell_id"))


@query("shift_report", D.sql("SELECT CASE grouping(chunk_id, cell_line, time_h) WHEN 0 THEN 'time' WHEN 1 THEN 'line' WHEN 3 THEN 'dataset' ELSE 'all' END AS level, coalesce(chunk_id, -1) AS dataset, coalesce(cell_line, -1) AS line, coalesce(time_h, -1) AS day, count(*) FILTER (is_control) AS n_control, round(avg(d) FILTER (is_control), 6) + 0.0 AS mean_control, count(*) FILTER (NOT is_control) AS n_treated, round(avg(d) FILTER (NOT is_control), 6) + 0.0 AS mean_treated FROM arms WHERE arm = 'raw' GROUP BY ROLLUP (chunk_id, cell_line, time_h)", **_SHIFTS))
def shift_report(spark, sf_dir):
    """Age shifts of controls and treated cells by dataset, line and time; -1 stands for all of a column."""
    return rounded(_shift_report(spark, sf_dir, True).na.fill(-1, ["dataset", "line", "day"]))


@query("control_gap", D.sql("SELECT arm, lo.dataset AS low_dataset, hi.dataset AS high_dataset, round(round(hi.m - lo.m, 9), 6) + 0.0 AS gap, CASE WHEN round(hi.m - lo.m, 9) < 0.05 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT arm, min({'m': m, 'dataset': chunk_id}) AS lo, max({'m': m, 'dataset': chunk_id}) AS hi FROM (SELECT arm, chunk_id, round(avg(d), 9) + 0.0 AS m FROM arms WHERE is_control GROUP BY ALL) GROUP BY arm HAVING count(*) >= 2)", **_SHIFTS))
def control_gap(spark, sf_dir):
    """How far apart the controls of datasets lie: before and after each line's own are taken off."""
    return rounded(M.union_all(*(RP.control_gap(_shift_report(spark, sf_dir, raw), 0.05).withColumn("arm", F.lit(arm)) for arm, raw in (("raw", True), ("by_line", False)))))

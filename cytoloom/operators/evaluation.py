"""Evaluation of estimators: score cards by fold, gates by regime, error scales of donors, calibration reports, level corrections.

Estimators are a column, not a loop: every table here holds all of them, and each metric is one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import entropy, logit, sigmoid, unit_hash
from . import metrics as M, scoring as S

#: 95 % points of chi-squared (0.025, 0.975) by degrees of freedom; others take those of 5
CHI_SQUARED = {2: (0.051, 7.378), 3: (0.216, 9.348), 4: (0.484, 11.143), 5: (0.831, 12.833), 6: (1.237, 14.449), 7: (1.690, 16.013), 8: (2.180, 17.535)}
#: two-sided 95 % points of Student's t for the batch offset; beyond them the normal's
T_FEW = {2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447}
T_MANY = 1.96


def _lookup(n: Column, table: dict, other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(n == k, v).otherwise(out)
    return out


# ---- states against states ----------------------------------------------------------------------------------------


def mean_shift(expr: DataFrame, cells: DataFrame, by: str, controls: DataFrame) -> DataFrame:
    """by, gene, shift: the mean absolute difference of the group's cells from the controls' mean, absent entries being zeros.

    cells: cell_id, by; controls: cell_id. Genes and groups are dimensions; cells are only aggregated.
    """
    n = controls.agg(F.count("*").alias("n"))
    mean = expr.join(controls.select("cell_id"), "cell_id", "left_semi").groupBy("gene").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(n)).select("gene", (F.col("s") / F.col("n")).alias("c"))
    genes = expr.select("gene").distinct().join(mean, "gene", "left").select("gene", F.coalesce("c", F.lit(0.0)).alias("c"))
    grid = cells.groupBy(by).agg(F.count("*").alias("n_cells")).crossJoin(genes)
    sums = expr.join(cells.select("cell_id", by), "cell_id").join(genes, "gene").groupBy(by, "gene").agg(F.sum(F.abs(F.col("value") - F.col("c"))).alias("d"), F.count("*").alias("k"))
    missing = (F.col("n_cells") - F.coalesce("k", F.lit(0))) * F.abs("c")
    return grid.join(sums, [by, "gene"], "left").select(by, "gene", ((F.coalesce("d", F.lit(0.0)) + missing) / F.col("n_cells")).alias("shift"))


def nearest_state(truth: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """by, item, match, distance: the prediction of the group that is nearest to each true state by L1, the first on ties.

    Both: by, item, gene, value; states are sparse, and items are aggregates (few a group). |t - p| summed is |t| + |p| less what shared genes save, so
    only states that share a gene meet; besides them, the smallest prediction is a candidate.
    """
    size = lambda d: d.groupBy(*by, "item").agg(F.sum(F.abs("value")).alias("size"))
    t, p = size(truth), size(pred).select(*by, F.col("item").alias("match"), F.col("size").alias("p_size"))
    other = pred.select(*by, "gene", F.col("item").alias("match"), F.col("value").alias("p"))
    saved = F.sum(F.abs("value") + F.abs("p") - F.abs(F.col("value") - F.col("p")))
    shared = truth.join(other, [*by, "gene"]).groupBy(*by, "item", "match").agg(saved.alias("saved")).join(p, [*by, "match"])
    least = p.groupBy(*by).agg(F.min_by(F.struct("match", "p_size"), F.struct("p_size", "match")).alias("m")).select(*by, "m.*")
    every = shared.unionByName(t.select(*by, "item").join(least, by).withColumn("saved", F.lit(0.0))).join(t, [*by, "item"])
    d = F.round(F.col("size") + F.col("p_size") - F.col("saved"), 9)
    return every.groupBy(*by, "item").agg(F.min_by("match", F.struct(d, F.col("match"))).alias("match"), F.min(d).alias("distance"))


def pds(truth: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """by, pds: the share of true states whose nearest prediction is their own."""
    return nearest_state(truth, pred, by).groupBy(*by).agg(F.avg((F.col("item") == F.col("match")).cast("double")).alias("pds"))


# ---- score cards and gates ----------------------------------------------------------------------------------------


def scorecard(df: DataFrame, params: S.ScoreParams, q: float, by: str = "fold", least: int = 3) -> DataFrame:
    """by, metric, value: the nineteen metrics of a fold. Folds of fewer than `least` rows with an age are left out; a metric that is not defined is null.

    df: cell_id, by, s, p_loss, mu_age, sigma_age, in_dist, mu_ridge, s_platt, y (0 is safe), y_age, age_mask.
    """
    scored = S.efficacy(df, params)
    approved = lambda c: F.count_if(F.col("age_mask") & (F.col(c) == S.APPROVED)).cast("double")
    # the oracle's status is an expression over the same row, so no join is needed
    both = scored.withColumn("__oracle", _status(params, F.when(F.col("age_mask"), F.col("y_age")).otherwise(F.col("mu_age"))))
    masked = lambda c: F.when(F.col("age_mask"), c)
    half = F.lit(0.5)
    shift = lambda c: F.percentile(masked(F.col(c)), half) - F.percentile(masked(F.col("y_age")), half)
    error = lambda c: F.avg(masked(F.abs(F.col(c) - F.col("y_age"))))
    inside = (F.col("y_age") >= F.col("mu_age") - q) & (F.col("y_age") <= F.col("mu_age") + q)
    wide = both.groupBy(by).agg(
        F.count(masked(F.col("y_age"))).cast("double").alias("n_cells"), error("mu_age").alias("dage_mae_model"), error("mu_ridge").alias("dage_mae_ridge"), shift("mu_age").alias("level_shift_model"),
        shift("mu_ridge").alias("level_shift_ridge"), F.percentile(masked(F.col("res")), half).alias("res_median"), F.max(masked(F.col("res"))).alias("res_max"), approved("status").alias("res_approvals"),
        approved("__oracle").alias("res_approvals_oracle"), F.avg(masked(inside.cast("double"))).alias("conformal_coverage"), F.lit(2.0 * q).alias("conformal_width"), F.avg(masked((~F.col("in_dist")).cast("double"))).alias("ood_rate"),
    )
    valid = scored.filter("age_mask").select(by, (-F.col("y_age")).alias("g"), F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), c.alias("x")) for n, c in (("rank_res", F.round("res", 9)), ("rank_model_dage", -F.col("mu_age")), ("rank_ridge_dage", -F.col("mu_ridge")))))).alias("e")).select(by, "g", "e.*")
    ranks = M.spearman(valid, [by, "arm"], "x", "g").groupBy(by).pivot("arm", ["rank_res", "rank_model_dage", "rank_ridge_dage"]).agg(F.first("spearman"))
    safe = df.select(by, F.round("s", 9).alias("p"), F.col("s_platt").alias("p2"), (F.col("y") == 0).cast("int").alias("hit"))
    classes = safe.groupBy(by).agg((F.min("hit") < F.max("hit")).alias("both"))
    fate = M.prauc(safe, [by], "p", "hit").join(M.auroc(safe, [by], "p", "hit"), by).join(M.ece_binary(safe, [by], "p", "hit").withColumnRenamed("ece", "e1"), by).join(M.ece_binary(safe, [by], "p2", "hit").withColumnRenamed("ece", "e2"), by).join(classes, by)
    fate = fate.select(by, *(F.when(F.col("both"), F.col(c)).alias(n) for c, n in (("prauc", "fate_prauc"), ("auroc", "fate_roc"), ("e1", "fate_ece"), ("e2", "fate_ece_platt"))))
    all_ = wide.filter(F.col("n_cells") >= least).join(ranks, by, "left").join(fate, by, "left")
    return M.long_form(all_, [by], [c for c in all_.columns if c != by])


def _status(p: S.ScoreParams, mu: Column) -> Column:
    r = F.greatest(F.lit(0.0), -(mu + p.z_conf * F.col("sigma_age")))
    return F.when(~F.col("in_dist"), S.REJECTED_OOD).when(F.col("s") < p.tau_safe - 3 * p.w, S.REJECTED_UNSAFE).when(r == 0, S.REJECTED_NO_REJUVENATION).otherwise(S.APPROVED)


def evaluate(df: DataFrame, probs: list[str], q: float, params: S.ScoreParams) -> DataFrame:
    """regime, estimator, prauc, ece, mae, r2, n and, of `model`, coverage and spearman: what gates() takes. prauc and mae are rounded to 9 places, so that estimators that tie do so whatever the order of summation.

    df: regime, estimator, probs, mu_age, sigma_age, in_dist, y, y_age, age_mask: the predictions of all estimators in all regimes. prauc is the mean over classes that have rows.
    """
    by = ["regime", "estimator"]
    ovr = M.one_vs_rest(df, probs, "y").select(*by, "cls", F.round("p", 9).alias("p"), "hit")
    macro = M.prauc(ovr, [*by, "cls"], "p", "hit").groupBy(*by).agg(F.avg("prauc").alias("prauc"))
    fit = M.regression(df, by, "mu_age", "y_age", F.col("age_mask"))
    model = S.efficacy(df.filter("estimator = 'model' AND age_mask").withColumns({"s": F.col(probs[0]), "p_loss": F.col(probs[1])}), params)
    ranked = M.spearman(model.select("regime", F.round("res", 9).alias("res"), (-F.col("y_age")).alias("g")), ["regime"], "res", "g")
    covered = model.groupBy("regime").agg(M.coverage(F.col("mu_age") - q, F.col("mu_age") + q, F.col("y_age")).alias("coverage"))
    of_model = ranked.join(covered, "regime").withColumn("estimator", F.lit("model"))
    return fit.join(macro, by, "left").join(M.ece_top1(df, by, probs, "y"), by, "left").join(of_model, by, "left").select(*by, F.round("prauc", 9).alias("prauc"), "ece", F.round("mae", 9).alias("mae"), "r2", "n", "coverage", "spearman")


def fold_report(metrics: DataFrame, names: list[str], by: str = "fold") -> DataFrame:
    """One row a fold with a column a metric."""
    return metrics.groupBy(by).pivot("metric", names).agg(F.first("value"))


# ---- donors -------------------------------------------------------------------------------------------------------


def donor_error_scale(df: DataFrame, donor: str = "donor", most: float = 0.5) -> DataFrame:
    """donor, n, mae, sigma_mean, sigma_mc_mean, share of the pool, and whether one donor owns more than `most` of it. df: mu_age, y_age, age_mask, sigma_age, sigma_mc."""
    g = df.filter("age_mask").groupBy(donor).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("mu_age") - F.col("y_age"))).alias("mae"), F.avg("sigma_age").alias("sigma_mean"), F.avg("sigma_mc").alias("sigma_mc_mean"))
    total = g.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return g.crossJoin(F.broadcast(total)).select(donor, "n", "mae", "sigma_mean", "sigma_mc_mean", share.alias("share"), (share > most).alias("imbalanced"))


def batch_offset(pairs: DataFrame, least: int = 3) -> DataFrame:
    """n, mean_offset, ci_low, ci_high, status of paired offsets (column offset).

    The t points are those of n - 1 degrees of freedom, so intervals of few pairs are narrower than from a table that is looked up one off.
    """
    n = F.count("offset")
    g = pairs.agg(n.alias("n"), F.avg("offset").alias("m"), F.stddev_samp("offset").alias("sd"))
    half = _lookup(F.col("n") - 1, T_FEW, T_MANY) * F.col("sd") / F.sqrt("n")
    ok = F.col("n") >= least
    low, high = F.col("m") - half, F.col("m") + half
    status = F.when(F.col("n") == 0, "NOT_ESTIMABLE").when(~ok, "INDETERMINATE").when((low > 0) | (high < 0), "BATCH_EFFECT").otherwise("NO_BATCH_EFFECT")
    return g.select("n", F.when(ok, F.col("m")).alias("mean_offset"), F.when(ok, low).alias("ci_low"), F.when(ok, high).alias("ci_high"), status.alias("status"))


def variance_share(offsets: DataFrame, by: list[str], cv_mae: float, mostly: float = 0.6, little: float = 0.3) -> DataFrame:
    """How much of the donors' variance of offsets (column offset) one baseline sample with the clock's error explains: share with its interval, sd that is left, status."""
    g = offsets.groupBy(*by).agg(F.count("offset").alias("n"), F.var_samp("offset").alias("v"))
    ok = (F.col("n") >= 3) & (F.col("v") > 0)
    df, base = F.col("n") - 1, cv_mae**2
    part = lambda chi: F.least(F.lit(base) / (F.col("v") * df / chi), F.lit(1.0))
    low, high = part(_lookup(df, {k: v[0] for k, v in CHI_SQUARED.items()}, CHI_SQUARED[5][0])), part(_lookup(df, {k: v[1] for k, v in CHI_SQUARED.items()}, CHI_SQUARED[5][1]))
    share = F.least(F.lit(base) / F.nullif(F.col("v"), F.lit(0.0)), F.lit(1.0))
    status = F.when(~F.coalesce(ok, F.lit(False)), "CANNOT_VERIFY").when(high - low > 0.5, "INDETERMINATE").when(share >= mostly, "BASELINE_DOMINATES").when(share < little, "BASELINE_MINOR").otherwise("INDETERMINATE")
    return g.select(*by, "n", *(F.when(ok, c).alias(a) for c, a in ((share, "share"), (low, "share_low"), (high, "share_high"), (F.sqrt(F.greatest(F.col("v") - base, F.lit(0.0))), "residual_sd"))), status.alias("status"))


def level_correction(df: DataFrame, ks: list[int], repeats: int, seed: int, donor: str = "fold") -> DataFrame:
    """donor, k, base_shift, base_mae and, as means over repeats, shift and mae after a scalar offset (median of k reference rows) and after the offset of the reference nearest in time.

    df: cell_id, donor, mu_age, y_age, t. References are the k rows of a donor with the lowest hash of the repeat; they are not evaluated. A donor
    needs three rows beside them. Only the references are ranked, and they are the smallest k of each partition before they meet.
    """
    top = max(ks)
    e = F.col("mu_age") - F.col("y_age")
    base = df.groupBy(donor).agg(F.abs(F.percentile("mu_age", F.lit(0.5)) - F.percentile("y_age", F.lit(0.5))).alias("base_shift"), F.avg(F.abs(e)).alias("base_mae"), F.count("*").alias("n"))
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("u", unit_hash(str(seed), F.col("repeat"), F.col("cell_id")))
    order = Window.partitionBy(donor, "repeat").orderBy("u", "cell_id")
    refs = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).select(donor, "repeat", "cell_id", "r", F.col("t").alias("t_ref"), e.alias("e_ref"))
    by_k = refs.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("r") <= F.col("k"))
    offsets = by_k.groupBy(donor, "repeat", "k").agg(F.percentile("e_ref", F.lit(0.5)).alias("offset"), F.collect_list("cell_id").alias("ids"), F.sort_array(F.collect_list(F.struct(F.col("cell_id").alias("id"), "t_ref", "e_ref"))).alias("refs"))  # k rows each
    judged = rows.join(F.broadcast(offsets), [donor, "repeat"]).withColumn("is_ref", F.array_contains("ids", F.col("cell_id"))).filter("NOT is_ref")
    gap = lambda x: F.abs(x["t_ref"] - F.col("t"))
    near = F.array_min(F.transform("refs", lambda x: F.struct(gap(x).alias("gap"), x["id"].alias("id"), x["e_ref"].alias("e"))))["e"]
    cut = judged.select(donor, "repeat", "k", "y_age", (F.col("mu_age") - F.col("offset")).alias("sc"), (F.col("mu_age") - near).alias("mt"))
    med = lambda c: F.percentile(c, F.lit(0.5))
    each = cut.groupBy(donor, "k", "repeat").agg(
        F.abs(med("sc") - med("y_age")).alias("sc_shift"), F.avg(F.abs(F.col("sc") - F.col("y_age"))).alias("sc_mae"), F.abs(med("mt") - med("y_age")).alias("mt_shift"), F.avg(F.abs(F.col("mt") - F.col("y_age"))).alias("mt_mae")
    )
    mean = each.groupBy(donor, "k").agg(*(F.avg(c).alias(c) for c in ("sc_shift", "sc_mae", "mt_shift", "mt_mae")))
    return mean.join(base, donor).filter(F.col("n") - F.col("k") >= 3).drop("n")


def correction_verdict(corrected: DataFrame, least_folds: int = 4, reduction: float = 0.5) -> DataFrame:
    """k, folds whose shift is reduced by at least `reduction`, folds in all, whether that is enough, and the mean gain of the time-matched arm."""
    good = (F.col("base_shift") > 1e-9) & (1 - F.col("sc_shift") / F.nullif(F.col("base_shift"), F.lit(0.0)) >= reduction)
    g = corrected.groupBy("k").agg(F.count_if(good).alias("n_reduced"), F.count("*").alias("n_folds"), F.avg(F.col("sc_mae") - F.col("mt_mae")).alias("matched_gain"))
    return g.withColumn("passed", F.col("n_reduced") >= least_folds)


def credit_fractions(test: DataFrame, calib: DataFrame, by: str, z_conf: float = 1.0) -> DataFrame:
    """by, offset (median error of the calibration rows), thr (less than -z times the median spread earns credit), shares of true, predicted and corrected ages below it, and errors before and after."""
    med = lambda c: F.percentile(c, F.lit(0.5))
    scal = test.filter("age_mask").groupBy(by).agg((-z_conf * med("sigma_age")).alias("thr")).join(calib.filter("age_mask").groupBy(by).agg(med(F.col("mu_age") - F.col("y_age")).alias("offset")), by)
    j = test.filter("age_mask").join(F.broadcast(scal), by)
    corrected = F.col("mu_age") - F.col("offset")
    below = lambda c: F.avg((c < F.col("thr")).cast("double"))
    return j.groupBy(by, "offset", "thr").agg(
        below(F.col("y_age")).alias("true_credit"), below(F.col("mu_age")).alias("pred_credit"), below(corrected).alias("corrected_credit"),
        F.avg(F.abs(F.col("mu_age") - F.col("y_age"))).alias("mae_raw"), F.avg(F.abs(corrected - F.col("y_age"))).alias("mae_corrected"), F.count("*").alias("n"),
    )


def ood_quality(df: DataFrame, by: list[str]) -> DataFrame:
    """by, ood_rate, mae_flagged, mae_kept, auc of the error for the flag, and what that says of the detector. df: mu_age, y_age, in_dist."""
    e = F.abs(F.col("mu_age") - F.col("y_age"))
    g = df.groupBy(*by).agg(F.avg((~F.col("in_dist")).cast("double")).alias("ood_rate"), F.avg(F.when(~F.col("in_dist"), e)).alias("mae_flagged"), F.avg(F.when(F.col("in_dist"), e)).alias("mae_kept"))
    auc = M.auroc(df.select(*by, e.alias("e"), (~F.col("in_dist")).cast("int").alias("flag")), by, "e", "flag")
    v = F.when(F.col("auroc").isNull(), "single class").when(F.col("auroc") > 0.6, "informative").when(F.col("auroc") < 0.4, "anti-informative").otherwise("uninformative")
    return g.join(auc, by).select(*by, "ood_rate", "mae_flagged", "mae_kept", F.col("auroc").alias("auc"), v.alias("verdict"))


def overfit_classes(df: DataFrame, by: list[str], bulk: Column) -> DataFrame:
    """by, train_bulk, train_donors, test: mean absolute errors by subset, and how far the test is above the training donors. df: mu_age, y_age, age_mask, split.

    `fit_verdict` names the class of such a row."""
    e = F.abs(F.col("mu_age") - F.col("y_age"))
    of = lambda c: F.avg(F.when(F.col("age_mask") & c, e))
    train = F.col("split") == "train"
    g = df.groupBy(*by).agg(of(train & bulk).alias("train_bulk"), of(train & ~bulk).alias("train_donors"), of(F.col("split") == "test").alias("test"))
    return g.withColumn("ratio", F.col("test") / F.nullif(F.col("train_donors"), F.lit(0.0)))


#: a fold whose training error is below LOW of its test error has learnt its donors by heart; above HIGH, it fits neither
LOW, HIGH = 0.4, 0.75


def fit_verdict(train: Column, test: Column) -> Column:
    """MEMORIZING, CANNOT_FIT or, between them or where an error is missing, PARTIAL. Compared in 9 places."""
    low, high = F.round(train - LOW * test, 9) < 0, F.round(train - HIGH * test, 9) > 0
    return F.when(low, "MEMORIZING").when(high, "CANNOT_FIT").otherwise("PARTIAL")


def overfit_summary(folds: DataFrame) -> DataFrame:
    """One row over folds with both errors: their means, the ratio of the means, the folds of each class, and which class holds half of them or more (MIXED if none;
    MEMORIZING on a tie; null without such folds). folds: train_donors, test."""
    of = lambda v: F.count_if(fit_verdict(F.col("train_donors"), F.col("test")) == v)
    g = folds.filter("train_donors IS NOT NULL AND test IS NOT NULL").agg(F.avg("train_donors").alias("mean_train"), F.avg("test").alias("mean_test"), of("MEMORIZING").alias("n_memorizing"), of("CANNOT_FIT").alias("n_cannot_fit"), F.count("*").alias("n"))
    half = F.col("n") / 2
    verdict = F.when(F.col("n") == 0, None).when((F.col("n_memorizing") >= F.col("n_cannot_fit")) & (F.col("n_memorizing") >= half), "MEMORIZING").when(F.col("n_cannot_fit") >= half, "CANNOT_FIT").otherwise("MIXED")
    return g.withColumns({"ratio": F.col("mean_test") / F.nullif(F.col("mean_train"), F.lit(0.0)), "verdict": verdict})


def neighbour_times(neighbours: DataFrame) -> DataFrame:
    """spread: mean over rows of the spread of their neighbours' times; corr: mean correlation of time and age among them. neighbours: query_id, t, y."""
    from ..functions.columns import safe_corr

    each = neighbours.groupBy("query_id").agg(F.stddev_pop("t").alias("spread"), safe_corr(F.col("t"), F.col("y")).alias("corr"))
    return each.agg(F.avg("spread").alias("spread"), F.avg("corr").alias("corr"), F.count("*").alias("n"))


def neighbour_estimate(neighbours: DataFrame, rows: DataFrame, classes: int = 3) -> DataFrame:
    """query_id, p0.., mu_age: class shares of all rows of the neighbouring compounds, and the mean age of those that have one, else 0.

    neighbours: query_id, ref_id; rows: ref_id, y, y_age, age_mask. Rows are aggregated by compound before they meet.
    """
    of = rows.groupBy("ref_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("y") == i).alias(f"c{i}") for i in range(classes)), F.sum(F.when(F.col("age_mask"), F.col("y_age"))).alias("age"), F.count_if("age_mask").alias("ages"))
    g = neighbours.join(of, "ref_id").groupBy("query_id").agg(*((F.sum(f"c{i}") / F.sum("n")).alias(f"p{i}") for i in range(classes)), F.coalesce(F.sum("age") / F.nullif(F.sum("ages"), F.lit(0)), F.lit(0.0)).alias("mu_age"))
    return g


# ---- calibration --------------------------------------------------------------------------------------------------


def soft_nll(y: Column, p: Column) -> Column:
    """Mean cross-entropy of probabilities p against soft labels y (arrays)."""
    return F.avg(-F.aggregate(F.zip_with(y, p, lambda a, b: a * F.ln(F.least(F.greatest(b, F.lit(1e-12)), F.lit(1.0)))), F.lit(0.0), lambda s, x: s + x))


def calibration_report(df: DataFrame, logits: list[str], y: str, temperature: float, platt: tuple[float, float], bins: int = 10) -> DataFrame:
    """origin, stage, nll, ece, safe_ece, n before and after calibration. df: origin (in_dist, xdonor), logits, y."""
    from ..functions.columns import softmax

    def stage(name: str, t: float) -> DataFrame:
        p = softmax(*(F.col(c) for c in logits), tau=t)
        return df.select("origin", F.col(y).alias("y"), F.lit(name).alias("stage"), *(c.alias(f"q{i}") for i, c in enumerate(p)))

    rows = stage("before", 1.0).unionByName(stage("after", temperature))
    plain = softmax(*(F.col(c) for c in logits))[0]
    safe = df.select("origin", (F.col(y) == 0).cast("int").alias("hit"), F.explode(F.array(F.struct(F.lit("before").alias("stage"), plain.alias("p")), F.struct(F.lit("after").alias("stage"), sigmoid(platt[0] * logit(plain) + platt[1]).alias("p")))).alias("e")).select("origin", "hit", "e.*")
    by, names = ["origin", "stage"], [f"q{i}" for i in range(len(logits))]
    base = rows.groupBy(*by).agg(M.nll(names, "y").alias("nll"), F.count("*").alias("n"))
    return base.join(M.ece_top1(rows, by, names, "y"), by).join(M.ece_binary(safe, by, "p", "hit", bins).withColumnRenamed("ece", "safe_ece"), by)


def calibration_policy(df: DataFrame, p: str, y: str) -> DataFrame:
    """fitted_on, slope, intercept, n, safe_ece on the cross-donor pool, of the maps fitted on all held-out rows (which is used) and on the pool alone (which is reported). df: origin, p, y."""
    from .baselines import platt_on_logit

    pool = df.filter("origin = 'xdonor'")
    parts = []
    for name, rows in (("all", df), ("pool", pool)):  # two fits
        a, b = platt_on_logit(rows, p, y)
        after = pool.select(F.lit(name).alias("fitted_on"), sigmoid(a * logit(F.col(p)) + b).alias("q"), F.col(y).alias("hit"))
        fit = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("fitted_on"), F.lit(a).alias("slope"), F.lit(b).alias("intercept"), "n")
        parts.append(fit.join(M.ece_binary(after, ["fitted_on"], "q", "hit").withColumnRenamed("ece", "safe_ece"), "fitted_on"))
    return M.union_all(*parts)


def selection_objective(df: DataFrame, by: list[str], probs: list[str], y: str, weights: list[float], gamma: float, delta: float) -> DataFrame:
    """by, objective: class-weighted focal loss plus the Huber loss of ages, weights fixed, so it follows quality only. df: probs, y, mu_age, y_age, age_mask."""
    p = F.greatest(F.element_at(F.array(*probs), F.col(y) + 1), F.lit(1e-12))
    w = F.element_at(F.array(*map(F.lit, weights)), F.col(y) + 1)
    return df.groupBy(*by).agg((F.avg(-w * F.pow(1 - p, F.lit(gamma)) * F.ln(p)) + M.huber_masked("mu_age", "y_age", F.col("age_mask"), delta)).alias("objective"), F.count("*").alias("n"))


def efficacy_terms(df: DataFrame, p: S.ScoreParams, by: list[str]) -> DataFrame:
    """by, medians of the score's five factors, mean entropy, rows. df: s, p_loss, mu_age, sigma_age, p0, p1, p2."""
    r = S.gain(p)
    med = lambda c: F.percentile(c, F.lit(0.5))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), med(sigmoid((F.col("s") - p.tau_safe) / p.w)).alias("gate"), med(F.pow("s", F.lit(p.k))).alias("safety"), med(r / (r + p.kappa)).alias("gain_term"), med(F.exp(-p.lam * F.col("p_loss"))).alias("loss_term"),
        med(r).alias("gain"), F.avg(entropy(F.array("p0", "p1", "p2"))).alias("entropy"),
    )

"""Reports on fitted models: coverage and composition of the calibration pool, bundles by part and arm, level shifts from snapshots, typed features of a split, overfit classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import hard_label, logit, quantile, sigmoid
from .metrics import union_all
from .perturbation import perturbation_vector


def coverage_report(df: DataFrame, q: float, scale: float = 1.0, z: float = 1.0, approx: bool = False) -> DataFrame:
    """origin, n, coverage (share of |mu_age - y_age| within q), abs_residual, the 10th, 50th and 90th percentile of scale * z * sigma_age over q, and the share of rows below half of q.

    df: origin, mu_age, sigma_age, y_age, age_mask. Rows without an age or outside the mask are left out; q must be above zero.
    """
    if q <= 0:
        raise ValueError("the half width must be above zero")
    rows = df.filter(F.col("age_mask") & F.col("y_age").isNotNull() & F.col("mu_age").isNotNull())
    e, ratio = F.abs(F.col("mu_age") - F.col("y_age")), F.col("sigma_age") * scale * z / q
    rows = rows.withColumns({"__e": e, "__r": ratio})
    within = F.avg((F.round("__e", 9) <= q).cast("double"))
    spread = [quantile("__r", p, approx).alias(f"sigma_over_q_p{round(100 * p)}") for p in (0.1, 0.5, 0.9)]
    return rows.groupBy("origin").agg(F.count("*").alias("n"), within.alias("coverage"), F.avg("__e").alias("abs_residual"), *spread, F.avg((F.round("__r", 9) < 0.5).cast("double")).alias("under_half_q"))


def pool_composition(df: DataFrame, donor: str = "donor") -> DataFrame:
    """donor, n, share, abs_residual, calibrated of the cross-donor pool: whether it has two donors or more, so that maps fitted on it speak for others. df: donor, mu_age, y_age, age_mask."""
    g = df.filter(F.col("age_mask")).groupBy(donor).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("mu_age") - F.col("y_age"))).alias("abs_residual"))
    total = g.agg(F.sum("n").alias("total"), F.count("*").alias("donors"))
    return g.crossJoin(F.broadcast(total)).select(donor, "n", (F.col("n") / F.col("total")).alias("share"), "abs_residual", (F.col("donors") >= 2).alias("calibrated"))


def bundle(df: DataFrame, platt: tuple[float, float], pool: Column) -> DataFrame:
    """Predictions of the parts pool, calib and test, raw and calibrated, in one table: fold, part, arm, cell_id, p_safe, p_loss, mu_age, sigma_age, in_dist, y, y_age, age_mask.

    df: the same without part and arm, with p0 (safe), p1 (loss) and split; rows of other splits are left out but for those where `pool` holds, which are in
    the pool besides. The map of `platt` is of the safe class; the loss keeps its share of the rest.
    """
    rest = 1 - F.col("p0")
    safe = sigmoid(platt[0] * logit(F.col("p0")) + platt[1])
    loss = F.when(rest > 0, F.col("p1") * (1 - safe) / rest).otherwise(0.0)
    keep = ["fold", "cell_id", "mu_age", "sigma_age", "in_dist", "y", "y_age", "age_mask"]
    parts = F.array_compact(F.array(F.when(pool, F.lit("pool")), F.when(F.col("split").isin("calib", "test"), F.col("split"))))
    arms = F.array(F.struct(F.lit("raw").alias("arm"), F.col("p0").alias("p_safe"), F.col("p1").alias("p_loss")), F.struct(F.lit("calibrated").alias("arm"), safe.alias("p_safe"), loss.alias("p_loss")))
    return df.withColumn("e", F.explode(arms)).withColumn("part", F.explode(parts)).select("part", "e.*", *keep)


def level_shifts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """fold, level_shift of the first snapshot of `paths` that has any; folds without the figure are left out, and no snapshot at all gives no rows.

    A snapshot is a folder of JSON lines with fold, metric and value.
    """
    schema = "fold string, metric string, value double"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema(schema).json(path).filter("metric = 'level_shift_model' AND value IS NOT NULL").select("fold", F.col("value").alias("level_shift"))
    return spark.createDataFrame([], "fold string, level_shift double")


def gather_features(samples: DataFrame, splits: DataFrame, regime: str, split: str) -> DataFrame:
    """Rows of one split with typed features: cell_id, cell_line, scaffold_id, state (floats), perturbation (floats: the fingerprint, else the factors' levels), dose_time
    (floats), y (the largest soft label's place, the first on ties), y_age, age_mask.

    samples: cell_id, cell_line, scaffold_id, x, fp, tf, log_dose, log_time, y_soft, y_age, age_mask. Rows with neither fp nor tf are left out, as they have no input.
    """
    wanted = splits.filter((F.col("regime") == regime) & (F.col("split") == split)).select("cell_id")
    floats = "array<float>"
    return samples.join(wanted, "cell_id", "left_semi").filter("fp IS NOT NULL OR tf IS NOT NULL").select(
        "cell_id", "cell_line", "scaffold_id", F.col("x").cast(floats).alias("state"), perturbation_vector("fp", "tf").cast(floats).alias("perturbation"),
        F.array("log_dose", "log_time").cast(floats).alias("dose_time"), hard_label(F.col("y_soft")).alias("y"), F.col("y_age").cast("double").alias("y_age"), "age_mask",
    )


def held_out_pairs(df: DataFrame, group: str, groups: list, fit, keep: list[str]) -> DataFrame:
    """The rows of every group with the prediction of `fit(train)` on the other groups. A fit a group: groups are a stated few."""
    return union_all(*(fit(df.filter(F.col(group) != g))(df.filter(F.col(group) == g)).select(*keep) for g in groups))


def shift_report(df: DataFrame, mask: Column | None = None) -> DataFrame:
    """level ('time', 'line', 'dataset' or 'all'), dataset, line, day, n_control, mean_control, n_treated, mean_treated: age shifts of controls against treated cells, all levels from one pass.

    df: dataset, line, day, is_control, d_age. Rows without a shift, without the control flag, or outside the mask are left out; a null dataset, line or day is a value of its own.
    """
    rows = df.filter(F.col("d_age").isNotNull() & F.col("is_control").isNotNull())
    rows = rows if mask is None else rows.filter(mask)
    of = lambda c: F.when(c, F.col("d_age"))
    control, treated = of(F.col("is_control")), of(~F.col("is_control"))
    names = F.create_map(*(F.lit(x) for x in (0, "time", 1, "line", 3, "dataset", 7, "all")))
    sums = [F.count(control).alias("n_control"), F.avg(control).alias("mean_control"), F.count(treated).alias("n_treated"), F.avg(treated).alias("mean_treated")]
    return rows.rollup("dataset", "line", "day").agg(names[F.grouping_id().cast("int")].alias("level"), *sums).select("level", "dataset", "line", "day", "n_control", "mean_control", "n_treated", "mean_treated")


def control_gap(report: DataFrame, limit: float = 3.0) -> DataFrame:
    """low_dataset, high_dataset, gap, verdict: the two datasets whose controls lie furthest apart (ties: the first, or last, by name), and PASS where that is below `limit`.

    report: as shift_report() gives it. Datasets without controls, or without a name, take no part; fewer than two give no row.
    """
    rows = report.filter("level = 'dataset' AND n_control > 0 AND dataset IS NOT NULL").select("dataset", (F.round("mean_control", 9) + 0.0).alias("m"))
    ends = rows.agg(F.count("*").alias("k"), F.min(F.struct("m", "dataset")).alias("lo"), F.max(F.struct("m", "dataset")).alias("hi")).filter("k >= 2")
    gap = F.round(F.col("hi.m") - F.col("lo.m"), 9)
    return ends.select(F.col("lo.dataset").alias("low_dataset"), F.col("hi.dataset").alias("high_dataset"), gap.alias("gap"), F.when(gap < limit, "PASS").otherwise("FAIL").alias("verdict"))

"""Queries of fits (checked by row counts and tests) and of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baselines as B, metrics as M, scoring as S
from ..sources import samples as IO
from ..streaming import jobs as J
from ..streaming.run import drained, shared_path, staged
from . import domain as D
from .registry import query, rounded

X = ["z0", "z1", "z2"]


@query("ridge_baseline")
def ridge_baseline(spark, sf_dir):
    df = D.preds(spark, sf_dir)
    out = B.ridge(df.filter("age_mask AND cell_id % 5 < 3"), [*X, "sigma_age"], "y_age")(df.filter("cell_id % 5 >= 3"))
    return rounded(M.regression(out, ["fold"], "prediction", "y_age", F.col("age_mask")), 4)


@query("logistic_baseline")
def logistic_baseline(spark, sf_dir):
    df = D.preds(spark, sf_dir)
    out = B.logistic(df.filter("cell_id % 5 < 3"), X, "y")(df.filter("cell_id % 5 >= 3"))
    return rounded(out.withColumns({f"p{i}": F.get("probs", F.lit(i)) for i in range(3)}).groupBy("fold").agg(M.nll(["p0", "p1", "p2"], "y").alias("nll")), 4)


@query("tree_baselines")
def tree_baselines(spark, sf_dir):
    df = D.preds(spark, sf_dir).filter("age_mask")
    train, test = df.filter("cell_id % 5 < 3"), df.filter("cell_id % 5 >= 3")
    parts = [M.regression(B.trees(train, [*X, "sigma_age"], "y_age", k)(test), ["fold"], "prediction", "y_age", F.lit(True)).withColumn("kind", F.lit(k)) for k in ("boosted", "forest")]
    return rounded(parts[0].unionByName(parts[1]), 4)


@query("fit_ensemble")
def fit_ensemble(spark, sf_dir):
    df = D.preds(spark, sf_dir).select("cell_id", *X, "y", F.when(F.col("age_mask"), F.col("y_age")).alias("age"))
    df = staged(df, "preds")  # fits read it again and again
    members = B.ensemble(df.filter("cell_id % 5 < 3"), X, "y", "age", 3)(df.filter("cell_id % 5 >= 3"))
    g = members.groupBy("cell_id").agg(*(F.avg(F.get("probs", F.lit(i))).alias(f"p{i}") for i in range(3)), F.avg("mu_age").alias("mu_age"), F.stddev_pop("mu_age").alias("sigma_age"))
    return rounded(g, 4)


@query("fit_platt")
def fit_platt(spark, sf_dir):
    df = D.probs(spark, sf_dir).select("p0", (F.col("y") == 0).cast("double").alias("safe"))
    a, b = B.platt_on_logit(df, "p0", "safe")
    from ..functions.columns import logit, sigmoid

    return rounded(df.withColumn("q", sigmoid(a * logit(F.col("p0")) + b)).agg(M.binary_logloss("p0", "safe").alias("before"), M.binary_logloss("q", "safe").alias("after"), F.count("*").alias("n")), 4)


@query("calibrator_bakeoff")
def calibrator_bakeoff(spark, sf_dir):
    df = D.probs(spark, sf_dir).select((F.col("fold") % 3).alias("region"), "p0", (F.col("y") == 0).cast("double").alias("safe"))
    df = staged(df, "probs")  # fits read it again and again
    return rounded(B.bakeoff(df, "region", "p0", "safe"), 4)


@query("sample_round_trip", D.sql("SELECT shard_id, count(*) AS n, sum(row_idx)::BIGINT AS idx, min(cell_id) AS first_cell FROM (SELECT chunk_id AS shard_id, cell_id, row_number() OVER (PARTITION BY chunk_id ORDER BY cell_id) - 1 AS row_idx FROM cells) GROUP BY 1"))
def sample_round_trip(spark, sf_dir):
    path = shared_path(spark, "samples")
    IO.write_samples(D.cells(spark, sf_dir), path)
    m = IO.manifest(spark.read.parquet(path))
    return m.groupBy("shard_id").agg(F.count("*").alias("n"), F.sum("row_idx").alias("idx"), F.min("cell_id").alias("first_cell"))


@query("update_column", D.sql("SELECT cell_id, dose_um * 2 AS dose_um, time_h FROM cells"))
def update_column(spark, sf_dir):
    c = D.cells(spark, sf_dir).select("cell_id", "dose_um", "time_h")
    return IO.update_column(c, c.select("cell_id", (F.col("dose_um") * 2).alias("dose_um")), "dose_um")


@query("snapshots", D.sql("SELECT tag, count(DISTINCT fold) AS n_folds FROM (SELECT fold, unnest(['a', 'b']) AS tag FROM preds) GROUP BY 1"))
def snapshots(spark, sf_dir):
    v = D.preds(spark, sf_dir).groupBy("fold").agg(F.avg("mu_age").alias("value")).withColumn("metric", F.lit("mu"))
    path = shared_path(spark, "snapshots")
    for tag in ("a", "b", "a"):
        IO.snapshot(v, path, tag)
    return IO.list_snapshots(spark, path).select("tag", "n_folds")


def _events(spark, sf_dir):
    """The events table as a stream."""
    folder = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(folder).schema
    # a file source lists a folder or a glob; the glob matches the one table
    return spark.readStream.schema(schema).parquet(folder.replace("events.parquet", "events.parq*")).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ece_bins", "SELECT day, bin::INT AS bin, count(*) AS n, round(avg(p), 6) AS conf, round(avg(y), 6) AS acc FROM (SELECT (epoch_us(ts) // 86400000000)::BIGINT AS day, (event_id % 100) / 100.0::DOUBLE AS p, (user_id % 3 = 0)::INT AS y, least(floor((event_id % 100) / 100.0::DOUBLE * 10), 9) AS bin FROM events) GROUP BY ALL")
def stream_ece_bins(spark, sf_dir):
    s = _events(spark, sf_dir).select("ts", (F.col("event_id") % 100 / 100.0).alias("p"), (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    out = drained(J.running_ece_bins(s, late="60 days"), "complete")
    return rounded(out.select(F.floor(F.unix_seconds("w.start") / 86400).alias("day"), "bin", "n", "conf", "acc"))


@query("stream_running_baseline", "SELECT user_id AS cell_line, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_running_baseline(spark, sf_dir):
    """Views are the controls."""
    s = _events(spark, sf_dir).filter("event_type = 'view'").select(F.col("user_id").alias("cell_line"), "value")
    out = drained(J.running_baseline(s), "update")
    last = out.groupBy("cell_line").agg(F.max_by(F.struct("n", "mean"), "n").alias("s"))
    return rounded(last.select("cell_line", "s.n", "s.mean"))


@query("stream_running_baseline_all", "SELECT user_id AS cell_line, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_running_baseline_all(spark, sf_dir):
    """All events, as if all were controls."""
    s = _events(spark, sf_dir).select(F.col("user_id").alias("cell_line"), "value")
    last = drained(J.running_baseline(s), "update").groupBy("cell_line").agg(F.max_by(F.struct("n", "mean"), "n").alias("s"))
    return rounded(last.select("cell_line", "s.n", "s.mean"))


@query("stream_suppress_duplicates", "SELECT count(DISTINCT user_id * 1000 + event_id % 7) AS n FROM events")
def stream_suppress_duplicates(spark, sf_dir):
    s = _events(spark, sf_dir).select("ts", (F.col("user_id") * 1000 + F.col("event_id") % 7).alias("cell_id"))
    return drained(J.suppress_duplicates(s, late="60 days")).agg(F.count("*").alias("n"))


@query("stream_scoring", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'REJECTED_OOD' WHEN (event_id % 100) / 100.0::DOUBLE < 0.85::DOUBLE - 3 * 0.03::DOUBLE THEN 'REJECTED_UNSAFE' WHEN greatest(0, -((event_id % 41 - 20) - (user_id % 5) + 1)) = 0 THEN 'REJECTED_NO_REJUVENATION' ELSE 'APPROVED' END AS status FROM events) GROUP BY 1")
def stream_scoring(spark, sf_dir):
    s = _events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("cell_line"), (F.col("event_id") % 100 / 100.0).alias("s"), F.lit(0.1).alias("p_loss"), (F.col("event_id") % 41 - 20).cast("double").alias("mu_age"), F.lit(1.0).alias("sigma_age"), (F.col("event_id") % 11 != 0).alias("in_dist")
    )
    offsets = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("cell_line")).distinct().withColumn("offset", (F.col("cell_line") % 5).cast("double"))
    return drained(J.score_stream(s, S.ScoreParams(), offsets)).groupBy("status").agg(F.count("*").alias("n"))


@query("ingest_with_ledger", D.sql("SELECT chunk_id, count(*) AS n, count(DISTINCT cell_id % 2)::BIGINT AS n_batches FROM cells GROUP BY 1"))
def ingest_with_ledger(spark, sf_dir):
    """Each chunk comes in two deliveries; a third run finds nothing new, nor does a fourth whose checkpoint is lost; a chunk that is cleared is taken again."""
    landing, out, ledger, check, other = (shared_path(spark, w) for w in ("landing", "ingested", "ledger", "check", "other-check"))
    cells = D.cells(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    for half, at in ((0, check), (1, check), (None, check), (None, other)):
        if half is not None:
            cells.filter(F.col("cell_id") % 2 == half).repartition("chunk_id").write.mode("append").parquet(landing)
        J.ingest(spark.readStream.schema(cells.schema).parquet(landing), lambda b: b, out, ledger, at).awaitTermination()
    J.clear(spark, ledger, [1])
    J.ingest(spark.readStream.schema(cells.schema).parquet(landing), lambda b: b, out, ledger, check).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("chunk_id").cast("int").alias("chunk_id")).agg(F.count("*").alias("n"), F.count_distinct("delivery").alias("n_batches"))


@query("stream_running_rates", "SELECT (epoch_us(ts) // 86400000000)::BIGINT AS day, round(avg((event_id % 11 = 0)::INT), 6) AS ood_rate, round(avg((event_id % 3 = 0)::INT), 6) AS approval_rate, count(*) AS n FROM events GROUP BY 1")
def stream_running_rates(spark, sf_dir):
    s = _events(spark, sf_dir).select("ts", (F.col("event_id") % 11 != 0).alias("in_dist"), F.when(F.col("event_id") % 3 == 0, S.APPROVED).otherwise(S.REJECTED_UNSAFE).alias("status"))
    out = drained(J.running_rates(s, late="60 days"), "complete")
    return rounded(out.select(F.floor(F.unix_seconds("w.start") / 86400).alias("day"), "ood_rate", "approval_rate", "n"))


@query("mean_finite", D.sql("SELECT fold, round(avg(v) FILTER (isfinite(v)), 6) AS mean FROM (SELECT fold, CASE WHEN cell_id % 5 = 0 THEN NULL WHEN cell_id % 7 = 0 THEN 'nan'::DOUBLE WHEN cell_id % 11 = 0 THEN 'inf'::DOUBLE ELSE mu_age END AS v FROM preds) GROUP BY 1"))
def mean_finite(spark, sf_dir):
    k = F.col("cell_id")
    v = F.when(k % 5 == 0, F.lit(None).cast("double")).when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(F.col("mu_age"))
    return rounded(D.preds(spark, sf_dir).withColumn("v", v).groupBy("fold").agg(M.mean_finite(F.col("v")).alias("mean")))


@query("fold_reports_as_json", D.sql("SELECT f.fold::VARCHAR AS fold, metric, round(value, 6) AS value FROM (SELECT DISTINCT fold FROM preds) f LEFT JOIN (SELECT fold, unnest(['mae', 'bias']) AS metric, unnest([avg(abs(mu_age - y_age)), avg(mu_age - y_age)]) AS value FROM preds WHERE age_mask AND fold % 4 <> 1 GROUP BY fold) USING (fold)"))
def fold_reports_as_json(spark, sf_dir):
    """Metric rows written as JSON by regime and read back for all expected folds; some have no report."""
    df = D.preds(spark, sf_dir).filter("age_mask AND fold % 4 <> 1")
    e = F.col("mu_age") - F.col("y_age")
    long = M.long_form(df.groupBy("fold").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias")), ["fold"], ["mae", "bias"])
    path = shared_path(spark, "reports")
    IO.write_report(long.select((F.col("fold") % 3).cast("string").alias("regime"), F.lit("model").alias("estimator"), F.col("fold").cast("string").alias("fold"), "metric", "value"), path)
    folds = D.preds(spark, sf_dir).select(F.col("fold").cast("string").alias("fold")).distinct()
    return rounded(IO.read_fold_reports(spark, path, folds).select("fold", "metric", "value"))


def _battery(df):
    """fold, metric, value of the whole battery of one set of predictions: p0..p2, y, mu_age, sigma_age, y_age, age_mask, in_dist."""
    by, P = ["fold"], ["p0", "p1", "p2"]
    safe = df.withColumn("safe", (F.col("y") == 0).cast("int")).withColumn("pr", F.round("p0", 9))
    e = F.abs(F.col("mu_age") - F.col("y_age"))
    masked = F.col("age_mask")
    simple = df.groupBy(*by).agg(
        M.brier(P, "y").alias("brier"), M.nll(P, "y").alias("nll"), F.avg((~F.col("in_dist")).cast("double")).alias("ood_rate"),
        F.avg(F.when(masked, (e <= 1.6448536269514722 * F.col("sigma_age")).cast("double"))).alias("coverage"), F.avg(F.when(masked, 2 * 1.6448536269514722 * F.col("sigma_age"))).alias("width"),
    )
    reg = M.regression(df, by, "mu_age", "y_age", masked).drop("n")
    parts = [simple, reg, M.ece_top1(df, by, P, "y"), M.ece_binary(safe, by, "p0", "safe").withColumnRenamed("ece", "ece_safe"), M.auroc(safe, by, "pr", "safe"), M.prauc(safe, by, "pr", "safe"), M.spearman(df.filter(masked), by, "mu_age", "y_age")]
    return M.union_all(*(M.long_form(p, by, [c for c in p.columns if c != "fold"]) for p in parts))


@query("measure_fold", D.sql("""SELECT fold, metric, round(value, 6) + 0.0 AS value FROM (
  SELECT fold, unnest(['brier', 'nll', 'ood_rate', 'coverage', 'width']) AS metric, unnest([avg(power(p0 - (y = 0)::INT, 2) + power(p1 - (y = 1)::INT, 2) + power(p2 - (y = 2)::INT, 2)), avg(-ln(greatest([p0, p1, p2][y + 1], 1e-12))), avg((NOT in_dist)::INT), avg((abs(mu_age - y_age) <= 1.6448536269514722 * sigma_age)::INT) FILTER (age_mask), avg(2 * 1.6448536269514722 * sigma_age) FILTER (age_mask)]) AS value FROM probs GROUP BY fold
  UNION ALL SELECT fold, unnest(['mae', 'rmse', 'pearson', 'r2']), unnest([avg(abs(e)), sqrt(avg(e * e)), corr(mu_age, y_age), 1 - sum(e * e) / (var_pop(y_age) * count(*))]) FROM (SELECT *, mu_age - y_age AS e FROM preds WHERE age_mask) GROUP BY fold
  UNION ALL SELECT fold, 'ece', sum(g) / max(t) FROM (SELECT fold, bin, abs(sum(hit - conf)) AS g, sum(count(*)) OVER (PARTITION BY fold) AS t FROM (SELECT fold, greatest(p0, p1, p2) AS conf, (list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1 = y)::INT AS hit, (ceil(greatest(p0, p1, p2) * 15) - 1)::INT AS bin FROM probs) GROUP BY fold, bin) GROUP BY fold
  UNION ALL SELECT fold, 'ece_safe', sum(g) / max(t) FROM (SELECT fold, b, abs(sum((y = 0)::INT - p0)) AS g, sum(count(*)) OVER (PARTITION BY fold) AS t FROM (SELECT fold, y, p0, least(floor(p0 * 10), 9) AS b FROM probs) GROUP BY fold, b) GROUP BY fold
  UNION ALL SELECT fold, 'auroc', sum(pos * (below + neg / 2)) / (max(P) * (max(N) - max(P))) FROM (SELECT fold, pos, n - pos AS neg, coalesce(sum(n - pos) OVER (PARTITION BY fold ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY fold) AS P, sum(n) OVER (PARTITION BY fold) AS N FROM safe) GROUP BY fold
  UNION ALL SELECT fold, 'prauc', sum(pos * tp / flagged) / max(P) FROM (SELECT fold, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY fold) AS P FROM safe WINDOW w AS (PARTITION BY fold ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY fold
  UNION ALL SELECT fold, 'spearman', corr(ra, rb) FROM (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY mu_age) + (count(*) OVER (PARTITION BY fold, mu_age) - 1) / 2 AS ra, rank() OVER (PARTITION BY fold ORDER BY y_age) + (count(*) OVER (PARTITION BY fold, y_age) - 1) / 2 AS rb FROM preds WHERE age_mask) GROUP BY fold)""",
  safe="SELECT fold, round(p0, 9) AS s, sum((y = 0)::INT)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM probs GROUP BY 1, 2"))
def measure_fold(spark, sf_dir):
    return rounded(_battery(D.probs(spark, sf_dir)))


@query("fit_clock")
def fit_clock(spark, sf_dir):
    from ..operators import clock as K, expression as E

    lines = D.cells(spark, sf_dir).select("cell_id", F.col("cell_line").alias("sample"))
    sums = D.expr(spark, sf_dir).join(lines, "cell_id").groupBy("sample", "gene").agg(F.sum("value").alias("value"))
    norm = E.normalize_cp10k(sums.withColumnRenamed("sample", "cell_id")).withColumnRenamed("cell_id", "sample")
    ages = lines.select("sample").distinct().withColumn("age", (20 + F.col("sample") * 2).cast("double"))
    weights, intercept, m = K.fit_clock(norm, ages)
    return rounded(weights.withColumns({"intercept": F.lit(intercept), "cv_mae": F.lit(m["cv_mae"]), "alpha": F.lit(m["alpha"])}), 4)


@query("extreme_contrast", D.sql("SELECT region::INT AS region, round(o - y, 6) AS contrast, round(1.6448536269514722 * 6.0 * sqrt(1 / n_young::DOUBLE + 1 / n_old::DOUBLE), 6) AS bar, (hi - lo)::DOUBLE AS true_gap, n_young, n_old, CASE WHEN o - y >= 1.6448536269514722 * 6.0 * sqrt(1 / n_young::DOUBLE + 1 / n_old::DOUBLE) THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT region, lo, hi, count(*) FILTER (chrono = lo) AS n_young, count(*) FILTER (chrono = hi) AS n_old, avg(predicted) FILTER (chrono = hi) AS o, avg(predicted) FILTER (chrono = lo) AS y FROM (SELECT *, min(chrono) OVER (PARTITION BY region) AS lo, max(chrono) OVER (PARTITION BY region) AS hi FROM (SELECT fold % 5 AS region, fold, (20 + fold // 10 * 20)::DOUBLE AS chrono, 20 + fold // 10 * 20 + avg(mu_age) / 10 AS predicted FROM preds GROUP BY fold)) GROUP BY ALL)"))
def extreme_contrast(spark, sf_dir):
    from ..operators.clock import extreme_contrast as contrast

    donors = D.preds(spark, sf_dir).groupBy("fold").agg(F.avg("mu_age").alias("m"))
    chrono = 20 + F.floor(F.col("fold") / 10) * 20
    rows = donors.select((F.col("fold") % 5).alias("region"), chrono.cast("double").alias("chrono"), (chrono + F.col("m") / 10).alias("predicted"))
    return rounded(contrast(rows, 6.0, ["region"]).drop("power", "pearson"))


@query("input_sweep", D.sql("SELECT cell_id, point::DOUBLE AS point, round(0.1 * dose_um - 0.5 * ln(point), 6) + 0.0 AS score, round(-0.5 * (ln(point) - ln(24)), 6) + 0.0 AS change FROM cells, (SELECT unnest([24.0, 96.0]) AS point)"))
def input_sweep(spark, sf_dir):
    from ..operators.clock import sweep

    return rounded(sweep(D.cells(spark, sf_dir), "time_h", [24.0, 96.0], 0.1 * F.col("dose_um") - 0.5 * F.ln("time_h")))


@query("forward_model")
def forward_model(spark, sf_dir):
    """State against state with elapsed time, each donor group left out in turn."""
    from ..operators import timecourse as T

    pts = T.timepoints(D.course(spark, sf_dir).withColumnRenamed("day", "t"), 3, 2)
    pairs = T.forward_pairs(pts).withColumn("dt2", F.col("dt") * F.col("dt")).withColumn("grp", F.col("donor") % 3).withColumn("cell_id", F.xxhash64("donor", "t_i", "t_j"))
    parts = []
    for g in range(3):  # fits, not rows
        train, test = pairs.filter(F.col("grp") != g), pairs.filter(F.col("grp") == g)
        for arm, cols in (("state", ["v_i"]), ("state_and_time", ["v_i", "dt", "dt2"])):
            out = B.ridge(train, cols, "v_j")(test)
            parts.append(M.regression(out, ["grp"], "prediction", "v_j", F.lit(True)).withColumn("arm", F.lit(arm)))
    return rounded(M.union_all(*parts), 4)


@query("edistance_after_pca")
def edistance_after_pca(spark, sf_dir):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = D.table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    low = PCA(k=8, inputCol="x", outputCol="z").fit(v).transform(v).select("vec_id", "label", vector_to_array("z").alias("v"))
    return rounded(M.energy_to_control(low, "label", "v", F.col("label") == 0), 4)


@query("leave_one_line_out")
def leave_one_line_out(spark, sf_dir):
    """The chain of fit, predict and measure with each region left out, all folds from one pass; a fold that fails is a row with its error."""
    from ..operators import heldout as H

    df = D.preds(spark, sf_dir).withColumn("region", F.col("fold") % 5)
    return rounded(H.leave_group_out(df, "region", ["z0", "z1", "z2", "sigma_age"], "y_age", mask=F.col("age_mask")).select("region", "mae", "r2", "n", "error"), 4)

"""Queries over vectors and arms: pruned and hashed neighbours, mean vectors of time points, gated ranking targets, thresholds with calibration, panels that differ."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import expression as X, metrics as M, neighbours as NB, quality as QC, scoring as S, timecourse as T
from . import domain as D, evaluation_queries as E
from .build_queries import Build
from .registry import QUERIES, SQL, query, rounded


def _sides(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.withColumnRenamed("vec_id", "query_id"), v.select("label", F.col("vec_id").alias("ref_id"), F.col("v").alias("ref_v"))


def _others(near, k: int):
    """The k nearest but the row itself."""
    w = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    return near.filter("query_id <> ref_id").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("query_id", "ref_id", "distance")


@query("pivot_knn", SQL["euclidean_knn"])
def pivot_knn(spark, sf_dir):
    """The three nearest others of each vector under its label, with pruning by pivots."""
    return rounded(_others(NB.pivot_knn(*_sides(spark, sf_dir), 4, ["label"]), 3), 5)


@query("hashed_knn_recall")
def hashed_knn_recall(spark, sf_dir):
    """The share of those neighbours that hash tables find."""
    found = _others(NB.hashed_knn(*_sides(spark, sf_dir), 4, ["label"], width=1.0), 3)
    return rounded(NB.recall(found, QUERIES["euclidean_knn"](spark, sf_dir)))


# ---- time points --------------------------------------------------------------------------------------------------

_POPULATIONS = {
    "rows_at": "SELECT cell_id, c.cell_line AS donor, time_h AS t, y_age AS value, (y <> 0)::INT::DOUBLE AS unsafe FROM cells c JOIN preds USING (cell_id) WHERE age_mask",
    "pops": "SELECT * EXCLUDE k FROM (SELECT *, count(*) OVER (PARTITION BY donor) AS k FROM (SELECT donor, t, avg(value) AS value, avg(unsafe) AS unsafe, count(*) AS n FROM rows_at GROUP BY ALL HAVING count(*) >= 4)) WHERE k >= 3",
    "means": "SELECT donor, t, gene, sum(e.value) / any_value(n) AS value FROM expr e JOIN rows_at USING (cell_id) JOIN (SELECT donor, t, n FROM pops) USING (donor, t) GROUP BY ALL",
}


def _populations(spark, sf_dir):
    p = D.preds(spark, sf_dir).filter("age_mask").select("cell_id", F.col("y_age").alias("value"), (F.col("y") != 0).cast("double").alias("unsafe"))
    rows = D.cells(spark, sf_dir).select("cell_id", F.col("cell_line").alias("donor"), F.col("time_h").alias("t")).join(p, "cell_id")
    return T.mean_vectors(D.expr(spark, sf_dir), rows)


@query("timepoint_vectors", D.sql("SELECT donor, t, n, round(p.value, 6) + 0.0 AS value, round(unsafe, 6) AS unsafe, gene, round(m.value, 6) AS mean_expression FROM means m JOIN pops p USING (donor, t)", **_POPULATIONS))
def timepoint_vectors(spark, sf_dir):
    """Mean expression, mean age shift and unsafe share of each line's time points."""
    points, vectors = _populations(spark, sf_dir)
    return rounded(vectors.select("donor", "t", "gene", F.col("value").alias("mean_expression")).join(points, ["donor", "t"]))


@query("vector_forward_pairs", D.sql("""SELECT donor, a.t AS t_i, b.t AS t_j, b.t - a.t AS dt, round(a.value, 6) + 0.0 AS v_i, round(b.value, 6) + 0.0 AS v_j, round(d, 5) AS distance, round(c, 6) AS cosine FROM pops a JOIN pops b USING (donor)
  JOIN (SELECT donor, x.t AS ti, y.t AS tj, sqrt(sum((coalesce(v, 0) - coalesce(w, 0)) * (coalesce(v, 0) - coalesce(w, 0)))) AS d, sum(v * w) / sqrt(sum(v * v) * sum(w * w)) AS c FROM (SELECT donor, t, gene, coalesce(m.value, 0) AS v FROM pops CROSS JOIN (SELECT DISTINCT gene FROM means) LEFT JOIN means m USING (donor, t, gene)) x
    JOIN (SELECT donor, t, gene, coalesce(m.value, 0) AS w FROM pops CROSS JOIN (SELECT DISTINCT gene FROM means) LEFT JOIN means m USING (donor, t, gene)) y USING (donor, gene) WHERE y.t > x.t GROUP BY ALL) ON donor = a.donor AND ti = a.t AND tj = b.t WHERE b.t > a.t""".replace("ON donor = a.donor AND ti = a.t AND tj = b.t WHERE", "USING (donor) WHERE ti = a.t AND tj = b.t AND"), **_POPULATIONS))
def vector_forward_pairs(spark, sf_dir):
    """How far each line's mean profile moves between two of its time points."""
    points, vectors = _populations(spark, sf_dir)
    return rounded(T.vector_pairs(points, vectors).withColumn("distance", F.round("distance", 5)))


# ---- arms ---------------------------------------------------------------------------------------------------------

_ARMS3 = f"SELECT fold, cell_id, y, y_age, age_mask, cell_id % 10 AS part, unnest(['age', 'res', 'recalibrated']) AS arm, unnest([-mu_age, round(res, 9), round(CASE WHEN in_dist THEN 1 / (1 + exp(-greatest(least((sp - 0.4) / 0.05, 500), -500))) * sp * sp * (r / (r + 5.0)) ELSE 0 END, 9)]) AS score FROM (SELECT *, {E._PLATT_SQL} AS sp FROM scored)"
_GATED = "SELECT arm, fold, cell_id, score, (y = 0 AND y_age < 0)::INT AS good, round(CASE WHEN y = 0 THEN -y_age ELSE coalesce(min(-y_age) FILTER (y = 0) OVER w - 1, -y_age) END, 9) AS gated, round(-y_age - CASE WHEN y = 0 THEN 0 ELSE 3 * stddev_pop(-y_age) OVER w END, 9) AS penalised FROM arms3 WHERE age_mask WINDOW w AS (PARTITION BY arm, fold)"


def _three_arms(spark, sf_dir):
    """Age alone, the score, and the score on recalibrated safety, of every row."""
    df = E._card(spark, sf_dir)
    raw = S.efficacy(df, E.PARAMS).select("cell_id", "fold", "y", "y_age", "age_mask", "mu_age", F.col("res").alias("raw"))
    new = S.efficacy(df.withColumn("s", F.col("s_platt")), E.PARAMS).select("cell_id", F.col("res").alias("new"))
    return raw.join(new, "cell_id").select("cell_id", "fold", "y", "y_age", "age_mask", F.expr("stack(3, 'age', -mu_age, 'res', round(raw, 9), 'recalibrated', round(new, 9)) AS (arm, score)"))


@query("gated_ranking_arms", D.sql(f"SELECT arm, fold, round(a.v, 6) AS spearman_gated, round(b.v, 6) AS spearman_penalised, round(p, 6) AS good_at_5 FROM ({E.spearman_sql('arm, fold', 'score', 'gated', 'tg')}) a JOIN ({E.spearman_sql('arm, fold', 'score', 'penalised', 'tg')}) b USING (arm, fold) JOIN (SELECT arm, fold, avg(good) AS p FROM (SELECT *, row_number() OVER (PARTITION BY arm, fold ORDER BY score DESC, cell_id) AS r FROM tg) WHERE r <= 5 GROUP BY ALL) USING (arm, fold)", arms3=_ARMS3, tg=_GATED))
def gated_ranking_arms(spark, sf_dir):
    """The arms against gains that count only where the cell stays safe: gated and penalised targets, and the share of safe, younger cells in the first five."""
    by = ["arm", "fold"]
    df = S.safe_targets(_three_arms(spark, sf_dir).filter("age_mask").withColumn("g", -F.col("y_age")), by, F.col("y") == 0, "g")
    df = df.withColumns({"gated": F.round("gated", 9), "penalised": F.round("penalised", 9)})
    first = df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "cell_id"))).filter("r <= 5").groupBy(*by).agg(F.avg("good").alias("good_at_5"))
    both = M.spearman(df, by, "score", "gated").withColumnRenamed("spearman", "spearman_gated").join(M.spearman(df, by, "score", "penalised").withColumnRenamed("spearman", "spearman_penalised"), by)
    return rounded(both.join(first, by))


_SCALED = {
    "arms3": _ARMS3,
    "limits": "SELECT arm, fold, min(score) AS lo, max(score) AS hi, quantile_cont(score, 0.8) AS tq FROM arms3 WHERE age_mask AND part = 8 GROUP BY ALL",
    "tested": "SELECT arm, fold, good, CASE WHEN hi > lo THEN round(greatest(least((score - lo) / (hi - lo), 1), 0), 9) ELSE 0 END AS p, CASE WHEN hi > lo THEN round((tq - lo) / (hi - lo), 9) ELSE 0.5 END AS threshold FROM (SELECT *, (y = 0 AND y_age < 0)::INT AS good FROM arms3 WHERE age_mask AND part = 9) JOIN limits USING (arm, fold)",
}


@query("threshold_arms_ece", D.sql(f"SELECT arm, fold, round(threshold, 6) AS threshold, n, n_good, round(precision, 6) AS precision, round(recall, 6) AS recall, round(v, 5) AS ece FROM (SELECT arm, fold, any_value(threshold) AS threshold, count(*) AS n, sum(good)::BIGINT AS n_good, sum(good) FILTER (p >= threshold) / nullif(count(*) FILTER (p >= threshold), 0)::DOUBLE AS precision, coalesce(sum(good) FILTER (p >= threshold), 0) / nullif(sum(good), 0)::DOUBLE AS recall FROM tested GROUP BY ALL) JOIN ({E.ece_sql('arm, fold', 'p', 'good', 'tested', 5).replace('SELECT *, p AS p', 'SELECT *')}) USING (arm, fold) WHERE n_good BETWEEN 1 AND n - 1", **_SCALED))
def threshold_arms_ece(spark, sf_dir):
    """Scores scaled by the calibration rows' range: precision and recall at their 80 % quantile, and the calibration error in five bins. Folds of one class are left out."""
    by = ["arm", "fold"]
    df = _three_arms(spark, sf_dir).filter("age_mask").withColumn("good", ((F.col("y") == 0) & (F.col("y_age") < 0)).cast("int"))
    z = S.minmax_by_calib(df.filter("cell_id % 10 = 9"), df.filter("cell_id % 10 = 8"), by, "score", 0.8)
    z = z.select(*by, "good", F.round("scaled", 9).alias("p"), F.round("threshold", 9).alias("threshold"))
    flag = F.col("p") >= F.col("threshold")
    hits, flags, goods = F.count_if(flag & (F.col("good") == 1)), F.count_if(flag), F.sum("good")
    fit = z.groupBy(*by).agg(F.max("threshold").alias("threshold"), F.count("*").alias("n"), goods.alias("n_good"), (hits / F.nullif(flags, F.lit(0))).alias("precision"), (hits / F.nullif(goods, F.lit(0))).alias("recall"))
    out = fit.filter("n_good BETWEEN 1 AND n - 1").join(M.ece_binary(z, by, "p", "good", 5), by)
    return rounded(out.withColumn("ece", F.round("ece", 5)))


# ---- contracts ----------------------------------------------------------------------------------------------------

_PANELS = {
    "brands": "SELECT gene, row_number() OVER (ORDER BY gene) AS pos FROM (SELECT DISTINCT p_brand AS gene FROM part)",
    "lists": "SELECT 'bundle' AS source, gene, pos FROM brands UNION ALL SELECT 'scaler', gene, pos FROM brands WHERE pos > 2 UNION ALL SELECT 'panel', gene, CASE pos WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE pos END FROM brands UNION ALL SELECT 'copy', gene, pos FROM brands",
}


@query("panel_differences", D.sql("SELECT source, h AS panel_hash, h = (SELECT substr(sha256(string_agg(gene, chr(10) ORDER BY pos)), 1, 16) FROM brands) AS agree, (SELECT count(*) FROM brands) - n AS n_missing, 0::BIGINT AS n_extra, moved AS n_moved FROM (SELECT source, substr(sha256(string_agg(gene, chr(10) ORDER BY l.pos)), 1, 16) AS h, count(*) AS n, count(*) FILTER (l.pos <> b.pos) AS moved FROM lists l JOIN brands b USING (gene) GROUP BY 1)", **_PANELS))
def panel_differences(spark, sf_dir):
    """A list without two genes, one with two exchanged and an equal one, against the bundle's."""
    genes = D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct().withColumn("pos", F.row_number().over(Window.orderBy("gene")).cast("long"))  # a dimension
    swapped = F.when(F.col("pos") == 1, 2).when(F.col("pos") == 2, 1).otherwise(F.col("pos")).cast("long")
    lists = M.union_all(*(d.select(F.lit(n).alias("source"), "gene", "pos") for n, d in (("bundle", genes), ("scaler", genes.filter("pos > 2")), ("panel", genes.withColumn("pos", swapped)), ("copy", genes))))
    return QC.panel_differences(lists, "bundle")


@query("clock_callable", D.sql("SELECT cell_id, round(ln(1 + coalesce(s, 0)), 6) AS age FROM kept LEFT JOIN (SELECT cell_id, sum(value) AS s FROM expr GROUP BY 1) USING (cell_id)"))
def clock_callable(spark, sf_dir):
    """Ages by a function instead of a table of weights: the logarithm of a cell's total."""
    b = Build(spark, sf_dir)

    def depth(expr, cells):
        return expr.groupBy("cell_id").agg(F.ln(1 + F.sum("value")).alias("age")).join(cells.select("cell_id"), "cell_id", "left_semi")

    ages = X.predict_age(b.expr, b.kept(), depth)
    return rounded(ages.withColumn("age", F.coalesce("age", F.lit(0.0))))

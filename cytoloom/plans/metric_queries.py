"""Queries of metrics over predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import entropy
from ..operators import evaluation as V, metrics as M
from ..streaming.run import staged
from . import domain as D
from .domain import CTES
from .registry import query, rounded

P = ["p0", "p1", "p2"]
BY = ["fold"]

CTES |= {
    "ovr": "SELECT fold, cell_id, 0 AS cls, p0 AS p, (y = 0)::INT AS hit FROM probs UNION ALL SELECT fold, cell_id, 1, p1, (y = 1)::INT FROM probs UNION ALL SELECT fold, cell_id, 2, p2, (y = 2)::INT FROM probs",
    "vectors": "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
}


def _ovr(spark, sf_dir):
    # scores are rounded, as a threshold's ties depend on the last bits otherwise
    return M.one_vs_rest(D.probs(spark, sf_dir), P, "y").select("fold", "cls", F.round("p", 9).alias("p"), "hit")


@query("auroc", D.sql("SELECT fold, cls, round(sum(pos * (below + neg / 2)) / nullif(max(tp_all) * (max(n_all) - max(tp_all)), 0), 6) AS auroc FROM (SELECT fold, cls, pos, n - pos AS neg, coalesce(sum(n - pos) OVER (PARTITION BY fold, cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY fold, cls) AS tp_all, sum(n) OVER (PARTITION BY fold, cls) AS n_all FROM (SELECT fold, cls, round(p, 9) AS s, sum(hit)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM ovr GROUP BY ALL)) GROUP BY ALL"))
def auroc(spark, sf_dir):
    return rounded(M.auroc(_ovr(spark, sf_dir), ["fold", "cls"], "p", "hit"))


@query("prauc", D.sql("SELECT fold, cls, round(sum(pos * tp / flagged) / nullif(max(tp_all), 0), 6) AS prauc FROM (SELECT fold, cls, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY fold, cls) AS tp_all FROM (SELECT fold, cls, round(p, 9) AS s, sum(hit)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM ovr GROUP BY ALL) WINDOW w AS (PARTITION BY fold, cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY ALL"))
def prauc(spark, sf_dir):
    return rounded(M.prauc(_ovr(spark, sf_dir), ["fold", "cls"], "p", "hit"))


@query("prauc_documents", "SELECT task, round(sum(pos * tp / flagged) / nullif(max(tp_all), 0), 6) AS prauc FROM (SELECT task, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS flagged, sum(pos) OVER (PARTITION BY task) AS tp_all FROM (SELECT task, s, sum(hit)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM (SELECT n_chars AS s, unnest(['quality', 'toxic']) AS task, unnest([quality, toxic]) AS hit FROM documents JOIN labels USING (doc_id)) GROUP BY ALL) WINDOW w AS (PARTITION BY task ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) GROUP BY ALL")
def prauc_documents(spark, sf_dir):
    docs, labels = D.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), D.table(spark, sf_dir, "labels")
    long = docs.join(labels, "doc_id").select("n_chars", F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (task, hit)"))
    return rounded(M.prauc(long, ["task"], "n_chars", "hit"))


_SCALARS = "round(avg(power(p0 - (y = 0)::INT, 2) + power(p1 - (y = 1)::INT, 2) + power(p2 - (y = 2)::INT, 2)), 6) AS brier, round(avg(-ln(greatest([p0, p1, p2][y + 1], 1e-12))), 6) AS nll, round(avg(-(power(1 - [p0, p1, p2][y + 1], 2) * ln(greatest([p0, p1, p2][y + 1], 1e-12)))), 6) AS focal"


@query("probability_losses", D.sql(f"SELECT fold, {_SCALARS}, round(avg(-((y = 0)::INT * ln(least(greatest(p0, 1e-9), 1 - 1e-9)) + (y <> 0)::INT * ln(1 - least(greatest(p0, 1e-9), 1 - 1e-9)))), 6) AS logloss, round(avg(-(p0 * ln(p0 + 1e-12) + p1 * ln(p1 + 1e-12) + p2 * ln(p2 + 1e-12))), 6) AS entropy FROM probs GROUP BY fold"))
def probability_losses(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumn("safe", (F.col("y") == 0).cast("int"))
    return rounded(df.groupBy("fold").agg(M.brier(P, "y").alias("brier"), M.nll(P, "y").alias("nll"), M.focal_loss(P, "y", 2.0).alias("focal"), M.binary_logloss("p0", "safe").alias("logloss"), F.avg(entropy(F.array(*P))).alias("entropy")))


_TOP1 = "SELECT fold, bin, round(avg(conf), 6) AS conf, round(avg(hit), 6) AS acc, count(*) AS n FROM (SELECT fold, greatest(p0, p1, p2) AS conf, (list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1 = y)::INT AS hit, (ceil(greatest(p0, p1, p2) * 15) - 1)::INT AS bin FROM probs) WHERE bin >= 0 GROUP BY ALL"


@query("reliability_bins", D.sql(_TOP1))
def reliability_bins(spark, sf_dir):
    return rounded(M.reliability_top1(D.probs(spark, sf_dir), BY, P, "y"))


@query("ece_top1", D.sql("SELECT fold, round(sum(g) / max(t), 6) AS ece FROM (SELECT fold, bin, abs(sum(hit - conf)) AS g, sum(count(*)) OVER (PARTITION BY fold) AS t FROM (SELECT fold, greatest(p0, p1, p2) AS conf, (list_position([p0, p1, p2], greatest(p0, p1, p2)) - 1 = y)::INT AS hit, (ceil(greatest(p0, p1, p2) * 15) - 1)::INT AS bin FROM probs) GROUP BY fold, bin) GROUP BY fold"))
def ece_top1(spark, sf_dir):
    return rounded(M.ece_top1(D.probs(spark, sf_dir), BY, P, "y"))


@query("ece_binary", D.sql("SELECT fold, round(sum(g) / max(t), 6) AS ece FROM (SELECT fold, b, abs(sum((y = 0)::INT - p0)) AS g, sum(count(*)) OVER (PARTITION BY fold) AS t FROM (SELECT fold, y, p0, least(floor(p0 * 10), 9) AS b FROM probs) GROUP BY fold, b) GROUP BY fold"))
def ece_binary(spark, sf_dir):
    return rounded(M.ece_binary(D.probs(spark, sf_dir).withColumn("safe", (F.col("y") == 0).cast("int")), BY, "p0", "safe"))


@query("regression_metrics", D.sql("SELECT fold, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(corr(mu_age, y_age), 6) AS pearson, round(1 - sum(e * e) / (var_pop(y_age) * count(*)), 6) AS r2, count(*) AS n FROM (SELECT *, mu_age - y_age AS e FROM preds WHERE age_mask) GROUP BY fold"))
def regression_metrics(spark, sf_dir):
    return rounded(M.regression(D.preds(spark, sf_dir), BY, "mu_age", "y_age", F.col("age_mask")))


@query("coverage", D.sql("SELECT fold, round(avg((abs(mu_age - y_age) <= 4)::INT), 6) AS fixed, round(avg((abs(mu_age - y_age) <= 1.6 * sigma_age)::INT), 6) AS scaled FROM preds WHERE age_mask GROUP BY fold"))
def coverage(spark, sf_dir):
    mu, t, s = F.col("mu_age"), F.col("y_age"), F.col("sigma_age")
    return rounded(D.preds(spark, sf_dir).filter("age_mask").groupBy("fold").agg(M.coverage(mu - 4, mu + 4, t).alias("fixed"), M.coverage(mu - 1.6 * s, mu + 1.6 * s, t).alias("scaled")))


@query("precision_at_k", D.sql("SELECT fold, round(avg(good), 6) AS precision_at_k FROM (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY -mu_age DESC, cell_id) AS r, (-y_age >= median(-y_age) OVER (PARTITION BY fold))::INT AS good FROM preds) WHERE r <= 50 GROUP BY fold"))
def precision_at_k(spark, sf_dir):
    df = D.preds(spark, sf_dir).withColumns({"s": -F.col("mu_age"), "q": -F.col("y_age")})
    return rounded(M.precision_at_k(df, BY, "s", "q", 50))


_SPEAR = "SELECT fold, round(corr(ra, rb), 6) AS spearman FROM (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY mu_age) + (count(*) OVER (PARTITION BY fold, mu_age) - 1) / 2 AS ra, rank() OVER (PARTITION BY fold ORDER BY y_age) + (count(*) OVER (PARTITION BY fold, y_age) - 1) / 2 AS rb FROM preds) GROUP BY fold"


@query("spearman", D.sql(_SPEAR))
def spearman(spark, sf_dir):
    return rounded(M.spearman(D.preds(spark, sf_dir), BY, "mu_age", "y_age"))


@query("des", D.sql("""SELECT pert_id, round(count(*) FILTER (a AND b) / count(*)::DOUBLE, 6) AS jaccard FROM (SELECT pert_id, gene, bool_or(src = 0) AS a, bool_or(src = 1) AS b FROM (
  SELECT 0 AS src, pert_id, gene FROM top_odd UNION ALL SELECT 1, pert_id, gene FROM top_even) GROUP BY ALL) GROUP BY 1""",
  cmean="SELECT gene, coalesce(sum(value) FILTER (is_control), 0) / (SELECT count(*) FROM cells WHERE is_control) AS c FROM expr JOIN cells USING (cell_id) GROUP BY 1",
  **{f"top_{n}": f"SELECT pert_id, gene FROM (SELECT pert_id, gene, row_number() OVER (PARTITION BY pert_id ORDER BY round((coalesce(d, 0) + (n - coalesce(k, 0)) * c) / n, 9) DESC, gene) AS r, count(*) OVER (PARTITION BY pert_id) AS g FROM (SELECT pert_id, count(*) AS n FROM cells WHERE NOT is_control AND cell_id % 2 = {k} GROUP BY 1) CROSS JOIN cmean LEFT JOIN (SELECT pert_id, gene, sum(abs(value - c)) AS d, count(*) AS k FROM expr JOIN cells USING (cell_id) JOIN cmean USING (gene) WHERE NOT is_control AND cell_id % 2 = {k} GROUP BY ALL) USING (pert_id, gene)) WHERE r <= greatest(1, floor(g * 0.1))" for n, k in (("odd", 1), ("even", 0))}))
def des(spark, sf_dir):
    """The genes that move most from the controls, in two halves of a perturbation's cells."""
    cells, expr = D.cells(spark, sf_dir), staged(D.expr(spark, sf_dir), "expr")
    treated = cells.filter("NOT is_control").select("cell_id", "pert_id")

    def top(k: int):
        shift = V.mean_shift(expr, treated.filter(F.col("cell_id") % 2 == k), "pert_id", cells.filter("is_control"))
        return M.top_share(shift.withColumn("shift", F.round("shift", 9)), ["pert_id"], "gene", "shift", 0.1).select("pert_id", "gene")

    return rounded(M.jaccard(top(1), top(0), ["pert_id"], "gene"))


_EDIST = """SELECT a.label, round(greatest(2 * ab - aa - bb, 0), 5) AS e_distance FROM
  (SELECT x.label, avg(list_distance(x.v, c.v)) AS ab FROM vectors x, vectors c WHERE x.label <> 0 AND c.label = 0 GROUP BY 1) a
  JOIN (SELECT x.label, avg(list_distance(x.v, z.v)) AS aa FROM vectors x JOIN vectors z USING (label) WHERE label <> 0 GROUP BY 1) USING (label), (SELECT avg(list_distance(x.v, z.v)) AS bb FROM vectors x, vectors z WHERE x.label = 0 AND z.label = 0)"""


@query("edistance_to_control", D.sql(_EDIST))
def edistance(spark, sf_dir):
    v = D.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(M.energy_to_control(v, "label", "v", F.col("label") == 0), 5)


@query("class_mass", D.sql("SELECT cls::INT AS cls, round(mass, 5) AS mass, round(raw / avg(raw) OVER (), 6) AS weight FROM (SELECT cls, mass, (1 - 0.999) / (1 - power(0.999, mass)) AS raw FROM (SELECT unnest([0, 1, 2]) AS cls, unnest([sum(p0), sum(p1), sum(p2)]) AS mass FROM probs))"))
def class_mass(spark, sf_dir):
    return rounded(M.class_mass(D.probs(spark, sf_dir), P).select("cls", F.round("mass", 5).alias("mass"), "weight"))


@query("huber_masked", D.sql("SELECT fold, round(avg(CASE WHEN e <= 3 THEN e * e / 2 ELSE 3 * (e - 1.5) END), 6) AS huber FROM (SELECT fold, abs(mu_age - y_age) AS e FROM preds WHERE age_mask) GROUP BY fold"))
def huber(spark, sf_dir):
    return rounded(D.preds(spark, sf_dir).groupBy("fold").agg(M.huber_masked("mu_age", "y_age", F.col("age_mask"), 3.0).alias("huber")))


@query("level_shift", D.sql("SELECT fold, round(median(mu_age) - median(y_age), 6) + 0.0 AS level_shift, round(avg(in_dist::INT), 6) AS in_share, round(avg(abs(mu_age - y_age)) FILTER (NOT in_dist), 6) AS mae_flagged, round(avg(abs(mu_age - y_age)) FILTER (in_dist), 6) AS mae_kept FROM preds WHERE age_mask GROUP BY fold"))
def level_shift(spark, sf_dir):
    e = F.abs(F.col("mu_age") - F.col("y_age"))
    half = F.lit(0.5)
    return rounded(D.preds(spark, sf_dir).filter("age_mask").groupBy("fold").agg(
        (F.percentile("mu_age", half) - F.percentile("y_age", half)).alias("level_shift"), F.avg(F.col("in_dist").cast("double")).alias("in_share"),
        F.avg(F.when(~F.col("in_dist"), e)).alias("mae_flagged"), F.avg(F.when(F.col("in_dist"), e)).alias("mae_kept"),
    ))


@query("precision_recall_at", D.sql("SELECT fold, cutoff::DOUBLE AS cutoff, round(count(*) FILTER (p0 >= cutoff AND y = 0) / nullif(count(*) FILTER (p0 >= cutoff), 0)::DOUBLE, 6) AS precision, round(CASE WHEN count(*) FILTER (p0 >= cutoff) = 0 THEN 0 ELSE count(*) FILTER (p0 >= cutoff AND y = 0) / nullif(count(*) FILTER (y = 0), 0)::DOUBLE END, 6) AS recall, count(*) FILTER (p0 >= cutoff) AS n_flagged FROM probs, (SELECT unnest([0.3, 0.5, 0.9, 0.999]) AS cutoff) GROUP BY ALL"))
def precision_recall(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumn("good", (F.col("y") == 0).cast("int"))
    return rounded(M.precision_recall_at(df, BY, "p0", "good", [0.3, 0.5, 0.9, 0.999]))


@query("saturation_and_ratio", D.sql("SELECT fold, round(avg((p0 > 0.6)::INT), 6) AS saturated, round(quantile_cont(abs(mu_age - y_age) / sigma_age, 0.1), 6) AS p10, round(quantile_cont(abs(mu_age - y_age) / sigma_age, 0.5), 6) AS p50, round(quantile_cont(abs(mu_age - y_age) / sigma_age, 0.9), 6) AS p90 FROM probs GROUP BY fold"))
def saturation(spark, sf_dir):
    df = D.probs(spark, sf_dir).withColumn("ratio", F.abs(F.col("mu_age") - F.col("y_age")) / F.col("sigma_age"))
    q = lambda x: F.percentile("ratio", F.lit(x))
    return rounded(df.groupBy("fold").agg(F.avg((F.col("p0") > 0.6).cast("double")).alias("saturated"), q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90")))


@query("metrics_long", D.sql(f"SELECT fold, metric, value FROM (SELECT fold, unnest(['brier', 'nll']) AS metric, unnest([brier, nll]) AS value FROM (SELECT fold, {_SCALARS} FROM probs GROUP BY fold))"))
def metrics_long(spark, sf_dir):
    wide = D.probs(spark, sf_dir).groupBy("fold").agg(M.brier(P, "y").alias("brier"), M.nll(P, "y").alias("nll"))
    return rounded(M.long_form(wide, ["fold"], ["brier", "nll"]))

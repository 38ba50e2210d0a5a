"""Queries of fits with groups left out: all folds from one pass, elapsed time as an input, sweeps. SQL solves the normal equations by Cramer's rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import heldout as H, metrics as M, statistics as ST, timecourse as T
from . import domain as D
from .registry import query, rounded


def det(a: list[list[str]]) -> str:
    """The determinant of a matrix of SQL expressions."""
    if len(a) == 1:
        return a[0][0]
    return "(" + " ".join(f"{'+' if j % 2 == 0 else '-'} ({a[0][j]}) * {det([r[:j] + r[j + 1 :] for r in a[1:]])}" for j in range(len(a))) + ")"


def moments_sql(group: str, cols: list[str], y: str, source: str) -> str:
    v = ["1.0::DOUBLE", *(f"({c})::DOUBLE" for c in (*cols, y))]
    return f"SELECT {group} AS g, " + ", ".join(f"sum({v[i]} * {v[j]}) AS m{i}{j}" for i in range(len(v)) for j in range(i, len(v))) + f" FROM {source} GROUP BY 1"


def ridge_sql(sums: str, k: int, alpha: float = 1.0, left_out: bool = True) -> str:
    """g, b0, b1..: ridge on standardised columns, from moments (g, m00, m01, ...), of all groups but g, or of all."""
    names = [f"m{i}{j}" for i in range(k + 2) for j in range(i, k + 2)]
    rest = f"SELECT s.g, {', '.join(f't.{m} - s.{m} AS {m}' if left_out else f't.{m}' for m in names)} FROM {sums if left_out else '(SELECT 0 AS g)'} s, (SELECT {', '.join(f'sum({m}) AS {m}' for m in names)} FROM {sums}) t"
    c = lambda i, j: f"(m{min(i, j)}{max(i, j)} - m0{i} * m0{j} / m00)"
    sd = [f"s{i + 1}" for i in range(k)]
    spread = ", ".join(f"CASE WHEN {c(i, i)} / m00 > 1e-24 THEN sqrt({c(i, i)} / m00) ELSE 1 END AS s{i}" for i in range(1, k + 1))
    gram = [[f"{c(i + 1, j + 1)} / ({sd[i]} * {sd[j]}) + {alpha if i == j else 0.0}::DOUBLE" for j in range(k)] for i in range(k)]
    right = [f"{c(i + 1, k + 1)} / {sd[i]}" for i in range(k)]
    entries = ", ".join([*(f"{gram[i][j]} AS a{i}{j}" for i in range(k) for j in range(k)), *(f"{right[i]} AS r{i}" for i in range(k))])
    a = [[f"a{i}{j}" for j in range(k)] for i in range(k)]
    weights = ", ".join(f"{det([[f'r{i}' if j == q else a[i][j] for j in range(k)] for i in range(k)])} / {det(a)} / {sd[q]} AS b{q + 1}" for q in range(k))
    solved = f"SELECT *, {weights} FROM (SELECT *, {entries} FROM (SELECT *, {spread} FROM ({rest})))"
    return f"SELECT g, (m0{k + 1} {' '.join(f'- b{i + 1} * m0{i + 1}' for i in range(k))}) / m00 AS b0, {', '.join(f'b{i + 1}' for i in range(k))} FROM ({solved})"


_COLS = ["z0", "z1", "sigma_age"]
_LEFT = {"masked": "SELECT *, fold AS grp FROM preds WHERE age_mask", "sums": moments_sql("grp", _COLS, "y_age", "masked"), "fits": ridge_sql("sums", 3)}
_PRED = "b0 + b1 * z0 + b2 * z1 + b3 * sigma_age"


def _masked(spark, sf_dir):
    return D.preds(spark, sf_dir).filter("age_mask").withColumn("grp", F.col("fold"))


@query("group_moments", D.sql("SELECT g AS grp, m00::BIGINT AS n, round(m01, 4) AS s_z0, round(m13, 4) AS s_z0_sigma, round(m34, 4) + 0.0 AS s_sigma_age, round(m44, 4) AS s_age2 FROM sums", **_LEFT))
def group_moments(spark, sf_dir):
    """The sums that every left-out fit is made of."""
    at = {(i, j): n for n, (i, j) in enumerate((i, j) for i in range(5) for j in range(i, 5))}
    m = H.moments(_masked(spark, sf_dir), "grp", _COLS, "y_age")
    return rounded(m.select("grp", "n", *(F.get("m", F.lit(at[k])).alias(a) for a, k in (("s_z0", (0, 1)), ("s_z0_sigma", (1, 3)), ("s_sigma_age", (3, 4)), ("s_age2", (4, 4))))), 4)


@query("leave_group_out", D.sql(f"SELECT grp, count(*) AS n, round(avg(abs(e)), 5) AS mae, round(1 - sum(e * e) / (var_pop(y_age) * count(*)), 5) AS r2, NULL::VARCHAR AS error FROM (SELECT grp, y_age, {_PRED} - y_age AS e FROM masked JOIN fits ON g = grp) GROUP BY 1", **_LEFT))
def leave_group_out(spark, sf_dir):
    """Ridge with every line left out, from one pass."""
    return rounded(H.leave_group_out(_masked(spark, sf_dir), "grp", _COLS, "y_age"), 5)


_FORWARD = {
    "points": "SELECT donor, t, value, unsafe FROM (SELECT *, count(*) OVER (PARTITION BY donor) AS k FROM (SELECT donor, day AS t, avg(value) AS value, avg((row_id % 5 = 0)::INT) AS unsafe, count(*) AS n FROM course GROUP BY ALL HAVING count(*) >= 2)) WHERE k >= 3",
    "fpairs": "SELECT a.donor AS grp, a.value AS v_i, a.unsafe AS u_i, b.value AS v_j, b.unsafe AS u_j, ln(1 + b.t - a.t) AS dt, ln(1 + b.t - a.t) * ln(1 + b.t - a.t) AS dt2 FROM points a JOIN points b ON a.donor = b.donor AND b.t > a.t",
} | {f"{k}{n}": q for k, y in (("v", "v_j"), ("u", "u_j")) for n, cols in ((1, ["v_i", "u_i"]), (2, ["v_i", "u_i", "dt", "dt2"])) for q in (moments_sql("grp", cols, y, "fpairs"),)}
_FORWARD |= {f"{k}fit{n}": ridge_sql(f"{k}{n}", 2 * n) for k in "vu" for n in (1, 2)} | {"swept": ridge_sql("v2", 4, left_out=False)}
_ONE, _TWO = "b0 + b1 * v_i + b2 * u_i", "b0 + b1 * v_i + b2 * u_i + b3 * dt + b4 * dt2"


def _gate_sql(k: str, y: str) -> str:
    arm = lambda n, p: f"SELECT grp, count(*) AS n, avg(abs({p} - {y})) AS mae FROM fpairs JOIN {k}fit{n} ON g = grp GROUP BY 1"
    return f"SELECT grp, a.n, a.mae AS mae_state, b.mae AS mae_both FROM ({arm(1, _ONE)}) a JOIN ({arm(2, _TWO)}) b USING (grp)"


_FORWARD |= {"gated": f"SELECT 'age' AS target, * FROM ({_gate_sql('v', 'v_j')}) UNION ALL SELECT 'unsafe', * FROM ({_gate_sql('u', 'u_j')})"}


def _forward(spark, sf_dir):
    c = D.course(spark, sf_dir).withColumnRenamed("day", "t")
    unsafe = c.groupBy("donor", "t").agg(F.avg((F.col("row_id") % 5 == 0).cast("double")).alias("unsafe"))
    p = T.timepoints(c, 3, 2).join(unsafe, ["donor", "t"])
    v = T.forward_pairs(p)
    u = T.forward_pairs(p, value="unsafe").select("donor", "t_i", "t_j", F.col("v_i").alias("u_i"), F.col("v_j").alias("u_j"))
    pairs = v.join(u, ["donor", "t_i", "t_j"]).withColumn("dt", F.ln(1 + F.col("dt").cast("double"))).withColumnRenamed("donor", "grp")
    first = p.groupBy(F.col("donor").alias("grp")).agg(F.min_by(F.struct(F.col("value").alias("v_i"), F.col("unsafe").alias("u_i")), "t").alias("s")).select("grp", "s.*")
    return pairs, first


def _gates(spark, sf_dir):
    pairs, _ = _forward(spark, sf_dir)
    return M.union_all(*(H.forward_gate(pairs, "grp", ["v_i", "u_i"], y).withColumn("target", F.lit(n)) for n, y in (("age", "v_j"), ("unsafe", "u_j"))))


@query("forward_gate", D.sql("SELECT target, grp, n, round(mae_state, 5) AS mae_state, round(mae_both, 5) AS mae_both FROM gated", **_FORWARD))
def forward_gate(spark, sf_dir):
    """Age and unsafe share of a later time point from an earlier one, with and without the time between, each donor under the others' fit."""
    return rounded(_gates(spark, sf_dir), 5)


@query("forward_interval", D.sql("SELECT target, round(m, 5) + 0.0 AS mean_diff, n, round(m - 2.571::DOUBLE * sd / sqrt(n), 5) + 0.0 AS ci_low, round(m + 2.571::DOUBLE * sd / sqrt(n), 5) + 0.0 AS ci_high, CASE WHEN round(m + 2.571::DOUBLE * sd / sqrt(n), 9) < 0 THEN 'HELPS' WHEN round(m - 2.571::DOUBLE * sd / sqrt(n), 9) > 0 THEN 'HURTS' ELSE 'TIED' END AS status FROM (SELECT target, avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n FROM (SELECT target, mae_both - mae_state AS d FROM gated) GROUP BY 1)", **_FORWARD))
def forward_interval(spark, sf_dir):
    """The paired interval over donors of what elapsed time adds (below zero: it helps). More than ten donors take the table's default point."""
    ci = ST.paired_ci(_gates(spark, sf_dir).select("target", (F.col("mae_both") - F.col("mae_state")).alias("diff")), ["target"])
    status = F.when(F.round("ci_high", 9) < 0, "HELPS").when(F.round("ci_low", 9) > 0, "HURTS").otherwise("TIED")
    return rounded(ci.select("target", "mean_diff", "n", "ci_low", "ci_high", status.alias("status")), 5)


@query("forward_sweep", D.sql("SELECT donor AS grp, round(lo, 6) AS dt_low, round(hi, 6) AS dt_high, round(b0 + b1 * v_i + b2 * u_i + b3 * lo + b4 * lo * lo, 4) AS at_low, round(b0 + b1 * v_i + b2 * u_i + b3 * hi + b4 * hi * hi, 4) AS at_high, round(b3 * (hi - lo) + b4 * (hi * hi - lo * lo), 4) + 0.0 AS swing FROM (SELECT donor, arg_min(value, t) AS v_i, arg_min(unsafe, t) AS u_i FROM points GROUP BY 1), swept, (SELECT quantile_cont(dt, 0.1) AS lo, quantile_cont(dt, 0.9) AS hi FROM fpairs)", **_FORWARD))
def forward_sweep(spark, sf_dir):
    """Each donor's first state, with the elapsed time swept from its 10th to its 90th percentile."""
    pairs, first = _forward(spark, sf_dir)
    s = H.elapsed_sweep(pairs, first, "grp", ["v_i", "u_i"], "v_j")
    return rounded(s.select("grp", F.round("dt_low", 6).alias("dt_low"), F.round("dt_high", 6).alias("dt_high"), *(F.round(c, 4).alias(c) for c in ("at_low", "at_high", "swing"))), 6)

"""The safety-gated efficacy score, responses, ranking, intervals and calibration maps."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import clip, logit, quantile, sigmoid

#: statuses in order of precedence, the last if nothing speaks against it
REJECTED_OOD, REJECTED_UNSAFE, REJECTED_NO_REJUVENATION, APPROVED = "REJECTED_OOD", "REJECTED_UNSAFE", "REJECTED_NO_REJUVENATION", "APPROVED"
OOD_WARNING = "Out-of-distribution: prediction not trustworthy."


@dataclass(frozen=True)
class ScoreParams:
    """Safety floor and its width, safety exponent, scale of the gain in years, weight of its spread, weight of the loss risk."""

    tau_safe: float = 0.85
    w: float = 0.03
    k: float = 2.0
    kappa: float = 5.0
    z_conf: float = 1.0
    lam: float = 0.0

    def __post_init__(self) -> None:
        if not (0 < self.tau_safe < 1 and self.w > 0 and self.k >= 1 and self.kappa > 0 and self.z_conf >= 0 and self.lam >= 0):
            raise ValueError(f"parameters out of bounds: {self}")


def gain(p: ScoreParams, mu: str = "mu_age", sigma: str = "sigma_age") -> Column:
    return F.greatest(F.lit(0.0), -(F.col(mu) + p.z_conf * F.col(sigma)))


def efficacy(df: DataFrame, p: ScoreParams = ScoreParams()) -> DataFrame:
    """df with res and status. df: s, p_loss, mu_age, sigma_age, in_dist."""
    r = gain(p)
    res = sigmoid((F.col("s") - p.tau_safe) / p.w) * F.pow("s", F.lit(p.k)) * (r / (r + p.kappa)) * F.exp(-p.lam * F.col("p_loss"))
    status = F.when(~F.col("in_dist"), REJECTED_OOD).when(F.col("s") < p.tau_safe - 3 * p.w, REJECTED_UNSAFE).when(r == 0, REJECTED_NO_REJUVENATION).otherwise(APPROVED)
    return df.withColumns({"res": F.when(F.col("in_dist"), res).otherwise(0.0), "status": status})


def respond(df: DataFrame, q: float) -> DataFrame:
    """What a caller gets of a scored row: score out of ten, rounded probabilities, interval, warning."""
    return df.select(
        "cell_id", "status", F.bround(10 * F.col("res"), 2).alias("score"), F.bround("s", 3).alias("p_identity_preserved"), F.bround("p_loss", 3).alias("p_identity_loss"), F.bround("p_death", 3).alias("p_apoptosis"),
        F.bround("mu_age", 2).alias("delta_age_mean"), F.bround(F.col("mu_age") - q, 2).alias("low"), F.bround(F.col("mu_age") + q, 2).alias("high"), "in_dist",
        F.when(~F.col("in_dist"), OOD_WARNING).alias("warning"),
    )


def rank_candidates(responses: DataFrame, top: int = 0) -> DataFrame:
    """Approved first, then by score, then by id; top 0 is all."""
    ordered = responses.orderBy(F.col("status") != APPROVED, F.desc("score"), "cell_id")
    return ordered.limit(top) if top else ordered


def fit_conformal(residuals: DataFrame, by: list[str], levels: list[float], col: str = "abs_residual", approx: bool = False) -> DataFrame:
    """by, level, q, attainable: the ceil((n + 1) level)-th smallest residual, at most the largest; 1000 without residuals.

    Equal residuals are counted first, so the window runs over distinct ones; approx takes a sketch's quantile instead, for groups too large to be sorted in one task.
    """
    grid = F.explode(F.array(*(F.lit(float(v)) for v in levels)))
    if approx:
        at = residuals.groupBy(*by).agg(F.count(col).alias("n"), *(F.percentile_approx(col, v, 10_000).alias(f"q{i}") for i, v in enumerate(levels)))
        long = at.select(*by, "n", F.inline(F.array(*(F.struct(F.lit(float(v)).alias("level"), F.col(f"q{i}").cast("double").alias("q")) for i, v in enumerate(levels)))))
        return long.select(*by, "level", F.coalesce("q", F.lit(1e3)).alias("q"), F.coalesce(F.ceil((F.col("n") + 1) * F.col("level")) <= F.col("n"), F.lit(False)).alias("attainable"))
    each = residuals.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("m"))
    w = Window.partitionBy(*by)
    ranked = each.select(*by, col, "m", F.sum("m").over(w.orderBy(col)).alias("upto"), F.sum("m").over(w).alias("n"))
    want = ranked.withColumn("level", grid).withColumn("k", F.ceil((F.col("n") + 1) * F.col("level")))
    at = F.greatest(F.lit(1), F.least("k", "n"))
    got = want.filter((F.col("upto") >= at) & (F.col("upto") - F.col("m") < at)).select(*by, "level", F.col(col).alias("q"), (F.col("k") <= F.col("n")).alias("attainable"))
    wanted = residuals.select(*by).distinct().withColumn("level", grid)
    return wanted.join(got, [*by, "level"], "left").select(*by, "level", F.coalesce("q", F.lit(1e3)).alias("q"), F.coalesce("attainable", F.lit(False)).alias("attainable"))


def sigma_scale(df: DataFrame, by: list[str], residual: str, sigma: str, level: float = 0.9, z: float = 1.6448536269514722, approx: bool = False) -> DataFrame:
    """max(1, level-quantile of |residual| over z times the median spread); 1 where that is no number."""
    ratio = quantile(F.abs(F.col(residual)), level, approx) / F.nullif(quantile(sigma, 0.5, approx) * z, F.lit(0.0))
    return df.groupBy(*by).agg(F.greatest(F.lit(1.0), F.coalesce(ratio, F.lit(1.0))).alias("sigma_scale"))


def apply_platt(df: DataFrame, slope: float, intercept: float, s: str = "p0", loss: str = "p1", death: str = "p2") -> DataFrame:
    """The safe probability recalibrated; loss and death keep their ratio, or share evenly if both are 0."""
    new = sigmoid(slope * logit(F.col(s)) + intercept)
    rest = F.col(loss) + F.col(death)
    share = F.when(rest > 0, F.col(loss) / F.nullif(rest, F.lit(0.0))).otherwise(0.5)
    return df.withColumns({s: new, loss: (1 - new) * share, death: (1 - new) * (1 - share)})


def temperature_grid(df: DataFrame, logits: list[str], y: str, grid: list[float]) -> DataFrame:
    """t, nll of the logits divided by each temperature: one aggregate a temperature, in one pass over the rows as they are."""
    top = F.greatest(*(F.col(c) for c in logits))
    own = F.element_at(F.array(*logits), F.col(y) + 1)

    def nll(t: float) -> Column:
        parts = [F.exp((F.col(c) - top) / t) for c in logits]
        return F.avg((top - own) / t + F.ln(sum(parts[1:], parts[0])))

    ts = list(dict.fromkeys(grid))
    wide = df.agg(*(nll(t).alias(f"n{i}") for i, t in enumerate(ts)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"n{i}").alias("nll")) for i, t in enumerate(ts)))))


def fit_temperature(df: DataFrame, logits: list[str], y: str, points: int = 25, rounds: int = 3) -> float:
    """The temperature in [0.01, 100] with the least loss, never worse than 1: a grid of logarithms, narrowed about its best."""
    low, high, best = math.log(0.01), math.log(100.0), (math.inf, 1.0)
    for _ in range(rounds):
        grid = [math.exp(low + (high - low) * i / (points - 1)) for i in range(points)] + [1.0]
        got = sorted((r["nll"], r["t"]) for r in temperature_grid(df, logits, y, grid).collect() if r["nll"] is not None)
        best = min([best, *got]) if got else best
        step = (high - low) / (points - 1)
        low, high = max(math.log(0.01), math.log(best[1]) - step), min(math.log(100.0), math.log(best[1]) + step)
    return best[1]


def minmax_by_calib(test: DataFrame, calib: DataFrame, by: list[str], col: str, q: float, approx: bool = False) -> DataFrame:
    """test with scaled (clipped to [0, 1] by the calibration set's range) and threshold (its scaled quantile). Without a range scaled is 0 and the threshold 0.5, which flags nothing."""
    ranges = calib.groupBy(*by).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), quantile(col, q, approx).alias("t"))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    scaled = lambda c, flat: F.when(width.isNull(), flat).otherwise(clip((c - F.col("lo")) / width, 0.0, 1.0))
    return test.join(F.broadcast(ranges), by).withColumns({"scaled": scaled(F.col(col), 0.0), "threshold": scaled(F.col("t"), 0.5)}).drop("lo", "hi", "t")


def ensemble_combine(members: DataFrame, logits: list[str], age: str, scale: float = 1.0) -> DataFrame:
    """cell_id, p0.., mu_age, sigma_age: means of the members' softmax probabilities and ages, spread of ages times scale."""
    z = [F.col(c) for c in logits]
    top = F.greatest(*z)
    total = sum((F.exp(c - top) for c in z[1:]), F.exp(z[0] - top))
    probs = members.withColumns({f"q{i}": F.exp(c - top) / total for i, c in enumerate(z)})
    return probs.groupBy("cell_id").agg(*(F.avg(f"q{i}").alias(f"p{i}") for i in range(len(z))), F.avg(age).alias("mu_age"), (F.stddev_pop(age) * scale).alias("sigma_age"))


def safe_targets(df: DataFrame, by: list[str], safe: Column, gain_col: str) -> DataFrame:
    """gated: unsafe rows pushed below the worst safe one by 1; penalised: less 3 sd for unsafe ones."""
    g = F.col(gain_col)
    stats = df.groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg((F.min(F.when(safe, g)) - 1).alias("__floor"), F.stddev_pop(g).alias("__sd"))  # a row a group
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(stats[f"__{c}"])
    floor, sd = F.col("__floor"), F.col("__sd")
    return df.join(stats, same).withColumns({"gated": F.when(safe, g).otherwise(F.coalesce(floor, g)), "penalised": g - 3 * sd * (~safe).cast("double"), "good": (safe & (g > 0)).cast("int")}).drop(*stats.columns)

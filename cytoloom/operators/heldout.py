"""Leave-one-group-out ridge from one pass: moments by group, each fit from all moments less its group's, every row predicted by the fit that has not seen its group; logistic fits, one a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import dot
from .baselines import balanced_logistic
from .metrics import prauc, union_all


def moments(df: DataFrame, group: str, cols: list[str], target: str) -> DataFrame:
    """group, n, m: sums of the products of (1, cols, target), the upper triangle row by row. Rows with a null among them are left out. One partial aggregate."""
    v = [F.lit(1.0), *(F.col(c).cast("double") for c in (*cols, target))]
    known = df.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in (*cols, target)))
    pairs = [F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))]
    return known.groupBy(group).agg(F.count("*").alias("n"), F.array(*pairs).alias("m"))


def solved(m: np.ndarray, k: int, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, weights) of least squares with alpha |w|^2 on standardised columns; a column without spread keeps its scale. Raises where there is no unique solution."""
    full = np.zeros((k + 2, k + 2))
    full[np.triu_indices(k + 2)] = m
    full = full + np.triu(full, 1).T
    n = full[0, 0]
    if n < 2:
        raise ValueError(f"a fit needs two rows, not {n:.0f}")
    mean = full[0] / n
    centred = full[1:, 1:] - n * np.outer(mean[1:], mean[1:])
    spread = np.sqrt(np.maximum(np.diag(centred)[:k] / n, 0))
    scale = np.where(spread > 1e-12 * np.maximum(1.0, np.abs(mean[1 : k + 1])), spread, 1.0)
    gram = centred[:k, :k] / np.outer(scale, scale) + alpha * np.eye(k)
    if np.linalg.cond(gram) > 1e12:
        raise ValueError("the columns of the other groups are linearly dependent")
    w = np.linalg.solve(gram, centred[:k, k] / scale) / scale
    return float(mean[k + 1] - w @ mean[1 : k + 1]), w


def left_out_fits(sums: DataFrame, group: str, k: int, alpha: float = 1.0) -> DataFrame:
    """group, n_train, intercept, w, error: the fit on all other groups. A fit that fails is a row with its error. sums: as moments() gives them, of one target."""
    size = (k + 2) * (k + 3) // 2
    total = sums.agg(F.sum("n").alias("all_n"), F.array(*(F.sum(F.get("m", F.lit(i))) for i in range(size))).alias("all_m"))
    rest = sums.crossJoin(F.broadcast(total)).select(group, (F.col("all_n") - F.col("n")).alias("n_train"), F.zip_with("all_m", "m", lambda a, b: a - b).alias("m"))
    kind = sums.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m, n in zip(b.column("m").to_pylist(), b.column("n_train").to_pylist()):
                try:
                    intercept, w = solved(np.array(m), k, alpha)
                    out.append((intercept, w.tolist(), None))
                except (ValueError, np.linalg.LinAlgError) as e:  # recorded: the other folds stand
                    out.append((None, None, str(e)[:500]))
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(group), b.column("n_train"), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.list_(pa.float64())), pa.array(cols[2], pa.string())], names=[group, "n_train", "intercept", "w", "error"])

    return rest.mapInArrow(run, f"`{group}` {kind}, n_train long, intercept double, w array<double>, error string")


def predicted(df: DataFrame, fits: DataFrame, group: str, cols: list[str], out: str = "prediction") -> DataFrame:
    """df with the prediction of its group's fit, which has not seen the group. A few numbers a group are joined."""
    x = F.array(*(F.col(c).cast("double") for c in cols))
    return df.join(fits.select(group, "intercept", "w"), group, "left").withColumn(out, F.col("intercept") + dot(F.col("w"), x)).drop("intercept", "w")


def leave_group_out(df: DataFrame, group: str, cols: list[str], target: str, alpha: float = 1.0, mask: Column | None = None) -> DataFrame:
    """group, n, mae, r2, error of each group under the fit on the others. mask: rows that are fitted and measured."""
    rows = df if mask is None else df.filter(mask)
    fits = left_out_fits(moments(rows, group, cols, target), group, len(cols), alpha)
    e = F.col("prediction") - F.col(target)
    spread = F.var_pop(target) * F.count(target)
    g = predicted(rows, fits, group, cols).groupBy(group).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.when(spread > 1e-12, spread)).alias("r2"))
    return g.join(fits.select(group, "error"), group, "left")


def forward_gate(pairs: DataFrame, group: str, state: list[str], target: str, dt: str = "dt", alpha: float = 1.0) -> DataFrame:
    """group, n, mae_state, mae_both of each donor under the others' fits: does elapsed time (dt and its square) add to the state? pairs: group, state columns, dt, target."""
    timed = pairs.withColumn("__dt2", F.col(dt) * F.col(dt))
    arms = [leave_group_out(timed, group, cols, target, alpha).select(group, "n", F.col("mae").alias(name)) for name, cols in (("mae_state", state), ("mae_both", [*state, dt, "__dt2"]))]
    return arms[0].join(arms[1].drop("n"), group)


def elapsed_sweep(pairs: DataFrame, first: DataFrame, group: str, state: list[str], target: str, dt: str = "dt", alpha: float = 1.0) -> DataFrame:
    """group, dt_low, dt_high, at_low, at_high, swing: the prediction for each donor's first state after the 10th and the 90th percentile of elapsed times, by one fit on all pairs.

    first: group and state columns, one row a donor. The coefficients and the two points are one row.
    """
    timed = pairs.withColumn("__dt2", F.col(dt) * F.col(dt)).withColumn("__all", F.lit(0))
    cols = [*state, dt, "__dt2"]
    none = F.array(*(F.lit(0.0) for _ in range((len(cols) + 2) * (len(cols) + 3) // 2)))
    sums = moments(timed, "__all", cols, target)
    fit = left_out_fits(sums.unionByName(sums.select(F.lit(1).alias("__all"), F.lit(0).cast("long").alias("n"), none.alias("m"))), "__all", len(cols), alpha).filter("__all = 1")
    ends = pairs.agg(F.percentile(dt, F.lit(0.1)).alias("dt_low"), F.percentile(dt, F.lit(0.9)).alias("dt_high"))
    at = lambda t: F.col("intercept") + dot(F.col("w"), F.array(*(F.col(c).cast("double") for c in state), F.col(t), F.col(t) * F.col(t)))
    rows = first.crossJoin(F.broadcast(fit.select("intercept", "w").crossJoin(ends)))
    return rows.select(group, "dt_low", "dt_high", at("dt_low").alias("at_low"), at("dt_high").alias("at_high")).withColumn("swing", F.col("at_high") - F.col("at_low"))


def leave_group_out_fate(df: DataFrame, group: str, groups: list, cols: list[str], hit: str) -> DataFrame:
    """group, n, prauc, log_loss, error of a balanced logistic fit of the 0/1 column `hit` with each of `groups` (a stated few) left out: a fit each, measured in one pass.

    A fit that fails, for one class among the other groups' rows, is a row with its error; rows with a null `hit` or group are left out. A group of one class has no prauc.
    """
    rows = df.filter(F.col(hit).isNotNull())
    parts, failed = [], []
    for g in groups:
        try:
            scored = balanced_logistic(rows.filter(F.col(group) != g), cols, hit)
        except ValueError as e:  # recorded: the other folds stand
            failed.append((g, str(e)[:500]))
            continue
        parts.append(scored(rows.filter(F.col(group) == g)).select(group, hit, F.round("fitted", 9).alias("__p")))
    kind = df.schema[group].dataType.simpleString()
    errors = df.sparkSession.createDataFrame(failed, f"`{group}` {kind}, error string").select(group, F.lit(None).cast("long").alias("n"), F.lit(None).cast("double").alias("prauc"), F.lit(None).cast("double").alias("log_loss"), "error")
    if not parts:
        return errors
    out = union_all(*parts)
    p = F.greatest(F.least("__p", F.lit(1 - 1e-9)), F.lit(1e-9))
    g = out.groupBy(group).agg(F.count("*").alias("n"), F.avg(-F.log(F.when(F.col(hit) == 1, p).otherwise(1 - p))).alias("log_loss"), F.count_distinct(hit).alias("__k"))
    g = g.join(prauc(out, [group], "__p", hit), group, "left").withColumn("prauc", F.when(F.col("__k") == 2, F.col("prauc")))
    return g.select(group, "n", "prauc", "log_loss", F.lit(None).cast("string").alias("error")).unionByName(errors)

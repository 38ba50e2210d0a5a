"""Leakage-free splits, sampling and batching. Order comes from md5 of a seed and the group, so splits are the same everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import unit_hash
from .ranks import ranked

SPLITS = ("train", "val", "calib", "test")


def shuffled(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def group_counts(n: int, fracs: list[float]) -> list[int]:
    """Groups by split: floors, leftovers to the largest remainders, and at least one each if there are four or more."""
    exact = [f * n for f in fracs]
    counts = [int(e + 1e-9) for e in exact]
    order = sorted(range(len(fracs)), key=lambda i: (-(exact[i] - counts[i]), i))
    for i in order[: n - sum(counts)]:
        counts[i] += 1
    if n >= 4:
        for i, c in enumerate(counts):
            if c == 0:
                counts[counts.index(max(counts))] -= 1
                counts[i] = 1
    return counts


def partition_groups(groups: DataFrame, fracs: list[float], seed: int) -> DataFrame:
    """grp, split of distinct groups (few beside the rows): whole groups, exact counts."""
    distinct = groups.select("grp").distinct()
    edges, at = [], 0
    for c in group_counts(distinct.count(), fracs):
        at += c
        edges.append(at)
    rank = F.row_number().over(Window.orderBy(shuffled(seed, "grp"), "grp"))
    split = F.when(F.col("r") <= edges[0], SPLITS[0]).when(F.col("r") <= edges[1], SPLITS[1]).when(F.col("r") <= edges[2], SPLITS[2]).otherwise(SPLITS[3])
    return distinct.withColumn("r", rank).select("grp", split.alias("split"))


def _joined(cells: DataFrame, group: Column, fracs: list[float], seed: int) -> DataFrame:
    keyed = cells.select("cell_id", group.alias("grp"))
    return keyed.join(partition_groups(keyed, fracs, seed), "grp").select("cell_id", "split")


def scaffold_split(cells: DataFrame, fracs: list[float], seed: int) -> DataFrame:
    """Controls are pinned to train."""
    free = cells.filter("scaffold_id IS NULL OR scaffold_id <> 'CONTROL'")
    pinned = cells.filter("scaffold_id = 'CONTROL'").select("cell_id", F.lit("train").alias("split"))
    return _joined(free, F.coalesce("scaffold_id", "pert_id"), fracs, seed).unionByName(pinned)


def cell_line_split(cells: DataFrame, fracs: list[float], seed: int) -> DataFrame:
    return _joined(cells, F.col("cell_line"), fracs, seed)


def held_groups(cells: DataFrame, col: str, frac: float, seed: int) -> DataFrame:
    """The groups of `col` that are held out: floor(frac * groups), at least one."""
    groups = cells.select(F.col(col).alias("grp")).distinct()
    n = max(1, int(groups.count() * frac + 1e-9))
    return groups.orderBy(shuffled(seed, "grp"), "grp").limit(n)


def both_split(cells: DataFrame, fracs: list[float], seed: int) -> DataFrame:
    """test: scaffold and line both held out; train, val, calib: neither, by scaffold; the rest is dropped.

    The three fractions are rescaled and the fourth is 0, so with four or more seen groups one of them is test too.
    """
    scaf = held_groups(cells, "scaffold_id", fracs[3], seed).select(F.col("grp").alias("scaffold_id"), F.lit(True).alias("new_scaf"))
    line = held_groups(cells, "cell_line", fracs[3], seed + 1).select(F.col("grp").alias("cell_line"), F.lit(True).alias("new_line"))
    marked = cells.join(F.broadcast(scaf), "scaffold_id", "left").join(F.broadcast(line), "cell_line", "left")
    marked = marked.select("cell_id", "scaffold_id", F.coalesce("new_scaf", F.lit(False)).alias("ns"), F.coalesce("new_line", F.lit(False)).alias("nl"))
    seen = sum(fracs[:3])
    inner = partition_groups(marked.filter("NOT ns AND NOT nl").select(F.col("scaffold_id").alias("grp")), [f / seen for f in fracs[:3]] + [0.0], seed + 2)
    out = marked.join(F.broadcast(inner.withColumnRenamed("grp", "scaffold_id")), "scaffold_id", "left")
    return out.select("cell_id", F.when(F.col("ns") & F.col("nl"), "test").when(F.col("ns") | F.col("nl"), "drop").otherwise(F.col("split")).alias("split"))


def draw(u: Column, fracs: list[float]) -> Column:
    out, at = F.lit(SPLITS[len(fracs) - 1]), sum(fracs)
    for f, name in reversed(list(zip(fracs[:-1], SPLITS))):
        at -= fracs[SPLITS.index(name) + 1]
        out = F.when(u < at, name).otherwise(out)
    return out


def random_split(cells: DataFrame, fracs: list[float], seed: int) -> DataFrame:
    return cells.select("cell_id", draw(unit_hash(str(seed), F.col("cell_id")), fracs).alias("split"))


def holdout_split(cells: DataFrame, fracs: list[float], seed: int, lines: list) -> DataFrame:
    """Named lines are test, the rest is drawn."""
    seen = sum(fracs[:3])
    drawn = draw(unit_hash(str(seed), F.col("cell_id")), [f / seen for f in fracs[:3]])
    return cells.select("cell_id", F.when(F.col("cell_line").isin(lines), "test").otherwise(drawn).alias("split"))


def line_holdout_split(cells: DataFrame, fracs: list[float], seed: int, line, share: float) -> DataFrame:
    """A share of one line is test, the rest is drawn."""
    seen = sum(fracs[:3])
    drawn = draw(unit_hash(str(seed), F.col("cell_id")), [f / seen for f in fracs[:3]])
    test = (F.col("cell_line") == line) & (unit_hash(f"{seed}-line", F.col("cell_id")) < share)
    return cells.select("cell_id", F.when(test, "test").otherwise(drawn).alias("split"))


REGIMES: dict[str, Callable[..., DataFrame]] = {"scaffold": scaffold_split, "cell_line": cell_line_split, "both": both_split, "random": random_split, "holdout": holdout_split, "line_holdout": line_holdout_split}


def make_splits(cells: DataFrame, regimes: list[str], fracs: list[float], seed: int, lines: list | None = None, line=None, share: float = 0.3) -> DataFrame:
    """regime, cell_id, split of all regimes at once; an unknown one is an error. holdout needs `lines`, line_holdout a `line` and the share of it that is test."""
    if unknown := set(regimes) - set(REGIMES):
        raise ValueError(f"unknown regimes: {sorted(unknown)}")
    if ("holdout" in regimes and not lines) or ("line_holdout" in regimes and line is None):
        raise ValueError("holdout needs lines, line_holdout a line")
    more = {"holdout": (lines,), "line_holdout": (line, share)}
    parts = [REGIMES[r](cells, fracs, seed, *more.get(r, ())).select(F.lit(r).alias("regime"), "cell_id", "split") for r in regimes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gather_split(samples: DataFrame, splits: DataFrame, regime: str, split: str) -> DataFrame:
    wanted = splits.filter((F.col("regime") == regime) & (F.col("split") == split))
    return samples.join(wanted, "cell_id", "left_semi")


def stratified_batches(cells: DataFrame, size: int, seed: int) -> DataFrame:
    """cell_id, batch: controls and treated of a chunk dealt evenly, so that every batch has controls."""
    n = cells.groupBy("chunk_id").agg(F.ceil(F.count("*") / size).alias("k"))
    r = ranked(cells.select("cell_id", "chunk_id", "is_control"), ["chunk_id", "is_control"], [shuffled(seed, "cell_id"), F.col("cell_id")])
    batch = _dealt(F.col("rank") - 1, F.col("size"), F.col("k"))
    return r.join(n, "chunk_id").select("cell_id", "chunk_id", "is_control", batch.cast("long").alias("batch"))


def cap_per_sample(cells: DataFrame, by: list[str], n: int, seed: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(shuffled(seed, "cell_id"), "cell_id"))
    return cells.withColumn("r", rank).filter(F.col("r") <= n).drop("r")


def cap_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(shuffled(seed, "cell_id"), "cell_id").limit(n)


def composition(cells: DataFrame, splits: DataFrame, value: str) -> DataFrame:
    both = cells.join(splits, "cell_id")
    counts = both.groupBy("cell_line").pivot("split", list(SPLITS)).agg(F.count("cell_id"))
    return counts.na.fill(0).join(both.groupBy("cell_line").agg(F.avg(value).alias("mean_value")), "cell_line")


def inner_lodo(rows: DataFrame, bulk: float = 0.5, least: int = 2) -> DataFrame:
    """fold, cell_id, role: each usable donor is left out in turn; its rows of train, val and calib are evaluated.

    rows: cell_id, donor, split. monitor: validation rows of other donors. Folds number as donors do; rows are repeated once a fold. Fewer than `least` usable donors are an error.
    """
    n = rows.filter("split = 'train'").groupBy("donor").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    folds = n.crossJoin(F.broadcast(total)).filter(F.col("total") - F.col("n") >= F.lit(bulk) * F.col("total")).select(F.col("donor").alias("fold"))
    if (usable := folds.limit(least).count()) < least:
        raise ValueError(f"only {usable} donors can be left out; {least} are needed")
    used = rows.filter("split IN ('train', 'val', 'calib')").crossJoin(F.broadcast(folds))
    role = F.when(F.col("donor") == F.col("fold"), "eval").when(F.col("split") == "train", "train").when(F.col("split") == "val", "monitor")
    return used.select("fold", "cell_id", role.alias("role")).filter("role IS NOT NULL")


def kfold(df: DataFrame, k: int, seed: int, by: list[str]) -> DataFrame:
    """fold of each row of a table, dealt within `by` as ntile deals: the first folds get one row more. A group may hold nearly all rows."""
    r = ranked(df, by, [shuffled(seed, "cell_id"), F.col("cell_id")], "__rank", "__size")
    return r.withColumn("fold_k", _dealt(F.col("__rank") - 1, F.col("__size"), F.lit(k)).cast("int")).drop("__rank", "__size")


def _dealt(r: Column, m: Column, k: Column) -> Column:
    """The part of k that row r of m (from 0) falls in: the first m mod k parts get one more."""
    big, base = m % k, F.floor(m / k)
    return F.when(r < big * (base + 1), F.floor(r / (base + 1))).otherwise(big + F.floor((r - big * (base + 1)) / F.greatest(base, F.lit(1))))


def union_splits(*parts: DataFrame) -> DataFrame:
    """Rows of several splits, each cell once, though a split be passed twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["cell_id"])


def codes(rows: DataFrame, name: str) -> DataFrame:
    """name, code: numbers of the distinct names in their order, from 0. Names are a dimension."""
    return rows.select(name).distinct().withColumn("code", (F.row_number().over(Window.orderBy(name)) - 1).cast("int"))

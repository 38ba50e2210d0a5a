"""Ranks of rows in a group that may hold nearly all of them: by a distributed sort, not by a window over the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..streaming.run import staged

_PART = 33  # monotonically_increasing_id() has the partition above, the place in it below


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank", size: str = "size", parts: int | None = None) -> DataFrame:
    """df with the rank of each row in its group (from 1, as row_number() gives it) and the group's size. `order` should leave no ties.

    Rows are sorted over ranges of (by, order), which cut through a group as often as its rows need, and written once. A row's rank is its place in its
    range, less the place of its group's first row there, plus the group's rows in the ranges before: a table of a row a group and range, joined back on both.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*(F.col(c) for c in by), *order]
    at = staged(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__at", _PART))
    runs = at.groupBy(*by, "__part").agg(F.min("__at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy(*by)  # of ranges, not of rows
    before = F.coalesce(F.sum("n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__p"), (before - F.col("first") + 1).alias("__shift"), F.sum("n").over(group).alias(size))
    same = at["__part"] == runs["__p"]
    for c in by:
        same = same & at[c].eqNullSafe(runs[f"__{c}"])
    return at.join(runs, same).withColumn(rank, F.col("__at") + F.col("__shift")).select(*df.columns, rank, size)


def medians(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """by, median: the exact median of the values that are not null, from ranks."""
    r = ranked(df.filter(F.col(value).isNotNull()).select(*by, value, tie), by, [F.col(value), F.col(tie)])
    middle = r.filter((F.col("rank") == F.floor((F.col("size") + 1) / 2)) | (F.col("rank") == F.floor(F.col("size") / 2) + 1))
    return middle.groupBy(*by).agg(F.avg(value).alias("median"))

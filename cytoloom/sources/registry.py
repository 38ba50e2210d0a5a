"""Sources of measurements by name: each plans its chunks and fetches one as (cells, expr)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Source(Protocol):
    """plan gives one row a chunk (chunk_id and what fetch needs); fetch gives the cells and the sparse expression of chunks."""

    def plan(self, spark: SparkSession) -> DataFrame: ...

    def fetch(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]: ...


SOURCES: dict[str, Callable[..., Source]] = {}


def source(name: str):
    """Registers a source under `name`; a second one of the name is an error."""

    def add(cls):
        if name in SOURCES:
            raise ValueError(f"source {name} is registered already")
        SOURCES[name] = cls
        return cls

    return add


def fetch_all(spark: SparkSession, sources: list[Source]) -> tuple[DataFrame, DataFrame]:
    """Cells and expression of several sources; a chunk that two of them plan is an error."""
    from ..operators.perturbation import union_sources

    plans = [s.plan(spark) for s in sources]
    union_sources(*(p.select("chunk_id") for p in plans))  # it looks for ids planned twice
    got = [s.fetch(p) for s, p in zip(sources, plans)]
    cells, expr = got[0]
    for c, e in got[1:]:
        cells, expr = cells.unionByName(c, allowMissingColumns=True), expr.unionByName(e)
    return cells, expr


@source("tables")
class Tables:
    """Tables at hand: cells (chunk_id, cell_id, ...) and expr (cell_id, gene, value)."""

    def __init__(self, cells: DataFrame, expr: DataFrame):
        self.cells, self.expr = cells, expr

    def plan(self, spark: SparkSession) -> DataFrame:
        return self.cells.select("chunk_id").distinct()

    def fetch(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        cells = self.cells.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        return cells, self.expr.join(cells.select("cell_id"), "cell_id", "left_semi")

"""Queries of splits, sampling and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as S
from . import domain as D
from .registry import SQL, query, rounded

FRACS = [0.7, 0.1, 0.1, 0.1]
SEED = 7


def _key(expr: str, seed: int | str = SEED) -> str:
    return f"md5('{seed}|' || ({expr})::VARCHAR)"


def _unit(expr: str, seed: int | str = SEED) -> str:
    return f"(('0x' || substr(md5('{seed}|' || ({expr})::VARCHAR), 1, 8))::UBIGINT / 4294967296.0)"


def _groups(source: str, fracs: list[float], seed: int = SEED, less: int = 0) -> str:
    """SQL of partition_groups: floors, largest remainders; less: groups that the first split gives to the last, which would have none."""
    f = ", ".join(map(str, fracs))
    return f"""(SELECT grp, CASE WHEN r <= c1 THEN 'train' WHEN r <= c1 + c2 THEN 'val' WHEN r <= c1 + c2 + c3 THEN 'calib' ELSE 'test' END AS split FROM
  (SELECT grp, row_number() OVER (ORDER BY {_key("grp", seed)}, grp) AS r FROM (SELECT DISTINCT grp FROM ({source}))),
  (SELECT k[1] - {less} AS c1, k[2] AS c2, k[3] AS c3 FROM (SELECT list(c ORDER BY i) AS k FROM (SELECT i, c0 + CASE WHEN rk <= n - sum(c0) OVER () THEN 1 ELSE 0 END AS c FROM
    (SELECT i, n, floor(f * n + 1e-9)::INT AS c0, row_number() OVER (ORDER BY floor(f * n + 1e-9) - f * n, i) AS rk FROM (SELECT unnest([{f}]) AS f, unnest(range({len(fracs)})) AS i), (SELECT count(DISTINCT grp) AS n FROM ({source})))))))"""


@query("scaffold_split", D.sql(f"SELECT cell_id, split FROM cells JOIN {_groups("SELECT scaffold_id AS grp FROM cells WHERE scaffold_id <> 'CONTROL'", FRACS)} ON scaffold_id = grp UNION ALL SELECT cell_id, 'train' FROM cells WHERE scaffold_id = 'CONTROL'"))
def scaffold_split(spark, sf_dir):
    return S.scaffold_split(D.cells(spark, sf_dir), FRACS, SEED)


@query("cell_line_split", D.sql(f"SELECT cell_id, split FROM cells JOIN {_groups('SELECT cell_line AS grp FROM cells', FRACS)} ON cell_line = grp"))
def cell_line_split(spark, sf_dir):
    return S.cell_line_split(D.cells(spark, sf_dir), FRACS, SEED)


@query("random_split", D.sql(f"SELECT cell_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.8 THEN 'val' WHEN u < 0.9 THEN 'calib' ELSE 'test' END AS split FROM (SELECT cell_id, {_unit('cell_id')} AS u FROM cells)"))
def random_split(spark, sf_dir):
    return S.random_split(D.cells(spark, sf_dir), FRACS, SEED)


_DRAWN = "CASE WHEN u < 7 / 9.0::DOUBLE THEN 'train' WHEN u < 8 / 9.0::DOUBLE THEN 'val' ELSE 'calib' END"


@query("holdout_split", D.sql(f"SELECT cell_id, CASE WHEN cell_line IN (3, 11) THEN 'test' ELSE {_DRAWN} END AS split FROM (SELECT cell_id, cell_line, {_unit('cell_id')} AS u FROM cells)"))
def holdout_split(spark, sf_dir):
    return S.holdout_split(D.cells(spark, sf_dir), FRACS, SEED, [3, 11])


@query("line_holdout_split", D.sql(f"SELECT cell_id, CASE WHEN cell_line = 5 AND v < 0.3 THEN 'test' ELSE {_DRAWN} END AS split FROM (SELECT cell_id, cell_line, {_unit('cell_id')} AS u, {_unit('cell_id', '7-line')} AS v FROM cells)"))
def line_holdout_split(spark, sf_dir):
    return S.line_holdout_split(D.cells(spark, sf_dir), FRACS, SEED, 5, 0.3)


def _held(col: str, seed: int) -> str:
    return f"{col} IN (SELECT grp FROM (SELECT grp, row_number() OVER (ORDER BY {_key('grp', seed)}, grp) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {col} AS grp FROM cells)) WHERE r <= greatest(1, floor(n * 0.1::DOUBLE + 1e-9)))"


_MARKED = f"SELECT cell_id, scaffold_id, {_held('scaffold_id', SEED)} AS ns, {_held('cell_line', SEED + 1)} AS nl FROM cells"
# the rescaled fourth fraction is 0, so where there are four groups one of them goes from train to test
_BOTH = f"SELECT cell_id, CASE WHEN ns AND nl THEN 'test' WHEN ns OR nl THEN 'drop' ELSE split END AS split FROM marked LEFT JOIN {_groups('SELECT scaffold_id AS grp FROM marked WHERE NOT ns AND NOT nl', [0.7 / 0.9, 0.1 / 0.9, 0.1 / 0.9, 0.0], SEED + 2, 1)} ON scaffold_id = grp"


@query("both_split", D.sql(_BOTH, marked=_MARKED))
def both_split(spark, sf_dir):
    return S.both_split(D.cells(spark, sf_dir), FRACS, SEED)


_REGIMES = {
    "scaffold": SQL["scaffold_split"], "cell_line": SQL["cell_line_split"], "random": SQL["random_split"], "holdout": SQL["holdout_split"], "line_holdout": SQL["line_holdout_split"], "both": D.sql(_BOTH, marked=_MARKED),
}


@query("make_splits", " UNION ALL ".join(f"SELECT '{r}' AS regime, split, count(*) AS n FROM ({q}) GROUP BY split" for r, q in _REGIMES.items()))
def make_splits(spark, sf_dir):
    return S.make_splits(D.cells(spark, sf_dir), list(S.REGIMES), FRACS, SEED, lines=[3, 11], line=5).groupBy("regime", "split").agg(F.count("*").alias("n"))


@query("gather_split", D.sql(f"SELECT cell_id, dose_um, time_h FROM cells WHERE {_unit('cell_id')} < 0.8 AND {_unit('cell_id')} >= 0.7"))
def gather_split(spark, sf_dir):
    cells = D.cells(spark, sf_dir)
    return S.gather_split(cells.select("cell_id", "dose_um", "time_h"), S.make_splits(cells, ["random"], FRACS, SEED), "random", "val")


@query("stratified_batches", D.sql(f"SELECT chunk_id, is_control, batch::BIGINT AS batch, count(*) AS n, min(cell_id) AS first_id FROM (SELECT chunk_id, is_control, cell_id, CASE WHEN r < big * (base + 1) THEN r // (base + 1) ELSE big + (r - big * (base + 1)) // greatest(base, 1) END AS batch FROM (SELECT *, m % k AS big, m // k AS base FROM (SELECT chunk_id, is_control, cell_id, row_number() OVER (PARTITION BY chunk_id, is_control ORDER BY {_key('cell_id')}, cell_id) - 1 AS r, count(*) OVER (PARTITION BY chunk_id, is_control) AS m, k FROM cells JOIN (SELECT chunk_id, ceil(count(*) / 500)::BIGINT AS k FROM cells GROUP BY 1) USING (chunk_id)))) GROUP BY ALL"))
def stratified_batches(spark, sf_dir):
    return S.stratified_batches(D.cells(spark, sf_dir), 500, SEED).groupBy("chunk_id", "is_control", "batch").agg(F.count("*").alias("n"), F.min("cell_id").alias("first_id"))


@query("cap_per_sample", D.sql(f"SELECT cell_id, cell_line FROM cells QUALIFY row_number() OVER (PARTITION BY cell_line ORDER BY {_key('cell_id')}, cell_id) <= 20"))
def cap_per_sample(spark, sf_dir):
    return S.cap_per_sample(D.cells(spark, sf_dir).select("cell_id", "cell_line"), ["cell_line"], 20, SEED)


@query("cap_rows", D.sql(f"SELECT cell_id FROM cells ORDER BY {_key('cell_id')}, cell_id LIMIT 1000"))
def cap_rows(spark, sf_dir):
    return S.cap_rows(D.cells(spark, sf_dir).select("cell_id"), 1000, SEED)


@query("composition", D.sql("SELECT cell_line, " + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}" for s in S.SPLITS) + f", round(avg(dose_um), 6) AS mean_value FROM (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.8 THEN 'val' WHEN u < 0.9 THEN 'calib' ELSE 'test' END AS split FROM (SELECT *, {_unit('cell_id')} AS u FROM cells)) GROUP BY 1"))
def composition(spark, sf_dir):
    cells = D.cells(spark, sf_dir)
    return rounded(S.composition(cells, S.random_split(cells, FRACS, SEED), "dose_um"))


_INNER = f"SELECT cell_id, cell_line AS donor, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.8 THEN 'val' WHEN u < 0.9 THEN 'calib' ELSE 'test' END AS split FROM (SELECT cell_id, CASE WHEN cell_line < 12 THEN 0 ELSE cell_line END AS cell_line, {_unit('cell_id')} AS u FROM cells)"


@query("inner_lodo", D.sql("SELECT fold, role, count(*) AS n FROM (SELECT fold, CASE WHEN donor = fold THEN 'eval' WHEN split = 'train' THEN 'train' WHEN split = 'val' THEN 'monitor' END AS role FROM inner_rows, (SELECT donor AS fold FROM (SELECT donor, count(*) AS n, sum(count(*)) OVER () AS total FROM inner_rows WHERE split = 'train' GROUP BY 1) WHERE total - n >= 0.5 * total) WHERE split <> 'test') WHERE role IS NOT NULL GROUP BY ALL", inner_rows=_INNER))
def inner_lodo(spark, sf_dir):
    cells = D.cells(spark, sf_dir)
    rows = cells.select("cell_id", F.when(F.col("cell_line") < 12, 0).otherwise(F.col("cell_line")).alias("donor")).join(S.random_split(cells, FRACS, SEED), "cell_id")
    return S.inner_lodo(rows).groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("kfold", D.sql(f"SELECT chunk_id, fold_k, count(*) AS n FROM (SELECT chunk_id, (ntile(5) OVER (PARTITION BY chunk_id ORDER BY {_key('cell_id')}, cell_id) - 1)::INT AS fold_k FROM cells) GROUP BY ALL"))
def kfold(spark, sf_dir):
    return S.kfold(D.cells(spark, sf_dir), 5, SEED, ["chunk_id"]).groupBy("chunk_id", "fold_k").agg(F.count("*").alias("n"))

"""Hard negatives by tiled products of integer matrices.

Vectors become integers (floor of `scale` times each component), so that scores, their inner products, are exact. Anchors (rows whose vec_id is divisible by
`every`) and all rows are dealt to tiles, and each pair of tiles is one task's product. It is formed by Strassen's recursion on 64-bit integers: seven products
of half-size blocks instead of eight, odd sides filled up with zeros, all sums exact; small blocks are multiplied directly.

A first pass compares anchors with rows of their own label and keeps a heap of the `positives` best for each anchor; a second compares them with all
rows, and keeps, for each anchor and positive, a heap of the `negatives` best of other labels inside the window
low_percent * positive <= 100 * negative <= 100 * positive. Heaps of a tile are rows; they merge by the best few of each anchor, cut down before the shuffle and
after it, so no task ever holds an anchor's scores of more than one tile.

Higher scores come first, ties by the smaller vec_id, null ids last. Nulls: rows with a null label, a null vector, or a null or non-finite component take no part; an empty vector has the score 0 with empty ones. Only vectors
of one length are compared. A null vec_id is no anchor, but may be a positive or a negative (a null id). Rows that share a vec_id are rows of their own, and an anchor for each. An empty table gives none; extra columns are ignored.
Components beyond 64-bit integers, and scores beyond them, stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .staging import Staging

ANCHORS, ROWS, LEAF = 512, 4096, 32  # anchors and rows of a tile, about; the least side that is halved
NULL_ID = np.iinfo(np.int64).max


def leaf_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers: in doubles where all sums stay below 2^53, so that they are exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2^64, by Strassen's recursion."""
    n, k, m = *a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return leaf_product(a, b)
    if n % 2 or k % 2 or m % 2:
        a, b = np.pad(a, ((0, n % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, m % 2)))
        return strassen(a, b, leaf)[:n, :m]
    h, i, j = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1, p2, p3 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    p4, p5 = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    p6, p7 = strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    return np.block([[p1 + p4 - p5 + p7, p3 + p5], [p2 + p4, p1 - p2 + p3 + p6]])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b; an error where one leaves 64 bits."""
    if a.shape[1] and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] >= 2.0**62:
        exact = a.astype(object) @ b.T.astype(object)
        if exact.size and (exact.max() >= 1 << 63 or exact.min() <= -(1 << 63)):
            raise OverflowError("a score leaves 64 bits")
        return exact.astype(np.int64)
    return strassen(a, b.T)


def integer_rows(rows: DataFrame, scale: int, relabel_every: int, labels: int) -> DataFrame:
    """uid, vec_id, label, q: the rows that take part."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    valid = rows.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    q = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return valid.select(F.monotonically_increasing_id().alias("uid"), "vec_id", label.alias("label"), q.alias("q"), F.size("embedding").alias("length"))


def tiles(anchors: DataFrame, rows: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """Anchors and rows together, in groups (keys, anchor tile, row tile) of about `ANCHORS` and `ROWS`: a stated query set against all rows, in blocks."""
    many = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    counts = many(anchors, ANCHORS, "a_tiles").join(many(rows, ROWS, "r_tiles"), keys)
    tile = lambda c: F.pmod(F.xxhash64("uid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = [*keys, "at", "rt", "anchor", "uid", "vec_id", "label", "q", *extra]
    a = anchors.join(counts, keys).withColumn("at", tile("a_tiles")).withColumn("rt", every("r_tiles")).withColumn("anchor", F.lit(True)).select(*dict.fromkeys(columns))
    r = rows.join(counts, keys).withColumn("rt", tile("r_tiles")).withColumn("at", every("a_tiles")).withColumn("anchor", F.lit(False))
    r = r.withColumns({c: F.lit(None).cast(anchors.schema[c].dataType) for c in extra}).select(*dict.fromkeys(columns))
    return a.unionByName(r).groupBy(*keys, "at", "rt")


def sides(t: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, rows (by id, null ids last), the ids of the rows and both sides' integers."""
    is_anchor = t.column("anchor").to_numpy()
    a, r = t.filter(pa.array(is_anchor)), t.filter(pa.array(~is_anchor))
    ids = r.column("vec_id").fill_null(NULL_ID).to_numpy()
    order = np.lexsort((r.column("uid").to_numpy(), ids, r.column("vec_id").is_null().to_numpy(zero_copy_only=False)))
    r = r.take(pa.array(order))
    matrix = lambda x: x.column("q").combine_chunks().flatten().to_numpy().reshape(x.num_rows, -1) if x.num_rows else np.zeros((0, 0), np.int64)
    return a, r, ids[order], matrix(a), matrix(r)


def best_of(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """Merges heaps: the n best rows of each key, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("uid"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def positive_heaps(anchors: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """a_uid, uid, vec_id, score of each anchor's best rows of its label."""

    def run(t: pa.Table) -> pa.Table:
        a, r, _, x, y = sides(t)
        out = []
        if a.num_rows and r.num_rows:
            s = scores(x, y) if x.shape[1] else np.zeros((a.num_rows, r.num_rows), np.int64)
            uid = r.column("uid").to_numpy()
            for i, own in enumerate(a.column("uid").to_numpy()):
                best = np.argsort(-s[i], kind="stable")[: n + 1]
                best = best[uid[best] != own][:n]
                out.append((np.full(len(best), own), best, s[i, best]))
        own, at, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"a_uid": own, "uid": r.column("uid").take(pa.array(at)), "vec_id": r.column("vec_id").take(pa.array(at)), "score": score})

    found = tiles(anchors, rows, ["length", "label"], []).applyInArrow(run, "a_uid long, uid long, vec_id long, score long")
    return best_of(found, ["a_uid"], n)


def window_heaps(anchors: DataFrame, rows: DataFrame, n: int, low_percent: int) -> DataFrame:
    """a_uid, p_uid, uid, vec_id, score of the best rows of other labels in each positive's window. anchors: also windows, of p_uid and score."""

    def run(t: pa.Table) -> pa.Table:
        a, r, _, x, y = sides(t)
        out = []
        if a.num_rows and r.num_rows:
            s = scores(x, y) if x.shape[1] else np.zeros((a.num_rows, r.num_rows), np.int64)
            labels = r.column("label").to_numpy()
            for i, (own, label, windows) in enumerate(zip(a.column("uid").to_pylist(), a.column("label").to_pylist(), a.column("windows").to_pylist())):
                other = np.flatnonzero(labels != label)
                order = other[np.argsort(-s[i, other], kind="stable")]
                falling = -s[i, order]
                for w in windows:
                    first = int(np.searchsorted(falling, -w["score"], "left"))
                    best = order[first : first + n]
                    best = best[s[i, best] >= -(-low_percent * w["score"] // 100)]
                    out.append((np.full(len(best), own), np.full(len(best), w["p_uid"]), best, s[i, best]))
        own, positive, at, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return pa.table({"a_uid": own, "p_uid": positive, "uid": r.column("uid").take(pa.array(at)), "vec_id": r.column("vec_id").take(pa.array(at)), "score": score})

    found = tiles(anchors, rows, ["length"], ["windows"]).applyInArrow(run, "a_uid long, p_uid long, uid long, vec_id long, score long")
    return best_of(found, ["a_uid", "p_uid"], n)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low_percent: int = 80, scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    staging = Staging(rows.sparkSession, "hard-negatives")
    known = staging.write(integer_rows(rows, scale, relabel_every, labels), "rows")
    anchors = known.filter(F.col("vec_id") % every == 0)
    found = staging.write(positive_heaps(anchors, known, positives).select("a_uid", F.col("uid").alias("p_uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = found.groupBy("a_uid").agg(F.collect_list(F.struct("p_uid", F.col("positive_score").alias("score"))).alias("windows"))  # `positives` at most
    held = window_heaps(anchors.join(windows.withColumnRenamed("a_uid", "uid"), "uid"), known, negatives, low_percent)
    named = held.join(found, ["a_uid", "p_uid"]).join(anchors.select(F.col("uid").alias("a_uid"), F.col("vec_id").alias("anchor_id")), "a_uid")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid AS a_uid, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same, list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.q) = len(b.q)),
p AS (SELECT a_uid, uid AS p_uid, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND uid <> a_uid
  QUALIFY row_number() OVER (PARTITION BY a_uid ORDER BY score DESC, vec_id NULLS LAST, uid) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY s.a_uid, p_uid ORDER BY score DESC, vec_id NULLS LAST, uid)::INTEGER AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM s JOIN p ON p.a_uid = s.a_uid AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""

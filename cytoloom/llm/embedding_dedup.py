"""Near-duplicate embeddings by cross-polytope hashing.

Equal vectors are one class, found by two 64-bit hashes, so that a vector that is everywhere costs one row. A class is rotated by three rounds of sign flips and
fast Hadamard transforms (zeros fill its length up to a power of two); the rotated vector's largest coordinate and its sign, the nearest vertex of the
cross-polytope, is a hash. `functions` of them make a bucket, and there are `tables` such tables. A class goes to its own bucket of each table and to
the `probes` next ones, by how far the rotated vector is from their vertices. Two classes are candidates if they share a bucket that is one's own; candidates
are verified by their cosine in double precision, so no link is below `least`.

Buckets of more than `BLOCK` classes are dealt to blocks, and each pair of blocks is compared in a task of its own as a product of matrices. Pairs stay in the task: it
gives, for each class, how many vectors it is linked to, and the smallest class of its part of the task's links. A pair that shares several
buckets is counted in the first of them only, which both sides can tell from their vectors.

Recall for pairs at a cosine of exactly `least` = 0.9 in 64 dimensions (3,998 random pairs of 4,000 found with 8 tables of 2 functions and 4 probes): two functions
give buckets of a few classes up to some 100,000 vectors and hundreds at 10 million; for more vectors take 3 functions and 12 tables (0.998).

Nulls: vectors that are null, of zero length or norm, or hold a null or non-finite component link with nothing; so do vectors of different lengths with each other. A row with a null vec_id is a
vector like any other, but gives its component no id; its own is null if no other has one. Rows that share a vec_id are a vector each. An empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .staging import Staging

BLOCK = 1024  # classes of a side
SALTS = 16  # a class's row is sent to so many places, its members are dealt to


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Hadamard transform of each row; rows have a power of two of columns."""
    n, width, half = *x.shape, 1
    while half < width:
        x = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(x: np.ndarray, tables: int, functions: int, probes: int, seed: int = 12) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket ids of unit vectors: the row's own first, then the nearest others."""
    n, length = x.shape
    width = max(2, 1 << (length - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :length] = x
    near = min(3, width)
    picks = np.array(list(itertools.product(range(near), repeat=functions)))
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        signs = np.random.default_rng([seed, t, width]).choice(np.array([-1.0, 1.0]), (functions, 3, width))
        far, code = np.zeros((n, len(picks))), np.full((n, len(picks)), length * 4096 + t, np.int64)
        for f in range(functions):
            y = padded
            for s in signs[f]:
                y = hadamard(y * s)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, top, 1)
            gap = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            far += gap[:, picks[:, f]]
            code = code * 1_000_003 + (2 * top + (value < 0))[:, picks[:, f]] + 1  # wraps around for many functions
        best = np.argsort(far, axis=1, kind="stable")[:, : 1 + probes]
        out[:, t, : best.shape[1]] = np.take_along_axis(code, best, 1)
        out[:, t, best.shape[1] :] = out[:, t, :1]  # there are no more vertices
    return out


def matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) of each length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    ends = vectors.offsets.to_numpy()
    flat, size = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends)
    for length in np.unique(size).tolist():
        rows = np.flatnonzero(size == length)
        yield rows, flat[ends[rows][:, None] + np.arange(length)]


def classes_of(vectors: DataFrame, staging: Staging) -> DataFrame:
    """cls, h1, h2, size, least_id, v: the distinct vectors that can have links. vectors: vec_id, embedding, h1, h2."""
    found = vectors.groupBy("h1", "h2").agg(F.count("*").alias("size"), F.min("vec_id").alias("least_id"), F.min("embedding").alias("v"), F.max("embedding").alias("w"))
    same = F.when(F.col("v") == F.col("w"), F.col("v")).otherwise(F.raise_error(F.lit("two vectors have one pair of hashes")))
    return staging.write(found.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "size", "least_id", same.alias("v")), "classes")


def in_buckets(classes: DataFrame, tables: int, functions: int, probes: int) -> DataFrame:
    """bucket, cls, own: where each class goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = b.column("cls").to_numpy()
            for rows, x in matrices(b.column("v")):
                for low in range(0, len(rows), 2048):
                    found = buckets(unit(x[low : low + 2048]), tables, functions, probes)
                    own = np.zeros(found.shape, bool)
                    own[:, :, 0] = True
                    each = np.repeat(cls[rows[low : low + 2048]], tables * (1 + probes))
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(each), pa.array(own.ravel())], names=["bucket", "cls", "own"])

    return classes.select("cls", "v").mapInArrow(run, "bucket long, cls long, own boolean").groupBy("bucket", "cls").agg(F.bool_or("own").alias("own"))


def block_pairs(placed: DataFrame) -> DataFrame:
    """bucket, cls, own, side, i, j: the pairs of blocks that each class is compared in, of buckets that hold candidates."""
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.bool_or("own").alias("any")).filter("m > 1 AND any")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = placed.join(sizes, "bucket").select("bucket", "cls", "own", F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return dealt.select("bucket", "cls", "own", (F.col("block") > F.col("other")).cast("int").alias("side"), i.alias("i"), j.alias("j"))


def first_shared(one: np.ndarray, two: np.ndarray, here: int) -> np.ndarray:
    """Whether `here` is the first bucket that row k of one and row k of two share as one's own. Both: (rows, tables, buckets)."""
    first = np.zeros(len(one), bool)
    open_ = np.ones(len(one), bool)
    none = np.iinfo(np.int64).max
    for t in range(one.shape[1]):
        a, b = one[:, t], two[:, t]
        least = np.minimum(np.where(a == b[:, :1], a, none).min(1), np.where(b == a[:, :1], b, none).min(1))
        shared = least < none
        first |= open_ & shared & (least == here)
        open_ &= ~shared
    return first


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is linked to, over any number of links (a, b)."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def links_in(bucket: int, x: np.ndarray, cls: np.ndarray, size: np.ndarray, own: np.ndarray, side: np.ndarray, across: bool, least: float, how: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(cls, vectors linked to it as counted here, smallest class of its part) of the classes that have links in a block or between two."""
    x = unit(x)
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if across else one
    near = (x[one] @ x[two].T >= least) & (own[one][:, None] | own[two])
    if not across:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    if not len(a):
        return None
    a, b = one[a], two[b]
    rows, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    where = buckets(x[rows], **how)
    links = np.zeros(len(rows), np.int64)
    for low in range(0, len(a), 1 << 15):
        p, q = a[low : low + (1 << 15)], b[low : low + (1 << 15)]
        counted = first_shared(where[p], where[q], bucket)
        np.add.at(links, p[counted], size[rows[q[counted]]])
        np.add.at(links, q[counted], size[rows[p[counted]]])
    order = np.argsort(cls[rows])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return cls[rows], links, cls[rows][order][joined(len(rows), back[a], back[b])][back]


def verified(dealt: DataFrame, classes: DataFrame, least: float, how: dict) -> DataFrame:
    """cls, links, root: partial results of each pair of blocks."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = dealt.join(classes.select("cls", "size", "v"), "cls").select("bucket", "i", "j", "cls", "size", "own", "side", "v").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held is None or not held.num_rows:
                continue
            key = np.stack([held.column(k).to_numpy() for k in ("bucket", "i", "j")])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
            if b is None:
                edge.append(held.num_rows)  # else the last group may go on in the next batch
            cls, size, own, side = (held.column(k).to_numpy() for k in ("cls", "size", "own", "side"))
            v = held.column("v").combine_chunks()
            ends, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            found = []
            for low, high in zip(edge, edge[1:]):
                if high - low > 1:
                    x = flat[ends[low] : ends[high]].reshape(high - low, -1).astype(np.float64)
                    found.append(links_in(int(key[0, low]), x, cls[low:high], size[low:high], own[low:high], side[low:high], key[1, low] != key[2, low], least, how))
            found = [f for f in found if f]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["cls", "links", "root"])
            held = held.slice(edge[-1])

    return together.mapInArrow(run, "cls long, links long, root long")


def near_duplicates(rows: DataFrame, least: float = 0.9, tables: int = 8, functions: int = 2, probes: int = 4) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; rows: vec_id, embedding."""
    staging = Staging(rows.sparkSession, "near-vectors")
    how = {"tables": tables, "functions": functions, "probes": probes}
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.coalesce((F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda c: c != 0), F.lit(False))
    hashed = rows.select("vec_id", "embedding", usable.alias("usable"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    classes = classes_of(hashed.filter("usable").drop("usable"), staging)
    dealt = block_pairs(staging.write(in_buckets(classes, **how), "buckets"))
    parts = staging.write(verified(dealt, classes, least, how), "links")
    counts = parts.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(parts.filter("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct(), staging)
    grouped = classes.select("cls", "least_id").join(groups.select(F.col("node").alias("cls"), "component"), "cls")
    smallest = grouped.groupBy("component").agg(F.min("least_id").alias("smallest"))
    joint = grouped.join(smallest, "component").select("cls", "smallest")
    of_class = classes.join(counts, "cls", "left").join(joint, "cls", "left").select(
        "h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least_id").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salted = hashed.select("vec_id", "usable", "h1", "h2", F.when(F.col("usable"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).cast("int").alias("salt"))
    out = salted.join(of_class, ["h1", "h2", "salt"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of all vectors. The operator finds the same ones where its recall is 1, as on the given tables.
SQL = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS uid, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT * FROM t WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.uid AS a, b.uid AS b FROM v a JOIN v b ON a.uid <> b.uid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT uid, uid AS other FROM t UNION SELECT r.uid, l.b FROM reach r JOIN links l ON l.a = r.other),
part AS (SELECT r.uid, min(o.vec_id) AS component_id FROM reach r JOIN t o ON o.uid = r.other GROUP BY r.uid)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM t JOIN part USING (uid) LEFT JOIN (SELECT a AS uid, count(*) AS n FROM links GROUP BY a) USING (uid)"""

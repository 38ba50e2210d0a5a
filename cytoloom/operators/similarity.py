"""Nearest neighbours and distances: exact joins on shared bits, distances to fitted distributions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from ..functions.columns import dot, quantile

#: distances that a task holds at once
CELLS = 1 << 20
#: numbers that a side of a pair of blocks holds, where a key has many blocks
NUMBERS = 1 << 19


def hashed_fingerprint(compound: Column, n: int = 48, size: int = 2048) -> Column:
    """Sorted on-bits: n sha256 hashes of "compound|i", first four bytes modulo size; none for an empty compound."""
    bit = lambda i: (F.conv(F.substring(F.sha2(F.concat_ws("|", compound, i.cast("string")), 256), 1, 8), 16, 10).cast("long") % size).cast("int")
    bits = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), bit)))
    return F.when(compound.isNull() | (compound == ""), F.array().cast("array<int>")).otherwise(bits)


def encode_once(df: DataFrame, key: str, out: str = "bits") -> DataFrame:
    """Fingerprints of distinct compounds, joined back."""
    distinct = df.select(key).distinct().withColumn(out, hashed_fingerprint(F.col(key)))
    return df.join(distinct, key)


def _blocks(rows: Column, block: int, vectors: bool) -> Column:
    """The blocks of a side. Of vectors, blocks beyond the eighth make all larger, up to `NUMBERS`, as a row is sent to every block of the other side."""
    blocks = F.greatest(F.lit(1), F.ceil(rows / block))
    return F.least(blocks, F.greatest(F.lit(8), F.ceil(rows * F.col("__size") / NUMBERS))) if vectors else blocks


def _in_blocks(queries: DataFrame, refs: DataFrame, by: list[str], block: int, k: int | None = None) -> DataFrame:
    """All pairs of queries (query_id) and refs (ref_id) of a key, met in blocks of about `block` rows on either side, so that a hot key is many tasks and nothing is broadcast.

    With k, of each pair of blocks the k nearest refs of every query only, with their distance: by, query_id, ref_id, distance. Queries have then a complete vector v, refs ref_v, and
    vectors of other sizes do not meet; where queries have `rings`, a list, they meet refs whose `ring` is in it.
    """
    if k is not None:
        by = [*by, "__size"]
        queries, refs = queries.withColumn("__size", F.size("v")), refs.withColumn("__size", F.size("ref_v"))
    n = lambda d: _blocks(F.count("*"), block, k is not None).cast("int").alias(d)
    sizes = queries.groupBy(*by).agg(n("nq")).join(refs.groupBy(*by).agg(n("nr")), by)
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int")
    q = queries.join(sizes, by).withColumn("bq", spread("query_id", "nq")).withColumn("br", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).drop("nq", "nr")
    r = refs.join(sizes, by).withColumn("br", spread("ref_id", "nr")).withColumn("bq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).drop("nq", "nr")
    keys = [*by, "bq", "br"]
    if k is None:
        return q.join(r, keys).drop("bq", "br")
    out = StructType([*(queries.schema[c] for c in by[:-1]), queries.schema["query_id"], refs.schema["ref_id"], StructField("distance", DoubleType())])
    r = r.withColumnsRenamed({c: f"__{c}" for c in keys})  # both sides may come from one table
    return q.groupBy(*keys).cogroup(r.groupBy(*(f"__{c}" for c in keys))).applyInArrow(lambda left, right: _block_nearest(left, right, by[:-1], k), out)


def _matrix(t: pa.Table, c: str) -> np.ndarray:
    values = np.asarray(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64)
    return values.reshape(t.num_rows, len(values) // t.num_rows)


def _block_nearest(left: pa.Table, right: pa.Table, by: list[str], k: int) -> pa.Table:
    """by, query_id, ref_id, distance of the k refs of the block that are nearest to each query, the least ref_id first on ties."""
    order = pc.sort_indices(right.column("ref_id"))
    right = right.take(order)  # a ref's place is its rank on ties
    i, j, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if left.num_rows and right.num_rows:
        x, y = _matrix(left, "v"), _matrix(right, "ref_v")
        if "rings" in left.column_names:
            lists = left.column("rings").combine_chunks()
            owner, wanted, ring = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy(), right.column("ring").to_numpy()
            parts = []
            for u in np.unique(ring):
                own, there = np.unique(owner[wanted == u]), np.flatnonzero(ring == u)
                a, b, e = _least(x[own], y[there], k)
                parts.append((own[a], there[b], e))
            i, j, d = _first(*(np.concatenate(p) for p in zip(*parts)), k)
        else:
            i, j, d = _least(x, y, k)
    one, two = left.take(pa.array(i)), right.take(pa.array(j))
    return pa.table({**{c: one.column(c) for c in by}, "query_id": one.column("query_id"), "ref_id": two.column("ref_id"), "distance": pa.array(d)})


def _first(i: np.ndarray, j: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k entries of each i with the least (d, j)."""
    o = np.lexsort((j, d, i))
    i, j, d = i[o], j[o], d[o]
    at = np.arange(len(i))
    begins = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], at, 0)) if len(i) else at
    keep = at - begins < k
    return i[keep], j[keep], d[keep]


def _least(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k rows of y that are nearest to each of x, the first on ties.

    A product of matrices gives the squares but for its rounding, which is bounded; the rows that this leaves are measured anew, summed in the order of the dimensions.
    """
    n, dims = y.shape
    width = max(1, min(16, n // (8 * k)))
    with np.errstate(over="ignore", invalid="ignore"):
        centre = y.sum(0) / max(1, n)
        a, b = x - centre, y - centre
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        rounding = 8 * (dims + 8) * np.finfo(np.float64).eps
        own_room, room = rounding * aa + np.finfo(np.float64).tiny, rounding * bb
        low, product = bb - room, np.ascontiguousarray(-2 * b.T)
        bounded = n > k and len(x) > 0 and np.isfinite(4 * (aa.max() + bb.max()))
    rows, columns = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    if not bounded:
        return _least_of_all(rows, columns, np.arange(len(x)), k)
    parts = []
    step = max(1, CELLS // n)
    for s in range(0, len(x), step):
        least = a[s : s + step] @ product
        least += low  # a lower bound, but for the query's own square and room
        m = len(least)
        groups = least[:, : n // width * width].reshape(m, width, -1).min(1)
        kth = np.partition(groups, k - 1, axis=1)[:, k - 1]  # k groups have a row within it
        i, j = np.divmod(np.flatnonzero(least <= kth[:, None]), n)
        limit = kth + 2 * np.maximum.reduceat(room[j], np.searchsorted(i, np.arange(m))) + 2 * own_room[s : s + step]
        i, j = np.divmod(np.flatnonzero(least <= limit[:, None]), n)
        many = np.bincount(i, minlength=m) > n // 8  # near copies: cheaper to measure without picking
        if many.any():
            parts.append(_least_of_all(rows, columns, np.flatnonzero(many) + s, k))
            few = ~many[i]
            i, j = i[few], j[few]
        i += s
        d = np.zeros(len(i))
        for own, other in zip(rows, columns):
            gap = own[i] - other[j]
            d += gap * gap
        parts.append(_first(i, j, np.sqrt(d), k))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _least_of_all(rows: np.ndarray, columns: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `_least` gives for the queries `of`, with every distance measured in the order of the dimensions. rows, columns: a line a dimension."""
    n = columns.shape[1]
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    step = max(1, CELLS // 16 // max(1, n))
    for s in range(0, len(of), step):
        these = of[s : s + step]
        d, gap = np.zeros((len(these), n)), np.empty((len(these), n))
        with np.errstate(over="ignore"):
            for own, other in zip(rows[:, these], columns):
                np.subtract(own[:, None], other, out=gap)
                gap *= gap
                d += gap
        np.sqrt(d, out=d)
        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if n > k else np.inf
        i, j = np.nonzero(d <= kth)
        i, j, e = _first(i, j, d[i, j], k)
        parts.append((these[i], j, e))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _complete(v: str) -> Column:
    """Whether v is an array of numbers without gaps."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _numbers(df: DataFrame, v: str) -> Column:
    """v as doubles; floats stay, as tasks make them doubles, so that a shuffle moves half the bytes."""
    return F.col(v) if df.schema[v].dataType.elementType == FloatType() else F.col(v).cast("array<double>").alias(v)


def _first_copies(refs: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k least ref_ids of each distinct vector of a key: no other copy can be among the k nearest of any query."""
    # the sort compares hashes before vectors
    return refs.withColumn("__r", F.row_number().over(Window.partitionBy(F.xxhash64("ref_v"), *by, "ref_v").orderBy("ref_id"))).filter(F.col("__r") <= k).drop("__r")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    # the limit on the rank is taken in each partition before rows of a query meet
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref_id"))).filter(F.col("r") <= k).drop("r")


def jaccard_knn(queries: DataFrame, refs: DataFrame, k: int, block: int = 512) -> DataFrame:
    """query_id, ref_id, distance of the k nearest refs by Jaccard distance of on-bits, by ref_id on ties. Of two empty sets the distance is 0.

    queries: query_id, bits; refs: ref_id, bits; both hold distinct fingerprints. Fingerprints of some dozens of bits meet nearly all others in some
    bit, so no index would prune: the queries are held against all refs, in blocks, and each block keeps its k best of a query.
    """
    pairs = _in_blocks(queries.select("query_id", "bits").withColumn("all", F.lit(0)), refs.select("ref_id", F.col("bits").alias("other")).withColumn("all", F.lit(0)), ["all"], block)
    both = F.size(F.array_intersect("bits", "other"))
    union = F.size("bits") + F.size("other") - both
    met = pairs.select("query_id", "ref_id", both.alias("both"), union.alias("union"))
    return _nearest(met.select("query_id", "ref_id", F.when(F.col("union") == 0, 0.0).otherwise(1 - F.col("both") / F.nullif(F.col("union"), F.lit(0))).alias("distance")), k)


def euclidean_knn(queries: DataFrame, refs: DataFrame, k: int, by: list[str], block: int = 2048) -> DataFrame:
    """by, query_id, ref_id, distance of the k nearest refs of the same key, by ref_id on ties. queries: by, query_id, v; refs: by, ref_id, ref_v.

    All queries meet all distinct refs of a key, as products of matrices in blocks, and a block keeps the k best of a query. Rows with a null vector, or null or non-finite components, take no part.
    """
    here = queries.filter(_complete("v")).select(*by, "query_id", _numbers(queries, "v"))
    there = _first_copies(refs.filter(_complete("ref_v")).select(*by, "ref_id", _numbers(refs, "ref_v")), by, k)
    return _nearest(_in_blocks(here, there, by, block, k), k)


def fit_ood(train: DataFrame, col: str, ridge: float = 1e-3, q: float = 0.99, approx: bool = False) -> dict:
    """Mean, inverse of covariance (n - 1) plus ridge, and the q-quantile of squared distances. The matrix has the features' size, whatever the rows do.

    Sums of products are one aggregate over the pairs of dimensions.
    """
    width = F.size(col)
    upper = F.flatten(F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(F.sequence(i, width - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.get(col, i).alias("x"), F.get(col, j).alias("y")))))
    pairs = train.select(F.explode(upper).alias("e")).select("e.*").groupBy("i", "j").agg(F.avg("x").alias("mean"), F.covar_samp("x", "y").alias("c")).toPandas()
    d = int(pairs.j.max()) + 1
    covariance, mean = np.zeros((d, d)), np.zeros(d)
    i, j = pairs.i.to_numpy(), pairs.j.to_numpy()
    covariance[i, j] = covariance[j, i] = pairs.c.to_numpy()
    mean[i] = pairs["mean"].to_numpy()
    precision = np.linalg.inv(covariance + ridge * np.eye(d))
    model = {"mean": mean.tolist(), "precision": precision.tolist()}
    model["threshold"] = score_ood(train, col, model | {"threshold": 0.0}).agg(quantile("d2", q, approx).alias("t")).first()["t"]
    return model


def score_ood(df: DataFrame, col: str, model: dict) -> DataFrame:
    """df with d2 (squared Mahalanobis distance) and in_dist."""
    mean, precision = F.array(*map(F.lit, model["mean"])), F.array(*(F.array(*map(F.lit, row)) for row in model["precision"]))
    centred = F.zip_with(F.col(col), mean, lambda x, m: x - m)
    lined = df.withColumn("__c", centred)
    quad = dot(F.transform(precision, lambda row: F.aggregate(F.zip_with(row, F.col("__c"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)), F.col("__c"))
    return lined.withColumn("d2", quad).drop("__c").withColumn("in_dist", F.col("d2") <= model["threshold"])


def diagonal_ood(train: DataFrame, df: DataFrame, keys: list[str], ridge: float = 1e-3, q: float = 0.99) -> DataFrame:
    """keys, d2, in_dist with a diagonal covariance, in long form: both have keys, dim, value."""
    stats = train.groupBy("dim").agg(F.avg("value").alias("mu"), (F.var_samp("value") + ridge).alias("var"))
    dist = lambda d: d.join(F.broadcast(stats), "dim").groupBy(*keys).agg(F.sum(F.pow(F.col("value") - F.col("mu"), F.lit(2.0)) / F.col("var")).alias("d2"))
    limit = dist(train).agg(F.percentile("d2", F.lit(q)).alias("t"))
    return dist(df).crossJoin(F.broadcast(limit)).select(*keys, "d2", (F.col("d2") <= F.col("t")).alias("in_dist"))



"""Nearest neighbours by Euclidean distance beyond all pairs: exact with pruning by pivots, approximate with hash tables whose recall is measured."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..streaming.run import staged
from .similarity import _complete, _first_copies, _in_blocks, _nearest

#: relative room for rounding in a bound, so that ties are never pruned
SLACK = 1e-9


def _distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _pivots(refs: DataFrame, by: list[str], pivots: int) -> DataFrame:
    """by, pivots: the refs of a key with the least hashes, at most `pivots` of them; the k least of each partition meet, so no group is gathered."""
    least = F.row_number().over(_window(by).orderBy("h", "ref_id"))
    local = refs.select(*by, "ref_id", "ref_v", F.xxhash64("ref_id", F.lit(17)).alias("h"))
    return local.withColumn("r", least).filter(F.col("r") <= pivots).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("r").alias("cell"), F.col("ref_v").alias("p")))).alias("pivots"))


def _window(by: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def pivot_knn(queries: DataFrame, refs: DataFrame, k: int, by: list[str], pivots: int = 24, rings: int = 4, block: int = 2048) -> DataFrame:
    """by, query_id, ref_id, distance of the k nearest refs of the same key, by ref_id on ties: the rows of `euclidean_knn`, from fewer distances.

    queries: by, query_id, v; refs: by, ref_id, ref_v. Each ref falls to its nearest pivot and to one of `rings` rings around it. The rings' counts and
    radii bound a query's k-th distance from above; by the triangle inequality a ring whose nearest edge lies beyond that bound holds no neighbour, so the
    query does not meet it. A query goes to a cell once, with the rings that it wants there; a cell meets its queries in blocks, as products of matrices, and gives the k best of a query. Rows with a null vector, or null or non-finite
    components, take no part; a null key has no neighbours; a key of fewer than k refs gives them all.
    """
    here = queries.filter(_complete("v")).select(*by, "query_id", F.col("v").cast("array<double>").alias("v"))
    there = _first_copies(refs.filter(_complete("ref_v")).select(*by, "ref_id", F.col("ref_v").cast("array<double>").alias("ref_v")), by, k)
    marks = staged(_pivots(there, by, pivots), "pivots")
    gaps = F.transform("pivots", lambda p: F.struct(_distance("ref_v", p["p"]).alias("d"), p["cell"].alias("cell")))
    placed = staged(there.join(marks, by).withColumn("near", F.array_min(gaps)).select(*by, "ref_id", "ref_v", "near.d", "near.cell"), "placed")
    radius = placed.groupBy(*by, "cell").agg(F.max("d").alias("radius"))
    ring = F.when(F.col("radius") > 0, F.least(F.floor(F.col("d") * rings / F.col("radius")), F.lit(rings - 1))).otherwise(0).cast("int")
    ringed = staged(placed.join(radius, [*by, "cell"]).withColumn("ring", ring).drop("radius"), "ringed")
    edges = ringed.groupBy(*by, "cell", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n"))
    # a row a key, of at most pivots times rings entries
    shape = edges.groupBy(*by).agg(F.collect_list(F.struct("cell", "ring", "lo", "hi", "n")).alias("edges"))

    to_pivot = F.transform("pivots", lambda p: _distance("v", p["p"]))
    seen = here.join(marks, by).withColumn("to_pivot", to_pivot).drop("pivots").join(shape, by)
    at = lambda e: F.element_at("to_pivot", e["cell"])
    lower = lambda e: F.greatest(at(e) - e["hi"], e["lo"] - at(e), F.lit(0.0))
    by_reach = F.array_sort(F.transform("edges", lambda e: F.struct((at(e) + e["hi"]).alias("reach"), e["n"].alias("n"))))
    # the least reach within which k refs lie for sure; none if the key has fewer
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("bound"))
    step = lambda s, e: F.struct((s["n"] + e["n"]).alias("n"), F.when((s["n"] < k) & (s["n"] + e["n"] >= k), e["reach"]).otherwise(s["bound"]).alias("bound"))
    bound = F.aggregate(by_reach, start, step)["bound"]
    # the room follows the size of the terms that are subtracted, not that of their difference
    wanted = F.filter("edges", lambda e: lower(e) <= F.col("bound") + SLACK * (at(e) + e["hi"] + F.least(F.col("bound"), at(e))))
    found = staged(seen.withColumn("bound", bound).select(*by, "query_id", "v", F.transform(wanted, lambda e: F.struct(e["cell"].alias("cell"), e["ring"].alias("ring"))).alias("wanted")), "routed")
    # a row a query and cell, not a row a ring
    cells = F.array_distinct(F.transform("wanted", lambda e: e["cell"]))
    routed = found.withColumn("cell", F.explode(cells)).withColumn("rings", F.transform(F.filter("wanted", lambda e: e["cell"] == F.col("cell")), lambda e: e["ring"])).drop("wanted")
    keys = [*by, "cell"]
    return _nearest(_in_blocks(routed, ringed.select(*keys, "ring", "ref_id", "ref_v"), keys, block, k).select(*by, "query_id", "ref_id", "distance"), k)


def hashed_knn(queries: DataFrame, refs: DataFrame, k: int, by: list[str], width: float, tables: int = 8, functions: int = 2, seed: int = 17, block: int = 2048) -> DataFrame:
    """by, query_id, ref_id, distance of the nearest refs among those that share a bucket of random projections (cells of `width`) in one of the tables.

    The approximate form: every distinct ref is indexed and every bucket is searched whole, in blocks, as products of matrices; a block gives the k best of a query. What is missed is stated by `recall`. A query may have fewer
    than k neighbours. Rows with a null vector, or null or non-finite components, take no part. The vectors of both sides have one size.
    """
    here = queries.filter(_complete("v")).select(*by, "query_id", F.col("v").cast("array<double>").alias("v"))
    there = staged(_first_copies(refs.filter(_complete("ref_v")).select(*by, "ref_id", F.col("ref_v").cast("array<double>").alias("ref_v")), by, k), "distinct")
    lsh = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", numHashTables=tables * functions, bucketLength=width, seed=seed)
    model = lsh.fit(there.select(array_to_vector("ref_v").alias("__v")))

    def hashed(df: DataFrame, v: str) -> DataFrame:
        h = model.transform(df.withColumn("__v", array_to_vector(v)))
        one = lambda i: vector_to_array(F.col("__h")[i])[0]
        keys = [F.struct(F.lit(t).alias("table"), F.xxhash64(*(one(t * functions + j) for j in range(functions))).alias("bucket")) for t in range(tables)]
        return h.withColumn("e", F.explode(F.array(*keys))).select(*df.columns, "e.table", "e.bucket")

    keys = [*by, "table", "bucket"]
    near = _in_blocks(staged(hashed(here, "v"), "query_buckets"), staged(hashed(there, "ref_v"), "ref_buckets"), keys, block, k)
    # a pair that meets in several tables is one
    return _nearest(near.select(*by, "query_id", "ref_id", "distance").dropDuplicates([*by, "query_id", "ref_id"]), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n true neighbours, n_found of them, recall (null without any)."""
    pairs = exact.select("query_id", "ref_id").join(found.select("query_id", "ref_id", F.lit(1).alias("hit")), ["query_id", "ref_id"], "left")
    g = pairs.agg(F.count("*").alias("n"), F.count("hit").alias("n_found"))
    return g.withColumn("recall", F.col("n_found") / F.nullif(F.col("n"), F.lit(0)))

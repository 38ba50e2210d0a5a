"""Donors' time courses: forward pairs, matched pairs, nearest references, shapes of trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def forward_pairs(points: DataFrame, key: str = "donor", t: str = "t", value: str = "value") -> DataFrame:
    """Ordered pairs of one donor's time points: donor, t_i, t_j, dt, v_i, v_j. Points are few a donor; make them so first."""
    a = points.select(key, F.col(t).alias("t_i"), F.col(value).alias("v_i"))
    b = points.select(key, F.col(t).alias("t_j"), F.col(value).alias("v_j"))
    return a.join(b, key).filter("t_j > t_i").withColumn("dt", F.col("t_j") - F.col("t_i"))


def timepoints(rows: DataFrame, least_points: int = 3, least_rows: int = 4) -> DataFrame:
    """donor, t, mean value, n of points with enough rows, of donors with enough points."""
    p = rows.groupBy("donor", "t").agg(F.avg("value").alias("value"), F.count("*").alias("n")).filter(F.col("n") >= least_rows)
    return p.withColumn("k", F.count("*").over(Window.partitionBy("donor"))).filter(F.col("k") >= least_points).drop("k")


def matched_pairs(rows: DataFrame, keys: list[str], batch: str, one, two) -> DataFrame:
    """keys, v_one, v_two, offset where each batch has exactly one row for the keys."""
    g = rows.filter(F.col(batch).isin(one, two)).groupBy(*keys).agg(
        F.count_if(F.col(batch) == one).alias("n1"), F.count_if(F.col(batch) == two).alias("n2"),
        F.max(F.when(F.col(batch) == one, F.col("value"))).alias("v_one"), F.max(F.when(F.col(batch) == two, F.col("value"))).alias("v_two"),
    )
    return g.filter("n1 = 1 AND n2 = 1").select(*keys, "v_one", "v_two", (F.col("v_two") - F.col("v_one")).alias("offset"))


def nearest(rows: DataFrame, refs: DataFrame, key: str = "donor") -> DataFrame:
    """Each row takes the value of the reference of its key that is nearest in time; the earliest id on ties.

    rows: key, row_id, t; refs: key, ref_id, t_ref, ref_value.
    """
    j = rows.join(refs, key)
    best = F.min_by(F.struct("ref_id", "t_ref", "ref_value"), F.struct(F.abs(F.col("t") - F.col("t_ref")), F.col("ref_id")))
    return j.groupBy(key, "row_id", "t").agg(best.alias("b")).select(key, "row_id", "t", "b.ref_id", "b.t_ref", "b.ref_value")


def trajectory_shape(points: DataFrame, by: str = "donor") -> DataFrame:
    """Quadratic fit of value on standardised time by power sums: curvature, its t statistic, R2, and a shape."""
    w = Window.partitionBy(by)
    z = points.withColumn("z", (F.col("t") - F.avg("t").over(w)) / F.nullif(F.stddev_pop("t").over(w), F.lit(0.0)))
    s = z.filter("z IS NOT NULL").groupBy(by).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.pow("z", F.lit(3.0))).alias("s3"), F.sum(F.pow("z", F.lit(4.0))).alias("s4"), F.sum("value").alias("y0"),
        F.sum(F.col("value") * F.col("z")).alias("y1"), F.sum(F.col("value") * F.col("z") * F.col("z")).alias("y2"), F.sum(F.col("value") * F.col("value")).alias("yy"),
    )
    # z has sum 0 and sum of squares n, so the normal equations are [[n,0,n],[0,n,s3],[n,s3,s4]]
    det = F.col("n") * (F.col("n") * F.col("s4") - F.col("s3") * F.col("s3")) - F.pow("n", F.lit(3.0))
    c = (F.col("n") * F.col("n") * F.col("y2") - F.col("n") * F.col("s3") * F.col("y1") - F.col("n") * F.col("n") * F.col("y0")) / F.nullif(det, F.lit(0.0))
    fit = s.withColumn("det", det).withColumn("c", c).filter("n >= 4 AND abs(det) > 1e-6")
    fit = fit.withColumn("b", (F.col("y1") - F.col("c") * F.col("s3")) / F.col("n")).withColumn("a", F.col("y0") / F.col("n") - F.col("c"))
    sse = F.greatest(F.col("yy") - F.col("a") * F.col("y0") - F.col("b") * F.col("y1") - F.col("c") * F.col("y2"), F.lit(0.0))
    sst = F.col("yy") - F.col("y0") * F.col("y0") / F.col("n")
    se = F.sqrt(sse / (F.col("n") - 3) * F.col("n") * F.col("n") / F.col("det"))
    out = fit.withColumn("t_curve", F.col("c") / F.nullif(se, F.lit(0.0))).withColumn("r2", 1 - sse / F.nullif(sst, F.lit(0.0)))
    shape = F.when(F.abs("t_curve") < 2, F.when(F.abs("b") > 2 * F.sqrt(sse / (F.col("n") - 3) / F.col("n")), "monotonic").otherwise("none")).when(F.col("c") < 0, "HUMP").otherwise("U")
    return out.select(by, "a", "b", "c", "t_curve", "r2", shape.alias("shape"))


def rises(steps: DataFrame, step: str = "day", value: str = "value", loss: str | None = None) -> DataFrame:
    """falls: whether the mean age (value) ends lower than it began; early, late: how much the mean identity loss rises over the first and the last third of the steps;
    late_rise: late is at least early. Without `loss` the value serves for both. A course with no more steps than a third has rises of 0. One row a step: few rows."""
    g = steps.groupBy(step).agg(F.avg(value).alias("m"), F.avg(loss or value).alias("p"))
    arr = F.array_sort(F.collect_list(F.struct(step, "m", "p")))
    one = g.agg(arr.alias("s")).withColumn("k", F.greatest(F.lit(1), F.floor(F.size("s") / 3)).cast("int"))
    at = lambda i, c: F.get("s", i)[c]
    last = F.size("s") - 1
    rise = lambda hi, lo: F.when(F.size("s") > F.col("k"), at(hi, "p") - at(lo, "p")).otherwise(0.0)
    out = one.select(F.when(F.size("s") > 1, at(last, "m") < at(F.lit(0), "m")).otherwise(F.lit(False)).alias("falls"), rise(last, last - F.col("k")).alias("late"), rise(F.col("k"), F.lit(0)).alias("early"))
    return out.withColumn("late_rise", F.col("late") >= F.col("early"))


def mean_vectors(expr: DataFrame, rows: DataFrame, key: str = "donor", least_points: int = 3, least_rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """(points, vectors) of populations: points are key, t, value, unsafe, n; vectors are key, t, gene, value, the mean over all rows of the point, zeros not stored.

    expr: cell_id, gene, value; rows: cell_id, key, t, value, unsafe. Times count as one where they agree in six places. Points of fewer rows than
    `least_rows`, keys of fewer points than `least_points`, and rows with a null key or time are left out. A point whose rows have no expression has no vector rows.
    """
    at = rows.filter(F.col(key).isNotNull() & F.col("t").isNotNull()).withColumn("t", F.round("t", 6) + 0.0)
    p = at.groupBy(key, "t").agg(F.avg("value").alias("value"), F.avg("unsafe").alias("unsafe"), F.count("*").alias("n")).filter(F.col("n") >= least_rows)
    enough = p.groupBy(key).agg(F.count("*").alias("k")).filter(F.col("k") >= least_points).select(key)
    points = p.join(enough, key, "left_semi")
    sums = expr.join(at.select("cell_id", key, "t"), "cell_id").groupBy(key, "t", "gene").agg(F.sum("value").alias("s"))
    return points, sums.join(points.select(key, "t", "n"), [key, "t"]).select(key, "t", "gene", (F.col("s") / F.col("n")).alias("value"))


def vector_pairs(points: DataFrame, vectors: DataFrame, key: str = "donor") -> DataFrame:
    """Forward pairs of a key's points with their vectors: key, t_i, t_j, dt, v_i, v_j, distance, cosine (null where a vector is zero).

    Inner products are sums over shared genes, so no vector is made dense; points are few a key, and pairs meet by key and gene.
    """
    pairs = forward_pairs(points.select(key, "t", "value"), key)
    norms = vectors.groupBy(key, "t").agg(F.sum(F.col("value") * F.col("value")).alias("q"))
    a = vectors.select(key, "gene", F.col("t").alias("t_i"), F.col("value").alias("a"))
    b = vectors.select(key, "gene", F.col("t").alias("t_j"), F.col("value").alias("b"))
    dots = a.join(b, [key, "gene"]).filter("t_j > t_i").groupBy(key, "t_i", "t_j").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))
    side = lambda t, q: norms.select(key, F.col("t").alias(t), F.col("q").alias(q))
    j = pairs.join(dots, [key, "t_i", "t_j"], "left").join(side("t_i", "qi"), [key, "t_i"], "left").join(side("t_j", "qj"), [key, "t_j"], "left")
    j = j.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ab", "qi", "qj")})
    distance = F.sqrt(F.greatest(F.col("qi") + F.col("qj") - 2 * F.col("ab"), F.lit(0.0)))
    return j.select(key, "t_i", "t_j", "dt", "v_i", "v_j", distance.alias("distance"), (F.col("ab") / F.nullif(F.sqrt(F.col("qi") * F.col("qj")), F.lit(0.0))).alias("cosine"))

"""Normalisation, scores, labels and age shifts over sparse long expression tables.

expr(cell_id, gene, value) leaves zeros out, so means and variances divide by the cells of the group, never by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import softmax

EPS_Z = 1e-8
EPS_SCALE = 1e-6


def normalize_cp10k(expr: DataFrame) -> DataFrame:
    """log1p of counts per ten thousand; zeros stay zeros, so the table stays sparse."""
    total = F.sum("value").over(Window.partitionBy("cell_id"))
    return expr.select("cell_id", "gene", F.log1p(F.col("value") / F.nullif(total, F.lit(0.0)) * 1e4).alias("value"))


def in_chunks(expr: DataFrame, cells: DataFrame) -> DataFrame:
    return expr.join(cells.select("cell_id", "chunk_id"), "cell_id")


def gene_stats(expr: DataFrame, cells: DataFrame, by: str = "chunk_id") -> DataFrame:
    """by, gene, mu, sigma (population) with zeros counted. cells has cell_id and `by`."""
    sums = expr.join(cells.select("cell_id", by), "cell_id").groupBy(by, "gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n = cells.groupBy(by).agg(F.count("*").alias("n"))
    mu = F.col("s") / F.col("n")
    return sums.join(F.broadcast(n), by).select(by, "gene", mu.alias("mu"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mu * mu, F.lit(0.0))).alias("sigma"), "n")


def fit_panel(expr: DataFrame, cells: DataFrame, n_top: int, forced: list[str] = [], excluded: list[str] = []) -> DataFrame:  # noqa: B006
    """pos, gene: forced genes first, then by variance (zeros counted), ties by name."""
    n = cells.agg(F.count("*").alias("n"))
    var = F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0))
    genes = expr.filter(~F.col("gene").isin(excluded)).groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(F.broadcast(n))
    rank = F.lit(len(forced))
    for i, g in reversed(list(enumerate(forced))):
        rank = F.when(F.col("gene") == g, i).otherwise(rank)
    # genes number in the ten thousands at most, whatever the cells do
    top = genes.select("gene", rank.alias("r"), F.round(var, 9).alias("var")).orderBy("r", F.desc("var"), "gene").limit(n_top)
    return top.select((F.row_number().over(Window.orderBy("r", F.desc("var"), "gene")) - 1).alias("pos"), "gene")


def to_panel(expr: DataFrame, panel: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, X: dense arrays in panel order, absent genes 0."""
    size = panel.count()
    entries = expr.join(F.broadcast(panel), "gene").groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return cells.select("cell_id").join(entries, "cell_id", "left").select("cell_id", x.alias("X"))


def standardize(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """z-scores of stored entries by chunk; a zero entry's is -mu / (sigma + eps)."""
    stats = gene_stats(expr, cells)
    return in_chunks(expr, cells).join(F.broadcast(stats), ["chunk_id", "gene"]).select("cell_id", "gene", ((F.col("value") - F.col("mu")) / (F.col("sigma") + EPS_Z)).alias("z"))


def signature_scores(expr: DataFrame, cells: DataFrame, sets: DataFrame) -> DataFrame:
    """cell_id, set_name, score: mean z over the set's genes that the chunk has; 0 where it has none. sets: set_name, gene."""
    weights = gene_stats(expr, cells).join(F.broadcast(sets), "gene")
    per_set = weights.groupBy("chunk_id", "set_name").agg(F.count("*").alias("m"), F.sum(F.col("mu") / (F.col("sigma") + EPS_Z)).alias("base"))
    sums = in_chunks(expr, cells).join(F.broadcast(weights.select("chunk_id", "gene", "set_name", "sigma")), ["chunk_id", "gene"])
    sums = sums.groupBy("cell_id", "set_name").agg(F.sum(F.col("value") / (F.col("sigma") + EPS_Z)).alias("v"))
    grid = cells.select("cell_id", "chunk_id").crossJoin(F.broadcast(sets.select("set_name").distinct()))
    scored = grid.join(F.broadcast(per_set), ["chunk_id", "set_name"], "left").join(sums, ["cell_id", "set_name"], "left")
    return scored.select("cell_id", "set_name", F.coalesce((F.coalesce("v", F.lit(0.0)) - F.col("base")) / F.col("m"), F.lit(0.0)).alias("score"))


def pivot_scores(scores: DataFrame, names: list[str]) -> DataFrame:
    return scores.groupBy("cell_id").pivot("set_name", names).agg(F.first("score"))


def _control_stats(df: DataFrame, scores: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by chunk and line, by chunk): count, mean and spread of each score over controls (c_) and over all (a_). Partial aggregates, so a line may have nearly all rows."""
    ctrl = lambda c: F.when(F.col("is_control"), F.col(c))
    stats = [f(v).alias(f"{p}{n}_{c}") for c in scores for p, v in (("c_", ctrl(c)), ("a_", F.col(c))) for n, f in (("n", F.count), ("mu", F.avg), ("sd", F.stddev_pop))]
    return df.groupBy("chunk_id", "cell_line").agg(*stats), df.groupBy("chunk_id").agg(*(s.alias(f"g_{i}") for i, s in enumerate(stats)))


def relative_to_controls(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """df with z (named by `scores`) of each score against the own line's controls in the chunk; fewer than two: the chunk's controls, or without any all its cells; no spread: the chunk's, then 1."""
    line, chunk = _control_stats(df, list(scores))
    names = [c for c in line.columns if c not in ("chunk_id", "cell_line")]
    chunk = chunk.select("chunk_id", *(F.col(f"g_{i}").alias(f"g{n}") for i, n in enumerate(names)))
    j = _with_stats(df, line, chunk)
    out = {}
    for c, z in scores.items():
        g_mu, g_sd = (F.when(F.col(f"gc_n_{c}") >= 1, F.col(f"gc_{s}_{c}")).otherwise(F.col(f"ga_{s}_{c}")) for s in ("mu", "sd"))
        own = F.col(f"c_n_{c}") >= 2
        mu, sd = F.when(own, F.col(f"c_mu_{c}")).otherwise(g_mu), F.when(own, F.col(f"c_sd_{c}")).otherwise(g_sd)
        out[z] = (F.col(c) - mu) / F.when(sd > 1e-8, sd).when(g_sd > 1e-8, g_sd).otherwise(1.0)
    return j.withColumns(out).select(*(c for c in df.columns if c not in out), *out)


def _with_stats(df: DataFrame, line: DataFrame, chunk: DataFrame | None = None) -> DataFrame:
    """df with the columns of its line in its chunk, and of its chunk. A few rows a chunk: Spark broadcasts them, or deals a hot line's rows again."""
    keys = ["chunk_id", "cell_line"]
    both = line if chunk is None else line.join(chunk, "chunk_id")
    null_safe = [df[k].eqNullSafe(both[k]) for k in keys]
    return df.join(both, null_safe[0] & null_safe[1]).drop(*(both[k] for k in keys))


def fate_labels(scores: DataFrame, cells: DataFrame, tau: float, baseline_safe: float = 2.0) -> DataFrame:
    """cell_id, y_safe, y_loss, y_death from somatic, pluripotency and apoptosis scores (safe, loss, death)."""
    df = cells.select("cell_id", "chunk_id", "cell_line", "is_control").join(scores, "cell_id")
    z = relative_to_controls(df, {"safe": "zs", "loss": "zl", "death": "zd"})
    y = softmax(F.lit(baseline_safe), F.col("zl") - F.col("zs"), F.col("zd"), tau=tau)
    return z.select("cell_id", *(p.alias(n) for p, n in zip(y, ("y_safe", "y_loss", "y_death"))))


def clock_predict(expr: DataFrame, cells: DataFrame, clock: DataFrame, intercept: float) -> DataFrame:
    """cell_id, age: the clock over all genes of the profile, not the panel's only."""
    sums = expr.join(F.broadcast(clock), "gene").groupBy("cell_id").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", (F.coalesce("s", F.lit(0.0)) + intercept).alias("age"))


def predict_age(expr: DataFrame, cells: DataFrame, clock) -> DataFrame:
    """cell_id, age of every cell by a clock: any callable (expr, cells) -> (cell_id, age), or a pair of a table of weights (gene, weight) and an intercept.

    A callable that leaves a cell out gives it a null age; one that gives a cell two ages is an error when the result is read.
    """
    ages = clock(expr, cells) if callable(clock) else clock_predict(expr, cells, *clock)
    g = ages.groupBy("cell_id").agg(F.count("*").alias("n"), F.max("age").cast("double").alias("age"))
    one = g.select("cell_id", F.when(F.col("n") > 1, F.raise_error(F.format_string("two ages for cell %s", F.col("cell_id").cast("string"))).cast("double")).otherwise(F.col("age")).alias("age"))
    return cells.select("cell_id").join(one, "cell_id", "left")


def with_baseline(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with `out`: the mean of the controls of the line in the chunk; without controls, of the line."""
    line = df.groupBy("chunk_id", "cell_line").agg(F.coalesce(F.avg(F.when(F.col("is_control"), F.col(value))), F.avg(value)).alias(out))
    return _with_stats(df, line)


def delta_age(ages: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, chunk_id, cell_line, is_control, age, d_age: the age less that of the line's controls. Cells without an age are left out, a null line is a line."""
    df = cells.select("cell_id", "chunk_id", "cell_line", "is_control").join(ages, "cell_id")
    return with_baseline(df, "age", "base").withColumn("d_age", F.col("age") - F.col("base")).drop("base")


def ols(by: list[str], df: DataFrame, x: str, y: str) -> DataFrame:
    """by, a, b of y = a x + b; no spread of x: (0, mean y)."""
    flat = F.coalesce(F.var_pop(x), F.lit(0.0)) < 1e-12
    return df.groupBy(*by).agg(
        F.when(flat, 0.0).otherwise(F.regr_slope(y, x)).alias("a"),
        F.coalesce(F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x)), F.lit(0.0)).alias("b"),
    )


def deconfound(df: DataFrame, train: Column, x: str, y: str, mask: Column) -> DataFrame:
    """y less its fit on x over the training rows, recentred on the controls of masked rows; null elsewhere."""
    fit = ols([], df.filter(train & mask), x, y)
    masked = df.filter(mask).crossJoin(F.broadcast(fit)).withColumn("r", F.col(y) - (F.col("a") * F.col(x) + F.col("b")))
    return with_baseline(masked, "r", "base").withColumn("y_age", F.col("r") - F.col("base")).drop("a", "b", "r", "base")


def fit_harmonizer(expr: DataFrame, cells: DataFrame, least_mean: float = 0.1) -> DataFrame:
    """dataset_id, gene, mu, sigma of controls on the genes that every dataset admits; sigma is at least its dataset's median.

    cells: cell_id, dataset_id, is_control. Datasets with fewer than three controls take no part.
    """
    controls = cells.filter("is_control").select("cell_id", "dataset_id")
    stats = gene_stats(expr, controls, "dataset_id").filter((F.col("mu") >= least_mean) & (F.col("n") >= 3))
    datasets = controls.groupBy("dataset_id").agg(F.count("*").alias("n")).filter("n >= 3").agg(F.count("*").alias("d"))
    common = stats.groupBy("gene").agg(F.count("*").alias("k")).crossJoin(F.broadcast(datasets)).filter("k = d").select("gene")
    shared = stats.join(common, "gene", "left_semi")
    floor = F.percentile("sigma", F.lit(0.5)).over(Window.partitionBy("dataset_id"))
    return shared.select("dataset_id", "gene", "mu", F.greatest("sigma", floor).alias("sigma"))


def harmonize(expr: DataFrame, cells: DataFrame, harm: DataFrame) -> DataFrame:
    """cell_id, gene, z on the common genes, absent genes included: a zero is no zero after centring."""
    grid = cells.select("cell_id", "dataset_id").join(F.broadcast(harm), "dataset_id")
    full = grid.join(expr, ["cell_id", "gene"], "left")
    return full.select("cell_id", "gene", ((F.coalesce("value", F.lit(0.0)) - F.col("mu")) / (F.col("sigma") + EPS_SCALE)).alias("z"))


def harmonized_age(expr: DataFrame, cells: DataFrame, harm: DataFrame, clock: DataFrame, intercept: float, reference: int | str) -> DataFrame:
    """The clock on profiles moved to the reference dataset, folded into one weight a gene and one constant a dataset, so nothing is made dense."""
    ref = harm.filter(F.col("dataset_id") == reference).select("gene", F.col("mu").alias("mu_ref"), F.col("sigma").alias("sigma_ref"))
    folded = harm.join(ref, "gene").join(F.broadcast(clock), "gene")
    folded = folded.withColumn("w", F.col("weight") * F.col("sigma_ref") / (F.col("sigma") + EPS_SCALE)).withColumn("c", F.col("weight") * F.col("mu_ref") - F.col("w") * F.col("mu"))
    const = folded.groupBy("dataset_id").agg(F.sum("c").alias("c"))
    owned = cells.select("cell_id", "dataset_id")
    sums = expr.join(owned, "cell_id").join(F.broadcast(folded.select("dataset_id", "gene", "w")), ["dataset_id", "gene"]).groupBy("cell_id").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    return owned.join(sums, "cell_id", "left").join(F.broadcast(const), "dataset_id").select("cell_id", (F.coalesce("s", F.lit(0.0)) + F.col("c") + intercept).alias("age"))


def fit_scaler(long: DataFrame, n_rows: DataFrame) -> DataFrame:
    """feature, mean, std (population, zeros counted). long: feature, value; n_rows: one row, n."""
    sums = long.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(F.broadcast(n_rows))
    mean = F.col("s") / F.col("n")
    return sums.select("feature", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def dedup_symbols(counts: DataFrame) -> DataFrame:
    """Of rows with one symbol the one with the largest total is kept, the first on ties. counts: feature_row, symbol, total."""
    best = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("total"), "feature_row"))
    return counts.withColumn("r", best).filter("r = 1").drop("r")


def embedding_project(expr: DataFrame, vectors: DataFrame) -> DataFrame:
    """cell_id, dim, value: expression-weighted sums of gene vectors (gene, vec)."""
    long = vectors.select("gene", F.posexplode("vec").alias("dim", "e"))
    return expr.join(F.broadcast(long), "gene").groupBy("cell_id", "dim").agg(F.sum(F.col("value") * F.col("e")).alias("value"))


def age_valid(source: Column, masked: list) -> Column:
    """Whether a row's age counts: its source is not one whose ages mean nothing (as of cancer lines). An unknown source counts."""
    return ~F.coalesce(source.isin(masked), F.lit(False))

"""Quality control and contracts of cells and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def qc_metrics(expr: DataFrame, cells: DataFrame, mito: Column | None = None) -> DataFrame:
    """cell_id, total, n_genes, mito_fraction; a cell without any entry has zeros."""
    mito = F.upper("gene").startswith("MT-") if mito is None else mito
    sums = expr.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_genes"), F.sum(F.when(mito, F.col("value")).otherwise(0.0)).alias("mito"))
    all_ = cells.select("cell_id").join(sums, "cell_id", "left")
    return all_.select(
        "cell_id",
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.coalesce("n_genes", F.lit(0)).alias("n_genes"),
        (F.coalesce("mito", F.lit(0.0)) / F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(1.0))).alias("mito_fraction"),
    )


def qc_filter(metrics: DataFrame, min_genes: int, max_mito: float, max_counts: float | None = None) -> DataFrame:
    """Bounds are inclusive; no max_counts is no cap."""
    kept = metrics.filter((F.col("n_genes") >= min_genes) & (F.col("mito_fraction") <= max_mito))
    return kept if max_counts is None else kept.filter(F.col("total") <= max_counts)


def drop_empty_droplets(triplets: DataFrame, min_genes: int, by: list[str]) -> DataFrame:
    """Rows of droplets with at least min_genes stored entries, whatever their values."""
    real = triplets.groupBy(*by).count().filter(F.col("count") >= min_genes).select(*by)
    return triplets.join(real, by, "left_semi")


#: rule: what a sample breaks it by
SAMPLE_RULES = {
    "x_empty": "X IS NULL OR size(X) = 0",
    "x_finite": "exists(X, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))",
    "dose_time_size": "dose_time IS NULL OR size(dose_time) <> 2",
    "y_cls_size": "y_cls IS NULL OR size(y_cls) <> 3",
    "y_cls_negative": "exists(y_cls, v -> v < -1e-6)",
    "y_cls_sum": "abs(aggregate(y_cls, double(0), (s, v) -> s + v) - 1) > 1e-3",
    "age_mask": "age_mask <> (y_age IS NOT NULL AND NOT isnan(y_age))",
    "sig_scores_size": "sig_scores IS NULL OR size(sig_scores) <> 3",
    "modality": "u_modality IS NULL OR u_modality NOT IN ('chem', 'genetic', 'tf')",
    "fingerprint": "(u_modality = 'chem') <> (u_chem_fp IS NOT NULL)",
    "fingerprint_size": "u_chem_fp IS NOT NULL AND size(u_chem_fp) <> 2048",
    "fingerprint_bits": "exists(u_chem_fp, b -> b NOT IN (0, 1))",
    "gene_embedding": "u_modality = 'genetic' AND u_gene_emb IS NULL",
    "tf_embedding": "u_modality = 'tf' AND (u_tf_emb IS NULL OR size(u_tf_emb) <> 8)",
    "scaffold": "u_modality = 'chem' AND (scaffold_id IS NULL OR scaffold_id = '')",
}


def validate_samples(samples: DataFrame) -> DataFrame:
    """(cell_id, rule) of every broken rule; none if all samples are valid."""
    broken = F.array(*(F.when(F.coalesce(F.expr(e), F.lit(False)), F.lit(rule)) for rule, e in SAMPLE_RULES.items()))
    return samples.select("cell_id", F.explode(F.array_compact(broken)).alias("rule"))


def obs_contract(expr: DataFrame, cells: DataFrame) -> DataFrame:
    """Orphans on either side: (side, n)."""
    left = expr.select("cell_id").distinct().join(cells, "cell_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("expr_without_cell").alias("side"), "n")
    right = cells.join(expr, "cell_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("cell_without_expr").alias("side"), "n")
    return left.unionByName(right)


def panel_hash(panel: DataFrame) -> DataFrame:
    """First 16 hex digits of the sha256 of the genes by position. A panel has a few thousand genes."""
    genes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda x: x["gene"])
    return panel.agg(F.substring(F.sha2(F.concat_ws("\n", genes), 256), 1, 16).alias("panel_hash"))


def control_census(cells: DataFrame) -> DataFrame:
    """Controls and treated by chunk and line, and whether the fallback without controls fires."""
    counts = cells.groupBy("chunk_id", "cell_line").agg(F.count_if("is_control").alias("n_control"), F.count_if(~F.col("is_control")).alias("n_perturbed"))
    return counts.withColumn("fallback", (F.col("n_perturbed") > 0) & (F.col("n_control") == 0))


def census_verdict(census: DataFrame) -> DataFrame:
    return census.agg(F.when(F.count("*") == 0, "CANNOT_VERIFY").when(F.bool_or("fallback"), "FAIL").otherwise("PASS").alias("verdict"), F.count_if("fallback").alias("n_fallback"))


def donor_usability(rows: DataFrame, bulk: float = 0.5) -> DataFrame:
    """fold, donor, n, left_share, usable: a donor whose removal leaves less than `bulk` of the rows is not."""
    n = rows.groupBy("fold", "donor").agg(F.count("*").alias("n"))
    share = 1 - F.col("n") / F.sum("n").over(Window.partitionBy("fold"))
    return n.withColumn("left_share", share).withColumn("usable", F.col("left_share") >= bulk)


def usability_verdict(usable: DataFrame, least: int = 2) -> DataFrame:
    n = usable.groupBy("fold").agg(F.count_if("usable").alias("n_usable"))
    return n.withColumn("verdict", F.when(F.col("n_usable") >= least, "PASS").when(F.col("n_usable") > 0, "STOP").otherwise("FAIL"))


def profile_shards(cells: DataFrame) -> DataFrame:
    return cells.groupBy("chunk_id").agg(F.count("*").alias("n_rows"), F.count_distinct("cell_line").alias("n_lines"), F.count_distinct("pert_id").alias("n_perts"))


def class_variation(soft: DataFrame, cols: list[str], least: float = 0.01) -> DataFrame:
    """Whether at least two classes have `least` of the soft mass."""
    mass = soft.agg(*(F.sum(c).alias(c) for c in cols))
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    n = sum(((F.col(c) / total >= least).cast("int") for c in cols[1:]), (F.col(cols[0]) / total >= least).cast("int"))
    return mass.select(n.alias("n_classes"), (n >= 2).alias("varies"))


def check_panel_hash(panels: DataFrame) -> DataFrame:
    """panel_hash, n_sources, agree: whether all sources (source, pos, gene) have one panel."""
    genes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda x: x["gene"])
    each = panels.groupBy("source").agg(F.substring(F.sha2(F.concat_ws("\n", genes), 256), 1, 16).alias("h"))
    return each.agg(F.min("h").alias("panel_hash"), F.count("*").alias("n_sources"), (F.min("h") == F.max("h")).alias("agree"))


def panel_differences(panels: DataFrame, reference: str) -> DataFrame:
    """source, panel_hash, agree, n_missing, n_extra, n_moved of each source (source, pos, gene) against the source `reference`: genes that it lacks, has in
    addition, or has at another place. A source that lists a gene twice counts each place of it."""
    genes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda x: x["gene"])  # a panel is a dimension
    each = panels.groupBy("source").agg(F.substring(F.sha2(F.concat_ws("\n", genes), 256), 1, 16).alias("panel_hash"))
    ref = panels.filter(F.col("source") == reference).select("gene", F.col("pos").alias("at"))
    wanted = each.select("source").crossJoin(F.broadcast(ref))
    own = panels.select("source", "gene", "pos")
    met = wanted.join(own, ["source", "gene"], "full").groupBy("source").agg(
        F.count_if(F.col("pos").isNull()).alias("n_missing"), F.count_if(F.col("at").isNull()).alias("n_extra"), F.count_if(F.col("at") != F.col("pos")).alias("n_moved")
    )
    theirs = each.filter(F.col("source") == reference).select(F.col("panel_hash").alias("h"))
    return each.join(met, "source").crossJoin(F.broadcast(theirs)).select("source", "panel_hash", (F.col("panel_hash") == F.col("h")).alias("agree"), "n_missing", "n_extra", "n_moved")

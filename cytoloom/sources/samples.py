"""The sample table on disk: shards by chunk, manifest, column updates, reports and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .schemas import METRICS, SAMPLES


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLES).parquet(path)


def write_samples(df: DataFrame, path: str, by: str | list[str] = "chunk_id") -> None:
    """zstd Parquet, one folder a chunk (or what `by` names); only the folders that df has rows for are replaced, each as a whole. An empty table is an error."""
    if df.isEmpty():
        raise ValueError("no samples to write")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(by).parquet(path)


def update_column(samples: DataFrame, values: DataFrame, column: str, key: str = "cell_id") -> DataFrame:
    """samples with one column replaced; NaN becomes null. Every sample needs exactly one value."""
    if values.groupBy(key).count().filter("count > 1").limit(1).count() or samples.join(values, key, "left_anti").limit(1).count():
        raise ValueError(f"values do not match the samples by {key}")
    new = values.select(key, F.when(~F.isnan(column), F.col(column)).alias("__new"))
    return samples.join(new, key).withColumn(column, F.col("__new").cast(samples.schema[column].dataType)).drop("__new")


def manifest(samples: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """Keys of the samples with their position in the chunk: a projection, so the features are not read."""
    keys = [c for c in ("cell_id", "cell_line", "pert_id", "scaffold_id", "source", "age_mask") if c in samples.columns]
    return samples.select(*keys, F.col(chunk).alias("shard_id"), (F.row_number().over(Window.partitionBy(chunk).orderBy("cell_id")) - 1).cast("long").alias("row_idx"))


def load_manifest(spark: SparkSession, samples: str, path: str) -> DataFrame:
    """The manifest at `path`; where there is none, it is built from the samples and written first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    manifest(spark.read.parquet(samples)).write.parquet(path)
    return spark.read.parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines, one folder a regime."""
    metrics.write.mode("overwrite").partitionBy("regime").json(path)


def read_fold_reports(spark: SparkSession, path: str, folds: DataFrame) -> DataFrame:
    """Metrics of the expected folds; files that are missing or broken leave nulls."""
    got = spark.read.schema(METRICS).option("mode", "PERMISSIVE").json(path)
    return folds.join(got.filter("fold IS NOT NULL"), "fold", "left")


def snapshot(values: DataFrame, path: str, tag: str) -> None:
    """Appends fold, metric, value under a tag; the same tag is replaced."""
    values.select("fold", "metric", "value", F.current_timestamp().alias("utc"), F.lit(tag).alias("tag")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").parquet(path)


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("tag").agg(F.max("utc").alias("utc"), F.count_distinct("fold").alias("n_folds"))

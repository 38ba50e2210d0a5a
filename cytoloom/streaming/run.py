"""Runs a stream over the rows at hand to its end and reads the result as a table, for queries and tests."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a temporary one only where it is unset and the session is local."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: for what several steps read, and to cut lineage."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives for all input available now: of every batch, or in complete mode, where each gives the whole result, of the last one."""
    spark = stream.sparkSession
    out, check = shared_path(spark, "stream-out"), shared_path(spark, "stream-check")
    last: list[int] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        last[:] = [n]

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/batch={last[0]}" if mode == "complete" else f"{out}/batch=*")

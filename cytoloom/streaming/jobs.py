"""Ingest by micro-batches with a ledger, stream-static scoring, running monitors, baselines and suppression of duplicates."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.scoring import ScoreParams, efficacy
from ..sources.samples import write_samples
from .run import staged

ERROR_LENGTH = 500

#: what names a delivery: a source file in one version
FILE = ["file", "size", "modified"]
LEDGER = "file string, size long, modified timestamp, chunk_id string, status string, n long, error string, ts timestamp"


def with_file(rows: DataFrame) -> DataFrame:
    """rows of a file source with the file that each comes from, its size and time, and the delivery's name. A null chunk is a chunk."""
    named = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))
    key = F.concat_ws("|", "file", F.col("size").cast("string"), F.unix_micros("modified").cast("string"))
    return named.withColumns({"chunk_id": F.col("chunk_id").cast("string"), "delivery": F.substring(F.sha2(key, 256), 1, 32)})


def latest(ledger: DataFrame) -> DataFrame:
    """The last row of each file and chunk."""
    return ledger.groupBy(*FILE, "chunk_id").agg(F.max_by("status", "ts").alias("status"), F.max_by("n", "ts").alias("n"))


def pending(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of found (file, size, modified, chunk_id and others) that the ledger does not have as `done`."""
    done = latest(ledger).filter("status = 'done'").select(*FILE, "chunk_id")
    same = [found[c].eqNullSafe(done[c]) for c in (*FILE, "chunk_id")]
    return found.join(done, same[0] & same[1] & same[2] & same[3], "left_anti")


def record(found: DataFrame, ledger: str, status: str, error: str | None = None) -> None:
    """Appends a ledger row for each row of found: file, size, modified, chunk_id, n."""
    text = F.lit(error[:ERROR_LENGTH] if error else None).cast("string")
    found.select(*FILE, "chunk_id", F.lit(status).alias("status"), F.col("n").cast("long").alias("n"), text.alias("error"), F.current_timestamp().alias("ts")).write.mode("append").parquet(ledger)


def clear(spark: SparkSession, ledger: str, chunk_ids: list, file: str | None = None) -> None:
    """Marks chunks as not done, in one file or in all that the ledger has: the next ingest takes them again, whatever its checkpoint has seen."""
    wanted = F.col("chunk_id").isin([str(c) for c in chunk_ids])
    record(latest(spark.read.schema(LEDGER).parquet(ledger)).filter(wanted if file is None else wanted & (F.col("file") == file)), ledger, "cleared")


def take(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, ledger: str) -> None:
    """Writes the chunks of rows (as with_file gives them) that the ledger does not have as done, and records them with their numbers of rows."""
    each = rows.groupBy(*FILE, "delivery", "chunk_id").agg(F.count("*").alias("n"))
    todo = staged(pending(each, rows.sparkSession.read.schema(LEDGER).parquet(ledger)), "pending")
    if todo.isEmpty():
        return
    try:
        wanted = rows.join(todo, (rows["delivery"] == todo["delivery"]) & rows["chunk_id"].eqNullSafe(todo["chunk_id"]), "left_semi").drop(*FILE)
        write_samples(transform(wanted), out, ["chunk_id", "delivery"])
    except Exception as e:
        record(todo, ledger, "failed", str(e))
        raise
    record(todo, ledger, "done")


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, ledger: str, checkpoint: str, read: Callable[[list[str]], DataFrame] | None = None):
    """New files of chunks to samples, each file's rows once: in folders of chunk and delivery, a delivery being a file in one version (path, size, time).

    A delivery that is taken again replaces its own folders only: after a failure between the samples and the ledger, with another or a lost checkpoint, and by two
    ingests that share a ledger. What the ledger has as done is skipped; what it has as failed or cleared is read again at the start (by `read`, of paths; Parquet
    files if not given), as the stream's checkpoint may have passed it. Failures are recorded and raised. stream: a file source without projections, with chunk_id;
    transform keeps chunk_id and delivery. A reader of `out` gets the chunks with an extra column, delivery.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)  # so that the first batch finds a ledger
    open_ = latest(spark.read.schema(LEDGER).parquet(ledger)).filter("status <> 'done'").select(*FILE, "chunk_id")
    files = sorted(unquote(r["file"]) for r in open_.select("file").distinct().collect())  # what has been cleared or has failed
    if files:
        again = with_file((read or spark.read.schema(stream.schema).parquet)(*([files] if read else files)))
        same = [again[c].eqNullSafe(open_[c]) for c in (*FILE, "chunk_id")]
        take(again.join(open_, same[0] & same[1] & same[2] & same[3], "left_semi"), transform, out, ledger)
    return with_file(stream).writeStream.foreachBatch(lambda batch, _: take(batch, transform, out, ledger)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(stream: DataFrame, params: ScoreParams, offsets: DataFrame) -> DataFrame:
    """Scores rows against frozen parameters and a static table of offsets by line (line, offset). Stateless."""
    shifted = stream.join(F.broadcast(offsets), "cell_line", "left").withColumn("mu_age", F.col("mu_age") - F.coalesce("offset", F.lit(0.0))).drop("offset")
    return efficacy(shifted, params)


def running_ece_bins(stream: DataFrame, window: str = "1 day", late: str = "2 days", bins: int = 10, slide: str | None = None) -> DataFrame:
    """Counts, mean confidence and accuracy by window and bin; rows later than the watermark are dropped. stream: ts, p, y."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg(F.col("y").cast("double")).alias("acc"))


def running_rates(stream: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Share out of distribution and approved, by window. stream: ts, in_dist, status."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.avg((~F.col("in_dist")).cast("double")).alias("ood_rate"), F.avg((F.col("status") == "APPROVED").cast("double")).alias("approval_rate"), F.count("*").alias("n"))


def running_baseline(stream: DataFrame) -> DataFrame:
    """cell_line, n, mean of the controls seen so far; in update mode, of the lines that a batch touches. stream: cell_line, value."""
    return stream.groupBy("cell_line").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def suppress_duplicates(stream: DataFrame, key: str = "cell_id", ts: str = "ts", late: str = "2 days") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])

"""Ingest in several deliveries, failures, cleared chunks, and streams drained in every mode."""

from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cytoloom.operators import expression as X
from cytoloom.streaming import jobs as J
from cytoloom.streaming.run import drained

ROW = "cell_id string, chunk_id string"


def deliver(spark, rows, path):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, transform=lambda b: b, check="check", **how):
    at = lambda n: str(tmp_path / n)
    J.ingest(spark.readStream.schema(ROW).parquet(at("in")), transform, at("out"), at("ledger"), at(check), **how).awaitTermination()
    return sorted((r["chunk_id"] or "", r["cell_id"]) for r in spark.read.schema(ROW + ", delivery string").parquet(at("out")).collect())


def ledger(spark, tmp_path):
    return spark.read.schema(J.LEDGER).parquet(str(tmp_path / "ledger"))


def test_a_chunk_may_come_in_two_deliveries(spark, tmp_path):
    deliver(spark, [("a", "1"), ("b", "1"), ("n", None)], str(tmp_path / "in"))
    run(spark, tmp_path)
    deliver(spark, [("c", "1"), ("d", "2")], str(tmp_path / "in"))
    want = [("", "n"), ("1", "a"), ("1", "b"), ("1", "c"), ("2", "d")]
    assert run(spark, tmp_path) == want == run(spark, tmp_path)
    led = ledger(spark, tmp_path).collect()
    assert sorted((r["chunk_id"] or "", r["n"], r["status"]) for r in led) == [("", 1, "done"), ("1", 1, "done"), ("1", 2, "done"), ("2", 1, "done")]
    assert len({r["file"] for r in led}) == 2


def test_a_failed_chunk_is_taken_again(spark, tmp_path):
    deliver(spark, [("a", "1"), ("b", "2")], str(tmp_path / "in"))

    def broken(batch):
        raise ValueError("x" * 900)

    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path, broken)
    failed = ledger(spark, tmp_path).collect()
    assert {r["status"] for r in failed} == {"failed"} and all(len(r["error"]) == J.ERROR_LENGTH for r in failed)
    assert run(spark, tmp_path) == [("1", "a"), ("2", "b")] == run(spark, tmp_path, check="new")


@pytest.mark.parametrize("second", ["check", "new"])
def test_a_ledger_that_two_checkpoints_share(spark, tmp_path, second):
    """Neither loses what comes after, nor doubles what was there before."""
    taken = []

    def noting(batch):
        taken.extend(r[0] for r in batch.select("cell_id").collect())
        return batch

    deliver(spark, [("a", "1"), ("b", "1")], str(tmp_path / "in"))
    run(spark, tmp_path, noting)
    deliver(spark, [("c", "1")], str(tmp_path / "in"))
    deliver(spark, [("d", "2")], str(tmp_path / "in"))
    want = [("1", "a"), ("1", "b"), ("1", "c"), ("2", "d")]
    assert run(spark, tmp_path, noting, check=second) == want
    assert run(spark, tmp_path, noting, check="third") == want and sorted(taken) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("again", ["check", "new"])
def test_a_failure_between_samples_and_ledger(spark, tmp_path, monkeypatch, again):
    deliver(spark, [("a", "1"), ("b", "2")], str(tmp_path / "in"))
    record = J.record

    def lost(found, path, status, error=None):
        if status == "done":
            raise RuntimeError("the driver is gone")
        record(found, path, status, error)

    monkeypatch.setattr(J, "record", lost)
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path)
    assert ledger(spark, tmp_path).count() == 0
    monkeypatch.undo()
    assert run(spark, tmp_path, check=again) == [("1", "a"), ("2", "b")]
    assert {(r["status"], r["n"]) for r in ledger(spark, tmp_path).collect()} == {("done", 1)}


def test_cleared_chunks_are_taken_again_after_a_restart(spark, tmp_path):
    deliver(spark, [("a", "1"), ("b", "2")], str(tmp_path / "in"))
    run(spark, tmp_path)
    J.clear(spark, str(tmp_path / "ledger"), ["1"])
    seen = ledger(spark, tmp_path)
    found = seen.filter("status = 'done'").select(*J.FILE, "chunk_id", "n")
    assert [r["chunk_id"] for r in J.pending(found, seen).collect()] == ["1"]
    upper = lambda b: b.withColumn("cell_id", F.upper("cell_id"))
    assert run(spark, tmp_path, upper) == [("1", "A"), ("2", "b")] == run(spark, tmp_path)
    J.clear(spark, str(tmp_path / "ledger"), ["2"], file=seen.first()["file"])
    assert run(spark, tmp_path, upper, read=lambda files: spark.read.schema(ROW).parquet(*files)) == [("1", "A"), ("2", "B")]


def test_complete_streams_give_the_last_result(spark, tmp_path):
    for i in range(2):
        spark.range(5).select((F.col("id") * 0 + F.lit(i)).alias("x"), F.lit("k").alias("cell_line"), F.lit(1.0 + i).alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("x long, cell_line string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(s.groupBy("cell_line").agg(F.count("*").alias("n")), "complete").collect()
    assert [(r["cell_line"], r["n"]) for r in got] == [("k", 10)]
    base = drained(J.running_baseline(s), "update").orderBy("n").collect()
    assert [(r["n"], r["mean"]) for r in base] in ([(5, 1.0), (10, 1.5)], [(5, 2.0), (10, 1.5)])
    assert drained(s.filter("x > 9")).count() == 0


def test_one_line_may_have_nearly_all_rows(spark):
    df = spark.range(30_000).select("id", F.lit(0).alias("chunk_id"), F.when(F.col("id") < 5, "rare").when(F.col("id") < 6, F.lit(None).cast("string")).otherwise("hot").alias("cell_line"), (F.col("id") % 3 == 0).alias("is_control"), (F.col("id") % 97).cast("double").alias("v"))
    plan = X.with_baseline(df, "v", "b")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    both = X.relative_to_controls(X.with_baseline(df, "v", "b"), {"v": "z"}).toPandas()
    for line, g in both.groupby("cell_line", dropna=False):
        ctrl, chunk = g.v[g.is_control], both.v[both.is_control]
        assert abs(g.b - (ctrl.mean() if len(ctrl) else g.v.mean())).max() < 1e-9
        own = ctrl if len(ctrl) >= 2 else chunk
        sd = own.std(ddof=0) if own.std(ddof=0) > 1e-8 else chunk.std(ddof=0)
        assert abs(g.z - (g.v - own.mean()) / sd).max() < 1e-9
    assert len(both) == 30_000

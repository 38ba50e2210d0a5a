"""Pruned and hashed neighbours, triplets in byte ranges, mean vectors, panels and clocks against plain Python."""

from __future__ import annotations

import gzip
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoloom.operators import expression as X, neighbours as NB, quality as QC, scoring as S, similarity as N, timecourse as T
from cytoloom.sources import matrices as R, triplets as TR


def _vectors(spark, rows, v="ref_v", i="ref_id"):
    return spark.createDataFrame(rows, f"label int, {i} int, {v} array<double>")


def _brute(queries, refs, k):
    out = {}
    for label, q, v in queries:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        near = sorted((math.dist(v, w), r) for other, r, w in refs if other == label and w is not None and all(x is not None and math.isfinite(x) for x in w))
        out[q] = [r for _, r in near[:k]]
    return {q: r for q, r in out.items() if r}


@pytest.mark.parametrize("seed,pivots,rings,block", [(1, 5, 3, 7), (2, 1, 1, 1000), (3, 40, 4, 16)])
def test_pivots_lose_no_neighbour(spark, seed, pivots, rings, block):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, (6, 3))
    # whole numbers, so that ties are many and exact; one key has nearly all rows, equal rows are frequent
    refs = [(0 if i % 9 else 1, i, [float(x) for x in centres[i % 6] + rng.integers(-2, 3, 3)]) for i in range(260)]
    refs += [(0, 1000 + i, [5.0, 5.0, 5.0]) for i in range(60)] + [(0, 2000, None), (0, 2001, [1.0, None, 2.0]), (1, 2002, [float("nan"), 0.0, 0.0]), (2, 2003, [1.0, 1.0, 1.0])]
    queries = [(label, i, v) for label, i, v in refs if i % 3 == 0 or i >= 2000] + [(7, 5000, [0.0, 0.0, 0.0]), (0, 5001, [900.0, -900.0, 3.0])]
    got = {}
    for r in NB.pivot_knn(_vectors(spark, queries, "v", "query_id"), _vectors(spark, refs), 4, ["label"], pivots, rings, block).orderBy("query_id", "distance", "ref_id").collect():
        got.setdefault(r["query_id"], []).append(r["ref_id"])
    assert got == _brute(queries, refs, 4)


def test_pivots_meet_fewer_rows(spark, monkeypatch):
    """On clustered vectors a query meets a small part of its key."""
    rng = np.random.default_rng(4)
    refs = [(0, i, [float(x) for x in 100 * (i % 20) + rng.normal(size=4)]) for i in range(800)]
    met = []
    blocks = NB._in_blocks

    def counted(*args):
        pairs = blocks(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(NB, "_in_blocks", counted)
    df = _vectors(spark, refs)
    assert NB.pivot_knn(df.withColumnsRenamed({"ref_id": "query_id", "ref_v": "v"}), df, 3, ["label"]).count() == 2400
    assert met[0] < 800 * 800 / 4


def test_neighbours_of_nothing(spark):
    none = _vectors(spark, [])
    some = _vectors(spark, [(0, 1, [1.0, 2.0])], "v", "query_id")
    assert NB.pivot_knn(some, none, 3, ["label"]).count() == 0
    assert NB.pivot_knn(none.withColumnsRenamed({"ref_id": "query_id", "ref_v": "v"}), _vectors(spark, [(0, 1, [1.0, 2.0])]), 3, ["label"]).count() == 0
    assert NB.recall(none.withColumn("query_id", F.col("ref_id")), none.withColumn("query_id", F.col("ref_id"))).first()["recall"] is None


def test_hashed_neighbours_are_near(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    refs = [(0, i, [float(x) for x in base[i // 5] + 0.05 * rng.normal(size=8)]) for i in range(300)]
    q, r = _vectors(spark, refs, "v", "query_id"), _vectors(spark, refs)
    found, exact = NB.hashed_knn(q, r, 5, ["label"], width=2.0), N.euclidean_knn(q, r, 5, ["label"])
    got = NB.recall(found, exact).first()
    assert got["n"] == 1500 and got["recall"] >= 0.9
    true = {(x["query_id"], x["ref_id"]): x["distance"] for x in N.euclidean_knn(q, r, 300, ["label"]).collect()}
    assert all(abs(true[(x["query_id"], x["ref_id"])] - x["distance"]) < 1e-12 for x in found.collect())


def _triplet_text(n, seed=0, end="\n"):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 50), rng.randint(1, 9), rng.randint(1, 1000) / 8) for _ in range(n)]
    body = "\n".join(f"{a} {b} {v!r}" for a, b, v in rows) + end
    return "%%MatrixMarket matrix coordinate real general\n%" + "c" * 300 + f"\n\n50 9 {n}\n" + body, rows


def _summed(rows):
    out = {}
    for a, b, v in rows:
        out[(a, b)] = out.get((a, b), 0) + v
    return out


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_triplets_in_ranges(spark, tmp_path, split):
    folder = tmp_path / "m"
    folder.mkdir()
    want = {}
    for name, n, end in (("a.mtx", 40, "\n"), ("b.mtx", 25, "")):
        text, rows = _triplet_text(n, len(name) + n, end)
        (folder / name).write_text(text)
        want[name] = _summed(rows)
    text, rows = _triplet_text(30, 9)
    (folder / "c.mtx.gz").write_bytes(gzip.compress(text.encode()))
    want["c.mtx.gz"] = _summed(rows)
    (folder / "d.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 2\n1 2\n% a remark\n2 1\n")
    want["d.mtx"] = {(1, 2): 1.0, (2, 1): 1.0}
    (folder / "e.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 3 0\n")
    (folder / "_SUCCESS").write_text("")
    got = {}
    for r in TR.read_triplets(spark, str(folder), split).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], {})[(r["gene_row"], r["barcode"])] = r["value"]
    assert got == want


def test_triplets_by_name(spark, tmp_path):
    TR.register(spark)
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 3\n2 2 4\n")
    df = spark.read.format("triplets").load(f"file://{tmp_path}/a.mtx")
    assert sorted((r["gene_row"], r["barcode"], r["value"]) for r in df.collect()) == [(1, 1, 3.0), (2, 2, 4.0)]
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 3\n2 2\n")
    with pytest.raises(Exception, match="fields"):
        spark.read.format("triplets").load(str(tmp_path / "bad.mtx")).collect()
    with pytest.raises(Exception, match="absent"):
        spark.read.format("triplets").load(str(tmp_path / "absent.mtx")).collect()


def test_text_reader_finds_sizes_in_later_blocks(spark, tmp_path):
    """Comments longer than a block: the line of sizes is the first one by place in the file, whichever task reads it."""
    text, rows = _triplet_text(60, 3)
    (tmp_path / "a.mtx").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        got = {(r["gene_row"], r["barcode"]): r["value"] for r in R.read_mtx(spark, str(tmp_path / "a.mtx")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == _summed(rows)


def test_mean_vectors(spark):
    rows = [(i, "a", float(i % 3), float(i), float(i % 2)) for i in range(12)] + [(20 + i, "b", float(i), 1.0, 0.0) for i in range(12)] + [(50, None, 1.0, 1.0, 0.0), (51, "a", None, 1.0, 0.0)]
    cells = spark.createDataFrame(rows, "cell_id int, donor string, t double, value double, unsafe double")
    expr = spark.createDataFrame([(0, "G1", 4.0), (3, "G1", 8.0), (1, "G2", 2.0), (20, "G1", 9.0), (51, "G1", 9.0)], "cell_id int, gene string, value double")
    points, vectors = T.mean_vectors(expr, cells)
    assert {(r["donor"], r["t"], r["n"]) for r in points.collect()} == {("a", 0.0, 4), ("a", 1.0, 4), ("a", 2.0, 4)}
    assert {(r["t"], r["gene"], r["value"]) for r in vectors.collect()} == {(0.0, "G1", 3.0), (1.0, "G2", 0.5)}
    got = {(r["t_i"], r["t_j"]): (r["distance"], r["cosine"]) for r in T.vector_pairs(points, vectors).collect()}
    assert got == {(0.0, 1.0): (math.sqrt(9.25), 0.0), (0.0, 2.0): (3.0, None), (1.0, 2.0): (0.5, None)}


def test_panels_that_differ(spark):
    rows = [("ref", 1, "A"), ("ref", 2, "B"), ("same", 1, "A"), ("same", 2, "B"), ("less", 1, "A"), ("more", 1, "A"), ("more", 2, "B"), ("more", 3, "C"), ("moved", 1, "B"), ("moved", 2, "A")]
    got = {r["source"]: (r["agree"], r["n_missing"], r["n_extra"], r["n_moved"]) for r in QC.panel_differences(spark.createDataFrame(rows, "source string, pos int, gene string"), "ref").collect()}
    assert got == {"ref": (True, 0, 0, 0), "same": (True, 0, 0, 0), "less": (False, 1, 0, 0), "more": (False, 0, 1, 0), "moved": (False, 0, 0, 2)}


def test_clock_as_a_function(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell_id int")
    expr = spark.createDataFrame([(1, "G", 2.0)], "cell_id int, gene string, value double")
    weights = spark.createDataFrame([("G", 3.0)], "gene string, weight double")
    ages = lambda clock: {r["cell_id"]: r["age"] for r in X.predict_age(expr, cells, clock).collect()}
    assert ages((weights, 10.0)) == {1: 16.0, 2: 10.0}
    assert ages(lambda e, c: e.select("cell_id", F.lit(5.0).alias("age"))) == {1: 5.0, 2: None}
    with pytest.raises(Exception, match="two ages"):
        ages(lambda e, c: c.select("cell_id", F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("age")))


def test_scores_without_a_range_flag_nothing(spark):
    test, calib = spark.createDataFrame([("a", 7.0), ("b", 3.0)], "g string, s double"), spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 2.0), ("b", 4.0)], "g string, s double")
    got = {r["g"]: (r["scaled"], r["threshold"]) for r in S.minmax_by_calib(test, calib, ["g"], "s", 0.5).collect()}
    assert got == {"a": (0.0, 0.5), "b": (0.5, 0.5)}


def test_met_blocks_give_k_a_query(spark, monkeypatch):
    """What the cells and buckets give is k rows of a query each, not its pairs; the rings that a query does not want are not met."""
    rng = np.random.default_rng(6)
    df = _vectors(spark, [(0, i, [float(x) for x in 100 * (i % 20) + rng.normal(size=4)]) for i in range(800)])
    queries, seen = df.withColumnsRenamed({"ref_id": "query_id", "ref_v": "v"}), []
    blocks = NB._in_blocks

    def kept(q, r, keys, block, k):
        near = blocks(q, r, keys, block, k)
        most = near.groupBy("query_id").agg(F.count("*").alias("n")).join(q.groupBy("query_id").agg(F.count("*").alias("cells")), "query_id")
        met = q.withColumn("ring", F.explode("rings")).join(r, [*keys, "ring"]).count() if "rings" in q.columns else None
        seen.append((most.filter(F.col("n") > k * F.col("cells")).count(), met))
        return near

    monkeypatch.setattr(NB, "_in_blocks", kept)
    assert NB.pivot_knn(queries, df, 3, ["label"]).count() == 2400 and NB.hashed_knn(queries, df, 3, ["label"], width=20.0).count() == 2400
    assert [s[0] for s in seen] == [0, 0] and seen[0][1] < 800 * 800 / 4

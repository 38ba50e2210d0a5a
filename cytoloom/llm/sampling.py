"""Bounded, repeatable samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .staging import Staging


def quotas(sizes: dict, n: int) -> dict:
    """How many rows of each label make n in all, spread evenly: a label that has fewer gives all, the others share the rest."""
    out, left = {}, n
    for at, label in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[label] = min(sizes[label], left // (len(sizes) - at))
        left -= out[label]
    return out


def labelled_sample(labels: DataFrame, n: int) -> DataFrame:
    """At most n rows of (doc_id, label, fold, weight), spread evenly over the labels: the lowest hashes of doc_id of each.

    weight is a label's rows over its sampled rows, scaled to a mean of 1: weighted, the sample has the labels' own shares at any size.
    Null ids and labels are left out; an id that has several rows is taken once, with the least label; an empty table gives none. Labels are few.
    Each label's rows are thinned where they lie, to about twice its share, and the lowest are taken of these without their texts.
    """
    known = labels.select("doc_id", "label").filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    hashed = known.select("doc_id", "label", F.xxhash64("doc_id").alias("h")).withColumn("u", F.pmod("h", F.lit(1 << 30)))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    wanted = {label: q for label, q in quotas(sizes, n).items() if q}
    if not wanted:
        return known.limit(0).select("doc_id", "label", F.lit(0).alias("fold"), F.lit(1.0).alias("weight"))
    bound = F.lit(None).cast("double")
    for label, q in wanted.items():
        bound = F.when(F.col("label") == F.lit(label), F.lit((2.0 * q + 200) / sizes[label] * (1 << 30))).otherwise(bound)
    near = Staging(labels.sparkSession, "sample").write(hashed.filter(F.col("u") <= bound), "near")
    taken = {r["label"]: min(r["n"], wanted[r["label"]]) for r in near.groupBy("label").agg(F.count("*").alias("n")).collect()}
    mean = sum(sizes[x] for x in taken) / max(1, sum(taken.values()))
    parts = [
        near.filter(F.col("label") == F.lit(label)).orderBy("u", "h", "doc_id").limit(q).select("doc_id", "label", F.pmod(F.xxhash64("h"), F.lit(1000)).cast("int").alias("fold"), F.lit(sizes[label] / q / mean).alias("weight"))
        for label, q in taken.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, label, fold, weight, text of the sampled ids (the sample has a bound, so it is sent to all tasks); repeated rows of an id once. Null ids are not in it; a null text stays null; other columns are left out."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

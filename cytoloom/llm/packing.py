"""Conflict-constrained best-fit packing.

Documents are packed into bins of `capacity` tokens. A bin carries two bitmaps: the sources in it (`per_source` bits each) and the
duplicate clusters in it (one bit each); a document fits where its tokens do and it conflicts with neither, so no bin has two
copies of one text, or more than `per_source` documents of a source. Documents come by size, largest first. Bins are ordered by what
is left in them: the search begins at the smallest remainder that holds the document and goes on to its successors until a
compatible bin, which is the tightest one, is found; else a bin is opened. A document longer than a bin is cut
into full bins of its own and a rest, which is packed like any other; nothing is left out.

Documents are dealt to shards by a hash of the row and its number among equal rows, about `shard` each, whatever their source or cluster, so a hot source
or cluster is spread evenly and a task's work is bounded; shards are packed apart, and only ids and sizes are shuffled.

Nulls: a null text has no tokens, takes no room, and is placed like any other; a null source is one source; a null cluster conflicts with
nothing, a null doc_id is placed like any id. Repeated rows are placed each (in different bins, as copies of one text). Extra columns
are ignored; an empty table gives none. Ties of size are ordered by doc_id, ties of remainder by bin number.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .text import lower_ascii, words_of

RUN = 1000  # copies of a row that are numbered at a time
PACKED = "shard int, doc_id long, piece int, bin int, at int, n_tokens int, source string"


def pack_shard(rows: list[tuple], capacity: int, per_source: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, bin, offset, tokens) of rows (doc_id, tokens, source, cluster)."""
    sources: dict = {}
    clusters: dict = {}
    left: list[tuple[int, int]] = []  # (remainder, bin), ordered
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins = 0
    todo = []
    for i, (doc_id, n, _, _) in enumerate(rows):
        piece = 0
        while n > capacity:
            yield i, piece, bins, 0, capacity
            source_bits.append(0)
            cluster_bits.append(0)
            bins, piece, n = bins + 1, piece + 1, n - capacity
        todo.append((-n, doc_id is None, doc_id or 0, i, piece))
    for size, _, _, i, piece in sorted(todo):
        n = -size
        _, _, source, cluster = rows[i]
        s = sources.setdefault(source, len(sources)) * per_source
        mask = ((1 << per_source) - 1) << s
        c = 0 if cluster is None else 1 << clusters.setdefault(cluster, len(clusters))
        for at in range(bisect_left(left, (n, -1)), len(left)):
            remainder, b = left[at]
            if source_bits[b] & mask != mask and not cluster_bits[b] & c:
                del left[at]
                break
        else:
            remainder, b = capacity, bins
            bins += 1
            source_bits.append(0)
            cluster_bits.append(0)
        used = (source_bits[b] & mask) >> s
        source_bits[b] |= (used + 1) << s  # the next free bit: used bits are the low ones
        cluster_bits[b] |= c
        insort(left, (remainder - n, b))
        yield i, piece, b, capacity - remainder, n


def pack(sized: DataFrame, capacity: int = 2048, per_source: int = 3, shard: int = 4096) -> DataFrame:
    """shard, doc_id, piece, bin, at (offset in the bin), n_tokens, source. sized: doc_id, n_tokens, source, cluster.

    A bin is named by shard and bin.
    """
    spark = sized.sparkSession
    rows = sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("int").alias("n_tokens"), F.col("source").cast("string").alias("source"), "cluster")
    shards = max(1, -(-rows.count() // shard))
    # equal rows are counted, numbered and dealt each, so that a hot row fills no shard and the shard does not depend on the files
    equal = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
    runs = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))))
    first = F.col("run") * RUN
    each = runs.withColumn("number", F.explode(F.sequence(first, F.least(first + RUN, F.col("times")) - 1)))
    dealt = each.select(*rows.columns, F.pmod(F.xxhash64(*rows.columns, "number"), F.lit(shards)).cast("int").alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens", "source", "cluster"]).reset_index(drop=True)
        null = lambda v: None if pd.isna(v) else v
        rows = [(null(d), int(n), null(s), null(c)) for d, n, s, c in zip(pdf.doc_id, pdf.n_tokens, pdf.source, pdf.cluster)]
        got = list(pack_shard(rows, capacity, per_source))
        out = pd.DataFrame(got, columns=["row", "piece", "bin", "at", "n_tokens"])
        out["doc_id"] = pdf.doc_id.to_numpy()[out.row]
        out["source"] = pdf.source.to_numpy()[out.row]
        out["shard"] = pdf.shard.iloc[0] if len(pdf) else 0
        return out[["shard", "doc_id", "piece", "bin", "at", "n_tokens", "source"]]

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "shard").groupBy("shard").applyInPandas(run, PACKED)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (words), source, cluster (a hash of the words, so that copies with other blanks or capitals are one cluster; null without words)."""
    words = docs.select("doc_id", "source", words_of(lower_ascii(F.col("text"))).alias("w"))
    return words.select("doc_id", F.size("w").alias("n_tokens"), "source", F.when(F.size("w") > 0, F.xxhash64("w")).alias("cluster"))


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    return pack(sized(docs), **how)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

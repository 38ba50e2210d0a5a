"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of every `window` consecutive ones the smallest is kept, the
rightmost on ties, with its position. Two texts that share a run of at least `k + window - 1` code points
share a kept hash. Likeness is the Jaccard index of the sets of kept hashes.

Nulls and empty texts have the empty fingerprint and likeness 1 to each other, 0 to others. A text shorter than k
is one gram; one with fewer than `window` grams keeps its smallest. Ties of doc_id are ordered by text (nulls
first), a null doc_id comes last; repeated rows each give a row. Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .text import mix64

_BASE = 0x9E3779B97F4A7C15
PREFIX = 256  # characters by which the rows of one id are parted


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all k-grams; hashes of 1, 2, 4, ... points are joined to those of k."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    power = mix64(points.astype(np.uint64) + np.uint64(1))  # hashes of the grams of `width` points
    width, done, at = 1, None, 0
    while True:
        if k & width:
            if done is None:
                done = power
            else:
                tail = power[at:]
                m = min(len(done), len(tail))
                done = done[:m] * np.uint64(pow(_BASE, width, 1 << 64)) + tail[:m]
            at += width
        if at == k:
            return mix64(done[: n - k + 1]) >> np.uint64(32)
        power = power[: len(power) - width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2


def winnow(text: str | None, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of one text, by position."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = gram_hashes(points, k)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    flipped = np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64)
    low = (grams << np.uint64(32)) | flipped  # the smallest hash, then the rightmost position
    need, have = min(window, len(grams)), 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    kept = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return kept >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_string(hashes: np.ndarray, at: np.ndarray) -> str:
    return ",".join([f"{h:08x}:{p}" for h, p in zip(hashes.tolist(), at.tolist())])


def fingerprints(docs: DataFrame, k: int = 32, window: int = 48) -> DataFrame:
    """doc_id, positions array<long>, hashes array<long>: what winnowing keeps of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [winnow(t, k, window) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[1].tolist() for g in got], pa.list_(pa.int64())), pa.array([g[0].astype(np.int64).tolist() for g in got], pa.list_(pa.int64()))],
                names=["doc_id", "positions", "hashes"],
            )

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, positions array<long>, hashes array<long>")


def cuts_within(slim: DataFrame, hot: dict[int | None, int], size: int) -> dict[int | None, list[str]]:
    """Where the rows of an id that has more than a block's are cut further: quantiles of the first `PREFIX` characters of a sample of its texts, about 20 a cut."""
    if not hot:
        return {}
    at = F.col("doc_id").isin([h for h in hot if h is not None])
    rows = slim.filter(at | F.col("doc_id").isNull() if None in hot else at)
    share = min(1.0, 20 / size)
    found: dict[int | None, list[str]] = {}
    for r in rows.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, PREFIX).alias("t")).sample(share, 5).toLocalIterator():  # about 20 rows for each block that they fill
        found.setdefault(r["doc_id"], []).append(r["t"])
    out = {}
    for h, texts in found.items():
        texts.sort()
        parts = -(-hot[h] // size)
        out[h] = sorted({texts[i * len(texts) // parts] for i in range(1, parts)})
    return out


def with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """The texts dealt to ranges of doc_id, one after another in descending order, each range followed by the document that comes next.

    Columns block, doc_id, text, ghost: a ghost is that next document, there only to be looked at. A range's bounds come from
    quantiles of doc_id; an id (or the null id) of more rows than a range should have is a range of its own and is cut further by text, as ties are ordered by it. So a task gets
    a bounded share however ids are spread, but for texts of one id that agree in their first `PREFIX` characters. Texts are shuffled once.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = slim.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)], 100 * blocks).alias("q")).first()["q"] if blocks > 1 else []
    size = max(1, -(-docs.count() // blocks))
    hot = {r["doc_id"]: r["count"] for r in ids.groupBy("doc_id").count().filter(F.col("count") > size).collect()}  # fewer than blocks
    inner = cuts_within(slim, hot, size)
    edges = np.array(sorted({*(cuts or []), *(x for h in hot if h is not None for x in (h - 1, h))}), np.int64)
    width = 1 + max((len(c) for c in inner.values()), default=0)

    def segments(ids: pa.Array, texts: pa.Array | None) -> np.ndarray:
        block = np.searchsorted(edges, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "left") + 1
        block[ids.is_null().to_numpy(zero_copy_only=False)] = 0  # the null id comes last
        block = block.astype(np.int64) * width
        if inner:
            for i, v in enumerate(ids.to_pylist()):
                if v in inner:
                    block[i] += bisect.bisect_right(inner[v], texts[i].as_py() or "")
        return block

    def block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(segments(b.column(0), b.column(1)))], names=["doc_id", "block"])

    # the highest id of each range: as many rows as there are ranges
    seen = slim if inner else ids.withColumn("text", F.lit(""))
    tops = {r["block"]: r["top"] for r in seen.mapInArrow(block_of, "doc_id long, block long").groupBy("block").agg(F.max("doc_id").alias("top")).collect()}
    have = sorted(tops, key=lambda x: (x // width == 0, -(x // width), x % width))
    wanted: dict[int | None, list[int]] = {}  # by the id that is looked at
    first_of: dict[int, list[int]] = {}  # by the part of a hot id whose first row is
    for i, b in enumerate(have):
        after = have[(i + 1) % len(have)]
        (first_of.setdefault(after, []) if tops[after] in inner else wanted.setdefault(tops[after], [])).append(b)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            block = segments(ids, texts)
            ghosts = [(i, x) for i, v in enumerate(ids.to_pylist()) for x in wanted.get(v, ())]
            for part in set(block.tolist()) & set(first_of):
                rows = np.flatnonzero(block == part).tolist()
                least = min(rows, key=lambda i: (texts[i].is_valid, texts[i].as_py() or ""))
                ghosts += [(least, x) for x in first_of[part]]
            take = pa.array([*range(len(ids)), *(i for i, _ in ghosts)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((block, [x for _, x in ghosts])).astype(np.int64)), ids.take(take), texts.take(take), pa.array([False] * len(ids) + [True] * len(ghosts))],
                names=["block", "doc_id", "text", "ghost"],
            )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.mapInArrow(deal, "block long, doc_id long, text string, ghost boolean")
    return dealt.repartition(parts, "block").sortWithinPartitions(F.col("block"), F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def compare_with_edits(docs: DataFrame, k: int = 32, window: int = 48, blocks: int | None = None) -> DataFrame:
    """Each text's fingerprint, that of its edit, and the likenesses.

    The edit replaces a text's last third, in code points, by the beginning of the next document's text in descending doc_id
    (after the last: the first). Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint
    ("hash:position" joined by commas), near_edited, near_next.
    """
    blocks = blocks or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (block, id, text, kept) of the row before, which waits for its next
        for b in batches:
            out: list[tuple] = []
            for block, doc_id, text, ghost in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and held[0] != block:
                    held = None  # what was held is a ghost, or a further copy of one
                if held and held[4]:
                    continue
                kept = winnow(text, k, window)
                if held:
                    t, n = held[2] or "", len(held[2] or "") // 3
                    edited = t[: len(t) - n] + (text or "")[:n]
                    new = winnow(edited, k, window)
                    own = held[3]
                    out.append((held[1], len(t), hashlib.sha256(edited.encode()).hexdigest(), as_string(*own), as_string(*new), likeness(own[0], new[0]), likeness(own[0], kept[0])))
                held = (block, doc_id, text, kept, ghost)
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, blocks).mapInArrow(run, schema)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Phrase collocations by a multikey quicksort of suffix pointers.

Texts are lower-cased (A-Z), split at sentence marks and line ends into pieces and those into words. Every word begins a suffix: itself and
up to three more words of its piece. How often a phrase of up to four words occurs is how many suffixes begin with it.

A task combines equal suffixes of a slice of texts, so that a passage which is everywhere costs one entry a slice, and routes them by their leading
words: an order of all suffixes (language, then 64-bit hashes of their words) is cut at quantiles of a bounded sample into
ranges of about `route_words` suffixes. A frequent word or word pair spans as many ranges as it needs. In each range a multikey three-way quicksort
runs over pointers to the suffixes, one word a level, to a depth of four: a partition of equal words is a phrase and its size the count.
Partitions whose whole size is below `least` are abandoned. All partitions of one level of recursion are split at once, as arrays.
A range may hold only a part of the phrases that its first and last suffix begin with; their parts are given whatever their size, and added up.

A candidate (2 to 4 words, `least` times or more) is cut after its first k words: with a its count, l and r those of its parts, the score is
floor(2000000 a / (l + r)), and its lowest-scoring cut counts (ties: the smallest k). A candidate that lies inside a longer one with at least 80 % of its count is dropped.

Nulls: a null text is empty; a null language is `und`, together with texts that are so marked. A text without words gives nothing, and so does
an empty table. Very long texts are taken whole. Repeated rows count each. Ties go by count, then by phrase in byte order. Extra columns are ignored.
Two words with one 64-bit hash stop the job; another `seed` then parts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .staging import Staging
from .text import Words, mix64, small_batches

DEPTH = 4
SLICE = 1 << 23  # bytes of text that are combined at once
_MARKS = np.zeros(256, bool)
_MARKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True


def packed_bytes(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_bytes(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, size, codec="zstd", asbytes=True)


class Suffixes(Words):
    """The words of a batch of texts, parted at blanks and at marks; each begins a suffix of up to four words that ends with its piece."""

    blank = _MARKS.copy()
    blank[[0x20, 0x09]] = True

    def keys(self, seed: int) -> np.ndarray:
        """A row of hashes for each of the four places; 0 is beyond the piece."""
        h = self.hashes()
        h = np.maximum(mix64(h + np.uint64(seed)) if seed else h, np.uint64(1))
        marks = np.concatenate(([0], np.cumsum(_MARKS[self.bytes])))
        text = np.repeat(np.arange(len(self.count)), self.count)
        cut = (marks[self.start[1:]] > marks[self.end[:-1]]) | (text[1:] != text[:-1])
        piece = np.concatenate(([0], np.cumsum(cut))) if len(h) else np.zeros(0, np.int64)
        out = np.zeros((DEPTH, len(h)), np.uint64)
        for d in range(min(DEPTH, len(h))):
            n = len(h) - d
            out[d, :n] = np.where(piece[:n] == piece[d:], h[d:], np.uint64(0))
        return out


def by_language(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, pa.Array]]:
    """(lang, texts) of slices of about `limit` bytes."""
    for b in small_batches(batches, "text", limit):
        langs = b.column("lang").dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, b.column("text").take(pa.array(np.flatnonzero(code == i)))


def sampled_cuts(texts: DataFrame, sample_docs: int, route_words: int, seed: int) -> list[tuple[str, tuple[int, ...]]]:
    """(lang, four hashes) at which ranges begin: quantiles of a sample of about sample_docs texts, of which each gives 1,000 suffixes at most."""
    rate = min(1.0, sample_docs / max(texts.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in by_language(batches, SLICE):
            w = Suffixes(part)
            step = np.repeat(np.maximum(64, w.count // 1000), w.count)
            taken = w.keys(seed)[:, (np.arange(len(step)) - np.repeat(w.first[:-1], w.count)) % step == step // 2]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([len(step)]), pa.array([np.ascontiguousarray(taken.T).tobytes()], pa.binary())], names=["lang", "words", "keys"])

    words, keys = 0, []
    for r in texts.sample(rate, 7).mapInArrow(run, "lang string, words long, keys binary").toLocalIterator():  # bounded by sample_docs
        words += r["words"]
        keys += [(r["lang"], tuple(k)) for k in np.frombuffer(r["keys"], np.uint64).reshape(-1, DEPTH).tolist()]
    routes = max(1, min(round(words / rate / route_words), len(keys) // 16))
    keys.sort()
    return sorted({keys[i * len(keys) // routes] for i in range(1, routes)})


def combined(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes in order: the slice's distinct hashes (0 first), a pointer to each one's first word, codes (rows of four) into them, and how often each suffix is there."""
    hashes, at, code = np.unique(keys[0], return_index=True, return_inverse=True)
    hashes = np.concatenate((np.zeros(1, np.uint64), hashes))
    codes = np.zeros(keys.shape, np.int64)
    codes[0] = code + 1
    for d in range(1, DEPTH):
        codes[d, :-d] = np.where(keys[d, :-d] > 0, codes[0, d:], 0)
    high, low = codes[0] << 32 | codes[1], codes[2] << 32 | codes[3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
    return hashes, at, codes[:, order[new]].T, np.diff(np.append(new, len(order)))


def first_not_below(columns: np.ndarray, key: tuple[int, ...]) -> int:
    """Where key would stand in rows of ordered columns."""
    low, high = 0, columns.shape[1]
    for d, k in enumerate(key):
        part = columns[d, low:high]
        left = low + int(np.searchsorted(part, np.uint64(k), "left"))
        high = low + int(np.searchsorted(part, np.uint64(k), "right"))
        low = left
        if low == high:
            break
    return low


def routed(texts: DataFrame, cuts: list[tuple[str, tuple[int, ...]]], seed: int) -> DataFrame:
    """route, lang and packed suffixes: a row for each slice of texts and range that it has suffixes of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in by_language(batches, SLICE):
            w = Suffixes(part)
            if not len(w.start):
                continue
            hashes, at, codes, times = combined(w.keys(seed))
            columns = hashes[codes.T]
            below = sum(c[0] < lang for c in cuts)
            edges = [0, *(first_not_below(columns, c[1]) for c in cuts if c[0] == lang), len(codes)]
            rows = []
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                if a == b:
                    continue
                used, local = np.unique(codes[a:b], return_inverse=True)
                local = local.reshape(b - a, DEPTH).astype(np.uint32)
                leading = np.unique(codes[a:b, 0])
                body = np.ascontiguousarray(local.T).tobytes() + times[a:b].astype(np.int64).tobytes()
                names = b" ".join(w.bytes[w.start[j] : w.end[j]].tobytes() for j in at[leading - 1].tolist())
                rows.append((below + i, lang, b - a, hashes[used].tobytes(), packed_bytes(body), hashes[leading].tobytes(), len(names), packed_bytes(names)))
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["route", "lang", "rows", "hashes", "body", "leading", "bytes", "words"])

    return texts.mapInArrow(run, "route int, lang string, rows long, hashes binary, body binary, leading binary, bytes long, words binary")


def frequent_prefixes(keys: np.ndarray, times: np.ndarray, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, a suffix that has it, count) of the prefixes that suffixes begin with `least` times or more, by multikey three-way quicksort.

    keys: a row for each depth, 0 beyond the end. Pointers of all open partitions lie one after the other; each step splits every one of
    them around a pivot of its own, and goes on with the parts that are large enough: equal ones one word deeper.
    """
    out = []
    at = np.arange(keys.shape[1])
    size, depth = np.array([len(at)]), np.zeros(1, np.int64)
    if times.sum() < least:
        return out
    while len(size):
        first = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        key = keys[depth[part], at]
        a, b, c = key[first], key[first + size // 2], key[first + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))
        mine = pivot[part]
        side = (key >= mine).astype(np.int64) + (key > mine)
        moved = np.zeros(len(at), np.int64)
        cell = np.zeros((len(size), 3), np.int64)
        for s in range(3):
            run = np.concatenate(([0], np.cumsum(side == s)))
            cell[:, s] = run[first + size] - run[first]
            moved += np.where(side == s, run[:-1] - run[first][part], 0)
        moved += (first[:, None] + np.cumsum(cell, 1) - cell)[part, side]
        where = np.empty_like(at)
        where[moved] = at
        sizes = cell.ravel()
        ends = np.cumsum(sizes)
        sums = np.concatenate(([0], np.cumsum(times[where])))
        total = sums[ends] - sums[ends - sizes]
        level = np.repeat(depth, 3)
        equal = np.arange(len(sizes)) % 3 == 1
        large = (total >= least) & ~(equal & (np.repeat(pivot, 3) == 0))
        for d in range(DEPTH):
            here = np.flatnonzero(large & equal & (level == d))
            if len(here):
                out.append((d + 1, where[ends[here] - sizes[here]], total[here]))
        level = level + equal
        open_ = large & (level < DEPTH)
        at = where[np.repeat(open_, sizes)]
        size, depth = sizes[open_], level[open_]
    return out


def edge_prefixes(keys: np.ndarray, times: np.ndarray) -> dict[tuple[int, ...], int]:
    """The prefixes of the first and the last suffix of a range, and how often they are there."""
    out = {}
    for pick in (np.min, np.max):
        rows, key = np.arange(keys.shape[1]), []
        for d in range(DEPTH):  # towards the first or last suffix
            word = pick(keys[d, rows])
            if not word:
                break
            key.append(int(word))
            rows = rows[keys[d, rows] == word]
            out[tuple(key)] = 0
    for key in out:
        rows = np.arange(keys.shape[1])
        for d, word in enumerate(key):
            rows = rows[keys[d, rows] == np.uint64(word)]
        out[key] = int(times[rows].sum())
    return out


def counted_routes(packed: DataFrame, least: int) -> DataFrame:
    """lang, phrase (hashes), word (of phrases of one), n, from each range; a phrase without words has all words of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_lang: dict[str, list] = {}
        words: dict[str, dict[int, bytes]] = {}
        for b in batches:
            for _, lang, n, hashes, body, leading, size, names in zip(*(c.to_pylist() for c in b.columns)):
                raw = unpacked_bytes(body, n * (4 * DEPTH + 8))
                local = np.frombuffer(raw, np.uint32, n * DEPTH).reshape(DEPTH, n)
                by_lang.setdefault(lang, []).append((np.frombuffer(hashes, np.uint64)[local], np.frombuffer(raw, np.int64, n, 4 * DEPTH * n)))
                known = words.setdefault(lang, {})
                for h, w in zip(np.frombuffer(leading, np.uint64).tolist(), unpacked_bytes(names, size).split(b" ")):
                    if known.setdefault(h, w) != w:
                        raise ValueError(f"the words {w!r} and {known[h]!r} have one hash: take another seed")
        for lang in sorted(by_lang):
            keys = np.concatenate([k for k, _ in by_lang[lang]], axis=1)
            times = np.concatenate([t for _, t in by_lang.pop(lang)])
            edges = edge_prefixes(keys, times)
            found: list[tuple[tuple[int, ...], int]] = [((), int(times.sum())), *edges.items()]
            for depth, where, total in frequent_prefixes(keys, times, least):
                found += [(k, n) for k, n in zip(zip(*keys[:depth, where].tolist()), total.tolist()) if k not in edges]
            text = [words[lang][k[0]].decode() if len(k) == 1 else None for k, _ in found]
            phrases = np.array([x for k, _ in found for x in k], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(k) for k, _ in found)]), pa.int32()), pa.array(phrases))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), lists, pa.array(text, pa.string()), pa.array([n for _, n in found])], names=["lang", "phrase", "word", "n"])

    return packed.groupBy("route").applyInArrow(run, "lang string, phrase array<long>, word string, n long")


def frequent_phrases(docs: DataFrame, least: int = 30, route_words: int = 1_000_000, sample_docs: int = 20_000, seed: int = 0) -> DataFrame:
    """lang, phrase (hashes of its words), word (of phrases of one), n: the phrases of one to four words that are there `least` times, and one empty phrase a language with all its words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sampled_cuts(texts, sample_docs, route_words, seed)
    parts = counted_routes(routed(texts, cuts, seed), least)
    added = parts.groupBy("lang", "phrase").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n"))
    one = F.when(F.col("word") == F.col("other"), F.col("word")).when(F.col("word").isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.lit("two words have one hash: take another seed")))
    return added.select("lang", "phrase", one.alias("word"), "n").filter(f"n >= {int(least)} OR size(phrase) = 0")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, inside_percent: int = 80, **routes: int) -> DataFrame:
    """Each language's `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    known = Staging(docs.sparkSession, "collocations").write(frequent_phrases(docs, least, **routes), "phrases")
    counts = known.select("lang", "phrase", "n")
    held = known.filter("size(phrase) > 1").select("lang", "phrase", F.col("n").alias("a"))
    cut = held.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
    cut = cut.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("right", F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k")))
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.score", "c.l", "c.r")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("phrase") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("phrase") - m + 1), lambda i: F.slice("phrase", i, m))))
    longer = held.filter("size(phrase) > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"CAST(100 AS DECIMAL(3, 0)) * CAST(longer AS DECIMAL(20, 0)) >= CAST({int(inside_percent)} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(20, 0))")
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))

    each = kept.select("lang", "phrase", F.posexplode("phrase").alias("at", "h"))
    spelt = each.join(known.filter("size(phrase) = 1").select("lang", F.col("phrase")[0].alias("h"), "word"), ["lang", "h"])
    spelt = spelt.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    named = kept.join(spelt, ["lang", "phrase"]).select("lang", F.col("text").alias("phrase"), "a", "l", "r", "score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)  # of 64 parts, so of 64 * top rows a language at most
    totals = known.filter("size(phrase) = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS n FROM spots, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, p, k, n AS a FROM f WHERE k > 1),
cuts AS (SELECT c.*, cut, l.n AS l, r.n AS r, (2000000::HUGEINT * a) // (l.n + r.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:cut] JOIN f r ON r.lang = c.lang AND r.p = c.p[cut + 1:c.k]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
longer AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer FROM (SELECT lang, p, k, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) t(m) WHERE m < k) GROUP BY ALL),
kept AS (SELECT s.lang, array_to_string(s.p, ' ') AS phrase, a, l, r, score FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.p = s.p
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""

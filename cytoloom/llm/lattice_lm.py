"""Language-model scoring by the likelihood of a subword lattice.

The pieces of a public tokenizer's vocabulary, and all single bytes, form a unigram model. A text's probability sums over
every segmentation of its words into pieces: the forward recursion, in log space, over the lattice of each word. Pieces do not
cross words, so the recursion runs once for each distinct word of the corpus, and a text adds up its words' values and
that of its end. The vocabulary's own scores (its order) give the first probabilities, p ~ 1 / (rank + 3); expectation
maximisation over all words of the training texts, weighted by their counts, fits them, until words that are held out stop gaining.

The corpus is read once. Groups of texts list their distinct words; words are counted, scored and joined back to the groups,
where they meet the texts' word counts. So what is shuffled is one row for each distinct word of a group, not for each word.

Nulls: a null text is an empty one, which is its end alone; a null doc_id is not held out. Words of any length and texts of any
length are taken whole. Ties do not arise; repeated rows count, and are scored, each. An empty table gives none. Without
training texts N and V are 0 and the vocabulary's own probabilities are used. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .language_id import held_out
from .staging import Staging
from .text import _BASE, _BYTE, Words, mix64, small_batches

GROUP = 6  # slices of text in a group: about 12 MB
LONG = 64  # bytes: words beyond it are scored one by one
LN10 = float(np.log(10))
PART = 1 << 24  # bytes of packed texts in a task of the last shuffle, about


# ---- pieces -------------------------------------------------------------------------------------------------------


def read_pieces(path: str | None = None) -> list[bytes]:
    """The vocabulary's pieces by rank, as bytes; a word's beginning is a blank. All single bytes follow."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    ranked = sorted((-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    pieces = list(dict.fromkeys(sp.id_to_piece(i).replace("▁", " ").encode() for _, i in ranked))
    return list(dict.fromkeys([*pieces, *(bytes([b]) for b in range(256))]))


def _roll(h: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return h * _BASE + _BYTE[byte]


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials, -inf where all are."""
    x = np.stack(terms)
    top = x.max(0)
    top[np.isneginf(top)] = 0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(0)) + top


@dataclass
class Pieces:
    """Pieces, their log probabilities, and a table that finds a piece by its hash."""

    pieces: list[bytes]
    logp: np.ndarray
    log_end: float = 0.0

    def __post_init__(self) -> None:
        h = np.zeros(len(self.pieces), np.uint64)
        for n in range(max(map(len, self.pieces))):
            on = np.array([i for i, p in enumerate(self.pieces) if len(p) > n])
            h[on] = _roll(h[on], np.array([self.pieces[i][n] for i in on], np.uint8))
        self.hash = mix64(h)
        self.longest = max(map(len, self.pieces))
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.pieces))
        while len(left):  # what collides in a table goes to the next
            slot = self._slot(self.hash[left], len(self.tables))
            _, at = np.unique(slot, return_index=True)
            table = np.zeros(1 << 20, np.int32)
            table[slot[at]] = left[at] + 1
            self.tables.append(table)
            left = np.delete(left, at)

    @staticmethod
    def _slot(h: np.ndarray, n: int) -> np.ndarray:
        return ((h >> np.uint64(44 - 11 * n)) & np.uint64((1 << 20) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none. A piece of a later table has a rival in each earlier one, so an empty place there ends the search."""
        h = mix64(h)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for n, table in enumerate(self.tables):
            at = table[self._slot(h[left], n)]
            left, at = left[at > 0], at[at > 0].astype(np.int64) - 1
            hit = self.hash[at] == h[left]
            out[left[hit]] = at[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def by_text(self) -> dict[bytes, int]:
        if not hasattr(self, "_index"):
            self._index = {p: i for i, p in enumerate(self.pieces)}
        return self._index

    # ---- the lattice ----

    def edges(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece that begins at each place of equally long words (rows of chars); the number of pieces where there is none."""
        h = np.zeros(chars.shape, np.uint64)
        out = []
        for n in range(1, min(chars.shape[1], self.longest) + 1):
            h = _roll(h[:, : chars.shape[1] - n + 1], chars[:, n - 1 :])
            found = self.find(h.ravel()).reshape(h.shape)
            out.append(np.where(found < 0, len(self.pieces), found))
        return out

    def forward(self, lp: list[np.ndarray], width: int) -> np.ndarray:
        """Log probability of each beginning of the words, over all its segmentations. lp: log probabilities of the edges by length."""
        a = np.full((len(lp[0]), width + 1), -np.inf)
        a[:, 0] = 0
        for j in range(1, width + 1):
            a[:, j] = _log_sum([a[:, j - n] + lp[n - 1][:, j - n] for n in range(1, min(j, len(lp)) + 1)])
        return a

    def backward(self, lp: list[np.ndarray], width: int) -> np.ndarray:
        b = np.full((len(lp[0]), width + 1), -np.inf)
        b[:, width] = 0
        for i in reversed(range(width)):
            b[:, i] = _log_sum([b[:, i + n] + lp[n - 1][:, i] for n in range(1, min(width - i, len(lp)) + 1)])
        return b

    def one(self, word: bytes, counts: np.ndarray | None = None, times: float = 0.0) -> float:
        """The same for one long word, with a dictionary; adds expected counts of pieces if asked."""
        index, n = self.by_text(), len(word)
        a = np.full(n + 1, -np.inf)
        a[0] = 0
        found = [(i, j, index[word[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + self.longest) + 1) if word[i:j] in index]
        for i, j, k in found:
            a[j] = np.logaddexp(a[j], a[i] + self.logp[k])
        if counts is not None:
            b = np.full(n + 1, -np.inf)
            b[n] = 0
            for i, j, k in reversed(found):
                b[i] = np.logaddexp(b[i], b[j] + self.logp[k])
            for i, j, k in found:
                counts[k] += times * np.exp(a[i] + self.logp[k] + b[j] - a[n])
        return float(a[n])

    def words(self, words: list[bytes], counts: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word, a blank before it; with counts, adds the expected counts of pieces, times the words' own."""
        out = np.zeros(len(words))
        size = np.array([len(w) for w in words])
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            if n + 1 > LONG:
                for r in rows.tolist():
                    out[r] = self.one(b" " + words[r], counts, 0.0 if times is None else float(times[r]))
                continue
            chars = np.frombuffer(b"".join(b" " + words[r] for r in rows.tolist()), np.uint8).reshape(len(rows), n + 1)
            edges = self.edges(chars)
            table = np.append(self.logp, -np.inf)
            lp = [table[e] for e in edges]
            a = self.forward(lp, n + 1)
            out[rows] = a[:, n + 1]
            if counts is not None:
                b = self.backward(lp, n + 1)
                times_of = times[rows][:, None]
                for k, (piece, p) in enumerate(zip(edges, lp), 1):
                    on = piece < len(counts)
                    weight = (a[:, : n + 2 - k] + p + b[:, k:] - a[:, n + 1 :])[on]
                    counts += np.bincount(piece[on], np.broadcast_to(times_of, piece.shape)[on] * np.exp(weight), len(counts))
        return out


def from_ranks(pieces: list[bytes]) -> np.ndarray:
    """Log probabilities by rank; single bytes that are no piece of the vocabulary stand at its end."""
    p = 1 / (np.arange(len(pieces)) + 3.0)
    return np.log(p / p.sum())


def re_estimated(lexicon: DataFrame, first: Pieces, ends: int, prior: float = 100.0, most: int = 4, gain: float = 0.005) -> tuple[Pieces, list[float]]:
    """(the pieces with their fitted probabilities, mean log10 probability of a held-out word before each step).

    Expectation maximisation over (word, c); the end of a text is one more symbol. The vocabulary's own probabilities count as
    `prior` pieces. A tenth of the words, by hash, is held out: steps go on until these gain less than the share `gain`, or to `most` steps; the
    last one counts the held-out words too.
    """
    spark = lexicon.sparkSession
    words = lexicon.filter("c > 0").select("word", "c", (F.pmod(F.xxhash64("word"), F.lit(10)) == 0).alias("out"))

    def step(now: Pieces) -> tuple[np.ndarray, float, float]:
        """(expected counts of the words kept and held out, log probability and number of those held out)."""
        sent = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, total, n = np.zeros((2, len(sent.value.pieces))), 0.0, 0.0
            for b in batches:
                out = b.column("out").to_numpy(zero_copy_only=False).astype(bool)
                for held, part in ((0, b.filter(pa.array(~out))), (1, b.filter(pa.array(out)))):
                    c = part.column("c").to_numpy().astype(float)
                    logp = sent.value.words([w.encode() for w in part.column("word").to_pylist()], counts[held], c)
                    if held:
                        total, n = total + float(c @ logp), n + float(c.sum())
            part, at = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(part, [2, 3])), pa.array(np.append(at, [0, 0])), pa.array(np.append(counts[part, at], [total, n]))], names=["part", "piece", "n"])

        got = words.mapInArrow(run, "part long, piece long, n double").groupBy("part", "piece").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros((4, len(now.pieces)))
        table[got.part.to_numpy(dtype=np.int64), got.piece.to_numpy(dtype=np.int64)] = got.n.to_numpy(dtype=float)
        return table[:2], float(table[2, 0]), float(table[3, 0])

    def fitted(counts: np.ndarray) -> Pieces:
        n = prior * np.exp(first.logp) + counts
        total = n.sum() + max(ends, 1)
        return Pieces(first.pieces, np.log(n / total), float(np.log(max(ends, 1) / total)))

    now, seen = first, []
    while True:
        counts, logp, n = step(now)
        seen.append(logp / LN10 / max(n, 1.0))
        if len(seen) == most or (len(seen) > 1 and seen[-1] - seen[-2] < gain * abs(seen[-2])):
            return fitted(counts.sum(0)), seen
        now = fitted(counts[0])


# ---- the corpus ---------------------------------------------------------------------------------------------------


def _pack(x: np.ndarray) -> bytes:
    wide = len(x) and x.max() > 0xFFFF
    return (b"\1" + x.astype(np.uint32).tobytes()) if wide else (b"\0" + x.astype(np.uint16).tobytes())


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint32 if x[0] else np.uint16, offset=1).astype(np.int64)


GROUPED = "grp long, lid int, word string, n long, doc_id long, held_out boolean, n_tokens long, ids binary, counts binary"


def _group(batches: list[pa.RecordBatch], gid: int) -> Iterator[pa.RecordBatch]:
    """A group's distinct words with their counts in training texts, then its texts as counts of these words."""
    parts = [Words(b.column("text")) for b in batches]
    hashes = np.concatenate([p.hashes() for p in parts])
    count = np.concatenate([p.count for p in parts])
    held = np.concatenate([b.column("held_out").to_numpy(zero_copy_only=False) for b in batches]).astype(bool)
    text = np.repeat(np.arange(len(count)), count)
    words, at, lid = np.unique(hashes, return_index=True, return_inverse=True)
    train = np.bincount(lid, ~held[text], len(words)).astype(np.int64)
    starts = np.cumsum([0, *(len(p.start) for p in parts)])
    part = np.searchsorted(starts, at, "right") - 1
    names = [parts[p].text(i - starts[p]) for p, i in zip(part.tolist(), at.tolist())]
    none = lambda n, t: pa.nulls(n, t)
    n = len(words)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, gid)), pa.array(np.arange(n, dtype=np.int32)), pa.array(names, pa.string()), pa.array(train), none(n, pa.int64()), none(n, pa.bool_()), none(n, pa.int64()), none(n, pa.binary()), none(n, pa.binary())],
        names=["grp", "lid", "word", "n", "doc_id", "held_out", "n_tokens", "ids", "counts"],
    )
    key, times = np.unique(text * (n + 1) + lid, return_counts=True)
    edge = np.searchsorted(key, np.arange(len(count) + 1) * (n + 1))
    key = key % (n + 1) if n else key
    ids = [_pack(np.diff(key[a:b], prepend=0)) for a, b in zip(edge[:-1], edge[1:])]
    counts = [_pack(times[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    m = len(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, gid)), none(m, pa.int32()), none(m, pa.string()), none(m, pa.int64()), pa.chunked_array([b.column("doc_id") for b in batches]).combine_chunks(), pa.array(held), pa.array(count + 1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
        names=["grp", "lid", "word", "n", "doc_id", "held_out", "n_tokens", "ids", "counts"],
    )


def grouped_words(docs: DataFrame) -> DataFrame:
    """docs: doc_id, held_out, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        gid = TaskContext.get().partitionId() << 32
        for b in small_batches(batches):
            held.append(b)
            if len(held) == GROUP:
                yield from _group(held, gid)
                held, gid = [], gid + 1
        if held:
            yield from _group(held, gid)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, GROUPED)


def score(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs: doc_id, held_out, text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    staging = Staging(spark, "lattice-lm")
    seen = staging.write(grouped_words(docs), "words")
    words, texts = seen.filter("word IS NOT NULL"), seen.filter("word IS NULL")
    train = ~F.col("held_out")
    totals = texts.agg(
        F.coalesce(F.sum(F.when(train, F.col("n_tokens"))), F.lit(0)).alias("n"), F.count_if(train).alias("ends"), F.coalesce(F.sum(F.octet_length("ids") + F.octet_length("counts") + 64), F.lit(0)).alias("bytes")
    ).first()
    lexicon = staging.write(words.groupBy("word").agg(F.sum("n").alias("c")), "lexicon")
    n, ends = totals["n"], totals["ends"]
    v = lexicon.filter("c > 0").count() + (ends > 0)
    first = Pieces(pieces := read_pieces(vocabulary), from_ranks(pieces))
    fitted, _ = re_estimated(lexicon, first, ends)
    sent = spark.sparkContext.broadcast(fitted)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = sent.value.words([w.encode() for w in b.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(got)], names=["word", "c", "logp"])

    scored = lexicon.mapInArrow(likelihood, "word string, c long, logp double")
    back = words.select("grp", "lid", "word").join(scored, "word").select("grp", "lid", "c", "logp", *(F.lit(None).cast(t).alias(c) for c, t in TEXT))
    rows = back.unionByName(texts.select("grp", F.lit(None).cast("int").alias("lid"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("logp"), *(c for c, _ in TEXT)))
    met = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), totals["bytes"] // PART), "grp").sortWithinPartitions(F.col("grp"), F.col("lid").asc_nulls_last())
    unseen = float(np.log10(1 / (n + v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_end = sent.value.log_end
        gid, held, c, logp = None, [], np.zeros(0), np.zeros(0)
        for b in batches:
            groups = b.column("grp").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                if groups[i] != gid:
                    gid, held, c, logp = groups[i], [], np.zeros(0), np.zeros(0)
                listed = part.num_rows - part.column("lid").null_count  # a group's words come first
                if listed:
                    held.append((part.column("c").slice(0, listed).to_numpy(), part.column("logp").slice(0, listed).to_numpy()))
                if listed == part.num_rows:
                    continue
                if held:
                    c, logp = np.concatenate([c, *(h[0] for h in held)]), np.concatenate([logp, *(h[1] for h in held)])
                    held = []
                base = np.log10(c + 1) + unseen
                part = part.slice(listed)
                known, bases, scores = [], [], []
                for ids, counts in zip(part.column("ids").to_pylist(), part.column("counts").to_pylist()):
                    at, k = np.cumsum(_unpack(ids)), _unpack(counts)
                    known.append(int(k[c[at] > 0].sum()) + (ends > 0))
                    bases.append(float(k @ base[at]) + float(np.log10(ends + 1)) + unseen)
                    scores.append((float(k @ logp[at]) + log_end) / LN10)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), part.column("n_tokens"), pa.array(known, pa.int64()), pa.array(np.full(len(known), n, np.int64)), pa.array(bases, pa.float64()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return met.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


TEXT = (("doc_id", "long"), ("held_out", "boolean"), ("n_tokens", "long"), ("ids", "binary"), ("counts", "binary"))


def op6_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", held_out(7, 2).alias("held_out"), "text"))

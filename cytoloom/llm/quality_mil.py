"""Quality classifier by attention over passages (multiple-instance learning).

A text is a bag of passages of 50 words. Each passage is encoded: shares of kinds of bytes, word shape, repetition
inside the passage, inside the text and of whole lines, then a dense layer. Gated attention, learned from document labels alone,
weighs the passages; the weighted sum of their encodings is scored. The network (a few thousand weights) is trained on
at most `max_train` labelled texts, whole, of at most `max_passages` passages together, spread evenly over the labels and weighed back to the labels' shares.

Nulls: a null text is an empty one, which is a single passage of zeros; a null label or doc_id is not learned from. Very
long texts are bags of many passages, encoded in bounded slices of a batch; ties do not matter; repeated rows each give a row. With no
labelled row, or rows of one label only, the score is that label's share (1/2 without any). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .language_id import held_out
from .sampling import labelled_sample, sample_texts
from .staging import Staging
from .text import Words, _windows, small_batches, string_bytes

PASSAGE = 50
#: bytes of one kind, in the order of the features
KINDS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", *(bytes([c]) for c in b"!?.,;:'\"()[]{}#*$%&|<>@/\\-_=+~^`"), bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
_KIND = np.full(256, len(KINDS), np.int64)
for _i, _b in enumerate(KINDS):
    _KIND[list(_b)] = _i
WIDTH = len(KINDS) + 1 + 8


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, first passage of every text and one past the last)."""
    raw, off = string_bytes(texts)
    words = Words(texts, fold=False)
    folded = Words(texts)
    hashes = folded.hashes()
    n_texts, count = len(words.count), words.count
    pieces = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate(([0], np.cumsum(pieces)))
    total = int(first[-1])
    text_of_word = np.repeat(np.arange(n_texts), count)
    rank = np.arange(len(words.start)) - words.first[:-1][text_of_word]
    of_word = first[:-1][text_of_word] + rank // PASSAGE
    step = np.zeros(len(raw) + 1, np.int64)  # bytes belong to the passage of the last word begun in their text
    lead = off[:-1][np.diff(off) > 0]
    step[lead] = first[:-1][np.diff(off) > 0]
    heads = np.flatnonzero((rank % PASSAGE == 0) & (rank > 0))
    step[words.start[heads]] = of_word[heads]
    of_byte = np.maximum.accumulate(step[:-1])
    out = np.zeros((total, WIDTH))
    k = len(KINDS) + 1
    by_kind = np.bincount(of_byte * k + _KIND[raw], minlength=total * k).reshape(total, k)
    size = np.maximum(by_kind.sum(1), 1)
    out[:, :k] = by_kind / size[:, None]
    n = np.maximum(np.bincount(of_word, minlength=total), 1)
    length = words.end - words.start
    mean = np.bincount(of_word, length, total) / n
    out[:, k] = mean / 10
    out[:, k + 1] = np.sqrt(np.maximum(np.bincount(of_word, length.astype(float) ** 2, total) / n - mean**2, 0)) / 10
    seen, again = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    for a, c in zip(words.first.tolist(), count.tolist()):
        if c > 1:
            _, at = np.unique(hashes[a : a + c], return_index=True)
            seen[a : a + c] = True
            seen[a + at] = False
        if c > 5:
            w = _windows(hashes[a : a + c], 5)
            _, at = np.unique(w, return_index=True)
            again[a : a + len(w)] = True
            again[a + at] = False
    share = lambda flag: np.bincount(of_word, flag, total) / n
    out[:, k + 2] = share(seen)
    out[:, k + 3] = share(again)
    upper = np.concatenate(([0], np.cumsum(_KIND[raw] == 0)))
    out[:, k + 4] = share((upper[words.end] - upper[words.start]) * 2 > length)
    odd = np.concatenate(([0], np.cumsum((_KIND[raw] >= 6) & (_KIND[raw] < k - 3))))
    out[:, k + 5] = share((odd[words.end] - odd[words.start]) >= 2)
    out[:, k + 6] = share(odd[words.end] - odd[words.start] == length)
    out[:, k + 7] = np.log1p(np.repeat(count, pieces)) / 10
    return out, first


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale).clip(-6, 6) @ self.parts["W"] + self.parts["wb"])

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probabilities of the bags that begin at first[:-1], and what the gradient needs."""
        p = self.parts
        h = self.encode(x)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        top = np.maximum.reduceat(e, first[:-1])
        w = np.exp(e - top[bag])
        w /= np.add.reduceat(w, first[:-1])[bag]
        z = np.add.reduceat(h * w[:, None], first[:-1])
        return 1 / (1 + np.exp(-(z @ p["c"] + p["b"]))), (h, t, g, w, z, bag)


def train(bags: list[np.ndarray], y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, weight: np.ndarray | None = None) -> Network:
    """Adam on the weighted cross-entropy of the document labels; seeded."""
    weight = np.ones(len(bags)) if weight is None else weight
    r = np.random.default_rng(0)
    rows = np.concatenate(bags)
    mean, scale = rows.mean(0), rows.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    init = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
    net = Network(mean, scale, {"W": init(WIDTH, hidden), "wb": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "a": init(gate), "c": init(hidden), "b": np.zeros(())})
    m = {k: np.zeros_like(v) for k, v in net.parts.items()}
    s = {k: np.zeros_like(v) for k, v in net.parts.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            x = np.concatenate([bags[i] for i in pick])
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in pick])))
            prob, (h, t, g, w, z, bag) = net.forward(x, first)
            p = net.parts
            d = (prob - y[pick]) * weight[pick] / len(pick)
            dz = d[:, None] * p["c"]
            dw = np.einsum("ij,ij->i", h, dz[bag])
            de = w * (dw - np.add.reduceat(w * dw, first[:-1])[bag])
            dtg = de[:, None] * p["a"]
            dv, du = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = w[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
            dn = dh * (1 - h * h)
            xn = ((x - mean) / scale).clip(-6, 6)
            grad = {"W": xn.T @ dn, "wb": dn.sum(0), "V": h.T @ dv, "U": h.T @ du, "a": (t * g).T @ de, "c": z.T @ d, "b": d.sum()}
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in p:
                q = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                s[k] = 0.999 * s[k] + 0.001 * q * q
                p[k] = p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 3000, max_passages: int = 400_000) -> Network | float:
    """The network, or a constant share where labels have nothing to part. labels: doc_id, label (0 or 1).

    It is trained on at most `max_train` whole texts that have at most `max_passages` passages together (74 MB encoded): texts in the order of their hash, as long as they fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x, first = passages(b.column("text"))
            packed = pa.array([x[i:j].astype(np.float32).tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("fold"), b.column("weight"), pa.array(np.diff(first)), packed], names=["doc_id", "label", "fold", "weight", "n", "x"])

    texts = sample_texts(docs, labelled_sample(labels, max_train))
    kind = texts.schema["doc_id"].dataType.simpleString()
    encoded = texts.select("doc_id", F.col("label").cast("int").alias("label"), "fold", "weight", "text").mapInArrow(run, f"doc_id {kind}, label int, fold int, weight double, n long, x binary")
    bags = Staging(docs.sparkSession, "mil").write(encoded, "bags")
    sizes = bags.select("doc_id", "label", "fold", "weight", "n").toPandas().sort_values(["fold", "doc_id"])
    fits, kept = 0, []
    for n in sizes.n:
        kept.append(fits + n <= max_passages)
        fits += n if kept[-1] else 0
    chosen = sizes[np.array(kept, bool)]
    y = chosen.label.to_numpy().astype(float)
    if len(np.unique(y)) < 2:  # weights of one label are equal
        y = sizes.label.to_numpy().astype(float)
        return float(np.average(y, weights=sizes.weight)) if len(y) else 0.5
    scale = sizes.groupby("label").size() / chosen.groupby("label").size()  # what a label lost by length is weighed back
    few = bags.filter(F.col("doc_id").isin(chosen.doc_id.tolist())) if len(chosen) < len(sizes) else bags
    sample = few.select("doc_id", "label", "weight", "x").toPandas().sort_values("doc_id")
    weight = sample.weight.to_numpy() * sample.label.map(scale).to_numpy()
    return train([np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for x in sample.x], sample.label.to_numpy().astype(float), weight=weight)


def score(docs: DataFrame, net: Network | float, threshold: float = 0.7) -> DataFrame:
    """docs' columns but text, and score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for b in small_batches(batches):
            if isinstance(net, float):
                p = np.full(b.num_rows, net)
            else:
                p, _ = net.forward(*passages(b.column("text")))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*rest, "score", "predicted"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def op5_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    out = held_out(4, 2)
    net = fit(docs, labels.filter(~out))
    return score(docs.select("doc_id", out.alias("held_out"), "text"), net)

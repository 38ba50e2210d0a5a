"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are the 1- to 3-grams of the lower-cased letters of the whole text (other characters part words), hashed to
2**15 places, weighted by term frequency times inverse document frequency and scaled to length 1. Document frequencies
are counted over all training texts. The weights are fitted by follow-the-regularised-leader with elastic-net
penalties on at most `max_train` labelled texts, spread evenly over the labels; a fifth of these is held back to fit the
temperature that calibrates the probabilities.

Nulls: a null text, or one without a letter, is `und` with score 0; a row with null lang is not learned from, and one with
a null doc_id is neither sampled nor held out. Empty and very long texts need no special care; ties go to the first label in
order; repeated rows each give a row. Without any labelled row all are `und`. Extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .sampling import labelled_sample, sample_texts
from .text import mix64, mod_of_id, small_batches, string_bytes

PLACES = 1 << 15
ORDERS = (1, 2, 3)
_FOLDED: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Code point to lower-cased code point if it is a letter, to 0 if not."""
    if not _FOLDED:
        _FOLDED.append(np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(sys.maxunicode + 1)], np.uint32))
    return _FOLDED[0]


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, counts) of each text's n-grams; both empty if it has no letter."""
    raw, off = string_bytes(texts)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[off]
    table = _folding()
    folded = table[points]
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
        f = folded[a:b]
        letter = f > 0
        if not letter.any():
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one blank after each word
        x = np.concatenate(([0], f[keep], [0])).astype(np.uint64) + np.uint64(1)
        total = np.zeros(PLACES, np.int64)
        h = x
        for n in ORDERS:
            if n > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + x[n - 1 :]
            total += np.bincount((mix64(h + np.uint64(n << 56)) >> np.uint64(49)).astype(np.int64), minlength=PLACES)
        at = np.flatnonzero(total)
        yield at, total[at].astype(float)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # places x langs, document frequencies' weights included
    idf: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.sum((n * self.idf[at]) ** 2)) or 1.0
        return (n / norm) @ self.weights[at] + self.bias


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each place; counted over all rows, collected as one number a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(PLACES, np.int64), 0
        for b in small_batches(batches):
            for at, _ in grams(b.column("text")):
                df[at] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["place", "n"])

    got = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(PLACES)
    real = got[got.place >= 0]
    df[real.place.to_numpy()] = real.n.to_numpy()
    return df, int(got[got.place < 0].n.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader, proximal, with per-coordinate rates; (weights, bias) of the softmax regression."""
    z, n = np.zeros((PLACES + 1, k)), np.zeros((PLACES + 1, k))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    weight = np.ones(len(rows)) if weight is None else weight
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, x = rows[i]
            w = weights(at)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = weight[i] * x[:, None] * p[None, :]
            gg = g * g
            old = n[at]
            z[at] += g - (np.sqrt(old + gg) - np.sqrt(old)) / alpha * w
            n[at] = old + gg
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The temperature with the least negative log-likelihood: a search over a grid of logarithms, refined once.

    Targets are smoothed by one pseudo-row, so that a sample without errors does not drive the temperature to 0.
    """
    if not len(labels) or logits.shape[1] < 2:
        return 1.0
    n, k = logits.shape
    eps = 1 / (n + k)
    target = np.full((n, k), eps / (k - 1))
    target[np.arange(n), labels] = 1 - eps

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float(np.average(np.log(np.exp(x).sum(1)) - (target * x).sum(1), weights=weight))

    best = min(np.exp(np.linspace(-4, 3, 71)), key=loss)
    return float(min(best * np.exp(np.linspace(-0.1, 0.1, 21)), key=loss))


def fit(train: DataFrame, max_train: int = 3000, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.001, l2: float = 0.001, epochs: int = 4) -> Model | None:
    """Fits on rows of (doc_id, text, label); None without any."""
    known = train.filter("label IS NOT NULL")
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            got = list(grams(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), b.column("fold"), b.column("weight"), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in got], pa.binary())],
                names=["doc_id", "label", "fold", "weight", "at", "n"],
            )

    texts = sample_texts(known, labelled_sample(known, max_train))
    kind = texts.schema["doc_id"].dataType.simpleString()
    sample = texts.select("doc_id", "label", "fold", "weight", "text").mapInArrow(run, f"doc_id {kind}, label string, fold int, weight double, at binary, n binary").toPandas().sort_values("doc_id")
    langs = sorted(sample.label.unique())
    if not langs:
        return None
    rows, y = [], []
    for label, at, c in zip(sample.label, sample["at"], sample.n):
        at = np.frombuffer(at, np.int32).astype(np.int64)
        x = np.frombuffer(c, np.float32) * idf[at]
        norm = np.sqrt(np.sum(x * x)) or 1.0
        rows.append((np.append(at, PLACES), np.append(x / norm, 1.0)))
        y.append(langs.index(label))
    y, held, weight = np.array(y), sample.fold.to_numpy() < 200, sample.weight.to_numpy()
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    learn = np.flatnonzero(~held)
    weights, bias = ftrl([rows[i] for i in learn], y[learn], len(langs), alpha, beta, l1, l2, epochs, weight[learn])
    model = Model(langs, weights * idf[:, None], idf, bias)
    back = np.flatnonzero(held)
    logits = np.array([rows[i][1][:-1] @ weights[rows[i][0][:-1]] + bias for i in back]).reshape(len(back), len(langs))
    model.temperature = temperature(logits, y[back], weight[back])
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score more (the probability of the language predicted)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in small_batches(batches):
            langs, scores = [], []
            for at, n in grams(b.column("text")):
                if m is None or not len(at):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                x = m.logits(at, n) / m.temperature
                p = np.exp(x - x.max())
                langs.append(m.langs[int(np.argmax(p))])
                scores.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(m: int, rest: int) -> Column:
    return F.coalesce(mod_of_id(F.col("doc_id"), m) == rest, F.lit(False))


def identify(docs: DataFrame, fold: Column | None = None, max_train: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns from the rows that are not held out."""
    out = held_out(4, 2) if fold is None else fold
    model = fit(docs.filter(~out).select("doc_id", "text", F.col("lang").alias("label")), max_train)
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.4, max_train: int = 3000) -> DataFrame:
    """The documents whose language is known with a probability of `least`; others (no letters, or no clear language) go. Columns stay."""
    model = fit(docs.select("doc_id", "text", F.col("lang").alias("label")), max_train)
    slim = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return predict(slim, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of lexicon words, plain and obfuscated (digits and signs for letters, dots or stars
between them, letters drawn out), how near they are to a second-person word, capitals, punctuation, rates of
obfuscated spelling. The lexicon has a listed part and a learned one: words and word beginnings that stand out in toxic training
texts. At most `max_train` labelled texts, spread evenly over the labels, are learned from, in three parts: one for the
lexicon, one for the trees, one for the calibration.

Nulls: a null text is an empty one; a null label or doc_id is not learned from. Empty texts score as texts without any sign of
toxicity; very long ones are taken whole; repeated rows each give a row. Without rows of both labels the score is the share of
label 1 (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from .language_id import held_out
from .sampling import labelled_sample, sample_texts
from .staging import Staging
from .text import _BYTE, Words, _powers, mix64, small_batches

INSULTS = """idiot idiots moron morons stupid loser losers clown scum trash pathetic worthless disgusting dumb fool garbage vermin filth
filthy imbecile jerk bastard bitch asshole retard retarded shit shitty fuck fucking fucked cunt whore slut dick pig parasite
coward liar crap freak creep hate kill die ugly
dumm dummkopf arschloch abschaum trottel versager widerlich wertlos scheisse hure schlampe schwein depp hurensohn
imbécile connard connasse salaud ordure minable débile crétin merde pute dégoûtant raclure abruti
imbécil estúpido basura escoria patético inútil asqueroso mierda puta cabrón gilipollas tonto""".split()
SECOND_PERSON = "you your yours yourself u ur youre you're du dich dir dein deine deinen ihr euch tu te toi ton ta vous votre usted ustedes tú vosotros ti".split()
NEAR = 5  # words

_LEET = np.arange(256, dtype=np.uint8)
_LEET[65:91] += 32
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _LEET[_a] = _b
_DROP = np.zeros(256, bool)
_DROP[list(b".,*_-'\"()[]{}#%&|<>?;:+=~^`/\\")] = True
_EDGE = _DROP.copy()  # what is cut from the ends of a word
_EDGE[ord("!")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
FEATURES = 18


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def plain_hashes(w: Words) -> np.ndarray:
    """Hashes of the folded words without signs at their ends."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        inside = start < end
        start[inside & _EDGE[w.bytes[np.minimum(start, len(w.bytes) - 1)]]] += 1
        inside = start < end
        end[inside & _EDGE[w.bytes[np.maximum(end - 1, 0)]]] -= 1
    w.plain = (start, np.maximum(end, start))
    return _span_hashes(w.bytes, *w.plain)


def folded_hashes(w: Words) -> np.ndarray:
    """Hashes of the words without signs at their ends, with digits and signs read as letters, other signs dropped, and drawn-out letters taken once."""
    if not hasattr(w, "plain"):
        plain_hashes(w)
    leet = _LEET[w.bytes]
    keep = ~_DROP[w.bytes]
    kept = np.flatnonzero(keep)
    twice = np.zeros(len(kept), bool)
    twice[1:] = leet[kept[1:]] == leet[kept[:-1]]
    word_of = np.zeros(len(w.bytes) + 1, np.int64)
    word_of[w.start] = 1
    word_of = np.cumsum(word_of)
    twice[1:] &= word_of[kept[1:]] == word_of[kept[:-1]]
    kept = kept[~twice]
    at = np.zeros(len(w.bytes) + 1, np.int64)
    at[kept + 1] = 1
    at = np.cumsum(at)
    start, end = w.plain
    return _span_hashes(leet[kept], at[start], at[end])


def beginnings(w: Words, n: int) -> np.ndarray:
    """Hashes of the first n bytes of the words longer than that; shorter ones give 0."""
    start, end = w.plain
    out = np.zeros(len(start), np.uint64)
    long = end - start > n
    out[long] = _span_hashes(w.bytes, start[long], start[long] + n) ^ np.uint64(n)
    return out


def _lexicon(words: list[str], how) -> np.ndarray:
    return np.unique(how(Words(pa.array(words))))


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


PREFIXES = (3, 4, 5, 6, 7, 8)


def learned_keys(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct words and word beginnings, as hashes."""
    w = Words(texts)
    sets = [plain_hashes(w), *(beginnings(w, n) for n in PREFIXES)]
    return [np.unique(np.concatenate([s[a : a + c] for s in sets])) for a, c in zip(w.first.tolist(), w.count.tolist())]


def _weights(values: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, weight = table
    if not len(keys):
        return np.zeros(len(values))
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, weight[at], 0.0)


def features(texts: pa.Array, learned: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w = Words(texts, fold=False)
    raw = w.bytes
    low = Words(texts)
    n_texts = len(low.count)
    of = np.repeat(np.arange(n_texts), low.count)
    n = np.maximum(low.count, 1)
    plain = plain_hashes(low)
    hit = _in(plain, _lexicon(INSULTS, plain_hashes))
    hidden = _in(folded_hashes(low), _lexicon(INSULTS, folded_hashes)) & ~hit
    weight = _weights(plain, learned)
    for k in PREFIXES:
        weight = np.maximum(weight, _weights(beginnings(low, k), learned))
    own = weight > 0
    sum_, top = np.bincount(of, weight, n_texts), np.zeros(n_texts)
    np.maximum.at(top, of, weight)
    you = _in(plain, _lexicon(SECOND_PERSON, plain_hashes))
    toxic = hit | hidden | own
    place = np.flatnonzero(toxic)
    yours = np.flatnonzero(you)
    near = np.zeros(len(plain), bool)
    if len(place) and len(yours):
        i = np.searchsorted(yours, place)
        for j in (np.maximum(i - 1, 0), np.minimum(i, len(yours) - 1)):
            near[place] |= (np.abs(yours[j] - place) <= NEAR) & (of[yours[j]] == of[place])
    count = lambda flag: np.bincount(of, flag, n_texts)
    edge = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[w.offsets])
    size = np.maximum(np.diff(w.offsets), 1)
    inside = np.concatenate(([0], np.cumsum(~_LETTER[raw])))
    letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    s, e = low.plain
    mixed = (inside[e] - inside[s] > 0) & (letters[e] - letters[s] > 1)
    shouted = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
    out = np.empty((n_texts, FEATURES))
    for i, x in enumerate(
        (
            np.log1p(count(hit)), 100 * count(hit) / n, np.log1p(count(hidden)), 100 * count(hidden) / n, np.log1p(sum_), 100 * sum_ / n, top, 100 * count(own) / n,
            np.log1p(count(toxic)), 100 * count(toxic) / n, np.log1p(count(near)), 100 * count(you) / n, edge((raw >= 65) & (raw <= 90)) / size,
            count((shouted[low.end] - shouted[low.start]) > 2) / n, edge(raw == 33) / size, edge(_DROP[raw]) / size, count(mixed) / n, np.log1p(low.count),
        )
    ):
        out[:, i] = x
    return out


@dataclass
class Model:
    learned: tuple[np.ndarray, np.ndarray]
    trees: object = None
    isotonic: object = None
    constant: float = 0.0


def learn_lexicon(texts: DataFrame, least: int = 3, ratio: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings found in at least `least` toxic texts, in a share `ratio` times that of other texts; their log ratios. texts: label (0 or 1), text.

    Texts are counted by word in Spark; only what stands out is collected.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = learned_keys(b.column("text"))
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            label = np.repeat(b.column("label").to_numpy(), [len(k) for k in found])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(label)], names=["key", "label"])

    size = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(1) or not size.get(0):
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = texts.select("label", "text").mapInArrow(keys, "key long, label int").filter("key <> 0").groupBy("key").agg(F.count_if(F.col("label") == 1).alias("c"), F.count_if(F.col("label") == 0).alias("d"))
    log_ratio = F.ln((F.col("c") / size[1]) / ((F.col("d") + 0.5) / size[0]))
    got = counts.filter(F.col("c") >= least).select("key", log_ratio.alias("w")).filter(F.col("w") >= float(np.log(ratio))).toPandas()
    key = got.key.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], got.w.to_numpy(float)[order]


def with_features(docs: DataFrame, learned: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs' columns but text, and features array<double>."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = features(b.column("text"), sent.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists], names=[*rest, "features"])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    return docs.mapInArrow(run, f"{fields}features array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 4000, trees: int = 15, depth: int = 3) -> Model:
    """labels: doc_id, label (0 or 1)."""
    staging = Staging(docs.sparkSession, "toxicity")
    sample = staging.write(sample_texts(docs, labelled_sample(labels, max_train)), "sample")

    counted = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counted) < 2:
        return Model((np.zeros(0, np.uint64), np.zeros(0)), constant=float(max(counted, default=0)))
    model = Model(learn_lexicon(sample.filter("fold < 450").select(F.col("label").cast("int").alias("label"), "text")))
    slim = sample.select("fold", "weight", F.col("label").cast("double").alias("label"), "text")
    ready = staging.write(with_features(slim, model.learned).coalesce(2), "features").withColumn("features", array_to_vector("features"))
    learn = ready.filter("fold >= 450 AND fold < 800") if ready.filter("fold >= 450 AND fold < 800").select("label").distinct().count() == 2 else ready
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1, maxBins=32, cacheNodeIds=False, weightCol="weight").fit(learn)
    judged = model.trees.transform(ready.filter("fold >= 800")).select("label", "weight", vector_to_array("probability")[1].alias("p"))
    if judged.isEmpty():
        judged = model.trees.transform(ready).select("label", "weight", vector_to_array("probability")[1].alias("p"))
    # one pseudo-row of each label at either end keeps the curve inside (0, 1)
    ends = docs.sparkSession.createDataFrame([(0.0, 1.0, 0.0), (1.0, 1.0, 1.0)], "label double, weight double, p double")
    model.isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score", weightCol="weight").fit(judged.unionByName(ends))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs' columns but text, and score, predicted."""
    rest = [c for c in docs.columns if c != "text"]
    if model.trees is None:
        out = docs.select(*rest, F.lit(model.constant).alias("score"))
    else:
        ready = with_features(docs, model.learned).withColumn("features", array_to_vector("features"))
        judged = model.trees.transform(ready).withColumn("p", vector_to_array("probability")[1])
        out = model.isotonic.transform(judged).select(*rest, "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    out = held_out(5, 0)
    model = fit(docs, labels.filter(~out))
    return score(docs.select("doc_id", out.alias("held_out"), "text"), model)

"""Mixing to target weights with soft membership.

A naive Bayes classifier, trained on a labelled table, gives every document a posterior over domains; a document counts in each
domain with its tokens times its posterior. Nonnegative rates (how often a document is taken) are fitted so that the expected tokens of the
domains match targets: projected gradient steps on the squared errors from rate 1. A rate is its start plus its posterior times the sum of all steps, one number a
domain, projected to zero and above; so a step is one aggregate over a narrow table of tokens and posteriors, and nothing but domain totals reaches the driver.
Steps are scaled by the inverse of the domains' Gram matrix over the rows with a rate above zero, so that domains whose posteriors overlap, and rare ones, move as fast as others; a step is
halved until the objective that it descends falls by enough. That objective is convex: its minimum has the rates of least change, weighted by tokens, that meet the targets. `met` says whether every domain's
expected tokens are within `within` of the target; where no rates can meet it, those that came nearest are given, and `met` is false.

Targets are shares of tokens; without any, the labelled table's shares to the power `temper`. The total is the least at which no domain has to
shrink, or `tokens` if given. `copies` is the rate rounded up or down by a hash of the id, so that its expectation is the rate.

Nulls: a null text has no tokens; its posterior is the prior and its rate fits no one's total. A null label, or the label of a null id or
of an id that is not among the documents, is not learned from, and is no domain if it has no other; a row with a null doc_id is rated like any other. Texts are taken whole; repeated rows count and are rated each. Without labelled rows every rate is
1. An empty table gives none. Extra columns pass through, but for those with the names of results. All of it is DataFrame functions and Spark ML.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .quality_rules import let
from .sampling import labelled_sample, sample_texts
from .staging import Staging
from .text import lower_ascii, words_of

PLACES = 1 << 14


def token_features(docs: DataFrame) -> DataFrame:
    """docs' columns, n_tokens and features: term frequencies of hashed words, scaled so that long texts do not saturate the posterior."""
    split = docs.withColumn("__words", words_of(lower_ascii(F.col("text")))).withColumn("n_tokens", F.size("__words").cast("long"))
    counted = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=PLACES).transform(split)
    return Normalizer(inputCol="__tf", outputCol="features", p=2.0).transform(counted).drop("__words", "__tf")


def posteriors(docs: DataFrame, labelled: DataFrame, max_train: int = 4000, staging: Staging | None = None) -> tuple[list[str], dict[str, float], DataFrame]:
    """(domains, their shares of the labelled rows, docs' columns but text with n_tokens and post array<double>).

    labelled: doc_id, label. The classifier is fitted on at most `max_train` rows, spread evenly over the labels; the shares become its prior again.
    """
    staging = staging or Staging(docs.sparkSession, "mixing")
    # docs' own columns travel in one, so that none clashes with a feature's
    slim = docs.select(F.struct(F.lit(0).alias("text"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_tokens", "post"))).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    plain = slim.withColumn("n_tokens", F.size(words_of(F.col("text"))).cast("long"))
    out = lambda df, post: df.select("row.*", "n_tokens", post.alias("post")).drop("text")
    sampled = staging.write(sample_texts(docs, labelled_sample(labelled, max_train)), "sample")
    each = {r["label"]: (r["n"], r["weight"]) for r in sampled.groupBy("label").agg(F.count("*").alias("n"), F.first("weight").alias("weight")).collect()}
    # only labels that the sample has can be learned: ids may be null, or not be among docs
    domains = sorted(each)
    if not domains:
        return [], {}, out(plain, F.array().cast("array<double>"))
    total = sum(n * w for n, w in each.values())
    shares = {d: each[d][0] * each[d][1] / total for d in domains}
    if len(domains) == 1:
        return domains, shares, out(plain, F.array(F.lit(1.0)))
    number = F.element_at(F.create_map(*(F.lit(x) for i, d in enumerate(domains) for x in (d, float(i)))), F.col("label"))
    model = NaiveBayes(smoothing=0.01).fit(token_features(sampled).select(number.alias("label"), "features"))
    judged = model.transform(token_features(slim)).withColumn("post", vector_to_array("probability"))
    weight = F.array(*(F.lit(shares[d] / each[d][0]) for d in domains))
    scaled = let(F.zip_with("post", weight, lambda p, w: p * w), lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), lambda t: F.transform(v, lambda x: x / t)))
    return domains, shares, out(judged, scaled)


def rate_of(moved: list[float]) -> Column:
    """The rate of a row after steps that add up to `moved`."""
    if not moved:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), 1 + F.aggregate(F.zip_with("post", F.array(*map(F.lit, moved)), lambda p, m: p * m), F.lit(0.0), lambda s, x: s + x))


def totals(soft: DataFrame, moved: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """(half the tokens times squared rates, expected tokens by domain, Gram matrix of the rows with a rate) after steps that add up to `moved`: one aggregate."""
    k = len(moved)

    def parts(x: Column) -> Column:
        pairs = F.flatten(F.transform("post", lambda p, i: F.transform(F.slice("post", i + 1, k), lambda q: p * q * x["on"])))
        return F.concat(F.array(x["n"] * x["rate"] * x["rate"] / 2), F.transform("post", lambda p: p * x["n"] * x["rate"]), pairs)

    row = F.struct(F.col("n_tokens").cast("double").alias("n"), rate_of(moved).alias("rate"))
    active = let(row, lambda x: F.struct(x["n"].alias("n"), x["rate"].alias("rate"), F.when(x["rate"] > 0, x["n"]).otherwise(0.0).alias("on")))
    sums = soft.filter("n_tokens > 0").select(array_to_vector(let(active, parts)).alias("v")).agg(Summarizer.sum(F.col("v")).alias("s")).first()["s"]
    if sums is None:
        return 0.0, np.zeros(k), np.zeros((k, k))
    sums, gram = sums.toArray(), np.zeros((k, k))
    gram[np.triu_indices(k)] = sums[1 + k :]
    return float(sums[0]), sums[1 : 1 + k], gram + np.triu(gram, 1).T


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float], tokens: float | None = None, most: int = 60, within: float = 1e-4) -> tuple[list[float], bool]:
    """(sum of the steps, by domain; whether every domain's expected tokens are within `within` of its target). `most` passes are tried, or until none lessens the objective."""
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    goal = share / share.sum()
    now = np.zeros(len(domains))
    half, have, gram = totals(soft, now.tolist())
    if not have.sum():
        return now.tolist(), False
    budget = tokens or max(h / g for h, g in zip(have, goal) if g > 0)
    want = budget * goal
    # a domain with target 0 is measured against the mean target
    scale = np.where(goal > 0, want, budget / len(domains))
    floor = 1e-12 * np.trace(gram) + 1e-9 * np.diag(gram)
    gap = lambda h: float(np.max(np.abs(h - want) / scale))
    best = (gap(have), now)
    value, left = half - want @ now, most
    while best[0] > within and left > 0:
        slope = have - want
        step = -np.linalg.solve(gram + np.diag(np.maximum(floor, 1e-300)), slope)
        part = 1.0
        while left > 0:
            tried = now + part * step
            half, got, active = totals(soft, tried.tolist())
            left -= 1
            best = min(best, (gap(got), tried), key=lambda b: b[0])
            if half - want @ tried <= value + 1e-4 * part * (slope @ step) or best[0] <= within:
                break
            part /= 4
        else:
            break
        now, have, gram, value = tried, got, active, half - want @ tried
    return best[1].tolist(), best[0] <= within


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, temper: float = 0.7, tokens: float | None = None, staging: Staging | None = None) -> DataFrame:
    """docs' columns but text, and n_tokens, domain (the likeliest), posterior (its share), rate, copies, met."""
    staging = staging or Staging(docs.sparkSession, "mixing")
    domains, shares, soft = posteriors(docs, labelled, staging=staging)
    soft = staging.write(soft, "posteriors")
    targets = targets or {d: s**temper for d, s in shares.items()}
    moved, met = fit_rates(soft, domains, targets, tokens) if domains else ([], False)
    rated = soft.withColumn("rate", rate_of(moved))
    top = F.array_max("post")
    name = F.get(F.array(*map(F.lit, domains)), F.array_position("post", top).cast("int") - 1) if domains else F.lit(None).cast("string")
    chance = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rest = [c for c in soft.columns if c not in ("n_tokens", "post", "domain", "posterior", "rate", "copies", "met")]
    return rated.select(*rest, "n_tokens", name.alias("domain"), top.alias("posterior"), "rate", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"), F.lit(met).alias("met"))


def repeat_to_mix(docs: DataFrame, label: str = "lang", **how) -> DataFrame:
    """docs with each row repeated as often as its copies say. Columns stay.

    Rows that share an id share their decision: ids are rated once, by the row with the most copies.
    """
    rates = mixed(docs.select("doc_id", "text"), docs.select("doc_id", F.col(label).cast("string").alias("label")), **how).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id")
    both = row.join(rates, F.col("doc_id").eqNullSafe(F.col("id")))
    return both.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs.select("doc_id", "source", "text"), docs.select("doc_id", F.col("lang").alias("label")))

"""The methods themselves against plain Python: batteries, cutoffs, posteriors, rates, gradients, expectation maximisation, features, calibration, layouts."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cytoloom.llm import language_id, lattice_lm, mixing, ngram_join, packing, quality_mil, sampling, secrets, toxicity
from cytoloom.llm.staging import Staging

NEEDED = "doc_id long, text string, lang string, source string"


# ---- the join's large groups ----------------------------------------------------------------------------------------


def family(rng, n, words, edits):
    text = [f"w{rng.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        copy = list(text)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randrange(50)}"
        yield " ".join(copy)


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = set()
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            links.add((a, b))
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in sets}, links


@pytest.mark.parametrize("links", [True, False])
def test_large_buckets_and_components_by_their_hub(spark, monkeypatch, links):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(5)
    texts = [t for n, w, e in ((40, 60, 2), (30, 50, 5), (25, 40, 3), (5, 30, 1)) for t in family(rng, n, w, e)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[0]) for i in range(20)]
    want, _ = brute(rows, 4, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(df, cell=5, links=links).collect()}
    assert got == want


def test_frequent_shingles_route_like_rare_ones(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, f"{passage} " + " ".join(f"t{rng.randrange(900)}" for _ in range(3))) for i in range(60)] + [(100 + i, passage + " " + " ".join(f"u{rng.randrange(900)}" for _ in range(90))) for i in range(30)]
    want, links = brute(rows, 4, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(ngram_join.frequent_shingles(df, 4, Staging(spark, "test"))[0]) >= 37
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(df).collect()} == want
    assert {tuple(r) for r in ngram_join.linked_pairs(df).collect()} == links


@pytest.mark.parametrize("wide", [False, True])
def test_overlaps_as_bitmaps_and_as_lists(wide):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60 if not wide else 100_000, int(rng.integers(1, 80)), dtype=np.uint64)) for _ in range(40)]
    if wide:
        sets += [np.unique(np.concatenate((s, s[:1] + np.uint64(1)))) for s in sets[:20]]
    sets.sort(key=len)
    for one, two in ((sets, sets), (sets[:15], sets[15:])):
        low, high = np.zeros(len(one), int), np.full(len(one), len(two))
        for x, got in zip(one, ngram_join.overlaps(one, two, low, high)):
            assert got.tolist() == [len(np.intersect1d(x, y)) for y in two] or one is two
            if one is two:
                same = [len(np.intersect1d(x, y)) for y in two]
                # a set with itself is compared with nothing else's shingles only; other pairs are exact
                assert [a for a, y in zip(got.tolist(), two) if y is not x] == [b for b, y in zip(same, two) if y is not x]


def test_names_that_clash(spark):
    cols = "doc_id long, text string, lang string, source string, id long, row string, `__gone` string, `__again` string, `__base` string, `__more` string, `__all` string, copies int, features string, label string, n_tokens int"
    rows = [(i, f"token = abcdefgh12 and some words number {i % 2} that are long enough to keep", "en", "a", i, "r", "g", "h", "b", "m", "a", 3, "f", "l", 1) for i in (1, 1, 2, 3)]
    df = spark.createDataFrame(rows, cols)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    clean = secrets.redact(df).collect()
    assert all((r["__base"], r["__more"], r["__all"], r["row"]) == ("b", "m", "a", "r") and r["text"].startswith("[assign]") for r in clean)
    again = mixing.repeat_to_mix(df)
    assert again.columns == df.columns and {r["copies"] for r in again.collect()} == {3}
    assert mixing.mixed(df, df.select("doc_id", F.col("lang").alias("label"))).count() == 4
    assert language_id.keep_identified(df, least=0.0).columns == df.columns


# ---- secrets --------------------------------------------------------------------------------------------------------


def slow_p(token, encoding):
    _, alphabet, cells = secrets.ENCODINGS[encoding]
    plain = (token.lower() if encoding in ("hex", "base36", "lower") else token).replace("_", "/").replace("-", "+")
    v = [alphabet.index(c) for c in plain]
    n, size = len(v), len(alphabet)
    ends = cells[0] if n < 48 else cells[1]
    chi = sum((sum(low <= x < end for x in v) - n * (end - low) / size) ** 2 / (n * (end - low) / size) for low, end in zip((0, *ends), ends))
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    df = len(ends) - 1
    p1 = upper(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [x >= size // 2 for x in v]
    ups = sum(high)
    runs = 1 + sum(a != b for a, b in itertools.pairwise(high))
    mean = 2 * ups * (n - ups) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    p2 = 2 * upper(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    m = sum(v) / n
    var, lag = sum((x - m) ** 2 for x in v), sum((a - m) * (b - m) for a, b in itertools.pairwise(v))
    p3 = 2 * upper(abs(lag / var) * math.sqrt(n)) if var > 0 else 0.0
    half = -sum(math.log(max(p, 1e-12)) for p in (p1, p2, p3))
    return math.exp(-half) * (1 + half + half * half / 2)


def test_the_battery_of_every_encoding(spark):
    rng = random.Random(4)
    letters = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "lower": "abcdefghijklmnopqrstuvwxyz", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}
    for name, alphabet in letters.items():
        tokens = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (20, 33, 64)] + [alphabet[2] * 24, (alphabet[:6] * 6)[:30]]
        got = [r[0] for r in spark.createDataFrame([(t,) for t in tokens], "t string").select(secrets.randomness(F.col("t"), name)).collect()]
        assert np.allclose(got, [slow_p(t, name) for t in tokens], atol=1e-6), name


def test_ordinary_strings_of_a_small_group_are_no_keys(spark):
    docs = spark.createDataFrame([(1, "x InternationalHelper7Factory y"), (2, "x com/example/internal/Helper2Impl y"), (3, "plain")], "doc_id long, text string")
    assert [r["n_random"] for r in secrets.find_secrets(docs).collect()] == [0, 0, 0]
    assert {r["text"] for r in secrets.redact(docs).collect()} == {r["text"] for r in docs.collect()}


@pytest.mark.parametrize("keys, plain", [(400, 4000), (4000, 400), (50, 50), (0, 300), (0, 60)])
def test_false_discoveries_are_bounded(keys, plain):
    shares = []
    for seed in range(12):
        rng = np.random.default_rng(seed)
        ordinary = 0.45 * rng.random(plain) ** 6  # as ordinary strings stay below one half
        p = np.concatenate((rng.random(keys), ordinary))
        n = np.bincount(np.minimum((p * secrets.BINS).astype(int), secrets.BINS - 1), minlength=secrets.BINS).tolist()
        cut = secrets.cutoff(n, secrets.plain_tail(n), 0.1, 0.001)
        above = (p >= cut).sum()
        shares.append((ordinary >= cut).sum() / above if above else 0.0)
    assert np.mean(shares) < 0.13, shares


# ---- packing --------------------------------------------------------------------------------------------------------


def test_packing_does_not_depend_on_files(spark):
    rng = random.Random(2)
    rows = [(i if i % 9 else None, "w " * rng.randint(0, 300), "en", f"s{i % 3}") for i in range(400)] + [(7, "same text", "en", "a")] * 300
    df = spark.createDataFrame(rows, NEEDED)
    cols = ["shard", "doc_id", "piece", "bin", "at", "n_tokens", "source"]
    got = [sorted(map(str, packing.pack_documents(d, capacity=200, shard=64).select(*cols).collect())) for d in (df.coalesce(1), df.repartition(7), df.repartition(3, "source"))]
    assert got[0] == got[1] == got[2] and len(got[0]) >= 700
    sizes = collections.Counter(r["shard"] for r in packing.pack_documents(df, capacity=200, shard=64).collect())
    assert max(sizes.values()) < 200  # equal rows fill no shard


# ---- mixing ---------------------------------------------------------------------------------------------------------


def test_a_label_of_a_null_id_is_no_domain(spark):
    rows = [(i, f"the words of {'english' if i % 2 else 'le francais'} text {i}", "en" if i % 2 else "fr", "a") for i in range(20)] + [(None, "der deutsche text", "de", "a")]
    df = spark.createDataFrame(rows, NEEDED)
    got = mixing.mixed(df.select("doc_id", "text"), df.select("doc_id", F.col("lang").alias("label"))).collect()
    assert len(got) == 21 and {r["domain"] for r in got} <= {"en", "fr"} and all(r["posterior"] is not None and r["rate"] >= 0 for r in got)
    lone = mixing.mixed(df.select("doc_id", "text"), df.filter("lang = 'en'").select("doc_id", F.col("lang").alias("label"))).collect()
    assert {(r["domain"], r["posterior"]) for r in lone} == {("en", 1.0)}


def test_posteriors_and_rates_match_a_small_solver(spark):
    rng = random.Random(6)
    vocabulary = {"en": ["alpha", "beta", "gamma", "shared"], "fr": ["un", "deux", "trois", "shared"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(3, 12))), lang, "a") for i, lang in enumerate(["en"] * 30 + ["fr"] * 10)]
    df = spark.createDataFrame(rows, NEEDED)
    labelled = df.select("doc_id", F.col("lang").alias("label"))
    domains, shares, soft = mixing.posteriors(df.select("doc_id", "text"), labelled)
    assert domains == ["en", "fr"] and np.allclose([shares["en"], shares["fr"]], [0.75, 0.25])
    # multinomial naive Bayes on term frequencies of unit length, smoothing 0.01, prior the labels' shares
    tf = {i: collections.Counter(t.split()) for i, t, _, _ in rows}
    unit = {i: {w: c / math.sqrt(sum(x * x for x in tf[i].values())) for w, c in tf[i].items()} for i in tf}
    total = {d: collections.Counter() for d in domains}
    for i, _, d, _ in rows:
        total[d].update(unit[i])
    logp = {d: {w: math.log((total[d][w] + 0.01) / (sum(total[d].values()) + 0.01 * mixing.PLACES)) for w in set(sum(vocabulary.values(), []))} for d in domains}
    got = {r["doc_id"]: (r["n_tokens"], r["post"]) for r in soft.collect()}
    for i in tf:
        raw = np.array([math.log(shares[d]) + sum(c * logp[d][w] for w, c in unit[i].items()) for d in domains])
        want = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
        assert np.allclose(got[i][1], want, atol=1e-4)  # the fit smooths its prior by 0.01 too
        assert got[i][0] == sum(tf[i].values())
    soft = Staging(spark, "test").write(soft)
    moved, met = mixing.fit_rates(soft, domains, {"en": 0.5, "fr": 0.5})
    t = soft.withColumn("rate", mixing.rate_of(moved)).toPandas()
    n, post = t.n_tokens.to_numpy(float), np.array(t.post.tolist())
    goal = max(n @ post / 0.5) * np.array([0.5, 0.5])
    assert met and np.allclose((n * t.rate.to_numpy()) @ post, goal, rtol=1e-4) and (t.rate >= 0).all()
    # of all rates that meet the targets, those of least change by tokens: the projection, solved here by its equations on the rows with a rate
    on = t.rate.to_numpy() > 0
    m = np.linalg.lstsq((post[on] * n[on, None]).T @ post[on], goal - (n[on] @ post[on]), rcond=None)[0]
    assert np.allclose(np.maximum(0, 1 + post @ m), t.rate, atol=1e-3)


def test_quotas_are_even():
    assert sampling.quotas({"a": 5, "b": 100, "c": 100}, 45) == {"a": 5, "b": 20, "c": 20} and sampling.quotas({"a": 3}, 10) == {"a": 3} and sampling.quotas({}, 5) == {}


# ---- quality --------------------------------------------------------------------------------------------------------


def test_attention_matches_plain_python():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(k, quality_mil.WIDTH)) for k in (1, 4, 2)]
    net = quality_mil.train(bags, np.array([0.0, 1.0, 1.0]), epochs=2)
    x, first = np.concatenate(bags), np.array([0, 1, 5, 7])
    got, _ = net.forward(x, first)
    p = net.parts
    for bag, want in zip(bags, got):
        h = np.tanh(((bag - net.mean) / net.scale).clip(-6, 6) @ p["W"] + p["wb"])
        gate = [math.exp(float((np.tanh(r @ p["V"]) / (1 + np.exp(-(r @ p["U"])))) @ p["a"])) for r in h]
        z = sum(g * r for g, r in zip(gate, h)) / sum(gate)
        assert abs(1 / (1 + math.exp(-(z @ p["c"] + p["b"]))) - want) < 1e-9


def test_attention_gradients_match_finite_differences(monkeypatch):
    """One step of Adam from zero moments moves every weight by the rate against its gradient's sign; large gradients are checked."""
    rng = np.random.default_rng(9)
    bags, y, w = [rng.normal(size=(k, quality_mil.WIDTH)) for k in (3, 1, 5, 2)], np.array([1.0, 0.0, 1.0, 0.0]), np.array([1.0, 2.0, 0.5, 1.5])
    start = quality_mil.train(bags, y, epochs=0, weight=w)
    step = quality_mil.train(bags, y, epochs=1, rate=1e-3, decay=0.0, weight=w)
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags])))

    def loss():
        prob, _ = start.forward(np.concatenate(bags), first)
        return float(np.sum(w * -(y * np.log(prob) + (1 - y) * np.log(1 - prob))) / len(y))

    for name, value in start.parts.items():
        flat = value.reshape(-1)
        for at in rng.choice(len(flat), min(6, len(flat)), replace=False):
            keep, eps = flat[at], 1e-5
            flat[at] = keep + eps
            up = loss()
            flat[at] = keep - eps
            slope = (up - loss()) / (2 * eps)
            flat[at] = keep
            if abs(slope) > 1e-4:
                moved = step.parts[name].reshape(-1)[at] - keep
                assert np.sign(moved) == -np.sign(slope) and abs(abs(moved) - 1e-3) < 1e-5, name


def test_training_is_bounded_in_passages(spark):
    rows = [(i, "good words in here " * (5 if i % 2 else 400)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    for bound in (400_000, 200, 0):
        net = quality_mil.fit(docs, labels, max_passages=bound)
        assert quality_mil.score(docs, net).filter("score BETWEEN 0 AND 1").count() == 60
    assert net == 0.5


# ---- language -------------------------------------------------------------------------------------------------------


def test_letters_by_category(spark):
    texts = ["\U000f0000\U000f0001 12", "\U000e0041\U000e0042", "\U00020000\U00020001", "Ünïcode", "１２", "ª"]
    got = [len(at) > 0 for at, _ in language_id.grams(pa.array(texts))]
    assert got == [any(c.isalpha() for c in t) for t in texts] == [False, False, True, True, False, True]


def test_follow_the_leader_matches_plain_python():
    rng = np.random.default_rng(7)
    rows = [(np.append(np.sort(rng.choice(50, 6, replace=False)), language_id.PLACES), np.append(rng.normal(size=6), 1.0)) for _ in range(15)]
    labels, weight = rng.integers(0, 3, 15), rng.uniform(0.5, 2, 15)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.01
    got, bias = language_id.ftrl(rows, labels, 3, alpha, beta, l1, l2, 2, weight)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def w(i, k):
        return 0.0 if abs(z[i, k]) <= l1 else -(z[i, k] - math.copysign(l1, z[i, k])) / ((beta + math.sqrt(n[i, k])) / alpha + l2)

    order = np.random.default_rng(0)
    for _ in range(2):
        for r in order.permutation(15).tolist():
            at, x = rows[r]
            now = {(i, k): w(i, k) for i in at.tolist() for k in range(3)}
            logit = [sum(v * now[i, k] for i, v in zip(at.tolist(), x)) for k in range(3)]
            e = [math.exp(v - max(logit)) for v in logit]
            for k in range(3):
                d = e[k] / sum(e) - (k == labels[r])
                for i, v in zip(at.tolist(), x):
                    g = weight[r] * v * d
                    z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / alpha * now[i, k]
                    n[i, k] += g * g
    want = np.array([[w(i, k) for k in range(3)] for i in range(50)])
    assert np.allclose(got[:50], want) and np.allclose(bias, [w(language_id.PLACES, k) for k in range(3)]) and (want == 0).any()


def test_n_grams_and_document_frequencies(spark):
    texts = ["ab a", "AB", "xyz 9"]
    grams = []
    for t in texts:
        padded = " " + re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in t)) + " "  # one blank after a word, and the ends
        grams.append({padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1)})
    got = [set(at.tolist()) for at, _ in language_id.grams(pa.array(texts))]
    assert [len(g) for g in got] == [len(g) for g in grams] and len(got[0] & got[1]) == len(grams[0] & grams[1])
    df, n = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert n == 3 and df.sum() == sum(map(len, grams)) and df.max() == 3  # the blank


# ---- the language model ---------------------------------------------------------------------------------------------


def test_expectation_maximisation_gains_on_held_out_words(spark):
    rng = random.Random(1)
    parts = ["ka", "lo", "mi", "ter", "sun", "ba"]
    words = collections.Counter("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(1500))
    pieces = [b" ", *(p.encode() for p in parts), b"zz", b"qq", *(bytes([c]) for c in range(256) if c != 32)]
    first = lattice_lm.Pieces(pieces, lattice_lm.from_ranks(pieces))
    lexicon = spark.createDataFrame(list(words.items()) + [("unseen", 0)], "word string, c long")
    fitted, seen = lattice_lm.re_estimated(lexicon, first, 100)
    assert len(seen) >= 2 and seen[-1] > seen[0] and all(b >= a - 1e-6 for a, b in itertools.pairwise(seen))
    # the last step, by the slow lattice: probabilities of pieces and the end make 1
    assert abs(np.exp(fitted.logp).sum() + math.exp(fitted.log_end) - 1) < 1e-9
    one, _ = lattice_lm.re_estimated(lexicon, first, 100, most=1)
    counts = np.zeros(len(pieces))
    for w, c in words.items():
        first.one(b" " + w.encode(), counts, c)
    want = 100.0 * np.exp(first.logp) + counts
    assert np.allclose(np.exp(one.logp), want / (want.sum() + 100))


def test_corpus_scores_match_the_slow_lattice(spark):
    rows = [(i, t) for i, t in enumerate(["the cat the dog", "", None, "a  cat\n" + "z" * 90, "the cat the dog"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    got = {r["doc_id"]: r["score"] for r in lattice_lm.score(docs).collect()}
    pieces = lattice_lm.read_pieces()
    counts = collections.Counter(w for _, t in rows for w in (t or "").split())
    fitted, _ = lattice_lm.re_estimated(spark.createDataFrame(list(counts.items()), "word string, c long"), lattice_lm.Pieces(pieces, lattice_lm.from_ranks(pieces)), 5)
    for i, t in rows:
        want = (sum(fitted.one(b" " + w.encode()) for w in (t or "").split()) + fitted.log_end) / math.log(10)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want))


# ---- toxicity -------------------------------------------------------------------------------------------------------


def test_features_match_plain_python():
    empty = (np.zeros(0, np.uint64), np.zeros(0))
    texts = ["You IDIOT, you are a loser!!", "A fine day.", "what an 1d10t", ""]
    f = toxicity.features(pa.array(texts), empty)
    for t, row in zip(texts, f):
        words = t.split()
        bare = [re.sub(r"^\W+|\W+$", "", w.lower()) for w in words]
        hit = [w in toxicity.INSULTS for w in bare]
        you = [w in toxicity.SECOND_PERSON for w in bare]
        near = sum(h and any(y and abs(i - j) <= toxicity.NEAR for j, y in enumerate(you)) for i, h in enumerate(hit))
        n, size = max(len(words), 1), max(len(t.encode()), 1)
        assert np.isclose(row[0], math.log1p(sum(hit))) and np.isclose(row[1], 100 * sum(hit) / n) and np.isclose(row[11], 100 * sum(you) / n)
        assert np.isclose(row[10], math.log1p(near)) and np.isclose(row[12], sum(c.isupper() for c in t) / size) and np.isclose(row[14], t.count("!") / size) and np.isclose(row[17], math.log1p(len(words)))
    assert f[2, 2] > 0 and f[2, 0] == 0


def test_the_learned_lexicon_matches_counts(spark):
    rows = [(1, "vile thing here")] * 4 + [(0, "nice thing here")] * 6 + [(0, "vile")] + [(1, "other")]
    df = spark.createDataFrame(rows, "label int, text string")
    keys, weight = toxicity.learn_lexicon(df)
    from cytoloom.llm.text import Words

    vile = toxicity.plain_hashes(Words(pa.array(["vile"])))[0]
    got = dict(zip(keys.tolist(), weight.tolist()))
    assert np.isclose(got[int(vile)], math.log((4 / 5) / (1.5 / 7))) and (np.diff(keys.astype(float)) >= 0).all()
    assert int(toxicity.plain_hashes(Words(pa.array(["thing"])))[0]) not in got
    assert len(toxicity.learn_lexicon(df.filter("label = 1"))[0]) == 0


def test_scores_rise_with_the_trees_probability(spark):
    rows = [(i, ("you idiot loser " if i % 4 == 0 else "a calm and pleasant day ") * (1 + i % 5)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("label")))
    ready = toxicity.with_features(docs, model.learned)
    from pyspark.ml.functions import array_to_vector, vector_to_array

    p = model.trees.transform(ready.withColumn("features", array_to_vector("features"))).select("doc_id", vector_to_array("probability")[1].alias("p"))
    t = toxicity.score(docs, model).join(p, "doc_id").orderBy("p").toPandas()
    assert (np.diff(t.score) >= -1e-12).all() and ((t.score >= 0.5) == (t.doc_id % 4 == 0)).all()


# ---- the pipeline ---------------------------------------------------------------------------------------------------

EDGES = [(1, None, "en", "a"), (2, "", None, None), (3, "one two three four five six", "en", "a"), (3, "one two three four five six", "en", "a"), (None, "no id here at all in this text", "de", "b"), (4, "é " * 30000, "fr", "b"), (5, "12 ?? 34", "fr", "b")]


def test_pipeline_of_edge_rows(spark):
    cols = NEEDED + ", row string, score double"
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in EDGES], cols)
    for rows in (docs, docs.limit(0)):
        staging, now = Staging(spark, "test"), rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = staging.write(stage(spark, now, ""), "stage")
            assert now.columns == rows.columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
        assert packed.filter("piece = 0").count() == now.count()
    assert now.count() == 0


# ---- no switches at a size ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["keys", "ordinary", "both"])
def test_one_string_more_hardly_moves_a_cutoff(kind):
    rng = random.Random(9)
    n, before = [0] * secrets.BINS, None
    for i in range(200):
        key = kind == "keys" or kind == "both" and i % 3 == 0
        n[rng.randrange(secrets.BINS) if key else 0] += 1
        cut = secrets.cutoffs_of({3: list(n), 11: [5] + [0] * 62 + [1]}, 0.1, 0.001)[3]
        assert before is None or abs(cut - before) <= 0.25 * max(cut, before) + 6 / secrets.BINS
        before = cut
    assert cut <= 0.05 if kind == "keys" else cut > 0.02
    assert secrets.cutoffs_of({3: [0] * 63 + [1]}, 0.1, 0.001)[3] <= 0.05  # a lone candidate that looks random is one


def test_one_document_more_hardly_moves_a_fence(spark):
    from cytoloom.llm import quality_rules

    wide = [("en", "big", 0, 1000 + i % 400) for i in range(1000)]
    before = None
    for n in (1, 50, 98, 99, 100, 101, 102, 300):
        rows = wide + [("en", "small", 1, 3000 + i % 100) for i in range(n)]
        docs = spark.createDataFrame(rows, "lang string, source string, k int, v int").selectExpr("lang", "source", "100L AS n_words", "0L AS n_symbols", "100L * v DIV 1000 AS word_chars", "1L AS n_lines", "0L AS n_dup_lines", "0L AS n_repeat_words", "0L AS n_upper")
        fence = {r["source"]: r["fences"]["word_length"] for r in quality_rules.thresholds(quality_rules.sketches(docs), 100, 6).collect()}
        assert fence["big"]["low"] < 1000 < fence["big"]["high"]
        if before and before[0] in (98, 99, 100, 101):
            assert abs(fence["small"]["high"] - before[1]["high"]) <= 150 and abs(fence["small"]["low"] - before[1]["low"]) <= 150
        before = (n, fence["small"])
    assert fence["small"]["high"] > fence["big"]["high"]  # with many documents, its own quartiles rule

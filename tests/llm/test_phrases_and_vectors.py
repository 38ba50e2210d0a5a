"""Collocations, near-duplicate vectors and hard negatives against brute force, and their edge cases."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cytoloom.llm import collocations, embedding_dedup, hard_negatives
from conftest import SF, rows_of

VECTORS = "vec_id long, embedding array<float>, label int, n_links string"  # n_links: a column whose name clashes


# ---- collocations ---------------------------------------------------------------------------------------------------


def phrases_of(texts: list[tuple], least: int, top: int) -> list[tuple]:
    f, n = collections.Counter(), collections.Counter()
    for lang, text in texts:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        inside = any(len(q) > len(p) and g == lang and m >= least and 100 * m >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), m in f.items())
        if not inside:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, rows in found.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1))


def listed(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("route_words", [1_000_000, 40])
def test_collocations_match_brute_force(spark, route_words):
    rng = random.Random(3)
    words = ["A", "b", "the", "é", "\x01x", "ab", "Ünd", "z"] + [f"w{i}" for i in range(6)]
    texts = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", ", ", "\t", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    texts += [("en", None), (None, ""), ("en", " .,; \n"), ("fr", "the hot pair " * 500), ("fr", "the hot pair again")] + [("en", "one passage that is everywhere")] * 40
    docs = spark.createDataFrame([(i, t, g, "x") for i, (g, t) in enumerate(texts)], "doc_id long, text string, lang string, phrase string").repartition(5)
    for least, top in ((3, 2000), (5, 7)):
        assert listed(collocations.collocations(docs, least, top, route_words=route_words)) == phrases_of(texts, least, top)


def test_collocations_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.limit(0)).count() == 0


def test_counts_that_pass_64_bits_when_multiplied(spark):
    big = 6 * 10**17  # times 2,000,000: 80 bits
    assert spark.sql(f"SELECT CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS s FROM VALUES ({big}L, {big + 1}L, {big + 7}L) t(a, l, r)").first()["s"] == 2000000 * big // (2 * big + 8)


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 5, (4, 3000)).astype(np.uint64)
    for d in range(1, 4):
        keys[d] = np.where((keys[d - 1] == 0) | (rng.random(3000) < 0.1), 0, keys[d])
    times = rng.integers(1, 4, 3000)
    want = collections.Counter()
    for row, t in zip(keys.T.tolist(), times.tolist()):
        for d in range(1, 5):
            if row[d - 1]:
                want[tuple(row[:d])] += t
    for least in (1, 40, 10**6):
        got = {tuple(keys[:d, i].tolist()): int(n) for d, at, total in collocations.frequent_prefixes(keys, times, least) for i, n in zip(at, total)}
        assert got == {k: n for k, n in want.items() if n >= least}


def test_suffixes_end_with_their_piece():
    w = collocations.Suffixes(pa.array(["a b. c", None, "A\tb"]))
    k = w.keys(0)
    assert (k > 0).sum(0).tolist() == [2, 1, 1, 2, 1] and k[0, 0] == k[0, 3] and k[1, 0] == k[1, 3]


# ---- near-duplicate vectors -----------------------------------------------------------------------------------------


def links_of(vectors: list, least: float = 0.9) -> np.ndarray:
    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    near = np.zeros((len(vectors),) * 2, bool)
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and usable[i] and usable[j] and len(a) == len(b):
                x, y = np.float32(a).astype(float), np.float32(b).astype(float)
                near[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= least
    return near


def expected(ids: list, near: np.ndarray) -> list[tuple]:
    part = list(range(len(ids)))
    for _ in ids:
        part = [min([part[i], *(part[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
    low = {p: min((ids[i] for i in range(len(ids)) if part[i] == p and ids[i] is not None), default=None) for p in part}
    return sorted(((ids[i], int(near[i].sum()), low[part[i]], ids[i] == low[part[i]]) for i in range(len(ids))), key=str)


def around(rng, centre: np.ndarray, n: int, noise: float) -> list:
    return [(centre + rng.normal(size=len(centre)) * noise).tolist() for _ in range(n)]


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # so that a group spans several blocks
    rng = np.random.default_rng(5)
    vectors = [v for n in (1, 2, 5, 60) for v in around(rng, rng.normal(size=24), n, 0.1)] + rng.normal(size=(40, 24)).tolist()
    vectors += [vectors[0]] * 50 + [(2 * np.float32(vectors[1])).tolist()] + around(rng, np.ones(7), 5, 0.1)
    vectors += [None, [], [0.0] * 24, [None, *vectors[0][1:]], [float("nan"), *vectors[0][1:]], [float("inf"), *vectors[0][1:]], [1e30] * 24, [1e-30] * 24, [-0.0, 1.0], [0.0, 1.0], [3.0], [2.0], [-1.0]]
    ids = list(range(1000, 1000 + len(vectors)))
    ids[3] = ids[4] = None
    ids[5] = ids[6]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in zip(ids, vectors)], VECTORS).repartition(4)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()), key=str)
    assert got == expected(ids, links_of(vectors))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cosine, functions, tables", [(0.9, 2, 8), (0.93, 3, 12)])
def test_recall_of_the_hashes(cosine, functions, tables):
    rng = np.random.default_rng(2)
    u = embedding_dedup.unit(rng.normal(size=(1000, 64)))
    w = rng.normal(size=u.shape)
    w = embedding_dedup.unit(w - (w * u).sum(1)[:, None] * u)
    a, b = (embedding_dedup.buckets(x, tables, functions, 4) for x in (u, cosine * u + np.sqrt(1 - cosine**2) * w))
    found = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1)
    assert found.mean() >= 0.97
    other = ((a == np.roll(b, 1, 0)[:, :, :1]).any(2)).any(1)
    assert other.mean() < 0.05  # most of what is far is never compared


def test_hadamard_is_orthonormal():
    h = embedding_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


# ---- hard negatives -------------------------------------------------------------------------------------------------


def test_hard_negatives_match_sql(spark, duck, monkeypatch):
    want = rows_of(duck.sql(hard_negatives.SQL).df())
    for anchors, rows in ((512, 4096), (1, 30)):
        monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
        monkeypatch.setattr(hard_negatives, "ROWS", rows)
        assert rows_of(hard_negatives.op13_hard_negatives(spark, SF).toPandas()) == want


def mined(rows: list[tuple]) -> list[tuple]:
    ok = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v], ((x + 1) % 10 if i is not None and i % 7 == 0 else x), k) for k, (i, v, x, _) in enumerate(rows) if x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, a, x, k in ok:
        if i is None or i % 100:
            continue
        each = [(sum(p * q for p, q in zip(a, b)), j, y, m) for j, b, y, m in ok if len(a) == len(b)]
        for p in sorted((s for s in each if s[2] == x and s[3] != k), key=order)[:5]:
            inside = sorted((s for s in each if s[2] != x and 80 * p[0] <= 100 * s[0] <= 100 * p[0]), key=order)[:5]
            out += [(i, p[1], n, s[1], p[0], s[0]) for n, s in enumerate(inside, 1)]
    return sorted(out, key=str)


def test_hard_negatives_edges(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 8)
    rng = np.random.default_rng(4)
    rows = [(100 * (i // 6) if i % 6 == 0 else i, (rng.integers(-2, 6, 3) / 4).tolist(), int(rng.integers(0, 3)), "x") for i in range(60)]  # many ties
    v = rows[0][1]
    rows += [(100, v, 1, "x"), (100, v, 1, "x"), (None, v, 1, "x"), (None, v, 2, "x"), (700, None, 1, "x"), (701, v, None, "x"), (702, [None, 1.0, 1.0], 1, "x"), (703, [float("nan"), 1.0, 1.0], 1, "x"), (800, [], 1, "x"), (801, [], 2, "x"), (803, [], 1, "x"), (900, [-1.0, 0.0], 1, "x"), (901, [1.0, 0.0], 1, "x"), (902, [1.0, 0.0], 2, "x")]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == mined(rows)
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_strassen_is_exact():
    rng = np.random.default_rng(6)
    for shape in ((1, 1, 1), (37, 65, 130), (70, 70, 70), (5, 300, 9)):
        for most in (300, 1 << 40):
            a, b = rng.integers(-most, most, shape[:2]), rng.integers(-most, most, shape[1:])
            assert (hard_negatives.strassen(a, b, 8) == a @ b).all()  # both modulo 2^64
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.array([[1 << 40]]), np.array([[1 << 40]]))
    assert hard_negatives.scores(np.array([[1 << 31]]), np.array([[1 << 31]]))[0, 0] == 1 << 62

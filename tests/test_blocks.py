"""The blocked search of all held-out documents against plain sums, and how few rows it hands on."""

import math

import numpy as np
import pytest

from lexispark.operators import blocks as K
from lexispark.operators import classify as C
from lexispark.operators import vectorize as V
from lexispark.plans.experiments import HeldOut


def vectors(rng, n, terms, scale):
    """Rows of skewed terms; every third repeats the one before, so that there are ties."""
    rows = []
    for i in range(n):
        own = np.unique((terms * rng.random(rng.integers(0, 30)) ** 3).astype(np.int32))
        rows.append(rows[-1] if i % 3 == 2 else (own, rng.random(len(own)) * scale))
    first = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])])
    return rows, first, np.concatenate([a for a, _ in rows]), np.concatenate([w for _, w in rows])


@pytest.mark.parametrize(("dense", "scale"), [(2e-3, 1.0), (0.5, 40.0), (0.02, 1e-4)])
def test_blocks_find_what_plain_sums_find(monkeypatch, dense, scale):
    monkeypatch.setattr(K, "QUERY_BLOCK", 16)
    monkeypatch.setattr(K, "DENSE", dense)
    monkeypatch.setattr(K, "PRODUCTS", 50)
    rng = np.random.default_rng(7)
    docs, first, at, w = vectors(rng, 200, 300, scale)
    queries, q_first, q_at, q_w = vectors(rng, 40, 350, scale)
    ids = rng.permutation(200).astype(np.int64)
    best = K._Best(len(queries), 5)
    for a in range(0, 200, 64):
        b = min(a + 64, 200)
        K._search(K._Block(ids[a:b], first[a : b + 1] - first[a], at[first[a] : first[b]], w[first[a] : first[b]]), q_first, q_at, q_w, best)
    for (terms, weights), (scores, found) in zip(queries, best.held, strict=True):
        own = dict(zip(terms, weights, strict=True))
        exact = {i: math.fsum(own.get(t, 0.0) * x for t, x in zip(*d, strict=True)) for i, d in zip(ids, docs, strict=True)}
        want = sorted((i for i in exact if exact[i] > 0), key=lambda i: (-round(exact[i], 12), i))[:5]
        assert list(found) == want and scores == pytest.approx([exact[i] for i in want])


def test_no_row_for_each_pair_leaves_the_search(spark):
    rows = [(i, f"same words in every text {'abcdefgh'[i % 8] * 3}", "ab"[i % 2]) for i in range(400)]
    held = HeldOut(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    metrics, found = held.metrics(3)
    assert metrics.count() == 80
    assert found.scores.count() <= 80 * 3 * held.counts.rdd.getNumPartitions()


def test_features_are_the_weights_of_the_space(spark):
    rows = [(i, f"words {'abcdefgh'[i % 8] * 3} {'xyz'[i % 3] * 2} the words", i % 2) for i in range(40)] + [(40, "12", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    counts = K.counted(docs)
    found = K.fit(counts, K.hashes(spark, ["the"]))
    got = {r.doc_id: sorted(r.features.values) for r in C.features(counts, found, "log").collect()}
    want = {i: [] for i, *_ in rows}
    for r in V.Space(docs.select("doc_id", "text"), ["the"]).postings(["log"], False).collect():
        want[r.doc_id].append(r.w_log)
    assert got == {i: pytest.approx(sorted(w)) for i, w in want.items()}


def test_histories_of_machines_are_bounded_together():
    assert [C.trained_at_once(n) for n in (0, 1_000, 400_000, 10_000_000)] == [4, 4, 1, 1]


def test_places_are_those_of_a_binary_search():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 1000):
        ids = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, n), [5, 6, 7, 8][: n - 1]]).astype(np.int64))
        asked = np.concatenate([ids, ids - 1, rng.integers(-(2**63), 2**63 - 1, 100), [-(2**63), 2**63 - 1]]).astype(np.int64)
        found = K.Fit(ids, np.ones(len(ids)), 1, 1.0).places(asked)
        assert (found == np.minimum(np.searchsorted(ids, asked), len(ids) - 1)).all()


@pytest.mark.parametrize("method", ["tfidf", "bm25"])
def test_measures_from_labels_are_those_of_the_lists(spark, monkeypatch, method):
    """Two labels with words of their own, some documents in the words of the other label, copies, empty ones and no label."""
    monkeypatch.setattr(K, "BOUND_DOCS", 40)
    monkeypatch.setattr(K, "BOUND_TERMS", 300)
    monkeypatch.setattr(K, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(5)
    words = {x: [f"{x}{'abcdefghijklmnopqrst'[i]}" for i in range(20)] + ["both", "shared"] for x in ("xx", "yy")}
    rows = []
    for i in range(400):
        label = ("xx", "yy")[i % 2]
        own = words[("xx", "yy")[(i + (i % 41 == 0)) % 2]]
        text = "" if i % 50 == 0 else rows[i - 2][1] if i % 5 == 0 else " ".join(own[int(22 * rng.random() ** 2)] for _ in range(12))
        rows.append((i, text, None if i % 97 == 5 else "few" if i % 80 == 7 else label))
    held = HeldOut(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    want = {r[0]: r[1:] for r in held.metrics(5, method)[0].select("query_id", "precision_at_k", "ap_at_k").collect()}
    measures, found = held.measures(5, method)
    got = {r[0]: r[1:] for r in measures.collect()}
    assert got == want
    searched = found.scores.select("query_id").distinct().count()
    assert 0 < searched < len(want)

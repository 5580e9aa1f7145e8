"""The evaluation queries named ..._all ask every held-out document; the reference here is plain Python."""

import hashlib
import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from lexispark.functions.text import STOP_WORDS
from lexispark.plans import registry

WORDS = {"en": "orbit rocket space the launch moon".split(), "fr": "lune fusée orbite espace rocket the".split(), "de": "mond rakete raum orbit launch and".split()}


def documents(n=300):
    rows = []
    for i in range(n):
        lang = ("en", "fr", "de")[i * i % 7 % 3]
        at = hashlib.md5(str(i).encode()).digest()
        rows.append((i, " ".join(WORDS[lang][b % 6] for b in at[: 1 + i % 9]), lang, "web"))
    return rows


def held_out(rows):
    test = set()
    for lang in WORDS:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
        test |= {r[0] for r in own[: math.ceil(0.2 * len(own))]}
    return test


def terms(text):
    import re

    return Counter(t for t in re.findall("[a-z]+", text.lower()) if len(t) > 1 and t not in STOP_WORDS)


def brute_force(rows, k=10):
    """query_id -> (precision, AP, ranking) of cosine over raw TF-IDF."""
    test = held_out(rows)
    train = [r for r in rows if r[0] not in test]
    counts = {r[0]: terms(r[1]) for r in rows}
    df = Counter(t for r in train for t in counts[r[0]])
    idf = {t: math.log((1 + len(train)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(i):
        v = {t: c * idf[t] for t, c in counts[i].items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors, label, out = {r[0]: vector(r[0]) for r in train}, {r[0]: r[2] for r in rows}, {}
    for q in test:
        v = vector(q)
        score = {d: round(sum(x * w.get(t, 0) for t, x in v.items()), 12) for d, w in vectors.items()}
        ranked = sorted(score, key=lambda d: (score[d] <= 0, -score[d], d))[:k]
        rel = [label[d] == label[q] for d in ranked]
        ap = sum(sum(rel[: i + 1]) / (i + 1) for i in range(k) if rel[i]) / min(sum(label[d] == label[q] for d in vectors), k)
        out[q] = (sum(rel) / k, ap, ranked)
    return out


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rows = documents()
    place = tmp_path_factory.mktemp("held-out")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{place}/documents.parquet")
    return str(place), brute_force(rows)


def test_every_held_out_document_is_a_query(spark, fixture):
    place, want = fixture
    assert len(want) > 40
    got = {r.query_id: r for r in entry.queries()["per_query_metrics_all"](spark, place).collect()}
    assert set(got) == set(want)
    for q, (precision, ap, ranked) in want.items():
        assert (got[q].precision_at_k, got[q].ap_at_k) == (pytest.approx(precision, abs=1e-6), pytest.approx(ap, abs=1e-6))
        assert got[q].top_docs == ",".join(map(str, ranked))
    ranks = {}
    for r in sorted(entry.queries()["padded_ranking_all"](spark, place).collect()):
        ranks.setdefault(r.query_id, []).append(r.doc_id)
    assert ranks == {q: w[2] for q, w in want.items()}


@pytest.mark.parametrize("mode", ["raw", "log", "double", "bm25"])
def test_means_are_over_every_held_out_document(spark, fixture, mode):
    place, want = fixture
    r = entry.queries()[f"eval_precision_map_{mode}_all"](spark, place).first()
    assert r.queries == len(want)
    if mode == "raw":
        assert r.map_at_k == pytest.approx(sum(w[1] for w in want.values()) / len(want), abs=1e-6)


def test_quality_difference_counts_every_held_out_document(spark, fixture):
    place, want = fixture
    assert sum(entry.queries()["quality_difference_all"](spark, place).first()) == len(want)


def test_ablation_runs_every_seed(spark, fixture):
    got = {r["name"]: r for r in entry.queries()["stop_word_ablation_all"](spark, fixture[0]).collect()}
    assert {n: r.runs for n, r in got.items()} == {"default": 10, "none": 10}
    assert got["default"].vocabulary_size_mean < got["none"].vocabulary_size_mean


def test_sampled_queries_keep_their_size(spark, fixture):
    assert registry.queries()["per_query_metrics"](spark, fixture[0]).count() == min(registry.SAMPLED, len(fixture[1]))

import math

import pytest

from lexispark.operators import metrics as M
from lexispark.operators import retrieve as R
from lexispark.operators import vectorize as V
from lexispark.plans import experiments as E
from lexispark.sources import corpus, store

CORPUS = [(41, "river bridge"), (6, "river stone"), (23, "bridge river"), (50, "violin concert"), (77, "of")]


def space(spark, rows, stop=("of",), **kw):
    return V.Space(spark.createDataFrame(rows, "doc_id long, text string"), stop, **kw)


def tokens(spark, *texts):
    return V.tokenized(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"), ("of",), "query_id")


def test_counts_idf_and_norms(spark):
    s = space(spark, [(1, "clay clay iron"), (2, "iron salt"), (3, "iron")])
    idf = {r.term: r.idf for r in s.vocab.collect()}
    assert idf["clay"] == pytest.approx(math.log(4 / 2) + 1) and idf["iron"] == pytest.approx(1)
    norms = {}
    for r in s.postings(with_bm25=False).collect():
        for m in V.TF_MODES:
            norms[r.doc_id, m] = norms.get((r.doc_id, m), 0) + r[f"w_{m}"] ** 2
    assert all(n == pytest.approx(1) for n in norms.values())


def test_vocabulary_is_in_code_point_order(spark):
    words = ["yew", "ash", "alder", "al", "birch", "bi", "ashen", "zz"]
    s = space(spark, [(i, f"{w} ash") for i, w in enumerate(words)])
    assert {r.term: r.term_id for r in V.numbered(s.vocab).collect()} == {w: i for i, w in enumerate(sorted(words))}


def test_double_tf(spark):
    s = space(spark, [(0, "clay clay clay iron"), (1, "iron"), (2, ""), (3, "of")])
    w = {(r.doc_id, r.term): r.w_double for r in s.postings(["double"], False).collect()}
    a, b = 1 + math.log(5 / 2), (0.5 + 0.5 / 3) * (1 + math.log(5 / 3))
    assert w[0, "clay"] == pytest.approx(a / math.hypot(a, b)) and w[1, "iron"] == pytest.approx(1)
    assert s.n_docs == 4


def test_empty_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError, match="vocabulary is empty"):
        space(spark, [(1, "123"), (2, "!")]).require_terms()


def test_bm25_by_hand(spark):
    s = space(spark, [(31, "clay iron clay clay"), (8, "iron salt"), (64, "of")])
    assert s.average == pytest.approx(2)
    best = R.search_batch(s, tokens(spark, "clay", "clay clay"), 3, "bm25").collect()
    assert [(r.query_id, r.doc_id) for r in sorted(best)] == [(0, 31), (1, 31)]
    want = math.log(1 + 2.5 / 1.5) * 3 * 2.5 / (3 + 1.5 * (1 - 0.75 + 0.75 * 4 / 2))
    assert all(r.score == pytest.approx(want) for r in best)
    for k1, b in ((-1, 0.5), (math.nan, 0.5), (1, -1), (1, 1.1), (math.inf, 0.5)):
        with pytest.raises(ValueError):
            V.check_bm25(k1, b)


def test_ties_go_by_id_and_only_positive_scores_count(spark):
    best = R.search_batch(space(spark, CORPUS), tokens(spark, "bridge"), 3).collect()
    assert [r.doc_id for r in sorted(best)] == [23, 41]


@pytest.mark.parametrize("mode", V.TF_MODES)
def test_scan_equals_inverted(spark, mode):
    s, q = space(spark, CORPUS), tokens(spark, "bridge", "stone river bridge", "river river river", "unheard")
    for k in (1, 3, 5):
        a, b = (R.search_batch(s, q, k, mode=mode, strategy=x) for x in R.STRATEGIES)
        assert R.consistency(a, b).first().consistent
    assert [r.query_id for r in R.unanswerable(s, q).collect()] == [3]


def test_padding_and_metrics(spark):
    docs = spark.createDataFrame([(90, "a"), (7, "a"), (3, "b")], "doc_id long, label string")
    queries = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "query_id long, label string")
    scores = spark.createDataFrame([(1, 90, 0.2), (1, 7, 0.2)], "query_id long, doc_id long, score double")
    ranking = R.padded_ranking(scores, queries, docs, 2)
    got = {}
    for r in sorted(ranking.collect()):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {0: [3, 7], 1: [7, 90], 2: [3, 7]}
    per = {r.query_id: (r.precision_at_k, r.ap_at_k) for r in M.retrieval_metrics(ranking, queries, docs, 2).collect()}
    assert per == {0: (0.5, 0.25), 1: (0.0, 0.0), 2: (0.0, 0.0)}


def test_latency(spark):
    r = M.latency(spark.createDataFrame([(0.001,), (0.002,), (0.003,), (0.004,)], "seconds double")).first()
    assert (r.mean_ms, r.p50_ms, r.samples) == (pytest.approx(2.5), pytest.approx(2.5), 4) and r.p95_ms == pytest.approx(3.85)
    none = M.latency(spark.createDataFrame([], "seconds double")).first()
    assert none.mean_ms is None and none.samples == 0
    with pytest.raises(Exception, match="nonnegative"):
        M.latency(spark.createDataFrame([(-1.0,)], "seconds double")).collect()


def test_store_round_trip_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(18, "bridge bridge river", 0), (4, "violin concert", 1), (2, "bridge stone", 0)], "doc_id long, text string, label int")
    names = spark.createDataFrame([(0, "land"), (1, "music")], "label int, name string")
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    mark = corpus.fingerprint(docs)
    store.save(V.Space(docs.select("doc_id", "text"), k1=2.2, b=0.3), docs, names, path, mark)
    index = store.load_for_corpus(spark, path, mark)
    assert (index.manifest["k1"], index.manifest["b"]) == (2.2, 0.3)
    for kw in ({}, {"strategy": "scan"}, {"mode": "log"}, {"mode": "double"}, {"method": "bm25"}):
        rows = index.search("bridge", 2, **kw).collect()
        assert {r.doc_id for r in rows} == {2, 18} and all(r.label == "land" for r in rows)
    for query, k, error in (("bridge", 4, "topk"), ("bridge", True, "topk"), (" ", 1, "blank"), ("unheard", 1, "no terms")):
        with pytest.raises(ValueError, match=error):
            index.search(query, k)
    with pytest.raises(ValueError, match="another corpus"):
        store.load_for_corpus(spark, path, "x")
    text = store.read_text(spark, f"{path}/manifest.json")
    store.write_text(spark, f"{path}/manifest.json", text.replace('"n_docs": 3', '"n_docs": 4'))
    with pytest.raises(ValueError, match="checksum"):
        store.load(spark, path)
    store.write_text(spark, f"{path}/manifest.json", text)
    spark.read.parquet(f"{path}/docs").limit(2).coalesce(1).write.parquet(f"{path}/fewer")
    spark.read.parquet(f"{path}/fewer").write.mode("overwrite").parquet(f"{path}/docs")
    with pytest.raises(ValueError, match="checksum"):
        store.load(spark, path)


def test_plans_keep_their_shape(spark, tmp_path):
    s = space(spark, CORPUS)
    plan = R.search_batch(s, tokens(spark, "bridge"), 3)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan
    s.postings().write.parquet(f"{tmp_path}/p")
    pushed = spark.read.parquet(f"{tmp_path}/p").filter("term IN ('bridge')").select("doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [EqualTo(term,bridge)]" in pushed or "PushedFilters: [IsNotNull(term), EqualTo(term,bridge)]" in pushed


def test_experiments_are_deterministic_and_do_not_leak(spark):
    kinds = {"land": "river bridge stone meadow", "music": "violin concert choir organ", "food": "bread butter honey tea"}
    rows = [(7 * i + 1, " ".join(w for k, w in enumerate(kinds[kind].split()) if (i + k) % 4) + " again", kind) for i in range(45) for kind in [list(kinds)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    train, queries = E.held_out(docs, 6)
    ids = {r.query_id for r in queries.collect()}
    assert len(ids) == 6 and not ids & {r.doc_id for r in train.collect()}
    one, two = (E.tf_variants(docs, 6).collect() for _ in range(2))
    assert one == two and {r.method for r in one} == {"raw", "log", "double", "bm25"} and all(r.empty_queries == 0 for r in one)


def test_classified_variants(spark):
    kinds = {"land": "river bridge stone meadow", "music": "violin concert choir organ"}
    rows = [(i, " ".join(w for k, w in enumerate(kinds[kind].split()) if (i + k) % 4) + " again", kind) for i in range(40) for kind in [list(kinds)[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    assert E.classified(docs, "log").first() == (1.0, 1.0)


def test_splits_are_thresholds_of_the_hash_order(spark):
    import hashlib

    from lexispark.operators import split as S

    rows = [(i, "t", None if i % 11 == 0 else "abc"[i % 3]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    order = lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0])
    want = set()
    for label in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[2] == label), key=order)
        want |= {r[0] for r in own[: math.ceil(0.2 * len(own))]}
    out = S.stratified_split(docs)
    assert {r.doc_id for r in out.filter("is_test").collect()} == want and out.count() == len(rows)
    plan = out._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan and "BroadcastHashJoin" in plan
    assert S.query_subset(out.filter("is_test").drop("is_test"), 50).count() == 50
    assert S.stratified_split(docs.limit(0)).count() == 0


def test_scan_of_many_documents_and_batches(spark):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(300)]
    s, q = space(spark, rows), tokens(spark, *[" ".join(rng.choices(words, k=5)) for _ in range(12)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        a, b = (R.search_batch(s, q, 7, strategy=x).collect() for x in R.STRATEGIES)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.query_id, r.rank, r.doc_id) for r in sorted(a)] == [(r.query_id, r.rank, r.doc_id) for r in sorted(b)] and len(a) == 84
    plan = R.search_batch(s, q, 7, strategy="scan")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_matrix_validation(spark):
    s = space(spark, CORPUS)
    assert V.validated(s.counts, s.vocab, s.n_docs, ids=s.lengths).count() == s.counts.count()
    twice = s.counts.unionByName(s.counts.limit(1))
    for cells, n, error in ((twice, 5, "repeated"), (s.counts.selectExpr("doc_id", "term", "CAST('NaN' AS DOUBLE) AS count"), 5, "values"), (s.counts.selectExpr("doc_id", "concat(term, 'x') AS term", "count"), 5, "unknown terms"), (s.counts.selectExpr("doc_id + 1000 AS doc_id", "term", "count"), 5, "unknown documents"), (s.counts, 1, "over the shape")):
        with pytest.raises(ValueError, match=error):
            V.validated(cells, s.vocab, n, ids=s.lengths)


def test_validation_notices_a_wrong_weight(spark):
    from lexispark.plans import validation

    docs = spark.createDataFrame(CORPUS, "doc_id long, text string")
    s = space(spark, CORPUS)
    assert validation.validate_weights(s, docs).first().passed
    postings = s.postings
    s.postings = lambda *a: postings(*a).withColumn("w_raw", V.F.col("w_raw") + V.F.when(V.F.col("doc_id") == 6, 0.01).otherwise(0.0))
    wrong = validation.validate_weights(s, docs).first()
    assert not wrong.passed and wrong.max_error == pytest.approx(0.01)


def test_search_as_a_table_function(spark, tmp_path):
    from lexispark.functions.register import register

    docs = spark.createDataFrame([(18, "bridge bridge river", 0), (4, "violin concert", 1), (2, "bridge stone", 0)], "doc_id long, text string, label int")
    names = spark.createDataFrame([(0, "land"), (1, "music")], "label int, name string")
    store.save(V.Space(docs.select("doc_id", "text")), docs, names, f"file://{tmp_path}/i", "")
    index = store.load(spark, f"file://{tmp_path}/i", verify=True)
    assert "lexi_search" in register(spark, index)
    got = spark.sql("SELECT * FROM lexi_search('Bridge, violin', 2) ORDER BY rank").collect()
    want = index.search("bridge violin", 2, "bm25").collect()
    assert [(r["rank"], r.doc_id) for r in got] == [(r["rank"], r.doc_id) for r in want]
    assert len(store.file_digests(spark, f"file://{tmp_path}/i/vocab")) >= 1


def test_metric_edges(spark):
    p = M.per_class(spark.createDataFrame([(0, 0), (0, 1), (2, 0)], "label int, prediction int"))
    assert {r.label: (r.precision, r.recall, r.support) for r in p.collect()} == {0: (0.5, 0.5, 2), 1: (0.0, 0.0, 0), 2: (0.0, 0.0, 1)}
    runs = spark.createDataFrame([("a", 3, 0.8), ("a", 3, 1.0), ("b", 0, 0.5)], "name string, stop_word_count int, m double")
    got = {r.name: (r.m_mean, r.m_std) for r in M.summarize_runs(runs, ["m"]).collect()}
    assert got["a"] == (pytest.approx(0.9), pytest.approx(0.1414213562)) and got["b"] == (0.5, 0.0)
    with pytest.raises(ValueError, match="at least 500"):
        corpus.validate(spark.createDataFrame([(1, "x", 0)], "doc_id long, text string, label int"))


def test_equal_weights_in_another_order_are_tied(spark):
    parts = [0.1, 0.2, 0.3]
    rows = [(d, f"t{d}{i}", w) for d, own in ((1, parts), (2, parts[::-1]), (3, sorted(parts))) for i, w in enumerate(own)]
    postings = spark.createDataFrame(rows, "doc_id long, term string, w_bm25 double").coalesce(1)
    weights = spark.createDataFrame([(0, t, 1.0) for _, t, _ in rows], "query_id long, term string, weight double")
    scores = [r.score for r in R.scores_inverted(postings, weights, "w_bm25", True).collect()]
    assert len(scores) == 3 and len(set(scores)) == 1 and scores[0] == pytest.approx(math.fsum(parts), abs=1e-13)

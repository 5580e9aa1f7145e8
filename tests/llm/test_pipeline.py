"""The pipeline on the smallest tables, each stage against a brute-force version on its own input."""

import os
import random

import pytest
from test_lines import plain
from test_operators import brute_classes, shingles

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    from lexispark.llm import common
    from lexispark.llm.toxicity import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = common.materialize(stage(spark, docs, SF), "test-stage")
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after) and set(after) <= set(before)
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            marked = {r.doc_id: r.toxic for r in labels.collect()}
            assert set(before) - set(after) == {r.doc_id for r in toxicity(docs, labels).filter("predicted = 1").collect()}
            assert sum(marked.get(d) == 0 for d in set(before) - set(after)) <= 2
        if k == 1:
            want = plain([(d, r.text) for d, r in before.items()])
            assert {d: r.text for d, r in after.items()} == {d: t for d, t in want.items() if t.strip() or not before[d].text.strip()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if k == 2:
            classes = brute_classes([(d, r.text) for d, r in before.items()])
            assert set(after) == {d for d, (_, c, _) in classes.items() if c == d}
        if k == 3:
            held = {d: shingles(r.text) for d, r in before.items()}
            assert set(after) == {d for d, s in held.items() if not any(i and len(i & s) >= 0.8 * len(i) - 1e-9 for i in items.values())}
        if k == 4:
            assert all(1 <= r.copies <= 3 and r.taken == r.size * r.copies for r in after.values())
            for source in {r.source for r in after.values()}:
                own = [r for r in after.values() if r.source == source]
                assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in before_sizes(before, source))
        docs = out


class _Sized:
    def __init__(self, text):
        self.size = len((text or "").split())


def before_sizes(before, source):
    return [_Sized(r.text) for r in before.values() if r.source == source]


def test_the_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    assert corpus_pipeline.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def rows_of(spark, *pairs):
    return spark.createDataFrame([(d, t, "en", "web", len(t or "")) for d, t in pairs], SCHEMA)


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def sorted_rows(*pairs):
    return sorted(pairs, key=str)


def test_ngram_stage_keeps_one_row_of_each_class(spark, tmp_path):
    a, b, c, d = (prose(k) for k in "abcd")
    near = a + " zzzzzz"
    docs = rows_of(spark, (1, a), (1, a), (1, a), (2, b), (2, c), (None, near), (None, d), (None, d), (5, c + " zzzzzz"), (9, None), (9, None), (8, ""))
    got = kept(corpus_pipeline.ngram_join(spark, docs, str(tmp_path)))
    # 1: one of three equal rows, and not its near copy without id; 2: two unlike texts of one id stay, the near copy 5 goes.
    assert got == sorted_rows((1, a), (2, b), (2, c), (None, d), (9, None), (9, None), (8, ""))


def test_ngram_stage_does_not_drop_a_document_that_shares_its_id_with_a_copy(spark, tmp_path):
    a, b = prose("a"), prose("b")
    got = kept(corpus_pipeline.ngram_join(spark, rows_of(spark, (1, a), (7, a + " zzzzzz"), (7, b)), str(tmp_path)))
    assert got == sorted_rows((1, a), (7, b))


def test_ngram_stage_chooses_among_equal_texts_whatever_their_other_columns(spark, tmp_path):
    a = prose("a")
    rows = [(1, a, "en", s, len(a)) for s in ("web", "book", "code")]
    got = [corpus_pipeline.ngram_join(spark, spark.createDataFrame(r, SCHEMA), str(tmp_path)).collect() for r in (rows, rows[::-1])]
    assert len(got[0]) == 1 and got[0] == got[1]


def test_decontamination_judges_each_row(spark, tmp_path):
    item, a, b = prose("item", 20), prose("a"), prose("b")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty = a + " " + item
    docs = rows_of(spark, (1, dirty), (1, a), (None, dirty), (None, b), (3, dirty), (3, dirty), (4, b), (4, b), (5, None))
    assert kept(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == sorted_rows((1, a), (None, b), (4, b), (4, b), (5, None))


def test_toxicity_judges_each_row(spark, tmp_path):
    from lexispark.llm import toxicity as tox

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    a, dirty = prose("a"), " ".join(tox.SEED_WORDS)
    docs = rows_of(spark, (1, dirty), (1, a), (None, dirty), (None, a), (3, dirty), (3, dirty), (4, a), (4, a), (5, None))
    assert kept(corpus_pipeline.toxicity(spark, docs, str(tmp_path))) == sorted_rows((1, a), (None, a), (4, a), (4, a), (5, None))


def test_line_dedup_of_repeated_rows_ids_and_nulls(spark, tmp_path):
    a, b, c = (prose(k, 8) for k in "abc")
    docs = rows_of(spark, (1, a), (1, a), (1, a + "\n" + b), (None, b + "\n" + c), (2, c))
    got = kept(corpus_pipeline.line_dedup(spark, docs, str(tmp_path)))
    # A line stays with the first document that has it, ids first; two equal rows are one document and stay or go together.
    assert sorted(l for _, t in {x for x in got} for l in t.split("\n")) == sorted([a, b, c])
    assert got.count((1, a)) in (0, 2) and (2, c) in got and not any(d is None for d, _ in got)


def test_mix_draws_rows_of_one_id_apart(spark, tmp_path):
    docs = rows_of(spark, *[(k % 3 if k % 4 else None, prose(k)) for k in range(40)])
    out = corpus_pipeline.mixing(spark, docs, str(tmp_path)).collect()
    assert len(out) == 40 and all(r.copies == 1 for r in out)


HELPERS = ("row", "key", "h", "d", "gone", "size", "target", "copies", "taken", "source_size", "n_lines", "n_dropped", "emptied", "_hit", "_other", "_toxic", "_gone_id", "_gone_h", "_s", "_below", "place", "first", "stays", "score", "doc", "hash", "item", "ids", "a", "b", "o", "x", "kept", "ls", "_n", "_k", "_text")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(0, prose("item", 20))], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return str(place)


@pytest.mark.parametrize("k", range(5))
def test_every_other_column_passes_through_every_stage(spark, tables, k):
    """Columns named like any helper, of several types, with nulls; a null id, a repeated row and a null text among the rows."""
    from pyspark.sql import functions as F

    a, b = prose("a"), prose("b")
    docs = rows_of(spark, (1, a), (2, b), (2, b), (None, prose("c")), (4, None), (5, "")).withColumns({c: F.when(F.col("doc_id") != 2, F.concat(F.lit(c), F.col("doc_id").cast("string"))) for c in HELPERS})
    docs = docs.withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "when": F.lit("2020-01-01").cast("timestamp")})
    out = corpus_pipeline.STAGES[k][1](spark, docs, tables)
    assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or len(out.columns) == len(docs.columns))
    rows = out.collect()
    texts = {1: {a}, 2: {b}, 4: {None}, 5: {""}}
    for r in rows:
        assert r.doc_id is None or r.text in texts[r.doc_id]
        assert all(r[c] == (None if r.doc_id in (None, 2) else f"{c}{r.doc_id}") for c in HELPERS) and r.m == {"k": r.doc_id}
    assert {r.doc_id for r in rows} == {1, 2, None, 4, 5} and len(rows) == (5 if k == 2 else 6)
    if k == 4:
        assert {"mix_size", "mix_target", "mix_copies", "mix_taken"} <= set(out.columns)
        # One source, so every word is taken once; documents without words may stand more often, which adds nothing.
        assert all(r["mix_taken"] == r["mix_size"] and r["mix_copies"] >= 1 for r in rows)


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, tables, k):
    docs = rows_of(spark, (1, "x")).limit(0)
    out = corpus_pipeline.STAGES[k][1](spark, docs, tables)
    assert out.count() == 0 and out.columns[:5] == docs.columns


def test_a_very_long_document_passes(spark, tables):
    long = " ".join(prose(i, 500) for i in range(100))
    docs = rows_of(spark, (1, long), (2, long + " zzzzzz"), (3, long + " " + prose("item", 20)), (4, prose("d")))
    for k, want in ((0, {1, 2, 3, 4}), (1, {1, 2, 3, 4}), (2, {1, 4}), (3, {1, 2, 4})):
        assert {r.doc_id for r in corpus_pipeline.STAGES[k][1](spark, docs, tables).select("doc_id").collect()} == want


def test_run_leaves_only_its_result_in_the_shared_folder(spark, tables, tmp_path):
    import shutil

    from lexispark.llm import common

    shutil.copytree(tables, tmp_path / "t")
    rows_of(spark, (1, prose("a")), (2, prose("b"))).write.parquet(f"{tmp_path}/t/documents.parquet")
    before = common.written()
    out = corpus_pipeline.run(spark, f"{tmp_path}/t")
    assert common.written() == before + 1 and out.count() == 2


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from lexispark.llm import common

    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            @staticmethod
                            def isEmpty():
                                return True

                        return Empty

                return Sc

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())

"""Building and benchmarking end to end: corpus in, stored index and reports out."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .operators import classify as C
from .operators import metrics as M
from .operators import retrieve as R
from .operators import split as S
from .operators import vectorize as V
from .plans import experiments as E
from .plans.validation import validate_weights
from .sources import corpus, store

#: Searches that reports show where none are given: so many, of the most frequent terms that not every document has.
SHOWN_QUERIES = 3


@dataclass(frozen=True)
class BuildConfig:
    data: str
    label: str = "lang"
    artifacts: str = "artifacts/runtime"
    reports: str = "artifacts/reports"
    epochs: int = 10
    seed: int = S.SEED
    minimum_documents: int = corpus.MINIMUM_DOCUMENTS
    queries: tuple[str, ...] = ()
    batch_size: int | None = None


@dataclass(frozen=True)
class BuildReport:
    document_count: int
    search_vocabulary_size: int
    accuracy: float
    macro_f1: float
    misclassified: int
    consistent: bool


def index_path(artifacts: str) -> str:
    return artifacts if ":" in artifacts else f"file://{Path(artifacts).resolve()}"


def shown_queries(vocab: DataFrame, n_docs: int, given: tuple[str, ...]) -> tuple[str, ...]:
    """The given ones, or pairs of neighbouring terms by document frequency, each of less than half of the documents."""
    if given:
        return given
    terms = [r.term for r in vocab.filter(F.col("df") < max(n_docs / 2, 2)).orderBy(F.col("df").desc(), "term").limit(2 * SHOWN_QUERIES).collect()]
    return tuple(" ".join(terms[i : i + 2]) for i in range(0, len(terms), 2))


def check_batch_size(spark: SparkSession, size: int | None) -> None:
    """Rows that go to Python at a time while fitting and predicting."""
    if size is not None:
        if size < 1:
            raise ValueError("batch size must be positive")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def build(spark: SparkSession, config: BuildConfig) -> BuildReport:
    """Sanitize, validate, classify on a split, index the whole corpus, and write the index and the reports."""
    check_batch_size(spark, config.batch_size)
    raw, categories = corpus.read_documents(spark, config.data, config.label)
    docs = corpus.load(raw).persist()
    reports = Path(config.reports)
    try:
        n = corpus.validate(docs, config.minimum_documents)
        report.write_json(reports / "sanitization.json", report.rows_of(corpus.privacy_summary(raw))[0] | {"categories": report.rows_of(corpus.category_report(raw, categories))})
        d = S.stratified_split(docs, seed=config.seed)
        predictions = C.classify(d.filter("NOT is_test").drop("is_test"), d.filter("is_test").drop("is_test"), max_iter=config.epochs).persist()
        scores = report.rows_of(M.accuracy(predictions).crossJoin(M.macro_f1(predictions)))[0]
        cells = report.rows_of(M.confusion(predictions, categories))
        report.write_json(reports / "classification.json", scores | {"settings": asdict(config), "confusion": cells, "per_class": report.rows_of(M.per_class(predictions))})
        report.write_json(reports / "classification_errors.json", report.rows_of(C.misclassified(predictions, docs, categories)))
        report.save_confusion_matrix(cells, reports / "confusion_matrix.png")
        space = V.Space(docs.select("doc_id", "text")).require_terms()
        checked = report.rows_of(validate_weights(space, docs.select("doc_id", "text")))[0]
        if not checked["passed"]:
            raise ValueError("TF-IDF weights fail their validation")
        report.write_json(reports / "validation.json", checked)
        manifest = store.save(space, docs, categories, index_path(config.artifacts), corpus.fingerprint(docs))
        index = store.load(spark, index_path(config.artifacts))
        report.write_json(reports / "index.json", report.rows_of(V.matrix_stats(index.postings, manifest["n_docs"], manifest["n_terms"]))[0])
        found, consistent = {}, True
        for q in shown_queries(index.vocab, n, config.queries):
            try:
                best = [index.search(q, min(5, n), strategy=s) for s in R.STRATEGIES]
            except ValueError as e:
                found[q] = {"not_measured": str(e)}
                continue
            found[q] = report.rows_of(best[1])
            consistent &= report.rows_of(R.consistency(*[b.withColumn("query_id", F.lit(0)) for b in best]))[0]["consistent"]
        report.write_json(reports / "search_examples.json", found)
        return BuildReport(n, manifest["n_terms"], scores["accuracy"], scores["macro_f1"], scores["misclassified"], bool(consistent))
    finally:
        docs.unpersist()


def benchmark(spark: SparkSession, config: BuildConfig, count: int = 100, repeats: int = 5, seeds: int = 1) -> dict:
    """Quality of TF modes and BM25, strategies by size, stop words and comparisons, bound to the stored index."""
    check_batch_size(spark, config.batch_size)
    index = store.load(spark, index_path(config.artifacts))
    raw, _ = corpus.read_documents(spark, config.data, config.label)
    docs = corpus.load(raw).persist()
    mark = corpus.fingerprint(docs)
    if mark != index.manifest["fingerprint"]:
        raise ValueError("index artifact was built from another corpus; rebuild it")
    train, queries = E.held_out(docs, count, config.seed)
    compared = {}
    for q in shown_queries(index.vocab, index.n_docs, config.queries):
        try:
            a, b = (index.search(q, min(5, index.n_docs), method=m).withColumn("query_id", F.lit(0)) for m in ("tfidf", "bm25"))
            compared[q] = {"overlap": sum(r["overlap"] for r in report.rows_of(R.overlap(a, b))), "ranks": report.rows_of(R.compared(a, b, index.docs))}
        except ValueError as e:
            compared[q] = {"not_measured": str(e)}
    tfidf, bm25 = E.evaluate(train, queries, 10), E.evaluate(train, queries, 10, "bm25")
    d = S.stratified_split(docs, seed=config.seed)
    per_class = {m: report.rows_of(M.per_class(C.classify(d.filter("NOT is_test").drop("is_test"), d.filter("is_test").drop("is_test"), m, config.epochs))) for m in V.TF_MODES}
    result = {
        "schema_version": report.SCHEMA_VERSION, "fingerprint": mark, "index_digest": index.manifest["digest"], "settings": asdict(config) | {"queries_asked": count, "repeats": repeats, "seeds": seeds},
        "quality": report.rows_of(E.tf_variants(docs, count, classify=True)), "difference": report.rows_of(M.quality_difference(tfidf, bm25))[0], "cases": report.rows_of(M.difference_cases(tfidf, bm25)), "per_class": per_class,
        "latency": E.scan_against_inverted(docs, queries, repeats=repeats), "ablation": report.rows_of(E.stop_word_ablation(docs, count, seeds=range(seeds), classify=True)), "comparisons": compared,
    }
    reports = Path(config.reports)
    report.write_json(reports / "retrieval_benchmark.json", result)
    for part in report.PARTS:
        report.write_csv(reports / f"{part}.csv", result[part])
    for mode, rows in per_class.items():
        report.write_csv(reports / f"per_class_{mode}.csv", rows)
    report.save_bars(result["quality"], "method", ["precision_at_k", "map_at_k"], reports / "quality.png")
    report.save_bars([r | {"name": f"{r['strategy']} {r['documents']}"} for r in result["latency"]], "name", ["mean_ms", "p95_ms"], reports / "latency.png")
    report.save_bars(result["ablation"], "name", ["precision_at_k_mean", "map_at_k_mean"], reports / "ablation.png")
    (reports / "experiment_summary.md").write_text(report.benchmark_summary(result, index.manifest), encoding="utf-8")
    docs.unpersist()
    return result

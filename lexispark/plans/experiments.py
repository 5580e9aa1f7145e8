"""Paired experiments: variants share the split, the queries and the counts they can share."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks as K
from ..operators import classify as C
from ..operators import metrics as M
from ..operators import retrieve as R
from ..operators import split as S
from ..operators import vectorize as V
from ..operators.sizes import broadcast_if_few

ABLATION_SEEDS = tuple(range(10))
#: Seeds of the ablation whose jobs are under way together.
SEEDS_AT_ONCE = 3


def evaluate(train: DataFrame, queries: DataFrame, k: int, method: str = "tfidf", mode: str = "raw", stop_words: Iterable[str] | None = None, space: V.Space | None = None) -> DataFrame:
    """Per-query metrics of label retrieval: (doc_id, text, label) searched by (query_id, text, label)."""
    from ..functions.text import STOP_WORDS

    words = STOP_WORDS if stop_words is None else tuple(stop_words)
    space = space or V.Space(train.select("doc_id", "text"), words)
    tokens = V.tokenized(queries, words, "query_id")
    weights = R.query_weights(space, tokens, method, mode)
    postings = space.postings([mode] if method != "bm25" else [], method == "bm25")
    scores = R.scores_inverted(postings, weights, "w_bm25" if method == "bm25" else f"w_{mode}", R.few_terms(tokens))
    return M.retrieval_metrics(R.padded_ranking(scores, queries, train, k), queries, train, k)


def held_out(docs: DataFrame, count: int | None, seed: int = S.SEED) -> tuple[DataFrame, DataFrame]:
    d = S.stratified_split(docs, seed=seed)
    test = S.query_subset(d.filter("is_test").drop("is_test"), count, seed=seed)
    return d.filter("NOT is_test").drop("is_test"), test.withColumnRenamed("doc_id", "query_id")


def found_now(row: DataFrame) -> DataFrame:
    """A result of one row, computed once: plans of many variants together would fill the driver."""
    return row.sparkSession.createDataFrame(row.collect(), row.schema)


class HeldOut:
    """Every held-out document as a query, over counts that are made once for all splits and sets of stop words."""

    def __init__(self, docs: DataFrame):
        self.counts = K.counted(docs.select("doc_id", "text", "label"))
        self.splits: dict[int, tuple[DataFrame, DataFrame]] = {}
        self.stops: dict[tuple[str, ...], np.ndarray] = {}

    def split(self, seed: int = S.SEED) -> tuple[DataFrame, DataFrame]:
        if seed not in self.splits:
            d = S.stratified_split(self.counts, seed=seed)
            self.splits[seed] = d.filter("NOT is_test").drop("is_test"), d.filter("is_test").drop("is_test")
        return self.splits[seed]

    def stop(self, words: tuple[str, ...]) -> np.ndarray:
        if words not in self.stops:
            self.stops[words] = K.hashes(self.counts.sparkSession, words)
        return self.stops[words]

    def metrics(self, k: int, method: str = "tfidf", mode: str = "raw", stop_words: Iterable[str] | None = None, seed: int = S.SEED, fit: K.Fit | None = None) -> tuple[DataFrame, K.Searched]:
        """Per-query metrics of label retrieval as ``evaluate`` has them, and the search behind them."""
        from ..functions.text import STOP_WORDS

        train, test = self.split(seed)
        stop = self.stop(STOP_WORDS if stop_words is None else tuple(stop_words))
        found = K.search(train, test, k, method, mode, stop, fit)
        return self._ranked(found, train, test, k), found

    @staticmethod
    def _ranked(found: K.Searched, train: DataFrame, test: DataFrame, k: int) -> DataFrame:
        queries, docs = test.select(F.col("doc_id").alias("query_id"), "label"), train.select("doc_id", "label")
        return M.retrieval_metrics(R.padded_ranking(found.scores, queries, docs, k), queries, docs, k)

    def measures(self, k: int, method: str = "tfidf", mode: str = "raw", stop_words: Iterable[str] | None = None, seed: int = S.SEED, fit: K.Fit | None = None) -> tuple[DataFrame, K.Searched]:
        """(query_id, precision_at_k, ap_at_k) as ``metrics`` has them, from the labels of the k best only.

        Both are 1 where all k best are of the query's label, which ``blocks.unsettled`` shows without putting them in
        order; the other queries are searched.  The result's scores are those of the latter.
        """
        from ..functions.text import STOP_WORDS

        train, test = self.split(seed)
        spark = train.sparkSession
        fit = fit or K.fit(train, self.stop(STOP_WORDS if stop_words is None else tuple(stop_words)))
        fitted = spark.sparkContext.broadcast(fit)
        rest = K.unsettled(train, test, k, method, mode, fitted)
        fitted.destroy()
        asked = test.join(rest, "doc_id", "left_semi").select(*test.columns)
        found = K.search(train, asked, k, method, mode, np.zeros(0, np.int64), fit)
        one = F.lit(1.0)
        settled = test.join(rest, "doc_id", "left_anti").select(F.col("doc_id").alias("query_id"), one.alias("precision_at_k"), one.alias("ap_at_k"))
        return self._ranked(found, train, asked, k).select("query_id", "precision_at_k", "ap_at_k").unionByName(settled), found


def classified(docs: DataFrame, mode: str = "raw", stop_words: Iterable[str] | None = None, seed: int = S.SEED, max_iter: int = 10, held: HeldOut | None = None) -> DataFrame:
    """One row: accuracy and macro_f1 of a linear SVM on the held-out documents, whose labels are numbered here by name."""
    from ..functions.text import STOP_WORDS

    names = broadcast_if_few(docs.select("label").distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("_n")))
    words, number = STOP_WORDS if stop_words is None else tuple(stop_words), lambda d: d.join(names, "label").withColumn("label", F.col("_n")).drop("_n")
    if held is None:
        d = S.stratified_split(number(docs).select("doc_id", "text", "label"), seed=seed)
        out = C.classify(d.filter("NOT is_test").drop("is_test"), d.filter("is_test").drop("is_test"), mode, max_iter, words)
    else:
        out = C.classify_counted(*map(number, held.split(seed)), mode, max_iter, words)
    return found_now(M.accuracy(out).crossJoin(M.macro_f1(out)).select("accuracy", "macro_f1"))


def ablation_variant(docs: DataFrame, name: str, stop_words: Iterable[str], count: int | None, k: int, seed: int = S.SEED, classify: bool = False, held: HeldOut | None = None, fit: K.Fit | None = None) -> DataFrame:
    """One row: name, stop_word_count, vocabulary_size, precision_at_k, map_at_k; accuracy and macro_f1 if asked for.

    Where every held-out document is a query, ``held`` may share the counts, and ``fit`` the fit of the seed's terms.
    """
    words = tuple(stop_words)
    if count is None:
        held = held or HeldOut(docs)
        metrics, found = held.measures(k, stop_words=words, seed=seed, fit=fit and fit.without(held.stop(words)))
        means, size = found_now(M.mean_metrics(metrics)), docs.sparkSession.createDataFrame([(len(found.fit.ids),)], "vocabulary_size long")
    else:
        train, queries = held_out(docs, count, seed)
        space = V.Space(train.select("doc_id", "text"), words)
        size = space.vocab.agg(F.count("*").alias("vocabulary_size"))
        means = M.mean_metrics(evaluate(train, queries, k, stop_words=words, space=space))
    row = means.crossJoin(size).select(F.lit(name).alias("name"), F.lit(len(words)).alias("stop_word_count"), "vocabulary_size", "precision_at_k", "map_at_k")
    return row.crossJoin(classified(docs, "raw", words, seed, held=held)) if classify else row


def stop_word_ablation(docs: DataFrame, count: int | None = None, k: int = 10, seeds: Iterable[int] = ABLATION_SEEDS, classify: bool = False) -> DataFrame:
    """Both variants over all seeds, then mean and standard deviation by variant."""
    from ..functions.text import STOP_WORDS

    held = HeldOut(docs) if count is None else None

    def run(seed: int) -> list[DataFrame]:
        fit = held and K.fit_all(held.split(seed)[0])
        return [ablation_variant(docs, name, words, count, k, seed, classify, held, fit).withColumn("seed", F.lit(seed)) for name, words in (("default", STOP_WORDS), ("none", ()))]

    # Short jobs of one seed fill the cores that those of another leave; machines hold their histories in the driver.
    with ThreadPoolExecutor(1 if classify else SEEDS_AT_ONCE) as pool:
        rows = [r for both in pool.map(run, seeds) for r in both]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return M.summarize_runs(out, ["vocabulary_size", "precision_at_k", "map_at_k", *(("accuracy", "macro_f1") if classify else ())])


def tf_variants(docs: DataFrame, count: int | None = 100, k: int = 10, classify: bool = False) -> DataFrame:
    """(method, queries, empty_queries, train_nnz, precision_at_k, map_at_k) of the three TF modes and BM25 over one split.

    With ``classify``, accuracy and macro_f1 of a linear SVM by TF mode, null for BM25.
    """
    if count is None:
        return _tf_variants_held_out(docs, k, classify)
    train, queries = held_out(docs, count)
    space = V.Space(train.select("doc_id", "text"))
    empty = R.unanswerable(space, V.tokenized(queries, key="query_id")).agg(F.count("*").alias("empty_queries"))
    nnz = space.counts.agg(F.count("*").alias("train_nnz"))
    shared = empty.crossJoin(nnz)
    out = None
    for method, mode in [*(("tfidf", m) for m in V.TF_MODES), ("bm25", "raw")]:
        row = M.mean_metrics(evaluate(train, queries, k, method, mode, space=space)).crossJoin(shared)
        row = row.select(F.lit(method if method == "bm25" else mode).alias("method"), "queries", "empty_queries", "train_nnz", "precision_at_k", "map_at_k")
        if classify:
            none = row.sparkSession.createDataFrame([(None, None)], "accuracy double, macro_f1 double")
            row = row.crossJoin(classified(docs, mode) if method == "tfidf" else none)
        out = row if out is None else out.unionByName(row)
    return out


def _tf_variants_held_out(docs: DataFrame, k: int, classify: bool) -> DataFrame:
    held, fit, out = HeldOut(docs), None, None
    for method, mode in [*(("tfidf", m) for m in V.TF_MODES), ("bm25", "raw")]:
        metrics, found = held.measures(k, method, mode, fit=fit)
        fit = found.fit
        row = found_now(M.mean_metrics(metrics)).select(F.lit(method if method == "bm25" else mode).alias("method"), "queries", F.lit(found.empty).cast("long").alias("empty_queries"), F.lit(int(fit.df.sum())).cast("long").alias("train_nnz"), "precision_at_k", "map_at_k")
        if classify:
            none = row.sparkSession.createDataFrame([(None, None)], "accuracy double, macro_f1 double")
            row = row.crossJoin(classified(docs, mode, held=held) if method == "tfidf" else none)
        out = row if out is None else out.unionByName(row)
    return out


def timed(action: Callable[[], object], repeats: int = 5) -> list[float]:
    """Seconds of each repeat after one run that is not counted."""
    action()
    out = []
    for _ in range(repeats):
        began = time.perf_counter()
        action()
        out.append(time.perf_counter() - began)
    return out


def sizes(n_docs: int, wanted: Iterable[int] = (1_000, 5_000, 10_000)) -> list[int]:
    """The sizes that fit, and the whole."""
    return sorted({min(n, n_docs) for n in wanted} | {n_docs})


def prefix(docs: DataFrame, n: int) -> DataFrame:
    return docs.orderBy("doc_id").limit(n)


def scan_against_inverted(docs: DataFrame, queries: DataFrame, wanted: Iterable[int] = (1_000, 5_000, 10_000), k: int = 10, repeats: int = 5) -> list[dict]:
    """Latency of a query batch by either strategy over growing parts of the corpus."""
    rows = []
    for n in sizes(docs.count(), wanted):
        space = V.Space(prefix(docs, n).select("doc_id", "text"))
        postings = space.postings(["raw"], False).persist()
        postings.count()
        tokens = V.tokenized(queries, key="query_id").persist()
        for strategy in R.STRATEGIES:
            seconds = timed(lambda s=strategy: R.search_batch(space, tokens, k, strategy=s, postings=postings).collect(), repeats)  # noqa: B023
            stats = M.latency(docs.sparkSession.createDataFrame([(x,) for x in seconds], "seconds double")).first().asDict()
            rows.append({"documents": n, "strategy": strategy} | stats)
        postings.unpersist()
        tokens.unpersist()
    return rows

"""Term counts, vocabulary, TF-IDF and BM25 weights as long tables of (doc_id, term, value)."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, tokenize
from .sizes import broadcast_if_few

TF_MODES = ("raw", "log", "double")
K1, B = 1.5, 0.75


def tokenized(docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens), dealt by key: counts, maxima and norms of a document then need no further shuffle."""
    return docs.select(key, F.col(text).alias("_t")).repartition(key).select(key, tokenize(F.col("_t"), stop_words).alias("tokens"))


def term_counts(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, count) with count over zero."""
    return tokens.select(key, F.explode("tokens").alias("term")).groupBy(key, "term").agg(F.count("*").alias("count"))


def doc_lengths(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, length): all tokens, those out of any vocabulary included; 0 for a document without."""
    return tokens.select(key, F.size("tokens").cast("long").alias("length"))


def vocabulary(counts: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf, bm25_idf); N counts all documents, those without tokens too.

    Grouped by the term and a hash of it: a join on the term then shuffles the few rows of the vocabulary once more, which
    lets the skew join split the other side.
    """
    df = F.col("df")
    return counts.groupBy("term", F.xxhash64("term").alias("_h")).agg(F.count("*").alias("df")).select(
        "term", "df", (F.ln((1.0 + F.lit(n_docs)) / (1.0 + df)) + 1.0).alias("idf"), F.ln(1.0 + (F.lit(n_docs) - df + 0.5) / (df + 0.5)).alias("bm25_idf")
    )


def numbered(vocab: DataFrame) -> DataFrame:
    """Adds term_id, the 0-based place in code-point order.  For display and export: joins go by term.

    Terms are counted by their first two characters; a term's place is what comes before its beginning, and its place
    among those that begin alike.
    """
    begins = F.substring("term", 1, 2)
    sizes = vocab.groupBy(begins.alias("_p")).agg(F.count("*").alias("_n"))
    # One row for each beginning: at most 26 * 26 of them, as terms are a to z.
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy("term")) - 1
    numbered_ = vocab.withColumn("_b", begins).withColumn("_own", own).join(broadcast_if_few(before), F.col("_b") == F.col("_p"))
    return numbered_.withColumn("term_id", F.col("_own") + F.col("_before")).drop("_b", "_p", "_own", "_before")


def with_vocabulary(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Inner join on term: what is out of vocabulary goes.

    Both sides of the join are plain shuffles (see ``vocabulary``), so that a small vocabulary is broadcast at run time and
    the postings of a very frequent term are split by the skew join.
    """
    return counts.join(vocab, "term")


def tf(mode: str, key: str = "doc_id"):
    if mode == "raw":
        return F.col("count").cast("double")
    if mode == "log":
        return 1.0 + F.ln("count")
    if mode == "double":
        return 0.5 + 0.5 * F.col("count") / F.max("count").over(Window.partitionBy(key))
    raise ValueError(f"unknown TF mode: {mode}")


def tfidf(joined: DataFrame, modes: Iterable[str] = TF_MODES, key: str = "doc_id") -> DataFrame:
    """(key, term, count, idf, ...) with an L2-normalised column w_<mode> for each mode."""
    modes = tuple(modes)
    own = Window.partitionBy(key)
    out = joined.withColumns({f"_{m}": tf(m, key) * F.col("idf") for m in modes})
    return out.withColumns({f"w_{m}": F.col(f"_{m}") / F.sqrt(F.sum(F.col(f"_{m}") * F.col(f"_{m}")).over(own)) for m in modes}).drop(*[f"_{m}" for m in modes])


def check_bm25(k1: float, b: float) -> None:
    if not (math.isfinite(k1) and k1 >= 0):
        raise ValueError("k1 must be finite and nonnegative")
    if not (math.isfinite(b) and 0 <= b <= 1):
        raise ValueError("b must be finite and between 0 and 1")


def bm25(joined: DataFrame, lengths: DataFrame, average: float, k1: float = K1, b: float = B, key: str = "doc_id") -> DataFrame:
    """Adds w_bm25 to (key, term, count, bm25_idf, ...); with an average length of 0 the ratio counts as 0."""
    check_bm25(k1, b)
    ratio = F.col("length") / F.lit(float(average)) if average > 0 else F.lit(0.0)
    f = F.col("count").cast("double")
    return joined.join(lengths, key).withColumn("w_bm25", F.col("bm25_idf") * f * (k1 + 1.0) / (f + k1 * (1.0 - b + b * ratio)))


class Space:
    """A fitted corpus: tokens, counts, vocabulary and all weights, sharing one dealing of the documents."""

    def __init__(self, docs: DataFrame, stop_words: Iterable[str] = STOP_WORDS, k1: float = K1, b: float = B):
        self.stop_words, self.k1, self.b = tuple(stop_words), k1, b
        check_bm25(k1, b)
        self.tokens = tokenized(docs, self.stop_words)
        self.counts = term_counts(self.tokens)
        self.lengths = doc_lengths(self.tokens)
        self.n_docs = docs.count()
        self.vocab = vocabulary(self.counts, self.n_docs)

    @cached_property
    def average(self) -> float:
        """The mean document length, found when it is first needed."""
        return float(self.lengths.agg(F.coalesce(F.avg("length"), F.lit(0.0))).first()[0])

    def require_terms(self) -> Space:
        if self.vocab.isEmpty():
            raise ValueError("vocabulary is empty")
        return self

    def postings(self, modes: Iterable[str] = TF_MODES, with_bm25: bool = True) -> DataFrame:
        """(doc_id, term, count, df, idf, w_<mode>..., length, w_bm25)."""
        out = tfidf(with_vocabulary(self.counts, self.vocab), modes)
        return bm25(out, self.lengths, self.average, self.k1, self.b) if with_bm25 else out

    def transform(self, docs: DataFrame, modes: Iterable[str] = TF_MODES, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Weights of other texts in this space: its vocabulary and IDF, their own norms."""
        counts = term_counts(tokenized(docs, self.stop_words, key, text), key)
        return tfidf(with_vocabulary(counts, self.vocab), modes, key)


def invalid_cells(cells: DataFrame, vocab: DataFrame, n_docs: int, column: str = "count", ids: DataFrame | None = None) -> DataFrame:
    """(problem, cells) of a matrix (doc_id, term, <column>): every kind of problem, with 0 where there is none.

    Cells that stand twice, values that are null, not finite or zero, terms out of the vocabulary, documents out of
    ``ids`` (doc_id) if these are given, and more documents than ``n_docs``.
    """
    value = F.col(column).cast("double")
    bad = F.count_if(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value == 0))
    twice = cells.groupBy("doc_id", "term").count().filter("count > 1").agg(F.lit("repeated cells").alias("problem"), F.count("*").alias("cells"))
    values = cells.agg(F.lit("values").alias("problem"), bad.alias("cells"))
    terms = cells.join(vocab.select("term"), "term", "left_anti").agg(F.lit("unknown terms").alias("problem"), F.count("*").alias("cells"))
    out = twice.unionByName(values).unionByName(terms)
    if ids is not None:
        out = out.unionByName(cells.join(ids.select("doc_id"), "doc_id", "left_anti").agg(F.lit("unknown documents").alias("problem"), F.count("*").alias("cells")))
    return out.unionByName(cells.agg(F.lit("documents over the shape").alias("problem"), F.greatest(F.count_distinct("doc_id") - F.lit(n_docs), F.lit(0)).alias("cells")))


def validated(cells: DataFrame, vocab: DataFrame, n_docs: int, column: str = "count", ids: DataFrame | None = None) -> DataFrame:
    """The matrix itself, if nothing is wrong with it."""
    wrong = [f"{r.cells} {r.problem}" for r in invalid_cells(cells, vocab, n_docs, column, ids).filter("cells > 0").collect()]
    if wrong:
        raise ValueError("invalid sparse matrix: " + ", ".join(sorted(wrong)))
    return cells


def matrix_stats(postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """One row: shape, nnz, density and the bytes of dense, row-wise and posting layouts."""
    cells = n_docs * n_terms
    nnz = F.count("*")
    return postings.agg(nnz.alias("nnz")).select(
        F.lit(n_docs).cast("long").alias("n_docs"), F.lit(n_terms).cast("long").alias("n_terms"), "nnz",
        (F.when(F.lit(cells) > 0, F.col("nnz") / F.lit(max(cells, 1))).otherwise(0.0)).alias("density"),
        (F.col("nnz") * 12 + 4 * (n_docs + 1)).cast("long").alias("sparse_bytes"), F.lit(8 * cells).cast("long").alias("dense_bytes"),
        (F.col("nnz") * 12 + 4 * (n_terms + 1)).cast("long").alias("posting_bytes"),
    )

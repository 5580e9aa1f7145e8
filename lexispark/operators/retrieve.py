"""Cosine and BM25 retrieval over postings: single and batched, by inverted join or full scan, with exact top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectorize import Space

TIE_DECIMALS = 12
TOLERANCE = 1e-12
STRATEGIES = ("scan", "inverted")
#: Query terms of at most so many rows (about 40 bytes each) are broadcast to the postings.
MOST_QUERY_TERMS = 200_000
#: Numbers of a block of the query matrix of a scan.
SCAN_CELLS = 4 << 20


def check_topk(topk: object, n_docs: int) -> int:
    if isinstance(topk, bool) or not isinstance(topk, int) or not 1 <= topk <= n_docs:
        raise ValueError(f"topk must be an integer between 1 and {n_docs}")
    return topk


def best_first(score: str = "score", key: str = "doc_id"):
    """Larger scores first, equal to 12 decimals means tied, ties by id."""
    return [F.bround(score, TIE_DECIMALS).desc(), F.col(key).asc()]


def query_weights(space: Space, queries: DataFrame, method: str, mode: str) -> DataFrame:
    """(query_id, term, weight): normalised TF-IDF of the query, or 1 for each distinct term for BM25."""
    if method == "bm25":
        terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term"))
        return terms.join(space.vocab.select("term"), "term").select("query_id", "term", F.lit(1.0).alias("weight"))
    from .vectorize import term_counts, tfidf, with_vocabulary

    joined = with_vocabulary(term_counts(queries, "query_id"), space.vocab)
    return tfidf(joined, [mode], "query_id").select("query_id", "term", F.col(f"w_{mode}").alias("weight"))


def few_terms(queries: DataFrame) -> bool:
    """Whether the queries' distinct terms, counted, are few enough to be broadcast."""
    return (queries.agg(F.sum(F.size(F.array_distinct("tokens")))).first()[0] or 0) <= MOST_QUERY_TERMS


def exact_sum(value) -> Column:
    """The sum of nonnegative numbers under 2**33 to 2**-70, the same in any order: sums of whole numbers in two parts.

    A sum of doubles depends on their order in its last bits, and rounding would then tell apart what is tied.
    """
    high = F.floor(value * 2.0**30)
    low = F.floor((value * 2.0**30 - high) * 2.0**40)
    return (F.sum(high) + F.sum(low) / 2.0**40) / 2.0**30


def scores_inverted(postings: DataFrame, weights: DataFrame, column: str, small: bool = False) -> DataFrame:
    """(query_id, doc_id, score): only postings of query terms are touched; partial sums before the shuffle.

    ``small`` says that the weights were counted and may be broadcast (see ``few_terms``).
    """
    side = F.broadcast(weights) if small else weights
    return postings.select("doc_id", "term", F.col(column).alias("_w")).join(side, "term").groupBy("query_id", "doc_id").agg(exact_sum(F.col("_w") * F.col("weight")).alias("score"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best positive scores: larger first, equal to 12 decimals by id."""
    near = np.flatnonzero(scores > 0)
    if len(near) > 4 * k:
        near = near[scores[near] >= np.partition(scores[near], len(near) - k)[len(near) - k] - 10.0**-TIE_DECIMALS]
    return near[np.lexsort((ids[near], -np.round(scores[near], TIE_DECIMALS)))][:k]


def scan_top_k(postings: DataFrame, weights: DataFrame, column: str, k: int) -> DataFrame:
    """The k best of each query from a scan of every document against all queries, no posting list being looked up.

    Queries are a bounded batch, counted before they are brought to the driver: a matrix of their terms, with which each
    task multiplies its documents, block by block of queries.  Only a task's k best of each query leave it.
    """
    rows = weights.limit(MOST_QUERY_TERMS + 1).toPandas()
    if len(rows) > MOST_QUERY_TERMS:
        raise ValueError(f"a scan takes queries of at most {MOST_QUERY_TERMS} terms at a time; search by the inverted join")
    names, at = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
    terms = pd.Index(rows["term"].unique())
    place, value = terms.get_indexer(rows["term"]), rows["weight"].to_numpy(np.float64)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = max(1, SCAN_CELLS // max(len(terms), 1))
        blocks = []
        for a in range(0, len(names), width):
            own = (at >= a) & (at < a + width)
            block = np.zeros((len(terms), min(width, len(names) - a)))
            block[place[own], at[own] - a] = value[own]
            blocks.append(block)
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(names)

        def take(frame: pd.DataFrame) -> None:
            found = terms.get_indexer(frame["term"])
            known = found >= 0
            ids, found, w = frame["doc_id"].to_numpy()[known], found[known], frame["w"].to_numpy(np.float64)[known]
            if not len(ids):
                return
            starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
            own = ids[starts]
            for b, block in enumerate(blocks):
                scores = np.add.reduceat(w[:, None] * block[found], starts, axis=0)
                for q in np.flatnonzero((scores > 0).any(axis=0)):
                    i = b * width + q
                    s, d = np.concatenate([held[i][0], scores[:, q]]), np.concatenate([held[i][1], own])
                    best = _best(s, d, k)
                    held[i] = s[best], d[best]

        rest = None
        for frame in frames:
            if not len(frame):
                continue
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            ids = rest["doc_id"].to_numpy()
            # The last document may go on in the next batch.
            whole = len(ids) - int((ids == ids[-1]).sum())
            take(rest.iloc[:whole])
            rest = rest.iloc[whole:]
        if rest is not None:
            take(rest)
        yield pd.DataFrame({"query_id": np.repeat(names, [len(s) for s, _ in held]), "doc_id": np.concatenate([d for _, d in held]) if held else [], "score": np.concatenate([s for s, _ in held]) if held else []})

    types = dict(weights.dtypes) | dict(postings.dtypes)
    documents = postings.select("doc_id", "term", F.col(column).alias("w")).repartition("doc_id").sortWithinPartitions("doc_id")
    return top_k(documents.mapInPandas(scan, f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double"), k)


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best positive scores of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first()))
    return scores.filter("score > 0").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def search_batch(space: Space, queries: DataFrame, k: int, method: str = "tfidf", mode: str = "raw", strategy: str = "inverted", postings: DataFrame | None = None) -> DataFrame:
    """(query_id, tokens) -> top k each.  Queries without a known term have no rows; ``unanswerable`` lists them."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    weights = query_weights(space, queries, method, mode)
    column = "w_bm25" if method == "bm25" else f"w_{mode}"
    if postings is None:
        postings = space.postings([mode] if method != "bm25" else [], method == "bm25")
    if strategy == "scan":
        return scan_top_k(postings, weights, column, k)
    return top_k(scores_inverted(postings, weights, column, few_terms(queries)), k)


def unanswerable(space: Space, queries: DataFrame) -> DataFrame:
    """(query_id) of the queries without any term of the vocabulary."""
    known = queries.select("query_id", F.explode("tokens").alias("term")).join(space.vocab.select("term"), "term", "left_semi")
    return queries.select("query_id").join(known, "query_id", "left_anti")


def padded_ranking(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score): exactly k rows where there are k documents, others filling up by smallest doc_id.

    A query with p < k positive scores needs at most the k smallest ids, as no more than p of those are positive.
    """
    positive = top_k(scores, k)
    fill = docs.select("doc_id").orderBy("doc_id").limit(k)
    rest = queries.select("query_id").crossJoin(F.broadcast(fill)).join(positive.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = positive.select("query_id", "doc_id", "score", F.lit(0).alias("_late")).unionByName(rest.select("query_id", "doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("_late")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_late", *best_first()))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def consistency(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: rows in both rankings, rows in one only, largest score difference, and whether they agree to 1e-12."""
    a = one.select("query_id", "doc_id", F.col("score").alias("a"))
    b = other.select("query_id", "doc_id", F.col("score").alias("b"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    out = both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unshared"), F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("largest"))
    return out.withColumn("consistent", (F.col("unshared") == 0) & (F.col("largest") <= TOLERANCE)).select("shared", "unshared", "consistent")


def rank_shift(base: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, doc_id, base_rank, other_rank) of the rows whose rank differs; null is outside the list."""
    a = base.select("query_id", "doc_id", F.col("rank").alias("base_rank"))
    b = other.select("query_id", "doc_id", F.col("rank").alias("other_rank"))
    return a.join(b, ["query_id", "doc_id"], "full_outer").filter(~F.col("base_rank").eqNullSafe(F.col("other_rank")))


def compared(base: DataFrame, other: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query_id, doc_id, base_rank, other_rank, length) of the rows of either list; a null rank is outside the list."""
    a = base.select("query_id", "doc_id", F.col("rank").alias("base_rank"))
    b = other.select("query_id", "doc_id", F.col("rank").alias("other_rank"))
    return a.join(b, ["query_id", "doc_id"], "full_outer").join(lengths.select("doc_id", "length"), "doc_id").select("query_id", "doc_id", "base_rank", "other_rank", "length")


def overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, overlap): documents that both lists hold."""
    return one.select("query_id", "doc_id").join(other.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("overlap"))

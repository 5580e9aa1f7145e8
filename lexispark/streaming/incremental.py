"""An extension: documents that keep arriving are sanitized and scored against a stored index's frozen vocabulary.

Tokens, counts and weights of a document depend on nothing but itself and the vocabulary, so the stream carries no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import redact, tokenize
from ..operators.retrieve import query_weights
from ..sources.store import Index

SCHEMA = "doc_id long, text string"


def read_stream(spark: SparkSession, folder: str, files_at_a_time: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_a_time).parquet(folder)


def scored(stream: DataFrame, index: Index, query: str) -> DataFrame:
    """(doc_id, clean, score): the BM25 score of each arriving document for one query; only positive scores pass.

    BM25 is used as it needs no norm over the document's other terms.  The query's terms and their IDF are read from the
    index once and stand in the plan, so a batch of documents is one narrow projection.
    """
    terms = query_weights(index, index.tokens(query), "bm25", "raw").join(index.vocab, "term").select("term", "bm25_idf").collect()
    if not terms:
        raise ValueError("query has no terms in the fitted vocabulary")
    average, k1, b = index.manifest["average_length"], index.manifest["k1"], index.manifest["b"]
    tokens = redact(stream).withColumn("tokens", tokenize(F.col("text"), index.stop_words))
    ratio = F.size("tokens") / F.lit(average) if average > 0 else F.lit(0.0)
    score = F.lit(0.0)
    for r in terms:
        f = (F.size("tokens") - F.size(F.array_remove("tokens", r.term))).cast("double")
        score = score + F.lit(r.bm25_idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * ratio))
    return tokens.select("doc_id", "clean", score.alias("score")).filter("score > 0")

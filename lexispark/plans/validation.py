"""The weights against an implementation that shares no code with the fit: Spark's ML pipeline."""

from __future__ import annotations

from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vectorize import Space

TOLERANCE = 1e-6
#: Terms that the reference pipeline, whose vocabulary is held by the driver, can number.
MOST_TERMS = 1 << 24


def ml_weights(docs: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    """(doc_id, text) -> (doc_id, term, w): raw TF-IDF, normalised, by tokenizer, counts, IDF and norm of Spark ML.

    Its IDF is ln((1 + N) / (1 + df)); ours has one more.
    """
    words = RegexTokenizer(inputCol="text", outputCol="_words", pattern="[a-z]+", gaps=False, minTokenLength=2).transform(docs.select("doc_id", "text"))
    kept = StopWordsRemover(inputCol="_words", outputCol="_kept", stopWords=list(stop_words), caseSensitive=True).transform(words) if stop_words else words.withColumn("_kept", F.col("_words"))
    counter = CountVectorizer(inputCol="_kept", outputCol="_counts", vocabSize=MOST_TERMS, minDF=1.0).fit(kept)
    counts = counter.transform(kept)
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(counts).idf.toArray() + 1.0
    scaled = ElementwiseProduct(inputCol="_counts", outputCol="_scaled", scalingVec=Vectors.dense(idf)).transform(counts)
    unit = Normalizer(inputCol="_scaled", outputCol="_unit", p=2.0).transform(scaled)
    cells = F.udf(lambda v: [(int(i), float(x)) for i, x in zip(v.indices, v.values, strict=True)], "array<struct<i:int,w:double>>")
    names = docs.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "i int, term string")
    return unit.select("doc_id", F.explode(cells("_unit")).alias("c")).select("doc_id", "c.i", "c.w").join(names, "i").select("doc_id", "term", "w")


def validate_weights(space: Space, docs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row: n_docs, n_terms, cells, max_error, mean_error (over all cells of the matrix) and passed.

    A cell that only one side has counts with its whole weight.
    """
    ours = space.postings(["raw"], False).select("doc_id", "term", F.col("w_raw").alias("a"))
    both = ours.join(ml_weights(docs, space.stop_words).withColumnRenamed("w", "b"), ["doc_id", "term"], "full_outer")
    error = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    n_terms = space.vocab.count()
    out = both.agg(F.count("*").alias("cells"), F.coalesce(F.max(error), F.lit(0.0)).alias("max_error"), F.coalesce(F.sum(error), F.lit(0.0)).alias("_sum"))
    size = float(max(space.n_docs * n_terms, 1))
    return out.select(F.lit(space.n_docs).cast("long").alias("n_docs"), F.lit(n_terms).cast("long").alias("n_terms"), "cells", "max_error", (F.col("_sum") / size).alias("mean_error"), (F.col("max_error") <= tolerance).alias("passed"))

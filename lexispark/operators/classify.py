"""Linear text classification: sparse vectors, one-vs-rest linear SVMs, and what they got wrong."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, safe_snippet
from . import blocks

MAX_ERRORS = 20
#: An optimizer holds about so many vectors of the vocabulary's size in the driver (ten pairs, a point and a gradient).
HISTORY_VECTORS = 22
#: What all machines that are trained at the same time may hold of such vectors, if it is more than one.
HISTORY_BYTES, MOST_AT_ONCE = 128 << 20, 4


def features(counts: DataFrame, found: blocks.Fit, mode: str) -> DataFrame:
    """``blocks.counted`` rows -> (doc_id, label, features): sparse TF-IDF vectors; a document without terms is all zeros."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    size, fitted = len(found.ids), counts.sparkSession.sparkContext.broadcast(found)
    to_vector = F.udf(lambda i, w: SparseVector(size, i, w), VectorUDT())
    return blocks.weighed_rows(counts, fitted, "tfidf", mode, False).select("doc_id", "label", to_vector("i", "w").alias("features"))


def trained_at_once(size: int) -> int:
    """How many machines may be trained at a time, each of which holds its history in the driver."""
    return max(1, min(MOST_AT_ONCE, HISTORY_BYTES // (8 * HISTORY_VECTORS * max(size, 1))))


def train_svm(vectors: DataFrame, max_iter: int = 10, reg: float = 0.01, parallelism: int = 4):
    """One linear SVM for each label (0, 1, ...) against the rest; at least two labels."""
    if max_iter < 1:
        raise ValueError("epochs must be positive")
    if vectors.select("label").distinct().limit(2).count() < 2:
        raise ValueError("linear SVM training requires at least two classes")
    vectors = vectors.withColumn("label", F.col("label").cast("double"))
    return OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=reg), parallelism=parallelism).fit(vectors)


def classify_counted(train: DataFrame, test: DataFrame, mode: str = "raw", max_iter: int = 10, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(doc_id, label, prediction) of the test rows, both as ``blocks.counted`` makes them; the space is fitted on train alone."""
    found = blocks.fit(train, blocks.hashes(train.sparkSession, stop_words))
    if not len(found.ids):
        raise ValueError("vocabulary is empty")
    own = features(train, found, mode).persist()
    try:
        model = train_svm(own, max_iter, parallelism=trained_at_once(len(found.ids)))
    finally:
        own.unpersist()
    # Predicted once: every measure of them would plan and run all machines again.
    return blocks.scratch(model.transform(features(test, found, mode)).select("doc_id", "label", F.col("prediction").cast("int").alias("prediction")), "predicted")


def classify(train: DataFrame, test: DataFrame, mode: str = "raw", max_iter: int = 10, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(doc_id, text, label) twice -> (doc_id, label, prediction) of the test rows; the space is fitted on train alone."""
    return classify_counted(*(blocks.counted(d.select("doc_id", "text", "label"), stop_words) for d in (train, test)), mode, max_iter, ())


def misclassified(predictions: DataFrame, docs: DataFrame, names: DataFrame, n: int = MAX_ERRORS) -> DataFrame:
    """(doc_id, actual, predicted, text_snippet) of the first ``n`` wrong documents by id."""
    wrong = predictions.filter("label <> prediction").orderBy("doc_id").limit(n).join(docs.select("doc_id", "text"), "doc_id")
    name = lambda on, out: names.select(F.col("label").alias(on), F.col("name").alias(out))
    named = wrong.join(F.broadcast(name("label", "actual")), "label").join(F.broadcast(name("prediction", "predicted")), "prediction")
    return safe_snippet(named, "text", name="text_snippet").select("doc_id", "actual", "predicted", "text_snippet")

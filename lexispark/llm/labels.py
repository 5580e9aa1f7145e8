"""Labelled rows that classifiers learn from: one mark a document, a fold left out, and a sample bounded in rows and bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Marks (12 bytes each) up to this many are broadcast to the documents; more are joined by shuffle.
MOST_MARKS_BROADCAST = 2_000_000
#: Bytes of text of each class in a sample, and of a text that may teach at all.
MOST_BYTES, MOST_TEXT_BYTES = 48 << 20, 8 << 20
_PARTS = 1 << 40


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, mod ``folds``, is ``fold``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)) == fold


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, y): 1 if any row of the document says so; rows without id or label teach nothing."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, folds: int, fold: int, most: int, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, y, text) of a sample, labelled documents by class), none of them of the held-out fold.

    Of each class about ``most`` documents and ``most_bytes`` bytes at most, drawn by a hash of id and text.  Documents
    repeated with the same id and text count once; a text of over MOST_TEXT_BYTES bytes does not teach.
    """
    marks = common.materialize(one_label(labels, name).filter(~held_out(F.col("doc_id"), folds, fold)), "marks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = texts.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    keys = keys.join(common.broadcast_if_small(marks, marks.count(), MOST_MARKS_BROADCAST), "doc_id").dropDuplicates(["doc_id", "h"])
    keys = common.materialize(keys, "labelled")
    small = F.col("bytes") <= min(MOST_TEXT_BYTES, most_bytes)
    sizes = {r.y: r for r in keys.groupBy("y").agg(F.count("*").alias("n"), F.count_if(small).alias("few"), F.sum(F.when(small, F.col("bytes"))).alias("bytes")).collect()}
    taken = F.lit(False)
    for y, r in sizes.items():
        share = min(1.0, most / max(r.few, 1), most_bytes / max(r.bytes or 0, 1))
        taken = taken | ((F.col("y") == y) & (F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "h"), F.lit(_PARTS)) < F.lit(math.ceil(share * _PARTS))))
    drawn = keys.filter(small & taken).select(F.col("doc_id").alias("d"), "h", "y")
    sample = texts.join(F.broadcast(drawn), (F.col("doc_id") == F.col("d")) & (F.xxhash64("text") == F.col("h"))).dropDuplicates(["doc_id", "h"])
    return common.materialize(sample.select("doc_id", "y", "text"), "sample"), {y: r.n for y, r in sizes.items()}

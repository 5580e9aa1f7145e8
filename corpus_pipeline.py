"""A corpus pipeline: five stages over the documents table, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept.  All but the last return the columns of ``documents``; the last adds
what the mix decided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import common
from lexispark.llm.decontam import drop_contaminated
from lexispark.llm.jaccard import one_of_each_class
from lexispark.llm.lines import deduped
from lexispark.llm.mixing import mixed_documents
from lexispark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go, row by row: others with their doc_id, or without one, stay."""
    return drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from their documents; a document that had lines and lost all of them goes, too.

    Rows of the same doc_id and text are one document here and stay or go together; the next stage keeps one of them.
    """
    kept = deduped(docs).filter("NOT emptied").select("row.*")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: the smallest doc_id, nulls last, then by hashes of text and row.

    Rows of one doc_id with unlike texts are documents of their own; wordless and null texts all stay.
    """
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, row by row: others with their doc_id, or without one, stay."""
    return drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, and how often it repeats each; rows of one doc_id with unlike texts are drawn apart."""
    return mixed_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("benchmark decontamination", decontamination), ("mixing sources to target weights", mixing)]

#: The first stage is a learned model, which SQL cannot express; the tests run the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    first = common.written()
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        # What this stage and the one before it left in the shared folder is no longer read.
        common.remove_scratch(spark, first, common.written() - 1)
    return docs

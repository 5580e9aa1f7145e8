"""The corpus source: sanitizing, validation in one pass, the privacy report and the fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import KINDS, redact

MINIMUM_DOCUMENTS = 500
FULL_CATEGORIES = 20
#: A column with more different values is refused as a label.
MOST_CATEGORIES = 100_000


def read_documents(spark: SparkSession, path: str, label: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, label), (label, name): labels number the names in code-point order; a small dimension.

    A document without a label belongs to no category and is left out.
    """
    raw = spark.read.parquet(path).select("doc_id", "text", F.col(label).alias("name"))
    found = raw.select("name").filter("name IS NOT NULL").distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"{label} has over {MOST_CATEGORIES} different values and is no label")
    categories = spark.createDataFrame(list(enumerate(sorted(r[0] for r in found))), "label int, name string")
    return raw.join(F.broadcast(categories), "name").select("doc_id", "text", "label"), categories


def load(docs: DataFrame) -> DataFrame:
    """Sanitized documents that are not empty: doc_id, text, label.  Ids stay as they were, with gaps."""
    return redact(docs).filter("clean <> ''").select("doc_id", F.col("clean").alias("text"), "label")


def validate(docs: DataFrame, minimum: int = MINIMUM_DOCUMENTS) -> int:
    """The number of documents, if they can be used; one pass."""
    n, null, blank, ids, labels = docs.agg(
        F.count("*"), F.count_if(F.col("text").isNull()), F.count_if(F.trim(F.col("text")) == ""), F.count_distinct("doc_id"), F.count_distinct("label")
    ).first()
    if n < minimum:
        raise ValueError(f"dataset must contain at least {minimum} documents")
    if null:
        raise ValueError("dataset texts must be strings")
    if blank:
        raise ValueError("dataset texts must not be blank")
    if ids != n:
        raise ValueError("document ids must be unique")
    if labels < 2:
        raise ValueError("dataset must contain at least two labels")
    return n


def validate_categories(docs: DataFrame, categories: DataFrame, expected: int = FULL_CATEGORIES) -> None:
    """Exactly ``expected`` different names, numbered from 0 without gaps, each with documents."""
    rows = categories.collect()
    if len(rows) != expected or len({r.name for r in rows}) != expected:
        raise ValueError(f"dataset must have {expected} unique categories")
    if sorted(r.label for r in rows) != list(range(expected)):
        raise ValueError("category ids must count from 0")
    if {r.label for r in docs.select("label").distinct().collect()} != set(range(expected)):
        raise ValueError("every category must occur, and no other")


def category_report(docs: DataFrame, categories: DataFrame) -> DataFrame:
    """(name, raw, retained, excluded) of every category, those without documents too."""
    counts = redact(docs).groupBy("label").agg(F.count("*").alias("raw"), F.count_if(F.col("clean") != "").alias("retained"), F.count_if(F.col("clean") == "").alias("excluded"))
    return categories.join(counts, "label", "left").select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "retained", "excluded")])


def category_map(report: DataFrame) -> DataFrame:
    """One row: ``categories``, a map of each name to its counts; categories are a small dimension."""
    counts = F.struct("raw", "retained", "excluded")
    return report.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("name"), counts.alias("counts"))))).alias("categories"))


def privacy_summary(docs: DataFrame) -> DataFrame:
    """One row: documents in, retained and dropped, the retention rate (0 for none) and redactions by kind."""
    kept = F.count_if(F.col("clean") != "")
    rate = F.when(F.count("*") > 0, kept / F.count("*")).otherwise(0.0)
    sums = [F.coalesce(F.sum(f"n_{kind}"), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return redact(docs).agg(F.count("*").alias("documents_input"), kept.alias("documents_retained"), F.count_if(F.col("clean") == "").alias("documents_dropped"), rate.alias("retention_rate"), *sums)


def row_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h): SHA-256 of id, label and text, each with its length, so that no two rows are written alike."""
    part = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return docs.select("doc_id", F.sha2(F.concat(part(F.col("doc_id").cast("string")), part(F.col("label").cast("string")), part(F.col("text"))), 256).alias("h"))


def fingerprint(docs: DataFrame) -> str:
    """One digest of all rows in any order: sums of the halves of their digests, so nothing is gathered or sorted."""
    rows = row_fingerprints(docs)
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    sums = rows.agg(F.count("*"), *words).first()
    return rows.sparkSession.range(1).select(F.sha2(F.lit("/".join(str(x) for x in sums)), 256)).first()[0]

"""Deterministic stratified splits by a hash of seed and id.

The order of a class is that of md5(seed:doc_id), so a split depends on no engine's random numbers and no row order.  A
split is a threshold for each class, found by counting: documents are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizes import broadcast_if_few

TEST_SHARE, SEED = 0.2, 42


def _order(seed: int):
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), F.col("doc_id")]


#: The order is looked at through the first hexadecimal digits of the hash, one bucket for each value.
BUCKET_DIGITS = 4


def _thresholds(keys: DataFrame, takes: DataFrame) -> DataFrame:
    """(_l, _k, _d) by label, hash and id; (_l, _take) -> (_l, _last): the hash and id of each label's last row that is taken.

    Rows are counted by label and bucket; only those of the bucket in which a label's number runs out are put in order.
    """
    bucket = F.conv(F.substring("_k", 1, BUCKET_DIGITS), 16, 10).cast("int")
    counts = keys.groupBy("_l", bucket.alias("_b")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_l").orderBy("_b"))
    held = counts.withColumn("_upto", upto).join(takes.withColumnRenamed("_l", "_m"), F.col("_l").eqNullSafe(F.col("_m")))
    edges = held.filter((F.col("_upto") >= F.col("_take")) & (F.col("_upto") - F.col("_n") < F.col("_take"))).select(F.col("_l").alias("_m"), "_b", (F.col("_take") - F.col("_upto") + F.col("_n")).alias("_rest"))
    inside = keys.join(broadcast_if_few(edges), F.col("_l").eqNullSafe(F.col("_m")) & (bucket == F.col("_b")))
    place = F.row_number().over(Window.partitionBy("_l").orderBy("_k", "_d"))
    return inside.withColumn("_place", place).filter(F.col("_place") == F.col("_rest")).select(F.col("_l").alias("_m"), F.struct("_k", "_d").alias("_last"))


def _keyed(docs: DataFrame, label: str, seed: int) -> DataFrame:
    key, doc_id = _order(seed)
    return docs.select(F.col(label).alias("_l"), key.alias("_k"), doc_id.alias("_d"))


def _is_taken(docs: DataFrame, thresholds: DataFrame, label: str, seed: int, name: str) -> DataFrame:
    """Adds ``name``: whether a row comes no later than its label's last one; texts are not moved."""
    rows = docs.join(broadcast_if_few(thresholds), F.col(label).eqNullSafe(F.col("_m")), "left")
    key, doc_id = _order(seed)
    return rows.withColumn(name, F.coalesce(F.struct(key.alias("_k"), doc_id.alias("_d")) <= F.col("_last"), F.lit(False))).drop("_m", "_last")


def stratified_split(docs: DataFrame, label: str = "label", share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Adds is_test: in each class the first ceil(share * size) documents in hash order."""
    keys = _keyed(docs, label, seed)
    takes = keys.groupBy("_l").agg(F.ceil(F.lit(share) * F.count("*")).alias("_take"))
    return _is_taken(docs, _thresholds(keys, takes), label, seed, "is_test")


def query_subset(test: DataFrame, count: int | None, label: str = "label", seed: int = SEED) -> DataFrame:
    """``count`` documents in proportion to their classes; all for None or a larger count.

    With fewer queries than classes it is a plain sample.  Otherwise classes get the whole part of their share, and the
    largest remainders, then the smaller label, one more.
    """
    if count is None:
        return test
    keys = _keyed(test, label, seed)
    n, classes = keys.agg(F.count("*"), F.count_distinct("_l")).first()
    if count >= n:
        return test
    if count < classes:
        return test.orderBy(*_order(seed)).limit(count)
    sizes = keys.groupBy("_l").agg(F.count("*").alias("_n")).withColumn("_q", F.lit(count) * F.col("_n") / F.lit(n))
    # One row for each class.
    left = F.lit(count) - F.sum(F.floor("_q")).over(Window.partitionBy())
    more = F.row_number().over(Window.orderBy((F.col("_q") - F.floor("_q")).desc(), "_l"))
    takes = sizes.select("_l", (F.floor("_q") + (more <= left).cast("int")).alias("_take"))
    return _is_taken(test, _thresholds(keys, takes), label, seed, "_taken").filter("_taken").drop("_taken")

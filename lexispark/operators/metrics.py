"""Metrics of retrieval and classification, latency samples and repeated runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-12


def retrieval_metrics(ranking: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id), (query_id, label), (doc_id, label) -> per query precision_at_k, ap_at_k and the lists.

    AP divides by min(relevant documents, k), P by k; without a relevant document AP is 0.
    """
    relevant = docs.groupBy("label").agg(F.count("*").alias("_n"))
    own = queries.select("query_id", F.col("label").alias("query_label")).join(relevant, F.col("query_label") == relevant["label"], "left").select("query_id", "query_label", F.coalesce("_n", F.lit(0)).alias("_n"))
    hits = ranking.join(docs.select("doc_id", "label"), "doc_id").join(own, "query_id").withColumn("_rel", (F.col("label") == F.col("query_label")).cast("int"))
    seen = F.sum("_rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("_p", F.when(F.col("_rel") == 1, seen / F.col("rank")).otherwise(0.0))
    top = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda x: x[c])
    out = hits.groupBy("query_id").agg(F.first("query_label").alias("query_label"), F.first("_n").alias("_n"), F.sum("_rel").alias("_hits"), F.sum("_p").alias("_ap"), F.count("*").alias("_rows"), top("doc_id").alias("top_doc_ids"), top("label").alias("top_labels"))
    ap = F.when(F.col("_n") > 0, F.col("_ap") / F.least("_n", F.lit(k))).otherwise(0.0)
    checked = F.when(F.col("_rows") < k, F.raise_error(F.lit(f"every ranking must have at least {k} documents")).cast("double")).otherwise(F.col("_hits") / F.lit(k))
    return out.select("query_id", "query_label", checked.alias("precision_at_k"), ap.alias("ap_at_k"), "top_doc_ids", "top_labels")


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.coalesce(F.avg("precision_at_k"), F.lit(0.0)).alias("precision_at_k"), F.coalesce(F.avg("ap_at_k"), F.lit(0.0)).alias("map_at_k"))


def quality_difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """One row: wins of either side in AP and ties, equal to within 1e-12."""
    d = F.col("b") - F.col("a")
    both = one.select("query_id", F.col("ap_at_k").alias("a")).join(other.select("query_id", F.col("ap_at_k").alias("b")), "query_id")
    return both.agg(F.count_if(d > TOLERANCE).alias("second_wins"), F.count_if(d < -TOLERANCE).alias("first_wins"), F.count_if(F.abs(d) <= TOLERANCE).alias("ties"))


def difference_cases(one: DataFrame, other: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` queries by id whose AP differs; a query of one side only is an error."""
    both = one.select("query_id", F.col("ap_at_k").alias("first_ap")).join(other.select("query_id", F.col("ap_at_k").alias("second_ap")), "query_id", "full_outer")
    lost = F.col("first_ap").isNull() | F.col("second_ap").isNull()
    delta = F.when(lost, F.raise_error(F.lit("paired metrics must have the same queries")).cast("double")).otherwise(F.col("second_ap") - F.col("first_ap"))
    return both.withColumn("delta", delta).filter(F.abs("delta") > TOLERANCE).orderBy("query_id").limit(n)


def per_class(predictions: DataFrame) -> DataFrame:
    """(label, prediction) -> label, precision, recall, f1, support of the labels in truth or prediction; 0 for 0/0."""
    truth = predictions.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("support"), F.count_if(F.col("label") == F.col("prediction")).alias("tp"))
    guess = predictions.groupBy(F.col("prediction").alias("p")).agg(F.count("*").alias("guessed"))
    both = truth.join(guess, F.col("l") == F.col("p"), "full_outer").select(F.coalesce("l", "p").alias("label"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "guessed")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    return both.select("label", ratio(tp, F.col("guessed")).alias("precision"), ratio(tp, F.col("support")).alias("recall"), ratio(2 * tp, F.col("guessed") + F.col("support")).alias("f1"), "support")


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"), F.count_if(F.col("label") != F.col("prediction")).alias("misclassified"))


def macro_f1(predictions: DataFrame) -> DataFrame:
    return per_class(predictions).agg(F.avg("f1").alias("macro_f1"))


def confusion(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(actual, predicted, n) of every pair of the label table, zeros too; the labels are a small dimension."""
    cells = labels.select(F.col("label").alias("actual")).crossJoin(labels.select(F.col("label").alias("predicted")))
    n = predictions.groupBy(F.col("label").alias("actual"), F.col("prediction").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def latency(samples: DataFrame, seconds: str = "seconds") -> DataFrame:
    """One row in milliseconds: mean, median, interpolated 95th percentile; nulls and 0 samples for none."""
    s = F.col(seconds)
    bad = s.isNull() | F.isnan(s) | (s < 0) | (s == float("inf"))
    ms = F.when(bad, F.raise_error(F.lit("latency must be finite and nonnegative")).cast("double")).otherwise(s * 1000)
    return samples.select(ms.alias("ms")).agg(F.avg("ms").alias("mean_ms"), F.percentile("ms", F.lit(0.5)).alias("p50_ms"), F.percentile("ms", F.lit(0.95)).alias("p95_ms"), F.count("ms").alias("samples"))


def summarize_runs(runs: DataFrame, measures: list[str], by: str = "name") -> DataFrame:
    """Mean and sample standard deviation (0 for one run) of each measure per variant; its stop word count must be one."""
    one = F.when(F.count_distinct("stop_word_count") == 1, F.max("stop_word_count")).otherwise(F.raise_error(F.lit("a variant must keep one stop word count")).cast("int"))
    sums = [x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))]
    return runs.groupBy(by).agg(one.alias("stop_word_count"), F.count("*").alias("runs"), *sums)

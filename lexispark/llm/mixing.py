"""Mixing sources to target weights by nested hash thresholds, in DataFrame operations only.

Every document gets a 48-bit key, a hash of its id and text.  Word totals by source and by the key's first 12 bits
show in which bucket a source's budget runs out; only that bucket is summed again by the next 12 bits, and so on
through four levels.  The documents taken are those whose key is below the source's threshold: a filter, no sort.
A larger budget has a larger threshold, so its documents include those of every smaller one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
LEVELS, LEVEL_BITS = 4, 12
#: Per-source rows up to this many are broadcast to the documents (under 64 bytes each); more are joined by shuffle.
MOST_SOURCES_BROADCAST = 50_000


def document_key(doc_id: Column, text: Column) -> Column:
    """48 bits of the MD5 digest of id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> with target: ``share`` of all words by weight, none above ``most`` times its size.

    Resharing the excess until no source is above its limit ends where target = min(limit, level * weight) for one
    common level.  Sources in order of limit per weight are full up to some point; the level is what is left of the
    whole over the weights that are left, at the first source that this level does not overfill.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * most)
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "_level": (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))),
        }
    )
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source", "_level")))
    ranked = ranked.withColumn("_at", level.over(every)["_level"])
    target = F.when(F.col("_at") * F.col("_w") < F.col("_cap"), F.col("_at") * F.col("_w")).otherwise(F.col("_cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame, few: int) -> DataFrame:
    """(source, key, size), (source, _rest) -> (source, _below, _rest) after one more level on the boundary bucket."""
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        bucket = F.floor(F.col("key") / F.lit(1 << shift)).cast("long")
        if level:
            inside = rows.join(common.broadcast_if_small(budgets.select(F.col("source").alias("_s"), "_bucket", "_rest"), few, MOST_SOURCES_BROADCAST), F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("key") / F.lit(1 << (shift + LEVEL_BITS))) == F.col("_bucket")))
            sums = inside.groupBy("source", "_rest", bucket.alias("_b")).agg(F.sum("size").alias("_n"))
        else:
            held = budgets.select(F.col("source").alias("_s"), "_rest")
            sums = rows.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_n")).join(common.broadcast_if_small(held, few, MOST_SOURCES_BROADCAST), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
        in_order = Window.partitionBy("source").orderBy("_b")
        upto = F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("_upto", upto)
        last = level == LEVELS - 1
        # The boundary is the last bucket that starts within the budget; at the last level it goes in if at least half fits.
        edge = sums.filter(F.col("_upto") <= F.col("_rest")).groupBy("source").agg(F.max(F.struct("_b", "_upto", "_n", "_rest")).alias("_e"))
        if last:
            takes = F.col("_e._upto") + F.col("_e._n") / 2 <= F.col("_e._rest")
            budgets = edge.select("source", (F.col("_e._b") + takes.cast("long")).alias("_below"))
        else:
            budgets = edge.select("source", F.col("_e._b").alias("_bucket"), (F.col("_e._rest") - F.col("_e._upto")).alias("_rest"))
    return budgets


def mix_plan(rows: DataFrame, weights: Sequence[int], share: float, most: int) -> tuple[DataFrame, int]:
    """(source, key, size) -> one row per source with source_size, target, whole copies and key threshold; its rows."""
    totals = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("int")
    totals = common.materialize(totals.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")).coalesce(1), "mix-targets")
    few = totals.count()
    below = common.materialize(_threshold(rows, totals.select("source", "_rest"), few).coalesce(1), "mix-thresholds")
    plan = totals.join(below.withColumnRenamed("source", "_t"), F.col("source").eqNullSafe(F.col("_t")), "left")
    return plan.select(F.col("source").alias("_s"), "source_size", "target", "_whole", F.coalesce("_below", F.lit(0)).alias("_below")), few


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` (0 to ``most``) is how often the mix repeats the document and ``taken`` its words, repeats counted.  A
    source is repeated whole as often as its target allows; the rest is met by the documents under its key threshold,
    within half of the boundary document.  Null texts and wordless texts have size 0 and are taken with the others.
    Rows repeated with the same id and text share a key and go in or stay out together.  Null sources are one source,
    named last.  A source of size 0 has target 0.  Other columns are not looked at.  An empty table gives an empty result.
    """
    rows = common.keep_columns(docs, doc_id="long", text="string", source="string")
    rows = common.materialize(rows.select("doc_id", "source", common.space_words(F.col("text")).alias("size"), document_key(F.col("doc_id"), F.col("text")).alias("key")), "mix")
    plan, few = mix_plan(rows, weights, share, most)
    out = rows.join(common.broadcast_if_small(plan, few, MOST_SOURCES_BROADCAST), F.col("source").eqNullSafe(F.col("_s")))
    copies = F.least(F.col("_whole") + (F.col("key") < F.col("_below")).cast("int"), F.lit(most))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = MOST_COPIES) -> DataFrame:
    """The documents that the mix of ``mix_sources`` takes, with their columns and size, source_size, target, copies, taken.

    Where a table has a column of such a name, its own stays and the mix's is named mix_size and so on.  The texts are
    read twice and filtered in place; they are not shuffled.
    """
    named = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), common.space_words(F.col("text")).alias("size"), document_key(F.col("doc_id").cast("long"), F.col("text")).alias("key"))
    plan, few = mix_plan(common.materialize(named.select("source", "size", "key"), "mix"), weights, share, most)
    out = named.join(common.broadcast_if_small(plan, few, MOST_SOURCES_BROADCAST), F.col("source").eqNullSafe(F.col("_s")))
    out = out.withColumn("copies", F.least(F.col("_whole") + (F.col("key") < F.col("_below")).cast("int"), F.lit(most))).filter("copies > 0")
    return common.beside(out, "mix", size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), copies=F.col("copies"), taken=F.col("size") * F.col("copies"))


QUERY = "op4_mix_sources"


def query(spark, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(table: str = "documents") -> str:
    """DuckDB: the same mix from sorted running sums, row by row instead of by bucket."""
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS key FROM {table}),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, 3 * source_size AS cap FROM t),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM t) AS DOUBLE) - CAST(coalesce(sum(cap) OVER b, 0) AS DOUBLE))
          / CAST((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST) AS k
        FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT arg_min(level, k) AS lv FROM l WHERE level * w <= cap),
g AS (SELECT source, source_size, CASE WHEN lv * w < cap THEN lv * w ELSE CAST(cap AS DOUBLE) END AS target FROM l LEFT JOIN a ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM g),
k AS (SELECT source, key, sum(size) AS n FROM d GROUP BY source, key),
c AS (SELECT k.*, p.target - p.whole * p.source_size AS rest, coalesce(sum(n) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
        FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, max(key) AS edge, arg_max(upto + n / 2 <= rest, key) AS takes FROM c WHERE upto <= rest GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * least(whole + CASE WHEN key < edge + CAST(takes AS BIGINT) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN e ON d.source IS NOT DISTINCT FROM e.source"""


SQL = mix_sql()

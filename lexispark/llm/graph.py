"""Connected components of an edge table by alternating large-star and small-star steps, kept in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MOST_ROUNDS = 60


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(u, v) -> (node, root): the smallest node that each node of some edge is connected with.

    Each round sets components aside that are stars already, and hangs in the others every node's larger neighbours, then
    its smaller ones, on the smallest it knows of; the number of rounds is logarithmic in the largest diameter.  Minima are
    stored before edges are joined with them: both sides of such a join are plain shuffles then, so the edges of a node
    that has very many are split by the skew join.
    """
    store = lambda df: common.materialize(df, what)
    least_of = lambda rows: store(rows.groupBy("u").agg(F.min("v").alias("m")))
    edges = store(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    done = []
    for _ in range(MOST_ROUNDS):
        # A star: its centre is no larger end of any edge, and its other nodes have no other edge.
        ends = edges.groupBy("u").agg((F.count("*") > 1).alias("several"))
        centres = edges.select(F.col("v").alias("u")).distinct().withColumn("centre", F.lit(True))
        inner = store(ends.join(centres, "u", "left").filter("several OR centre").select("u"))
        several = edges.join(inner, "u", "left_semi").select("v")
        centred = edges.select("v").distinct().join(inner.select(F.col("u").alias("v")), "v", "left_semi")
        open_ = store(several.unionByName(centred).distinct())
        if not open_.take(1):
            done.append(edges)
            break
        done.append(store(edges.join(open_, "v", "left_anti")))
        edges = store(edges.join(open_, "v", "left_semi"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = store(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        small = large.join(least_of(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = store(small.filter("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(whole.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

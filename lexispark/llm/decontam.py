"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

A test item is contained in a document if at least ``threshold`` of its distinct five-word shingles occur there.  A
fixed number of permutations cannot find a short item in a long document: the share of minima they have in common is
about item size over document size.  So sketches are bottom-k MinHashes, k set by the item's size class: an item of n
shingles can miss at most m(n) = n - ceil(threshold * n) of them, and any m + 1 of its shingles include one that the
document has.  Each class of sizes [2^p, 2^(p+1)) keeps the m(2^(p+1) - 1) + 1 smallest hashes of each item, which makes
the recall 1; a document's sketch is all of its hashes up to the largest that any class keeps.  Hashes that meet make
candidates, and these are verified by exact shingle containment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
#: Sketch rows (16 bytes), candidate documents (24 bytes) and item shingles (8 bytes) up to these counts are broadcast.
MOST_SKETCH_ROWS, MOST_CANDIDATES, MOST_ITEM_SHINGLES = 500_000, 200_000, 2_000_000


def runs_of(w: Column, words: int) -> Column:
    """64-bit hashes of the runs of ``words`` words of an array of word hashes, in order and repeated as they repeat."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(F.slice(w, i, words)))
    return F.when(F.size(w) >= words, runs).otherwise(F.array().cast("array<long>"))


def document_hashes(text: Column, lengths: Sequence[int], upto: Column | None = None) -> Column:
    """Hashes of the runs of each of these lengths, those up to a limit if one is given."""
    kept = lambda runs: runs if upto is None else F.filter(runs, lambda x: x <= upto)
    return common.bind(common.word_hashes(text), lambda w: F.concat(*[kept(runs_of(w, n)) for n in lengths]) if lengths else F.array().cast("array<long>"))


def _misses(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * F.lit(threshold) - F.lit(1e-9))


def item_sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item, s: distinct shingle hashes in order) -> (item, size_class, k, hash)."""
    n = F.size("s")
    size_class = F.floor(F.log2(n)).cast("int")
    largest = F.pow(F.lit(2.0), size_class + 1).cast("long") - 1
    kept = items.filter(n > 0).select("item", size_class.alias("size_class"), F.least(_misses(largest, threshold) + 1, n).cast("int").alias("k"), "s")
    return kept.select("item", "size_class", "k", F.explode(F.slice("s", F.lit(1), F.col("k"))).alias("hash"))


def _contained(docs: DataFrame, items: DataFrame, threshold: float, words: int) -> DataFrame:
    """(doc_id, h, i, n, m) of every text, told by id and hash, and item id (as a string) with containment >= threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    items = common.keep_columns(items, item_id="long", text="string").select("item_id", common.word_hashes(F.col("text")).alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(words)).alias("length")
    shingled = items.select("item_id", length, F.array_sort(F.array_distinct(F.when(F.size("w") < words, F.array(F.xxhash64("w"))).otherwise(runs_of(F.col("w"), words)))).alias("s"))
    # Items of equal shingles are one item while searching.
    grouped = shingled.groupBy("s").agg(F.first("length").alias("length"), F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids"))
    items = common.materialize(grouped.select(F.xxhash64("s").alias("item"), "length", "ids", "s"), "items")
    # At most ``words`` different lengths.
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    sketches = common.materialize(item_sketches(items, threshold).select("item", "hash"), "item-sketches")
    n_sketch, top = sketches.agg(F.count("*"), F.max("hash")).first()
    top = -(1 << 63) if top is None else top

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    sketched = texts.select("doc_id", "h", F.explode(document_hashes(F.col("text"), lengths, F.lit(top))).alias("hash"))
    found = sketched.join(common.broadcast_if_small(sketches, n_sketch, MOST_SKETCH_ROWS), "hash").select("doc_id", "h", "item").distinct()
    found = common.materialize(found, "contained-candidates")

    which = found.select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct()
    few = which.count()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    read = texts.join(common.broadcast_if_small(which, few, MOST_CANDIDATES), same, "left_semi").select("doc_id", "h", F.array_distinct(document_hashes(F.col("text"), lengths)).alias("has"))
    n_shingles = items.agg(F.coalesce(F.sum(F.size("s")), F.lit(0))).first()[0]
    pairs = read.join(found.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "item"), same).join(common.broadcast_if_small(items, n_shingles, MOST_ITEM_SHINGLES), "item")
    matched, n = F.size(F.array_intersect("s", "has")), F.size("s")
    pairs = pairs.select("doc_id", "h", F.explode("ids").alias("i"), n.cast("long").alias("n"), matched.cast("long").alias("m")).filter(F.col("m") >= F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)))
    return pairs


def find_contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, words: int = common.SHINGLE_WORDS) -> DataFrame:
    """(doc_id, item_id, item_shingles, matched, containment) of every document and item with containment >= threshold.

    Words are lower-cased runs of letters and digits.  An item of under five words has one shingle, all its words, and is
    contained where they stand in a row in a document; wordless or null texts have none and never match.  Shingles are compared by 64-bit hash.  Rows repeated
    with the same id come out once per pair, with the largest containment; null ids are kept as ids of their own.  Empty
    tables give an empty result, and other columns are not looked at.
    """
    pairs = _contained(docs, items, threshold, words)
    best = pairs.groupBy("doc_id", F.expr("try_cast(i AS bigint)").alias("item_id")).agg(F.max(F.struct(F.col("m") / F.col("n"), "n", "m")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("item_shingles"), F.col("b.m").alias("matched"), (F.col("b.m") / F.col("b.n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows of one doc_id, or of none, are judged each by its text."""
    return common.without_rows(docs, _contained(docs, items, threshold, common.SHINGLE_WORDS))


QUERY = "op3_find_contained"


def query(spark, sf_dir: str) -> DataFrame:
    return find_contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def contained_ctes(docs: str, items: str = "benchmark") -> str:
    """DuckDB: containment of every pair that shares a shingle, by plain join on shingle strings."""
    plain = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
    words = lambda table, key: f"SELECT {key}, string_split({plain}, ' ') AS w FROM {table} WHERE {plain} <> ''"
    runs = "unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' ')))"
    return f"""
bw AS (SELECT *, least(len(w), 5) AS m FROM ({words(items, "item_id")})),
bs AS (SELECT DISTINCT item_id, m, {runs} AS s FROM bw),
ds AS (SELECT DISTINCT doc_id, m, {runs} AS s FROM ({words(docs, "doc_id")}), (SELECT DISTINCT m FROM bw) WHERE len(w) >= m),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
contained AS (SELECT ds.doc_id, bs.item_id, any_value(bn.n) AS item_shingles, count(*) AS matched, count(*) / any_value(bn.n) AS containment
  FROM ds JOIN bs ON ds.s = bs.s AND ds.m = bs.m JOIN bn ON bs.item_id = bn.item_id GROUP BY ds.doc_id, bs.item_id HAVING count(*) >= ceil(any_value(bn.n) * {THRESHOLD} - 1e-9))"""


SQL = f"WITH {contained_ctes('documents')} SELECT * FROM contained"

"""Near-duplicate documents by a Jaccard join on word shingles: Chosen Path search, then exact comparison.

Sets are embedded in ``T`` MinHash values.  Each of several runs splits all sets at a node of a tree by a few sampled
positions, chosen by the node alone, each with probability 1 / (threshold * T): sets go on together where they share the
value at such a position.  A node with few sets is searched by brute force on 128-bit sketches; a larger one is split
again, to a bounded depth, and at that depth its sets are all linked.  Runs are repeated until a pair at the threshold is
found with the target recall even at the full depth.

What this leaves are candidate groups, which hold every pair that was found.  Within them Jaccard similarity is computed
exactly on whole shingle sets, block by block, giving each set its number of links and the spanning edges of its class;
no pair is ever a row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .graph import components

THRESHOLD = 0.8
T = 128
TARGET_RECALL, MAX_DEPTH = 0.999, 4
#: Nodes with at most so many sets are searched by brute force.
BUCKET = 4096
#: A pair at the threshold differs in more sketch bits than this with a probability of about 3e-6.
SKETCH_SIGMAS = 4.5
#: Members and shingles of one block; groups beyond are compared block by block.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000
MOST_BROADCAST = 200_000
#: Shingles whose MinHashes are computed at a time, to stay within the cache.
AT_A_TIME = 400_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = mix64(np.arange(1, 2 * T + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MUL, _XOR = (_SEEDS[:T] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[T:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(values: np.ndarray, offsets: np.ndarray, words: int = common.SHINGLE_WORDS) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its runs of words; of all its words if it has fewer."""
    values = values.view(np.uint64)
    rolled = mix64(values[: max(0, len(values) - words + 1)] + np.uint64(words))
    for k in range(1, words):
        rolled = mix64(rolled + values[k : len(values) - words + 1 + k])
    sets = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            one = mix64(values[a : a + 1] + np.uint64(b - a))
            for k in range(a + 1, b):
                one = mix64(one + values[k : k + 1])
            sets.append(one)
        else:
            sets.append(values[:0])
    return sets


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """len(sets) x T values; no set may be empty."""
    out = np.empty((len(sets), T), np.uint32)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= AT_A_TIME):
            total += len(sets[end])
            end += 1
        flat = (np.concatenate(sets[start:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]])]).astype(np.int64)
        held = np.empty_like(flat)
        for i in range(T):
            np.bitwise_xor(flat, _XOR[i], out=held)
            np.multiply(held, _MUL[i], out=held)
            out[start:end, i] = np.minimum.reduceat(held, at)
        start = end
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """One bit of each MinHash value, as two 64-bit words."""
    bits = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(17)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64).reshape(len(sig), T // 64)


def set_id(u: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(u.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, w) -> (doc_id, h, set_id, n, sig); set_id is null for wordless texts."""
    for batch in batches:
        sets = shingle_sets(*_lists(batch.column("w")))
        full = [s for s in sets if len(s)]
        sigs = iter(minhashes(full)) if full else iter(())
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"), "h": batch.column("h"),
                "set_id": pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int32()),
                "sig": pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary()),
            }
        )


def survival(depth: int, jaccard_over_threshold: float = 1.0) -> float:
    """Probability that a pair shares a node at this depth in one run."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p * jaccard_over_threshold)
    return p


def runs_for(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def sampled(paths: np.ndarray, threshold: float) -> np.ndarray:
    """len(paths) x T: which positions each node splits on."""
    drawn = mix64(paths[:, None] + _SEEDS[None, :T])
    return drawn < np.uint64(int(2**64 / (threshold * T)))


def children(paths: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of every node that a row's set goes to from its node."""
    row, i = np.nonzero(sampled(paths, threshold))
    return row, mix64(mix64(paths[row] + _SEEDS[i]) + sig[row, i].astype(np.uint64))


def _node_rows(ids: np.ndarray, paths: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"path": pa.array(paths.view(np.int64)), "id": pa.array(ids), "b0": pa.array(bits[:, 0].view(np.int64)), "b1": pa.array(bits[:, 1].view(np.int64))})


NODE_SCHEMA = "path long, id long, b0 long, b1 long"


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, T)


def first_split(runs: int, threshold: float):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix64(np.arange(1, runs + 1, dtype=np.uint64))
        picks = [np.nonzero(x)[0] for x in sampled(roots, threshold)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sig = np.asarray(batch.column("id")), _sigs(batch.column("sig"))
            bits = sketches(sig)
            for root, pick in zip(roots, picks, strict=True):
                for i in pick:
                    yield _node_rows(ids, mix64(mix64(root + _SEEDS[i : i + 1]) + sig[:, i].astype(np.uint64)), bits)

    return split


def next_split(threshold: float):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sig = np.asarray(batch.column("id")), _sigs(batch.column("sig"))
            row, paths = children(np.asarray(batch.column("path")).view(np.uint64), sig, threshold)
            if len(row):
                yield _node_rows(ids[row], paths, sketches(sig)[row])

    return split


def linked(ids: np.ndarray, bits: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning edges of the graph of sketches that differ in at most ``most`` bits."""
    edges, left = [], np.argsort(ids)
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[x]).sum(axis=1) <= most
            if near.any():
                found = left[near]
                edges += [(int(y), int(ids[root])) for y in ids[found]]
                queue += list(found)
                left = left[~near]
    return edges


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"u": pa.array([e[0] for e in edges], pa.int64()), "v": pa.array([e[1] for e in edges], pa.int64())})


def search_buckets(most: int):
    """Sorted node rows -> spanning edges of each node."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []

        def several():
            held = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
                path = held.column("path").to_numpy()
                done = np.searchsorted(path, path[-1])
                yield held.slice(0, done)
                held = held.slice(done)
            if held is not None:
                yield held

        for part in several():
            if not part.num_rows:
                continue
            path, ids = part.column("path").to_numpy(), part.column("id").to_numpy()
            bits = np.stack([part.column("b0").to_numpy().view(np.uint64), part.column("b1").to_numpy().view(np.uint64)], axis=1)
            starts = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
            sizes = np.diff(np.concatenate([starts, [len(path)]]))
            two = starts[sizes == 2]
            near = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1) <= most]
            edges += [(max(x, y), min(x, y)) for x, y in zip(ids[near].tolist(), ids[near + 1].tolist(), strict=True) if x != y]
            for a, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                edges += linked(ids[a : a + n], bits[a : a + n], most)
            if len(edges) > 50_000:
                yield _edge_batch(edges)
                edges = []
        if edges:
            yield _edge_batch(edges)

    return search


def candidate_edges(sets: DataFrame, threshold: float, recall: float = TARGET_RECALL, depth: int = MAX_DEPTH, bucket: int = BUCKET) -> DataFrame:
    """(id, sig) with distinct ids -> (u, v): edges that connect every pair found at some node."""
    spark = sets.sparkSession
    agree = (1 + threshold) / 2
    most = T - math.floor(T * agree - SKETCH_SIGMAS * math.sqrt(T * agree * (1 - agree)))
    rows = sets.mapInArrow(first_split(runs_for(recall, depth), threshold), NODE_SCHEMA)
    edges = None
    for level in range(1, depth + 1):
        large = common.materialize(rows.groupBy("path").count().filter(F.col("count") > bucket).select("path"), "large-nodes")
        n = large.count()
        large = common.broadcast_if_small(large, n, MOST_BROADCAST)
        small = rows.join(large, "path", "left_anti") if n else rows
        n_parts = common.shuffle_partitions(spark)
        found = small.repartition(n_parts, "path").sortWithinPartitions("path").mapInArrow(search_buckets(most), "u long, v long")
        edges = found if edges is None else edges.unionByName(found)
        if not n:
            break
        deep = common.materialize(rows.join(large, "path", "left_semi").select("path", "id"), "large-node-rows")
        if level == depth:
            first = deep.groupBy("path").agg(F.min("id").alias("v"))
            edges = edges.unionByName(deep.join(first, "path").select(F.col("id").alias("u"), "v"))
        else:
            rows = deep.join(sets, "id").select("path", "id", "sig").mapInArrow(next_split(threshold), NODE_SCHEMA)
    return edges


def compare(threshold: float):
    """Sorted (comp, i, j, block, id, s) -> (id, links, root): links within block pair i, j and a spanning forest of them."""

    def rows(ids, links, root):
        return pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(root, pa.int64())})

    def one(group: pa.Table):
        ids, first = np.unique(group.column("id").to_numpy(), return_index=True)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block = group.column("block").to_numpy()[first]
        raw = group.column("s")
        sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in first]
        m, sizes = len(ids), np.array([len(s) for s in sets], np.float64)
        if m == 1:
            return ids, np.zeros(1, np.int64), ids
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(m), sizes.astype(np.int64))
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        shared = np.zeros((m, m), np.float64)
        wide = min(int(at[-1]) + 1, max(256, 8_000_000 // m))
        for c in range(0, int(at[-1]) + 1, wide):
            a, b = np.searchsorted(at, [c, c + wide])
            dense = np.zeros((m, wide), np.float32)
            dense[owner[a:b], at[a:b] - c] = 1
            shared += dense @ dense.T
        near = shared >= threshold * (sizes[:, None] + sizes[None, :] - shared) - 1e-9
        np.fill_diagonal(near, False)
        if i != j:
            near &= block[:, None] != block[None, :]
        root, left = np.arange(m), np.ones(m, bool)
        for x in range(m):
            if left[x]:
                left[x], queue = False, [x]
                while queue:
                    new = near[queue.pop()] & left
                    left &= ~new
                    root[new] = x
                    queue += np.flatnonzero(new).tolist()
        return ids, near.sum(axis=1), ids[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for group in common.groups(batches, ["comp", "i", "j"]):
            out.append(one(group))
            if len(out) >= 2000:
                yield rows(*map(np.concatenate, zip(*out, strict=True)))
                out = []
        if out:
            yield rows(*map(np.concatenate, zip(*out, strict=True)))

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(*_lists(batch.column("w")))
        kept = {name: batch.column(name) for name in ("comp", "id", "blocks")}
        yield pa.RecordBatch.from_pydict(kept | {"s": pa.array([s.tobytes() for s in sets], pa.binary())})


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The rows as (doc_id, h, set_id, ...), and (id, least_id, class_id, n_links, first) of each set.

    ``first`` (n: no id, doc_id, h) is the text that comes first in the class, by doc_id, nulls last, then a hash of the text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    signed = common.materialize(texts.select("doc_id", "h", common.word_hashes(F.col("text")).alias("w")).mapInArrow(sign, "doc_id long, h long, set_id long, n int, sig binary"), "signatures")
    worded = signed.filter("set_id IS NOT NULL")
    sets = common.materialize(worded.groupBy(F.col("set_id").alias("id")).agg(F.first("sig").alias("sig"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("from"), F.first("n").cast("long").alias("n"), F.min("doc_id").alias("doc_id")), "sets")

    comps = components(candidate_edges(sets.select("id", "sig"), threshold), "candidates").select(F.col("node").alias("id"), F.col("root").alias("comp"))
    members = common.materialize(comps.join(sets.select("id", "from", "n"), "id"), "candidate-sets")
    blocks = members.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "comp").select("comp", "id", "blocks", F.col("from.doc_id").alias("d"), F.col("from.h").alias("g"))
    members = common.materialize(members, "candidate-blocks")
    few = members.count()
    read = texts.join(common.broadcast_if_small(members, few, MOST_BROADCAST), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    whole = read.select("comp", "id", "blocks", common.word_hashes(F.col("text")).alias("w")).mapInArrow(_with_sets, "comp long, id long, blocks int, s binary")
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = whole.withColumn("block", block).withColumn("p", F.explode(pairs)).select("comp", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "id", "s")
    n_parts = common.shuffle_partitions(docs.sparkSession)
    compared = dealt.repartition(n_parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(compare(threshold), "id long, links long, root long")
    compared = common.materialize(compared, "compared")

    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(compared.select(F.col("id").alias("u"), F.col("root").alias("v")), "classes").select(F.col("node").alias("id"), "root")
    known = sets.select("id", F.col("doc_id").alias("set_id"), "from").join(links, "id", "left").join(classes, "id", "left").select("id", "set_id", "from", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("root", "id").alias("root"))
    lowest = known.groupBy("root").agg(F.min("set_id").alias("class_id"), F.min("from").alias("first"))
    known = known.join(lowest, "root").select(F.col("id"), F.col("set_id").alias("least_id"), "class_id", "n_links", "first")
    return signed, known


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, set_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles (lower-cased runs of letters
    and digits; all words of a shorter text) is at least ``threshold``.  Documents with equal sets are copies: set_id is
    the smallest doc_id among them.  n_links counts the other sets that a document's set is linked to, copies once.
    class_id is the smallest doc_id that a document is connected with through links and copies.  Wordless and null texts
    have no shingles; each is a class of its own.  Null doc_ids are passed over for set_id and class_id, which are null
    if there is no other.  Rows repeated whole are copies.  Sets are told apart by a 64-bit digest, shingles by a 64-bit
    hash.  Other columns are not looked at; an empty table gives an empty result.
    """
    signed, known = _classes(docs, threshold)
    out = signed.select("doc_id", F.col("set_id").alias("id")).join(known, "id", "left")
    alone = F.col("id").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("set_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near duplicates, with its columns: the smallest doc_id, nulls last, then a hash of the text.

    Rows that agree in both are copies like any others, of which the one with the smallest hash of the row stays.  Rows of
    one doc_id with unlike texts are documents of their own.  Wordless and null texts all stay, since none is a copy.
    """
    signed, known = _classes(docs, threshold)
    placed = signed.select("doc_id", "h", F.col("set_id").alias("id")).join(known.select("id", "first"), "id")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    placed = common.materialize(placed.groupBy("doc_id", "h").agg(F.first(stays).alias("stays"), F.count("*").alias("n")), "class-firsts")
    repeated = placed.filter("stays AND n > 1").select("doc_id", "h")
    few = repeated.count()
    if not few:
        return common.without_rows(docs, placed.filter("NOT stays"))
    again = common.broadcast_if_small(repeated.select(F.struct("doc_id", "h").alias("key")), few, MOST_BROADCAST)
    named = docs.select(F.struct("*").alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("key"))
    # Equal rows are one, and of the others the one with the smallest hash of its columns; the window cuts before it shuffles.
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.to_json("row")), F.to_json("row")))
    one = named.join(again, "key").withColumn("place", place).filter("place = 1").select("row.*")
    return common.without_rows(docs, placed.filter("NOT stays OR n > 1")).unionByName(one)


QUERY = "op8_near_duplicates"


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def near_ctes(docs: str, p: str = "") -> str:
    """DuckDB (WITH RECURSIVE): every pair that shares a shingle, compared; ``{p}near_out`` has doc_id, set_id, class_id, n_links."""
    plain = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"
    return f"""
{p}sh AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')))) AS s
  FROM (SELECT doc_id, string_split({plain}, ' ') AS w FROM {docs} WHERE {plain} <> '')),
{p}se AS MATERIALIZED (SELECT min(doc_id) AS set_id, list(doc_id) AS ids, s, len(s) AS n FROM {p}sh GROUP BY s),
{p}px AS MATERIALIZED (SELECT set_id, n, unnest(s) AS g FROM {p}se),
{p}lk AS MATERIALIZED (SELECT a.set_id AS u, b.set_id AS v FROM {p}px a JOIN {p}px b ON a.g = b.g AND a.set_id <> b.set_id
  GROUP BY a.set_id, b.set_id, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*)) - 1e-9),
{p}cc(node, root) AS (SELECT set_id, set_id FROM {p}se UNION SELECT {p}lk.v, {p}cc.root FROM {p}cc JOIN {p}lk ON {p}cc.node = {p}lk.u),
{p}cl AS (SELECT node, min(root) AS class_id FROM {p}cc GROUP BY node),
{p}near_out AS (SELECT d.doc_id, coalesce(se.set_id, d.doc_id) AS set_id, coalesce(cl.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links
  FROM {docs} d LEFT JOIN (SELECT set_id, unnest(ids) AS doc_id FROM {p}se) se ON d.doc_id = se.doc_id LEFT JOIN {p}cl cl ON se.set_id = cl.node
  LEFT JOIN (SELECT u, count(*) AS n_links FROM {p}lk GROUP BY u) k ON se.set_id = k.u)"""


SQL = f"WITH RECURSIVE {near_ctes('documents')} SELECT * FROM near_out"

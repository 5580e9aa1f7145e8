"""Approximate nearest neighbours by inner product over learned partitions.

The vectors are a tree of parts.  A node's parts come from a bounded sample of its vectors: queries and the vectors of the
sample that they find by inner product are a neighbour graph, whose vectors are dealt to parts of equal size so that what
one query finds lies in few of them.  Two small classifiers are learned: one says to which part a vector belongs, from its
direction and its norm; the other in which parts a query's neighbours lie, from its direction, as inner products rank
alike at any norm of the query.  A node that holds more than LEAF vectors is split again, so parts grow in number with the
table, not in size.  Every different vector is indexed in one leaf.

How many parts a query visits is read off the true neighbours, among all vectors, of a bounded number of queries.  The
vectors of the leaves that a query comes to are ranked by exact inner product in double precision.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: At most about so many vectors of a node, drawn by a hash, teach its parts; at most so many parts, each of so many sampled.
MOST_SAMPLE = 4096
MOST_PARTS, VECTORS_PER_PART = 64, 64
GRAPH_NEIGHBOURS = 12
#: A node of more different vectors is split again.
LEAF = 16_384
HIDDEN, STEPS, RATE, SEED = 96, 250, 0.01, 5
#: At most so many queries teach all nodes, beside each node's own sample, and at most so many others set the parts to visit.
TAUGHT_QUERIES, CALIBRATION_QUERIES = 1024, 512
#: Share of true neighbours that the first level may miss, by the lower bound of 95 %; each further level half of the one above.
LOSS = 0.035
#: Vectors and queries that meet in one task.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
MOST_BROADCAST = 200_000
TOP = 20
QUERY_EVERY = 20


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and logarithms of the norms, of vectors that are not zero; no square overflows."""
    most = np.abs(x).max(axis=1, keepdims=True)
    n = np.linalg.norm(x / most, axis=1, keepdims=True)
    return x / most / n, (np.log(most) + np.log(n))[:, 0]


def neighbour_lists(asks: np.ndarray, x: np.ndarray, k: int, own: int) -> np.ndarray:
    """Of each query the indices of its k rows of largest inner product; the first ``own`` queries do not find their own row."""
    out = np.empty((len(asks), k), np.int64)
    for a in range(0, len(asks), 1024):
        s = asks[a : a + 1024] @ x.T
        i = np.arange(a, min(a + 1024, own))
        s[i - a, i] = -np.inf
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(unit: np.ndarray, norm: np.ndarray, lists: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """A part for each row: halves that divide few lists, then moves to where a row's company is, within a tenth over the mean size.

    Rows are halved along the norm or one of two principal directions, whichever divides the lists least.
    """
    part = np.zeros(len(unit), np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1 or not len(rows):
            part[rows] = first
            return
        cut = len(rows) * (n // 2) // n
        inside = np.zeros(len(unit), bool)
        inside[rows] = True
        held = inside[lists]
        some = held.any(axis=1)
        found, held = lists[some], held[some]
        centred = unit[rows] - unit[rows].mean(axis=0)
        axes = np.linalg.svd(centred[: 4 * unit.shape[1]], full_matrices=False)[2][:2]
        best = None
        for along in (*(centred @ axis for axis in axes), norm[rows]):
            order = rows[np.argsort(along, kind="stable")]
            side = np.zeros(len(unit), bool)
            side[order[:cut]] = True
            left = (side[found] & held).sum(axis=1)
            divided = np.minimum(left, held.sum(axis=1) - left).sum()
            if best is None or divided < best[0]:
                best = divided, order
        order = best[1]
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(unit)), 0, parts)
    most = math.ceil(1.1 * len(unit) / parts)
    for _ in range(rounds):
        ties = company(lists, part, parts, len(unit))
        gain = ties.max(axis=1) - ties[np.arange(len(unit)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(np.argmax(np.where(size < most, ties[i], -1)))
            if ties[i, to] > ties[i, part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i], moved = to, moved + 1
        if not moved:
            break
    return part


def company(lists: np.ndarray, part: np.ndarray, parts: int, rows: int) -> np.ndarray:
    """rows x parts: over the lists that hold a row, how many of the others that they hold lie in each part."""
    k = lists.shape[1]
    held = np.bincount((np.arange(len(lists))[:, None] * parts + part[lists]).ravel(), minlength=len(lists) * parts).reshape(-1, parts).astype(np.float32)
    order = np.argsort(lists, axis=None, kind="stable")
    found, starts = np.unique(lists.ravel()[order], return_index=True)
    ties = np.zeros((rows, parts), np.float32)
    ties[found] = np.add.reduceat(held[order // k], starts, axis=0)
    ties[np.arange(rows), part] -= np.bincount(lists.ravel(), minlength=rows)
    return ties


class Router:
    """One hidden layer from a vector to the probabilities of parts."""

    def __init__(self, dims: int, parts: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, dims**-0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]

    @classmethod
    def of(cls, weights: list[np.ndarray]) -> Router:
        router = cls.__new__(cls)
        router.w = weights
        return router

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w[0] * 3 + self.w[1], 0) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, target: np.ndarray, share: np.ndarray | None = None, steps: int = STEPS, seed: int = SEED) -> Router:
        """Adam over batches; rows are drawn by ``share``."""
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            pick = rng.choice(len(x), min(512, len(x)), p=share)
            a, t = x[pick], target[pick]
            h = np.maximum(a @ self.w[0] * 3 + self.w[1], 0)
            z = h @ self.w[2] + self.w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - t) / len(pick)
            d_h = (d @ self.w[2].T) * (h > 0)
            grads = [a.T @ d_h * 3, d_h.sum(axis=0), h.T @ d, d.sum(axis=0)]
            for i, g in enumerate(grads):
                g = g + 1e-4 * self.w[i]
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        return self


class Node:
    """The parts of one node: where vectors belong and where queries look."""

    def __init__(self, x: np.ndarray, asks: np.ndarray, seed: int = SEED):
        """``x``: sampled vectors, all different; ``asks``: directions of queries beside those of the sample itself."""
        unit, norm = directions(x)
        self.centre, self.spread = norm.mean(), max(norm.std(), 0.05)
        self.parts = int(np.clip(len(x) // VECTORS_PER_PART, 1, MOST_PARTS))
        if self.parts == 1:
            self.belongs = self.looks = Router(x.shape[1] + 1, 1)
            return
        k = min(GRAPH_NEIGHBOURS, len(x) - 1)
        asks = np.concatenate([unit, asks.reshape(-1, x.shape[1])])
        lists = neighbour_lists(asks, x / np.abs(x).max(), k, len(x))
        part = balanced_parts(unit, norm, lists, self.parts)
        ties = company(lists, part, self.parts, len(x))
        target = ties / np.maximum(ties.sum(axis=1, keepdims=True), 1) * 0.5
        target[np.arange(len(x)), part] += 1 - target.sum(axis=1)
        often = np.bincount(lists.ravel(), minlength=len(x)) / k + 0.3
        self.belongs = Router(x.shape[1] + 1, self.parts, seed).fit(self._features(unit, norm), target, often / often.sum())
        at = self.place(x)
        found = np.zeros((len(asks), self.parts))
        np.add.at(found, (np.repeat(np.arange(len(asks)), k), at[lists].ravel()), 1 / k)
        self.looks = Router(x.shape[1] + 1, self.parts, seed).fit(self._features(asks, None), found)

    def dump(self) -> bytes:
        return pickle.dumps((self.parts, self.centre, self.spread, self.belongs.w, self.looks.w))

    @classmethod
    def load(cls, dumped: bytes) -> Node:
        node = cls.__new__(cls)
        node.parts, node.centre, node.spread, belongs, looks = pickle.loads(dumped)
        node.belongs, node.looks = Router.of(belongs), Router.of(looks)
        return node

    def _features(self, unit: np.ndarray, norm: np.ndarray | None) -> np.ndarray:
        return np.column_stack([unit, np.zeros(len(unit)) if norm is None else np.clip((norm - self.centre) / self.spread, -4, 4) / 3])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The part of each vector."""
        return self.belongs.logits(self._features(*directions(x))).argmax(axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All parts for each query, most probable first."""
        return np.argsort(-self.looks.logits(self._features(directions(q)[0], None)), axis=1, kind="stable")


def rank_block(ids: list[np.ndarray], x: np.ndarray, q: np.ndarray, top: int) -> list[tuple[list[int], list[float]]]:
    """Each query's ``top`` nearest ids of the block by exact inner product, ties to the smaller id; an id counts once."""
    rough = q @ x.T
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
    count = np.array([len(i) for i in ids])
    flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), count)
    starts = np.cumsum(count) - count
    repeats = len(np.unique(flat)) < len(flat)
    out = []
    for r in range(len(q)):
        near = np.arange(len(ids))
        if len(ids) > 4 * top:
            near = np.flatnonzero(rough[r] >= np.partition(rough[r], len(ids) - top)[len(ids) - top] - slack)
        while True:
            exact = (x[near] * q[r]).sum(axis=1)
            rows = np.repeat(starts[near], count[near]) + np.arange(count[near].sum()) - np.repeat(np.cumsum(count[near]) - count[near], count[near])
            found, scores = flat[rows], exact[np.searchsorted(near, owner[rows])]
            order = np.lexsort((found, -scores))
            found, scores = found[order], scores[order]
            if repeats:
                first = np.sort(np.unique(found, return_index=True)[1])
                found, scores = found[first], scores[first]
            if len(found) >= top or len(near) == len(ids):
                break
            near = np.arange(len(ids))
        out.append((found[:top].tolist(), scores[:top].tolist()))
    return out


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, a, b) of the vectors that take part: with an id, finite throughout, not zero, of the most frequent length.

    a and b are two hashes of the vector, by which equal vectors are known.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.filter(F.size("x") == F.lit(lengths["n"] if lengths else 0)).withColumns({"a": F.xxhash64("x"), "b": F.xxhash64(F.lit("b"), "x")})


def stack(column) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def drawn(rows: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About ``most`` of n rows (a, b, ...), by a hash of theirs."""
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), "a", "b"), F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, most / max(n, 1)) * (1 << 30))))


def true_neighbours(vectors: DataFrame, asks: np.ndarray, keys: set, top: int) -> DataFrame:
    """(q, a, b): the ``top`` vectors of largest inner product, among all, of each of a bounded number of queries."""
    own = {k: i for i, k in enumerate(keys)}

    def scan(frames):
        held = [np.zeros((len(asks), 0)), np.zeros((len(asks), 0), np.int64), np.zeros((len(asks), 0), np.int64)]
        for frame in frames:
            if not len(frame):
                continue
            a, b = frame["a"].to_numpy(np.int64), frame["b"].to_numpy(np.int64)
            s = asks @ stack(frame["x"]).T
            for j, k in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                if k in own:
                    s[own[k], j] = -np.inf
            new = [s, np.broadcast_to(a, s.shape), np.broadcast_to(b, s.shape)]
            held = [np.concatenate(x, axis=1) for x in zip(held, new, strict=True)]
            if held[0].shape[1] > top:
                best = np.argpartition(-held[0], top - 1, axis=1)[:, :top]
                held = [np.take_along_axis(x, best, axis=1) for x in held]
        s, a, b = (x.ravel() for x in held)
        q = np.repeat(np.arange(len(asks)), held[0].shape[1])
        fine = s > -np.inf
        yield pd.DataFrame({"q": q[fine], "s": s[fine], "a": a[fine], "b": b[fine]})

    found = vectors.select("a", "b", "x").mapInPandas(scan, "q long, s double, a long, b long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "a", "b"))
    return found.withColumn("p", place).filter(F.col("p") <= top).select("q", "a", "b")


def enough_parts(ranks: pd.DataFrame, most: int, loss: float) -> int:
    """(q, rank of the part of a true neighbour) -> the fewest parts whose mean recall is above 1 - loss by its lower bound."""
    if not len(ranks):
        return most
    places = ranks.groupby("q")["rank"].apply(lambda r: r.to_numpy())
    for m in range(1, most):
        recall = np.array([(r < m).mean() for r in places])
        if recall.mean() - 1.645 * recall.std() / math.sqrt(len(recall)) >= 1 - loss:
            return m
    return most


def nearest(vectors: DataFrame, query_every: int = QUERY_EVERY, top: int = TOP, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each row whose vec_id is divisible by ``query_every``.

    Nearness is the inner product of the original vectors in double precision, ties to the smaller vec_id; a query's own
    id is no candidate.  Vectors that are null, zero, not finite or not of the most frequent length, and rows without id,
    take no part.  A repeated id counts once per query, with its best score; as a query it is its smallest vector.  Equal
    vectors are one while searching; their ``top`` + 1 smallest ids are all that a list can hold.  Other columns are not
    looked at.  Without usable vectors the result is empty.
    """
    spark = vectors.sparkSession
    rows = common.materialize(usable_vectors(vectors).dropDuplicates(["vec_id", "a", "b"]), "vectors")
    smallest = F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))
    different = rows.withColumn("r", smallest).filter(F.col("r") <= top + 1).groupBy("a", "b").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("x").alias("x"))
    index = common.materialize(different.withColumn("node", F.lit(0).cast("long")), "index")
    n = index.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = common.materialize(rows.filter(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "a", "b")).alias("v")).select("vec_id", "v.*"), "asked")
    routed = common.materialize(asked.groupBy("a", "b").agg(F.first("x").alias("x")).withColumn("node", F.lit(0).cast("long")), "routed")
    n_routed = routed.count()

    # A bounded number of queries: some teach, the true neighbours of the others say how many parts to visit.
    known = drawn(routed, n_routed, TAUGHT_QUERIES + CALIBRATION_QUERIES, "known").orderBy("a", "b").select("a", "b", "x").toPandas()
    held = np.arange(len(known)) % 3 == 2
    sample = stack(known["x"]) if len(known) else np.zeros((0, 1))
    taught, trials = directions(sample[~held])[0] if (~held).any() else sample[:0], sample[held]
    keys = list(zip(known["a"][held].tolist(), known["b"][held].tolist(), strict=True))
    truth = common.materialize(true_neighbours(index, trials, keys, top), "truth") if len(trials) else None

    levels = 1 + max(0, math.ceil(math.log(max(n / leaf, 1)) / math.log(MOST_PARTS / 4)))
    for level in range(levels):
        if level:
            large = common.materialize(index.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > leaf), "large-nodes")
        else:
            large = spark.createDataFrame([(0, n)] if n > 2 * VECTORS_PER_PART else [], "node long, n long")
        n_large = large.count()
        if not n_large:
            break
        index, routed, truth = _split(index, routed, truth, common.broadcast_if_small(large, n_large, MOST_BROADCAST), taught, trials, LOSS / 2**level, level, top, level == levels - 1)

    lists = _search(index, routed, top + 1)
    each = lists.select("a", "b", F.explode(F.arrays_zip("ids", "scores")).alias("f")).groupBy("a", "b", F.col("f.ids").alias("id")).agg(F.max("f.scores").alias("s"))
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("s").desc(), "id"))
    best = each.withColumn("r", rank).filter(F.col("r") <= top + 1).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("r", "id", "s"))).alias("best"))
    others = F.slice(F.filter("best", lambda f: f["id"] != F.col("vec_id")), 1, top)
    out = asked.select("vec_id", "a", "b").join(best, ["a", "b"]).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("p", "f"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.s").alias("score"))


def _split(index: DataFrame, routed: DataFrame, truth: DataFrame | None, large: DataFrame, taught: np.ndarray, trials: np.ndarray, loss: float, level: int, top: int, last: bool):
    """One more level: the large nodes' vectors, queries and true neighbours go to their parts."""
    share = F.pmod(F.xxhash64(F.lit(f"sample{level}"), "a", "b"), F.lit(1 << 30)) < F.ceil(F.least(F.lit(1.0), F.lit(float(MOST_SAMPLE)) / F.col("n")) * (1 << 30))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        x = stack(frame.sort_values(["a", "b"])["x"])
        return pd.DataFrame({"node": frame["node"].iloc[:1], "model": [Node(x, taught).dump()]})

    models = index.join(large, "node").filter(share).select("node", "a", "b", "x").groupBy("node").applyInPandas(learn, "node long, model binary")
    models = common.materialize(models, "node-models")
    child = lambda node, part: node * MOST_PARTS + 1 + part

    def dealt(rows: DataFrame, most: int, other: DataFrame):
        """Rows of large nodes by blocks of about ``most``, with their node's model in each block."""
        blocks = rows.groupBy("node").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
        mine = rows.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "a", "b"), F.col("blocks").cast("long")).cast("int")).drop("blocks")
        theirs = other.join(blocks, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return mine.groupBy("node", "block").cogroup(theirs.groupBy("node", "block"))

    def assign(key, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        part = np.concatenate([np.zeros(0, np.int64), *(Node.load(model["model"].iloc[0]).place(stack(rows["x"][k : k + 8192])) for k in range(0, len(rows), 8192))])
        return pd.DataFrame({"a": rows["a"], "b": rows["b"], "ids": rows["ids"], "x": rows["x"], "node": child(rows["node"], part)})

    small, inner = index.join(large, "node", "left_anti"), index.join(large.select("node"), "node", "left_semi")
    placed = dealt(inner, 4 * BLOCK_VECTORS, models).applyInPandas(assign, "a long, b long, ids array<long>, x array<double>, node long")
    after = common.materialize(small.select("a", "b", "ids", "x", "node").unionByName(placed), "index")
    parent = F.floor((F.col("node") - 1) / MOST_PARTS).cast("long")
    sizes = after.withColumn("parent", parent).groupBy("parent", "node").agg(F.count_distinct(F.col("ids")[0]).alias("n")).groupBy(F.col("parent").alias("node")).agg(F.collect_list(F.struct("node", "n")).alias("sizes"))
    models = common.materialize(models.join(sizes, "node"), "node-sizes")

    probes = MOST_PARTS
    if truth is not None:
        # At most CALIBRATION_QUERIES x top rows.
        of = after.select("a", "b", "node").join(F.broadcast(truth), ["a", "b"]).withColumn("parent", parent)
        found = of.join(models.select(F.col("node").alias("parent")), "parent", "left_semi")

        def ranks(key, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            out = pd.DataFrame({"q": rows["q"], "a": rows["a"], "b": rows["b"], "rank": np.zeros(len(rows), np.int64)})
            if len(rows) and len(model):
                place = np.argsort(Node.load(model["model"].iloc[0]).order(trials), axis=1)
                out["rank"] = place[rows["q"].to_numpy(), (rows["node"] - child(rows["parent"], 0)).to_numpy()]
            return out

        seen = found.groupBy("parent").cogroup(models.select(F.col("node").alias("parent"), "model").groupBy("parent")).applyInPandas(ranks, "q long, a long, b long, rank long").toPandas()
        probes = enough_parts(seen, MOST_PARTS, loss)
        if not last:
            lost = index.sparkSession.createDataFrame([tuple(map(int, r)) for r in seen[seen["rank"] >= probes][["q", "a", "b"]].itertuples(index=False)], "q long, a long, b long")
            truth = common.materialize(truth.join(F.broadcast(lost), ["q", "a", "b"], "left_anti"), "truth")

    def route(key, rows: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        """The first parts by probability, and as many more as it takes to hold enough candidates."""
        nodes = []
        if len(rows) and len(model):
            order = Node.load(model["model"].iloc[0]).order(stack(rows["x"]))
            n = np.zeros(order.shape[1], np.int64)
            for s in model["sizes"].iloc[0]:
                n[s["node"] - child(key[0], 0)] = s["n"]
            upto = np.cumsum(n[order], axis=1)
            enough = np.where(upto[:, -1] > top, np.argmax(upto > top, axis=1) + 1, order.shape[1])
            nodes = [[child(key[0], int(p)) for p in o[: max(probes, e)] if n[p]] for o, e in zip(order, enough, strict=True)]
        return pd.DataFrame({"a": rows["a"], "b": rows["b"], "x": rows["x"], "nodes": nodes})

    stay, go = routed.join(large, "node", "left_anti"), routed.join(large.select("node"), "node", "left_semi")
    went = dealt(go, 4 * BLOCK_QUERIES, models).applyInPandas(route, "a long, b long, x array<double>, nodes array<long>")
    routed = common.materialize(stay.select("a", "b", "x", "node").unionByName(went.select("a", "b", "x", F.explode("nodes").alias("node"))), "routed")
    return after, routed, truth


def _search(index: DataFrame, routed: DataFrame, top: int) -> DataFrame:
    """(a, b, ids, scores): the nearest of each query in each block of vectors of the leaves it comes to."""
    counts = index.groupBy("node").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("vb")).join(routed.groupBy("node").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qb")), "node")
    counts = common.materialize(counts, "blocks")
    counts = common.broadcast_if_small(counts, counts.count(), MOST_BROADCAST)
    dealt = lambda n: F.pmod(F.xxhash64(F.lit("block"), "a", "b"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(counts, "node").select("node", dealt("vb").alias("v"), every("qb").alias("q"), "a", "b", "ids", "x")
    right = routed.join(counts, "node").select("node", every("vb").alias("v"), dealt("qb").alias("q"), "a", "b", F.lit(None).cast("array<long>").alias("ids"), "x")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks, found = frame["ids"].isna().to_numpy(), []
        if asks.any() and not asks.all():
            x, ids = stack(frame["x"][~asks]), list(frame["ids"][~asks])
            q = stack(frame["x"][asks])
            for k in range(0, len(q), 256):
                found += rank_block(ids, x, q[k : k + 256], top)
        a, b = (frame[c][asks] if found else [] for c in ("a", "b"))
        return pd.DataFrame({"a": a, "b": b, "ids": [f[0] for f in found], "scores": [f[1] for f in found]})

    n_parts = common.shuffle_partitions(index.sparkSession)
    return left.unionByName(right).repartition(n_parts, "node", "v", "q").groupBy("node", "v", "q").applyInPandas(search, "a long, b long, ids array<long>, scores array<double>")


QUERY = "op10_nearest"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))

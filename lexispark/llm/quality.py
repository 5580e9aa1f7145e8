"""Quality by a byte-level convolutional network in numpy.

Filters over WIDTH bytes run along the whole text.  Their largest responses in overlapping chunks feed a small hidden
layer that says how bad a chunk looks; a softmax-weighted mean over all chunks of the document, led by the worst, makes one
probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .labels import held_out, labelled_sample

WIDTH, FILTERS, HIDDEN = 6, 16, 16
#: Positions of a block; a chunk is two neighbouring blocks, so chunks overlap by half.
BLOCK = 128
#: At most about so many labelled rows and bytes of each class, drawn by a hash, train the network.
MOST_LABELLED, MOST_BYTES = 1_500, 16 << 20
STEPS, BATCH, RATE, DECAY, SEED = 700, 32, 0.01, 1e-5, 17
FOLDS, HELD_OUT = 4, 2
CUT = 0.7
#: Positions convolved at a time.
AT_A_TIME = 1 << 16


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each zero-padded to whole blocks of positions and WIDTH - 1 bytes more; blocks of each."""
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
    out = np.zeros(int((blocks * BLOCK + WIDTH - 1).sum()), np.uint8)
    at = 0
    for t, n in zip(texts, blocks, strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * BLOCK + WIDTH - 1
    return out, blocks


def starts_of(blocks: np.ndarray) -> np.ndarray:
    """Where each block's positions begin in the padded bytes."""
    doc = np.repeat(np.arange(len(blocks)), blocks)
    return np.arange(int(blocks.sum())) * BLOCK + doc * (WIDTH - 1)


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.p = {
            "filters": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
            "w1": rng.normal(0, 0.4, (FILTERS, HIDDEN)).astype(np.float32), "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 0.4, HIDDEN).astype(np.float32), "b2": np.zeros(1, np.float32),
        }
        self.scale = np.array([1.0, 0.0])

    def block_maxima(self, data: np.ndarray, starts: np.ndarray, want_at: bool = False):
        """Largest response of each filter in each block, and where, if wanted."""
        best = np.empty((len(starts), FILTERS), np.float32)
        at = np.empty((len(starts), FILTERS), np.int64) if want_at else None
        step = max(1, AT_A_TIME // BLOCK)
        filters = self.p["filters"]
        for k in range(0, len(starts), step):
            where = (starts[k : k + step, None] + np.arange(BLOCK)[None, :]).ravel()
            act = np.take(filters[0], data[where], axis=0)
            held = np.empty_like(act)
            for j in range(1, WIDTH):
                np.take(filters[j], data[where + j], axis=0, out=held, mode="clip")
                act += held
            act = act.reshape(-1, BLOCK, FILTERS)
            best[k : k + step] = act.max(axis=1)
            if want_at:
                at[k : k + step] = act.argmax(axis=1) + starts[k : k + step, None]
        return best, at

    def chunks(self, best: np.ndarray, blocks: np.ndarray):
        """Chunk maxima, the block each comes from, and the document of each chunk."""
        end = np.cumsum(blocks)
        first = end - blocks
        n = np.maximum(blocks - 1, 1)
        doc = np.repeat(np.arange(len(blocks)), n)
        left = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        right = np.minimum(left + 1, end[doc] - 1)
        src = np.where(best[right] > best[left], right[:, None], left[:, None])
        return np.maximum(best[left], best[right]), src, doc

    def head(self, m: np.ndarray, doc: np.ndarray, docs: int):
        h = np.tanh(m @ self.p["w1"] + self.p["b1"])
        z = h @ self.p["w2"] + self.p["b2"][0]
        top = np.full(docs, -np.inf, np.float32)
        np.maximum.at(top, doc, z)
        e = np.exp(z - top[doc])
        share = e / np.bincount(doc, e, docs)[doc]
        return h, z, share, np.bincount(doc, share * z, docs)

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """How bad each text looks."""
        data, blocks = padded(texts)
        best, _ = self.block_maxima(data, starts_of(blocks))
        m, _, doc = self.chunks(best, blocks)
        return self.head(m, doc, len(texts))[3]

    def gradient(self, texts: list[bytes], bad: np.ndarray) -> dict[str, np.ndarray]:
        data, blocks = padded(texts)
        best, at = self.block_maxima(data, starts_of(blocks), want_at=True)
        m, src, doc = self.chunks(best, blocks)
        h, _, share, out = self.head(m, doc, len(texts))
        d_z = ((1 / (1 + np.exp(-out)) - bad) / len(texts))[doc] * share
        d_h = d_z[:, None] * self.p["w2"][None, :] * (1 - h * h)
        d_m = d_h @ self.p["w1"].T
        filters = np.zeros_like(self.p["filters"])
        f = np.broadcast_to(np.arange(FILTERS), src.shape)
        where = at[src, f]
        for j in range(WIDTH):
            np.add.at(filters[j], (data[where + j], f), d_m.astype(np.float32))
        return {"filters": filters, "w1": m.T @ d_h, "b1": d_h.sum(axis=0), "w2": h.T @ d_z, "b2": np.array([d_z.sum()])}

    def fit(self, texts: list[bytes], good: np.ndarray, rate_good: float, steps: int = STEPS, seed: int = SEED) -> Network:
        """Adam over batches with as many good as bad texts; then the scale of the score, at the true rates."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(good == c) for c in (0, 1)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(c, BATCH // 2) for c in by_class])
            g = self.gradient([texts[i] for i in pick], 1.0 - good[pick])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, x in self.p.items():
                d = g[k].astype(np.float32) + DECAY * x
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        z = self.logits(texts)
        weight = np.where(good == 1, rate_good / max((good == 1).sum(), 1), (1 - rate_good) / max((good == 0).sum(), 1))
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * -z + b, -30, 30)))
            d = (p - good) * weight
            s = np.maximum(p * (1 - p) * weight, 1e-9)
            x = np.stack([-z, np.ones_like(z)], axis=1)
            step = np.linalg.solve(x.T @ (x * s[:, None]) + 1e-3 * np.eye(2), x.T @ d + 1e-3 * np.array([a - 1.0, b]))
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.scale = np.array([max(a, 0.05), b])
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of good quality."""
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * -self.logits(texts) + self.scale[1], -40, 40)))


class Constant:
    """Stands in where the labels have one class only."""

    def __init__(self, p: float):
        self.p = p

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.p)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED):
    """From a bounded sample of the labelled rows outside the held-out fold."""
    sample, sizes = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, most, MOST_BYTES)
    n, n_good = sum(sizes.values()), sizes.get(1, 0)
    rows = sample.select("doc_id", "y", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("t")).toArrow().sort_by([("doc_id", "ascending"), ("t", "ascending")])
    good = rows.column("y").to_numpy().astype(np.float64)
    if not len(good) or good.min() == good.max():
        return Constant((n_good + 1) / (n + 2))
    return Network().fit(rows.column("t").to_pylist(), good, n_good / n)


def score(docs: DataFrame, model, *keep: str) -> DataFrame:
    """``keep`` columns and score: the probability that the whole text is of good quality; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, held, size = batch.column("t"), [], [], 0
            for k in range(batch.num_rows):
                held.append(texts[k].as_py())
                size += len(held[-1])
                if size > 2_000_000:
                    out.append(model.scores(held))
                    held, size = [], 0
            if held:
                out.append(model.scores(held))
            found = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in keep} | {"score": pa.array(found, pa.float64())})

    rows = docs.select(*keep, F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("t"))
    return rows.mapInArrow(run, StructType([f for f in rows.schema if f.name != "t"]).add("score", "double"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels of the held-out fold (crc32 of doc_id as text, mod 4, is 2; a null id counts as empty text) are not read.
    Only the text's bytes are scored.  Null and empty texts score as a text of zero bytes.  Rows repeated are scored
    alike, other columns are not looked at, an empty table gives an empty result.  With labels of one class only, the
    score is that class's smoothed rate.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


QUERY = "op6_quality"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

"""A hidden Markov language model over the words of a corpus.

Frequent words are emitted one by one; every other word is emitted as its class, given by its last two characters, times
its share of that class, which does not depend on the state.  So a text's likelihood is that of its sequence of classes,
by the scaled forward recursion over the whole text, times the shares of its rarer words, and the model is a proper
distribution over the whole vocabulary and one unknown word per class, however large the vocabulary grows.

Baum-Welch runs over all training documents: each task sums the expected counts of its part and the sums by class are added
up across partitions.  Long documents are worked through in segments, with the forward and backward messages carried over
every cut, so the counts are those of the whole sequence.  A bounded sample of segments only gives the first guess.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STATES = 8
#: Words with an emission of their own, and words, the most frequent of all documents, whose counts are broadcast (16 bytes
#: each); all others are joined.
OWN_WORDS, BROADCAST_WORDS = 16_384, 262_144
CLASS_BITS = 10
CLASSES = 1 << CLASS_BITS
#: Baum-Welch passes over all training documents; tokens of a segment, and of the segments that are worked on at a time.
PASSES, SEGMENT, AT_A_TIME = 3, 1024, 1 << 18
#: Segments of the first guess, about so many drawn by a hash, their tokens, and its passes.
GUESS_SEGMENTS, GUESS_TOKENS, GUESS_PASSES, SEED = 1600, 256, 20, 3
#: A task of a pass takes about so many tokens.
TASK_TOKENS = 4 << 20
SMOOTH_EMISSION, SMOOTH_MOVE = 20.0, 1.0
FOLDS, HELD_OUT = 7, 2
_COLUMNS = [f"v{i}" for i in range(STATES)]


def token_ids(text: Column) -> Column:
    """Of each word and then the end: 54 bits of its hash, and its class in the low 10 bits."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def one(w: Column) -> Column:
        return F.xxhash64(w).bitwiseAND(F.lit(-CLASSES)).bitwiseOR(F.pmod(F.xxhash64(F.right(w, F.lit(2))), F.lit(CLASSES)))

    return F.transform(F.concat(words, F.array(F.lit("\n"))), one)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, held_out) -> (id, c, n): how often each word occurs in the training rows, and in all, of a batch."""
    for batch in batches:
        tokens, offsets = _lists(batch.column("t"))
        taught = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), np.diff(offsets))
        ids, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_pydict({"id": ids, "c": np.bincount(at[taught], minlength=len(ids)).astype(np.int64), "n": n})


def at_least(counts: DataFrame, column: str, most: int) -> int:
    """The smallest count such that at most ``most`` words reach it, on a scale of eighths of powers of two."""
    bucket = F.floor(F.log2(column) * 8).cast("int")
    held, least = 0, math.inf
    for r in sorted(counts.filter(F.col(column) > 0).groupBy(bucket.alias("b")).agg(F.count("*").alias("words"), F.min(column).alias("least")).collect(), key=lambda r: -r.b):
        held += r.words
        if held > most:
            break
        least = r.least
    return int(least) if least < math.inf else 1 << 62


class Vocabulary:
    """Frequent words in order of id: log10(c + 1), emission class and log10 of the share within it; c may be 0."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, own_from: int, class_tokens: np.ndarray, class_words: np.ndarray, total: int, distinct: int):
        order = np.argsort(ids)
        self.ids, c = ids[order], counts[order]
        self.gain, self.known = np.log10(c + 1.0), c > 0
        own = c >= own_from
        self.log_class = -np.log10(class_tokens + class_words + 1.0)
        low = (self.ids & (CLASSES - 1)).astype(np.int64)
        self.cls = np.where(own, CLASSES + np.cumsum(own) - 1, low).astype(np.uint16)
        self.share = np.where(own, 0.0, self.gain + self.log_class[low])
        self.n_classes = CLASSES + int(own.sum())
        self.class_tokens = np.concatenate([class_tokens, c[own]]).astype(np.float64)
        self.total, self.distinct = total, distinct

    def encode(self, ids: np.ndarray, offsets: np.ndarray):
        """Per document: tokens known from training, sums of their gains and of shares; classes; where the words are that are not here."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        low = (ids & (CLASSES - 1)).astype(np.int64)
        if len(self.ids):
            hit = self.ids[at] == ids
            cls = np.where(hit, self.cls[at], low).astype(np.uint16)
            gain, share = np.where(hit, self.gain[at], 0.0), np.where(hit, self.share[at], self.log_class[low])
            known = hit & self.known[at]
        else:
            hit, known, cls, gain, share = np.zeros(len(ids), bool), np.zeros(len(ids), bool), low.astype(np.uint16), np.zeros(len(ids)), self.log_class[low]
        first = offsets[:-1]
        sums = [np.add.reduceat(x, first) if len(first) else x[:0] for x in (known.astype(np.int64), gain, share)]
        return (*sums, cls, ~hit)


class Model:
    """Start, move and emission probabilities of the class sequence."""

    def __init__(self, n_classes: int, class_tokens: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.prior = (class_tokens + 1.0) / (class_tokens.sum() + n_classes)
        self.emit = self.prior[:, None] * rng.dirichlet(np.full(STATES, 2.0), n_classes)
        self.emit /= self.emit.sum(axis=0)
        self.move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        self.start = np.full(STATES, 1.0 / STATES)

    def update(self, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
        """The M step, with the unigram distribution and uniform moves as priors."""
        use = emitted.sum(axis=0)
        self.emit = (emitted + SMOOTH_EMISSION * self.prior[:, None]) / (use + SMOOTH_EMISSION)
        self.move = (moved + SMOOTH_MOVE) / (moved.sum(axis=1, keepdims=True) + SMOOTH_MOVE * STATES)
        self.start = (started + SMOOTH_MOVE) / (started.sum() + SMOOTH_MOVE * STATES)

    def transfers(self, cls: np.ndarray, first: np.ndarray, length: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For each of some segments the matrix, up to a factor, from the states before it to those at its last token.

        A segment that begins a document goes from the states at its first token instead.
        """
        order = np.argsort(-length, kind="stable")
        first, size, begins = first[order], length[order], begins[order]
        whole = np.broadcast_to(np.eye(STATES), (len(size), STATES, STATES)).copy()
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))
            moved = whole[:n] @ self.move if t else np.where(begins[:, None, None], whole, self.move)
            step = moved * self.emit[cls[first[:n] + t]][:, None, :]
            whole[:n] = step / step.sum(axis=(1, 2), keepdims=True)
        out = np.empty_like(whole)
        out[order] = whole
        return out

    def messages(self, cls: np.ndarray, first: np.ndarray, length: np.ndarray, begins: np.ndarray):
        """(before, after) of every segment, in order of documents: what the rest of its document says about its states.

        ``before`` is the distribution of the states at the token before it (of its own first token where it begins a
        document), ``after`` the likelihood of what follows, up to a factor, by the state at its last token.
        """
        before, after = np.tile(self.start, (len(first), 1)), np.ones((len(first), STATES))
        parts = np.flatnonzero(~(begins & np.append(begins[1:], True)))
        if len(parts):
            steps = self.transfers(cls, first[parts], length[parts], begins[parts])
            a = None
            for k, i in enumerate(parts):
                if begins[i]:
                    a = self.start
                before[i] = a
                a = a @ steps[k]
                a = a / a.sum()
            b = None
            for k, i in zip(range(len(parts) - 1, -1, -1), parts[::-1], strict=True):
                if i + 1 == len(begins) or begins[i + 1]:
                    b = np.ones(STATES)
                after[i] = b
                if not begins[i]:
                    b = steps[k] @ b
                    b = b / b.sum()
        return before, after

    def expected(self, cls: np.ndarray, first: np.ndarray, length: np.ndarray, begins: np.ndarray, before: np.ndarray, after: np.ndarray):
        """(emitted, moved, started) of segments by the scaled forward-backward recursions, given the messages from outside."""
        order = np.argsort(-length, kind="stable")
        first, length, begins, before, after = first[order], length[order], begins[order], before[order], after[order]
        steps = int(length[0])
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        alphas, scales, emits = [], [], []
        for t in range(steps):
            n = active[t]
            e = self.emit[cls[first[:n] + t]]
            a = (np.where(begins[:, None], before, before @ self.move) if t == 0 else alphas[-1][:n] @ self.move) * e
            s = a.sum(axis=1, keepdims=True)
            alphas.append(a / s)
            scales.append(s)
            emits.append(e)
        moved, gammas, at = np.zeros((STATES, STATES)), [], []
        last = lambda t, a, b: after[a:b] / (alphas[t][a:b] * after[a:b]).sum(axis=1, keepdims=True)
        beta = last(steps - 1, 0, active[-1])
        for t in range(steps - 1, -1, -1):
            n = active[t]
            if t < steps - 1:
                k = active[t + 1]
                back = emits[t + 1] * beta / scales[t + 1]
                moved += alphas[t][:k].T @ back
                beta = np.concatenate([back @ self.move.T, last(t, k, n)])
            gamma = alphas[t] * beta
            gammas.append(gamma)
            at.append(cls[first[:n] + t])
        started = gammas[-1][begins].sum(axis=0)
        # The move over the cut before a segment.
        inner = ~begins
        moved += before[inner].T @ (emits[0] * beta / scales[0])[inner]
        gamma, at = np.concatenate(gammas), np.concatenate(at)
        emitted = np.stack([np.bincount(at, gamma[:, s], len(self.emit)) for s in range(STATES)], axis=1)
        return emitted, moved * self.move, started

    def log10_likelihoods(self, cls: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each whole sequence, by the scaled forward recursion; no sequence is empty."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        first, length = offsets[:-1][order], length[order]
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        out, a = np.zeros(len(length)), None
        for t in range(steps):
            n = active[t]
            a = (self.start if a is None else a[:n] @ self.move) * self.emit[cls[first[:n] + t]]
            s = a.sum(axis=1)
            out[:n] += np.log10(s)
            a /= s[:, None]
        whole = np.empty(len(length))
        whole[order] = out
        return whole


def segments(offsets: np.ndarray, size: int = SEGMENT):
    """(first token, length, whether it begins a document) of the parts of at most ``size`` tokens."""
    length = np.diff(offsets)
    n = -(-length // size)
    doc = np.repeat(np.arange(len(n)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = offsets[doc] + k * size
    return first, np.minimum(size, offsets[doc + 1] - first), k == 0


def _classes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint16), np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]).astype(np.int64)


def _sum_counts(model: Model, cls: np.ndarray, offsets: np.ndarray, size: int | None = None):
    """The expected counts of whole documents."""
    first, length, begins = segments(offsets, size or SEGMENT)
    before, after = model.messages(cls, first, length, begins)
    # Segments of like lengths are taken together, so many that their messages stay small.
    order = np.argsort(-length, kind="stable")
    part = np.cumsum(length[order]) // AT_A_TIME
    emitted, moved, started = np.zeros((len(model.emit), STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
    for pick in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []:
        e, m, s = model.expected(cls, first[pick], length[pick], begins[pick], before[pick], after[pick])
        emitted, moved, started = emitted + e, moved + m, started + s
    return emitted, moved, started


def expected_counts(model: Model):
    """Encoded rows -> (key, v0..): one row for each class that occurs, STATES rows of moves, one of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _sum_counts(model, *_classes(batch.column("classes")))
                total = part if total is None else tuple(a + b for a, b in zip(total, part, strict=True))
        if total is not None:
            emitted, moved, started = total
            seen = np.flatnonzero(emitted.sum(axis=1))
            key = np.concatenate([seen, -1 - np.arange(STATES), [-1 - STATES]])
            rows = np.concatenate([emitted[seen], moved, started[None, :]])
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64())} | {c: rows[:, i] for i, c in enumerate(_COLUMNS)})

    return run


def _drawn_segments(share: float):
    """(rid, classes) -> classes of the segments that a hash of document and place draws; each is a document of the first guess."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rid, raw in zip(batch.column("rid").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                for k in range(0, max(len(raw), 1), 2 * GUESS_TOKENS):
                    if zlib.crc32(f"{rid}/{k}".encode()) < share * 2**32:
                        found.append(raw[k : k + 2 * GUESS_TOKENS])
            yield pa.RecordBatch.from_pydict({"classes": pa.array(found, pa.binary())})

    return run


def train(encoded: DataFrame, vocabulary: Vocabulary, passes: int = PASSES) -> Model:
    model = Model(vocabulary.n_classes, vocabulary.class_tokens)
    taught = encoded.filter("NOT held_out").select("classes", "rid", "n_tokens")
    n, n_segments, n_tokens = taught.agg(F.count("*"), F.sum(F.ceil(F.col("n_tokens") / GUESS_TOKENS)), F.sum("n_tokens")).first()
    if not n:
        return model
    drawn = taught.select("rid", "classes").mapInArrow(_drawn_segments(min(1.0, GUESS_SEGMENTS / n_segments)), "classes binary").orderBy("classes").toArrow()
    if drawn.num_rows:
        cls, offsets = _classes(drawn.column("classes"))
        for _ in range(GUESS_PASSES):
            model.update(*_sum_counts(model, cls, offsets))
    tasks = max(n_tokens // TASK_TOKENS, common.cores(taught.sparkSession))
    for _ in range(passes):
        sums = taught.select("classes").coalesce(tasks).mapInArrow(expected_counts(model), "key long, " + ", ".join(f"{c} double" for c in _COLUMNS)).groupBy("key").agg(*[F.sum(c).alias(c) for c in _COLUMNS]).toPandas()
        values = sums[_COLUMNS].to_numpy()
        key = sums["key"].to_numpy()
        emitted, moved = np.zeros((vocabulary.n_classes, STATES)), np.zeros((STATES, STATES))
        emitted[key[key >= 0]] = values[key >= 0]
        lower = (key < 0) & (key >= -STATES)
        moved[-1 - key[lower]] = values[lower]
        model.update(emitted, moved, values[key == -1 - STATES].sum(axis=0))
    return model


def score_documents(docs: DataFrame, passes: int = PASSES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the rows whose crc32(doc_id as text) mod 7 is not 2 (a null id counts as empty text).  Letters A to Z are
    lower-cased, tokens are words and one end, so a null or empty text is the end alone.  base_score is the add-one
    unigram log10 probability; score is the model's, of the whole text.  Words are told apart by 54 bits of a hash and
    their class.  Repeated rows count as often as they stand and are scored alike.  Other columns are not looked at.  An
    empty table gives an empty result; without training rows every word is unknown.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), token_ids(F.col("text").cast("string")).alias("t"))
    counts = rows.select("t", "held_out").mapInArrow(_count, "id long, c long, n long").groupBy("id").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    counts = common.materialize(counts, "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    # What is frequent in any rows is broadcast, so no word that is joined is frequent.
    own_from, shared_from = at_least(counts, "c", OWN_WORDS), at_least(counts, "n", BROADCAST_WORDS)
    known = counts.filter((F.col("n") >= shared_from) | (F.col("c") >= own_from)).toArrow()
    tail = counts.filter((F.col("c") < own_from) & (F.col("c") > 0)).groupBy(F.col("id").bitwiseAND(F.lit(CLASSES - 1)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in tail:
        class_tokens[r.k], class_words[r.k] = r.c, r.n
    vocabulary = Vocabulary(known.column("id").to_numpy(), known.column("c").to_numpy(), own_from, class_tokens, class_words, total, distinct)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                ids, offsets = _lists(batch.column("t"))
                hits, gain, share, cls, rare = vocabulary.encode(ids, offsets)
                upto = np.concatenate([[0], np.cumsum(rare)])[offsets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": np.diff(offsets), "hits": hits, "gain": gain, "share": share,
                        "classes": pa.array([cls[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()),
                        "rare": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids[rare])),
                    }
                )

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, hits long, gain double, share double, classes binary, rare array<long>"
    encoded = common.materialize(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(encode, schema), "encoded")
    model = train(encoded, vocabulary, passes)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.log10_likelihoods(*_classes(batch.column("classes")))
            yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in ("rid", "doc_id", "held_out", "n_tokens", "hits", "gain", "share")} | {"path": found})

    plain = encoded.select("rid", "doc_id", "held_out", "n_tokens", "hits", "gain", "share", "classes")
    scored = plain.mapInArrow(forward, "rid long, doc_id long, held_out boolean, n_tokens long, hits long, gain double, share double, path double")
    rare = encoded.select("rid", F.explode("rare").alias("id")).join(counts.filter((F.col("n") < shared_from) & (F.col("c") < own_from) & (F.col("c") > 0)), "id").groupBy(F.col("rid").alias("r")).agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("k"))
    out = scored.join(rare, F.col("rid") == F.col("r"), "left")
    more = F.coalesce("more", F.lit(0.0))
    per_token = math.log10(total + distinct + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("gain") + more - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), (F.col("path") + F.col("share") + more).alias("score"),
    )


QUERY = "op1_score_documents"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return score_documents(common.table(spark, sf_dir, "documents"))

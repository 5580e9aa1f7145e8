"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are themes of a short list of insults, words and word beginnings that are much more frequent in documents marked
toxic, and patterns such as insults near a "you" or an exclamation mark.  The label model has two classes in which every
voter fires with a probability of its own; it starts from the voters' agreement and is fitted by EM.  The marks anchor the
share of the classes only.  Correlations of each pair of voters within the classes are estimated and discount what such
voters repeat.  The posteriors, not the marks, are what the linear classifier is trained on; its features are all words,
word beginnings and character n-grams that speak for toxicity, whether a voter knows them or not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .labels import held_out, labelled_sample

#: Insults that voters know without any labels, by theme.
THEMES = {
    "mind": ("idiot", "moron", "stupid", "clown", "dumb", "imbecile"),
    "contempt": ("scum", "trash", "loser", "worthless", "pathetic", "vermin"),
    "disgust": ("disgusting", "ugly", "filthy", "freak"),
    "character": ("bastard", "coward", "liar", "jerk"),
}
SEED_WORDS = tuple(w for words in THEMES.values() for w in words)
#: At most about so many labelled rows of each class teach.
MOST_LABELLED = 4_000
#: Learned entries of the lexicon, those of them that vote on their own, and features of the classifier.
MOST_ENTRIES, MOST_ENTRY_VOTERS, MOST_FEATURES = 600, 48, 4_000
#: Entries: so many toxic rows and this share of them at least, this log-odds ratio, and so few other rows for each.
MIN_SUPPORT, MIN_SHARE, MIN_LOG_ODDS, MOST_OTHERS = 3, 0.008, 3.5, 0.05
#: Features: weight of toxic rows, and standard errors of the log-odds ratio.
MIN_WEIGHT, MIN_Z = 3.0, 4.0
PREFIXES, GRAM = (4, 5, 6), 5
MOST_SHIFT = 3.0
FOLDS, HELD_OUT = 5, 0
CUT = 0.5
#: Words whose features a task remembers.
MOST_REMEMBERED = 400_000

_WORD = re.compile(r"[^\W\d_]+")
_NEAR_YOU = re.compile(r"\b(?:you|your|du|dein|tu|ton|eres)\b", re.I)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def entries_of(word: str) -> list[str]:
    """The word, as ``word$``, and its beginnings if it is longer."""
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) > k)]


def features_of(word: str) -> list[str]:
    """Its entries, and its character n-grams from the second letter on, as ``~gram``."""
    return [*entries_of(word), *("~" + word[i : i + GRAM] for i in range(1, len(word) - GRAM + 1))]


def _counted(of: Callable[[str], list[str]], weight: Callable[[pd.DataFrame], np.ndarray]):
    """(doc_id, text, ...) -> (entry, pos, neg): weights of the documents that hold each entry, a row for each entry and task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pos, every = Counter(), Counter()
        for frame in frames:
            for text, p in zip(frame["text"], weight(frame), strict=True):
                held = {e for w in words_of(text) for e in of(w)}
                every.update(held)
                if p > 0.01:
                    for e in held:
                        pos[e] += p
        names = list(every)
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pd.DataFrame({"entry": part, "pos": [float(pos[e]) for e in part], "n": [float(every[e]) for e in part]})

    return run


def learn_lexicon(sample: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """Entries with enough support among toxic rows and a high log-odds ratio, most telling first."""
    counts = sample.mapInPandas(_counted(entries_of, lambda f: f["y"].to_numpy(float)), "entry string, pos double, n double").groupBy("entry").agg(F.sum("pos").alias("pos"), (F.sum("n") - F.sum("pos")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    kept = counts.filter((F.col("pos") >= max(MIN_SUPPORT, MIN_SHARE * n_pos)) & (F.col("neg") <= F.col("pos") * max(MOST_OTHERS, MOST_OTHERS * n_neg / max(n_pos, 1) / 8))).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
    rows = kept.orderBy(F.col("pos").desc(), F.col("odds").desc(), "entry").limit(4 * MOST_ENTRIES).collect()
    chosen: list[str] = []
    held: set[str] = set()
    for r in sorted(rows, key=lambda r: (-r.odds * np.log1p(r.pos), len(r.entry), r.entry)):
        word = r.entry.rstrip("$")
        if not any(word[:k] in held for k in PREFIXES if k < len(word)) and len(chosen) < MOST_ENTRIES:
            chosen.append(r.entry)
            held.add(r.entry)
    return chosen


class Lexicon:
    """Voters over a text's hits: the themes of the seeds, learned entries one by one, the rest of them, and patterns."""

    PATTERNS = ("silent", "several", "many", "dense", "shouted", "near you", "exclaimed")

    def __init__(self, learned: list[str]):
        seeds = {w + "$": t for t, words in enumerate(THEMES.values()) for w in words}
        learned = [e for e in learned if e not in seeds]
        self.voter = seeds | {e: len(THEMES) + min(i, MOST_ENTRY_VOTERS) for i, e in enumerate(learned)}
        self.names = [*THEMES, *learned[:MOST_ENTRY_VOTERS], "other learned entries", *self.PATTERNS]

    def votes(self, text: str | None) -> list[bool]:
        words = words_of(text)
        hits = {e: w for w in words for e in entries_of(w) if e in self.voter}
        fired = [False] * (len(THEMES) + MOST_ENTRY_VOTERS + 1)
        for e in hits:
            fired[self.voter[e]] = True
        told = set(hits.values())
        fired = fired[: len(self.names) - len(self.PATTERNS)]
        sentences = [s for s in re.split(r"(?<=[.!?\n])", text or "") if told & words_of(s)] if told else []
        return [*fired, not told, len(told) > 1, len(told) > 3, len(told) >= 0.02 * len(words) > 0, any(w.upper() in text for w in told if len(w) > 3), any(_NEAR_YOU.search(s) for s in sentences), any(s.rstrip().endswith("!") for s in sentences)]


def correlations(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """m x m correlations of the residuals of x; what chance alone could make counts as none."""
    rest = x - mean
    scale = np.sqrt(np.maximum((rest**2).sum(axis=0), 1e-9))
    r = rest.T @ rest / np.outer(scale, scale)
    r[np.abs(r) < 3 / np.sqrt(len(x))] = 0
    np.fill_diagonal(r, 1)
    return np.clip(r, -1, 1)


def _shift(gain: np.ndarray, prior: float) -> float:
    """What to add to the log odds so that the mean probability is ``prior``, by bisection."""
    low, high = -20.0, 20.0
    for _ in range(40):
        at = (low + high) / 2
        low, high = (at, high) if (1 / (1 + np.exp(-np.clip(gain + at, -40, 40)))).mean() < prior else (low, at)
    return (low + high) / 2


def label_model(votes: np.ndarray, prior: float, rounds: int = 60, outer: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n x m firings and the share of class 1, which every step keeps -> its posteriors, m x 2 firing probabilities, m x m correlations within the classes, voters' weights.

    A voter that does not fire speaks for the class in which it fires less.  The start is the voters' agreement: the more of them fire, the likelier class 1.  A voter's weight is one over the sum
    of its squared positive correlations with all, itself among them: what k voters say alike counts once, what is said
    independently counts in full.
    """
    x = votes.astype(np.float64)
    weight = 1 / (np.maximum(correlations(x, x.mean(axis=0)), 0) ** 4).sum(axis=1)
    # A voter that fires where the others do not speaks against class 1.
    others = x.sum(axis=1, keepdims=True) - x
    side = np.sign(((x - x.mean(axis=0)) * (others - others.mean(axis=0))).sum(axis=0))
    agreed = np.maximum(x @ (weight * side), 0)
    # Between two values that occur, so that about as many rows as class 1 has are above.
    at = max(np.quantile(agreed, 1 - prior), agreed[agreed > 0].min(initial=agreed.max()))
    cut = (at + agreed[agreed < at].max(initial=0)) / 2
    post = np.clip(0.5 + (agreed - cut) / max(agreed.std(), 1e-9), 0.02, 0.98)
    for _ in range(outer):
        for _ in range(rounds):
            fire = np.stack([((1 - post) @ x + 0.5) / ((1 - post).sum() + 1), (post @ x + 0.5) / (post.sum() + 1)], axis=1)
            gain = np.log(prior / (1 - prior)) + x @ (weight * np.log(fire[:, 1] / fire[:, 0])) + (1 - x) @ (weight * np.log((1 - fire[:, 1]) / (1 - fire[:, 0])))
            new = 1 / (1 + np.exp(-np.clip(gain + _shift(gain, prior), -40, 40)))
            done, post = np.abs(new - post).max() < 1e-6, new
            if done:
                break
        rho = correlations(x, np.outer(1 - post, fire[:, 0]) + np.outer(post, fire[:, 1]))
        weight = 1 / (np.maximum(rho, 0) ** 2).sum(axis=1)
    return post, fire, rho, weight


def fit_linear(rows: list[list[int]], target: np.ndarray, width: int, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression over the presence of features and a bias, by full-batch Adam with soft targets, the rarer class lifted half-way."""
    at = np.array([i for hits in rows for i in hits], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(h) for h in rows])
    rare = max(target.mean(), 1e-9)
    each = np.where(target > 0.5, ((1 - rare) / rare) ** 0.5, 1.0)
    each /= each.sum()
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, w[at], len(rows)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) * each
        g = np.append(np.bincount(at, d[owner], width) + ridge * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        rate *= 0.99
    return w


class Linear:
    """Weights by feature, and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def hits(self, text: str | None, known: dict[str, tuple[str, ...]]) -> set[str]:
        """The features of a whole text; ``known`` remembers those of words."""
        found: set[str] = set()
        for w in words_of(text):
            own = known.get(w)
            if own is None:
                if len(known) >= MOST_REMEMBERED:
                    known.clear()
                own = known[w] = tuple(f for f in features_of(w) if f in self.weights)
            found.update(own)
        return found


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Linear:
    """From a bounded sample of the labelled rows outside the held-out fold; without both classes the seeds alone decide."""
    sample, sizes = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, most)
    counts = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n, n_pos = sum(sizes.values()), sizes.get(1, 0)
    if not counts.get(1) or not counts.get(0):
        rate = (n_pos + 1) / (n + 2)
        return Linear({w + "$": 4.0 for w in SEED_WORDS}, min(float(np.log(rate / (1 - rate))), -2.0))
    lexicon = Lexicon(learn_lexicon(sample, counts[1], counts[0]))

    def vote(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "h": frame["h"], "votes": [lexicon.votes(t) for t in frame["text"]]})

    keyed = sample.select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = keyed.mapInPandas(vote, "doc_id long, h long, votes array<boolean>").orderBy("doc_id", "h").toPandas()
    # The classes' shares in the sample, which draws so many of each.
    post, *_ = label_model(np.array(rows["votes"].tolist(), bool), float(np.clip(counts[1] / (counts[0] + counts[1]), 0.01, 0.99)))
    # Posteriors are made more decided before they teach: the many rows of which little is known would else outweigh the rest.
    post = post**2 / (post**2 + (1 - post) ** 2)
    of = dict(zip(zip(rows["doc_id"].tolist(), rows["h"].tolist(), strict=True), post.tolist(), strict=True))

    soft = lambda f: np.array([of[k] for k in zip(f["doc_id"].tolist(), f["h"].tolist(), strict=True)])
    a, b = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    z = (F.log(a / (post.sum() + 1)) - F.log(b / ((1 - post).sum() + 1))) / F.sqrt(1 / a + 1 / b)
    counted = keyed.mapInPandas(_counted(features_of, soft), "entry string, pos double, n double").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    telling = counted.filter(F.col("pos") >= MIN_WEIGHT).withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.col("z").desc(), "entry").limit(MOST_FEATURES).collect()
    names = [r.entry for r in telling]
    at, empty = {e: i for i, e in enumerate(names)}, Linear(dict.fromkeys(names, 0.0), 0.0)

    def hold(frames):
        known: dict[str, tuple[str, ...]] = {}
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "h": frame["h"], "hits": [sorted(at[e] for e in empty.hits(t, known)) for t in frame["text"]]})

    held = keyed.mapInPandas(hold, "doc_id long, h long, hits array<int>").orderBy("doc_id", "h").toPandas()
    rows = [list(h) for h in held["hits"]]
    w = fit_linear(rows, soft(held), len(names))
    # The marks anchor the share: as many rows of the sample are above one half as are marked, if the odds move by MOST_SHIFT at most.
    z = np.sort(np.array([w[h].sum() + w[-1] for h in rows]))[::-1]
    shift = float(np.clip((z[counts[1] - 1] + z[min(counts[1], len(z) - 1)]) / 2, -np.log(MOST_SHIFT), np.log(MOST_SHIFT)))
    return Linear(dict(zip(names, w[:-1].tolist(), strict=True)), float(w[-1]) - shift)


def scorer(model: Linear) -> Callable[[list[str | None]], np.ndarray]:
    """Texts -> the probabilities that they are toxic; one task's, as it remembers words."""
    known: dict[str, tuple[str, ...]] = {}

    def run(texts: list[str | None]) -> np.ndarray:
        z = np.array([model.bias + sum(model.weights[f] for f in sorted(model.hits(t, known))) for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    return run


def score(docs: DataFrame, model: Linear, *keep: str) -> DataFrame:
    """``keep`` columns and score: the classifier's probability that the whole text is toxic; null counts as empty."""

    def run(frames):
        scores = scorer(model)
        for frame in frames:
            yield frame[[c for c in frame.columns if c != "text"]].assign(score=scores(frame["text"].tolist()))

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = StructType([f for f in rows.schema if f.name != "text"]).add("score", "double")
    return rows.mapInPandas(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Labels of the held-out fold (crc32 of doc_id as text, mod 5, is 0; a null id counts as empty text) are not read.
    Only the text is scored.  Null and empty texts score as a text without hits.  Rows repeated are scored alike, other
    columns are not looked at, and an empty table gives an empty result.  Without labels of both classes the seed list
    alone decides.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns; each row is judged by its text, in place."""
    model, at = train(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist()) < CUT))

    return docs.mapInArrow(run, docs.schema)


QUERY = "op5_toxicity"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

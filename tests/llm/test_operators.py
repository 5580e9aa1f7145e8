"""Each operator against a brute-force version on small tables, and the defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import chat, common, decontam, graph, hmm, jaccard, labels, mixing, neighbours, quality, toxicity, warc

DOCS = "doc_id long, text string, source string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# mixing


def test_mix_meets_targets_and_nests(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    docs = frame(spark, rows, DOCS)
    whole, half = ({r.doc_id: r for r in mixing.mix_sources(docs, share=s).collect()} for s in (1.0, 0.5))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), (5, 2, 1, 5), strict=False))
    target, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        target |= {s: level * weights[s] for s in open_} | {s: 3.0 * sizes[s] for s in full}
        if not full:
            break
        open_ -= full
        left -= sum(3 * sizes[s] for s in full)
    for s in sizes:
        own = [r for r in whole.values() if r.source == s]
        assert own[0].target == pytest.approx(target[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - target[s]) <= 40
    assert all(half[d].copies <= whole[d].copies <= 3 for d in whole)


def test_mix_edges(spark):
    assert mixing.mix_sources(frame(spark, [], DOCS)).count() == 0
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", "b"), (3, "x y", "b"), (3, "x y", "b")]
    out = [tuple(r) for r in mixing.mix_sources(frame(spark, rows, DOCS).withColumn("key", mixing.F.lit("z"))).select("doc_id", "size", "source_size", "taken").collect()]
    assert len(out) == 5 and sorted(x[1] for x in out) == [0, 0, 2, 2, 2]
    assert mixing.mixed_documents(frame(spark, rows, DOCS).withColumn("key", mixing.F.lit("z"))).columns[:4] == ["doc_id", "text", "source", "key"]


# decontamination


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_containment_is_exact(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 5, 9, 20, 70])))) for i in range(25)] + [(25, None), (26, ""), (27, "one two three")]
    docs = []
    for d in range(80):
        text = rng.choices(words, k=rng.randrange(0, 60))
        if rng.random() < 0.7:
            part = rng.choice(items)[1] or ""
            part = part.split()
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, " ".join(text).upper() if d % 3 else ", ".join(text)))
    docs += [(80, None), (81, "One, two; three!"), (81, "One, two; three!")]
    docs += [(82, "here are one two three more words than five"), (83, "w1 two three")]
    items += [(28, "one two three"), (29, "two")]

    def runs(text, n):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = {}
    for d, t in docs:
        for i, s in items:
            a = shingles(s)
            b = runs(t, min(5, len(re.findall(r"[^\W_]+", s or ""))))
            if a and len(a & b) >= 0.8 * len(a) - 1e-9:
                want[d, i] = (len(a), len(a & b))
    got = decontam.find_contained(frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.item_shingles, r.matched) for r in got} == want and len(got) == len(want) > 20
    assert {(82, 28), (82, 29), (83, 29)} <= set(want)


def test_containment_edges(spark):
    empty = frame(spark, [], "doc_id long, text string")
    items = frame(spark, [(1, "a b c d e f")], "item_id long, text string")
    assert decontam.find_contained(empty, items).count() == 0
    assert decontam.find_contained(frame(spark, [(None, "x a b c d e f")], "doc_id long, text string"), items).first().doc_id is None
    assert decontam.find_contained(frame(spark, [(1, "x")], "doc_id long, text string"), frame(spark, [], "item_id long, text string")).count() == 0


# near duplicates


def brute_classes(docs):
    sets = {}
    for d, t in docs:
        s = frozenset(shingles(t))
        sets.setdefault(s if s else (d,), []).append(d)
    keys = list(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = Counter()
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if isinstance(a, frozenset) and isinstance(b, frozenset) and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).extend(sets[k])
    return {d: (min(sets[k]), min(groups[find(k)]), links[k]) for k in keys for d in sets[k]}


@pytest.fixture(scope="module")
def near_docs():
    rng = random.Random(4)
    docs, d = [], 0
    for _ in range(12):
        base = [f"v{rng.randrange(500)}" for _ in range(rng.randrange(6, 120))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
            docs.append((d, " ".join(text)))
            d += 1
    return [*docs, (d, None), (d + 1, " . "), (d + 2, docs[0][1].upper()), (d + 3, "two words"), (d + 4, "Two words.")]


def test_near_duplicates(spark, near_docs):
    got = jaccard.near_duplicates(frame(spark, near_docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.set_id, r.class_id, r.n_links) for r in got} == brute_classes(near_docs) and len(got) == len(near_docs)


def test_near_duplicates_split_nodes_and_blocks(spark, near_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    whole = jaccard.candidate_edges
    monkeypatch.setattr(jaccard, "candidate_edges", lambda sets, t: whole(sets, t, bucket=2))
    got = jaccard.near_duplicates(frame(spark, near_docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.set_id, r.class_id, r.n_links) for r in got} == brute_classes(near_docs)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(60)] + [(500, 100 + i) for i in range(80)] + [(1000, 1100 + i) for i in range(80)] + [(3, 3), (2000, 2001), (2001, 2000)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in graph.components(frame(spark, pairs, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in [500, *range(100, 180)]} | {i: 1000 for i in [1000, *range(1100, 1180)]} | {2000: 2000, 2001: 2000}
    assert got == want
    assert graph.components(frame(spark, [], "u long, v long")).count() == 0


def test_near_duplicates_edges(spark):
    assert jaccard.near_duplicates(frame(spark, [], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (None, None)]
    got = sorted(map(tuple, jaccard.near_duplicates(frame(spark, rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 5, 5, 0), (5, 5, 5, 0), (None, None, None, 0)], key=str)


def test_recall_follows_the_number_of_runs():
    assert jaccard.survival(1) == pytest.approx(1 - math.exp(-1))
    assert 1 - (1 - jaccard.survival(4)) ** jaccard.runs_for(0.999, 4) >= 0.999


# toxicity and quality


def test_toxicity_learns_and_keeps_the_held_out_fold_out(spark):
    rng = random.Random(6)
    plain = [f"word{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(100)]
    docs, labels = [], []
    for d in range(500):
        toxic = d % 5 == 1
        words = rng.choices(plain, k=30)
        if toxic:
            words[rng.randrange(30)] = "gruxel" + rng.choice("abcdefgh")
        docs.append((d, " ".join(words)))
        labels.append((d, int(toxic)))
    docs += [(None, None), (900, ""), (901, "gruxela"), (902, "word")]
    labels += [(None, 1), (3, None)]
    got = toxicity.toxicity(frame(spark, docs, "doc_id long, text string"), frame(spark, labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    right = [r.predicted == (r.doc_id % 5 == 1) for r in got if r.doc_id is not None and r.doc_id < 500 and r.held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in got)
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (900, 901, 902)} == {900: 0, 901: 1, 902: 0}
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, frame(spark, [], "doc_id long, toxic int")).collect()}
    assert got == {1: 1, 2: 0}
    assert toxicity.toxicity(frame(spark, [], "doc_id long, text string"), frame(spark, [], "doc_id long, toxic int")).count() == 0


def test_label_model_finds_good_voters_and_ties_copies():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    accurate = [np.where(rng.random(3000) < 0.9, y, ~y) for _ in range(3)]
    noise = rng.random(3000) < 0.3
    votes = np.stack([*accurate, noise, noise, noise], axis=1)
    post, fire, rho, weight = toxicity.label_model(votes, 0.3)
    assert ((post > 0.5) == y).mean() > 0.95
    assert fire[:3, 1] == pytest.approx([0.9] * 3, abs=0.05) and fire[:3, 0] == pytest.approx([0.1] * 3, abs=0.05)
    assert rho[3, 4] > 0.99 and np.abs(rho[:3, 3:]).max() < 0.2
    assert weight[3:] == pytest.approx([1 / 3] * 3) and (fire[:3, 1] > 0.8).all()


def test_label_model_finds_a_correlated_pair():
    rng = np.random.default_rng(5)
    n, y = 6000, np.random.default_rng(4).random(6000) < 0.25
    votes = [np.where(rng.random(n) < acc, y, ~y) for acc in (0.95, 0.9, 0.85, 0.8, 0.9)]
    # The last voter mostly says what the one before it says, right or wrong.
    votes.append(np.where(rng.random(n) < 0.8, votes[4], np.where(rng.random(n) < 0.9, y, ~y)))
    post, fire, rho, weight = toxicity.label_model(np.stack(votes, axis=1), 0.25)
    assert fire[:4, 1] == pytest.approx([0.95, 0.9, 0.85, 0.8], abs=0.06)
    assert np.unravel_index(np.argmax(np.triu(rho, 1)), rho.shape) == (4, 5) and rho[4, 5] > 0.6
    assert weight[4] < 0.8 * weight[1] and ((post > 0.5) == y).mean() > 0.95


def test_samples_are_bounded_whatever_repeats(spark):
    docs = frame(spark, [(d % 8, f"text {d % 8} " + "x" * (d % 8)) for d in range(4000)], "doc_id long, text string")
    marks = frame(spark, [(d, d % 2) for d in range(8)] * 50, "doc_id long, toxic int")
    sample, sizes = labels.labelled_sample(docs, marks, "toxic", 5, 0, 100)
    taught = {d for d in range(8) if zlib.crc32(str(d).encode()) % 5}
    assert {r.doc_id for r in sample.collect()} == taught and sample.count() == len(taught) and sum(sizes.values()) == len(taught)
    many = frame(spark, [(d, f"t{d}" * 50) for d in range(3000)], "doc_id long, text string")
    few, sizes = labels.labelled_sample(many, frame(spark, [(d, int(d % 100 == 0)) for d in range(3000)], "doc_id long, toxic int"), "toxic", 5, 0, 200)
    by = Counter(r.y for r in few.collect())
    assert by[1] == sizes[1] and 120 < by[0] < 300


@pytest.mark.parametrize("seed", [1, 2])
def test_convolution_is_the_plain_one(seed):
    net, rng = quality.Network(seed), np.random.default_rng(seed)
    text = bytes(rng.integers(32, 127, 700).astype(np.uint8))
    blocks = -(-len(text) // quality.BLOCK)
    data = text + bytes(blocks * quality.BLOCK + quality.WIDTH - 1 - len(text))
    response = np.array([sum(net.p["filters"][j, data[i + j]] for j in range(quality.WIDTH)) for i in range(blocks * quality.BLOCK)])
    best = [response[b * quality.BLOCK : (b + 1) * quality.BLOCK].max(axis=0) for b in range(blocks)]
    chunks = [np.maximum(best[b], best[b + 1]) for b in range(blocks - 1)]
    z = np.array([np.tanh(c @ net.p["w1"] + net.p["b1"]) @ net.p["w2"] + net.p["b2"][0] for c in chunks])
    weight = np.exp(z - z.max())
    assert net.logits([text])[0] == pytest.approx(float((weight * z).sum() / weight.sum()), abs=1e-4)


def test_quality_learns(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for d in range(160):
        bad = d % 4 == 0
        lines = [" ".join(word() for _ in range(12)) for _ in range(4)]
        if bad:
            lines[rng.randrange(4)] = " | ".join(word() for _ in range(30))
        docs.append((d, "\n".join(lines)))
        labels.append((d, int(not bad)))
    monkeypatch.setattr(quality, "STEPS", 120)
    docs += [(None, None), (500, "")]
    got = quality.quality(frame(spark, docs, "doc_id long, text string"), frame(spark, labels, "doc_id long, quality int")).collect()
    right = [r.predicted == (r.doc_id % 4 != 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 160]
    assert len(got) == 162 and len(right) > 20 and sum(right) / len(right) > 0.9 and all(0 <= r.score <= 1 for r in got)
    none = quality.quality(frame(spark, docs[:2], "doc_id long, text string"), frame(spark, [], "doc_id long, quality int")).collect()
    assert [r.score for r in none] == [0.5, 0.5]


def test_quality_gradient_and_padding():
    net = quality.Network(3)
    texts, bad = [b"", b"short", bytes(range(32, 127)) * 5], np.array([1.0, 0.0, 1.0])
    loss = lambda: float(np.mean([np.log1p(np.exp(-z)) if b else np.log1p(np.exp(z)) for z, b in zip(net.logits(texts), bad, strict=True)]))
    g = net.gradient(texts, bad)
    before = loss()
    for k in ("b1", "w2", "w1", "filters"):
        net.p[k] -= 0.01 * g[k].astype(np.float32)
    assert loss() < before
    together, alone = net.logits(texts), np.concatenate([net.logits([t]) for t in texts])
    assert together == pytest.approx(alone, abs=1e-5)


# language model


def test_scores_by_hand(spark):
    docs = [(d, " ".join(random.Random(d).choices(["Aa", "b", "éE", "cc", f"r{d}"], k=d % 9))) for d in range(60)] + [(60, None), (61, "\x0b x\ty "), (62, "zzz")]
    got = {r.doc_id: r for r in hmm.score_documents(frame(spark, docs, "doc_id long, text string"), passes=1).collect()}
    tokens = lambda s: [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")) if w] + ["\n"]
    c = Counter()
    for d, s in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(tokens(s))
    n, v = sum(c.values()), len(c)
    for d, s in docs:
        w, r = tokens(s), got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and r.score < 0


def test_forward_is_exact_and_counts_add_up():
    rng = np.random.default_rng(2)
    model = hmm.Model(7, np.ones(7), 1)
    model.start, model.move = rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    cls = rng.integers(0, 7, 25).astype(np.uint16)
    offsets = np.array([0, 1, 9, 25])
    want = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        x = model.start * model.emit[cls[a]]
        for t in range(a + 1, b):
            x = (x @ model.move) * model.emit[cls[t]]
        want.append(math.log10(x.sum()))
    assert model.log10_likelihoods(cls, offsets) == pytest.approx(want)
    emitted, moved, started = hmm._sum_counts(model, cls, offsets)
    assert emitted.sum() == pytest.approx(25) and started.sum() == pytest.approx(3) and moved.sum() == pytest.approx(22)
    assert emitted.sum(axis=1) == pytest.approx(np.bincount(cls, minlength=7))
    first = model.log10_likelihoods(cls, offsets).sum()
    for _ in range(3):
        model.update(*hmm._sum_counts(model, cls, offsets))
    assert model.log10_likelihoods(cls, offsets).sum() > first


def test_counts_over_cuts_are_those_of_whole_documents():
    rng = np.random.default_rng(6)
    model = hmm.Model(30, np.ones(30), 1)
    model.start, model.move = rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES)
    cls, offsets = rng.integers(0, 30, 900).astype(np.uint16), np.array([0, 1, 9, 25, 400, 900])
    whole = hmm._sum_counts(model, cls, offsets, 1000)
    for size in (1, 7, 100):
        for a, b in zip(whole, hmm._sum_counts(model, cls, offsets, size), strict=True):
            assert a == pytest.approx(b, abs=1e-8)


def test_score_is_the_plain_forward_recursion(spark, monkeypatch):
    """With few words of their own and few broadcast, so that own, shared, joined and unknown words all occur."""
    monkeypatch.setattr(hmm, "OWN_WORDS", 4)
    monkeypatch.setattr(hmm, "BROADCAST_WORDS", 12)
    models = []
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: (models.append((train(*a), a[1])), models[-1][0])[1])
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    docs = [(d, " ".join(rng.choices(words, weights=range(1, 19), k=rng.randrange(0, 30)) + [f"u{d}"] * (d % 4))) for d in range(80)]
    docs += [(200, " ".join(rng.choices(words, k=6000))), (201, None), (None, "ax ay"), (None, "ax ay")]
    got = hmm.score_documents(frame(spark, docs, "doc_id long, text string").withColumn("rid", hmm.F.lit(1)), passes=1).collect()
    assert len(got) == len(docs)
    model, vocabulary = models[0]
    c, by_class, in_class = Counter(), Counter(), Counter()
    unheld = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2
    split = lambda t: [w for w in (t or "").split(" ") if w] + ["\n"]
    for d, t in docs:
        if unheld(d):
            c.update(split(t))
    ids = {w: r for w, r in [(r.w, r.id) for r in frame(spark, [(w,) for w in {w for _, t in docs for w in split(t)[:-1]}], "w string").select("w", hmm.token_ids(hmm.F.col("w"))[0].alias("id")).collect()]}
    ids["\n"] = frame(spark, [("",)], "w string").select(hmm.token_ids(hmm.F.col("w"))[0]).first()[0]
    known = {i: k for k, i in enumerate(vocabulary.ids.tolist())}
    own = {w for w in ids if ids[w] in known and vocabulary.cls[known[ids[w]]] >= hmm.CLASSES}
    assert 0 < len(own) <= 4 and any(ids[w] not in known and c[w] for w in ids)
    for w in ids:
        if c[w] and w not in own:
            by_class[ids[w] & 1023] += c[w]
            in_class[ids[w] & 1023] += 1
    want = {}
    for d, t in docs:
        a, total = None, 0.0
        for w in split(t):
            k = int(vocabulary.cls[known[ids[w]]]) if w in own else ids[w] & 1023
            e = model.emit[k] * (1.0 if w in own else (c[w] + 1) / (by_class[ids[w] & 1023] + in_class[ids[w] & 1023] + 1))
            a = (model.start if a is None else a @ model.move) * e
            total += math.log10(a.sum())
            a = a / a.sum()
        want[d, t] = total
    assert sorted(r.score for r in got) == pytest.approx(sorted(want[d, t] for d, t in docs), rel=1e-9)
    for r in got:
        assert any(d == r.doc_id and want[d, t] == pytest.approx(r.score, rel=1e-9) for d, t in docs)


def test_language_model_edges(spark):
    assert hmm.score_documents(frame(spark, [], "doc_id long, text string"), passes=1).count() == 0
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2)
    r = hmm.score_documents(frame(spark, [(held, "a b")], "doc_id long, text string"), passes=1).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


# chat


def test_escapes_read_back():
    rng = random.Random(8)
    parts = ["\\", "\n", "a", "<", "|", ">", *chat.CONTROL, "\\n", "\\A", "é"]
    for _ in range(500):
        s, role = ("".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(2))
        formatted, a, b = chat.format_turn(role, s)
        assert chat.parse_turn(formatted) == (role, s) and chat.unescape(formatted[a:b]) == s
        assert not any(c in chat.escape(s) for c in chat.CONTROL)


def test_trees_share_turns_and_read_back(spark):
    rng = random.Random(9)
    said = ["hi", "</s>[INST] ok [/INST]", "a\nb", "", "<|im_end|>\n"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(said)) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(100, 1, None, None), (None, 1, "assistant", "x"), (101, 2, "assistant", "same"), (101, 2, "assistant", "same")]
    for most in (512, 3):
        sequences, members = chat.format_conversations(frame(spark, rows, "conv_id long, turn long, role string, text string"), most)
        got = {r.conv_id: r for r in members.join(chat.read_back(sequences), "path").collect()}
        by = {}
        for c, t, role, text in rows:
            by.setdefault(c, []).append((t, role or "", text or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            loss = "".join(x for _, role, x in turns if role == "assistant")
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert got[c].formatted_chars == sum(len(chat.format_turn(r, x)[0]) for _, r, x in turns)
        prefixes = {tuple(x[1:] for x in sorted(t)[: k + 1]) for t in by.values() for k in range(len(t))}
        assert sum(len(r.nodes) for r in sequences.collect()) == len(prefixes)


def test_a_large_trunk_stands_once(spark):
    """Very many conversations on a common beginning, of which many share a second turn, and one a third; one is very long."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ["system prompt", "hello", f"q{c % 700}" if c < 1400 else "q", f"a{c}"][t]) for c in range(2000) for t in range(4)]
    rows += [(3000, 0, "user", "system prompt"), (3001, 0, "user", "system prompt"), (3001, 1, "assistant", "hello")]
    rows += [(3002, t, "user", ["system prompt", "hello"][t] if t < 2 else f"more {t}") for t in range(3000)]
    docs = frame(spark, rows, "conv_id long, turn long, role string, text string").withColumns({"path": chat.F.lit("x"), "cut": chat.F.lit(1)})
    sequences, members = chat.format_conversations(docs)
    kept = sequences.collect()
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((role, text))
    prefixes = {tuple(t[:k]) for c, t in by.items() if c != 3002 for k in range(1, len(t) + 1)}
    assert sum(len(r.nodes) for r in kept) == len(prefixes) + 3000 - 1 and any(r.trunk for r in kept)
    assert max(len(r.leaves) for r in kept) <= 2 * chat.MOST_IN_SEQUENCE
    got = {r.conv_id: r for r in members.join(chat.read_back(sequences), "path").collect()}
    for c, turns in by.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest() and got[c].n_turns == len(turns)
    empty = chat.format_conversations(docs.limit(0))
    assert empty[0].count() == empty[1].count() == 0


# archives


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (7, "u", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (7, "v", big)]
    got = sorted(map(tuple, warc.archive_pages(frame(spark, rows, PAGES), f"file://{tmp_path}/w", payloads=True).select("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload").collect()), key=str)
    want = []
    for p, u, h in rows:
        data = (h or "").encode()
        to = 7 if h == big and p != 7 else None
        want.append((p, "http://a/%0D%0AX: y" if p == 1 else u, "revisit" if to else "response", len(data), hashlib.sha1(data).hexdigest(), to, None if to else bytearray(data)))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(frame(spark, [], PAGES)).count() == 0


def test_damage_is_noticed():
    import io

    payload = b"x" * 200_000
    member = warc.make_record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None)
    whole = list(warc.read_records(io.BytesIO(member * 3)))
    assert len(whole) == 3 and warc.parse_record(*whole[2])[6] == payload
    with pytest.raises(warc.Damaged):
        list(warc.read_records(io.BytesIO(member + member[:-20])))
    import gzip

    plain = gzip.decompress(member)
    for bad in (plain.replace(b"xxx", b"xyx", 1), plain.replace(b"Content-Length: 2", b"Content-Length: 1", 1), plain[:-1]):
        with pytest.raises((warc.Damaged, KeyError)):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.Damaged):
        list(warc.read_records(io.BytesIO(gzip.compress(b"WARC/1.0\r\n" + b"x: y\r\n" * 200_000))))


def foreign(kind, block, version="WARC/1.0", **fields):
    head = "".join(f"{k.replace('_', '-')}:{v}\r\n" for k, v in fields.items())
    return f"{version}\r\nwarc-type: {kind}\r\n{head}content-length:  {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n5\r\nhello\r\n3;x=y\r\nabc\r\n0\r\n\r\n"
    sha1 = lambda b: hashlib.sha1(b).hexdigest()
    records = [
        foreign("warcinfo", b"software: other\r\n", WARC_Record_ID="<urn:info>", Content_Type="application/warc-fields"),
        foreign("response", http + b"payload", warc_record_id="<urn:a>", CONTENT_TYPE="application/http; msgtype=response", WARC_Target_URI="http://a/"),
        foreign("response", chunked, "WARC/1.1", WARC_Record_ID="<urn:b>", Content_Type="application/http", WARC_Payload_Digest=f"SHA1:{sha1(b'helloabc').upper()}", WARC_Block_Digest=f"sha256:{hashlib.sha256(chunked).hexdigest()}"),
        foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Record_ID="<urn:c>", WARC_Refers_To="<urn:a>", Content_Type="application/http"),
        foreign("revisit", b"", WARC_Record_ID="<urn:d>", WARC_Refers_To="<urn:elsewhere>", WARC_Payload_Digest=f"sha1:{sha1(b'z')}"),
        foreign("metadata", b"", WARC_Record_ID="<urn:e>", WARC_Block_Digest="blake9:xyz"),
        foreign("resource", b"a\r\n\r\nb", WARC_Record_ID="<urn:f>"),
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:4]))
    (tmp_path / "two.warc").write_bytes(b"".join(records[4:]))
    listed = frame(spark, [("one.warc.gz",), ("two.warc",)], "archive string")
    got = {r.record_id: r for r in warc.read_archives(listed, f"file://{tmp_path}", payloads=True).collect()}
    assert {k: r.record_type for k, r in got.items()} == {"<urn:info>": "warcinfo", "<urn:a>": "response", "<urn:b>": "response", "<urn:c>": "revisit", "<urn:d>": "revisit", "<urn:e>": "metadata", "<urn:f>": "resource"}
    assert bytes(got["<urn:a>"].payload) == b"payload" and bytes(got["<urn:b>"].payload) == b"helloabc" and bytes(got["<urn:f>"].payload) == b"a\r\n\r\nb"
    assert (got["<urn:c>"].payload_bytes, got["<urn:c>"].payload_digest, got["<urn:c>"].refers_to_id) == (7, sha1(b"payload"), "<urn:a>")
    assert (got["<urn:d>"].payload_bytes, got["<urn:d>"].payload_digest, got["<urn:d>"].payload) == (None, sha1(b"z"), None)


# neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 16))
    x = centres[rng.integers(0, 20, 1500)] + rng.normal(0, 0.4, (1500, 16))
    x[100:130] = x[100]
    rows = [(int(i), x[i].tolist()) for i in range(1500)] + [(2000, None), (2020, [0.0] * 16), (2040, [math.nan] * 16), (2060, [None] * 16), (2080, [1.0]), (None, [1.0] * 16), (20, x[20].tolist())]
    got = {}
    for r in sorted(neighbours.nearest(frame(spark, rows, "vec_id long, embedding array<double>")).collect()):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -np.round(s, 12)))[:20]
        hit += len({v for _, v, _ in found} & set(best.tolist()))
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        assert all(sc == pytest.approx(x[v] @ x[q], abs=1e-12) for _, v, sc in found)
        assert [(-sc, v) for _, v, sc in found] == sorted((-sc, v) for _, v, sc in found)
    assert hit / (20 * len(got)) >= 0.9


def test_neighbours_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(frame(spark, [], schema)).count() == 0
    assert neighbours.nearest(frame(spark, [(0, [1.0, 2.0])], schema)).count() == 0
    got = neighbours.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 1.0])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)] == [(0, 1, 3, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0)]


@pytest.mark.parametrize("copies", [1, 2, 4, 5])
def test_neighbours_of_a_block_of_repeated_ids(copies):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (300, 8))
    # Copies of an id differ, so its best score counts; every vector has a second id as well.
    rows = np.concatenate([x + rng.normal(0, 0.01, x.shape) for _ in range(copies)])
    ids = [np.array([i, 1000 + i]) for i in np.tile(np.arange(300), copies)]
    for q, (found, scores) in enumerate(neighbours.rank_block(ids, rows, x[:40], 20)):
        s = (rows @ x[q]).reshape(copies, 300).max(axis=0)
        want = np.lexsort((np.concatenate([np.arange(300), 1000 + np.arange(300)]), -np.concatenate([s, s])))[:20]
        assert found == [int(w) if w < 300 else int(w) + 700 for w in want] and scores == pytest.approx(s[want % 300].tolist())


@pytest.mark.parametrize("copies", [2])
def test_neighbours_of_repeated_rows_are_those_of_single_rows(spark, copies):
    x = np.random.default_rng(12).normal(0, 1, (1000, 16))
    rows = [(int(i), x[i].tolist()) for i in range(1000)]
    one, many = ([tuple(r) for r in sorted(neighbours.nearest(frame(spark, rows * c, "vec_id long, embedding array<double>")).collect())] for c in (1, copies))
    assert [r[:3] for r in many] == [r[:3] for r in one] and [r[3] for r in many] == pytest.approx([r[3] for r in one])
    assert len(one) == 20 * 50


def test_neighbours_of_a_very_common_vector(spark):
    x = np.random.default_rng(13).normal(0, 1, (400, 8))
    x[100:300] = 3 * x[100]
    rows = [(int(i), x[i].tolist(), 1) for i in range(400)]
    got = {}
    for r in sorted(neighbours.nearest(frame(spark, rows, "vec_id long, embedding array<double>, node int")).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (120, 280):
        assert got[q] == [i for i in range(100, 122) if i != q][:20]


def recall(spark, x, **how):
    table = frame(spark, [(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    hit, found = 0, {}
    for r in neighbours.nearest(table, **how).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(range(0, len(x), 20)) and all(len(f) == 20 for f in found.values())
    for q in found:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found[q] & set(np.argpartition(-s, 20)[:20].tolist()))
    return hit / 20 / len(found)


@pytest.mark.parametrize(("n", "spread", "leaf"), [(4000, 0.0, 16_384), (4000, 0.5, 16_384), (4000, 1.0, 16_384), (4000, 0.5, 40), (50_000, 0.0, 16_384), (50_000, 0.5, 16_384), (50_000, 1.0, 16_384)])
def test_neighbours_by_inner_product_at_any_norms(spark, n, spread, leaf):
    """Clustered vectors whose norms are lognormal; a small leaf makes several levels."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (20, 16))
    x = centres[rng.integers(0, 20, n)] + rng.normal(0, 0.4, (n, 16))
    x *= rng.lognormal(0, spread, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, leaf=leaf) >= 0.95


def test_parts_grow_with_the_table():
    """A node's parts are many where its sample is large, and a node above LEAF is split again: see the small leaf above."""
    rng = np.random.default_rng(5)
    few, many = (neighbours.Node(rng.normal(0, 1, (n, 8)), np.zeros((0, 8))) for n in (640, 2560))
    assert (few.parts, many.parts) == (10, 40)
    at = np.bincount(many.place(rng.normal(0, 1, (2560, 8))), minlength=40)
    assert at.max() < 2560 / 8 and neighbours.Node.load(many.dump()).parts == 40


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == common.shared_dir(spark)

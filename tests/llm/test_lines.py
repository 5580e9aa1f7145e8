"""Line deduplication against a plain quadratic version."""

import random

import pytest

from lexispark.llm.lines import MIN_FUZZY_CHARS, dedup_lines

SCHEMA = "doc_id long, text string"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(docs: list[tuple[int, str]]) -> dict[int, str]:
    first: dict[str, tuple[int, int]] = {}
    norm = lambda s: " ".join(s.lower().split())
    for d, t in sorted(docs):
        for k, line in enumerate(t.split("\n")):
            if norm(line):
                first.setdefault(norm(line), (d, k))
    gone = {x for x in first if len(x) >= MIN_FUZZY_CHARS and any(len(y) >= MIN_FUZZY_CHARS and first[y] < first[x] and abs(len(x) - len(y)) < 2 and distance(x, y) <= 1 for y in first)}
    keep = lambda d, k, s: not norm(s) or first[norm(s)] == (d, k) and norm(s) not in gone
    return {d: "\n".join(s for k, s in enumerate(t.split("\n")) if keep(d, k, s)) for d, t in docs}


def test_matches_the_plain_version(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (19, 20, 21, 33, 40, 64, 5, 90) for _ in range(3)]

    def edited(s):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(5)
        if kind == 0:
            return s[:i] + rng.choice("abcx") + s[i:]
        if kind == 1:
            return s[:i] + s[i + 1 :]
        if kind == 2:
            return s[:i] + rng.choice("abcx") + s[i + 1 :]
        return s if kind == 3 else s.upper() + "  "

    docs = [(d, "\n".join([*(edited(edited(rng.choice(base)) if rng.random() < 0.3 else rng.choice(base)) for _ in range(rng.randrange(7))), *[""] * rng.randrange(2)])) for d in range(80)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == plain(docs)


def test_nulls_blanks_repeats_and_other_columns(spark):
    rows = [(None, "only here it is, a line\n", "x"), (1, None, "y"), (2, "", "z"), (3, "only here it is, a line", None), (3, "only here it is, a line", None), (4, "\n \n", "b")]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, `row` string"))
    assert out.columns == ["doc_id", "text", "row", "n_lines", "n_dropped", "emptied"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(None, "", "x", 1, 1, True), (1, None, "y", 0, 0, False), (2, "", "z", 0, 0, False), (3, "only here it is, a line", None, 1, 0, False), (3, "only here it is, a line", None, 1, 0, False), (4, "\n \n", "b", 0, 0, False)], key=str)


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [MIN_FUZZY_CHARS - 1, MIN_FUZZY_CHARS])
def test_short_lines_are_compared_for_equality(spark, n):
    docs = [(1, "a" * n), (2, "a" * (n - 1) + "b")]
    kept = {r.doc_id for r in dedup_lines(spark.createDataFrame(docs, SCHEMA)).filter("NOT emptied").collect()}
    assert kept == ({1, 2} if n < MIN_FUZZY_CHARS else {1})

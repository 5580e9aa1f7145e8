import pytest

from lexispark.functions import text as T
from pyspark.sql import functions as F


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text"))).first()[0]


def test_stop_words_are_all_there():
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 124


@pytest.mark.parametrize(
    ("text", "stop", "words"),
    [("Under 7 BRIDGES, q; rivers_flow", ("under",), ["bridges", "rivers", "flow"]), ("Tea/COFFEE or milk?", ("or", "milk"), ["tea", "coffee"]), ("", (), []), ("5 x 9", (), [])],
)
def test_tokenize(spark, text, stop, words):
    assert one(spark, text, lambda c: T.tokenize(c, stop)) == words


def test_null_text_is_an_error(spark):
    with pytest.raises(Exception, match="text must be a string"):
        one(spark, None, T.tokenize)


def redacted(spark, value):
    return T.sanitized(spark.createDataFrame([(value,)], "text string")).first()


def test_all_kinds_are_redacted(spark):
    r = redacted(spark, "Write to lena.k@post.example or see ftp://files.example/a, host 10.20.30.40 and fe80::a:1, ring +49 30 5550 1234; part 300.1.1.1 and room 12-34 stay")
    assert r.clean == "write to or see host and ring part and room stay"
    assert r.redactions == dict.fromkeys(T.KINDS, 1)
    assert r.excluded_reason is None


def test_plain_numbers_stay(spark):
    r = redacted(spark, "take 12 eggs from 7 Baker Road")
    assert r.clean == "take eggs from baker road" and sum(r.redactions.values()) == 0


def test_only_valid_addresses_count(spark):
    assert redacted(spark, "p 172.16.0.255 q 256.1.1.1 r 10.01.2.3 s 700.8.8.4.4 t 9.8.7.6.5 u").redactions["ipv4"] == 2
    assert redacted(spark, "at 07:15:59").redactions["ipv6"] == 0
    assert redacted(spark, "face::z").redactions["ipv6"] == 1


def test_ipv6_agrees_with_the_standard_library(spark):
    import ipaddress
    import random
    import re

    rng = random.Random(3)
    # Fixed value: what is looked at as an address.
    shape = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:])")

    def valid(s):
        try:
            ipaddress.IPv6Address(s)
            return True
        except ValueError:
            return False

    texts = [" ".join(":".join(rng.choice(["", "", "1", "ab", "12345", "f00"]) for _ in range(rng.randrange(2, 10))) for _ in range(5)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.n_ipv6 for r in T.redact(df).collect()}
    assert got == {i: sum(valid(m) for m in shape.findall(t)) for i, t in enumerate(texts)}


def test_emptied_documents_have_a_reason(spark):
    assert redacted(spark, "m@n.io 42").excluded_reason == "empty_after_sanitization"


@pytest.mark.parametrize(("text", "safe"), [("green hills beyond", True), ("", False), ("lena@post.example", False), ("Green hills", False), ("a  b", False), (" a", False), (None, False)])
def test_safe_text(spark, text, safe):
    assert one(spark, text, T.is_safe) is safe


def test_snippets(spark):
    cut = lambda s, n=240: one(spark, s, lambda c: T.cut_at_word(c, n))
    assert cut("seven tall pines", 10) == "seven tall"
    assert cut("seven mountains", 9) == "seven"
    assert cut("y" * 300) == "y" * 240
    long = cut("lanterns " * 40)
    assert len(long) <= 240 and long.endswith("lanterns")
    with pytest.raises(ValueError, match="positive"):
        T.cut_at_word(F.col("x"), 0)
    with pytest.raises(Exception, match="must contain text"):
        T.safe_snippet(spark.createDataFrame([("123",)], "text string")).collect()


def test_very_long_texts(spark):
    assert one(spark, "ab " * 300_000 + "ab", T.is_safe) is True
    assert redacted(spark, "word " * 300_000).redactions["email"] == 0


def test_registered_functions_equal_the_columns(spark):
    from lexispark.functions.register import register

    texts = ["Mail lena.k@post.example now", "host 10.20.30.40, not 300.1.1.1", "face::z and fe80::1", "ring +49 30 5550 1234", "", "lanterns " * 60, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    df.createOrReplaceTempView("some_texts")
    assert register(spark) == ["lexi_tokens", "lexi_clean", "lexi_redactions", "lexi_is_safe", "lexi_snippet"]
    got = {r.id: r for r in spark.sql("SELECT id, lexi_clean(text) AS clean, lexi_redactions(text) AS redactions, lexi_is_safe(text) AS safe, lexi_snippet(text) AS snippet FROM some_texts").collect()}
    want = {r.id: r for r in T.sanitized(df).withColumn("safe", T.is_safe(F.col("text"))).withColumn("cut", T.cut_at_word(F.col("clean"))).collect()}
    for i, r in want.items():
        assert (got[i].clean, got[i].safe, got[i].snippet) == (r.clean, r.safe, r.cut) and got[i].redactions == r.redactions
    assert spark.sql("SELECT lexi_tokens('The lanterns and a boat')").first()[0] == ["lanterns", "boat"]


def test_snippet_query_takes_documents_without_words(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "12 34 !", "en", "web"), (2, "two words", "en", "web"), (3, "", "en", "web"), (4, "a@b.com", "fr", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.snippet for r in entry.queries()["safe_snippet"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "two words", 3: "", 4: ""}

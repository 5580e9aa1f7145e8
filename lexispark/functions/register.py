"""The text functions, and a search, as SQL functions of a session: plain SQL bodies, which Catalyst inlines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from . import text as T

PREFIX = "lexi_"


def _literal(pattern: str) -> str:
    """A raw SQL string; no pattern here holds a quote."""
    if "'" in pattern:
        raise ValueError("a pattern must not hold a quote")
    return f"r'{pattern}'"


def _steps() -> list[tuple[str, str]]:
    """(kind, SQL over {t} that makes its matches spaces), in order."""
    mark = "concat(chr(1), '$2')"
    ipv4 = f"replace(regexp_replace(regexp_replace({{t}}, {_literal(T._IPV4)}, {mark}), concat(chr(1), '(?=[0-9])'), ''), chr(1), ' ')"
    plain = lambda p: f"regexp_replace({{t}}, {_literal(p)}, ' ')"
    return [("email", plain(T._EMAIL)), ("url", plain(T._URL)), ("ipv4", ipv4), ("ipv6", plain(T._IPV6)), ("phone", plain(T._PHONE))]


def _counts(kind: str) -> str:
    patterns = {"email": T._EMAIL, "url": T._URL, "ipv6": T._IPV6, "phone": T._PHONE}
    if kind == "ipv4":
        return f"size(filter(regexp_extract_all({{t}}, {_literal(T._IPV4)}, 1), m -> m <> ''))"
    return f"regexp_count({{t}}, {_literal(patterns[kind])})"


def register(spark: SparkSession, index=None, stop_words: Iterable[str] = T.STOP_WORDS, prefix: str = PREFIX) -> list[str]:
    """Defines temporary functions and returns their names: tokens, clean, redactions, is_safe and snippet of a text.

    With a stored index also search(query, k), a table function: (rank, doc_id, score) of BM25, best first, at most k rows
    of positive score.
    """
    stop = ", ".join(f"'{w}'" for w in stop_words)
    kept = f" AND NOT array_contains(array({stop}), w)" if stop else ""
    redacted, counts = "t", {}
    for kind, step in _steps():
        counts[kind] = _counts(kind).replace("{t}", redacted)
        redacted = step.replace("{t}", redacted)
    letters = "array_join(regexp_extract_all(lower({t}), '([a-z]+)', 1), ' ')"
    shapes = [T._EMAIL, T._URL, rf"(?U)\b{T.IPV4_SHAPE}\b", T._IPV6, T._PHONE]
    unsafe = " OR ".join(f"t RLIKE {_literal(p)}" for p in shapes)
    n = T.SNIPPET_LIMIT
    bodies = {
        "tokens": ("ARRAY<STRING>", f"filter(regexp_extract_all(lower(t), '([a-z]+)', 1), w -> length(w) > 1{kept})"),
        "clean": ("STRING", letters.replace("{t}", redacted)),
        "redactions": ("MAP<STRING, INT>", "map(" + ", ".join(f"'{k}', {counts[k]}" for k in T.KINDS) + ")"),
        "is_safe": ("BOOLEAN", f"coalesce(t <> '' AND NOT t RLIKE '[^a-z ]|^ | \\\\z|  ' AND NOT ({unsafe}), false)"),
    }
    names = []
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(t STRING) RETURNS {kind} RETURN {body}")
        names.append(prefix + name)
    cut = f"CASE WHEN length(c) <= {n} THEN c WHEN substr(c, {n + 1}, 1) = ' ' THEN substr(c, 1, {n}) ELSE regexp_replace(substr(c, 1, {n}), ' [^ ]*$', '') END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}cut(c STRING) RETURNS STRING RETURN {cut}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}snippet(t STRING) RETURNS STRING RETURN {prefix}cut({prefix}clean(t))")
    names.append(f"{prefix}snippet")
    if index is not None:
        index.postings.createOrReplaceTempView(f"{prefix}postings")
        scores = f"SELECT doc_id, sum(w_bm25) AS score FROM {prefix}postings WHERE array_contains({prefix}tokens(q), term) GROUP BY doc_id"
        ranked = f"SELECT CAST(row_number() OVER (ORDER BY bround(score, 12) DESC, doc_id) AS INT) AS rank, doc_id, score FROM ({scores}) WHERE score > 0"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}search(q STRING, k INT) RETURNS TABLE (rank INT, doc_id BIGINT, score DOUBLE) RETURN SELECT rank, doc_id, score FROM ({ranked}) WHERE rank <= k")
        names.append(f"{prefix}search")
    return names

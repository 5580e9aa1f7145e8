"""Text functions as columns: tokens, redaction of identifiers, the safe-text contract and snippets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default stop words.
STOP_WORDS = tuple(
    """a about after again all also am an and any are as at be because been before being between both but by can could
    did do does doing down during each few for from further had has have having he her here hers herself him himself his
    how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
    ourselves out over own same she should so some such than that the their theirs them themselves then there these they
    this those through to too under until up very was we were what when where which while who whom why will with would
    you your yours yourself yourselves""".split()
)
#: What counts as an identifier.
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"\b(?:https?://|ftp://|www\.)\S+"
IPV4_SHAPE = r"(?:\d{1,3}\.){3}\d{1,3}"
PHONE = r"(?<!\w)(?:(?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{4}|\d{3}[-.]\d{4})(?!\w)"
KINDS = ("email", "phone", "url", "ipv4", "ipv6")
SNIPPET_LIMIT = 240

#: Java needs (?U) for word characters and digits beyond ASCII.
_EMAIL, _URL, _PHONE = f"(?iU){EMAIL}", f"(?iU){URL}", f"(?U){PHONE}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4_VALID = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
#: A valid address as group 1, or another text of that shape as group 2, so that both are consumed alike.
_IPV4 = rf"(?U)\b(?:({_IPV4_VALID})\b|({IPV4_SHAPE})\b)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Addresses of two to seven colons that fill a whole run of hexadecimal digits and colons.
_IPV6 = "(?<![0-9A-Fa-f:])(?:" + "|".join([f"(?:{_HEX}:){{7}}{_HEX}", *(f"(?:{_HEX}:){{1,{7 - k}}}(?::{_HEX}){{{k}}}" for k in range(1, 7)), f":(?::{_HEX}){{1,6}}", f"(?:{_HEX}:){{1,6}}:", "::"]) + ")(?![0-9A-Fa-f:])"


def letters(text: Column) -> Column:
    """Lower-case runs of a to z, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def tokenize(text: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Words of more than one letter that are no stop words, in order with repeats.  A null text is an error."""
    stop = list(stop_words)
    checked = F.coalesce(text, F.raise_error(F.lit("text must be a string")).cast("string"))
    keep = (lambda w: (F.length(w) > 1) & ~w.isin(stop)) if stop else (lambda w: F.length(w) > 1)
    return F.filter(letters(checked), keep)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_email, n_url, n_ipv4, n_ipv6, n_phone and ``clean``: identifiers made spaces, then words alone.

    E-mail addresses, URLs, IPv4 and IPv6 addresses and telephone numbers go in this order.  IPv4 candidates with an
    octet over 255 or a leading zero, and IPv6 candidates that are no address, stay and are not counted.
    """
    valid4 = F.size(F.filter(F.regexp_extract_all("_r", F.lit(_IPV4), F.lit(1)), lambda m: m != ""))
    # Valid ones become a mark alone, others the mark and themselves; a mark before a digit goes again.
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("_r"), _IPV4, "\u0001$2"), "\u0001(?=[0-9])", ""), "\u0001", " ")
    out = df.withColumn("_r", F.col(text))
    out = out.withColumn("n_email", F.regexp_count("_r", F.lit(_EMAIL))).withColumn("_r", F.regexp_replace("_r", _EMAIL, " "))
    out = out.withColumn("n_url", F.regexp_count("_r", F.lit(_URL))).withColumn("_r", F.regexp_replace("_r", _URL, " "))
    out = out.withColumn("n_ipv4", valid4).withColumn("_r", marked)
    out = out.withColumn("n_ipv6", F.regexp_count("_r", F.lit(_IPV6))).withColumn("_r", F.regexp_replace("_r", _IPV6, " "))
    out = out.withColumn("n_phone", F.regexp_count("_r", F.lit(_PHONE))).withColumn("_r", F.regexp_replace("_r", _PHONE, " "))
    return out.withColumn("clean", F.array_join(letters(F.col("_r")), " ")).drop("_r")


def sanitized(df: DataFrame, text: str = "text") -> DataFrame:
    """``redact`` with ``redactions`` as a map, and ``excluded_reason`` where nothing is left."""
    out = redact(df, text)
    counts = F.create_map(*[x for kind in KINDS for x in (F.lit(kind), F.col(f"n_{kind}"))])
    reason = F.when(F.col("clean") == "", F.lit("empty_after_sanitization"))
    return out.withColumns({"redactions": counts, "excluded_reason": reason}).drop(*[f"n_{kind}" for kind in KINDS])


def is_safe(text: Column) -> Column:
    """Words of a to z joined by single spaces, and nothing that looks like an identifier, any IPv4 shape included."""
    shapes = [_EMAIL, _URL, rf"(?U)\b{IPV4_SHAPE}\b", _IPV6, _PHONE]
    fine = (text != "") & ~text.rlike("[^a-z ]|^ | \\z|  ")
    for shape in shapes:
        fine = fine & ~text.rlike(shape)
    return F.coalesce(fine, F.lit(False))


def cut_at_word(clean: Column, limit: int = SNIPPET_LIMIT) -> Column:
    """At most ``limit`` characters, back to the last whole word; a single longer word is cut."""
    if limit < 1:
        raise ValueError("snippet limit must be positive")
    head = F.substring(clean, 1, limit)
    return F.when(F.length(clean) <= limit, clean).when(F.substring(clean, limit + 1, 1) == " ", head).otherwise(F.regexp_replace(head, " [^ ]*$", ""))


def safe_snippet(df: DataFrame, text: str = "text", limit: int = SNIPPET_LIMIT, name: str = "snippet", allow_empty: bool = False) -> DataFrame:
    """Adds a snippet of the sanitized text; an empty one is an error, as it could not be shown, unless allowed."""
    out = redact(df, text)
    checked = cut_at_word(F.col("clean"), limit) if allow_empty else F.when(F.col("clean") == "", F.raise_error(F.lit("snippet source must contain text after sanitization")).cast("string")).otherwise(cut_at_word(F.col("clean"), limit))
    return out.withColumn(name, checked).drop("clean", *[f"n_{kind}" for kind in KINDS])


def collapsed_snippet(text: Column, limit: int = SNIPPET_LIMIT) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit)

"""Line deduplication by a deletion-neighbourhood join.

Two lines are the same if they are equal after lower-casing and collapsing white space, or if both are long enough and
one insertion, deletion or substitution of a character turns one into the other.  Lines within one edit have a common
variant: both without the same position (substitution), or the longer without one position (insertion).  Variants are
hashed keys; equal keys meet, the edit distance of what met is verified, and of each such pair the earlier line stays.

Variants of every line would be as many as the characters of the corpus.  One edit leaves the first or the last half of
a line as it was, so lines first meet by hashes of their halves.  A line whose half another distinct line shares then
emits variants without each of 16 parts, and variants without one character only in parts outside which another line is
equal.  That loses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Normalised lines under this many characters are compared for equality only: one edit makes a short line another line.
MIN_FUZZY_CHARS = 20
#: Candidate lines up to this many (under 64 bytes each) are broadcast to the texts; more are joined by shuffle.
MOST_LINES_BROADCAST = 400_000
#: Parts that a candidate line is cut into before single characters are left out.
BLOCKS = 16


def normal_line(line: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x20\x09-\x0D]")


def _half_keys(x: Column) -> Column:
    """Hashes of the halves in which a line can agree with one that is as long, one shorter or one longer."""
    n = F.length(x)
    parts = []
    for h in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        parts += [F.xxhash64(F.lit("<"), h, F.left(x, h)), F.xxhash64(F.lit(">"), h, F.right(x, h))]
    return F.array_distinct(F.array(*parts))


def _block_variants(candidates: DataFrame) -> DataFrame:
    """(a, b, x) -> (key, a, b, start, n): the line without each of BLOCKS parts, n characters from start on (from 1).

    The parts are those of a line of the same length, and those of one that is a character shorter, with that character.
    """
    length = F.length("x")

    def parts(base: Column, more: int) -> Column:
        def one(j: Column) -> Column:
            start, end = F.floor(j * base / BLOCKS).cast("int"), (F.floor((j + 1) * base / BLOCKS) + more).cast("int")
            rest = F.xxhash64(base, j, F.left("x", start), F.right("x", length - end))
            return F.struct(rest.alias("key"), (start + 1).alias("start"), (end - start).alias("n"))

        return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), one)

    return candidates.select("a", "b", F.explode(F.concat(parts(length, 0), parts(length - 1, 1))).alias("p")).select("p.key", "a", "b", "p.start", "p.n")


def _shared(keyed: DataFrame) -> DataFrame:
    """The keys that two different lines have."""
    return keyed.groupBy("key").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo <> hi").select("key")


def _variants(candidates: DataFrame) -> DataFrame:
    """(a, b, o, x) -> (key, i, a, b, o): the line itself (i = 0), and the line without each character where an edit may be."""
    parts = _block_variants(candidates)
    near = parts.join(_shared(parts), "key", "left_semi").groupBy("a", "b").agg(F.collect_set(F.struct("start", "n")).alias("where"))
    at = F.array_distinct(F.flatten(F.transform("where", lambda w: F.when(w["n"] > 0, F.sequence(w["start"], w["start"] + w["n"] - 1)).otherwise(F.array().cast("array<int>")))))
    one = F.transform(at, lambda i: F.struct(i.alias("i"), F.xxhash64(F.concat(F.left(F.col("x"), i - 1), F.substr(F.col("x"), i + 1))).alias("key")))
    cut = candidates.join(near, ["a", "b"]).select("a", "b", "o", F.explode(one).alias("c")).select("c.key", "c.i", "a", "b", "o")
    return cut.unionByName(candidates.select(F.xxhash64("x").alias("key"), F.lit(0).alias("i"), "a", "b", "o"))


def _near_dropped(candidates: DataFrame) -> DataFrame:
    """(a, b) of the lines that have an earlier line within one edit."""
    me = F.struct("o", "a", "b")
    earliest = lambda which, group: F.min(F.when(which, me)).over(Window.partitionBy(*group))
    cut = F.col("i") > 0
    met = _variants(candidates).withColumns({"_whole": earliest(~cut, ["key"]), "_longer": earliest(cut, ["key"]), "_sub": earliest(cut, ["key", "i"])})
    # Lines that agree without position i differ there alone; a longer line meets the whole line that it contains.
    partners = F.when(cut, F.array("_sub", "_whole")).otherwise(F.array("_longer"))
    pairs = met.select("a", "b", "o", F.explode(partners).alias("p")).filter(F.col("p.o") < F.col("o")).select("a", "b", F.col("p.a").alias("pa"), F.col("p.b").alias("pb")).distinct()
    text = candidates.select("a", "b", "x")
    other = candidates.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("x").alias("y"))
    return pairs.join(text, ["a", "b"]).join(other, ["pa", "pb"]).filter(F.levenshtein("x", "y", 1) >= 0).select("a", "b").distinct()


def dedup_lines(docs: DataFrame, min_fuzzy_chars: int = MIN_FUZZY_CHARS) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of ``text``, and n_lines, n_dropped, emptied beside them.

    Lines end at line feeds.  Of lines that are the same (see above) the earliest stays, by doc_id (nulls last), then a
    hash of the text, then line number; a line goes if any earlier one is within one edit of it.  Blank lines are never
    counted, compared or dropped.  ``emptied`` tells that a document had lines and lost all.  A null text stays null,
    with n_lines 0.  Rows repeated with the same doc_id and text count as one document and come out alike.  Other
    columns pass through; where the table has a column n_lines, n_dropped or emptied, its own stays and the one made here
    is named lines_n_lines and so on.  An empty table gives an empty result.
    """
    out = deduped(docs, min_fuzzy_chars)
    return common.beside(out, "lines", n_lines=F.col("n_lines"), n_dropped=F.col("n_dropped"), emptied=F.col("emptied"))


def deduped(docs: DataFrame, min_fuzzy_chars: int = MIN_FUZZY_CHARS) -> DataFrame:
    """As ``dedup_lines``, with each row of ``docs`` as a struct: row, n_lines, n_dropped, emptied."""
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.split(F.col("text"), "\n").alias("ls"))
    lines = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), F.posexplode(F.split(F.col("text"), "\n")).alias("l", "line")).filter(~_blank(F.col("line"))).withColumn("x", normal_line("line"))
    order = F.struct(F.col("d").isNull().alias("n"), F.coalesce("d", F.lit(0)).alias("d"), "h", "l")
    fuzzy = F.length("x") >= min_fuzzy_chars
    hashed = lines.select(F.xxhash64("x").alias("a"), F.xxhash64(F.lit("b"), "x").alias("b"), order.alias("o"), F.when(fuzzy, _half_keys(F.col("x"))).alias("k"))
    firsts = common.materialize(hashed.groupBy("a", "b").agg(F.min("o").alias("o"), F.first("k").alias("k")), "lines")

    keys = firsts.select("a", "b", F.explode("k").alias("key"))
    found = keys.join(_shared(keys), "key", "left_semi").select("a", "b").distinct()
    places = common.materialize(found.join(firsts.select("a", "b", "o"), ["a", "b"]), "line-candidates")
    by_doc = places.groupBy(F.col("o.n").alias("n"), F.col("o.d").alias("d"), F.col("o.h").alias("h")).agg(F.collect_list(F.struct("a", "b", "o")).alias("c"))
    few = places.count()
    texts = docs.select(F.col("doc_id").isNull().alias("n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text").alias("h"), "text")
    read = texts.join(common.broadcast_if_small(by_doc, few, MOST_LINES_BROADCAST), ["n", "d", "h"])
    taken = common.bind(F.split("text", "\n"), lambda ls: F.transform("c", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["o"].alias("o"), normal_line(F.element_at(ls, c["o"]["l"] + 1)).alias("x"))))
    candidates = read.select(F.explode(taken).alias("t")).select("t.*").dropDuplicates(["a", "b"])
    dropped = common.materialize(_near_dropped(common.materialize(candidates, "line-texts")), "lines-dropped")

    stays = firsts.select("a", "b", "o").join(dropped, ["a", "b"], "left_anti")
    kept = stays.groupBy(F.col("o.n").alias("kn"), F.col("o.d").alias("kd"), F.col("o.h").alias("kh")).agg(F.collect_list("o.l").alias("kept"))
    out = named.join(kept, (F.col("d").isNull() == F.col("kn")) & (F.coalesce("d", F.lit(0)) == F.col("kd")) & (F.col("h") == F.col("kh")), "left")
    kept_or_none = F.coalesce("kept", F.array().cast("array<int>"))
    blank = F.filter(F.transform(F.col("ls"), lambda x, i: F.when(_blank(x), i)), lambda i: i.isNotNull())
    stay = F.array_sort(F.concat(kept_or_none, blank))
    n_lines = F.coalesce(F.size("ls") - F.size(blank), F.lit(0))
    out = out.withColumns({"_n": F.when(F.col("ls").isNull(), 0).otherwise(n_lines), "_k": F.size(kept_or_none), "_text": F.array_join(F.transform(stay, lambda i: F.element_at("ls", i + 1)), "\n")})
    return out.select(F.col("row").withField("text", F.col("_text")).alias("row"), F.col("_n").cast("long").alias("n_lines"), (F.col("_n") - F.col("_k")).cast("long").alias("n_dropped"), ((F.col("_n") > 0) & (F.col("_k") == 0)).alias("emptied"))


QUERY = "op9_dedup_lines"


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def lines_ctes(docs: str) -> str:
    """DuckDB common table expressions; ``lines_out`` has one row per document of ``docs`` (doc_id unique, not null)."""
    return rf"""
ln AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS l, unnest(string_split(text, chr(10))) AS line FROM {docs} WHERE text IS NOT NULL),
nl AS (SELECT *, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS x FROM ln),
fl AS (SELECT x, min((doc_id, l)) AS o, length(x) AS n FROM nl WHERE x <> '' GROUP BY x),
hk AS (SELECT x, o, n, h, unnest(['<' || left(x, h), '>' || right(x, h)]) AS k FROM (SELECT x, o, n, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM fl WHERE n >= {MIN_FUZZY_CHARS})),
nd AS (SELECT DISTINCT p.x FROM hk p JOIN hk q ON p.h = q.h AND p.k = q.k AND q.o < p.o WHERE abs(p.n - q.n) <= 1 AND levenshtein(p.x, q.x) <= 1),
st AS (SELECT nl.doc_id, nl.l, nl.line, nl.x, nl.x = '' OR (fl.o = (nl.doc_id, nl.l) AND nd.x IS NULL) AS stays FROM nl LEFT JOIN fl ON nl.x = fl.x LEFT JOIN nd ON nl.x = nd.x),
lines_out AS (SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(st.line, chr(10) ORDER BY st.l) FILTER (st.stays), '') END AS text,
   count(*) FILTER (st.x <> '') AS n_lines, count(*) FILTER (st.x <> '' AND NOT st.stays) AS n_dropped,
   count(*) FILTER (st.x <> '') > 0 AND count(*) FILTER (st.x <> '' AND st.stays) = 0 AS emptied
 FROM {docs} d LEFT JOIN st ON d.doc_id = st.doc_id GROUP BY d.doc_id)"""


SQL = f"WITH {lines_ctes('documents')} SELECT doc_id, text, n_lines, n_dropped, emptied FROM lines_out"

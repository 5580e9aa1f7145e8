"""Registered queries over the driver's tables and the DuckDB text each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as C
from ..operators import metrics as M
from ..operators import retrieve as R
from ..operators import split as S
from ..operators import vectorize as V
from ..functions import register
from ..sources import corpus, store
from .validation import validate_weights

K = 10
#: Held-out documents that the sampled evaluations ask.
SAMPLED = 100
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def docs_of(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of few files is dealt over the cores before work on its texts."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def space_of(spark, sf_dir, stop_words=T.STOP_WORDS) -> V.Space:
    return V.Space(docs_of(spark, sf_dir).select("doc_id", "text"), stop_words)


def bench_queries(spark, sf_dir, stop_words=T.STOP_WORDS) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return V.tokenized(items, stop_words, "query_id")


def labelled(spark, sf_dir) -> DataFrame:
    """lang as the label."""
    return docs_of(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("label"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _tok(stop: str = _STOP, table: str = "documents", key: str = "doc_id") -> str:
    cond = f" AND x NOT IN ({stop})" if stop else ""
    return f"SELECT {key}, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 1{cond}) AS toks FROM {table}"


_BASE = f"""tok AS ({_tok()}),
cnt AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY doc_id, term),
nn AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok),
voc AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS bidf FROM (SELECT term, count(*) AS df FROM cnt GROUP BY term), nn)"""
_TF = {"raw": "c", "log": "1.0 + ln(c)", "double": "0.5 + 0.5 * c / max(c) OVER (PARTITION BY {k})"}


def _weights(mode: str, name: str = "w", source: str = "cnt", key: str = "doc_id") -> str:
    tf = _TF[mode].format(k=key)
    return f"""{name}u AS (SELECT {key}, {source}.term, c, idf, ({tf}) * idf AS u FROM {source} JOIN voc ON {source}.term = voc.term),
{name} AS (SELECT {key}, term, c, idf, u / sqrt(sum(u * u) OVER (PARTITION BY {key})) AS w FROM {name}u)"""


_QTOK = f"qt AS ({_tok(table='benchmark', key='item_id AS query_id')}), qc AS (SELECT query_id, term, count(*) AS c FROM (SELECT query_id, unnest(toks) AS term FROM qt) GROUP BY query_id, term)"
_BM25 = f"""bl AS (SELECT doc_id, len(toks) AS length FROM tok),
bw AS (SELECT cnt.doc_id, cnt.term, bidf * c * ({V.K1} + 1.0) / (c + {V.K1} * (1.0 - {V.B} + {V.B} * length / avgdl)) AS w FROM cnt JOIN voc ON cnt.term = voc.term JOIN bl ON cnt.doc_id = bl.doc_id, nn)"""


def _search(mode: str, k: int = K, out: str = "top") -> str:
    """CTEs up to ``out``: query_id, rank, doc_id, score."""
    if mode == "bm25":
        return f"""{_BM25}, {out}_s AS (SELECT query_id, doc_id, sum(w) AS score FROM bw JOIN (SELECT DISTINCT query_id, term FROM qc) q ON bw.term = q.term GROUP BY query_id, doc_id),
{_rank(out, k)}"""
    return f"""{_weights(mode, f"d{mode}")}, {_weights(mode, f"q{mode}", "qc", "query_id")},
{out}_s AS (SELECT query_id, doc_id, sum(d{mode}.w * q{mode}.w) AS score FROM d{mode} JOIN q{mode} ON d{mode}.term = q{mode}.term GROUP BY query_id, doc_id),
{_rank(out, k)}"""


def _rank(out: str, k: int) -> str:
    return f"{out} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM {out}_s WHERE score > 0) WHERE rank <= {k})"


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Text


@query(f"SELECT doc_id, toks AS tokens, len(toks) AS n FROM ({_tok()})".replace("toks AS tokens, ", "array_to_string(toks, ' ') AS tokens, "))
def tokenize_terms(spark, sf_dir):
    d = spread(docs_of(spark, sf_dir).select("doc_id", "text")).select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n"))


@query(f"SELECT doc_id, len(toks) AS n FROM ({_tok('')})")
def tokenize_without_stop_words(spark, sf_dir):
    d = spread(docs_of(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", F.size(T.tokenize(F.col("text"), ())).cast("long").alias("n"))


_EMAIL_SQL, _URL_SQL = f"(?i){T.EMAIL}", f"(?i){T.URL}"
_OCT = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IP_SQL = rf"\b{_OCT}(?:\.{_OCT}){{3}}\b"
_PHONE_SQL = r"(^|\W)((?:\+?\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{4}|\d{3}[-.]\d{4})($|\W)"
# An address fills a whole run of hexadecimal digits and colons; RE2 cannot look around, so a run's neighbours are matched too.
_IPV6_RUN, _IPV6_SQL = "[0-9A-Fa-f:]+", T._IPV6.removeprefix("(?<![0-9A-Fa-f:])").removesuffix("(?![0-9A-Fa-f:])")
_IPV6_AROUND = f"(^|[^0-9A-Fa-f:]){_IPV6_SQL}($|[^0-9A-Fa-f:])"
_CLEAN = f"""s1 AS (SELECT *, len(regexp_extract_all(text, '{_EMAIL_SQL}')) AS n_email, regexp_replace(text, '{_EMAIL_SQL}', ' ', 'g') AS t1 FROM documents),
s2 AS (SELECT *, len(regexp_extract_all(t1, '{_URL_SQL}')) AS n_url, regexp_replace(t1, '{_URL_SQL}', ' ', 'g') AS t2 FROM s1),
s2b AS (SELECT *, len(regexp_extract_all(t2, '{_IP_SQL}')) AS n_ipv4, regexp_replace(t2, '{_IP_SQL}', ' ', 'g') AS t2b FROM s2),
s3 AS (SELECT *, len(list_filter(regexp_extract_all(t2b, '{_IPV6_RUN}'), lambda x: regexp_full_match(x, '{_IPV6_SQL}'))) AS n_ipv6,
  regexp_replace(regexp_replace(t2b, '{_IPV6_AROUND}', '\\1 \\2', 'g'), '{_IPV6_AROUND}', '\\1 \\2', 'g') AS t3 FROM s2b),
s4 AS (SELECT *, len(regexp_extract_all(t3, '{_PHONE_SQL}')) AS n_phone, regexp_replace(t3, '{_PHONE_SQL}', '\\1 \\3', 'g') AS t4 FROM s3),
cl AS (SELECT *, array_to_string(regexp_extract_all(lower(t4), '[a-z]+'), ' ') AS clean FROM s4)"""


def _redacted(spark, sf_dir):
    return T.redact(spread(docs_of(spark, sf_dir).select("doc_id", "text", "lang", "source")))


@query(f"WITH {_CLEAN} SELECT doc_id, n_email, n_url FROM cl")
def sanitize_email_url(spark, sf_dir):
    return _redacted(spark, sf_dir).select("doc_id", F.col("n_email").cast("long").alias("n_email"), F.col("n_url").cast("long").alias("n_url"))


@query(f"WITH {_CLEAN} SELECT doc_id, n_ipv4, n_ipv6 FROM cl")
def sanitize_ip(spark, sf_dir):
    return _redacted(spark, sf_dir).select("doc_id", F.col("n_ipv4").cast("long").alias("n_ipv4"), F.col("n_ipv6").cast("long").alias("n_ipv6"))


# Texts with made-up addresses at their end: of four groups and a gap, of eight, of nine (none), with a group too long (none).
_M = lambda i: f"substr(md5(CAST(doc_id AS VARCHAR)), {i}, 4)"
_SIX = " || ':' || ".join(_M(1 + 4 * i) for i in range(6))
_WITH_IPV6 = f"SELECT doc_id, text || ' see ' || {_M(1)} || ':' || {_M(5)} || '::' || {_M(9)} || ' or ' || {_SIX} || ':1:2 not ' || {_SIX} || ':1:2:3 nor ' || {_M(1)} || '0::1,' || '::' || {_M(3)} || '.' AS text FROM documents"


@query(f"WITH {_CLEAN.replace('FROM documents', f'FROM ({_WITH_IPV6})')} SELECT doc_id, n_ipv6, clean FROM cl")
def sanitize_ipv6(spark, sf_dir):
    d = spread(docs_of(spark, sf_dir).select("doc_id", "text"))
    made = d.selectExpr("doc_id", _WITH_IPV6.replace("VARCHAR", "STRING").removeprefix("SELECT doc_id, ").removesuffix(" FROM documents"))
    return T.redact(made).select("doc_id", F.col("n_ipv6").cast("long").alias("n_ipv6"), "clean")


@query(f"WITH {_CLEAN} SELECT doc_id, n_phone FROM cl")
def sanitize_phone(spark, sf_dir):
    return _redacted(spark, sf_dir).select("doc_id", F.col("n_phone").cast("long").alias("n_phone"))


@query(f"WITH {_CLEAN} SELECT doc_id, clean, CASE WHEN clean = '' THEN 'empty_after_sanitization' END AS excluded_reason FROM cl")
def sanitize_normalize(spark, sf_dir):
    return T.sanitized(spread(docs_of(spark, sf_dir).select("doc_id", "text"))).select("doc_id", "clean", "excluded_reason")


@query(rf"WITH {_CLEAN} SELECT doc_id, regexp_matches(text, '^[a-z]+( [a-z]+)*$') AS raw_safe, regexp_matches(clean, '^[a-z]+( [a-z]+)*$') AS clean_safe FROM cl")
def safe_text(spark, sf_dir):
    return _redacted(spark, sf_dir).join(docs_of(spark, sf_dir).select("doc_id", F.col("text").alias("t")), "doc_id").select("doc_id", T.is_safe(F.col("t")).alias("raw_safe"), T.is_safe(F.col("clean")).alias("clean_safe"))


@query(f"WITH {_CLEAN} SELECT doc_id, CASE WHEN length(clean) <= 240 THEN clean WHEN substr(clean, 241, 1) = ' ' THEN substr(clean, 1, 240) ELSE regexp_replace(substr(clean, 1, 240), ' [^ ]*$', '') END AS snippet FROM cl")
def safe_snippet(spark, sf_dir):
    """As in the SQL, a document without words has an empty snippet."""
    return T.safe_snippet(spread(docs_of(spark, sf_dir).select("doc_id", "text")), allow_empty=True).select("doc_id", "snippet")


@query(r"SELECT doc_id, substr(trim(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g')), 1, 240) AS snippet FROM documents")
def collapsed_snippet(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", T.collapsed_snippet(F.col("text")).alias("snippet"))


@query(f"WITH {_CLEAN} SELECT source AS name, count(*) AS raw, count(*) FILTER (clean <> '') AS retained, count(*) FILTER (clean = '') AS excluded FROM cl GROUP BY source")
def privacy_by_category(spark, sf_dir):
    docs, categories = corpus.read_documents(spark, f"{sf_dir}/documents.parquet", "source")
    return corpus.category_report(spread(docs), categories)


@query(f"WITH {_CLEAN} SELECT count(*) AS documents_input, count(*) FILTER (clean <> '') AS documents_retained, count(*) FILTER (clean = '') AS documents_dropped, count(*) FILTER (clean <> '') / count(*) AS retention_rate, {', '.join(f'CAST(sum(n_{k}) AS BIGINT) AS n_{k}' for k in T.KINDS)} FROM cl")
def privacy_summary(spark, sf_dir):
    return corpus.privacy_summary(spread(docs_of(spark, sf_dir).select("doc_id", "text")))


@query("SELECT doc_id, sha256(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) || length(lang) || ':' || lang || length(text) || ':' || text) AS h FROM documents")
def corpus_fingerprint_rows(spark, sf_dir):
    return corpus.row_fingerprints(labelled(spark, sf_dir))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 17")
def document_by_id(spark, sf_dir):
    return docs_of(spark, sf_dir).filter("doc_id = 17").select("doc_id", "lang", "n_chars")


# Vocabulary and weights


@query(f"WITH {_BASE} SELECT doc_id, term, c AS count FROM cnt")
def term_counts(spark, sf_dir):
    return space_of(spark, sf_dir).counts


@query(f"WITH {_BASE} SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, round(idf, 9) AS idf, round(bidf, 9) AS bm25_idf FROM voc")
def vocab_df_idf(spark, sf_dir):
    return V.numbered(space_of(spark, sf_dir).vocab).select("term_id", "term", "df", F.round("idf", 9).alias("idf"), F.round("bm25_idf", 9).alias("bm25_idf"))


@query(f"WITH {_BASE} SELECT doc_id, len(toks) AS length, round(avgdl, 6) AS average FROM tok, nn")
def doc_lengths(spark, sf_dir):
    s = space_of(spark, sf_dir)
    return s.lengths.select("doc_id", "length", F.round(F.lit(s.average), 6).alias("average"))


def _weight_query(mode):
    def run(spark, sf_dir):
        return space_of(spark, sf_dir).postings([mode], False).select("doc_id", "term", F.round(f"w_{mode}", 6).alias("w"))

    run.__name__ = f"tfidf_{mode}"
    return query(f"WITH {_BASE}, {_weights(mode)} SELECT doc_id, term, round(w, 6) AS w FROM w")(run)


for _mode in V.TF_MODES:
    _weight_query(_mode)


@query(f"WITH {_BASE}, {_QTOK}, {_weights('raw', 'w', 'qc', 'query_id')} SELECT query_id, term, round(w, 6) AS w FROM w")
def tfidf_transform(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    return space_of(spark, sf_dir).transform(items, ["raw"], "query_id").select("query_id", "term", F.round("w_raw", 6).alias("w"))


@query(f"WITH {_BASE}, {_BM25} SELECT doc_id, term, round(w, 6) AS w FROM bw")
def bm25_weights(spark, sf_dir):
    return space_of(spark, sf_dir).postings([]).select("doc_id", "term", F.round("w_bm25", 6).alias("w"))


@query(f"WITH {_BASE} SELECT n AS n_docs, v AS n_terms, z AS nnz, round(z / (n * v), 9) AS density, z * 12 + 4 * (n + 1) AS sparse_bytes, 8 * n * v AS dense_bytes, z * 12 + 4 * (v + 1) AS posting_bytes FROM nn, (SELECT count(*) AS v FROM voc), (SELECT count(*) AS z FROM cnt)")
def matrix_stats(spark, sf_dir):
    s = space_of(spark, sf_dir)
    out = V.matrix_stats(s.counts, s.n_docs, s.vocab.count())
    return out.withColumn("density", F.round("density", 9))


@query(f"WITH {_BASE}, {_weights('raw')} SELECT doc_id, round(w, 6) AS w FROM w WHERE term = 'thing'")
def posting_lookup(spark, sf_dir):
    return space_of(spark, sf_dir).postings(["raw"], False).filter("term = 'thing'").select("doc_id", F.round("w_raw", 6).alias("w"))


@query(f"WITH {_BASE}, {_weights('raw')} SELECT doc_id, term, round(w, 6) AS w FROM w WHERE doc_id = 17")
def matrix_row(spark, sf_dir):
    return space_of(spark, sf_dir).postings(["raw"], False).filter("doc_id = 17").select("doc_id", "term", F.round("w_raw", 6).alias("w"))


@query(f"WITH {_BASE}, {_weights('raw')} SELECT doc_id, term, c AS count, round(idf, 6) AS idf, round(c * idf, 6) AS weighted, round(w, 6) AS w FROM w WHERE doc_id = (SELECT min(doc_id) FROM cnt) ORDER BY term LIMIT 5")
def stage_example(spark, sf_dir):
    p = space_of(spark, sf_dir).postings(["raw"], False)
    first = p.agg(F.min("doc_id").alias("doc_id"))
    return p.join(F.broadcast(first), "doc_id").orderBy("term").limit(5).select("doc_id", "term", "count", F.round("idf", 6).alias("idf"), F.round(F.col("count") * F.col("idf"), 6).alias("weighted"), F.round("w_raw", 6).alias("w"))


@query(f"WITH {_BASE} SELECT problem, CAST(0 AS BIGINT) AS cells FROM (VALUES ('repeated cells'), ('values'), ('unknown terms'), ('unknown documents'), ('documents over the shape')) v(problem) UNION ALL SELECT 'cells without a term', (SELECT count(*) FROM cnt WHERE length(term) % 7 = 0)")
def matrix_problems(spark, sf_dir):
    """None in the fitted matrix; and what is found where the vocabulary lacks the terms of every seventh length."""
    s = space_of(spark, sf_dir)
    fine = V.invalid_cells(s.counts, s.vocab, s.n_docs, ids=s.lengths)
    broken = V.invalid_cells(s.counts, s.vocab.filter("length(term) % 7 <> 0"), s.n_docs).filter("problem = 'unknown terms'")
    return fine.unionByName(broken.withColumn("problem", F.lit("cells without a term")))


@query(f"WITH {_BASE} SELECT n AS n_docs, (SELECT count(*) FROM voc) AS n_terms, (SELECT count(*) FROM cnt) AS cells, true AS passed FROM nn")
def weights_against_ml(spark, sf_dir):
    """The TF-IDF weights against those of Spark's ML pipeline, which shares no code with the fit."""
    docs = spread(docs_of(spark, sf_dir).select("doc_id", "text"))
    out = validate_weights(V.Space(docs), docs)
    return out.select("n_docs", "n_terms", "cells", "passed")


@query(f"WITH {_CLEAN}, tk AS ({_tok()}) SELECT cl.doc_id, clean, len(toks) AS n_tokens, n_email + n_url + n_ipv4 + n_ipv6 + n_phone AS redacted, regexp_matches(clean, '^[a-z]+( [a-z]+)*$') AS safe FROM cl JOIN tk ON cl.doc_id = tk.doc_id")
def sql_functions(spark, sf_dir):
    """The text functions as they are registered for SQL."""
    register.register(spark)
    spread(docs_of(spark, sf_dir).select("doc_id", "text")).createOrReplaceTempView("lexi_documents")
    total = "aggregate(map_values(lexi_redactions(text)), 0, (a, x) -> a + x)"
    return spark.sql(f"SELECT doc_id, lexi_clean(text) AS clean, CAST(size(lexi_tokens(text)) AS BIGINT) AS n_tokens, CAST({total} AS BIGINT) AS redacted, lexi_is_safe(lexi_clean(text)) AS safe FROM lexi_documents")


# Search


def flagship(spark, sf_dir):
    """Cosine top 10 of the first benchmark passage, with language and snippet."""
    q = bench_queries(spark, sf_dir).filter("query_id = 0")
    best = R.search_batch(space_of(spark, sf_dir), q, K)
    shown = docs_of(spark, sf_dir).select("doc_id", "lang", T.collapsed_snippet(F.col("text")).alias("snippet"))
    return best.join(shown, "doc_id").select("rank", "doc_id", "lang", F.round("score", 6).alias("score"), "snippet")


_top = "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM top"


def _search_query(name, method, mode, strategy):
    def run(spark, sf_dir):
        best = R.search_batch(space_of(spark, sf_dir), bench_queries(spark, sf_dir), K, method, mode, strategy)
        return best.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))

    run.__name__ = name
    return query(f"WITH {_BASE}, {_QTOK}, {_search('bm25' if method == 'bm25' else mode)} {_top}")(run)


for _mode in V.TF_MODES:
    _search_query(f"search_cosine_{_mode}", "tfidf", _mode, "inverted")
_search_query("search_scan_raw", "tfidf", "raw", "scan")
_search_query("search_bm25", "bm25", "raw", "inverted")


# Searches of a stored index: it is built once for a session and a table, as an index is; only the search is the query.
_INDEXES: dict = {}


def index_of(spark, sf_dir) -> store.Index:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = store.scratch_folder(spark, "index")
        docs, names = corpus.read_documents(spark, f"{sf_dir}/documents.parquet", "lang")
        store.save(V.Space(docs.select("doc_id", "text")), docs, names, path, "", allow_empty_snippets=True)
        _INDEXES[key] = store.load(spark, path)
    return _INDEXES[key]


def _index_query(name, method, mode, strategy):
    def run(spark, sf_dir):
        best = store.search_batch(index_of(spark, sf_dir), bench_queries(spark, sf_dir), K, method, mode, strategy)
        return best.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))

    run.__name__ = name
    return query(f"WITH {_BASE}, {_QTOK}, {_search('bm25' if method == 'bm25' else mode)} {_top}")(run)


_index_query("search_index_cosine", "tfidf", "raw", "inverted")
_index_query("search_index_bm25", "bm25", "raw", "inverted")
_index_query("search_index_scan", "tfidf", "raw", "scan")


@query(f"WITH {_BASE}, {_QTOK}, {_search('raw', K, 'a')}, {_search('bm25', K, 'b')} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(a.rank AS INTEGER) AS base_rank, CAST(b.rank AS INTEGER) AS other_rank, len(toks) AS length FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id JOIN tok ON tok.doc_id = coalesce(a.doc_id, b.doc_id)")
def tfidf_bm25_comparison(spark, sf_dir):
    """Ranks of both, null outside the list, and how long the document is."""
    index, q = index_of(spark, sf_dir), bench_queries(spark, sf_dir)
    return R.compared(store.search_batch(index, q, K), store.search_batch(index, q, K, "bm25"), index.docs)


@query(f"WITH {_BASE}, {_QTOK}, {_search('raw')} SELECT count(*) AS shared, CAST(0 AS BIGINT) AS unshared, true AS consistent FROM top")
def scan_inverted_consistency(spark, sf_dir):
    s, q = space_of(spark, sf_dir), bench_queries(spark, sf_dir)
    p = s.postings(["raw"], False)
    return R.consistency(*[R.search_batch(s, q, K, strategy=x, postings=p) for x in R.STRATEGIES])


@query(f"WITH {_BASE}, {_QTOK}, {_search('raw', 5, 'a')}, {_search('log', 5, 'b')} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(a.rank AS INTEGER) AS base_rank, CAST(b.rank AS INTEGER) AS other_rank FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id WHERE a.rank IS DISTINCT FROM b.rank")
def tf_mode_rank_shift(spark, sf_dir):
    s, q = space_of(spark, sf_dir), bench_queries(spark, sf_dir)
    p = s.postings(["raw", "log"], False)
    return R.rank_shift(*[R.search_batch(s, q, 5, mode=m, postings=p) for m in ("raw", "log")])


@query(f"WITH {_BASE}, {_QTOK}, {_search('raw', K, 'a')}, {_search('bm25', K, 'b')} SELECT query_id, count(*) AS overlap FROM a JOIN b USING (query_id, doc_id) GROUP BY query_id")
def tfidf_bm25_overlap(spark, sf_dir):
    s, q = space_of(spark, sf_dir), bench_queries(spark, sf_dir)
    p = s.postings(["raw"])
    return R.overlap(R.search_batch(s, q, K, postings=p), R.search_batch(s, q, K, "bm25", postings=p))


# Made-up queries of the letters a to f, of which some hold a known term and some none.
@query(f"WITH {_BASE}, ct AS ({_tok(table='(SELECT conv_id * 1000 + turn AS query_id, md5(CAST(conv_id * 1000 + turn AS VARCHAR)) AS text FROM conversations)', key='query_id')}) SELECT DISTINCT query_id FROM ct WHERE NOT list_has_any(toks, (SELECT list(term) FROM voc))")
def oov_queries(spark, sf_dir):
    turn = (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(turn).distinct().withColumn("text", F.md5(F.col("query_id").cast("string")))
    return R.unanswerable(space_of(spark, sf_dir), V.tokenized(turns, key="query_id"))


_SPLIT = "sp AS (SELECT doc_id, text, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= ceil(0.2 * count(*) OVER (PARTITION BY lang)) AS is_test FROM documents)"


@query(f"WITH {_SPLIT} SELECT doc_id, label, is_test FROM sp")
def stratified_split(spark, sf_dir):
    return S.stratified_split(labelled(spark, sf_dir)).select("doc_id", "label", "is_test")


_SUBSET = f"""{_SPLIT}, te AS (SELECT * FROM sp WHERE is_test),
sz AS (SELECT label, {SAMPLED} * count(*) / (SELECT count(*) FROM te) AS q FROM te GROUP BY label),
tk AS (SELECT label, floor(q) + CAST(row_number() OVER (ORDER BY q - floor(q) DESC, label) <= {SAMPLED} - (SELECT sum(floor(q)) FROM sz) AS INTEGER) AS take FROM sz),
qs AS (SELECT * FROM (SELECT te.*, row_number() OVER (PARTITION BY te.label ORDER BY md5('42:' || doc_id), doc_id) AS place, take FROM te JOIN tk ON te.label = tk.label) WHERE place <= take)"""


@query(f"WITH {_SUBSET} SELECT doc_id, label FROM qs")
def query_subset(spark, sf_dir):
    test = S.stratified_split(labelled(spark, sf_dir)).filter("is_test")
    return S.query_subset(test, SAMPLED).select("doc_id", "label")


@query(f"WITH {_SPLIT} SELECT count(*) FILTER (is_test) AS test, count(*) FILTER (NOT is_test) AS train, (SELECT count(*) FROM sp a JOIN sp b ON a.doc_id = b.doc_id WHERE a.is_test AND NOT b.is_test) AS shared FROM sp")
def split_disjoint(spark, sf_dir):
    d = S.stratified_split(labelled(spark, sf_dir)).select("doc_id", "is_test")
    test, train = d.filter("is_test").select("doc_id"), d.filter("NOT is_test").select("doc_id")
    return d.agg(F.count_if("is_test").alias("test"), F.count_if(~F.col("is_test")).alias("train")).crossJoin(test.intersect(train).agg(F.count("*").alias("shared")))


# Evaluation: held-out documents search the training documents; same language is relevant.  The queries with a DuckDB text
# ask a sample of SAMPLED held-out documents, as their texts do; those named ..._all ask every one and have no text.


def _evaluation(spark, sf_dir, method="tfidf", mode="raw", stop_words=T.STOP_WORDS, count=SAMPLED):
    if count is None:
        from .experiments import HeldOut

        return HeldOut(labelled(spark, sf_dir)).metrics(K, method, mode, stop_words)[0]
    d = S.stratified_split(labelled(spark, sf_dir))
    train, test = d.filter("NOT is_test").drop("is_test"), S.query_subset(d.filter("is_test").drop("is_test"), count)
    space = V.Space(train.select("doc_id", "text"), stop_words)
    q = test.select(F.col("doc_id").alias("query_id"), "text", "label")
    tokens = V.tokenized(q, stop_words, "query_id")
    weights = R.query_weights(space, tokens, method, mode)
    p = space.postings([mode] if method != "bm25" else [], method == "bm25")
    scores = R.scores_inverted(p, weights, "w_bm25" if method == "bm25" else f"w_{mode}", R.few_terms(tokens))
    ranking = R.padded_ranking(scores, q, train, K)
    return M.retrieval_metrics(ranking, q, train, K)


def _eval_sql(mode: str, stop: str = _STOP, p: str = "") -> str:
    base = _BASE.replace(_tok(), _tok(stop, "(SELECT * FROM sp WHERE NOT is_test)"))
    qtok = f"qt AS ({_tok(stop, 'qs', 'doc_id AS query_id')}), qc AS (SELECT query_id, term, count(*) AS c FROM (SELECT query_id, unnest(toks) AS term FROM qt) GROUP BY query_id, term)"
    return f"""{_SUBSET}, {base}, {qtok}, {_search(mode, K, 'pos')}, tr AS (SELECT doc_id, label FROM sp WHERE NOT is_test),
fill AS (SELECT qs.doc_id AS query_id, f.doc_id FROM qs, (SELECT doc_id FROM tr ORDER BY doc_id LIMIT {K}) f WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.query_id = qs.doc_id AND pos.doc_id = f.doc_id)),
rk AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY late, r, doc_id) AS rank FROM (SELECT query_id, doc_id, 0 AS late, rank AS r FROM pos UNION ALL SELECT query_id, doc_id, 1, 0 FROM fill)) WHERE rank <= {K}),
hit AS (SELECT rk.*, CAST(tr.label = qs.label AS INTEGER) AS rel, qs.label AS query_label, tr.label FROM rk JOIN tr ON rk.doc_id = tr.doc_id JOIN qs ON rk.query_id = qs.doc_id),
pr AS (SELECT *, CASE WHEN rel = 1 THEN sum(rel) OVER (PARTITION BY query_id ORDER BY rank) / rank ELSE 0.0 END AS pp FROM hit),
nr AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
pq AS (SELECT query_id, query_label, sum(rel) / {K} AS precision_at_k, sum(pp) / least(any_value(nr.n), {K}) AS ap_at_k, array_to_string(list(doc_id ORDER BY rank), ',') AS top_docs, array_to_string(list(pr.label ORDER BY rank), ',') AS top_labels FROM pr JOIN nr ON pr.query_label = nr.label GROUP BY query_id, query_label)"""


def _per_query(out):
    joined = lambda c, n: F.array_join(F.col(c).cast("array<string>"), ",").alias(n)
    return out.select("query_id", "query_label", *_six("precision_at_k", "ap_at_k"), joined("top_doc_ids", "top_docs"), joined("top_labels", "top_labels"))


@query(f"WITH {_eval_sql('raw')} SELECT query_id, query_label, round(precision_at_k, 6) AS precision_at_k, round(ap_at_k, 6) AS ap_at_k, top_docs, top_labels FROM pq")
def per_query_metrics(spark, sf_dir):
    return _per_query(_evaluation(spark, sf_dir))


@query()
def per_query_metrics_all(spark, sf_dir):
    return _per_query(_evaluation(spark, sf_dir, count=None))


_mean = "SELECT count(*) AS queries, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(ap_at_k), 6) AS map_at_k FROM pq"


def _eval_query(name, method, mode):
    def run(spark, sf_dir):
        return M.mean_metrics(_evaluation(spark, sf_dir, method, mode)).select("queries", *_six("precision_at_k", "map_at_k"))

    def run_all(spark, sf_dir):
        return M.mean_metrics(_evaluation(spark, sf_dir, method, mode, count=None)).select("queries", *_six("precision_at_k", "map_at_k"))

    run.__name__, run_all.__name__ = name, f"{name}_all"
    query()(run_all)
    return query(f"WITH {_eval_sql('bm25' if method == 'bm25' else mode)} {_mean}")(run)


for _mode in V.TF_MODES:
    _eval_query(f"eval_precision_map_{_mode}", "tfidf", _mode)
_eval_query("eval_precision_map_bm25", "bm25", "raw")


@query(f"WITH a AS (WITH {_eval_sql('raw')} SELECT query_id, ap_at_k FROM pq), b AS (WITH {_eval_sql('bm25')} SELECT query_id, ap_at_k FROM pq) SELECT count(*) FILTER (b.ap_at_k - a.ap_at_k > 1e-12) AS second_wins, count(*) FILTER (b.ap_at_k - a.ap_at_k < -1e-12) AS first_wins, count(*) FILTER (abs(b.ap_at_k - a.ap_at_k) <= 1e-12) AS ties FROM a JOIN b USING (query_id)")
def quality_difference(spark, sf_dir):
    return M.quality_difference(_evaluation(spark, sf_dir), _evaluation(spark, sf_dir, "bm25"))


@query()
def quality_difference_all(spark, sf_dir):
    from .experiments import HeldOut

    held = HeldOut(labelled(spark, sf_dir))
    one, found = held.measures(K)
    return M.quality_difference(one, held.measures(K, "bm25", fit=found.fit)[0])


def _ranked(out):
    return out.select("query_id", F.posexplode("top_doc_ids").alias("p", "doc_id")).select("query_id", (F.col("p") + 1).alias("rank"), "doc_id")


@query(f"WITH {_eval_sql('raw')} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id FROM rk")
def padded_ranking(spark, sf_dir):
    return _ranked(_evaluation(spark, sf_dir))


@query()
def padded_ranking_all(spark, sf_dir):
    return _ranked(_evaluation(spark, sf_dir, count=None))


_ablate = f"SELECT 'default' AS name, CAST({len(T.STOP_WORDS)} AS INTEGER) AS stop_word_count, (SELECT count(*) FROM voc) AS vocabulary_size, (SELECT round(avg(precision_at_k), 6) FROM pq) AS precision_at_k, (SELECT round(avg(ap_at_k), 6) FROM pq) AS map_at_k"


@query(f"SELECT * FROM (WITH {_eval_sql('raw')} {_ablate}) UNION ALL SELECT * FROM (WITH {_eval_sql('raw', '')} {_ablate.replace(repr('default'), repr('none')).replace(str(len(T.STOP_WORDS)), '0')})")
def stop_word_ablation(spark, sf_dir):
    from .experiments import ablation_variant

    parts = [ablation_variant(labelled(spark, sf_dir), name, words, SAMPLED, K) for name, words in (("default", T.STOP_WORDS), ("none", ()))]
    return parts[0].unionByName(parts[1]).select("name", "stop_word_count", "vocabulary_size", *_six("precision_at_k", "map_at_k"))


def _variant_sql(mode: str, name: str) -> str:
    return f"SELECT * FROM (WITH {_eval_sql(mode)} SELECT '{name}' AS method, count(*) AS queries, (SELECT count(*) FROM qt WHERE query_id NOT IN (SELECT query_id FROM qc JOIN voc ON qc.term = voc.term)) AS empty_queries, (SELECT count(*) FROM cnt) AS train_nnz, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(ap_at_k), 6) AS map_at_k FROM pq)"


@query(" UNION ALL ".join(_variant_sql(m, m) for m in (*V.TF_MODES, "bm25")))
def tf_variants(spark, sf_dir):
    from .experiments import tf_variants as variants

    return variants(labelled(spark, sf_dir), SAMPLED, K).select("method", "queries", "empty_queries", "train_nnz", *_six("precision_at_k", "map_at_k"))


@query()
def tf_variants_classified(spark, sf_dir):
    """The same of every held-out document, with accuracy and macro-F1 of a linear SVM by TF mode."""
    from .experiments import tf_variants as variants

    return variants(labelled(spark, sf_dir), None, K, classify=True)


@query()
def stop_word_ablation_classified(spark, sf_dir):
    """All held-out documents of one seed, with accuracy and macro-F1 of a linear SVM."""
    from .experiments import stop_word_ablation as ablation

    return ablation(labelled(spark, sf_dir), None, K, seeds=(S.SEED,), classify=True)


@query(f"WITH {_eval_sql('raw')} SELECT query_id, to_json({{'query_id': query_id, 'query_label': query_label, 'top_doc_ids': (SELECT list(doc_id ORDER BY rank) FROM rk WHERE rk.query_id = pq.query_id)}}) AS record FROM pq")
def per_query_json(spark, sf_dir):
    """A nested record of each query."""
    return _evaluation(spark, sf_dir).select("query_id", F.to_json(F.struct("query_id", "query_label", "top_doc_ids")).alias("record"))


@query(f"WITH {_CLEAN} SELECT to_json(map_from_entries(list((source, {{'raw': raw, 'retained': retained, 'excluded': excluded}}) ORDER BY source))) AS categories FROM (SELECT source, count(*) AS raw, count(*) FILTER (clean <> '') AS retained, count(*) FILTER (clean = '') AS excluded FROM cl GROUP BY source)")
def privacy_category_map(spark, sf_dir):
    """One map of a category's name to its counts."""
    docs, categories = corpus.read_documents(spark, f"{sf_dir}/documents.parquet", "source")
    return corpus.category_map(corpus.category_report(spread(docs), categories)).select(F.to_json("categories").alias("categories"))


@query()
def stop_word_ablation_all(spark, sf_dir):
    """All held-out documents of all seeds."""
    from .experiments import stop_word_ablation as ablation

    return ablation(labelled(spark, sf_dir), None, K)


# Classification metrics over stand-in predictions: the label, or for a tenth of ids another one

_GUESS = "pd AS (SELECT doc_id, text, lang AS label, CASE WHEN substr(md5('p' || doc_id), 1, 1) IN ('0', '1', '2') THEN 'en' WHEN substr(md5('p' || doc_id), 1, 1) = '3' THEN 'fr' ELSE lang END AS prediction FROM documents)"


def _stand_in(spark, sf_dir):
    c = F.substring(F.md5(F.concat(F.lit("p"), F.col("doc_id").cast("string"))), 1, 1)
    return labelled(spark, sf_dir).withColumn("prediction", F.when(c.isin("0", "1", "2"), "en").when(c == "3", "fr").otherwise(F.col("label")))


_PC = f"""{_GUESS}, ls AS (SELECT label FROM pd UNION SELECT prediction FROM pd),
pc AS (SELECT ls.label, count(*) FILTER (pd.label = ls.label AND pd.prediction = ls.label) AS tp, count(*) FILTER (pd.prediction = ls.label) AS guessed, count(*) FILTER (pd.label = ls.label) AS support FROM ls, pd GROUP BY ls.label)"""


@query(f"WITH {_PC} SELECT label, round(CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(CASE WHEN guessed + support > 0 THEN 2 * tp / (guessed + support) ELSE 0 END, 6) AS f1, support FROM pc")
def per_class_metrics(spark, sf_dir):
    return M.per_class(_stand_in(spark, sf_dir)).select("label", *_six("precision", "recall", "f1"), "support")


@query(f"WITH {_PC} SELECT (SELECT count(*) FROM pd) AS n, (SELECT round(avg(CAST(label = prediction AS INTEGER)), 6) FROM pd) AS accuracy, (SELECT count(*) FROM pd WHERE label <> prediction) AS misclassified, round(avg(CASE WHEN guessed + support > 0 THEN 2 * tp / (guessed + support) ELSE 0 END), 6) AS macro_f1 FROM pc")
def accuracy_macro_f1(spark, sf_dir):
    p = _stand_in(spark, sf_dir)
    return M.accuracy(p).crossJoin(M.macro_f1(p)).select("n", *_six("accuracy"), "misclassified", *_six("macro_f1"))


@query(f"WITH {_GUESS}, ll AS (SELECT DISTINCT lang AS label FROM documents) SELECT a.label AS actual, b.label AS predicted, (SELECT count(*) FROM pd WHERE pd.label = a.label AND pd.prediction = b.label) AS n FROM ll a, ll b")
def confusion_matrix(spark, sf_dir):
    p = _stand_in(spark, sf_dir)
    return M.confusion(p, p.select("label").distinct())


@query(f"WITH {_CLEAN}, {_GUESS} SELECT pd.doc_id, pd.label AS actual, pd.prediction AS predicted, CASE WHEN length(clean) <= 240 THEN clean WHEN substr(clean, 241, 1) = ' ' THEN substr(clean, 1, 240) ELSE regexp_replace(substr(clean, 1, 240), ' [^ ]*$', '') END AS text_snippet FROM pd JOIN cl ON pd.doc_id = cl.doc_id WHERE pd.label <> pd.prediction ORDER BY pd.doc_id LIMIT 20")
def misclassifications(spark, sf_dir):
    p = _stand_in(spark, sf_dir)
    names = p.select("label", F.col("label").alias("name")).distinct()
    return C.misclassified(p.drop("text"), docs_of(spark, sf_dir), names)


@query("SELECT round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, count(*) AS samples FROM (SELECT abs(value) / 1000 * 1000 AS ms FROM events)")
def latency_stats(spark, sf_dir):
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.abs("value") / 1000).alias("seconds"))
    return M.latency(samples).select(*_six("mean_ms", "p50_ms", "p95_ms"), "samples")


@query("SELECT event_type AS name, CAST(5 AS INTEGER) AS stop_word_count, count(*) AS runs, round(avg(value), 6) AS value_mean, round(coalesce(stddev_samp(value), 0), 6) AS value_std FROM events GROUP BY event_type")
def ablation_summary(spark, sf_dir):
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name"), "value", F.lit(5).alias("stop_word_count"))
    return M.summarize_runs(runs, ["value"]).select("name", "stop_word_count", "runs", *_six("value_mean", "value_std"))


@query()
def svm_accuracy(spark, sf_dir):
    """Held-out accuracy of the trained linear SVM on lang; a fitted model, so rows only."""
    docs, _ = corpus.read_documents(spark, f"{sf_dir}/documents.parquet", "lang")
    d = S.stratified_split(docs)
    out = C.classify(d.filter("NOT is_test").drop("is_test"), d.filter("is_test").drop("is_test"))
    return M.accuracy(out).crossJoin(M.macro_f1(out))

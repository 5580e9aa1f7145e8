"""The stored index: postings sorted by term, vocabulary and documents as Parquet, under a checked manifest."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SNIPPET_LIMIT, is_safe, safe_snippet
from ..operators.retrieve import MOST_QUERY_TERMS, check_topk, few_terms, query_weights, scan_top_k, scores_inverted, top_k
from ..operators.vectorize import TF_MODES, Space, numbered, tokenized

VERSION = 3
POLICY = "sanitized-snippets-only"
TABLES = ("postings", "vocab", "docs")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on whatever file system the path names."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(f"no index at {path}; build it first")
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def file_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every file under a folder, by its path there; each file is read in a stream by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("h")).collect()
    return {r.path.partition(path.partition(":")[2].lstrip("/"))[2].lstrip("/"): r.h for r in rows}


def table_digest(df: DataFrame) -> str:
    """Of all rows in any order: their number and the sums of two 64-bit hashes of each."""
    parts = [F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return hashlib.sha256(repr([str(x) for x in df.agg(F.count("*"), *parts).first()]).encode()).hexdigest()


def manifest_digest(manifest: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in manifest.items() if k != "digest"}, sort_keys=True).encode()).hexdigest()


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own in spark.checkpoint.dir; a local session without one gets a folder that goes when it ends."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lexispark-index-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        place = f"file://{own}"
    return f"{place.rstrip('/')}/lexispark-{what}-{uuid.uuid4().hex}"


def save(space: Space, docs: DataFrame, categories: DataFrame, path: str, fingerprint: str, allow_empty_snippets: bool = False) -> dict:
    """Writes the three tables and then the manifest, without which nothing is read.

    Documents keep a safe snippet and their label, never their text.  A document without words has no snippet to show,
    which is an error unless allowed.
    """
    spark = docs.sparkSession
    space.require_terms()
    shown = safe_snippet(docs, allow_empty=allow_empty_snippets).select("doc_id", "label", "snippet").join(space.lengths, "doc_id").join(F.broadcast(categories), "label")
    shown.select("doc_id", "label", "name", "length", "snippet").write.mode("overwrite").parquet(f"{path}/docs")
    numbered(space.vocab).write.mode("overwrite").parquet(f"{path}/vocab")
    postings = space.postings().select("term", "doc_id", "count", *[f"w_{m}" for m in TF_MODES], "w_bm25")
    # Sorted by term, so that min and max in the files let a search skip what holds none of its terms.
    postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    manifest = {
        "version": VERSION, "policy": POLICY, "n_docs": space.n_docs, "average_length": space.average, "n_terms": stored["vocab"].count(), "nnz": stored["postings"].count(),
        "k1": space.k1, "b": space.b, "stop_words": sorted(space.stop_words), "fingerprint": fingerprint, "digests": {t: table_digest(df) for t, df in stored.items()},
    }
    manifest["digest"] = manifest_digest(manifest)
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


@dataclass
class Index:
    """A restored index; nothing is fitted again."""

    spark: SparkSession
    manifest: dict
    postings: DataFrame
    vocab: DataFrame
    docs: DataFrame

    @property
    def n_docs(self) -> int:
        return self.manifest["n_docs"]

    @property
    def stop_words(self) -> tuple:
        return tuple(self.manifest["stop_words"])

    def persist(self) -> Index:
        """Keeps the postings for repeated searches."""
        self.postings = self.postings.persist()
        return self

    def tokens(self, query: str) -> DataFrame:
        rows = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        return tokenized(rows, self.stop_words, "query_id")

    def search(self, query: str, topk: int = 5, method: str = "tfidf", mode: str = "raw", strategy: str = "inverted") -> DataFrame:
        """(rank, score, doc_id, label, text_snippet), at most ``topk`` rows of positive score.

        Errors in this order: topk, method, mode or strategy, blank query, no known term.
        """
        check_topk(topk, self.n_docs)
        if method not in ("tfidf", "bm25") or mode not in TF_MODES or strategy not in ("scan", "inverted"):
            raise ValueError("unknown search method, TF mode or strategy")
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must not be blank")
        weights = query_weights(self, self.tokens(query), method, mode)
        known = [(r.query_id, r.term, r.weight) for r in weights.collect()]
        if not known:
            raise ValueError("query has no terms in the fitted vocabulary")
        column = "w_bm25" if method == "bm25" else f"w_{mode}"
        weights = self.spark.createDataFrame(known, "query_id long, term string, weight double")
        if strategy == "scan":
            best = scan_top_k(self.postings, weights, column, topk)
        else:
            best = top_k(scores_inverted(self.postings.filter(F.col("term").isin([k[1] for k in known])), weights, column, len(known) <= MOST_QUERY_TERMS), topk)
        return best.join(self.docs, "doc_id").select("rank", "score", "doc_id", F.col("name").alias("label"), F.col("snippet").alias("text_snippet")).orderBy("rank")


def search_batch(index: Index, queries: DataFrame, k: int, method: str = "tfidf", mode: str = "raw", strategy: str = "inverted") -> DataFrame:
    """(query_id, tokens) -> (query_id, rank, doc_id, score), the top k each, from the stored weights; nothing is fitted."""
    weights, column = query_weights(index, queries, method, mode), "w_bm25" if method == "bm25" else f"w_{mode}"
    if strategy == "scan":
        return scan_top_k(index.postings, weights, column, k)
    return top_k(scores_inverted(index.postings, weights, column, few_terms(queries)), k)


def load(spark: SparkSession, path: str, verify: bool = False) -> Index:
    """The manifest is checked first: version, policy, its own digest; then the tables' rows against it, from their footers.

    With ``verify`` the digests of all rows, the BM25 IDF and the snippets are checked too, which reads the whole index.
    """
    manifest = json.loads(read_text(spark, f"{path}/manifest.json"))
    if manifest.get("version") != VERSION or manifest.get("policy") != POLICY:
        raise ValueError("index artifact has another version or policy; rebuild it")
    if manifest_digest(manifest) != manifest.get("digest"):
        raise ValueError("index artifact manifest fails its checksum; rebuild it")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in TABLES}
    for t, key in (("postings", "nnz"), ("vocab", "n_terms"), ("docs", "n_docs")):
        if tables[t].count() != manifest[key]:
            raise ValueError(f"index artifact {t} fails its checksum; rebuild it")
    if verify:
        for t, df in tables.items():
            if table_digest(df) != manifest["digests"][t]:
                raise ValueError(f"index artifact {t} fails its checksum; rebuild it")
        n = manifest["n_docs"]
        again = F.ln(1.0 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        if tables["vocab"].filter(F.abs(again - F.col("bm25_idf")) > 1e-12).take(1):
            raise ValueError("index artifact BM25 idf does not fit its counts; rebuild it")
        if tables["docs"].filter(~is_safe(F.col("snippet")) | (F.length("snippet") > SNIPPET_LIMIT)).take(1):
            raise ValueError("index artifact snippets are unsafe; rebuild it")
    return Index(spark, manifest, tables["postings"], tables["vocab"], tables["docs"])


def load_for_corpus(spark: SparkSession, path: str, fingerprint: str) -> Index:
    index = load(spark, path, verify=True)
    if index.manifest["fingerprint"] != fingerprint:
        raise ValueError("index artifact was built from another corpus; rebuild it")
    return index

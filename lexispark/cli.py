"""Commands: build, benchmark, search (also without its name), compare, demo, interactive.

Exit codes: 0, 1 for a failed validation, 2 for a user's error, 130 for an interrupt.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import functions as F

from . import report
from .engine import BuildConfig, benchmark, build, index_path
from .functions.text import collapsed_snippet
from .operators import retrieve as R
from .operators.vectorize import TF_MODES
from .plans.experiments import timed
from .session import get_session
from .sources import store


def _parser(command: str) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog=f"lexispark {command}")
    p.add_argument("--artifacts", default="artifacts/runtime")
    p.add_argument("--reports", default="artifacts/reports")
    if command in ("build", "benchmark", "interactive"):
        p.add_argument("--data", required=command != "interactive", help="documents as Parquet: doc_id, text and a label column")
        p.add_argument("--label", default="lang")
        p.add_argument("--epochs", type=int, default=10)
        p.add_argument("--batch-size", type=int, help="rows that go to Python at a time while fitting and predicting")
        p.add_argument("--minimum-documents", type=int, default=500)
    if command == "benchmark":
        p.add_argument("--queries", type=int, default=100)
        p.add_argument("--repeats", type=int, default=5)
        p.add_argument("--seeds", type=int, default=1)
    if command not in ("build", "benchmark"):
        p.add_argument("--verify", action="store_true", help="check every row of the stored index against its digests first")
    if command in ("search", "compare"):
        p.add_argument("--query", required=True)
        p.add_argument("--topk", type=int, default=5)
    if command == "search":
        p.add_argument("--method", choices=("tfidf", "bm25"), default="tfidf")
        p.add_argument("--tf-mode", choices=TF_MODES, default="raw")
        p.add_argument("--strategy", choices=R.STRATEGIES, default="inverted")
    return p


def _config(o: argparse.Namespace) -> BuildConfig:
    return BuildConfig(o.data, o.label, o.artifacts, o.reports, o.epochs, minimum_documents=o.minimum_documents, batch_size=o.batch_size)


def show(df) -> None:
    print(report.terminal_table(report.rows_of(df)))


def compare(index: store.Index, query: str, topk: int) -> bool:
    """TF modes by rank, TF-IDF against BM25, and both strategies; whether the strategies agree."""
    zero = lambda df: df.selectExpr("0 AS query_id", "rank", "doc_id", "score")
    raw = zero(index.search(query, topk))
    for mode in TF_MODES:
        best = index.search(query, topk, mode=mode)
        print(f"\nTF mode {mode}")
        show(best)
        if mode != "raw":
            show(R.rank_shift(raw, zero(best)))
    print("\nBM25")
    bm25 = index.search(query, topk, "bm25")
    show(bm25)
    show(R.overlap(raw, zero(bm25)))
    show(R.compared(raw, zero(bm25), index.docs))
    scan = zero(index.search(query, topk, strategy="scan"))
    agreed = report.rows_of(R.consistency(scan, raw))[0]
    print("\nscan and inverted:", agreed)
    return bool(agreed["consistent"])


def demo(index: store.Index, reports: Path) -> bool:
    """Six stages: corpus, document, search, TF modes with BM25 and strategies, speed, saved experiments; whether all that can fail has passed."""
    saved = report.load_benchmark(reports, index.manifest["fingerprint"], index.manifest["digest"], required=True)
    stage = lambda n, what: print(f"\n[{n}/6] {what}")
    stage(1, "corpus and index")
    print(f"documents {index.n_docs}, terms {index.manifest['n_terms']}, postings {index.manifest['nnz']}")
    sanitized = reports / "sanitization.json"
    if sanitized.exists():
        print(sanitized.read_text(encoding="utf-8")[:2000])
    stage(2, "a document, sanitized")
    show(index.docs.orderBy("doc_id").limit(1))
    word = index.vocab.orderBy(F.col("df").desc(), "term").first().term
    k = min(5, index.n_docs)
    stage(3, f"search for {word!r}")
    show(index.search(word, k))
    stage(4, "TF modes, BM25 and strategies")
    agreed = compare(index, word, k)
    stage(5, "speed")
    for s in R.STRATEGIES:
        print(s, [f"{1000 * x:.1f} ms" for x in timed(lambda s=s: index.search(word, k, strategy=s).collect(), 3)])
    stage(6, "saved experiments")
    for part in report.PARTS:
        print(f"\n{part}\n{report.terminal_table(saved[part])}")
    checked = reports / "validation.json"
    valid = not checked.exists() or bool(json.loads(checked.read_text(encoding="utf-8")).get("passed"))
    print("\nstrategies agree:", agreed, " weights are valid:", valid)
    return agreed and valid


MENU = "1 search  2 TF modes, BM25 and strategies  3 speed  4 document  5 benchmark  6 index  0 quit"


def interactive(index: store.Index, o: argparse.Namespace) -> int:
    """A bad entry is reported and asked again; the end of input leaves."""
    while True:
        print(MENU)
        try:
            choice = input("> ").strip()
            if choice == "0":
                return 0
            if choice in ("1", "2", "3"):
                query = input("query: ")
            if choice == "1":
                show(index.search(query, min(5, index.n_docs)))
            elif choice == "2":
                compare(index, query, min(5, index.n_docs))
            elif choice == "3":
                for s in R.STRATEGIES:
                    print(s, [f"{1000 * x:.1f} ms" for x in timed(lambda s=s: index.search(query, min(5, index.n_docs), strategy=s).collect(), 3)])
            elif choice == "4":
                wanted = int(input("doc_id: "))
                source = index.spark.read.parquet(o.data).select("doc_id", collapsed_snippet("text").alias("text")) if o.data else index.docs
                rows = source.filter(f"doc_id = {wanted}").limit(1).collect()
                print(rows[0].asDict() if rows else "no such document")
            elif choice == "5":
                saved = report.load_benchmark(Path(o.reports), index.manifest["fingerprint"], index.manifest["digest"], required=False)
                print(report.terminal_table(saved["quality"]) if saved else "no benchmark yet")
            elif choice == "6":
                print({k: v for k, v in index.manifest.items() if k not in ("stop_words", "digests")})
            else:
                print("unknown choice")
        except EOFError:
            return 0
        except ValueError as e:
            print(f"error: {e}")


def run(argv: Sequence[str]) -> int:
    names = ("build", "benchmark", "search", "compare", "demo", "interactive")
    command, rest = (argv[0], argv[1:]) if argv and argv[0] in names else ("search", argv)
    o = _parser(command).parse_args(rest)
    spark = get_session(f"lexispark {command}")
    spark.sparkContext.setLogLevel("ERROR")
    if command == "build":
        made = build(spark, _config(o))
        print(f"build complete: {made}")
        return 0 if made.consistent else 1
    index = store.load(spark, index_path(o.artifacts), verify=getattr(o, "verify", True))
    if command == "benchmark":
        benchmark(spark, _config(o), o.queries, o.repeats, o.seeds)
        print(f"benchmark complete: {o.reports}")
        return 0
    if command == "search":
        show(index.search(o.query, o.topk, o.method, o.tf_mode, o.strategy))
        return 0
    if command == "compare":
        return 0 if compare(index, o.query, o.topk) else 1
    if command == "demo":
        return 0 if demo(index, Path(o.reports)) else 1
    return interactive(index.persist(), o)


def main(argv: Sequence[str] | None = None) -> int:
    try:
        return run(list(sys.argv[1:] if argv is None else argv))
    except KeyboardInterrupt:
        print("\nCancelled by user.", file=sys.stderr)
        return 130
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def script() -> None:
    """The console script."""
    sys.exit(main())

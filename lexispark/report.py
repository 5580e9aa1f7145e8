"""Reports as small JSON, CSV and Markdown files, and terminal tables.  They hold metrics and safe snippets, never texts."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame

SCHEMA_VERSION = 1
MOST_ROWS = 10_000


def rows_of(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """The rows of a small result; a larger one is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def write_json(path: Path, value: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")


def write_csv(path: Path, rows: list[dict]) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, fieldnames=list(rows[0]) if rows else [])
        writer.writeheader()
        writer.writerows(rows)


def markdown_table(rows: list[dict]) -> str:
    if not rows:
        return "_no rows_\n"
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    head = list(rows[0])
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(show(r[c]) for c in head) + " |" for r in rows)]) + "\n"


def summary(sections: dict[str, list[dict]], title: str = "Experiments") -> str:
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(rows)}" for name, rows in sections.items())


#: Sections of a benchmark that are tables, and fields that their rows must have.
PARTS = {"quality": ("method", "queries", "precision_at_k", "map_at_k"), "latency": ("documents", "strategy", "mean_ms", "p50_ms", "p95_ms", "samples"), "ablation": ("name", "stop_word_count", "runs", "precision_at_k_mean", "map_at_k_mean")}


def benchmark_summary(result: dict, manifest: dict) -> str:
    """What was measured, on what, and how it compares, in Markdown."""
    d, settings = result["difference"], result["settings"]
    best = max(result["quality"], key=lambda r: (r["map_at_k"], r["method"]))
    head = f"""# Experiments

Corpus of {manifest["n_docs"]} documents and {manifest["n_terms"]} terms, {manifest["nnz"]} postings; fingerprint `{result["fingerprint"][:16]}`, index `{result["index_digest"][:16]}`.
{best["queries"]} held-out queries, {settings["repeats"]} timed repeats, {settings["seeds"]} seeds; labels count as relevance.

Best by MAP: {best["method"]} ({best["map_at_k"]:.6f}). By average precision BM25 wins {d["second_wins"]}, TF-IDF {d["first_wins"]}, {d["ties"]} are ties.
"""
    titles = {"quality": "Retrieval and classification by weighting", "latency": "Scan against inverted search by corpus size", "ablation": "Stop words on and off"}
    parts = [f"## {title}\n\n{markdown_table(result[part])}" for part, title in titles.items()]
    cases = f"## First queries whose average precision differs\n\n{markdown_table(result['cases'])}"
    shown = [f"### {q}\n\n" + (markdown_table(c["ranks"]) if "ranks" in c else f"not measured: {c['not_measured']}\n") for q, c in result["comparisons"].items()]
    return "\n".join([head, *parts, cases, "## Searches by TF-IDF and BM25\n", *shown])


def terminal_table(rows: list[dict], width: int = 60) -> str:
    """Columns as wide as their contents, long values cut with an ellipsis."""
    cut = lambda v: (s := f"{v:.6f}" if isinstance(v, float) else str(v))[: width - 1] + "…" if len(str(v)) > width else (f"{v:.6f}" if isinstance(v, float) else str(v))
    if not rows:
        return "(no rows)"
    head = list(rows[0])
    cells = [head, *([cut(r[c]) for c in head] for r in rows)]
    wide = [max(len(x[i]) for x in cells) for i in range(len(head))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, wide, strict=True)).rstrip() for line in cells)


def load_benchmark(reports: Path, fingerprint: str, digest: str, required: bool) -> dict | None:
    """The saved benchmark if it fits the index; none, or an error if it is required, where there is no such file."""
    path = Path(reports) / "retrieval_benchmark.json"
    if not path.exists():
        if required:
            raise FileNotFoundError(f"Benchmark report is not available at {path}; run benchmark first")
        return None
    try:
        report = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as e:
        raise ValueError("Benchmark report is malformed; run benchmark again") from e
    if not isinstance(report, dict) or report.get("schema_version") != SCHEMA_VERSION:
        raise ValueError("Benchmark report has another version; run benchmark again")
    if report.get("fingerprint") != fingerprint or report.get("index_digest") != digest:
        raise ValueError("Benchmark report belongs to another corpus or index; run benchmark again")
    for part in (*PARTS, "comparisons"):
        if part not in report:
            raise ValueError(f"Benchmark report lacks {part}; run benchmark again")
    if not isinstance(report["comparisons"], dict):
        raise ValueError("Benchmark report lacks comparisons; run benchmark again")
    for part, fields in PARTS.items():
        rows = report[part]
        if not isinstance(rows, list) or not rows or not all(isinstance(r, dict) for r in rows):
            raise ValueError(f"Benchmark report lacks rows of {part}; run benchmark again")
        lost = sorted({f for r in rows for f in fields if f not in r})
        if lost:
            raise ValueError(f"Benchmark report lacks {', '.join(lost)} of {part}; run benchmark again")
    return report


def save_bars(rows: list[dict], name: str, measures: list[str], path: Path) -> bool:
    """Bars of each measure side by side, if matplotlib is there."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    figure, axes = pyplot.subplots(figsize=(8, 4))
    for i, measure in enumerate(measures):
        axes.bar([k + 0.8 * i / len(measures) for k in range(len(rows))], [r[measure] or 0 for r in rows], 0.8 / len(measures), label=measure)
    axes.set(xticks=range(len(rows)), xticklabels=[str(r[name]) for r in rows])
    axes.legend()
    path.parent.mkdir(parents=True, exist_ok=True)
    figure.tight_layout()
    figure.savefig(path)
    pyplot.close(figure)
    return True


def save_confusion_matrix(rows: list[dict], path: Path) -> bool:
    """A heat map of (actual, predicted, n), if matplotlib is there."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    labels = sorted({r["actual"] for r in rows})
    grid = [[next((r["n"] for r in rows if r["actual"] == a and r["predicted"] == p), 0) for p in labels] for a in labels]
    figure, axes = pyplot.subplots(figsize=(8, 7))
    image = axes.imshow(grid, cmap="Blues")
    figure.colorbar(image)
    axes.set(xticks=range(len(labels)), yticks=range(len(labels)), xticklabels=labels, yticklabels=labels, xlabel="predicted", ylabel="actual")
    path.parent.mkdir(parents=True, exist_ok=True)
    figure.tight_layout()
    figure.savefig(path)
    pyplot.close(figure)
    return True

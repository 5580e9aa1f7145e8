import json

import pytest

from lexispark import cli, report
from lexispark.sources import store
from lexispark.streaming import incremental


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("built")
    rows = [(3 * i, ("river bridge stone" if i % 2 else "violin concert choir") + f" page{'klmnopqrst'[i % 10]} from m@n.io", "land" if i % 2 else "music") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(top / "docs"))
    code = cli.main(["build", "--data", str(top / "docs"), "--artifacts", str(top / "index"), "--reports", str(top / "reports"), "--minimum-documents", "20", "--epochs", "3"])
    assert code == 0
    return top


def test_build_writes_reports_and_index(spark, built):
    made = {p.name for p in (built / "reports").iterdir()}
    assert {"sanitization.json", "classification.json", "classification_errors.json", "validation.json", "index.json", "search_examples.json"} <= made
    assert json.loads((built / "reports/sanitization.json").read_text())["n_email"] == 30
    assert store.load(spark, f"file://{built}/index").n_docs == 30


def test_search_commands(built, capsys):
    common = ["--artifacts", str(built / "index")]
    assert cli.main([*common, "--query", "bridge", "--topk", "3"]) == 0
    assert "land" in capsys.readouterr().out
    assert cli.main(["search", *common, "--query", "bridge", "--method", "bm25", "--topk", "2"]) == 0
    assert cli.main(["compare", *common, "--query", "bridge", "--topk", "3"]) == 0
    assert cli.main([*common, "--query", " "]) == 2
    assert cli.main([*common, "--query", "unheard"]) == 2
    assert cli.main(["--artifacts", str(built / "none"), "--query", "bridge"]) == 2


def test_menu_recovers(built, monkeypatch, capsys):
    entries = iter(["9", "1", "unheard", "4", "x", "4", "3", "5", "6"])

    def answer(_=""):
        try:
            return next(entries)
        except StopIteration:
            raise EOFError from None

    monkeypatch.setattr("builtins.input", answer)
    assert cli.main(["interactive", "--artifacts", str(built / "index")]) == 0
    out = capsys.readouterr().out
    assert "unknown choice" in out and "no terms" in out and "no benchmark yet" in out


def test_benchmark_and_demo(spark, built, capsys, monkeypatch):
    # The SVM is fitted by the build above and by test_classified_variants; eight more would only take time.
    monkeypatch.setattr("lexispark.operators.classify.classify", lambda train, test, *a, **k: test.selectExpr("doc_id", "label", "label AS prediction"))
    common = ["--artifacts", str(built / "index"), "--reports", str(built / "reports")]
    assert cli.main(["benchmark", "--data", str(built / "docs"), *common, "--queries", "4", "--repeats", "1", "--epochs", "2", "--batch-size", "500"]) == 0
    made = {p.name for p in (built / "reports").iterdir()}
    assert {"retrieval_benchmark.json", "quality.csv", "latency.csv", "ablation.csv", "per_class_raw.csv", "per_class_log.csv", "per_class_double.csv", "experiment_summary.md"} <= made
    quality = json.loads((built / "reports/retrieval_benchmark.json").read_text())["quality"]
    assert {r["method"] for r in quality} == {"raw", "log", "double", "bm25"} and all(r["accuracy"] is not None for r in quality if r["method"] != "bm25")
    assert cli.main(["demo", *common]) == 0
    out = capsys.readouterr().out
    assert all(f"[{n}/6]" in out for n in range(1, 7)) and "strategies agree: True" in out
    assert cli.main(["build", "--data", str(built / "docs"), *common, "--batch-size", "0"]) == 2
    assert cli.main(["search", *common, "--query", "bridge", "--verify"]) == 0


def test_interrupt(monkeypatch):
    monkeypatch.setattr(cli, "run", lambda _: (_ for _ in ()).throw(KeyboardInterrupt))
    assert cli.main([]) == 130


def test_benchmark_reports_are_checked(tmp_path):
    with pytest.raises(FileNotFoundError):
        report.load_benchmark(tmp_path, "f", "d", required=True)
    assert report.load_benchmark(tmp_path, "f", "d", required=False) is None
    path = tmp_path / "retrieval_benchmark.json"
    for text, error in (("{", "malformed"), ('{"schema_version": 0}', "version"), ('{"schema_version": 1, "fingerprint": "x"}', "another corpus"), ('{"schema_version": 1, "fingerprint": "f", "index_digest": "d"}', "lacks"), ('{"schema_version": 1, "fingerprint": "f", "index_digest": "d", "comparisons": {}, "latency": [], "ablation": [], "quality": [{"method": "raw"}]}', "lacks map_at_k")):
        path.write_text(text)
        with pytest.raises(ValueError, match=error):
            report.load_benchmark(tmp_path, "f", "d", required=True)


def test_stream_scores_equal_the_index(spark, built, tmp_path):
    index = store.load(spark, f"file://{built}/index")
    spark.createDataFrame([(1, "bridge bridge from m@n.io"), (2, "nothing known")], incremental.SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = incremental.scored(incremental.read_stream(spark, str(tmp_path / "in")), index, "bridge")
    run = stream.writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = spark.table("scored").collect()
    assert [(r.doc_id, r.clean) for r in rows] == [(1, "bridge bridge from")] and rows[0].score > 0

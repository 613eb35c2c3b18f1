"""Readers, writers, registry and streams."""

import json

import pytest

from docaudit.operators import findings, profile, scorers
from docaudit.plans import flows
from docaudit.sources import readers, sinks
from docaudit.streaming import live


def test_reports_last_file_wins(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body if isinstance(body, str) else json.dumps(body, indent=1))

    put("verification_a.json", {"paper_id": "a", "verdict": "OLD"})
    put("verification_b_report.json", {"paper_id": "a", "verdict": "NEW", "predicted_errors": [{"error_category": "x", "confidence": 0.5}]})
    put("c_report.json", {"paper_id": "c", "verdict": "OK"})
    put("metrics.json", {"paper_id": "z"})
    put("batch_results.json", {"paper_id": "z"})
    put("notes.json", {"paper_id": "n"})
    put("broken_report.json", "{oops")
    got = {r.paper_id: r.verdict for r in readers.scan_reports(spark, str(tmp_path)).collect()}
    assert got == {"a": "NEW", "c": "OK"}


def test_report_from_text_else_saved(spark):
    own = 'x\n```json\n{"paper_id": "a", "verdict": "BAD", "predicted_errors": [{"error_category": "x", "confidence": 0.5}]}\n```'
    outputs = spark.createDataFrame([("a", own), ("b", "nothing"), ("c", "nothing"), ("d", "nothing")], "paper_id string, output string")
    finding = "struct<error_category: string, error_location: string, confidence: double, supporting_evidence: string, verifier_name: string, snippet_id: string>"
    saved = spark.createDataFrame([("b", "SAVED", [("y", "Lemma 1", 0.9, "", "text", "s")]), ("c", "EMPTY", [])], f"paper_id string, verdict string, predicted_errors array<{finding}>")
    got = {r.paper_id: (r.success, r.verdict, len(r.predicted_errors)) for r in findings.reports(outputs, saved).collect()}
    assert got == {"a": (True, "BAD", 1), "b": (True, "SAVED", 1), "c": (False, "UNKNOWN", 0), "d": (False, "UNKNOWN", 0)}
    assert {r.verdict for r in findings.reports(outputs).collect()} == {"BAD", "UNKNOWN"}


def test_predictions_round_trip(spark, tmp_path):
    rows = [{"paper_id": "p", "title": "t", "predicted_errors": [{"error_category": "x", "error_location": "Lemma 1", "confidence": 0.9}], "total_snippets": 3, "verifier_usage": {"text": 3}}]
    (tmp_path / "predictions.json").write_text(json.dumps(rows))
    df = readers.scan_predictions(spark, str(tmp_path / "predictions.json"))
    r = df.first()
    assert r.predicted_errors[0].error_location == "Lemma 1" and r.verifier_usage == {"text": 3}
    sinks.write_predictions(df, str(tmp_path / "out"), "r1")
    assert readers.scan_predictions(spark, str(tmp_path / "out" / "run=r1"), lines=True).first().paper_id == "p"


def test_cases_and_sinks(spark, tmp_path):
    cases = spark.createDataFrame(
        [("1", "g", "prob", ["a", "b"], True, -1, "math"), ("2", "g", "prob", ["a"], False, 0, "gsm8k")],
        "id string, generator string, problem string, steps array<string>, final_answer_correct boolean, label int, split string",
    )
    path = str(tmp_path / "cases")
    cases.write.parquet(path)
    assert [r.id for r in readers.scan_cases(spark, path, "math").collect()] == ["1"]
    with pytest.raises(ValueError):
        readers.scan_cases(spark, path, "nope")
    steps = spark.createDataFrame([("2", 0, True, True)], "paper_id string, step_index int, checkable boolean, is_error boolean")
    results = flows.step_case_results(cases, steps)
    assert {r.paper_id: (r.true_label, r.predicted_label) for r in results.collect()} == {"1": (-1, -1), "2": (0, 0)}
    sinks.write_step_results(results, results.groupBy().count(), str(tmp_path / "steps"), "math")
    sinks.write_metrics(results, str(tmp_path / "metrics"))
    sinks.write_confusion(results, str(tmp_path / "cm"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cm")).count() == 2
    image = spark.createDataFrame([("p", 0, "c", "QUJD")], "paper_id string, image_idx int, caption string, base64_data string")
    sinks.write_images(image, str(tmp_path / "img"))
    assert bytes(spark.read.parquet(str(tmp_path / "img")).first().image) == b"ABC"


def test_lookup_pushes_down(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = profile.get_paper(docs, "17", key="doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and found.count() == 1
    assert profile.get_paper(docs, "no such id", key="doc_id").count() == 0
    assert [r.doc_id for r in profile.list_papers(docs, "doc_id", "text", [], 2, after=9).collect()] == [10, 11]


def test_registry(spark):
    r = scorers.ScorerRegistry()
    r.register("a", scorers.text_rule)
    r.register("a", scorers.text_rule)
    with pytest.raises(ValueError):
        r.register("a", scorers.visual_rule)
    with pytest.raises(KeyError):
        r.get("b")
    assert r.has("a") and r.names() == ["a"]
    s = spark.createDataFrame(
        [("x", "citation", "Our novel method; it was previously established by Smith et al."), ("y", "citation", "We build on standard techniques."), ("z", "nobody", "t")],
        "snippet_id string, verifier_name string, content string",
    )
    got = {x.snippet_id: (x.status, x.error_detected) for x in scorers.default_registry().apply(s).collect()}
    assert got == {"x": ("ERROR_DETECTED", True), "y": ("NO_ERROR", False), "z": ("SKIPPED", False)}


def test_chunk_findings(spark):
    c = spark.createDataFrame(
        [("s", 0, False, False, 0.99, "fine", None), ("s", 1, False, True, 0.7, "bad", "x"), ("s", 2, True, False, 0.0, "", None), ("t", 0, True, False, 0.0, "", None), ("u", 0, False, False, 0.5, "one", None)],
        "id string, chunk_idx int, failed boolean, error_detected boolean, confidence double, reasoning string, predicted_error_category string",
    )
    got = {r.id: (r.status, r.reasoning, r.n_failed) for r in scorers.best_chunk_finding(c, ["id"]).collect()}
    assert got == {"s": ("ERROR_DETECTED", "[chunk 2/3] bad", 1), "t": ("UNVERIFIABLE", None, 1), "u": ("NO_ERROR", "one", 0)}


def drain(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in df.sparkSession.sql(f"SELECT * FROM {name}").drop("session").collect()}


def test_live_rollup_and_symbols(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    base = {"verifier_name": "text", "error_detected": True, "confidence": 0.9, "symbol": "x", "domain": "real", "definition": None, "order_idx": 1}
    rows = [
        {**base, "paper_id": "p", "snippet_id": "s1", "ts": "2024-01-01T00:00:00Z"},
        {**base, "paper_id": "p", "snippet_id": "s1", "ts": "2024-01-01T00:01:00Z"},
        {**base, "paper_id": "p", "snippet_id": "s0", "domain": "unknown", "order_idx": 0, "confidence": 0.1, "ts": "2024-01-01T00:02:00Z"},
    ]
    late = [{**base, "paper_id": "z", "snippet_id": "s9", "ts": "2024-01-02T00:00:00Z"}]
    (folder / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    schema = "paper_id string, snippet_id string, ts timestamp, verifier_name string, error_detected boolean, confidence double, symbol string, domain string, definition string, order_idx int"
    (folder / "2.json").write_text("\n".join(json.dumps(r) for r in late))
    src = live.read_json_stream(spark, str(folder), schema, files_per_trigger=1)
    assert drain(live.live_rollup(src, "ts"), "roll") == {("p", "text", 2, 1, 0.9)}
    assert drain(live.live_symbols(src, "ts"), "syms") == {("p", "x", "real", None, "s0", 0)}


def test_report_table(spark):
    prof = spark.createDataFrame([("lang", "en", 3)], "dimension string, value string, n long")
    totals = spark.createDataFrame([(1, 2, 2, 1)], "papers long, total_snippets long, snippets_verified long, errors_detected long")
    usage = spark.createDataFrame([("text", 2)], "verifier_name string, n_snippets long")
    table = spark.createDataFrame([("overall", "all", 1, 0, 0, 1.0, 1.0, 1.0, 1.0, 1)], "dimension string, category string, tp long, fp long, fn long, precision double, recall double, f1 double, accuracy double, support long")
    assert flows.report(prof, totals, usage, table).groupBy("section").count().count() == 4
    out = flows.evaluate(
        spark.createDataFrame([("p", 0, "x", "Lemma 1")], "paper_id string, pred_idx long, error_category string, error_location string"),
        spark.createDataFrame([("p", 0, "x", "Lemma 1", "errata", "Math")], "paper_id string, ann_idx long, error_category string, error_location string, error_severity string, paper_category string"),
    )
    assert out["totals"].first().n_matched == 1 and out["worst"].count() == 2 and out["class_report"].count() == 0

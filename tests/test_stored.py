"""Stored results as Variants: totals, caps, and what raises."""

import json

import pytest

from quillspark.plans import catalogue, stored


def results(spark, *rows):
    return spark.createDataFrame([(i, a, None if r is None else r if isinstance(r, str) else json.dumps(r)) for i, a, r in rows], "file_id long, analyzer_id string, result_json string")


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_rollup_of_odd_results(spark):
    kept = [{"notation_id": "mermaid", "confidence": "high", "detected_via": "fence_label"}, {"notation_id": "new", "confidence": None}, {}]
    table = results(
        spark,
        (1, "notation", {"any_notation_detected": True, "notation_count_total": 9, "notations_summary": {"mermaid": {"count": 3, "confidences": ["high", "low"], "subtypes": ["pie"]}, "new": {"count": 1}}, "detections": kept}),
        (2, "notation", {}),
        (3, "notation", {"any_notation_detected": False, "notation_count_total": 0, "notations_summary": {}, "detections": [], "extra": [1, {"a": 2}]}),
        (4, "notation", {"any_notation_detected": True, "notation_count_total": "2", "notations_summary": {"json_schema": {"count": 2, "confidences": ["high"]}, "mermaid": {}}, "detections": None}),
        (5, "notation", None),
        (6, "structure", "no JSON"),
    )
    got = stored.notation_rollup(table)
    assert [tuple(r) for r in got["totals"].collect()] == [(4, 2, 1, 2, 8)]
    assert rows(got["notations"], "notation", "occurrences", "files", "kept", "omitted") == {("mermaid", 3, 2, 1, 2), ("new", 1, 1, 1, 0), ("json_schema", 2, 1, 0, 2)}
    assert rows(got["details"], "notation", "what", "value", "files") == {("mermaid", "confidence", "high", 1), ("mermaid", "confidence", "low", 1), ("mermaid", "subtype", "pie", 1), ("json_schema", "confidence", "high", 1)}
    assert rows(got["kept"], "what", "value", "records") == {("confidence", "high", 1), ("confidence", "?", 2), ("via", "fence_label", 1), ("via", "?", 2)}
    none = stored.notation_rollup(table.limit(0))
    assert [tuple(r) for r in none["totals"].collect()] == [(0, 0, 0, 0, 0)] and none["notations"].collect() == none["kept"].collect() == []


def test_lines_are_dealt_once_and_results_made_once(spark, sf_dir):
    for name in ("a29_totals", "a29_notations", "a29_details", "a29_kept"):
        plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(id#") == 1 and plan.count("StructsToJsonEvaluator") == 1


def test_results_of_lines(spark, tmp_path):
    lines = [(5, 1, 7, 1, "A", "O"), (5, 1, 14, 1, "N", "F"), (5, 4, 7, 5, "R", "O"), (5, 2, 10, 3, "A", "F"), (5, 9, 8, 3, "A", "F"), (6, 1, None, 6, "N", "F"), (8, 1, None, 7, "N", "F")]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"
    table = spark.createDataFrame([(o, p, s if o != 6 else 5, i, f, t) for o, p, s, i, f, t in lines], kinds)
    table.repartition(4).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.file_id: json.loads(r.result_json) for r in catalogue._stored_lines(spark, str(tmp_path)).collect()}
    assert set(got) == {5, 6} and got[5]["any_notation_detected"] and got[5]["notation_count_total"] == 5
    said = {n: (m["count"], sorted(m["confidences"]), sorted(m["subtypes"])) for n, m in got[5]["notations_summary"].items()}
    assert said == {"mermaid": (3, ["high", "low", "medium"], ["flow"]), "d2": (1, ["high"], ["state"]), "plantuml": (1, ["high"], ["flow"])}
    record = lambda i, n, s, c, v: {"i": i, "notation_id": n, "subtype": s, "confidence": c, "detected_via": v}
    assert got[5]["detections"] == [record(1, "mermaid", "flow", "high", "fence_label"), record(1, "mermaid", "flow", "medium", "pattern"), record(3, "d2", "state", "high", "pattern"), record(3, "plantuml", "flow", "high", "pattern")]
    assert got[6] == {"any_notation_detected": True, "notation_count_total": 1, "notations_summary": {"bnf_ebnf": {"count": 1, "confidences": ["medium"], "subtypes": ["flow"]}}, "detections": []}


def test_details_of_files_that_say_the_same(spark):
    said = lambda *m: {"notations_summary": dict(m)}
    same = ("mermaid", {"count": 1, "confidences": ["high", "low"], "subtypes": ["pie"]})
    table = results(spark, (1, "notation", said(same)), (2, "notation", said(same, ("d2", {"confidences": ["high"]}))), (3, "notation", said(("mermaid", {"confidences": ["low", "high"], "subtypes": "pie"}))), (4, "notation", said(("mermaid", {"confidences": [None, 2], "subtypes": []}), ("d2", 5))))
    want = {("mermaid", "confidence", "high", 3), ("mermaid", "confidence", "low", 3), ("mermaid", "subtype", "pie", 2), ("mermaid", "confidence", None, 1), ("mermaid", "confidence", "2", 1), ("d2", "confidence", "high", 1)}
    assert rows(stored.notation_rollup(table)["details"], "notation", "what", "value", "files") == want


def test_what_is_no_json_names_its_file(spark):
    with pytest.raises(Exception, match="file 7 has a result that is no JSON"):
        stored.notation_rollup(results(spark, (7, "notation", '{"a": ')))["totals"].collect()


def test_observations_and_panels(spark):
    fine = {"line_count": 2, "word_count": "4", "char_count": 7}
    files = spark.createDataFrame([(1, "a.md", 8), (2, "b.md", 8), (3, "c.md", 0)], "id long, path string, size_bytes long")
    table = results(spark, (1, "structure", fine), (2, "structure", fine | {"word_count": 5}), (3, "structure", {"line_count": 0, "word_count": 0, "char_count": 0}))
    seen = stored.observations(files, table)
    assert rows(seen, "file_id", "size_bytes", "line_count", "word_count", "char_count") == {(1, 8, 2, 4, 7), (2, 8, 2, 5, 7), (3, 0, 0, 0, 0)}
    third = 100 / 3
    want = {("bytes", 0, 1, third), ("bytes", 8, 2, 100.0), ("lines", 0, 1, third), ("lines", 2, 2, 100.0), ("words", 0, 1, third), ("words", 4, 1, 200 / 3), ("words", 5, 1, 100.0), ("tokens", 0, 1, third), ("tokens", 2, 2, 100.0)}
    got = rows(stored.size_panels(seen), "panel", "value", "files", "percent")
    assert {(p, v, n, round(x, 9)) for p, v, n, x in got} == {(p, v, n, round(x, 9)) for p, v, n, x in want}
    assert stored.size_panels(seen.limit(0)).collect() == []
    for wrong, said in (({"line_count": 1, "word_count": 1}, "file 1 lacks char_count"), (fine | {"line_count": None}, "file 1 lacks line_count"), (fine | {"line_count": "x"}, "file 1 lacks line_count"), (fine | {"word_count": -1}, "file 1 has a size below zero")):
        with pytest.raises(Exception, match=said):
            stored.observations(files, results(spark, (1, "structure", wrong))).collect()
    with pytest.raises(Exception, match="file 1 lacks size_bytes"):
        stored.observations(files.selectExpr("id", "path", "CAST(NULL AS LONG) AS size_bytes"), table).collect()

import json

from pyspark.sql import functions as F

from gradeloom.operators import deltas


def test_items_of_every_list(spark):
    delta = {
        "new_checks": ["dates are sorted", {"name": "n1", "description": "d"}, 7],
        "new_hidden_tests": ["assert f(1) == 2", "words", {"test_id": "t", "test_code": "assert f(2) == 3"}, {"name": "w", "code": "assert  code.strip()", "counts_as_hidden_test": True}, {"code": "assert f(0)", "eligible_for_clean_export": None}],
        "exception_tests": [{"name": "e", "expected_exception": "ValueError", "code": "", "test_code": "c"}, "raises"],
        "numeric_tolerance_tests": [{"test_id": "x", "expected": 1.5, "tolerance": 0}, {"test_id": "y", "expected": 1}],
        "file_output_tests": "out.csv",
        "static_checks": ["no eval", {"check_id": "s", "must_match": False, "pattern": "eval"}],
        "array_close_tests": None,
    }
    ops = spark.createDataFrame([("o1", json.dumps(delta)), ("o2", "{}"), ("o3", None), ("o4", "no json")], "operator_id string, delta string")
    rows = deltas.delta_items(ops)
    assert rows.columns[1:] == deltas.COLUMNS
    got = {(r.list, r.place): r for r in rows.collect()}
    assert len(got) == rows.count() == 15 and {r.operator_id for r in got.values()} == {"o1"}
    c = [got["new_checks", k] for k in (1, 2, 3)]
    assert (c[0].rule, c[0].kind, c[0].source, c[0].name) == ("dates are sorted", "generic", "fallback", c[0].item_id) and c[0].item_id.startswith("check_") and len(c[0].item_id) == 16
    assert (c[1].item_id, c[1].rule, c[1].source) == ("n1", "d", "llm") and (c[2].error, c[2].item_id) == ("ITEM_IS_NEITHER_OBJECT_NOR_TEXT", None)
    h = [got["new_hidden_tests", k] for k in range(1, 6)]
    assert [x.code for x in h] == ["assert f(1) == 2", "", "assert f(2) == 3", "assert  code.strip()", "assert f(0)"] and [x.test_tier for x in h] == ["smoke", "smoke", "semantic", "smoke", "semantic"]
    assert [x.counts_as_hidden_test for x in h] == [False, False, True, False, True] and [x.eligible_for_clean_export for x in h] == [False, False, True, False, False]
    assert h[2].item_id == h[2].name or h[2].item_id == "t"
    assert got["exception_tests", 1].code == "c" and got["exception_tests", 1].expected_exception == "ValueError" and got["exception_tests", 2].code is None
    assert (got["numeric_tolerance_tests", 1].tolerance, got["numeric_tolerance_tests", 2].tolerance) == ("0", None)
    assert got["file_output_tests", None].error == "LIST_IS_NOT_A_LIST"
    assert [(got["static_checks", k].rule, got["static_checks", k].must_match) for k in (1, 2)] == [("no eval", True), ("", False)]


def test_verdicts(spark):
    texts = {
        "bad": {"new_checks": [1]},
        "none": {},
        "twice": {"new_hidden_tests": [{"test_id": "a", "code": "assert 1 == f()"}, {"test_id": "a", "code": "assert 2 == f()"}], "numeric_tolerance_tests": [{"expected": 1}], "exception_tests": [{"test_id": "e"}], "static_checks": [{"check_id": "c"}]},
        "good": {"new_checks": ["x"]},
    }
    ops = spark.createDataFrame([(k, "V", json.dumps(v), 0) for k, v in texts.items()] + [("spec", "V", "{}", 1), ("other", "X", "{}", 0)], "operator_id string, axis string, delta string, test_specs int")
    got = {r.operator_id: r.errors for r in deltas.delta_verdicts(ops, deltas.delta_items(ops)).collect()}
    assert got == {
        "bad": ["ITEM_IS_NEITHER_OBJECT_NOR_TEXT"], "none": ["V_WITHOUT_VERIFICATION", "NO_EXECUTABLE_DELTA"], "good": [], "spec": [], "other": [],
        "twice": ["DUPLICATE_HIDDEN_TEST_ID", "NUMERIC_TEST_INCOMPLETE", "EXCEPTION_TEST_INCOMPLETE", "STATIC_CHECK_INCOMPLETE"],
    }


def test_deltas_of_a_small_file_are_the_work_of_all_tasks(spark):
    ops = spark.range(400).selectExpr("cast(id AS string) AS operator_id", """'{"new_checks": ["a", 1]}' AS delta""").coalesce(1)
    items = deltas.delta_items(ops)
    assert items.count() == 800 and items.select(F.spark_partition_id()).distinct().count() == 4

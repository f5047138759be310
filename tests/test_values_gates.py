import json

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import code, values
from gradeloom.operators import constraints, gates


@pytest.mark.parametrize(
    "a, b, want",
    [
        (1.0, 1.0 + 5e-7, True), (1, 1.1, False), (True, 1, True), (float("nan"), float("nan"), True), (None, None, True), ({"a": [1, 2.0]}, {"a": [1, 2.0000001]}, True), ({"a": 1}, {"a": 1, "b": 2}, False),
        ("a  b", "a b", True), ("array([1.0, 2.0])", "array([1.0000001, 2.0], dtype=float32)", True), ("array([1.0, 2.0])", "array([1.0, 3.0])", False), ([1, 2], "[1, 2]", True), ([1], [1, 2], False), ("x 1 2", "x 1 3", False),
    ],
)
def test_match(a, b, want):
    assert values.match(a, b) is want


def test_contains_paths_and_hash(spark):
    assert values.contains({"a": {"b": 1, "c": 2}, "d": 0}, {"a": {"b": 1.0}}) and not values.contains({"a": [1, 2]}, {"a": [1]}) and not values.contains([1], {"a": 1})
    assert values.path_matches("out.txt", "./x/out.txt") and values.path_matches("x/a", "x//a") and not values.path_matches("x/a", "y/a") and not values.path_matches("", "a") and not values.path_matches(".", "a")
    df = spark.createDataFrame([('{"a": 1, "b": [2]}', '{"b": [2], "a": 1}')], "a string, b string").select(values.stable_hash("a").alias("a"), values.stable_hash("b").alias("b"), values.flat_text("a").alias("t")).first()
    assert df.a == df.b and df.t == "1 2"


CHECKS = [
    ("return_value", "type_is", {"type": "dict"}, True), ("return_value", "dict_has_keys", {"keys": ["k"]}, True), ("return_value", "dict_has_keys", {"keys": ["q"]}, False), ("return_value", "non_empty", {}, True),
    ("return_value", "equals", {"value": {"k": 1.0000000001}}, True), ("return_value", "dict_contains", {"value": {}}, True), ("return_value", "list_sorted", {}, False), ("stdout", "contains", {"text": "hello   world"}, True),
    ("stdout", "non_empty", {}, True), ("stdout", "regex_match", {"pattern": "h.l+o"}, True), ("stdout", "regex_match", {"pattern": "("}, False), ("file_artifact", "path_exists", {"path": "a.csv"}, True), ("file_artifact", "path_exists", {}, True),
    ("file_artifact", "path_suffix_exists", {"suffix": ".txt"}, False), ("odd", "rule", {}, False),
]


def test_checks_run(spark):
    out = json.dumps({"return_value": {"k": 1}, "return_type": "dict", "stdout": "hello world\n", "file_artifacts": [{"path": "out/a.csv"}]})
    rows = [(i, [(f"c{i}", k, r, json.dumps(p), "soft")], out) for i, (k, r, p, _) in enumerate(CHECKS)] + [(99, [], out), (98, None, out)]
    df = spark.createDataFrame(rows, f"id int, checks array<{constraints.CHECK}>, output string")
    got = {r.id: r for r in constraints.run_checks(df, ["id"]).collect()}
    assert [got[i].passed for i in range(len(CHECKS))] == [w for *_, w in CHECKS]
    assert got[99].passed and got[98].passed and "unsupported" in got[14].failure_reasons[0]


def compiled(spark, signature):
    df = spark.createDataFrame([(json.dumps(signature),)], "s string")
    return [(c.kind, c.rule, json.loads(c.params)) for c in df.select(constraints.signature_checks(F.col("s")).alias("x")).first().x]


def test_signature_compiles(spark):
    assert compiled(spark, {"return_value": None, "return_type": "NoneType"}) == [("return_value", "type_is", {"type": "NoneType"}), ("return_value", "equals", {"value": None})]
    assert compiled(spark, {"return_value": None}) == []
    assert compiled(spark, {"return_value": [1, {"a": 2}]}) == [("return_value", "equals", {"value": [1, {"a": 2}]})]
    assert [x[1] for x in compiled(spark, {"return_value": {"a": 1}, "stdout_contains": ["x"], "file_artifacts": [{"path": "p"}]})] == ["dict_has_keys", "dict_contains", "contains", "path_exists"]
    assert [x[1] for x in compiled(spark, {"return_value": {"a": 1}, "exact": True})] == ["equals"]


def test_requirements_compile(spark):
    texts = ["Return a dict of rows", "A dict with keys mean and valid_count", "Output must be sorted in descending order", "Print the Summary to stdout", "print it", "Write `out.csv`, please", "Write the file", "Preserve output contract", "be nice", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(constraints.requirement_check(F.col("t")).alias("c"))
    want = [("type_is", {"type": "dict"}), ("dict_has_keys", {"keys": ["mean", "valid_count", "count"]}), ("list_sorted", {"order": "descending"}), ("contains", {"text": "summary"}), ("non_empty", {})]
    want += [("path_exists", {}), ("path_exists", {}), ("non_empty", {}), None, None, None]
    assert [(r.c.rule, json.loads(r.c.params)) if r.c else None for r in df.collect()] == want
    named = spark.createDataFrame([("Write results to out.json, then stop",)], "t string").select(constraints.requirement_check(F.col("t")).alias("c")).first().c
    assert json.loads(named.params) == {"path": "out.json"}


def test_seed_against_truth(spark):
    rows = [
        ("x: [1, 2]\nend", "x: [1,2]\nend", "1", "1", ["a/b"], ["a/b"]),
        ("x: 1", "y: 1", "1", None, ["b", "a"], ["d/a", "d/b"]),
        ("a", "a", "2", "1", ["a"], ["b"]),
        ("1.0", "1", None, None, None, None),
        ("a\nb", "a", None, "null", [], None),
    ]
    df = spark.createDataFrame(rows, "stdout string, truth_stdout string, value string, truth_value string, paths array<string>, truth_paths array<string>")
    got = [r.mismatches for r in constraints.seed_matches_truth(df).collect()]
    assert got == [[], ["stdout_mismatch"], ["return_value_mismatch", "file_artifacts_mismatch"], [], ["stdout_mismatch"]]


def test_failure_types_and_rules(spark):
    failures = {
        "c1_return_type:return type is int": "return_type_mismatch",
        "OUTPUT_CONSTRAINT_FAILED:return_keys:keys missing": "return_keys_mismatch",
        "c_return_value_equals:no": "return_value_mismatch",
        "OUTPUT_CONSTRAINT_FAILED:return_contains:no": "return_value_mismatch",
        "OUTPUT_CONSTRAINT_FAILED:stdout_0:no": "stdout_mismatch",
        "c_stdout_regex_1:no": "stdout_regex_mismatch",
        "c_artifact_exists_0:x": "file_artifact_missing",
        "CASE_EXECUTION_ERROR:ValueError": "exception_mismatch",
        "CASE_EXECUTION_ERROR:NameError: x": "name_error",
        "CASE_EXECUTION_ERROR:ModuleNotFoundError: y": "module_not_found",
    }
    df = spark.createDataFrame([([k],) for k in failures] + [(["a path {name}/x"],), ([],), (None,)], "f array<string>")
    got = df.select(constraints.failure_types(F.col("f")).alias("t"), constraints.repair_rules(constraints.failure_types(F.col("f"))).alias("r")).collect()
    assert [r.t for r in got] == [[v] for v in failures.values()] + [["unresolved_artifact_template"], [], []]
    assert all(constraints.failure_types_of([k]) == [v] and constraints.repair_rules_of([v]) == r.r for (k, v), r in zip(failures.items(), got))
    assert len(got[-1].r) == 3 and len(got[0].r) == 4


def test_preflight():
    assert code.preflight("def f(x):\n    return x", "def f(x)") == [] and code.preflight("", None) == ["EMPTY_CODE"] and code.preflight("```python\nx\n```") == ["WRAPPED_IN_TEXT"]
    assert code.preflight("def f(:", None)[0].startswith("SYNTAX_ERROR") and code.preflight("def g(x): pass", "def f(x)") == ["TARGET_FUNCTION_MISSING"] and code.preflight("def f(y): pass", "def f(x)") == ["SIGNATURE_MISMATCH"]
    assert code.preflight("import socket\neval('1')") == ["UNSAFE_CALL:eval", "UNSAFE_IMPORT:socket"]
    assert [code.path_class(p) for p in ("a/b", "/a", "~/a", "C:\\x", "../a", "a/../../b", "a/../b", "", None)] == ["safe", "absolute", "home", "drive", "parent", "parent", "safe", "empty", "empty"]
    assert code.path_references("open('in/a.txt')\nx = 'b/c.csv'\ny = 'plain'") == ["in/a.txt", "b/c.csv"]


def case(**k):
    base = dict(env_id="e", case_id="c", description="d", case_kind="coverage", targets_operator_id="o1", axis="D", semantic_intent="s", target_constraint="t", expected_failure_mode="m", call_code="result = f(1)", setup_code="", assertion_code="", expected_output_signature='{"return_value": 1}', covered_requirements=["r"])
    return tuple((base | k).values())


def test_case_validation(spark):
    ops = spark.createDataFrame([("e", "o1", "D")], "env_id string, operator_id string, axis string")
    rows = [
        (case(), []), (case(targets_operator_id="zz"), ["UNKNOWN_TARGET_OPERATOR_ID:zz"]), (case(case_kind="seed_baseline", targets_operator_id=""), []), (case(axis="C"), ["AXIS_OPERATOR_MISMATCH"]), (case(call_code="f(1)"), ["CALL_CODE_MUST_ASSIGN_RESULT"]),
        (case(call_code=""), ["MISSING_FIELD:call_code", "EMPTY_CALL_CODE"]), (case(assertion_code="assert True"), ["PLACEHOLDER_ASSERTION"]), (case(expected_output_signature='{"return_value": null}'), ["EXPECTED_OUTPUT_SIGNATURE_EMPTY_SHELL"]),
        (case(expected_output_signature='{"return_value": "<a.B object at 0x1f>"}'), ["UNSTABLE_EXPECTED_OUTPUT_OBJECT_MEMORY_ADDRESS"]), (case(covered_requirements=[" "]), ["EMPTY_COVERED_REQUIREMENTS"]), (case(call_code="result = open('/etc/x.txt')"), ["UNSAFE_PATH:/etc/x.txt"]),
        (case(description=None), ["MISSING_FIELD:description"]),
    ]
    fields = "env_id case_id description case_kind targets_operator_id axis semantic_intent target_constraint expected_failure_mode call_code setup_code assertion_code expected_output_signature".split()
    df = spark.createDataFrame([(*r[:1], f"c{i}", *r[2:]) for i, (r, _) in enumerate(rows)], ", ".join(f"{f} string" for f in fields) + ", covered_requirements array<string>")
    got = {r.case_id: r for r in constraints.validate_cases(df, ops).collect()}
    for i, (_, want) in enumerate(rows):
        assert got[f"c{i}"].failure_reasons == want and got[f"c{i}"].valid == (not want), i


def test_gates(spark):
    df = spark.createDataFrame([(["X:1"], []), (["Y"], ["w"]), ([], ["w", "w"]), ([], [])], "f array<string>, w array<string>").select(gates.gate("g", F.col("f"), F.col("w"), ("X",)).alias("g"))
    assert [(r.g.severity, r.g.score, r.g.passed) for r in df.collect()] == [("hard_fail", 0.0, False), ("soft_fail", 0.3, False), ("pass_with_warning", 0.8, True), ("pass", 1.0, True)]


def test_final_decision(spark):
    rep = spark.createDataFrame([("a", 1, "pass", [], []), ("b", 1, "hard_fail", ["R1", "R1"], []), ("b", 2, "pass", [], ["w"]), ("d", 1, "pass", [], [])], "env_id string, position int, severity string, failure_reasons array<string>, warnings array<string>")
    s = gates.operator_summary(rep)
    assert {r.env_id: r.severity for r in s.collect()} == {"a": "pass", "b": "hard_fail", "d": "pass"}
    g = spark.createDataFrame([("a", 1, "pass_with_warning", []), ("b", 1, "pass", []), ("d", 1, "pass", []), ("d", 2, "soft_fail", ["S"])], "env_id string, position int, severity string, failure_reasons array<string>")
    envs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "env_id string")
    got = {r.env_id: (r.final_decision, r.rejection_reasons) for r in gates.final_decision(envs, s, g).collect()}
    assert got == {"a": ("clean", []), "b": ("rejected", ["R1", "OPERATOR_REALIZATION_HARD_FAIL"]), "c": ("rejected", ["OPERATOR_REALIZATION_REPORT_MISSING", "OPERATOR_REALIZATION_HARD_FAIL"]), "d": ("rejected", ["S"])}


def test_realization_and_more_gates(spark):
    cols = "axis string, intensity int, has_patch boolean, exposed boolean, valid_cases int, linked_cases int, passed_cases int, failed_cases int, gold_reused boolean, answer_invariant boolean, invariant_declared boolean"
    df = spark.createDataFrame([("D", 1, False, True, 1, 1, 1, 0, True, False, False), ("V", 2, True, True, 1, 1, 1, 0, True, True, True), ("A", 1, True, False, 0, 0, 0, 1, False, False, False)], cols)
    a, b, c = gates.realization(df).collect()
    assert a.failure_reasons == ["D_NO_DATA_PATCH", "SEED_GOLD_REUSED_WITHOUT_JUSTIFICATION"] and b.severity == "pass_with_warning" and c.failure_reasons == ["A_ROBUSTNESS_NOT_VISIBLE", "A_NO_TARGETED_SHORTCUT_CASE", "A_NO_CASE_FOR_ROBUSTNESS", "A_GOLD_FALLS_INTO_SHORTCUT"]
    rep = spark.createDataFrame([("a", "c1", True), ("b", "c1", False), ("c", None, None)], "env_id string, case_id string, passed boolean")
    got = {r.env_id: r.gate for r in gates.gold_execution_gate(rep).collect()}
    assert got["a"].passed and got["b"].failure_reasons == ["CASE_FAILED:c1"] and got["c"].severity == "hard_fail"
    q = spark.createDataFrame([(["o"], ["o"], 1, ["r", "s"], ["r"]), (["o", "p"], ["o"], 0, ["r"], [])], "operators array<string>, covered_operators array<string>, valid_cases int, requirements array<string>, covered_requirements array<string>")
    x, y = [r.gate for r in gates.oracle_quality_gate(q).collect()]
    assert x.severity == "pass_with_warning" and y.failure_reasons == ["NO_VALIDATED_ORACLE_CASES", "NO_CASE_REQUIREMENT_COVERAGE", "NO_VALID_ORACLE_CASE_FOR_OPERATOR:p"]
    none, some = F.lit(None).cast("array<string>"), F.array(F.lit("x"))
    assert spark.range(1).select(gates.baseline_gate(some, some, some, F.lit("g")).alias("g")).first().g.severity == "pass_with_warning"
    assert spark.range(1).select(gates.baseline_gate(none, some, some, F.lit("")).alias("g")).first().g.failure_reasons == ["EMPTY_VALIDATED_ORACLE_CASES", "EMPTY_SCALED_GOLD"]


def test_triage(spark):
    texts = ["HTTP Error 503", "timeout in your region", "bad request timeout", "all fine", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(gates.retryable(F.lit("llm_error"), F.col("t")).alias("x")).collect()] == [True, False, False, False, False]
    assert not any(r.x for r in df.select(gates.retryable(F.lit("validated"), F.col("t")).alias("x")).collect())
    kinds = spark.createDataFrame([("EMPTY_SCALED_GOLD",), ("D_NO_DATA_PATCH",), ("NO_VALIDATED_ORACLE_CASES",), ("zzz",)], "r string").select(gates.failure_category(F.col("r")).alias("c"))
    assert [r.c for r in kinds.collect()] == ["repair", "realization", "generation", "other"]


def test_status_prune_change(spark):
    df = spark.createDataFrame([("clean", True, []), ("clean", False, []), (None, None, ["f"]), (None, None, [])], "final_decision string, passed boolean, blocking_flags array<string>")
    assert [r.export_status for r in gates.export_status(df).collect()] == ["clean", "rejected", "rejected", "clean"]
    p = spark.createDataFrame([(["a", "b"], ["b"], True, True), (["a"], ["a"], True, False)], "cases array<string>, invalid_cases array<string>, gates_pass_without boolean, operators_kept boolean")
    assert [r.cases for r in gates.safe_prune(p).collect()] == [["a"], ["a"]]
    e = spark.createDataFrame([("t", "M1", "x"), ("t", "M2", "x"), ("t", "M3", "y"), ("u", "M2", "x")], "original_task_id string, level string, problem string")
    assert {(r.original_task_id, r.level): r.changed for r in gates.semantic_change(e, ["problem"]).collect()} == {("t", "M1"): None, ("t", "M2"): False, ("t", "M3"): True, ("u", "M2"): None}
    assert gates.assert_complete(e, 4).count() == 4
    with pytest.raises(Exception, match="rows"):
        gates.assert_complete(e, 5).collect()


def test_json_is_repaired_outside_of_texts():
    r = values.repair_json
    assert r('{"a": "True story, None left", "b": True, // note\n "c": [1,2,],}') == '{"a": "True story, None left", "b": true, "c": [1, 2]}'
    assert r("x {'a': 'it\\'s \"q\"', 'b': None} y") == '{"a": "it\'s \\"q\\"", "b": null}'
    assert r('```json\n{"a": [1, 2\n```') == '{"a": [1, 2]}' and r('{"u": "http://x//y # z"}') == '{"u": "http://x//y # z"}'
    assert r("[(1, 2), {3: 4}]") == '[[1, 2], {"3": 4}]' and r('{"a": "open') == '{"a": "open"}' and r("none") is None and r("{a b}") is None


def test_comparing_goes_as_deep_as_values_do():
    deep, other = 1, 2
    for _ in range(3_000):
        deep, other = [deep], [other]
    assert values.match(deep, deep) and not values.match(deep, other)
    assert values.match("array([1., 2.])", "[1.0 2.0]\n") and values.match("[1, 2]", [1, 2]) and not values.match(1, {"a": 1})
    assert values.contains({"a": 1, "c": 2}, {"a": 1}) and not values.contains([1, 2], [1]) and not values.match({"a": 1, "c": 2}, {"a": 1})
    assert values.path_matches("/a/../b", "/b") and not values.path_matches("/b", "b")


def test_reasons_and_common_words_are_not_made_again_for_each_text(spark):
    from gradeloom.operators import evidence

    df = spark.createDataFrame([(1, "Check the blue bolt, blue"), (2, None)], "n int, t string")
    out = df.select("n", gates.reasons((F.col("n") > 0, "A"), (F.col("t").isNull(), "B"), (F.lit(None).cast("boolean"), "C")).alias("r"), evidence.case_words(F.col("t")).alias("w"))
    assert [tuple(r) for r in out.orderBy("n").collect()] == [(1, ["A"], ["blue", "bolt"]), (2, ["A", "B"], None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except(array(the" not in plan and "array_except([a,an" not in plan and "lambda" not in plan.split("AS r#")[0] and "INSET" in plan
    code.has_result("result = 1"), code.has_result("result = 1")
    assert code.has_result.cache_info().hits > 0

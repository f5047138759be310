import json

from gradeloom.operators import adapters, gates, trajectories

SCHEMA = "env_id string, level string, problem string, signature string, gold_solution string, call_code string, expected_output string"
GOOD = "def f(x):\n    return x + 1"


def test_trajectories_keep_graded_code_alone(spark):
    rows = [("a", "M2", "p", "def f(x)", GOOD, "result = f(1)", '{"return_value": 2.0000000001}'), ("b", "M2", "p", "def f(x)", GOOD, "result = f(1)", '{"return_value": 9}'), ("c", "M2", "p", "def f(x)", " ", "", "{}"), ("d", "M2", "p", "def f(x)", "def g(x): pass", "", "{}")]
    envs = spark.createDataFrame(rows, SCHEMA)
    got = {r.env_id: r for r in trajectories.trajectories(envs).collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {"a": None, "b": "hidden_oracle_failed", "c": "missing_reference_code", "d": "no_valid_final_submission"}
    messages = json.loads(got["a"].messages)
    assert [m["role"] for m in messages] == ["system", "user"] + ["assistant", "tool"] * 3 and "2.0000000001" not in got["a"].messages
    assert got["a"].used_tools == ["get_task_context", "validate_candidate_code", "submit_final_code"] and got["a"].sample_id.startswith("a_oracle_gold")
    teacher = adapters.MockClient({"teacher_solution": lambda c: {"final_code": "def f(x):\n    return 2"}})
    assert {r.env_id: r.reject_reason for r in trajectories.trajectories(envs.where("env_id = 'a'"), teacher).collect()} == {"a": None}


def test_seed_requirements_and_regression(spark):
    envs = spark.createDataFrame([("a", "def f(x)", "result = f(1)", '{"return_value": 2, "return_type": "int"}'), ("b", None, "", "{}")], "env_id string, signature string, call_code string, expected_output string")
    got = {r.env_id: r.seed_requirements for r in trajectories.seed_requirements(envs).collect()}
    assert len(got["a"]) == 4 and got["a"][0].endswith("for f.") and got["b"] == []
    cases = spark.createDataFrame([("a", "c1", "coverage")], "env_id string, case_id string, case_kind string")
    once = trajectories.with_regression_case(cases, envs)
    assert {r.case_id for r in once.collect()} == {"c1", "a_seed_regression"} and trajectories.with_regression_case(once, envs).count() == 2


def test_artifact_gate(spark):
    fields = "operators array<string>, operator_reports array<string>, scaled_cases array<string>, validated_cases array<string>, gold_solution string, user_prompt string, scaling_plan string, operator_severity string, prior_gates map<string,string>, violations array<string>"
    x = ["x"]
    df = spark.createDataFrame([(x, x, x, x, "g", "p", "s", "pass", {"a": "pass"}, []), (x, x, x, [], "g", "", "s", "soft_fail", {"a_gate": "hard_fail"}, ["V"]), (x, x, x, x, "g", "p", "s", "pass_with_warning", None, None)], fields)
    a, b, c = [r.gate for r in gates.artifact_gate(df).collect()]
    assert a.severity == "pass" and c.severity == "pass_with_warning" and b.severity == "hard_fail"
    assert b.failure_reasons == ["TOOL_BUDGET_MISMATCH: V", "EMPTY_VALIDATED_ORACLE_CASES", "EMPTY_FINAL_PROMPT", "OPERATOR_REALIZATION_SOFT_FAIL", "A_GATE_HARD_FAIL"]


def test_test_and_consistency_gates(spark):
    t = spark.createDataFrame([(2, 2, 0, 0, 0, 2, []), (0, 0, 0, 0, 0, 0, None), (3, 1, 1, 0, 1, 2, ["E"])], "tests int, semantic_tests int, weak_tests int, untargeted_tests int, without_failure_mode int, v_intensity int, execution_errors array<string>")
    a, b, c = [r.gate for r in gates.hidden_tests_gate(t).collect()]
    assert a.severity == "pass" and b.severity == "hard_fail" and c.failure_reasons == ["E", "WEAK_HIDDEN_TEST", "V_NOT_ENOUGH_SEMANTIC_TESTS"]
    s = "gold_solution string, seed_gold string, gold_changed boolean, answer_invariant boolean, change_reason string, requirements array<string>, tested array<string>, verified array<string>, verifier_state string, operator_severity string"
    d = spark.createDataFrame([("n", "o", True, False, "", ["r"], ["r"], ["r"], "v", "pass"), ("o", "o", True, False, "", ["r", "q"], ["r"], ["r"], "v", "hard_fail")], s)
    a, b = [r.gate for r in gates.consistency_gate(d).collect()]
    assert a.severity == "pass" and b.failure_reasons == ["SEED_GOLD_REUSED_WITHOUT_JUSTIFICATION", "REQUIREMENT_CHAIN_BROKEN"] and len(b.warnings) == 3

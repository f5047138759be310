import json

from pyspark.sql import functions as F

from gradeloom.operators import adapters, verifiers
from gradeloom.plans.stages import Run


def raw(spark, n=5):
    rows = []
    for i in range(n):
        code = f"def f(x):\n    return {{'v': x + {i}}}"
        rows.append((i + 1, json.dumps({"idx": f"t{i}", "problem": "Compute the mean of an array" if i % 2 else "Parse a csv file", "starter_code": "def f(x):\n    <<insert solution here>>", "signature": "def f(x)", "solution": code, "code": code, "call_code": "result = f(2)"})))
    rows.append((n + 1, json.dumps({"idx": "broken", "problem": "p", "solution": "def f(:", "code": "def f(:", "call_code": "result = 1"})))
    return spark.createDataFrame(rows, "row_idx long, value string")


def test_stages_run_once_and_resume(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    out = run.all(raw(spark))
    assert out["tasks"].count() == 6 and out["seeds"].count() == 5 and out["envs"].count() == 20
    assert out["envs"].where("export_status <> 'clean'").count() == 0 and out["splits"].count() == 20
    joined = out["envs"].join(out["splits"], "env_id")
    assert joined.groupBy("original_task_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    total = {r.level: r for r in out["summary"].collect()}[None]
    assert total.rollouts == 20 and total.sample_pass_rate == 1.0 and abs(total.mean_reward - 1.7) < 1e-9
    again = Run(spark, str(tmp_path / "run"))
    assert again.all(raw(spark))["evals"].count() == 20 and again.ran == []


def test_scaled_tables_evaluation_and_publishing(spark, tmp_path):
    run = Run(spark, str(tmp_path / "run"))
    out = run.all(raw(spark, 2))
    ops = out["operators"]
    assert ops.where("size(patch_errors) > 0").count() == 0 and ops.count() == out["cases"].where("targets_operator_id <> ''").count()
    assert out["cases"].where("not valid").count() == 0 and out["golds"].where("not gold_passed").count() == 0
    assert out["states"].count() == ops.select("env_id").distinct().count()
    reasons = {x for r in out["realization"].collect() for x in r.failure_reasons}
    assert reasons == {"SEED_GOLD_REUSED_WITHOUT_JUSTIFICATION"}
    bad = adapters.MockClient({"agent_turn": lambda c: {"tool": "submit_final_code", "code": "def f(x):\n    return {'v': -1}"}})
    got = run.evaluate({"base": ("base", bad), "tuned": ("sft", run.client)}, split=None)
    rows = {r.model_label: r for r in got["comparison"].collect()}
    assert rows["base"].num_envs == rows["tuned"].num_envs == 2 and rows["base"].sample_pass_rate == 0 and rows["tuned"].case_pass_rate == 1
    assert [(r.model_label, r.delta_sample_pass_rate) for r in got["deltas"].collect()] == [("tuned", 1.0)]
    made = run.publish(str(tmp_path / "result"), ["envs", "rewards", "no such table"])
    assert {r.name: r.rows for r in made.collect()} == {"envs": 8, "rewards": 8} and spark.read.parquet(str(tmp_path / "result/envs")).count() == 8


def test_strict_runs_reject_unrealized_operators(spark, tmp_path):
    out = Run(spark, str(tmp_path / "strict"), strict=True).all(raw(spark, 1))
    got = {r.level: r.export_status for r in out["envs"].collect()}
    hard = {r.level for r in out["realization"].where("severity = 'hard_fail'").collect()}
    assert got["M1"] == "clean" and hard and all(got[level] == ("rejected" if level in hard else "clean") for level in got)


def test_a_bad_model_fails_its_cases(spark, tmp_path):
    bad = adapters.MockClient({"agent_turn": lambda c: {"tool": "submit_final_code", "code": "def f(x):\n    return 1 / 0"}})
    out = Run(spark, str(tmp_path / "bad"), bad).all(raw(spark, 2))
    r = out["rewards"].first()
    assert not r.execution_passed and r.advantage == 0.0 and any("OUTPUT_CONSTRAINT_FAILED" in x for x in r.failure_reasons)


def test_hidden_tests_and_specs(spark):
    ops = spark.createDataFrame(
        [("e", "o2", 2, [("t", None, "assert f(1) == 1", None, None, None, None, None, None), (None, "n", "assert True", None, None, None, None, None, None)], ["c2"], [], []), ("e", "o1", 1, [(None, None, None, " assert f(2) ", "fallback", None, None, None, None), (None, None, None, "assert f(3)", None, None, None, None, None)], ["c1"], ["s"], ["x"])],
        f"env_id string, operator_id string, position int, hidden_tests array<{verifiers.TEST}>, checks array<string>, static_checks array<string>, exception_tests array<string>",
    )
    envs = spark.createDataFrame([("e", None, "function_body", "d", ["x"]), ("f", "static_check", "function_body", "d", None)], "env_id string, verifier_type_hint string, solution_form string, primary_domain string, secondary_domains array<string>")
    got = {r.env_id: r for r in verifiers.verifier_specs(envs, ops).collect()}
    assert got["e"].verifier_type == "unit_test" and got["e"].checks == ["compile_check", "secondary_domain_grounding", "c1", "c2"] and got["e"].generated_from == ["o1", "o2"]
    assert [t.code for t in got["e"].hidden_tests] == ["assert f(3)", "assert f(1) == 1"] and got["e"].hidden_tests[0].test_id.startswith("o1_hidden_")
    assert got["f"].checks == ["compile_check"] and got["f"].hidden_tests == []


def test_delta_errors(spark):
    t = lambda i: (i, None, "assert x", None, None, None, None, None, None)
    rows = [("V", [], [], [], [], [], []), ("D", [t("a"), t("a"), t(None)], ["c"], ["", "r"], ["E"], [(None, 1.0)], []), ("C", [t("a")], [], [], [], [], [])]
    df = spark.createDataFrame(rows, f"axis string, hidden_tests array<{verifiers.TEST}>, checks array<string>, static_checks array<string>, exception_tests array<string>, numeric_tests array<struct<expected:double,tolerance:double>>, test_specs array<string>")
    assert [r.errors for r in verifiers.delta_errors(df).collect()] == [["V_WITHOUT_VERIFICATION", "NO_EXECUTABLE_DELTA"], ["HIDDEN_TEST_WITHOUT_ID", "DUPLICATE_HIDDEN_TEST_ID", "NUMERIC_TEST_INCOMPLETE", "STATIC_CHECK_INCOMPLETE"], []]


def test_tool_configs_stay_in_bounds(spark):
    df = spark.createDataFrame([("e", lv, tools) for lv in verifiers.TOOL_BOUNDS for tools in ([], ["a"], list("abcdefgh"), ["a", "a", "debug_traceback", "req"])], "env_id string, level string, tools array<string>")
    got = verifiers.config_violations(verifiers.tool_configs(df, ["s1", "s2", "s3"], ["req"]))
    assert got.count() == 16 and got.where(F.size("violations") > 0).count() == 0
    assert got.where("level = 'M1' and array_contains(tools, 'req')").first().allowed_tools == ["req", "a", "debug_traceback"]


def test_case_plans_and_repair(spark):
    ops = spark.createDataFrame([("e", "o1", "D", 1), ("e", "o2", "C", 2)], "env_id string, operator_id string, axis string, position int")
    envs = spark.createDataFrame([("e", "M3", "g", "c", "x"), ("f", "M1", "g", "", "x")], "env_id string, level string, gold_solution string, call_code string, expected_output string")
    got = {r.env_id: r for r in verifiers.case_plans(envs, ops, {"M3": 2}).collect()}
    assert (got["e"].status, got["e"].required_cases, got["e"].targets_operator_id) == ("ready", 2, "o1,o2") and (got["f"].status, got["f"].required_cases) == ("blocked", 0)
    cases = spark.createDataFrame([("e", None, 3, None, "C", "f(1)"), ("e", "k", 4, "o1", None, "result = f(2)")], "env_id string, case_id string, position int, targets_operator_id string, axis string, call_code string")
    fixed = {r.position: r for r in verifiers.repaired_cases(cases, ops).collect()}
    assert (fixed[3].case_id, fixed[3].targets_operator_id, fixed[3].call_code) == ("scaled_oracle_case_3", "o2", "result = f(1)") and fixed[4].axis == "D"

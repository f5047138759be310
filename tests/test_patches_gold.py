import json

from pyspark.sql import functions as F

from gradeloom.operators import adapters, constraints, gold, patches, summaries
from gradeloom.operators.constraints import CHECK

OPS = f"env_id string, operator_id string, position int, axis string, operator_intensity int, transformation_goal string, patch {patches.PATCH}"


def test_templates_by_axis(spark):
    df = spark.createDataFrame([("e", f"o{a}", i, a, n, "g", None) for i, (a, n) in enumerate([("D", 1), ("D", 2), ("C", 1), ("A", 2), ("V", 1)])], OPS)
    got = patches.with_patches(df, F.lit("chem"), F.array(F.lit("bio"))).collect()
    flat = [{f"{p.state}.{p.key}": json.loads(p.value) for p in r.patch} for r in got]
    assert flat[0]["data.input_format_variants"] == ["extensionless", "comment_lines"] and len(flat[1]["data.input_format_variants"]) == 3
    assert flat[1]["verifier.resource_variation_checks"] == ["d_resource_check_2"] and flat[3]["task.must_not_follow_shortcut"] is True
    assert [f["gold.gold_changed"] for f in flat] == [True, True, True, True, False] and flat[4]["gold.answer_invariant"] is True
    assert flat[2]["task.domain_context"] == {"primary_domain": "chem", "secondary_domains": ["bio"]} and flat[2]["task.axis_intensity"] == 1 and flat[2]["task.axis_constraints"] == ["C"]
    assert got[3].semantic_spec.spec_id == "e_a_2_spec" and got[3].semantic_spec.test_template_type == "anti_shortcut_case"
    checked = patches.patch_errors(patches.with_patches(df, F.lit("chem"), F.lit(None).cast("array<string>")))
    assert checked.where(F.size("patch_errors") > 0).count() == 0 and checked.where(~patches.realized_patch(F.col("axis"), F.col("patch"))).count() == 0


def test_missing_entries_are_filled_in(spark):
    given = [("data", "resource_variants", '["mine"]')]
    goal = 'do "it"\nwell'
    df = spark.createDataFrame([("e", f"o{i}", i, a, 1, goal, p) for i, (a, p) in enumerate([("D", given), ("C", None), ("A", []), ("V", None), ("X", None)])], OPS)
    got = df.select("axis", patches.repaired_patch(F.col("patch"), F.col("axis"), F.col("operator_id"), F.col("transformation_goal")).alias("p")).collect()
    flat = {r.axis: {f"{p.state}.{p.key}": json.loads(p.value) for p in r.p} for r in got}
    assert flat["D"]["data.resource_variants"] == ["mine"] and flat["D"]["test.tests_with_new_resource_variants"] == [goal]
    assert flat["A"]["visible.robustness_trap"] == goal and flat["V"]["gold.gold_changed"] is False and flat["X"] == {"task.operator_goal": goal}
    errors = patches.patch_errors(df).collect()
    assert errors[1].patch_errors == ["NO_STATE_UPDATE", "NO_SEMANTIC_UPDATE", "C_WITHOUT_CONSTRAINT"] and errors[0].patch_errors == []


def test_patches_add_up_in_order(spark):
    rows = [
        ("e", "o2", 2, "D", 1, "g", [("task", "a", '{"y": 2, "z": [1]}'), ("task", "b", "2"), ("gold", "c", '{"k": 1}')]),
        ("e", "o1", 1, "D", 1, "g", [("task", "a", '{"x": 1, "y": 1}'), ("task", "b", '{"n": 1}'), ("gold", "c", "0")]),
        ("f", "o1", 1, "D", 1, "g", [("turn", "a", "null")]),
        ("g", "o1", 1, "D", 1, "g", None),
    ]
    base = spark.createDataFrame([("e", [("task", "a", '{"w": 0, "x": 0}'), ("task", "d", "1")])], f"env_id string, patch {patches.PATCH}")
    states = patches.applied(spark.createDataFrame(rows, OPS), base)
    got = {r.env_id: r for r in patches.state_maps(states).collect()}
    assert {k: json.loads(v) for k, v in got["e"].task_state.items()} == {"a": {"w": 0, "x": 1, "y": 2, "z": [1]}, "b": 2, "d": 1}
    assert got["e"].gold_state == {"c": '{"k": 1}'} and got["f"].turn_state == {"a": "null"} and got["e"].turn_state == {} and "g" not in got


def test_gold_is_repaired_within_bounds(spark):
    good, bad = "def f(x):\n    return x + 1", "def f(x):\n    return x"
    check = [("return_equals", "return_value", "equals", '{"value": 3}', "hard")]
    cases = spark.createDataFrame([(e, "c", 1, "", "result = f(2)", check) for e in "abc"], f"env_id string, case_id string, position int, setup_code string, call_code string, checks array<{CHECK}>")
    envs = spark.createDataFrame([(e, "p", bad) for e in "abcd"], "env_id string, problem string, gold_solution string")

    def repair(c):
        assert c["repair_rules"] and c["failed_cases"][0]["case_id"] == "c"
        return {"code": good} if c["env_id"] == "b" and c["attempt"] == 2 else {}

    client = adapters.MockClient({"scaled_gold": lambda c: {"code": good} if c["env_id"] == "a" else {"code": ""}, "scaled_gold_repair": repair})
    got = {r.env_id: r for r in gold.gold_solutions(envs, cases, client).collect()}
    assert got["a"].gold_passed and got["a"].repair_attempts == 0 and got["b"].gold_passed and got["b"].repair_attempts == 2 and got["b"].gold_code == good
    assert not got["c"].gold_passed and got["c"].repair_attempts == 3 and got["c"].gold_failures == ["OUTPUT_CONSTRAINT_FAILED:return_equals:return value differs"] and not got["c"].case_reports[0].passed
    assert [t["failure_types"] for t in json.loads(got["c"].repair_trace)] == [["return_value_mismatch"]] * 3
    assert got["d"].gold_failures == ["NO_CASES"] and gold.gold_solutions(envs.limit(0), cases, client).count() == 0


def test_manifest_counts(spark):
    rows = [("train", "gold", ["a", "create_test_file"]), ("train", "agent", []), ("dev", None, None)]
    df = spark.createDataFrame(rows, "split string, trajectory_type string, tools array<string>")
    got = summaries.sft_manifest(df, df.limit(1)).first()
    assert (got.num_samples, got.num_rejected, got.uses_create_test_file) == (3, 1, 1) and got.splits == {"train": 2, "dev": 1} and got.trajectory_types == {"gold": 1, "agent": 1, "unknown": 1}
    none = summaries.sft_manifest(df.limit(0), df.limit(0)).first()
    assert none.num_samples == 0 and none.splits == {}


def test_bound_requirements(spark):
    rows = [("e", "c1", "coverage", "o1", "D", ["r1", "r2", "r9", "r1"]), ("e", "c2", "seed_regression", "o1", "seed", ["r2", "r9"]), ("e", "c3", "coverage", "", None, ["r2", "r3"]), ("f", "c", "coverage", "o", "D", ["r1"]), ("e", "c4", "coverage", "o1", "D", None)]
    cases = spark.createDataFrame(rows, "env_id string, case_id string, case_kind string, targets_operator_id string, axis string, covered_requirement_ids array<string>")
    known = spark.createDataFrame([("e", "r1", "o1", "D"), ("e", "r2", "o2", "C"), ("e", "r3", None, "global")], "env_id string, requirement_id string, operator_id string, axis string")
    got = {(r.case_id, r.requirement_id): r.failure_reasons for r in constraints.bound_requirements(cases, known).collect()}
    assert got == {
        ("c1", "r1"): [], ("c1", "r2"): ["REQUIREMENT_OPERATOR_MISMATCH:r2", "REQUIREMENT_AXIS_MISMATCH:r2"], ("c1", "r9"): ["UNKNOWN_REQUIREMENT_ID:r9"],
        ("c2", "r2"): [], ("c2", "r9"): ["UNKNOWN_REQUIREMENT_ID:r9"], ("c3", "r2"): [], ("c3", "r3"): [],
    }

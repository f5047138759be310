import json
import random

from pyspark.sql import functions as F

from gradeloom.functions.code import assigns_result, code_paths
from gradeloom.functions.values import flat_text
from gradeloom.operators import adapters, case_repair, constraints, evidence, patches, prompts, rubrics
from gradeloom.plans import catalogue
from gradeloom.plans.stages import Run, gold_client
from gradeloom.sources.shared import written

from test_stages_verifiers import raw

CASES = "env_id string, case_id string, position int, case_kind string, targets_operator_id string, axis string, description string, semantic_intent string, target_constraint string, expected_failure_mode string, setup_code string, call_code string, assertion_code string, expected_output_signature string, covered_requirements array<string>"
OPS = f"env_id string, operator_id string, axis string, position int, transformation_goal string, output_requirements array<string>, patch {patches.PATCH}"
GOAL = "Reject sequences with unknown bases"


def case(i="c", kind="coverage_extension", target="o1", axis="C", text=GOAL, call="result = reject(sequences='ACGX')", signature='{"return_value": ["unknown"]}', covered=(GOAL,), mode="bases_ignored"):
    return ("e", i, 1, kind, target, axis, text, text, text, mode, "", call, "", signature, list(covered))


def checked(spark, cases, visible=(GOAL,)):
    ops = evidence.operator_texts(spark.createDataFrame([("e", "o1", "C", 1, GOAL, [GOAL], [("visible", "output_constraints", '["Say which bases are unknown"]')]), ("e", "o2", "D", 2, "Read gzip files", [], None)], OPS))
    asked = spark.createDataFrame([("e", "r1", 1, "o1", "C", GOAL), ("e", "r2", 2, None, "seed", "Seed output stays")], "env_id string, requirement_id string, position int, operator_id string, axis string, text string")
    shown = spark.createDataFrame([("e", list(visible))], "env_id string, visible_requirements array<string>")
    return {r.case_id: r for r in constraints.validate_cases(spark.createDataFrame(cases, CASES), ops, "env_id", asked, shown).collect()}


def test_rules_on_text(spark):
    got = checked(
        spark,
        [
            case("good"),
            case("generic", text="Handle scaled input"),
            case("other", text="Print coloured tables", covered=["Print coloured tables"], call="result = coloured()"),
            case("unseen", text=GOAL, covered=["Say nothing at all"]),
            case("blind", call="result = 1", signature='{"return_value": 1}', mode="m"),
            case("wrong operator", target="o2", axis="D"),
            case("seed", kind="seed_baseline", target="", axis="seed", text="Seed output stays", covered=["Seed output stays"]),
        ],
    )
    assert got["good"].valid and got["good"].covered_requirement_ids == got["good"].matched_requirement_ids == ["r1"] and got["good"].matched_requirements == [GOAL]
    assert "CASE_REQUIREMENT_TOO_GENERIC" in got["generic"].failure_reasons
    assert {"EMPTY_COVERED_REQUIREMENT_IDS", "COVERED_REQUIREMENTS_NOT_VISIBLE", "CASE_REQUIREMENT_NOT_LINKED_TO_OPERATOR_SEMANTICS"} <= set(got["other"].failure_reasons)
    assert got["unseen"].failure_reasons == ["COVERED_REQUIREMENTS_NOT_VISIBLE"]
    assert got["blind"].failure_reasons == ["CASE_EXPECTATION_NOT_LINKED_TO_BOUND_REQUIREMENT:r1", "CASE_EXPECTATION_NOT_LINKED_TO_REQUIREMENT"]
    assert got["wrong operator"].covered_requirement_ids == [] and "EMPTY_COVERED_REQUIREMENT_IDS" in got["wrong operator"].failure_reasons
    assert got["seed"].valid and got["seed"].covered_requirement_ids == ["r2"]


def test_visible_requirements_come_from_states_and_prompt(spark):
    rows = [("e", ["own", " "], {"format_constraints": '["f1", ""]', "must_not_assume": '"no list"'}, {"required_steps": '["s"]'}, f"x {evidence.HEAD}\n- a\nb\n\n{evidence.FOOT} c"), ("f", None, None, None, None)]
    df = spark.createDataFrame(rows, "env_id string, output_requirements array<string>, visible_state map<string,string>, task_state map<string,string>, user_prompt string")
    got = {r.env_id: r.visible_requirements for r in evidence.visible_requirements(df).collect()}
    assert got == {"e": ["own", "f1", "s", "a", "b"], "f": []}


def test_gaps_are_missing_or_weak(spark):
    asked = spark.createDataFrame([("e", f"r{k}", "Reject unknown bases", k != 4) for k in range(1, 5)] + [("e", "r5", "handle scaled input", True)], "env_id string, requirement_id string, text string, required_coverage boolean")
    bound = spark.createDataFrame([("e", "r1", True), ("e", "r1", False), ("e", "r2", False)], "env_id string, requirement_id string, passed boolean")
    assert {r.requirement_id: r.code for r in evidence.requirement_gaps(asked, bound).collect()} == {"r2": "REQUIREMENT_ID_HAS_WEAK_CASE_ONLY", "r3": "MISSING_REQUIREMENT_COVERAGE"}


def test_rules_mend_what_they_can(spark):
    ops = spark.createDataFrame([("e", "o1", "C", 1, GOAL, [], None)], OPS)
    rows = [case("seed_case_main", kind=None, call="f(1)", signature='{"return_value": "<a.B object at 0x1f>"}', text="handle scaled input"), case("k", call="x = 1", signature="nothing")]
    df = spark.createDataFrame(rows, CASES).withColumn("covered_requirement_ids", evidence.no_texts())
    got = {r.case_id: r for r in case_repair.rule_repaired(df, ops).collect()}
    a, b = got["seed_case_main"], got["k"]
    assert (a.case_kind, a.call_code, a.expected_output_signature, a.target_constraint) == ("scaled_seed_case_main", "result = f(1)", '{"return_value": "<B object>"}', GOAL)
    assert b.call_code == "x = 1\nresult = None" and b.expected_output_signature == "{}"


def test_rounds_broadcast_nothing_that_grows_with_environments(spark):
    """Small as they are here, all tables of a round are merged on the environment: none is collected by the driver."""
    table = lambda rows, columns: written(spark.createDataFrame(rows, columns), "t")
    ops = evidence.operator_texts(table([("e", "o1", "C", 1, GOAL, [GOAL], None)], OPS))
    asked = table([("e", "r1", 1, "o1", "C", GOAL)], "env_id string, requirement_id string, position int, operator_id string, axis string, text string")
    shown = table([("e", [GOAL])], "env_id string, visible_requirements array<string>")
    cases = table([case()], CASES).withColumn("covered_requirement_ids", evidence.no_texts())
    ruled = case_repair.rule_repaired(cases, ops)
    seen = constraints.validate_cases(ruled, ops, "env_id", asked, shown)
    failing = case_repair.failures(seen, asked, asked.select("env_id").distinct())
    again = case_repair.asked_again(seen, failing, adapters.MockClient({}), 1)
    for df in (ruled, seen, failing, again):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.case_id, r.valid) for r in seen.collect()] == [("c", True)]


def test_cases_are_shuffled_once_and_by_environment_alone(spark, sf):
    """Validation meets what an environment has in the rows of its cases: no exchange by case, and in the query none that holds the texts of cases."""
    exchanges = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    table = lambda rows, columns: written(spark.createDataFrame(rows, columns), "t")
    ops = evidence.operator_texts(table([("e", "o1", "C", 1, GOAL, [GOAL], None)], OPS))
    asked = table([("e", "r1", 1, "o1", "C", GOAL)], "env_id string, requirement_id string, position int, operator_id string, axis string, text string")
    shown = table([("e", [GOAL])], "env_id string, visible_requirements array<string>")
    found = exchanges(constraints.validate_cases(table([case()], CASES), ops, "env_id", asked, shown))
    assert 0 < len(found) <= 4 and not any("case_id" in x for x in found)
    plan = catalogue.QUERIES["case_validation"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("case_id" in x for x in exchanges(catalogue.QUERIES["case_validation"](spark, sf)))
    assert sum("RepartitionByExpression" in x for x in plan) == 4 and not any("Join LeftOuter" in x and "case_id" in x for x in plan)


def test_cases_of_one_id_are_judged_each_by_its_own_texts(spark):
    other = dict(text="Print coloured tables", covered=["Print coloured tables"], call="result = coloured()")
    asked = [("e", "r1", 1, "o1", "C", GOAL), ("e", "r2", 2, None, "seed", "Print coloured tables"), ("e", None, 3, None, "seed", GOAL), ("e", "r1", 4, "o2", "D", "Read gzip files")]
    ops = evidence.operator_texts(spark.createDataFrame([("e", "o1", "C", 1, GOAL, [GOAL], None)], OPS))
    shown = spark.createDataFrame([("e", [GOAL])], "env_id string, visible_requirements array<string>")
    known = spark.createDataFrame(asked, "env_id string, requirement_id string, position int, operator_id string, axis string, text string")
    df = spark.createDataFrame([case("c"), case("c", **other), case(None), case("named")], CASES)
    df = df.withColumn("covered_requirement_ids", F.when(F.col("case_id") == "named", F.array(F.lit("gone"), F.lit("r2"))).otherwise(evidence.no_texts()))
    got = constraints.validate_cases(df, ops, "env_id", known, shown).collect()
    ids = {(r.case_id, r.description): (r.covered_requirement_ids, r.matched_requirement_ids) for r in got}
    assert ids == {("c", GOAL): (["r1"], ["r1"]), ("c", other["text"]): (["r2"], ["r2"]), (None, GOAL): (["r1"], ["r1"]), ("named", GOAL): (["gone", "r2", "r1"], ["r1"])}
    wrong = next(r.failure_reasons for r in got if r.case_id == "named")
    assert wrong == ["UNKNOWN_REQUIREMENT_ID:gone", "CASE_REQUIREMENT_TEXT_MISMATCH:r2", "CASE_EXPECTATION_NOT_LINKED_TO_BOUND_REQUIREMENT:r2"]


def test_words_and_codes_keep_their_edges(spark):
    """Stops end no word, equal texts of a batch are read once, and nulls are texts of their own."""
    texts = ["See A.b/c.txt... and (op_x, op_y) v1.2.", "the new ... a.b. .c A", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(evidence.case_words(F.col("t")).alias("w"))
    assert [r.w for r in df.collect()] == [["see", "a.b/c.txt", "v1.2"], ["a.b", "c"], None, []]
    codes = spark.createDataFrame([(c,) for c in ["result = open('a/b.txt')", "x = 1", None, "result = (", "result = open('a/b.txt')"]], "c string").coalesce(1)
    got = codes.select(assigns_result("c").alias("r"), code_paths("c").alias("p"), flat_text(F.to_json(F.array("c"))).alias("f"), flat_text(F.lit(None).cast("string")).alias("n")).collect()
    assert [(r.r, r.p) for r in got] == [(True, ["a/b.txt"]), (False, []), (False, []), (False, []), (True, ["a/b.txt"])]
    assert [r.f for r in got] == ["result = open('a/b.txt')", "x = 1", "", "result = (", "result = open('a/b.txt')"] and all(r.n == "" for r in got)


def test_staged_runs_repair_in_rounds(spark, tmp_path):
    """A model that spoils a case first and mends it at its second try; one environment is never mended."""
    client, asked = gold_client(), []

    def repair(c):
        asked.append(1)
        if c["attempt"] < 2 or c["env_id"].endswith("m4"):
            return {"cases": [x | {"call_code": ""} for x in c["cases"]]}
        return {"cases": [x | {"call_code": "result = f(2)", "description": x["description"] + " f 2"} for x in c["cases"]]}

    client.builders["oracle_case_repair"] = repair
    run = Run(spark, str(tmp_path / "run"), client)
    real = run.repaired
    run.repaired = lambda drafts, *rest: real(drafts.withColumn("call_code", F.when(F.col("level").isin("M3", "M4"), "").otherwise(F.col("call_code"))), *rest)
    out = run.all(raw(spark, 1))
    levels = out["drafts"].select("env_id", "level")
    got = {(r.level, r.repairs, r.valid) for r in out["cases"].join(levels, "env_id").select("level", "repairs", "valid").distinct().collect()}
    assert got == {("M1", 0, True), ("M2", 0, True), ("M3", 2, True), ("M4", 3, False)}
    assert run.table("repair/cases-1-failures").count() == 2 and run.table("repair/cases-2-failures").count() == 1
    again = Run(spark, str(tmp_path / "run"), client)
    again.all(raw(spark, 1))
    assert again.ran == []


def test_strict_runs_keep_what_is_realized(spark, tmp_path):
    client = gold_client()
    client.builders["scaled_gold"] = lambda c: {"code": c["seed_code"].replace("return", "out =") + "\n    return out"}
    out = Run(spark, str(tmp_path / "strict"), client, strict=True).all(raw(spark, 2))
    assert out["realization"].where("severity = 'hard_fail'").count() == 0 and out["realization"].where("not exposed and axis <> 'V'").count() == 0
    assert out["envs"].where("export_status <> 'clean'").count() == 0
    prompt = out["envs"].where("level = 'M4'").first().user_prompt
    assert prompt.startswith("Task ID: ") and evidence.HEAD in prompt and evidence.FOOT in prompt and "Problem:\n" in prompt


def plain_requirements(visible, task, asked):
    items = [str(x) for k in prompts.VISIBLE_ENTRIES for x in (visible.get(k) if isinstance(visible.get(k), list) else [visible[k]] if visible.get(k) else []) if str(x).strip()]
    items += [str(x) for k in prompts.TASK_ENTRIES if isinstance(task.get(k), list) for x in task[k] if str(x).strip()]
    items += [str(visible[prompts.TRAP_ENTRY])] if visible.get(prompts.TRAP_ENTRY) else []
    if asked:
        items = [x for x in items if not any(p in x.lower() for p in prompts.PROMPT_PHRASES)] + asked
    seen = {}
    for x in items:
        seen.setdefault(" ".join(x.lower().split()), x)
    return list(seen.values())


def test_prompts_collect_in_order(spark):
    visible = {"must_not_assume": ["No names"], "constraint_hints": ["Keep  order", "", "keep order"], "output_constraints": "One line", "robustness_trap": "Names mislead", "implicit_clues": [], "format_constraints": ["handle scaled input now"]}
    task = {"extra_constraints": ["Limit memory"], "required_steps": "not a list"}
    rows = [("e", {k: json.dumps(v) for k, v in visible.items()}, {k: json.dumps(v) for k, v in task.items()}), ("f", {"constraint_hints": '["handle scaled input now"]'}, {})]
    envs = spark.createDataFrame(rows, "env_id string, visible_state map<string,string>, task_state map<string,string>")
    ops = spark.createDataFrame([("e", "o2", "C", 2, "The solution must  sort records quickly", ["Limit memory"], None), ("e", "o1", "C", 1, "Verify that unknown bases are rejected", [], None)], OPS)
    cases = spark.createDataFrame([case("b", target="o1, o2", text="Check gzip archives thoroughly", covered=["Mention unknown alphabets"]), case("a", target="", text="x" * 330 + " unknown bases", covered=[])], CASES)
    got = {r.env_id: r.requirements for r in prompts.requirements_of(envs, ops, cases).collect()}
    long = "x" * 317 + "..."
    first = ["Check gzip archives thoroughly", "Mention unknown alphabets", "unknown bases are rejected"]
    assert got["e"] == plain_requirements(visible, task, [*first, "The solution must sort records quickly"]) and long not in got["e"]
    assert got["f"] == plain_requirements({"constraint_hints": ["handle scaled input now"]}, {}, [])


def test_tool_section_and_exposure(spark):
    tools = F.array(F.struct(F.lit("run").alias("name"), F.array(F.lit("code"), F.lit("limit")).alias("arguments"), F.lit("Runs code.").alias("description"), F.lit("testing").alias("when")))
    text = spark.range(1).select(prompts.tool_section(tools, F.lit(3), F.create_map(F.lit("run"), F.lit(2))).alias("t")).first().t
    assert text == "Only the following tools may be used:\n1. run(code, limit)\n   Runs code.\n   Use when: testing\n\nTool budget:\n- max total tool calls: 3\n- run: 2\n\n"
    ops = spark.createDataFrame([("e", "o1", "C", 1, GOAL, [], [("visible", "k", '["alphabets listed"]')]), ("e", "o2", "D", 2, "Read gzip archives", [], None), ("f", "o1", "C", 1, "the and", [], None), ("g", "o1", "C", 1, GOAL, [], None)], OPS)
    envs = spark.createDataFrame(
        [("e", f"{evidence.HEAD}\n- unknown alphabets\n\nOutput requirement:\n- gzip archives", "gzip"), ("f", "anything", ""), ("g", "sequences bases", "sequences")], "env_id string, user_prompt string, seed_text string"
    )
    none = spark.createDataFrame([], CASES)
    got = {(r.env_id, r.operator_id): r.exposed for r in prompts.exposures(ops, none, envs).collect()}
    assert got == {("e", "o1"): True, ("e", "o2"): False, ("f", "o1"): False, ("g", "o1"): False}


def test_cases_take_their_rows_to_operators(spark):
    """The rows of ``linked_cases`` joined to their cases again, also where ids repeat or are null, targets are lists and an operator has two axes."""
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    cases = [(pick("e", "f", None), pick("c1", "c2", "c3", None), pick("o1", "o2,o1", " o2 ,o2", "", " ", None, "gone"), pick("C", "D", None), k) for k in range(60)]
    ops = [(pick("e", "f", "g"), pick("o1", "o2", "o3"), pick("C", "D", None)) for _ in range(12)]
    c = spark.createDataFrame(cases, "env_id string, case_id string, targets string, axis string, n int")
    o = spark.createDataFrame(ops, "env_id string, operator_id string, axis string")
    plain = rubrics.linked_cases(o, c).select("env_id", "operator_id", "case_id").join(c.select("env_id", "case_id", "n"), ["env_id", "case_id"])
    want = {(r.env_id, r.operator_id): sorted(r.n) for r in plain.groupBy("env_id", "operator_id").agg(F.collect_list("n").alias("n")).collect()}
    got = {(r.env_id, r.operator_id): sorted(r.rows) for r in rubrics.linked_rows(o, c, F.col("n")).collect()}
    assert got == want and len(got) > 3


def test_prompts_and_exposures_read_cases_once(spark):
    table = lambda rows, columns: written(spark.createDataFrame(rows, columns), "t")
    ops, cases = table([("e", "o1", "C", 1, GOAL, [GOAL], None)], OPS), table([case()], CASES)
    envs = table([("e", {"constraint_hints": '["Keep the order of bases"]', "implicit_clues": None}, {"required_steps": '["Read all sequences"]'}, f"x {evidence.HEAD}\n- {GOAL}\n", "seed")], "env_id string, visible_state map<string,string>, task_state map<string,string>, user_prompt string, seed_text string")
    asked, shown = prompts.requirements_of(envs, ops, cases), prompts.exposures(ops, cases, envs)
    for df in (asked, shown):
        assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 4  # environments, operators twice, cases
    assert asked.first().requirements == ["Keep the order of bases", "Read all sequences", GOAL] and shown.first().exposed
    texts = [" Verify  that  verify x", "The  solution must go", "therefore", "Handle Scaled Input now", " \n", "", "increase data complexity by adding y", None, "z" * 400]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.get(prompts.told_texts(F.array("t")), 0).alias("t")).collect()]
    assert got == ["x", "The solution must go", "therefore", "Handle Scaled Input now", "", "", "Add y", "", "z" * 317 + "..."]
    assert [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(prompts.says_nothing(F.col("t")).alias("s")).collect()] == [False, False, False, True, True, True, False, None, False]

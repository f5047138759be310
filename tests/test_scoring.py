import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import rubrics, scoring, summaries

SCHEMA = (
    "env_id string, level string, compile_passed boolean, execution_passed boolean, passed_cases int, total_cases int, failure_reasons array<string>, case_reports array<string>, "
    "notes array<string>, tool_trace array<struct<tool_name:string,budget_violation:boolean,result:string,budget_error:string>>, rubric_score double"
)


def rollout(**k):
    base = dict(env_id="e", level="M2", compile_passed=True, execution_passed=True, passed_cases=2, total_cases=2, failure_reasons=[], case_reports=[], notes=[], tool_trace=[], rubric_score=None)
    return tuple((base | k).values())


def reward(spark, use_rubric=False, **k):
    return scoring.with_reward(spark.createDataFrame([rollout(**k)], SCHEMA), use_rubric).first()


@pytest.mark.parametrize(
    "fields, rubric, want",
    [
        (dict(execution_passed=False, passed_cases=1, total_cases=2), False, 0.35),
        (dict(execution_passed=False, passed_cases=1, total_cases=2, rubric_score=0.75), True, 0.65),
        (dict(), False, 1.7),
        (dict(tool_trace=[("t", True, None, None)] * 2), False, 1.4),
        (dict(tool_trace=[("t", True, None, None)] * 9), False, 1.3),
        (dict(execution_passed=False, compile_passed=False, passed_cases=0, total_cases=0, failure_reasons=[scoring.NO_SUBMIT]), False, -0.2),
        (dict(execution_passed=False, passed_cases=0, total_cases=2, case_reports=['{"stderr": "Traceback ..."}']), False, 0.0),
        (dict(execution_passed=None, compile_passed=None, passed_cases=None, total_cases=None, failure_reasons=None, case_reports=None, notes=None, tool_trace=None), False, 0.0),
    ],
)
def test_reward(spark, fields, rubric, want):
    assert reward(spark, rubric, **fields).reward == pytest.approx(want)


def test_budget_violations_from_notes_and_results(spark):
    assert reward(spark, notes=["TOOL_BUDGET exceeded"]).tool_budget_violation_count == 1
    trace = [("t", None, '{"error": "TOOL_BUDGET_EXHAUSTED"}', None), ("t", None, None, "tool_budget_exceeded"), ("t", False, "fine", None)]
    r = reward(spark, tool_trace=trace, notes=["tool_budget"])
    assert r.tool_budget_violation_count == 2 and not r.budget_ok


def test_advantages_have_mean_0_and_deviation_1(spark):
    rng = np.random.default_rng(0)
    rows = [(f"g{i % 7}", float(rng.normal())) for i in range(200)] + [("flat", 0.5)] * 4 + [(None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "group_id string, reward double")
    got = scoring.group_advantages(df, ["group_id"]).toPandas()
    assert len(got) == len(rows)
    for g, x in got.groupby("group_id"):
        if g == "flat":
            assert (x.advantage == 0).all()
        else:
            assert abs(x.advantage.mean()) < 1e-9 and abs(x.advantage.std(ddof=0) - 1) < 1e-9
    other = df.withColumn("advantage", scoring.window_advantage("reward", ["group_id"])).toPandas()
    assert np.allclose(sorted(got.advantage), sorted(other.advantage))
    assert sorted(got[got.group_id.isna()].advantage) == [-1, 1]


def test_agent_summary_penalises_rows_without_cases(spark):
    rows = [
        rollout(env_id="a", passed_cases=3, total_cases=4, execution_passed=True),
        rollout(env_id="b", passed_cases=0, total_cases=0, execution_passed=False, failure_reasons=[scoring.NO_SUBMIT]),
        rollout(env_id="c", passed_cases=0, total_cases=0, execution_passed=False, level=None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("scored_rubrics", F.lit(0))
    got = {r.level: r for r in summaries.agent_summary(df).collect()}
    assert round(got[None].sample_pass_rate, 4) == 0.3333 and got[None].case_pass_rate == 0.5 and got[None].case_pass_rate_nonzero_only == 0.75
    assert got["M2"].case_pass_rate == pytest.approx(0.6) and got["M2"].no_final_code_samples == 1 and "unknown" in got
    assert summaries.agent_summary(df.limit(0)).count() <= 1


def test_rubric_scores_and_weights(spark):
    rub = spark.createDataFrame([("e", "r1", "core", 2.0, ["c1", "c2"]), ("e", "r2", "edge", 1.0, ["c1"]), ("e", "r3", "edge", 1.0, []), ("e", "r4", "core", 2.0, ["gone"])], "env_id string, rubric_id string, category string, weight double, covered_by_cases array<string>")
    rep = spark.createDataFrame([("e", "c1", True), ("e", "c2", False)], "env_id string, case_id string, passed boolean")
    scored = scoring.rubric_scores(rub, rep)
    got = {r.rubric_id: r.score for r in scored.collect()}
    assert got == {"r1": 0.5, "r2": 1.0, "r3": None, "r4": 0.0}
    total = {r.category: r.weighted_score for r in scoring.weighted_score(scored.where("score is not null"), "score", "weight", "category").collect()}
    assert total[None] == pytest.approx(2 / 5) and total["edge"] == 1.0 and total["core"] == pytest.approx(0.25)


def test_requirement_rubrics(spark):
    req = spark.createDataFrame(
        [("e", "r1", "Keep the original seed behavior."), ("e", "r2", "Print the  TABLE to stdout"), ("e", "r3", "Return type is dict"), ("e", "r4", "Handle empty input")],
        "env_id string, requirement_id string, text string",
    )
    cases = spark.createDataFrame(
        [("e", "c1", 1, ["r4"], ["nothing"]), ("e", "c2", 2, [], ["please print the table to stdout, now"]), ("f", "c3", 3, ["r1"], [])],
        "env_id string, case_id string, position int, covered_requirement_ids array<string>, covered_requirements array<string>",
    )
    got = {r.requirement_id: r for r in rubrics.requirement_rubrics(req, cases).collect()}
    assert [(got[k].category, got[k].weight) for k in ("r1", "r2", "r3", "r4")] == [("seed_behavior", 2.0), ("output_format", 1.5), ("runtime_contract", 1.0), ("scaled_requirement", 2.0)]
    assert got["r4"].covered_by_cases == ["c1"] and got["r2"].covered_by_cases == ["c2"] and got["r1"].evidence_type == "uncovered"


def test_requirements_match(spark):
    pairs = [("Mutating the matrix fails", "modify matrix rows"), ("", "x"), ("the output", "a value"), ("Sort rows by score", "rows sorted somehow"), ("validate checks", "it validates tests")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.m for r in df.select(rubrics.requirements_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, False, False, True]


def test_numbering_and_links(spark):
    req = spark.createDataFrame([("e", "D", 2), ("e", "D", 1), ("e", "", 3), ("e", "C-x", 1)], "env_id string, axis string, position int")
    assert {r.requirement_id for r in rubrics.number_requirements(req).collect()} == {"req_d_001", "req_d_002", "req_global_001", "req_c_x_001"}
    ops = spark.createDataFrame([("e", "o1", "D"), ("e", "o2", "C")], "env_id string, operator_id string, axis string")
    cases = spark.createDataFrame([("e", "c1", "o1, o2", "D"), ("e", "c2", "", "C"), ("e", "c3", None, "D")], "env_id string, case_id string, targets string, axis string")
    assert {(r.operator_id, r.case_id) for r in rubrics.linked_cases(ops, cases).collect()} == {("o1", "c1"), ("o2", "c1"), ("o2", "c2"), ("o1", "c3")}
    cov = rubrics.operator_coverage(ops, cases.withColumn("axis", F.lit("D,C"))).first()
    assert cov.covered == ["o1", "o2"] and cov.missing == []


def test_coverage_ladder(spark):
    req = spark.createDataFrame([("e", k) for k in "abcd"], "env_id string, requirement_id string")
    links = spark.createDataFrame([("e", "b", "1", False), ("e", "c", "2", True), ("e", "d", "3", True)], "env_id string, requirement_id string, case_id string, matches boolean")
    rep = spark.createDataFrame([("e", "2", False), ("e", "3", True)], "env_id string, case_id string, passed boolean")
    got = {r.requirement_id: r.status for r in rubrics.coverage_matrix(req, links, rep).collect()}
    assert got == {"a": "missing_case", "b": "case_mismatch", "c": "gold_failed", "d": "pass"}


def test_reports(spark):
    s = spark.createDataFrame([("t1", None, True, True, True), ("t1", "BAD", False, False, None)], "sample_type string, reject_reason string, accepted boolean, uses_tool boolean, oracle_passed boolean")
    assert max(r.samples for r in summaries.sample_quality(s).collect()) == 2
    f = spark.createDataFrame([("e", 1, "x" * 10), ("e", 2, "y" * 70_000), ("e", 3, "z")], "env_id string, position int, content string")
    assert [r.fits for r in summaries.file_budget(f).orderBy("position").collect()] == [True, False, True]
    v = spark.createDataFrame([(True, False), (True, True), (False, False), (None, None)], "accepted boolean, repair_succeeded boolean")
    assert tuple(summaries.validation_counts(v).first()) == (4, 2, 2, 1, 1)
    assert summaries.sum_summaries(summaries.validation_counts(v).unionByName(summaries.validation_counts(v))).first().input == 8
    p = spark.createDataFrame([(0.9, 0.4), (0.5, 0.5)], "chosen_score double, rejected_score double")
    assert summaries.preference_margin(p).first().mean_margin == pytest.approx(0.25)


def test_keyword_scores(spark):
    from gradeloom.operators import rubrics

    rows = [("a", "Use the parser, validate headers!", "The PARSER ran.", 2.0), ("a", "what is a to", "anything", 1.0), ("b", "alpha beta gamma delta epsilon zeta", "alpha, beta", 1.0), ("b", "alpha beta gamma delta", "alpha beta", 0.5), ("c", "", "x", 0.0)]
    got = {r.env_id: r for r in rubrics.keyword_scores(spark.createDataFrame(rows, "env_id string, criterion string, answer string, weight double"), ["env_id"]).collect()}
    assert (got["a"].score, got["a"].passed) == (2.0 / 3.0, 1)  # a criterion without keywords is never met
    assert (got["b"].score, got["b"].passed) == (0.5 / 1.5, 1) and got["c"].score == 0.0

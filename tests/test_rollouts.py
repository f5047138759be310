import pytest
from pyspark.sql import functions as F

from gradeloom.operators import rollouts


def test_completions_are_scored_or_penalised(spark):
    envs = spark.createDataFrame([("e", "result = f(1)", '{"return_value": {"v": 2}}')], "env_id string, call_code string, expected_output string")
    rows = [
        (1, "e", "```python\ndef f(x):\n    return {'v': x + 1}\n```"), (2, "e", "def f(x): return {'v': 0}"), (3, "e", "def f(x): return 1/0"), (4, "e", "  "), (5, "gone", "def f(x): return 1"),
        (6, "e", '{"final_code": "def f(x): return {\'v\': 2.0}"}'),
    ]
    got = {r.completion_id: r.reward for r in rollouts.score_completions(spark.createDataFrame(rows, "completion_id int, env_id string, completion string"), envs).collect()}
    assert got == pytest.approx({1: 1.7, 2: 0.1, 3: 0.1, 4: -0.1, 5: -0.2, 6: 1.7})


def test_pending_and_reward_table(spark):
    envs = spark.createDataFrame([("a",), ("b",)], "env_id string")
    done = spark.createDataFrame([("a_r000",)], "rollout_id string")
    assert rollouts.pending_rollouts(envs, done, 2).count() == 3
    schema = "rollout_id string, group_id string, position int, execution_passed boolean, compile_passed boolean, passed_cases int, total_cases int, failure_reasons array<string>, case_reports array<string>, notes array<string>, tool_trace array<struct<budget_violation:boolean,result:string,budget_error:string>>"
    rows = [("r1", "g", 1, False, True, 0, 1, [], [], [], []), ("r2", "g", 2, False, True, 0, 1, [], [], [], []), ("r1", "g", 3, True, True, 1, 1, [], [], [], [])]
    got = {r.rollout_id: (r.position, round(r.reward, 6), round(r.advantage, 6)) for r in rollouts.reward_table(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"r1": (1, 1.7, 1.0), "r2": (2, 0.1, -1.0)}
    a = spark.range(1).select(rollouts.merged_guidance(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y")), F.array(F.lit("d"))).alias("m"), rollouts.merged_guidance(F.lit(None), F.lit(None), F.array(F.lit("d"))).alias("n")).first()
    assert a.m == ["x", "y"] and a.n == ["d"]

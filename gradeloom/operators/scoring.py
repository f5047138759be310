"""Rewards, group advantages and rubric scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import rate

#: Reason of a run that ended without a valid submission.
NO_SUBMIT = "MAX_TURNS_WITHOUT_VALID_FINAL_CODE"
RUNTIME_MARKS = "runtime|traceback|exception|timeout"
BUDGET_MARKS = "tool_budget_exhausted|tool_budget_exceeded"


@dataclass(frozen=True)
class RewardWeights:
    sample_pass: float = 1.0
    case_rate: float = 0.5
    rubric: float = 0.4
    valid_submit: float = 0.1
    within_budget: float = 0.1
    no_submit: float = 0.2
    runtime_error: float = 0.1
    budget: float = 0.1
    budget_cap: int = 3


def one(flag: Column) -> Column:
    return F.when(flag, 1.0).otherwise(0.0)


def reward_value(
    sample_pass: Column, case_rate: Column, valid_submit: Column, no_submit: Column, runtime_error: Column, violations: Column, rubric: Column | None = None, w: RewardWeights = RewardWeights()
) -> Column:
    """The weighted sum, unrounded. ``rubric`` null: rubrics don't count."""
    total = (
        w.sample_pass * one(sample_pass)
        + w.case_rate * case_rate
        + w.valid_submit * one(valid_submit)
        + w.within_budget * one(sample_pass & (violations == 0))
        - w.no_submit * one(no_submit)
        - w.runtime_error * one(runtime_error)
        - w.budget * F.least(violations, F.lit(w.budget_cap))
    )
    return total if rubric is None else total + w.rubric * rubric


def runtime_error(reasons: Column, case_reports: Column) -> Column:
    """A mark of a runtime failure in a reason or in a case report (JSON text)."""
    bad = lambda x: F.lower(x).rlike(RUNTIME_MARKS)
    return F.coalesce(F.exists(reasons, bad), F.lit(False)) | F.coalesce(F.exists(case_reports, bad), F.lit(False))


def budget_violations(notes: Column, events: Column) -> Column:
    """Violations in a trace's events (``budget_violation``, ``result``, ``budget_error``); at least one if a note tells of one."""
    noted = F.coalesce(F.exists(notes, lambda n: F.lower(n).contains("tool_budget")), F.lit(False)).cast("int")
    over = lambda e: (
        F.coalesce(e["budget_violation"], F.lit(False))
        | F.lower(F.coalesce(e["result"], F.lit(""))).rlike(BUDGET_MARKS)
        | F.lower(F.coalesce(e["budget_error"], F.lit(""))).contains("tool_budget_exceeded")
    )
    return F.greatest(noted, F.coalesce(F.size(F.filter(events, over)), F.lit(0)))


def with_reward(rollouts: DataFrame, use_rubric: bool = False, weights: RewardWeights = RewardWeights()) -> DataFrame:
    """Reward columns for evaluation rows.

    Reads ``execution_passed``, ``compile_passed``, ``passed_cases``, ``total_cases``, ``failure_reasons``, ``case_reports`` (array of JSON text), ``notes``,
    ``tool_trace`` and, with ``use_rubric``, ``rubric_score``. Nulls count as false, 0 or empty.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = rollouts.withColumns(
        {
            "case_pass_rate": F.when(zero("total_cases") > 0, rate(zero("passed_cases"), zero("total_cases"))).otherwise(0.0),
            "sample_pass": true("execution_passed") & (zero("total_cases") > 0),
            "valid_submit": (zero("total_cases") > 0) | true("compile_passed"),
            "no_submit": F.coalesce(F.array_contains("failure_reasons", NO_SUBMIT), F.lit(False)),
            "runtime_error": runtime_error(F.col("failure_reasons"), F.col("case_reports")),
            "tool_budget_violation_count": budget_violations(F.col("notes"), F.col("tool_trace")),
        }
    )
    value = reward_value(
        F.col("sample_pass"),
        F.col("case_pass_rate"),
        F.col("valid_submit"),
        F.col("no_submit"),
        F.col("runtime_error"),
        F.col("tool_budget_violation_count"),
        F.coalesce(F.col("rubric_score"), F.lit(0.0)) if use_rubric else None,
        weights,
    )
    over = F.col("tool_budget_violation_count") > 0
    return df.withColumns({"reward": value, "tool_budget_violation": over, "budget_ok": ~over})


def group_advantages(rewards: DataFrame, group: list[str], reward: str = "reward", least: float = 1e-8) -> DataFrame:
    """Each row's distance from its group's mean in population deviations; 0 where the deviation is at most ``least``.

    The group's moments are aggregated before they meet the rows, so a large group isn't sorted or held in one task."""
    moments = rewards.groupBy(*group).agg(F.avg(reward).alias("group_reward_mean"), F.stddev_pop(reward).alias("group_reward_std"))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"m.{g}")) for g in group]
    joined = rewards.alias("r").join(moments.alias("m"), same)
    off = F.when(F.col("m.group_reward_std") > least, (F.col(f"r.{reward}") - F.col("m.group_reward_mean")) / F.col("m.group_reward_std")).otherwise(0.0)
    return joined.select("r.*", "m.group_reward_mean", "m.group_reward_std", off.alias("advantage"))


def window_advantage(reward: str, group: list[str], least: float = 1e-8) -> Column:
    """The same in one window, for groups that are small by design (rollouts of an environment)."""
    w = Window.partitionBy(*group)
    mean, spread = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    return F.when(spread > least, (F.col(reward) - mean) / spread).otherwise(0.0)


def attach_rewards(rollouts: DataFrame, rewards: DataFrame) -> DataFrame:
    """Rollouts with their reward row as a struct ``reward_row`` (null without one); a rollout_id's last reward counts."""
    return rollouts.join(rewards.select("rollout_id", F.struct(*(c for c in rewards.columns if c != "rollout_id")).alias("reward_row")), "rollout_id", "left")


def missing_reward(value: Column, penalty: float = -0.2) -> Column:
    """Reward of a completion whose environment is unknown."""
    return F.coalesce(value, F.lit(penalty))


def weighted_score(rows: DataFrame, score: str, weight: str, category: str, by: list[str] = []) -> DataFrame:
    """Sum(score x weight) / sum(weight) overall (category null) and per category."""
    view = rows.withColumn("__sw", F.col(score) * F.col(weight)).withColumn("__w", F.col(weight).cast("double"))
    agg = [F.sum("__sw").alias("sw"), F.sum("__w").alias("w"), F.count("*").alias("scored")]
    sets = [[F.col(c) for c in [*by, category]], [F.col(c) for c in by]]
    out = view.groupingSets(sets, *(F.col(c) for c in [*by, category])).agg(*agg)
    return out.select(*by, category, rate(F.col("sw"), F.col("w")).alias("weighted_score"), F.col("w").alias("total_weight"), "scored")


def rubric_scores(rubrics: DataFrame, reports: DataFrame, env: str = "env_id") -> DataFrame:
    """Each rubric's score: the share of its cases that passed, a case without report failing; null without cases.

    ``rubrics``: env, ``rubric_id``, ``category``, ``weight``, ``covered_by_cases``; ``reports``: env, ``case_id``, ``passed``.
    """
    cases = rubrics.select(env, "rubric_id", F.explode_outer("covered_by_cases").alias("case_id"))
    passed = reports.groupBy(env, "case_id").agg(F.max_by("passed", F.coalesce("passed", F.lit(False))).alias("passed"))
    per = (
        cases.join(passed, [env, "case_id"], "left")
        .groupBy(env, "rubric_id")
        .agg(F.avg(F.when(F.col("case_id").isNotNull(), F.when(F.coalesce("passed", F.lit(False)), 1.0).otherwise(0.0))).alias("score"))
    )
    return rubrics.join(per, [env, "rubric_id"], "left")

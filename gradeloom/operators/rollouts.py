"""Rollouts to rewards: collecting, resuming, scoring completions, attaching advantages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.values import values_match
from gradeloom.operators import adapters, episodes, scoring, upserts

NONE = "array<string>"


def pending_rollouts(envs: DataFrame, done: DataFrame, k: int) -> DataFrame:
    """The environments' rollouts, ``k`` each, that have no finished row."""
    return upserts.pending(episodes.rollouts(envs, k), done, ["rollout_id"])


def score_completions(completions: DataFrame, envs: DataFrame, penalty: float = -0.2, weights: scoring.RewardWeights = scoring.RewardWeights()) -> DataFrame:
    """Rewards of model completions (``completion_id``, ``env_id``, ``completion``) against their environment (``env_id``, ``call_code``, ``expected_output``).

    The code of a completion runs in a child process; a completion of an unknown environment gets ``penalty``."""
    known = envs.select("env_id", "call_code", "expected_output", F.lit(True).alias("__known"))
    df = completions.join(known, "env_id", "left").withColumn("code", T.completion_code("completion"))
    cases = df.where("__known and code <> ''").select("completion_id", "code", F.lit("").alias("setup_code"), "call_code")
    ran = adapters.execute(cases, ["completion_id"]).select("completion_id", "ok", "error", "output")
    both = df.join(ran, "completion_id", "left")
    value = lambda c: F.to_json(F.struct(F.try_element_at(F.from_json(c, "map<string,variant>"), F.lit("return_value")).alias("v")))
    same = values_match(value("output"), value("expected_output"))
    passed = F.coalesce("ok", F.lit(False)) & same
    rows = both.withColumn("__passed", passed).withColumns(
        {
            "execution_passed": F.col("__passed"),
            "compile_passed": F.col("code") != "",
            "passed_cases": F.col("__passed").cast("int"),
            "total_cases": F.lit(1),
            "failure_reasons": F.when(F.col("code") == "", F.array(F.lit(scoring.NO_SUBMIT))).otherwise(F.array().cast(NONE)),
            "case_reports": F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast(NONE)),
            "notes": F.array().cast(NONE),
            "tool_trace": F.array().cast("array<struct<budget_violation:boolean,result:string,budget_error:string>>"),
        }
    )
    scored = scoring.with_reward(rows, weights=weights)
    return scored.select("completion_id", "env_id", "execution_passed", scoring.missing_reward(F.when(F.col("__known"), F.col("reward")), penalty).alias("reward"))


def reward_table(rollouts: DataFrame, use_rubric: bool = False) -> DataFrame:
    """Reward rows of rollouts, the last of each ``rollout_id`` at its first place, with advantages in their ``group_id``."""
    once = upserts.keep_last_at_first(rollouts, ["rollout_id"], "position")
    return scoring.group_advantages(scoring.with_reward(once, use_rubric), ["group_id"])


def merged_guidance(primary, secondary, default):
    """Guidance of the primary, then the secondary domains, else the default; each once, in order."""
    own = F.array_distinct(F.concat(F.coalesce(primary, F.array().cast(NONE)), F.coalesce(secondary, F.array().cast(NONE))))
    return F.when(F.size(own) > 0, own).otherwise(default)

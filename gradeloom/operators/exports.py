"""Training and evaluation views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.text import digest12


def message(role: str, content: Column) -> Column:
    return F.when(F.coalesce(content, F.lit("")) != "", F.struct(F.lit(role).alias("role"), content.alias("content")))


def chat(*messages: Column) -> Column:
    """Messages that have content, in order."""
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def sft_samples(envs: DataFrame) -> DataFrame:
    return envs.select("env_id", chat(message("system", F.lit("Solve the task with executable code.")), message("user", F.col("user_prompt")), message("assistant", F.col("gold_solution"))).alias("messages"))


def preference_samples(pairs: DataFrame, margin: float = 0.35) -> DataFrame:
    """``chosen_score`` above ``rejected_score``: where it isn't, it is lifted to the rejected one plus ``margin``, at most 1."""
    lifted = F.when(F.col("chosen_score") <= F.col("rejected_score"), F.least(F.lit(1.0), F.col("rejected_score") + margin)).otherwise(F.col("chosen_score"))
    return pairs.withColumn("chosen_score", lifted).withColumn("margin", F.col("chosen_score") - F.col("rejected_score"))


def process_samples(envs: DataFrame, steps: str = "steps") -> DataFrame:
    """A row per step with its number from 1."""
    return envs.select("env_id", F.posexplode(steps).alias("pos", "step")).select("env_id", (F.col("pos") + 1).alias("step_id"), "step")


def rl_environments(envs: DataFrame) -> DataFrame:
    return envs.select("env_id", "level", "user_prompt", (F.col("max_total_tool_calls") + 1).alias("max_steps"))


def prompt_rows(envs: DataFrame, cases: str = "cases") -> DataFrame:
    """Prompts of environments that have cases to grade with."""
    return envs.where(F.size(cases) > 0).select("env_id", "level", "user_prompt", F.size(cases).alias("evaluation_cases"))


def sample_id(env: Column, kind: Column, code: Column) -> Column:
    return F.concat_ws("_", env, kind, F.substring(F.md5(F.coalesce(code, F.lit("")).cast("binary")), 1, 16))


def tool_samples(runs: DataFrame, least_score: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected samples of tool runs (``env_id``, ``sample_type``, ``final_code``, ``execution_passed``, ``used_tools``, ``rubric_score``)."""
    why = (
        F.when(F.trim(F.coalesce("final_code", F.lit(""))) == "", "NO_FINAL_CODE")
        .when(~F.coalesce("execution_passed", F.lit(False)), "ORACLE_FAILED")
        .when(F.size("used_tools") == 0, "NO_TOOL_USED")
        .when(F.coalesce("rubric_score", F.lit(0.0)) < least_score, "LOW_RUBRIC_SCORE")
    )
    df = runs.withColumn("reject_reason", why).withColumn("sample_id", sample_id(F.col("env_id"), F.col("sample_type"), F.col("final_code")))
    return df.where("reject_reason is null").drop("reject_reason"), df.where("reject_reason is not null")


def question_points(envs: DataFrame) -> DataFrame:
    """Points to grade of each environment: one for the code, one per requirement."""
    one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    points = F.concat(F.array(one("executable_code", F.lit("The code runs and passes its cases."))), F.transform("output_requirements", lambda r: one("requirement", r)))
    return envs.select("env_id", F.posexplode(points).alias("pos", "p")).select("env_id", F.format_string("%s_qp_%02d", "env_id", F.col("pos") + 1).alias("point_id"), "p.kind", F.col("p.text").alias("text"))


def rubrics_of_points(points: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("env_id").orderBy("point_id"))
    return points.withColumn("rubric_id", F.format_string("%s_rubric_%02d", "env_id", n))


def training_bundle(envs: DataFrame, points: DataFrame, rubrics: DataFrame) -> DataFrame:
    """Environments with their points and rubrics as arrays; both are gathered per environment before they meet it."""
    nest = lambda df, name: df.groupBy("env_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != "env_id")))).alias(name))
    return envs.join(nest(points, "question_points"), "env_id", "left").join(nest(rubrics, "rubrics"), "env_id", "left")


def completed_rows(runs: DataFrame, traces: DataFrame, evals: DataFrame, checkpoint: DataFrame, key: str = "env_id") -> DataFrame:
    """Environments with run, trace and evaluation as structs; a checkpoint row takes the place of what the tables hold."""
    pack = lambda df, name: df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name))
    base = pack(runs, "run").join(pack(traces, "trace"), key).join(pack(evals, "eval"), key)
    other = checkpoint.select(key, *(F.col(c).alias(f"__{c}") for c in ("run", "trace", "eval")))
    both = base.join(other, key, "full_outer")
    return both.select(key, *(F.coalesce(f"__{c}", c).alias(c) for c in ("run", "trace", "eval")))


def hidden_test_ids(tests: DataFrame) -> DataFrame:
    """Semantic hidden tests per environment: their number and ids."""
    kind = F.coalesce("kind", F.lit(""))
    semantic = kind.isin("semantic", "data_variant_case", "constraint_boundary_case", "anti_shortcut_case", "semantic_coverage_case")
    return tests.groupBy("env_id").agg(F.count_if(semantic).alias("semantic_tests"), F.array_sort(F.collect_list(F.when(semantic, F.col("test_id")))).alias("test_ids"))


def verifier_delta(operators: DataFrame, lists: list[str]) -> DataFrame:
    """List columns of an environment's operators, one after the other in their order."""
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(c).alias("v")))), lambda x: x["v"])).alias(c)
    return operators.groupBy("env_id").agg(*(flat(c) for c in lists))


def logged_call(name: Column, code: Column) -> Column:
    """What a log keeps of a tool call."""
    return F.struct(name.alias("tool_name"), digest12(code).alias("sha256"), F.length(code).alias("chars"))


def write_splits(rows: DataFrame, path: str) -> None:
    """A view as Parquet, one folder per split, so that a reader of one split opens that alone."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)

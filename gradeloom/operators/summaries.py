"""Summaries over evaluation, reward and sample rows: overall (null key) and per level in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import rate
from gradeloom.operators.scoring import NO_SUBMIT


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def flag_count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def penalised_case_rate(passed: Column, total: Column, zero_rows: Column) -> Column:
    """Case rate in which a row without cases counts as one failed case."""
    return rate(passed, total + zero_rows)


def by_level(rows: DataFrame, level: str = "level"):
    """Grouping by level and over all; a null level is ``unknown``."""
    known = rows.withColumn(level, F.coalesce(F.nullif(F.col(level), F.lit("")), F.lit("unknown")))
    return known.groupingSets([[F.col(level)], []], F.col(level))


def agent_summary(evals: DataFrame, level: str = "level") -> DataFrame:
    """Counts and rates of evaluated runs. Case rates penalise rows without cases; ``case_pass_rate_nonzero_only`` doesn't."""
    empty = zero("total_cases") == 0
    scored = zero("scored_rubrics") > 0
    agg = by_level(evals, level).agg(
        F.count("*").alias("samples"),
        flag_count(F.col("compile_passed")).alias("compile_passed"),
        flag_count(F.col("execution_passed")).alias("execution_passed"),
        F.count_if(empty).alias("zero_case_samples"),
        flag_count(F.array_contains("failure_reasons", NO_SUBMIT)).alias("no_final_code_samples"),
        F.count_if(~empty).alias("nonzero_case_samples"),
        flag_count(F.col("execution_passed") & ~empty).alias("nonzero_case_execution_passed"),
        F.sum(zero("passed_cases")).alias("passed_cases"),
        F.sum(zero("total_cases")).alias("total_cases"),
        F.coalesce(F.avg(F.when(scored, F.coalesce("rubric_score", F.lit(0.0)))), F.lit(0.0)).alias("mean_rubric_score"),
        F.count_if(scored).alias("rubric_scored_samples"),
    )
    c = F.col
    return agg.withColumns(
        {
            "sample_pass_rate": rate(c("execution_passed"), c("samples")),
            "case_pass_rate": penalised_case_rate(c("passed_cases"), c("total_cases"), c("zero_case_samples")),
            "case_pass_rate_nonzero_only": rate(c("passed_cases"), c("total_cases")),
            "nonzero_case_sample_pass_rate": rate(c("nonzero_case_execution_passed"), c("nonzero_case_samples")),
        }
    )


def reward_summary(rewards: DataFrame, level: str = "level") -> DataFrame:
    """Counts, means and rates of reward rows. The case rate isn't penalised here."""
    scored = zero("scored_rubrics") > 0
    agg = by_level(rewards, level).agg(
        F.count("*").alias("rollouts"),
        F.coalesce(F.avg(F.coalesce("reward", F.lit(0.0))), F.lit(0.0)).alias("mean_reward"),
        F.coalesce(F.avg(F.when(scored, F.coalesce("rubric_score", F.lit(0.0)))), F.lit(0.0)).alias("mean_rubric_score"),
        F.count_if(scored).alias("rubric_scored_rollouts"),
        flag_count(F.col("execution_passed")).alias("execution_passed"),
        flag_count(F.col("budget_ok")).alias("budget_ok"),
        flag_count(F.col("tool_budget_violation")).alias("tool_budget_violation"),
        F.sum(zero("tool_budget_violation_count")).alias("tool_budget_violation_count"),
        F.sum(zero("passed_cases")).alias("passed_cases"),
        F.sum(zero("total_cases")).alias("total_cases"),
    )
    c = F.col
    return agg.withColumns(
        {
            "sample_pass_rate": rate(c("execution_passed"), c("rollouts")),
            "case_pass_rate": rate(c("passed_cases"), c("total_cases")),
            "budget_ok_rate": rate(c("budget_ok"), c("rollouts")),
            "tool_budget_violation_rate": rate(c("tool_budget_violation"), c("rollouts")),
        }
    )


def reason_counts(rows: DataFrame, reasons: Column | str, top: int = 20) -> DataFrame:
    """The most frequent reasons; equal counts in alphabetical order."""
    one = rows.select(F.explode(reasons if isinstance(reasons, Column) else F.col(reasons)).alias("reason"))
    return one.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)


def tool_counts(traces: DataFrame, trace: str = "tool_trace") -> DataFrame:
    """Calls of each tool over all traces."""
    return traces.select(F.explode(trace).alias("e")).groupBy(F.coalesce(F.col("e.tool_name"), F.lit("")).alias("tool_name")).agg(F.count("*").alias("calls"))


def trace_steps(traces: DataFrame, steps: Column) -> DataFrame:
    """Least, most and mean number of steps of a trace; zeros without traces."""
    n = F.coalesce(steps, F.lit(0))
    none = F.lit(0)
    return traces.agg(F.coalesce(F.min(n), none).alias("min_steps"), F.coalesce(F.max(n), none).alias("max_steps"), F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_steps"))


def validation_counts(rows: DataFrame) -> DataFrame:
    """Counters of input validation; a direct row was accepted without repair."""
    accepted, repaired = F.coalesce("accepted", F.lit(False)), F.coalesce("repair_succeeded", F.lit(False))
    return rows.agg(
        F.count("*").alias("input"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(~accepted).alias("rejected"),
        F.count_if(accepted & ~repaired).alias("direct"),
        F.count_if(accepted & repaired).alias("repaired"),
    )


def sum_summaries(summaries: DataFrame) -> DataFrame:
    """Counters of several splits added up."""
    numbers = [c for c, t in summaries.dtypes if t in ("int", "bigint", "double")]
    return summaries.agg(*(F.sum(c).alias(c) for c in numbers))


def sample_quality(samples: DataFrame) -> DataFrame:
    """Accepted and rejected samples by type and reason (grouping sets: all, type, reason)."""
    sets = [[F.col("sample_type")], [F.col("reject_reason")], []]
    return samples.groupingSets(sets, F.col("sample_type"), F.col("reject_reason")).agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.coalesce("uses_tool", F.lit(False))).alias("uses_tool"),
        F.count_if(F.coalesce("oracle_passed", F.lit(False))).alias("oracle_passed"),
    )


def eval_report(envs: DataFrame, levels: list[str]) -> DataFrame:
    """Environments by level (zero-filled), primary domain and secondary domain: ``facet``, ``value``, ``envs``."""
    fixed = envs.sparkSession.createDataFrame([(x,) for x in levels], "value string")
    level = fixed.join(envs.groupBy(F.col("level").alias("value")).agg(F.count("*").alias("envs")), "value", "left").select(F.lit("level").alias("facet"), "value", F.coalesce("envs", F.lit(0)).alias("envs"))
    primary = envs.groupBy(F.col("primary_domain").alias("value")).agg(F.count("*").alias("envs")).select(F.lit("primary_domain").alias("facet"), "value", "envs")
    secondary = envs.select(F.explode("secondary_domains").alias("value")).groupBy("value").agg(F.count("*").alias("envs")).select(F.lit("secondary_domain").alias("facet"), "value", "envs")
    return level.unionByName(primary).unionByName(secondary)


def preference_margin(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("rows"), F.coalesce(F.avg(F.col("chosen_score") - F.col("rejected_score")), F.lit(0.0)).alias("mean_margin"))


def deltas_to_base(rows: DataFrame, key: str, base, numbers: list[str]) -> DataFrame:
    """Each row's numbers less those of the base row; null without a base row. The base is one row, aggregated."""
    one = rows.where(F.col(key) == base).agg(*(F.first(c).alias(f"base_{c}") for c in numbers))
    return rows.join(F.broadcast(one)).withColumns({f"delta_{c}": F.col(c) - F.col(f"base_{c}") for c in numbers}).drop(*(f"base_{c}" for c in numbers))


# Numbers of a model's row in a comparison, and those that are compared with the base.
COMPARED = ("sample_pass_rate", "case_pass_rate", "case_pass_rate_nonzero_only", "nonzero_case_sample_pass_rate")
COUNTED = ("passed_cases", "total_cases")


def comparison_rows(totals: DataFrame) -> DataFrame:
    """Models' totals (``model_label``, ``model_kind``, ``samples``, numbers of ``agent_summary``) as rows of a comparison; null numbers are 0."""
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in (*COMPARED, *COUNTED)]
    kept = [c for c in ("output_dir", "adapter") if c in totals.columns]
    return totals.select("model_label", "model_kind", F.coalesce("samples", F.lit(0)).alias("num_envs"), *numbers, *kept)


def comparison_deltas(rows: DataFrame, base: str = "base") -> DataFrame:
    """Each other model's rates less the base model's; null without a base row."""
    out = deltas_to_base(rows, "model_label", base, list(COMPARED))
    return out.where(F.col("model_label") != base).select("model_label", *(f"delta_{c}" for c in COMPARED))


def sft_manifest(samples: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of counts: ``samples`` (``split``, ``trajectory_type``, ``tools``) by split and kind, those that use the test-file tool, and rejected ones."""
    counts = lambda c: F.coalesce(F.first(F.when(F.col("facet") == c, F.col("m")), ignorenulls=True), F.create_map().cast("map<string,bigint>"))
    per = [samples.groupBy(F.coalesce(c, F.lit("unknown")).alias("k")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "k", "n") for c in ("split", "trajectory_type")]
    facets = per[0].unionByName(per[1]).groupBy("facet").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("m"))
    maps = facets.agg(counts("split").alias("splits"), counts("trajectory_type").alias("trajectory_types"))
    one = samples.agg(F.count("*").alias("num_samples"), flag_count(F.array_contains("tools", "create_test_file")).alias("uses_create_test_file"))
    return one.join(F.broadcast(rejected.agg(F.count("*").alias("num_rejected")))).join(F.broadcast(maps))


def file_budget(files: DataFrame, env: str = "env_id", each: int = 65_536, total: int = 262_144) -> DataFrame:
    """Fixture files with ``fits``: no larger than ``each``, and within ``total`` with those before it."""
    from pyspark.sql import Window

    size = F.octet_length("content")
    run = F.sum(size).over(Window.partitionBy(env).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return files.withColumn("bytes", size).withColumn("running_bytes", run).withColumn("fits", (F.col("bytes") <= each) & (F.col("running_bytes") <= total))

"""Severity, gates, failure categories and the clean / rejected decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities from best to worst, and their scores.
SEVERITIES = ("pass", "pass_with_warning", "soft_fail", "hard_fail")
SCORES = (1.0, 0.8, 0.3, 0.0)

# What a failure reason must contain to be of a category; the first category that fits counts.
FAILURE_CATEGORIES = {
    "generation": (
        "NO_VALIDATED_ORACLE_CASES",
        "VALIDATED_ORACLE_CASES_TOO_FEW",
        "NO_VALID_ORACLE_CASE_FOR_OPERATOR",
        "SCALED_ORACLE_CASES_TOO_FEW",
        "SEED_CASE_ADMISSION_FAILED",
        "PARTIAL_CASE_REQUIREMENT_COVERAGE",
        "M4_COMBINED_ORACLE_CASE_MISSING",
        "STAGE05_LLM_GENERATION_ERROR",
    ),
    "repair": (
        "CASE_FAILED:",
        "SCALED_GOLD_CASE_EXECUTION_FAILED:",
        "SCALED_GOLD_COMPILE_FAILED",
        "SCALED_GOLD_EXECUTION_FAILED",
        "SCALED_OUTPUT_CONSTRAINTS_FAILED",
        "OUTPUT_CONSTRAINT_FAILED:",
        "GOLD_CASE_EXECUTION_GATE_HARD_FAIL",
        "GOLD_CASE_EXECUTION_GATE_SOFT_FAIL",
        "EMPTY_SCALED_GOLD",
        "SCALED_GOLD_SOLUTION_MISSING",
        "STAGE05_LLM_REPAIR_ERROR",
    ),
    "realization": ("ONLY_RATIONALE_SIGNAL", "SCALED_GOLD_DOES_NOT_MATCH_VERIFIER_SPECS", "OPERATOR_REALIZATION", "INTENSITY_", "D_", "C_", "A_", "V_"),
}

# Marks of model failures that another try can't mend, and of those that it may.
FINAL_FAILURES = (
    "http error 400",
    "bad request",
    "http error 401",
    "unauthorized",
    "http error 403",
    "forbidden",
    "model not found",
    "not available in your region",
    "region",
    "invalid api key",
)
PASSING_FAILURES = (
    "llm network error",
    "remotedisconnected",
    "remote end closed connection",
    "transient http error",
    "http error 408",
    "http error 409",
    "http error 429",
    "http error 500",
    "http error 502",
    "http error 503",
    "http error 504",
    "connection reset",
    "connection aborted",
    "broken pipe",
    "timeout",
    "timed out",
    "temporarily unavailable",
    "rate limit",
)


def holds_any(text: Column, marks) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | text.contains(m)
    return hit


def rank(severity: Column) -> Column:
    """0 (pass) to 3 (hard_fail); null is a pass."""
    return F.coalesce(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), severity).cast("int"), F.lit(1)) - 1


def named(level: Column) -> Column:
    return F.get(F.array(*(F.lit(s) for s in SEVERITIES)), level)


def severity_rank(failures: Column, warnings: Column, hard_codes=()) -> Column:
    """Hard for a reason that is, or starts with ``code:`` of, a hard code; soft for any other reason; then warnings."""
    hard = F.exists(failures, lambda r: r.isin(*hard_codes) | F.array_contains(F.array(*(F.lit(c) for c in hard_codes)), F.substring_index(r, ":", 1))) if hard_codes else F.lit(False)
    return F.when(F.coalesce(hard, F.lit(False)), 3).when(F.size(failures) > 0, 2).when(F.size(warnings) > 0, 1).otherwise(0)


def gate(name: str, failures: Column, warnings: Column, hard_codes=()) -> Column:
    """A gate's result: severity, score, whether it passed, distinct reasons in order."""
    r = severity_rank(failures, warnings, hard_codes)
    return F.struct(
        F.lit(name).alias("gate_name"),
        named(r).alias("severity"),
        F.get(F.array(*(F.lit(s) for s in SCORES)), r).alias("score"),
        (r <= 1).alias("passed"),
        F.array_distinct(failures).alias("failure_reasons"),
        F.array_distinct(warnings).alias("warnings"),
    )


def reasons(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in order.

    Nulls are taken out by array_except where codes differ: with a lambda, all conditions would be interpreted, and what they share made once for each of them."""
    found = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules))
    if len({code for _, code in rules}) == len(rules):
        return F.array_except(found, F.array(F.lit(None).cast("string")))
    return F.filter(found, lambda x: x.isNotNull())


def operator_summary(reports: DataFrame, by: str = "env_id") -> DataFrame:
    """Worst severity and all reasons of an environment's operator reports (ordered by ``position``)."""
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(c).alias("v")))), lambda x: x["v"])))
    return (
        reports.groupBy(by)
        .agg(F.max(rank(F.col("severity"))).alias("r"), ordered("failure_reasons").alias("failure_reasons"), ordered("warnings").alias("warnings"))
        .select(by, named(F.when((F.col("r") == 0) & (F.size("warnings") > 0), 1).otherwise(F.col("r"))).alias("severity"), "failure_reasons", "warnings")
    )


def final_decision(envs: DataFrame, summaries: DataFrame, gates: DataFrame, by: str = "env_id") -> DataFrame:
    """``final_decision``, ``passed`` and ``rejection_reasons``. An environment without operator report is rejected.

    ``gates``: by, ``position``, ``severity``, ``failure_reasons``. Reasons of passed gates don't count.
    """
    bad = rank(F.col("severity")) >= 2
    per = gates.groupBy(by).agg(
        F.coalesce(F.max(rank(F.col("severity"))), F.lit(0)).alias("gate_rank"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("position", "failure_reasons")))), lambda x: x["failure_reasons"])).alias("gate_reasons"),
    )
    s = summaries.select(by, rank(F.col("severity")).alias("op_rank"), F.col("failure_reasons").alias("op_reasons"), F.concat(F.lit("OPERATOR_REALIZATION_"), F.upper("severity")).alias("op_code"))
    joined = envs.join(s, by, "left").join(per, by, "left")
    missing = F.col("op_rank").isNull()
    worst = F.when(missing, 3).otherwise(F.col("op_rank"))
    own = F.when(missing, F.array(F.lit("OPERATOR_REALIZATION_REPORT_MISSING"), F.lit("OPERATOR_REALIZATION_HARD_FAIL"))).when(worst >= 2, F.concat("op_reasons", F.array("op_code")))
    empty = F.array().cast("array<string>")
    passed = (worst < 2) & (F.coalesce("gate_rank", F.lit(0)) < 2)
    return joined.select(
        *envs.columns,
        passed.alias("passed"),
        F.when(passed, "clean").otherwise("rejected").alias("final_decision"),
        F.array_distinct(F.concat(F.coalesce(own, empty), F.coalesce("gate_reasons", empty))).alias("rejection_reasons"),
    )


def baseline_gate(cases: Column, scaled_cases: Column, reports: Column, gold: Column) -> Column:
    """The artifact gate of unscaled environments, which pass with a warning if complete."""
    codes = ("EMPTY_VALIDATED_ORACLE_CASES", "EMPTY_SCALED_ORACLE_CASES", "SCALED_GOLD_CASE_EXECUTION_REPORT_MISSING", "EMPTY_SCALED_GOLD")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    failures = reasons((none(cases), codes[0]), (none(scaled_cases), codes[1]), (none(reports), codes[2]), (F.trim(F.coalesce(gold, F.lit(""))) == "", codes[3]))
    return gate("artifact_integrity_gate", failures, F.array(F.lit("M1_BASELINE_USES_VALIDATED_SEED_CASE")), codes)


def gold_execution_gate(reports: DataFrame, by: str = "env_id") -> DataFrame:
    """Gate over case reports: a failed case is a hard failure that names it; no report is one too."""
    failed = F.array_sort(F.collect_list(F.when(~F.coalesce("passed", F.lit(False)), F.concat(F.lit("CASE_FAILED:"), F.col("case_id")))))
    per = reports.groupBy(by).agg(F.count("case_id").alias("n"), failed.alias("failed"))
    failures = F.when(F.col("n") == 0, F.array(F.lit("SCALED_GOLD_CASE_EXECUTION_REPORT_MISSING"))).otherwise(F.col("failed"))
    return per.select(by, gate("gold_case_execution_gate", failures, F.array().cast("array<string>"), ("CASE_FAILED", "SCALED_GOLD_CASE_EXECUTION_REPORT_MISSING")).alias("gate"))


def oracle_quality_gate(envs: DataFrame, by: str = "env_id") -> DataFrame:
    """Gate over coverage: ``operators``, ``covered_operators``, ``valid_cases``, ``requirements``, ``covered_requirements`` (arrays and counts)."""
    missing = F.array_except("operators", "covered_operators")
    part = (F.size("covered_requirements") > 0) & (F.size(F.array_except("requirements", "covered_requirements")) > 0)
    base = reasons(
        (F.col("valid_cases") == 0, "NO_VALIDATED_ORACLE_CASES"),
        ((F.size("requirements") > 0) & (F.size(F.array_intersect("requirements", "covered_requirements")) == 0), "NO_CASE_REQUIREMENT_COVERAGE"),
    )
    each = F.transform(missing, lambda o: F.concat(F.lit("NO_VALID_ORACLE_CASE_FOR_OPERATOR:"), o))
    return envs.withColumn("gate", gate("oracle_case_quality_gate", F.concat(base, each), reasons((part, "PARTIAL_CASE_REQUIREMENT_COVERAGE")), ("NO_VALIDATED_ORACLE_CASES", "NO_VALID_ORACLE_CASE_FOR_OPERATOR")))


# Failure codes of an operator that isn't realized, by axis: patch, exposure, case, gold.
REALIZATION_CODES = {
    "D": ("D_NO_DATA_PATCH", "D_NO_VISIBLE_INPUT_REQUIREMENT", ("D_NO_CASE_FOR_DATA_VARIANT",), "D_GOLD_DOES_NOT_SUPPORT_DATA_VARIANT"),
    "C": ("C_NO_EXTRA_CONSTRAINT", "C_CONSTRAINT_NOT_VISIBLE", ("C_NO_CASE_FOR_CONSTRAINT",), "C_GOLD_DOES_NOT_SATISFY_CONSTRAINT"),
    "A": ("A_NO_SHORTCUT_TRAP", "A_ROBUSTNESS_NOT_VISIBLE", ("A_NO_TARGETED_SHORTCUT_CASE", "A_NO_CASE_FOR_ROBUSTNESS"), "A_GOLD_FALLS_INTO_SHORTCUT"),
}


def realization(operators: DataFrame) -> DataFrame:
    """Operators with ``failure_reasons``, ``warnings`` and ``severity``.

    Reads ``axis``, ``intensity``, ``has_patch``, ``exposed``, ``valid_cases``, ``linked_cases``, ``passed_cases``, ``failed_cases`` (counts), ``gold_reused``, ``answer_invariant``,
    ``invariant_declared``. There is no soft level here: any reason is a hard failure.
    """
    c = F.col
    rules = []
    for axis, (patch, exposure, case, gold) in REALIZATION_CODES.items():
        own = c("axis") == axis
        rules += [(own & ~c("has_patch"), patch), (own & ~c("exposed"), exposure), *((own & (c("valid_cases") == 0), k) for k in case), (own & (c("failed_cases") > 0), gold)]
    v = c("axis") == "V"
    rules += [
        (v & (c("valid_cases") == 0), "V_NOT_ENOUGH_CASES"),
        (v & (c("valid_cases") == 0), "V_CASES_NOT_LINKED"),
        (v & (c("passed_cases") == 0), "V_NO_GOLD_PASS_SIGNAL"),
        (v & ~c("invariant_declared"), "V_GOLD_INVARIANT_NOT_DECLARED"),
        (~v & c("gold_reused") & ~c("answer_invariant"), "SEED_GOLD_REUSED_WITHOUT_JUSTIFICATION"),
    ]
    warned = reasons((v & (c("intensity") >= 2) & (c("linked_cases") < 2), "INTENSITY_2_PREFER_MORE_VERIFIER_SIGNALS"))
    out = operators.withColumn("failure_reasons", reasons(*rules)).withColumn("warnings", warned)
    return out.withColumn("severity", F.when(F.size("failure_reasons") > 0, "hard_fail").when(F.size("warnings") > 0, "pass_with_warning").otherwise("pass"))


def failure_category(reason: Column) -> Column:
    out = F.lit("other")
    for name, marks in reversed(FAILURE_CATEGORIES.items()):
        out = F.when(holds_any(reason, marks), name).otherwise(out)
    return out


def retryable(source: Column, text: Column) -> Column:
    """A failure of the model call that another try may mend."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (F.coalesce(source, F.lit("")) == "llm_error") & ~holds_any(t, FINAL_FAILURES) & holds_any(t, PASSING_FAILURES)


def export_status(envs: DataFrame) -> DataFrame:
    """``export_status``: clean or rejected, from ``final_decision``, ``passed`` and ``blocking_flags`` (null decision: flags alone)."""
    decided = F.coalesce("final_decision", F.lit(""))
    blocked = F.size("blocking_flags") > 0
    rejected = blocked | (decided == "rejected") | ((decided != "") & ~F.coalesce("passed", F.lit(False)))
    return envs.withColumn("export_status", F.when(rejected, "rejected").otherwise("clean"))


def quality_report(envs: DataFrame) -> DataFrame:
    return envs.select("env_id", "original_task_id", (F.col("export_status") == "clean").alias("keep"), "export_status", "quality_flags", "blocking_flags")


def semantic_change(envs: DataFrame, fields: list[str], task: str = "original_task_id", level: str = "level", base: str = "M1") -> DataFrame:
    """``changed``: an environment differs from its task's base in the named fields (null for the base or without one)."""
    mark = F.md5(F.to_json(F.struct(*fields)).cast("binary"))
    bases = envs.where(F.col(level) == base).groupBy(task).agg(F.first(mark).alias("__base"))
    own = envs.withColumn("__own", mark).join(bases, task, "left")
    return own.withColumn("changed", F.when(F.col(level) != base, F.col("__own") != F.col("__base"))).drop("__own", "__base")


def assert_complete(rows: DataFrame, expected: int) -> DataFrame:
    """Fails the job if the number of rows isn't the one expected."""
    n = rows.agg(F.count("*").alias("n"))
    checked = n.select(F.assert_true(F.col("n") == expected, F.concat(F.lit("rows: "), F.col("n").cast("string"))).alias("ok"))
    return rows.join(F.broadcast(checked.where("ok is null")))


def safe_prune(envs: DataFrame) -> DataFrame:
    """Drop invalid cases only where the gates pass without them and every operator keeps a case.

    Reads ``cases`` and ``invalid_cases`` (arrays of case ids), ``gates_pass_without`` and ``operators_kept``."""
    ok = (F.size("invalid_cases") > 0) & F.col("gates_pass_without") & F.col("operators_kept")
    return envs.withColumn("pruned", F.when(ok, F.col("invalid_cases")).otherwise(F.array().cast("array<string>"))).withColumn("cases", F.when(ok, F.array_except("cases", "invalid_cases")).otherwise(F.col("cases")))


def safety_flags(text: Column, phrases: dict[str, list[str]]) -> Column:
    """Names of the rules whose phrases a text contains."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return reasons(*((holds_any(t, words), name) for name, words in phrases.items()))


# Codes of an incomplete result, by what is missing.
ARTIFACTS = {
    "operators": "EMPTY_OPERATOR_INSTANCES",
    "operator_reports": "EMPTY_OPERATOR_REALIZATION_REPORT",
    "scaled_cases": "EMPTY_SCALED_ORACLE_CASES",
    "validated_cases": "EMPTY_VALIDATED_ORACLE_CASES",
}
TEXT_ARTIFACTS = {"gold_solution": "EMPTY_SCALED_GOLD", "user_prompt": "EMPTY_FINAL_PROMPT", "scaling_plan": "EMPTY_SCALING_PLAN"}


def artifact_gate(envs: DataFrame) -> DataFrame:
    """Gate over what a scaled environment must carry (arrays and texts of ARTIFACTS), its ``operator_severity``, the severities of earlier
    gates (``prior_gates``: map of name to severity) and its tool configuration's ``violations``."""
    none = F.array().cast("array<string>")
    empty = [(F.coalesce(F.size(c), F.lit(0)) <= 0, code) for c, code in ARTIFACTS.items()]
    blank = [(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", code) for c, code in TEXT_ARTIFACTS.items()]
    bad = F.map_filter(F.coalesce("prior_gates", F.create_map().cast("map<string,string>")), lambda k, v: v.isin("soft_fail", "hard_fail"))
    prior = F.transform(F.map_entries(bad), lambda e: F.concat_ws("_", F.upper(e["key"]), F.upper(e["value"])))
    own = reasons(
        (F.col("operator_severity").isNull(), "OPERATOR_REALIZATION_REPORT_MISSING"),
        (F.col("operator_severity") == "hard_fail", "OPERATOR_REALIZATION_HARD_FAIL"),
        (F.col("operator_severity") == "soft_fail", "OPERATOR_REALIZATION_SOFT_FAIL"),
    )
    tools = F.transform(F.coalesce("violations", none), lambda v: F.concat(F.lit("TOOL_BUDGET_MISMATCH: "), v))
    warned = reasons((F.col("operator_severity") == "pass_with_warning", "OPERATOR_REALIZATION_PASS_WITH_WARNING"))
    hard = (*ARTIFACTS.values(), *TEXT_ARTIFACTS.values(), "OPERATOR_REALIZATION_REPORT_MISSING", "OPERATOR_REALIZATION_HARD_FAIL", "TOOL_BUDGET_MISMATCH")
    return envs.withColumn("gate", gate("artifact_integrity_gate", F.concat(tools, reasons(*empty, *blank), own, F.array_sort(prior)), warned, hard))


def hidden_tests_gate(envs: DataFrame) -> DataFrame:
    """Gate over hidden tests: ``tests``, ``semantic_tests``, ``weak_tests``, ``untargeted_tests``, ``without_failure_mode`` (counts), ``v_intensity``, ``execution_errors``."""
    c = F.col
    failures = F.concat(
        F.coalesce("execution_errors", F.array().cast("array<string>")),
        reasons(
            (c("weak_tests") > 0, "WEAK_HIDDEN_TEST"),
            (c("untargeted_tests") > 0, "UNTARGETED_HIDDEN_TEST"),
            ((c("tests") == 0) | ((c("v_intensity") > 0) & (c("semantic_tests") == 0)), "NO_VALID_SEMANTIC_HIDDEN_TEST"),
            ((c("semantic_tests") > 0) & (c("semantic_tests") < c("v_intensity")), "V_NOT_ENOUGH_SEMANTIC_TESTS"),
        ),
    )
    return envs.withColumn("gate", gate("hidden_tests_quality_gate", failures, reasons((c("without_failure_mode") > 0, "MISSING_EXPECTED_FAILURE_MODE")), ("NO_VALID_SEMANTIC_HIDDEN_TEST",)))


def consistency_gate(envs: DataFrame) -> DataFrame:
    """Gate over the chain of added requirements, gold, tests and verifier: ``gold_solution``, ``seed_gold``, ``gold_changed``, ``answer_invariant``, ``change_reason``,
    ``requirements``, ``tested``, ``verified`` (arrays of requirement ids), ``verifier_state`` (text), ``operator_severity``."""
    c = F.col
    text = lambda x: F.trim(F.coalesce(c(x), F.lit("")))
    same = text("gold_solution") == text("seed_gold")
    added = F.size("requirements") > 0
    untested, unverified = F.array_except("requirements", "tested"), F.array_except("requirements", "verified")
    broken = F.size(F.array_intersect(untested, unverified)) > 0
    failures = reasons(
        (text("gold_solution") == "", "SCALED_GOLD_MISSING"),
        (same & c("gold_changed") & ~c("answer_invariant"), "SEED_GOLD_REUSED_WITHOUT_JUSTIFICATION"),
        (c("answer_invariant") & (text("change_reason") == ""), "GOLD_INVARIANT_WITHOUT_JUSTIFICATION"),
        (added & (F.size(F.array_intersect("requirements", "tested")) == 0), "NO_TEST_COVERS_NEW_REQUIREMENT"),
        (text("verifier_state") == "", "VERIFIER_STATE_EMPTY"),
        (added & (F.size(F.array_intersect("requirements", "verified")) == 0), "VERIFIER_DOES_NOT_KNOW_NEW_REQUIREMENT"),
        (broken, "REQUIREMENT_CHAIN_BROKEN"),
    )
    warned = reasons(
        (added & (F.size(untested) > 0), "ADDED_REQUIREMENT_NOT_TESTED"),
        (added & (F.size(unverified) > 0), "PARTIAL_VERIFIER_REQUIREMENT_COVERAGE"),
        (c("operator_severity").isin("soft_fail", "hard_fail"), "OPERATOR_REALIZATION_ALREADY_FAILED"),
    )
    return envs.withColumn("gate", gate("scaled_task_consistency_gate", failures, warned, ("SCALED_GOLD_MISSING", "NO_TEST_COVERS_NEW_REQUIREMENT", "REQUIREMENT_CHAIN_BROKEN")))

"""Verifier specs: normalising, checking and assembling what an operator adds to an environment's tests; tool configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators.gates import reasons
from gradeloom.operators.planning import tool_priority
from gradeloom.sources.shared import growing

TEST = "struct<test_id:string,name:string,code:string,assertion_code:string,source:string,test_tier:string,is_placeholder:boolean,counts_as_hidden_test:boolean,eligible_for_clean_export:boolean>"

# What a test's code may not consist of.
WEAK_TESTS = r"(?i)asserttrue|callable\(globals\(\)"


def normalized_test(test: Column, owner: Column) -> Column:
    """A hidden test with id, name, code and flags filled in; code counts by any of its names."""
    code = T.first_text(test["code"], test["assertion_code"])
    ident = F.coalesce(T.present(test["test_id"]), T.present(test["name"]), F.concat_ws("_", owner, F.lit("hidden"), F.substring(F.md5(code.cast("binary")), 1, 8)))
    flag = lambda c: F.coalesce(c, F.lit(True))
    return F.struct(
        ident.alias("test_id"),
        F.coalesce(T.present(test["name"]), ident).alias("name"),
        code.alias("code"),
        F.coalesce(T.present(test["assertion_code"]), code).alias("assertion_code"),
        F.coalesce(T.present(test["source"]), F.lit("llm")).alias("source"),
        F.coalesce(T.present(test["test_tier"]), F.lit("semantic")).alias("test_tier"),
        F.coalesce(test["is_placeholder"], F.lit(False)).alias("is_placeholder"),
        flag(test["counts_as_hidden_test"]).alias("counts_as_hidden_test"),
        flag(test["eligible_for_clean_export"]).alias("eligible_for_clean_export"),
    )


def admissible(test: Column) -> Column:
    """A test with code that is no placeholder, no fallback, no smoke test and that says something."""
    squeezed = F.replace(test["code"], F.lit(" "), F.lit(""))
    good = test["counts_as_hidden_test"] & test["eligible_for_clean_export"] & ~test["is_placeholder"]
    return good & (test["code"] != "") & (test["source"] != "fallback") & (test["test_tier"] != "smoke") & ~squeezed.rlike(WEAK_TESTS)


def admissible_tests(tests: Column, owner: Column) -> Column:
    return F.filter(F.transform(F.coalesce(tests, F.array().cast(f"array<{TEST}>")), lambda t: normalized_test(t, owner)), admissible)


def delta_errors(operators: DataFrame) -> DataFrame:
    """Operators with ``errors``. Reads ``axis``, ``hidden_tests`` (TEST), ``checks``, ``static_checks`` (array of rule), ``exception_tests`` (array of expected_exception),
    ``numeric_tests`` (array of struct expected, tolerance), ``test_specs``."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    ids = F.filter(F.transform(F.coalesce("hidden_tests", F.array().cast(f"array<{TEST}>")), lambda t: F.coalesce(T.present(t["test_id"]), T.present(t["name"]), F.lit(""))), lambda x: F.lit(True))
    named = F.filter(ids, lambda x: x != "")
    nothing = sum((size(c) for c in ("hidden_tests", "checks", "static_checks", "exception_tests", "numeric_tests", "test_specs")), F.lit(0)) == 0
    blank = lambda x: T.strip(F.coalesce(x, F.lit(""))) == ""
    return operators.withColumn(
        "errors",
        reasons(
            ((F.col("axis") == "V") & (size("hidden_tests") + size("checks") + size("test_specs") == 0), "V_WITHOUT_VERIFICATION"),
            (nothing, "NO_EXECUTABLE_DELTA"),
            (F.exists(ids, lambda x: x == ""), "HIDDEN_TEST_WITHOUT_ID"),
            (F.size(F.array_distinct(named)) < F.size(named), "DUPLICATE_HIDDEN_TEST_ID"),
            (F.exists("numeric_tests", lambda t: t["expected"].isNull() | t["tolerance"].isNull()), "NUMERIC_TEST_INCOMPLETE"),
            (F.exists("exception_tests", blank), "EXCEPTION_TEST_INCOMPLETE"),
            (F.exists("static_checks", blank), "STATIC_CHECK_INCOMPLETE"),
        ),
    )


def verifier_specs(envs: DataFrame, operators: DataFrame) -> DataFrame:
    """A spec per environment (``env_id``, ``verifier_type_hint``, ``solution_form``, ``primary_domain``, ``secondary_domains`` as names) from its operators
    (``operator_id``, ``position``, ``hidden_tests``, ``checks``, ``static_checks``, ``exception_tests``), in their order."""
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(c).alias("v")))), lambda x: x["v"])).alias(c)
    tested = operators.withColumn("hidden_tests", admissible_tests(F.col("hidden_tests"), F.col("operator_id")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "operator_id"))), lambda x: x["operator_id"]).alias("generated_from")
    per = tested.groupBy("env_id").agg(flat("hidden_tests"), flat("checks"), flat("static_checks"), flat("exception_tests"), ids)
    names = F.coalesce("secondary_domains", F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return envs.join(per, "env_id", "left").select(
        F.concat(F.lit("verifier_"), "env_id").alias("verifier_id"),
        "env_id",
        F.coalesce("verifier_type_hint", F.lit("unit_test")).alias("verifier_type"),
        "solution_form",
        F.concat(F.array(F.lit("compile_check")), F.when(F.size(names) > 0, F.array(F.lit("secondary_domain_grounding"))).otherwise(none), F.coalesce("checks", none)).alias("checks"),
        F.coalesce("hidden_tests", F.array().cast(f"array<{TEST}>")).alias("hidden_tests"),
        F.coalesce("exception_tests", none).alias("exception_tests"),
        F.concat(F.array(F.lit("placeholder must not remain after insertion")), F.coalesce("static_checks", none)).alias("static_checks"),
        F.concat(F.array("primary_domain"), names).alias("rubric_links"),
        F.coalesce("generated_from", none).alias("generated_from"),
    )


# Limits of tool configurations by level: tools, calls in all, calls of one tool, debug calls.
TOOL_BOUNDS = {"M1": ((2, 3), (2, 4), 2, 0), "M2": ((1, 3), (2, 5), 3, 0), "M3": ((2, 5), (4, 9), 4, 2), "M4": ((3, 7), (7, 14), 6, 4)}


def tool_configs(envs: DataFrame, seed_tools: list[str], required: list[str]) -> DataFrame:
    """``allowed_tools`` and their budget from wanted tools (``tools``) and ``level``: clamped to the level, required ones kept, filled up from ``seed_tools``."""
    out = None
    for level, ((low, high), (calls_low, calls_high), each, debug) in TOOL_BOUNDS.items():
        own = envs.where(F.col("level") == level)
        kept = tool_priority(F.array_distinct(F.coalesce("tools", F.array().cast("array<string>"))), required, high)
        spare = F.array_except(F.array(*(F.lit(t) for t in seed_tools)), kept)
        full = F.concat(kept, F.slice(spare, F.lit(1), F.greatest(F.lit(0), F.lit(low) - F.size(kept))))
        extra = 2 if level in ("M3", "M4") else 1
        per = lambda t: F.least(F.lit(each), F.when(t == "debug_traceback", 2).otherwise(3))  # noqa: E731, B023
        part = own.withColumn("allowed_tools", full)
        part = part.withColumn("max_total_tool_calls", F.least(F.lit(calls_high), F.greatest(F.lit(calls_low), F.size("allowed_tools") + extra)))
        part = part.withColumn("max_calls_per_tool", F.map_from_arrays("allowed_tools", F.transform("allowed_tools", per)))
        part = part.withColumn("max_debug_calls", F.when(F.array_contains("allowed_tools", "debug_traceback"), F.lit(min(debug, 2))).otherwise(0))
        out = part if out is None else out.unionByName(part)
    return out


def config_violations(configs: DataFrame) -> DataFrame:
    """Tool configurations with ``violations`` of their level's limits."""
    def of(pick):
        out = F.lit(None).cast("int")
        for level, bounds in TOOL_BOUNDS.items():
            out = F.when(F.col("level") == level, F.lit(pick(bounds))).otherwise(out)
        return out

    n = F.size("allowed_tools")
    return configs.withColumn(
        "violations",
        reasons(
            (n < of(lambda b: b[0][0]), "TOO_FEW_TOOLS"),
            (n > of(lambda b: b[0][1]), "TOO_MANY_TOOLS"),
            (F.size(F.array_distinct("allowed_tools")) < n, "DUPLICATE_TOOLS"),
            (~F.col("max_total_tool_calls").between(of(lambda b: b[1][0]), of(lambda b: b[1][1])), "TOTAL_CALLS_OUT_OF_RANGE"),
            (F.exists(F.map_values("max_calls_per_tool"), lambda v: v > of(lambda b: b[2])), "CALLS_PER_TOOL_OUT_OF_RANGE"),
            (F.col("max_debug_calls") > of(lambda b: b[3]), "DEBUG_CALLS_OUT_OF_RANGE"),
        ),
    )


def case_plans(envs: DataFrame, operators: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """Plans of scaled cases: the seed case as blueprint aimed at all operators, with how many validated cases are needed.

    ``least``: cases that a level needs at least; without operators none are needed, and the unscaled level needs none."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("position", "operator_id"))), lambda x: x["operator_id"])
    per = operators.groupBy("env_id").agg(ids.alias("operator_ids"))
    joined = envs.join(per, "env_id", "left").withColumn("operator_ids", F.coalesce("operator_ids", F.array().cast("array<string>")))
    own = F.when((F.col("level") == "M1") | (F.size("operator_ids") == 0), 0).otherwise(1)
    floor = F.lit(0)
    for level, n in (least or {}).items():
        floor = F.when(F.col("level") == level, F.lit(n)).otherwise(floor)
    ready = (T.strip(F.coalesce("gold_solution", F.lit(""))) != "") & (T.strip(F.coalesce("call_code", F.lit(""))) != "") & (T.strip(F.coalesce("expected_output", F.lit(""))) != "")
    return joined.select(
        F.concat("env_id", F.lit("_scaled_case_plan")).alias("plan_id"),
        "env_id",
        F.when(ready, "ready").otherwise("blocked").alias("status"),
        F.greatest(own, floor).alias("required_cases"),
        F.greatest(F.lit(0), F.size("operator_ids") - 1).alias("additional_cases"),
        F.array_join("operator_ids", ",").alias("targets_operator_id"),
        "call_code",
        F.col("expected_output").alias("expected_output_signature"),
    )


def repaired_cases(cases: DataFrame, operators: DataFrame) -> DataFrame:
    """Cases with what a rule can mend: a missing id from the position, a missing target from the axis (the first operator of it), a missing
    axis from the target, a call whose value isn't kept assigned to ``result``."""
    first = operators.groupBy("env_id", "axis").agg(F.min_by("operator_id", "position").alias("__op"))
    axis_of = operators.select("env_id", F.col("operator_id").alias("targets_operator_id"), F.col("axis").alias("__axis")).dropDuplicates(["env_id", "targets_operator_id"])
    df = cases.join(growing(first), ["env_id", "axis"], "left").join(growing(axis_of), ["env_id", "targets_operator_id"], "left")
    call = T.strip(F.coalesce("call_code", F.lit("")))
    bare = call.rlike(r"^[A-Za-z_][\w.]*\(") & ~call.contains("\n")
    return df.withColumns(
        {
            "case_id": F.coalesce(T.present("case_id"), F.format_string("scaled_oracle_case_%d", F.col("position"))),
            "targets_operator_id": F.coalesce(T.present("targets_operator_id"), F.col("__op")),
            "axis": F.coalesce(T.present("axis"), F.col("__axis")),
            "call_code": F.when(bare, F.concat(F.lit("result = "), call)).otherwise(F.col("call_code")),
        }
    ).drop("__op", "__axis")

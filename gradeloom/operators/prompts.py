"""Prompts of scaled environments: the requirements that their states, operators and cases ask for, and which operators a finished prompt gives away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.values import flat_text
from gradeloom.operators.evidence import FOOT, GENERIC_PHRASES, HEAD, case_text, json_texts, list_texts, no_texts
from gradeloom.operators.rubrics import linked_rows
from gradeloom.sources.shared import growing

# Entries of the states that a prompt lists, in this order.
VISIBLE_ENTRIES = [
    "constraint_hints",
    "implicit_requirements",
    "implicit_clues",
    "execution_requirements",
    "stepwise_requirements",
    "resource_complexity_notes",
    "robustness_challenges",
    "must_not_assume",
    "output_constraints",
    "format_constraints",
]
TASK_ENTRIES = ["extra_constraints", "execution_steps", "required_steps", "implicit_requirements", "safety_critical_constraints"]
TRAP_ENTRY = "robustness_trap"
# Words that don't make a requirement specific, in a prompt; and those that don't show an operator in it.
PROMPT_COMMON = [
    "additional", "behavior", "boundary", "case", "cases", "computation", "constraint", "constraints", "contract", "correctly", "data", "edge", "edge-case", "executable", "expected",
    "explicit", "expose", "file", "function", "gold", "handle", "input", "introduce", "introduced", "must", "new", "operator", "oracle", "ordering", "output", "output-contract", "parameter",
    "parameters", "preserve", "requirement", "requirements", "required", "respect", "return", "return-contract", "rules", "scaled", "solution", "stronger", "structure", "task", "test",
    "tests", "testing", "value", "values", "variant", "variants",
]
EXPOSURE_COMMON = [
    "the", "and", "or", "with", "that", "this", "must", "should", "shall", "case", "cases", "test", "tests", "task", "solution", "function", "return", "returns", "input", "output", "file",
    "value", "values", "expected", "include", "includes", "provided", "when", "then", "than", "into", "from", "for", "not", "none", "true", "false", "additional", "behavior", "boundary",
    "computation", "constraint", "constraints", "contract", "correctly", "data", "edge", "edge-case", "executable", "explicit", "expose", "format", "gold", "handle", "introduce", "introduced",
    "new", "operator", "oracle", "output-contract", "ordering", "parameter", "parameters", "preserve", "requirement", "requirements", "required", "respect", "return-contract", "rules", "scaled",
    "stronger", "structure", "testing", "variant", "variants", "verifier",
]
# How openings of a requirement are put in a prompt.
OPENINGS = [
    (r"(?i)^verify that\s+", ""),
    (r"(?i)^verify\s+", ""),
    (r"(?i)^increase data complexity by requiring\s+", "Require "),
    (r"(?i)^increase data complexity by adding\s+", "Add "),
    (r"(?i)^increase data complexity by introducing\s+", "Introduce "),
    (r"(?i)^scaled executable cases? must (verify|check|include|expose)\s+", "Handle "),
    (r"(?i)^the solution must\s+", "The solution must "),
]
#: How a text begins that one of OPENINGS fits.
OPENED = r"(?i)^(verify|increase|scaled|the)\s"
PROMPT_PHRASES = [*GENERIC_PHRASES, "increase computation and contract complexity through parameter rules"]
LONGEST = 320
PLACEHOLDER = "<<insert solution here>>"


def long_words(text: Column, common: list[str]) -> Column:
    """Distinct words of three letters and more that aren't common."""
    return T.without(F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z][a-zA-Z0-9_-]{2,}"), F.lit(0)), common)


def says_nothing(text: Column) -> Column:
    return ~text.rlike(r"\S") | T.contains_any(F.lower(text), PROMPT_PHRASES)


def told_texts(texts: Column) -> Column:
    """Requirements as a prompt puts them: single blanks, their openings made plain, at most LONGEST characters; null is empty. Each step's text is made once, and only what begins like an opening is held against them."""
    plain = F.transform(texts, lambda x: T.comparable(F.coalesce(x, F.lit(""))))

    def opened(x: Column) -> Column:
        out = x
        for pattern, put in OPENINGS:
            out = F.regexp_replace(out, pattern, put)
        return F.when(x.rlike(OPENED), out).otherwise(x)

    return F.transform(F.transform(plain, opened), lambda x: F.when(F.length(x) > LONGEST, F.concat(F.rtrim(F.substring(x, 1, LONGEST - 3)), F.lit("..."))).otherwise(x))


def is_specific(text: Column) -> Column:
    return ~says_nothing(text) & (F.size(long_words(text, PROMPT_COMMON)) >= 2)


def _entries(state: str, keys: list[str], read) -> Column:
    """Texts of a state's entries, in order. Only those that are there are read."""
    there = F.filter(F.transform(F.array(*map(F.lit, keys)), lambda k: F.try_element_at(F.col(state), k)), lambda v: v.isNotNull())
    return F.flatten(F.transform(there, lambda v: F.coalesce(read(v), no_texts())))


def state_requirements() -> Column:
    """What the states (maps ``visible_state``, ``task_state``) ask for, in order."""
    texts = lambda v: F.when(~F.coalesce(v, F.lit("null")).isin("null", "false", "0", '""', "[]", "{}"), json_texts(v)).otherwise(no_texts())
    return F.concat(_entries("visible_state", VISIBLE_ENTRIES, texts), _entries("task_state", TASK_ENTRIES, list_texts), _entries("visible_state", [TRAP_ENTRY], texts))


def operator_requirements(operators: DataFrame, cases: DataFrame, env: str = "env_id") -> DataFrame:
    """``asked`` of each environment: its operators in order, of each the linked cases in order (two of constraint, intent and description, then what they cover), then its goal and own requirements.

    ``operators``: env, ``operator_id``, ``axis``, ``position``, ``transformation_goal``, ``output_requirements``; ``cases``: env, ``case_id``, ``position``, ``targets_operator_id``, ``axis`` and texts."""
    main = F.slice(F.filter(told_texts(F.array("target_constraint", "semantic_intent", "description")), is_specific), 1, 2)
    own = F.concat(main, F.filter(told_texts(T.text_list("covered_requirements")), is_specific))
    linked = linked_rows(operators, cases.withColumn("targets", F.col("targets_operator_id")), F.struct(F.col("position").alias("p"), "case_id", own.alias("texts")), env)
    per = linked.select(env, "operator_id", F.flatten(F.transform(F.array_sort("rows"), lambda x: x["texts"])).alias("of_cases"))
    goal = F.filter(told_texts(F.concat(F.array("transformation_goal"), T.text_list("output_requirements"))), is_specific)
    every = operators.select(env, "operator_id", "position", goal.alias("goal")).join(growing(per), [env, "operator_id"], "left")
    asked = F.concat(F.coalesce("of_cases", no_texts()), "goal")
    ordered = F.array_sort(F.collect_list(F.struct("position", "operator_id", asked.alias("asked"))))
    return every.groupBy(env).agg(F.flatten(F.transform(ordered, lambda x: x["asked"])).alias("asked"))


def requirements_of(envs: DataFrame, operators: DataFrame, cases: DataFrame, env: str = "env_id") -> DataFrame:
    """Environments (``visible_state``, ``task_state``) with ``requirements``: what their states ask for, then their operators; the first of those that differ in case or blanks alone.

    Where operators ask for something, generic requirements of the states go."""
    joined = envs.join(growing(operator_requirements(operators, cases, env)), env, "left")
    asked = F.coalesce("asked", no_texts())
    stated = state_requirements()
    every = F.concat(F.when(F.size(asked) > 0, F.filter(stated, lambda r: ~says_nothing(r))).otherwise(stated), asked)
    joined = joined.withColumn("__every", every).withColumn("__keys", F.transform("__every", lambda r: T.folded(r)))
    first = F.filter("__every", lambda r, i: F.array_position(F.col("__keys"), F.element_at("__keys", i + 1)) == i + 1)
    return joined.withColumn("requirements", first).drop("asked", "__every", "__keys")


def tool_section(tools: Column, total: Column, calls: Column) -> Column:
    """The part on tools: ``tools`` are structs (name, arguments, description, when), ``calls`` a map of tool to calls; empty without a total."""
    listed = F.transform(tools, lambda t, i: F.format_string("%d. %s(%s)\n   %s\n   Use when: %s", i + 1, t["name"], F.array_join(t["arguments"], ", "), t["description"], t["when"]))
    budget = F.concat(F.array(F.concat(F.lit("- max total tool calls: "), total.cast("string"))), F.transform(F.map_entries(calls), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string"))))
    body = F.when(F.size(listed) > 0, F.array_join(listed, "\n")).otherwise(F.lit("None"))
    text = F.concat(F.lit("Only the following tools may be used:\n"), body, F.lit("\n\nTool budget:\n"), F.array_join(budget, "\n"), F.lit("\n\n"))
    return F.coalesce(text, F.lit(""))


def prompt(env: Column, requirements: Column, problem: Column, context: Column, tools: Column | None = None, placeholder: Column | None = None) -> Column:
    """A finished prompt: tools, requirements, what to return, problem and context."""
    lines = F.array_join(F.transform(requirements, lambda r: F.concat(F.lit("- "), r)), "\n")
    asked = F.when(F.size(requirements) > 0, F.concat(F.lit(f"{HEAD}\n"), lines, F.lit("\n\n"))).otherwise(F.lit(""))
    mark = F.coalesce(placeholder, F.lit(PLACEHOLDER)) if placeholder is not None else F.lit(PLACEHOLDER)
    return F.concat(
        F.lit("Task ID: "), env, F.lit("\nMode: evaluation\n\n"), tools if tools is not None else F.lit(""), asked, F.lit(f"{FOOT}\n- return only the code that should replace "), mark,
        F.lit("\n\nProblem:\n"), F.coalesce(problem, F.lit("")), F.lit("\n\nContext:\n"), F.coalesce(context, F.lit("")),
    )


def asked_in(prompt: Column) -> Column:
    """The requirements' part of a prompt, up to the next head; empty without one."""
    return F.regexp_extract(prompt, rf"(?s){HEAD}\s*(.*?)(?:\n\n[A-Z][A-Za-z ]+:\s*|\z)", 1)


def shown_words(envs: DataFrame, env: str) -> DataFrame:
    """Specific words of each environment's seed (``__known``) and of what its prompt asks for (``__shown``), made once an environment."""
    rows = envs.select(env, F.coalesce("user_prompt", F.lit("")).alias("__prompt"), long_words(F.coalesce("seed_text", F.lit("")), EXPOSURE_COMMON).alias("__known"))
    rows = rows.withColumn("__asked", asked_in(F.col("__prompt")))
    whole = F.array_except(long_words(F.col("__prompt"), EXPOSURE_COMMON), "__known")
    return rows.select(env, "__known", F.when(F.col("__asked") == "", whole).otherwise(long_words(F.col("__asked"), EXPOSURE_COMMON)).alias("__shown"))


def exposures(operators: DataFrame, cases: DataFrame, envs: DataFrame, env: str = "env_id") -> DataFrame:
    """``operators`` with ``exposed``: the prompt shares two specific words (or the only one) with what the operator, its patch and its linked cases say and the seed doesn't.

    ``envs``: env, ``user_prompt``, ``seed_text``. A prompt that lists no requirements is read as a whole, less the seed's words."""
    texts = F.concat_ws(" ", "case_id", "case_kind", "targets_operator_id", "axis", case_text(), "setup_code", "call_code", "assertion_code", "expected_output_signature")
    said = linked_rows(operators, cases.withColumn("targets", F.col("targets_operator_id")), texts, env).select(env, "operator_id", F.array_join(F.array_sort("rows"), " ").alias("__said"))
    given = F.array_join(F.coalesce("output_requirements", no_texts()), " ") if "output_requirements" in operators.columns else F.lit("")
    patch = flat_text(F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("patch", lambda p: p["value"]), ","), F.lit("")), F.lit("]")))
    rows = operators.join(growing(said), [env, "operator_id"], "left").join(growing(shown_words(envs, env)), env, "left")
    rows = rows.withColumns({c: F.coalesce(c, no_texts()) for c in ("__known", "__shown")} | {"__own": long_words(F.concat_ws(" ", "transformation_goal", given, patch, "__said"), EXPOSURE_COMMON)})
    new = F.array_except("__own", "__known")
    rows = rows.withColumns({"__own": F.when(F.size(new) > 0, new).otherwise(F.col("__own"))})
    enough = (F.size("__own") > 0) & (F.size(F.array_intersect("__shown", "__own")) >= F.least(F.lit(2), F.size("__own")))
    return rows.withColumn("exposed", enough).drop("__said", "__known", "__own", "__shown")

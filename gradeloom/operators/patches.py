"""State patches of operators: what an axis writes, what is filled in where it is missing, how patches add up, and what an axis must have.

A patch is an array of entries (PATCH): one of eight states, a key and a value as JSON text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.gates import reasons

PATCH = "array<struct<state:string,key:string,value:string>>"
STATES = ("task", "data", "tool", "visible", "gold", "verifier", "test", "turn")
#: States that change what a task asks or how it is judged.
SEMANTIC = ("visible", "gold", "verifier", "test", "data")

# Names of the entries that an operator of each axis writes, and of its tests. The sentences are our own. {n} is the operator's intensity.
TEMPLATES = {
    "D": [
        ("task", "extra_constraints", ["Accept other forms of the input than the seed's run reads."]),
        ("data", "resource_variants", ["d_variant_intensity_{n}"]),
        ("data", "additional_inputs", ["d_additional_input_{n}"]),
        ("visible", "input_description", ["What the input may look like is wider now; each form must be dealt with."]),
        ("visible", "resource_complexity_notes", ["Cases may lay files out, format them or build their records in another way."]),
        ("verifier", "resource_variation_checks", ["d_resource_check_{n}"]),
        ("test", "tests_with_new_resource_variants", ["d_case_variant_{n}"]),
    ],
    "C": [
        ("task", "extra_constraints", ["Keep the rules on parameters, limits, order and results that the cases add."]),
        ("visible", "output_constraints", ["Cases ask more of the computation and of its result."]),
        ("visible", "format_constraints", ["The result's structure and its edge cases stay as they are asked for."]),
        ("verifier", "constraint_checks", ["c_constraint_check_{n}"]),
        ("test", "constraint_hidden_tests", ["c_constraint_case_{n}"]),
    ],
    "A": [
        ("task", "shortcut_traps", ["Inputs may repeat, disagree, be random or mislead; a short cut fails on them."]),
        ("task", "must_not_follow_shortcut", True),
        ("visible", "robustness_trap", "Some cases are made so that fixed answers and loose assumptions fail."),
        ("visible", "robustness_challenges", ["Random names and inputs that repeat or disagree still give the right result."]),
        ("visible", "must_not_assume", ["No fixed names of files or flags, and not only inputs that are well formed."]),
        ("verifier", "anti_shortcut_checks", ["a_shortcut_check_{n}"]),
        ("verifier", "shortcut_rejection_checks", ["a_rejection_check_{n}"]),
        ("test", "shortcut_hidden_tests", ["a_shortcut_case_{n}"]),
    ],
    "V": [
        ("visible", "execution_requirements", ["More cases than the seed's own must pass when they are run."]),
        ("verifier", "stronger_checks", ["v_case_coverage_{n}"]),
        ("verifier", "verifier_hardening", ["validated_oracle_cases"]),
        ("test", "semantic_hidden_tests", ["v_semantic_case_{n}"]),
    ],
}
FORMAT_VARIANTS = ("extensionless", "comment_lines", "empty_sections")
# Kind of an axis's semantic test, its failure mode, the kind of its input and the mode of its comparison.
SPECS = {
    "D": ("data_variant_case", "solution_only_handles_original_seed_input_shape", "data_variant", "data_variant"),
    "C": ("constraint_boundary_case", "solution_matches_seed_case_but_breaks_new_constraint", "constraint_variant", "constraint_boundary"),
    "A": ("anti_shortcut_case", "solution_hardcodes_seed_assumption_or_brittle_shortcut", "adversarial_variant", "anti_shortcut"),
    "V": ("semantic_coverage_case", "solution_passes_seed_case_but_not_stronger_scaled_case_suite", "coverage_variant", "oracle_coverage"),
}
#: What the cases of an axis must show; our own words.
REQUIREMENTS = {
    "D": "A case that runs shows in its result the other form of input that this operator brings.",
    "C": "A case that runs shows the added rule in its result.",
    "A": "A case that runs shows in its result that the short cut which this operator forbids fails.",
    "V": "More cases that run, each with the result that this operator asks for.",
}
GOAL, GOAL_TEXT, VARIANT = "{goal list}", "{goal}", "{id}_resource_variant"
# Names of the entries that an axis can't be without; the sentences are our own, or the operator's goal.
DEFAULTS = {
    "D": [
        ("task", "extra_constraints", ["Accept the forms of input that the cases hold."]),
        ("data", "resource_variants", VARIANT),
        ("visible", "input_description", ["Inputs may differ in format, shape or in how they are read."]),
        ("test", "tests_with_new_resource_variants", GOAL),
    ],
    "C": [("task", "extra_constraints", GOAL), ("visible", "output_constraints", GOAL), ("verifier", "constraint_checks", GOAL), ("test", "constraint_hidden_tests", GOAL)],
    "A": [
        ("task", "shortcut_traps", GOAL),
        ("task", "must_not_follow_shortcut", True),
        ("visible", "robustness_trap", GOAL_TEXT),
        ("visible", "must_not_assume", ["Names, parameters and well-formed inputs of the seed aren't given."]),
        ("verifier", "anti_shortcut_checks", GOAL),
        ("test", "shortcut_hidden_tests", GOAL),
    ],
    "V": [("visible", "execution_requirements", ["More validated cases must pass."]), ("verifier", "stronger_checks", GOAL), ("test", "semantic_hidden_tests", GOAL)],
}
# Entries that prove an axis's patch, and words that do so in any entry of the states named.
PROOFS = {
    "D": (
        [("data", k) for k in ("resource_variants", "additional_inputs", "input_format_variants", "data_variants", "fixtures", "resource_manifest")],
        ("data", "visible", "task"),
        ["input", "file", "format", "variant", "data", "resource"],
    ),
    "C": (
        [("task", "extra_constraints"), ("visible", "output_constraints"), ("verifier", "constraint_checks")],
        ("task", "visible", "verifier"),
        ["constraint", "validate", "validation", "invalid", "error", "raise", "return", "parameter", "params", "bounds", "contract"],
    ),
    "A": (
        [("task", "shortcut_traps"), ("visible", "robustness_trap"), ("visible", "must_not_assume")],
        ("task", "visible", "verifier"),
        ["robust", "adversarial", "shortcut", "hardcod", "misnamed", "wrong extension", "duplicate", "missing", "malformed", "non-list", "mutation", "empty", "comment", "conflict", "misleading"],
    ),
}


def _entry(state: str, key: str, value: Column) -> Column:
    return F.struct(F.lit(state).alias("state"), F.lit(key).alias("key"), value.cast("string").alias("value"))


def _by_axis(axis: Column, made: dict[str, list[Column]], otherwise: list[Column]) -> Column:
    out = F.array(*otherwise).cast(PATCH)
    for name, entries in made.items():
        out = F.when(axis == name, F.array(*entries).cast(PATCH)).otherwise(out)
    return out


def _gold(axis: Column) -> Column:
    """Axis V leaves the solution as it is; the others change it."""
    same = axis == "V"
    why = F.when(same, "Only the checks grow; the task means the same.").otherwise(F.concat(F.lit("The solution must keep up with what axis "), axis, F.lit(" adds.")))
    return F.array(
        _entry("gold", "gold_changed", ~same),
        _entry("gold", "answer_invariant", same),
        _entry("gold", "seed_gold_compatible_with_scaled_task", same),
        _entry("gold", "gold_change_reason", _text(why)),
    ).cast(PATCH)


def _text(value: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def state_patch(axis: Column, intensity: Column, primary: Column, secondary: Column) -> Column:
    """The patch (PATCH) of an operator by its axis and intensity, with the domains as context."""
    n = intensity.cast("string")
    made = {a: [_entry(s, k, F.replace(F.lit(json.dumps(v)), F.lit("{n}"), n)) for s, k, v in rows] for a, rows in TEMPLATES.items()}
    made["D"].append(_entry("data", "input_format_variants", F.to_json(F.slice(F.array(*(F.lit(v) for v in FORMAT_VARIANTS)), F.lit(1), intensity.cast("int") + 1))))
    domains = F.struct(primary.alias("primary_domain"), F.coalesce(secondary, F.array().cast("array<string>")).alias("secondary_domains"))
    shared = F.array(_entry("task", "axis_constraints", F.to_json(F.array(axis))), _entry("task", "axis_intensity", n), _entry("task", "domain_context", F.to_json(domains))).cast(PATCH)
    return F.concat(shared, _by_axis(axis, made, []), _gold(axis))


def semantic_spec(axis: Column, owner: Column, intensity: Column) -> Column:
    """The semantic test that an axis asks for: ids, kinds and the requirement that its case must show."""
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for a, row in SPECS.items() for x in (a, row[i]))), axis)
    return F.struct(
        F.concat_ws("_", owner, F.lower(axis), intensity.cast("string"), F.lit("spec")).alias("spec_id"),
        pick(0).alias("test_template_type"),
        pick(1).alias("expected_failure_mode"),
        pick(2).alias("input_kind"),
        pick(3).alias("comparison_mode"),
        F.element_at(F.create_map(*(F.lit(x) for pair in REQUIREMENTS.items() for x in pair)), axis).alias("requirement"),
    )


def with_patches(operators: DataFrame, primary: Column, secondary: Column) -> DataFrame:
    """Operators with ``patch``, ``semantic_spec`` and one check of the axis (``check_id``)."""
    axis, n = F.col("axis"), F.col("operator_intensity")
    return operators.withColumns(
        {
            "patch": state_patch(axis, n, primary, secondary),
            "semantic_spec": semantic_spec(axis, F.col("env_id"), n),
            "check_id": F.concat_ws("_", "env_id", F.lower(axis), n.cast("string"), F.lit("check")),
        }
    )


def repaired_patch(patch: Column, axis: Column, operator_id: Column, goal: Column) -> Column:
    """The patch with the entries that its axis can't be without; entries that are there stay. An unknown axis gets its goal alone; null is an empty patch."""
    given = F.coalesce(patch, F.array().cast(PATCH))

    def value(v) -> Column:
        if v == GOAL:
            return F.to_json(F.array(goal))
        if v == GOAL_TEXT:
            return _text(goal)
        return F.to_json(F.array(F.concat(operator_id, F.lit("_resource_variant")))) if v == VARIANT else F.lit(json.dumps(v))

    made = {a: [_entry(s, k, value(v)) for s, k, v in rows] for a, rows in DEFAULTS.items()}
    wanted = F.concat(_by_axis(axis, made, [_entry("task", "operator_goal", _text(goal))]), F.when(axis.isin(*DEFAULTS), _gold(axis)).otherwise(F.array().cast(PATCH)))
    return F.concat(given, F.filter(wanted, lambda w: ~F.exists(given, lambda p: (p["state"] == w["state"]) & (p["key"] == w["key"]))))


def applied(operators: DataFrame, base: DataFrame | None = None, env: str = "env_id") -> DataFrame:
    """States after all patches, in the operators' order (``position``): a row per environment, state and key.

    A later value replaces an earlier one; an object over an object adds to it, key by key. ``base`` holds the states before (env, ``patch``).
    An environment's operators are few by design, so a key's values are gathered."""
    rows = operators.select(env, F.col("position").cast("long").alias("p"), F.posexplode("patch").alias("i", "e"))
    if base is not None:
        rows = base.select(env, F.lit(None).cast("long").alias("p"), F.posexplode("patch").alias("i", "e")).unionByName(rows)
    per = rows.groupBy(env, F.col("e.state").alias("state"), F.col("e.key").alias("key")).agg(F.sort_array(F.collect_list(F.struct("p", "i", F.col("e.value").alias("v")))).alias("all"))
    is_object = lambda v: F.coalesce(F.startswith(F.ltrim(v), F.lit("{")), F.lit(False))
    values = F.transform("all", lambda x: x["v"])
    plain = F.coalesce(F.array_max(F.transform(values, lambda v, i: F.when(~is_object(v), i + 1))), F.lit(0))
    tail = F.slice(values, plain + 1, F.size("all"))
    entries = F.flatten(F.transform(tail, lambda v: F.map_entries(F.from_json(v, "map<string,variant>"))))
    numbered = F.transform(entries, lambda e, i: F.struct(i.alias("i"), e["key"].alias("key"), e["value"].alias("value")))
    last = F.aggregate(numbered, F.create_map().cast("map<string,int>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["i"])))
    merged = F.map_from_entries(F.transform(F.filter(numbered, lambda e: F.try_element_at(last, e["key"]) == e["i"]), lambda e: F.struct(e["key"], e["value"])))
    whole = F.when(F.size(tail) == 0, F.element_at(values, -1)).when(F.size(tail) == 1, F.element_at(tail, 1)).otherwise(F.to_json(merged))
    return per.select(env, "state", "key", whole.alias("value"))


def state_maps(states: DataFrame, env: str = "env_id") -> DataFrame:
    """A row per environment, with a map of key to JSON text for each of the eight states."""
    of = lambda s: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("state") == s, F.struct("key", "value"))))).alias(f"{s}_state")
    return states.groupBy(env).agg(*(of(s) for s in STATES))


def _filled(value: Column) -> Column:
    return ~F.coalesce(value, F.lit("null")).isin("null", "false", "0", '""', "[]", "{}")


def has(patch: Column, entries: list[tuple[str, str]]) -> Column:
    """One of the entries is there and says something."""
    return F.exists(F.coalesce(patch, F.array().cast(PATCH)), lambda p: F.concat_ws(".", p["state"], p["key"]).isin(*(f"{s}.{k}" for s, k in entries)) & _filled(p["value"]))


def _has_state(patch: Column, states: tuple[str, ...]) -> Column:
    return F.exists(F.coalesce(patch, F.array().cast(PATCH)), lambda p: p["state"].isin(*states))


def realized_patch(axis: Column, patch: Column) -> Column:
    """A patch that holds what its axis is about, by an entry or by words (for axis V any semantic entry)."""
    out = _has_state(patch, ("task", *SEMANTIC))
    for name, (entries, states, words) in PROOFS.items():
        text = F.array_join(F.transform(F.filter(F.coalesce(patch, F.array().cast(PATCH)), lambda p: p["state"].isin(*states)), lambda p: F.lower(F.coalesce(p["value"], F.lit("")))), " ")  # noqa: B023
        out = F.when(axis == name, has(patch, entries) | text.rlike("|".join(words))).otherwise(out)
    return out


def patch_errors(operators: DataFrame) -> DataFrame:
    """Operators (``axis``, ``operator_intensity``, ``patch``) with ``patch_errors``: what keeps a patch from counting."""
    p, axis = F.col("patch"), F.col("axis")
    known = F.coalesce(p, F.array().cast(PATCH))
    prompt = F.exists(known, lambda e: e["key"].contains("user_prompt") | F.coalesce(e["value"], F.lit("")).contains("user_prompt"))
    return operators.withColumn(
        "patch_errors",
        reasons(
            (~F.coalesce("operator_intensity", F.lit(0)).isin(1, 2, 3), "INVALID_INTENSITY"),
            (~_has_state(p, STATES), "NO_STATE_UPDATE"),
            (~_has_state(p, SEMANTIC), "NO_SEMANTIC_UPDATE"),
            (prompt, "WRITES_USER_PROMPT"),
            (has(p, [("task", "solution_form")]), "CHANGES_SOLUTION_FORM"),
            ((axis == "D") & ~_has_state(p, ("data",)), "D_WITHOUT_DATA_PATCH"),
            ((axis == "C") & ~has(p, PROOFS["C"][0]), "C_WITHOUT_CONSTRAINT"),
            ((axis == "A") & ~has(p, [("visible", "robustness_trap"), ("visible", "must_not_assume"), ("verifier", "anti_shortcut_checks")]), "A_WITHOUT_ROBUSTNESS"),
            ((axis == "V") & ~has(p, [("verifier", "stronger_checks")]), "V_WITHOUT_VERIFICATION"),
        ),
    )

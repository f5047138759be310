"""Text evidence: which requirements a case covers, whether they are visible, and whether case, operator and expectation speak of the same thing.

Texts meet inside an environment, whose cases, requirements and operators are few by design.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.values import flat_text
from gradeloom.operators.rubrics import contains_either, specific, tokens
from gradeloom.sources.shared import growing

# Words that say nothing specific about a case.
CASE_COMMON = [
    "a", "an", "and", "any", "as", "axis", "behavior", "boundary", "case", "cases", "check", "checks", "code", "computation", "constraint", "constraints", "contract", "correct",
    "correctly", "data", "edge", "edge-case", "expected", "explicit", "expose", "file", "for", "format", "from", "function", "gold", "handle", "handles", "input", "inputs", "intent",
    "introduced", "main", "must", "new", "operator", "oracle", "ordering", "output", "parameter", "parameters", "preserve", "provided", "required", "requirement", "requirements",
    "respect", "return", "returns", "rule", "rules", "satisfy", "scaled", "semantic", "solution", "task", "test", "testing", "tests", "the", "this", "to", "type", "value", "values",
    "variant", "variants", "verify", "when", "with",
]
# What a requirement that says nothing says.
GENERIC_PHRASES = [
    "handle scaled input/data variants from the oracle cases",
    "handle scaled input",
    "scaled executable cases must expose",
    "scaled cases add explicit edge-case",
    "scaled cases introduce stronger computation",
    "solution must satisfy new boundary",
    "respect new parameter, boundary, ordering, or return-contract constraints from scaled cases",
    "preserve the required return structure and edge-case behavior",
    "new requirement introduced by this operator",
    "new computation and contract constraints introduced by this operator",
]
# Entries of an environment's states that its reader sees as requirements, and those of an operator's patch.
VISIBLE_ENTRIES = {
    "visible": ["execution_requirements", "stepwise_requirements", "implicit_requirements", "constraint_hints", "output_constraints", "format_constraints", "must_not_assume", "robustness_challenges"],
    "task": ["visible_requirements", "extra_constraints", "required_steps", "execution_steps"],
}
OPERATOR_ENTRIES = {
    "visible": ["execution_requirements", "stepwise_requirements", "implicit_requirements", "constraint_hints", "output_constraints", "format_constraints", "robustness_challenges", "must_not_assume"],
    "task": ["extra_constraints", "required_steps", "execution_steps", "implicit_requirements", "safety_critical_constraints"],
}
#: The heads of a prompt between which its requirements stand.
HEAD, FOOT = "Additional requirements:", "Output requirement:"

SEED_KINDS = ("seed_baseline", "seed_regression")


def no_texts() -> Column:
    return F.array().cast("array<string>")


def parts(c: str) -> Column:
    """Names in a comma-separated text."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ","), lambda x: T.strip(x)), lambda x: x != "")


def norm(text: Column) -> Column:
    return T.folded(text)


def case_words(text: Column) -> Column:
    """Distinct specific words of a text, with the marks of paths and numbers inside them; ids of operators don't count."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9](?:[a-z0-9_*/:.-]*[a-z0-9_*/:-])?"), F.lit(0))  # a stop at its end isn't a word's
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(CASE_COMMON) & ~F.startswith(w, F.lit("op_"))))


def is_generic(text: Column) -> Column:
    """Blank, one of the phrases that say nothing, or fewer than two specific words."""
    t = norm(F.coalesce(text, F.lit("")))
    return (t == "") | T.contains_any(t, GENERIC_PHRASES) | (F.size(case_words(t)) < 2)


def json_texts(value: Column) -> Column:
    """The texts of a JSON value: a list's items, or the value itself; blank ones are left out."""
    whole = F.when(F.startswith(F.ltrim(value), F.lit("[")), value).when(value.isNotNull(), F.concat(F.lit("["), value, F.lit("]")))
    return T.text_list(F.from_json(whole, "array<string>"))


def list_texts(value: Column) -> Column:
    """``json_texts`` of lists alone."""
    return F.when(F.startswith(F.ltrim(value), F.lit("[")), json_texts(value)).otherwise(no_texts())


def prompt_lines(prompt: Column) -> Column:
    """The additional requirements that a prompt lists."""
    inside = F.when(F.contains(prompt, F.lit(HEAD)), F.split_part(F.substr(prompt, F.locate(HEAD, prompt) + len(HEAD)), F.lit(FOOT), F.lit(1)))
    return F.filter(F.transform(F.split(F.coalesce(inside, F.lit("")), r"\r\n|\r|\n"), lambda x: T.strip(F.regexp_replace(T.strip(x), "^-", ""))), lambda x: x != "")


def visible_requirements(envs: DataFrame, env: str = "env_id") -> DataFrame:
    """``visible_requirements`` of environments (``output_requirements``, maps ``visible_state`` and ``task_state`` of JSON texts, ``user_prompt``), each once."""
    of = lambda state: F.flatten(F.array(*(F.coalesce(list_texts(F.try_element_at(F.col(f"{state}_state"), F.lit(k))), no_texts()) for k in VISIBLE_ENTRIES[state])))
    every = F.concat(T.text_list("output_requirements"), of("visible"), of("task"), prompt_lines(F.coalesce("user_prompt", F.lit(""))))
    return envs.select(env, F.array_distinct(every).alias("visible_requirements"))


def operator_texts(operators: DataFrame) -> DataFrame:
    """Operators with ``requirement_texts`` (own requirements, then entries of their patch) and ``semantic_words`` of all that they say.

    Reads ``transformation_goal``, ``patch`` and, where they are, ``operator_type``, ``rationale``, ``output_requirements``, ``expected_failure_modes``."""
    given = lambda c, otherwise: F.coalesce(F.col(c), otherwise) if c in operators.columns else otherwise
    entries = F.coalesce("patch", F.array().cast("array<struct<state:string,key:string,value:string>>"))
    own = T.text_list(given("output_requirements", no_texts()))
    of = lambda state: F.flatten(F.transform(F.array(*map(F.lit, OPERATOR_ENTRIES[state])), lambda k: F.flatten(F.transform(F.filter(entries, lambda p: (p["state"] == state) & (p["key"] == k)), lambda p: json_texts(p["value"])))))
    told = F.filter(entries, lambda p: p["state"].isin("task", "visible", "data"))
    said = F.concat_ws(
        " ", given("operator_type", F.lit("")), "transformation_goal", given("rationale", F.lit("")), F.array_join(own, " "), flat_text(F.concat(F.lit("["), F.array_join(F.transform(told, lambda p: p["value"]), ","), F.lit("]"))),
        F.array_join(given("expected_failure_modes", no_texts()), " "),
    )
    return operators.withColumns({"requirement_texts": F.array_distinct(F.concat(own, of("visible"), of("task"))), "semantic_words": case_words(said)})


def covered_text() -> Column:
    return F.array_join(F.coalesce("covered_requirements", no_texts()), " ")


def case_text() -> Column:
    """What a case says that it is about."""
    return F.lower(F.concat_ws(" ", "description", "semantic_intent", "target_constraint", "expected_failure_mode", covered_text()))


def observable_text() -> Column:
    """What a case does and expects."""
    signature = F.when(F.try_parse_json("expected_output_signature").isNotNull(), F.col("expected_output_signature"))
    return F.lower(F.concat_ws(" ", "setup_code", "call_code", flat_text(signature), "expected_failure_mode"))


def fits(operator: Column, axis: Column, targets: Column, axes: Column) -> Column:
    """A requirement is for a case by its operator and axis: the case's, none, or the seed's or global."""
    same = (operator == "") | (F.size(targets) == 0) | F.array_contains(targets, operator)
    return same & (axis.isin("seed", "global") | (F.size(axes) == 0) | F.array_contains(axes, axis))


def covers(text: Column, words: Column, said: Column, own: Column) -> Column:
    """A requirement (``text``: its tokens, ``words``: the specific ones) and what a case says (``said``, ``own``) hold each other, word for word, or share two specific words, or the only one."""
    return (text != "") & (said != "") & (contains_either(text, said) | ((F.size(words) > 0) & (F.size(F.array_intersect(words, own)) >= F.least(F.lit(2), F.size(words)))))


def requirement_evidence(cases: DataFrame, requirements: DataFrame, env: str = "env_id") -> DataFrame:
    """A row per case and requirement of its environment that its texts cover: ``held`` (one holds the other, word for word), ``shared`` specific words, and
    ``score``: 1 if held, else the share of the requirement's words.

    ``requirements``: env, ``requirement_id``, ``position``, ``operator_id``, ``axis``, ``text``. A requirement of another operator or axis than the case's doesn't count, unless
    it is the seed's or global. Without being held, two words must be shared, or the only one."""
    c = cases.select(env, "case_id", parts("targets_operator_id").alias("__targets"), parts("axis").alias("__axes"), F.array_join(tokens(case_text()), " ").alias("__said"), specific(case_text()).alias("__own"))
    r = requirements.where(F.coalesce("requirement_id", F.lit("")) != "").select(
        env, "requirement_id", "position", F.coalesce("operator_id", F.lit("")).alias("__op"), F.coalesce("axis", F.lit("")).alias("__axis"),
        F.array_join(tokens(F.coalesce("text", F.lit(""))), " ").alias("__text"), specific(F.coalesce("text", F.lit(""))).alias("__asked"),
    )
    own = fits(F.col("__op"), F.col("__axis"), F.col("__targets"), F.col("__axes"))
    pairs = c.join(growing(r), env).where(own & covers(F.col("__text"), F.col("__asked"), F.col("__said"), F.col("__own")))
    pairs = pairs.withColumns({"held": contains_either(F.col("__text"), F.col("__said")), "shared": F.size(F.array_intersect("__asked", "__own"))})
    score = F.when(F.col("held"), 1.0).otherwise(F.col("shared") / F.size("__asked"))
    return pairs.select(env, "case_id", "requirement_id", "position", "held", "shared", score.alias("score"))


def asked_lists(requirements: DataFrame, env: str = "env_id") -> DataFrame:
    """Environments with their requirements as a list ``__reqs`` by position, whose words are made once an environment: cases meet it in their row."""
    get = lambda c: F.coalesce(F.col(c), F.lit(""))
    one = F.struct("position", "requirement_id", get("operator_id").alias("operator"), get("axis").alias("axis"), F.array_join(tokens(get("text")), " ").alias("text"), specific(get("text")).alias("words"))
    return requirements.groupBy(env).agg(F.array_sort(F.collect_list(one)).alias("__reqs"))


def told_ids(reqs: Column, targets: Column, axes: Column, said: Column, own: Column) -> Column:
    """Ids of the requirements of ``asked_lists`` that a case's texts cover (see ``requirement_evidence``), by position."""
    found = F.filter(reqs, lambda r: (F.coalesce(r["requirement_id"], F.lit("")) != "") & fits(r["operator"], r["axis"], targets, axes) & covers(r["text"], r["words"], said, own))
    return F.coalesce(F.transform(found, lambda r: r["requirement_id"]), no_texts())


def text_match(requirement: Column, said: Column) -> Column:
    """A requirement and a case's texts hold each other or share enough specific words."""
    return covers(F.array_join(tokens(requirement), " "), specific(requirement), F.array_join(tokens(said), " "), specific(said))


def shows(words: Column, shown: Column) -> Column:
    """What is shown has a specific word of the requirement; any word will do for one without."""
    return F.when(F.size(words) == 0, F.size(shown) > 0).otherwise(F.arrays_overlap(words, shown))


def observable_match(requirement: Column, seen: Column) -> Column:
    """What a case does and expects has a specific word of the requirement; any word will do for one without."""
    return shows(specific(requirement), specific(seen))


def requirement_gaps(requirements: DataFrame, bound: DataFrame, env: str = "env_id") -> DataFrame:
    """Requirements that no valid case covers, with ``code``: REQUIREMENT_ID_HAS_WEAK_CASE_ONLY if one names them, else MISSING_REQUIREMENT_COVERAGE.

    ``bound``: env, ``requirement_id`` and ``passed`` of the bound requirements of valid cases. Generic requirements needn't be covered, nor those with ``required_coverage`` false."""
    wanted = requirements.where((F.coalesce("requirement_id", F.lit("")) != "") & ~is_generic(F.col("text")))
    if "required_coverage" in requirements.columns:
        wanted = wanted.where(F.coalesce("required_coverage", F.lit(True)))
    seen = bound.groupBy(env, "requirement_id").agg(F.some("passed").alias("__covered"))
    joined = wanted.join(growing(seen), [env, "requirement_id"], "left").where(~F.coalesce("__covered", F.lit(False)))
    return joined.withColumn("code", F.when(F.col("__covered").isNull(), "MISSING_REQUIREMENT_COVERAGE").otherwise("REQUIREMENT_ID_HAS_WEAK_CASE_ONLY")).drop("__covered")

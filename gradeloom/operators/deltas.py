"""What operators add to the verifier, as models write it: lists of objects or bare texts, made rows of one form, with what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.values import stable_hash
from gradeloom.operators.gates import holds_any, reasons
from gradeloom.sources.shared import dealt

# The lists of a delta with the prefix of their items' ids; those of checks, whose id has another name; and what a hidden test's code may not consist of.
LISTS = {
    "new_checks": "check",
    "new_hidden_tests": "hidden",
    "exception_tests": "exception",
    "numeric_tolerance_tests": "numeric_tolerance",
    "array_close_tests": "array_close",
    "dataframe_equal_tests": "dataframe_equal",
    "file_output_tests": "file_output",
    "object_state_tests": "object_state",
    "static_checks": "static",
}
CHECK_LISTS = ("new_checks", "static_checks")
WEAK_CODE = [
    "assertinserted_solution_code.strip()",
    "assertsolution.strip()",
    "assertcode.strip()",
    "asserttrue",
    "ortrue",
    "compile(",
]
COLUMNS = ["list", "place", "item_id", "name", "description", "kind", "rule", "pattern", "must_match", "code", "expected_exception", "expected", "tolerance", "source", "test_tier", "counts_as_hidden_test", "eligible_for_clean_export", "error"]


def _lists(parsed: Column) -> Column:
    """Items of all lists of a delta (map of JSON texts): list, place and JSON text; a list that isn't one gives a row without place."""
    one = []
    for name in LISTS:
        raw = F.try_element_at(parsed, F.lit(name))
        texts = F.transform(F.try_variant_get(F.try_parse_json(raw), "$", "array<variant>"), lambda x: F.to_json(x))
        items = F.transform(texts, lambda x, i: F.struct(F.lit(name).alias("list"), (i + 1).alias("place"), x.alias("item")))  # noqa: B023
        wrong = F.array(F.struct(F.lit(name).alias("list"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("item")))
        one.append(F.when(raw.isNull(), F.array().cast("array<struct<list:string,place:int,item:string>>")).otherwise(F.coalesce(items, wrong)))
    return F.flatten(F.array(*one))


def delta_items(operators: DataFrame, delta: str = "delta", owner: str = "operator_id") -> DataFrame:
    """A row per item of ``delta`` (JSON text) of each operator, in one form (COLUMNS), with ``error`` for what is neither object nor text and for lists that aren't lists.

    Operators are dealt to all tasks first, as their deltas are small against the work that they give. Ids come from the item, else from a hash of owner and item. A bare text is its own rule or, if it asserts something, its code; it never counts as a hidden test, nor does an object's code that says nothing."""
    parsed = dealt(operators.select(owner, delta)).select(owner, F.from_json(F.col(delta), "map<string,string>").alias("parsed"))
    rows = parsed.select(owner, F.explode(_lists(F.col("parsed"))).alias("x")).select(owner, "x.*")
    first = F.substring(F.ltrim("item"), 1, 1)
    is_object, is_text = F.col("place").isNotNull() & (first == "{"), F.col("place").isNotNull() & (first == '"')
    prefix = F.element_at(F.create_map(*(F.lit(x) for pair in LISTS.items() for x in pair)), F.col("list"))
    whole = F.concat(F.lit('{"owner_id": '), F.regexp_extract(F.to_json(F.array(F.col(owner))), r"(?s)^\[(.*)\]$", 1), F.lit(', "value": '), F.coalesce("item", F.lit("null")), F.lit("}"))
    rows = rows.withColumns({"own": F.concat_ws("_", prefix, F.substring(stable_hash(whole), 1, 10)), "text": F.when(is_text, F.element_at(F.from_json(F.concat(F.lit("["), "item", F.lit("]")), "array<string>"), 1)), "object": F.when(is_object, F.col("item"))})
    raw = lambda k: F.get_json_object("object", f"$.{k}")
    told = lambda *keys: F.coalesce(*(T.strip(T.present(raw(k))) for k in keys))
    there = lambda k: F.array_contains(F.json_object_keys("object"), k)
    truth = lambda k: F.when(there(k), ~F.coalesce(raw(k), F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")).otherwise(True)
    own = F.col("list")
    check, hidden, static = own.isin(*CHECK_LISTS), own == "new_hidden_tests", own == "static_checks"
    item_id = F.when(check, F.coalesce(told("check_id", "name"), "own")).otherwise(F.coalesce(told("test_id", "name"), "own"))
    asserts = holds_any(F.col("text"), ("assert", "def test_"))
    code = F.when(is_text, F.when(asserts, F.col("text")).when(hidden, "")).when(hidden, F.coalesce(told("code", "assertion_code", "test_code", "execution"), F.lit(""))).otherwise(F.coalesce(F.nullif(raw("code"), F.lit("")), raw("test_code")))
    source = F.when(is_text, "fallback").otherwise(F.coalesce(F.nullif(raw("source"), F.lit("")), F.lit("llm")))
    kind = F.coalesce(told("kind"), F.lit("generic"))
    rows = rows.withColumns({"code": F.when(~check, code), "source": source, "item_id": item_id})
    weak = (F.col("source") == "fallback") | F.coalesce(holds_any(F.replace("code", F.lit(" "), F.lit("")), WEAK_CODE), F.lit(False))
    known = is_object | is_text
    values = {
        "name": F.when(check, F.coalesce(told("name", "check_id"), "item_id")).when(hidden, F.coalesce(told("name", "test_id"), "own")),
        "description": F.when(is_object & (own != "new_checks"), F.coalesce(told("description"), F.lit(""))),
        "kind": F.when(own == "new_checks", kind),
        "rule": F.when(check, F.when(is_text, F.col("text")).otherwise(F.coalesce(told("rule", "description"), F.when(static, "").otherwise(kind)))),
        "pattern": F.when(static, raw("pattern")),
        "must_match": F.when(static, truth("must_match")),
        "code": F.col("code"),
        "expected_exception": F.when(own == "exception_tests", F.coalesce(raw("expected_exception"), F.lit(""))),
        "expected": F.when(own == "numeric_tolerance_tests", raw("expected")),
        "tolerance": F.when(own == "numeric_tolerance_tests", raw("tolerance")),
        "source": F.col("source"),
        "test_tier": F.when(hidden, F.when(weak, "smoke").otherwise(F.coalesce(F.nullif(raw("test_tier"), F.lit("")), F.lit("semantic")))),
        "counts_as_hidden_test": F.when(hidden, truth("counts_as_hidden_test") & ~weak),
        "eligible_for_clean_export": F.when(~check, truth("eligible_for_clean_export") & ~is_text & ~F.when(hidden, weak).otherwise(False)),
    }
    error = F.when(F.col("place").isNull(), "LIST_IS_NOT_A_LIST").when(~known, "ITEM_IS_NEITHER_OBJECT_NOR_TEXT")
    return rows.select(owner, "list", "place", F.when(known, F.col("item_id")).alias("item_id"), *(F.when(known, c).alias(n) for n, c in values.items()), error.alias("error"))


def delta_verdicts(operators: DataFrame, items: DataFrame, owner: str = "operator_id") -> DataFrame:
    """Operators (``axis``, ``test_specs``: a number) with ``errors`` of their delta: items that can't be read leave nothing else to check; else what their axis lacks, then what their items lack."""
    has = lambda name: F.count_if(F.col("list") == name)
    ids = F.collect_list(F.when(F.col("list") == "new_hidden_tests", F.col("item_id")))
    lacks = lambda name, c: F.coalesce(F.some((F.col("list") == name) & c), F.lit(False))
    per = items.groupBy(owner).agg(
        F.array_sort(F.collect_set("error")).alias("unread"), has("new_hidden_tests").alias("tests"), has("new_checks").alias("checks"), (has("static_checks") + has("exception_tests") + has("numeric_tolerance_tests")).alias("others"),
        (F.size(ids) > F.size(F.array_distinct(ids))).alias("twice"), lacks("numeric_tolerance_tests", F.col("expected").isNull() | F.col("tolerance").isNull()).alias("numbers"),
        lacks("exception_tests", F.coalesce("expected_exception", F.lit("")) == "").alias("exceptions"), lacks("static_checks", F.coalesce("rule", F.lit("")) == "").alias("rules"),
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    specs = n(F.col("test_specs"))
    df = operators.join(per, owner, "left").withColumn("unread", F.coalesce("unread", F.array().cast("array<string>")))
    own = reasons(
        ((F.col("axis") == "V") & (n("tests") + n("checks") + specs == 0), "V_WITHOUT_VERIFICATION"),
        (F.col("axis").isin("D", "C", "V", "A") & (n("tests") + n("checks") + n("others") + specs == 0), "NO_EXECUTABLE_DELTA"),
        (F.col("twice"), "DUPLICATE_HIDDEN_TEST_ID"),
        (F.col("numbers"), "NUMERIC_TEST_INCOMPLETE"),
        (F.col("exceptions"), "EXCEPTION_TEST_INCOMPLETE"),
        (F.col("rules"), "STATIC_CHECK_INCOMPLETE"),
    )
    return df.select(*operators.columns, F.when(F.size("unread") > 0, F.col("unread")).otherwise(own).alias("errors"))

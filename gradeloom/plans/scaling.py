"""Queries of the catalogue on scaling: patches, states, requirements, failures and comparisons, each with the same result in DuckDB's SQL."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import constraints, patches, summaries
from gradeloom.plans.catalogue import query, r6
from gradeloom.sources.session import table

AXIS_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'D' WHEN 1 THEN 'C' WHEN 2 THEN 'A' WHEN 3 THEN 'V' ELSE 'X' END"


def _axis(k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(a) for a in "DCAVX")), (k % 5 + 1).cast("int"))


def _operators(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as operators: axis, intensity 1 or 2, name as goal."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("env_id"), F.concat(F.lit("op"), F.col("p_partkey").cast("string")).alias("operator_id"), _axis(F.col("p_partkey")).alias("axis"), (F.col("p_size") % 2 + 1).cast("int").alias("operator_intensity"), F.col("p_name").alias("goal"))


@query(
    f"""
WITH o AS (SELECT p_partkey, p_size % 2 + 1 AS n, {AXIS_SQL} AS axis FROM part), t(axis, state, key, value) AS (VALUES __TEMPLATES__)
SELECT p_partkey, state, key, replace(value, '{{n}}', n::VARCHAR) AS value FROM o JOIN t ON o.axis = t.axis
UNION ALL SELECT p_partkey, 'task', 'axis_constraints', '["' || axis || '"]' FROM o UNION ALL SELECT p_partkey, 'task', 'axis_intensity', n::VARCHAR FROM o
UNION ALL SELECT p_partkey, 'task', 'domain_context', '{{"primary_domain":"any","secondary_domains":["other"]}}' FROM o
UNION ALL SELECT p_partkey, 'data', 'input_format_variants', CASE n WHEN 1 THEN '["extensionless","comment_lines"]' ELSE '["extensionless","comment_lines","empty_sections"]' END FROM o WHERE axis = 'D'
UNION ALL SELECT p_partkey, 'gold', k, CASE WHEN (axis = 'V') = (k <> 'gold_changed') THEN 'true' ELSE 'false' END FROM o, (VALUES ('gold_changed'), ('answer_invariant'), ('seed_gold_compatible_with_scaled_task')) g(k)""".replace(
        "__TEMPLATES__", ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (axis, s, k, json.dumps(v))) + ")" for axis, rows in patches.TEMPLATES.items() for s, k, v in rows)
    )
)
def axis_patches(spark: SparkSession, sf: str) -> DataFrame:
    """All that operators of each axis write, but for the reason why the solution changes."""
    patch = patches.state_patch(F.col("axis"), F.col("operator_intensity"), F.lit("any"), F.array(F.lit("other")))
    return _operators(spark, sf).select(F.col("env_id").alias("p_partkey"), F.inline(patch)).where("key <> 'gold_change_reason'")


def _rows_sql(entries) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + ")" for row in entries)


_HOW = {patches.GOAL: "list", patches.GOAL_TEXT: "text", patches.VARIANT: "id"}
_WANTED = [(axis, s, k, v if v in _HOW.values() else json.dumps(v)) for axis, rows in patches.DEFAULTS.items() for s, k, v in [(s, k, _HOW.get(v, v) if isinstance(v, str) else v) for s, k, v in rows]] + [("X", "task", "operator_goal", "text")]
_OWN = {"D": ("data", "resource_variants"), "C": ("verifier", "constraint_checks"), "A": ("visible", "robustness_trap")}
_GOLD = ("gold_changed", "answer_invariant", "seed_gold_compatible_with_scaled_task")


@query(
    f"""
WITH o AS (SELECT p_partkey, p_name, p_size % 3 AS has, {AXIS_SQL} AS axis FROM part), d(axis, state, key, how) AS (VALUES {_rows_sql(_WANTED)}),
e AS (SELECT p_partkey, state, key, CASE WHEN has = 0 AND key IN ('resource_variants', 'constraint_checks', 'robustness_trap') THEN '"own"'
  WHEN how = 'id' THEN '["op' || p_partkey || '_resource_variant"]' WHEN how = 'text' THEN '"' || p_name || '"' WHEN how = 'list' THEN '["' || p_name || '"]' ELSE how END AS value FROM o JOIN d ON o.axis = d.axis)
SELECT * FROM e UNION ALL SELECT p_partkey, 'gold', k, CASE WHEN (axis = 'V') = (k <> 'gold_changed') THEN 'true' ELSE 'false' END FROM o, (VALUES {_rows_sql((k,) for k in _GOLD)}) g(k) WHERE axis <> 'X'
UNION ALL SELECT p_partkey, 'gold', 'gold_change_reason', CASE WHEN axis = 'V' THEN '"Only the checks grow; the task means the same."' ELSE '"The solution must keep up with what axis ' || axis || ' adds."' END FROM o WHERE axis <> 'X'"""
)
def missing_state_repair(spark: SparkSession, sf: str) -> DataFrame:
    """All entries that an axis can't be without; a third of the parts have one of them already, which stays."""
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for axis, pair in _OWN.items() for x in (axis, pair[i]))), F.col("axis"))
    size = table(spark, sf, "part").select(F.col("p_partkey").alias("env_id"), "p_size")
    ops = _operators(spark, sf).join(size, "env_id")
    given = F.when((F.col("p_size") % 3 == 0) & F.col("axis").isin(*_OWN), F.array(F.struct(pick(0).alias("state"), pick(1).alias("key"), F.lit('"own"').alias("value"))))
    whole = patches.repaired_patch(given.cast(patches.PATCH), F.col("axis"), F.col("operator_id"), F.col("goal"))
    return ops.select(F.col("env_id").alias("p_partkey"), F.inline(whole))


@query(
    """
WITH e AS (SELECT user_id, event_type AS state, 'k' || event_id % 5 AS key, event_id, event_id % 3 = 0 AS plain FROM events),
l AS (SELECT user_id, state, key, coalesce(max(event_id) FILTER (WHERE plain), -1) AS p, max(event_id) AS last FROM e GROUP BY ALL)
SELECT user_id, state, key, '' AS part, p::BIGINT AS n FROM l WHERE p = last
UNION ALL SELECT e.user_id, e.state, e.key, 'p' || e.event_id % 4, max(e.event_id)::BIGINT FROM e JOIN l ON e.user_id = l.user_id AND e.state = l.state AND e.key = l.key AND e.event_id > l.p GROUP BY ALL"""
)
def merged_states(spark: SparkSession, sf: str) -> DataFrame:
    """Events as patches of their user: every third sets a number, the others add a part to an object."""
    i = F.col("event_id")
    text = lambda c: c.cast("string")
    value = F.when(i % 3 == 0, text(i)).otherwise(F.concat(F.lit('{"p'), text(i % 4), F.lit('":'), text(i), F.lit("}")))
    entry = F.struct(F.col("event_type").alias("state"), F.concat(F.lit("k"), text(i % 5)).alias("key"), value.alias("value"))
    states = patches.applied(table(spark, sf, "events").select("user_id", i.alias("position"), F.array(entry).alias("patch")), env="user_id")
    parts = F.when(F.startswith("value", F.lit("{")), F.from_json("value", "map<string,bigint>")).otherwise(F.create_map(F.lit(""), F.col("value").try_cast("bigint")))
    return states.select("user_id", "state", "key", F.explode(parts).alias("part", "n"))


@query(
    """
WITH p AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'A dict with the keys mean and count:' WHEN 1 THEN 'Return a dict.' WHEN 2 THEN 'Print the summary.' WHEN 3 THEN 'Use stdout.'
  WHEN 4 THEN 'Write `a.json`, then b.csv, then stop.' WHEN 5 THEN 'In descending order.' WHEN 6 THEN 'Preserve output contract.' ELSE '' END || ' ' || text AS text FROM documents),
t AS (SELECT doc_id, text, lower(text) AS t FROM p),
w AS (SELECT doc_id, t, list_filter(string_split_regex(replace(text, ',', ' '), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: regexp_matches(x, '\\.(json|csv|txt)$'))[1] AS word FROM t)
SELECT doc_id, CASE WHEN contains(t, 'dict') AND (contains(t, 'key') OR contains(t, 'field')) THEN 'dict_has_keys' WHEN contains(t, 'dict') THEN 'type_is'
  WHEN (contains(t, 'stdout') OR contains(t, 'print')) AND regexp_matches(t, 'mg|kg|filtered mean|summary|warning') THEN 'contains' WHEN contains(t, 'stdout') OR contains(t, 'print') THEN 'non_empty'
  WHEN regexp_matches(t, '\\.json|\\.csv|write|file') THEN 'path_exists' WHEN regexp_matches(t, 'sort|ascending|descending') THEN 'list_sorted'
  WHEN regexp_matches(t, 'preserve output contract|return an integer result') THEN 'non_empty' END AS rule,
  CASE WHEN contains(t, 'dict') AND (contains(t, 'key') OR contains(t, 'field')) THEN array_to_string(list_filter(['mean', 'std', 'valid_count', 'count', 'summary'], lambda k: contains(t, k)), ',')
  WHEN contains(t, 'dict') THEN 'dict' WHEN contains(t, 'stdout') OR contains(t, 'print') THEN coalesce(list_filter(['mg', 'kg', 'filtered mean', 'summary', 'warning'], lambda k: contains(t, k))[1], '')
  WHEN regexp_matches(t, '\\.json|\\.csv|write|file') THEN trim(coalesce(word, ''), '`''"')
  WHEN regexp_matches(t, 'sort|ascending|descending') THEN CASE WHEN contains(t, 'descending') THEN 'descending' ELSE 'ascending' END ELSE '' END AS param FROM w"""
)
def compiled_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents behind a request as requirements: the check that each asks for, and its parameter."""
    asks = ["A dict with the keys mean and count:", "Return a dict.", "Print the summary.", "Use stdout.", "Write `a.json`, then b.csv, then stop.", "In descending order.", "Preserve output contract.", ""]
    ask = F.get(F.array(*map(F.lit, asks)), (F.col("doc_id") % 8).cast("int"))
    c = constraints.requirement_check(F.concat(ask, F.lit(" "), "text"))
    p = F.from_json("c.params", "struct<keys:array<string>,type:string,text:string,path:string,order:string>")
    df = table(spark, sf, "documents").select("doc_id", c.alias("c")).withColumn("p", p)
    return df.select("doc_id", F.col("c.rule").alias("rule"), F.coalesce(F.array_join("p.keys", ","), "p.type", "p.text", "p.path", "p.order", F.lit("")).alias("param"))


# A reason of each kind, in the forms that runs and checks give.
REASONS = {
    "module_not_found": "CASE_EXECUTION_ERROR:ModuleNotFoundError: No module named 'x'",
    "name_error": "CASE_EXECUTION_ERROR:NameError: name 'y' is not defined",
    "exception_mismatch": "CASE_EXECUTION_ERROR:ValueError: bad",
    "return_type_mismatch": "OUTPUT_CONSTRAINT_FAILED:return_type:return type is int",
    "return_keys_mismatch": "OUTPUT_CONSTRAINT_FAILED:return_keys:keys missing: ['a']",
    "return_value_mismatch": "case_1_return_value_equals:return value differs",
    "stdout_mismatch": "OUTPUT_CONSTRAINT_FAILED:stdout_0:stdout lacks the text",
    "stdout_regex_mismatch": "OUTPUT_CONSTRAINT_FAILED:stdout_regex_0:stdout doesn't match",
    "file_artifact_missing": "OUTPUT_CONSTRAINT_FAILED:file_0:file is missing",
    "unresolved_artifact_template": "no such artifact: out/{name}.csv",
}


@query(
    f"""
WITH r AS (SELECT l_orderkey, [{", ".join(f"'{k}'" for k in REASONS)}][l_partkey % 12 + 1] AS kind FROM lineitem)
SELECT l_orderkey, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS kinds, 3 + count(DISTINCT kind) AS rules FROM r GROUP BY 1"""
)
def failure_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as failures of its cases, by part, of ten kinds or none: their kinds, and how many rules a repair gets."""
    reason = F.get(F.array(*map(F.lit, REASONS.values())), (F.col("l_partkey") % 12).cast("int"))
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.coalesce(reason, F.lit("another reason"))).alias("failures"))
    df = per.select("l_orderkey", constraints.failure_types(F.col("failures")).alias("kinds"))
    return df.select("l_orderkey", F.array_join(F.array_sort("kinds"), ",").alias("kinds"), F.size(constraints.repair_rules(F.col("kinds"))).cast("long").alias("rules"))


@query(
    """
WITH c AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS passed FROM lineitem GROUP BY 1),
r AS (SELECT o_orderpriority AS m, coalesce(total, 0) AS total, coalesce(passed, 0) AS passed, o_orderstatus = 'F' AS ok FROM orders LEFT JOIN c ON o_orderkey = l_orderkey),
s AS (SELECT m, count(*) AS num_envs, count(*) FILTER (WHERE ok) / count(*) AS sp, sum(passed) / sum(CASE WHEN total = 0 THEN 1 ELSE total END) AS cp, sum(passed) / sum(total) AS cn,
  count(*) FILTER (WHERE ok AND total > 0) / count(*) FILTER (WHERE total > 0) AS ns FROM r GROUP BY 1), b AS (SELECT * FROM s WHERE m = '1-URGENT')
SELECT s.m AS model_label, round(s.sp - b.sp, 6) AS delta_sample_pass_rate, round(s.cp - b.cp, 6) AS delta_case_pass_rate, round(s.cn - b.cn, 6) AS delta_case_pass_rate_nonzero_only,
  round(s.ns - b.ns, 6) AS delta_nonzero_case_sample_pass_rate FROM s, b WHERE s.m <> '1-URGENT'"""
)
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities as models, orders as their runs, lines as cases: rates less those of the base model."""
    cases = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("total_cases"), F.count_if(F.col("l_returnflag") == "R").alias("passed_cases"))
    runs = table(spark, sf, "orders").join(cases, "o_orderkey", "left").select(
        F.col("o_orderpriority").alias("level"), "total_cases", "passed_cases", F.lit(True).alias("compile_passed"), (F.col("o_orderstatus") == "F").alias("execution_passed"),
        F.array().cast("array<string>").alias("failure_reasons"), F.lit(0).alias("scored_rubrics"), F.lit(0.0).alias("rubric_score"),
    )
    totals = summaries.agent_summary(runs).where("level is not null").withColumnRenamed("level", "model_label").withColumn("model_kind", F.lit("run"))
    out = summaries.comparison_deltas(summaries.comparison_rows(totals), "1-URGENT")
    return out.select("model_label", *(r6(f"delta_{c}").alias(f"delta_{c}") for c in summaries.COMPARED))

"""Queries of the catalogue on cases: evidence, validation, repair, prompts and exposure, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import adapters, case_repair, constraints, evidence, prompts
from gradeloom.plans.catalogue import query, r6
from gradeloom.sources.session import table
from gradeloom.sources.shared import gathered, written

LINE_SQL = "line AS (SELECT o, k, p_name AS name, p_type AS kind FROM (SELECT l_orderkey AS o, l_linenumber AS k, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = part)"
#: The vocabulary of part names has one word that is common to all lists: new.
WORDS_SQL = "list_filter(list_distinct(string_split({0}, ' ')), lambda x: x <> 'new')"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders with the name and type of their part: ``o``, ``k``, ``name``, ``kind``."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p_partkey"))
    return lines.join(table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("kind")), "p_partkey").drop("p_partkey")


def _text(value: str | None, name: str) -> Column:
    return F.lit(value).cast("string").alias(name)


NO_TEXTS = "array<string>"


@query(
    f"""
WITH {LINE_SQL}, w AS (SELECT *, {WORDS_SQL.format("name")} AS w FROM line),
p AS (SELECT c.o, c.k, r.k AS requirement, contains(c.name, r.name) OR contains(r.name, c.name) AS held, len(list_intersect(c.w, r.w)) AS shared, len(r.w) AS n FROM w c JOIN w r ON c.o = r.o AND r.k <= 2)
SELECT o, k, requirement, held, shared::INTEGER AS shared, round(CASE WHEN held THEN 1 ELSE shared / n END, 6) AS score FROM p WHERE held OR (n > 0 AND shared >= least(2, n))"""
)
def case_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as its cases, the parts of lines 1 and 2 as its requirements: pairs whose names cover each other."""
    lines = _lines(spark, sf)
    cases = lines.select("o", F.col("k").alias("case_id"), F.col("name").alias("description"), *(_text(None, c) for c in ("targets_operator_id", "axis", "semantic_intent", "target_constraint", "expected_failure_mode")), F.lit(None).cast(NO_TEXTS).alias("covered_requirements"))
    asked = lines.where("k <= 2").select("o", F.col("k").cast("string").alias("requirement_id"), F.col("k").alias("position"), _text(None, "operator_id"), _text("global", "axis"), F.col("name").alias("text"))
    found = evidence.requirement_evidence(cases, asked, "o")
    return found.select("o", F.col("case_id").alias("k"), F.col("position").alias("requirement"), "held", "shared", r6("score").alias("score"))


@query(
    f"""
WITH {LINE_SQL}, g AS (SELECT o, arg_min(name, k) AS goal, list(name) FILTER (WHERE k <= 2) AS visible FROM line GROUP BY 1),
c AS (SELECT line.*, goal, coalesce(visible, []) AS visible, k % 5 = 0 AS seed, CASE WHEN k % 6 = 5 THEN 'gone' ELSE 'op' END AS target, {WORDS_SQL.format("name")} AS w, {WORDS_SQL.format("goal")} AS g,
  CASE WHEN k % 4 = 3 THEN '' ELSE name || ' ' END || name || ' ' || name || ' m ' || name AS said FROM line JOIN g ON line.o = g.o),
b AS (SELECT *, target = 'op' AND (contains(said, goal) OR contains(goal, said) OR (len(g) > 0 AND len(list_intersect(g, w)) >= least(2, len(g)))) AS bound FROM c)
SELECT o, k, array_to_string(list_filter([
  CASE WHEN k % 4 = 3 THEN 'MISSING_FIELD:description' END,
  CASE WHEN target = 'gone' AND NOT seed THEN 'UNKNOWN_TARGET_OPERATOR_ID:gone' END,
  CASE WHEN bound AND NOT seed AND len(g) > 0 AND NOT (k % 2 = 0 AND len(list_intersect(g, w)) > 0) THEN 'CASE_EXPECTATION_NOT_LINKED_TO_BOUND_REQUIREMENT:r1' END,
  CASE WHEN NOT bound AND NOT seed THEN 'EMPTY_COVERED_REQUIREMENT_IDS' END,
  CASE WHEN NOT seed AND len(list_filter(visible, lambda v: contains(v, name) OR contains(name, v))) = 0 THEN 'COVERED_REQUIREMENTS_NOT_VISIBLE' END,
  CASE WHEN NOT seed AND len(w) < 2 THEN 'CASE_REQUIREMENT_TOO_GENERIC' END,
  CASE WHEN NOT seed AND target = 'op' AND len(w) > 0 AND len(g) > 0 AND len(list_intersect(g, w)) = 0 THEN 'CASE_REQUIREMENT_NOT_LINKED_TO_OPERATOR_SEMANTICS' END,
  CASE WHEN NOT seed AND len(w) > 0 AND k % 2 = 1 THEN 'CASE_EXPECTATION_NOT_LINKED_TO_REQUIREMENT' END], lambda x: x IS NOT NULL), ',') AS failures FROM b"""
)
def case_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as cases of their order's operator, whose goal is the first part's name: what stands against each, with a third of the rules made to fail."""
    lines = gathered(_lines(spark, sf).select("o", "k", "name").where("o IS NOT NULL"), "o")  # an order's few words are shuffled, not the cases made of them
    k, name = F.col("k"), F.col("name")
    cases = lines.select(
        "o", "k", k.cast("string").alias("case_id"), F.when(k % 4 != 3, name).alias("description"), F.when(k % 5 == 0, "seed_baseline").otherwise("coverage_extension").alias("case_kind"),
        F.when(k % 6 == 5, "gone").otherwise("op").alias("targets_operator_id"), _text("D", "axis"), name.alias("semantic_intent"), name.alias("target_constraint"), _text("m", "expected_failure_mode"), _text("", "setup_code"),
        F.when(k % 2 == 0, F.concat(F.lit('result = f("'), name, F.lit('")'))).otherwise("result = f(1)").alias("call_code"), _text("", "assertion_code"), _text('{"return_value": 7}', "expected_output_signature"), F.array(name).alias("covered_requirements"),
    )
    goals = lines.groupBy("o").agg(F.min_by("name", "k").alias("goal"), F.collect_list(F.when(k <= 2, name)).alias("visible_requirements"))
    ops = goals.select("o", _text("op", "operator_id"), _text("D", "axis"), F.col("goal").alias("transformation_goal"), F.array("goal").alias("output_requirements"), F.lit(None).cast("array<struct<state:string,key:string,value:string>>").alias("patch"))
    asked = goals.select("o", _text("r1", "requirement_id"), F.lit(1).alias("position"), _text("op", "operator_id"), _text("D", "axis"), F.col("goal").alias("text"))
    out = constraints.validate_cases(cases, evidence.operator_texts(ops), "o", asked, goals.select("o", "visible_requirements"))
    return out.select("o", "k", F.array_join("failure_reasons", ",").alias("failures"))


@query("SELECT c_custkey, c_custkey % 5 <> 4 AS valid, least(c_custkey % 5, 3)::INTEGER AS repairs FROM customer")
def repaired_case_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as environments with a case each, which a mock model mends at its first, second, third or fourth request, or that needs none; three rounds are allowed."""
    key = F.col("c_custkey").cast("string")
    c = table(spark, sf, "customer").select("c_custkey", key.alias("env_id"))
    goal = "Round each mean to two places and keep the units."
    ops = c.select("env_id", _text("op", "operator_id"), _text("C", "axis"), F.lit(1).alias("position"), F.lit(1).alias("operator_intensity"), _text(goal, "transformation_goal"), F.lit(None).cast("array<struct<state:string,key:string,value:string>>").alias("patch"))
    asked = c.select("env_id", _text("r1", "requirement_id"), F.lit(1).alias("position"), _text("op", "operator_id"), _text("C", "axis"), _text(goal, "text"))
    good, bad = "result = mean(units=2)", ""
    cases = c.select(
        "env_id", F.lit(1).alias("position"), _text("c", "case_id"), _text(goal, "description"), _text("constraint_boundary_case", "case_kind"), _text("op", "targets_operator_id"), _text("C", "axis"), _text(goal, "semantic_intent"), _text(goal, "target_constraint"),
        _text("m", "expected_failure_mode"), _text('{"return_value": 2}', "expected_output_signature"), _text("", "setup_code"), F.when(F.col("c_custkey") % 5 == 0, good).otherwise(bad).alias("call_code"), _text("", "assertion_code"), F.array(F.lit(goal)).alias("covered_requirements"),
    )

    def mend(asked: dict) -> dict:
        if int(asked["env_id"]) % 5 != asked["attempt"]:
            return {}
        return {"cases": [x | {"call_code": good} for x in asked["cases"]]}

    visible = c.select("env_id", F.array(F.lit(goal)).alias("visible_requirements"))
    done = case_repair.validated(cases, ops, asked, visible, adapters.MockClient({"oracle_case_repair": mend}))
    return done.select(F.col("env_id").cast("long").alias("c_custkey"), "valid", "repairs")


@query(
    f"""
WITH {LINE_SQL}, f AS (SELECT o, arg_min(name, k) AS name, arg_min(kind, k) AS kind FROM line GROUP BY 1),
s AS (SELECT *, len(list_filter(list_distinct(string_split(name, ' ')), lambda x: x <> 'new')) >= 2 AS ok, len(list_filter(list_distinct(string_split(lower(kind) || ' ' || name, ' ')), lambda x: x <> 'new')) >= 2 AS told FROM line),
asked AS (
  SELECT o, k % 3 + 1 AS a, k AS b, 1 AS c, name AS t FROM s WHERE ok AND EXISTS (SELECT 1 FROM line l WHERE l.o = s.o AND l.k = s.k % 3 + 1)
  UNION ALL SELECT o, k % 3 + 1, k, 2, kind || ' ' || name FROM s WHERE told AND EXISTS (SELECT 1 FROM line l WHERE l.o = s.o AND l.k = s.k % 3 + 1)
  UNION ALL SELECT o, k % 3 + 1, k, 3, name FROM s WHERE ok AND EXISTS (SELECT 1 FROM line l WHERE l.o = s.o AND l.k = s.k % 3 + 1)
  UNION ALL SELECT o, k, 1000, 4, name FROM s WHERE ok AND k <= 3),
items AS (
  SELECT o, 0 AS a, 1 AS b, 0 AS c, kind AS t FROM f UNION ALL SELECT o, 0, 2, 0, 'Handle scaled input of ' || name FROM f WHERE NOT EXISTS (SELECT 1 FROM asked WHERE asked.o = f.o)
  UNION ALL SELECT o, 0, 3, 0, name FROM f UNION ALL SELECT * FROM asked),
once AS (SELECT *, row_number() OVER (PARTITION BY o, lower(t) ORDER BY a, b, c) AS n FROM items),
list AS (SELECT o, count(*) AS requirements, string_agg('- ' || t, chr(10) ORDER BY a, b, c) AS lines FROM once WHERE n = 1 GROUP BY 1)
SELECT o, requirements, md5('Task ID: ' || o || chr(10) || 'Mode: evaluation' || chr(10) || chr(10) || 'Additional requirements:' || chr(10) || lines || chr(10) || chr(10) || 'Output requirement:' || chr(10)
  || '- return only the code that should replace <<insert solution here>>' || chr(10) || chr(10) || 'Problem:' || chr(10) || name || chr(10) || chr(10) || 'Context:' || chr(10) || kind) AS prompt FROM list JOIN f USING (o)"""
)
def rewritten_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as environments with the prompts that their states, three operators and their cases give."""
    lines = written(_lines(spark, sf), "lines")
    first = lines.groupBy("o").agg(F.min_by("name", "k").alias("name"), F.min_by("kind", "k").alias("kind"))
    visible = F.create_map(F.lit("constraint_hints"), F.to_json(F.array("kind", F.concat(F.lit("Handle scaled input of "), "name"))))
    envs = first.select("o", "name", "kind", visible.alias("visible_state"), F.create_map(F.lit("extra_constraints"), F.to_json(F.array("name"))).alias("task_state"))
    op = lambda k: F.concat(F.lit("op"), k.cast("string"))
    ops = lines.where("k <= 3").select("o", op(F.col("k")).alias("operator_id"), _text("D", "axis"), F.col("k").alias("position"), F.concat(F.lit("Verify that  "), "name").alias("transformation_goal"), F.lit(None).cast(NO_TEXTS).alias("output_requirements"))
    cases = lines.select(
        "o", F.col("k").cast("string").alias("case_id"), F.col("k").alias("position"), op(F.col("k") % 3 + 1).alias("targets_operator_id"), _text("D", "axis"), F.col("name").alias("target_constraint"), _text(None, "semantic_intent"),
        F.concat("kind", F.lit(" "), "name").alias("description"), F.array("name").alias("covered_requirements"),
    )
    out = prompts.requirements_of(envs, ops, cases, "o")
    text = prompts.prompt(F.col("o").cast("string"), F.col("requirements"), F.col("name"), F.col("kind"))
    return out.select("o", F.size("requirements").cast("long").alias("requirements"), F.md5(text.cast("binary")).alias("prompt"))


@query(
    f"""
WITH {LINE_SQL}, n AS (SELECT o, arg_min(name, k) AS first, arg_max(name, k) AS last, max(CASE WHEN k <= 2 THEN name ELSE '' END) AS other FROM line GROUP BY 1),
w AS (SELECT o, {WORDS_SQL.format("last")} AS seed, CASE WHEN o % 2 = 0 THEN {WORDS_SQL.format("first || ' ' || other")} ELSE list_filter({WORDS_SQL.format("first")}, lambda x: NOT list_contains({WORDS_SQL.format("last")}, x)) END AS shown FROM n)
SELECT line.o, k, len(list_filter({WORDS_SQL.format("name")}, lambda x: list_contains(shown, x) AND NOT list_contains(seed, x))) >= 2 AS exposed FROM line JOIN w ON line.o = w.o"""
)
def operator_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as operators of their order: the prompt gives them away, by the requirements that it lists or, for odd orders, as a whole less the seed's words."""
    lines = written(_lines(spark, sf), "lines")
    n = lines.groupBy("o").agg(F.min_by("name", "k").alias("first"), F.max_by("name", "k").alias("last"), F.max(F.when(F.col("k") <= 2, F.col("name")).otherwise("")).alias("other"))
    listed = F.when(F.col("o") % 2 == 0, F.array("first", "other")).otherwise(F.array().cast(NO_TEXTS))
    envs = n.select("o", prompts.prompt(F.col("o").cast("string"), listed, F.col("last"), F.col("first")).alias("user_prompt"), F.col("last").alias("seed_text"))
    op = F.concat(F.lit("op"), F.col("k").cast("string"))
    ops = lines.select("o", "k", op.alias("operator_id"), _text("D", "axis"), F.col("name").alias("transformation_goal"), F.lit(None).cast("array<struct<state:string,key:string,value:string>>").alias("patch"))
    cases = lines.select(
        "o", F.col("k").cast("string").alias("case_id"), op.alias("targets_operator_id"), _text("coverage_extension", "case_kind"), _text("D", "axis"), F.col("name").alias("description"), *(_text("", c) for c in ("semantic_intent", "target_constraint", "expected_failure_mode", "setup_code", "assertion_code")),
        _text("result = f(1)", "call_code"), _text('{"return_value": 7}', "expected_output_signature"), F.array("name").alias("covered_requirements"),
    )
    return prompts.exposures(ops, cases, envs, "o").select("o", "k", "exposed")

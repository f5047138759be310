"""Queries of the catalogue on gates, decisions and links: each with the same result in DuckDB's SQL. Orders are environments, their lines the cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import replies
from gradeloom.operators import constraints, deltas, exports, gates, rubrics, splits, verifiers
from gradeloom.plans.cases import LINE_SQL, _lines, _text
from gradeloom.plans.catalogue import query
from gradeloom.sources.session import table

#: A set of lines as text, in SQL and here.
SET_SQL = "coalesce(string_agg(DISTINCT {0}, ',' ORDER BY {0}) FILTER (WHERE {1}), '')"


def _told(gate: Column) -> list[Column]:
    """What a gate says, as plain columns."""
    return [gate["severity"].alias("severity"), gate["passed"].alias("passed"), F.array_join(gate["failure_reasons"], ",").alias("failures"), F.array_join(gate["warnings"], ",").alias("warnings")]


def _verdict_sql(hard: str) -> str:
    """Severity and pass from failures ``f``, warnings ``w`` and a condition for hard ones."""
    return f"""CASE WHEN {hard} THEN 'hard_fail' WHEN f <> '' THEN 'soft_fail' WHEN w <> '' THEN 'pass_with_warning' ELSE 'pass' END AS severity, f = '' AS passed, f AS failures, w AS warnings"""


def _codes_sql(*rules: tuple[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {code if code.startswith('(') else repr(code)} END" for c, code in rules) + "], lambda x: x IS NOT NULL AND x <> ''), ',')"


@query(
    f"""
WITH c AS (SELECT l_orderkey AS o, l_linenumber::VARCHAR AS k, bool_and(l_returnflag <> 'R') AS passed FROM lineitem GROUP BY 1, 2),
g AS (SELECT o_orderkey AS o, count(k) AS n, coalesce(string_agg('CASE_FAILED:' || k, ',' ORDER BY k) FILTER (WHERE NOT passed), '') AS failed FROM orders LEFT JOIN c ON o = o_orderkey GROUP BY 1),
t AS (SELECT o, CASE WHEN n = 0 THEN 'SCALED_GOLD_CASE_EXECUTION_REPORT_MISSING' ELSE failed END AS f, '' AS w FROM g)
SELECT o, {_verdict_sql("f <> ''")} FROM t"""
)
def gold_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose solution passes all their cases; a returned line is a case that failed, and an order without lines has no report."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("string").alias("case_id")).agg(F.every(F.col("l_returnflag") != "R").alias("passed"))
    reports = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o")).join(c, "o", "left")
    return gates.gold_execution_gate(reports, "o").select("o", *_told(F.col("gate")))


@query(
    f"""
WITH s AS (SELECT l_orderkey AS o, list(DISTINCT l_linenumber::VARCHAR) AS ops, coalesce(list(DISTINCT l_linenumber::VARCHAR) FILTER (WHERE l_quantity > 10), []) AS covered, count(*) FILTER (WHERE l_returnflag <> 'R') AS valid,
  list(DISTINCT l_linestatus) AS asked, coalesce(list(DISTINCT l_linestatus) FILTER (WHERE l_returnflag = 'A'), []) AS done FROM lineitem GROUP BY 1),
m AS (SELECT *, coalesce((SELECT string_agg('NO_VALID_ORACLE_CASE_FOR_OPERATOR:' || x, ',' ORDER BY x) FROM (SELECT unnest(list_filter(ops, lambda y: NOT list_contains(covered, y))) AS x)), '') AS missing FROM s),
t AS (SELECT o, valid, missing, {_codes_sql(("valid = 0", "NO_VALIDATED_ORACLE_CASES"), ("len(done) = 0", "NO_CASE_REQUIREMENT_COVERAGE"), ("true", "(missing)"))} AS f,
  {_codes_sql(("len(done) > 0 AND len(done) < len(asked)", "PARTIAL_CASE_REQUIREMENT_COVERAGE"))} AS w FROM m)
SELECT o, {_verdict_sql("valid = 0 OR missing <> ''")} FROM t"""
)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by what their cases cover: line numbers as operators, covered by large lines; line states as requirements, covered by lines of one flag."""
    k = F.col("l_linenumber").cast("string")
    some = lambda c, of: F.array_sort(F.collect_set(F.when(c, of)))
    envs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(
        some(F.lit(True), k).alias("operators"), some(F.col("l_quantity") > 10, k).alias("covered_operators"), F.count_if(F.col("l_returnflag") != "R").alias("valid_cases"),
        some(F.lit(True), F.col("l_linestatus")).alias("requirements"), some(F.col("l_returnflag") == "A", F.col("l_linestatus")).alias("covered_requirements"),
    )
    return gates.oracle_quality_gate(envs, "o").select("o", *_told(F.col("gate")))


@query(
    f"""
WITH s AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS semantic, count(*) FILTER (WHERE l_discount > 0.09) AS weak, count(*) FILTER (WHERE l_tax > 0.07) AS loose,
  count(*) FILTER (WHERE l_quantity > 45) AS silent, l_orderkey % 3 AS v FROM lineitem GROUP BY 1),
t AS (SELECT *, {_codes_sql(("o % 11 = 0", "SYNTAX"), ("weak > 0", "WEAK_HIDDEN_TEST"), ("loose > 0", "UNTARGETED_HIDDEN_TEST"), ("v > 0 AND semantic = 0", "NO_VALID_SEMANTIC_HIDDEN_TEST"), ("semantic > 0 AND semantic < v", "V_NOT_ENOUGH_SEMANTIC_TESTS"))} AS f,
  {_codes_sql(("silent > 0", "MISSING_EXPECTED_FAILURE_MODE"))} AS w FROM s)
SELECT o, {_verdict_sql("v > 0 AND semantic = 0")} FROM t"""
)
def hidden_test_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by their lines as hidden tests: weak, without target, not enough of meaning, or silent on how they fail."""
    count = lambda c, name: F.count_if(c).alias(name)
    envs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(
        F.count("*").alias("tests"), count(F.col("l_returnflag") == "A", "semantic_tests"), count(F.col("l_discount") > 0.09, "weak_tests"), count(F.col("l_tax") > 0.07, "untargeted_tests"), count(F.col("l_quantity") > 45, "without_failure_mode")
    )
    envs = envs.withColumns({"v_intensity": F.col("o") % 3, "execution_errors": F.when(F.col("o") % 11 == 0, F.array(F.lit("SYNTAX")))})
    return gates.hidden_tests_gate(envs).select("o", *_told(F.col("gate")))


@query(
    f"""
WITH s AS (SELECT l_orderkey AS o, list(DISTINCT l_linenumber) AS asked, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_quantity > 25), []) AS tested, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_discount > 0.03), []) AS known FROM lineitem GROUP BY 1),
c AS (SELECT *, o % 2 = 0 AS same, o % 3 = 0 AS invariant, o % 5 = 0 AS silent, o % 7 = 0 AS empty, len(list_filter(asked, lambda x: NOT list_contains(tested, x))) AS untested, len(list_filter(asked, lambda x: NOT list_contains(known, x))) AS unknown,
  len(list_filter(asked, lambda x: NOT list_contains(tested, x) AND NOT list_contains(known, x))) > 0 AS broken FROM s),
t AS (SELECT *, {_codes_sql(("same AND NOT invariant", "SEED_GOLD_REUSED_WITHOUT_JUSTIFICATION"), ("invariant AND silent", "GOLD_INVARIANT_WITHOUT_JUSTIFICATION"), ("len(tested) = 0", "NO_TEST_COVERS_NEW_REQUIREMENT"), ("empty", "VERIFIER_STATE_EMPTY"), ("len(known) = 0", "VERIFIER_DOES_NOT_KNOW_NEW_REQUIREMENT"), ("broken", "REQUIREMENT_CHAIN_BROKEN"))} AS f,
  {_codes_sql(("untested > 0", "ADDED_REQUIREMENT_NOT_TESTED"), ("unknown > 0", "PARTIAL_VERIFIER_REQUIREMENT_COVERAGE"), ("o % 13 = 0", "OPERATOR_REALIZATION_ALREADY_FAILED"))} AS w FROM c)
SELECT o, {_verdict_sql("len(tested) = 0 OR broken")} FROM t"""
)
def consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by the chain from line numbers as requirements to those that are tested and known to the verifier, and by what is said of their solution."""
    some = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("l_linenumber"))))
    envs = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(some(F.lit(True)).alias("requirements"), some(F.col("l_quantity") > 25).alias("tested"), some(F.col("l_discount") > 0.03).alias("verified"))
    o = F.col("o")
    envs = envs.withColumns({
        "gold_solution": F.when(o % 2 == 0, "code").otherwise("other code"), "seed_gold": F.lit(" code"), "gold_changed": F.lit(True), "answer_invariant": o % 3 == 0, "change_reason": F.when(o % 5 != 0, "said"),
        "verifier_state": F.when(o % 7 != 0, "state"), "operator_severity": F.when(o % 13 == 0, "soft_fail").otherwise("pass"),
    })
    return gates.consistency_gate(envs).select("o", *_told(F.col("gate")))


@query(
    """
WITH s AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ['pass', 'pass_with_warning', 'soft_fail', 'hard_fail'][o_orderkey % 4 + 1] END AS op FROM orders),
g AS (SELECT l_orderkey AS o, string_agg('REASON_' || l_linenumber, ',' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R') AS bad FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1)
SELECT s.o, coalesce(op IN ('pass', 'pass_with_warning'), false) AND bad IS NULL AS passed, CASE WHEN coalesce(op IN ('pass', 'pass_with_warning'), false) AND bad IS NULL THEN 'clean' ELSE 'rejected' END AS final_decision,
  concat_ws(',', CASE WHEN op IS NULL THEN 'OPERATOR_REALIZATION_REPORT_MISSING,OPERATOR_REALIZATION_HARD_FAIL' WHEN op LIKE '%fail' THEN 'OWN,OPERATOR_REALIZATION_' || upper(op) END, bad) AS reasons
FROM s LEFT JOIN g ON s.o = g.o"""
)
def final_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders accepted or rejected by the worst report on their operators, which a fifth lacks, and their lines as gates, of which returned ones failed."""
    o = F.col("o")
    envs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o"))
    level = F.get(F.array(*map(F.lit, gates.SEVERITIES)), (o % 4).cast("int"))
    reports = envs.where(o % 5 != 0).select("o", level.alias("severity"), F.array(F.lit("OWN")).alias("failure_reasons"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("position"), "l_returnflag").distinct()
    made = lines.select("o", "position", F.when(F.col("l_returnflag") == "R", "soft_fail").otherwise("pass").alias("severity"), F.array(F.concat(F.lit("REASON_"), F.col("position").cast("string"))).alias("failure_reasons"))
    out = gates.final_decision(envs, reports, made, "o")
    return out.select("o", "passed", "final_decision", F.array_join("rejection_reasons", ",").alias("reasons"))


@query(
    f"""
WITH {LINE_SQL}
SELECT a.o, a.k AS op, b.k AS case_id FROM line a JOIN line b ON a.o = b.o AND a.k <= 4 AND CASE WHEN b.k % 3 = 0 THEN a.kind = b.kind ELSE a.k IN (b.k % 4 + 1, 1) END"""
)
def linked_case_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as operators and cases of their order: a case names two operators, or for every third line none and goes by its part's type as axis."""
    lines = _lines(spark, sf)
    op = lambda k: k.cast("string")
    ops = lines.where("k <= 4").select("o", op(F.col("k")).alias("operator_id"), F.col("kind").alias("axis"))
    cases = lines.select("o", op(F.col("k")).alias("case_id"), F.col("kind").alias("axis"), F.when(F.col("k") % 3 != 0, F.concat(op(F.col("k") % 4 + 1), F.lit(" , 1"))).alias("targets"))
    return rubrics.linked_cases(ops, cases, "o").select("o", F.col("operator_id").cast("int").alias("op"), F.col("case_id").cast("int").alias("case_id"))


@query(
    f"""
WITH {LINE_SQL}
SELECT a.o, a.k, EXISTS (SELECT 1 FROM line b WHERE b.o = a.o AND b.k > 1 AND (a.k % 2 = 0 OR b.k % 2 = 0 OR a.k = b.k) AND (a.kind = b.kind) AND len(list_filter(string_split(a.name, ' '), lambda w: contains(b.name, w))) > 0) AS covered FROM line a"""
)
def hidden_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as requirements, of which odd ones belong to an operator, covered by the order's other lines as tests of the same type that hold a word."""
    lines = _lines(spark, sf)
    op = F.when(F.col("k") % 2 == 1, F.col("k").cast("string"))
    asked = lines.select("o", "k", F.col("k").cast("string").alias("requirement_id"), op.alias("operator_id"), F.col("kind").alias("axis"), F.col("name").alias("text"))
    tests = lines.where("k > 1").select("o", op.alias("operator_id"), F.col("kind").alias("axis"), F.upper("name").alias("text"))
    return rubrics.hidden_test_coverage(asked, tests, "o").select("o", "k", "covered")


@query(
    f"""
WITH {LINE_SQL}, f AS (SELECT o, name, min(k) AS k FROM line WHERE k > 1 GROUP BY 1, 2)
SELECT line.o, line.k, f.k AS source FROM line LEFT JOIN f ON line.o = f.o AND line.name = f.name"""
)
def requirement_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as requirements with the first operator, from the second line on, whose text is theirs but for case and blanks."""
    lines = _lines(spark, sf)
    asked = lines.select("o", "k", F.upper("name").alias("text"))
    given = lines.where("k > 1").select("o", F.col("k").alias("position"), F.col("k").alias("operator_id"), F.concat(F.lit("  "), F.replace("name", F.lit(" "), F.lit("   "))).alias("text"))
    return rubrics.with_sources(asked, given, "o").select("o", "k", F.col("operator_id").alias("source"))


@query(
    f"""
WITH {LINE_SQL}
SELECT o, k, CASE WHEN k <> 1 THEN kind <> (SELECT kind FROM line b WHERE b.o = line.o AND b.k = 1) OR name <> (SELECT name FROM line b WHERE b.o = line.o AND b.k = 1) END AS changed FROM line"""
)
def changed_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as levels of their order: whether name and type differ from those of the first line, null for that and for orders without one."""
    out = gates.semantic_change(_lines(spark, sf), ["name", "kind"], "o", "k", 1)
    return out.select("o", "k", "changed")


@query(
    """
WITH r AS (SELECT l_orderkey AS o, l_linenumber AS k, bool_and(l_returnflag <> 'R') AS passed FROM lineitem GROUP BY 1, 2), c AS (SELECT l_orderkey AS o, l_linenumber AS k, min(l_partkey) AS part FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2)
SELECT r.o, r.k, part FROM r LEFT JOIN c ON r.o = c.o AND r.k = c.k WHERE NOT passed"""
)
def failed_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines as failed reports, with their case where it is still there (large lines)."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("case_id"), "l_returnflag", "l_quantity", "l_partkey")
    reports = lines.groupBy("o", "case_id").agg(F.every(F.col("l_returnflag") != "R").alias("passed"))
    cases = lines.where("l_quantity > 10").groupBy("o", "case_id").agg(F.min("l_partkey").alias("part"))
    return constraints.failed_diffs(reports, cases, "o").select("o", F.col("case_id").alias("k"), "part")


@query(
    """
WITH b AS (SELECT o_orderkey AS k, o_custkey AS run, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey), n AS (SELECT p_partkey * 2 AS k, p_size AS run, p_brand AS status FROM part)
SELECT coalesce(n.k, b.k) AS k, coalesce(n.run, b.run)::BIGINT AS run, coalesce(n.status, b.status) AS status FROM b FULL JOIN n ON n.k = b.k"""
)
def completed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with run, trace and evaluation from three tables; parts as checkpoint rows take their place or add to them."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("env_id"), F.col("o_custkey").cast("long").alias("v"), F.col("o_orderstatus").alias("s"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("v"))
    traced = o.join(c, "v", "left_semi").select("env_id", "s")
    p = table(spark, sf, "part").select((F.col("p_partkey") * 2).alias("env_id"), F.struct(F.col("p_size").cast("long").alias("v")).alias("run"), *(F.struct(F.col("p_brand").alias("s")).alias(n) for n in ("trace", "eval")))
    out = exports.completed_rows(o.select("env_id", "v"), traced, o.select("env_id", "s"), p)
    return out.select(F.col("env_id").alias("k"), F.col("run.v").alias("run"), F.col("eval.s").alias("status"))


@query(
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'dev' WHEN o_orderkey % 4 = 1 THEN 'test' WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 2 THEN 'dev' ELSE 'train' END AS split FROM orders
WHERE CASE WHEN o_orderkey % 4 = 0 THEN 'dev' WHEN o_orderkey % 4 = 1 THEN 'test' WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 2 THEN 'dev' ELSE 'train' END = 'dev'"""
)
def chosen_split(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one split: the assigned one, else the row's own, else train, also for names that aren't known."""
    given = F.get(F.array(F.lit("DEV"), F.lit("test"), F.lit(None), F.lit("validation")), (F.col("o_orderkey") % 4).cast("int"))
    own = F.when(F.col("o_orderstatus") == "F", "dev").otherwise("other")
    rows = table(spark, sf, "orders").select("o_orderkey", splits.assigned_split(given, own).alias("split"))
    return splits.select_split(rows, "dev")


@query(
    f"""
WITH {LINE_SQL}, op AS (SELECT o, string_agg(k::VARCHAR, ',' ORDER BY k) AS ids, count(*) AS n FROM line WHERE k <= 3 GROUP BY 1)
SELECT o_orderkey AS o, CASE WHEN o_orderkey % 5 = 0 THEN 'blocked' ELSE 'ready' END AS status, greatest(CASE WHEN o_orderkey % 4 = 0 OR n IS NULL THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 4 = 3 THEN 2 ELSE 0 END)::INTEGER AS required_cases,
  greatest(0, coalesce(n, 0) - 1)::INTEGER AS additional_cases, coalesce(ids, '') AS targets FROM orders LEFT JOIN op ON op.o = o_orderkey"""
)
def planned_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as environments of four levels with up to three operators: the plan of their cases."""
    o = F.col("o")
    envs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("o")).select(
        o.alias("env_id"), F.concat(F.lit("M"), (o % 4 + 1).cast("string")).alias("level"), _text("g", "gold_solution"), F.when(o % 5 != 0, "result = 1").otherwise(" ").alias("call_code"), _text("{}", "expected_output")
    )
    ops = _lines(spark, sf).where("k <= 3").select(F.col("o").alias("env_id"), F.col("k").alias("position"), F.col("k").cast("string").alias("operator_id"))
    out = verifiers.case_plans(envs, ops, {"M4": 2})
    return out.select(F.col("env_id").alias("o"), "status", "required_cases", "additional_cases", F.col("targets_operator_id").alias("targets"))


@query(
    """
SELECT p_partkey, 'new_checks' AS list, 1 AS place, p_name AS rule, NULL AS code, 'fallback' AS source, NULL AS counts, NULL AS error FROM part WHERE p_size % 3 <> 2
UNION ALL SELECT p_partkey, 'new_checks', 2, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'generic' END, NULL, 'llm', NULL, NULL FROM part WHERE p_size % 3 <> 2
UNION ALL SELECT p_partkey, 'new_checks', NULL, NULL, NULL, NULL, NULL, 'LIST_IS_NOT_A_LIST' FROM part WHERE p_size % 3 = 2
UNION ALL SELECT p_partkey, 'new_hidden_tests', 1, NULL, CASE WHEN p_size % 2 = 0 THEN 'assert ' || p_name ELSE 'compile( ' || p_name END, 'llm', p_size % 2 = 0, NULL FROM part
UNION ALL SELECT p_partkey, 'new_hidden_tests', 2, NULL, 'assert ' || p_brand, 'fallback', false, NULL FROM part
UNION ALL SELECT p_partkey, 'static_checks', 1, NULL, NULL, NULL, NULL, 'ITEM_IS_NEITHER_OBJECT_NOR_TEXT' FROM part
UNION ALL SELECT p_partkey, 'static_checks', 2, p_type, NULL, p_brand, NULL, NULL FROM part"""
)
def delta_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as operators whose verifier deltas hold texts, objects, numbers and lists that aren't lists: each item in one form."""
    p = table(spark, sf, "part")
    even = F.col("p_size") % 2 == 0
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    checks = F.when(F.col("p_size") % 3 == 2, quoted(F.col("p_name"))).otherwise(F.concat(F.lit("["), quoted(F.col("p_name")), F.lit(","), F.to_json(F.struct(F.col("p_brand").alias("name"), F.when(even, F.col("p_type")).alias("rule"))), F.lit("]")))
    code = F.concat(F.when(even, "assert ").otherwise("compile( "), "p_name")
    tests = F.concat(F.lit("["), F.to_json(F.struct(F.col("p_brand").alias("test_id"), code.alias("code"))), F.lit(","), quoted(F.concat(F.lit("assert "), "p_brand")), F.lit("]"))
    static = F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit(","), F.to_json(F.struct(F.col("p_type").alias("description"), F.col("p_brand").alias("source"))), F.lit("]"))
    delta = F.concat(F.lit('{"new_checks":'), checks, F.lit(',"new_hidden_tests":'), tests, F.lit(',"static_checks":'), static, F.lit("}"))
    items = deltas.delta_items(p.select(F.col("p_partkey").cast("string").alias("operator_id"), delta.alias("delta")))
    return items.select(F.col("operator_id").cast("long").alias("p_partkey"), "list", "place", "rule", "code", "source", F.col("counts_as_hidden_test").alias("counts"), "error")


@query(
    """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type ELSE 'submit_final_code' END AS name,
  CASE event_id % 5 WHEN 0 THEN '{"k":' || event_id || '}' WHEN 1 THEN '{"code": "x = ' || event_id || '"}' ELSE '{"code":"print(\\"' || event_type || '\\")"}' END AS arguments FROM events WHERE event_id % 5 < 3"""
)
def reply_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as replies of a model: a call, arguments alone, a call whose code breaks the JSON, an answer and plain words; the calls that they make."""
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    i, kind = F.col("event_id"), F.col("event_type")
    forms = [
        text('{"tool_calls": [{"name": "', kind, '", "arguments": {"k": ', i, "}}]}"), text('{"code": "x = ', i, '"}'), text('{"tool_calls": [{"name": "submit_final_code", "arguments": {"code": "print("', kind, '")"}}]}'),
        text('{"final_code": "x = ', i, '"}'), text("No call: ", kind),
    ]
    calls = replies.tool_calls(F.get(F.array(*forms), (i % 5).cast("int")), ["submit_final_code"])
    return table(spark, sf, "events").select("event_id", F.explode(calls).alias("c")).select("event_id", "c.name", "c.arguments")

"""Queries that apply the library's operators to the driver tables, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators import episodes, exports, gates, planning, ranks, rubrics, scoring, splits, summaries, taxonomy, upserts
from gradeloom.sources.session import table
from gradeloom.sources.shared import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def long(c: Column | str) -> Column:
    return T.col(c).cast("long")


def r6(c: Column | str) -> Column:
    return F.round(T.col(c), 6)


REWARD_CTE = """
cases AS (
  SELECT l_orderkey, count(*) AS total_cases, count(*) FILTER (WHERE l_returnflag = 'R') AS passed_cases,
    count(*) FILTER (WHERE l_quantity > 45) AS violations, avg(l_discount) * 10 AS rubric_score
  FROM lineitem GROUP BY l_orderkey
), runs AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority AS level, coalesce(total_cases, 0) AS total_cases, coalesce(passed_cases, 0) AS passed_cases,
    coalesce(violations, 0) AS violations, coalesce(rubric_score, 0) AS rubric_score
  FROM orders LEFT JOIN cases ON o_orderkey = l_orderkey
), rewards AS (
  SELECT o_orderkey, level, total_cases, passed_cases, violations, rubric_score, o_orderstatus = 'F' AND total_cases > 0 AS sample_pass,
    (CASE WHEN o_orderstatus = 'F' AND total_cases > 0 THEN 1.0 ELSE 0.0 END)
    + 0.5 * (CASE WHEN total_cases > 0 THEN passed_cases::DOUBLE / total_cases ELSE 0.0 END)
    + 0.4 * rubric_score
    + 0.1 * (CASE WHEN total_cases > 0 OR o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END)
    + 0.1 * (CASE WHEN o_orderstatus = 'F' AND total_cases > 0 AND violations = 0 THEN 1.0 ELSE 0.0 END)
    - 0.2 * (CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END)
    - 0.1 * (CASE WHEN level = '1-URGENT' THEN 1.0 ELSE 0.0 END)
    - 0.1 * least(violations, 3) AS reward
  FROM runs
)"""


def _rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rollouts: lines are cases, returned ones passed; a large quantity is a budget violation."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("total_cases"),
        F.count_if(F.col("l_returnflag") == "R").alias("passed_cases"),
        F.count_if(F.col("l_quantity") > 45).alias("violations"),
        (F.avg("l_discount") * 10).alias("rubric_score"),
    )
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("level"))
    j = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<string>")
    event = F.struct(F.lit(True).alias("budget_violation"), F.lit("").alias("result"), F.lit("").alias("budget_error"))
    return j.select(
        "o_orderkey",
        "level",
        (F.col("o_orderstatus") == "F").alias("execution_passed"),
        (F.col("o_orderstatus") != "P").alias("compile_passed"),
        "passed_cases",
        "total_cases",
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit(scoring.NO_SUBMIT))).otherwise(none).alias("failure_reasons"),
        F.when(F.col("level") == "1-URGENT", F.array(F.lit('{"stderr": "Traceback"}'))).otherwise(none).alias("case_reports"),
        none.alias("notes"),
        F.array_repeat(event, F.coalesce("violations", F.lit(0)).cast("int")).alias("tool_trace"),
        F.coalesce("rubric_score", F.lit(0.0)).alias("rubric_score"),
    )


@query("WITH " + REWARD_CTE + "SELECT o_orderkey, round(reward, 6) AS reward, sample_pass, violations AS tool_budget_violation_count FROM rewards")
def reward_by_order(spark: SparkSession, sf: str) -> DataFrame:
    out = scoring.with_reward(_rollouts(spark, sf), use_rubric=True)
    return out.select("o_orderkey", r6("reward").alias("reward"), "sample_pass", long("tool_budget_violation_count").alias("tool_budget_violation_count"))


@query(
    "WITH "
    + REWARD_CTE
    + """
SELECT level, count(*) AS rollouts, round(avg(reward), 6) AS mean_reward, count(*) FILTER (WHERE sample_pass) AS passed,
  sum(passed_cases)::BIGINT AS passed_cases, sum(total_cases)::BIGINT AS total_cases,
  round(coalesce(sum(passed_cases)::DOUBLE / nullif(sum(total_cases), 0), 0), 6) AS case_pass_rate, round(count(*) FILTER (WHERE violations = 0)::DOUBLE / count(*), 6) AS budget_ok_rate
FROM rewards GROUP BY GROUPING SETS ((level), ())"""
)
def reward_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = scoring.with_reward(_rollouts(spark, sf), use_rubric=True).withColumns({"scored_rubrics": F.lit(1), "execution_passed": F.col("sample_pass")})
    out = summaries.reward_summary(rows)
    return out.select("level", "rollouts", r6("mean_reward").alias("mean_reward"), F.col("execution_passed").alias("passed"), "passed_cases", "total_cases", r6("case_pass_rate").alias("case_pass_rate"), r6("budget_ok_rate").alias("budget_ok_rate"))


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN sd > 1e-8 THEN (l_extendedprice - mean) / sd ELSE 0 END, 6) AS advantage
FROM (SELECT *, avg(l_extendedprice) OVER w AS mean, stddev_pop(l_extendedprice) OVER w AS sd FROM lineitem WINDOW w AS (PARTITION BY l_orderkey))"""
)
def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    out = lines.withColumn("advantage", r6(scoring.window_advantage("l_extendedprice", ["l_orderkey"])))
    return out.drop("l_extendedprice")


@query(
    """
SELECT event_type, user_id, event_id, round(CASE WHEN sd > 1e-8 THEN (value - mean) / sd ELSE 0 END, 6) AS advantage
FROM (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY event_type))"""
)
def group_advantage_skewed(spark: SparkSession, sf: str) -> DataFrame:
    """Few large groups: moments are aggregated first and joined, nothing is sorted."""
    out = scoring.group_advantages(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", "user_id", "event_id", r6("advantage").alias("advantage"))


@query(
    """
SELECT event_type AS level, count(*) AS rollouts, round(avg(value), 4) AS mean_reward, count(*) FILTER (WHERE value > 50) AS passed,
  round(count(*) FILTER (WHERE value > 50)::DOUBLE / count(*), 6) AS sample_pass_rate
FROM events GROUP BY GROUPING SETS ((event_type), ())"""
)
def level_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("level"), F.col("value").alias("reward"), (F.col("value") > 50).alias("execution_passed"))
    zeros = {c: F.lit(0) for c in ("rubric_score", "scored_rubrics", "passed_cases", "total_cases", "tool_budget_violation_count")}
    out = summaries.reward_summary(e.withColumns(zeros | {"budget_ok": F.lit(True), "tool_budget_violation": F.lit(False)}))
    return out.select("level", "rollouts", F.round("mean_reward", 4).alias("mean_reward"), F.col("execution_passed").alias("passed"), r6("sample_pass_rate").alias("sample_pass_rate"))


@query(
    """
WITH per AS (
  SELECT c_custkey, c_mktsegment, count(o_orderkey) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment
)
SELECT c_mktsegment AS level, count(*) AS samples, count(*) FILTER (WHERE total = 0) AS zero_case_samples, sum(passed)::BIGINT AS passed_cases, sum(total)::BIGINT AS total_cases,
  round(sum(passed)::DOUBLE / (sum(total) + count(*) FILTER (WHERE total = 0)), 6) AS case_pass_rate,
  round(coalesce(sum(passed)::DOUBLE / nullif(sum(total), 0), 0), 6) AS case_pass_rate_nonzero_only
FROM per GROUP BY GROUPING SETS ((c_mktsegment), ())"""
)
def zero_case_rate(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("total_cases"), F.count_if(F.col("o_orderstatus") == "F").alias("passed_cases"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("level"))
    rows = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").withColumns(
        {"compile_passed": F.lit(True), "execution_passed": F.lit(True), "failure_reasons": F.array().cast("array<string>"), "scored_rubrics": F.lit(0), "rubric_score": F.lit(0.0)}
    )
    out = summaries.agent_summary(rows)
    return out.select("level", "samples", "zero_case_samples", "passed_cases", "total_cases", r6("case_pass_rate").alias("case_pass_rate"), r6("case_pass_rate_nonzero_only").alias("case_pass_rate_nonzero_only"))


@query("SELECT event_type || ':' || json_extract_string(props, '$.k') AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 20")
def failure_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return summaries.reason_counts(e, F.array(F.concat_ws(":", "event_type", F.get_json_object("props", "$.k"))), 20)


@query(
    """
SELECT l_returnflag AS category, round(sum((1 - l_discount) * l_quantity) / sum(l_quantity), 6) AS weighted_score, count(*) AS scored
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())"""
)
def rubric_weighted(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select((1 - F.col("l_discount")).alias("score"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("category"))
    return scoring.weighted_score(lines, "score", "weight", "category").select("category", r6("weighted_score").alias("weighted_score"), "scored")


@query(
    """
WITH rubric AS (
  SELECT o_custkey, o_orderpriority AS category, count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*) AS score FROM orders GROUP BY 1, 2
)
SELECT o_custkey AS env_id, category, round(score, 6) AS score FROM rubric"""
)
def rubric_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as environments, priorities as rubrics, orders as the cases that cover them."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("env_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderkey").cast("string").alias("case_id"), (F.col("o_orderstatus") == "F").alias("passed"))
    rub = o.groupBy("env_id", "category").agg(F.collect_list("case_id").alias("covered_by_cases"), F.first("category").alias("rubric_id"))
    return scoring.rubric_scores(rub, o.select("env_id", "case_id", "passed")).select("env_id", "category", r6("score").alias("score"))


@query(
    """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def checkpoint_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return upserts.latest(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    """
SELECT user_id, event_type, arg_max(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY user_id, event_type"""
)
def rollout_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    return upserts.keep_last_at_first(e, ["user_id", "event_type"], "event_id")


@query("SELECT doc_id, lang FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that have no label yet."""
    return upserts.pending(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def resume_done(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return upserts.finished(c, table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query(
    """
WITH fresh AS (SELECT doc_id, 1 - quality AS quality FROM labels WHERE toxic = 1 UNION ALL SELECT item_id + 1000000000 AS doc_id, 1 AS quality FROM benchmark)
SELECT coalesce(f.doc_id, l.doc_id) AS doc_id, (CASE WHEN f.doc_id IS NOT NULL THEN f.quality ELSE l.quality END)::INTEGER AS quality
FROM (SELECT doc_id, quality FROM labels) l FULL OUTER JOIN fresh f ON l.doc_id = f.doc_id"""
)
def retry_merge(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    again = labels.where("toxic = 1").select("doc_id", (1 - F.col("quality")).cast("int").alias("quality"))
    added = table(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.lit(1).alias("quality"))
    return upserts.merge(labels.select("doc_id", F.col("quality").cast("int")), again.unionByName(added), ["doc_id"])


@query("SELECT r_regionkey, r_name, level, i::INTEGER AS rollout_index FROM region, (VALUES ('M1'), ('M2'), ('M3'), ('M4')) t(level), range(4) s(i)")
def level_cross(spark: SparkSession, sf: str) -> DataFrame:
    r = episodes.level_cross(table(spark, sf, "region").withColumn("env_id", F.col("r_name")), ["M1", "M2", "M3", "M4"])
    return episodes.rollouts(r, 4).select("r_regionkey", "r_name", "level", "rollout_index")


def _rule_sql(column: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in rules)
    return f"CASE {whens} ELSE '{default}' END"


@query(
    f"""
WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, {_rule_sql("t", taxonomy.DOMAIN_WORDS, "scientific_software_engineering")} AS primary_domain,
  {_rule_sql("t", [(a, w) for a, _, w in taxonomy.TASK_WORDS], "io_format_and_cli")} AS primary_task_type,
  {_rule_sql("t", [(b, w) for _, b, w in taxonomy.TASK_WORDS], "code_validation_and_utility")} AS secondary_task_type
FROM t"""
)
def route_keywords(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    return taxonomy.with_rules(d, F.col("t")).drop("t")


_ANY = lambda words: f"regexp_matches(t, '{'|'.join(words)}')"
_CLINICAL = {n: _ANY(w) for n, w in taxonomy.CLINICAL_WORDS}
_CLINICAL[taxonomy.CLINICAL_URGENT] = f"({_CLINICAL[taxonomy.CLINICAL_URGENT]} OR ({_ANY(taxonomy.CLINICAL_STEPS)} AND {_ANY(taxonomy.CLINICAL_SIGNS)}))"
_CLINICAL[taxonomy.CLINICAL_PLANNED] = f"({_CLINICAL[taxonomy.CLINICAL_PLANNED]} AND NOT {_CLINICAL[taxonomy.CLINICAL_URGENT]})"
QUESTIONS = ["The next best step after sudden fever?", "Most likely cause, and the best treatment?", "Which vaccine, by a cohort study?", "Best treatment of shock?", "Informed consent for a biopsy.", ""]


@query(
    f"""
WITH q AS (SELECT doc_id, lower([{", ".join(f"'{q}'" for q in QUESTIONS)}][doc_id % {len(QUESTIONS)} + 1] || ' ' || coalesce(text, '')) AS t FROM documents),
f AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {sql} THEN '{n}' END" for n, sql in _CLINICAL.items())}], lambda x: x IS NOT NULL) AS found FROM q)
SELECT doc_id, coalesce(found[1], '{taxonomy.CLINICAL_DEFAULT}') AS primary_task_type, array_to_string(found[2:], ',') AS secondary FROM f"""
)
def clinical_types(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents behind a question: clinical task types by priority."""
    question = F.get(F.array(*map(F.lit, QUESTIONS)), (F.col("doc_id") % len(QUESTIONS)).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", F.lower(F.concat(question, F.lit(" "), F.coalesce("text", F.lit("")))).alias("t"))
    return taxonomy.with_clinical_types(d, F.col("t")).select("doc_id", "primary_task_type", F.array_join("secondary_task_types", ",").alias("secondary"))


@query(
    """
SELECT c_custkey, coalesce(nullif(trim(c_mktsegment), ''), 'none') AS first_text,
  CASE c_custkey % 7 WHEN 1 THEN 'bioinformatics_sequence_structure' WHEN 3 THEN 'omics_measurement_analysis' WHEN 4 THEN 'systems_molecular_modeling' ELSE 'scientific_software_engineering' END AS domain,
  c_custkey % 7 IN (0, 6) AS known
FROM customer"""
)
def alias_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """Names given to customers in turn, as people write them: aliases with other case and signs, and names that aren't known."""
    given = F.get(F.array(*map(F.lit, ("CLI", "Genomics ", "pan das", " omics", "metabolic-model", "no such name", "Utility"))), (F.col("c_custkey") % 7).cast("int"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.coalesce(F.nullif(T.first_text("c_mktsegment", "c_name"), F.lit("")), F.lit("none")).alias("first_text"),
        taxonomy.canonical(given, "domain").alias("domain"),
        taxonomy.known(given, taxonomy.TASK_TYPE_ALIASES).isNotNull().alias("known"),
    )


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    """
WITH s AS (SELECT c_nationkey, c_mktsegment AS domain, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT *, round(n / sum(n) OVER (PARTITION BY c_nationkey), 6) AS relevance FROM s),
p AS (SELECT c_nationkey, arg_max(domain, (n, domain)) AS main FROM s GROUP BY 1),
r AS (SELECT t.c_nationkey, domain, relevance, row_number() OVER (PARTITION BY t.c_nationkey ORDER BY relevance DESC, domain) AS place FROM t JOIN p ON p.c_nationkey = t.c_nationkey AND domain <> main AND domain <> 'MACHINERY' AND relevance >= 0.18)
SELECT c_nationkey, place::INTEGER AS place, domain, relevance FROM r WHERE place <= 3"""
)
def hint_topn(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as hints of a nation, by their share of customers; the largest is the primary one, and machinery isn't allowed."""
    s = table(spark, sf, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("domain")).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("domain", "n")))
    hints = F.transform("all", lambda h: F.struct(h["domain"].alias("domain"), F.round(h["n"] / F.col("total"), 6).alias("relevance")))
    per = s.groupBy("c_nationkey").agg(listed.alias("all"), F.sum("n").alias("total"), F.max(F.struct("n", "domain"))["domain"].alias("main"))
    top = taxonomy.top_hints(hints, F.col("main"), SEGMENTS[:-1], 0.18, 3)
    return per.select("c_nationkey", F.posexplode(top).alias("at", "h")).select("c_nationkey", (F.col("at") + 1).alias("place"), "h.domain", "h.relevance")


PLAIN_SQL = "trim(regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[^a-z0-9_ .:/+-]+', '', 'g'))"


@query(
    f"""
WITH i AS (SELECT item_id, {PLAIN_SQL} AS p FROM benchmark), d AS (SELECT doc_id, {PLAIN_SQL} AS p FROM documents)
SELECT DISTINCT item_id, doc_id FROM i JOIN d ON i.p <> '' AND d.p <> '' AND (contains(i.p, d.p) OR contains(d.p, i.p))"""
)
def requirement_match(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark items as requirements, whole documents as covered texts: pairs where one holds the other, meeting on a rare word."""
    items = rubrics.plain_texts(table(spark, sf, "benchmark"), "item_id", "text")
    docs = rubrics.plain_texts(table(spark, sf, "documents"), "doc_id", "text")
    a = rubrics.holding_pairs(items, docs).toDF("item_id", "doc_id")
    b = rubrics.holding_pairs(docs, items).toDF("doc_id", "item_id")
    return a.unionByName(b).distinct()


@query(
    """
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part)
SELECT a.p_partkey AS left_key, b.p_partkey AS right_key FROM p a JOIN p b
ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND len(list_intersect(a.w, b.w)) >= least(2, len(a.w))"""
)
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a brand that share enough words."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.array_distinct(rubrics.tokens(F.col("p_name"))).alias("w"))
    return rubrics.token_pairs(p, "p_brand", "p_partkey", "w")


@query(
    """
WITH s AS (SELECT user_id, event_type, event_id, epoch_ms(ts) // 1000 AS a, epoch_ms(ts) // 1000 + ceil(value * 60)::BIGINT AS b FROM events WHERE event_type IN ('click', 'view'))
SELECT x.user_id, x.event_id AS left_id, y.event_id AS right_id, greatest(x.a, y.a) AS start, least(x.b, y.b) AS "end"
FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_type = 'click' AND y.event_type = 'view' AND x.a < y.b AND y.a < x.b"""
)
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    start = F.unix_seconds("ts")
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_type", F.col("event_id").alias("id"), start.alias("start"), (start + F.ceil(F.col("value") * 60).cast("long")).alias("end"))
    return episodes.overlapping(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", 3600)


@query(
    """
WITH b AS (SELECT conv_id, turn, role, length('<|' || role || '|>' || chr(10) || coalesce(text, '')) AS n FROM conversations),
c AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS span_start FROM b)
SELECT conv_id, turn, span_start, (span_start + n)::BIGINT AS span_end FROM c WHERE role = 'assistant'"""
)
def span_cursor(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    out = episodes.char_spans(c, ["conv_id"], ["turn"], episodes.render_block(F.col("role"), F.col("text")))
    return out.where("role = 'assistant'").select("conv_id", "turn", "span_start", "span_end")


@query(
    """
SELECT conv_id, md5(string_agg('<|' || role || '|>' || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn)) AS rendered_md5, count(*) AS messages FROM conversations GROUP BY conv_id"""
)
def chat_render(spark: SparkSession, sf: str) -> DataFrame:
    out = episodes.render(table(spark, sf, "conversations"), ["conv_id"], "turn", episodes.render_block(F.col("role"), F.col("text")))
    return out.select("conv_id", F.md5(F.col("rendered").cast("binary")).alias("rendered_md5"), "messages")


@query(
    """
WITH c AS (SELECT user_id, event_id, event_type,
  count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS calls_before,
  count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tool_calls_before FROM events)
SELECT *, calls_before >= 20 OR tool_calls_before >= 5 AS budget_violation FROM c"""
)
def budget_running(spark: SparkSession, sf: str) -> DataFrame:
    out = episodes.budget_flags(table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"], 20, 5)
    return out.select("user_id", "event_id", "event_type", "calls_before", "tool_calls_before", "budget_violation")


@query(
    """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, before, least(l_quantity, 60 - before) AS taken FROM c WHERE before < 60"""
)
def intensity_trim(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    out = episodes.trim_to_target(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", F.lit(60.0))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.col("before").cast("double"), "taken")


@query(
    """
SELECT min(doc_id) AS doc_id, md5(k) AS key_md5 FROM (SELECT doc_id, lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS k FROM documents) GROUP BY k"""
)
def dedupe_folded(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5(T.folded("text").cast("binary")).alias("key_md5"))
    return upserts.keep_first(d, ["key_md5"], ["doc_id"])


SEVERITY_SQL = """
CASE WHEN d.text IS NULL OR trim(d.text) = '' THEN 3 WHEN l.quality = 0 THEN 2 WHEN l.toxic = 1 THEN 1 ELSE 0 END"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    failures = gates.reasons((F.trim(F.coalesce("text", F.lit(""))) == "", "EMPTY_TEXT:document"), (F.col("quality") == 0, "LOW_QUALITY"))
    return d.select("doc_id", "lang", gates.gate("document_gate", failures, gates.reasons((F.col("toxic") == 1, "TOXIC")), ("EMPTY_TEXT",)).alias("gate"))


@query(
    f"""
WITH s AS (SELECT d.doc_id, d.lang, {SEVERITY_SQL} AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CASE r WHEN 0 THEN 'pass' WHEN 1 THEN 'pass_with_warning' WHEN 2 THEN 'soft_fail' ELSE 'hard_fail' END AS severity,
  CASE r WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS score, r <= 1 AS passed FROM s"""
)
def gate_decision(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("doc_id", "gate.severity", "gate.score", "gate.passed")


@query(
    f"""
WITH s AS (SELECT d.lang, {SEVERITY_SQL} AS r FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, CASE WHEN r <= 1 THEN 'clean' ELSE 'rejected' END AS export_status, count(*) AS docs FROM s GROUP BY 1, 2"""
)
def clean_rejected(spark: SparkSession, sf: str) -> DataFrame:
    rows = _gated(spark, sf).select("lang", F.col("gate.failure_reasons").alias("blocking_flags"), F.lit(None).cast("string").alias("final_decision"), F.lit(None).cast("boolean").alias("passed"))
    return gates.export_status(rows).groupBy("lang", "export_status").agg(F.count("*").alias("docs"))


@query(
    """
WITH g AS (SELECT source AS group_key, count(*) AS n, row_number() OVER (ORDER BY md5('1337:' || source), source) - 1 AS rk, count(*) OVER () AS k FROM documents GROUP BY source),
q AS (SELECT *, floor(k * (0.7 / 1.1))::BIGINT AS tr, greatest(1, floor(k * (0.1 / 1.1))::BIGINT) AS dv FROM g),
s AS (SELECT *, CASE WHEN rk < tr THEN 'train' WHEN rk < tr + dv THEN 'dev' ELSE 'test' END AS split FROM q)
SELECT t.split, coalesce(sum(n), 0)::BIGINT AS envs, count(group_key) AS groups FROM (VALUES ('train'), ('dev'), ('test')) t(split) LEFT JOIN s ON s.split = t.split GROUP BY t.split"""
)
def split_groups(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    return splits.split_counts(splits.assign_splits(d, {"train": 0.7, "dev": 0.1, "test": 0.3}, 1337, F.col("source")))


@query(
    """
WITH d AS (SELECT lang, doc_id, quality, row_number() OVER (PARTITION BY lang, quality ORDER BY doc_id) AS rn, n_chars FROM documents JOIN labels USING (doc_id)),
p AS (SELECT a.lang, a.doc_id AS chosen, b.doc_id AS rejected, least(1.0, a.n_chars / 4000.0) AS cs, least(1.0, b.n_chars / 4000.0) AS rs
  FROM d a JOIN d b ON a.lang = b.lang AND a.rn = b.rn AND a.quality = 1 AND b.quality = 0)
SELECT lang, chosen, rejected, round(CASE WHEN cs <= rs THEN least(1.0, rs + 0.35) ELSE cs END - rs, 6)::DOUBLE AS margin FROM p"""
)
def prefer_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Good and bad documents of a language, paired by rank."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", "doc_id", "quality", F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score"))
    d = ranks.placed(d, ["lang", "quality"], ["doc_id"], "rn")
    good = d.where("quality = 1").select("lang", "rn", F.col("doc_id").alias("chosen"), F.col("score").alias("chosen_score"))
    bad = d.where("quality = 0").select("lang", "rn", F.col("doc_id").alias("rejected"), F.col("score").alias("rejected_score"))
    return exports.preference_samples(good.join(bad, ["lang", "rn"])).select("lang", "chosen", "rejected", r6("margin").alias("margin"))


@query("SELECT role AS tool_name, count(*) AS calls FROM conversations GROUP BY role")
def tool_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("tool_name"))).alias("tool_trace"))
    return summaries.tool_counts(t)


@query("SELECT min(n) AS min_steps, max(n) AS max_steps, round(avg(n), 6) AS mean_steps FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def trace_steps(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return summaries.trace_steps(t, F.col("n")).withColumn("mean_steps", r6("mean_steps"))


@query(
    """
WITH s AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, abs(o_totalprice - cents / 100.0) <= greatest(1e-6 * greatest(abs(o_totalprice), abs(cents / 100.0)), 1e-6) AS is_close FROM orders JOIN s ON o_orderkey = l_orderkey"""
)
def numeric_close(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100).alias("total"))
    return table(spark, sf, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", T.close("o_totalprice", "total").alias("is_close"))


@query(
    """
WITH s AS (SELECT c_mktsegment AS model, count(*) AS customers, count(*) FILTER (WHERE c_acctbal > 0)::DOUBLE / count(*) AS rate FROM customer GROUP BY 1),
b AS (SELECT * FROM s WHERE model = 'BUILDING')
SELECT s.model, s.customers, s.customers - b.customers AS delta_customers, round(s.rate - b.rate, 6) AS delta_rate FROM s, b"""
)
def model_delta(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("model")).agg(F.count("*").alias("customers"), (F.count_if(F.col("c_acctbal") > 0) / F.count("*")).alias("rate"))
    out = summaries.deltas_to_base(s, "model", "BUILDING", ["customers", "rate"])
    return out.select("model", "customers", "delta_customers", r6("delta_rate").alias("delta_rate"))


@query(
    """
WITH o AS (SELECT c_nationkey, o_orderkey, o_orderpriority = '1-URGENT' AS matches, o_orderstatus = 'F' AS passed FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT n_nationkey, CASE WHEN count(o_orderkey) = 0 THEN 'missing_case' WHEN NOT coalesce(bool_or(matches), false) THEN 'case_mismatch'
  WHEN NOT coalesce(bool_and(passed), true) THEN 'gold_failed' ELSE 'pass' END AS status
FROM nation LEFT JOIN o ON c_nationkey = n_nationkey GROUP BY n_nationkey"""
)
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as requirements, orders as cases."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cases = o.select(F.lit(0).alias("env_id"), F.col("c_nationkey").alias("requirement_id"), F.col("o_orderkey").alias("case_id"), (F.col("o_orderpriority") == "1-URGENT").alias("matches"), (F.col("o_orderstatus") == "F").alias("passed"))
    n = table(spark, sf, "nation").select(F.lit(0).alias("env_id"), F.col("n_nationkey").alias("requirement_id"))
    out = rubrics.coverage_matrix(n, cases.select("env_id", "requirement_id", "case_id", "matches"), cases.select("env_id", "case_id", "passed"))
    return out.select(F.col("requirement_id").alias("n_nationkey"), "status")


@query(
    """
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM documents)
SELECT doc_id, CASE WHEN regexp_replace(substr(s, 1, 48), '_+$', '') = '' THEN 'item' ELSE regexp_replace(substr(s, 1, 48), '_+$', '') END AS slug FROM d"""
)
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.slug("text").alias("slug"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS sha256, length(text)::INTEGER AS chars, ('0x' || substr(md5(text), 1, 8))::BIGINT AS seed FROM documents")
def redacted_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", T.redacted("text").alias("r"), T.seed_of("text").alias("seed"))
    return d.select("doc_id", "r.sha256", "r.chars", "seed")


@query(
    """
SELECT count(*) AS input, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality <> 1) AS rejected,
  count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS direct, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS repaired FROM labels"""
)
def validation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.validation_counts(table(spark, sf, "labels").select((F.col("quality") == 1).alias("accepted"), (F.col("toxic") == 1).alias("repair_succeeded")))


@query(
    """
SELECT 'level' AS facet, t.value, count(o_orderkey) AS envs FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(value) LEFT JOIN orders ON o_orderstatus = t.value GROUP BY t.value
UNION ALL SELECT 'primary_domain', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'secondary_domain', v, count(*) FROM (SELECT unnest([o_orderstatus, o_orderpriority]) AS v FROM orders) GROUP BY v"""
)
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("level"), F.col("o_orderpriority").alias("primary_domain"), F.array("o_orderstatus", "o_orderpriority").alias("secondary_domains"))
    return summaries.eval_report(o, ["F", "O", "P", "X"])


@query(
    """
WITH p AS (SELECT p_partkey AS env_id, p_size % 4 AS d, p_size % 3 AS c FROM part),
a AS (SELECT env_id, 'D' AS axis, d AS n FROM p UNION ALL SELECT env_id, 'C', c FROM p)
SELECT env_id, env_id::VARCHAR || '_' || lower(axis) || '_' || lpad(i::VARCHAR, 2, '0') AS operator_id, axis, least(2, n - 2 * (i - 1))::INTEGER AS operator_intensity
FROM a, range(1, 4) r(i) WHERE n > 0 AND i <= (n + 1) // 2"""
)
def operator_chunks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("env_id"), F.lit("M3").alias("level"), F.lit("numerical_computation").alias("primary_task_type"),
        (F.col("p_size") % 4).alias("intensity_D"), (F.col("p_size") % 3).alias("intensity_C"), F.lit(0).alias("intensity_A"), F.lit(0).alias("intensity_V"),
    )
    return planning.operator_instances(p).select("env_id", "operator_id", "axis", F.col("operator_intensity").cast("int"))


@query(
    """
SELECT role, count(*) AS turns, min(duplicates) AS least, max(duplicates) AS most FROM (SELECT role, conv_id, count(*) AS duplicates FROM conversations GROUP BY role, conv_id HAVING count(*) > 1) GROUP BY role"""
)
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = upserts.duplicate_ids(table(spark, sf, "conversations"), ["role", "conv_id"])
    return d.groupBy("role").agg(F.count("*").alias("turns"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(
    """
SELECT doc_id, CASE WHEN contains(t, 'http error 400') OR contains(t, 'region') THEN false ELSE contains(t, 'timeout') OR contains(t, 'timed out') OR contains(t, 'rate limit') END AS retryable,
  CASE WHEN contains(text, 'CASE_FAILED:') THEN 'repair' WHEN contains(text, 'OPERATOR_REALIZATION') OR contains(text, 'INTENSITY_') OR contains(text, 'D_') OR contains(text, 'C_') OR contains(text, 'A_') OR contains(text, 'V_') THEN 'realization' ELSE 'other' END AS category
FROM (SELECT doc_id, text, lower(text) AS t FROM documents)"""
)
def failure_triage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", gates.retryable(F.lit("llm_error"), F.col("text")).alias("retryable"), gates.failure_category(F.col("text")).alias("category"))


@query(
    """
WITH t AS (SELECT conv_id, turn, text, length(text) // 3 AS a, 2 * (length(text) // 3) AS b FROM conversations WHERE role = 'assistant'),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words, string_split_regex(text, '[^ \\t\\n\\x0B\\f\\r]+') AS gaps FROM t),
o AS (SELECT conv_id, turn, a, b, len(words) AS n, list_transform(range(1, len(words) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(words[1:i - 1], lambda w: length(w))), 0)) AS starts, words FROM w)
SELECT conv_id, turn, n::INTEGER AS tokens, len(list_filter(range(1, n + 1), lambda i: starts[i] < b AND starts[i] + length(words[i]) > a))::INTEGER AS labelled,
  coalesce(list_min(list_filter(range(1, n + 1), lambda i: starts[i] < b AND starts[i] + length(words[i]) > a)) - 1, -1)::INTEGER AS first_labelled FROM o"""
)
def label_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Whitespace tokens of assistant turns, of which those that touch the turn's middle third are labelled: how many, and the first."""
    c = table(spark, sf, "conversations").where("role = 'assistant'").withColumn("tokens", episodes.word_offsets(F.coalesce("text", F.lit(""))))
    third = F.floor(F.length("text") / 3)
    spans = F.array(F.struct(third.alias("start"), (2 * third).alias("end")))
    c = c.withColumn("mask", episodes.label_mask(F.col("tokens"), F.transform("tokens", lambda x, i: i), spans))
    labelled = F.filter("mask", lambda m: m >= 0)
    return c.select("conv_id", "turn", F.size("tokens").alias("tokens"), F.size(labelled).alias("labelled"), F.coalesce(F.array_min(labelled), F.lit(-1)).alias("first_labelled"))


@query()
def plan_sampling(spark: SparkSession, sf: str) -> DataFrame:
    """Plans drawn with Python's generator for parts at four levels, with the rules they break (none)."""
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("env_id"), F.col("p_name").alias("text"))
    types = F.array(*(F.lit(t) for t in planning.PRIORITY))
    rows = episodes.level_cross(p, list(planning.LEVELS)).withColumns({"primary_task_type": F.get(types, (F.length("text") % 4).cast("int")), "secondary_task_types": types, "verifier_type_hint": F.lit(None).cast("string")})
    plans = planning.scaling_plans(planning.axis_weights(rows, F.col("text")).drop("text", "secondary_task_types", "verifier_type_hint"))
    return planning.plan_violations(plans)


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AS same, o_custkey % 2 = 0 AS holds, o_orderkey % 4 = 0 AS equal_part FROM orders")
def value_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as nested values: matched with noise inside and outside of the tolerance, searched for a part that they hold or not, matched with all of themselves in another order or a part."""
    from gradeloom.functions.values import value_contains, values_match

    o = table(spark, sf, "orders")
    noise = F.get(F.array(F.lit(1.0), F.lit(1 + 5e-7), F.lit(1 + 5e-6)), (F.col("o_orderkey") % 3).cast("int"))
    total, tags = F.col("o_totalprice"), F.array("o_orderstatus", "o_orderpriority").alias("tags")
    runs = lambda x: F.array(F.struct(F.struct(x.alias("total")).alias("output"), F.lit(True).alias("ok"))).alias("runs")
    texts = o.select(
        "o_orderkey", "o_custkey", F.to_json(F.struct(total.alias("total"), tags, runs(total))).alias("a"), F.to_json(F.struct((total * noise).alias("total"), tags, runs(total * noise))).alias("b"),
        F.to_json(F.struct(runs(total + F.col("o_custkey") % 2))).alias("part"), F.to_json(F.struct(runs(total), tags, total.alias("total"))).alias("turned"),
    )
    whole = F.when(F.col("o_orderkey") % 4 == 0, F.col("turned")).otherwise(F.col("part"))
    return texts.select("o_orderkey", values_match("a", "b").alias("same"), value_contains("a", "part").alias("holds"), values_match(F.col("a"), whole).alias("equal_part"))


from gradeloom.plans import cases, further, gating, scaling, streams  # noqa: E402, F401 - their queries register themselves

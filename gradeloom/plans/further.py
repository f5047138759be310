"""Further queries of the catalogue: merging, numbering, exports and weights, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators import episodes, exports, planning, ranks, rubrics, scoring, summaries, upserts
from gradeloom.plans.catalogue import long, query, r6
from gradeloom.sources.session import table

FOLDED_SQL = "lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))"


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars END::BIGINT AS value FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def merged_values(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of documents, replaced by labels where there are any."""
    old = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("value"))
    return upserts.merge(old, table(spark, sf, "labels").select("doc_id", long("quality").alias("value")), ["doc_id"])


@query(
    """
WITH o AS (SELECT n_nationkey AS k, n_name AS name, n_nationkey AS place FROM nation), n AS (SELECT s_nationkey AS k, max(s_name) AS name FROM supplier GROUP BY 1)
SELECT o.k, coalesce(n.name, o.name) AS name, o.place::BIGINT AS place FROM o LEFT JOIN n ON o.k = n.k"""
)
def merged_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """Nations, renamed after their last supplier, at their places."""
    old = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), long("n_nationkey").alias("place"))
    new = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("name")).withColumn("place", F.lit(0).cast("long"))
    return upserts.merge(old, new, ["k"], "place")


@query(
    """
SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2"""
)
def first_two(spark: SparkSession, sf: str) -> DataFrame:
    return upserts.first_n_per(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], 2).select("user_id", "event_type", "event_id")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 1")
def first_error(spark: SparkSession, sf: str) -> DataFrame:
    return upserts.first_match(table(spark, sf, "events"), F.col("event_type") == "error", ["ts", "event_id"]).select("event_id", "user_id", "value")


@query("SELECT 0 AS part, r_regionkey AS position, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation")
def ordered_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).select(F.col(f"{t[0]}_{t}key").alias("position"), F.col(f"{t[0]}_name").alias("name")) for t in ("region", "nation")]
    return upserts.ordered_union(parts, "position").select("part", "position", "name")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events")
def input_order(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their place in the order in which they came, as ``restore_order`` puts them at the sink."""
    e = table(spark, sf, "events").select("event_id", "ts")
    return upserts.restore_order(ranks.placed(e, [], ["ts", "event_id"], "position"), "position").select("event_id", "position")


@query(f"SELECT role, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role, {FOLDED_SQL} ORDER BY conv_id, turn) AS n FROM conversations) WHERE n = 1")
def first_spellings(spark: SparkSession, sf: str) -> DataFrame:
    return upserts.keep_first_folded(table(spark, sf, "conversations").select("role", "conv_id", "turn", "text"), "text", ["role"], ["conv_id", "turn"]).select("role", "conv_id", "turn")


@query(
    """
WITH b AS (SELECT conv_id, turn, strlen(text)::BIGINT AS bytes FROM conversations),
r AS (SELECT *, (sum(bytes) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS running_bytes FROM b)
SELECT *, bytes <= 900 AND running_bytes <= 2000 AS fits FROM r"""
)
def fixture_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as its files."""
    c = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("position"), F.col("text").alias("content"))
    out = summaries.file_budget(c, "conv_id", 900, 2000)
    return out.select("conv_id", F.col("position").alias("turn"), long("bytes").alias("bytes"), long("running_bytes").alias("running_bytes"), "fits")


@query(
    """
WITH l AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT o_orderkey AS rollout_id, coalesce(lines, 0) AS lines, coalesce(returned / lines, -0.2)::DOUBLE AS reward FROM orders LEFT JOIN l ON o_orderkey = l_orderkey"""
)
def attached_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the rewards of their lines, and the penalty where there are none."""
    rewards = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("rollout_id")).agg(F.count("*").alias("lines"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("reward"))
    out = scoring.attach_rewards(table(spark, sf, "orders").select(F.col("o_orderkey").alias("rollout_id")), rewards)
    return out.select("rollout_id", F.coalesce("reward_row.lines", F.lit(0)).alias("lines"), scoring.missing_reward(F.col("reward_row.reward")).alias("reward"))


@query(
    """
WITH m AS (SELECT o_orderkey, o_totalprice AS v, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS a, stddev_pop(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders)
SELECT o_orderkey, round(CASE WHEN s > 1e-8 THEN (v - a) / s ELSE 0 END, 6) AS advantage FROM m"""
)
def window_advantages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(scoring.window_advantage("o_totalprice", ["o_custkey"]), 6).alias("advantage"))


@query(
    """
WITH s AS (SELECT conv_id || '_' || turn AS env_id, string_split(text, '. ') AS p FROM conversations WHERE text IS NOT NULL)
SELECT env_id, unnest(range(1, len(p) + 1))::INTEGER AS step_id, unnest(p) AS step FROM s"""
)
def process_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of a turn as its steps."""
    c = table(spark, sf, "conversations")
    return exports.process_samples(c.select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("env_id"), F.split("text", r"\. ", -1).alias("steps")))


@query(
    """
WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS env_id, o_orderpriority AS level, o_orderstatus AS user_prompt, n::INTEGER AS evaluation_cases FROM orders JOIN l ON o_orderkey = l_orderkey"""
)
def gradable_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as environments, their lines as cases."""
    cases = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("cases"))
    o = table(spark, sf, "orders").join(cases, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return exports.prompt_rows(o.select(F.col("o_orderkey").alias("env_id"), F.col("o_orderpriority").alias("level"), F.col("o_orderstatus").alias("user_prompt"), F.coalesce("cases", F.array().cast("array<int>")).alias("cases")))


@query("SELECT p_partkey AS env_id, p_brand AS level, p_name AS user_prompt, p_size + 1 AS max_steps FROM part")
def rl_steps(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return exports.rl_environments(p.select(F.col("p_partkey").alias("env_id"), F.col("p_brand").alias("level"), F.col("p_name").alias("user_prompt"), F.col("p_size").alias("max_total_tool_calls")))


@query("SELECT doc_id, concat_ws('_', lang, source, substr(md5(coalesce(text, '')), 1, 16)) AS sample_id FROM documents")
def sample_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", exports.sample_id(F.col("lang"), F.col("source"), F.col("text")).alias("sample_id"))


@query(
    """
WITH c AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'original seed|seed behavior|seed call') THEN 'seed_behavior'
  WHEN regexp_matches(lower(text), 'stdout|stderr|print|format|file artifact|file path|create or update file') THEN 'output_format'
  WHEN regexp_matches(lower(text), 'return type|signature|compile') THEN 'runtime_contract' ELSE 'scaled_requirement' END AS category FROM documents)
SELECT doc_id, category, (CASE category WHEN 'output_format' THEN 1.5 WHEN 'runtime_contract' THEN 1.0 ELSE 2.0 END)::DOUBLE AS weight FROM c"""
)
def requirement_categories(spark: SparkSession, sf: str) -> DataFrame:
    c = rubrics.category(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", c.alias("category"), rubrics.category_weight(c).alias("weight"))


@query("SELECT event_id, printf('req_%s_%03d', lower(event_type), row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id)) AS requirement_id FROM events")
def numbered_requirements(spark: SparkSession, sf: str) -> DataFrame:
    return rubrics.number_requirements(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("event_id", "requirement_id")


@query(
    """
SELECT n_regionkey AS env_id, n_name AS requirement_id, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS cases
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2"""
)
def covering_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as requirements of a region, suppliers as cases that name theirs."""
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    requirements = n.select(F.col("n_regionkey").alias("env_id"), F.col("n_name").alias("requirement_id"), F.lit("").alias("text"))
    cases = s.select(F.col("n_regionkey").alias("env_id"), F.col("s_name").alias("case_id"), F.col("s_suppkey").alias("position"), F.array("n_name").alias("covered_requirement_ids"), F.array().cast("array<string>").alias("covered_requirements"))
    return rubrics.covering_cases(requirements, cases).select("env_id", "requirement_id", F.array_join("covered_by_cases", ",").alias("cases"))


@query("SELECT c_custkey AS env_id, i::INTEGER AS rollout_index, c_custkey || printf('_r%03d', i) AS rollout_id FROM customer, range(4) r(i)")
def rollout_ids(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.rollouts(table(spark, sf, "customer").select(F.col("c_custkey").alias("env_id")), 4)


@query(
    """
SELECT p_partkey, CASE k WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 2 END AS D, CASE k WHEN 0 THEN 5 WHEN 1 THEN 5 ELSE 7 END AS C,
  CASE k WHEN 3 THEN 5 ELSE 2 END AS A, CASE k WHEN 2 THEN 5 ELSE 3 END AS V FROM (SELECT p_partkey, length(p_name) % 4 AS k FROM part)"""
)
def axis_rank_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the axes for types of task given to parts by the length of their names."""
    types = F.array(*(F.lit(t) for t in planning.PRIORITY))
    w = planning.rank_weights(F.get(types, (F.length("p_name") % 4).cast("int")))
    return table(spark, sf, "part").select("p_partkey", w.alias("w")).select("p_partkey", "w.*")


@query("SELECT s_suppkey, replace(replace(lower(trim(s_name)), ' ', '_'), '-', '_') AS name, round(s_acctbal / 10000, 6) AS share FROM supplier")
def compact_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", T.compact("s_name").alias("name"), r6(T.rate(F.col("s_acctbal"), F.lit(10000.0))).alias("share"))


@query(
    """
WITH u AS (SELECT conv_id, (turn + 1)::DOUBLE AS weight, list_filter(list_transform(string_split_regex(lower(trim(text)), '\\s+'), lambda x: trim(x, '.,:;!?')), lambda x: length(x) > 3
  AND NOT list_contains(['the', 'a', 'an', 'and', 'or', 'to', 'of', 'is', 'what', 'when', 'use', 'clear', 'patient', 'facing'], x)) AS w FROM conversations WHERE role = 'user' AND text IS NOT NULL),
a AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
m AS (SELECT a.conv_id, a.turn, u.weight, len(list_filter(u.w, lambda x: contains(a.t, x))) >= greatest(1, least(3, len(u.w) // 2)) AS ok FROM a JOIN u ON a.conv_id = u.conv_id)
SELECT conv_id, turn, round(coalesce(sum(weight) FILTER (WHERE ok), 0) / sum(weight), 6) AS score, count(*) FILTER (WHERE ok) AS passed FROM m GROUP BY 1, 2"""
)
def keyword_rubrics(spark: SparkSession, sf: str) -> DataFrame:
    """Users' turns as criteria, weighted by their place, for the answers of their conversation."""
    c = table(spark, sf, "conversations").where("text is not null")
    criteria = c.where("role = 'user'").select("conv_id", F.col("text").alias("criterion"), (F.col("turn") + 1.0).alias("weight"))
    answers = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return rubrics.keyword_scores(answers.join(criteria, "conv_id"), ["conv_id", "turn"]).withColumn("score", r6("score"))

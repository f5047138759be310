"""The stages of a run, each a table in a folder: prepare, normalise, route, seed, scale (operators, states, requirements, cases, solutions, prompts), split, agent, reward, evaluate.

A stage that is finished for the same inputs isn't run again; ``run`` returns the tables by name. Model and execution are adapters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import adapters, case_repair, constraints, episodes, evidence, gates, gold, patches, planning, prompts, rubrics, scoring, splits, summaries, tasks, taxonomy, upserts, verifiers
from gradeloom.sources import files

LEVELS = ["M1", "M2", "M3", "M4"]


class Run:
    """A folder of stage tables.

    ``strict``: operators that aren't realized reject their environment; else the table ``realization`` only reports them (a model that returns the seed's solution as it is fails D, C and A).
    ``rounds``: how often cases that fail go back to the model."""

    def __init__(self, spark: SparkSession, folder: str, client: adapters.ModelClient | None = None, ratios: dict[str, float] | None = None, seed: int = 1337, strict: bool = False, rounds: int = 3):
        self.spark, self.folder, self.client = spark, folder.rstrip("/"), client or gold_client()
        self.ratios, self.seed = ratios or {"train": 0.7, "dev": 0.1, "test": 0.2}, seed
        self.strict, self.rounds, self.ran = strict, rounds, []

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def stage(self, name: str, marks: dict[str, str], make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table, made unless it is there for the same marks. A table is complete when its status says so."""
        if not files.is_done(self.spark, self.path("status"), name, marks):
            make().write.mode("overwrite").parquet(self.path(name))
            files.stage_done(self.spark, self.path("status"), name, self.table(name).count(), marks)
            self.ran.append(name)
        return self.table(name)

    def all(self, raw: DataFrame, mark: str = "1") -> dict[str, DataFrame]:
        """All stages from raw JSON lines (``row_idx``, ``value``); another ``mark`` runs them anew."""
        m = {"input": mark, "seed": str(self.seed)}
        out: dict[str, DataFrame] = {}

        def put(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            out[name] = self.stage(name, m, make)
            return out[name]

        t = put("tasks", lambda: tasks.normalize(raw))
        seen = put("executions", lambda: seed_runs(raw, t))
        routed = put("routing", lambda: taxonomy.validate_routing(taxonomy.route(t), taxonomy.DOMAINS, taxonomy.TASK_TYPES, 0.5, 0.7))
        seeds = put("seeds", lambda: tasks.seed_environments(t.join(seen.where("ok").select("task_id"), "task_id", "left_semi"), routed).drop("level"))
        plans = put("plans", lambda: scaled_plans(seeds))
        gates.assert_complete(plans, seeds.count() * len(LEVELS)).count()
        ops = put("operators", lambda: patched(planning.operator_instances(plans), plans, seeds))
        states = put("states", lambda: patches.state_maps(patches.applied(ops)))
        drafts = put("drafts", lambda: graded(seeds, plans, ops, seen))
        asked = put("requirements", lambda: requirements(drafts, ops))
        cases = put("cases", lambda: self.repaired(drafts, ops, states, asked, m))
        put("case_plans", lambda: verifiers.case_plans(drafts, ops))
        golds = put("golds", lambda: gold.gold_solutions(drafts, cases.where("valid"), self.client))
        written = put("prompts", lambda: rewritten(drafts, ops, cases, states))
        real = put("realization", lambda: realized(ops, cases, golds, drafts, written))
        envs = put("envs", lambda: with_golds(drafts, cases, golds, real, self.strict).drop("user_prompt").join(written, "env_id"))
        put("splits", lambda: splits.assign_splits(envs.where("export_status = 'clean'"), self.ratios, self.seed).select("env_id", "group_key", "split"))
        clean = envs.where("export_status = 'clean'")
        runs = put("runs", lambda: adapters.run_agents(clean, self.client))
        evals = put("evals", lambda: evaluated(runs, clean, seen))
        rewards = put("rewards", lambda: scoring.group_advantages(scoring.with_reward(evals), ["original_task_id"]))
        put("summary", lambda: summaries.reward_summary(rewards.withColumn("scored_rubrics", F.lit(0))))
        return out

    def repaired(self, drafts: DataFrame, ops: DataFrame, states: DataFrame, asked: DataFrame, marks: dict[str, str]) -> DataFrame:
        """The cases of all environments, validated and repaired; each round is a stage table of its own."""
        keep = lambda df, name: self.stage(f"repair/{name}", marks, lambda: df)
        shown = evidence.visible_requirements(with_states(drafts, states).join(asked.groupBy("env_id").agg(F.collect_list("text").alias("output_requirements")), "env_id", "left"))
        cases = case_repair.validated(scaled_cases(drafts, ops), ops, asked, shown, self.client, self.rounds, keep)
        return cases.withColumn("checks", constraints.signature_checks(F.col("expected_output_signature")))

    def evaluate(self, models: dict[str, tuple[str, adapters.ModelClient]], split: str | None = "test", base: str = "base", mark: str = "1") -> dict[str, DataFrame]:
        """Models (label to kind and client) run on the environments of a split (null: the seeds' own level of all): ``comparison`` and ``deltas`` to the base model.

        Each model's runs and evaluations are stage tables of their own; the seed's recorded output is what answers are held against."""
        m = {"input": mark, "seed": str(self.seed), "split": split or "seeds"}
        place = f"eval-{split or 'seeds'}"
        clean = self.table("envs").where("export_status = 'clean'")
        chosen = clean.where("level = 'M1'") if split is None else clean.join(self.table("splits").where(F.col("split") == split).select("env_id"), "env_id", "left_semi")
        seen = self.table("executions")
        rows = None
        for label, (kind, client) in models.items():
            runs = self.stage(f"{place}-{label}-runs", m, lambda: adapters.run_agents(chosen, client))  # noqa: B023
            evals = self.stage(f"{place}-{label}", m, lambda: evaluated(runs, chosen, seen))  # noqa: B023
            total = summaries.agent_summary(evals.withColumn("scored_rubrics", F.lit(0))).where("level is null")
            one = summaries.comparison_rows(total.withColumns({"model_label": F.lit(label), "model_kind": F.lit(kind), "output_dir": F.lit(self.path(f"{place}-{label}"))}))
            rows = one if rows is None else rows.unionByName(one)
        made = self.stage(f"{place}-comparison", m | {"models": ",".join(models)}, lambda: rows)
        return {"comparison": made, "deltas": summaries.comparison_deltas(made, base)}

    def publish(self, folder: str, names: list[str]) -> DataFrame:
        """Stage tables copied to a folder of results, with a manifest of their rows; tables that aren't there are left out."""
        return files.publish(self.spark, {n: self.path(n) for n in names}, folder)


def gold_client() -> adapters.MockClient:
    """A model that reads the task, then submits the gold solution."""
    return adapters.MockClient({"scaled_gold": lambda c: {"code": c["seed_code"]}, "agent_turn": lambda c: {"tool": "get_task_context"} if c["turn"] == 0 else {"tool": "submit_final_code", "code": c["gold_solution"]}})


def seed_runs(raw: DataFrame, t: DataFrame) -> DataFrame:
    """Each task's solution run with its call (field ``call_code`` of the record): the output is its seed case's expectation."""
    calls = raw.select("row_idx", F.coalesce(tasks.field(F.col("value"), "call_code"), F.lit("result = None")).alias("call_code"))
    cases = t.join(calls, "row_idx").select("task_id", F.coalesce(F.nullif(F.col("code"), F.lit("")), F.col("solution")).alias("code"), F.lit("").alias("setup_code"), "call_code")
    ran = adapters.execute(cases, ["task_id", "code", "call_code"])
    return ran.withColumnsRenamed({"code": "gold_code"})


def scaled_plans(seeds: DataFrame) -> DataFrame:
    """A plan per environment and level."""
    rows = episodes.level_cross(seeds, LEVELS).withColumn("base_env_id", F.col("env_id")).withColumn("env_id", F.concat_ws("_", "env_id", F.lower("level")))
    text = F.concat_ws("\n", "problem", "context_summary", "signature")
    weighted = planning.axis_weights(rows, text).select("env_id", "base_env_id", "original_task_id", "level", "primary_task_type", "final_weights")
    return planning.plan_violations(planning.scaling_plans(weighted))


def patched(ops: DataFrame, plans: DataFrame, seeds: DataFrame) -> DataFrame:
    """Operators with their patch and test, filled in where an entry is missing."""
    domains = plans.select("env_id", "base_env_id").join(seeds.select(F.col("env_id").alias("base_env_id"), "primary_domain"), "base_env_id")
    df = patches.with_patches(ops.join(domains.drop("base_env_id"), "env_id"), F.col("primary_domain"), F.lit(None).cast("array<string>")).drop("primary_domain")
    return patches.patch_errors(df.withColumn("patch", patches.repaired_patch(F.col("patch"), F.col("axis"), F.col("operator_id"), F.col("transformation_goal"))))


SEED_REQUIREMENT = "The seed's result stays as it was."


def requirements(envs: DataFrame, ops: DataFrame) -> DataFrame:
    """Requirements of each environment with their ids: the seed's result, and what each operator's case must show."""
    seed = envs.select("env_id", F.lit(0).cast("long").alias("position"), F.lit(None).cast("string").alias("operator_id"), F.lit("seed").alias("axis"), F.lit(SEED_REQUIREMENT).alias("text"))
    own = ops.select("env_id", F.col("position").cast("long").alias("position"), "operator_id", "axis", F.col("semantic_spec.requirement").alias("text"))
    return rubrics.number_requirements(seed.unionByName(own))


def scaled_cases(envs: DataFrame, ops: DataFrame) -> DataFrame:
    """The seed's case for each environment, and one for each operator: the blueprint that a model may replace (``case_repair``)."""
    e = envs.select("env_id", "call_code", F.col("expected_output").alias("expected_output_signature"))
    text = lambda c, name: F.lit(c).alias(name)
    seed = e.select("env_id", "call_code", F.lit(0).cast("long").alias("position"), text("seed_case", "case_id"), text("The seed's own call.", "description"), text("seed_regression", "case_kind"), text("", "targets_operator_id"), text("seed", "axis"),
                    text("The seed's behaviour stays.", "semantic_intent"), text("Same output as the seed.", "target_constraint"), text("seed_behaviour_lost", "expected_failure_mode"), F.array(F.lit(SEED_REQUIREMENT)).alias("covered_requirements"))
    own = ops.join(e.select("env_id", "call_code"), "env_id").select(
        "env_id", "call_code", F.col("position").cast("long").alias("position"), F.concat("operator_id", F.lit("_case")).alias("case_id"), F.concat("transformation_goal", F.lit(" The call: "), "call_code").alias("description"),
        F.col("semantic_spec.test_template_type").alias("case_kind"), F.col("operator_id").alias("targets_operator_id"), "axis", F.col("transformation_goal").alias("semantic_intent"), F.col("semantic_spec.requirement").alias("target_constraint"),
        F.col("semantic_spec.expected_failure_mode").alias("expected_failure_mode"), F.array("semantic_spec.requirement").alias("covered_requirements"),
    )
    return seed.unionByName(own).join(e.drop("call_code"), "env_id").withColumns({"setup_code": F.lit(""), "assertion_code": F.lit("")})


def with_states(envs: DataFrame, states: DataFrame) -> DataFrame:
    """Environments with the maps of the states that are read as requirements; those without patches have empty ones."""
    none = F.create_map().cast("map<string,string>")
    df = envs.select("env_id", F.lit(None).cast("string").alias("user_prompt")).join(states.select("env_id", "visible_state", "task_state"), "env_id", "left")
    return df.withColumns({c: F.coalesce(c, none) for c in ("visible_state", "task_state")})


def rewritten(envs: DataFrame, ops: DataFrame, cases: DataFrame, states: DataFrame) -> DataFrame:
    """The finished prompt of each environment, from its states, operators and valid cases."""
    own = ops.withColumn("output_requirements", F.array("semantic_spec.requirement"))
    asked = prompts.requirements_of(with_states(envs, states).drop("user_prompt"), own, cases.where("valid"))
    df = envs.select("env_id", "problem", "context_summary").join(asked.select("env_id", "requirements"), "env_id")
    return df.select("env_id", prompts.prompt(F.col("env_id"), F.col("requirements"), F.col("problem"), F.col("context_summary")).alias("user_prompt"))


def realized(ops: DataFrame, cases: DataFrame, golds: DataFrame, envs: DataFrame, written: DataFrame) -> DataFrame:
    """Operators with the verdict of ``gates.realization`` from their patch, the finished prompt, their cases and the solution's runs."""
    reports = golds.select("env_id", F.inline("case_reports")).select("env_id", "case_id", "passed")
    usable = (F.trim(F.coalesce("call_code", F.lit(""))) != "") & (F.size(F.json_object_keys("expected_output_signature")) > 0)
    links = rubrics.linked_cases(ops.select("env_id", "operator_id", "axis"), cases.withColumn("targets", F.col("targets_operator_id")))
    own = links.join(cases.select("env_id", "case_id", F.coalesce(usable, F.lit(False)).alias("usable")), ["env_id", "case_id"]).join(reports, ["env_id", "case_id"], "left")
    counts = own.groupBy("env_id", "operator_id").agg(F.count("*").alias("linked_cases"), F.count_if("usable").alias("valid_cases"), F.count_if(F.coalesce("passed", F.lit(False))).alias("passed_cases"), F.count_if(~F.coalesce("passed", F.lit(True))).alias("failed_cases"))
    state = patches.state_maps(patches.applied(ops)).select("env_id", F.coalesce(F.try_element_at("gold_state", F.lit("answer_invariant")) == "true", F.lit(False)).alias("answer_invariant"))
    reused = envs.select("env_id", F.col("gold_solution").alias("__seed")).join(golds.select("env_id", "gold_code"), "env_id").select("env_id", F.coalesce(F.trim("__seed") == F.trim("gold_code"), F.lit(False)).alias("gold_reused"))
    seen = envs.select("env_id", F.concat_ws("\n", "problem", "context_summary").alias("seed_text")).join(written, "env_id")
    df = prompts.exposures(ops.withColumn("output_requirements", F.array("semantic_spec.requirement")), cases, seen).drop("output_requirements")
    df = df.join(counts, ["env_id", "operator_id"], "left").join(state, "env_id").join(reused, "env_id")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("linked_cases", "valid_cases", "passed_cases", "failed_cases")}
    facts = {"intensity": F.col("operator_intensity"), "has_patch": patches.realized_patch(F.col("axis"), F.col("patch")), "invariant_declared": patches.has(F.col("patch"), [("gold", "answer_invariant")])}
    return gates.realization(df.withColumns(zero).withColumns(facts)).drop("patch", "semantic_spec")


def with_golds(envs: DataFrame, cases: DataFrame, golds: DataFrame, real: DataFrame, strict: bool) -> DataFrame:
    """Environments with their solution and decision: one whose solution or cases fail is rejected, and with ``strict`` one with an operator that isn't realized."""
    bad = cases.groupBy("env_id").agg(F.every("valid").alias("cases_valid"))
    hard = real.groupBy("env_id").agg(F.some(F.col("severity") == "hard_fail").alias("unrealized"))
    df = envs.drop("export_status").join(golds.select("env_id", "gold_code", "gold_passed", "repair_attempts"), "env_id").join(bad, "env_id", "left").join(hard, "env_id", "left")
    flags = gates.reasons((~F.col("gold_passed"), "SCALED_GOLD_FAILED"), (~F.coalesce("cases_valid", F.lit(False)), "INVALID_CASES"), (F.col("unrealized") & F.lit(strict), "OPERATOR_NOT_REALIZED"))
    out = df.withColumns({"blocking_flags": F.concat("blocking_flags", flags), "gold_solution": F.col("gold_code")})
    return gates.export_status(out).drop("gold_code", "gold_passed", "cases_valid", "unrealized")


def graded(seeds: DataFrame, plans: DataFrame, ops: DataFrame, seen: DataFrame) -> DataFrame:
    """Scaled environments with their decision: a plan that breaks a rule or operators that don't add up are rejected."""
    off = planning.intensity_mismatch(ops, plans).select("env_id").distinct().withColumn("mismatch", F.lit(True))
    base = seeds.withColumnRenamed("env_id", "base_env_id").drop("original_task_id", "primary_task_type")
    code = seen.select(F.col("task_id").alias("original_task_id"), "gold_code", "call_code", F.col("output").alias("expected_output"))
    df = plans.join(base, "base_env_id").join(off, "env_id", "left").join(code, "original_task_id").withColumn("gold_solution", F.col("gold_code")).drop("gold_code")
    flags = F.concat("violations", gates.reasons((F.coalesce("mismatch", F.lit(False)), "AXIS_INTENSITY_MISMATCH")))
    df = tasks.seed_admission(df).withColumn("blocking_flags", F.concat(flags, "admission_failures"))
    return gates.export_status(df.withColumns({"final_decision": F.lit(None).cast("string"), "passed": F.lit(None).cast("boolean")})).drop("mismatch")


def evaluated(runs: DataFrame, envs: DataFrame, seen: DataFrame) -> DataFrame:
    """Runs with their case executed and checked against the expected output."""
    e = envs.select("env_id", "original_task_id", "call_code", "expected_output")
    df = runs.join(e, "env_id")
    cases = df.where("final_code is not null").select("env_id", F.col("final_code").alias("code"), F.lit("").alias("setup_code"), "call_code")
    ran = adapters.execute(cases, ["env_id"]).withColumnRenamed("output", "seen_output")
    joined = df.join(ran, "env_id", "left").withColumn("checks", constraints.signature_checks(F.col("expected_output"))).withColumn("output", F.coalesce("seen_output", F.lit("{}")))
    checked = constraints.run_checks(joined.drop("failure_reasons"), ["env_id"]).withColumnRenamed("failure_reasons", "check_failures").join(runs.select("env_id", "failure_reasons"), "env_id")
    ok = F.coalesce("ok", F.lit(False)) & F.col("passed")
    events = F.from_json("trace", "array<struct<tool_name:string,budget_violation:boolean,result:string,budget_error:string>>")
    none = F.array().cast("array<string>")
    return checked.select(
        "env_id",
        "original_task_id",
        "level",
        F.col("final_code").isNotNull().alias("compile_passed"),
        ok.alias("execution_passed"),
        F.when(ok, 1).otherwise(0).alias("passed_cases"),
        F.lit(1).alias("total_cases"),
        F.concat("failure_reasons", "check_failures").alias("failure_reasons"),
        F.when(F.col("error").isNotNull(), F.array("error")).otherwise(none).alias("case_reports"),
        none.alias("notes"),
        F.coalesce(events, F.array().cast("array<struct<tool_name:string,budget_violation:boolean,result:string,budget_error:string>>")).alias("tool_trace"),
        F.lit(0.0).alias("rubric_score"),
    )


def retry(run: Run, evals: DataFrame, source: str = "evaluation_case_source") -> DataFrame:
    """Environments whose failure another try may mend."""
    return evals.where(gates.retryable(F.col(source), F.concat_ws("\n", "failure_reasons"))).select("env_id")


def merged_retry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evaluations with retried rows in the place of the failed ones."""
    return upserts.merge(old, new, ["env_id"])

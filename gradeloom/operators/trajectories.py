"""Tool trajectories for fine-tuning: from gold code and from a model, with graded final code."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.operators.adapters import Episode, ModelClient, run_code
from gradeloom.operators.exports import sample_id

COLUMNS = "env_id string, sample_type string, messages string, final_code string, execution_passed boolean, used_tools array<string>, reject_reason string"
GOLD, TEACHER = "oracle_gold_tool_trajectory", "teacher_tool_trajectory"


def _message(role: str, content: str | None = None, call: tuple[str, dict] | None = None, name: str | None = None) -> dict:
    m: dict = {"role": role}
    if content is not None:
        m["content"] = content
    if call:
        m["tool_calls"] = [{"id": f"call_{call[0]}", "type": "function", "function": {"name": call[0], "arguments": json.dumps(call[1])}}]
    if name:
        m["name"] = name
    return m


def play(env: dict, steps: list[tuple[str, dict]]) -> tuple[list[dict], Episode]:
    """Messages of an episode in which the assistant makes the given calls."""
    ep = Episode(env)
    messages = [_message("system", "Solve the task with the tools, then submit final code."), _message("user", str(env.get("problem") or ""))]
    for tool, args in steps:
        messages.append(_message("assistant", None, (tool, args)))
        messages.append(_message("tool", json.dumps(ep.call(tool, args.get("code"))), name=tool))
    return messages, ep


def graded(env: dict, code: str) -> bool:
    """The code gives the expected value for the environment's call."""
    from gradeloom.functions.values import match, steady

    ran = run_code(code, env.get("call_code") or "", {}, 5.0)
    want = json.loads(env.get("expected_output") or "{}")
    return bool(ran["ok"]) and match(steady(ran.get("return_value")), steady(want.get("return_value")))


def trajectories(envs: DataFrame, client: ModelClient | None = None) -> DataFrame:
    """A trajectory per environment, of gold code or, with a client, of the model's code; graded code alone is accepted (null ``reject_reason``).

    Reads ``env_id``, ``level``, ``problem``, ``signature``, ``gold_solution``, ``call_code``, ``expected_output`` (JSON text). The expectation filters; it never enters a message."""
    names = ["env_id", "level", "problem", "signature", "gold_solution", "call_code", "expected_output"]

    def run(batches):
        for pdf in batches:
            rows = []
            for env in pdf.to_dict("records"):
                kind = TEACHER if client else GOLD
                code = str((client.complete("teacher_solution", {"env_id": env["env_id"], "problem": env["problem"]}) if client else {}).get("final_code") or env.get("gold_solution") or "")
                if not code.strip():
                    rows.append((env["env_id"], kind, None, None, False, [], "missing_reference_code"))
                    continue
                messages, ep = play(env, [("get_task_context", {}), ("validate_candidate_code", {"code": code}), ("submit_final_code", {"code": code})])
                ok = ep.final is not None and graded(env, code)
                why = None if ok else "no_valid_final_submission" if ep.final is None else "hidden_oracle_failed"
                rows.append((env["env_id"], kind, json.dumps(messages), code, ok, [t["tool_name"] for t in ep.trace], why))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    made = envs.select(*names).mapInPandas(run, COLUMNS)
    return made.withColumn("sample_id", sample_id(F.col("env_id"), F.col("sample_type"), F.col("final_code")))


def seed_requirements(envs: DataFrame) -> DataFrame:
    """Environments with ``seed_requirements``: what the unscaled task did must stay. Reads ``signature``, ``call_code``, ``expected_output``."""
    name = F.regexp_extract(F.coalesce("signature", F.lit("")), r"def\s+(\w+)", 1)
    get = lambda k: F.get_json_object("expected_output", f"$.{k}")
    kept = F.when(name != "", F.concat(F.lit("Preserve the original seed behavior for "), name, F.lit("."))).otherwise(F.lit("Preserve the original seed behavior."))
    one = F.array(
        kept,
        F.concat(F.lit("Original seed call: "), F.substring(T.comparable("call_code"), 1, 220)),
        F.concat(F.lit("On the original seed call the return type is "), get("return_type"), F.lit(".")),
        F.concat(F.lit("On the original seed call the return value is "), F.substring(get("return_value"), 1, 260), F.lit(".")),
    )
    usable = (T.strip(F.coalesce("call_code", F.lit(""))) != "") & (F.coalesce(F.size(F.json_object_keys("expected_output")), F.lit(0)) > 0)
    return envs.withColumn("seed_requirements", F.when(usable, F.filter(one, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")))


def with_regression_case(cases: DataFrame, envs: DataFrame) -> DataFrame:
    """Cases with one regression case per environment made of its seed call, unless it has one."""
    have = cases.where("case_kind = 'seed_regression'").select("env_id").distinct()
    made = seed_requirements(envs).where(F.size("seed_requirements") > 0).join(have, "env_id", "left_anti")
    extra = made.select(
        "env_id",
        F.concat("env_id", F.lit("_seed_regression")).alias("case_id"),
        F.lit("seed_regression").alias("case_kind"),
        "call_code",
        F.col("expected_output").alias("expected_output_signature"),
        F.col("seed_requirements").alias("covered_requirements"),
    )
    return cases.unionByName(extra, allowMissingColumns=True)

"""Solutions of scaled environments: asked of the model, run on the environment's cases and repaired in bounded rounds."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.functions.values import check, load
from gradeloom.operators.adapters import ModelClient, run_code
from gradeloom.operators.constraints import CHECK, failure_types_of, repair_rules_of

REPORT = "struct<case_id:string,passed:boolean,failure_reasons:array<string>>"
MADE = f"gold_code string, repair_attempts int, gold_passed boolean, gold_failures array<string>, case_reports array<{REPORT}>, repair_trace string"


def case_failures(code: str, case, timeout: float = 15.0) -> list[str]:
    """Reasons why a solution fails a case: an error of the run, or checks that don't hold."""
    ran = run_code(code or "", f"{case['setup_code'] or ''}\n{case['call_code'] or ''}", {}, timeout)
    if not ran["ok"]:
        return [f"CASE_EXECUTION_ERROR:{ran.get('error')}"]
    found = [(c["check_id"], *check(ran, c["kind"] or "", c["rule"] or "", load(c["params"]) or {})) for c in case["checks"]]
    return [f"OUTPUT_CONSTRAINT_FAILED:{name}:{why}" for name, ok, why in found if not ok]


def solve(env: dict, cases: list, client: ModelClient, rounds: int, timeout: float = 15.0) -> tuple:
    """One environment's solution: the model's, else the seed's, run on all cases and repaired while one fails, at most ``rounds`` times.

    A reply without code keeps the code before it. The cases are never changed. The last repair is run too."""
    asked = {"env_id": env["env_id"], "problem": env.get("problem"), "seed_code": env.get("gold_solution"), "calls": [c["call_code"] for c in cases]}
    code = str(client.complete("scaled_gold", asked).get("code") or "").strip("\n") or env.get("gold_solution") or ""
    trace: list[dict] = []
    while True:
        reports = [(c["case_id"], case_failures(code, c, timeout)) for c in cases]
        failures = list(dict.fromkeys(r for _, rs in reports for r in rs))
        if not cases:
            failures = ["NO_CASES"]
        if not failures or not cases or len(trace) >= rounds:
            break
        types = failure_types_of(failures)
        step = {"attempt": len(trace) + 1, "failures": failures, "failure_types": types, "repair_rules": repair_rules_of(types)}
        trace.append(step)
        failed = [{"case_id": i, "failure_reasons": rs} for i, rs in reports if rs]
        code = str(client.complete("scaled_gold_repair", asked | step | {"code": code, "failed_cases": failed}).get("code") or "").strip("\n") or code
    return code, len(trace), not failures, failures, [{"case_id": i, "passed": not rs, "failure_reasons": rs} for i, rs in reports], json.dumps(trace)


def gold_solutions(envs: DataFrame, cases: DataFrame, client: ModelClient, rounds: int = 3, timeout: float = 15.0) -> DataFrame:
    """``env_id`` with ``gold_code``, ``gold_passed``, ``gold_failures``, ``case_reports``, ``repair_attempts`` and ``repair_trace``.

    ``envs``: ``env_id``, ``problem``, ``gold_solution``; ``cases``: ``env_id``, ``case_id``, ``position``, ``setup_code``, ``call_code``, ``checks`` (array of CHECK). An environment's cases
    are few by design and run in one place, as each repair needs all of them. One without cases fails with NO_CASES. The model is asked again if a task is
    lost: give a client that answers equal requests alike, and write the result once.
    """
    case = f"struct<position:bigint,case_id:string,setup_code:string,call_code:string,checks:array<{CHECK}>>"
    one = F.struct(F.col("position").cast("long").alias("position"), "case_id", "setup_code", "call_code", F.coalesce("checks", F.array().cast(f"array<{CHECK}>")).alias("checks")).cast(case)
    per = cases.groupBy("env_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).otherwise(0)).alias("cases"))
    joined = envs.select("env_id", "problem", "gold_solution").join(per, "env_id", "left").withColumn("cases", F.coalesce("cases", F.array().cast(f"array<{case}>")))
    fields = StructType.fromDDL(MADE).fields

    def run(batches):
        for pdf in batches:
            rows = [solve(env, list(env["cases"]), client, rounds, timeout) for env in pdf.to_dict("records")]
            out = pd.DataFrame(rows, columns=[f.name for f in fields], dtype=object)
            out.insert(0, "env_id", pdf["env_id"].to_numpy())
            yield out.astype({"repair_attempts": "int32", "gold_passed": "bool"})

    return joined.mapInPandas(run, StructType([envs.schema["env_id"], *fields]))

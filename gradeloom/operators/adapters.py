"""The two boundaries of the pipeline: model calls and execution of candidate code. Both run in ``mapInPandas``, in batches."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import sys
import tempfile
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ModelClient(Protocol):
    def complete(self, task: str, context: dict) -> dict: ...


class MockClient:
    """Deterministic answers from a builder per task; unknown tasks echo a digest of their context."""

    def __init__(self, builders: dict[str, Callable[[dict], dict]] | None = None):
        self.builders = builders or {}

    def complete(self, task: str, context: dict) -> dict:
        if task in self.builders:
            return self.builders[task](context)
        return {"task": task, "digest": hashlib.md5(json.dumps(context, sort_keys=True).encode()).hexdigest()}


class RetryingClient:
    """Tries again after failures that may pass, with growing pauses; the last failure is the answer."""

    def __init__(self, inner: ModelClient, tries: int = 5, pause: Callable[[float], None] | None = None):
        self.inner, self.tries, self.pause = inner, tries, pause or (lambda s: None)

    def complete(self, task: str, context: dict) -> dict:
        error = ""
        for k in range(1, self.tries + 1):
            try:
                return self.inner.complete(task, context)
            except (TimeoutError, ConnectionError) as e:
                error = f"{type(e).__name__}: {e}"
                self.pause(min(8.0, 0.75 * 2 ** (k - 1)))
        return {"error": error}


def request_key(task: str, context: str, model: str = "mock"):
    """Key of a request in the cache."""
    return F.md5(F.concat_ws("\x00", F.lit(task), F.lit(model), F.col(context)).cast("binary"))


def call_model(rows: DataFrame, client: ModelClient, task: str, key: list[str], context: str, cache: DataFrame | None = None, model: str = "mock") -> DataFrame:
    """Columns ``key`` and ``response`` (JSON text) for each row's ``context`` (JSON text). Cached requests aren't sent again, equal ones are sent once."""
    asked = rows.select(*key, F.col(context).alias("__context"), request_key(task, context, model).alias("key_hash"))
    if cache is not None:
        asked = asked.join(cache.select("key_hash", F.col("response").alias("__cached")), "key_hash", "left")
    else:
        asked = asked.withColumn("__cached", F.lit(None).cast("string"))
    fresh = asked.where("__cached is null").groupBy("key_hash").agg(F.min("__context").alias("__context"))

    def ask(batches):
        for pdf in batches:
            yield pd.DataFrame({"key_hash": pdf["key_hash"], "response": [json.dumps(client.complete(task, json.loads(c or "{}")), sort_keys=True) for c in pdf["__context"]]})

    answers = fresh.mapInPandas(ask, "key_hash string, response string")
    return asked.join(answers, "key_hash", "left").select(*key, "key_hash", F.coalesce("__cached", "response").alias("response"))


def run_code(code: str, call: str, files: dict[str, str], timeout: float = 15.0) -> dict:
    """Run code and a call that sets ``result`` in a child process of its own folder; its output as a signature."""
    script = (
        "import json, sys\n"
        "ns = {}\n"
        "exec(compile(open('candidate.py').read(), 'candidate.py', 'exec'), ns)\n"
        "exec(compile(open('call.py').read(), 'call.py', 'exec'), ns)\n"
        "v = ns.get('result')\n"
        "def plain(x):\n"
        "    if x is None or isinstance(x, (bool, int, float, str)): return x\n"
        "    if isinstance(x, dict): return {str(k): plain(y) for k, y in x.items()}\n"
        "    if isinstance(x, (list, tuple)): return [plain(y) for y in x]\n"
        "    if isinstance(x, (set, frozenset)): return sorted(map(plain, x), key=str)\n"
        "    return plain(x.tolist()) if hasattr(x, 'tolist') else repr(x)\n"
        "open('.result', 'w').write(json.dumps({'return_value': plain(v), 'return_type': type(v).__name__}))\n"
    )
    with tempfile.TemporaryDirectory() as folder:
        for name, text in {**files, "candidate.py": code, "call.py": call, ".run.py": script}.items():
            path = os.path.normpath(os.path.join(folder, name))
            if not path.startswith(folder + os.sep):
                return {"ok": False, "error": f"unsafe path {name}"}
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w") as f:
                f.write(text)
        before = {os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names}
        try:
            ran = subprocess.run([sys.executable, "-I", ".run.py"], cwd=folder, capture_output=True, text=True, timeout=timeout, env={"PATH": os.environ.get("PATH", "")})
        except subprocess.TimeoutExpired:
            return {"ok": False, "error": "timeout"}
        made = sorted({os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names} - before - {".result"})
        if ran.returncode or not os.path.exists(os.path.join(folder, ".result")):
            return {"ok": False, "stdout": ran.stdout, "error": (ran.stderr.strip().splitlines() or ["failed"])[-1]}
        with open(os.path.join(folder, ".result")) as f:
            return {"ok": True, "stdout": ran.stdout, "file_artifacts": [{"path": p} for p in made], **json.load(f)}


def execute(cases: DataFrame, key: list[str], timeout: float = 15.0) -> DataFrame:
    """Cases (``code``, ``setup_code``, ``call_code``) run in child processes: ``ok``, ``error`` and ``output`` (JSON text)."""
    schema = StructType([*(cases.schema[c] for c in key), *StructType.fromDDL("ok boolean, error string, output string").fields])

    def run(batches):
        for pdf in batches:
            seconds = min(15.0, max(1.0, timeout))
            found = [run_code(c or "", f"{s or ''}\n{k or ''}", {}, seconds) for c, s, k in zip(pdf["code"], pdf["setup_code"], pdf["call_code"])]
            out = pdf[key].copy()
            out["ok"] = [f["ok"] for f in found]
            out["error"] = [f.get("error") for f in found]
            out["output"] = [json.dumps({k: v for k, v in f.items() if k not in ("ok", "error")}) for f in found]
            yield out

    return cases.select(*dict.fromkeys([*key, "code", "setup_code", "call_code"])).mapInPandas(run, schema)


# Limits of tool calls by level (in all, and of one tool), and turns.
TOOL_LIMITS = {"M1": (6, 2), "M2": (7, 2), "M3": (9, 4), "M4": (11, 5)}
TURNS = {"M1": 7, "M2": 7, "M3": 9, "M4": 12}


class Episode:
    """Tools of one environment: budget is marked, not enforced; a submission that fails preflight is given back."""

    def __init__(self, env: dict, limits: dict | None = None):
        self.env, self.calls, self.trace = env, {}, []
        self.total, self.each = (limits or TOOL_LIMITS).get(env.get("level") or "M2", TOOL_LIMITS["M2"])
        self.final: dict | None = None

    def call(self, tool: str, code: str | None = None) -> dict:
        from gradeloom.functions.code import preflight

        over = tool != "submit_final_code" and (sum(v for k, v in self.calls.items() if k != "submit_final_code") >= self.total or self.calls.get(tool, 0) >= self.each)
        self.calls[tool] = self.calls.get(tool, 0) + 1
        if tool == "get_task_context":
            result = {"problem": self.env.get("problem"), "signature": self.env.get("signature")}
        elif tool == "validate_candidate_code":
            result = {"failures": preflight(code, self.env.get("signature"))}
        elif tool == "run_custom_test":
            result = run_code(self.env.get("gold_solution") or "", code or "", {}, 15.0)
        elif tool == "submit_final_code":
            failures = preflight(code, self.env.get("signature"))
            if failures:
                self.calls[tool] -= 1
                result = {"failures": failures}
            else:
                self.final = result = {"accepted": True, "code": code}
        else:
            result = {"error": f"unknown tool {tool}"}
        self.trace.append({"tool_name": tool, "result": json.dumps(result), "budget_violation": over})
        return result


def run_agents(envs: DataFrame, client: ModelClient) -> DataFrame:
    """One bounded episode per environment: each turn asks the model for a tool call until it submits or its turns end."""

    def run(batches):
        for pdf in batches:
            rows = []
            for env in pdf.to_dict("records"):
                ep = Episode(env)
                for turn in range(TURNS.get(env.get("level") or "M2", 7)):
                    asked = client.complete("agent_turn", {"env_id": env["env_id"], "turn": turn, "gold_solution": env.get("gold_solution")})
                    ep.call(str(asked.get("tool") or "submit_final_code"), asked.get("code"))
                    if ep.final:
                        break
                reasons = [] if ep.final else ["MAX_TURNS_WITHOUT_VALID_FINAL_CODE"]
                rows.append((env["env_id"], env.get("level"), (ep.final or {}).get("code"), json.dumps(ep.trace), reasons))
            yield pd.DataFrame(rows, columns=["env_id", "level", "final_code", "trace", "failure_reasons"])

    return envs.select("env_id", "level", "problem", "signature", "gold_solution").mapInPandas(run, "env_id string, level string, final_code string, trace string, failure_reasons array<string>")

"""Validating and repairing oracle cases until nothing fails, in bounded rounds.

A round mends what rules can mend, validates, and looks for requirements without a case. Environments without a failure are done; the others, a shrinking frontier, go to the model and into
the next round. Each round's cases are written before the model is asked again, so a lost task repeats one round's requests at most.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gradeloom.functions import text as T
from gradeloom.functions.code import assigns_result
from gradeloom.operators import constraints, evidence, verifiers
from gradeloom.operators.adapters import ModelClient
from gradeloom.sources.shared import growing, written

TEXTS = ["case_id", "description", "case_kind", "targets_operator_id", "axis", "semantic_intent", "target_constraint", "expected_failure_mode", "expected_output_signature", "setup_code", "call_code", "assertion_code"]
LISTS = ["covered_requirements", "covered_requirement_ids"]
CASE = ", ".join(["position long", *(f"{c} string" for c in TEXTS), *(f"{c} array<string>" for c in LISTS)])
COLUMNS = ["position", *TEXTS, *LISTS]


def rule_repaired(cases: DataFrame, operators: DataFrame) -> DataFrame:
    """Cases with what rules can mend: ``verifiers.repaired_cases``, then the kind by the id, a signature that is an object without addresses, a call that assigns a result, and for
    a generic constraint or intent the goal of the operator."""
    df = verifiers.repaired_cases(cases, operators)
    goal = operators.select("env_id", F.col("operator_id").alias("targets_operator_id"), F.col("transformation_goal").alias("__goal")).dropDuplicates(["env_id", "targets_operator_id"])
    df = df.join(growing(goal), ["env_id", "targets_operator_id"], "left")
    kind = F.when(F.contains("case_id", F.lit("seed_case_main")), "scaled_seed_case_main").otherwise("coverage_extension")
    is_object = F.coalesce(F.json_object_keys("expected_output_signature").isNotNull(), F.lit(False))
    call = T.strip(F.coalesce("call_code", F.lit("")))
    lifted = lambda c: F.when(F.col("__goal").isNotNull() & evidence.is_generic(F.col(c)) & ~evidence.is_generic(F.col("__goal")), F.col("__goal")).otherwise(F.col(c))
    return df.withColumns(
        {
            "case_kind": F.coalesce(T.present("case_kind"), kind),
            "expected_output_signature": F.when(is_object, T.stable_repr("expected_output_signature")).otherwise(F.lit("{}")),
            "call_code": F.when((call != "") & ~assigns_result(call), F.concat(F.col("call_code"), F.lit("\nresult = None"))).otherwise(F.col("call_code")),
            "target_constraint": lifted("target_constraint"),
            "semantic_intent": lifted("semantic_intent"),
        }
    ).select("env_id", *COLUMNS)


def failures(checked: DataFrame, requirements: DataFrame, envs: DataFrame) -> DataFrame:
    """Environments of ``envs`` that need a repair, with ``failures``: reasons of invalid cases by case, and codes of requirements without a case."""
    bad = checked.where("not valid").select("env_id", F.coalesce("case_id", F.lit("")).alias("case_id"), "failure_reasons")
    bound = checked.where("valid").select("env_id", F.explode("covered_requirement_ids").alias("requirement_id"), "matched_requirement_ids")
    bound = bound.select("env_id", "requirement_id", F.array_contains("matched_requirement_ids", F.col("requirement_id")).alias("passed"))
    own = requirements.join(growing(envs.select("env_id")), "env_id", "left_semi")
    gaps = evidence.requirement_gaps(own, bound).select("env_id", F.concat(F.lit("missing_coverage:"), "requirement_id").alias("case_id"), F.array("code").alias("failure_reasons"))
    return bad.unionByName(gaps).groupBy("env_id").agg(F.array_sort(F.collect_list(F.struct("case_id", "failure_reasons"))).alias("failures"))


def _row(env_id, place: int, case: dict) -> list:
    """A case of a reply as a row; what isn't a text or a list of texts is made one."""
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, sort_keys=True)
    position = case.get("position")
    lists = [[str(x) for x in case[c]] if isinstance(case.get(c), list) else [] for c in LISTS]
    return [env_id, position if isinstance(position, int) else place, *(text(case.get(c)) for c in TEXTS), *lists]


def asked_again(cases: DataFrame, failing: DataFrame, client: ModelClient, attempt: int) -> DataFrame:
    """The cases of ``failing`` environments as the model repairs them; an answer without cases leaves them as they are."""
    one = F.struct(*(F.col(c) for c in COLUMNS)).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in CASE.split(', '))}>")
    per = cases.groupBy("env_id").agg(F.sort_array(F.collect_list(one)).alias("cases"))
    rows = failing.join(growing(per), "env_id", "left").select("env_id", F.to_json("cases").alias("cases"), F.to_json("failures").alias("failures"))

    def ask(batches):
        for pdf in batches:
            out = []
            for env_id, cases_, failed in zip(pdf["env_id"], pdf["cases"], pdf["failures"]):
                now = json.loads(cases_) if cases_ else []
                reply = client.complete("oracle_case_repair", {"env_id": env_id, "attempt": attempt, "cases": now, "failures": json.loads(failed)})
                given = [c for c in (reply.get("cases") or []) if isinstance(c, dict)] if isinstance(reply.get("cases"), list) else []
                out += [_row(env_id, k, case) for k, case in enumerate(given or now)]
            yield pd.DataFrame(out, columns=["env_id", *COLUMNS], dtype=object).astype({"position": "int64"})

    return rows.mapInPandas(ask, StructType([cases.schema["env_id"], *StructType.fromDDL(CASE).fields]))


def validated(cases: DataFrame, operators: DataFrame, requirements: DataFrame, visible: DataFrame, client: ModelClient, rounds: int = 3, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Cases with their verdict (``constraints.validate_cases``) and ``repairs``, how often their environment went to the model: at most ``rounds`` times.

    ``keep`` writes a table under a name and reads it back. The result is the union of what each round finished, so it doesn't depend on the order of anything."""
    ops = evidence.operator_texts(operators)
    envs = requirements.select("env_id").unionByName(cases.select("env_id")).distinct()
    lists = {c: F.col(c) if c in cases.columns else evidence.no_texts() for c in LISTS}
    frontier, done = cases.withColumns(lists).select("env_id", F.col("position").cast("long").alias("position"), *TEXTS, *LISTS), None
    for attempt in range(rounds + 1):
        ruled = keep(rule_repaired(frontier, operators), f"cases-{attempt}-ruled")  # validation reads them several times
        checked = constraints.validate_cases(ruled, ops, "env_id", requirements, visible)
        checked = keep(checked.withColumn("repairs", F.lit(attempt)), f"cases-{attempt}")
        if attempt == rounds:
            return checked if done is None else done.unionByName(checked)
        failing = keep(failures(checked, requirements, envs), f"cases-{attempt}-failures")
        left = checked.join(growing(failing), "env_id", "left_anti")
        done = left if done is None else done.unionByName(left)
        if failing.isEmpty():
            return done
        envs = failing.select("env_id")
        frontier = keep(asked_again(checked.join(growing(envs), "env_id", "left_semi"), failing, client, attempt + 1), f"cases-{attempt}-repaired")
    return done

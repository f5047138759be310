"""Raw task records to tasks and seed environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as T
from gradeloom.functions.text import context_summary, first_raw, first_text, slug
from gradeloom.operators.taxonomy import PLACEHOLDER

# Names that a field goes by in raw records, in order of preference.
ALIASES = {
    "task_id": ("idx", "task_id", "id", "instance_id", "question_id"),
    "problem": ("problem", "instruction", "question", "prompt", "description"),
    "context": ("context", "starter_code", "template_code", "code"),
    "solution": ("solution", "ground_truth", "answer", "expected_answer"),
    "code": ("code", "full_code", "reference_code"),
    "signature": ("signature",),
    "task_family": ("task_family",),
}
RESOURCES = ("resources", "resource_files", "resource_paths", "files", "artifacts")
CODE_FIELDS = ("context", "solution", "code")


def field(record: Column, name: str) -> Column:
    return F.get_json_object(record, f"$.{name}")


def resource_files(record: Column) -> Column:
    """Paths of all resource fields: lists or objects, of strings or of objects with ``path``, ``name`` or ``file``; each once, in order."""
    lists = []
    for name in RESOURCES:
        raw = field(record, name)
        as_list = F.coalesce(F.from_json(raw, "array<string>"), F.map_values(F.from_json(raw, "map<string,string>")), F.when(F.trim(raw) != "", F.array(raw)))
        path = lambda x: F.when(x.startswith("{"), F.coalesce(field(x, "path"), field(x, "name"), field(x, "file"))).otherwise(x)
        lists.append(F.coalesce(F.transform(as_list, path), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*lists)), lambda x: T.strip(x)), lambda x: x.isNotNull() & (x != "")))


def normalize(raw: DataFrame, split: str = "train", record: str = "value") -> DataFrame:
    """Raw JSON lines (``value``, ``row_idx`` from 1) to tasks; a missing id is made of split and row."""
    r = F.col(record)
    picks = {k: (first_raw if k in CODE_FIELDS else first_text)(*(field(r, a) for a in names)) for k, names in ALIASES.items()}
    own = F.coalesce(F.nullif(picks["task_id"], F.lit("")), F.format_string("%s_%06d", F.coalesce(field(r, "source_split"), F.lit(split)), F.col("row_idx")))
    used = {a for names in ALIASES.values() for a in names} | set(RESOURCES) | {"source_split"}
    rest = F.to_json(F.map_filter(F.from_json(r, "map<string,string>"), lambda k, v: ~k.isin(*used)))
    df = raw.select(
        "row_idx",
        own.alias("raw_id"),
        F.coalesce(field(r, "source_split"), F.lit(split)).alias("source_split"),
        *(v.alias(k) for k, v in picks.items() if k != "task_id"),
        resource_files(r).alias("resource_files"),
        rest.alias("raw_metadata"),
    )
    return df.select(
        "row_idx",
        F.concat(F.lit("task_"), slug("raw_id", 64)).alias("task_id"),
        *df.columns[2:],
        F.col("context").contains(PLACEHOLDER).alias("has_placeholder"),
        context_summary("context").alias("context_summary"),
    )


def demo_rows(spark) -> DataFrame:
    """A few raw records for smoke tests."""
    rows = [
        '{"idx": "demo-1", "problem": "Parse a FASTA file and return the sequence lengths.", "context": "def lengths(path):\\n    <<insert solution here>>", "signature": "def lengths(path)", "solution": "return {}", "resources": ["reads.fasta"]}',
        '{"id": "demo-2", "instruction": "Merge two pandas dataframes on a column.", "starter_code": "x = <<insert solution here>>", "answer": "a.merge(b)", "files": [{"path": "a.csv"}, {"name": "b.csv"}]}',
        '{"question": "Compute the mean and variance of an array.", "code": "<<insert solution here>>", "ground_truth": "pass", "extra": 3}',
    ]
    return spark.createDataFrame([(r, i + 1) for i, r in enumerate(rows)], "value string, row_idx long")


def seed_environments(tasks: DataFrame, routing: DataFrame) -> DataFrame:
    """Routed tasks as unscaled environments, by task_id."""
    t = tasks.withColumnRenamed("solution", "gold_solution")
    r = routing.select("task_id", "primary_domain", "secondary_domains", "primary_task_type", "secondary_task_types", "solution_form", "verifier_type_hint", "confidence")
    env = r.drop("solution_form").join(t.drop(*(c for c in t.columns if c in r.columns and c != "task_id")), "task_id")
    form = routing.select("task_id", "solution_form")
    return env.join(form, "task_id").select(F.concat(F.lit("env_"), "task_id").alias("env_id"), F.col("task_id").alias("original_task_id"), *(c for c in env.columns if c != "task_id"), "solution_form", F.lit("M1").alias("level"))


def seed_admission(envs: DataFrame) -> DataFrame:
    """Environments with ``admission_failures``: no code, no call, no expected output."""
    from gradeloom.operators.gates import reasons

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    return envs.withColumn("admission_failures", reasons((blank("gold_solution"), "SEED_CODE_MISSING"), (blank("call_code"), "SEED_CALL_MISSING"), (blank("expected_output"), "SEED_EXPECTED_OUTPUT_MISSING")))


def qa_options(record: Column) -> Column:
    """Options of a multiple-choice record as a map: an object, or a list lettered from A."""
    listed = F.from_json(field(record, "options"), "array<string>")
    letters = F.transform(F.sequence(F.lit(0), F.size(listed) - 1), lambda i: F.char(65 + i))
    return F.coalesce(F.from_json(field(record, "options"), "map<string,string>"), F.when(F.size(listed) > 0, F.map_from_arrays(letters, listed)))


def qa_answer_key(record: Column, options: Column) -> Column:
    """Key of the answer: given as a key, or found by its text."""
    given = F.trim(F.coalesce(field(record, "answer_idx"), field(record, "answer_key"), field(record, "answer"), F.lit("")))
    by_text = F.get(F.map_keys(F.map_filter(options, lambda k, v: F.lower(F.trim(v)) == F.lower(given))), F.lit(0))
    return F.when(F.map_contains_key(options, F.upper(given)), F.upper(given)).otherwise(by_text)


def active_cases(validated: Column, seed: Column) -> Column:
    """Cases to evaluate with, and where they come from."""
    return F.when(F.coalesce(F.size(validated), F.lit(0)) > 0, F.struct(validated.alias("cases"), F.lit("validated").alias("source"))).when(
        F.coalesce(F.size(seed), F.lit(0)) > 0, F.struct(seed.alias("cases"), F.lit("seed").alias("source"))
    ).otherwise(F.struct(F.array().cast("array<string>").alias("cases"), F.lit("none").alias("source")))


def normalize_cases(cases: Column, least: int = 1) -> Column:
    """Cases (``call_code``, ``expected``) without blank ends and without those that lack a call or an expectation; ``too_few`` tells if less than ``least`` are left."""
    trimmed = F.transform(cases, lambda c: F.struct(F.trim(c["call_code"]).alias("call_code"), F.trim(c["expected"]).alias("expected")))
    kept = F.filter(trimmed, lambda c: (F.coalesce(c["call_code"], F.lit("")) != "") & (F.coalesce(c["expected"], F.lit("")) != ""))
    return F.struct(kept.alias("cases"), (F.size(kept) < least).alias("too_few"))


def public_manifest(paths: Column) -> Column:
    """Relative paths inside the task's folder, each once."""
    safe = lambda p: ~p.rlike(r"^(/|~|[A-Za-z]:)") & ~p.rlike(r"(^|/)\.\.(/|$)") & (p != "")
    return F.array_distinct(F.filter(F.transform(paths, lambda p: F.regexp_replace(F.replace(F.trim(p), F.lit("\\"), F.lit("/")), r"^(\./)+", "")), safe))

"""Sources and sinks: JSON lines, JSON documents, YAML, templates, logs."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines in file order: ``row_idx`` from 1 and ``value``; blank lines are skipped, a missing file is an empty table.

    The index comes from counts of each partition, so that no task numbers all rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "row_idx long, value string")
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    sizes = lines.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__part").collect()
    starts, run = [], 0
    for r in sizes:
        starts.append((r["__part"], run - r["first"]))
        run += r["n"]
    table = spark.createDataFrame(starts or [(0, 0)], "__part int, __start long")
    inside = F.col("__at") + F.col("__start") + 1
    return lines.join(F.broadcast(table), "__part").select(inside.alias("row_idx"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed JSON lines; a missing file is an empty table."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a log table."""
    rows.write.mode("append").parquet(path)


def read_splits(spark: SparkSession, paths: dict[str, str], fallback: str | None = None) -> DataFrame:
    """Lines of several splits with ``source_split``; with none there, those of the fallback file."""
    parts = [read_lines(spark, p).withColumn("source_split", F.lit(name)) for name, p in paths.items() if exists(spark, p)]
    if not parts:
        return read_lines(spark, fallback or "").withColumn("source_split", F.lit("train")) if fallback else spark.createDataFrame([], "row_idx long, value string, source_split string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_rows(rows: DataFrame, n: int | None) -> DataFrame:
    """Prefix in input order; deterministic, unlike a limit."""
    return rows if n is None else rows.where(F.col("row_idx") <= n)


def write_document(spark: SparkSession, path: str, value) -> None:
    """One JSON document, written beside its place and moved there."""
    jvm = spark._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(beside, target)


def read_document(spark: SparkSession, path: str):
    rows = spark.read.text(path, wholetext=True).collect() if exists(spark, path) else []
    return json.loads(rows[0]["value"]) if rows else None


def publish(spark: SparkSession, tables: dict[str, str], folder: str) -> DataFrame:
    """Tables (name to path) written once more below ``folder``, by the executors, with a manifest of names and rows. Missing ones and those already in place are left out of the copy."""
    rows = []
    for name, path in tables.items():
        target = f"{folder.rstrip('/')}/{name}"
        if not exists(spark, path):
            continue
        if path.rstrip("/") != target:
            spark.read.parquet(path).write.mode("overwrite").parquet(target)
        rows.append((name, spark.read.parquet(target).count()))
    manifest = spark.createDataFrame(rows, "name string, rows long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/manifest")
    return manifest


def stage_done(spark: SparkSession, path: str, stage: str, rows: int, marks: dict[str, str]) -> None:
    """Status of a finished stage with the marks of its inputs."""
    append_log(spark.createDataFrame([(stage, rows, json.dumps(marks, sort_keys=True))], "stage string, rows long, marks string").withColumn("at", F.current_timestamp()), path)


def is_done(spark: SparkSession, path: str, stage: str, marks: dict[str, str]) -> bool:
    """The stage's last status has the same marks."""
    if not exists(spark, path):
        return False
    last = spark.read.parquet(path).where(F.col("stage") == stage).agg(F.max_by("marks", "at").alias("m")).first()
    return last["m"] == json.dumps(marks, sort_keys=True)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that is there: split file, clean file, raw file."""
    return next((p for p in paths if exists(spark, p)), None)


def past_runs(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """Rows of many runs' files with the file they came from."""
    return spark.read.schema(schema).json(pattern).withColumn("source_file", F.input_file_name())


def latest_artifact(paths: DataFrame) -> DataFrame:
    """Of ``path`` and ``mtime``: the newest, and the one with the largest number at its end."""
    number = F.regexp_extract("path", r"-([0-9]+)/?$", 1).try_cast("long")
    return paths.agg(F.max_by("path", "mtime").alias("newest"), F.max_by("path", F.when(number.isNotNull(), number)).alias("highest"))


def load_yaml(text: str):
    """YAML by PyYAML; without it, a reader of nested maps, lists and plain values."""
    try:
        import yaml
    except ImportError:
        return simple_yaml(text)
    return yaml.safe_load(text)


def _scalar(text: str):
    t = text.strip()
    if t[:1] in "\"'" and t[-1:] == t[:1] and len(t) > 1:
        return t[1:-1]
    if t.startswith("[") and t.endswith("]"):
        return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
    low = t.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def simple_yaml(text: str):
    lines = [(len(x) - len(x.lstrip()), re.sub(r"\s+#.*$", "", x.strip())) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "---"))]

    def block(at: int, depth: int):
        out = None
        while at < len(lines) and lines[at][0] >= depth:
            indent, line = lines[at]
            if indent != depth:
                break
            if line.startswith("- ") or line == "-":
                out = [] if out is None else out
                body = line[2:].strip()
                if body and re.match(r"[\w.-]+:(\s|$)", body):
                    lines[at] = (indent + 2, body)
                    value, at = block(at, indent + 2)
                elif body:
                    value, at = _scalar(body), at + 1
                else:
                    value, at = block(at + 1, lines[at + 1][0])
                out.append(value)
                continue
            out = {} if out is None else out
            key, _, rest = line.partition(":")
            if rest.strip():
                out[key.strip().strip("\"'")], at = _scalar(rest), at + 1
            elif at + 1 < len(lines) and (lines[at + 1][0] > indent or lines[at + 1][1].startswith("-") and lines[at + 1][0] == indent):
                out[key.strip().strip("\"'")], at = block(at + 1, lines[at + 1][0])
            else:
                out[key.strip().strip("\"'")], at = None, at + 1
        return out, at

    return block(0, lines[0][0])[0] if lines else None


def render_template(template: str, values: dict) -> str:
    """``{{ name }}`` replaced; a name without a value is an error."""

    def put(m: re.Match) -> str:
        if m.group(1) not in values:
            raise KeyError(m.group(1))
        v = values[m.group(1)]
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return re.sub(r"\{\{\s*(\w+)\s*\}\}", put, template)


def scoped_paths(paths: dict[str, str], dataset: str, base: str = "data") -> dict[str, str]:
    """Paths below ``base`` moved into the dataset's folder; others as they are."""
    return {k: f"{base}/{dataset}/{v[len(base) + 1:]}" if v.startswith(base + "/") and not v.startswith(f"{base}/{dataset}/") else v for k, v in paths.items()}

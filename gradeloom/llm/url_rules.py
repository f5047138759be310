"""URL rules by a sort-merge range join, in DataFrame functions alone.

A host's canonical key is its labels from the last to the first, each followed by a full stop: ``blog.example.org`` is
``org.example.blog.``. A rule's host with all its subdomains is then one interval of keys, and intervals of rules are
nested or apart. ``sweep_events`` turns the rules, a bounded list that a caller writes down, into the interval ends in
key order, each with the stack of rules that are active from there on. Urls and events are sorted together and swept: a url
takes the stack of the last event before it, and the longest of its rules whose path fits wins.

The sweep is split by the key's first label and, within it, by a hash of the url's row; the few events of a label are
copied to each of its splits, so that a host with a third of all urls is spread over all of them.

A rule list may also be a table (``rule_events``).

Defined cases: a null url or one without ``://`` has an empty host and path, which no rule fits. Equal lengths: the rule
with the longer host wins, then ``block``. Repeated rows are judged each for itself. Extra columns are kept as they are
unless they have the result's names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import own, width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<len:int,host_len:int,verdict:string,path:string,rule:string>>"

#: The rules of the production query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep_events(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, list[tuple]]]:
    """(first label, key, stack of active rules) at each key where the stack changes."""
    by_key: dict[str, list[tuple]] = {}
    for verdict, host, path in rules:
        key = ".".join(reversed(host.split("."))) + "."
        by_key.setdefault(key, []).append((len(host) + len(path), len(host), verdict, path, host + path))
    ends = sorted({(key, 1, key) for key in by_key} | {(key[:-1] + "/", 0, key) for key in by_key})  # "/" follows "."
    stack: list[str] = []
    events: dict[str, tuple[str, list[tuple]]] = {}
    for at, opens, key in ends:
        if opens:
            stack.append(key)
        else:
            stack.remove(key)
        events[at] = (key.split(".", 1)[0], [r for k in stack for r in by_key[k]])
    return [(label, at, active) for at, (label, active) in events.items()]


def rule_events(rules: DataFrame) -> DataFrame:
    """``label``, ``key`` and ``stack`` of the same changes for rules in a table (``verdict``, ``host``, ``path``).

    Intervals are nested or apart, so the rules active in one are those of the keys that its key starts with; where it ends, those of the
    shorter ones. Rules with a null host or path, and repeated rules, don't count."""
    given = rules.select("verdict", "host", "path").where("host is not null and path is not null").distinct()
    rule = F.struct((F.length("host") + F.length("path")).alias("len"), F.length("host").alias("host_len"), "verdict", "path", F.concat("host", "path").alias("rule"))
    by_key = given.groupBy(canonical(F.col("host")).alias("key")).agg(F.collect_list(rule).alias("own"))
    labels = F.split("key", r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    above = by_key.select(F.col("key").alias("at"), F.explode(starts).alias("key")).join(by_key, "key")
    stacks = above.groupBy("at").agg(F.flatten(F.collect_list("own")).alias("inside"), F.coalesce(F.flatten(F.collect_list(F.when(F.col("key") != F.col("at"), F.col("own")))), F.array().cast(STACK)).alias("outside"))
    opens = stacks.select(F.substring_index("at", ".", 1).alias("label"), F.col("at").alias("key"), F.col("inside").cast(STACK).alias("stack"))
    closes = stacks.select(F.substring_index("at", ".", 1).alias("label"), F.concat(F.expr("substring(at, 1, length(at) - 1)"), F.lit("/")).alias("key"), F.col("outside").cast(STACK).alias("stack"))
    return opens.unionByName(closes)


def apply_rules(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", url_col: str = "url", splits: int | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, the winning ``rule`` (null if none fits) and ``verdict``."""
    spark = pages.sparkSession
    splits = splits or width(spark)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rest = rest_of(F.coalesce(F.col(url_col), F.lit("")))
    urls = pages.select(F.struct(*map(own, kept)).alias("row"), host_of(rest).alias("host"), path_of(rest).alias("path"))
    urls = urls.select(
        "row",
        "host",
        "path",
        canonical(F.col("host")).alias("key"),
        F.lit(1).alias("kind"),
        F.lit(None).cast(STACK).alias("stack"),
        F.pmod(F.xxhash64(F.lit(0), *(F.col("row").getField(c) for c, t in pages.dtypes if c in kept and "map<" not in t and "variant" not in t)), F.lit(splits)).cast("int").alias("split"),
    )
    row_type = urls.schema["row"].dataType
    changes = rule_events(rules) if isinstance(rules, DataFrame) else spark.createDataFrame(sweep_events(rules), f"label string, key string, stack {STACK}")
    events = (
        changes.select(F.lit(None).cast(row_type).alias("row"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", F.lit(0).alias("kind"), "stack", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "label")
    )
    both = urls.withColumn("label", F.substring_index("key", ".", 1)).unionByName(events)
    sweep = Window.partitionBy("label", "split").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    best = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    return found.withColumn("best", best).select(
        *(F.col("row").getField(c).alias(c) for c in kept), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )


#: The production query's result by plain conditions, in DuckDB's SQL.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, rest FROM p
), r AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM q
), s AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM r
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM s
"""

"""Running positions and budgets inside episodes, conversations and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.arrays import let, running


def _before(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def budget_flags(events: DataFrame, episode: list[str], tool: str, order: list[str], total: int, per_tool: int) -> DataFrame:
    """Calls before each call in all and of its tool, and ``budget_violation``: the call still runs, it is only marked."""
    so_far = F.count("*").over(_before(episode, order))
    own = F.count("*").over(_before([*episode, tool], order))
    df = events.withColumn("calls_before", so_far).withColumn("tool_calls_before", own)
    return df.withColumn("budget_violation", (F.col("calls_before") >= total) | (F.col("tool_calls_before") >= per_tool))


def trim_to_target(rows: DataFrame, by: list[str], order: list[str], amount: str, target: Column) -> DataFrame:
    """Rows until their running amount reaches ``target``; the last one is cut to what is left."""
    before = F.coalesce(F.sum(amount).over(_before(by, order)), F.lit(0))
    df = rows.withColumn("before", before).withColumn("target", target).where("before < target")
    return df.withColumn("taken", F.least(F.col(amount), F.col("target") - F.col("before"))).drop("target")


def char_spans(messages: DataFrame, by: list[str], order: list[str], block: Column, gap: int = 1) -> DataFrame:
    """``span_start`` and ``span_end`` of each message's block in the rendered text; blocks are ``gap`` characters apart."""
    df = messages.withColumn("__n", F.length(block))
    start = F.coalesce(F.sum(F.col("__n") + gap).over(_before(by, order)), F.lit(0))
    return df.withColumn("span_start", start.cast("long")).withColumn("span_end", (F.col("span_start") + F.col("__n")).cast("long")).drop("__n")


def render_block(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce(content, F.lit("")))


def render(messages: DataFrame, by: list[str], order: str, block: Column, gap: str = "\n") -> DataFrame:
    """One text per conversation."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), block.alias("block"))))
    return messages.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["block"]), gap).alias("rendered"), F.count("*").cast("long").alias("messages"))


def simplified_call(call: Column) -> Column:
    """A tool call as text: name and arguments."""
    return F.to_json(F.struct(call["function"]["name"].alias("name"), call["function"]["arguments"].alias("arguments")))


def overlaps(start: Column, end: Column, spans: Column) -> Column:
    """A token that isn't empty shares a character with a span (fields ``start`` and ``end``)."""
    return (end > start) & F.exists(spans, lambda s: (start < s["end"]) & (end > s["start"]))


def label_mask(offsets: Column, ids: Column, spans: Column, ignore: int = -100) -> Column:
    """Token ids where the token overlaps a span, ``ignore`` elsewhere."""
    return F.zip_with(offsets, ids, lambda o, i: F.when(overlaps(o["start"], o["end"], spans), i).otherwise(F.lit(ignore)))


def word_offsets(text: Column) -> Column:
    """Tokens split at blanks with their offsets, for use without a tokenizer."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    pairs = let(words, lambda w: F.arrays_zip(F.slice(F.split(text, r"\S+", -1), F.lit(1), F.size(w)).alias("gap"), w.alias("word")))

    def place(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["word"])).alias("end"), x["word"].alias("word"))

    def placed(xs: Column) -> Column:
        sizes = F.transform(xs, lambda x: F.length(x["gap"]) + F.length(x["word"]))
        return F.zip_with(xs, let(sizes, lambda n: running(n, lambda a, b: a + b)), place)

    return let(pairs, placed)


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of intervals (``id``, ``start``, ``end``; whole numbers) of a key that overlap, each once.

    Both are cut into buckets of ``width``; a pair is kept in the bucket where the later one starts, so it isn't met twice and
    a long interval isn't compared with all others of its key."""
    cut = lambda df: df.where("end > start").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    x, y = cut(a).alias("x"), cut(b).alias("y")
    meets = (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
    home = F.floor(F.greatest("x.start", "y.start") / width) == F.col("x.bucket")
    return x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.bucket") == F.col("y.bucket")) & meets & home).select(
        F.col(f"x.{key}"), F.col("x.id").alias("left_id"), F.col("y.id").alias("right_id"), F.greatest("x.start", "y.start").alias("start"), F.least("x.end", "y.end").alias("end")
    )


def level_cross(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Every row once per level: an explode of a fixed list, not a join."""
    return rows.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels))))


def rollouts(envs: DataFrame, k: int) -> DataFrame:
    """Every environment once per rollout index."""
    return envs.withColumn("rollout_index", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("rollout_id", F.concat_ws("_", "env_id", F.format_string("r%03d", "rollout_index")))

"""Structured Streaming forms of the batch operators: upsert of checkpoints, running summaries, budgets, resuming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gradeloom.operators.upserts import latest


BUCKETS = 64
BUCKET = "__bucket"


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def bucket_versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[int]]:
    """Versions of each bucket of an upserted table, ascending, of those below a number; unfinished ones don't count. At most BUCKETS x versions kept."""
    root, fs = _files(spark, path)
    found: dict[int, list[int]] = {}
    if fs.exists(root):
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("v=") and (below is None or int(name[2:]) < below) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                for t in fs.listStatus(s.getPath()):
                    part = t.getPath().getName()
                    if part.startswith(f"{BUCKET}="):
                        found.setdefault(int(part.split("=")[1]), []).append(int(name[2:]))
    return {b: sorted(v) for b, v in found.items()}


def version(spark: SparkSession, path: str, below: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """An upserted table: the last version of each bucket (of some buckets, or of versions below a number)."""
    last = {b: v[-1] for b, v in bucket_versions(spark, path, below).items() if buckets is None or b in buckets}
    return spark.read.parquet(*(f"{path}/v={v}/{BUCKET}={b}" for b, v in sorted(last.items()))) if last else None


def compact(spark: SparkSession, path: str, n: int) -> int:
    """Delete versions of buckets that version ``n`` and the one before it both supersede; returns how many went."""
    _, fs = _files(spark, path)
    gone = 0
    for b, numbers in bucket_versions(spark, path, n + 1).items():
        older = [v for v in numbers if v < n]
        for v in older[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/{BUCKET}={b}"), True)
            gone += 1
    return gone


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Latest row of each key in a table of ``buckets`` by the keys' hash. A micro-batch rewrites the buckets that its rows touch, as its version, and leaves the others
    where they are, so what is written grows with the batch; what two versions supersede is deleted.

    A batch that is run again reads the versions below its own and writes the same version again, so restarts don't repeat rows."""

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        own = latest(batch, keys, order)
        touched = [r["b"] for r in batch.select(place.alias("b")).distinct().collect()]  # at most as many as there are buckets
        before = version(spark, path, n, touched)
        rows = own if before is None else latest(before.unionByName(own), keys, order)
        rows.withColumn(BUCKET, place).repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/v={n}")
        compact(spark, path, n)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows of an append-mode stream as Parquet; a batch that is run again writes its own folder again."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def whole_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The last whole result of a complete-mode stream, which is small, at ``path``."""

    def put(batch: DataFrame, n: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_summary(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count and mean per key, for complete mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def once(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key's first row; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, key: str, length: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per key and window, final when the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class Budget(StatefulProcessor):
    """Marks calls beyond an episode's budget. State: calls of each tool of the episode, which goes when the watermark is ``idle_ms`` past its last call."""

    def __init__(self, names: tuple[str, str, str], total: int, each: int, idle_ms: int):
        self.names, self.total, self.each, self.idle_ms = names, total, each, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "tool string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {k[0]: v[0] for k, v in self.calls.iterator()}
        pdf = pd.concat(list(rows)).sort_values("position")
        flags = []
        for t in pdf["tool"]:
            flags.append(sum(seen.values()) >= self.total or seen.get(t, 0) >= self.each)
            seen[t] = seen.get(t, 0) + 1
        for t, n in seen.items():
            self.calls.updateValue((t,), (n,))
        end = int(pdf["millis"].max()) + self.idle_ms
        timers = list(self.handle.listTimers())
        if not timers or end > max(timers):
            for old in timers:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(end)
        yield pd.DataFrame(dict(zip([*self.names, "budget_violation"], [key[0], pdf["position"], pdf["tool"], flags])))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.calls.clear()
        return iter([])

    def close(self) -> None:
        pass


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def budget_stream(stream: DataFrame, episode: str, tool: str, position: str, total: int, each: int, time: str, delay: str = "1 hour", idle_ms: int = 86_400_000) -> DataFrame:
    """Tool calls marked when they exceed their episode's budget; calls of a batch are taken by position.

    Counters per episode are state with a timer in event time: an episode whose last call is ``idle_ms`` behind the watermark is forgotten. Calls that are late by more than ``delay`` are dropped, as by
    any watermark. The state is held in RocksDB, which is set for the session if it isn't."""
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(STORE):
        spark.conf.set(STORE, ROCKS)
    kind, place = (stream.schema[c].dataType.simpleString() for c in (episode, position))
    out = f"`{episode}` {kind}, `{position}` {place}, `{tool}` string, budget_violation boolean"
    rows = stream.select(F.col(episode).alias("episode"), F.col(position).alias("position"), F.col(tool).cast("string").alias("tool"), F.col(time).cast("timestamp").alias("at"))
    rows = rows.withWatermark("at", delay).withColumn("millis", F.unix_millis("at"))
    return rows.groupBy("episode").transformWithStateInPandas(Budget((episode, position, tool), total, each, idle_ms), out, "append", "eventTime")


def run_available(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """All that is there now, as a table in memory (for tests and small results)."""
    w = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()
    return stream.sparkSession.table(name)

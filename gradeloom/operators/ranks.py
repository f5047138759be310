"""Places of rows in the order of their group, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.sources.shared import written


def placed(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their number from 1 in the order of their group. Ties of all order columns are numbered in some order.

    Rows are dealt by ranges of group and order, so a group of a third of all rows is spread like any other; a row's number is its place in its part and the rows of its group in the parts before.
    The sorted parts are written first, so that numbers hold if a task runs again. The window is over counts, one for each group and part."""
    spark = rows.sparkSession
    at = F.monotonically_increasing_id()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    held = written(sorted_.withColumns({"__at": at, "__part": F.shiftright(at, 33)}), "placed")
    key = F.struct(*group) if group else F.lit(0)
    held = held.withColumn("__group", F.xxhash64(F.to_json(key)) if group else key)
    runs = held.groupBy(*group, "__group", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group, "__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = runs.select("__group", "__part", *(F.col(c).alias(f"__own_{c}") for c in group), (before - F.col("__first")).alias("__shift"))
    same = (held["__group"] == shift["__group"]) & (held["__part"] == shift["__part"])
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__own_{c}"))
    joined = held.join(shift, same)
    return joined.select(*rows.columns, (F.col("__at") + F.col("__shift") + 1).alias(name))

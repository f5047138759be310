"""Running sums and maxima over arrays in time about linear in their length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that one step of ``running`` goes through.
RUN = 64


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, not once for each use or each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(numbers: Column, join) -> Column:
    """For each number of an array ``join`` over those before it, from 0 on.

    Arrays only grow inside blocks of RUN, over three levels, so that the time is linear up to RUN**3 numbers and nearly so beyond."""

    def inside(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(block, start, lambda acc, x: F.struct(join(acc["all"], x).alias("all"), F.concat(acc["before"], F.array(acc["all"])).alias("before")))

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda k: inside(F.slice(x, k * RUN + 1, RUN)))

    def after(blocks: Column, starts: Column) -> Column:
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["before"], lambda x: join(s, x))))

    deep = let(cut(numbers), lambda one: let(cut(one["all"]), lambda two: after(one, after(two, inside(two["all"])["before"]))))
    return F.when(F.size(numbers) > RUN, deep).when(F.size(numbers) > 0, inside(numbers)["before"]).otherwise(F.array().cast("array<int>"))

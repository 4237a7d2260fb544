"""Running values along arrays of any length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.rx import let


def running(values: Column, combine=lambda a, b: a + b, start: int = 0) -> Column:
    """Running sums of an array of numbers, or what else combines them (``start`` being its neutral number), by doubling:
    the array is passed over as often as its length has bits."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def step(sums: Column, j: Column) -> Column:
        n = F.least(F.pow(F.lit(2), j).cast("int"), F.size(sums))
        moved = F.concat(F.array_repeat(F.lit(start).cast("long"), n), F.slice(sums, 1, F.size(sums) - n))
        return F.zip_with(sums, moved, combine)

    return F.aggregate(steps, F.transform(values, lambda x: x.cast("long")), step)


def depths(steps: Column) -> Column:
    """(before, stray, after) at each of an array of steps up (1), down (-1) and neither (0): how many are open before and
    after it, where a step down with none open is stray and counts for nothing."""

    def walked(sums: Column) -> Column:
        # what stray steps have taken too much is the lowest point so far
        lowest = running(F.transform(sums, lambda s: F.least(s, F.lit(0))), lambda a, b: F.least(a, b), 0)

        def made(low: Column) -> Column:
            def at(s: Column, i: Column) -> Column:
                earlier = F.coalesce(F.get(low, i - 1), F.lit(0))
                before = F.coalesce(F.get(sums, i - 1), F.lit(0)) - earlier
                return F.struct(before.alias("before"), (s < earlier).alias("stray"), (s - F.get(low, i)).alias("after"))

            return F.transform(sums, at)

        return let(lowest, made)

    return let(running(steps), walked)

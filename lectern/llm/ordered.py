"""Rows in an order, where one key may hold most of a table.

A window over a key gathers all its rows in one task. Here rows are dealt to
ranges of (key, order) instead and written; a key's rows fill as many ranges as
they need. What runs along a key is worked out inside each range, and what the
ranges before it add comes from a table of at most two rows a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.storage import written


def in_order(rows: DataFrame, *order: Column | str, name: str, then: tuple[Callable, str] | None = None) -> DataFrame:
    """rows, written, with ``at``: a number that rises with the order. ``range_of(at)`` is the range of a row.

    then: a function over a range's batches in order, for mapInArrow, and the columns that it adds.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    if then is not None:
        schema = T.StructType([*ranged.schema.fields, *T.StructType.fromDDL(then[1]).fields])
        ranged = ranged.mapInArrow(then[0], schema)
    return written(ranged, name)


def range_of(at: Column) -> Column:
    """The range that in_order dealt a row to."""
    return F.shiftright(at, 33)


def running(rows: DataFrame, key: str, sums: dict[str, Column] | None = None, xors: dict[str, Column] | None = None) -> DataFrame:
    """rows of in_order (by ``key`` and more) with a long for each of ``sums`` and ``xors``: the sum, or XOR, of the column
    over all rows of the same key up to this one; and ``final``, true for the last row of a key.

    Only keys whose rows lie in several ranges need what came before. A range begins with one key and ends with one, so
    the table of those has at most two rows a range, whatever the data, and is broadcast.
    """
    made = [(n, c, F.sum) for n, c in (sums or {}).items()] + [(n, c, F.bit_xor) for n, c in (xors or {}).items()]
    placed = rows.withColumn("_range", range_of(F.col("at")))
    piece = Window.partitionBy(key, "_range").orderBy("at")
    upto = piece.rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumns({n: f(c).over(upto) for n, c, f in made} | {"final": F.lead("at").over(piece).isNull()})
    edges = placed.groupBy("_range").agg(F.min_by(key, "at").alias("_a"), F.max_by(key, "at").alias("_b"))
    crossing = (
        edges.select(F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_key"), "_range")
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
    )
    split = placed.join(F.broadcast(crossing), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    totals = split.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(*[f(c).alias(n) for n, c, f in made])
    along = Window.partitionBy("_key").orderBy("_at")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_key", "_at", *[f(n).over(before).alias(f"_{n}") for n, _, f in made], F.lead("_at").over(along).isNotNull().alias("_more")
    )
    joined = inside.join(
        F.broadcast(carried), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")), "left"
    )
    earlier = lambda n: F.coalesce(F.col(f"_{n}"), F.lit(0).cast("long"))
    return joined.select(
        *rows.columns,
        *[F.col(n).bitwiseXOR(earlier(n)).alias(n) if f is F.bit_xor else (F.col(n) + earlier(n)).alias(n) for n, _, f in made],
        (F.col("final") & ~F.coalesce(F.col("_more"), F.lit(False))).alias("final"),
    )

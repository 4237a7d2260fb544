"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys are dealt to
equal ranges (buckets, as many as the source's row count asks for), sorted
inside each range, and word counts are summed up from range to range: a
distributed prefix sum. The document where the sum reaches the source's budget
is the cut; a budget over one epoch repeats the source.

Nothing but (doc_id, source, size) is shuffled. A hot source has more ranges,
not larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import quoted, unused, words
from lectern.storage import written

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def _key(seed: int) -> Column:
    """The hash-random key in [0, 1) of a row: of its doc_id, or of its text where that is null."""
    of = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), of), 11) / F.lit(float(1 << 53))


def sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size (words; 0 for null or empty text) and the hash-random key in [0, 1)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        _key(seed).alias("key"),
    )


def source_targets(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """One row a source: source, source_size, n_rows, target (double).

    The targets share ``share`` times all words by weight; none exceeds ``cap``
    times its source's size, and what is cut off goes to the others by weight.
    That is a common level x with target = min(cap * size, x * weight); only
    sums travel to the driver while x is found. share may not exceed cap.
    """
    if share > cap:
        raise ValueError("share may not exceed cap: the targets could not be met")
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")
    )
    # the rank of a source, without one task that sees all of them
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
    schema = T.StructType([*totals.schema.fields, T.StructField("weight", T.DoubleType())])
    dealt = ranked.map(lambda x: (*x[0], float(weights[x[1] % len(weights)])))
    sources = written(spark.createDataFrame(dealt, schema), "mix-sources")
    full = F.col("source_size") * F.lit(cap)
    level, closed = 0.0, -1
    while True:
        over = full < F.col("weight") * F.lit(level)
        x = sources.agg(
            F.sum("source_size").alias("all"),
            F.count_if(over).alias("closed"),
            F.sum(F.when(over, full).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if x["all"] is None or x["closed"] == closed or not x["weight"]:
            break
        closed = x["closed"]
        level = (share * x["all"] - x["taken"]) / x["weight"]
    return sources.select(
        "source", "source_size", "n_rows", F.least(full, F.col("weight") * F.lit(level)).alias("target")
    )


def _taken(before: Column) -> Column:
    """Words of a document that the mix takes: whole epochs, then what the budget leaves at its place."""
    size, total = F.col("size"), F.col("source_size")
    budget = F.floor(F.col("target"))
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(F.lit(0))
    rest = budget - epochs * total
    return (epochs * size + F.greatest(F.lit(0), F.least(size, rest - before))).cast("long")


def mix(docs: DataFrame, *, rows_per_range: int = 20_000, seed: int = 7, **targets) -> DataFrame:
    """The mix of all documents: doc_id, source, key, size, source_size, target, taken.

    taken counts the words the mix uses of the document: its size for every
    whole epoch, and in the last one as much as the source's budget reaches, so
    that only the document at the cut is split. Null text has size 0 and takes
    0; a null source is a source of its own, the last; repeated rows count as
    often as they appear; an empty table gives no rows. Reruns give the same
    mix, whatever the partitioning. Other columns are ignored.
    """
    sized = written(sizes(docs, seed), "mix-sizes")
    sources = written(source_targets(sized, **targets), "mix-targets")
    n = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / F.lit(rows_per_range)))
    placed = (
        sized.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "d.source", "key", "size", "source_size", "target", F.floor(F.col("key") * n).alias("range"))
    )
    across = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ranges = ranges.select(
        "source", "range", F.coalesce(F.sum("words").over(across), F.lit(0)).alias("earlier")
    )
    inside = (
        Window.partitionBy("source", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (
        summed.alias("d")
        .join(
            ranges.alias("r"),
            F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range")),
        )
        .withColumn("taken", _taken(F.col("before") + F.col("earlier")))
        .select("doc_id", "d.source", "key", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix takes them, with the columns of docs: a row for each copy.

    Documents stay whole: one is in the last epoch if at least half of its words
    are within the budget. What is taken of a source is everything up to one
    key, so the texts themselves need no shuffle: each row is compared with its
    source's cut.
    """
    seed = options.get("seed", 7)
    size, total = F.col("size"), F.col("source_size")
    epochs = F.when(total > 0, F.floor(F.col("target") / total)).otherwise(F.lit(0))
    extra = (F.col("taken") - epochs * size) * 2 >= F.greatest(size, F.lit(1))
    of, epoch_count, cut, copy = unused(docs, "_mix_source", "_mix_epochs", "_mix_cut", "_mix_copy")
    cuts = written(
        mix(docs, **options)
        .groupBy("source")
        .agg(F.max(epochs), F.max(F.when(extra, F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))))))
        .toDF(of, epoch_count, cut),
        "mix-cuts",
    )
    key = F.struct(
        _key(seed),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
    )
    rows = docs.join(cuts, F.col("source").cast("string").eqNullSafe(F.col(of)))
    copies = F.col(epoch_count) + F.when(F.coalesce(key <= F.col(cut), F.lit(False)), 1).otherwise(0)
    none = F.array().cast("array<int>")
    each = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(none))
    return rows.withColumn(copy, each).select(*map(quoted, docs.columns))

"""Line dedup by winnowing over line hashes.

A repeated run is a run of lines, of at least ``least_words`` words, that also
stands earlier: in a document with a smaller doc_id, or higher up in the same
one. Every run is made of minimal runs, one for each line it can start at. Each
minimal run is a window over line hashes, and its least hash is selected: a
guaranteed fingerprint, since a run that is repeated anywhere has the same
windows and the same minima there.

What is shuffled after that are the selected positions. Each carries its reach:
the windows that selected it, from the first line of the first to the last line
of the last. Positions with the same hash are joined. Where the whole reach is
that of an earlier position, all of it is a match, which is how the copies of a
passage are found, counted before they are shuffled. Positions that are the
first with their reach compare the windows in it one by one with those of the
others, from the earliest that holds the position to the latest, so that a match
is extended both ways as far as lines agree. Matches that touch are one, and the lines of later ones
are deleted.

Lines are compared by 128 bits of hash. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import let, quoted, unused, words
from lectern.storage import written

LEAST_WORDS = 50


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _hash(value: Column) -> Column:
    """128 bits as two numbers."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(1), value).alias("b"))


def positions(docs: DataFrame, least_words: int) -> DataFrame:
    """doc, t, pos, h, windows, reach: the lines that some minimal run of least_words words or more selects.

    doc and t (a hash of the text) name the document, pos is the line and h its
    hash. windows are the minimal runs that selected it, in order: their first
    and last line and a hash of their lines; reach is a hash of those hashes.
    Lines without words are passed over.
    """
    # repeated rows are one document
    texts = docs.select(_id().alias("doc"), F.xxhash64(_text()).alias("t"), _text().alias("text"))
    lines = texts.select("doc", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc", "t", "pos", _hash(F.col("line")).alias("h"), F.size(words(F.col("line"))).cast("long").alias("n")
    )
    one = (
        lines.where(F.col("n") > 0)
        .groupBy("doc", "t", "pos")
        .agg(F.first("h").alias("h"), F.first("n").alias("n"))
        .repartition("doc", "t")
    )
    document = Window.partitionBy("doc", "t")
    summed = one.withColumn(
        "before", F.coalesce(F.sum("n").over(document.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    # before rises strictly: the frame holds the lines that begin less than least_words words after this one
    ahead = document.orderBy("before").rangeBetween(0, least_words - 1)
    windows = summed.select(
        "doc",
        "t",
        "pos",
        F.max("pos").over(ahead).alias("last"),
        F.collect_list("h").over(ahead).alias("hs"),
        F.min(F.struct("h", "pos")).over(ahead).alias("least"),
        F.sum("n").over(ahead).alias("words"),
    ).where(F.col("words") >= least_words)
    each = F.struct(F.col("pos").alias("first"), "last", _hash(F.col("hs")).alias("run"))
    return (
        windows.groupBy("doc", "t", F.col("least.pos").alias("at"))
        .agg(F.first("least.h").alias("h"), F.sort_array(F.collect_list(each)).alias("windows"))
        .select(
            "doc", "t", F.col("at").alias("pos"), "h", "windows",
            _hash(F.transform("windows", lambda w: w["run"])).alias("reach"),
        )
    )


def repeated_ranges(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc, t, ranges: the later repeated runs of each document that has any, merged, as (first, last) line numbers."""
    found = written(positions(docs, least_words), "line-positions")
    place = F.struct("doc", "t", "pos")
    marks = found.groupBy(F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_h")
    joined = written(found.join(marks, F.col("h") == F.col("_h"), "left_semi"), "line-joined")
    # the first position of each reach; all others repeat all of it
    firsts = joined.groupBy("h", "reach").agg(F.min(place).alias("first"))
    marked = joined.join(firsts, ["h", "reach"])
    whole = marked.where(place != F.col("first")).select(
        "doc", "t", F.col("windows")[0]["first"].alias("first"), F.element_at("windows", -1)["last"].alias("last")
    )
    # the first ones extend window by window
    opened = marked.where(place == F.col("first")).select("doc", "t", "pos", "h", F.explode("windows").alias("w"))
    aligned = opened.select("doc", "t", "pos", "h", F.col("w.run").alias("run"), "w")
    key = ["h", "run"]
    earliest = aligned.groupBy(*key).agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    parts = aligned.join(earliest, key).where(place != F.col("least")).select("doc", "t", "w.first", "w.last")
    later = whole.unionByName(parts)
    document = Window.partitionBy("doc", "t").orderBy("first", "last")
    reached = F.max("last").over(document.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(reached + 1, F.lit(-1)) < F.col("first"), 1).otherwise(0)
    run = later.select("doc", "t", "first", "last", begins.alias("begins")).withColumn(
        "part", F.sum("begins").over(document.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = run.groupBy("doc", "t", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("doc", "t").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, deleted: str = "_deleted") -> DataFrame:
    """The rows of docs with later repeated runs cut out of ``text``, and ``deleted``: their (first, last) line numbers.

    Lines are parted by \\n and equal if all their characters are. Line numbers
    count from 0. Lines without words neither count nor part a run, and go with
    a run that they lie in. Null text stays null, a text that loses all lines
    becomes empty. A null doc_id comes before all others; documents with the
    same doc_id are ordered by their texts' hashes; rows that repeat both are
    one document and are cut alike. Texts are looked at whole, however long.
    Other columns stay as they are, whatever their names, but for one named like
    ``deleted``, which is replaced. An empty table stays empty.
    """
    doc, t, found = unused(docs, "_line_doc", "_line_t", "_line_ranges")
    ranges = repeated_ranges(docs, least_words).toDF(doc, t, found)
    lines = F.split(F.col("text").cast("string"), "\n")
    r, n = F.col(found), F.size(lines)
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(r)),
            lambda i: let(
                F.coalesce(F.get(r, i - 1)["last"] + 1, F.lit(0)),
                lambda a: F.slice(lines, a + 1, F.coalesce(F.get(r, i)["first"], n) - a),
            ),
        )
    )
    rest = F.when(r.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    joined = docs.join(ranges.hint("shuffle_hash"), (_id() == F.col(doc)) & (F.xxhash64(_text()) == F.col(t)), "left")
    none = F.array().cast("array<struct<first:int,last:int>>")
    return joined.select(
        *[rest.alias("text") if c == "text" else F.col(quoted(c)) for c in docs.columns if c != deleted],
        F.coalesce(r, none).alias(deleted),
    )

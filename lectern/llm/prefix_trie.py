"""A trie of conversations over their turns, by smallest-member ownership.

A node is a distinct sequence of first turns, named by 128 bits: the XOR of two
64-bit hashes of (place, turn) over its turns, which runs along a conversation
like a sum. A node belongs to its smallest member. A member of a node is a
member of all nodes above, so what a conversation owns is a suffix of its path:
three numbers a conversation say all about it (where the suffix begins, the
tokens above it, who owns the node above). One group-by over the occurrences
then gives every node its subtree's sums: tokens of occurrences less tokens of
owned nodes, leaves and children by the member that owns them.

Texts are hashed where they are read and never shuffled. Owners are found by an
aggregate that is joined back, not by a window over a node's occurrences: a
third of all conversations may share their first turn, and all share the root.
Such joins are of a written table with one row a key, so that Spark may split
the other side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.ordered import in_order, running
from lectern.storage import written

#: Most characters of conversation ids that are handed on in one row.
PIECE = 1 << 16
NODE = ("x1", "x2", "depth")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest, size (UTF-8 bytes of the text) of every turn, in the order of turn, null first.

    Null roles and texts are empty. Turns of one conversation with the same number are ordered by role, then by the
    digest. Rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of their own.
    Other columns are ignored.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    ordered = in_order(keyed, "conv_id", F.col("turn").asc_nulls_first(), "role", "digest", name="trie-turns")
    return running(ordered, "conv_id", sums={"depth": F.lit(1)}).select("conv_id", "depth", "digest", "size")


def rebuilt(originals: DataFrame, group: int, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: conv_id of all, and their turns (as ``turns`` gives them).

    A conversation c takes the first ``heads`` (a column over conv_id, at most ``most``) turns of conversation
    c - c % group, and then its own turns after its first ``heads``.
    """
    own = written(originals, "trie-originals")
    first = own.where(F.col("depth") <= most).select(F.col("conv_id").alias("_of"), "depth", "digest", "size")
    convs = own.where(F.col("depth") == 1).select("conv_id", heads.cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("_of"))
    there = first.groupBy("_of").agg(F.max("depth").alias("_n"))
    convs = written(convs.join(there, "_of", "left").withColumn("m", F.least("h", F.coalesce("_n", F.lit(0)))).drop("_n"), "trie-heads")
    taken = convs.join(first, "_of").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "digest", "size")
    kept = own.where(F.col("depth") > heads).join(convs.select("conv_id", (F.col("m") - F.col("h")).alias("_by")), "conv_id")
    kept = kept.select("conv_id", (F.col("depth") + F.col("_by")).alias("depth"), "digest", "size")
    return convs.select("conv_id"), taken.unionByName(kept)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x1, x2, depth, conv_id) to comma-joined ids of one node, PIECE characters or so a row."""
    node, ids, length = None, [], 0
    for b in batches:
        out = []
        for x1, x2, depth, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (x1, x2, depth) != node or length >= PIECE:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids, length = (x1, x2, depth), [], 0
            ids.append(c)
            length += 20
        if out:
            yield _rows(out, ENDS)
    if ids:
        yield _rows([(*node, ids[0], ",".join(map(str, ids)))], ENDS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of ids in order to one digest a node; only the hash's state is kept from piece to piece."""
    node, state = None, None
    for b in batches:
        out = []
        for x1, x2, depth, _, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (x1, x2, depth) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (x1, x2, depth), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield _rows(out, DIGESTS)
    if node is not None:
        yield _rows([(*node, state.hexdigest())], DIGESTS)


_KEY = [("x1", pa.int64()), ("x2", pa.int64()), ("depth", pa.int64())]
ENDS = pa.schema([*_KEY, ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([*_KEY, ("ends_sha256", pa.string())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _ends(occurrences: DataFrame) -> DataFrame:
    """Node and digest of the ids of the conversations that end there, in ascending order.

    Ids are joined to pieces in ranges of (node, id), so that a node's pieces, not its ids, meet where it is hashed.
    """
    ends = occurrences.where("final").select(*NODE, "conv_id")
    order = [*NODE, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "x1 long, x2 long, depth long, first long, ids string")
    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(_digests, "x1 long, x2 long, depth long, ends_sha256 string")


def prefix_trie(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """A row for every node of the trie of ``steps`` (conv_id, depth from 1 without gaps, digest, size), whose
    conversations are all of ``convs`` (conv_id, each once), also those without turns.

    x1, x2 (the node's name), conv_id (its smallest member), depth (0: the root), parent_conv_id (its parent's smallest
    member; root: null), n_convs (members), n_children, n_leaves (childless nodes in its subtree, itself included),
    saved_tokens (summed over the subtree: sizes of a node's last turn times its members but one), ends_sha256 (of the
    ids of members that end here, ascending, comma-joined). Without conversations there are no nodes. Conversations with
    equal turns are members of the same nodes and end at the same one; a conversation of any length is spread over
    ranges of its turns.
    """
    ordered = in_order(steps, "conv_id", "depth", name="trie-steps")
    x1, x2 = F.xxhash64("depth", "digest"), F.xxhash64(F.lit(1), "digest", "depth")
    below = running(ordered, "conv_id", sums={"upto": F.col("size")}, xors={"x1": x1, "x2": x2})
    first = steps.where(F.col("depth") == 1).select("conv_id", F.lit(False).alias("final"))
    nothing = F.lit(0).cast("long")
    roots = convs.join(first, "conv_id", "left").select(
        "conv_id", *[nothing.alias(c) for c in ("x1", "x2", "depth", "size", "upto")], F.coalesce("final", F.lit(True)).alias("final")
    )
    columns = ["conv_id", *NODE, "size", "upto", "final"]
    seen = written(roots.select(columns).unionByName(below.select(columns)), "trie-occurrences")
    owners = written(seen.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.bool_and("final").alias("childless")), "trie-owners")
    owned = F.col("owner") == F.col("conv_id")
    suffixes = written(
        seen.join(owners, [*NODE])
        .groupBy("conv_id")
        .agg(
            F.min(F.when(owned, F.col("depth"))).alias("begins"),
            F.coalesce(F.max(F.when(~owned, F.col("upto"))), F.lit(0)).alias("shared"),
            F.max_by("owner", F.when(~owned, F.col("depth"))).alias("above"),
            F.max((owned & F.col("final") & F.col("childless")).cast("int")).alias("leaf"),
        ),
        "trie-suffixes",
    )
    begins, depth = F.col("begins"), F.col("depth")
    nodes = (
        seen.join(suffixes, "conv_id")
        .groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.max(F.when(depth > begins, F.col("conv_id")).when(depth == begins, F.col("above"))).alias("parent_conv_id"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.when(~F.col("final") & (depth + 1 >= begins), 1).otherwise(0)).alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.greatest(F.lit(0), F.col("shared") - F.col("upto") + F.col("size"))).alias("saved_tokens"),
        )
    )
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(_ends(seen), [*NODE], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))

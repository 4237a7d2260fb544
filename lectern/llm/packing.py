"""Hierarchical multi-length packing.

A document's tokens first fill whole windows of the largest context size; the
rest is routed to the smallest tier that holds it. Each tier is packed from the
largest down: a piece opens a window of its tier, and the gap it leaves is
filled from shorter tiers, by the longest piece that fits or else by cutting
one. A window is always filled to its tier's length. Only what a partition has
left at its end is cut into shorter powers of two, so nothing is padded.

Step groups are balanced over all partitions: the longest sequences first, each
group takes the next ones until it has STEP tokens. Lengths are powers of two,
so every group but the last has exactly that many, and but for where a tier
ends, a group's sequences are of one tier.

Each partition packs its own rows as a stream, in blocks of bounded size, so
token ids never cross the network. The pieces are written, and numbered by the
counts of each partition's sequences: a table of one row a partition and tier.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import written

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group.
STEP = 16 * 2048
#: Tokens that are packed together: what a task holds, besides one document.
BLOCK = 1 << 20
END_ID = 1

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, part int, place long"
)


def tokenizer(json_path: str | None = None, ranks_path: str | None = None) -> Callable[[str], list[int]]:
    """An encoder with the vocabulary of byte_bpe_50k, without special tokens added.

    The ranks file holds the same vocabulary for a faster library with the same
    ids; the JSON file is loaded for texts that hold a special token's string.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tiktoken import registry

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = registry.ENCODINGS  # lives as long as the Python worker
    name = f"ranks:{ranks_path}"
    if name not in known:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        known[name] = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    plain = known[name]
    full = []

    def encode(text: str) -> list[int]:
        if "<|endoftext|>" not in text:
            return plain.encode_ordinary(text)
        if not full:
            from tokenizers import Tokenizer

            full.append(Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json")))
        return full[0].encode(text, add_special_tokens=False).ids

    return encode


class _Piece:
    """Consecutive tokens of one document."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(
            self.doc, self.start + n, self.ids[n:], self.total
        )


def _length(p: _Piece) -> int:
    return len(p.ids)


def _fill(window: list[_Piece], gap: int, shorter: list[_Piece]) -> int:
    """Move pieces from shorter (by length) into window until gap is filled or none is left; the gap that remains."""
    while gap and shorter:
        at = bisect_right(shorter, gap, key=_length)
        if at:
            piece = shorter.pop(at - 1)
        else:
            piece, rest = shorter.pop(0).cut(gap)
            insort(shorter, rest, key=_length)
        window.append(piece)
        gap -= len(piece.ids)
    return gap


def _powers(window: list[_Piece]) -> Iterator[list[_Piece]]:
    """A window of any length as windows of powers of two."""
    left = sum(map(_length, window))
    stack = window[::-1]
    while left:
        n = 1 << (left.bit_length() - 1)
        out, gap = [], n
        while gap:
            p = stack.pop()
            if len(p.ids) > gap:
                p, rest = p.cut(gap)
                stack.append(rest)
            out.append(p)
            gap -= len(p.ids)
        left -= n
        yield out


def pack_stream(docs: Iterator[tuple[object, np.ndarray]], tiers: tuple[int, ...] = TIERS) -> Iterator[list[_Piece]]:
    """Windows (lists of pieces) whose lengths are powers of two, for a stream of (doc_id, token ids).

    Every id of every document lies in exactly one piece. tiers: ascending powers of two.
    """
    largest, smallest = tiers[-1], tiers[0]
    pool: list[_Piece] = []
    window: list[_Piece] = []  # of the smallest tier, carried from block to block

    def packed() -> Iterator[list[_Piece]]:
        nonlocal pool, window
        pool.sort(key=_length)
        for tier in reversed(tiers[1:]):
            at = bisect_right(pool, tier // 2, key=_length)
            mine, pool = pool[at:], pool[:at]
            while mine:
                opened = [mine.pop()]
                gap = _fill(opened, tier - len(opened[0].ids), pool)
                if not gap:
                    yield opened
                    continue
                # nothing shorter is left: half a window now, the rest to the tiers below
                head, rest = _split(opened, tier // 2)
                yield head
                for p in rest:
                    insort(mine if len(p.ids) > tier // 2 else pool, p, key=_length)
        gap = smallest - sum(map(_length, window))
        while pool:
            gap = _fill(window, gap, pool)
            if gap:
                break
            yield window
            window, gap = [], smallest

    held = 0
    for doc, ids in docs:
        total = len(ids)
        whole = total - total % largest
        for a in range(0, whole, largest):
            yield [_Piece(doc, a, ids[a : a + largest], total)]
        if total > whole:
            pool.append(_Piece(doc, whole, ids[whole:], total))
            held += total - whole
        if held >= BLOCK:
            yield from packed()
            held = 0
    yield from packed()
    yield from _powers(window)


def _split(window: list[_Piece], n: int) -> tuple[list[_Piece], list[_Piece]]:
    """The first n tokens of a window, and the rest."""
    head, rest = [], []
    for p in window:
        if n >= len(p.ids):
            head.append(p)
            n -= len(p.ids)
        elif n:
            a, b = p.cut(n)
            head.append(a)
            rest.append(b)
            n = 0
        else:
            rest.append(p)
    return head, rest


def pack(
    docs: DataFrame,
    *,
    json_path: str | None = None,
    ranks_path: str | None = None,
    end_id: int = END_ID,
    tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """All documents as pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group.

    A document is its token ids and then end_id; null text counts as empty, and
    so is a single end_id. Rows with a null doc_id are packed too. Repeated rows
    are packed as often as they appear. An empty table gives no rows. tier is the
    sequence's length, a power of two; sequences shorter than the smallest tier
    hold what a partition had left. Every step group has STEP tokens, but for the
    last of all. Documents are packed as they come: ties don't matter; a text is
    encoded whole, and cut into as many sequences as it fills. Other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(json_path, ranks_path)
        partition = TaskContext.get().partitionId()

        def encoded() -> Iterator[tuple[object, np.ndarray]]:
            for b in batches:
                ids, texts = b.column("doc_id"), b.column("text")
                for i in range(b.num_rows):
                    tokens = encode(texts[i].as_py() or "")
                    tokens.append(end_id)
                    yield ids[i].as_py(), np.array(tokens, dtype="<u4")

        made: dict[int, int] = {}
        rows: list[tuple] = []
        for n, window in enumerate(pack_stream(encoded(), tiers)):
            tier = sum(map(_length, window))
            k = made[tier] = made.get(tier, -1) + 1
            at = 0
            for p in window:
                crc = zlib.crc32(p.ids.tobytes())
                rows.append((p.doc, p.start, len(p.ids), crc, p.total, (partition << 33) | n, at, tier, partition, k))
                at += len(p.ids)
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = written(named.mapInArrow(run, SCHEMA), "packed")
    counts = packed.where(F.col("offset") == 0).groupBy("part", "tier").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(F.desc("tier"), "part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "tier", F.coalesce(F.sum(F.col("n") * F.col("tier")).over(earlier), F.lit(0)).alias("before"))
    # as many rows as there are partitions and tiers
    placed = packed.join(F.broadcast(before), ["part", "tier"])
    group = F.floor((F.col("before") + F.col("place") * F.col("tier")) / STEP).cast("long")
    return placed.withColumn("step_group", group).select(*[x.split()[0] for x in SCHEMA.split(", ")[:-2]], "step_group")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int32() if x.endswith(" int") else pa.int64() for x in SCHEMA.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)

"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most 3 bits differ in at most one
bit on one of their two halves. So every distinct fingerprint emits, for each
half, all variants of it within half the radius (the half itself and its 32
one-bit neighbours: 66 rows), the rows are shuffled on the variant, and where a
half meets a variant the whole fingerprints are compared. A ball of radius 2
around the whole word would need 2,081 rows for the same links.

Inside a bucket links become a spanning forest at once, so a large group of
near copies leaves as many rows as it has members and not all its pairs.
Equal fingerprints were made one before. A bucket in which very many distinct
fingerprints share a half is dealt over several tasks, each with a slice of
them, against the whole bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import quoted, unused, words
from lectern.operators.components import connected_components
from lectern.storage import written

RADIUS = 3
#: Distinct fingerprints with the same half that one task compares with their bucket.
SLICE = 50_000


def fingerprint(text: str | None, shingle: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles (XXH64 of UTF-8, seed 42), repeats included.

    A-Z is lower-cased, words are separated by ASCII space, tab and line ends.
    Fewer words than a shingle has: the whole sequence. No words: 0.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    n = min(shingle, len(words))
    sizes = list(map(len, words))
    starts = list(accumulate((x + 1 for x in sizes), initial=0))
    h = xxhash.xxh64_intdigest
    # a word's start plus its size is where the next one starts, less one
    hashes = np.array([h(whole[a : b - 1], 42) for a, b in zip(starts, starts[n:], strict=False)], dtype="<u8")
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id (bigint), fp (bigint) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, shingle) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ, word by word. Unsigned: of a signed number numpy counts the bits of its absolute value."""
    return np.bitwise_count((a ^ b).astype(np.uint64))


def _bucket_links(members: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between members[own] and all members of one bucket."""
    label = np.arange(len(members))
    for i in np.flatnonzero(own):
        met = np.unique(label[_differ(members, members[i]) <= RADIUS])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    tied = label != np.arange(len(members))
    return members[tied], members[label[tied]]


def _bucket_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal (key, slice) in sorted rows (key, slice, fp, own)."""
    kept: list[np.ndarray] = []

    def links(key: np.ndarray, part: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[first, len(key)])
        owners = np.add.reduceat(own.astype(np.int64), first)
        us, vs = [], []
        two = first[(size == 2) & (owners > 0)]
        near = _differ(fp[two], fp[two + 1]) <= RADIUS
        us.append(fp[two][near])
        vs.append(fp[two + 1][near])
        for a, n in zip(first[(size > 2) & (owners > 0)], size[(size > 2) & (owners > 0)], strict=True):
            u, v = _bucket_links(fp[a : a + n], own[a : a + n])
            us.append(u)
            vs.append(v)
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "slice", "fp", "own")]
        if kept:
            cols = [np.concatenate([x, y]) for x, y in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = int(np.argmax(last))  # the last run may go on in the next batch
        if cut:
            yield from links(*(x[:cut] for x in cols))
        kept = [x[cut:] for x in cols]
    if kept:
        yield from links(*kept)


def links(nodes: DataFrame) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that connect all that are within RADIUS bits."""
    low = F.lit((1 << 32) - 1)
    half = F.floor(F.col("v") / 33)
    own = F.col("v") % 33 == 32
    value = F.when(half == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(low))
    flip = F.when(own, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, cast(v % 33 as int))"))
    key = (half * (1 << 32) + value.bitwiseXOR(flip)).cast("long")
    variants = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("v")).select(
        "fp", key.alias("key"), own.alias("own")
    )
    halves = nodes.select(
        F.explode(
            F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low) + (1 << 32))
        ).alias("_key")
    )
    # at most one row for SLICE fingerprints
    crowded = halves.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > SLICE)
    slices = F.coalesce(F.ceil(F.col("_n") / SLICE), F.lit(1)).cast("int")
    dealt = (
        variants.join(F.broadcast(crowded), F.col("key") == F.col("_key"), "left")
        .withColumn("_slices", slices)
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        .withColumn("own", F.col("own") & (F.pmod(F.hash("fp"), F.col("_slices")) == F.col("slice")))
    )
    return (
        dealt.select("key", "slice", "fp", "own")
        .repartition("key", "slice")
        .sortWithinPartitions("key", "slice")
        .mapInArrow(_bucket_runs, "u long, v long")
    )


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of docs.

    Rows whose fingerprints differ in at most RADIUS bits are linked;
    component_id is the least doc_id that links reach, the row's own included.
    Null and empty texts have fingerprint 0 and are linked like others. A null
    doc_id is never the least unless the group has no other. Repeated rows give
    repeated results; an empty table gives none. Other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle), "simhash")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    groups = connected_components(links(nodes.select("fp")))
    classes = _classes(nodes, groups, "fp")
    return fps.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


#: Texts of this many different shingles or more have a fingerprint besides their bitmap, which tells less of them.
LONG = 256
FINGERPRINT_BITS, BITMAP_BITS = 256, 512
#: Bits that fingerprints of similar long texts differ in at most: of similarity 0.8, 38.7 on average; this is 6 standard
#: deviations more.
MOST_APART = 6.0
#: Shingles found in COMMON or more of about SAMPLE texts, MOST_COMMON at most, are the last by which texts are found.
SAMPLE, COMMON, MOST_COMMON = 20_000, 10, 100_000
#: Texts that are found by one shingle are compared in blocks of about so many, every two of which meet in a task.
CROWD = 20_000
_FINGERPRINT = [f"f{i}" for i in range(FINGERPRINT_BITS // 64)]
_BITMAP = [f"m{i}" for i in range(BITMAP_BITS // 64)]
_SKETCH = [*_FINGERPRINT, *_BITMAP]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingle_hashes(tokens: list[bytes], shingle: int) -> np.ndarray:
    """The sorted hashes of the different word shingles. Fewer words than a shingle has: the whole sequence."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    each = np.array([h(t) for t in tokens], dtype=np.uint64)
    k = min(shingle, len(each))
    total = np.zeros(len(each) - k + 1, dtype=np.uint64)
    for i in range(k):
        total = (total + each[i : len(each) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(_mixed(total))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of FINGERPRINT_BITS: the bits set in over half of the hashes, widened to as many bits."""
    wide = np.stack([_mixed(hashes + np.uint64(i + 1)) for i in range(FINGERPRINT_BITS // 64)], axis=1)
    each = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    whole = len(each) // 255 * 255  # sums of 255 fit a byte
    counts = each[:whole].reshape(-1, 255, FINGERPRINT_BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    counts += each[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(each), bitorder="little").view("<i8")


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITMAP_BITS, each the parity of the number of hashes that fall on it. What two sets share cancels out, so that
    bitmaps differ in no more bits than the sets do in members."""
    at = (hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=BITMAP_BITS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def wide_fingerprint(text: str | None, shingle: int, similarity: float, common: np.ndarray) -> tuple[int, int, int, int, int, np.ndarray, np.ndarray]:
    """Of a text: a hash of it as it is; two hashes of its words, which name it; its SimHash of 64 bits; how many different
    shingles it has; its wide fingerprint and bitmap as 64-bit words; the shingles that it is found by.

    Of two sets with that Jaccard similarity, each holds at least that share of
    the other. So if the shingles of all texts are put in one order, two such
    texts have one in common among the first n - ceil(similarity * n) + 1 of
    each. The order is by hash, those of ``common`` (sorted) last.
    """
    import xxhash

    h = xxhash.xxh64_intdigest
    tokens = _tokens(text)
    joined = b" ".join(tokens)
    raw = h((text or "").encode("utf-8", "surrogatepass"), 42)
    first, second = h(joined, 1), h(joined, 2)
    sketch = np.zeros(len(_SKETCH), np.int64)
    found = np.empty(0, np.uint64)
    if tokens:
        found = _shingle_hashes(tokens, shingle)
        sketch[len(_FINGERPRINT) :] = _bitmap(found)
        if len(found) >= LONG:
            sketch[: len(_FINGERPRINT)] = _majority(found)
    n = len(found)
    if n and len(common):
        known = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate([found[~known], found[known]])
    if n:
        found = found[: n - math.ceil(similarity * n - 1e-9) + 1]
    signed = [x - ((x >> 63) << 64) for x in (raw, first, second)]
    return *signed, fingerprint(text, shingle), n, sketch, found.view(np.int64)


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that many texts have, sorted, MOST_COMMON at most; counted on about SAMPLE texts. What is found
    does not depend on them, they only keep buckets small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("text"):
                if tokens := _tokens(x.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(_shingle_hashes(tokens, shingle).view(np.int64))], ["h"])

    every = max(1, -(-docs.count() // SAMPLE))
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("text").cast("string").alias("text"))
    counted = some.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    rows = counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64))


def wide_fingerprints(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id and what wide_fingerprint says, for every row of docs."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))  # MOST_COMMON numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [wide_fingerprint(x, shingle, similarity, common.value) for x in b.column("text").to_pylist()]
            sketch = np.array([r[5] for r in rows], dtype=np.int64).reshape(-1, len(_SKETCH))
            found = pa.array([r[6] for r in rows], pa.list_(pa.int64()))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            columns += [pa.array(c) for c in sketch.T.copy()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *columns, found], ["doc_id", "raw", "h1", "h2", "fp", "n", *_SKETCH, "found_by"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    longs = ", ".join(f"{c} long" for c in ("doc_id", "raw", "h1", "h2", "fp", "n", *_SKETCH))
    return rows.mapInArrow(run, f"{longs}, found_by array<long>")


class _Bucket:
    """The texts of one bucket: how many shingles they have, their fingerprints and their bitmaps."""

    def __init__(self, n: np.ndarray, sketch: np.ndarray, similarity: float):
        self.n, self.fingerprint, self.bitmap = n, sketch[:, : len(_FINGERPRINT)], sketch[:, len(_FINGERPRINT) :]
        self.similarity = similarity
        cosine = 2 * similarity / (1 + similarity)
        p = float(np.arccos(cosine) / np.pi)
        self.most = FINGERPRINT_BITS * p + MOST_APART * math.sqrt(FINGERPRINT_BITS * p * (1 - p))

    def apart(self, i, others) -> np.ndarray:
        """How far others seem to be from i: the bits of the bitmaps, infinite for those that can't be similar.

        Sets of similarity s differ in (|a| + |b|) (1 - s) / (1 + s) members at most.
        """
        a, b = self.n[i], self.n[others]
        bits = _differ(self.bitmap[others], self.bitmap[i]).sum(axis=1, dtype=np.int64)
        fits = (bits <= (a + b) * ((1 - self.similarity) / (1 + self.similarity)) + 1e-6) & (
            np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-6
        )
        both = (a >= LONG) & (b >= LONG)
        if np.any(both):
            far = _differ(self.fingerprint[others], self.fingerprint[i]).sum(axis=1, dtype=np.int64)
            fits &= ~both | (far <= self.most)
        return np.where(fits, bits, np.inf)

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """The shortest links that tie all together that may be similar, directly or through others."""
        size = len(self.n)
        best, parent, left = np.full(size, np.inf), np.full(size, -1), np.ones(size, bool)
        i, every = 0, np.arange(size)
        for _ in range(size - 1):
            left[i] = False
            apart = self.apart(i, every)
            closer = left & (apart < best)
            best[closer], parent[closer] = apart[closer], i
            i = int(np.argmin(np.where(left, best, np.inf)))
            if not left[i] or np.isinf(best[i]):
                i = int(np.argmax(left))
        child = np.flatnonzero(parent >= 0)
        return child, parent[child]

    def between(self, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All that may be similar and lie in different components."""
        us, vs = [np.empty(0, int)], [np.empty(0, int)]
        for i in range(len(self.n) - 1):
            others = i + 1 + np.flatnonzero(component[i + 1 :] != component[i])
            close = others[np.isfinite(self.apart(i, others))]
            us.append(np.full(len(close), i))
            vs.append(close)
        return np.concatenate(us), np.concatenate(vs)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[np.ndarray]:
    """Sorted rows as matrices with the columns names, cut only between runs of equal first three columns."""
    kept: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
        cut = int(np.argmax((now[:, :3] == now[-1, :3]).all(axis=1)))
        if cut or (kept and (kept[-1][-1, :3] != now[0, :3]).any()):  # else the open run goes on
            yield np.concatenate([*kept, now[:cut]])
            kept = []
        kept.append(now[cut:])
    if kept:
        yield np.concatenate(kept)


def likely_links(members: DataFrame, similarity: float, apart: bool = False) -> DataFrame:
    """u, v: pairs of members (id, key, n, the words of the sketch) with one key that may be similar.

    Of each key the shortest pairs that tie all such members together. With
    apart, instead, all such pairs of members whose column ``component`` differs.
    The members of a key are dealt in blocks, of which every two meet in a task.
    """
    columns = ["key", "a", "b", "id", "n", *_SKETCH, *(["component"] if apart else [])]
    sketch_from = columns.index(_SKETCH[0])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, columns):
            first = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
            ids, n, sketch = rows[:, 3], rows[:, 4], rows[:, sketch_from : sketch_from + len(_SKETCH)]
            us, vs = [], []
            for start, size in zip(first, np.diff(np.r_[first, len(rows)]), strict=True):
                if size < 2:
                    continue
                at = slice(start, start + size)
                bucket = _Bucket(n[at], sketch[at], similarity)
                if not apart:
                    u, v = bucket.forest()
                else:
                    component = rows[at, -1]
                    if (component == component[0]).all():
                        continue
                    u, v = bucket.between(component)
                us.append(ids[at][u])
                vs.append(ids[at][v])
            if sum(map(len, us)):
                u, v = np.concatenate(us), np.concatenate(vs)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    blocks = F.ceil(F.col("_n") / CROWD).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks)
    dealt = (
        members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumns({"a": F.least(block, "other").cast("long"), "b": F.greatest(block, "other").cast("long")})
        .select(*columns)
    )
    return (
        dealt.repartition("key", "a", "b")
        .sortWithinPartitions("key", "a", "b", "id")
        .mapInArrow(linked, "u long, v long")
        .distinct()
    )


def _row(docs: DataFrame) -> dict[str, Column]:
    """What tells rows of docs apart: doc_id, null or not, and a hash of the text as it is."""
    doc_id = F.col("doc_id").cast("long")
    raw = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return {"__id": F.coalesce(doc_id, F.lit(0).cast("long")), "__null": doc_id.isNull(), "__raw": raw}


_ROW = ["__id", "__null", "__raw"]


def shingle_sets(docs: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """id, s: the hashes of the word shingles of the texts that asked (id and the columns of _ROW) names."""
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select(*[c.alias(n) for n, c in _row(docs).items()], lower.alias("text"))
    found = rows.join(asked.hint("shuffle_hash"), _ROW).dropDuplicates(["id"]).select("id", words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - shingle, F.lit(0)))
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("w"), i + 1, shingle)))
    return found.select("id", F.array_distinct(hashed).alias("s"))


def confirmed(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of word shingles are similar, compared as they are."""
    a, b = sets.toDF("u", "a"), sets.toDF("v", "b")
    both = F.size(F.array_intersect("a", "b"))
    alike = pairs.join(a, "u").join(b, "v").where(both >= F.lit(similarity) * (F.size("a") + F.size("b") - both))
    return alike.select("u", "v")


def ball_links(nodes: DataFrame) -> DataFrame:
    """u, v: pairs of nodes (id, fp) that tie all with one SimHash together, and all whose SimHashes links() ties."""
    heads = nodes.groupBy("fp").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("_n"))
    met = links(heads.select("fp")).toDF("_u", "_v")
    at = lambda n: heads.select(F.col("fp").alias(f"_{n}"), F.col("head").alias(n))
    near = met.join(at("u"), "_u").join(at("v"), "_v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    same = nodes.join(heads.where("_n > 1"), "fp").where(F.col("id") != F.col("head"))
    return near.unionByName(same.select(F.col("head").alias("u"), F.col("id").alias("v"))).distinct()


def similar_components(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, component: nodes linked by similarity, those without links left out.

    First the balls of SimHashes are hashed, as in near_duplicates, and what they
    link is a tie. SimHashes of texts of that similarity may differ in more bits; so
    texts that are found by one shingle form a bucket too, which gives the
    shortest links that tie it together. Those ties that the shingle sets confirm
    make components. Then each bucket gives all likely pairs that lie in different
    components, so that no likely pair is left unless links join it anyway.
    """
    balls = written(ball_links(nodes.select("id", "fp")), "simhash-balls")
    found = nodes.select("id", F.explode("found_by").alias("key"))
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    sketches = nodes.select("id", "n", *_SKETCH)
    members = written(found.join(counts, "key"), "simhash-found")
    ties = written(likely_links(members.join(sketches, "id"), similarity).unionByName(balls).distinct(), "simhash-ties")
    some = ties.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    asked = written(nodes.join(some, "id", "left_semi").select("id", *_ROW), "simhash-asked")
    sets = written(shingle_sets(docs, asked, shingle), "simhash-sets")
    groups = written(connected_components(confirmed(sets, ties, similarity)), "simhash-components")
    # who has no likely partner has none in another component either
    open_ = members.join(asked.select("id"), "id", "left_semi").join(sketches, "id")
    labelled = open_.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    between = written(likely_links(labelled, similarity, apart=True), "simhash-between")
    more = written(confirmed(sets, between, similarity), "simhash-more")
    if more.isEmpty():
        return groups
    return connected_components(groups.toDF("u", "v").unionByName(more))


def _similar(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (doc_id, raw, h1, h2); the nodes (id, h1, h2, first: the least doc_id, and the columns of _ROW of a row
    that has it); node, component of nodes with links."""
    fps = written(wide_fingerprints(docs, shingle, similarity), "simhash-wide")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "raw")).alias("row")
    each = fps.groupBy("h1", "h2").agg(row, *[F.first(c).alias(c) for c in ("fp", "n", *_SKETCH, "found_by")])
    nodes = written(
        each.select(
            F.monotonically_increasing_id().alias("id"), "h1", "h2", F.when(~F.col("row.null"), F.col("row.id")).alias("first"),
            F.col("row.id").alias("__id"), F.col("row.null").alias("__null"), F.col("row.raw").alias("__raw"), "fp", "n", *_SKETCH, "found_by",
        ),
        "simhash-nodes",
    )
    return fps.select("doc_id", "raw", "h1", "h2"), nodes, similar_components(docs, nodes, shingle, similarity)


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id for every row of docs: groups of documents linked by similarity.

    Similarity is the Jaccard similarity of the sets of word shingles; texts
    with the same words are always linked. The balls of SimHashes propose the
    nearest pairs, shared shingles the rest: all pairs so similar share a shingle
    that both are found by; bitmaps, and fingerprints of long texts, only leave
    out pairs that can't be so similar before shingles are compared. Nulls,
    empty texts, repeated rows: as near_duplicates.
    """
    fps, nodes, groups = _similar(docs, shingle, similarity)
    classes = _classes(nodes, groups, "id")
    named = nodes.select("h1", "h2", "id").join(classes, F.col("id") == F.col("_fp"))
    return fps.join(named, ["h1", "h2"]).select("doc_id", "component_id")


def _classes(nodes: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """_fp, component_id: the least ``first`` of each node's group."""
    linked = groups.join(nodes.select(key, "first"), F.col("node") == F.col(key)).select(key, "component", "first")
    least = linked.groupBy(F.col("component").alias("_c")).agg(F.min("first").alias("least"))
    moved = linked.join(least, F.col("component") == F.col("_c")).select(F.col(key).alias("_fp"), "least")
    return nodes.join(moved, F.col(key) == F.col("_fp"), "left").select(
        F.col(key).alias("_fp"), F.coalesce("least", "first").alias("component_id")
    )


def first_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each group of similar texts: that with the least doc_id, then the least hash of its text.

    Rows are told apart by doc_id and text: a row is left out for a similar one
    only, never for a doc_id that it shares with another text. A null doc_id is
    the least only where the group has no other. Of rows that repeat both, one
    stays. Null, empty and blank texts are one group; an empty table stays empty.
    Whole texts are compared, however long. Columns of any name stay as they are.
    """
    _, nodes, groups = _similar(docs, shingle, similarity)
    groups = written(groups, "simhash-groups")
    order = F.struct("__null", "__id", "__raw")
    grouped = nodes.join(groups, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("component", "id").alias("_c"))
    stay = grouped.agg(F.min(order).alias("_row")).select("_row.*")
    key = unused(docs, *_ROW)
    rows = docs.withColumns(dict(zip(key, _row(docs).values(), strict=True)))
    kept = rows.join(written(stay.select(*_ROW).toDF(*key), "simhash-stay").hint("shuffle_hash"), key, "left_semi")
    return kept.dropDuplicates(key).select(*map(quoted, docs.columns))

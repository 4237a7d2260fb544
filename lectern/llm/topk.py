"""Exact top-k search by inner product: a ball tree per shard, searched branch and bound, best node first.

The rows are dealt to cells around pivots, and cells to shards of bounded size.
One task reads a shard's rows, builds its ball tree once and then takes the
shard's queries as they stream past. A query opens the nodes of the tree in the
order of the largest inner product that it can have with a node's ball
(q.c + |q| r), the two halves of a node when it is opened, and stops when no
open node's bound reaches its k-th score.

A first pass takes every query to one shard of its own cell. The k-th scores
found there are shared: in the second pass a query goes only to the shards of
cells whose own ball it can reach that score in, and most nodes there are cut
off at once.

Components are whole numbers, scores are exact, and a bound is rounded up, so
ties and rounding lose nothing. The pivots come from a bounded sample, which
only decides where rows lie: every row is in a shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import written

SCALE = 1024
#: Rows of a tree's leaf and of a shard; pivots at most, of every vector length, chosen among so many sampled rows.
LEAF, SHARD, PIVOTS, SAMPLE = 64, 16_384, 256, 4_096
_NONE, _MOST = -(1 << 63), (1 << 63) - 1
#: Over what exact scores are shifted to be compared as texts; components are doubles, so none is this large.
_SHIFT = 10**700
_CLIP = 1e300


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of doubles: as doubles where all are exact in them, else as Python's integers."""
    with np.errstate(over="ignore"):
        out = np.floor(x * SCALE)
    if np.isfinite(out).all():
        return out
    return np.array([[math.floor(v) * SCALE if abs(v) > 2.0**60 else math.floor(v * SCALE) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _points(x: np.ndarray) -> np.ndarray:
    """x as doubles. Where one is cut down to _CLIP, balls are taken to have no bound."""
    if x.dtype == object:
        x = np.array([[float(min(max(v, -(10**301)), 10**301)) for v in row] for row in x], dtype=float).reshape(x.shape)
    return np.clip(x, -_CLIP, _CLIP)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of a vector with the rows of a matrix, all whole numbers."""
    if q.dtype != object and x.dtype != object:
        largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(q))
        if largest < 2.0**52:
            return np.rint(x @ q).astype(np.int64)
        if largest < 2.0**62:
            return x.astype(np.int64) @ q.astype(np.int64)
    exact = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, exact, strict=True)) for row in x] or [], dtype=object)


class BallTree:
    """Balls halved at the median along the line between two far points, down to LEAF rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.points = _points(x)
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        centers, radii = [], []
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            part = self.points[rows]
            # halves before the mean: sums of large components stay finite
            center = (part / len(rows)).sum(axis=0)
            at = len(centers)
            centers.append(center)
            with np.errstate(over="ignore", invalid="ignore"):
                far = np.sqrt(((part - center) ** 2).sum(axis=1))
            radii.append(far.max())
            self.rows.append(rows)
            self.children.append(None)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (at, pair[1]) if side == 0 else (pair[0], at)
            if len(rows) > LEAF:
                a = part[np.argmax(far)]
                with np.errstate(over="ignore", invalid="ignore"):
                    b = part[np.argmax(((part - a) ** 2).sum(axis=1))]
                    order = np.argsort(np.nan_to_num(part @ (b - a)), kind="stable")
                half = len(rows) // 2
                self.rows[at] = None
                todo += [(rows[order[:half]], at, 0), (rows[order[half:]], at, 1)]
        self.centers, self.radii = np.stack(centers), np.array(radii)
        if np.abs(self.points).max(initial=0) >= _CLIP:
            self.radii[:] = np.inf
        self.spread = np.abs(self.centers).sum(axis=1)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest inner product that each of the vectors q can have with each node's ball, rounded up."""
        points = _points(q)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((points**2).sum(axis=1))
            norm[np.abs(points).max(axis=1, initial=0) >= _CLIP] = np.inf
            value = points @ self.centers.T + norm[:, None] * self.radii
            value += 1e-9 * (np.abs(value) + norm[:, None] * (self.spread + self.radii)) + 1
        return np.where(np.isnan(value), np.inf, value)

    def search(self, q_id: int, q: np.ndarray, bounds: np.ndarray, floor: int | None, k: int) -> list[tuple[int, int]]:
        """(score, row id) of the best k rows but those with the id q_id, best first, ties to the smaller id.

        Nodes are opened in the order of their bounds, and never under a node that
        can't reach the k-th score. Rows with a score under floor may be missing.
        """
        bound = bounds.tolist()
        least = -math.inf if floor is None else floor
        best: list[tuple[int, int]] = []
        open_ = [(-bound[0], 0)]
        while open_ and -open_[0][0] >= least:
            node = heapq.heappop(open_)[1]
            rows = self.rows[node]
            if rows is None:
                for child in self.children[node]:
                    if bound[child] >= least:
                        heapq.heappush(open_, (-bound[child], child))
                continue
            got = scores(q, self.x[rows])
            keep = self.ids[rows] != q_id
            if math.isfinite(least):
                keep &= got >= least
            if not keep.any():
                continue
            best += zip((-got[keep]).tolist(), self.ids[rows][keep].tolist(), strict=True)
            if len(best) >= k:
                best = sorted(best)[:k]
                least = max(least, -best[-1][0])
        return [(-s, i) for s, i in sorted(best)]


def _vectors(b: pa.RecordBatch) -> np.ndarray:
    column = b.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _searched(k: int):
    """Rows (dim, shard, asks, id, x, floor), sorted, a shard's own rows before its queries, to its best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, tree = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "shard", "asks")], axis=1)
            edges = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))).tolist(), len(keys)]
            out: list[tuple[int, int, int, str]] = []
            for a, e in zip(edges, edges[1:], strict=False):
                if a == e:
                    continue
                some = batch.slice(a, e - a)
                dim, shard, asks = keys[a].tolist()
                if now != (dim, shard):
                    now, ids, parts, tree = (dim, shard), [], [], None
                x = whole_numbers(_vectors(some).reshape(len(some), dim))
                if not asks:
                    ids.append(some.column("id").to_numpy(zero_copy_only=False))
                    parts.append(x)
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = BallTree(np.concatenate(ids), np.concatenate(parts))
                for q_id, q, bounds, floor in zip(some.column("id").to_pylist(), x, tree.bounds(x), some.column("floor").to_pylist(), strict=True):
                    for s, i in tree.search(q_id, q, bounds, None if floor <= _NONE + 1 else floor, k):
                        fits = _NONE < s < _MOST
                        out.append((q_id, i, min(max(s, _NONE + 1), _MOST), "" if fits else f"{s + _SHIFT:0701d}"))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["query_id", "vec_id", "score", "exact"]
                )

    return run


def _cells(valid: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """valid with ``cell``, the nearest pivot of the vector's length, and its distance from it, rounded up."""
    shared = valid.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors of a length at most
    schema = "id long, dim int, x array<double>, asks boolean, cell int, far double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            cell, far = np.zeros(len(b), np.int32), np.zeros(len(b))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                p = shared.value.get(dim)
                x = _points(whole_numbers(_vectors(b.take(pa.array(at))).reshape(len(at), dim)))
                if p is None or not dim:
                    continue
                best = np.full(len(at), np.inf)
                for c, pivot in enumerate(p):
                    with np.errstate(over="ignore", invalid="ignore"):
                        d = np.sqrt(((x - pivot) ** 2).sum(axis=1))
                    closer = d < best
                    cell[at[closer]], best[closer] = c, d[closer]
                far[at] = best * (1 + 1e-9) + 1e-6
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], [*b.schema.names, "cell", "far"])

    return valid.mapInArrow(run, schema)


def _reached(pivots: dict[int, np.ndarray], cells: DataFrame):
    """Rows (dim, id, x, home, floor, shards) to the shards of the cells in which the floor can be reached. shards is asked
    only for lengths that have one cell; all others are looked up, PIVOTS cells of 16 lengths at most."""
    dims = list(pivots)
    table = {(r["dim"], r["cell"]): (r["shards"], r["radius"]) for r in cells.where(F.col("dim").isin(dims)).collect()} if dims else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            xs, dims = b.column("x").to_pylist(), b.column("dim").to_pylist()
            for x, dim, floor, shards in zip(xs, dims, b.column("floor").to_pylist(), b.column("shards").to_pylist(), strict=True):
                if dim not in pivots:
                    out.append(list(range(shards)))
                    continue
                q = _points(whole_numbers(np.array([x])))[0]
                with np.errstate(over="ignore", invalid="ignore"):
                    norm, at = np.sqrt((q**2).sum()), pivots[dim] @ q
                    size = norm * np.abs(pivots[dim]).sum(axis=1)
                found = []
                for (d, cell), (n, radius) in table.items():
                    if d != dim:
                        continue
                    bound = at[cell] + norm * radius
                    bound += 1e-9 * (abs(bound) + size[cell] + norm * radius) + 1
                    if math.isnan(bound) or np.abs(q).max(initial=0) >= _CLIP or bound >= floor:
                        found += [(cell << 32) + i for i in range(n)]
                out.append(found)
            columns = [b.column(c) for c in ("dim", "id", "x", "home", "floor")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int64()))], ["dim", "id", "x", "home", "floor", "shard"])

    return run


def _pivots(valid: DataFrame, n: dict[int, int]) -> dict[int, np.ndarray]:
    """For each of the few commonest lengths, rows far apart from each other among at most SAMPLE rows with the least hashes."""
    out = {}
    for dim, rows in n.items():
        many = min(PIVOTS, -(-rows // SHARD))
        if many < 2:
            continue
        some = valid.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").collect()
        x = _points(whole_numbers(np.array([r["x"] for r in some], dtype=float)))
        chosen, best = [x[0]], np.full(len(x), np.inf)
        while len(chosen) < many:
            with np.errstate(over="ignore", invalid="ignore"):
                best = np.minimum(best, np.nan_to_num(((x - chosen[-1]) ** 2).sum(axis=1)))
            chosen.append(x[int(np.argmax(best))])
        out[dim] = np.stack(chosen)
    return out


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query (a Column) holds for, its k best other rows.

    vectors: vec_id, embedding. Each component x becomes floor(1024 * x); the
    score is the integer inner product, ties go to the smaller vec_id. Vectors
    that are null or hold components that are null or non-finite, and rows with
    a null vec_id, take no part. Vectors of different lengths are not compared;
    empty ones score 0 with each other. Components may be as large as a double:
    rank is by the exact score, and a score beyond a long is given as the
    nearest one. Rows with the same vec_id are the same row to a query, which
    never finds its own id; of repeated ids every row is a candidate. A query
    with fewer than k others gets all; an empty table gives no rows. Other
    columns are ignored.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    finite = ~F.exists(F.col("x"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    valid = written(
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .select(F.col("vec_id").cast("long").alias("id"), x.alias("x"), is_query.alias("asks"))
        .where(F.coalesce(finite, F.lit(False)))
        .select("id", F.size("x").alias("dim"), "x", F.coalesce("asks", F.lit(False)).alias("asks")),
        "topk-vectors",
    )
    lengths = valid.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(16).collect()
    pivots = _pivots(valid, {r["dim"]: r["n"] for r in lengths})
    placed = written(_cells(valid, pivots), "topk-cells")
    # one row a cell: its shards, and the ball of its rows
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"), F.max("far").alias("radius"))
    cells = written(cells, "topk-balls")
    joined = placed.join(cells, ["dim", "cell"])
    # shards of a cell share its number's high bits
    shard = (F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("id", "x"), F.col("shards"))).alias("shard")
    rows = joined.select("dim", shard, F.lit(False).alias("asks"), "id", "x", F.lit(_NONE).alias("floor"))
    queries = joined.where("asks").dropDuplicates(["id", "x"])
    home = F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.hash("id"), F.col("shards"))

    def searched(asked: DataFrame) -> DataFrame:
        both = rows.unionByName(asked.select("dim", "shard", F.lit(True).alias("asks"), "id", "x", "floor"))
        dealt = both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")
        return dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score long, exact string")

    first = written(searched(queries.select("dim", home.alias("shard"), "id", "x", F.lit(_NONE).alias("floor"))), "topk-first")
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    kth = kth.where(F.col("n") >= k).select(F.col("query_id").alias("_id"), "least")
    asking = queries.select("dim", "id", "x", home.alias("home"), "shards").join(kth, F.col("id") == F.col("_id"), "left")
    asking = asking.select("dim", "id", "x", "home", F.coalesce("least", F.lit(_NONE)).alias("floor"), "shards")
    reached = asking.mapInArrow(_reached(pivots, cells), "dim int, id long, x array<double>, home long, floor long, shard array<long>")
    others = reached.withColumn("shard", F.explode("shard")).where(F.col("shard") != F.col("home"))
    many = not cells.groupBy("dim").agg(F.sum("shards").alias("n")).where(F.col("n") > 1).isEmpty()
    found = first.unionByName(searched(others)) if many else first
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by inner product with cover trees over queries and data, searched together.

A node covers its points by a centre and the greatest distance to it. By Cauchy and Schwarz no query of one node scores more with a
point of the other than ``<q, p> + |q| r + |p| s + r s``, for centres q and p and radii s and r. A pair of nodes is dropped where
that lies below the worst kth score that the node's queries have so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratecraft.session import ship_package, stage

SCALE = 256
SAMPLE_ROWS = 2048
MAX_CELLS = 64
CELL_ROWS = 4096
BLOCK_ROWS = 32768
QUERY_ROWS = 512
LEAF = 64
QUERY_LEAF = 16
FAN_OUT = 32
BASE_ROWS = 4096

_LONG = 2**63 - 1


class Tree:
    """A cover tree in arrays, over the rows of ``points``: a node's children cover it by balls of half its radius whose centres
    lie that far apart. Children of few points are held together in one leaf, with what ``FAN_OUT`` balls don't cover, so a set
    without structure is a shallow tree of large leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.floats = points.astype(np.float64)
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        everything = np.arange(len(points))
        if len(points):
            self._node(everything, self.floats.mean(axis=0))
        self.matrix = np.array(self.centres).reshape(len(self.centres), points.shape[1])
        self.lengths = np.linalg.norm(self.matrix, axis=1)
        self.radius = np.array(self.radii)

    def _add(self, rows: np.ndarray, centre: np.ndarray, away: np.ndarray) -> int:
        self.centres.append(centre)
        self.radii.append(float(away.max()) * (1 + 1e-9))
        self.children.append([])
        self.rows.append(rows)
        return len(self.centres) - 1

    def _node(self, rows: np.ndarray, centre: np.ndarray) -> int:
        away = np.linalg.norm(self.floats[rows] - centre, axis=1)
        own = self._add(rows, centre, away)
        if len(rows) <= self.leaf or away.max() == 0:
            return own
        half, rest, few = away.max() / 2, rows, []
        for _ in range(FAN_OUT):
            middle = self.floats[rest[0]]
            near = np.linalg.norm(self.floats[rest] - middle, axis=1) <= half
            if near.sum() < self.leaf // 4:
                few.append(rest[near])
            else:
                self.children[own].append(self._node(rest[near], middle))
            rest = rest[~near]
            if not len(rest):
                break
        few = np.concatenate([*few, rest]) if few or len(rest) else rest
        if len(few):
            if not self.children[own]:
                return own
            self.children[own].append(self._add(few, centre, np.linalg.norm(self.floats[few] - centre, axis=1)))
        return own


def _exact(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Integer inner products: by doubles where those are exact, by longs, or by Python's integers where longs would overflow
    (results beyond a long are held at its ends)."""
    a, b = (int(max(x.max(), -x.min())) if x.size else 0 for x in (points, others))
    most = a * b * points.shape[1]
    if most < 2**53:
        return (points.astype(np.float64) @ others.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return points @ others.T
    exact = points.astype(object) @ others.astype(object).T
    return np.clip(exact, -_LONG - 1, _LONG).astype(np.int64)


class Best:
    """The k best (score, id) of each query, ties to the smaller id; null ids (the greatest long) come last."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.k, self.worst = ids, k, least.copy()
        self.rows = self.scores = self.found = np.empty(0, dtype=np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Meets queries with data, all pairs of both; a query's own id is no match."""
        at, to = np.nonzero((scores >= self.worst[rows, None]) & (ids[None, :] != self.ids[rows, None]))
        if not len(at):
            return
        row, score, found = (np.concatenate(x) for x in ((self.rows, rows[at]), (self.scores, scores[at, to]), (self.found, ids[to])))
        order = np.lexsort((found, ~score, row))
        row, score, found = row[order], score[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        last = rank == self.k - 1
        self.worst[row[last]] = np.maximum(self.worst[row[last]], score[last])
        self.rows, self.scores, self.found = (x[rank < self.k] for x in (row, score, found))


def dual_search(queries: Tree, query_ids: np.ndarray, data: Tree, data_ids: np.ndarray, least: np.ndarray, k: int) -> Best:
    """The k best points of ``data`` for each query among those that score ``least`` (of that query) or more, pairs of nodes with
    the greatest bounds first."""
    best = Best(query_ids, least, k)
    if not len(queries.points) or not len(data.points):
        return best

    def bounds(q: int, p: np.ndarray) -> np.ndarray:
        high = data.matrix[p] @ queries.matrix[q] + queries.lengths[q] * data.radius[p] + data.lengths[p] * queries.radius[q] + queries.radius[q] * data.radius[p]
        return high + 1e-6 * (1 + np.abs(high) + queries.lengths[q] * data.lengths[p])

    heap = [(-float(bounds(0, np.array([0]))[0]), 0, 0)]
    while heap:
        high, q, p = heapq.heappop(heap)
        rows = queries.rows[q]
        if -high < best.worst[rows].min():
            continue
        below, under = queries.children[q], data.children[p]
        if not below and not under:
            # queries one by one first, as balls of no size
            alone = queries.floats[rows] @ data.matrix[p] + np.linalg.norm(queries.floats[rows], axis=1) * data.radius[p]
            rows = rows[alone + 1e-6 * (1 + np.abs(alone) + np.linalg.norm(queries.floats[rows], axis=1) * data.lengths[p]) >= best.worst[rows]]
            if not len(rows):
                continue
            for low in range(0, len(data.rows[p]), BASE_ROWS):
                to = data.rows[p][low : low + BASE_ROWS]
                best.add(rows, _exact(queries.points[rows], data.points[to]), data_ids[to])
        elif under and (not below or data.radius[p] >= queries.radius[q]):
            for child, bound in zip(under, bounds(q, np.array(under))):
                heapq.heappush(heap, (-float(bound), q, child))
        else:
            for child in below:
                heapq.heappush(heap, (-float(bounds(child, np.array([p]))[0]), child, p))
    return best


def whole(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component as long (held at the ends of the range), null where the vector or a component is null
    or not finite."""
    doubles = vector.cast("array<double>")
    good = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    limit = F.lit(float(2**62))
    value = lambda x: F.floor(F.greatest(-limit, F.least(limit, x * scale)))
    return F.when(vector.isNotNull() & good, F.transform(doubles, value))


def _rows(batches: Iterator[pa.RecordBatch], size: int = 2048) -> Iterator[dict]:
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            yield from batch.slice(low, size).to_pylist()


def _matrix(vectors: list[list[int]], width: int) -> np.ndarray:
    """Vectors as rows; missing components count as zero."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vec") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the k highest integer inner products with ``vectors`` (arrays of
    longs), those of its own id left out; equal scores in order of id. All there are where they are fewer.

    Exact: the index is fitted on at most ``SAMPLE_ROWS`` vectors, chosen by hash, but holds every row. The sample's spread-out
    points are the top of the tree, at most ``MAX_CELLS`` cells; a cell's rows are dealt to blocks of about ``BLOCK_ROWS``, and
    each task searches trees of a block and of its queries together. A query's kth score within the sample is a bound from
    the start, and cells whose ball lies below it are not visited. Of equal vectors only the k + 1 smallest ids are searched,
    since no other can be among the first k, so copies of one vector are no hot group.

    Null vectors take no part. Vectors of other lengths count missing components as zero. Null ids are candidates, the last
    of equal scores, and never queries. Query rows that share an id are searched one by one, and each has its ranks.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    data = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")).where("vec IS NOT NULL")
    first = Window.partitionBy("vec").orderBy(F.col("vec_id").asc_nulls_last())
    data = stage(data.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n"))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")).where("vec IS NOT NULL AND vec_id IS NOT NULL")
    known = data.agg(F.count("*").alias("rows"), F.max(F.size("vec")).alias("width")).first()
    width = max(known["width"] or 0, asked.agg(F.max(F.size("vec")).alias("width")).first()["width"] or 0)
    sample = data.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE_ROWS).collect()
    points, names = _matrix([r["vec"] for r in sample], width), np.array([_LONG if r["vec_id"] is None else r["vec_id"] for r in sample], dtype=np.int64)
    pivots = _spread(points, max(1, min(MAX_CELLS, -(-known["rows"] // CELL_ROWS))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                cell, away, _ = _nearest(_matrix(part.column("vec").to_pylist(), width), pivots)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(away)], names=[*part.schema.names, "cell", "away"])

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                own = _matrix(part.column("vec").to_pylist(), width)
                cell, away, _ = _nearest(own, pivots)
                ids = part.column("vec_id").to_numpy()
                scores = np.where(names[None, :] == ids[:, None], -_LONG - 1, _exact(own, points))
                least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -_LONG - 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(away), pa.array(least.astype(np.int64))], names=[*part.schema.names, "cell", "away", "least"])

    data = stage(data.mapInArrow(placed, "vec_id long, vec array<long>, cell long, away double"))
    cells = {r["cell"]: (r["radius"], -(-r["rows"] // BLOCK_ROWS)) for r in data.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("rows")).collect()}
    asked = asked.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "vec")
    asked = stage(asked.mapInArrow(seeded, "row long, vec_id long, vec array<long>, cell long, away double, least long"))

    blocks = {cell: n for cell, (_, n) in cells.items()}
    radii = np.array([cells[c][0] if c in cells else -np.inf for c in range(len(pivots))])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy of each query for every block of the cells it cannot leave out."""
        lengths = np.linalg.norm(pivots, axis=1)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                own = _matrix(part.column("vec").to_pylist(), width).astype(np.float64)
                size = np.linalg.norm(own, axis=1)[:, None]
                high = own @ pivots.T + size * radii
                high += 1e-6 * (1 + size * (lengths + np.maximum(radii, 0)))
                rows, to = np.nonzero(high >= part.column("least").to_numpy()[:, None])
                counts = np.array([blocks.get(int(c), 0) for c in to], dtype=np.int64)
                rows, to = np.repeat(rows, counts), np.repeat(to, counts)
                block = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                chosen = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(block), *(chosen.column(c) for c in ("row", "vec_id", "vec", "least", "cell"))], names=["cell", "block", "row", "vec_id", "vec", "least", "group"])

    shape = "cell long, block long, row long, vec_id long, vec array<long>, least long, group long"
    sizes = F.create_map(*[F.lit(x).cast("long") for item in (blocks or {0: 1}).items() for x in item])
    dealt = data.withColumn("block", F.pmod(F.xxhash64("vec", "vec_id"), sizes[F.col("cell")]))
    nothing = F.lit(None).cast("long")
    both = dealt.select("cell", "block", nothing.alias("row"), "vec_id", "vec", nothing.alias("least"), F.lit(-1).cast("long").alias("group")).union(asked.mapInArrow(routed, shape))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk, tree, ids = None, [], [], None, None
        for row in _rows(batches):
            if (row["cell"], row["block"]) != key:
                if chunk:
                    yield _answers(chunk, tree, ids, width, k)
                key, held, chunk, tree = (row["cell"], row["block"]), [], [], None
            if row["row"] is None:
                held.append((row["vec_id"], row["vec"]))
                continue
            if tree is None:
                tree = Tree(_matrix([v for _, v in held], width))
                ids, held = np.array([_LONG if i is None else i for i, _ in held], dtype=np.int64), []
            chunk.append(row)
            if len(chunk) == QUERY_ROWS:
                yield _answers(chunk, tree, ids, width, k)
                chunk = []
        if chunk:
            yield _answers(chunk, tree, ids, width, k)

    # a block's data come before its queries, and queries of one cell together
    found = both.repartition("cell", "block").sortWithinPartitions("cell", "block", "group").mapInArrow(searched, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(chunk: list[dict], tree: Tree, ids: np.ndarray, width: int, k: int) -> pa.RecordBatch:
    asked = np.array([r["vec_id"] for r in chunk], dtype=np.int64)
    best = dual_search(Tree(_matrix([r["vec"] for r in chunk], width), QUERY_LEAF), asked, tree, ids, np.array([r["least"] for r in chunk], dtype=np.int64), k)
    number = np.array([r["row"] for r in chunk], dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(number[best.rows]), pa.array(asked[best.rows]), pa.array(best.found, mask=best.found == _LONG), pa.array(best.scores)],
        names=["row", "query_id", "vec_id", "score"],
    )


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the distance to it, a little above what rounding may lose."""
    floats = vectors.astype(np.float64)
    away = np.stack([np.linalg.norm(floats - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(floats), 1))
    cell = away.argmin(axis=1)
    return cell, away[np.arange(len(cell)), cell] * (1 + 1e-9), away


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """At most n points, each the farthest from those before it."""
    floats = points.astype(np.float64)
    if not len(floats):
        return np.zeros((1, points.shape[1]))
    out = [floats[0]]
    away = np.linalg.norm(floats - out[0], axis=1)
    while len(out) < n and away.max() > 0:
        out.append(floats[away.argmax()])
        away = np.minimum(away, np.linalg.norm(floats - out[-1], axis=1))
    return np.array(out)

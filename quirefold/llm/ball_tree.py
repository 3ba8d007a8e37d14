"""Clustering of vectors around centroids with partition-local ball trees.

Every task builds trees of bounded size over the vectors of its own partition, once; a tree is one row. A ball stores its
radius, and its count and integer sum. A round sends the few centroids to the trees: by the triangle inequality a centroid
drops out of a ball where another one is surely nearer to every vector inside. A ball with one centroid left goes to it whole,
by count and sum; otherwise its halves are tried, and at a leaf the distances are computed in whole numbers. Bounds are
floating-point numbers with a margin for rounding, so that they never decide a tie; ties go to the smaller number at the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of a tree and of a leaf.
TREE, LEAF = 2048, 32
#: Components stop here, so that a squared distance fits in a long.
LARGEST = 1 << 27
#: Where no component is larger than this, sums of products are exact in floating point.
EXACT = 1 << 22
TREES = "ids array<long>, points binary, first array<int>, past array<int>, left array<int>, right array<int>, radius array<double>, sums binary"
_TREE_SCHEMA = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("first", pa.list_(pa.int32())), ("past", pa.list_(pa.int32())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("sums", pa.binary())])


def whole_vectors(vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, point): the vectors with exactly `dimensions` components, none null or not finite, as floor(scale * component)."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where((F.size(v) == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")).alias("point"))


def _seed_hash(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("1:"), F.coalesce(vec_id.cast("string"), F.lit(""))).cast("binary"), 256)


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[list]]:
    """A tree over the rows of points: the order of rows in it, and its balls as (first, past, left, right, radius, sum).

    A ball is split in halves along the line between two far points of it; one of at most `leaf` rows or of equal rows is a leaf.
    """
    order, balls, open_balls = np.arange(len(points)), [], [0]
    balls.append([0, len(points), -1, -1, 0.0, None])
    while open_balls:
        ball = balls[open_balls.pop()]
        first, past = ball[:2]
        rows = points[order[first:past]]
        ball[5] = rows.sum(axis=0, dtype=np.int64)
        inside = rows.astype(np.float64)
        off = ((inside - ball[5] / (past - first)) ** 2).sum(axis=1)
        ball[4] = float(np.sqrt(off.max()))
        if past - first <= leaf or (rows == rows[0]).all():
            continue
        far = inside[off.argmax()]
        other = inside[((inside - far) ** 2).sum(axis=1).argmax()]
        middle = (past - first) // 2
        order[first:past] = order[first:past][np.argpartition(inside @ (other - far), middle)]
        ball[2:4] = len(balls), len(balls) + 1
        open_balls += ball[2:4]
        balls += [[first, first + middle, -1, -1, 0.0, None], [first + middle, past, -1, -1, 0.0, None]]
    return order, balls


def _trees(batches: Iterator[pa.RecordBatch], dimensions: int, size: int) -> Iterator[pa.RecordBatch]:
    def grow(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        order, balls = build(points)
        first, past, left, right, radius, sums = zip(*balls, strict=True)
        columns = [[ids.take(pa.array(order)).to_pylist()], [points[order].astype("<i4").tobytes()], [first], [past], [left], [right], [radius], [np.array(sums).astype("<i8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TREE_SCHEMA, strict=True)], schema=_TREE_SCHEMA)

    ids, points, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            ids.append(part.column(0))
            points.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions))
            n += part.num_rows
            if n >= size:
                all_ids, all_points = pa.concat_arrays(ids), np.concatenate(points)
                yield grow(all_ids[:size], all_points[:size])
                ids, points, n = [all_ids[size:]], [all_points[size:]], n - size
    if n:
        yield grow(pa.concat_arrays(ids), np.concatenate(points))


def _distances(points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    if max(np.abs(points).max(initial=0), np.abs(centroid).max(initial=0)) <= EXACT:
        off = points.astype(np.float64) - centroid
        return np.einsum("ij,ij->i", off, off).astype(np.int64)
    return ((points.astype(np.int64) - centroid) ** 2).sum(axis=1)


def descend(points: np.ndarray, balls: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """The balls that go to one centroid whole, as (ball, centroid), the rows of the leaves that don't, and their centroids.

    A level of the tree is handled at once.
    """
    z, whole, rows, nearest = centroids.astype(np.float64), [], [], []
    level, live = np.zeros(1, int), np.ones((1, len(z)), bool)
    while len(level):
        center = balls["sums"][level] / (balls["past"] - balls["first"])[level, None]
        distance = np.sqrt(np.maximum(((center[:, None, :] - z[None]) ** 2).sum(axis=2), 0))
        reach = balls["radius"][level, None]
        margin = 1e-9 * (1 + distance + reach)
        live &= distance - reach - margin <= np.where(live, distance + reach + margin, np.inf).min(axis=1)[:, None]
        single = live.sum(axis=1) == 1
        whole += zip(level[single].tolist(), live[single].argmax(axis=1).tolist(), strict=True)
        leaf = ~single & (balls["left"][level] < 0)
        for ball, candidates in zip(level[leaf], live[leaf], strict=True):
            at = np.arange(balls["first"][ball], balls["past"][ball])
            numbers = np.flatnonzero(candidates)
            rows.append(at)
            nearest.append(numbers[np.argmin([_distances(points[at], centroids[j]) for j in numbers], axis=0)])
        inner = ~single & ~leaf
        live = np.repeat(live[inner], 2, axis=0)
        level = np.column_stack([balls["left"][level[inner]], balls["right"][level[inner]]]).ravel()
    none = np.zeros(0, int)
    return whole, np.concatenate([none, *rows]), np.concatenate([none, *nearest])


def _read(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    for i in range(batch.num_rows):
        balls = {name: batch.column(k)[i].values.to_numpy() for k, name in enumerate(("first", "past", "left", "right", "radius"), 2)}
        balls["sums"] = np.frombuffer(batch.column(7)[i].as_py(), "<i8").reshape(-1, dimensions)
        yield batch.column(0)[i].values, np.frombuffer(batch.column(1)[i].as_py(), "<i4").reshape(-1, dimensions), balls


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, dimensions = centroids.shape
    count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
    for batch in batches:
        for _, points, balls in _read(batch, dimensions):
            whole, rows, nearest = descend(points, balls, centroids)
            for ball, j in whole:
                count[j] += balls["past"][ball] - balls["first"][ball]
                total[j] += balls["sums"][ball]
            np.add.at(count, nearest, 1)
            np.add.at(total, nearest, points[rows].astype(np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["cluster", "count", "sums"])


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, points, balls in _read(batch, centroids.shape[1]):
            whole, rows, nearest = descend(points, balls, centroids)
            cluster = np.zeros(len(points), np.int32)
            cluster[rows] = nearest
            for ball, j in whole:
                cluster[balls["first"][ball] : balls["past"][ball]] = j
            distance = np.zeros(len(points), np.int64)
            for j in np.unique(cluster):
                distance[cluster == j] = _distances(points[cluster == j], centroids[j])
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])


def grow_trees(points: DataFrame, dimensions: int = DIMENSIONS, size: int = TREE) -> DataFrame:
    """Trees of at most `size` vectors over the partitions of points (vec_id, point), a row each, in the shared folder."""
    return cut(points.select("vec_id", "point").mapInArrow(partial(_trees, dimensions=dimensions, size=size), TREES))


def next_centroids(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of what each centroid gets; one that gets nothing stays. To the driver come one row a centroid."""
    k, dimensions = centroids.shape
    parts = trees.mapInArrow(partial(_sums, centroids=centroids), "cluster int, count long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("count").alias("count"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dimensions)]).alias("sums")).collect()
    after = centroids.copy()
    for r in rows:
        if r["count"]:
            after[r["cluster"]] = [s // r["count"] for s in r["sums"]]
    return after


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, tree: int = TREE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for every kept vector (see whole_vectors), and the final centroids.

    The centroids start as the vectors whose id has the smallest SHA-256 of `1:<vec_id>`, ties by components; a null id counts
    as empty. Repeated rows are vectors of their own; rows with a null, a short or a long vector, or one with a null or
    infinite component, are left out; components of over 2^27 after scaling stop there. With fewer vectors than clusters there
    are as many centroids as vectors; an empty table gives an empty result. Other columns are ignored.
    """
    kept = whole_vectors(vectors, column, dimensions, scale)
    seeds = kept.select(_seed_hash(F.col("vec_id")).alias("hash"), "point").orderBy("hash", "point").limit(clusters).collect()
    centroids = np.array([s["point"] for s in seeds], np.int64).reshape(-1, dimensions)
    if not seeds:
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where(F.lit(False)), centroids
    trees = grow_trees(kept, dimensions, tree)
    for _ in range(rounds):
        centroids = next_centroids(trees, centroids)
    return trees.mapInArrow(partial(_assign, centroids=centroids), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia (sums of distances) and centroid_sha256; these are one row a centroid."""
    import hashlib

    assigned = cut(assigned)
    sums = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    rows = [(j, n, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in sums.items()]
    figures = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Centroid clustering over space-filling-curve zone maps, in whole numbers.

* Vectors are put in the order of a Hilbert curve over all their dimensions, two bits each, the most spread ones
  leading, and written once in blocks of BLOCK rows with the least and greatest value of every dimension. The
  range that a vector goes to depends on its place on the curve and its id, so copies of one vector spread.
* In each round a block's box gives a lower and an upper bound of the distance to every centroid. Centroids whose
  lower bound is over the smallest upper bound cannot be nearest to any row of the block; the rows are compared
  exactly with the others, in one matrix product.
* A task adds up its vectors by centroid, so a round shuffles K x WIDTH sums a task and sends as many to the driver. Sums and
  distances are whole numbers: results do not depend on the order of rows, tasks or retries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secstream.llm.common import table
from secstream.session import materialise

WIDTH = 64
K = 40
ROUNDS = 5
SEED = 2
SCALE = 256
#: Components are held between -LIMIT and LIMIT, so that a squared distance fits a long.
LIMIT = 1 << 27
#: Rows of a block, and bits of a dimension that place a vector on the curve.
BLOCK, BITS = 256, 2
#: Up to this size of components a product in floating point is exact.
_EXACT = 1 << 22

_POINT = "_id long, _q array<int>"
_BLOCK = "_n int, _ids array<long>, _times array<long>, _low binary, _high binary, _rows binary"


def whole_vectors(df: DataFrame) -> DataFrame:
    """(_id, _q): vectors of WIDTH components, none null or non-finite, as whole numbers.

    Components beyond LIMIT count as LIMIT. Null ids stay null; other columns are left out.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return df.filter((F.size("embedding") == WIDTH) & ~bad).select(F.col("vec_id").cast("long").alias("_id"), scaled.alias("_q"))


def seeds(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests, in that order; ids that are null come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    rows = points.select("_q", digest.alias("_digest")).orderBy(F.col("_digest").asc_nulls_last(), "_q").limit(k).collect()
    return np.array([r._q for r in rows], np.int64).reshape(-1, WIDTH)


def hilbert_keys(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of ``levels`` (rows x dimensions, values under 2^bits) on the Hilbert curve, as bytes
    that sort in curve order. All rows at once: the axes are turned and reflected plane by plane from the top."""
    x = np.ascontiguousarray(levels.T).astype(np.int64)
    for plane in range(bits - 1, 0, -1):
        below = (1 << plane) - 1
        for axis in x:
            high = (axis >> plane & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ axis) & below)
            x[0] ^= np.where(high, below, swap)
            axis ^= swap if axis is not x[0] else 0
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> plane & 1, (1 << plane) - 1, 0)
    x ^= turn
    planes = np.concatenate([x >> plane & 1 for plane in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(planes.T, axis=1)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def spread(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every dimension; they only shape the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(WIDTH), np.zeros(WIDTH)
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch, "_q").astype(np.float64)
                n, total, squares = n + len(q), total + q.sum(axis=0), squares + (q**2).sum(axis=0)
        kind = pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH), pa.int32()), pa.array([n] * WIDTH, pa.int64()), pa.array(total, kind), pa.array(squares, kind)], ["_k", "_n", "_s", "_ss"])

    rows = points.mapInArrow(run, "_k int, _n long, _s double, _ss double").groupBy("_k").agg(*(F.sum(c).alias(c) for c in ("_n", "_s", "_ss"))).collect()
    mean, width = np.zeros(WIDTH), np.zeros(WIDTH)
    for r in rows:
        if r._n:
            mean[r._k] = r._s / r._n
            width[r._k] = max(r._ss / r._n - mean[r._k] ** 2, 0.0) ** 0.5
    return mean, width


def zone_blocks(points: DataFrame) -> DataFrame:
    """_BLOCK rows in curve order; equal rows that arrive together are one with a number of times."""
    mean, width = spread(points)
    order = np.argsort(-width, kind="stable")
    steps = (np.arange(1, 1 << BITS) - (1 << BITS) / 2) * 2 / (1 << BITS) * 1.35  # for BITS = 2 about quartiles

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch, "_q").astype(np.int32)
            ids = batch.column("_id")
            rows = np.ascontiguousarray(np.c_[q, np.asarray(ids.fill_null(0)).view(np.int32).reshape(-1, 2), np.asarray(ids.is_null(), np.int32)])
            _, at, times = np.unique(rows.view(np.dtype((np.void, rows.shape[1] * 4))).ravel(), return_index=True, return_counts=True)
            q = q[at]
            levels = sum((q[:, order] > (mean + width * s)[order]).astype(np.int64) for s in steps)
            keys = hilbert_keys(levels)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), ids.take(pa.array(at)), pa.array(times), pa.array(list(q), pa.list_(pa.int32()))], ["_key", "_id", "_times", "_q"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                q = _matrix(part, "_q").astype("<i4")
                one = lambda x, kind: pa.array([x], kind)
                yield pa.RecordBatch.from_arrays(
                    [one(len(q), pa.int32()), one(part.column("_id").to_pylist(), pa.list_(pa.int64())), one(part.column("_times").to_pylist(), pa.list_(pa.int64()))]
                    + [one(x.tobytes(), pa.binary()) for x in (q.min(axis=0), q.max(axis=0), q)],
                    ["_n", "_ids", "_times", "_low", "_high", "_rows"],
                )

    placed = points.mapInArrow(place, "_key binary, _id long, _times long, _q array<int>")
    ranged = placed.repartitionByRange("_key", "_id", "_q").sortWithinPartitions("_key", "_id", "_q")
    return materialise(ranged.mapInArrow(cut, _BLOCK), "zones")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector inside the box, ties included.

    The least distance to the box must not be over the smallest greatest one. Of what is left, a centroid goes if
    the one nearest to the middle of the box is nearer all over the box: the difference of two squared distances
    is linear, so its greatest value lies at the corner that the signs of its slopes name.
    """
    least = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    most = np.maximum(np.abs(centroids - low), np.abs(high - centroids))
    among = np.flatnonzero((least**2).sum(axis=1) <= (most**2).sum(axis=1).min())
    few = centroids[among]
    middle = few[((2 * few - low - high).astype(float) ** 2).sum(axis=1).argmin()]
    slope = few - middle
    worst = (middle**2).sum() - (few**2).sum(axis=1) + 2 * (np.maximum(slope, 0) @ high + np.minimum(slope, 0) @ low)
    return among[worst >= 0]


def nearest(rows: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row; of equals the smaller number."""
    among = candidates(low, high, centroids)
    few = centroids[among]
    if max(np.abs(low).max(), np.abs(high).max(), np.abs(few).max()) <= _EXACT:
        a, b = rows.astype(np.float64), few.astype(np.float64)
        squares = ((a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)).astype(np.int64)
    else:
        squares = np.stack([((rows - c) ** 2).sum(axis=1) for c in few], axis=1)
    best = squares.argmin(axis=1)
    return among[best], squares[np.arange(len(rows)), best]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for r in batch.to_pylist():
            box = [np.frombuffer(r[c], "<i4").astype(np.int64) for c in ("_low", "_high")]
            yield r["_ids"], np.asarray(r["_times"], np.int64), *box, np.frombuffer(r["_rows"], "<i4").reshape(-1, WIDTH).astype(np.int64)


def moved(zones: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means of what is nearest to them; empty ones stay."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for _, times, low, high, rows in _blocks(batches):
            to, _ = nearest(rows, low, high, centroids)
            np.add.at(sums, to, rows * times[:, None])
            np.add.at(n, to, times)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["_c", "_n", "_s"])

    parts = zones.mapInArrow(run, "_c long, _n long, _s array<long>")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.select("_c", "_n", F.posexplode("_s").alias("_k", "_s")).groupBy("_c", "_k").agg(total("_n"), total("_s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r._c, r._k] = int(r._s) // int(r._n)
    return out


def assigned(zones: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, times, low, high, rows in _blocks(batches):
            to, far = nearest(rows, low, high, centroids)
            for lo in range(0, int(times.sum()), 1 << 16):  # a block of few rows may stand for very many
                at = np.searchsorted(np.cumsum(times), np.arange(lo, min(lo + (1 << 16), int(times.sum()))), side="right")
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(at)), pa.array(to[at].astype(np.int32)), pa.array(far[at])], ["vec_id", "cluster", "distance"])

    return zones.mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept, and the
    centroids; ``vectors`` has vec_id and embedding.

    Vectors with another number of components, or with one that is null or not finite, and null ones, give no row.
    Repeated rows and ids each give their own row; a null id stays null and is a seed only if ids run out. With
    fewer than ``k`` vectors there are as many centroids as vectors; an empty table gives no rows. Other columns
    are ignored. Components beyond LIMIT after scaling count as LIMIT.
    """
    points = whole_vectors(vectors)
    centroids = seeds(points, k, seed)
    zones = zone_blocks(points)
    for _ in range(rounds):
        centroids = moved(zones, centroids)
    rows = materialise(assigned(zones, centroids), "assigned")
    total = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    inertia = sum(int(r.d) for r in total)
    of = [(r.cluster, int(r.d), inertia, hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in total]
    named = rows.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # K rows at most
    return rows.join(named, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op12_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))[0]


def _sql() -> str:
    """The same in SQL: each round compares all vectors with all centroids."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT rid, vec_id, v, k AS cluster, d AS distance FROM (
    SELECT rid, vec_id, v, k, d, row_number() OVER (PARTITION BY rid ORDER BY d, k) AS rn FROM (
      SELECT rid, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM kept, c{r}))
  WHERE rn = 1)""")
        if r < ROUNDS:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(moved.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (
      SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {WIDTH + 1}) AS t(i) GROUP BY cluster, i)
    GROUP BY cluster) AS moved ON moved.cluster = c{r}.k)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {K})),
{",".join(steps)},
inertias AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia, (SELECT sum(distance) FROM a{ROUNDS})::BIGINT AS inertia FROM a{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, distance, cluster_inertia, inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN inertias USING (cluster) JOIN c{ROUNDS} ON k = cluster
"""


ORACLE = _sql()

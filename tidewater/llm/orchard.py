"""Centroid clustering of integer vectors with Orchard's search for the nearest centroid.

Every centroid keeps the other centroids sorted by their distance from it.  A
vector starts at a guess ``c`` and walks along the list of ``c``.  A centroid
that is nearer (or as near, with a smaller number) becomes the new ``c`` and the
walk goes on along its list; centroids already seen are marked and not computed
again.  The walk ends at the first entry that lies strictly beyond twice the
current distance from ``c``: by the triangle inequality neither it nor any later
entry can be as near.  All distances are exact integers, so are the ties.

The vectors of a block walk in step: one turn advances every vector that still
walks, and vectors that reach the same centroid share one subtraction.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import settle, ship_package, slices

#: Vectors that walk together.
BLOCK_ROWS = 4096


class Orchard:
    """Centroids with their neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        apart = self.centroids[:, None, :] - self.centroids[None, :, :]
        between = np.einsum("ijd,ijd->ij", apart, apart)
        k = len(self.centroids)
        order = np.argsort(between, axis=1, kind="stable")
        self.neighbours = np.array([[j for j in row if j != i] for i, row in enumerate(order)], np.int64).reshape(k, max(k - 1, 0))
        # Walks compare squares: beyond twice the distance is beyond four times its square.
        self.reach = np.take_along_axis(between, self.neighbours, axis=1)
        self.start = int(between.sum(axis=1).argmin()) if k else 0
        self.computed = 0

    def _distances(self, vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Squared distance of every vector to its own centroid of ``to``."""
        self.computed += len(to)
        out = np.empty(len(to), np.int64)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                d = vectors[part] - self.centroids[to[part[0]]]
                out[part] = np.einsum("ij,ij->i", d, d)
        return out

    def nearest(self, vectors: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of every vector; ties go to the smaller number."""
        vectors = np.asarray(vectors, np.int64)
        n, k = len(vectors), len(self.centroids)
        at = np.full(n, self.start, np.int64) if guess is None else np.asarray(guess, np.int64).copy()
        best = self._distances(vectors, at)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), at] = True
        step = np.zeros(n, np.int64)
        walking = np.arange(n) if k > 1 else np.empty(0, np.int64)
        while len(walking):
            here, turn = at[walking], step[walking]
            going = self.reach[here, turn] <= 4 * best[walking]
            walking = walking[going]
            if not len(walking):
                break
            to = self.neighbours[here[going], turn[going]]
            step[walking] += 1
            fresh = ~seen[walking, to]
            rows, to = walking[fresh], to[fresh]
            if len(rows):
                seen[rows, to] = True
                d = self._distances(vectors[rows], to)
                nearer = (d < best[rows]) | ((d == best[rows]) & (to < at[rows]))
                moved = rows[nearer]
                at[moved], best[moved], step[moved] = to[nearer], d[nearer], 0
            walking = walking[step[walking] < k - 1]
        return at, best


def largest(dim: int) -> int:
    """Magnitude a component may have so that four times a squared distance is still an exact long (2^26 at 64 components)."""
    return min(math.isqrt((1 << 62) // (4 * dim)) // 2, (1 << 31) - 1)


def usable(vector: str, dim: int) -> Column:
    """Exactly ``dim`` components, none NULL or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def _matrix(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _seeds(kept: DataFrame, k: int, seed: int) -> list[tuple[int, ...]]:
    """At most ``k`` vectors: those with the smallest hash of ``seed:key``; equal hashes (repeated keys) by their vector."""
    hashed = kept.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256))
    return [tuple(r["v"]) for r in hashed.orderBy("hash", F.col("key").asc_nulls_last(), "v").limit(k).select("v").collect()]


def _next_centroids(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every centroid's vectors; a centroid without vectors stays."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for part in slices(batch, BLOCK_ROWS):
                vectors = _matrix(part, "v", dim).astype(np.int64)
                at, _ = search.nearest(vectors)
                for c in np.unique(at):
                    own = vectors[at == c]
                    count[c] += len(own)
                    total[c] += own.sum(axis=0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": np.repeat(full, dim),
                "component": np.tile(np.arange(dim), len(full)),
                "n": np.repeat(count[full], dim),
                "total": total[full].reshape(-1),
            },
            schema=pa.schema([("cluster", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("total", pa.int64())]),
        )

    partial = kept.select("v").mapInArrow(sums, "cluster long, component long, n long, total long")
    # A task's sums fit a long; the whole table's are added as decimals.
    whole = partial.groupBy("cluster", "component").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    )
    out = centroids.copy()
    for r in whole.collect():  # k * dim rows
        out[r["cluster"], r["component"]] = int(r["total"]) // int(r["n"])
    return out


def digest(centroid: np.ndarray) -> str:
    """Lowercase hex SHA-256 of the components, in decimal, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(
    rows: DataFrame,
    k: int = 16,
    rounds: int = 3,
    scale: int = 64,
    dim: int = 64,
    seed: int = 1,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Every usable row with its cluster, its squared distance, and the inertia of its cluster and of all.

    Components become the integer ``floor(scale * x)``.  Centroids start as the
    ``k`` vectors with the smallest SHA-256 of ``seed:key``, in hash order;
    ``rounds`` times every vector goes to its nearest centroid (ties: smaller
    number) and every centroid to the exact floor of its vectors' mean, an empty
    one stays; then vectors are assigned once more.

    Returns key, cluster, distance, cluster_inertia, inertia, centroid_sha256,
    one row per usable input row (repeated keys and rows each count); other
    columns take no part.  Rows whose vector is NULL, of another length than
    ``dim``, or holds a NULL or non-finite component are left out.  A NULL key
    hashes as ``seed:``.  Equal hashes are ordered by key, then by vector.
    Fewer rows than ``k`` give that many clusters; an empty table gives an empty
    result.  Components beyond ``largest(dim)`` are refused (the query fails):
    their distances would not be exact longs.

    Plan: the table is read once per round and never shuffled; a task sends one
    row of sums per centroid and component; the driver holds k * dim integers.
    """
    spark = rows.sparkSession
    ship_package(spark)
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    checked = F.transform(
        whole, lambda x: F.when(F.abs(x) <= F.lit(float(largest(dim))), x).otherwise(F.raise_error(F.lit("component too large for exact distances")).cast("double"))
    )
    kept = rows.filter(usable(vector, dim)).select(F.col(key).alias("key"), checked.cast("array<int>").alias("v"))
    out_schema = T.StructType(
        [
            T.StructField("key", rows.schema[key].dataType),
            T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()),
        ]
    )
    seeds = _seeds(kept, k, seed)
    centroids = np.array(seeds, np.int64).reshape(len(seeds), dim)
    for _ in range(rounds if seeds else 0):
        centroids = _next_centroids(kept, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for batch in batches:
            for part in slices(batch, BLOCK_ROWS):
                at, distance = search.nearest(_matrix(part, "v", dim))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(at, pa.int32()), pa.array(distance, pa.int64())], ["key", "cluster", "distance"])

    assigned = settle(kept.mapInArrow(assign, out_schema))
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # at most k rows
    every = sum(int(r["inertia"]) for r in inertia)
    facts = spark.createDataFrame(
        [(r["cluster"], int(r["inertia"]), every, digest(centroids[r["cluster"]])) for r in inertia],
        "own int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # At most k rows.
    joined = assigned.join(F.broadcast(facts), F.col("cluster") == F.col("own"))
    return joined.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

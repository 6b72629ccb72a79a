"""Centroid clustering: Lloyd's rounds with bounds that geometry tightens.

Vectors are integer lattice points.  Each vector carries its cluster, an upper bound of the distance to
its centroid and a lower bound of the distance to any other.  After the centroids move, the upper bound
grows by the drift of its own.  The lower bound need not fall by the largest drift of the others: all
vectors of a cluster lie in a sphere around its old centroid, and in the plane of that centre and the two
places of another centroid the vectors that come nearer most lie where the sphere touches a ray from the
middle between the two places.  With ``theta`` the angle there between the ray and the drift, no vector
comes nearer by more than ``drift * cos(theta)``, as

    |x - a| - |x - b| = 2 <x - m, b - a> / (|x - a| + |x - b|) <= |b - a| * cos(theta),  m = (a + b) / 2.

A vector whose upper bound stays below its lower bound, or below half the distance to the next centroid,
keeps its cluster unseen.  The others are measured exactly: first against their own centroid, then, where
that leaves doubt, against all.  Distances are exact integers; bounds are floating numbers with room for
rounding, so the result is that of exhaustive rounds.

Each round reads the vectors with their state, writes them to the shared folder and deletes the round
before; sums, counts and radii are partial aggregates of one row per cluster.  The driver holds the
centroids alone.

Defined results: vectors of another number of components, or with a null or non-finite one, are left out,
as are null vectors; components of 2**17 and more are refused, so that distances fit 64 bits; fewer vectors
than clusters are a cluster each at first; ties go to the smaller number; null ids hash as the empty text,
and equal hashes are taken in the order of their vectors; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.lineage import drop_table, write_table

COMPONENTS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
_LARGEST = 1 << 17
#: Room for rounding in bounds.
_UP, _DOWN = 1 + 1e-11, 1 - 1e-11
#: Components up to this size have exact sums of products in floating numbers.
_EXACT = 1 << 22


def lattice(vectors: DataFrame, id_col: Column, vector_col: Column, components: int = COMPONENTS) -> DataFrame:
    """``id, v``: the whole vectors as integers ``floor(SCALE * x)``."""
    vector = vector_col.cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = (F.size(vector) == components) & finite
    too_large = F.raise_error(F.lit(f"a vector component is {_LARGEST} or more"))
    number = lambda x: F.when(F.abs(x) < _LARGEST, F.floor(x * SCALE).cast("int")).otherwise(too_large.cast("int"))
    return vectors.where(whole).select(id_col.alias("id"), F.transform(vector, number).alias("v"))


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch["v"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT:
        points, centres = vectors.astype(np.float64), centroids.astype(np.float64)
        products = (points @ centres.T).astype(np.int64)
        return np.einsum("ij,ij->i", vectors, vectors)[:, None] - 2 * products + np.einsum("ij,ij->i", centroids, centroids)
    return np.stack([((vectors - centre) ** 2).sum(axis=1) for centre in centroids], axis=1)


@dataclass(frozen=True)
class Move:
    """What a round does to the bounds: per cluster, the growth of the upper and the fall of the lower one,
    and half the distance to the next centroid."""

    drift: np.ndarray
    loosened: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
        before, after = old.astype(np.float64), new.astype(np.float64)
        count = len(before)
        drift = np.sqrt(((after - before) ** 2).sum(axis=1)) * _UP
        loosened = np.zeros(count)
        for other in range(count):
            if not drift[other]:
                continue
            arm = before - (before[other] + after[other]) / 2
            reach = np.sqrt((arm**2).sum(axis=1))
            along = arm @ (after[other] - before[other])
            fall = np.full(count, drift[other])
            outside = reach > radius * _UP
            angle = np.arccos(np.clip(along[outside] / (reach[outside] * drift[other]), -1, 1))
            angle -= np.arcsin(radius[outside] * _UP / reach[outside])
            fall[outside] *= np.clip(np.cos(np.maximum(angle, 0)), 0, 1)
            fall[outside] += drift[other] * 1e-7
            fall[other] = 0
            np.maximum(loosened, np.minimum(fall, drift[other]), out=loosened)
        gaps = np.sqrt(squared(new, new).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        return cls(drift, loosened, gaps.min(axis=1) / 2 * _DOWN)


def assign(
    vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, move: Move | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Clusters and bounds after a move (None: nothing is known yet), and how many vectors were measured
    against all centroids."""
    if move is None:
        doubtful = np.arange(len(vectors))
    else:
        upper = (upper + move.drift[cluster]) * _UP
        lower = np.maximum((lower - move.loosened[cluster]) * _DOWN, 0)
        safe = np.maximum(lower, move.half[cluster])
        doubtful = np.flatnonzero(upper >= safe)
        gap = vectors[doubtful] - centroids[cluster[doubtful]]
        upper[doubtful] = np.sqrt((gap * gap).sum(axis=1).astype(np.float64)) * _UP
        doubtful = doubtful[upper[doubtful] >= safe[doubtful]]
    cluster = cluster.copy()
    if len(doubtful):
        far = squared(vectors[doubtful], centroids)
        nearest = far.argmin(axis=1)
        cluster[doubtful] = nearest
        rows = np.arange(len(doubtful))
        upper[doubtful] = np.sqrt(far[rows, nearest].astype(np.float64)) * _UP
        far[rows, nearest] = np.iinfo(np.int64).max
        second = far.min(axis=1).astype(np.float64)
        lower[doubtful] = np.where(len(centroids) > 1, np.sqrt(second) * _DOWN, np.inf)
    return cluster, upper, lower, len(doubtful)


_STATE = "v array<int>, cluster int, upper double, lower double, measured int"


def _round(centroids: np.ndarray, move: Move | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if move is None:
                state = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            else:
                state = batch["cluster"].to_numpy().astype(np.int64), batch["upper"].to_numpy().copy(), batch["lower"].to_numpy()
            cluster, upper, lower, measured = assign(_vectors(batch), *state, centroids, move)
            counts = np.zeros(batch.num_rows, np.int32)
            counts[0] = measured
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["v"], pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(counts)],
                ["id", "v", "cluster", "upper", "lower", "measured"],
            )

    return apply


def _measure(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gap = _vectors(batch) - centroids[batch["cluster"].to_numpy()] if batch.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["cluster"], pa.array((gap * gap).sum(axis=1))], ["id", "cluster", "distance"]
            )

    return apply


def _centroids(state: DataFrame, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The means of the clusters, rounded down, and the radii around the old ones (empty clusters stay),
    and how many vectors were measured."""
    size = old.shape[1]
    sums = F.array(*[F.sum(F.get("v", F.lit(i)).cast("long")) for i in range(size)])
    new, radius, measured = old.copy(), np.zeros(len(old)), 0
    found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("upper").alias("radius"), F.sum("measured").alias("measured"), sums.alias("sums"))
    for row in found.collect():
        new[row.cluster] = [total // row.n for total in row.sums]
        radius[row.cluster] = row.radius
        measured += row.measured
    return new, radius, measured


@dataclass(frozen=True)
class Clustering:
    """``members``: id, cluster, distance (squared) per vector; ``centroids``: a row of integers per cluster;
    ``measured``: per round, how many vectors were measured against all centroids."""

    members: DataFrame
    centroids: np.ndarray
    measured: list[int]


def cluster(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3) -> Clustering:
    """``rounds`` rounds over ``points`` (id, v), then a last assignment.  The first centroids are the
    points of the least SHA-256 of ``<seed>:<id>``."""
    kind = points.schema["id"].dataType.simpleString()
    points = write_table(points)
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = points.orderBy(rank, "v").limit(clusters).select("v").collect()
    if not first:
        return Clustering(points.selectExpr("id", "0 cluster", "0L distance").limit(0), np.zeros((0, COMPONENTS), np.int64), [])
    centroids = np.array([row.v for row in first], np.int64)
    state, move, measured = points, None, []
    for turn in range(rounds + 1):
        before, state = state, write_table(state.mapInArrow(_round(centroids, move), f"id {kind}, {_STATE}"))
        drop_table(before)
        new, radius, count = _centroids(state, centroids)
        measured.append(count)
        if turn == rounds or np.array_equal(new, centroids):  # nothing moves any more
            break
        move, centroids = Move.between(centroids, new, radius), new
    members = write_table(state.mapInArrow(_measure(centroids), f"id {kind}, cluster int, distance long"))
    drop_table(state)
    return Clustering(members, centroids, measured)


def oracle() -> str:
    """The query's result in SQL: every round measures every vector against every centroid."""
    parts = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {COMPONENTS})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= {CLUSTERS})""",
    ]
    for turn in range(ROUNDS + 1):
        parts.append(
            f"""a{turn} AS MATERIALIZED (
            SELECT vec_id, min(kept.v) AS v, min([list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c]) AS near
            FROM kept CROSS JOIN c{turn} c GROUP BY vec_id)"""
        )
        if turn < ROUNDS:
            parts.append(
                f"""m{turn} AS MATERIALIZED (
            SELECT c, list(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END ORDER BY i) AS v FROM (
              SELECT near[2] AS c, i, sum(v[i])::BIGINT AS total, count(*) AS n FROM a{turn}, range(1, {COMPONENTS + 1}) r(i) GROUP BY ALL)
            GROUP BY c),
            c{turn + 1} AS MATERIALIZED (SELECT c, coalesce(m{turn}.v, c{turn}.v) AS v FROM c{turn} LEFT JOIN m{turn} USING (c))"""
            )
    return f"""
        WITH {", ".join(parts)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(near[1] AS BIGINT) AS distance,
               CAST(sum(near[1]) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(near[1]) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(z.v, ',')) AS centroid_sha256
        FROM a{ROUNDS} JOIN c{ROUNDS} z ON c = near[2]
    """

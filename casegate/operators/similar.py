"""Groups of profiles linked by correlation above a threshold, without making the pairs.

A profile is a vector of counts over the tasks; centred and scaled it is a point on a sphere, and the
correlation of two profiles is the cosine of their angle.  Profiles link where that angle is less than
``theta``, the angle of the threshold.

1. *Pivots.*  A few profiles are chosen so that every profile links to one of them: rounds of a small sample
   of what is not covered yet, thinned to profiles that do not link among themselves.  On a sphere of given
   dimension their number has a bound that does not grow with the profiles.
2. *Groups of pivots.*  Every profile is measured against the pivots.  Pivots that one profile links to are
   in one group; a task reports a spanning forest of them.
3. *Borders.*  Left are links between groups, of two profiles that are no pivots.  With ``Q`` the pivot next
   to ``y``, the triangle inequality allows a link of ``x`` and ``y`` only where
   ``angle(x, Q) <= theta + angle(y, Q)``.  Only such profiles of different groups meet, tile by tile, at
   ``Q``, and a tile again reports a forest.

Angles only rule pairs out, with room for rounding; a link is decided by the counts themselves.  Where
profiles are so many and so different that the pivots pass ``MOST_PIVOTS``, the caller has to pair them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.lineage import cut_lineage

#: Profiles that a round looks at for new pivots.
SAMPLE = 512
MOST_PIVOTS = 20_000
#: Profiles of a side of a tile.
TILE = 1_024
_SLACK = 1e-7


def correlations(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pearson correlation of every row of counts with every other; of constant rows, nan."""
    tasks = left.shape[1]
    sums_left, sums_right = left.sum(axis=1), right.sum(axis=1)
    spread_left = (tasks * (left * left).sum(axis=1) - sums_left**2).astype(np.float64)
    spread_right = (tasks * (right * right).sum(axis=1) - sums_right**2).astype(np.float64)
    dots = _products(left, right)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (tasks * dots - sums_left[:, None] * sums_right).astype(np.float64) / np.sqrt(spread_left[:, None] * spread_right)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sums of products, by floating numbers where those are exact."""
    if left.size and right.size and float(left.max()) * float(right.max()) * left.shape[1] < 2**53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def angles(correlation: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.nan_to_num(correlation, nan=-1.0), -1, 1))


class Forest:
    """Links among ``count`` nodes, kept as a spanning forest."""

    def __init__(self, count: int):
        self.parent = list(range(count))
        self.links: list[tuple[int, int]] = []

    def root(self, node: int) -> int:
        while self.parent[node] != node:
            self.parent[node] = node = self.parent[self.parent[node]]
        return node

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((min(a, b), max(a, b)))


def _counts(batch: pa.RecordBatch, name: str = "counts") -> np.ndarray:
    return batch[name].flatten().to_numpy().reshape(batch.num_rows, -1)


def thinned(counts: np.ndarray, threshold: float) -> list[int]:
    """Rows that do not link among themselves, each other row linking to one of them."""
    linked = correlations(counts, counts) > threshold
    kept: list[int] = []
    for row in range(len(counts)):
        if not linked[row, kept].any():
            kept.append(row)
    return kept


def _uncovered(pivots, threshold: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known = pivots.value
                alone = ~(correlations(_counts(batch), known) > threshold).any(axis=1) if len(known) else np.ones(batch.num_rows, bool)
                yield batch.filter(pa.array(alone))

    return apply


def pivots_of(profiles: DataFrame, threshold: float) -> np.ndarray | None:
    """Profiles (rows of counts) of which each profile links to one; None where they are too many."""
    context = profiles.sparkSession.sparkContext
    tasks = None
    pivots: np.ndarray = np.zeros((0, 0), np.int64)
    left = profiles
    while True:
        sample = left.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
        if not sample:
            return pivots
        counts = np.array([row.counts for row in sample], np.int64)
        tasks = tasks or counts.shape[1]
        fresh = counts[thinned(counts, threshold)]
        pivots = np.concatenate([pivots.reshape(-1, tasks), fresh])
        if len(pivots) > MOST_PIVOTS:
            return None
        # what is left shrinks from round to round, so a round reads only what the one before left
        left = cut_lineage(left.mapInArrow(_uncovered(context.broadcast(fresh), threshold), left.schema))


def _measure(pivots, threshold: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = correlations(_counts(batch), pivots.value)
            nearest = np.nan_to_num(found, nan=-2.0).argmax(axis=1)
            away = angles(found[np.arange(len(found)), nearest])
            yield pa.RecordBatch.from_arrays(
                [batch["v"], batch["counts"], pa.array(nearest.astype(np.int32)), pa.array(away)], ["v", "counts", "pivot", "away"]
            )

    return apply


def _links(pivots, threshold: float):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(len(pivots.value))
        for batch in batches:
            if not batch.num_rows:
                continue
            linked = correlations(_counts(batch), pivots.value) > threshold
            for row in np.flatnonzero(linked.sum(axis=1) > 1):
                first, *others = np.flatnonzero(linked[row]).tolist()
                for other in others:
                    forest.link(first, other)
        if forest.links:
            a, b = zip(*forest.links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["a", "b"])

    return apply


def _borders(pivots, groups, radii, theta: float):
    """Profiles at the pivots of other groups where a link is possible."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = angles(correlations(_counts(batch), pivots.value))
            own = groups.value[batch["pivot"].to_numpy()]
            near = (away <= theta + radii.value + _SLACK) & (own[:, None] != groups.value)
            row, at = np.nonzero(near)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [taken["pivot"], taken["counts"], pa.array(at.astype(np.int32)), pa.array(away[row, at])], ["pivot", "counts", "at", "from_at"]
            )

    return apply


def _meet(threshold: float):
    """Links between the visitors of a tile and the members it holds, as links of their pivots."""

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs: set[tuple[int, int]] = set()
        if left.num_rows and right.num_rows:
            visitors, members = left.combine_chunks().to_batches()[0], right.combine_chunks().to_batches()[0]
            linked = correlations(_counts(visitors), _counts(members)) > threshold
            a, b = visitors["pivot"].to_numpy(), members["pivot"].to_numpy()
            row, column = np.nonzero(linked)
            pairs = set(zip(a[row].tolist(), b[column].tolist(), strict=True))
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int32()), "b": pa.array([y for _, y in pairs], pa.int32())})

    return apply


def _grouped(links: list[tuple[int, int]], count: int) -> np.ndarray:
    forest = Forest(count)
    for a, b in links:
        forest.link(a, b)
    return np.array([forest.root(node) for node in range(count)], np.int32)


def correlated_groups(profiles: DataFrame, threshold: float) -> DataFrame | None:
    """``v, component``: of ``profiles`` (``v``, unique; ``counts``: array of long, of equal lengths) the
    least ``v`` that links reach.  Constant profiles link to nothing.  None where pivots are too many."""
    spark = profiles.sparkSession
    context = spark.sparkContext
    profiles = cut_lineage(profiles)
    varied = F.array_min("counts") != F.array_max("counts")
    points = profiles.where(varied)
    pivots = pivots_of(points, threshold)
    if pivots is None:
        return None
    lone = profiles.where(~varied).select("v", F.col("v").alias("component"))
    if not len(pivots):
        return lone
    shared = context.broadcast(pivots)
    placed = cut_lineage(points.mapInArrow(_measure(shared, threshold), "v string, counts array<long>, pivot int, away double"))
    # forests of pivots: their number is bounded, not that of the profiles
    links = [tuple(r) for r in points.mapInArrow(_links(shared, threshold), "a int, b int").distinct().collect()]
    groups = _grouped(links, len(pivots))
    if len(set(groups.tolist())) > 1:
        links += _border_links(placed, shared, groups, threshold)
        groups = _grouped(links, len(pivots))
    table = spark.createDataFrame(list(enumerate(groups.tolist())), "pivot int, grouped int")
    members = placed.join(F.broadcast(table), "pivot")  # at most MOST_PIVOTS rows
    least = members.groupBy("grouped").agg(F.min("v").alias("component"))
    return members.join(F.broadcast(least), "grouped").select("v", "component").unionByName(lone)


def _border_links(placed: DataFrame, pivots, groups: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between groups of pivots, by the profiles next to them."""
    context = placed.sparkSession.sparkContext
    theta = math.acos(max(-1.0, min(1.0, threshold)))
    radii = np.zeros(len(groups))
    for row in placed.groupBy("pivot").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radii[row.pivot] = row.radius
    border = _borders(pivots, context.broadcast(groups), context.broadcast(radii), theta)
    visitors = cut_lineage(placed.mapInArrow(border, "pivot int, counts array<long>, at int, from_at double"))
    # one row per pivot at most, on the driver as the pivots are
    met = {r["at"]: r for r in visitors.groupBy("at").agg(F.min("from_at").alias("nearest"), F.count(F.lit(1)).alias("n")).collect()}
    if not met:
        return []
    spark = placed.sparkSession
    nearest = spark.createDataFrame([(at, r["nearest"]) for at, r in met.items()], "to int, nearest double")
    members = placed.join(F.broadcast(nearest), F.col("pivot") == F.col("to")).where(F.col("away") >= F.col("nearest") - theta - _SLACK)
    sizes = [(r["to"], r["count"]) for r in members.groupBy("to").count().collect()]
    # tiles: each side dealt at random into parts of some TILE profiles, each part beside each of the other side
    tiles = spark.createDataFrame([(at, -(-met[at]["n"] // TILE), -(-n // TILE)) for at, n in sizes], "at int, rows int, columns int")
    left = (
        visitors.join(F.broadcast(tiles), "at")
        .withColumn("row", F.pmod(F.xxhash64("counts", "pivot"), F.col("rows")).cast("int"))
        .select("at", "row", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), "pivot", "counts")
    )
    right = (
        members.withColumnRenamed("to", "at")
        .join(F.broadcast(tiles), "at")
        .withColumn("column", F.pmod(F.xxhash64("counts", "v"), F.col("columns")).cast("int"))
        .select("at", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "column", "pivot", "counts")
    )
    keys = ["at", "row", "column"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meet(threshold), "a int, b int")
    return [tuple(r) for r in found.distinct().collect()]

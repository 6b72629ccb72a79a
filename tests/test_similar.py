"""Groups of correlated profiles against all pairs."""

import numpy as np
import pytest

from casegate.operators import similar
from casegate.operators.roles import count_vectors, profile_groups

SCHEMA = "resource string, activity string, freq long"


def brute(counts, threshold, block=1_000):
    """Components by all pairs: from the first profile not reached yet, all that links reach."""
    centred = counts - counts.mean(axis=1, keepdims=True)
    points = centred / np.linalg.norm(centred, axis=1, keepdims=True)
    component = np.full(len(counts), -1)
    left = np.arange(len(counts))
    while len(left):
        start, reached, left = left[0], [left[0]], left[1:]
        while reached:
            now, reached = reached[:block], reached[block:]
            component[now] = start
            if len(left):
                linked = (points[now] @ points[left].T > threshold).any(axis=0)
                reached += left[linked].tolist()
                left = left[~linked]
    return component.tolist()


def frame(spark, counts):
    return spark.createDataFrame([(f"r{i:06d}", [int(x) for x in row]) for i, row in enumerate(counts)], "v string, counts array<long>")


def groups(found):
    return [int(r.component[1:]) for r in sorted(found.collect())]


def mixtures(rng, count, tasks, kinds, noise):
    """Profiles around a few mixes of tasks; some are between two of them."""
    mixes = rng.dirichlet(np.full(tasks, 0.3), kinds)
    at = rng.integers(0, kinds, (count, 2))
    share = np.where(rng.random(count) < 0.05, rng.random(count), 1)[:, None]
    mixed = mixes[at[:, 0]] * share + mixes[at[:, 1]] * (1 - share)
    return rng.poisson(mixed * 200 + noise * rng.random((count, tasks)))


@pytest.mark.parametrize(
    "seed, count, tasks, kinds, noise, threshold",
    [(1, 300, 6, 4, 5, 0.7), (2, 400, 12, 9, 20, 0.9), (3, 250, 30, 40, 2, 0.5), (4, 300, 3, 5, 30, 0.95), (5, 300, 40, 150, 3, 0.98), (6, 200, 8, 3, 1, 0.0)],
)
def test_groups_equal_all_pairs(spark, monkeypatch, seed, count, tasks, kinds, noise, threshold):
    monkeypatch.setattr(similar, "SAMPLE", 40)
    monkeypatch.setattr(similar, "TILE", 8)
    rng = np.random.default_rng(seed)
    counts = mixtures(rng, count, tasks, kinds, noise)
    counts = counts[counts.min(axis=1) < counts.max(axis=1)]
    assert groups(similar.correlated_groups(frame(spark, counts), threshold)) == brute(counts, threshold)


def test_links_over_a_border(spark, monkeypatch):
    """A chain of profiles, each linking to its neighbours alone: pivots cannot see every link."""
    monkeypatch.setattr(similar, "SAMPLE", 3)
    turn = np.linspace(0, 3, 31)
    plane = np.stack([np.array([1, -1, 0]) / 2**0.5, np.array([1, 1, -2]) / 6**0.5])
    counts = np.rint(1000 + 500 * (np.cos(turn)[:, None] * plane[0] + np.sin(turn)[:, None] * plane[1])).astype(np.int64)
    counts = np.delete(counts, [10, 11, 20], axis=0)
    for threshold in (0.993, 0.97, 0.9):
        assert groups(similar.correlated_groups(frame(spark, counts), threshold)) == brute(counts, threshold)


def test_constant_and_single_profiles(spark):
    found = similar.correlated_groups(frame(spark, [[2, 2, 2], [5, 5, 5], [1, 2, 3], [2, 4, 6], [3, 2, 1]]), 0.5)
    assert groups(found) == [0, 1, 2, 2, 4]
    assert groups(similar.correlated_groups(frame(spark, [[1, 1]]), 0.5)) == [0]
    assert similar.correlated_groups(frame(spark, []), 0.5).count() == 0


def test_many_different_profiles_are_paired(spark, monkeypatch):
    monkeypatch.setattr(similar, "MOST_PIVOTS", 3)
    rows = [(f"r{i:06d}", f"t{i % 6}", 3) for i in range(12)]
    found = profile_groups(spark.createDataFrame(rows, SCHEMA), 0.5)
    assert groups(found) == [0, 1, 2, 3, 4, 5] * 2


def test_count_vectors_go_by_task(spark):
    rows = [("a", "y", 2), ("b", "x", 1), ("b", "z", 4)]
    found = {r.v: r.counts for r in count_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"a": [0, 2, 0], "b": [1, 0, 4]}


def test_a_hundred_thousand_profiles(spark):
    counts = mixtures(np.random.default_rng(7), 100_000, 10, 14, 4)
    counts = np.unique(counts[counts.min(axis=1) < counts.max(axis=1)], axis=0)
    assert len(counts) > 95_000
    profiles = frame(spark, counts)
    found = groups(similar.correlated_groups(profiles, 0.7))
    assert found == brute(counts, 0.7)

"""Quartiles of processing times against numpy."""

import random

import numpy as np
import pytest

from casegate.operators.metrics import processing_time_distribution


def test_quartiles_are_exact_for_hot_missing_and_single_labels(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(40)) for _ in range(500)] + [(None, rng.randrange(10**6)) for _ in range(37)]
    rows += [("one", 7), ("gap", None), ("gap", 3), ("gap", 4), ("never", None)]
    found = processing_time_distribution(spark.createDataFrame(rows, "outcome_label string, processing_us long"))
    table = {r["outcome_label"]: r for r in found.collect()}
    assert set(table) == {"hot", None, "one", "gap", "never"}
    for name, row in table.items():
        own = [t for n, t in rows if n == name]
        assert row["cases"] == len(own)
        times = [t for t in own if t is not None]
        wanted = np.percentile(times, [0, 25, 50, 75, 100]).tolist() if times else [None] * 5
        assert list(row)[2:] == (pytest.approx(wanted) if times else wanted)
    assert processing_time_distribution(spark.createDataFrame([], "outcome_label string, processing_us long")).count() == 0

"""Grid search over learner settings."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.operators.learn import LearnSettings
from casegate.operators.refit import refits
from casegate.schema import KO_KEY

# What is tried when no grid is given.
DEFAULT_GRIDS = {
    "RIPPER": {
        "prune_size": [0.5, 0.8, 0.9],
        "k": [2],
        "dl_allowance": [1, 2, 4, 8],
        "n_discretize_bins": [10, 20],
    },
    "IREP": {"prune_size": [0.5, 0.8, 0.9], "n_discretize_bins": [10, 20]},
}
TIME_FOLDS = 3
RANDOM_FOLDS = 5


def combinations(grid: Mapping[str, Sequence], algorithm: str) -> list[dict]:
    """All settings of a grid, without those the algorithm does not have."""
    unknown = {"k", "dl_allowance"} if algorithm == "IREP" else set()
    known = {f.name for f in fields(LearnSettings)} - unknown
    names = [n for n in grid if n in known]
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def grid_scores(
    cases: DataFrame,
    kos: Sequence[str],
    features: Sequence[str],
    algorithm: str = "RIPPER",
    grid: Mapping[str, Sequence] | None = None,
    settings: LearnSettings = LearnSettings(),
    time_aware: bool = True,
) -> DataFrame:
    """Mean score of each check and setting over folds.

    Time-aware: three expanding folds and F1.  Otherwise five stratified folds and balanced accuracy.
    A fold without any case of a class scores 0.
    """
    choices = [replace(settings, **c) for c in combinations(grid or DEFAULT_GRIDS[algorithm], algorithm)]
    tasks = [(ko, choice) for choice in choices for ko in kos]
    scores: dict[tuple, list[float]] = {}
    for one in refits(cases, tasks, features, algorithm, TIME_FOLDS if time_aware else RANDOM_FOLDS, time_aware):
        score = f1(one.tp, one.fp, one.fn) if time_aware else balanced(one.tp, one.fp, one.fn, one.tn)
        scores.setdefault((one.ko, one.settings), []).append(score)
    names = [f.name for f in fields(LearnSettings) if f.name in (grid or DEFAULT_GRIDS[algorithm])]
    names = [n for n in names if n in combinations(grid or DEFAULT_GRIDS[algorithm], algorithm)[0]]
    kinds = {"prune_size": "double", "dl_allowance": "double"}
    rows = [
        (ko, *(float(v) if kinds.get(n) else v for n in names for v in [getattr(choice, n)]), sum(own) / len(own))
        for (ko, choice), own in scores.items()
    ]
    schema = ", ".join(f"{n} {kinds.get(n, 'int')}" for n in names)
    return cases.sparkSession.createDataFrame(rows, f"{KO_KEY} string, {schema}{', ' if schema else ''}mean_score double")


def f1(tp: int, fp: int, fn: int) -> float:
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def balanced(tp: int, fp: int, fn: int, tn: int) -> float:
    return (tp / (tp + fn) + tn / (tn + fp)) / 2 if tp + fn and tn + fp else 0.0


def best_settings(
    scores: DataFrame, settings: LearnSettings = LearnSettings()
) -> dict[str, LearnSettings]:
    """The best setting of each check; the first in grid order of equals."""
    names = [c for c in scores.columns if c not in (KO_KEY, "mean_score")]
    rows = scores.groupBy(KO_KEY).agg(
        F.min_by(F.struct(*names), F.struct(-F.round("mean_score", 9), *names)).alias("b")
    )
    return {r[KO_KEY]: replace(settings, **r["b"].asDict()) for r in rows.collect()}

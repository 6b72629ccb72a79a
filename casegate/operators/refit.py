"""Rules learnt afresh for every fold, and how they do on the cases of the fold they have not seen.

Every fold is binned by its own training cases.  All checks, folds and settings learn in lock step
from one count table, which also holds the cases that are scored: the cases themselves are read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegate.errors import RuleLearningError
from casegate.lineage import drop_table, write_table
from casegate.operators import roc
from casegate.operators.learn import LEARNERS, Learner, LearnSettings, ask_all, count_tables
from casegate.operators.rules import Rule
from casegate.operators.splits import stratified_folds, time_folds
from casegate.schema import CASE, KO, KO_KEY

FOLDS = 5


@dataclass(frozen=True)
class Refit:
    """A ruleset of one check, learnt outside a fold and scored on it."""

    ko: str
    fold: int
    settings: LearnSettings
    rules: list[Rule]
    tp: int
    fp: int
    fn: int
    tn: int


def refits(
    cases: DataFrame,
    tasks: Sequence[tuple[str, LearnSettings]],
    features: Sequence[str],
    algorithm: str = "RIPPER",
    folds: int = FOLDS,
    time_aware: bool = True,
) -> list[Refit]:
    """Each ``(check, settings)`` learnt once a fold, in the order of ``tasks`` and folds.

    Time-aware: a fold is learnt from all earlier cases; otherwise folds are stratified by check and
    learnt from all others.  A fold may lack a class: its counts are then 0.  Fewer cases than folds
    need raise ``RuleLearningError``.
    """
    if algorithm not in LEARNERS:
        raise RuleLearningError(f"unknown rule algorithm {algorithm!r}")
    if folds < 1 + (not time_aware):
        raise RuleLearningError(f"too few folds: {folds}")
    if not tasks:
        return []
    if len(cases.take(folds + time_aware)) < folds + time_aware:
        raise RuleLearningError(f"fewer cases than {folds} folds need")
    placed = time_folds(cases, folds) if time_aware else stratified_folds(cases, folds, F.col(KO))
    placed = write_table(placed.select(CASE, KO, "fold", *[F.col(f"`{c}`") for c in features]))
    settings = [own for _, own in tasks]
    sets, tests, number = {}, {}, {}
    for fold in range(1, folds + 1):
        inside = F.col("fold") < fold if time_aware else F.col("fold") != fold
        for bins in sorted({own.n_discretize_bins for own in settings}):
            at = number[fold, bins] = len(number)
            sets[at] = placed.filter(inside), bins
            tests[at] = placed.filter(F.col("fold") == fold)
    seeds = {own.seed for own in settings}
    if len(seeds) > 1:
        raise RuleLearningError("one seed at a time")
    counts = count_tables(sets, features, [own.prune_size for own in settings], seeds.pop(), tests)
    drop_table(placed)
    learners, tried = [], []
    for ko, own in tasks:
        for fold in range(1, folds + 1):
            learners.append(Learner(counts, number[fold, own.n_discretize_bins], ko, own))
            tried.append((ko, fold, own))
    found = ask_all(counts, [LEARNERS[algorithm](one) for one in learners])
    looks = [one.look(rules, test=True) for one, rules in zip(learners, found, strict=True) for rules in ([], rules)]
    seen = ask_all(counts, [asking(looks)])[0]
    results = []
    for (ko, fold, own), one, rules, every, left in zip(tried, learners, found, seen[::2], seen[1::2], strict=True):
        fn, tn = left.counts.p, left.counts.n
        readable = [tuple(counts.binnings[one.table][f].condition(label) for f, label in rule) for rule in rules]
        results.append(Refit(ko, fold, own, readable, every.counts.p - fn, every.counts.n - tn, fn, tn))
    return results


def asking(looks):
    """Only looks, all at once."""
    return (yield looks)


def refit_counts(spark: SparkSession, found: Sequence[Refit]) -> DataFrame:
    """``ko_activity, fold, tp, fp, fn, tn``: a row per check and fold, as ``roc.fold_counts`` gives
    them for rules that stay the same."""
    rows = [(one.ko, one.fold, one.tp, one.fp, one.fn, one.tn) for one in found]
    return spark.createDataFrame(rows, f"{KO_KEY} string, fold int, tp long, fp long, fn long, tn long")


def refit_areas(
    cases: DataFrame,
    settings: Mapping[str, LearnSettings],
    features: Sequence[str],
    algorithm: str = "RIPPER",
    folds: int = FOLDS,
    time_aware: bool = True,
) -> DataFrame:
    """``ko_activity, mean_auc, std_auc``: area under the mean ROC curve of models learnt per fold."""
    found = refits(cases, list(settings.items()), features, algorithm, folds, time_aware)
    return roc.mean_area(roc.fold_rates(refit_counts(cases.sparkSession, found)))

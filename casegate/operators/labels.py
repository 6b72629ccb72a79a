"""Which cases are rejected, and by which check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.errors import NoKnockoutsError
from casegate.operators.filters import cases_ending_with, eventually_follows_cases
from casegate.operators.names import keep_names, names_of
from casegate.schema import ACTIVITY, BY_END, CASE, END, KO, KO_KEY, REJECTED, START, order_key


def rejected_cases(
    log: DataFrame,
    kos,
    post: Sequence[str] = (),
    success: Sequence[str] = (),
    start: str = START,
    end: str = END,
    any_missing: bool = False,
) -> DataFrame:
    """Cases that reach a post-knock-out activity; else those that reach no success
    activity (``any_missing``: not all of them); else those where a check is
    directly followed by the end."""
    if post:
        return eventually_follows_cases(log, [(start, p) for p in post])
    if success:
        passed = eventually_follows_cases(log, [(start, s) for s in success], every=any_missing)
        return log.select(CASE).distinct().join(passed, CASE, "left_anti")
    return cases_ending_with(log, kos, end)


def label_cases(log: DataFrame, rejected: DataFrame, kos, outcomes: Sequence[str]) -> DataFrame:
    """One row per case: rejected or not, and the check that did it.

    The label is the last check, in completion order, up to the first outcome.
    Both are partial aggregates over the few rows that matter; a case without any
    check before the outcome keeps a null label and is still rejected.
    """
    place = order_key(BY_END)
    cuts = (
        log.filter(F.col(ACTIVITY).isin(*outcomes)).groupBy(CASE).agg(F.min(place).alias("_cut"))
    )
    labels = (
        keep_names(log.select(CASE, ACTIVITY, *BY_END), ACTIVITY, kos)
        .join(cuts, CASE, "left")
        .filter(F.col("_cut").isNull() | (place <= F.col("_cut")))
        .groupBy(CASE)
        .agg(F.max_by(ACTIVITY, place).alias(KO))
    )
    flagged = rejected.select(CASE, F.lit(True).alias("_rejected"))
    return (
        log.select(CASE)
        .distinct()
        .join(flagged, CASE, "left")
        .join(labels, CASE, "left")
        .select(
            CASE,
            F.coalesce("_rejected", F.lit(False)).alias(REJECTED),
            F.when(F.col("_rejected"), F.col(KO)).alias(KO),
        )
    )


def label_log(log: DataFrame, labels: DataFrame) -> DataFrame:
    """The label of its case on every event."""
    return log.join(labels, CASE, "left")


def observed_kos(labels: DataFrame) -> DataFrame:
    """Checks that rejected at least one case."""
    return labels.filter(F.col(KO).isNotNull()).select(F.col(KO).alias(KO_KEY)).distinct()


def check_labels(labels: DataFrame):
    """Names of the observed checks; an error if nothing tells cases apart."""
    if labels.filter(~F.col(REJECTED)).isEmpty():
        raise NoKnockoutsError(
            "every case counts as rejected; name negative or positive outcome activities"
        )
    return names_of(labels.select(KO), KO)


def label(log: DataFrame, kos, config) -> DataFrame:
    """Labels of a log under a configuration."""
    outcomes = config.post_knockout_activities or config.success_activities or [config.end_activity]
    rejected = rejected_cases(
        log,
        kos,
        config.post_knockout_activities,
        config.success_activities,
        config.start_activity,
        config.end_activity,
    )
    return label_cases(log, rejected, kos, outcomes)

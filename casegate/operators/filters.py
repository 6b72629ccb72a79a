"""Whole-case filters on the order of activities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegate.lineage import write_table
from casegate.operators.names import keep_names
from casegate.operators.ordered import sequence
from casegate.schema import ACTIVITY, BY_START, CASE, order_key

Pairs = Sequence[tuple[str, str]]


def keep_cases(log: DataFrame, cases: DataFrame, retain: bool = True) -> DataFrame:
    return log.join(cases.select(CASE), CASE, "left_semi" if retain else "left_anti").select(*log.columns)


def eventually_follows_cases(log: DataFrame, pairs: Pairs, every: bool = False) -> DataFrame:
    """Cases where ``a`` occurs before ``b`` for some (or every) pair.

    ``first(a) < last(b)`` holds exactly when such a pair of events exists, so one
    partial aggregate over the mentioned activities is enough.
    """
    firsts = sorted({a for a, _ in pairs})
    lasts = sorted({b for _, b in pairs})
    place = order_key(BY_START)
    ends = (
        log.filter(F.col(ACTIVITY).isin(*{*firsts, *lasts}))
        .groupBy(CASE)
        .agg(
            *[F.min(F.when(F.col(ACTIVITY) == a, place)).alias(f"_first{i}") for i, a in enumerate(firsts)],
            *[F.max(F.when(F.col(ACTIVITY) == b, place)).alias(f"_last{i}") for i, b in enumerate(lasts)],
        )
    )
    met = [
        F.coalesce(F.col(f"_first{firsts.index(a)}") < F.col(f"_last{lasts.index(b)}"), F.lit(False))
        for a, b in pairs
    ]
    together = met[0]
    for condition in met[1:]:
        together = (together & condition) if every else (together | condition)
    return ends.filter(together).select(CASE)


def eventually_follows(log: DataFrame, pairs: Pairs, retain: bool = True) -> DataFrame:
    return keep_cases(log, eventually_follows_cases(log, pairs), retain)


def chained_eventually_follows(log: DataFrame, activities: Sequence[str]) -> DataFrame:
    """Cases where each activity of the chain is eventually followed by the next."""
    if len(activities) < 2:
        return log
    pairs = list(zip(activities, activities[1:]))
    return keep_cases(log, eventually_follows_cases(log, pairs, every=True))


def follows(pairs: Pairs) -> Column:
    """Whether an event and its ``next_activity`` are one of ``pairs``."""
    hit = F.lit(False)
    for b in sorted({b for _, b in pairs}):
        before = sorted(a for a, then in pairs if then == b)
        hit = hit | ((F.col("next_activity") == b) & F.col(ACTIVITY).isin(*before))
    return F.coalesce(hit, F.lit(False))


def told_cases(log: DataFrame, pairs: Pairs) -> DataFrame:
    """The log with ``_met``, whether its case has one of ``pairs``, and the place ``_at`` of the event in the case.
    Cases are told while their rows lie sorted in one task, so they must be whole (see ``sequence``)."""
    stepped = sequence(log, BY_START, {"next_activity": ACTIVITY}, "_at", whole=True)
    return stepped.withColumn("_met", F.max(follows(pairs)).over(Window.partitionBy(CASE)))


def directly_follows_cases(log: DataFrame, pairs: Pairs, whole: bool = False) -> DataFrame:
    """Cases where ``b`` is the very next event after ``a`` for some pair."""
    log = log.select(CASE, ACTIVITY, *BY_START)
    if whole:
        return told_cases(log, pairs).filter(F.col("_met") & (F.col("_at") == 0)).select(CASE)
    return sequence(log, BY_START, {"next_activity": ACTIVITY}).filter(follows(pairs)).select(CASE).distinct()


def directly_follows(log: DataFrame, pairs: Pairs, retain: bool = True, whole: bool = False) -> DataFrame:
    """Unless they are ``whole``, cases are written before the log is joined to them, so that no task holds the
    sorts of both steps."""
    if not whole:
        return keep_cases(log, write_table(directly_follows_cases(log, pairs)), retain)
    met = F.col("_met") & F.col(CASE).isNotNull()
    return told_cases(log, pairs).filter(met if retain else ~met).select(*log.columns)


def cases_ending_with(log: DataFrame, names, end: str) -> DataFrame:
    """Cases where one of ``names`` is directly followed by ``end``."""
    stepped = sequence(log.select(CASE, ACTIVITY, *BY_START), BY_START, leads={"next_activity": ACTIVITY})
    return keep_names(stepped.filter(F.col("next_activity") == end), ACTIVITY, names).select(CASE).distinct()


def next_activity(log: DataFrame) -> DataFrame:
    """The log with the next activity of the case and the time it starts."""
    return sequence(log, BY_START, leads={"next_activity": ACTIVITY, "next_start_ts": "start_ts"})

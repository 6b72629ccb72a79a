"""Work in progress and calendar features of events.

The state of a series (all cases, one task, one role) at a time is the running sum
of its +1/-1 steps, after all steps of that time.  Events and steps are marks on the
time lines of their series: one sweep along them steps the states and reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.lineage import write_table
from casegate.operators.ordered import running_totals, sequence
from casegate.operators.scan import column, scan
from casegate.schema import (
    ACTIVITY,
    BY_START,
    CASE,
    END,
    END_TS,
    RESOURCE,
    SEQ,
    START,
    START_TS,
    micros,
)

ALL_CASES = "cases"


def task_series(task: Column) -> Column:
    return F.concat(F.lit("task "), task)


def role_series(role: Column) -> Column:
    return F.concat(F.lit("role "), role)


def transitions(log: DataFrame) -> DataFrame:
    """Each event twice: when it starts and when it completes."""
    kept = [c for c in log.columns if c not in (START_TS, END_TS)]
    starts = log.select(*kept, F.col(START_TS).alias("ts"), F.lit("start").alias("transition"))
    completes = log.select(*kept, F.col(END_TS).alias("ts"), F.lit("complete").alias("transition"))
    return starts.unionByName(completes)


def state_steps(log: DataFrame) -> DataFrame:
    """Summed steps per series and time.  Times at which some event starts or ends
    are there for its series even if nothing changes, so lookups always hit."""
    inner = ~F.col(ACTIVITY).isin(START, END)
    counted = inner & F.col("role").isNotNull()
    begin, end = micros(START_TS), micros(END_TS)

    def step(series: Column, at: Column, delta: Column) -> Column:
        return F.struct(series.alias("series"), at.alias("t"), delta.cast("long").alias("delta"))

    edge = F.when(F.col(ACTIVITY) == START, 1).when(F.col(ACTIVITY) == END, -1).otherwise(0)
    up, down = F.when(counted, 1).otherwise(0), F.when(counted, -1).otherwise(0)
    none = F.lit(0)
    rows = F.array(
        step(F.lit(ALL_CASES), begin, edge),
        step(F.lit(ALL_CASES), end, none),
        step(F.when(inner, task_series(F.col(ACTIVITY))), begin, up),
        step(F.when(inner, task_series(F.col(ACTIVITY))), end, down),
        step(F.when(inner, role_series(F.col("role"))), begin, up),
        step(F.when(inner, role_series(F.col("role"))), end, down),
        step(F.when(inner, role_series(F.col("n_role"))), end, none),
    )
    return (
        log.select(F.explode(rows).alias("s"))
        .select("s.*")
        .filter(F.col("series").isNotNull())
        .groupBy("series", "t")
        .agg(F.sum("delta").alias("delta"))
    )


def states(steps: DataFrame) -> DataFrame:
    """State of each series at each of its times.

    The steps are written once: the sweep reads them to find, cut and total crowded series.
    """
    return running_totals(write_table(steps), ["series"], "t", ["delta"]).withColumnRenamed("delta", "state")


def role_sizes(log: DataFrame) -> DataFrame:
    return log.filter(F.col("role").isNotNull()).groupBy("role").agg(
        F.count_distinct(RESOURCE).alias("role_size")
    )


#: The states an event reads.
SLOTS = ("st_wip", "end_wip", "st_tsk_wip", "st_busy", "end_busy")


def marks(log: DataFrame) -> Column:
    """An event's places on the time lines: ``slot`` (which state it reads there, if any), ``series``, ``t``
    and ``delta`` (how it changes the state), and the event itself on one of them.  ``log`` has ``role`` and
    ``n_role``."""
    inner = ~F.col(ACTIVITY).isin(START, END)
    counted = inner & F.col("role").isNotNull()
    begin, end = micros(START_TS), micros(END_TS)
    event = F.struct(*[column(c) for c in log.columns if c not in (CASE, SEQ)])
    up, down, none = F.when(counted, 1).otherwise(0), F.when(counted, -1).otherwise(0), F.lit(0)
    edge = F.when(F.col(ACTIVITY) == START, 1).when(F.col(ACTIVITY) == END, -1).otherwise(0)
    task, role, following = task_series(F.col(ACTIVITY)), role_series(F.col("role")), role_series(F.col("n_role"))

    def mark(slot: str | None, series: Column, at: Column, delta: Column, shown: Column | None = None) -> Column:
        return F.struct(
            F.when(inner, F.lit(slot)).alias("slot"),
            series.alias("series"),
            at.alias("t"),
            delta.cast("long").alias("delta"),
            F.when(inner & F.lit(shown is not None), event).alias("event"),
        )

    return F.array(
        mark("st_wip", F.lit(ALL_CASES), begin, edge, event),
        mark("end_wip", F.lit(ALL_CASES), end, none),
        mark("st_tsk_wip", task, begin, up),
        mark(None, task, end, down),
        mark("st_busy", role, begin, up),
        mark(None, role, end, down),
        mark("end_busy", following, end, none),
    )


def wip_features(log: DataFrame) -> DataFrame:
    """Events with case WIP at start and end, task WIP at start, the next task and
    role, and the occupancy of its own role at start and of the next role at end.

    ``log`` has boundaries and a ``role``.  A sweep of the time lines gives every mark its state, after
    all steps of its time; one aggregate brings an event's marks, and with them the event, together.
    """
    # the sweep reads the time lines several times
    stepped = write_table(sequence(log, BY_START, leads={"n_task": ACTIVITY, "n_role": "role"}))
    lines = (
        stepped.select(CASE, SEQ, F.explode(marks(stepped)).alias("m"))
        .select(CASE, SEQ, "m.*")
        .filter(F.col("series").isNotNull() & (F.col("slot").isNotNull() | (F.col("delta") != 0)))
    )
    read = scan(lines, ["series"], ["t"], totals={"state": "delta"}, peers=True).filter(F.col("slot").isNotNull())
    found = (
        read.groupBy(CASE, SEQ)
        .agg(
            F.first("event", ignorenulls=True).alias("event"),
            *[F.max(F.when(F.col("slot") == s, F.col("state"))).alias(s) for s in SLOTS],
        )
        .select(CASE, SEQ, "event.*", *SLOTS)
    )
    sizes = role_sizes(log)
    return (
        found.join(sizes, "role", "left")
        .join(sizes.select(F.col("role").alias("n_role"), F.col("role_size").alias("_next")), "n_role", "left")
        .withColumns(
            {
                "rp_st_oc": F.try_divide("st_busy", "role_size"),
                "rp_end_oc": F.coalesce(F.try_divide("end_busy", "_next"), F.lit(0.0)),
            }
        )
        .select(*log.columns, "n_task", "n_role", "st_wip", "st_tsk_wip", "end_wip", "rp_st_oc", "rp_end_oc")
    )


def role_pool(log: DataFrame, roles: Sequence[str], at_end: bool = False) -> DataFrame:
    """Occupancy of every given role at each event, one column per role.

    All roles are read at the distinct event times only; events join that table
    once.  ``roles`` is the short list of pools the caller wants as columns.
    """
    when, suffix = (END_TS, "_end_oc") if at_end else (START_TS, "_st_oc")
    inner = log.filter(~F.col(ACTIVITY).isin(START, END))
    times = inner.select(micros(when).alias("t")).distinct()
    reads = times.select(
        F.explode(F.array(*[F.struct(role_series(F.lit(r)).alias("series")) for r in roles])).alias("s"), "t"
    ).select("s.series", "t", F.lit(0).cast("long").alias("delta"))
    steps = (
        state_steps(log.withColumn("n_role", F.lit(None).cast("string")))
        .filter(F.col("series").startswith("role "))
        .unionByName(reads)
        .groupBy("series", "t")
        .agg(F.sum("delta").alias("delta"))
    )
    sizes = role_sizes(log).select(role_series(F.col("role")).alias("series"), "role", "role_size")
    names = {r: r.lower().replace(" ", "_") + suffix for r in roles}
    table = (
        states(steps)
        .join(sizes, "series")
        .groupBy("t")
        .agg(
            *[
                F.coalesce(
                    F.max(F.when(F.col("role") == r, F.col("state") / F.col("role_size"))), F.lit(0.0)
                ).alias(name)
                for r, name in names.items()
            ]
        )
    )
    return (
        inner.withColumn("t", micros(when)).join(table, "t", "left").select(*log.columns, *names.values())
    )


def mean_states(log: DataFrame) -> DataFrame:
    """Mean state of all cases and of each task over the distinct times of the log.

    A step at a time counts for that time and all later ones, so the mean is
    ``sum(step * times from there on) / times``; the state need not be known where
    it does not change.
    """
    steps = write_table(state_steps(log.withColumn("n_role", F.lit(None).cast("string"))))
    times = steps.select("t").distinct().withColumn("upto", F.lit(1).cast("long"))
    ranked = running_totals(times, [], "t", ["upto"])
    total = times.agg(F.count(F.lit(1))).scalar()
    return (
        steps.filter(~F.col("series").startswith("role "))
        .join(ranked, "t")
        .groupBy("series")
        .agg(F.sum((F.col("delta") * (total - F.col("upto") + 1)).cast("decimal(38,0)")).alias("_sum"))
        .select("series", F.try_divide(F.col("_sum").cast("double"), total).alias("mean_state"))
    )


def calendar_features(log: DataFrame, both_ends: bool = True) -> DataFrame:
    """Second of day, weekday (Monday is 0) and month at start and, if asked, end."""

    def parts(ts: str, prefix: str) -> dict[str, Column]:
        return {
            f"{prefix}_daytime": F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts),
            f"{prefix}_weekday": F.weekday(ts),
            f"{prefix}_month": F.month(ts),
        }

    added = parts(START_TS, "st")
    if both_ends:
        added |= parts(END_TS, "end")
    return log.withColumns(added)

"""Waiting-time waste: how long passing cases idle at a resource while it works on
cases that a check will reject.

For each check and resource this is the total overlap between idle intervals of
passing cases and work intervals of rejected ones.  Let ``G(t)`` be the idle time
accumulated at the resource up to ``t``.  A work interval [s, e] overlaps
``G(e) - G(s)`` of it.  So one time line per resource carries the idle intervals,
and each work interval reads it twice under its own check: no pairs, and no copy
of the idle intervals per check.

The line is a segmented scan per resource.  Times enter its sums as whole minutes and the rest, so that
the sums stay longs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.lineage import write_table
from casegate.operators.names import names_frame
from casegate.operators.ordered import sequence
from casegate.operators.scan import scan
from casegate.schema import (
    ACTIVITY,
    BY_START,
    CASE,
    END_TS,
    KO,
    KO_KEY,
    MICROS_PER_SECOND,
    REJECTED,
    RESOURCE,
    SEQ,
    START_TS,
    micros,
)

BIG = "decimal(38,0)"
MINUTE = 60 * MICROS_PER_SECOND


def idle_intervals(log: DataFrame) -> DataFrame:
    """Gaps between the end of an event and the next start in a passing case."""
    passing = log.filter(~F.col(REJECTED)).select(CASE, SEQ, ACTIVITY, RESOURCE, START_TS, END_TS)
    stepped = sequence(passing, BY_START, leads={"next_start_ts": START_TS})
    return stepped.filter(F.col("next_start_ts") > F.col(END_TS))


def waiting_time_waste(log: DataFrame, kos) -> DataFrame:
    names = names_frame(log.sparkSession, kos, KO_KEY)
    if RESOURCE not in log.columns:
        return names.withColumn("waiting_waste_us", F.lit(0).cast("long"))

    idle = (
        idle_intervals(log)
        .filter(F.col(RESOURCE).isNotNull())
        .select(
            RESOURCE,
            F.explode(
                F.array(
                    F.struct(micros(END_TS).alias("t"), F.lit(1).cast("long").alias("idle")),
                    F.struct(micros("next_start_ts").alias("t"), F.lit(-1).cast("long").alias("idle")),
                )
            ).alias("p"),
        )
        .select(RESOURCE, "p.*")
        .select(RESOURCE, "t", "idle", F.lit(None).cast("string").alias(KO_KEY), F.lit(0).cast("long").alias("sign"))
    )
    work = (
        log.filter(F.col(KO).isNotNull() & F.col(RESOURCE).isNotNull() & (F.col(END_TS) > F.col(START_TS)))
        .select(
            RESOURCE,
            F.col(KO).alias(KO_KEY),
            F.explode(
                F.array(
                    F.struct(micros(START_TS).alias("t"), F.lit(-1).cast("long").alias("sign")),
                    F.struct(micros(END_TS).alias("t"), F.lit(1).cast("long").alias("sign")),
                )
            ).alias("p"),
        )
        .select(RESOURCE, KO_KEY, "p.*")
        .select(RESOURCE, "t", F.lit(0).cast("long").alias("idle"), KO_KEY, "sign")
    )
    # rows of a resource, time and check count as one; written once, as finding the cuts and the scan read them
    summed = idle.unionByName(work).groupBy(RESOURCE, "t", KO_KEY).agg(F.sum("idle").alias("idle"), F.sum("sign").alias("sign"))
    points = write_table(summed).withColumns(
        {"_minute": F.floor(F.col("t") / F.lit(MINUTE)), "_rest": F.pmod("t", F.lit(MINUTE))}
    )
    # Rows of equal time in one step: a step at t adds nothing to G(t).
    totals = {"_open": "idle", "_minutes": F.col("idle") * F.col("_minute"), "_rests": F.col("idle") * F.col("_rest")}
    read = scan(points, [RESOURCE], ["t"], totals=totals, peers=True).filter(F.col("sign") != 0)
    whole = F.col("_open") * F.col("_minute") - F.col("_minutes")
    reached = whole.cast(BIG) * F.lit(MINUTE) + (F.col("_open") * F.col("_rest") - F.col("_rests"))
    waste = read.groupBy(KO_KEY).agg(F.sum((F.col("sign") * reached).cast(BIG)).cast("long").alias("_w"))
    return names.join(waste, KO_KEY, "left").select(
        KO_KEY, F.coalesce("_w", F.lit(0)).alias("waiting_waste_us")
    )

"""Canonical event log: key column names, boundary names and time arithmetic.

One row is one event.  Key columns have fixed names; every other column is a
free case attribute and passes through each operator untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "case_id"
SEQ = "seq"
ACTIVITY = "activity"
RESOURCE = "resource"
START_TS = "start_ts"
END_TS = "end_ts"
DURATION = "duration_us"

REJECTED = "knocked_out_case"
KO = "knockout_activity"
KO_KEY = "ko_activity"

KEY_COLUMNS = (CASE, SEQ, ACTIVITY, RESOURCE, START_TS, END_TS, DURATION)
LABEL_COLUMNS = (REJECTED, KO)

START = "Start"
END = "End"

BY_START = (START_TS, SEQ)
BY_END = (END_TS, SEQ)

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3_600 * MICROS_PER_SECOND


def utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone, so zone-free timestamps convert without shifts."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a zone-free timestamp (session zone UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def order_key(order) -> Column:
    """The ordering columns as one comparable struct, for min/max/min_by."""
    return F.struct(*[F.col(c) for c in order])


def attributes(df: DataFrame) -> list[str]:
    """Free attribute columns, in schema order."""
    fixed = set(KEY_COLUMNS) | set(LABEL_COLUMNS)
    return [c for c in df.columns if c not in fixed]

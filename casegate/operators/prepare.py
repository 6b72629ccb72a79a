"""From raw rows to the canonical event log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegate.operators.ordered import sequence
from casegate.operators.scan import scan
from casegate.schema import (
    ACTIVITY,
    BY_END,
    BY_START,
    CASE,
    DURATION,
    END,
    END_TS,
    KEY_COLUMNS,
    RESOURCE,
    SEQ,
    START,
    START_TS,
    attributes,
    micros,
)

# Source column names and the key columns they become.
DEFAULT_NAMES = {
    "Case ID": CASE,
    "Activity": ACTIVITY,
    "Resource": RESOURCE,
    "lifecycle:transition": "transition",
    "Start Timestamp": START_TS,
    "Complete Timestamp": END_TS,
}

# Boundary rows some tools write themselves.
NATIVE_BOUNDARIES = ("Start", "End", "start", "end")

# Strftime codes and the matching datetime pattern letters.
PATTERN_LETTERS = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%z": "xx",
    "%j": "DDD",
}


def rename(raw: DataFrame, names: Mapping[str, str] = DEFAULT_NAMES) -> DataFrame:
    """Give the key columns their canonical names; unknown names are left alone."""
    return raw.withColumnsRenamed({old: new for old, new in names.items() if old in raw.columns})


def datetime_pattern(strftime_format: str) -> str:
    """The Spark datetime pattern of a strftime format; other text is quoted."""
    pattern, at = "", 0
    while at < len(strftime_format):
        code = strftime_format[at : at + 2]
        if code in PATTERN_LETTERS:
            pattern, at = pattern + PATTERN_LETTERS[code], at + 2
        else:
            letter = strftime_format[at]
            pattern, at = pattern + (f"'{letter}'" if letter.isalpha() else letter), at + 1
    return pattern


def parse_timestamps(df: DataFrame, columns: Sequence[str], strftime_format: str) -> DataFrame:
    """Text to zone-free timestamps; a zone in the text is read over, not applied."""
    pattern = F.lit(datetime_pattern(strftime_format))
    return df.withColumns({c: F.to_timestamp_ntz(F.col(c), pattern) for c in columns})


def drop_native_boundaries(df: DataFrame) -> DataFrame:
    """Rows without an activity stay."""
    return df.filter(~F.coalesce(F.col(ACTIVITY).isin(*NATIVE_BOUNDARIES), F.lit(False)))


def drop_attributes(df: DataFrame) -> DataFrame:
    """Keep key columns only; the pruning reaches the scan."""
    return df.select(*[c for c in df.columns if c in KEY_COLUMNS])


def keep_tasks(df: DataFrame, element: str = "elementId") -> DataFrame:
    """Simulator exports: keep elements whose id starts with ``Task_``."""
    return df.filter(F.split(F.col(element), "_")[0] == "Task")


def deduplicate(df: DataFrame) -> DataFrame:
    """One of equal rows; a sequence column is not compared, the first of them stays."""
    if SEQ not in df.columns:
        return df.dropDuplicates()
    others = [F.col(f"`{c}`") for c in df.columns if c != SEQ]
    return df.groupBy(*others).agg(F.min(SEQ).alias(SEQ)).select(*[F.col(f"`{c}`") for c in df.columns])


def to_intervals(rows: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Pair ``start``/``complete`` rows (``transition``, ``ts``) first in, first out.

    Each complete row becomes one interval event.  It takes the earliest open
    start of its case and activity, and that row's resource; without one it
    starts when it ends.  Starts that never complete give nothing.

    With a running balance of starts minus completes, a complete without an open
    start is one that takes the balance to a new minimum below zero.  The number
    of those so far is ``-min(balance)``, so the k-th remaining complete pairs
    with the k-th start: a window of two rows on a unique key, which needs no
    shuffle besides that of the running balance.

    ``within``: columns that are the same in all rows of a case and stay in the
    result; rows that are dealt out by them are not shuffled at all.
    """
    keys = [*within, CASE, ACTIVITY]
    extra = [c for c in rows.columns if c not in (*keys, SEQ, RESOURCE, "ts", "transition")]
    opens, closes = (F.col("transition") == "start").cast("long"), (F.col("transition") == "complete").cast("long")
    marked = rows.withColumns({"_open": opens, "_close": closes})
    counted = scan(
        # of a start only time and resource are asked for
        marked.withColumns({c: F.when(F.col("_close") == 1, F.col(f"`{c}`")) for c in extra}),
        keys,
        ["ts", SEQ],
        totals={"_opens": "_open", "_closes": "_close", "_balance": F.col("_open") - F.col("_close")},
        lows={"_low_before": "_balance"},
    )
    low = F.least("_low_before", "_balance")
    paired = F.when(F.col("_open") == 1, F.col("_opens")).when(low == F.col("_low_before"), F.col("_closes") + low)
    # completes without a start have numbers of their own, as many of them would be one window; nulls equal nothing
    placed = counted.withColumn("_k", F.coalesce(paired, -F.col("_closes"))).filter(
        (F.col("_close") == 1) | ((F.col("_open") == 1) & F.col(CASE).isNotNull() & F.col(ACTIVITY).isNotNull())
    )
    both = Window.partitionBy(*keys, "_k")
    of_start = {"_begin": F.col("ts"), "_who": F.col(RESOURCE)}
    met = placed.withColumns({n: F.max(F.when(F.col("_open") == 1, c)).over(both) for n, c in of_start.items()})
    begin = F.coalesce("_begin", "ts")
    return met.filter(F.col("_close") == 1).select(
        *within,
        CASE,
        SEQ,
        ACTIVITY,
        F.when(F.col("_begin").isNotNull(), F.col("_who")).otherwise(F.col(RESOURCE)).alias(RESOURCE),
        begin.alias(START_TS),
        F.col("ts").alias(END_TS),
        (micros("ts") - micros(begin)).alias(DURATION),
        *[F.col(f"`{c}`") for c in extra],
    )


def canonical(df: DataFrame, one_timestamp: bool = False) -> DataFrame:
    """Select into the canonical log.  With one timestamp a row starts when it ends;
    without a sequence column rows are numbered as they are read, file by file.  Such numbers are
    unique, but write the log before it is used twice: they follow the partitions."""
    start = F.col(END_TS) if one_timestamp or START_TS not in df.columns else F.col(START_TS)
    seq: Column = F.col(SEQ).cast("long") if SEQ in df.columns else F.monotonically_increasing_id()
    return df.select(
        F.col(CASE).cast("string").alias(CASE),
        seq.alias(SEQ),
        F.col(ACTIVITY).cast("string").alias(ACTIVITY),
        F.col(RESOURCE).cast("string").alias(RESOURCE),
        start.alias(START_TS),
        F.col(END_TS).alias(END_TS),
        (micros(END_TS) - micros(start)).alias(DURATION),
        *[c for c in attributes(df) if c not in ("transition", "ts")],
    )


def add_boundaries(log: DataFrame) -> DataFrame:
    """Add a ``Start`` row 1 microsecond before and an ``End`` row after each case."""
    tick = F.expr("INTERVAL '0.000001' SECOND")
    span = log.groupBy(CASE).agg(
        F.min(START_TS).alias("_first"),
        F.max(END_TS).alias("_last"),
        F.min(SEQ).alias("_low"),
        F.max(SEQ).alias("_high"),
    )
    edges = F.array(
        F.struct(
            F.lit(START).alias("name"), (F.col("_first") - tick).alias("ts"), (F.col("_low") - 1).alias("seq")
        ),
        F.struct(
            F.lit(END).alias("name"), (F.col("_last") + tick).alias("ts"), (F.col("_high") + 1).alias("seq")
        ),
    )
    rows = span.select(CASE, F.explode(edges).alias("e")).select(
        CASE,
        F.col("e.seq").alias(SEQ),
        F.col("e.name").alias(ACTIVITY),
        F.col("e.name").alias(RESOURCE),
        F.col("e.ts").alias(START_TS),
        F.col("e.ts").alias(END_TS),
        F.lit(0).cast("long").alias(DURATION),
    )
    return log.unionByName(rows, allowMissingColumns=True)


def traces(log: DataFrame, one_timestamp: bool = False) -> DataFrame:
    """Traces as rows: the log with the 0-based place of each event in its case."""
    return sequence(log, BY_END if one_timestamp else BY_START, position="position")

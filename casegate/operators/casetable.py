"""Case-level attribute tables for rule learning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.errors import EmptyLogError
from casegate.lineage import write_table
from casegate.schema import (
    BY_START,
    CASE,
    END_TS,
    KEY_COLUMNS,
    KO,
    LABEL_COLUMNS,
    REJECTED,
    START_TS,
    attributes,
    order_key,
)

# Name parts that mark a column as no rule attribute.
IGNORED_PARTS = ("@", "daytime", "weekday", "month")
IGNORED_PARTS_ANY_CASE = ("id", "activity", "timestamp")


def case_rows(log: DataFrame) -> DataFrame:
    """The first row of each case."""
    rest = [c for c in log.columns if c != CASE]
    return log.groupBy(CASE).agg(F.min_by(F.struct(*rest), order_key(BY_START)).alias("_r")).select(CASE, "_r.*")


def rule_attributes(
    columns: Sequence[str], ignore: Sequence[str] = (), consider: Sequence[str] | None = None
) -> list[str]:
    """Columns rules may use.  An explicit ``consider`` list wins over the name rules."""
    fixed = {*KEY_COLUMNS, *LABEL_COLUMNS, "knockout_prefix"}
    if consider is not None:
        return [c for c in columns if c in consider and c not in fixed]
    unwanted = set(ignore)
    return [
        c
        for c in columns
        if c not in fixed
        and c not in unwanted
        and c.replace(" ", "_") not in unwanted
        and not any(part in c for part in IGNORED_PARTS)
        and not any(part in c.lower() for part in IGNORED_PARTS_ANY_CASE)
    ]


def underscored(df: DataFrame) -> DataFrame:
    """Spaces in column names become underscores."""
    return df.toDF(*[c.replace(" ", "_") for c in df.columns])


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with a numeric type, by schema."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    wanted = columns if columns is not None else df.columns
    return [c for c, t in df.dtypes if c in wanted and t.startswith(kinds)]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns whose every value is a number become doubles; one pass decides."""
    texts = [c for c, t in df.dtypes if c in columns and t == "string"]
    if not texts:
        return df
    misses = not_numbers(df, texts)
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts if misses[c] == 0})


def drop_empty_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop those of ``columns`` that are null throughout."""
    counts = df.agg(*[F.count(c).alias(f"_{i}") for i, c in enumerate(columns)]).first() if columns else {}
    empty = [c for i, c in enumerate(columns) if counts[f"_{i}"] == 0]
    if columns and len(empty) == len(columns):
        raise EmptyLogError("all attribute columns are null")
    return df.drop(*empty)


def last_values(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per case: times and the last non-null value of each column."""
    place = order_key(BY_START)
    return log.groupBy(CASE).agg(
        F.max(START_TS).alias(START_TS),
        F.max(END_TS).alias(END_TS),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns],
    )


def not_numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many texts of each column are no number."""
    if not columns:
        return {}
    no_number = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()) for c in columns]
    return dict(zip(columns, df.agg(*no_number).first(), strict=True))


def case_table(
    log: DataFrame, labels: DataFrame, ignore: Sequence[str] = (), consider: Sequence[str] | None = None
) -> DataFrame:
    """Cases with complete attributes and their label, ready for rule learning.

    Whether a text column holds only numbers, or nothing at all, is decided on the written case rows:
    a text among them that is no number settles it.  Columns without one are counted over the events.
    """
    wanted = rule_attributes(attributes(log), ignore, consider)
    if not wanted:
        raise EmptyLogError("the log has no attribute to learn rules from")
    texts = [c for c, t in log.dtypes if c in wanted and t == "string"]
    rows = write_table(last_values(log, wanted).join(labels.select(CASE, REJECTED, KO), CASE))
    seen = rows.agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(wanted)]).first()
    kept = [c for i, c in enumerate(wanted) if seen[f"_n{i}"]]
    if not kept:
        raise EmptyLogError("all attribute columns are null")
    misses = not_numbers(rows, texts)
    open_ones = [c for c in texts if c in kept and misses[c] == 0]
    if open_ones:
        misses |= not_numbers(log.join(labels.select(CASE), CASE, "left_semi"), open_ones)
    numbers = {c for c in texts if misses[c] == 0}
    table = rows.select(
        CASE,
        START_TS,
        END_TS,
        *[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in kept],
        REJECTED,
        KO,
    ).dropna("any", subset=kept)
    if table.isEmpty():
        raise EmptyLogError("every case has a null attribute")
    return table

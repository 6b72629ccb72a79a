"""Names taken out of the data: activities, checks and resources' roles are the vocabulary of a log.

As Python lists they become literals (hash sets in plans), so membership filters reach the file scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def names_of(df: DataFrame, column: str) -> list[str]:
    """Distinct non-null names of a column, sorted."""
    distinct = df.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return sorted(r["name"] for r in distinct.collect())


def keep_names(df: DataFrame, column: str, names: Iterable[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``names``."""
    return df.filter(F.col(column).isin(list(names)))


def names_frame(spark: SparkSession, names: Iterable[str], column: str) -> DataFrame:
    """The names as a one-column table."""
    return spark.createDataFrame([(n,) for n in names], f"{column} string")

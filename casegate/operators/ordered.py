"""Order-dependent building blocks that hold when one key owns most of the rows.

* ``sequence``        position and next values inside a case
* ``forward_fill``    last known values inside a case
* ``running_totals``  running sums along a time line, per key or global
* ``ordered_totals``  running sums along a global order
* ``dense_index``     0-based global rank under a total order

The first three are segmented scans (``scan.py``): a key that holds more rows than a task should is cut
into pieces.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegate.lineage import cut_lineage
from casegate.operators.scan import scan
from casegate.schema import CASE


def sequence(
    df: DataFrame,
    order: Sequence[str],
    leads: Mapping[str, str] | None = None,
    position: str | None = None,
    key: str = CASE,
    whole: bool = False,
) -> DataFrame:
    """Add, per ``key`` in ``order``, the next value of columns (``leads``: new name -> source) and the
    0-based ``position``.  ``whole``: keys are known to hold no more rows than a task should."""
    return scan(df, [key], order, whole=whole, leads=leads or {}, position=position)


def forward_fill(df: DataFrame, order: Sequence[str], columns: Mapping[str, str], key: str = CASE) -> DataFrame:
    """Add, per ``key`` in ``order``, the last non-null value so far of columns (new name -> source)."""
    return scan(df, [key], order, lasts=columns)


def running_totals(points: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """Replace each of ``values`` by its running total along ``time`` per ``keys``, rows of equal time
    taken in together."""
    sources = {f"_total_{v}": v for v in values}
    totals = scan(points, keys, [time], totals=sources, peers=True)
    return totals.withColumns({v: F.col(f"_total_{v}") for v in values}).select(*points.columns)


def ordered_totals(
    df: DataFrame, order: Sequence[str | Column], totals: Mapping[str, Column | str], by: Sequence[str] = ()
) -> DataFrame:
    """Add running totals (new name -> summed column) along a total ``order``, per ``by``.

    The sort is range partitioned, so no task sees more than its share however the
    rows spread over ``by``.  The sorted rows are checkpointed first: their ids must
    not be computed twice.  Offsets have one row per sort partition and group.
    """
    placed = cut_lineage(df.orderBy(*by, *order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part", *by)
        .agg(*[F.sum(value).alias(f"_sum_{new}") for new, value in totals.items()])
        .select(
            "_part",
            *by,
            *[F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_from_{new}") for new in totals],
        )
    )
    inside = Window.partitionBy("_part", *by).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({f"_in_{new}": F.sum(value).over(inside) for new, value in totals.items()})
    return running.join(offsets, ["_part", *by]).select(
        *df.columns, *[(F.col(f"_from_{new}") + F.col(f"_in_{new}")).alias(new) for new in totals]
    )


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Add the 0-based rank of each row under ``order``, which must be total.

    As in ``ordered_totals``, but the place inside a sort partition is part of the
    id, so only one offset per sort partition is needed and no window.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + inside).alias(name)
    )

"""Equal-frequency bins of numeric attributes, with exact edges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.operators.ordered import ordered_totals
from casegate.operators.rules import Condition


@dataclass(frozen=True)
class Binning:
    """Edges of one attribute; with ``edges`` empty each value is its own bin."""

    feature: str
    edges: tuple[float, ...] = ()
    numeric: bool = True

    def label(self) -> Column:
        """Bin number as text, or the value itself."""
        column = F.col(f"`{self.feature}`")
        if not self.edges:
            return column.cast("string")
        number = F.lit(0)
        for edge in self.edges:
            number = number + (column >= edge).cast("int")
        return number.cast("string")

    def condition(self, label: str) -> Condition:
        if not self.edges:
            if self.numeric:
                return Condition(self.feature, "=", lo=float(label))
            return Condition(self.feature, "=", value=label)
        at = int(label)
        if at == 0:
            return Condition(self.feature, "<", hi=self.edges[0])
        if at == len(self.edges):
            return Condition(self.feature, ">=", lo=self.edges[-1])
        return Condition(self.feature, "between", lo=self.edges[at - 1], hi=self.edges[at])


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value of each numeric column occurs."""
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return (
        doubles.unpivot([], list(columns), "feature", "x")
        .filter(F.col("x").isNotNull())
        .groupBy("feature", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Edge ``i`` of an attribute is its smallest value with at least ``i/bins`` of
    the rows at or below it.  Exact, from running counts over distinct values."""
    counted = ordered_totals(value_counts(df, columns), ["x"], {"reached": "n"}, by=["feature"])
    totals = counted.groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.min("x").alias("low"),
        F.min(F.when(F.col("reached") > F.col("n"), F.col("x"))).alias("second_low"),
    )
    first = F.expr(f"((reached - n) * {bins}) div total + 1")
    last = F.expr(f"least((reached * {bins}) div total, {bins - 1})")
    return (
        counted.join(totals, "feature")
        .withColumns({"_first": first, "_last": last})
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("edge", F.explode(F.sequence("_first", "_last")))
        .select("feature", "edge", "x", "distinct_values", "low", "second_low")
    )


def fit_bins(df: DataFrame, numeric: Sequence[str], other: Sequence[str], bins: int) -> list[Binning]:
    """Bins for the attributes of a case table.  The driver receives at most
    ``bins`` edges per numeric attribute."""
    found: dict[str, set[float]] = {}
    if numeric:
        for row in quantile_edges(df, numeric, bins).collect():
            cuts = found.setdefault(row["feature"], set())
            if row["distinct_values"] > bins:
                cuts.add(row["x"] if row["x"] > row["low"] else row["second_low"])
    return [Binning(c, tuple(sorted(found.get(c, ())))) for c in numeric] + [
        Binning(c, numeric=False) for c in other
    ]

"""Categories as numbers: ordered target statistics, after Prokhorenkova et al. (2018).

Training cases lie in blocks along a hashed permutation.  A case's category becomes the smoothed share
of positive labels among the cases of that category in earlier blocks, so no case sees its own label;
other cases get the share over all training cases.  Counts are partial aggregates per attribute, value
and block; the running totals of a value are at most ``BLOCKS`` rows, however many cases hold it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegate.lineage import drop_table, write_table
from casegate.operators.splits import shuffled

BLOCKS = 64
#: Cases that the overall share counts for.
WEIGHT = 1.0


def block(blocks: int = BLOCKS, seed: int = 0) -> Column:
    return (F.conv(F.substring(shuffled(seed), 1, 6), 16, 10).cast("long") % blocks).cast("int")


def category(column: str) -> Column:
    """A value as a key; a missing value is a category of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


@dataclass(frozen=True)
class TargetCodes:
    """Counts of labels per attribute and value, ready to code cases with."""

    columns: tuple[str, ...]
    table: DataFrame
    prior: float
    weight: float
    blocks: int
    seed: int

    def share(self, positives: Column, cases: Column) -> Column:
        """The smoothed share; the overall one where no case is counted."""
        total = F.coalesce(cases, F.lit(0)) + F.lit(self.weight)
        return (F.coalesce(positives, F.lit(0.0)) + F.lit(self.weight * self.prior)) / total

    def coded(self, cases: DataFrame, names: Sequence[str], ordered: bool) -> DataFrame:
        """``cases`` with a column of ``names`` for each attribute; ``ordered`` for the training cases
        themselves.  Values not trained on get the overall share.  A training case of a frequent value
        meets one of its blocks; the other join is by value, and its frequent values are split at run
        time as the cases are its outer side."""
        own = cases.withColumn("_block", block(self.blocks, self.seed)) if ordered else cases
        for at, (column, name) in enumerate(zip(self.columns, names, strict=True)):
            rows = self.table.filter(F.col("attribute") == at)
            if ordered:
                known = rows.select(F.col("value").alias("_value"), "_block", self.share(F.col("earlier_y"), F.col("earlier_n")).alias(name))
            else:
                known = rows.filter("last").select(F.col("value").alias("_value"), self.share(F.col("all_y"), F.col("all_n")).alias(name))
            own = own.withColumn("_value", category(column)).join(known, ["_value", "_block"] if ordered else ["_value"], "left")
            own = own.withColumn(name, F.coalesce(name, F.lit(self.prior))).drop("_value")
        return own.select(*cases.columns, *names)

    def drop(self) -> None:
        drop_table(self.table)


def target_codes(
    train: DataFrame, columns: Sequence[str], label: str = "_y", weight: float = WEIGHT, blocks: int = BLOCKS, seed: int = 0
) -> TargetCodes:
    """Statistics of a 0-or-1 ``label`` (null counts as 0) over the values of ``columns``."""
    y = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    values = F.array(*[F.struct(F.lit(at).alias("attribute"), category(c).alias("value")) for at, c in enumerate(columns)])
    counts = (
        train.select(block(blocks, seed).alias("_block"), y.alias("y"), F.explode(values).alias("v"))
        .groupBy("v.attribute", "v.value", "_block")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    )
    along = Window.partitionBy("attribute", "value").orderBy("_block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = counts.select(
        "attribute",
        "value",
        "_block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier_n"),
        F.coalesce(F.sum("y").over(before), F.lit(0.0)).alias("earlier_y"),
        F.sum("n").over(whole).alias("all_n"),
        F.sum("y").over(whole).alias("all_y"),
        (F.lead("_block").over(along).isNull()).alias("last"),
    )
    prior = train.agg(F.avg(y)).first()[0]
    return TargetCodes(tuple(columns), write_table(table), prior or 0.0, weight, blocks, seed)


@dataclass
class CodedModel:
    """A fitted pipeline behind target codes."""

    codes: TargetCodes
    names: Sequence[str]
    model: object

    @property
    def stages(self) -> list:
        return self.model.stages

    def transform(self, cases: DataFrame) -> DataFrame:
        return self.model.transform(self.codes.coded(cases, self.names, ordered=False))


@dataclass
class CodedEstimator:
    """A pipeline over target codes of ``columns``, which it finds under ``names``; label in ``_y``."""

    pipeline: object
    columns: Sequence[str]
    names: Sequence[str]

    def fit(self, train: DataFrame) -> CodedModel:
        codes = target_codes(train, self.columns)
        coded = write_table(codes.coded(train, self.names, ordered=True))
        model = self.pipeline.fit(coded)
        drop_table(coded)
        return CodedModel(codes, self.names, model)

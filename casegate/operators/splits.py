"""Train and test splits, samples and folds of a case table, all deterministic.

Random choices rank the cases by an md5 of case id and seed, so they do not
depend on partitioning and are the same in every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.operators.ordered import dense_index
from casegate.schema import CASE, START_TS

TEST_SHARE = 0.2


def shuffled(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(CASE), F.lit(str(seed))))


def temporal_rank(cases: DataFrame) -> DataFrame:
    """Rank of each case by start time."""
    return dense_index(cases, [START_TS, CASE], "time_rank")


def class_rank(cases: DataFrame, label: Column, seed: int) -> DataFrame:
    """Shuffled rank of each case inside its class, and the class size."""
    marked = cases.withColumns({"_class": label.cast("string"), "_key": shuffled(seed)})
    placed = dense_index(marked, ["_class", "_key", CASE], "_rank")
    sizes = placed.groupBy("_class").agg(
        F.count(F.lit(1)).alias("class_size"), F.min("_rank").alias("_from")
    )
    return (
        placed.join(sizes, placed["_class"].eqNullSafe(sizes["_class"]))
        .withColumn("class_rank", F.col("_rank") - F.col("_from"))
        .select(*cases.columns, "class_rank", "class_size")
    )


def temporal_holdout(cases: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """``is_test`` marks the last ``ceil(share * n)`` cases by start time."""
    ranked = temporal_rank(cases)
    total = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn(
        "is_test", F.col("time_rank") >= total - F.ceil(total * F.lit(test_share))
    ).drop("time_rank")


def stratified_holdout(
    cases: DataFrame, label: Column, seed: int = 0, test_share: float = TEST_SHARE
) -> DataFrame:
    """``is_test`` marks a random share of each class."""
    ranked = class_rank(cases, label, seed)
    return ranked.withColumn(
        "is_test", F.col("class_rank") < F.ceil(F.col("class_size") * F.lit(test_share))
    ).drop("class_rank", "class_size")


def balance_classes(cases: DataFrame, label: Column, seed: int = 1) -> DataFrame:
    """A random sample of each class, as large as the smallest class."""
    ranked = class_rank(cases, label, seed)
    smallest = ranked.agg(F.min("class_size")).scalar()
    return ranked.filter(F.col("class_rank") < smallest).drop("class_rank", "class_size")


def time_folds(cases: DataFrame, folds: int) -> DataFrame:
    """``fold`` 0 is only ever trained on; fold ``i`` is tested on all earlier ones."""
    ranked = temporal_rank(cases)
    total = ranked.agg(F.count(F.lit(1))).scalar()
    size = F.floor(total / (folds + 1))
    first = total - size * folds
    return ranked.withColumn(
        "fold",
        F.when(F.col("time_rank") < first, 0)
        .otherwise(F.floor((F.col("time_rank") - first) / size) + 1)
        .cast("int"),
    ).drop("time_rank")


def stratified_folds(cases: DataFrame, folds: int, label: Column, seed: int = 0) -> DataFrame:
    """``fold`` 1 to ``folds``, each with the same share of every class."""
    ranked = class_rank(cases, label, seed)
    return ranked.withColumn("fold", (F.col("class_rank") % folds + 1).cast("int")).drop(
        "class_rank", "class_size"
    )

"""Variants: the activity sequences of the cases.

A variant is kept as rows (variant, position, activity), never as one long list.
Cases are matched to each other by length and two 64-bit order-sensitive
fingerprints, which combine by XOR and so aggregate partially; the steps shown
for a variant are those of its first case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.operators.ordered import dense_index, sequence
from casegate.schema import ACTIVITY, BY_END, CASE

SAME = ("variant_len", "_print_a", "_print_b")


def placed_steps(log: DataFrame) -> DataFrame:
    """Events in completion order: case, position, activity, next activity."""
    return sequence(
        log.select(CASE, ACTIVITY, *BY_END),
        BY_END,
        leads={"next_activity": ACTIVITY},
        position="position",
    ).select(CASE, "position", ACTIVITY, "next_activity")


def case_variants(steps: DataFrame) -> DataFrame:
    """One row per case: length and fingerprints of its sequence."""
    return steps.groupBy(CASE).agg(
        F.count(F.lit(1)).alias("variant_len"),
        F.bit_xor(F.xxhash64("position", ACTIVITY)).alias("_print_a"),
        F.bit_xor(F.xxhash64(F.lit("second"), ACTIVITY, "position")).alias("_print_b"),
    )


def count_variants(cases: DataFrame) -> DataFrame:
    """One row per variant: length, case count, first case."""
    return cases.groupBy(*SAME).agg(
        F.count(F.lit(1)).alias("case_count"), F.min(CASE).alias("first_case")
    )


def sorted_variants(steps: DataFrame) -> DataFrame:
    """Variants numbered by length, then case count (most first), then first case."""
    counted = count_variants(case_variants(steps)).select("variant_len", "case_count", "first_case")
    return dense_index(counted, ["variant_len", F.col("case_count").desc(), "first_case"], "vidx")


def variant_steps(steps: DataFrame, variants: DataFrame) -> DataFrame:
    """The rows of each variant, taken from its first case."""
    first = variants.select("vidx", "variant_len", F.col("first_case").alias(CASE))
    return steps.join(first, CASE).select("vidx", "variant_len", "position", ACTIVITY, "next_activity")


def covered_variants(steps: DataFrame, min_share: float) -> tuple[DataFrame, DataFrame]:
    """Variants holding at least ``min_share`` of all cases, and their cases.

    At most ``1 / min_share`` variants qualify, whatever the size of the log.
    """
    cases = case_variants(steps)
    total = cases.agg(F.count(F.lit(1))).scalar()
    covered = count_variants(cases).filter(F.col("case_count") >= total * F.lit(min_share))
    return covered, cases.join(covered.select(*SAME), list(SAME), "left_semi").select(CASE)


def variant_arrays(steps: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants with their sequence as an array.  For variant tables that are
    bounded, such as the covered ones; a sequence is one case long."""
    first = variants.select("variant_len", "case_count", "first_case", F.col("first_case").alias(CASE))
    return (
        steps.join(first, CASE)
        .groupBy("first_case", "variant_len", "case_count")
        .agg(F.array_sort(F.collect_list(F.struct("position", ACTIVITY))).alias("_s"))
        .select("first_case", "variant_len", "case_count", F.col(f"_s.{ACTIVITY}").alias("variant"))
    )

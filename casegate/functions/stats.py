"""Confidence intervals, ranges and histograms of case attributes."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.operators.casetable import numeric_columns
from casegate.schema import CASE, KO, KO_KEY


def t_tail(x: float, dof: int) -> float:
    """Upper tail of Student's t, by Simpson's rule on the density's finite side."""
    # With x = sqrt(dof) * tan(angle) the density is proportional to cos^(dof-1).
    top = math.atan(x / math.sqrt(dof))
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    steps = 2000
    width = top / steps
    total = sum(
        (1 if i in (0, steps) else 4 if i % 2 else 2) * math.cos(i * width) ** (dof - 1)
        for i in range(steps + 1)
    )
    return 0.5 - scale * total * width / 3


def t_quantile(confidence: float, dof: int) -> float:
    """Two-sided critical value of Student's t, by bisection."""
    low, high = 0.0, 1.0
    tail = (1 - confidence) / 2
    while t_tail(high, dof) > tail:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, dof) > tail else (low, middle)
    return (low + high) / 2


def t_interval(df: DataFrame, column: str, confidence: float = 0.95) -> DataFrame:
    """Confidence interval of a mean."""
    sums = df.agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.count(column).alias("n")
    )
    n = sums.first()["n"]
    factor = t_quantile(confidence, n - 1) if n > 1 else float("nan")
    half = F.col("sd") * factor / F.sqrt("n")
    return sums.select("mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), "n")


def poisson_thresholds() -> list[int]:
    """32-bit cumulative thresholds of a Poisson count with mean 1."""
    thresholds, total, k = [], 0.0, 0
    while k < 13:
        total += math.exp(-1) / math.factorial(k)
        thresholds.append(min(int(total * 2**32), 2**32 - 1))
        k += 1
    return thresholds


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def bootstrap_interval(
    df: DataFrame,
    column: str,
    statistic: Callable[[Column, Column], Column] = weighted_mean,
    alpha: float = 0.05,
    samples: int = 100,
    key: str = CASE,
) -> DataFrame:
    """Bootstrap interval of a weighted statistic.

    Each resample gives a row a Poisson(1) number of copies, from a hash of its key
    and the resample number, so nothing is drawn on the driver and partial
    aggregation shrinks the copies before the shuffle.  The bounds are the
    resamples at places ``round((samples - 1) * alpha / 2)`` and its mirror.
    """
    drawn = F.conv(
        F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("resample").cast("string"))), 1, 8),
        16,
        10,
    ).cast("long")
    copies = F.lit(0)
    for threshold in poisson_thresholds():
        copies = copies + (drawn >= threshold).cast("int")
    resampled = (
        df.select(key, F.col(column).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("resample"))
        .withColumn("_w", copies)
        .groupBy("resample")
        .agg(statistic(F.col("_x"), F.col("_w")).alias("_s"))
    )
    # At most ``samples`` values: one per resample.
    places = [round((samples - 1) * a) for a in (alpha / 2, 1 - alpha / 2)]
    sorted_values = F.array_sort(F.collect_list("_s"))
    return resampled.agg(sorted_values.alias("_v")).select(
        F.col("_v")[places[0]].alias("low"), F.col("_v")[places[1]].alias("high")
    )


def value_ranges(cases: DataFrame, rules: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each numeric rule attribute over the cases its
    check rejected.  One pass for all attributes, then rows."""
    numeric = numeric_columns(cases, columns)
    if not numeric:
        return cases.sparkSession.createDataFrame(
            [], f"{KO_KEY} string, feature string, low double, high double"
        )
    spans = (
        cases.filter(F.col(KO).isNotNull())
        .groupBy(F.col(KO).alias(KO_KEY))
        .agg(
            *[F.min(f"`{c}`").cast("double").alias(f"_low{i}") for i, c in enumerate(numeric)],
            *[F.max(f"`{c}`").cast("double").alias(f"_high{i}") for i, c in enumerate(numeric)],
        )
    )
    long = spans.select(
        KO_KEY,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"), F.col(f"_low{i}").alias("low"), F.col(f"_high{i}").alias("high")
                    )
                    for i, c in enumerate(numeric)
                ]
            )
        ).alias("s"),
    ).select(KO_KEY, "s.*")
    used = rules.select(KO_KEY, "feature").distinct()
    return long.join(used, [KO_KEY, "feature"], "left_semi")


def histogram(cases: DataFrame, column: str, bins: int, intervals: DataFrame | None = None) -> DataFrame:
    """Counts in equal-width bins; with ``intervals`` (lo, hi) of a rule, bins the
    rule reaches are marked."""
    x = F.col(f"`{column}`").cast("double")
    low, high = cases.agg(F.min(x)).scalar(), cases.agg(F.max(x)).scalar()
    width = (high - low) / bins
    counted = (
        cases.filter(x.isNotNull())
        .groupBy(F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("cases"))
        .select(
            "bin",
            (low + F.col("bin") * width).alias("bin_low"),
            (low + (F.col("bin") + 1) * width).alias("bin_high"),
            "cases",
        )
    )
    if intervals is None:
        return counted
    reach = intervals.select(
        F.coalesce("lo", F.lit(float("-inf"))).alias("_lo"), F.coalesce("hi", F.lit(float("inf"))).alias("_hi")
    )
    # Both sides are small: ``bins`` rows against the conditions of one rule set.
    met = counted.join(
        reach, (F.col("_lo") < F.col("bin_high")) & (F.col("_hi") > F.col("bin_low")), "left_semi"
    ).select("bin", F.lit(True).alias("_met"))
    return counted.join(met, "bin", "left").select(
        *counted.columns, F.coalesce("_met", F.lit(False)).alias("in_rule")
    )


def max_abs_scale(
    train: DataFrame, other: DataFrame, columns: Sequence[str], day_seconds: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Divide by the largest absolute value in ``train``; seconds of day by a day;
    nulls become 0.  Both frames are scaled by what ``train`` says."""

    def scaled(df: DataFrame) -> DataFrame:
        sized = {}
        for c in columns:
            largest = train.agg(F.max(F.abs(c))).scalar()
            sized[c] = F.coalesce(F.col(c) / F.when(largest == 0, 1).otherwise(largest), F.lit(0.0))
        sized |= {c: F.coalesce(F.col(c) / 86400.0, F.lit(0.0)) for c in day_seconds}
        return df.withColumns(sized)

    return scaled(train), scaled(other)

"""What each knock-out check rejects and costs.

Every measure is keyed by ``ko_activity`` and computed for all checks in one
pass.  ``log`` carries the labels of its case; ``labels`` has one row per case;
``kos`` is a table of check names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.errors import NoActivitiesError
from casegate.functions.text import hms, percent
from casegate.operators.names import keep_names, names_frame
from casegate.operators.ordered import ordered_totals
from casegate.operators.waiting import waiting_time_waste
from casegate.schema import (
    ACTIVITY,
    CASE,
    DURATION,
    END_TS,
    KO,
    KO_KEY,
    MICROS_PER_SECOND,
    REJECTED,
    START_TS,
    micros,
)


def total_cases(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct(CASE).alias("total_cases"))


def distinct_activities(log: DataFrame) -> DataFrame:
    return log.select(ACTIVITY).distinct()


def available_cases(log: DataFrame, kos) -> DataFrame:
    """Distinct cases that contain the check; 0 for a check that never occurs."""
    found = (
        keep_names(log.select(CASE, ACTIVITY), ACTIVITY, kos)
        .groupBy(F.col(ACTIVITY).alias(KO_KEY))
        .agg(F.count_distinct(CASE).alias("_n"))
    )
    return (
        names_frame(log.sparkSession, kos, KO_KEY)
        .join(found, KO_KEY, "left")
        .select(KO_KEY, F.coalesce("_n", F.lit(0)).alias("available_cases"))
    )


def knocked_out_cases(labels: DataFrame) -> DataFrame:
    return (
        labels.filter(F.col(KO).isNotNull())
        .groupBy(F.col(KO).alias(KO_KEY))
        .agg(F.count(F.lit(1)).alias("knocked_out_cases"))
    )


def rejection_rates(log: DataFrame, labels: DataFrame, kos) -> DataFrame:
    """Cases knocked out by the check over cases containing it."""
    rejected = F.coalesce("knocked_out_cases", F.lit(0))
    return (
        available_cases(log, kos)
        .join(knocked_out_cases(labels), KO_KEY, "left")
        .select(
            KO_KEY,
            "available_cases",
            rejected.alias("knocked_out_cases"),
            F.coalesce(F.try_divide(rejected, "available_cases"), F.lit(0.0)).alias("rejection_rate"),
        )
    )


def time_waste(log: DataFrame, kos) -> DataFrame:
    """Processing and over-processing waste, from one pass over rejected cases.

    Processing waste adds the durations of all other activities of the rejected
    cases; over-processing waste adds the time from the first start to the last
    end of those activities, case by case.
    """
    spans = (
        log.filter(F.col(KO).isNotNull() & (F.col(ACTIVITY) != F.col(KO)))
        .groupBy(KO, CASE)
        .agg(
            F.sum(DURATION).alias("_work"),
            (F.max(micros(END_TS)) - F.min(micros(START_TS))).alias("_span"),
        )
        .groupBy(F.col(KO).alias(KO_KEY))
        .agg(F.sum("_work").alias("_work"), F.sum("_span").alias("_span"))
    )
    return (
        names_frame(log.sparkSession, kos, KO_KEY)
        .join(spans, KO_KEY, "left")
        .select(
            KO_KEY,
            F.coalesce("_work", F.lit(0)).alias("processing_waste_us"),
            F.coalesce("_span", F.lit(0)).alias("overprocessing_waste_us"),
        )
    )


def processing_waste(log: DataFrame, kos) -> DataFrame:
    return time_waste(log, kos).select(KO_KEY, "processing_waste_us")


def overprocessing_waste(log: DataFrame, kos) -> DataFrame:
    return time_waste(log, kos).select(KO_KEY, "overprocessing_waste_us")


def mean_durations(log: DataFrame) -> DataFrame:
    """Mean duration of each activity in seconds."""
    return log.groupBy(ACTIVITY).agg(
        (F.avg(micros(END_TS) - micros(START_TS)) / MICROS_PER_SECOND).alias("mean_seconds")
    )


def efforts(log: DataFrame, labels: DataFrame, kos, one_timestamp: bool = False) -> DataFrame:
    """Effort per rejection: mean duration over 100 times the rejection rate.

    With one timestamp there is no duration and 1 takes its place.  A check that
    never rejects has no effort.
    """
    rates = rejection_rates(log, labels, kos)
    if one_timestamp:
        timed = rates.withColumn("mean_seconds", F.lit(0.0))
        numerator: Column = F.lit(1.0)
    else:
        means = mean_durations(keep_names(log.select(ACTIVITY, START_TS, END_TS), ACTIVITY, kos))
        timed = rates.join(means.withColumnRenamed(ACTIVITY, KO_KEY), KO_KEY, "left")
        numerator = F.col("mean_seconds")
    return timed.withColumn("effort", F.try_divide(numerator, F.lit(100) * F.col("rejection_rate")))


def case_frequencies(log: DataFrame, kos) -> DataFrame:
    """Share of all cases that contain the check, in percent."""
    total = log.agg(F.count_distinct(CASE)).scalar()
    return available_cases(log, kos).withColumn(
        "case_frequency", F.try_divide(F.lit(100) * F.col("available_cases"), total)
    )


def passed_cases(labels: DataFrame) -> DataFrame:
    """Number of cases that are not rejected."""
    return labels.agg(F.count_if(~F.col(REJECTED)).alias("passed_cases"))


def report(
    log: DataFrame,
    labels: DataFrame,
    kos,
    rules_text: DataFrame | None = None,
    one_timestamp: bool = False,
    skip_waiting: bool = False,
) -> DataFrame:
    """One row per check with every measure, in numbers.

    ``rules_text`` (ko_activity, rejection_rule) is optional.  Logs with one
    timestamp have no time columns.
    """
    total = labels.agg(F.count(F.lit(1))).scalar()
    table = efforts(log, labels, kos, one_timestamp).withColumn(
        "case_frequency", F.try_divide(F.lit(100) * F.col("available_cases"), total)
    )
    if rules_text is not None:
        table = table.join(rules_text, KO_KEY, "left")
    if one_timestamp:
        return table.drop("mean_seconds").orderBy(KO_KEY)
    passed = labels.agg(F.count_if(~F.col(REJECTED))).scalar()
    table = table.join(time_waste(log, kos), KO_KEY, "left")
    if skip_waiting:
        table = table.withColumn("waiting_waste_us", F.lit(0).cast("long"))
    else:
        table = table.join(waiting_time_waste(log, kos), KO_KEY, "left")
    mean_wait = F.try_divide(F.col("waiting_waste_us"), passed)
    return table.withColumn("mean_waiting_waste_us", mean_wait).orderBy(KO_KEY)


def report_text(numbers: DataFrame, algorithm: str = "RIPPER") -> DataFrame:
    """The report with headings and units for people; the last projection."""
    columns = [
        F.col(KO_KEY).alias("Knockout Check"),
        F.col("available_cases").alias("Total frequency"),
        percent(F.col("case_frequency") / 100).alias("Case frequency"),
        percent(F.col("rejection_rate")).alias("Rejection rate"),
    ]
    if "rejection_rule" in numbers.columns:
        columns.append(F.col("rejection_rule").alias(f"Rejection rule ({algorithm})"))
    columns.append(F.round("effort", 2).alias("Effort per rejection"))
    if "mean_seconds" in numbers.columns:
        columns += [
            hms(F.col("mean_seconds")).alias("Mean Duration"),
            hms(F.col("overprocessing_waste_us") / MICROS_PER_SECOND).alias("Total Overprocessing Waste"),
            hms(F.col("processing_waste_us") / MICROS_PER_SECOND).alias("Total PT Waste"),
            hms(F.col("waiting_waste_us") / MICROS_PER_SECOND).alias("Total Waiting Time Waste"),
            hms(F.col("mean_waiting_waste_us") / MICROS_PER_SECOND).alias("Mean Waiting Time Waste"),
        ]
    return numbers.select(*columns)


def discovery_quality(activities: DataFrame, expected: Sequence[str], found: Sequence[str]) -> DataFrame:
    """Found checks against expected ones, over the activities of a log."""
    if activities.isEmpty():
        raise NoActivitiesError("no activities given")
    spark = activities.sparkSession
    computed = names_frame(spark, sorted(set(found)), "found")
    wanted = names_frame(spark, sorted(set(expected)), "wanted")
    names = activities.select(F.col(activities.columns[0]).alias("name")).distinct()
    marked = names.join(computed, F.col("name") == F.col("found"), "full").join(
        wanted, F.coalesce("name", "found") == F.col("wanted"), "left"
    )
    is_found, is_wanted = F.col("found").isNotNull(), F.col("wanted").isNotNull()
    counts = marked.agg(
        F.count_if(F.col("name").isNotNull()).alias("_total"),
        F.count_if(is_found & is_wanted).alias("true_positives"),
        F.count_if(is_found & ~is_wanted).alias("false_positives"),
        F.count_if(~is_found & ~is_wanted).alias("true_negatives"),
        F.count_if(~is_found & is_wanted).alias("false_negatives"),
    )
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    precision = F.when(tp + fp == 0, 1.0).otherwise(F.try_divide(tp, tp + fp))
    recall = F.when(tp + fn == 0, 1.0).otherwise(F.try_divide(tp, tp + fn))
    return (
        counts.withColumns(
            {"accuracy": F.try_divide(tp + tn, "_total"), "precision": precision, "recall": recall}
        )
        .withColumn(
            "f1_score",
            F.when(F.col("precision") + F.col("recall") == 0, F.lit(float("nan"))).otherwise(
                F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
            ),
        )
        .drop("_total")
    )


def case_processing_times(log: DataFrame) -> DataFrame:
    """Processing time per case with its label for display."""
    return log.groupBy(CASE).agg(
        F.sum(DURATION).alias("processing_us"),
        F.coalesce(F.max(KO), F.when(~F.max(REJECTED), "Not Knocked Out")).alias("outcome_label"),
    )


def processing_time_distribution(by_case: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum of processing time per label, linear between cases.

    Times are counted and their counts summed along a range-partitioned order: the case at a place is the
    first time whose running count exceeds it.  No task holds the times of a label.
    """
    counted = by_case.groupBy(F.struct("outcome_label").alias("_key"), "processing_us").agg(F.count(F.lit(1)).alias("_n"))
    timed = F.when(F.col("processing_us").isNotNull(), F.col("_n"))
    sizes = counted.groupBy("_key").agg(F.sum("_n").alias("cases"), F.sum(timed).alias("_timed"))
    placed = ordered_totals(counted.filter(F.col("processing_us").isNotNull()), ["processing_us"], {"_reached": "_n"}, by=["_key"])
    found = []
    for share, name in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high")):
        place = share * (F.col("_timed") - 1)
        before, after = (F.min(F.when(F.col("_reached") > at, F.col("processing_us"))) for at in (F.floor(place), F.ceil(place)))
        part = F.first(place - F.floor(place))
        found.append((before * (1 - part) + after * part).alias(name))
    quantiles = placed.join(sizes.select("_key", "_timed"), "_key").groupBy("_key").agg(*found)
    names = ["low", "q1", "median", "q3", "high"]
    return sizes.join(quantiles, "_key", "left").select("_key.outcome_label", "cases", *names)


def outcome_counts(by_case: DataFrame) -> DataFrame:
    """Cases per label, most first."""
    return (
        by_case.groupBy("outcome_label")
        .agg(F.count(F.lit(1)).alias("cases"))
        .orderBy(F.col("cases").desc(), "outcome_label")
    )

"""Rejection rules: the model, its table form, its predicate and its measures."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegate.operators.names import names_frame
from casegate.schema import KO, KO_KEY

RULES_SCHEMA = (
    "ko_activity string, rule_id int, cond_id int, feature string, op string, "
    "lo double, hi double, value string"
)


@dataclass(frozen=True, order=True)
class Condition:
    """``=`` with ``value`` (text, boolean) or ``lo`` (number), ``<`` hi, ``>=`` lo,
    or ``between`` with lo included and hi excluded."""

    feature: str
    op: str
    lo: float | None = None
    hi: float | None = None
    value: str | None = None

    def predicate(self) -> Column:
        column = F.col(f"`{self.feature}`")
        if self.op == "=":
            met = column.cast("string") == self.value if self.value is not None else column == self.lo
        elif self.op == "<":
            met = column < self.hi
        elif self.op == ">=":
            met = column >= self.lo
        else:
            met = (column >= self.lo) & (column < self.hi)
        return F.coalesce(met, F.lit(False))


Rule = tuple[Condition, ...]
Rulesets = Mapping[str, Sequence[Rule]]


def predicate(rules: Sequence[Rule]) -> Column:
    """A ruleset as one boolean column: any rule, all of its conditions."""
    fires = F.lit(False)
    for rule in rules:
        together = F.lit(True)
        for condition in rule:
            together = together & condition.predicate()
        fires = fires | together
    return fires


def rules_table(spark: SparkSession, rulesets: Rulesets) -> DataFrame:
    rows = [
        (ko, r, c, cond.feature, cond.op, cond.lo, cond.hi, cond.value)
        for ko, rules in sorted(rulesets.items())
        for r, rule in enumerate(rules)
        for c, cond in enumerate(rule)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def condition_text() -> Column:
    """``feature=<hi``, ``feature=lo-hi``, ``feature=>lo`` or ``feature=value``."""
    name = F.regexp_replace("feature", " ", "_")

    def number(column: str) -> Column:
        return F.regexp_replace(F.format_string("%.2f", column), r"\.?0+$", "")

    shown = (
        F.when(F.col("op") == "<", F.concat(F.lit("<"), number("hi")))
        .when(F.col("op") == ">=", F.concat(F.lit(">"), number("lo")))
        .when(F.col("op") == "between", F.concat(number("lo"), F.lit("-"), number("hi")))
        .otherwise(F.coalesce(F.col("value"), number("lo")))
    )
    return F.concat(name, F.lit("="), shown)


def rules_text(rules: DataFrame) -> DataFrame:
    """Each ruleset as text: ``[[a=x ^ b=lo-hi] V [..]]``."""
    shown = rules.withColumn("_text", condition_text())
    by_rule = shown.groupBy(KO_KEY, "rule_id").agg(
        F.array_sort(F.collect_list(F.struct("cond_id", "_text"))).alias("_c")
    )
    one = F.concat(F.lit("["), F.array_join(F.col("_c._text"), " ^ "), F.lit("]"))
    return (
        by_rule.select(KO_KEY, "rule_id", one.alias("_rule"))
        .groupBy(KO_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("rule_id", "_rule"))).alias("_r"))
        .select(
            KO_KEY,
            F.concat(F.lit("["), F.array_join(F.col("_r._rule"), " V "), F.lit("]")).alias("rejection_rule"),
        )
    )


def parse_rules(texts: Mapping[str, str]) -> dict[str, list[Rule]]:
    """Rulesets from their published text form, one short text per check."""

    def condition(text: str) -> Condition:
        feature, shown = text.split("=", 1)
        number = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
        if match := re.fullmatch(rf"<({number})", shown):
            return Condition(feature, "<", hi=float(match[1]))
        if match := re.fullmatch(rf">({number})", shown):
            return Condition(feature, ">=", lo=float(match[1]))
        if match := re.fullmatch(rf"({number})-({number})", shown):
            return Condition(feature, "between", lo=float(match[1]), hi=float(match[2]))
        return Condition(feature, "=", value=shown)

    found = {}
    for ko, text in texts.items():
        body = re.sub(r"\s*\n\s*", " ", text.strip())
        rules = re.findall(r"\[([^\[\]]+)\]", body)
        found[ko] = [tuple(condition(c.strip()) for c in rule.split("^")) for rule in rules]
    return found


def condition_intervals(rules: DataFrame) -> DataFrame:
    """The number interval ``[lo, hi)`` of each condition that has one; open ends are null."""
    return rules.filter(F.col("op").isin("<", ">=", "between")).select(
        KO_KEY, "rule_id", "cond_id", "feature", "lo", "hi"
    )


def text_intervals(conditions: DataFrame) -> DataFrame:
    """``lo`` and ``hi`` of published condition values in column ``shown``."""
    number = r"(-?\d+(?:\.\d+)?)"
    between = rf"^{number}-{number}$"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract("shown", pattern, group), F.lit("")).cast("double")

    return conditions.withColumns(
        {
            "lo": F.coalesce(part(between, 1), part(rf"^>{number}$", 1)),
            "hi": F.coalesce(part(between, 2), part(rf"^<{number}$", 1)),
        }
    )


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy(KO_KEY).agg(
        F.count_distinct("rule_id").alias("rule_count"), F.count(F.lit(1)).alias("condition_count")
    )


def rule_features(rules: DataFrame) -> DataFrame:
    """Attributes each ruleset uses."""
    return rules.select(KO_KEY, "feature").distinct()


def one_vs_rest(labels: DataFrame, kos: Sequence[str]) -> DataFrame:
    """Each case once per check, with whether that check rejected it."""
    marks = F.array(*[F.struct(F.lit(k).alias(KO_KEY), F.col(KO).eqNullSafe(k).alias("is_ko")) for k in kos])
    return labels.select("*", F.explode(marks).alias("_m")).select(*labels.columns, "_m.*")


def predictions(cases: DataFrame, rulesets: Rulesets) -> DataFrame:
    """Each case once per check, with whether the check's rules fire for it."""
    marks = F.array(
        *[
            F.struct(F.lit(ko).alias(KO_KEY), predicate(rules).alias("predicted"))
            for ko, rules in sorted(rulesets.items())
        ]
    )
    return cases.select("*", F.explode(marks).alias("_m")).select(*cases.columns, "_m.*")


def per_ko(cases: DataFrame, rulesets: Rulesets, measures) -> DataFrame:
    """Aggregates for every ruleset in one pass over the cases.

    ``measures(fires, is_ko)`` names the aggregates of one check; checks become
    rows again after the aggregation, on a single row.
    """
    kos = sorted(rulesets)
    if not kos:
        raise ValueError("no rulesets given")
    sums, shapes = [], []
    for i, ko in enumerate(kos):
        columns = measures(predicate(rulesets[ko]), F.col(KO).eqNullSafe(ko))
        sums += [c.alias(f"_{i}_{n}") for n, c in columns.items()]
        shapes.append(F.struct(F.lit(ko).alias(KO_KEY), *[F.col(f"_{i}_{n}").alias(n) for n in columns]))
    return cases.agg(*sums).select(F.explode(F.array(*shapes)).alias("m")).select("m.*")


def coverage(cases: DataFrame, rulesets: Rulesets) -> DataFrame:
    """Per check: cases the rules fire for, and how many of them it rejected."""
    return per_ko(
        cases,
        rulesets,
        lambda fires, is_ko: {
            "predicted": F.count_if(fires),
            "predicted_true": F.count_if(fires & is_ko),
        },
    )


def support_and_confidence(cases: DataFrame, rulesets: Rulesets, available: DataFrame) -> DataFrame:
    """Support: predicted cases over cases that contain the check.  Confidence:
    predicted and rejected by it over predicted.  Both 0 where nothing is there."""
    return (
        coverage(cases, rulesets)
        .join(available, KO_KEY, "left")
        .select(
            KO_KEY,
            "predicted",
            "predicted_true",
            F.coalesce(F.try_divide("predicted", "available_cases"), F.lit(0.0)).alias("support"),
            F.coalesce(F.try_divide("predicted_true", "predicted"), F.lit(0.0)).alias("confidence"),
        )
    )


def holdout_quality(test: DataFrame, rulesets: Rulesets) -> DataFrame:
    """Precision, recall and F1 on held-out cases; 0 where undefined."""
    counts = per_ko(
        test,
        rulesets,
        lambda fires, is_ko: {
            "tp": F.count_if(fires & is_ko),
            "fp": F.count_if(fires & ~is_ko),
            "fn": F.count_if(~fires & is_ko),
            "tn": F.count_if(~fires & ~is_ko),
        },
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            # A ruleset gives one operating point of the ROC curve.
            "roc_auc": (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2,
            "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
            "f1_score": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        }
    )


def settings_text(settings: Mapping[str, object]) -> str:
    """Settings by name, those without a value left out."""
    return ", ".join(f"{name}={value}" for name, value in sorted(settings.items()) if value is not None)


def rule_metrics(
    cases: DataFrame,
    test: DataFrame,
    rulesets: Rulesets,
    available: DataFrame,
    scope: str = "all",
    settings: Mapping[str, Mapping[str, object]] | None = None,
    areas: DataFrame | None = None,
) -> DataFrame:
    """Metrics table per check.  Support and confidence use all cases, or with
    ``scope="test"`` the held-out ones only.

    ``settings``: what each check was learnt with, told as ``parameters``.  ``areas`` (``mean_auc,
    std_auc`` per check, from folds): ``roc_auc`` is the mean of the folds instead of the held-out
    cases' area, with its spread as ``roc_auc_std``.
    """
    spark = cases.sparkSession
    counts = rule_counts(rules_table(spark, rulesets))
    table = (
        names_frame(spark, sorted(rulesets), KO_KEY)
        .join(support_and_confidence(test if scope == "test" else cases, rulesets, available), KO_KEY, "left")
        .join(
            holdout_quality(test, rulesets).select(KO_KEY, "precision", "recall", "f1_score", "roc_auc"), KO_KEY, "left"
        )
        .join(counts, KO_KEY, "left")
        .fillna(0, ["rule_count", "condition_count"])
    )
    if areas is not None:
        folds = areas.select(KO_KEY, F.col("mean_auc").alias("_mean"), F.col("std_auc").alias("roc_auc_std"))
        table = table.join(folds, KO_KEY, "left").withColumn("roc_auc", F.col("_mean")).drop("_mean")
    if settings is not None:
        told = [(ko, settings_text(settings[ko])) for ko in sorted(rulesets) if ko in settings]
        table = table.join(spark.createDataFrame(told, f"{KO_KEY} string, parameters string"), KO_KEY, "left")
    return table


def low_confidence(metrics: DataFrame, threshold: float, support: float | None = None) -> DataFrame:
    """Checks whose rules are below the confidence (or support) threshold."""
    below = F.col("confidence") < threshold
    if support is not None:
        below = below | (F.col("support") < support)
    return metrics.filter(below).select(KO_KEY, "support", "confidence")


def confidence_warnings(metrics: DataFrame, threshold: float) -> DataFrame:
    return low_confidence(metrics, threshold).select(
        KO_KEY,
        F.format_string(
            'The rules of "%s" hold too rarely: confidence %s, at least %s is asked for',
            KO_KEY,
            F.round("confidence", 3).cast("string"),
            F.lit(str(threshold)),
        ).alias("warning"),
    )


def simplify_rules(rules: DataFrame) -> DataFrame:
    """Join touching intervals of single-condition rules on the same attribute.

    Rules with several conditions, and conditions without an interval, stay as they
    are.  ``rules`` is a model, a few rows per check and attribute.
    """
    sized = rules.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(KO_KEY, "rule_id")))
    single = (F.col("_n") == 1) & F.col("op").isin("<", ">=", "between")
    low = F.coalesce("lo", F.lit(float("-inf")))
    high = F.coalesce("hi", F.lit(float("inf")))
    ordered = Window.partitionBy(KO_KEY, "feature").orderBy("_low", "_high", "rule_id")
    islands = (
        sized.filter(single)
        .withColumns({"_low": low, "_high": high})
        .withColumn("_reach", F.max("_high").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn(
            "_island",
            F.sum(F.when(F.col("_low") <= F.col("_reach"), 0).otherwise(1)).over(
                ordered.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .groupBy(KO_KEY, "feature", "_island")
        .agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("rule_id").alias("rule_id"))
    )
    no_low, no_high = F.col("_low") == float("-inf"), F.col("_high") == float("inf")
    merged = islands.filter(~(no_low & no_high)).select(
        KO_KEY,
        "rule_id",
        F.lit(0).alias("cond_id"),
        "feature",
        F.when(no_low, "<").when(no_high, ">=").otherwise("between").alias("op"),
        F.when(~no_low, F.col("_low")).alias("lo"),
        F.when(~no_high, F.col("_high")).alias("hi"),
        F.lit(None).cast("string").alias("value"),
    )
    # An interval without ends is a condition that always holds where there is a value.
    everything = islands.filter(no_low & no_high).select(
        KO_KEY,
        "rule_id",
        F.lit(0).alias("cond_id"),
        "feature",
        F.lit(">=").alias("op"),
        F.col("_low").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        F.lit(None).cast("string").alias("value"),
    )
    rest = sized.filter(~single).drop("_n")
    return merged.unionByName(everything).unionByName(rest.select(*merged.columns))

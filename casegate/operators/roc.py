"""ROC curves and areas, of rules over folds and of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.operators.ordered import ordered_totals
from casegate.operators.rules import Rulesets, predicate
from casegate.schema import KO, KO_KEY

GRID = 100  # points of the mean curve


def fold_counts(cases: DataFrame, rulesets: Rulesets) -> DataFrame:
    """Per check and fold: the confusion counts of its rules.  ``cases`` has ``fold``."""
    kos = sorted(rulesets)
    marks = F.array(
        *[
            F.struct(
                F.lit(ko).alias(KO_KEY),
                predicate(rulesets[ko]).alias("fires"),
                F.col(KO).eqNullSafe(ko).alias("is_ko"),
            )
            for ko in kos
        ]
    )
    return (
        cases.select("fold", F.explode(marks).alias("m"))
        .select("fold", "m.*")
        .groupBy(KO_KEY, "fold")
        .agg(
            F.count_if(F.col("fires") & F.col("is_ko")).alias("tp"),
            F.count_if(F.col("fires") & ~F.col("is_ko")).alias("fp"),
            F.count_if(~F.col("fires") & F.col("is_ko")).alias("fn"),
            F.count_if(~F.col("fires") & ~F.col("is_ko")).alias("tn"),
        )
    )


def fold_rates(counts: DataFrame) -> DataFrame:
    """Rates of each fold; null where a fold lacks a class.  A rule gives one
    operating point, so its area is ``(1 + tpr - fpr) / 2``."""
    rated = counts.withColumns(
        {
            "tpr": F.try_divide("tp", F.col("tp") + F.col("fn")),
            "fpr": F.try_divide("fp", F.col("fp") + F.col("tn")),
        }
    )
    return rated.withColumn("auc", F.coalesce((1 + F.col("tpr") - F.col("fpr")) / 2, F.lit(0.0)))


def curve_at(x: Column) -> Column:
    """The fold's curve (0,0)-(fpr,tpr)-(1,1) at ``x``, forced through the origin."""
    fpr, tpr = F.col("fpr"), F.col("tpr")
    rising = F.when(fpr > 0, tpr * x / fpr).otherwise(tpr)
    falling = tpr + (1 - tpr) * F.try_divide(x - fpr, 1 - fpr)
    return F.when(x == 0, F.lit(0.0)).when(x <= fpr, rising).otherwise(falling)


def mean_curve(rates: DataFrame) -> DataFrame:
    """Mean and spread of the true-positive rate over folds on a fixed grid."""
    point = F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))
    spread = (
        rates.select(KO_KEY, "fold", "tpr", "fpr", point.alias("point"))
        .withColumn("x", F.col("point") / float(GRID - 1))
        .withColumn("y", curve_at(F.col("x")))
        .groupBy(KO_KEY, "point", "x")
        .agg(F.avg("y").alias("mean_tpr"), F.stddev_pop("y").alias("std_tpr"))
    )
    last = F.col("point") == GRID - 1
    mean = F.when(last, F.lit(1.0)).otherwise(F.col("mean_tpr"))
    return spread.withColumn("mean_tpr", mean).withColumns(
        {
            "upper_tpr": F.least(F.col("mean_tpr") + F.col("std_tpr"), F.lit(1.0)),
            "lower_tpr": F.greatest(F.col("mean_tpr") - F.col("std_tpr"), F.lit(0.0)),
        }
    )


def mean_area(rates: DataFrame) -> DataFrame:
    """Trapezoid area under the mean curve, and the spread of the fold areas.

    On an even grid every inner point weighs one step and both ends half.
    """
    ends = F.col("point").isin(0, GRID - 1)
    weight = F.when(ends, 0.5).otherwise(1.0) / float(GRID - 1)
    area = mean_curve(rates).groupBy(KO_KEY).agg(F.sum(F.col("mean_tpr") * weight).alias("mean_auc"))
    return area.join(rates.groupBy(KO_KEY).agg(F.stddev_pop("auc").alias("std_auc")), KO_KEY)


def score_steps(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score, with totals at or above it."""
    steps = scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    return ordered_totals(steps, [F.col("score").desc()], {"tp": "pos", "fp": "neg"})


def score_curve(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC points by falling score."""
    steps = score_steps(scored, score, label)
    pos, neg = steps.agg(F.sum("pos")).scalar(), steps.agg(F.sum("neg")).scalar()
    return steps.select(
        "score", F.try_divide("tp", pos).alias("tpr"), F.try_divide("fp", neg).alias("fpr")
    )


def score_area(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve of a score; equal scores count half."""
    steps = score_steps(scored, score, label)
    wins = F.col("neg").cast("decimal(38,0)") * (2 * F.col("tp") - F.col("pos"))
    return steps.agg(F.sum(wins).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")).select(
        F.try_divide(F.col("_w").cast("double"), 2.0 * F.col("_p") * F.col("_n")).alias("auc")
    )

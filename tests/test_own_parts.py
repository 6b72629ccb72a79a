"""Parts of one's own in an analysis: preprocessing, bootstrap statistic, teacher."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from casegate.config import AnalysisConfig
from casegate.functions.stats import bootstrap_interval
from casegate.operators import learn
from casegate.operators.prepare import add_boundaries
from casegate.plans.analysis import Analysis
from casegate.sources.derived import order_log


def test_another_bootstrap_statistic(spark):
    rows = spark.range(400).select(F.col("id").cast("string").alias("case_id"), (F.col("id") % 20).cast("double").alias("x"))
    largest = bootstrap_interval(rows, "x", lambda x, w: F.max(F.when(w > 0, x))).first()
    assert (largest["low"], largest["high"]) == (19.0, 19.0)
    mean = bootstrap_interval(rows, "x").first()
    total = bootstrap_interval(rows, "x", lambda x, w: F.sum(x * w)).first()
    assert mean["low"] < 9.5 < mean["high"] and total["low"] < 3_800 < total["high"]


def test_another_teacher(spark):
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("case_id"), (F.col("id") * 37 % 100).cast("double").alias("amount"), (F.col("id") * 53 % 90).cast("double").alias("noise")
    )
    cases = rows.withColumn("knockout_activity", F.when(F.col("amount") < 30, "ko")).withColumn("knocked_out_case", F.col("amount") < 30)

    def tree(features, train):
        stages = [VectorAssembler(inputCols=features, outputCol="v"), DecisionTreeClassifier(featuresCol="v", labelCol="_y", maxDepth=2, maxBins=256)]
        return Pipeline(stages=stages), features

    settings = learn.LearnSettings(prune_size=0.33, max_rules=3)
    rules, teachers = learn.surrogate_rules(cases, ["ko"], ["amount", "noise"], settings, tree, cases)
    assert teachers["ko"].auc == pytest.approx(1.0) and teachers["ko"].importances["amount"] == pytest.approx(1.0)
    assert rules["ko"] and {c.feature for rule in rules["ko"] for c in rule} == {"amount"}


def test_preprocessing_in_a_run(spark):
    log = add_boundaries(order_log(spark, "/root/testdata/sf0.001"))
    config = AnalysisConfig(
        post_knockout_activities=["Notify rejection"], rule_discovery_algorithm="IREP", max_rules=1, max_rule_conds=1, prune_size=0.33,
        custom_log_preprocessing_function=lambda rows: rows.withColumn("half_price", F.col("o_totalprice") / 2),
    )
    result = Analysis(config).run(log)
    assert "half_price" in result.cases.columns
    assert result.cases.filter(F.abs(F.col("half_price") * 2 - F.col("o_totalprice")) > 1e-6).isEmpty()

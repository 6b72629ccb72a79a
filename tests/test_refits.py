"""Rules learnt again per fold, metrics of them, and teachers over attributes of many values."""

import hashlib
import random
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from casegate.config import AnalysisConfig
from casegate.errors import RuleLearningError
from casegate.operators import learn, refit, roc, rules, splits, targets
from casegate.operators.prepare import add_boundaries
from casegate.plans.analysis import Analysis
from casegate.sources.derived import order_log

CASES = "case_id string, start_ts timestamp_ntz, knocked_out_case boolean, knockout_activity string, a string, b string"


def changing(spark, n=600):
    """Early cases are rejected by ``a``, late ones by ``b``."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        a, b = rng.choice("pqrs"), rng.choice("uvwx")
        ko = "one" if (a == "p" if i < n // 2 else b == "u") else "two" if b == "x" else None
        rows.append((f"{i:04d}", i, ko is not None, ko, a, b))
    frame = spark.createDataFrame(rows, CASES.replace("timestamp_ntz", "int"))
    return frame.withColumn("start_ts", F.lit("2022-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours="start_ts"))


@pytest.mark.parametrize("time_aware", [True, False])
def test_a_refit_is_what_each_fold_learns_alone(spark, time_aware):
    cases = changing(spark)
    settings = learn.LearnSettings(prune_size=0.33, k=1)
    found = refit.refits(cases, [("one", settings), ("two", settings)], ["a", "b"], "IREP", 4, time_aware)
    assert [(one.ko, one.fold) for one in found] == [(ko, fold) for ko in ("one", "two") for fold in range(1, 5)]
    folds = splits.time_folds(cases, 4) if time_aware else splits.stratified_folds(cases, 4, F.col("knockout_activity"))
    for fold in (1, 4):
        train = folds.filter(F.col("fold") < fold if time_aware else F.col("fold") != fold)
        alone = learn.learn_rules(train, ["one", "two"], ["a", "b"], "IREP", settings)
        counts = {r["ko_activity"]: r for r in roc.fold_counts(folds.filter(F.col("fold") == fold), alone).collect()}
        for one in found:
            if one.fold == fold:
                assert one.rules == alone[one.ko]
                row = counts[one.ko]
                assert (one.tp, one.fp, one.fn, one.tn) == (row["tp"], row["fp"], row["fn"], row["tn"])
    if time_aware:  # the rules change with the cases
        assert {c.feature for c in found[0].rules[0]} == {"a"} and any(c.feature == "b" for rule in found[3].rules for c in rule)


def test_refits_of_few_cases_and_missing_classes(spark):
    cases = changing(spark, 40)
    with pytest.raises(RuleLearningError):
        refit.refits(cases.limit(3), [("one", learn.LearnSettings())], ["a"], "IREP", 5)
    with pytest.raises(RuleLearningError):
        refit.refits(cases, [("one", learn.LearnSettings())], ["a"], "OTHER", 5)
    assert refit.refits(cases, [], ["a"]) == []
    (first, *_) = found = refit.refits(cases, [("never", learn.LearnSettings())], ["a", "b"], "IREP", 3)
    assert first.rules == [] and (first.tp, first.fp, first.fn) == (0, 0, 0) and first.tn == 10
    area = roc.mean_area(roc.fold_rates(refit.refit_counts(spark, found))).first()
    assert area["std_auc"] == 0.0  # a fold without a class has no area: it counts 0


def test_metrics_tell_parameters_and_areas(spark):
    cases = changing(spark)
    chosen = {"one": learn.LearnSettings(max_rules=2, prune_size=0.33), "two": learn.LearnSettings(prune_size=0.33)}
    rulesets = {ko: learn.learn_rules(cases, [ko], ["a", "b"], "IREP", own)[ko] for ko, own in chosen.items()}
    available = spark.createDataFrame([("one", 600), ("two", 600)], "ko_activity string, available_cases long")
    areas = refit.refit_areas(cases, chosen, ["a", "b"], "IREP")
    table = rules.rule_metrics(cases, cases, rulesets, available, settings={ko: asdict(own) for ko, own in chosen.items()}, areas=areas)
    rows = {r["ko_activity"]: r for r in table.collect()}
    wanted = {r["ko_activity"]: r for r in areas.collect()}
    assert rows["one"]["parameters"].startswith("dl_allowance=1, k=2, max_rules=2, n_discretize_bins=10, prune_size=0.33")
    assert "max_rules" not in rows["two"]["parameters"]
    assert rows["two"]["roc_auc"] == wanted["two"]["mean_auc"] > 0.9 and rows["one"]["roc_auc"] < rows["two"]["roc_auc"]
    assert rows["one"]["roc_auc_std"] == wanted["one"]["std_auc"] > 0


def test_an_analysis_refits_where_asked(spark):
    log = add_boundaries(order_log(spark, "/root/testdata/sf0.001"))
    config = AnalysisConfig(
        post_knockout_activities=["Notify rejection"], rule_discovery_algorithm="IREP", max_rules=1, max_rule_conds=1,
        prune_size=0.33, roc_folds=3,
    )
    rows = Analysis(config).run(log).metrics.collect()
    assert len(rows) == 3 and all(0 <= r["roc_auc"] <= 1 and r["roc_auc_std"] is not None for r in rows)
    assert all("max_rules=1" in r["parameters"] for r in rows)


def test_ordered_statistics_are_the_brute_force_ones(spark):
    rng = random.Random(8)
    plain = [(str(i), rng.choice(["hot", "hot", None, "", f"v{i % 40}"]), float(rng.random() < 0.3)) for i in range(900)]
    cases = spark.createDataFrame(plain, "case_id string, kind string, _y double").withColumn("value", F.lit("clash"))
    codes = targets.target_codes(cases, ["kind"])
    both = codes.coded(codes.coded(cases, ["_o"], True), ["_t"], False)
    assert both.columns == ["case_id", "kind", "_y", "value", "_o", "_t"] and both.count() == 900
    block = {i: int(hashlib.md5(f"{i}|0".encode()).hexdigest()[:6], 16) % targets.BLOCKS for i, _, _ in plain}
    prior = sum(y for _, _, y in plain) / len(plain)
    for r in both.collect():
        same = [(i, y) for i, kind, y in plain if kind == r["kind"]]
        earlier = [y for i, y in same if block[i] < block[r["case_id"]]]
        assert r["_o"] == pytest.approx((sum(earlier) + prior) / (len(earlier) + 1))
        assert r["_t"] == pytest.approx((sum(y for _, y in same) + prior) / (len(same) + 1))
    new = cases.limit(1).withColumn("kind", F.lit("never seen"))
    assert codes.coded(new, ["_t"], False).first()["_t"] == pytest.approx(prior)


def test_an_attribute_of_fifty_thousand_values_trains(spark):
    cases = spark.range(150_000).select(
        F.col("id").cast("string").alias("case_id"),
        F.concat(F.lit("c"), F.col("id") % 50_000).alias("customer"),
        F.when(F.xxhash64(F.col("id") % 50_000) % 5 == 0, "ko").alias("knockout_activity"),
    )
    cases = cases.withColumn("knocked_out_case", F.col("knockout_activity").isNotNull())
    parts = cases.withColumn("new", F.col("case_id").cast("long") >= 100_000)
    teacher = learn.fit_teacher(parts.filter("not new"), "ko", ["customer"], lambda f, t: learn.boosted_trees(f, t, 2, 3), parts.filter("new"))
    assert teacher.auc > 0.95 and teacher.importances["customer"] == pytest.approx(1.0)
    with pytest.raises(RuleLearningError):
        learn.boosted_trees(["customer"], parts, depth=17)

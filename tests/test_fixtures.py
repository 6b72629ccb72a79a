"""The small logs with known results: fixed values, as the results must be equal."""

import pytest
from pyspark.sql import functions as F

from casegate.errors import ImpossibleOrderError, NoActivitiesError
from casegate.operators import metrics, redesign, rules
from casegate.operators.waiting import waiting_time_waste
from tests.logs import at, event, log_of


def test_rejection_rate_counts_cases_not_events(spark):
    names = {"x": ["activity_A", "activity_B", "check_A"], "y": ["activity_C", "activity_D", "check_A", "check_A"]}
    rows = [event(c, i, a, i, i + 1) for c, acts in names.items() for i, a in enumerate(acts)]
    log = log_of(spark, rows)
    labels = spark.createDataFrame(
        [("x", True, "check_A"), ("y", False, None)],
        "case_id string, knocked_out_case boolean, knockout_activity string",
    )
    assert metrics.rejection_rates(log, labels, ["check_A"]).first()["rejection_rate"] == 0.5
    assert metrics.rejection_rates(log, labels, []).count() == 0
    absent = metrics.rejection_rates(log, labels, ["nowhere"]).first()
    assert (absent["available_cases"], absent["rejection_rate"]) == (0, 0.0)
    assert metrics.efforts(log, labels, ["nowhere"]).first()["effort"] is None


@pytest.mark.parametrize(
    "found, counts",
    [
        (["ko_1", "ko_2"], (2, 0, 3, 0)),
        (["Start", "not_ko_1", "not_ko_2"], (0, 3, 0, 2)),
        (["ko_1", "ko_2", "not_ko_1"], (2, 1, 2, 0)),
    ],
)
def test_discovery_quality(spark, found, counts):
    names = spark.createDataFrame([(a,) for a in ("Start", "ko_1", "not_ko_1", "not_ko_2", "ko_2")], "a string")
    row = metrics.discovery_quality(names, ["ko_1", "ko_2"], found).first()
    assert counts == tuple(
        row[n] for n in ("true_positives", "false_positives", "true_negatives", "false_negatives")
    )


def test_discovery_quality_needs_activities(spark):
    with pytest.raises(NoActivitiesError):
        metrics.discovery_quality(spark.createDataFrame([], "a string"), [], [])


def test_waiting_time_of_two_idle_cases(spark):
    five = 5 / 60
    rows, labels = [], []

    def add(case, ko, *events):
        for i, (name, start, end) in enumerate(events):
            rows.append(event(case, len(rows), name, start, end))
            labels.append((ko is not None, ko))

    add("0", "ko_1", ("Start", 9, 9 + five), ("Work", 9 + five, 14), ("End", 14, 14 + five))
    for case in ("1", "2"):
        add(case, None, ("Start", 10, 10 + five), ("Work", 14 + five, 15), ("End", 15, 15 + five))
    log = log_of(spark, rows, "knocked_out_case boolean, knockout_activity string", labels)
    row = waiting_time_waste(log, ["ko_1"]).first()
    assert row["waiting_waste_us"] == 28_800 * 1_000_000
    without = log.drop("resource")
    assert waiting_time_waste(without, ["ko_1"]).first()["waiting_waste_us"] == 0


@pytest.mark.parametrize(
    "variant, needs, expected",
    [
        (
            ["ko_1", "normal_1", "normal_2", "ko_2", "normal_3", "ko_3"],
            {"ko_2": [("a1", "normal_1")], "ko_3": [("a2", "ko_2"), ("a3", "normal_2")]},
            ["ko_1", "normal_1", "ko_2", "normal_2", "ko_3", "normal_3"],
        ),
        (
            ["start", "normal_1", "normal_2", "ko_1", "normal_3", "ko_2", "ko_3"],
            {"ko_1": [("a1", "start")]},
            ["start", "ko_1", "ko_2", "ko_3", "normal_1", "normal_2", "normal_3"],
        ),
        (
            ["start", "normal_1", "normal_2", "ko_1", "normal_3", "ko_2", "ko_3"],
            {"ko_1": [("a1", "start")], "ko_3": [("a3", "normal_3")]},
            ["start", "ko_1", "ko_2", "normal_1", "normal_2", "normal_3", "ko_3"],
        ),
    ],
)
def test_relocation(spark, variant, needs, expected):
    df = spark.createDataFrame([(variant,)], "v array<string>")
    row = df.select(redesign.relocated(F.col("v"), ["ko_1", "ko_2", "ko_3"], needs).alias("r")).first()["r"]
    assert row["to_be"] == expected and row["dropped_kos"] == []


def test_relocation_reports_a_check_without_its_producer(spark):
    df = spark.createDataFrame([(["start", "a", "ko"],)], "v array<string>")
    row = df.select(redesign.relocated(F.col("v"), ["ko"], {"ko": [("x", "gone")]}).alias("r")).first()["r"]
    assert (row["to_be"], row["dropped_kos"]) == (["start", "a"], ["ko"])


@pytest.mark.parametrize("tasks", ["1", "6"])
@pytest.mark.parametrize(
    "names, values, producer",
    [
        (["Start", "A", "B", "C", "D", "End"], [None, None, None, "v", "v", "v"], "B"),
        (
            ["Start", "A", "B", "C", "D", "E", "F", "End"],
            [None, None, None, "B", "B,C", "B,C,D", "B,C,D", "B,C,D"],
            "D",
        ),
    ],
)
def test_attribute_producer(spark, names, values, producer, tasks):
    """With six tasks the case is cut into pieces."""
    rows = [event("0", i, a, 8 + i, 9 + i) for i, a in enumerate(names)]
    more = [(True, "KO", v) for v in values]
    log = log_of(spark, rows, "knocked_out_case boolean, knockout_activity string, attr string", more)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        found = redesign.attribute_producers(log, ["attr"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["producer"] for r in found] == [producer]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[[Loan_Ammount=11693.71-16840.45] V [Loan_Ammount=>16840.45]]", "[[Loan_Ammount=>11693.71]]"),
        (
            "[[Monthly_Income=555.77-830.79] V [Monthly_Income=<555.77] V [Monthly_Income=830.79-1019.68]]",
            "[[Monthly_Income=<1019.68]]",
        ),
        ("[[A=1-2 ^ B=x] V [A=5-6]]", "[[A=1-2 ^ B=x] V [A=5-6]]"),
    ],
)
def test_rule_simplification(spark, text, expected):
    table = rules.rules_table(spark, rules.parse_rules({"ko": text}))
    assert rules.rules_text(rules.simplify_rules(table)).first()["rejection_rule"] == expected
    assert rules.rules_text(table).first()["rejection_rule"] == text


def test_best_order_with_constraints(spark):
    efforts = {"a": 3.0, "b": 1.0, "c": 2.0, "d": 2.0}

    def best(*args):
        return redesign.order_or_raise(redesign.optimal_order(spark, efforts, *args))

    assert best() == ["b", "c", "d", "a"]
    # 3*1 + 1*2 + 2*3 + 2*4 equals 2*1 + 2*2 + 3*3 + 1*4: decided by name.
    assert best({"b": [("x", "a")]}) == ["a", "b", "c", "d"]
    assert best({"b": [("x", "c")]}) == ["c", "b", "d", "a"]
    assert best(None, [["b", "c", "d", "a"]]) == ["b", "d", "c", "a"]
    assert best(None, [["b", "c", "d", "a"], ["b", "d", "c", "a"]]) == ["b", "c", "a", "d"]
    with pytest.raises(ImpossibleOrderError):
        best({"a": [("x", "b")], "b": [("y", "a")]})


def test_times_are_hours():
    assert at(1).hour == 1

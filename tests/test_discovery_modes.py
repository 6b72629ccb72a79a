"""Discovery by mode on small hand-made logs, end to end to the labels."""

import pytest

from casegate.config import AnalysisConfig
from casegate.errors import NoKnockoutsError
from casegate.operators.discovery import discover
from casegate.operators.labels import label
from tests.logs import sequences

PASS = ["Start", "income", "history", "assess", "pay", "End"]
FAIL = {ko: ["Start", *PASS[1 : PASS.index(ko) + 1], "reject", "End"] for ko in ("income", "history", "assess")}


def found(spark, cases, **options):
    log = sequences(spark, cases)
    config = AnalysisConfig(**options)
    result = discover(log, config)
    labels = {r["case_id"]: (r["knocked_out_case"], r["knockout_activity"]) for r in label(log, result.kos, config).collect()}
    return result, [labels[f"c{i:03d}"] for i in range(len(cases))]


def test_simple_log_by_its_negative_outcome(spark):
    cases = [PASS, PASS, *FAIL.values()]
    result, labels = found(spark, cases, post_knockout_activities=["reject"])
    assert result.kos == ["assess", "history", "income"] and result.outcomes == ["reject"] and result.sequences is None
    assert labels == [(False, None), (False, None), (True, "income"), (True, "history"), (True, "assess")]


def test_known_checks_are_taken_as_they_are(spark):
    cases = [PASS, *FAIL.values()]
    result, labels = found(spark, cases, known_ko_activities=["income", "assess"], post_knockout_activities=["reject"])
    assert result.kos == ["assess", "income"]
    assert labels == [(False, None), (True, "income"), (True, "income"), (True, "assess")]


def test_several_negative_outcomes_and_excluded_activities(spark):
    cases = [PASS, FAIL["income"], ["Start", "income", "history", "ban", "End"], ["Start", "wait", "reject", "End"]]
    options = {"post_knockout_activities": ["reject", "ban"], "exclude_from_ko_activities": ["wait"]}
    result, labels = found(spark, cases, **options)
    assert result.kos == ["history", "income"] and result.outcomes == ["reject", "ban"]
    assert labels == [(False, None), (True, "income"), (True, "history"), (True, None)]


def test_nested_checks_and_rework(spark):
    """A check inside another's branch, and one that is done again before it rejects."""
    nested = ["Start", "income", "ask", "history", "reject", "End"]
    rework = ["Start", "income", "history", "income", "history", "reject", "End"]
    result, labels = found(spark, [PASS, nested, rework, FAIL["income"]], post_knockout_activities=["reject"])
    assert result.kos == ["history", "income"]
    assert labels == [(False, None), (True, "history"), (True, "history"), (True, "income")]


def test_success_activity_alone(spark):
    """Cases without the success activity count as rejected; their ends give the checks."""
    result, labels = found(spark, [PASS, PASS, PASS, FAIL["income"], FAIL["history"]], success_activities=["pay"])
    assert result.outcomes == ["pay"] and {"income", "history"} <= set(result.kos)
    assert [rejected for rejected, _ in labels] == [False, False, False, True, True]
    assert labels[3][1] == "income" or "reject" in result.kos


def test_automatic_mode_finds_what_sets_variants_apart(spark):
    result, _ = found(spark, [PASS, PASS, *FAIL.values()])
    assert result.sequences is not None and set(result.kos) <= {"income", "history", "assess", "reject", "pay"}
    assert {"income", "history"} & set(result.kos)


def test_nothing_found_is_an_error(spark):
    with pytest.raises(NoKnockoutsError):
        discover(sequences(spark, [PASS]), AnalysisConfig(post_knockout_activities=["never"]))

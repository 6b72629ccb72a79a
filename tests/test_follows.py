"""Directly-follows filters on logs dealt out by case: no join, tasks of one size, cases too large for a task."""

from datetime import datetime, timedelta

import pytest

import __spark_entry__ as entry
from casegate.operators.filters import directly_follows, directly_follows_cases
from casegate.plans.registry import day_by_case
from casegate.schema import CASE
from casegate.sources import derived
from tests.logs import event, log_of
from tests.test_dealt import plan

PAIRS = [("signup", "purchase"), ("view", "End")]


def event_table(spark, folder, hot=0):
    """Users of four events a day in one row group; user 0 has ``hot`` events more on the first day."""
    kinds = ["signup", "purchase", "view", "click", "error"]
    rows = [(u, kinds[(u * (k + 2) + k) % 5], k) for u in range(40) for k in range(4)]
    rows += [(0, kinds[3 + k % 2], 4 + k) for k in range(hot)]
    data = [
        (i, datetime(2024, 1, 1) + timedelta(minutes=k), u, kind, 0.0, f'{{"k": {k}}}')
        for i, (u, kind, k) in enumerate(rows)
    ]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/events.parquet")
    steps = {}
    for i, _, u, kind, *_ in data:
        steps.setdefault(f"{u}_20240101", []).append((i, kind))
    found = []
    for case, events in steps.items():
        named = [("Start", events[0][0] - 1), *((kind, i) for i, kind in events), ("End", events[-1][0] + 1)]
        if any((a, b) in PAIRS for (a, _), (b, _) in zip(named, named[1:])):
            found += [(case, i, name) for name, i in named]
    return str(folder), sorted(found)


@pytest.mark.parametrize("hot", [0, 600])
def test_filter_of_days(spark, tmp_path, hot):
    folder, expected = event_table(spark, tmp_path, hot)
    found = entry.queries()["b2_directly_follows"](spark, folder)
    assert 0 < len(expected) < 240 + hot
    assert sorted(map(tuple, found.collect())) == expected
    log, whole = day_by_case(spark, folder)
    assert whole == (hot == 0)
    cases = directly_follows_cases(log, PAIRS, whole)
    assert sorted(r[CASE] for r in cases.collect()) == sorted({case for case, *_ in expected})


def test_tasks_hold_some_events_and_sort_them_once(spark, tmp_path, monkeypatch):
    folder, _ = event_table(spark, tmp_path)
    monkeypatch.setattr(derived, "EVENTS_PER_TASK", 10)
    found = entry.queries()["b2_directly_follows"](spark, folder)
    told = plan(found)
    assert "Join" not in told and told.count("Sort ") == 1
    told = plan(entry.queries()["g2_union_of_relations"](spark, folder))
    assert told.count("Sort ") == 1 and told.count("Aggregate(") == 2  # those of the boundaries
    cores = spark.sparkContext.defaultParallelism
    assert derived.event_tasks(spark, folder) == cores * (1 + 160 // (10 * cores)) == found.rdd.getNumPartitions()


def test_whole_cases_as_cut_ones(spark):
    rows = [event(case, at, name, at, at + 1) for case in ("x", "y", None) for at, name in enumerate("abca")]
    rows += [event("z", 1, "b", 1, 2), event("z", 2, None, 2, 3), event("z", 3, "b", 3, 4), event("y", 0, "a", 0, 1)]
    log = log_of(spark, rows)
    for pairs in ([("a", "b")], [("c", "a"), ("b", "b")], [("c", "b")], [("a", "a")], []):
        for retain in (True, False):
            whole = directly_follows(log, pairs, retain, whole=True)
            assert whole.columns == log.columns
            plain = directly_follows(log, pairs, retain)
            assert sorted(map(str, whole.collect())) == sorted(map(str, plain.collect()))
            assert any(r[CASE] is None for r in whole.collect()) != retain
        cases = [sorted(map(str, directly_follows_cases(log, pairs, whole).collect())) for whole in (True, False)]
        assert cases[0] == cases[1]

"""XES files on little disk: compressed, and read by part without a shuffle of the events."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from casegate.operators import prepare
from casegate.plans import file_queries
from casegate.schema import CASE
from casegate.sources import files
from casegate.sources.files import PART, read_xes, read_xes_events, write_xes
from tests.logs import event, log_of

COLUMNS = ["case_id", "activity", "resource", "start_ts", "end_ts", "duration_us", "amount", "note"]


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="casegate-test-")


def small_log(spark, cases=40):
    rows = [event(f"c{i}", 2 * i + j, "ab"[j], 1 + j, 2 + j, f"R{i % 3}") for i in range(cases) for j in range(2)]
    return log_of(spark, rows, "amount double, note string", [(i / 4, None if i % 5 else f"n<{i}") for i in range(2 * cases)])


def shown(log):
    return sorted(map(tuple, log.select(COLUMNS).collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def xes(traces):
    """Traces as (case, [(activity, transition, resource, hour)])."""
    text = []
    for case, events in traces:
        name = "" if case is None else f'<string key="concept:name" value="{case}"/>'
        body = "".join(
            f'<event><string key="concept:name" value="{a}"/><string key="org:resource" value="{r}"/>'
            f'<string key="lifecycle:transition" value="{t}"/><date key="time:timestamp" value="2022-01-01T{h:02d}:00:00"/></event>'
            for a, t, r, h in events
        )
        text.append(f"<trace>{name}{body}</trace>")
    return f"<log>{''.join(text)}</log>"


def hours(log):
    rows = log.select("case_id", "activity", "resource", F.hour("start_ts"), F.hour("end_ts")).collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", ["out.xes", "out.xes.gz"])
def test_written_logs_are_read_without_a_shuffle(spark, folder, name):
    log, path = small_log(spark), f"{folder}/{name}"
    write_xes(log, path)
    written = [f for f in os.listdir(path) if f.startswith("part-")]
    assert written and all(f.endswith(".gz") == name.endswith(".gz") for f in written)
    back = read_xes(spark, path)
    assert "Exchange" not in plan(back) and PART not in back.columns
    assert shown(back) == shown(log)


def test_round_trip_writes_compressed_files(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(file_queries, "write_xes", lambda log, path: (paths.append(path), write_xes(log, path)))
    file_queries.a1(spark, "/root/testdata/sf0.001")
    assert all(f.endswith(".gz") for f in os.listdir(paths[0].removeprefix("file:")) if f.startswith("part-"))


def test_large_files_are_many_parts_of_whole_cases(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "PART_BYTES", 1_000)
    log = small_log(spark)
    write_xes(log, f"{folder}/many.xes")
    events = read_xes_events(spark, f"{folder}/many.xes")
    assert events.select(PART).distinct().count() > 5
    assert events.select(CASE, PART).distinct().count() == events.select(CASE).distinct().count()
    assert shown(read_xes(spark, f"{folder}/many.xes")) == shown(log)


def test_a_case_in_several_files_is_one_case(spark, folder):
    os.makedirs(path := f"{folder}/two.xes")
    parts = [[("c", [("Pay", "start", "Ann", 1)]), ("d", [("Pay", "complete", "Bob", 3)])], [("c", [("Pay", "complete", "Bob", 4)])]]
    for i, traces in enumerate(parts):
        with open(f"{path}/{i}.xes", "w") as out:
            # small files are read by one task
            out.write(xes(traces) + " " * (6 << 20))
    assert PART not in read_xes_events(spark, path).columns
    assert hours(read_xes(spark, path)) == [("c", "Pay", "Ann", 1, 4), ("d", "Pay", "Bob", 3, 3)]


def test_traces_without_a_name_do_not_pair(spark, folder):
    pair = [("Pay", "start", "Ann", 1), ("Pay", "complete", "Bob", 2)]
    with open(f"{folder}/nameless.xes", "w") as out:
        out.write(xes([(None, pair), (None, [("Pay", "complete", "Cid", 3)]), ("c", pair)]))
    assert hours(read_xes(spark, f"{folder}/nameless.xes")) == [
        ("c", "Pay", "Ann", 1, 2), (None, "Pay", "Bob", 2, 2), (None, "Pay", "Cid", 3, 3)
    ]


def test_intervals_need_one_shuffle(spark):
    marks = [(f"c{i % 7}", i, "Pay", f"R{i}", ("complete", "start", "complete")[i % 3], i) for i in range(60)]
    rows = spark.createDataFrame(marks, "case_id string, seq long, activity string, resource string, transition string, h int")
    rows = rows.withColumn("ts", F.expr("timestamp_ntz '2022-01-01 00:00:00' + make_dt_interval(0, h, 0, 0)"))
    found = prepare.to_intervals(rows.drop("h").withColumn("amount", F.col("seq") * 2))
    assert plan(found).count("Exchange") == 1
    open_starts, expected = {}, []
    for case, seq, _, who, kind, hour in marks:
        if kind == "start":
            open_starts.setdefault(case, []).append((who, hour))
        else:
            first = open_starts[case].pop(0) if open_starts.get(case) else (who, hour)
            expected.append((case, seq, first[0], first[1], hour, seq * 2))
    got = found.collect()
    since = lambda t: (t.day - 1) * 24 + t.hour
    assert sorted((r.case_id, r.seq, r.resource, since(r.start_ts), since(r.end_ts), r.amount) for r in got) == sorted(expected)

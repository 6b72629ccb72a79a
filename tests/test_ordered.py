"""Keys above a task's share are cut into pieces; results stay those of whole windows."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casegate.operators import ordered, prepare
from casegate.operators.discovery import candidate_sequences, differentiating_transitions
from casegate.operators.scan import cuts_of, scan
from casegate.operators.variants import placed_steps, sorted_variants, variant_steps
from casegate.operators.waiting import waiting_time_waste
from casegate.schema import BY_START
from tests.logs import event, log_of, random_cases, sequences


@contextmanager
def tasks(spark, count):
    """As many shuffle partitions, and so as small a share of a task."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(count))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def mixed_log(spark, seed=1):
    rng = random.Random(seed)
    data, labels = [], []
    for i in range(120):
        start = rng.randint(0, 60) / 7
        case = "big" if i % 2 else f"c{i % 9}"
        data.append(event(case, i, rng.choice("abc"), start, start + rng.randint(0, 9) / 5, f"R{i % 3}"))
        labels.append((case == "big", "a" if case == "big" else None, rng.choice([None, "x", "y"])))
    return log_of(
        spark, data, "knocked_out_case boolean, knockout_activity string, attr string", labels
    )


def everything(df, keys, order, added):
    """Plain windows for what ``scan`` adds."""
    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({n: F.lead(s).over(inside) for n, s in added["leads"].items()})
    df = df.withColumns({n: F.last(s, ignorenulls=True).over(upto) for n, s in added["lasts"].items()})
    df = df.withColumns({n: F.sum(s).over(upto) for n, s in added["totals"].items()})
    df = df.withColumns({n: F.least(F.lit(0), F.min(t).over(earlier)) for n, t in added["lows"].items()})
    return df.withColumn("place", F.row_number().over(inside).cast("long") - 1)


@pytest.mark.parametrize("count", [1, 2, 7, 40])
@pytest.mark.parametrize("keys", [["k"], ["k", "l"], []])
def test_scan_of_one_case_of_equal_timestamps(spark, count, keys):
    """Nine rows in ten belong to one key and one time: only the last part of the order tells them apart."""
    rng = random.Random(count)
    data = [
        (
            "big" if i % 10 else rng.choice(["a", "b", None]),
            i % 2,
            7 if i % 10 else rng.choice([None, 3, 7, 9]),
            i * 37 % 1000,
            rng.choice([-1, 1]),
            rng.choice([None, None, i]),
        )
        for i in range(1000)
    ]
    df = spark.createDataFrame(data, "k string, l int, t long, seq long, v long, w long").repartition(5)
    added = {"leads": {"nxt": "seq", "nw": "w"}, "lasts": {"known": "w"}, "totals": {"sum": "v"}, "lows": {"low": "sum"}}
    found = scan(df, keys, ["t", "seq"], tasks=count, position="place", **added)
    assert rows(found) == rows(everything(df, keys, ["t", "seq"], added))
    cuts = cuts_of(df, keys, ["t", "seq"], count)
    assert (cuts is None) == (count < 2 or (count == 2 and bool(keys)))
    if count == 40:
        pieces = cuts.pieces_of(df, "inner").groupBy(*keys, "_piece").count().collect()
        assert len(pieces) > 15 and max(r["count"] for r in pieces) < 100


def test_scan_takes_peers_together(spark):
    data = [(i % 2, i // 7, 1) for i in range(300)]
    df = spark.createDataFrame(data, "k int, t long, v long")
    inside = Window.partitionBy("k").orderBy("t")
    plain = df.withColumn("sum", F.sum("v").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    assert rows(scan(df, ["k"], ["t"], tasks=20, totals={"sum": "v"}, peers=True)) == rows(plain)


def test_whole_keys_are_shuffled_once(spark):
    log = mixed_log(spark)
    with tasks(spark, 2):
        plan = ordered.sequence(log, BY_START, {"nxt": "activity"}, "pos")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_sequence_and_fill(spark):
    log = mixed_log(spark)
    for step in (
        lambda: ordered.sequence(log, BY_START, {"nxt": "activity", "later": "start_ts"}, "pos"),
        lambda: ordered.forward_fill(log, BY_START, {"filled": "attr"}),
    ):
        found = []
        for count in (1, 30):
            with tasks(spark, count):
                found.append(rows(step()))
        assert found[0] == found[1]


def test_intervals(spark):
    rng = random.Random(3)
    data = [
        (f"c{i % 2}", i, "A", rng.choice(["start", "complete"]), f"R{i}", event("", 0, "", rng.randint(0, 30), 40)[4])
        for i in range(60)
    ]
    schema = "case_id string, seq long, activity string, transition string, resource string, ts timestamp_ntz"
    log = spark.createDataFrame(data, schema)
    expected = []
    for case in ("c0", "c1"):
        waiting = []
        for _, seq, _, transition, who, ts in sorted((r for r in data if r[0] == case), key=lambda r: (r[5], r[1])):
            if transition == "start":
                waiting.append((ts, who))
            else:
                begin, first = waiting.pop(0) if waiting else (ts, who)
                expected.append((case, seq, first, begin, ts))
    for count in (1, 20):
        with tasks(spark, count):
            found = prepare.to_intervals(log).select("case_id", "seq", "resource", "start_ts", "end_ts")
            assert sorted(map(tuple, found.collect())) == sorted(expected)


@pytest.mark.parametrize("seed", [1, 2])
def test_waiting_sweep_against_pairs(spark, seed):
    log = mixed_log(spark, seed)
    data = [r.asDict() for r in log.collect()]
    passing = {}
    for r in sorted(data, key=lambda r: (r["start_ts"], r["seq"])):
        if not r["knocked_out_case"]:
            passing.setdefault(r["case_id"], []).append(r)
    total = 0.0
    for events in passing.values():
        for now, then in zip(events, events[1:]):
            for work in data:
                if work["knockout_activity"] and work["resource"] == now["resource"]:
                    low = max(now["end_ts"], work["start_ts"])
                    high = min(then["start_ts"], work["end_ts"])
                    if high > low and then["start_ts"] > now["end_ts"]:
                        total += (high - low).total_seconds()
    for count in (1, 30):
        with tasks(spark, count):
            found = waiting_time_waste(log, ["a"]).first()["waiting_waste_us"]
        assert found == round(total * 1_000_000)


def test_running_totals_and_index(spark):
    rng = random.Random(5)
    data = [(f"k{i % 3}", i * 7 % 101, rng.randint(-5, 5)) for i in range(101)]
    points = spark.createDataFrame(data, "k string, t long, v long")
    expected = sorted((k, t, sum(w for j, u, w in data if j == k and u <= t)) for k, t, _ in data)
    for count in (1, 20):
        with tasks(spark, count):
            assert sorted(map(tuple, ordered.running_totals(points, ["k"], "t", ["v"]).collect())) == expected
    totals = ordered.ordered_totals(points, ["t"], {"s": "v"}, by=["k"]).select("k", "t", "s")
    assert sorted(map(tuple, totals.collect())) == expected
    ranked = ordered.dense_index(points.repartition(4), ["t"], "i").select("t", "i").collect()
    assert sorted(tuple(r) for r in ranked) == [(i, i) for i in range(101)]


#: Logs by hand: cases as strings of activities, a limit, and the candidates with what follows them and the
#: length of the variant that brings them up.
CANDIDATES = [
    # Each variant's first transition is its own; the activity after it is followed by the outcome.
    (["SAXE", "SBYE"], 9, {"S": ("A", "X", 4), "A": ("X", "X", 4), "B": ("Y", "Y", 4)}),
    # S-A occurs twice, so A-X sets the first variant apart, and X stands at the last but one place.
    (["SAXE", "SBYE", "SABCE"], 9, {"A": ("X", "X", 4), "S": ("B", "Y", 4), "B": ("Y", "Y", 4)}),
    # One candidate is enough, but the refused X keeps the search going for one more variant.
    (["SAXE", "SBYE", "SABCE"], 1, {"A": ("X", "X", 4), "S": ("B", "Y", 4), "B": ("Y", "Y", 4)}),
    # Without a refusal the search ends with the variant that reaches the limit.
    (["SAXE", "SBYE"], 2, {"S": ("A", "X", 4), "A": ("X", "X", 4)}),
    # The last activity of a case is followed by nothing: the outcome takes that place.
    (["SAE", "SABE", "SABCE"], 9, {"A": ("E", "A", 3), "E": ("A", "A", 3), "B": ("E", "B", 4)}),
]


@pytest.mark.parametrize("cases, limit, expected", CANDIDATES)
def test_candidates_of_logs_by_hand(spark, cases, limit, expected):
    steps = placed_steps(sequences(spark, cases))
    table = sorted_variants(steps)
    kept = variant_steps(steps, table).checkpoint()
    best = differentiating_transitions(kept, table)
    found = candidate_sequences(kept, table, best, limit).collect()
    assert {r["candidate"]: (r["followed_by"], r["outcome"], r["variant_len"]) for r in found} == expected


def test_variants_do_not_depend_on_row_order(spark):
    log = sequences(spark, random_cases(9))
    again = log.orderBy(F.rand(1)).repartition(5)
    first = rows(sorted_variants(placed_steps(log)))
    with tasks(spark, 60):
        assert first == rows(sorted_variants(placed_steps(again)))


def test_states_read_steps_that_are_written_once(spark):
    from casegate.operators.wip import states

    steps = spark.createDataFrame([("cases", 2, -1), ("cases", 1, 2), ("task a", 1, 1)], "series string, t long, delta long")
    found = states(steps.filter(F.col("t") > 0))
    assert found.inputFiles()
    assert sorted(map(tuple, found.collect())) == [("cases", 1, 2), ("cases", 2, 1), ("task a", 1, 1)]


def test_producers_read_labelled_events_that_are_written_once(spark):
    from casegate.operators.redesign import attribute_producers

    rows = [("a", 1, "load", 1, 1, None, "check"), ("a", 2, "check", 2, 2, 5.0, "check"), ("b", 3, "load", 1, 1, None, None)]
    log = spark.createDataFrame(rows, "case_id string, seq long, activity string, start_ts long, end_ts long, amount double, knockout_activity string")
    found = attribute_producers(log, ["amount"])
    assert found.inputFiles()
    assert [tuple(r) for r in found.collect()] == [("a", "check", "amount", "load")]

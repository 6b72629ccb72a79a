"""Small logs for tests."""

import random
from datetime import datetime, timedelta

LOG = (
    "case_id string, seq long, activity string, resource string, start_ts timestamp_ntz, "
    "end_ts timestamp_ntz, duration_us long"
)


def at(hours):
    return datetime(2022, 2, 17) + timedelta(hours=hours)


def event(case, seq, activity, start, end, resource="R1"):
    return (case, seq, activity, resource, at(start), at(end), int((end - start) * 3_600_000_000))


def log_of(spark, rows, extra="", more=()):
    schema = LOG + (", " + extra if extra else "")
    data = [(*r, *m) for r, m in zip(rows, more)] if extra else rows
    return spark.createDataFrame(data, schema)


def sequences(spark, cases):
    """A log from lists of activities, one hour each."""
    rows = [
        event(f"c{i:03d}", i * 1000 + p, a, p, p + 0.5)
        for i, case in enumerate(cases)
        for p, a in enumerate(case)
    ]
    return log_of(spark, rows)


def random_cases(seed, count=25, letters="abcd", longest=6):
    rng = random.Random(seed)
    return [
        ["Start", *(rng.choice(letters) for _ in range(rng.randint(1, longest))), "End"] for _ in range(count)
    ]

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from casegate.llm import exact
from casegate.llm.queries import op12_exact_dedup
from tests.llm.helpers import SF, clashing, documents

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def check(rows, docs):
    """``rows`` (id, keep_id, group_size, kept, sha) against the documents, by groups of equal texts."""
    assert sorted(str(r[0]) for r in rows) == sorted(str(k) for k, _ in docs)
    groups = {}
    for key, text in docs:
        groups.setdefault(hashlib.sha256((text or "").encode()).hexdigest(), []).append(key)
    seen = {}
    for key, keep, size, kept, sha in rows:
        assert key in groups[sha] and size == len(groups[sha])
        assert keep == max((k for k in groups[sha] if k is not None), default=None)
        seen.setdefault(sha, []).append((key, kept))
    for sha, members in seen.items():
        assert sorted(str(k) for k, _ in members) == sorted(map(str, groups[sha]))
        (winner,) = [k for k, kept in members if kept]
        assert winner == max((k for k in groups[sha] if k is not None), default=None)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [tuple(r) for r in op12_exact_dedup(spark, SF).select(*COLUMNS).collect()]
    check(rows, docs)


@pytest.mark.parametrize("lanes, fan", [(1, 16), (3, 2), (7, 2), (40, 3), (40, 16)])
def test_lanes_and_rounds(spark, monkeypatch, lanes, fan):
    rng = random.Random(lanes)
    docs = [(i, f"text {rng.randrange(60)}" if i % 3 else "a very frequent text") for i in range(400)]
    monkeypatch.setattr(exact, "FAN", fan)
    df = documents(spark, docs).repartition(lanes)
    # groups go on over Arrow batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    check([(*r[:4], r[4].hex()) for r in exact.duplicates(df, df["doc_id"], df["text"]).collect()], docs)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " "), (4, "x" * 300_000), (9, "x" * 300_000), (5, "é"), (6, "é"), (7, "é")]
    docs += [(None, "null id"), (None, "null id"), (None, "shared"), (11, "shared"), (12, "twice"), (12, "twice"), (-3, "minus"), (-4, "minus")]
    df = clashing(documents(spark, docs), "id", "row", "digest", "lane", "members", "keep_id").repartition(5)
    check([(*r[:4], r[4].hex()) for r in exact.duplicates(df, df["doc_id"], df["text"]).collect()], docs)
    none = documents(spark, [])
    assert exact.duplicates(none, none["doc_id"], none["text"]).count() == 0


def test_least_id_and_normalised_texts(spark):
    df = documents(spark, [(5, "Same Text"), (3, "same text"), (8, "SAME TEXT"), (1, "other")])
    found = exact.duplicates(df, df["doc_id"], df["text"], normalise=F.lower, keep="smallest")
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in found.collect()) == [
        (1, 1, 1, True),
        (3, 3, 3, True),
        (5, 3, 3, False),
        (8, 3, 3, False),
    ]


def test_fold_keeps_texts_of_unequal_proof_apart(spark):
    rows = [(b"d", 4, 1, 10, 0, 1), (b"d", 4, 1, 9, 1, 2), (b"d", 4, 2, 8, 2, 1), (b"e", 4, 2, 7, 3, 5)]
    df = spark.createDataFrame(rows, "digest binary, bytes long, proof long, id long, row long, members long").coalesce(1)
    folded = exact._merged(df, exact._TEXT).collect()
    assert [(bytes(r.digest), r.id, r.members) for r in folded] == [(b"d", 10, 3), (b"d", 8, 1), (b"e", 7, 5)]

import math
import random
import zlib

import numpy as np
import pytest

from casegate.llm import toxicity
from casegate.llm.queries import op5_toxicity
from tests.llm.helpers import clashing, documents

MID = "/root/testdata/sf0.01"


def brute(vectors, query, k):
    every = [(round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), -at) for at, v in enumerate(vectors)]
    return [(-at, c) for c, at in sorted(every, reverse=True)[:k] if c > 0]


@pytest.mark.parametrize("seed", range(6))
def test_index_is_exact(seed):
    rng = random.Random(seed)
    terms = 12

    def unit():
        raw = {t: rng.choice([1.0, 2.0, rng.random()]) for t in rng.sample(range(terms), rng.randint(1, 4))}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in sorted(raw.items())}

    vectors = [unit() for _ in range(700)]
    index = toxicity.Index(vectors, terms)
    for _ in range(40):
        query = unit()
        places, cosines = index.nearest(query, 25)
        assert np.allclose(cosines, [c for _, c in brute(vectors, query, 25)])
        assert places.tolist() == [p for p, _ in brute(vectors, query, 25)]


def test_monotone_fit():
    knots, values = toxicity.monotone(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0.0, 1, 0, 0, 1]), np.ones(5))
    assert list(knots) == [0.1, 0.1, 0.2, 0.3, 0.9, 0.9]
    assert np.allclose(values, [0, 0, 1 / 3, 1 / 3, 1, 1])


def labelled(spark, n=240):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"w{rng.randrange(400)}" for _ in range(40)] + (["nastyword" + "abc"[i % 3], "VILE"] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(n, None), (n + 1, ""), (None, "some vile text"), (n + 2, "vile " * 50_000), (n + 2, "vile " * 50_000)]
    labels += [(0, 1, 1), (1, 0, None), (None, 0, 1), (9_999, 1, 1)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_votes_and_edge_cases(spark):
    rows, labels = labelled(spark)
    docs = clashing(documents(spark, rows), "id", "score", "label", "terms", "aside", "row")
    model = toxicity.fit(docs, labels)
    assert b"vile" in model.terms.number and b"nasty*" in model.terms.number
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    by = {r.id: r.score for r in scored}
    assert all((by[i] >= 0.3) == (i % 4 == 0) for i in range(240))
    assert by[240] < 0.3 and by[241] < 0.3 and by[None] >= 0.3 and by[242] >= 0.3
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in by.items() if s < 0.3}
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_long_words_are_told_apart():
    a, b = b"x" * 40 + b"1", b"x" * 40 + b"2"
    assert toxicity.terms_of(a)[0] != toxicity.terms_of(b)[0] and toxicity.terms_of(a)[1:] == toxicity.terms_of(b)[1:]
    assert toxicity.terms_of(b"short")[0] == b"short"


def test_equal_cosines_rank_by_id():
    examples = [(i, 1, False, (0,), (1,)) for i in (12, 9, 100)] + [("b", 0, False, (0,), (1,)), ("a", 0, False, (0, 1), (1, 3))]
    model = toxicity.Model([b"vile", b"other"], np.ones(2), examples, {0: 2, 1: 3})
    places, _ = model.index.nearest(model.vector({0: 1}), 4)
    assert [model.ids[p] for p in places] == ["9", "12", "100", "b"]


def test_query_against_brute_force(spark, tmp_path):
    """Scores from cosines to every example, votes and calibration, without the index."""
    rows, labels = labelled(spark)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, own = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, own.where(~toxicity.held_out()))
    vectors = [{} for _ in model.ids]
    for term, (places, weights) in enumerate(zip(model.index.places, model.index.weights, strict=True)):
        for place, weight in zip(places.tolist(), weights.tolist(), strict=True):
            vectors[place][term] = weight
    number = lambda i: (int(i), "") if i.lstrip("-").isdigit() else (math.inf, i)

    def expected(text):
        counts = model.terms.counts((text or "").encode())
        if not counts:
            return model.bare, []
        query = model.vector(counts)
        every = [(-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), number(model.ids[p]), p) for p, v in enumerate(vectors)]
        near = [(-c, p) for c, _, p in sorted(every) if c < 0][: toxicity.NEIGHBOURS]
        if not near:
            return model.bare, []
        voices = [model.class_weight[int(model.labels[p])] / (1.05 - c) for c, p in near]
        vote = sum(v * model.labels[p] for v, (_, p) in zip(voices, near, strict=True)) / (sum(voices) + model.class_weight[0] / 0.05)
        return float(np.interp(vote, model.knots, model.values)), [model.ids[p] for _, p in near[:3]]

    found = {}
    for r in op5_toxicity(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, (r.score, list(r.nearest)))
    for key, text in rows:
        score, nearest = expected(text)
        assert found[key][0] == pytest.approx(score, abs=1e-9) and found[key][1] == nearest, key


def test_without_labels_every_score_is_zero(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]


def test_query_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = op5_toxicity(spark, MID).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = ([s for s, y in held if y == k] for k in (1, 0))
    wins = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean)
    assert wins / (len(toxic) * len(clean)) > 0.75  # some 260 labels to learn from

import re

import corpus_pipeline
from casegate.llm import toxicity
from tests.llm.helpers import SF
from tests.llm.test_decontamination import WORD, plain as plain_scan, plain_words
from tests.llm.test_fingerprints import shingles
from tests.llm.test_packing import check_pieces
from tests.llm.test_pii import plain as plain_pii
from tests.llm.test_simhash import plain_components


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    functions = dict(corpus_pipeline.STAGES)
    scored = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(
        docs, spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out()))).collect()}

    def apply(name, df):
        out = functions[name](spark, df, SF)
        rows = out.collect()
        if name != "packing":
            assert out.dtypes == docs.dtypes
            assert all(len(r.text) == r.n_chars for r in rows)
        return spark.createDataFrame(rows, out.schema), rows

    start = {r.doc_id: r.text for r in docs.collect()}
    df, rows = apply("toxicity", docs)
    assert {r.doc_id: r.text for r in rows} == {i: t for i, t in start.items() if scored[i] < 0.3}

    before = [(r.doc_id, r.text) for r in rows]
    df, rows = apply("near_duplicates", df)
    label = {i: c for i, _, c in plain_components(before)}  # within four bits, or four fifths alike
    sets = {i: shingles(t) for i, t in before}
    for i, _ in before:
        for j, _ in before:
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if c == high else c for k, c in label.items()}
    assert {r.doc_id for r in rows} == set(label.values()) and len(rows) < len(before)

    before = {r.doc_id: r.text for r in rows}
    df, rows = apply("decontamination", df)
    after = {r.doc_id: r.text for r in rows}
    hits = {i: (n, h, bad) for i, n, h, _, _, bad in plain_scan(list(before.items()), items)}
    assert any(bad for _, _, bad in hits.values())
    for doc, text in before.items():
        n, hit, bad = hits[doc]
        if not bad:
            assert after[doc] == text
        elif 2 * hit >= n:
            assert doc not in after
        else:
            assert len(plain_words(after[doc])) == n - hit
            assert not any(x[5] for x in plain_scan([(doc, after[doc])], items))

    before = after
    df, rows = apply("personal_data", df)
    after = {r.doc_id: r.text for r in rows}
    assert after.keys() == before.keys()
    for doc, text in before.items():
        assert not plain_pii(after[doc])
        if not plain_pii(text) and "AKIA" not in text:
            assert after[doc] == text
    assert WORD and re.search(r"\[EMAIL\]", " ".join(after.values()))

    _, pieces = apply("packing", df)
    check_pieces(pieces, list(after.items()), 0)


def test_run_is_the_stages(spark):
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0 and packed.columns[:2] == ["doc_id", "start"]

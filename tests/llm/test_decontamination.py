import hashlib
import random
import re

from casegate.llm import decontamination
from casegate.llm.queries import op2_decontamination
from tests.llm.helpers import SF, clashing, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items):
    """Every window of every item against every position of every document."""
    windows = {}
    for item, text in items:
        words = plain_words(text)
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    result = []
    for doc, text in rows:
        words = plain_words(text)
        hit, held = set(), set()
        for size in lengths:
            for k in range(len(words) - size + 1):
                if (items_here := windows.get(tuple(words[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    held |= items_here
        listed = ",".join(sorted(str(i) for i in held if i is not None))
        digest = hashlib.sha256(listed.encode()).hexdigest()
        n = len([i for i in held if i is not None])
        result.append((doc, len(words), len(hit), n, digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return sorted(result, key=str)


def found(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def digest_rows(report):
    rows = []
    for r in report.collect():
        digest = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        rows.append((r.id, r.n_words, r.n_hit, len(r["items"]), digest, r.contaminated))
    return sorted(rows, key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = found(op2_decontamination(spark, SF))
    assert got == plain(rows, items)
    assert any(r[5] for r in got)


def case(seed):
    """Few words, so that items, documents and their parts repeat each other in many ways."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "é", "7"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 2, 5, 12, 13, 14, 40])))) for i in range(12)]
    items += [(None, items[3][1]), (2, items[-1][1]), (99, None), (100, "!?")]
    rows = [(i, " ".join(rng.choices(vocabulary + ["other"] * (i % 3), k=rng.choice([0, 3, 30, 200])))) for i in range(30)]
    rows += [(7, "x " + (items[5][1] or "") + " y"), (7, "x " + (items[5][1] or "") + " y"), (None, items[8][1]), (50, None)]
    return rows, items


def test_random_cases(spark):
    for seed in range(4):
        rows, items = case(seed)
        docs = clashing(documents(spark, rows), "row", "id", "n_words", "spans", "items")
        bench = spark.createDataFrame(items, "item_id long, text string")
        for limit in (decontamination.BLOCK_WORDS, 40):  # one automaton, several
            assert digest_rows(decontamination.report(docs, bench, block_words=limit)) == plain(rows, items)


def test_a_task_runs_one_pass(spark):
    rows, items = case(0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontamination.BLOCK_WORDS, 40):
        report = decontamination.report(documents(spark, rows), bench, block_words=limit)
        kept = decontamination.decontaminate(documents(spark, rows), bench, block_words=limit)
        for made in (report, kept):
            assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_empty_tables_and_long_texts(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame([(1, "w " * 13)], "item_id long, text string")
    assert digest_rows(decontamination.report(documents(spark, [(1, "a b")]), none)) == plain([(1, "a b")], [])
    assert decontamination.report(documents(spark, []), bench).count() == 0
    long = [(1, "w " * 100_000), (2, "z" * 300_000)]
    assert digest_rows(decontamination.report(documents(spark, long), bench)) == plain(long, [(1, "w " * 13)])


def test_passages_go_and_clean_documents_stay(spark):
    passage = " ".join(f"item{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = "Clean, text. " * 30
    rows = [
        (1, clean), (2, clean + passage.upper() + "! And " + clean), (3, passage), (4, None), (5, ""),
        (6, "long " * 500 + passage), (7, clean + " ".join(passage.split()[:12]) + clean),
    ]
    docs = clashing(documents(spark, rows), "row", "spans")
    kept = decontamination.decontaminate(docs, bench, length_col="n_chars")
    assert kept.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    expected = {i: (t, None if t is None else len(t)) for i, t in rows if i != 3}
    expected[2] = (clean + "! And " + clean, len(clean) * 2 + 6)
    assert texts == expected


def test_long_spans_go_in_any_document(spark):
    item = " ".join(f"item{i}" for i in range(400))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = "long " * 10_000
    rows = [(1, long + item + " end"), (2, long + " ".join(item.split()[:50]) + " end"), (3, long), (4, item)]
    for limit, gone in ((None, ()), (400, (1,)), (401, ()), (50, (1, 2))):
        kept = decontamination.decontaminate(documents(spark, rows), bench, length_col="n_chars", max_span=limit)
        expected = {i: long + " end" if i in gone else t for i, t in rows if i != 4}
        assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (t, len(t)) for i, t in expected.items()}

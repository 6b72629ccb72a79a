import hashlib
import random

import numpy as np

from casegate.llm import fingerprints as fp
from casegate.llm.queries import op8_fingerprints
from tests.llm.helpers import SF, clashing, documents


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def true_jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check_rows(rows, docs):
    """``rows`` of the operator against the documents in order."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    wanted = []
    for at, (key, text) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        wanted.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    by = {}
    for r in rows:
        by.setdefault((r[0], r.n_chars, r.edited_sha256), []).append(r)
    assert len(rows) == len(wanted)
    errors = []
    for key, n, digest, text, edited, following in wanted:
        r = by[key, n, digest].pop()
        assert r.fingerprint == fp.fingerprint(fp.signature(fp.shingle_hashes(fp.word_hashes(text.encode().lower().split())))).hex()
        assert r.edited_fingerprint == fp.fingerprint(fp.signature(fp.shingle_hashes(fp.word_hashes(edited.encode().lower().split())))).hex()
        errors += [r.near_edited - true_jaccard(text, edited), r.near_next - true_jaccard(text, following)]
    return np.abs(errors)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    errors = check_rows(op8_fingerprints(spark, SF).collect(), docs)
    assert errors.mean() < 0.025 and errors.max() < 0.2


def test_edge_cases(spark):
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(500))
    docs = [(i * 7 - 50, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(60)]
    docs += [(1000, None), (1001, ""), (1002, "é😀x"), (1003, "  "), (1004, "abc"), (None, "null id"), (None, None), (2000, "x" * 100_000)]
    docs += [(1005, "tie a b c d e"), (1005, "another tie"), (1005, "another tie"), (3000, "one two three four"), (3001, "end")]
    for n in ("1", "2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        check_rows(fp.beside_next(clashing(documents(spark, docs), "id", "at", "guest", "first", "number")).collect(), docs)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert fp.beside_next(documents(spark, [])).count() == 0
    check_rows(fp.beside_next(documents(spark, [(5, "the only one here")])).collect(), [(5, "the only one here")])


def test_estimates_follow_jaccard():
    rng = random.Random(8)
    errors = []
    for _ in range(60):
        words = [f"v{rng.randrange(10_000)}" for _ in range(300)]
        other = list(words)
        for _ in range(rng.randrange(60)):
            other[rng.randrange(300)] = "changed" + str(rng.random())
        a, b = " ".join(words), " ".join(other)
        prints = [fp.fingerprint(fp.signature(fp.shingle_hashes(fp.word_hashes(t.encode().split())))) for t in (a, b)]
        errors.append(fp.likeness(*prints) - true_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    docs = []
    for base in range(6):
        words = [f"b{base}x{rng.randrange(3000)}" for _ in range(120)]
        for copy in range(8):
            changed = list(words)
            for _ in range(copy):
                changed[rng.randrange(120)] = f"new{rng.randrange(10**6)}"
            docs.append((len(docs) * 3 + 1, " ".join(changed)))
    docs += [(900, None), (901, ""), (902, "few words"), (903, "FEW words"), (None, docs[0][1]), (1, docs[0][1])]
    label = {i: i for i in range(len(docs))}
    for i in range(len(docs)):
        for j in range(i):
            if true_jaccard(docs[i][1], docs[j][1]) >= 0.8 and label[i] != label[j]:
                old = label[i]
                label = {k: label[j] if v == old else v for k, v in label.items()}
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[label[i]] = min(key, least.get(label[i], key))
    wanted = sorted(((key, least.get(label[i])) for i, (key, _) in enumerate(docs)), key=str)
    for tile in (fp.TILE, 3):
        got = sorted(((r.id, r.class_id) for r in fp.near_duplicates(documents(spark, docs), tile=tile).collect()), key=str)
        assert got == wanted
    assert fp.near_duplicates(documents(spark, [])).count() == 0

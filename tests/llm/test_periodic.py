import hashlib
import random
import zlib

import numpy as np

from casegate.llm import periodic
from casegate.llm.queries import op11_periodic
from tests.llm.helpers import SF, clashing, documents


def brute_runs(words):
    """Every stretch that keeps a period and cannot be made longer, smallest periods only."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i) + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def brute_collapse(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def altered(key, words):
    n = len(words)
    if key is None or not n:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def check(words):
    found = periodic.runs(periodic.codes(words))
    wanted = brute_runs(words)
    assert found == wanted, words
    assert periodic.collapsed(words, found) == b" ".join(brute_collapse(words, wanted))
    return len(found)


def test_runs_of_small_alphabets():
    rng = random.Random(11)
    total = 0
    for turn in range(2500):
        size = rng.choice((1, 2, 2, 3, 5))
        total += check([b"%d" % rng.randrange(size) for _ in range(rng.randrange(60))])
    assert total > 500


def test_runs_of_repeated_blocks():
    rng = random.Random(12)
    total = 0
    for turn in range(900):
        words = []
        while len(words) < 150:
            block = [b"%d" % rng.randrange(rng.choice((2, 3, 40))) for _ in range(rng.randrange(1, 12))]
            block = block * rng.randrange(1, 4) + block[: rng.randrange(3)]
            words += block * rng.randrange(1, 8) + block[: rng.randrange(len(block) + 1)]
        total += check(words)
    assert total > 1500


def test_fibonacci_and_single_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 1500:
        a, b = b, b + a
    check(b)
    check(b * 3)
    assert periodic.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    line = np.arange(10)
    assert periodic.runs(np.tile(line, 30_000)) == [(0, 300_000, 10)]
    assert periodic.runs(np.random.default_rng(5).permutation(200_000)) == []
    coin = np.random.default_rng(6).integers(0, 2, 30_000)
    assert all(length >= max(6, 4 * q) for _, length, q in periodic.runs(coin))


def digest_rows(docs):
    rows = []
    for key, text in docs:
        words = altered(key, (text or "").encode().split())
        found = brute_runs(words)
        longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        rows.append(
            (
                key,
                len(found),
                *((longest[0], longest[1], longest[2], 1000 * longest[1] // longest[2]) if longest else (None,) * 4),
                hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
                hashlib.sha256(b" ".join(brute_collapse(words, found))).hexdigest(),
            )
        )
    return sorted(rows, key=str)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = op11_periodic(spark, SF)
    rows = sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)
    assert rows == digest_rows(docs)
    assert sum(1 for r in rows if r[2] is not None) > 5


def test_edge_cases(spark, tmp_path):
    docs = [(i, "one two three four five six seven eight nine ten " * (i % 7)) for i in range(80)]
    docs += [(None, "a b " * 9), (None, None), (200, None), (201, ""), (202, " \t\n\x0b\x0c\r "), (203, "  " * 9), (204, "x" * 100_000)]
    docs += [(205, "tie tie tie tie tie tie x y y y y y y"), (206, "same row " * 5), (206, "same row " * 5), (207, "a\x00b " * 8)]
    zeros = [i for i in range(100_000, 110_000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    docs += [(i, " ".join(f"w{(k * 7) % 50}" for k in range(i % 23 * 5))) for i in zeros] + [(zeros[0], None), (zeros[1], " "), (zeros[2], "one")]
    clashing(documents(spark, docs), "id", "runs", "collapsed", "n_words", "h", "g", "start").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted((tuple(r) for r in op11_periodic(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)
    assert rows == digest_rows(docs)
    empty = tmp_path / "empty"
    documents(spark, []).write.parquet(f"{empty}/documents.parquet")
    assert op11_periodic(spark, str(empty)).count() == 0


def test_find_gives_runs_and_text(spark):
    docs = documents(spark, [(1, "go a b a b a b a b stop")])
    (row,) = periodic.find(docs, docs["doc_id"], docs["text"]).collect()
    assert [tuple(r) for r in row.runs] == [(1, 8, 2)] and row.n_words == 10
    assert row.collapsed == "go a b stop"

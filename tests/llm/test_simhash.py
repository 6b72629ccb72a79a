import random
import re

import numpy as np
import pytest
import xxhash

from casegate.llm import simhash
from casegate.llm.queries import op3_simhash
from tests.llm.helpers import SF, clashing, documents


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and label[i] != label[j]:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, label, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(op3_simhash(spark, SF)) == plain_components(rows)


def edge_rows():
    rng = random.Random(3)
    base = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "é\xa0É x\x85y"),
        (8, " ".join(base)), (9, " ".join(near)), (9, " ".join(near)), (None, " ".join(base)), (None, "alone null id"),
        (10, "word " * 60_000), (11, "x" * 200_000), (5, "other text of the same id"), (12, "a b c d e f g h i j k l"),
    ]


def test_edge_cases(spark):
    rows = edge_rows()
    docs = clashing(documents(spark, rows), "fp", "root", "component_id", "fingerprint", "id", "hi", "a")
    assert found(simhash.near_duplicates(docs)) == plain_components(rows)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_of_each_keeps_the_least(spark):
    docs = clashing(documents(spark, edge_rows()), "fp", "root", "id", "key", "node")
    kept = simhash.one_of_each(docs, least=None)
    assert kept.columns == docs.columns
    prints = [plain_fingerprint(r.text) for r in kept.collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12] and ids.count(None) == 1
    assert sorted(map(tuple, simhash.one_of_each(docs).collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def shared(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_beyond_the_radius_go_too(spark):
    rng = random.Random(12)
    rows = []
    for base in range(5):
        words = [f"w{base}x{rng.randrange(900)}" for _ in range(200)]
        rows.append((base * 10, " ".join(words)))
        for copy in range(1, 5):
            changed = list(words)
            for at in rng.sample(range(200), 2):
                changed[at] = f"other{rng.randrange(10**6)}"
            rows.append((base * 10 + copy, " ".join(changed)))
    far = [(100 + i, " ".join(rng.choices(rows[i * 5][1].split(), k=200))) for i in range(5)]
    assert min(shared(rows[b * 5][1], rows[b * 5 + c][1]) for b in range(5) for c in range(1, 5)) >= 0.8
    kept = simhash.one_of_each(documents(spark, rows + far))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 30, 40, 100, 101, 102, 103, 104]


@pytest.mark.parametrize("tile", [3, 1 << 16])
def test_large_group_of_near_copies_in_small_tiles(spark, tile):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (200, 2))}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 300)}
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "id long, fp long")
    got = {r.fp: r.component_id for r in simhash.components(df, tile=tile).collect()}
    label = {p: i for i, p in rows}
    changed = True
    while changed:
        changed = False
        for p in label:
            for q in label:
                if (p ^ q).bit_count() <= 4 and label[q] < label[p]:
                    label[p], changed = label[q], True
    assert got == label
    # a forest per pair of tiles: a tile meets at most 41 classes of population counts
    assert simhash.links(df.select("fp"), tile=10**6).count() < 41 * len(rows)

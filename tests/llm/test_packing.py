import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from casegate.llm import packing
from casegate.llm.queries import op1_packing
from casegate.llm.tokens import default_vocabulary, encoder
from tests.llm.helpers import SF, clashing, documents

PLAIN = Tokenizer.from_file(default_vocabulary())


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 0]


def check_pieces(pieces, rows, most_padding):
    """Each document's ids once, in whole, and sequences without gaps; returns the share of padding."""
    wanted, got = defaultdict(int), defaultdict(int)
    for doc, text in rows:
        ids = plain_ids(text)
        wanted[doc] += len(ids)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    ids_of = {doc: np.array(plain_ids(text), "<u4") for doc, text in rows}
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
        got[p.doc_id] += p.length
        own = ids_of[p.doc_id]
        assert p.doc_tokens == len(own) and p.length >= 1
        assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
    assert got == wanted
    padding = total = 0
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and {p.sequence_length for p in sequence} == {at}
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= most_padding * total
    copies = {doc: sum(d == doc for d, _ in rows) for doc, _ in rows}
    for doc, own in by_doc.items():
        covered = sorted((p.start, p.length) for p in own)
        for start in range(0, len(ids_of[doc]), 97):
            assert sum(s <= start < s + n for s, n in covered) == copies[doc]


def named(df):
    return df.withColumnRenamed("id", "doc_id").collect()


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = op1_packing(spark, SF).collect()
    check_pieces(pieces, rows, 0)
    groups = defaultdict(lambda: defaultdict(set))
    for p in pieces:
        groups[p.sequence_length][p.step_group].add(p.sequence_id)
    sizes = [len(g) for g in groups[1024].values()]
    assert max(sizes) <= 16 and max(sizes) - min(sizes) <= 1


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "x"), (4, "word " * 30_000), (5, "y" * 50_000), (6, "a <|endoftext|> b"),
        (7, "日本語 text ☃   here's"), (8, "it's  two   spaces\n\n end \xa0 ²3½ Ünï"), (None, "no id"), (9, "same"), (9, "same"),
    ]
    docs = clashing(documents(spark, rows), "id", "start", "length", "sequence_id")
    check_pieces(named(packing.pack(docs, default_vocabulary())), rows, 0)
    assert packing.pack(documents(spark, []), default_vocabulary()).count() == 0


def test_ids_round_trip(spark):
    rows = [(i, "some words of a text " * (i * 13 % 90)) for i in range(60)]
    packed = packing.pack(documents(spark, rows), default_vocabulary(), with_ids=True).collect()
    for doc, text in rows:
        own = sorted((p.start, p.ids) for p in packed if p.id == doc)
        assert [i for _, ids in own for i in ids] == plain_ids(text)


def test_encoder_matches_the_tokenizer():
    every = "".join(map(chr, range(1, 0x260)))
    texts = [every, " ".join(every), "\n\n  x\t\t y 's 'S 'll'd  ", *(f"a{c}{c} {c}b" for c in every)]
    own = encoder(default_vocabulary())
    for text in texts:
        assert np.frombuffer(own.bytes_of(text), "<u4").tolist() == plain_ids(text)[:-1]


def test_windows_are_full_and_costs_level():
    packer = packing.Packer(step_tokens=4096)
    rng = np.random.default_rng(5)
    for doc in range(400):
        packer.add(doc, bytes(4 * int(rng.integers(1, 3000))))
    packer.pack()
    windows = list(packer.windows())
    assert {t for t, _, _ in windows} <= set(packing.TIERS)
    assert all(sum(p.length for p in w) == t for t, _, w in windows)
    cost = defaultdict(int)
    for t, g, w in windows:
        if t == 1024:
            cost[g] += sum(p.length**2 for p in w)
    assert max(cost.values()) <= 1.35 * np.mean(list(cost.values()))
    packer.close()
    tail = [t for t, _, _ in packer.windows()]
    assert sum(tail) < 1024 and len(set(tail)) == len(tail)

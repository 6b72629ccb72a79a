import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casegate.llm import token_counts
from casegate.llm.queries import op4_token_counts
from casegate.llm.tokens import default_vocabulary, encoder
from tests.llm.helpers import SF, clashing, documents

PLAIN = Tokenizer.from_file(default_vocabulary())
PLAIN.encode_special_tokens = True


def plain_count(text):
    return len(PLAIN.encode(text, add_special_tokens=False).ids)


PARTS = ["a", "word", " ", "  ", "\n", " \n", "'", "'l", "l", "'re", "é", "12", "!?", "...", "\xa0", "\t x", "ll", "s", "日本", "☃", "S", "_", "<|endoftext|>"]


@pytest.mark.parametrize("seed", range(8))
def test_random_edits_keep_the_count(seed, monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", [2, 5, 256][seed % 3])
    rng = random.Random(seed)
    own = encoder(default_vocabulary())
    some = PARTS if seed % 2 else PARTS[:-5]  # with and without characters of the slow way
    for _ in range(25):
        text = "".join(rng.choices(some, k=rng.randrange(120)))
        counted = token_counts.CountedText(text, own)
        assert counted.tokens == plain_count(text)
        for _ in range(12):
            start, deleted = rng.randrange(len(text) + 1), rng.choice([0, 0, 1, 2, 5, 40])
            inserted = "".join(rng.choices(some, k=rng.choice([0, 1, 1, 2, 6])))
            text = text[:start] + inserted + text[start + deleted :]
            counted.edit(start, deleted, inserted)
            assert counted.text == text and counted.length == len(text)
            assert counted.tokens == plain_count(text), repr(text)


def test_edits_touch_little():
    own = encoder(default_vocabulary())
    text = "some words of a long text, and more of them. " * 5_000
    counted = token_counts.CountedText(text, own)
    built = counted.encoded
    for start in (0, 100_000, len(text)):
        counted.edit(start, 3, "new")
    assert counted.encoded - built < 200
    assert counted.tokens == plain_count(counted.text)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_token_counts(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id]
        n = len(text)
        edited = text[: n // 3] + text[n // 3 + 12 :]
        at = n * 2 // 3
        edited = edited[:at] + text[:24] + edited[at:]
        at = min(n + 3, len(edited))
        edited = edited[:at] + " " + text[:9][::-1] + edited[at + 9 :]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.tokens_before, r.tokens_after) == (plain_count(text), plain_count(edited))


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "abc"), (3, "abc"), (None, "x y"), (4, "é" * 100_000), (5, "  " * 50_000 + "x")]
    docs = clashing(documents(spark, rows), "id", "tokens_before", "edits")
    edits = F.expr("array(struct(1 start, 2 deleted, 'new ' inserted), null, struct(-5 start, 0 deleted, null inserted), struct(900000000 start, 9 deleted, '!' inserted))")
    got = token_counts.recount(docs, default_vocabulary(), docs["doc_id"], docs["text"], edits).collect()
    wanted = []
    for key, text in rows:
        text = text or ""
        edited = text[:1] + "new " + text[3:] + "!"
        wanted.append((key, plain_count(text), plain_count(edited), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.id, r.tokens_before, r.tokens_after, r.edited_sha256) for r in got), key=str) == sorted(wanted, key=str)
    none = F.lit(None).cast("array<struct<start:int,deleted:int,inserted:string>>")
    assert token_counts.recount(docs, default_vocabulary(), docs["doc_id"], docs["text"], none).where("tokens_before != tokens_after").count() == 0
    assert token_counts.recount(documents(spark, []), default_vocabulary(), F.col("doc_id"), F.col("text"), edits).count() == 0

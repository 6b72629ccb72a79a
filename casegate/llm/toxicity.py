"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words (runs of digits, letters and characters beyond ASCII, A-Z lowered) and their
beginnings of 4 to 6 bytes.  The model is fitted on a bounded sample of labelled rows: ``toxic`` and
``clean`` examples, those with the least hashes of their ids.  From it come the terms that set the
classes apart (log odds and G-test), the examples' vectors and the calibration; document frequencies
count all documents.  A text's nearest examples vote, nearer ones more, with each class weighed back
to its share of all labelled rows.  Other words than those terms do not count at all: the README has
recall with and without this restriction.  A third of the sample is set aside: it takes no part in choosing
terms or in voting, and a monotone fit over its votes turns votes into probabilities.  Texts without
any of the terms get the toxic share of such rows set aside.

The index keeps, for each term and block of examples, the greatest weight.  The sum of these over a
query's terms bounds the cosines of a block; blocks are taken by falling bounds until none can hold
a nearer example.

Defined results: a null text is empty; a null id is scored and not held out; a document with several
labels is toxic if one of them says so, null labels do not count; repeated rows are each scored;
examples at equal distance rank by id; without examples every score is 0; an empty table gives no
rows; only the named columns are read, and labels and ids are never inputs of a score.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.lineage import write_table
from casegate.llm.common import id_and_text, parts, texts
from casegate.llm.decontamination import words_of

#: Bounds of the sample that the model is fitted on.
TOXIC_EXAMPLES, CLEAN_EXAMPLES = 6_000, 12_000
MOST_TERMS = 4_096
LEAST_LOG_ODDS, LEAST_G = 2.0, 20.0
NEIGHBOURS = 25
BLOCK = 256
THRESHOLD = 0.3
_STARTS = (4, 5, 6)
_LONGEST_WORD = 32
#: Terms that a task counts before it passes them on.
_TERMS_HELD = 150_000
#: Words whose terms a worker keeps: some 20 MB.
_WORDS_KEPT = 150_000


def terms_of(word: bytes) -> list[bytes]:
    """A word and its beginnings, which end in a star.  A long word stands as its hash."""
    whole = word if len(word) <= _LONGEST_WORD else b"#" + hashlib.blake2b(word, digest_size=16).hexdigest().encode()
    return [whole, *(word[:n] + b"*" for n in _STARTS if len(word) >= n)]


class _Numbers(dict):
    """Numbers of the chosen terms of a word; words seen are kept, up to a bound."""

    def __init__(self, number: dict[bytes, int]):
        self._number = number

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = tuple(i for t in terms_of(word) if (i := self._number.get(t)) is not None)
        if len(self) < _WORDS_KEPT:
            self[word] = found
        return found


class Terms:
    """The chosen terms by number; ``counts`` finds them in a text."""

    def __init__(self, terms: list[bytes]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.starts = {t.rstrip(b"*")[: _STARTS[0]] for t in terms}
        self._of = _Numbers(self.number)

    def __reduce__(self):
        return Terms, (list(self.number),)

    def counts(self, text: bytes) -> dict[int, int]:
        starts = self.starts
        known = map(self._of.__getitem__, [w for w in words_of(text) if w[:4] in starts])
        found: Counter = Counter()
        for numbers in filter(None, known):
            found.update(numbers)
        return found


class Index:
    """Unit vectors of examples as postings by term, in blocks of ``BLOCK`` examples."""

    def __init__(self, vectors: list[dict[int, float]], terms: int, rank: np.ndarray | None = None):
        self.size = len(vectors)
        self.rank = np.arange(self.size) if rank is None else rank
        self.blocks = -(-self.size // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for at, vector in enumerate(vectors):
            for term, weight in vector.items():
                postings[term].append((at, weight))
        self.places = [np.array([p for p, _ in own], np.int64) for own in postings]
        self.weights = [np.array([w for _, w in own], np.float64) for own in postings]
        edges = np.arange(self.blocks + 1) * BLOCK
        self.cuts = [np.searchsorted(places, edges) for places in self.places]
        self.most = []
        for cuts, weights in zip(self.cuts, self.weights, strict=True):
            most = np.zeros(self.blocks)
            some = np.flatnonzero(np.diff(cuts))
            if len(some):
                most[some] = np.maximum.reduceat(weights, cuts[some])
            self.most.append(most)

    def nearest(self, vector: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest examples with a cosine above 0, nearest first,
        then by rank."""
        bounds = np.zeros(self.blocks)
        for term, weight in vector.items():
            bounds += weight * self.most[term]
        bounds *= 1 + 1e-9
        places = np.zeros(0, np.int64)
        cosines = np.zeros(0)
        for block in np.argsort(-bounds, kind="stable").tolist():
            if bounds[block] <= 0 or (len(cosines) == k and bounds[block] < cosines[-1]):
                break
            scores = np.zeros(BLOCK)
            for term, weight in vector.items():
                begin, end = self.cuts[term][block : block + 2]
                scores[self.places[term][begin:end] - block * BLOCK] += weight * self.weights[term][begin:end]
            some = np.flatnonzero(scores > 0)
            places = np.concatenate((places, some + block * BLOCK))
            cosines = np.concatenate((cosines, np.round(scores[some], 12)))
            order = np.lexsort((self.rank[places], -cosines))[:k]
            places, cosines = places[order], cosines[order]
        return places, cosines


def monotone(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic regression by pooling adjacent violators: knots and their values."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # sum, weight, first vote, last vote
    for at in order.tolist():
        pools.append([labels[at] * weights[at], weights[at], votes[at], votes[at]])
        while len(pools) > 1 and (
            pools[-2][3] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]
        ):
            total, weight, _, last = pools.pop()
            pools[-1][0] += total
            pools[-1][1] += weight
            pools[-1][3] = last
    knots = np.array([v for p in pools for v in p[2:4]])
    return knots, np.array([p[0] / p[1] for p in pools for _ in range(2)])


class Model:
    """Everything that scoring needs; its size is bounded by the sample's."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, examples: list[tuple], totals: dict[int, int]):
        """``examples``: (id, label, set aside, term numbers, counts); ``totals``: labelled rows by
        label."""
        self.terms, self.idf = Terms(terms), idf
        sampled = Counter(label for _, label, *_ in examples)
        self.class_weight = {y: totals.get(y, 0) / n for y, n in sampled.items()}
        placed = sorted(
            ((self.vector(dict(zip(t, c, strict=True))), i, y) for i, y, aside, t, c in examples if t and not aside),
            key=lambda x: (min(x[0], key=lambda t: (-x[0][t], t)), str(x[1])),
        )  # by heaviest term, so that blocks are alike
        self.ids = [str(i) for _, i, _ in placed]
        self.labels = np.array([y for _, _, y in placed], np.float64)
        self.weights = np.array([self.class_weight[y] for _, _, y in placed])
        by_id = sorted(range(len(placed)), key=lambda p: (not isinstance(placed[p][1], int), placed[p][1] if isinstance(placed[p][1], int) else 0, self.ids[p]))
        rank = np.empty(len(placed), np.int64)
        rank[by_id] = np.arange(len(placed))
        self.index = Index([v for v, _, _ in placed], len(terms), rank)
        aside = [(y, dict(zip(t, c, strict=True))) for _, y, aside, t, c in sorted(examples, key=lambda e: str(e[0])) if aside]
        weighed = [(y, self.class_weight[y]) for y, counts in aside if not counts]
        self.bare = sum(y * w for y, w in weighed) / sum(w for _, w in weighed) if weighed else 0.0
        told = [(self.vote(self.vector(counts))[0], y) for y, counts in aside if counts]
        votes, truth = (np.array(x, np.float64) for x in (zip(*told, strict=True) if told else ((), ())))
        self.knots, self.values = monotone(votes, truth, np.array([self.class_weight[int(y)] for y in truth]))

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: float(w / norm) for t, w in sorted(raw.items())}

    def vote(self, vector: dict[int, float]) -> tuple[float, np.ndarray, np.ndarray]:
        """The toxic share of the nearest examples' votes, and the examples with their cosines."""
        places, cosines = self.index.nearest(vector, NEIGHBOURS)
        if not len(places):
            return self.bare, places, cosines
        voices = self.weights[places] / (1.05 - cosines)
        doubt = self.class_weight.get(0, 0.0) / 0.05  # one clean example at distance 0: few neighbours say less
        return float((voices * self.labels[places]).sum() / (voices.sum() + doubt)), places, cosines

    def score(self, text: bytes) -> tuple[float, list[str], list[float]]:
        counts = self.terms.counts(text)
        if not counts or not len(self.knots):
            return self.bare, [], []
        vote, places, cosines = self.vote(self.vector(counts))
        calibrated = float(np.interp(vote, self.knots, self.values)) if len(places) else self.bare
        return calibrated, [self.ids[p] for p in places[:3]], cosines[:3].tolist()


def set_apart(counts: list[tuple[bytes, int, int]], toxic: int, clean: int) -> list[bytes]:
    """Terms of the toxic class, by G: ``counts`` has each term's toxic and clean examples."""
    chosen = []
    for term, a, b in counts:
        odds = math.log((a + 0.5) * (clean - b + 0.5) / ((toxic - a + 0.5) * (b + 0.5)))
        g = 0.0
        for seen, row, column in (
            (a, a + b, toxic), (b, a + b, clean), (toxic - a, toxic + clean - a - b, toxic), (clean - b, toxic + clean - a - b, clean)
        ):
            if seen:
                g += 2 * seen * math.log(seen * (toxic + clean) / (row * column))
        if odds >= LEAST_LOG_ODDS and g >= LEAST_G:
            chosen.append((-g, term))
    return [t for _, t in sorted(chosen)[:MOST_TERMS]]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    toxic_examples: int = TOXIC_EXAMPLES,
    clean_examples: int = CLEAN_EXAMPLES,
    corpus: DataFrame | None = None,
) -> Model:
    """Fit on ``labels`` (``id_col``, ``label_col``) of ``docs``; frequencies count ``corpus``, by
    default all of ``docs``.  Only bounded tables reach the driver: term numbers and counts of the
    sampled examples, and the counts of the chosen terms."""
    spark = docs.sparkSession
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull())
    known = known.groupBy(known[id_col].alias("id")).agg(F.max((known[label_col] > 0).cast("int")).alias("label"))
    known = write_table(known)
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for label, most in ((1, toxic_examples), (0, clean_examples)):
        own = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = own if chosen is None else chosen.unionByName(own)
    sample = write_table(
        id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "id")  # bounded by the sample
        .groupBy("id", "label").agg(F.min("text").alias("text"))
        .withColumn("aside", F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(3)) == 0)
    )
    chosen_from = sample.where(~F.col("aside"))
    sizes = {r["label"]: r["count"] for r in chosen_from.groupBy("label").count().collect()}

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def counts() -> pa.RecordBatch:
            every = list(seen[0].keys() | seen[1].keys())
            made = pa.record_batch(
                [pa.array(every, pa.binary()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] for t in every], pa.int64())],
                names=["term", "toxic", "clean"],
            )
            for own in seen:
                own.clear()
            return made

        for batch in batches:
            for text, label in zip(texts(batch["text"]), batch["label"].to_pylist(), strict=True):
                seen[label].update({t for w in set(words_of(text)) for t in terms_of(w)})
                if len(seen[0]) + len(seen[1]) > _TERMS_HELD:
                    yield counts()
        yield counts()

    counted = (
        chosen_from.mapInArrow(count_terms, "term binary, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic >= 3 and toxic > clean")
    )
    # a term has to be in three of the bounded sample's toxic examples: what comes back is bounded too
    terms = set_apart([tuple(r) for r in counted.toLocalIterator()], sizes.get(1, 0), sizes.get(0, 0))
    shared = spark.sparkContext.broadcast(terms)

    def count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = Terms(shared.value), np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            held[-1] += batch.num_rows
            for text in texts(batch["text"]):
                held[list(own.counts(text))] += 1
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some), pa.array(held[some])], names=["number", "n"])

    everything = id_and_text(docs if corpus is None else corpus, id_col, text_col).select("text")
    held = everything.mapInArrow(count_documents, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(terms) + 1)
    for row in held.collect():  # one row a term at most
        frequency[row["number"]] = row["n"]
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1

    def count_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(shared.value)
        for batch in batches:
            found = [own.counts(text) for text in texts(batch["text"])]
            yield pa.record_batch(
                [batch["id"], batch["label"], batch["aside"], pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))],
                names=["id", "label", "aside", "terms", "counts"],
            )

    kind = sample.schema["id"].dataType.simpleString()
    examples = sample.mapInArrow(count_examples, f"id {kind}, label int, aside boolean, terms array<int>, counts array<int>")
    return Model(terms, idf, [tuple(r) for r in examples.collect()], totals)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, nearest, cosines``: a row per row, with up to three nearest examples as evidence."""
    source = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, pickle.HIGHEST_PROTOCOL))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in parts(batches, "text"):
            scored = [own.score(text) for text in texts(batch["text"])]
            yield pa.record_batch(
                [batch["id"], pa.array([s for s, _, _ in scored], pa.float64()), pa.array([n for _, n, _ in scored], pa.list_(pa.string())), pa.array([c for _, _, c in scored], pa.list_(pa.float64()))],
                names=["id", "score", "nearest", "cosines"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double, nearest array<string>, cosines array<double>")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, pickle.HIGHEST_PROTOCOL))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(shared.value)
        for batch in parts(batches, lambda b: b.column(place)):
            yield batch.filter(pa.array([own.score(t)[0] < threshold for t in texts(batch.column(place))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))

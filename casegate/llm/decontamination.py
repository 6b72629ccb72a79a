"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

Words are runs of digits, letters and characters beyond ASCII after lower-casing A-Z.  A window is
13 consecutive words of an item; an item of fewer words, but not none, is one window.  A stream of
document words is run through the automaton, which tracks the longest match that ends at each word;
wherever it reaches a window, the window's words are hit and the items that hold it are noted.

Only stretches whose consecutive word triples all occur in items are streamed through the automaton
(a window lies inside one such stretch); numpy finds them for a whole batch at once.

Items are taken in blocks of bounded size, one automaton and one pass over the documents each.  A
pass's result is written before the next block's pass, so that a task holds one automaton however large
the benchmark is.  The driver reads the items and builds the automata, one after another: it holds one
automaton and the words of two blocks (an item is never divided).

Defined results: a null document or item text has no words; a null item id counts for hits but is
not listed; repeated item ids count once; repeated document rows are each scanned; an empty
benchmark hits nothing; other columns of the documents pass through.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.lineage import write_table
from casegate.llm.common import parts, texts

WINDOW = 13
#: Words of the items that one automaton holds: some 40 MB.
BLOCK_WORDS = 100_000
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else 32 for b in (*range(65), *range(97, 123), *range(91, 256)))


def words_of(text: bytes) -> list[bytes]:
    """White space stands for all other bytes, so that ``split`` finds the words."""
    return text.translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences.  ``step`` maps ``state * size + word`` to a state;
    ``full`` lists the items of states that hold a window of the whole length, ``short`` those of
    items that are one shorter window, with their lengths."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        sequences = [(i, [number(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        self.size = max(1, len(self.vocabulary))
        self.length, self.link, self.step = [0], [-1], {}
        following: list[dict[int, int]] = [{}]
        for _, words in sequences:
            last = 0
            for word in words:
                last = self._extend(following, last, word)
        self.step = {s * self.size + w: t for s, moves in enumerate(following) for w, t in moves.items()}
        self.shortest = min((min(window, len(words)) for _, words in sequences), default=window)
        self._mark(sequences)
        self.width = min(3, self.shortest)
        grams = {self._key(words[k : k + self.width]) for _, words in sequences for k in range(len(words) - self.width + 1)}
        self.grams = np.array(sorted(grams), np.int64)

    def _key(self, words: list[int]) -> int:
        key = 0
        for word in words:
            key = key * self.size + word
        return key

    def _new(self, following: list[dict[int, int]], length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        following.append(moves)
        return len(following) - 1

    def _split(self, following: list[dict[int, int]], state: int, word: int) -> int:
        """The state of the longest suffix that ``state`` and ``word`` spell, apart from longer ones."""
        target = following[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(following, self.length[state] + 1, self.link[target], dict(following[target]))
        self.link[target] = copy
        while state >= 0 and following[state].get(word) == target:
            following[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, following: list[dict[int, int]], last: int, word: int) -> int:
        if word in following[last]:
            return self._split(following, last, word)
        new = self._new(following, self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in following[state]:
            following[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(following, state, word)
        return new

    def _mark(self, sequences: list[tuple[str | None, list[int]]]) -> None:
        full: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        self.items = [i for i, _ in sequences]
        for at, (_, words) in enumerate(sequences):
            state = matched = 0
            for word in words:
                state, matched = self.step[state * self.size + word], matched + 1
                if matched >= self.window:
                    full.setdefault(self.cut(state, self.window), set()).add(at)
            if len(words) < self.window:
                short.setdefault(state, []).append((len(words), at))
        self.full = {s: sorted(x) for s, x in full.items()}
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for state in order:  # with those of shorter suffixes
            own = short.get(state, []) + (self.short.get(self.link[state], []) if self.link[state] >= 0 else [])
            if own:
                self.short[state] = own

    def cut(self, state: int, length: int) -> int:
        """The state of the match's last ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit spans (begin, end), positions of the items with windows, and the longest match."""
        step, size, window = self.step, self.size, self.window
        state = matched = longest = 0
        spans: list[tuple[int, int]] = []
        held: set[int] = set()
        for at, word in enumerate(words, 1):
            following = step.get(state * size + word)
            while following is None and state:
                state = self.link[state]
                matched = self.length[state]
                following = step.get(state * size + word)
            if following is None:
                continue
            state, matched = following, matched + 1
            longest = max(longest, matched)
            reach = 0
            if matched >= window:
                reach = window
                held.update(self.full.get(self.cut(state, window), ()))
            for length, item in self.short.get(state, ()):
                if length <= matched:
                    reach = max(reach, length)
                    held.add(item)
            if reach:
                if spans and spans[-1][1] >= at - reach:
                    spans[-1] = (min(spans[-1][0], at - reach), at)
                else:
                    spans.append((at - reach, at))
        return merged(spans), held, longest

    def stretches(self, numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the stretches that may hold a window."""
        width = self.width
        places = len(numbers) - width + 1
        if places <= 0 or not len(self.grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = numbers >= 0
        possible = owner[:places] == owner[width - 1 :]
        for k in range(width):
            possible &= known[k : k + places]
        at = np.flatnonzero(possible)
        keys = np.zeros(len(at), np.int64)
        for k in range(width):
            keys = keys * self.size + numbers[at + k]
        found = np.searchsorted(self.grams, keys)
        at = at[self.grams[np.minimum(found, len(self.grams) - 1)] == keys]
        if not len(at):
            return at, at
        breaks = np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
        begins = at[np.concatenate(([0], breaks + 1))]
        ends = at[np.concatenate((breaks, [len(at) - 1]))] + width
        enough = ends - begins >= self.shortest
        return begins[enough], ends[enough]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, sorted spans."""
    result: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if result and begin <= result[-1][1]:
            result[-1] = (result[-1][0], max(end, result[-1][1]))
        else:
            result.append((begin, end))
    return result


def blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of some ``limit`` words; an item is never divided."""
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in items.select(items[item_id].cast("string"), items[text].cast("string")).toLocalIterator():
        words = words_of((row[1] or "").encode())
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


RESULTS = "n_words long, longest int, spans array<struct<begin:int,end:int>>, items array<string>"


Finish = Callable[[pa.RecordBatch], pa.RecordBatch]


def _pass(shared, place: int, finish: Finish | None = None):
    """One automaton over all documents: adds its hits to those of the passes before; the last pass
    may go on to ``finish`` its batches, so that they need no further worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = pickle.loads(shared.value)
        number = automaton.vocabulary.get
        for batch in parts(batches, lambda b: b["row"].field(place)):
            words = [words_of(t) for t in texts(batch["row"].field(place))]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            numbers = np.fromiter(map(number, chain.from_iterable(words), repeat(-1)), np.int64, int(counts.sum()))
            owner = np.repeat(np.arange(len(words)), counts)
            first = np.concatenate(([0], np.cumsum(counts)))
            spans, items = batch["spans"].to_pylist(), batch["items"].to_pylist()
            longest = batch["longest"].to_pylist()
            for begin, end in zip(*(x.tolist() for x in automaton.stretches(numbers, owner)), strict=True):
                row = int(owner[begin])
                hit, held, matched = automaton.scan(numbers[begin:end].tolist())
                longest[row] = max(longest[row], matched)
                shift = begin - int(first[row])
                spans[row] += [{"begin": b + shift, "end": e + shift} for b, e in hit]
                items[row] += [automaton.items[i] for i in held if automaton.items[i] is not None]
            for row in np.flatnonzero([len(x) > 0 for x in spans]).tolist():
                joined = merged([(x["begin"], x["end"]) for x in spans[row]])
                spans[row] = [{"begin": b, "end": e} for b, e in joined]
                items[row] = sorted(set(items[row]))
            made = pa.record_batch(
                [batch["row"], pa.array(counts), pa.array(longest, pa.int32()), pa.array(spans, batch["spans"].type), pa.array(items, batch["items"].type)],
                names=batch.schema.names,
            )
            yield made if finish is None else finish(made)

    return run


def scan(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    finish: tuple[Finish, str] | None = None,
) -> DataFrame:
    """``row`` (a struct of the document's columns), ``n_words``, ``longest`` (the longest match
    tracked; stretches too short for a window are not tracked), ``spans`` (hit word spans, disjoint)
    and ``items`` (ids with windows, distinct, sorted); or what ``finish`` makes of its batches, with
    its schema."""
    context = docs.sparkSession.sparkContext
    place = docs.columns.index(text_col)
    result = docs.select(
        F.struct(*(docs[c].cast("string").alias(c) if c == text_col else docs[c] for c in docs.columns)).alias("row"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(0).alias("longest"),
        F.expr("cast(array() as array<struct<begin:int,end:int>>) spans"),
        F.expr("cast(array() as array<string>) items"),
    )
    row = result.schema["row"].dataType.simpleString()
    waiting = None  # a block is scanned once the next one, or the end, is known
    for block in chain(blocks(items, item_id, item_text, block_words), [None]):
        if waiting is not None or block is None:
            shared = context.broadcast(pickle.dumps(Automaton(waiting or [], window), pickle.HIGHEST_PROTOCOL))
            if block is None and finish is not None:
                return result.mapInArrow(_pass(shared, place, finish[0]), finish[1])
            result = result.mapInArrow(_pass(shared, place), f"row {row}, {RESULTS}")
            if block is not None:  # or a task would run the passes of all blocks at the same time
                result = write_table(result)
                shared.unpersist()
        waiting = block
    return result


N_HIT = "aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)"
#: The contamination rule: a twentieth of the words or more are hit.
LEAST_SHARE = 0.05


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, n_words, n_hit, items, contaminated, longest, spans`` per document."""
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return scan(read, items, "text", **options).selectExpr(
        "row.id id", "n_words", f"{N_HIT} n_hit", "items", f"{N_HIT} > 0 and 20 * {N_HIT} >= n_words contaminated", "longest", "spans",
    )


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what stands between them; the rest stays as it is."""
    lowered, places = text.lower(), []
    for match in _WORD_BYTES.finditer(lowered):
        places.append(match.span())
    kept, at = [], 0
    for begin, end in spans:
        kept.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    kept.append(text[at:])
    return b"".join(kept)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    length_col: str | None = None,
    least_share: float = LEAST_SHARE,
    drop_share: float = 0.5,
    max_span: int | None = None,
    **options,
) -> DataFrame:
    """``docs`` without benchmark passages.

    Length limit: a span is hit from the window's length on.  Coverage limits: a document of which
    ``least_share`` or more of the words are hit loses its hit spans, one of which ``drop_share`` or
    more are hit goes as a whole.  All other documents stay as they are, by the contamination rule;
    with ``max_span`` they lose the hit spans of at least so many words.
    ``length_col`` names a column that holds the text's code points, which is kept right.
    """
    columns = docs.columns
    place = columns.index(text_col)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, spans = batch["row"], batch["spans"].to_pylist()
        words = batch["n_words"].to_pylist()
        fields = [row.field(i) for i in range(len(columns))]
        keep = np.ones(batch.num_rows, bool)
        changed = {}
        for at, own in enumerate(spans):
            hit = sum(s["end"] - s["begin"] for s in own)
            if hit < least_share * words[at]:
                own = [s for s in own if max_span is not None and s["end"] - s["begin"] >= max_span]
            if not hit or not own:
                continue
            if hit >= max(drop_share, least_share) * words[at]:
                keep[at] = False
                continue
            text = fields[place][at].as_py()
            changed[at] = without(text.encode(), [(s["begin"], s["end"]) for s in own]).decode()
        if changed:
            fields[place] = pa.array([changed.get(at, t) for at, t in enumerate(fields[place].to_pylist())], fields[place].type)
            if length_col is not None:
                where = columns.index(length_col)
                lengths = fields[where].to_pylist()
                fields[where] = pa.array([len(changed[at]) if at in changed else n for at, n in enumerate(lengths)], fields[where].type)
        return pa.record_batch(fields, names=columns).filter(pa.array(keep))

    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema)
    return scan(docs, items, text_col, finish=(cut, schema), **options)

"""Periodic runs: stretches of words that repeat four times or more, by online sparse diagonals.

A run is a maximal stretch of words with smallest period ``q`` and ``max(LEAST, TIMES * q)`` words or
more: on the diagonal of lag ``q`` its words match the words ``q`` before them.  ``runs`` goes through the
words of a text in order; the earlier occurrences of a word lengthen the diagonals of their lags, and a
diagonal that ends long enough emits its run at once.  Only cells that can matter are visited:

* A run of lag ``d`` matches ``3 * d`` words on end, so a word counts together with the ``2**m <= 3 * d``
  words that begin with it.  Lags are taken by such scales; text that does not repeat at a scale leaves
  no cell there and in none above.
* In a stretch where the nearest earlier occurrence stays ``q`` words back, the occurrences inside the
  stretch are the multiples of ``q``, whose diagonals match as far as that of ``q``.  They are not
  visited; where the stretch ends, those that go on open with the length it lends them.

So a text of ``n`` words takes some ``log n`` sorts of its words, and the visits do not grow with the
square of a word's frequency.  A text is one row and one task's work, a batch holds some 2 MB.

``find`` is the operator: each text's runs and the text without the repetitions.

Defined results: a null text is empty; a text without words has no runs and collapses to the empty
text; null ids and repeated rows stay as they are, a row each; an empty table gives no rows; only the two
named columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.llm.common import parts, texts

LEAST = 6
TIMES = 4
RUN = "array<struct<start: long, length: long, period: long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def codes(words: list[bytes]) -> np.ndarray:
    """A number per distinct word."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


class Scale:
    """Word sequences of one length, by where they begin: their numbers and occurrences in order."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        ranked = keys[self.order]
        fresh = np.ones(len(keys), bool)
        np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
        group = np.cumsum(fresh) - 1
        self.repeats = group[-1] + 1 < len(keys)
        self.code = np.empty(len(keys), np.int64)
        self.code[self.order] = group
        self.fresh = fresh

    def doubled(self, length: int) -> Scale:
        """Sequences of twice the length."""
        top = int(self.code.max()) + 1
        return Scale(self.code[:-length] * top + self.code[length:])

    def diagonals(self, length: int, low: int, high: int, words: int) -> Iterator[Run]:
        """``lag, first, last``: the first and last matching begin of each diagonal that holds a run, for
        lags of ``low`` to ``high - 1``."""
        before = np.full(len(self.code), -high, np.int64)
        again = ~self.fresh
        before[self.order[again]] = self.order[np.flatnonzero(again) - 1]
        nearest = np.arange(len(before)) - before
        visited = np.flatnonzero(nearest < high)
        if not len(visited):
            return
        order, code = self.order.tolist(), self.code.tolist()
        place = np.empty(len(order), np.int64)
        place[self.order] = np.arange(len(order))
        head = np.maximum.accumulate(np.where(self.fresh, np.arange(len(order)), 0))

        def ended(lag: int, first: int, last: int) -> bool:
            return last + length - first + lag >= max(LEAST, TIMES * lag)

        active: dict[int, int] = {}
        last, period, since = -2, 0, 0
        for at, near, rank in zip(visited.tolist(), nearest[visited].tolist(), place[visited].tolist(), strict=True):
            if at > last + 1:
                yield from ((lag, first, last) for lag, first in active.items() if ended(lag, first, last))
                active, period = {}, 0
            elif active:
                for lag in [lag for lag in active if code[at - lag] != code[at]]:
                    first = active.pop(lag)
                    if ended(lag, first, last):
                        yield lag, first, last
            last = at
            if near == period:  # the stretch goes on: occurrences before it alone are new
                latest = min(since - period - 1, at - low)
                lent = 0
            else:
                latest = at - low
                lent, begun = period, since
                period, since = near, at
            floor = int(head[rank])
            if order[floor] > latest:
                continue
            for k in range(bisect_right(order, latest, floor, rank) - 1, floor - 1, -1):
                lag = at - order[k]
                if lag >= high:
                    break
                first = at
                if lent and lag % lent == 0:
                    first = min(at, begun - lent + lag)
                if lag not in active and (TIMES - 1) * lag <= words - first:
                    active[lag] = first
        yield from ((lag, first, last) for lag, first in active.items() if ended(lag, first, last))


def runs(words: np.ndarray) -> list[Run]:
    """``start, length, period`` of every run of numbered words, by start, then period."""
    if len(words) < LEAST:
        return []
    found: dict[tuple[int, int], int] = {}
    length, scale = 1, Scale(words)
    while scale.repeats and 2 * length <= len(words):
        scale, length = scale.doubled(length), 2 * length
        if length < TIMES:
            continue
        low = 1 if length == TIMES else -(-length // (TIMES - 1))
        if TIMES * low > len(words):
            break
        for lag, first, last in scale.diagonals(length, low, -(-2 * length // (TIMES - 1)), len(words)):
            span = first - lag, last + length - first + lag
            found[span] = min(lag, found.get(span, lag))
    return sorted((start, count, period) for (start, count), period in found.items())


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words joined by a space, less those that a run holds after its first period."""
    if not found:
        return b" ".join(words)
    kept, end = [], 0
    for begin, stop in sorted((start + period, start + length) for start, length, period in found):
        kept += words[end:begin]
        end = max(end, stop)
    return b" ".join(kept + words[end:])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, "text"):
        all_runs, counts, short = [], [], []
        for text in texts(batch["text"]):
            words = text.split()
            found = runs(codes(words))
            all_runs.append([dict(zip(("start", "length", "period"), run, strict=True)) for run in found])
            counts.append(len(words))
            short.append(collapsed(words, found))
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(counts, pa.int64()), pa.array(all_runs, _RUNS), pa.array(short, pa.binary()).cast(pa.string())],
            ["id", "n_words", "runs", "collapsed"],
        )


def find(docs: DataFrame, id_col: Column, text_col: Column) -> DataFrame:
    """``id, n_words, runs, collapsed``: each text's runs, by start, then period, and its words without
    their repetitions."""
    source = docs.select(id_col.alias("id"), text_col.cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_find, f"id {kind}, n_words long, runs {RUN}, collapsed string")


def periodic_tail(id_col: Column, text_col: Column) -> Column:
    """The text, or for one id in ten its words with a tail that repeats: of ``n`` words, with ``h`` the
    CRC-32 of the decimal id and ``g = h div 10``, those from ``a = g % n`` on become periodic with period
    ``1 + (n - a) div (3 + g % 8)``.  A null id or text stays as it is."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text_col, r"[ \t-\r]+"), lambda w: w != "")

    def changed(row: Column) -> Column:
        whole, g = row["words"], row["g"]
        n = F.size(whole).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(whole, (a + (i - a) % p).cast("int")))
        return F.array_join(F.concat(F.slice(whole, F.lit(1), a.cast("int")), tail), " ")

    # one element, so that the words are cut once
    rows = F.transform(F.array(F.struct(words.alias("words"), g.alias("g"))), lambda r: F.when(F.size(r["words"]) > 0, changed(r)).otherwise(""))
    return F.when((h % 10 == 0) & text_col.isNotNull(), rows[0]).otherwise(text_col)

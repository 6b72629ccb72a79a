"""Edit-aware token counts.

A document's pre-tokens are the leaves of a tree: leaves hold some ``LEAF`` pre-tokens with their text,
inner nodes the sums of code points and tokens below.  An edit goes down to its place by the sums,
cuts out the pre-tokens it touches and the boundary context before them, pre-tokenizes from there
until the new and the old boundaries agree again, encodes these pre-tokens only and updates the sums
on the way up.

The context: the pre-tokenizer looks ahead two characters after an apostrophe, one after a run, and
to the end of a run of spaces.  So reading starts again at a boundary two or more characters before
the edit that no space precedes.

The strings of special tokens count as ordinary text.

Defined results: a null text is empty, null edits are none; edits apply one after the other, each to
the text as it is then; places beyond the text mean its end, negative ones its start, a null insertion
is empty; null ids and repeated rows are each returned; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from casegate.llm.common import parts
from casegate.llm.tokens import Encoder, encoder, pre_tokens

LEAF = 256
_SPACES = " \t\n\x0b\x0c\r\x85\xa0"


class Leaf:
    """Consecutive pre-tokens: their text, lengths and token counts."""

    __slots__ = ("counts", "lengths", "text", "tokens")

    def __init__(self, text: str, lengths: list[int], counts: list[int]):
        self.text, self.lengths, self.counts = text, lengths, counts
        self.tokens = sum(counts)


class CountedText:
    """A text whose token count follows its edits."""

    def __init__(self, text: str, own: Encoder):
        self._own = own
        self.encoded = 0
        lengths, counts = self._measure(text)
        self._leaves = list(self._cut(text, lengths, counts))
        self._grow()

    def _measure(self, text: str) -> tuple[list[int], list[int]]:
        pieces = self._own.pieces(text)
        self.encoded += len(pieces)
        return list(map(len, pieces)), list(map(self._own.count, pieces))

    @staticmethod
    def _cut(text: str, lengths: list[int], counts: list[int]) -> Iterator[Leaf]:
        at = 0
        for begin in range(0, len(lengths), LEAF):
            own = lengths[begin : begin + LEAF]
            size = sum(own)
            yield Leaf(text[at : at + size], own, counts[begin : begin + LEAF])
            at += size

    def _grow(self) -> None:
        """Sums over the leaves, as a binary tree in two arrays whose roots are at 1."""
        self._width = 1
        while self._width < len(self._leaves):
            self._width *= 2
        self._chars, self._tokens = [0] * (2 * self._width), [0] * (2 * self._width)
        for at, leaf in enumerate(self._leaves):
            self._chars[self._width + at], self._tokens[self._width + at] = len(leaf.text), leaf.tokens
        for node in range(self._width - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self._chars[node] = self._chars[2 * node] + self._chars[2 * node + 1]
        self._tokens[node] = self._tokens[2 * node] + self._tokens[2 * node + 1]

    def _update(self, at: int) -> None:
        node = self._width + at
        self._chars[node], self._tokens[node] = len(self._leaves[at].text), self._leaves[at].tokens
        while node > 1:
            node //= 2
            self._add_up(node)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place``, and where the leaf starts."""
        node, begin = 1, 0
        while node < self._width:
            node *= 2
            if place >= begin + self._chars[node] and self._chars[node + 1]:
                begin += self._chars[node]
                node += 1
        return node - self._width, begin

    @property
    def length(self) -> int:
        return self._chars[1]

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def text(self) -> str:
        return "".join(leaf.text for leaf in self._leaves)

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` code points from ``start`` on by ``inserted``."""
        start = min(max(start, 0), self.length)
        stop = min(start + max(deleted, 0), self.length)
        if start == stop and not inserted:
            return
        if not self._leaves:
            self._leaves = list(self._cut(inserted, *self._measure(inserted)))
            self._grow()
            return
        first, begin = self._leaf_at(max(0, start - 1))
        first, begin, skip, skipped = self._context(first, begin, start)
        last, end = first, begin + len(self._leaves[first].text)
        while end < stop and last + 1 < len(self._leaves):
            last += 1
            end += len(self._leaves[last].text)
        while True:
            held = self._leaves[first : last + 1]
            old = "".join(leaf.text for leaf in held)
            lengths = [n for leaf in held for n in leaf.lengths]
            counts = [n for leaf in held for n in leaf.counts]
            at_end = last + 1 == len(self._leaves)
            new = old[: start - begin] + inserted + old[stop - begin :]
            agreed = self._agree(new, skipped, lengths, start - begin + len(inserted), stop - begin, at_end)
            if agreed is not None:
                break
            last += 1
        pieces, kept = agreed
        self.encoded += len(pieces)
        lengths[skip:kept] = map(len, pieces)
        counts[skip:kept] = map(self._own.count, pieces)
        made = list(self._cut(new, lengths, counts))
        if len(made) == last + 1 - first and len(lengths) <= len(made) * LEAF:
            self._leaves[first : last + 1] = made
            for at in range(first, last + 1):
                self._update(at)
        else:
            self._leaves[first : last + 1] = made
            self._grow()

    def _context(self, leaf: int, begin: int, start: int) -> tuple[int, int, int, int]:
        """The leaf and pre-token to read again from: ``leaf, its start, pre-token, its offset``."""
        while True:
            own = self._leaves[leaf]
            best, at = None, 0
            for number, size in enumerate(own.lengths):
                if begin + at > start - 2:
                    break
                if at and own.text[at - 1] not in _SPACES:
                    best = number, at
                at += size
            if best is not None:
                return leaf, begin, *best
            if leaf == 0:
                return 0, 0, 0, 0
            leaf -= 1
            begin -= len(self._leaves[leaf].text)

    def _agree(self, new: str, skipped: int, lengths: list[int], new_end: int, old_end: int, at_end: bool) -> tuple[list[str], int] | None:
        """Pre-tokens of ``new`` from ``skipped`` on up to the first boundary after the edit that the
        old ones share, and the number of the old ones before it; None if more text is needed."""
        shift = new_end - old_end
        boundaries, at = {}, 0
        for number, size in enumerate(lengths):
            if at >= old_end:
                boundaries[at + shift] = number
            at += size
        if at_end:
            boundaries[len(new)] = len(lengths)
        pieces: list[str] = []
        place = skipped
        window = max(64, new_end - skipped + 64)
        while True:
            part = new[skipped : skipped + window]
            whole = skipped + window >= len(new)
            found = self._own.pieces(part)
            safe = len(part) if whole and at_end else _safe_end(part)
            pieces, place = [], skipped
            for piece in found:
                if place in boundaries and place >= new_end:
                    return pieces, boundaries[place]
                if place - skipped + len(piece) > safe:
                    break
                pieces.append(piece)
                place += len(piece)
            if place in boundaries and place >= new_end:
                return pieces, boundaries[place]
            if whole:
                return None
            window *= 4


def _safe_end(part: str) -> int:
    """Pre-tokens that end here or before do not depend on what follows ``part``: its last characters
    and the spaces and run they belong to may."""
    pieces = pre_tokens(part)
    end = len(part) - 3
    if pieces is None or end <= 0:
        return max(0, end - 64)
    at, ends = 0, [0]
    for piece in pieces:
        at += len(piece)
        ends.append(at)
    below = [e for e in ends if e <= end]
    while len(below) > 1 and part[below[-1] - 1] in _SPACES:
        below.pop()
    return below[-1]


SCHEMA = "tokens_before long, tokens_after long, pre_tokens long, encoded_again long, edited_sha256 string"


def recount(docs: DataFrame, tokenizer: str, id_col: Column, text_col: Column, edits_col: Column) -> DataFrame:
    """``id``, the token counts before and after a row's edits (an array of structs ``start, deleted,
    inserted``), the pre-tokens of the text, those encoded for the edits, and the edited text's SHA-256."""
    read = docs.select(id_col.alias("id"), text_col.cast("string").alias("text"), edits_col.alias("edits"))
    kind = read.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, special=False)  # an edit may make or break such a string
        for batch in parts(batches, "text"):
            rows = []
            for text, edits in zip(batch["text"].to_pylist(), batch["edits"].to_pylist(), strict=True):
                counted = CountedText(text or "", own)
                before, built = counted.tokens, counted.encoded
                for edit in edits or []:
                    if edit is not None:
                        counted.edit(edit["start"] or 0, edit["deleted"] or 0, edit["inserted"] or "")
                digest = hashlib.sha256(counted.text.encode()).hexdigest()
                rows.append((before, counted.tokens, built, counted.encoded - built, digest))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
            yield pa.record_batch([batch["id"], *arrays, pa.array(columns[4], pa.string())], names=["id", *(f.split(" ")[0] for f in SCHEMA.split(", "))])

    return read.mapInArrow(run, f"id {kind}, {SCHEMA}")

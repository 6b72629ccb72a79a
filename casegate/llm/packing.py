"""Hierarchical multi-length packing.

Each document becomes its token ids and a final id 0.  Whole long windows are cut off its front; the
rest is routed to the shortest context-size tier that holds it.  A tier is packed from its longest
pieces down: a piece opens a window of the tier's size, and the gap is filled from the same and the
shorter tiers, with the longest piece that fits as long as one fits, else by cutting one.  So every
window is full, and its size is a power of two.  What is left of the last tier at the end of a task
fills ever shorter windows.  Windows of a tier are dealt to step groups of equal token counts so
that their attention costs (sums of squared piece lengths) are level.

Documents are packed where they are read, with no shuffle; a task holds some ``SHARD_TOKENS`` tokens
and one document.  Sequence ids are the task's number and a count, and depend on its rows alone.

Defined results: a null text is empty (one token, the final id); null ids are packed; repeated rows
are packed as often as they occur; an empty table gives no rows; only the two columns are read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from casegate.llm.common import id_and_text, parts
from casegate.llm.tokens import encoder

TIERS = (1024, 512, 256, 128)
SHARD_TOKENS = 2_000_000
#: Tokens of a step group, in windows of one tier.
STEP_TOKENS = 16_384
END_ID = 0
_END = np.array([END_ID], "<u4").tobytes()


class Piece:
    """``length`` ids of a document from ``start`` on."""

    __slots__ = ("doc", "start", "length", "ids", "total")

    def __init__(self, doc, start: int, length: int, ids: bytes, total: int):
        self.doc, self.start, self.length, self.ids, self.total = doc, start, length, ids, total

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, length, self.ids[: 4 * length], self.total)
        return head, Piece(self.doc, self.start + length, self.length - length, self.ids[4 * length :], self.total)


class Packer:
    """Pieces waiting in tiers, sorted by length, and the windows packed so far."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
            raise ValueError("tiers are falling powers of two")
        self.tiers = tiers
        self.step_tokens = step_tokens
        self.waiting: dict[int, list[Piece]] = {t: [] for t in tiers}
        self.full: dict[int, list[list[Piece]]] = {}
        self.groups = 0

    def route(self, piece: Piece) -> None:
        tier = min(t for t in self.tiers if t >= piece.length)
        bisect.insort(self.waiting[tier], piece, key=lambda p: p.length)

    def add(self, doc, ids: bytes) -> int:
        total, longest = len(ids) // 4, self.tiers[0]
        for start in range(0, total, longest):
            part = ids[4 * start : 4 * (start + longest)]
            piece = Piece(doc, start, len(part) // 4, part, total)
            if piece.length == longest:
                self.full.setdefault(longest, []).append([piece])
            else:
                self.route(piece)
        return total

    def _filler(self, tier: int, gap: int) -> Piece | None:
        """The longest waiting piece of ``tier`` or a shorter one that fits the gap; else one cut to
        it, from the shortest tier that has one."""
        lists = [self.waiting[t] for t in self.tiers if t <= tier]
        for pieces in lists:
            at = bisect.bisect_right(pieces, gap, key=lambda p: p.length)
            if at:
                return pieces.pop(at - 1)
        for pieces in reversed(lists):
            if pieces:
                head, rest = pieces.pop(0).cut(gap)
                self.route(rest)
                return head
        return None

    def pack(self) -> None:
        """Pack tier by tier; what cannot fill a window of its tier goes on waiting."""
        for tier in self.tiers:
            while sum_at_least(self.waiting, self.tiers, tier) and self.waiting[tier]:
                window = [self.waiting[tier].pop()]
                gap = tier - window[0].length
                while gap:
                    piece = self._filler(tier, gap)
                    window.append(piece)
                    gap -= piece.length
                self.full.setdefault(tier, []).append(window)

    def close(self) -> None:
        """The last pieces, end to end, in ever shorter windows down to one id."""
        self.pack()
        rest = [p for t in self.tiers for p in reversed(self.waiting[t])]
        self.waiting = {t: [] for t in self.tiers}
        left = sum(p.length for p in rest)
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                piece = rest.pop(0)
                if piece.length > gap:
                    piece, after = piece.cut(gap)
                    rest.insert(0, after)
                window.append(piece)
                gap -= piece.length
            self.full.setdefault(size, []).append(window)
            left -= size

    def windows(self) -> Iterator[tuple[int, int, list[Piece]]]:
        """``tier, step group, pieces`` of the full windows: the costliest first, to and fro over
        the groups."""
        for tier, windows in sorted(self.full.items(), reverse=True):
            groups = -(-len(windows) * tier // self.step_tokens)
            windows.sort(key=lambda w: -sum(p.length**2 for p in w))
            for at, window in enumerate(windows):
                lap, place = divmod(at, groups)
                yield tier, self.groups + (place if lap % 2 == 0 else groups - 1 - place), window
            self.groups += groups
        self.full = {}


def sum_at_least(waiting: dict[int, list[Piece]], tiers: tuple[int, ...], tier: int) -> bool:
    """Whether the pieces of ``tier`` and below fill one of its windows."""
    total = 0
    for t in tiers:
        if t <= tier:
            for piece in waiting[t]:
                total += piece.length
                if total >= tier:
                    return True
    return False


SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, step_group long"
)


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: ``id``, its place in the document and in its sequence, the CRC-32 of its ids
    and, ``with_ids``, the ids themselves.  ``tokenizer``: a vocabulary file that every executor has."""
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer).bytes_of, Packer(tiers, step_tokens)
        task, number, held, id_type = TaskContext.get().partitionId() << 32, 0, 0, None

        def packed() -> pa.RecordBatch:
            nonlocal number
            rows: list[tuple] = []
            for tier, group, window in packer.windows():
                offset = 0
                for p in window:
                    rows.append((p.doc, p.start, p.length, zlib.crc32(p.ids), p.total, task + number, offset, tier, task + group, p.ids))
                    offset += p.length
                number += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:9])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(b, "<u4").astype("i4") for b in columns[9]], pa.list_(pa.int32())))
            return pa.record_batch(arrays, names=["id", *(f.split(" ")[0] for f in SCHEMA.split(", ")), *["ids"] * with_ids])

        for batch in parts(batches, "text"):
            id_type = batch["id"].type
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held += packer.add(doc, encode(text or "") + _END)
                if held >= SHARD_TOKENS:
                    packer.pack()
                    yield packed()
                    held = 0
        if id_type is not None:
            packer.close()
            yield packed()

    return source.mapInArrow(run, f"id {kind}, {SCHEMA}" + ", ids array<int>" * with_ids)

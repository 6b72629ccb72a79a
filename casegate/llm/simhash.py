"""SimHash near-duplicates by tiled exact comparison.

A text is lower-cased (A-Z), cut into words at white space (0x20, 0x09-0x0D) and into shingles of
four words, repeats included; a text of fewer words is one shingle, one without words has
fingerprint 0.  A fingerprint bit is 1 where over half of the shingles' XXH64 (seed 42) have it.

Fingerprints are compared exactly: distinct fingerprints are dealt into tiles by the population
counts of their two halves, and a pair of tiles is compared (exclusive-or, bit counts) unless these
counts alone already differ by more than the radius.  A pair of tiles reports a spanning forest of
its links, never all of them, so a group of n copies costs at most n rows per pair.

Defined results: a null text is empty; null ids take part and are never a component's id unless all
of its ids are null; rows with the same id or text are each returned; an empty table gives no rows;
only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.lineage import write_table
from casegate.llm import fingerprints as fingerprints_of
from casegate.llm.common import classes, id_and_text, parts, texts

SHINGLE = 4
RADIUS = 4
#: Fingerprints of a tile: two tiles of 8 bytes each are what a task holds.
TILE = 1 << 16
_BLOCK = 256
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return [
        digest(joined[i:j], 42)
        for i, j in zip(begins[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    ]


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: bit counts are summed in eight byte lanes at a
    time over at most 255 hashes, then per text."""
    result = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return result
    sizes = counts[some]
    pieces = (sizes + 254) // 255
    owner_first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(pieces.sum()) - np.repeat(owner_first, pieces)
    cuts = np.repeat(begin, pieces) + within * 255
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), owner_first, axis=0)
        ones = (2 * sums > sizes[:, None]).astype(np.uint8)
        result[some] |= np.ascontiguousarray(ones).view(np.uint64)[:, 0] << np.uint64(bit)
    return result


def fingerprint_column(column: pa.Array, width: int = SHINGLE) -> pa.Array:
    """Signed 64-bit fingerprints of a text column."""
    lists = [shingle_hashes(text, width) for text in texts(column)]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for hashes in lists for h in hashes), np.uint64, int(counts.sum()))
    return pa.array(majorities(flat, counts).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``id, fp``: a row per row, ``fp`` the fingerprint as a signed long."""
    source = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            yield pa.record_batch([batch["id"], fingerprint_column(batch["text"], width)], names=["id", "fp"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``radius`` bits, as positions in both arrays.

    ``label`` holds each position's class so far; a row is linked once to every other class among
    its neighbours, so at most one link a position is kept however many neighbours there are."""
    offset = 0 if same else len(left)
    label = np.arange(offset + len(right))
    first_of, second_of = [], []
    for begin in range(0, len(left), _BLOCK):
        rows = left[begin : begin + _BLOCK]
        for at in range(begin + 1 if same else 0, len(right), 1 << 13):
            columns = right[at : at + (1 << 13)]
            near = np.bitwise_count(rows[:, None] ^ columns[None, :]) <= radius
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                others = at + np.flatnonzero(near[i])
                if same:
                    others = others[others > begin + i]
                known = label[offset + others]
                new, where = np.unique(known, return_index=True)
                mine = label[begin + i]
                for root, j in zip(new.tolist(), where.tolist(), strict=True):
                    if root != mine:
                        label[label == root] = mine
                        first_of.append(begin + i)
                        second_of.append(int(others[j]))
    return np.array(first_of, np.int64), np.array(second_of, np.int64)


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``, distinct) that connect exactly
    what the pairs within ``radius`` bits connect.

    Tiles are keyed by the population counts of both halves and a part number; the number of parts
    of a class follows from its count (a histogram of 33 x 33 classes at most), so no tile exceeds
    ``tile`` fingerprints by much and none is cut.  Every pair of tiles within the radius is one row
    of the tile join.
    """
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi")
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("lo")
    prints = prints.select("fp", high, low)
    sizes = prints.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).alias("n"))
    tiles = (
        prints.join(F.broadcast(sizes), ["hi", "lo"])  # at most 33 * 33 rows
        .select("hi", "lo", F.pmod(F.xxhash64("fp"), "n").alias("part"), "fp")
        .groupBy("hi", "lo", "part")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    tiles = write_table(tiles)
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    reach = F.array(*(F.struct(F.lit(i).alias("hi"), F.lit(j).alias("lo")) for i, j in near))
    asked = tiles.select(
        F.col("hi").alias("ahi"), F.col("lo").alias("alo"), F.col("part").alias("apart"), F.explode(reach).alias("d")
    ).select("ahi", "alo", "apart", (F.col("ahi") + F.col("d.hi")).alias("hi"), (F.col("alo") + F.col("d.lo")).alias("lo"))
    pairs = asked.join(tiles.select("hi", "lo", "part"), ["hi", "lo"]).where(
        "struct(ahi, alo, apart) <= struct(hi, lo, part)"
    )
    left = tiles.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo"), F.col("part").alias("apart"), F.col("fps").alias("left"))
    right = tiles.select("hi", "lo", "part", F.col("fps").alias("right"))
    work = pairs.join(left, ["ahi", "alo", "apart"]).join(right, ["hi", "lo", "part"]).select(
        (F.struct("ahi", "alo", "apart") == F.struct("hi", "lo", "part")).alias("same"), "left", "right"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (np.asarray(batch[c][row].values) for c in ("left", "right"))
                i, j = near_pairs(a.view(np.uint64), b.view(np.uint64), radius, batch["same"][row].as_py())
                yield pa.record_batch([pa.array(a[i]), pa.array(b[j])], names=["a", "b"])

    return work.mapInArrow(compare, "a long, b long")


def components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, more: DataFrame | None = None) -> DataFrame:
    """``fp, root, component_id`` for each distinct fingerprint of ``prints`` (``id, fp``; written or
    cheap to read again): its class, and the least id of all rows whose fingerprints it reaches.
    ``more``: further links ``a, b`` between fingerprints."""
    distinct = write_table(prints.groupBy("fp").agg(F.min("id").alias("id")))
    near = links(distinct.select("fp"), radius, tile)
    roots = classes(near if more is None else near.unionByName(more))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")
    )
    ids = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    return joined.join(ids, "root").select("fp", "root", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``."""
    prints = write_table(fingerprints(docs, id_col, text_col))
    return prints.join(components(prints, radius), "fp").select(
        F.col("id").alias("doc_id"), hex_fingerprint("fp").alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, least: float | None = fingerprints_of.SIMILAR
) -> DataFrame:
    """``docs`` with one row of each component: of its least id, then of the least text digest, then
    of the least other columns.  Rows that repeat an id and a text count as one.

    Four bits of 64 say that texts are alike, but most texts that share four fifths of their shingles
    differ in more.  With ``least``, texts of at least that Jaccard similarity (shingles of five words,
    candidates by signature bands, verified) are linked beside those within the radius.
    """
    columns = docs.columns
    digest = F.xxhash64(F.coalesce(F.sha2(docs[text_col].cast("binary"), 256), F.lit("")))
    source = docs.select(F.struct(docs[id_col].alias("id"), digest.alias("digest")).alias("key"), docs[text_col].cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            signs = [fingerprints_of.band_keys(t) if least is not None else (0, []) for t in texts(batch["text"])]
            yield pa.record_batch(
                [batch["key"], fingerprint_column(batch["text"]), pa.array([n for n, _ in signs], pa.int64()), pa.array([k for _, k in signs], pa.list_(pa.int64())), batch["text_key"]],
                names=["key", "fp", "node", "keys", "text_key"],
            )

    keyed = source.withColumn("text_key", F.xxhash64("text"))
    rows = write_table(keyed.mapInArrow(sign, f"key {kind}, fp long, node long, keys array<bigint>, text_key long"))
    more = None
    if least is not None:
        alike = classes(fingerprints_of.verified_links(rows.select("node", "keys", "text_key"), source.select("text"), least))
        found = write_table(rows.select("fp", "node").distinct().join(alike, "node").select("fp", "root").distinct())
        hub = found.groupBy("root").agg(F.min("fp").alias("b"))
        more = found.join(hub, "root").select(F.col("fp").alias("a"), "b")
    rows = rows.select(F.col("key.id").alias("id"), F.col("key.digest").alias("digest"), "fp")
    found = rows.join(components(rows.select("id", "fp"), radius, more=more), "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    keep = found.groupBy("root").agg(first)
    keep = keep.select(F.col("first.id").alias("_id"), F.col("first.digest").alias("_digest"))
    kept = docs.withColumn("_digest_of_row", digest)
    kept = kept.join(keep, kept[id_col].eqNullSafe(keep["_id"]) & (kept["_digest_of_row"] == keep["_digest"]), "left_semi")
    rest = [c for c in columns if c != id_col]
    return (
        kept.groupBy(kept[id_col].alias("_id"), "_digest_of_row")
        .agg(F.min(F.struct(*rest)).alias("_row"))
        .select(*(F.col("_id").alias(c) if c == id_col else F.col(f"_row.`{c}`").alias(c) for c in columns))
    )

"""Document fingerprints: MinHash.

A text's words (A-Z lowered, cut at white space) form shingles of five, fewer words one shingle.
Word hashes are combined to shingle hashes, and a signature holds for each of ``PERMUTATIONS``
universal hash permutations the least value over the shingles, all in numpy.  A fingerprint keeps one
mixed byte of each value; the share of equal bytes, less what chance adds, estimates the Jaccard
similarity.

``near_duplicates`` joins bands of signatures in Spark and verifies candidates by their exact Jaccard
similarity.  ``beside_next`` compares each document with an edited form of itself and with the next.

Defined results: a null text is empty; a text without words has no shingles, equals only its like;
null ids come last, rows of one id are ordered by their texts and repeated rows follow each other;
an empty table gives no rows; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegate.lineage import write_table
from casegate.llm.common import classes, id_and_text, parts, texts

SHINGLE = 5
PERMUTATIONS = 128
SIMILAR = 0.8
#: Bands of five values: a pair of similarity 0.8 shares one with probability 0.99995.
BANDS, BAND = 25, 5
#: Texts of a tile of one bucket; a pair of tiles is what a task holds.
TILE = 512
#: Bits of the map that finds the texts of crowded buckets.
_BITS = 1 << 26
_SEED = 20_240_229
_MIX = np.uint32(0x9E3779B1)
_EMPTY = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


_FACTORS, _OFFSETS = _permutations()
_PLACES = np.random.default_rng(_SEED + 1).integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles; a word's factor is that of its place in the shingle."""
    count = len(words) - SHINGLE + 1
    if count <= 0:
        whole = (words * _PLACES[: len(words)]).sum(keepdims=True) if len(words) else words
        mixed = whole ^ np.uint64(len(words))
    else:
        mixed = words[:count] * _PLACES[0]
        for place in range(1, SHINGLE):
            mixed += words[place : place + count] * _PLACES[place]
    return mixed ^ (mixed >> np.uint64(29))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = _EMPTY.copy()
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for begin in range(0, len(folded), 256):
        values = folded[begin : begin + 256, None] * _FACTORS
        values += _OFFSETS
        np.minimum(least, values.min(axis=0), out=least)
    return least


def fingerprint(least: np.ndarray) -> bytes:
    """One byte a permutation."""
    return ((least * _MIX) >> np.uint32(24)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity, 0 to 1: equal bytes less those equal by chance."""
    equal = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / len(a)
    return max(0.0, (equal - 1 / 256) / (1 - 1 / 256))


class Document:
    """A text with its signature and the part of it that its edited form shares: the shingles of the
    words before the edit."""

    def __init__(self, key, text: str):
        self.key, self.text = key, text
        self.replaced = len(text) // 4
        head = text[: len(text) - self.replaced]
        words = text.encode().lower().split()
        hashes = word_hashes(words)
        certain = max(0, len(head.encode().lower().split()) - 1)
        self.shared = max(0, certain - SHINGLE + 1)
        self.head = head
        self.kept = signature(shingle_hashes(hashes[:certain])) if self.shared else _EMPTY
        self.least = np.minimum(self.kept, signature(shingle_hashes(hashes[self.shared :])))
        self.print = fingerprint(self.least)

    def edited(self, following: str) -> tuple[str, bytes]:
        """The edited text and its fingerprint."""
        text = self.head + following[: self.replaced]
        if not self.replaced:
            return text, self.print
        rest = word_hashes(text.encode().lower().split()[self.shared :])
        return text, fingerprint(np.minimum(self.kept, signature(shingle_hashes(rest))))


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: each
    document beside its edited form (its last quarter replaced by as many first code points of the
    next document, by ascending numeric id; after the last the first) and beside the next one.

    Documents are dealt once, to ranges of ids between quantiles; the first document of each range
    also goes to the range before it.  A task sorts its range and holds two documents at a time.
    """
    from pyspark.ml.feature import Bucketizer  # not needed in workers

    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = source.select(F.col("id").cast("double").alias("number"))
    cuts = number.approxQuantile("number", [i / count for i in range(1, count)], 0.1 / count) if count > 1 else []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    ranges = len(edges) - 1
    dealt = source.withColumn("number", F.coalesce(F.col("id").cast("double"), F.lit(float("inf"))))
    if ranges > 1:
        dealt = Bucketizer(splits=edges, inputCol="number", outputCol="at").transform(dealt)
    else:
        dealt = dealt.withColumn("at", F.lit(0))
    dealt = dealt.select(F.col("at").cast("int").alias("at"), "id", "text")
    first = {r["at"]: r["id"] for r in dealt.groupBy("at").agg(F.min("id").alias("id")).collect()}  # one row a range
    held = sorted(first)
    before = [(at, first[at], held[i - 1]) for i, at in enumerate(held)]
    kind = source.schema["id"].dataType.simpleString()
    guests = spark.createDataFrame(before, f"at int, first {kind}, earlier int")
    dealt = dealt.join(F.broadcast(guests), "at").select(
        F.explode(
            F.when(
                F.col("id").eqNullSafe(F.col("first")),
                F.array(F.struct(F.col("at"), F.lit(0).alias("guest")), F.struct(F.col("earlier").alias("at"), F.lit(1).alias("guest"))),
            ).otherwise(F.array(F.struct(F.col("at"), F.lit(0).alias("guest"))))
        ).alias("place"),
        "id",
        "text",
    )
    dealt = dealt.select("place.at", "place.guest", "id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartitionById(ranges, F.col("at")).sortWithinPartitions("at", "guest", F.asc_nulls_last("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Document | None = None
        kind_of_id = None
        for batch in parts(batches, "text"):
            rows = []
            kind_of_id = batch["id"].type
            for guest, key, text in zip(batch["guest"].to_pylist(), batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if guest and last is None:
                    continue  # a second guest
                current = Document(key, text)
                if last is not None:
                    edited, edited_print = last.edited(text)
                    rows.append((
                        last.key, len(last.text), hashlib.sha256(edited.encode()).hexdigest(), last.print.hex(), edited_print.hex(),
                        likeness(last.print, edited_print), likeness(last.print, current.print),
                    ))
                last = None if guest else current
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (kind_of_id, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    return dealt.mapInArrow(
        run, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common shingles of each pair of sets: shingles that both sides have, as columns of two incidence
    matrices, multiplied block by block."""
    counts = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate([*side, np.zeros(0, np.int64)]).astype(np.int64) for side in (left, right)]
    common = np.intersect1d(flat[0], flat[1])
    if left is right:  # a shingle of one set alone adds to its own size only
        values, times = np.unique(flat[0], return_counts=True)
        common = values[times > 1]
    for begin in range(0, len(common), 4096):
        some = common[begin : begin + 4096]
        sides = []
        for row, values, side in zip(rows, flat, (left, right), strict=True):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            held = some[at] == values
            matrix = np.zeros((len(side), len(some)), np.float32)
            matrix[row[held], at[held]] = 1
            sides.append(matrix)
        counts += sides[0] @ sides[1].T
    return counts


def similar_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], least: float, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of at least that Jaccard similarity; two empty sets are alike."""
    sets = [s for _, s in left], [s for _, s in left if same] or [s for _, s in right]
    both = overlaps(sets[0], sets[0] if same else sets[1])
    sizes = [np.array([len(s) for s in side], np.float64) for side in sets]
    either = sizes[0][:, None] + sizes[1][None, :] - both
    alike = both >= least * either - 1e-9
    offset = 0 if same else len(left)
    label = np.arange(offset + len(right))
    links = []
    for i in range(len(left)):
        others = np.flatnonzero(alike[i])
        others = others[others > i] if same else others
        new, where = np.unique(label[offset + others], return_index=True)
        mine = label[i]
        for root, j in zip(new.tolist(), where.tolist(), strict=True):
            if root != mine:
                label[label == root] = mine
                links.append((left[i][0], right[int(others[j])][0]))
    return links


def band_keys(text: bytes) -> tuple[int, list[int]]:
    """A signed hash of the set of shingles, and a key of each band."""
    shingles = np.unique(shingle_hashes(word_hashes(text.lower().split())))
    bands = signature(shingles)[: BANDS * BAND].reshape(BANDS, BAND)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), at) - (1 << 63) for at, b in enumerate(bands)]
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7) - (1 << 63), keys


def verified_links(signed: DataFrame, source: DataFrame, least: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """``a, b``: links between nodes (sets of shingles) of at least that Jaccard similarity which share a
    band, as a forest.  ``signed``: ``node, keys, text_key`` of each row, written; ``source``: ``text``.

    Buckets of the same members are verified once.  The texts of a bucket are dealt to tiles of bounded
    size; each tile, and each pair of tiles of a bucket, is verified in a task and reports a spanning
    forest of its links.  Shingles are made again for the texts of crowded buckets alone: a bitmap of
    fixed size over their keys passes them, and a few more that the join on nodes leaves out.
    """
    nodes = write_table(signed.groupBy("node").agg(F.first("keys").alias("keys"), F.min("text_key").alias("text_key")))
    buckets = nodes.select("node", F.explode("keys").alias("bucket"))
    members = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    crowded = (
        buckets.groupBy("bucket").agg(F.count("*").alias("n"), members).where("n > 1")
        .groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    )
    placed = write_table(
        buckets.join(crowded, "bucket").select("node", "bucket", F.ceil(F.col("n") / tile).alias("parts"), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / tile)).alias("part"))
    )
    wanted = nodes.join(placed.select("node").distinct(), "node").select(F.pmod("text_key", F.lit(_BITS)).alias("bit"))
    bitmaps = wanted.groupBy(F.expr("bit div 32768").alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    bitmap = np.zeros(_BITS // 8, np.uint8)
    for row in bitmaps.toLocalIterator():  # 8 MB at most
        bitmap[row["at"] * 4096 : (row["at"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(shared.value, np.uint8)
        for batch in parts(batches, "text"):
            bits = batch["bit"].to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((held[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)))
            sets = [np.unique(shingle_hashes(word_hashes(t.lower().split()))) for t in texts(batch["text"])]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), 7) - (1 << 63) for s in sets]
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    read = source.select("text", F.pmod(F.xxhash64("text"), F.lit(_BITS)).alias("bit"))
    shingled = read.mapInArrow(cut, "node long, shingles array<bigint>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    tiles = write_table(
        placed.join(shingled, "node")
        .groupBy("bucket", "part", "parts").agg(F.sort_array(F.collect_list(F.struct("node", "shingles"))).alias("texts"))
    )
    several = tiles.where("parts > 1")
    other = several.select("bucket", F.col("part").alias("other"), F.col("texts").alias("others"))
    pairs = several.join(other, "bucket").where("part < other").select("texts", "others")

    def sides(batch: pa.RecordBatch, row: int) -> list[list[tuple[int, np.ndarray]]]:
        found = []
        for column in batch.schema.names:
            members = batch[column][row].values
            sets = members.field(1)
            found.append([(n, np.asarray(sets[i].values)) for i, n in enumerate(members.field(0).to_pylist())])
        return found

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in range(batch.num_rows):
                own = sides(batch, row)
                links += similar_links(own[0], own[-1], least, len(own) == 1)
            yield pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    inside = tiles.select("texts").mapInArrow(verify, "a long, b long")
    return inside.unionByName(pairs.mapInArrow(verify, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILAR, tile: int = TILE) -> DataFrame:
    """``id, class_id`` per row: the least id of the rows linked to it, where texts of at least that
    Jaccard similarity which share a band are linked.  Copies are one node."""
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            signs = [band_keys(t) for t in texts(batch["text"])]
            yield pa.record_batch(
                [batch["id"], pa.array([n for n, _ in signs], pa.int64()), pa.array([k for _, k in signs], pa.list_(pa.int64())), batch["text_key"]],
                names=["id", "node", "keys", "text_key"],
            )

    keyed = source.withColumn("text_key", F.xxhash64("text"))
    signed = write_table(keyed.mapInArrow(sign, f"id {kind}, node long, keys array<bigint>, text_key long"))
    roots = classes(verified_links(signed, source.select("text"), least, tile))
    rooted = signed.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    return rooted.join(ids, "root").select("id", "class_id")

"""Exact duplicates: a tree-merge of sorted digest runs.

Every text gets its SHA-256 digest and, as proof, its length in bytes and a second hash.  The rows of
each input partition (a lane) are written as one run, sorted by digest, proof and rank, so that equal
texts are neighbours and the row to keep comes first.

Lanes exchange their runs in binomial rounds of ``FAN`` partners.  In each round the lanes of a group
deal their runs out by ranges of digests, ``FAN`` times as many ranges as in the round before, and a task
merges what its partners send for its range: equal neighbours with equal proof fold to the first of them
with the sum of their counts.  After the last round a range lies in one task and holds every text once.
A text of a third of all rows is one row per lane from the first fold on, and ``FAN`` rows in a task at
most; no task ever holds more than its share of the digests.

The way back is by lane: the groups of two rows or more meet the first runs by digest (a row per lane at
most), then the rows of a lane by digest and lane.

Defined results: a null text is empty; the greatest id stays (the least on demand), a null id only where
the group has no other; of rows that repeat the id to keep the first one read stays, so exactly one row
of a group is kept; an empty table gives no rows; columns beside the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegate.lineage import write_table

#: Partners that exchange their runs in a round.
FAN = 16
#: A row's number is its lane and its place there: the lane's bits.
_PLACE_BITS = 33
_TEXT = ["digest", "bytes", "proof"]


def _fold(same: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbours that agree in ``same`` become the first of them with the sum of ``members``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if open_group is None else [open_group, batch]).combine_chunks()
            fresh = np.ones(table.num_rows, bool)
            if table.num_rows > 1:
                fresh[1:] = False
                for name in same:
                    column = table[name]
                    fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
            first = np.flatnonzero(fresh)
            members = np.add.reduceat(table["members"].to_numpy(), first)
            field = table.schema.field("members")
            table = table.take(first).set_column(table.schema.get_field_index("members"), field, pa.array(members))
            folded = table.combine_chunks().to_batches()[0]
            open_group = folded.slice(folded.num_rows - 1)
            if folded.num_rows > 1:
                yield folded.slice(0, folded.num_rows - 1)
        if open_group is not None:
            yield open_group

    return fold


def _merged(runs: DataFrame, same: list[str]) -> DataFrame:
    return runs.mapInArrow(_fold(same), runs.schema)


def duplicates(
    docs: DataFrame, id_col: Column, text_col: Column, normalise: Callable[[Column], Column] | None = None, keep: str = "largest"
) -> DataFrame:
    """``id, keep_id, group_size, kept, digest``: a row per row of ``docs``, with the id and size of its
    group of equal texts (equal after ``normalise``) and whether it is the one that stays."""
    text = F.coalesce(text_col.cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    best = {"largest": F.col("id").desc_nulls_last(), "smallest": F.col("id").asc_nulls_last()}[keep]
    order = [*_TEXT, best, "row"]
    rows = docs.select(
        id_col.alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.xxhash64(text).alias("proof"),
    )
    rows = write_table(rows.sortWithinPartitions(*order))
    rows = rows.withColumn("lane", F.shiftright("row", _PLACE_BITS).cast("int"))
    lanes = rows.agg(F.max("lane")).first()[0]
    if lanes is None:
        lanes = 0
    lanes += 1
    first_runs = _merged(rows.withColumn("members", F.lit(1).cast("long")), ["lane", *_TEXT])

    runs, width = first_runs, 1
    leading = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    while True:
        width *= FAN
        ranges = min(width, lanes)
        groups = -(-lanes // width)
        at = F.floor(F.col("lane") / width).cast("int") * ranges + F.shiftright(leading * ranges, 32).cast("int")
        runs = _merged(runs.repartitionById(groups * ranges, at).sortWithinPartitions(*order), _TEXT)
        if groups == 1:
            break

    several = runs.where("members > 1").select(*_TEXT, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "members")
    by_lane = first_runs.select(*_TEXT, "lane").join(several, _TEXT).distinct()
    return rows.join(by_lane, [*_TEXT, "lane"], "left").select(
        "id",
        F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("members", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "digest",
    )


def oracle() -> str:
    """The query's result in SQL (non-null ids)."""
    return """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """

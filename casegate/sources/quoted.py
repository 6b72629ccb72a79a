"""CSV files whose quoted fields hold line breaks, read by many tasks.

Spark cuts a text file at line ends, some of which lie inside quotes.  Whether a cut does follows from
all text before it.  For each split a first pass tells how it ends if it begins outside quotes and if it
begins inside; a scan over the splits of a file composes these, and a second pass cuts each split at the
ends of its rows.  A row that runs over a split's end is put together from its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegate.lineage import cut_lineage
from casegate.operators.ordered import dense_index

#: Bytes of row text that a task hands over at once.
BATCH_BYTES = 4 << 20


def ends_open(line: str, inside: bool) -> bool:
    """Whether a line leaves a quoted field open.  A quote opens a field only where the field begins; a
    doubled one stands for itself; what follows a closing quote belongs to the field up to the comma."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                at = line.find(',"', at) + 1
                if at == 0:
                    return False
            at += 1
        at = line.find('"', at)
        while at >= 0 and line[at + 1 : at + 2] == '"':
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(",", at) + 1
        if at == 0:
            return False
        inside = False


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and the split they lie in; a carriage return stays with its line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """The lines of a task by split; a split may come in several parts, one after the other."""
    for batch in batches:
        starts = batch["start"].to_numpy(zero_copy_only=False)
        files = batch["file"].dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(bounds, bounds[1:], strict=False):
            if end > begin:
                key = files.dictionary[int(codes[begin])].as_py(), int(starts[begin])
                yield key, batch["value"].slice(begin, end - begin).to_pylist()


def split_ends(lines: DataFrame) -> DataFrame:
    """``file, start, closed, opened``: whether a split ends inside quotes if it begins outside, and if
    it begins inside."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], tuple[bool, bool]] = {}
        for key, some in by_split(batches):
            closed, opened = seen.get(key, (False, True))
            for line in some:
                same = closed == opened
                closed = ends_open(line, closed)
                opened = closed if same else ends_open(line, opened)
            seen[key] = closed, opened
        rows = [(*key, *ends) for key, ends in seen.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.record_batch(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "start", "closed", "opened"]
        )

    return lines.mapInArrow(look, "file string, start long, closed boolean, opened boolean")


def split_states(ends: DataFrame) -> DataFrame:
    """``file, start, inside, ends``: whether a split begins and ends inside quotes.

    A split that ends alike either way settles what follows; one that swaps flips it.  So a split's
    state is the last settled one, flipped by the swaps since: running sums along a file's splits.
    """
    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.sum((F.col("closed") & ~F.col("opened")).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    settled = F.when(F.col("closed") == F.col("opened"), (F.col("closed").cast("int") + F.col("swaps")) % 2)
    known = ends.withColumn("swaps", swaps).withColumn("settled", settled)
    last = F.coalesce(F.last("settled", ignorenulls=True).over(before), F.lit(0))
    inside = ((last + F.coalesce(F.last("swaps").over(before), F.lit(0))) % 2 == 1).alias("inside")
    return known.select("file", "start", "closed", "opened", inside).select(
        "file", "start", "inside", F.when(F.col("inside"), F.col("opened")).otherwise(F.col("closed")).alias("ends")
    )


def split_key() -> F.Column:
    return F.xxhash64("file", "start")


def csv_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file, at, text`` per CSV row: rows of a file are ordered by ``at``, and its first has 0.  Empty
    lines are no rows.  A field that is never closed takes the rest of its file.  And the splits."""
    lines = lines_of(spark, path)
    states = cut_lineage(split_states(split_ends(lines)))
    # 8 bytes for a split that begins inside quotes, of some 10^6 splits in 100 TB.
    held = states.filter("inside").select(split_key().alias("k")).toArrow()["k"].to_numpy()
    begins_inside = spark.sparkContext.broadcast(np.sort(held))

    def cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """Whole rows, or the pieces at both ends of splits: the first has ``begins`` false."""
        current, inside, parts, begins, at, row_at = None, False, [], True, 0, 0
        out: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string())
            return pa.record_batch(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["file", "at", "begins", "text"]
            )

        def keep(complete: bool) -> None:
            if parts and whole == (begins and complete):
                out.append((current[0], row_at, begins, "\n".join(parts)))

        for batch in batches:
            inner = batch["inside"].to_numpy(zero_copy_only=False)
            done = 0
            for key, some in by_split([batch]):
                if key != current:
                    keep(not parts)  # the row that the split before left open
                    current, parts = key, []
                    inside = bool(inner[done])
                    begins = not inside
                    # A split's first line begins behind its start, but for the first split.
                    at = row_at = key[1] + (key[1] > 0)
                done += len(some)
                for line in some:
                    if not parts:
                        row_at = at
                    parts.append(line)
                    at += len(line.encode()) + 1
                    inside = ends_open(line, inside)
                    if not inside:
                        size += at - row_at
                        keep(True)
                        parts, begins = [], True
                        if size > BATCH_BYTES:
                            yield batch_of()
                            out, size = [], 0
        keep(not parts)
        yield batch_of()

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["k"].to_numpy(zero_copy_only=False)
            inside = np.isin(keys, begins_inside.value)
            yield pa.record_batch([batch["file"], batch["start"], batch["value"], pa.array(inside)], names=["file", "start", "value", "inside"])

    keyed = lines.withColumn("k", split_key())
    schema = "file string, at long, begins boolean, text string"
    rows = keyed.mapInArrow(lambda b: cut(marked(b), True), schema).select("file", "at", "text")
    if not states.filter("ends").isEmpty():
        pieces = keyed.mapInArrow(lambda b: cut(marked(b), False), schema)
        along = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        chained = pieces.withColumn("row", F.last(F.when(F.col("begins"), F.col("at")), ignorenulls=True).over(along))
        texts = F.array_sort(F.collect_list(F.struct("at", "text")))
        joined = chained.groupBy("file", F.col("row").alias("at")).agg(texts.alias("texts"))
        rows = rows.unionByName(joined.select("file", "at", F.array_join(F.col("texts.text"), "\n").alias("text")))
    return rows.filter(F.trim(F.regexp_replace("text", r"[\r\t]", "")) != ""), states


def read_quoted_csv(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """Rows of CSV files as text columns.  The names are those of one file; the first row
    of every file is its header.  ``order`` names a column of numbers in reading order, unique over up
    to 2^20 files of 2^43 bytes each."""
    # Only the first row of one file is read for the names.
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    if not names:
        raise ValueError(f"no header: {path}")
    texts, splits = csv_texts(spark, path)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    text = F.regexp_replace("text", r"\r$", "")
    if order:
        files = dense_index(splits.select("file").distinct(), ["file"], "nr")
        texts = texts.join(files, "file").withColumn(order, F.col("nr") * 2**43 + F.col("at"))
    kept = [order] if order else []
    parsed = texts.filter("at > 0").select(*kept, F.from_csv(text, schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    columns = [F.col(f"r._{i}").alias(n) for i, n in enumerate(names)]
    return parsed.select(*columns, *kept)

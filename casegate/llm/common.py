"""What the corpus operators share: reading tables, word bytes, Arrow helpers, links to classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegate.lineage import write_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads: columns beside them never clash with its own."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(
    batches: Iterator[pa.RecordBatch], column: str | Callable[[pa.RecordBatch], pa.Array], limit: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """Batches cut to some ``limit`` bytes of the text column each, so that memory follows neither
    the batch size nor the row lengths (a single row may still be longer)."""
    for batch in batches:
        text = batch[column] if isinstance(column, str) else column(batch)
        sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(begin, end - begin)
        del batch, text
        pa.default_memory_pool().release_unused()


def classes(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: non-null, comparable): one row ``node, root`` per
    linked node, ``root`` the least node reachable.

    Alternates large-star and small-star steps: a node's larger neighbours, then its smaller ones,
    are linked to the least of them.  Minima are aggregates that combine before the shuffle, the
    joins back are inner joins that can be split at run time, and each round is written to the
    shared folder, so nothing is gathered on the driver or in one task.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    edges = write_table(edges)
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(
                edges.select(F.col("m").alias("node"), F.col("m").alias("root")).distinct()
            )
        seen = state
        both = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            edges.select(F.col("m").alias("u"), F.col("v").alias("w"))
        )
        least = both.groupBy("u").agg(F.min("w").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), "m").distinct()
        large = write_table(large)
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v").where("m != least").select(F.col("m").alias("v"), F.col("least").alias("m"))
        edges = write_table(small.unionByName(least.select("v", F.col("least").alias("m"))).distinct())

"""Cutting lineage in reliable storage.

Nothing here relies on executors staying alive: what is reused is written to the
folder the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from casegate.errors import CasegateError


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder.  Only a local session without the setting gets a folder
    of its own: on a cluster a machine-local one would be lost with its machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise CasegateError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="casegate-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: for small tables of loops, and for rows whose ids must not be
    computed twice."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def write_table(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as parquet and continue from the files: for logs that many steps
    read, each with its own columns and filters.  ``codec``: the session's unless given."""
    path = f"{shared_folder(df.sparkSession)}/casegate-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_dealt(df: DataFrame, tasks: int, key: str, order: Sequence[str] = (), codec: str | None = None) -> DataFrame:
    """Write ``df``, which is hash partitioned by ``key`` into ``tasks`` partitions, as ``write_table`` does, in
    as many buckets: what groups or joins by ``key`` reads them without a shuffle.  Buckets are sorted by
    ``key`` and ``order``, as sorted rows are sorted again in little time.  Partitions of a few keys each
    serve as well: a file per partition and bucket that it holds."""
    name = uuid.uuid4().hex
    path = f"{shared_folder(df.sparkSession)}/casegate-{name}"
    writer = df.write.option("path", path).bucketBy(tasks, key).sortBy(key, *order)
    (writer.option("compression", codec) if codec else writer).saveAsTable(f"casegate_{name}")
    return df.sparkSession.table(f"casegate_{name}")


def drop_table(df: DataFrame) -> None:
    """Delete what ``write_table`` wrote for ``df``, once nothing reads it any more.  A frame that reads
    anything else is left alone."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/casegate-"
    paths = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    if len(paths) != 1:
        return
    (path,) = paths
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if target.getParent().toUri().getPath() == root.getParent().toUri().getPath() and target.getName().startswith(root.getName()):
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

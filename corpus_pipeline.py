"""Training corpus pipeline: documents in, packed sequences out.

Toxic documents go; of each group of near-duplicates one document stays; contaminated documents lose
their benchmark passages or go; personal data is replaced by its kind; what is left is packed.  All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casegate.lineage import write_table
from casegate.llm import decontamination, packing, pii, simhash, toxicity
from casegate.llm.common import table
from casegate.llm.tokens import default_vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints the document of the least id."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents without their benchmark passages, the others as they are."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), length_col="n_chars")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence."""
    return packing.pack(docs, default_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("personal_data", redact),
    ("packing", pack),
]

#: Nearest-neighbour votes, components and tokenizers are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir))
    return docs

"""Small tables for the corpus tests."""

import json

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(doc_id, text) pairs as a documents table."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: json.dumps(r, default=str))


def clashing(docs, *names):
    """``docs`` with further columns of the given names."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit("clash") for n in names})

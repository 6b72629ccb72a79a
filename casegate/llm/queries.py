"""The operators as queries over the whole tables, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegate.llm import clusters, decontamination, exact, fingerprints, html, licenses, packing, periodic, pii, simhash, token_counts, toxicity, warc
from casegate.llm.common import table
from casegate.llm.tokens import default_vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_vocabulary()).withColumnRenamed("id", "doc_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        F.col("longest").cast("long").alias("longest_match"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of each document, made from it: a cut of 12 code points after a third, its first 24
    code points put in after two thirds, and its last 9 replaced."""
    docs = table(spark, sf_dir, "documents")
    edits = F.expr(
        """array(
             struct(cast(length(text) div 3 as int) start, 12 deleted, '' inserted),
             struct(cast(length(text) * 2 div 3 as int) start, 0 deleted, substring(text, 1, 24) inserted),
             struct(length(text) + 3 start, 9 deleted, concat(' ', reverse(substring(text, 1, 9))) inserted))"""
    )
    return token_counts.recount(docs, default_vocabulary(), docs["doc_id"], docs["text"], edits).withColumnRenamed("id", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).select(
        F.col("id").alias("doc_id"),
        toxicity.held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "nearest",
        "cosines",
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    count = "cast(size(filter(base, s -> s.kind = '{0}')) as long) n_{0}"
    return pii.find(docs, docs["doc_id"], docs["text"]).selectExpr(
        "kept doc_id",
        *(count.format(k.name) for k in pii.BASE),
        f"sha2({pii.listed('base')}, 256) base_sha256",
        f"{pii.listed('concat(base, added)')} spans",
        "transform(concat(base, added), s -> s.score) scores",
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, docs["doc_id"], docs["text"]).withColumnRenamed("id", "doc_id")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.beside_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.responses_of(table(spark, sf_dir, "pages"))
    return warc.derivatives(responses, "page_id").withColumnRenamed("key", "page_id")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = docs.select(docs["doc_id"], periodic.periodic_tail(docs["doc_id"], docs["text"]).alias("text"))
    found = periodic.find(changed, changed["doc_id"], changed["text"])
    # the greatest length; ties by the smallest start, then period
    longest = F.expr(
        """aggregate(runs, cast(null as struct<start: long, length: long, period: long>),
                     (best, r) -> if(best is null or r.length > best.length, r, best))"""
    )
    return found.withColumn("longest", longest).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.duplicates(docs, docs["doc_id"], docs["text"]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = clusters.cluster(clusters.lattice(vectors, vectors["vec_id"], vectors["embedding"]))
    spread = {r.cluster: r.inertia for r in found.members.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in found.centroids.tolist()]
    sums = F.array(*[F.lit(spread.get(c, 0)).cast("long") for c in range(len(digests))]).cast("array<long>")
    return found.members.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        F.get(sums, "cluster").alias("cluster_inertia"),
        F.lit(sum(spread.values())).cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)).cast("array<string>"), "cluster").alias("centroid_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_fingerprints": op8_fingerprints,
    "op9_warc": op9_warc,
    "op10_html": op10_html,
    "op11_periodic": op11_periodic,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_clusters": op13_clusters,
}
SQL: dict[str, str] = {"op7_licenses": licenses.oracle(), "op12_exact_dedup": exact.oracle(), "op13_clusters": clusters.oracle()}

"""Queries that write a log or a report to the shared folder and read it back, and discovery by mode."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casegate.config import AnalysisConfig, ReadOptions
from casegate.lineage import shared_folder
from casegate.operators import discovery, metrics
from casegate.operators.labels import label
from casegate.operators.names import names_frame
from casegate.plans.log_queries import rounded
from casegate.plans.oracles import with_parts
from casegate.plans.registry import day, day_labelled, orders, register
from casegate.schema import ACTIVITY, CASE, KO, KO_KEY, REJECTED
from casegate.sources.derived import order_log, user_day_log
from casegate.sources.files import read_csv, read_xes, write_report, write_xes

KEYS = [CASE, ACTIVITY, "resource", "start_ts", "end_ts", "duration_us"]
#: Heads of the columns and how times are written.
HEADS = {CASE: "Case ID", ACTIVITY: "Activity", "resource": "Resource", "start_ts": "Start Timestamp", "end_ts": "Complete Timestamp"}
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def new_path(spark, suffix):
    return f"{shared_folder(spark)}/casegate-{uuid.uuid4().hex}{suffix}"


@register("a1_xes_round_trip", with_parts(f"SELECT {', '.join(KEYS)}, c_acctbal, o_totalprice, o_orderpriority FROM raw_order"))
def a1(spark, folder):
    path = new_path(spark, ".xes.gz")
    write_xes(order_log(spark, folder), path)
    return read_xes(spark, path).select(*KEYS, "c_acctbal", "o_totalprice", "o_orderpriority")


def csv_of(log, path, codec="none"):
    shown = [F.date_format(c, STAMP).alias(h) if c.endswith("_ts") else F.col(c).alias(h) for c, h in HEADS.items()]
    log.select(*shown, F.concat(F.lit('said "'), ACTIVITY, F.lit('",\nthen more')).alias("Note")).write.option(
        "header", True
    ).option("escape", '"').option("compression", codec).csv(path)


NOTED = with_parts(
    f"SELECT {', '.join(KEYS)}, 'said \"' || activity || '\",' || chr(10) || 'then more' AS note FROM raw_day"
)


@register("a3_csv_round_trip", NOTED)
def a3(spark, folder):
    """Quoted fields with quotes, commas and line breaks."""
    path = new_path(spark, ".csv")
    csv_of(user_day_log(spark, folder), path)
    return read_csv(spark, path, ReadOptions()).select(*KEYS, F.col("Note").alias("note"))


@register("a4_compressed_csv_round_trip", NOTED)
def a4(spark, folder):
    path = new_path(spark, ".csv")
    csv_of(user_day_log(spark, folder), path, "gzip")
    return read_csv(spark, path, ReadOptions()).select(*KEYS, F.col("Note").alias("note"))


@register("a15_report_file", with_parts("""
SELECT ko_activity, available_cases, knocked_out_cases, round(rejection_rate, 6) AS rejection_rate, waiting_waste_us FROM report"""))
def a15(spark, folder):
    data = day_labelled(spark, folder)
    path = new_path(spark, ".csv")
    write_report(metrics.report(data.log, data.labels, data.kos), path)
    back = spark.read.option("header", True).csv(path)
    numbers = {c: F.col(c).cast("long") for c in ("available_cases", "knocked_out_cases", "waiting_waste_us")}
    back = back.withColumns(numbers | {"rejection_rate": F.col("rejection_rate").cast("double")})
    return rounded(back.select(KO_KEY, *list(numbers)[:2], "rejection_rate", "waiting_waste_us"), "rejection_rate")


@register("i1_automatic_discovery", with_parts(
    "SELECT DISTINCT candidate AS activity FROM day_candidates WHERE candidate NOT IN ('Start', 'End')", LIMIT_=7))
def i1_automatic(spark, folder):
    found = discovery.discover(day(spark, folder), AnalysisConfig())
    return names_frame(spark, found.kos, ACTIVITY)


@register("i1_manual_discovery", with_parts("""
SELECT c.case_id, r.cut IS NOT NULL AS knocked_out_case, CASE WHEN r.cut IS NOT NULL THEN l.ko END AS knockout_activity
FROM (SELECT DISTINCT case_id FROM ord) c
LEFT JOIN (SELECT case_id, min((end_ts, seq)) AS cut FROM ord WHERE activity = 'Notify rejection' GROUP BY 1) r ON r.case_id = c.case_id
LEFT JOIN (
  SELECT o.case_id, arg_max(o.activity, (o.end_ts, o.seq)) AS ko FROM ord o
  JOIN (SELECT case_id, min((end_ts, seq)) AS cut FROM ord WHERE activity = 'Notify rejection' GROUP BY 1) k ON k.case_id = o.case_id
  WHERE o.activity IN ('Check Balance', 'Check Price') AND (o.end_ts, o.seq) <= k.cut GROUP BY 1) l ON l.case_id = c.case_id"""))
def i1_manual(spark, folder):
    config = AnalysisConfig(known_ko_activities=["Check Price", "Check Balance"], post_knockout_activities=["Notify rejection"])
    log = orders(spark, folder)
    found = discovery.discover(log, config)
    return label(log, found.kos, config).select(CASE, REJECTED, KO)

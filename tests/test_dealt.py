"""Logs dealt out by case: tables of few row groups, steps by case without a shuffle, texts that are numbers."""

import contextlib
import io
import re
from datetime import datetime

from pyspark.sql import functions as F

from casegate.operators.casetable import case_table, last_values
from casegate.operators.rules import Condition
from casegate.plans.analysis import redesign_options
from casegate.plans.registry import orders_labelled
from casegate.operators.waiting import waiting_time_waste
from casegate.schema import CASE
from casegate.sources.derived import order_log, order_tasks
from tests.logs import event, log_of


def order_tables(spark, folder, n=400):
    """Orders and customers, a file of one row group each."""
    place = F.col("id")
    spark.range(n).select(
        place.alias("o_orderkey"),
        (place % 40).alias("o_custkey"),
        (place * 997 % 500_000).cast("double").alias("o_totalprice"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("o_orderdate"),
        F.concat(place % 5 + 1, F.lit("-P")).alias("o_orderpriority"),
    ).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.range(40).select(place.alias("c_custkey"), (place * 7 - 60).cast("double").alias("c_acctbal")).coalesce(1).write.parquet(
        f"{folder}/customer.parquet"
    )
    return str(folder)


def plan(df):
    told = io.StringIO()
    with contextlib.redirect_stdout(told):
        df.explain()
    return told.getvalue()


def test_one_row_group_becomes_many_tasks_of_whole_cases(spark, tmp_path):
    folder = order_tables(spark, tmp_path)
    placed = order_log(spark, folder).select(CASE, F.spark_partition_id().alias("task")).distinct().collect()
    assert len(placed) == len({row[CASE] for row in placed}) == 400
    assert len({row["task"] for row in placed}) == order_tasks(spark, folder) == spark.sparkContext.defaultParallelism


def test_steps_by_case_read_the_written_log_without_a_shuffle(spark, tmp_path):
    data = orders_labelled(spark, order_tables(spark, tmp_path))
    rows = last_values(data.base, ["c_acctbal"]).join(data.labels.hint("merge"), CASE)
    assert "Exchange" not in plan(rows) and rows.count() == 400
    assert "Exchange" not in plan(data.base.join(data.labels.hint("merge"), CASE, "left"))


def test_an_early_text_keeps_a_column_text(spark):
    rows = [event(case, at, "a", at, at + 1) for case in ("x", "y") for at in (1, 2)]
    more = [("one", "1"), ("1", "2"), ("3", "3"), ("4", "4")]
    log = log_of(spark, rows, "mixed string, number string", more)
    labels = spark.createDataFrame([("x", True, "a"), ("y", False, None)], "case_id string, knocked_out_case boolean, knockout_activity string")
    kinds = dict(case_table(log, labels).dtypes)
    assert (kinds["mixed"], kinds["number"]) == ("string", "double")


def test_dependencies_of_the_options_are_found_once(spark, tmp_path):
    data = orders_labelled(spark, order_tables(spark, tmp_path))
    rulesets = {"Check Balance": [(Condition("c_acctbal", "<", hi=0.0),)]}
    effort = spark.createDataFrame([("Check Balance", 1.0)], "ko_activity string, effort double")
    report = redesign_options(data.log, effort, rulesets, None)["dependencies"]
    assert "Window" not in plan(report)
    assert report.first()["dependencies"] == "'c_acctbal' is known once this is done: 'Load account'"


def test_waiting_points_of_equal_time_are_one_row_and_written_once(spark, tmp_path):
    data = orders_labelled(spark, order_tables(spark, tmp_path))
    told = plan(waiting_time_waste(data.log, data.kos))
    assert "resource, t, ko_activity" in "".join(re.findall(r"ReadSchema: (\S+)", told)).replace("struct<", "").replace(":string", "").replace(":bigint", "").replace(",", ", ")

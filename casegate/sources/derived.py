"""Event logs projected from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegate.schema import ACTIVITY, CASE, DURATION, END_TS, MICROS_PER_SECOND, RESOURCE, SEQ, START_TS, utc

CHAIN = (
    # activity, minutes it takes; the position in the list is the step
    ("Receive order", 2),
    ("Load account", 3),
    ("Check Balance", 5),
    ("Check Price", 10),
    ("Check Priority", 20),
)
CHAIN_CHECKS = ("Check Balance", "Check Price", "Check Priority")
REJECTION = "Notify rejection"
ACCEPTANCE = "Accept order"
CLOSING = "Close order"
#: Orders that one task makes events of at most, so that sorting them takes no more memory with more input.
ORDERS_PER_TASK = 100_000
#: Events that one task takes of a log whose cases are dealt out, on average at most.
EVENTS_PER_TASK = 250_000


def user_day_log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a log: a case is one user's day, an activity is an event type."""
    events = utc(spark).read.parquet(f"{folder}/events.parquet")
    seconds = F.floor(F.col("value") * 60)
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.concat(F.col("user_id"), F.lit("_"), F.date_format("ts", "yyyyMMdd")).alias(CASE),
        F.col("event_id").alias(SEQ),
        F.col("event_type").alias(ACTIVITY),
        F.concat(F.lit("R"), k % 10).alias(RESOURCE),
        F.col("ts").alias(START_TS),
        (F.col("ts") + F.make_dt_interval(secs=seconds)).alias(END_TS),
        (seconds * MICROS_PER_SECOND).cast("long").alias(DURATION),
        "value",
        k.alias("k"),
    )


def _tasks(spark: SparkSession, table: str, rows: int) -> int:
    """As many tasks for every core, of so many ``rows`` of the table at most on average."""
    cores = spark.sparkContext.defaultParallelism
    return cores * (1 + spark.read.parquet(table).count() // (rows * cores))


def event_tasks(spark: SparkSession, folder: str) -> int:
    """How many tasks the cases of ``user_day_log`` are dealt out to."""
    return _tasks(spark, f"{folder}/events.parquet", EVENTS_PER_TASK)


def order_tasks(spark: SparkSession, folder: str) -> int:
    """How many partitions ``order_log`` has."""
    return _tasks(spark, f"{folder}/orders.parquet", ORDERS_PER_TASK)


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` and ``customer`` as a log: a strict chain of three checks.

    Each check rejects on one attribute, so the rules behind it are known.  The
    account balance is null until the account is loaded.  Orders are dealt out and
    sorted by case before they become events, which are some seven times as many: tasks
    are of one size however the file is split, events of a case lie together where the
    log is written, and a grouping by case needs no shuffle of its own.
    """
    spark = utc(spark)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customer = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_acctbal")
    case = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        F.col("o_orderkey").cast("string").alias(CASE),
        "o_orderkey",
        "o_orderdate",
        "c_acctbal",
        "o_totalprice",
        "o_orderpriority",
        F.when(F.col("c_acctbal") < 0, 3)
        .when(F.col("o_totalprice") > 400000, 4)
        .when(F.col("o_orderpriority") == "5-LOW", 5)
        .otherwise(99)
        .alias("stop"),
    )
    case = case.repartition(order_tasks(spark, folder), CASE).sortWithinPartitions(CASE)
    steps = [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.lit(minutes).alias("minutes"))
        for i, (name, minutes) in enumerate(CHAIN, start=1)
    ]
    outcome = F.struct(
        F.lit(6).alias("step"),
        F.when(F.col("stop") < 99, REJECTION).otherwise(ACCEPTANCE).alias("name"),
        F.lit(1).alias("minutes"),
    )
    closing = F.struct(F.lit(7).alias("step"), F.lit(CLOSING).alias("name"), F.lit(1).alias("minutes"))
    done = F.filter(
        F.array(*steps, outcome, closing), lambda s: (s["step"] <= F.col("stop")) | (s["step"] >= 6)
    )
    event = case.withColumn("e", F.explode(done))
    begin = F.col("o_orderdate") + F.make_dt_interval(
        hours=F.col("e.step"), mins=(F.col("o_orderkey") % 7).cast("int")
    )
    return event.select(
        CASE,
        (F.col("o_orderkey") * 10 + F.col("e.step")).alias(SEQ),
        F.col("e.name").alias(ACTIVITY),
        F.concat(F.lit("R"), (F.col("o_orderkey") + F.col("e.step")) % 8).alias(RESOURCE),
        begin.alias(START_TS),
        (begin + F.make_dt_interval(mins=F.col("e.minutes"))).alias(END_TS),
        (F.col("e.minutes").cast("long") * 60 * MICROS_PER_SECOND).alias(DURATION),
        F.when(F.col("e.step") > 2, F.col("c_acctbal")).alias("c_acctbal"),
        "o_totalprice",
        "o_orderpriority",
    )

"""Every operator as a named query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casegate.lineage import write_dealt, write_table
from casegate.operators.discovery import activities_before, excluded
from casegate.operators.labels import label_cases, label_log, rejected_cases
from casegate.operators.names import names_of
from casegate.operators.prepare import add_boundaries
from casegate.operators.scan import cuts_of
from casegate.schema import ACTIVITY, BY_START, CASE, END, KO, START
from casegate.sources.derived import event_tasks, order_log, order_tasks, user_day_log

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query and the SQL with the same result."""

    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


DAY_POST = ["error"]
ORDER_POST = ["Notify rejection"]


class Labelled:
    """A log with its checks and labels.  The log and its labels (one row per case) are
    written once, as every step below reads them; the rest is lazy but for the names.
    ``dealt``: into how many tasks the log is hash partitioned by case, if it is."""

    def __init__(self, log: DataFrame, post: list[str], dealt: int | None = None):
        log = self.base = write_dealt(log, dealt, CASE, BY_START) if dealt else write_table(log)
        unwanted = [START, END, *post]
        self.candidates = names_of(excluded(activities_before(log, post), ACTIVITY, unwanted), ACTIVITY)
        rejected = rejected_cases(log, self.candidates, post)
        labels = label_cases(log, rejected, self.candidates, post)
        self.labels = write_dealt(labels, dealt, CASE) if dealt else write_table(labels)
        self.log = label_log(log, self.labels)

    @property
    def kos(self):
        return names_of(self.labels, KO)


def day(spark: SparkSession, folder: str) -> DataFrame:
    return add_boundaries(user_day_log(spark, folder))


def day_by_case(spark: SparkSession, folder: str) -> tuple[DataFrame, bool]:
    """``day``, and whether its cases are whole: events are dealt out by case before anything is made of them, to
    tasks of one size however the file is split, so boundaries and steps need no shuffle of their own.  Where a
    case holds more than a task should, the log stays as it comes."""
    log, tasks = user_day_log(spark, folder), event_tasks(spark, folder)
    pieces = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    whole = cuts_of(log, [CASE], BY_START, pieces) is None
    return add_boundaries(log.repartition(tasks, CASE) if whole else log), whole


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return add_boundaries(order_log(spark, folder))


def day_labelled(spark: SparkSession, folder: str) -> Labelled:
    return Labelled(day(spark, folder), DAY_POST)


def orders_labelled(spark: SparkSession, folder: str) -> Labelled:
    return Labelled(orders(spark, folder), ORDER_POST, order_tasks(spark, folder))

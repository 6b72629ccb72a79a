"""Local Spark session for tests."""

from pyspark.sql import SparkSession


def local_session(cpus="8"):
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("casegate-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )

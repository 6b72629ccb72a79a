"""Event log files: XES and CSV, plain or compressed, and the report sink."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Mapping
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegate.config import AnalysisConfig, ReadOptions
from casegate.errors import UnsupportedFileError
from casegate.lineage import drop_table, write_dealt, write_table
from casegate.operators.prepare import (
    DEFAULT_NAMES,
    add_boundaries,
    canonical,
    deduplicate,
    drop_attributes,
    drop_native_boundaries,
    keep_tasks,
    parse_timestamps,
    rename,
    to_intervals,
)
from casegate.schema import ACTIVITY, CASE, END_TS, RESOURCE, SEQ, START_TS, utc
from casegate.sources.quoted import read_quoted_csv

# Typed attribute tags of the XES format and the Spark types.
XES_TYPES = {"string": "string", "date": "string", "int": "bigint", "float": "double", "boolean": "boolean"}

# Standard XES keys.
XES_CASE = "concept:name"
XES_ACTIVITY = "concept:name"
XES_RESOURCE = "org:resource"
XES_TRANSITION = "lifecycle:transition"
XES_TIME = "time:timestamp"
SIMULATOR = "com.qbpsimulator"

#: Which part of the files an event comes from, a column of ``read_xes_events``.
PART = "_part"
#: Text of a file that one part holds, some 75,000 events, and how many bytes of text a compressed byte stands for.
PART_BYTES = 32 << 20
UNPACKED = 16
#: What is written to be read a few times holds many repeats; this codec takes some two fifths less than the default.
CODEC = "zstd"


def extension(path: str) -> str:
    """``.xes``, ``.csv`` (also under ``.gz``) or ``.zip``."""
    name = path.lower().rstrip("/")
    if name.endswith(".zip"):
        return ".zip"
    name = name.removesuffix(".gz")
    for known in (".xes", ".csv"):
        if name.endswith(known):
            return known
    raise UnsupportedFileError(f"not a log format: {path}")


def trace_schema() -> T.StructType:
    pair = T.StructType(
        [T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]
    )
    tags = [T.StructField(tag, T.ArrayType(pair)) for tag in XES_TYPES]
    return T.StructType([*tags, T.StructField("event", T.ArrayType(T.StructType(tags)))])


def pairs(prefix: str = "") -> Column:
    """All typed attributes of an element as one array of (key, value, tag)."""
    none = F.array().cast("array<struct<_key:string,_value:string>>")

    def tagged(tag: str) -> Column:
        return F.transform(
            F.coalesce(F.col(prefix + tag), none),
            lambda p: F.struct(p["_key"].alias("k"), p["_value"].alias("v"), F.lit(tag).alias("tag")),
        )

    parts = [tagged(tag) for tag in XES_TYPES]
    return F.concat(*parts)


def part_of(size: Column, packed: Column) -> Column:
    """The part of the files that a trace is in: by the task that reads it and, of files of more than
    ``PART_BYTES``, by its case.  So traces of one file that have the same name are in one part."""
    text = size * F.when(packed, UNPACKED).otherwise(1)
    parts = F.floor(text / PART_BYTES) + 1
    return F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.pmod(F.hash(F.col(CASE)), parts)


def xes_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per event of XES files: part, case, place in the trace and its attributes as pairs."""
    if extension(path) == ".zip":
        rows = zipped_xes_rows(spark, path)
        return rows.select(part_of(F.col("size"), F.lit(True)).alias(PART), CASE, "place", "pairs")
    read = utc(spark).read.format("xml").option("rowTag", "trace").schema(trace_schema()).load(path)
    name = F.element_at(F.filter(F.col("string"), lambda p: p["_key"] == XES_CASE), 1)["_value"]
    packed = F.lower(F.input_file_name()).endswith(".gz")
    traces = read.select(name.alias(CASE), "event", F.input_file_block_length().alias("size"), packed.alias("packed"))
    parts = traces.select(part_of(F.col("size"), F.col("packed")).alias(PART), CASE, "event")
    return parts.select(PART, CASE, F.posexplode("event").alias("place", "e")).select(
        PART, CASE, "place", pairs("e.").alias("pairs")
    )


def zipped_xes_rows(spark: SparkSession, path: str) -> DataFrame:
    """The same for XES files in zip archives, one task per archive, a trace at a time."""

    def attributes(element) -> list[dict]:
        found = []
        for child in element:
            tag = child.tag.rpartition("}")[2]
            if tag in XES_TYPES:
                found.append({"k": child.get("key"), "v": child.get("value"), "tag": tag})
        return found

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for content, size in zip(batch["content"], batch["length"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(archive.namelist()):
                        if not name.lower().endswith(".xes"):
                            continue
                        with archive.open(name) as member:
                            for _, element in ElementTree.iterparse(member):
                                if element.tag.rpartition("}")[2] != "trace":
                                    continue
                                case = next((a["v"] for a in attributes(element) if a["k"] == XES_CASE and a["tag"] == "string"), None)
                                events = [e for e in element if e.tag.rpartition("}")[2] == "event"]
                                rows = {"place": range(len(events)), "pairs": [attributes(e) for e in events], "size": size}
                                yield pd.DataFrame({CASE: case, **rows})
                                element.clear()

    archives = spark.read.format("binaryFile").load(path).select("content", "length")
    return archives.mapInPandas(
        parse, f"{CASE} string, place int, pairs array<struct<k:string,v:string,tag:string>>, size long"
    )


def read_xes_events(spark: SparkSession, path: str) -> DataFrame:
    """One row per event: case, place in the trace and a column per attribute key, and the part of the
    files if each case is in one part.

    Attribute types come from the XML tags; a value that is not of its type raises.  The files are
    parsed once and the typed events written, as every step below reads them.  The keys are found with
    one distinct over the parsed events; they are a schema, so they go to the driver.

    The events are in buckets by part, so what goes by part and case needs no shuffle of the events.  Where
    traces of one name are in several parts, steps by case shuffle the events.
    """
    parsed = write_table(xes_rows(spark, path), CODEC)
    keys = (
        parsed.select(F.explode("pairs").alias("p")).select("p.k", "p.tag").distinct().orderBy("k", "tag").collect()
    )
    types: dict[str, str] = {}
    for row in keys:
        types[row["k"]] = row["tag"] if types.get(row["k"], row["tag"]) == row["tag"] else "string"
    # of a key that is given twice, the last value
    latest = parsed.select(PART, CASE, "place", F.reverse("pairs.k").alias("k"), F.reverse("pairs.v").alias("v"))
    columns = [
        F.get("v", (F.array_position("k", key) - 1).cast("int")).cast(XES_TYPES[tag]).alias(key)
        for key, tag in types.items()
    ]
    parts = parsed.select(PART).distinct().count()
    events = write_dealt(latest.select(PART, CASE, "place", *columns), max(1, parts), PART, codec=CODEC)
    drop_table(parsed)
    spread = events.groupBy(CASE).agg((F.min(PART) != F.max(PART)).alias("spread")).filter("spread")
    return events if spread.isEmpty() else events.drop(PART)


def from_simulator(spark: SparkSession, path: str) -> bool:
    """Whether the log names the simulator as its source; asked only of logs with element ids."""
    if extension(path) == ".zip":
        return archived_simulator(spark, path)
    return not spark.read.text(path).filter(F.col("value").contains(SIMULATOR)).isEmpty()


def archived_simulator(spark: SparkSession, path: str) -> bool:
    """The same for logs in zip archives, read a line at a time."""

    def look(batches):
        import pandas as pd

        wanted = SIMULATOR.encode()
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.lower().endswith(".xes"):
                            with archive.open(name) as member:
                                yield pd.DataFrame({"named": [any(wanted in line for line in member)]})

    archives = spark.read.format("binaryFile").load(path).select("content")
    return not archives.mapInPandas(look, "named boolean").filter("named").isEmpty()


def zone_free(text: Column) -> Column:
    """The wall-clock time written in a timestamp text; its zone is left out.  Other texts raise."""
    local = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.replace(local, F.lit("T"), F.lit(" ")).cast("timestamp_ntz")


def read_xes(
    spark: SparkSession, path: str, names: Mapping[str, str] | None = None, simulator_export: bool | None = None
) -> DataFrame:
    """XES to interval events: lifecycle rows are paired, keys renamed, boundary rows
    of the tool removed, copies dropped.  Exports of the simulator are told by their source."""
    rows = read_xes_events(spark, path)
    within = [PART] if PART in rows.columns else []
    keys = {XES_ACTIVITY: ACTIVITY, XES_RESOURCE: RESOURCE, XES_TRANSITION: "transition", XES_TIME: "ts"}
    found = rows.withColumnsRenamed({k: v for k, v in keys.items() if k in rows.columns})
    if RESOURCE not in found.columns:
        found = found.withColumn(RESOURCE, F.lit(None).cast("string"))
    found = found.withColumn("ts", zone_free(F.col("ts")))
    found = found.withColumn(SEQ, F.col("place").cast("long")).drop("place")
    if "transition" in found.columns:
        paired = to_intervals(found.withColumn("transition", F.lower("transition")), within)
    else:
        paired = found.withColumns({END_TS: F.col("ts"), START_TS: F.col("ts")}).drop("ts")
    cleaned = drop_native_boundaries(rename(paired, names or {}))
    if "elementId" in cleaned.columns:
        if from_simulator(spark, path) if simulator_export is None else simulator_export:
            cleaned = keep_tasks(cleaned)
    return canonical(deduplicate(cleaned).drop(PART))


def zipped_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the CSV files in zip archives as maps from column to text, one task per archive; each
    file has its own header."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in sorted(archive.namelist()):
                        if not name.lower().endswith(".csv"):
                            continue
                        with archive.open(name) as member:
                            rows = (r for r in csv.reader(io.TextIOWrapper(member, encoding="utf-8-sig", newline="")) if r)
                            header = next(rows, None)
                            while header and (some := list(itertools.islice(rows, 10_000))):
                                maps = [[(k, v or None) for k, v in zip(header, r)] for r in some]
                                yield pd.DataFrame({"header": [header] * len(some), "r": [dict(m) for m in maps]})

    archives = spark.read.format("binaryFile").load(path).select("content")
    return archives.mapInPandas(parse, "header array<string>, r map<string,string>")


def read_csv_rows(spark: SparkSession, path: str, split_lines: bool = False) -> DataFrame:
    """CSV rows as text columns; ``.gz`` by extension, ``.zip`` unpacked in tasks.

    Quoted fields may hold line breaks: files are split for many tasks and cut at the ends of rows
    (which numbers them as ``seq``), unless ``split_lines`` says that each row is one line.
    """
    if extension(path) != ".zip":
        if not split_lines:
            return read_quoted_csv(spark, path, SEQ)
        return spark.read.option("header", True).option("escape", '"').csv(path)
    rows = zipped_csv_rows(spark, path)
    headers = rows.select("header").distinct().collect()  # one row a kind of file
    columns = list(dict.fromkeys(c for r in sorted(headers, key=lambda r: r["header"]) for c in r["header"]))
    return rows.select(*[F.col("r")[c].alias(c) for c in columns])


def read_csv(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> DataFrame:
    """CSV to the canonical log.  ``column_names`` maps source to key columns; a log
    with one timestamp has only the completion time."""
    names = {**DEFAULT_NAMES, **dict(options.column_names or {})}
    rows = rename(read_csv_rows(utc(spark), path, options.split_lines), names)
    times = [END_TS] if options.one_timestamp else [START_TS, END_TS]
    if RESOURCE not in rows.columns:
        rows = rows.withColumn(RESOURCE, F.lit(None).cast("string"))
    log = drop_native_boundaries(parse_timestamps(rows, times, options.timestamp_format))
    log = canonical(log, options.one_timestamp)
    return drop_attributes(log) if options.filter_d_attrib else log


def holds_xes(spark: SparkSession, path: str) -> bool:
    """Whether zip archives hold XES files."""

    def look(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    yield pd.DataFrame({"xes": [any(n.lower().endswith(".xes") for n in archive.namelist())]})

    archives = spark.read.format("binaryFile").load(path).select("content")
    return not archives.mapInPandas(look, "xes boolean").filter("xes").isEmpty()


def read_log(spark: SparkSession, config: AnalysisConfig) -> DataFrame:
    """The log a configuration names, with boundary events."""
    path, options = config.log_path, config.read_options
    kind = extension(path)
    if kind == ".xes" or (kind == ".zip" and holds_xes(spark, path)):
        log = read_xes(spark, path, options.column_names)
        log = drop_attributes(log) if options.filter_d_attrib else log
    else:
        log = read_csv(spark, path, options)
    return add_boundaries(log)


def write_report(report: DataFrame, path: str) -> None:
    """The analysis report as CSV; it has one row per check, so one file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_xes(log: DataFrame, path: str) -> None:
    """The log as XES: start and complete rows in each trace, typed attributes; compressed files
    if the name ends in ``.gz``.

    A trace is one XML element, so its events are gathered into one row; a case must
    fit a row of the file.  They are gathered as they are and get their XML form after.
    """
    fixed = {CASE, SEQ, ACTIVITY, RESOURCE, START_TS, END_TS, "duration_us"}
    tag_of = {"string": "string", "boolean": "boolean", "double": "float", "float": "float"}
    tag_of |= {t: "int" for t in ("tinyint", "smallint", "int", "bigint")}
    tag_of |= {t: "date" for t in ("timestamp", "timestamp_ntz", "date")}
    extra = [(c, tag_of.get(t, "string")) for c, t in log.dtypes if c not in fixed]

    def pair(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))

    def stamp(ts: Column) -> Column:
        return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    kept = [SEQ, ACTIVITY, RESOURCE, START_TS, END_TS, *[c for c, _ in extra]]

    def event(row: Column, transition: str, ts: str, order: int) -> Column:
        values = {c: row.getField(f"x{i}") for i, c in enumerate(kept)}
        tags: dict[str, list[Column]] = {tag: [] for tag in XES_TYPES}
        tags["string"] += [
            pair(XES_ACTIVITY, values[ACTIVITY]),
            pair(XES_RESOURCE, values[RESOURCE]),
            pair(XES_TRANSITION, F.lit(transition)),
        ]
        tags["date"].append(pair(XES_TIME, stamp(values[ts])))
        for name, tag in extra:
            tags[tag].append(pair(name, stamp(values[name]) if tag == "date" else values[name]))
        body = F.struct(
            *[
                F.filter(
                    F.array(*found) if found else F.array().cast("array<struct<_key:string,_value:string>>"),
                    lambda p: p["_value"].isNotNull(),
                ).alias(tag)
                for tag, found in tags.items()
            ]
        )
        return F.struct(values[ts].alias("at"), values[SEQ].alias(SEQ), F.lit(order).alias("o"), body.alias("body"))

    gathered = F.collect_list(F.struct(*[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(kept)]))
    traces = log.groupBy(CASE).agg(gathered.alias("rows"))
    both = F.transform("rows", lambda r: F.array(event(r, "start", START_TS, 0), event(r, "complete", END_TS, 1)))
    shaped = traces.select(
        F.array(pair(XES_CASE, F.col(CASE))).alias("string"),
        F.transform(F.sort_array(F.flatten(both)), lambda e: e["body"]).alias("event"),
    )
    writer = shaped.write.mode("overwrite").format("xml").option("rootTag", "log").option("rowTag", "trace")
    (writer.option("compression", "gzip") if path.lower().rstrip("/").endswith(".gz") else writer).save(path)

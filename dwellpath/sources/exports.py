"""Sources and sinks: timeline and tracker exports, anchor ranges, stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellpath.functions.geo import z_key
from dwellpath.operators.ingest import revision, revision_kept
from dwellpath.sources.records import json_records, text_lines
from dwellpath.sources.scratch import staged
from dwellpath.sources.store import Store

#: Read schemas; every field can be missing.
TIMELINE = """startTime string, endTime string,
  visit struct<topCandidate: struct<placeLocation: string, placeID: string, semanticType: string>>,
  activity struct<start: string, end: string, distanceMeters: string, topCandidate: struct<type: string, probability: string>>,
  activitySegment struct<start: string, end: string, distanceMeters: string, topCandidate: struct<type: string, probability: string>,
    timelinePath: struct<waypoints: array<struct<latE7: bigint, lngE7: bigint>>>, editConfirmationStatus: string, parkingEvent: string, simplifiedRawPath: string>,
  timelinePath array<struct<point: string, durationMinutesOffsetFromStartTime: string>>"""
TRACKER = """isVisit boolean, startTime string, startDate string, endTime string, endDate string, itemId string, activityType string, activityTypeConfidenceScore double,
  manualActivityType string, uncertainActivityType string, place struct<name: string>, streetAddress string, center struct<latitude: double, longitude: double>,
  samples array<struct<location: struct<latitude: double, longitude: double>, secondsFromGMT: int>>"""
ANCHORS = "lat double, lon double, place_id string, name string, start_date string, end_date string"


def read_timeline(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Records of timeline files: a list, or an object with timelineObjects; files of any size, read in parallel.

    Keeps the file, and in ``seq`` the place in it. ``more``: further fields of the records, as
    "subject_id bigint" where a file has several people's. For records one a line see ``read_timeline_lines``.
    """
    return _parsed(json_records(spark, path, "timelineObjects"), more)


def _parsed(texts: DataFrame, more: str) -> DataFrame:
    return parsed_once(texts, _with(more, TIMELINE), "file", "seq")


def parsed_once(texts: DataFrame, schema: str, *keep: str) -> DataFrame:
    """``texts`` with the fields of their JSON ``value`` in place of it.

    Each text is parsed once: filters on the fields don't pass an explode, while below a mere
    projection each field in a filter would be parsed, and its text made, again.
    """
    record = F.from_json("value", f"struct<{_fields(schema)}>")
    return texts.select(*keep, F.explode(F.array(record)).alias("r")).filter("r is not null").select(*keep, "r.*")


def _with(more: str, schema: str) -> str:
    return f"{more}, {schema}" if more else schema


def _fields(schema: str) -> str:
    """A column list as the fields of a struct."""
    out, depth = [], 0
    for word in schema.replace("\n", " ").split():
        out.append(word if depth or ":" in word else word + ":" if (not out or out[-1].endswith(",")) else word)
        depth += word.count("<") - word.count(">")
    return " ".join(out)


def read_timeline_lines(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Records one a line, with the file and the place in it."""
    return _parsed(text_lines(spark, path).filter(F.trim("value") != ""), more)


def read_tracker(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """Items of daily tracker files (gzip or not), with file name and place in the file."""
    raw = spark.read.schema(f"timelineItems array<struct<{_fields(_with(more, TRACKER))}>>").option("multiLine", True).json(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), F.posexplode("timelineItems").alias("seq", "r")).select("file", "seq", "r.*")


def read_anchor_ranges(spark: SparkSession, path: str, more: str = "", lines: bool = False) -> DataFrame:
    """Home or work ranges in listed order; null dates are open sides.

    A file is one list. With ``lines`` each line of a file is one, as for the ranges of many people:
    a file for each person would cost more to open than to read.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.posexplode(F.from_json("value", f"array<struct<{_fields(_with(more, ANCHORS))}>>")).alias("pos", "r"))
    r = raw.select("pos", "r.*")
    return r.withColumn("start_date", F.to_date("start_date")).withColumn("end_date", F.to_date("end_date"))


def _by_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("start_time", "yyyy-MM"))


def visit_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, ("month",))


def movement_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, ("source", "month"))


def append_visits(visits: DataFrame, path: str, rows_a_group: int | None = None) -> None:
    """Append to the stored visits, by month of the start and in it by place.

    Rows are dealt out and sorted by (month, z_key), so a file and a group of rows in it hold a
    small area, and readers of a box skip the others by the bounds of z_key, lat and lon that Parquet keeps.
    ``rows_a_group``: smaller groups than Parquet's default, for tables that are small or read in small boxes.
    """
    v = _by_month(visits).withColumn("z_key", z_key("lat", "lon"))
    laid = v.repartitionByRange("month", "z_key").sortWithinPartitions("month", "z_key")
    options = {"parquet.block.row.count.limit": str(rows_a_group), "parquet.page.row.count.limit": str(rows_a_group)} if rows_a_group else {}
    visit_store(visits.sparkSession, path).write(laid, **options)


def write_movements(movements: DataFrame, path: str) -> None:
    """Append to the stored movements, by source and month of the start."""
    movement_store(movements.sparkSession, path).write(_by_month(movements))


def replace_source(movements: DataFrame, path: str, source: str) -> None:
    """Replace one source's stored movements, by rows that may be made from the stored ones; all at once, or not at all."""
    movement_store(movements.sparkSession, path).write(_by_month(movements.filter(F.col("source") == source)), replace=lambda p: p[0] == source)


def revise_movements(new: DataFrame, path: str, source: str, days: int = 7, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> set[tuple[str, ...]]:
    """Bring new movements of ``source`` into the stored ones by ``merge_revision_window``; only the months that change are read whole and written.

    A subject's later stored rows go and later new rows come; the partitions that either is in are
    written anew. Returns the partitions written.
    """
    store = movement_store(new.sparkSession, path)
    stored = store.read(lambda p: p[0] == source)
    if stored is None:
        return store.write(_by_month(prepare(new)))
    going, coming = revision(stored, new, source, days)
    coming = staged(_by_month(prepare(coming)))
    changed = _months(going.select("month")).union(_months(coming.select("month"))).distinct()
    months = {r["month"] for r in changed.collect()}  # of a calendar
    touched = lambda p: p[0] == source and p[1] in months
    kept = revision_kept(store.read(touched), going)
    return store.write(kept.unionByName(coming.select(*kept.columns)), replace=touched)


def _months(df: DataFrame) -> DataFrame:
    return df.select(F.col("month").cast("string").alias("month")).distinct()


TRIP = ("trip_id", "subject_id", "start_time", "end_time", "local_start_ts", "local_end_ts", "category", "display_name", "cities", "primary_location_id")


def trip_stores(spark: SparkSession, path: str) -> tuple[Store, Store]:
    """Trips by month of the start, and their bridge to visits by the same."""
    return Store(spark, f"{path}/trips", ("month",)), Store(spark, f"{path}/trip_visits", ("month",))


def write_trips(trips: DataFrame, path: str, names: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Store trips and their bridge to visits; a trip whose subject, start and end are stored already is passed over, with its visits.

    ``names``: trip_id with display_name, cities and primary_location_id, of which any may be
    missing. ``force``: in place of all that is stored. The bridge is committed first, so no trip
    is seen without its visits, and readers take the bridge of stored trips alone. Returns the trips
    that came new.
    """
    spark = trips.sparkSession
    t_store, b_store = trip_stores(spark, path)
    stored = None if force else t_store.read()
    key = ["subject_id", "start_time", "end_time"]
    new = trips.dropDuplicates(key) if stored is None else trips.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
    if names is not None:
        new = new.join(names.select("trip_id", *[c for c in TRIP if c in names.columns and c != "trip_id"]), "trip_id", "left")
    new = staged(_by_month(new))
    pairs = new.select("trip_id", "subject_id", F.explode("visit_ids").alias("visit_id"), "month").distinct()
    b_store.write(pairs, replace=lambda _: force)
    t_store.write(new.select(*[c for c in TRIP if c in new.columns], "month"), replace=lambda _: force)
    return new


def read_trips(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trips, bridge) as stored."""
    t_store, b_store = trip_stores(spark, path)
    trips = t_store.read()
    if trips is None:
        raise FileNotFoundError(f"no trips are stored in {path}")
    return trips, b_store.read().join(trips.select("trip_id"), "trip_id", "left_semi").distinct()

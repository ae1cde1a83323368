"""From parsed exports to stored visits and movements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions import parse as P
from dwellpath.functions.geo import distance_m, path_length_m
from dwellpath.operators.joins import between_micros, near_in_time, nearest_record, overlapping, shuffled
from dwellpath.operators.slices import SLICE_ROWS, time_slices

MINUTE = 60_000_000


def route_records(raw: DataFrame) -> DataFrame:
    """Adds ``kind``: a visit beats all, a path alone is a breadcrumb trail, activity beats activitySegment."""
    kind = (
        F.when(F.col("visit").isNotNull(), "visit")
        .when(F.col("activity").isNotNull(), "activity")
        .when(F.col("activitySegment").isNotNull(), "segment")
        .when(F.col("timelinePath").isNotNull(), "breadcrumb")
    )
    return raw.withColumn("kind", kind).filter("kind is not null")


def _times(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("start_time", P.utc_instant("startTime")).withColumn("end_time", P.utc_instant("endTime"))
        .withColumn("local_start_ts", P.local_clock("startTime")).withColumn("local_end_ts", P.local_clock("endTime"))
        .withColumn("duration_minutes", P.duration_minutes("start_time", "end_time"))
    )


def _placed(records: DataFrame) -> DataFrame:
    return _times(records.filter("kind = 'visit'")).withColumn("_p", P.geo_point("visit.topCandidate.placeLocation"))


def rejected_visits(records: DataFrame) -> DataFrame:
    """Visit records that can't be stored, with the reason: no candidate, no point or no time."""
    reason = F.when(F.col("visit.topCandidate").isNull(), "no candidate").when(F.col("_p").isNull(), "no point").when(F.col("start_time").isNull() | F.col("end_time").isNull(), "no time")
    keep = [c for c in ("subject_id", "file", "seq", "id") if c in records.columns]
    return _placed(records).withColumn("reason", reason).filter("reason is not null").select(*keep, "startTime", "endTime", "reason")


def visits_from_timeline(records: DataFrame) -> DataFrame:
    """Visits whose place and times can be parsed."""
    v = _placed(records).filter("_p is not null and start_time is not null and end_time is not null")
    keep = [c for c in ("subject_id", "file", "seq", "id") if c in records.columns]
    return v.select(
        *keep, "start_time", "end_time", "duration_minutes", "local_start_ts", "local_end_ts", F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"),
        F.lit("timeline").alias("visit_type"), F.col("visit.topCandidate.semanticType").alias("semantic_type"), F.col("visit.topCandidate.placeID").alias("place_id"),
    )


def _metadata(facts: dict[str, Column]) -> Column:
    """What else the export says, as a map of those facts that are there."""
    given = F.create_map(*[x for name, value in facts.items() for x in (F.lit(name), value)])
    return F.map_filter(given, lambda _, v: v.isNotNull()).alias("metadata")


def movements_from_activities(records: DataFrame, kind: str) -> DataFrame:
    """Activities of the old (``activity``) or new (``segment``) form; both ends and times are needed."""
    part = "activity" if kind == "activity" else "activitySegment"
    m = _times(records.filter(F.col("kind") == kind)).withColumn("_a", P.geo_point(f"{part}.start")).withColumn("_b", P.geo_point(f"{part}.end"))
    m = m.filter("_a is not null and _b is not null and start_time is not null and end_time is not null")
    route = P.route_from_waypoints(f"{part}.timelinePath.waypoints") if kind == "segment" else F.lit(None).cast("array<struct<lon:double,lat:double>>")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    facts = {"format": F.lit(kind), "candidate_type": F.col(f"{part}.topCandidate.type"), "candidate_probability": F.col(f"{part}.topCandidate.probability")}
    if kind == "segment":
        facts |= {"edit_status": F.col(f"{part}.editConfirmationStatus"), "parking_event": F.col(f"{part}.parkingEvent"), "has_raw_path": F.col(f"{part}.simplifiedRawPath").isNotNull().cast("string")}
    keep = [c for c in ("subject_id", "file", "seq", "id") if c in records.columns]
    return m.select(
        *keep, "start_time", "end_time", "duration_minutes", "local_start_ts", "local_end_ts",
        F.col("_a.lat").alias("start_lat"), F.col("_a.lon").alias("start_lon"), F.col("_b.lat").alias("end_lat"), F.col("_b.lon").alias("end_lon"),
        P.normalize_activity(f"{part}.topCandidate.type").alias("activity_type"), number(f"{part}.topCandidate.probability").alias("confidence"), number(f"{part}.distanceMeters").alias("distance_meters"),
        F.lit("phone").alias("source"), F.lit("activity").alias("movement_type"), route.alias("route"), _metadata(facts),
    )


def movements_from_breadcrumbs(records: DataFrame) -> DataFrame:
    """Trails of at least two points whose first and last can be parsed."""
    m = _times(records.filter("kind = 'breadcrumb'")).filter(F.size("timelinePath") >= 2)
    m = m.withColumn("_a", P.geo_point(F.element_at("timelinePath", 1)["point"])).withColumn("_b", P.geo_point(F.element_at("timelinePath", -1)["point"]))
    m = m.filter("_a is not null and _b is not null and start_time is not null and end_time is not null")
    keep = [c for c in ("subject_id", "file", "seq", "id") if c in records.columns]
    return m.select(
        *keep, "startTime", "start_time", "end_time", "duration_minutes", "local_start_ts", "local_end_ts",
        F.col("_a.lat").alias("start_lat"), F.col("_a.lon").alias("start_lon"), F.col("_b.lat").alias("end_lat"), F.col("_b.lon").alias("end_lon"),
        F.lit("phone").alias("source"), F.lit("breadcrumb_trail").alias("movement_type"), P.points_of_path("timelinePath").alias("route"), F.size("timelinePath").alias("waypoint_count"),
        _metadata({"format": F.lit("breadcrumb"), "waypoint_count": F.size("timelinePath").cast("string")}),
    )


def movements_from_tracker(items: DataFrame) -> DataFrame:
    """Tracker activities with at least one placed sample; one point gives no route."""
    m = items.filter("not coalesce(isVisit, false)").withColumn("_p", P.sample_points("samples")).filter(F.size("_p") >= 1)
    m = m.withColumn("start_time", P.utc_instant(F.coalesce("startTime", "startDate"))).withColumn("end_time", P.utc_instant(F.coalesce("endTime", "endDate")))
    m = m.filter("start_time is not null and end_time is not null").withColumn("duration_minutes", P.duration_minutes("start_time", "end_time"))
    first, last = F.element_at("_p", 1), F.element_at("_p", -1)
    keep = [c for c in ("subject_id", "file", "seq", "id") if c in items.columns]
    return m.select(
        *keep, "start_time", "end_time", "duration_minutes", P.tracker_local_clock("start_time", "samples").alias("local_start_ts"), P.tracker_local_clock("end_time", "samples").alias("local_end_ts"),
        first["lat"].alias("start_lat"), first["lon"].alias("start_lon"), last["lat"].alias("end_lat"), last["lon"].alias("end_lon"),
        P.map_activity("activityType").alias("activity_type"), F.col("activityTypeConfidenceScore").alias("confidence"), F.lit("tracker").alias("source"), F.lit("activity").alias("movement_type"),
        F.when(F.size("_p") >= 2, F.col("_p")).alias("route"), F.size("samples").alias("sample_count"),
        _metadata({
            "format": F.lit("tracker"), "item_id": F.col("itemId"), "tracker_activity": F.col("activityType"), "manual_activity": F.col("manualActivityType"),
            "uncertain_activity": F.col("uncertainActivityType"), "sample_count": F.size("samples").cast("string"),
        }),
    )


def borrow_offset(trails: DataFrame, offsets: DataFrame, by: list[str], parts: DataFrame | None = None) -> DataFrame:
    """Trails with ``offset_minutes`` of the record nearest in time that writes its offset out."""
    return nearest_record(trails, offsets, "start_time", "at", "offset_minutes", by, parts)


def written_offsets(records: DataFrame) -> DataFrame:
    """(subject_id, at, offset_minutes) of every record whose start is written with its offset."""
    o = records.select("subject_id", P.utc_instant("startTime").alias("at"), P.explicit_offset_minutes("startTime").alias("offset_minutes"))
    return o.filter("at is not null and offset_minutes is not null")


def with_local_clocks(trails: DataFrame, offsets: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Trails written in UTC ('Z') with both local clocks at the offset borrowed for their start."""
    t = borrow_offset(trails, offsets, ["subject_id"], time_slices(offsets, "at", slice_rows))
    shift = F.when(F.endswith("startTime", F.lit("Z")), F.col("offset_minutes"))
    for name, at in (("local_start_ts", "start_time"), ("local_end_ts", "end_time")):
        t = t.withColumn(name, F.coalesce(P.shifted(F.col(at), shift), F.col(name)))
    return t.drop("offset_minutes")


def tracker_labels(items: DataFrame) -> DataFrame:
    """Names of tracker visits for ``label_places``: the place's name, else the street address; a centre is needed."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    order = F.struct("file", "seq") if "file" in items.columns else F.col("seq")
    l = items.filter("coalesce(isVisit, false)").select(
        "subject_id", P.utc_instant("startDate").alias("label_start"), P.utc_instant("endDate").alias("label_end"), F.coalesce(blank("place.name"), blank("streetAddress")).alias("label"),
        F.col("center.latitude").alias("label_lat"), F.col("center.longitude").alias("label_lon"), order.alias("seq"),
    )
    return l.filter("label is not null and label_lat is not null and label_lon is not null and label_start is not null and label_end is not null")


def file_order(df: DataFrame) -> list[str]:
    """The columns that tell the order of records: the file and the place in it, as far as they are there."""
    return [c for c in ("file", "seq", "id") if c in df.columns]


def first_of_equal(df: DataFrame, *key: str | Column) -> DataFrame:
    """Of rows with equal keys (nulls equal) the first in file order."""
    w = Window.partitionBy(*key).orderBy(*file_order(df))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def dedupe_visits(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New visits not stored yet; of equal ones (times and six-decimal point) the first in file order."""
    keyed = lambda df: df.withColumn("_lat", F.round("lat", 6)).withColumn("_lon", F.round("lon", 6))
    key = ["subject_id", "start_time", "end_time", "_lat", "_lon"]
    n = keyed(new)
    if stored is not None:
        n = n.join(shuffled(keyed(stored.filter("visit_type = 'timeline'")).select(*key)), key, "left_anti")
    return first_of_equal(n, *key).drop("_lat", "_lon")


#: What tells movements apart: a record that comes again, in another file or place, is the same one.
MOVEMENT_KEY = ("subject_id", "source", "movement_type", "start_time", "end_time", "start_lat", "start_lon", "end_lat", "end_lon")


def movement_key() -> list[Column]:
    """The natural key of a movement, points to six decimals."""
    return [F.round(c, 6) if c.endswith(("lat", "lon")) else F.col(c) for c in MOVEMENT_KEY]


def dedupe_movements(new: DataFrame) -> DataFrame:
    """Of movements with equal natural keys the first in file order."""
    return first_of_equal(new, *movement_key())


def _cutoff(stored: DataFrame, source: str, days: int) -> DataFrame:
    return stored.filter(F.col("source") == source).groupBy("subject_id").agg(F.timestamp_add("DAY", F.lit(-days), F.max("end_time")).alias("_cut"))


def _since(new: DataFrame, cutoff: DataFrame) -> DataFrame:
    return new.join(cutoff, "subject_id", "left").filter(F.col("_cut").isNull() | (F.col("end_time") > F.col("_cut"))).drop("_cut")


def revision(stored: DataFrame, new: DataFrame, source: str, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(stored rows that go, new rows that come) where the last days of ``source`` are replaced, as in ``merge_revision_window``."""
    cutoff = _cutoff(stored, source, days)
    going = stored.filter(F.col("source") == source).join(cutoff, "subject_id").filter(F.col("end_time") > F.col("_cut")).drop("_cut")
    return going, _since(new, cutoff)


def revision_kept(stored: DataFrame, going: DataFrame) -> DataFrame:
    """Stored rows without those that go."""
    key = ["subject_id", "id", "source", "start_time", "end_time"]
    return stored.join(shuffled(going.select(*key)), key, "left_anti")


def merge_revision_window(stored: DataFrame, new: DataFrame, source: str, days: int = 7, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Stored movements with the last days of ``source`` replaced by the new ones.

    A subject's cutoff is its latest stored end less the window: later stored rows of the source
    go, later new rows come, earlier new rows are ignored. Subjects without stored rows take all.
    ``prepare`` is applied to the new rows that come.
    """
    cutoff = _cutoff(stored, source, days)
    old = stored.join(cutoff, "subject_id", "left").filter((F.col("source") != source) | F.col("_cut").isNull() | (F.col("end_time") <= F.col("_cut"))).drop("_cut")
    return old.unionByName(prepare(_since(new, cutoff)).select(*old.columns))


def import_once(stored: DataFrame, new: DataFrame, source: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Stored rows, and new ones of subjects that have none of ``source`` stored."""
    have = stored.filter(F.col("source") == source).select("subject_id").distinct()
    return stored.unionByName(prepare(new.join(have, "subject_id", "left_anti")).select(*stored.columns))


def force_reload(stored: DataFrame, new: DataFrame, source: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Stored rows with all of ``source`` replaced."""
    return stored.filter(F.col("source") != source).unionByName(prepare(new).select(*stored.columns))


def link_visits(movements: DataFrame, visits: DataFrame, minutes: int = 5, metres: float = 500.0) -> DataFrame:
    """Movements with the visit each leaves and the visit each reaches.

    A candidate's end (start) is within the minutes of the movement's start (end) and within the
    metres; the nearest in time is taken, then in space, then the lowest id.
    """
    def best(t: str, lat: str, lon: str, v_t: str, name: str) -> DataFrame:
        m = movements.select("subject_id", F.col("id").alias("_m"), F.col(t).alias("_t"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
        v = visits.select("subject_id", F.col("id").alias("_v"), F.col(v_t).alias("_vt"), "lat", "lon")
        c = near_in_time(m, v, "_t", "_vt", ["subject_id"], minutes * MINUTE, (("_lat", "_lon"), ("lat", "lon"), metres)).withColumn("_d", distance_m("_lat", "_lon", "lat", "lon")).filter(F.col("_d") <= metres)
        rank = F.struct(F.abs(between_micros("_t", "_vt")).alias("g"), F.col("_d"), F.col("_v"))
        return c.groupBy("subject_id", F.col("_m").alias("id")).agg(F.min_by("_v", rank).alias(name))

    out = movements.join(shuffled(best("start_time", "start_lat", "start_lon", "end_time", "preceding_visit_id")), ["subject_id", "id"], "left")
    return out.join(shuffled(best("end_time", "end_lat", "end_lon", "start_time", "following_visit_id")), ["subject_id", "id"], "left")


def route_length(movements: DataFrame, model: str = "spheroid") -> DataFrame:
    """Fills a missing distance by the route's length: of breadcrumb trails, and of all tracker rows."""
    due = F.col("distance_meters").isNull() & F.col("route").isNotNull() & ((F.col("movement_type") == "breadcrumb_trail") | (F.col("source") == "tracker"))
    return movements.withColumn("distance_meters", F.when(due, path_length_m(F.col("route"), model)).otherwise(F.col("distance_meters")))


def label_places(visits: DataFrame, labels: DataFrame, metres: float = 250.0) -> DataFrame:
    """Visits named by tracker visits that overlap them in time within the metres; the last label wins.

    ``labels``: subject_id, label_start, label_end, label, label_lat, label_lon, seq.
    """
    v = visits.select("subject_id", F.col("id").alias("_v"), "start_time", "end_time", "lat", "lon")
    hit = overlapping(v, labels, ["subject_id"], ("start_time", "end_time"), ("label_start", "label_end")).filter(distance_m("lat", "lon", "label_lat", "label_lon") <= metres)
    names = hit.groupBy("subject_id", F.col("_v").alias("id")).agg(F.max_by("label", "seq").alias("_label"))
    return visits.join(shuffled(names), ["subject_id", "id"], "left").withColumn("place_name", F.coalesce("_label", "place_name")).drop("_label")

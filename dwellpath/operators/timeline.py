"""Movement lists, day timelines and cell rollups."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions.geo import geohash, in_box, segment_hits_box
from dwellpath.operators.query import MAX_MOVEMENTS, newest, page

MOVEMENT_TYPES = ("activity", "breadcrumb_trail", "gps_track", "inferred")


@dataclass(frozen=True)
class MovementFilter:
    day: date
    activity_type: str | None = None
    movement_type: str | None = None
    source: str | None = None
    min_metres: float | None = None
    max_metres: float | None = None
    box: tuple[float, float, float, float] | None = None

    def __post_init__(self):
        if self.movement_type is not None and self.movement_type not in MOVEMENT_TYPES:
            raise ValueError(f"movement_type must be one of {', '.join(MOVEMENT_TYPES)}")


def on_day(df: DataFrame, day: date) -> DataFrame:
    return df.filter((F.to_date("local_start_ts") <= F.lit(day)) & (F.to_date("local_end_ts") >= F.lit(day)))


def route_in_box(box: tuple[float, float, float, float]) -> Column:
    """Start, end or any leg of the route meets the box."""
    legs = F.zip_with(F.slice("route", F.lit(1), F.size("route") - 1), F.slice("route", F.lit(2), F.size("route") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = F.when(F.size("route") >= 2, F.exists(legs, lambda s: segment_hits_box(s["a"], s["b"], *box))).otherwise(F.lit(False))
    return in_box("start_lat", "start_lon", *box) | in_box("end_lat", "end_lon", *box) | F.coalesce(hit, F.lit(False))


def preferred_source(movements: DataFrame, day: date, priority: tuple[str, str] = ("tracker", "phone")) -> DataFrame:
    """On a day that the first source covers, a subject's movements of the second are left out; others stay."""
    first, second = priority
    d = on_day(movements, day)
    covered = d.filter(F.col("source") == first).select("subject_id").distinct().withColumn("_covered", F.lit(True))
    return d.join(covered, "subject_id", "left").filter((F.col("source") != second) | F.col("_covered").isNull()).drop("_covered")


def list_movements(movements: DataFrame, f: MovementFilter, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A day's movements, newest first: all, or a page of them."""
    m = preferred_source(movements, f.day) if f.source is None else on_day(movements, f.day).filter(F.col("source") == f.source)
    for c, value in (("activity_type", f.activity_type), ("movement_type", f.movement_type)):
        if value is not None:
            m = m.filter(F.col(c) == value)
    if f.min_metres is not None:
        m = m.filter(F.col("distance_meters") >= f.min_metres)
    if f.max_metres is not None:
        m = m.filter(F.col("distance_meters") <= f.max_metres)
    m = m if f.box is None else m.filter(route_in_box(f.box))
    return m.orderBy(*newest()) if limit is None else page(m, newest(), limit, offset, MAX_MOVEMENTS)


def movements_by_trip(movements: DataFrame, trip_visits: DataFrame) -> DataFrame:
    """(trip_id, movement id) where the visit before or after the movement belongs to the trip."""
    ends = movements.select("subject_id", "id", F.explode(F.array("preceding_visit_id", "following_visit_id")).alias("visit_id")).filter("visit_id is not null")
    return ends.join(trip_visits, ["subject_id", "visit_id"]).select("trip_id", "id").distinct()


def route_geojson(route: Column) -> Column:
    shape = F.struct(F.lit("LineString").alias("type"), F.transform(route, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return F.when(route.isNotNull(), F.to_json(shape))


def movement_detail(movements: DataFrame) -> DataFrame:
    """Movements with km, km/h and their route as GeoJSON."""
    metres, minutes = F.nullif(F.col("distance_meters"), F.lit(0.0)), F.nullif(F.col("duration_minutes"), F.lit(0))
    return movements.withColumn("km", F.bround(F.col("distance_meters") / 1000, 2)).withColumn("kmh", F.bround(metres / minutes * 60 / 1000, 1)).withColumn("geojson", route_geojson(F.col("route")))


def day_timeline(visits: DataFrame, movements: DataFrame, day: date) -> DataFrame:
    """A day's visits and movements in local order, each with the point where the next item begins."""
    v = on_day(visits, day).select("subject_id", F.lit("visit").alias("kind"), "id", "local_start_ts", "lat", "lon", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    last = F.when(F.size("route") >= 1, F.element_at("route", -1))
    m = on_day(movements, day).select(
        "subject_id", F.lit("movement").alias("kind"), "id", "local_start_ts", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"),
        F.coalesce(last["lat"], F.col("end_lat")).alias("to_lat"), F.coalesce(last["lon"], F.col("end_lon")).alias("to_lon"),
    )
    w = Window.partitionBy("subject_id").orderBy("local_start_ts", "kind", "id")
    return v.unionByName(m).withColumn("place", F.row_number().over(w)).withColumn("next_lat", F.lead("lat").over(w)).withColumn("next_lon", F.lead("lon").over(w))


def geohash_rollup(visits: DataFrame, precision: int = 10) -> DataFrame:
    return visits.groupBy(geohash("lat", "lon", precision).alias("geohash")).agg(F.count(F.lit(1)).alias("n_visits"), F.sum("duration_minutes").alias("minutes"))

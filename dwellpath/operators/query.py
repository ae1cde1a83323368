"""Filters and lookups over visits, locations and trips."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions.geo import distance_m, in_box, radius_box, radius_extent, z_ranges
from dwellpath.functions.names import format_full, some
from dwellpath.sources.store import Store

MAX_VISITS, MAX_LISTED, MAX_MOVEMENTS = 50_000, 1_000, 10_000


@dataclass(frozen=True)
class VisitFilter:
    """Conditions on visits; ``day`` overrides the range. Bounds are dates (local) or datetimes (UTC), each by its own type."""

    day: date | None = None
    box: tuple[float, float, float, float] | None = None  # south, west, north, east
    near: tuple[float, float, float] | None = None  # lat, lon, km
    start: date | datetime | None = None
    end: date | datetime | None = None
    location_id: str | None = None
    trip_id: str | None = None

    def __post_init__(self):
        if self.box is not None and (self.box[0] > self.box[2] or self.box[1] > self.box[3]):
            raise ValueError("a box is south, west, north, east")
        if self.near is not None and self.near[2] < 0:
            raise ValueError("a radius is not negative")

    def conditions(self) -> list[Column]:
        out = []
        local = lambda c: F.to_date(F.col(c))
        if self.day is not None:
            out += [local("local_start_ts") <= F.lit(self.day), local("local_end_ts") >= F.lit(self.day)]
        else:
            for bound, local_test, instant_test in (
                (self.start, lambda b: local("local_end_ts") >= b, lambda b: F.col("start_time") >= b),
                (self.end, lambda b: local("local_start_ts") <= b, lambda b: F.col("end_time") <= b),
            ):
                if isinstance(bound, datetime):
                    out.append(instant_test(F.lit(bound.isoformat(" ")).cast("timestamp_ntz")))
                elif bound is not None:
                    out.append(local_test(F.lit(bound)))
        if self.box is not None:
            out.append(in_box("lat", "lon", *self.box))
        if self.near is not None:
            out.append(within_km(*self.near))
        if self.location_id:
            out.append(F.col("location_id") == self.location_id)
        return out

    def key_ranges(self) -> list[Column]:
        """Conditions on ``z_key`` that hold wherever those on place do: for tables laid out by it."""
        boxes = [b for b in (self.box, self.near and radius_extent(*self.near)) if b]
        return [F.expr(" or ".join(f"z_key between {a} and {z}" for a, z in z_ranges(*b))) for b in boxes]


def within_km(lat: float, lon: float, km: float) -> Column:
    """At most ``km`` away on the spheroid; the box can be pushed to the scan."""
    return radius_box("lat", "lon", lat, lon, km) & (distance_m("lat", "lon", lat, lon) <= km * 1000)


def apply_filter(visits: DataFrame, f: VisitFilter, trip_visits: DataFrame | None = None) -> DataFrame:
    for c in [*f.conditions(), *(f.key_ranges() if "z_key" in visits.columns else [])]:
        visits = visits.filter(c)
    if f.trip_id is not None:
        if trip_visits is None:
            raise ValueError("a trip filter needs the bridge of trips and visits")
        ids = trip_visits.filter(F.col("trip_id") == f.trip_id).select("subject_id", F.col("visit_id").alias("id"))
        visits = visits.join(ids, ["subject_id", "id"])
    return visits


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = MAX_VISITS) -> DataFrame:
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def newest_after(store: Store, limit: int, after: tuple[datetime, int] | None = None, f: VisitFilter = VisitFilter()) -> DataFrame:
    """The page of the newest stored visits that follows a row (start_time, id), or the first.

    Months are read from that row's back until they hold a page, so a late page reads as little as
    an early one and nothing is sorted but what is on it or ties with it.
    """
    if not 1 <= limit <= MAX_VISITS:
        raise ValueError(f"limit must be 1 to {MAX_VISITS}")
    months = sorted({p[0] for p in store.partitions() if after is None or p[0] <= after[0].strftime("%Y-%m")}, reverse=True)
    step, found = 1, store.read(lambda p: False)
    while months and found is not None:
        own, months, step = months[:step], months[step:], step * 2
        rows = apply_filter(store.read(lambda p: p[0] in own), f)  # noqa: B023
        if after is not None:
            at = F.lit(after[0].isoformat(" ")).cast("timestamp_ntz")
            rows = rows.filter((F.col("start_time") < at) | ((F.col("start_time") == at) & (F.col("id") < after[1])))
        found = found.unionByName(rows)
        if not months or found.select("id").limit(limit).count() == limit:
            break
    return found.orderBy(*newest()).limit(limit)


def newest() -> list[Column]:
    return [F.col("start_time").desc(), F.col("id").desc()]


def _with_places(visits: DataFrame, locations: DataFrame) -> DataFrame:
    return visits.join(locations.select("location_id", "city", "county", "state", "country"), "location_id", "left")


def list_visits(visits: DataFrame, locations: DataFrame, f: VisitFilter = VisitFilter(), trip_visits: DataFrame | None = None) -> DataFrame:
    v = _with_places(apply_filter(visits, f, trip_visits), locations)
    return v.withColumn("location_name", F.coalesce(some("place_name"), format_full()))


def spots(visits: DataFrame, n: int | None = None) -> DataFrame:
    """Visits that share a coordinate to six decimals: all in no order, or the ``n`` most visited first."""
    by_name = visits.groupBy(F.round("lat", 6).alias("lat6"), F.round("lon", 6).alias("lon6"), "place_name").agg(
        F.count(F.lit(1)).alias("k"), F.sum("duration_minutes").alias("m"), F.min("start_time").alias("a"), F.max("end_time").alias("z"), F.max(F.to_date("local_start_ts")).alias("d"), F.max("location_id").alias("l")
    )
    # the name given most often, of equals the first; counted by name before, so a coordinate of many names needs no memory for them
    often = F.when(F.col("place_name").isNotNull(), F.struct((-F.col("k")).alias("k"), "place_name"))
    g = by_name.groupBy("lat6", "lon6").agg(
        F.sum("k").alias("n_visits"), F.sum("m").alias("minutes"), F.min("a").alias("first_visit"), F.max("z").alias("last_visit"), F.max("d").alias("last_day"), F.max("l").alias("location_id"), F.min(often)["place_name"].alias("place_name")
    )
    return g if n is None else page(g, [F.col("n_visits").desc(), F.col("lat6"), F.col("lon6")], n)


def day_spots(visits: DataFrame, day: date) -> DataFrame:
    """A day's visits by coordinate, named by the first of them that has a name."""
    v = apply_filter(visits, VisitFilter(day=day))
    named = F.when(F.col("place_name").isNotNull(), F.struct("start_time", "id"))
    return v.groupBy(F.round("lat", 6).alias("lat6"), F.round("lon", 6).alias("lon6")).agg(
        F.count(F.lit(1)).alias("n_visits"), F.sum("duration_minutes").alias("minutes"), F.max(F.to_date("local_start_ts")).alias("last_day"), F.min_by("place_name", named).alias("place_name")
    )


def nearby(visits: DataFrame, locations: DataFrame, lat: float, lon: float, km: float = 1.0, n: int = 50) -> DataFrame:
    v = visits.filter(within_km(lat, lon, km)).withColumn("km", distance_m("lat", "lon", lat, lon) / 1000)
    return _with_places(v.orderBy(*newest()).limit(n), locations)


def when_at(visits: DataFrame, lat: float, lon: float, km: float = 0.1) -> DataFrame:
    """All visits within ``km``, oldest first."""
    return visits.filter(within_km(lat, lon, km)).withColumn("km", distance_m("lat", "lon", lat, lon) / 1000).orderBy("start_time", "id")


def top_places(visits: DataFrame, locations: DataFrame, n: int = 10) -> DataFrame:
    by_location = visits.filter(F.col("location_id").isNotNull()).groupBy("location_id").agg(F.count(F.lit(1)).alias("k"), F.sum("duration_minutes").alias("m"))
    j = by_location.join(locations.filter("city is not null"), "location_id")
    g = j.groupBy("city", "state", "country").agg(F.sum("k").alias("n_visits"), (F.sum("m") / 60).alias("hours"))
    return g.orderBy(F.col("n_visits").desc(), "city", "state", "country").limit(n)


def city_visits(visits: DataFrame, locations: DataFrame, city: str, n: int = 100) -> DataFrame:
    """The newest visits to a city, any case, and the hours of those listed."""
    where = locations.filter(F.lower("city") == city.lower()).select("location_id", "city", "country")
    v = visits.join(where, "location_id").orderBy(*newest()).limit(n)
    # the listed visits alone, at most n
    return v.withColumn("hours", F.sum("duration_minutes").over(Window.partitionBy()) / 60)


def list_locations(locations: DataFrame, visits: DataFrame, country=None, state=None, city=None, admin_level=None, limit: int = 100, offset: int = 0) -> DataFrame:
    for name, value in (("country", country), ("state", state), ("city", city), ("admin_level", admin_level)):
        if value:
            locations = locations.filter(F.col(name) == value)
    counts = visits.filter(F.col("location_id").isNotNull()).groupBy("location_id").agg(F.count(F.lit(1)).alias("n"))
    l = locations.join(counts, "location_id", "left").withColumn("n_visits", F.coalesce("n", F.lit(0))).drop("n")
    order = [F.col("admin_level").desc(), *[F.col(c).asc_nulls_last() for c in ("city", "state", "country")], F.col("location_id")]
    return page(l, order, limit, offset, MAX_LISTED)


def list_trips(trips: DataFrame, cities: DataFrame, year: int | None = None, n: int = 50) -> DataFrame:
    """One year's trips in order, or the newest; whole days and the first three cities."""
    t = trips.join(cities, "trip_id", "left")
    order = [F.col("start_time").asc(), F.col("trip_id").asc()]
    if year is None:
        order = [F.col("start_time").desc(), F.col("trip_id").desc()]
    else:
        t = t.filter(F.year("start_time") == year)
    more = F.size("cities") - 3
    label = F.concat(F.array_join(F.slice("cities", 1, 3), ", "), F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise(F.lit("")))
    t = t.withColumn("days", F.floor(F.col("hours") / 24)).withColumn("city_list", F.coalesce(label, F.lit("")))
    return t.orderBy(*order) if year is not None else t.orderBy(*order).limit(n)


def trip_details(trips: DataFrame, trip_visits: DataFrame, trip_id: str | None = None) -> DataFrame:
    """Trips with their number of visits, one trip or all."""
    t = trips if trip_id is None else trips.filter(F.col("trip_id") == trip_id)
    return t.join(trip_visits.groupBy("trip_id").agg(F.count(F.lit(1)).alias("visit_count")), "trip_id", "left").withColumn("visit_count", F.coalesce("visit_count", F.lit(0)))


def trips_in_range(trips: DataFrame, start: date | datetime | None, end: date | datetime | None, category: str | None = None) -> DataFrame:
    """Trips that overlap the range; the start's type decides whether local days or instants count."""
    t = trips if category is None else trips.filter(F.col("category") == category)
    lead = start if start is not None else end
    if isinstance(lead, datetime):
        at = lambda b: F.lit(b.isoformat(" ")).cast("timestamp_ntz")
        t = t if end is None else t.filter(F.col("start_time") < at(end))
        return t if start is None else t.filter(F.col("end_time") > at(start))
    t = t if end is None else t.filter(F.to_date("local_start_ts") <= F.lit(end))
    return t if start is None else t.filter(F.to_date("local_end_ts") >= F.lit(start))


def trip_detail(trips: DataFrame, trip_visits: DataFrame, visits: DataFrame, names: DataFrame) -> DataFrame:
    """Trips' visits under the trip's name: display name, else cities, else the primary location.

    ``names``: trip_id, display_name, cities and primary_name, each of which may be null.
    """
    v = visits.select("subject_id", F.col("id").alias("visit_id"), F.col("start_time").alias("visit_start"), "duration_minutes", "place_name")
    t = trips.select("trip_id", "category").join(names, "trip_id", "left").withColumn("name", F.coalesce(some("display_name"), some(F.array_join("cities", ", ")), "primary_name"))
    return trip_visits.join(t.select("trip_id", "category", "name"), "trip_id").join(v, ["subject_id", "visit_id"])


def visit_table(visits: DataFrame, column: str, ascending: bool = True, n: int = MAX_LISTED) -> DataFrame:
    """Sorted by any column, nulls last both ways."""
    c = F.col(column)
    return visits.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), "subject_id", "id").limit(n)


def visits_around(visits: DataFrame, day: date, days: int | None) -> DataFrame:
    """Visits within ``days`` of a day, or in its calendar year (None)."""
    from datetime import timedelta

    if days is None:
        return apply_filter(visits, VisitFilter(start=date(day.year, 1, 1), end=date(day.year, 12, 31)))
    return apply_filter(visits, VisitFilter(start=day - timedelta(days=days), end=day + timedelta(days=days)))


def visits_trailing(visits: DataFrame, as_of: date, days: int = 0, months: int = 0, years: int = 0) -> DataFrame:
    start = F.date_sub(F.add_months(F.lit(as_of), -(months + 12 * years)), days)
    return visits.filter((F.to_date("local_end_ts") >= start) & (F.to_date("local_start_ts") <= F.lit(as_of)))

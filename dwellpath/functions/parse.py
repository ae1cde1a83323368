"""Parsing of exported values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = r"([+-])(\d{2}):?(\d{2})$"
#: Tracker activity names with another usual name.
TRACKER_ACTIVITIES = {
    "airplane": "FLYING",
    "boat": "BOATING",
    "bus": "IN_BUS",
    "car": "IN_PASSENGER_VEHICLE",
    "motorcycle": "MOTORCYCLING",
    "train": "IN_TRAIN",
    "tram": "IN_TRAM",
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def local_clock(c) -> Column:
    """Wall-clock time at the string's own offset."""
    return F.regexp_replace(_c(c), r"(?:Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")


def explicit_offset_minutes(c) -> Column:
    """Minutes of an offset written out; null for Z and for none."""
    part = lambda k: F.regexp_extract(_c(c), OFFSET, k)
    minutes = part(2).try_cast("int") * 60 + part(3).try_cast("int")
    return F.when(part(1) == "-", -minutes).when(part(1) == "+", minutes)


def shifted(t: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, t)


def utc_instant(c) -> Column:
    """UTC time; a string without an offset counts as UTC."""
    return shifted(local_clock(c), -F.coalesce(explicit_offset_minutes(c), F.lit(0)))


def geo_point(c) -> Column:
    """Struct (lat, lon) of 'geo:lat,lon'; null for anything else."""
    parts = F.split(F.regexp_replace(_c(c), "^geo:", ""), ",")
    lat, lon = F.get(parts, 0).try_cast("double"), F.get(parts, 1).try_cast("double")
    ok = F.startswith(_c(c), F.lit("geo:")) & (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def e7_point(c) -> Column:
    lat, lon = _c(c)["latE7"], _c(c)["lngE7"]
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct((lon / 1e7).alias("lon"), (lat / 1e7).alias("lat")))


def duration_minutes(start, end) -> Column:
    """Whole minutes, half to even, at least one."""
    us = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return F.when(us.isNotNull(), F.greatest(F.lit(1), F.bround(us / 60_000_000.0)).cast("int"))


def normalize_activity(c) -> Column:
    name = F.upper(F.translate(_c(c), " ", "_"))
    return F.when(_c(c).isNull() | (_c(c) == ""), F.lit("UNKNOWN")).otherwise(name)


def map_activity(c) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TRACKER_ACTIVITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(c)), normalize_activity(c))


def points_of_path(path) -> Column:
    """Valid points of a breadcrumb path, in order, as (lon, lat)."""
    p = F.transform(_c(path), lambda x: geo_point(x["point"]))
    return F.transform(F.filter(p, lambda x: x.isNotNull()), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))


def route_from_waypoints(c) -> Column:
    """Route of at least two waypoints and two valid ones; invalid ones dropped."""
    route = F.filter(F.transform(_c(c), e7_point), lambda x: x.isNotNull())
    return F.when((F.size(_c(c)) >= 2) & (F.size(route) >= 2), route)


def sample_points(samples) -> Column:
    """Points (lon, lat) of tracker samples that have a latitude, in order."""
    good = F.filter(_c(samples), lambda s: s["location"]["latitude"].isNotNull())
    return F.transform(good, lambda s: F.struct(s["location"]["longitude"].alias("lon"), s["location"]["latitude"].alias("lat")))


def tracker_local_clock(t, samples) -> Column:
    """Local time by the first sample that carries its offset in seconds; else UTC."""
    known = F.filter(_c(samples), lambda s: s["secondsFromGMT"].isNotNull())
    return F.timestamp_add("SECOND", F.coalesce(F.get(known, 0)["secondsFromGMT"], F.lit(0)), _c(t))

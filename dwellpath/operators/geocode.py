"""Reverse geocoding: unique coordinates, point-in-polygon by grid cells, hierarchy, locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions.geo import area_centroid
from dwellpath.operators.cells import boundary_cells, cell_holds, cell_keys

LEVELS = ((8, "city"), (6, "county"), (4, "state"), (2, "country"))


def admin_boundaries(relations: DataFrame, levels=(2, 4, 6, 8)) -> DataFrame:
    """Administrative relations of the wanted levels, tags projected."""
    level = F.expr("try_cast(tags['admin_level'] as int)")
    r = relations.withColumn("level", level).filter((F.col("tags")["boundary"] == "administrative") & F.col("level").isin(*levels))
    tag = lambda k: F.col("tags")[k]
    return r.select("osm_id", "level", tag("name").alias("name"), tag("name:en").alias("name_en"), F.coalesce(tag("ISO3166-1"), tag("country_code")).alias("country_code"), "polygons")


def with_coordinates(visits: DataFrame) -> DataFrame:
    return visits.withColumn("lat6", F.round("lat", 6)).withColumn("lon6", F.round("lon", 6))


def unique_coords(visits: DataFrame) -> DataFrame:
    """Coordinates, to six decimals, of visits without a location, with their number of visits."""
    v = with_coordinates(visits)
    if "location_id" in v.columns:
        v = v.filter(F.col("location_id").isNull())
    return v.groupBy("lat6", "lon6").agg(F.count(F.lit(1)).alias("n_visits"))


def point_in_boundary(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(lat6, lon6) with each boundary that holds the point strictly inside: osm_id, level, name, name_en.

    Points are joined by grid cell (``operators/cells.py``); names come in at the end, by id.
    """
    p = points.select("lat6", "lon6", F.explode(cell_keys(F.col("lat6"), F.col("lon6"))).alias("_k")).select("lat6", "lon6", "_k.*")
    hits = p.join(boundary_cells(boundaries), ["_size", "_y", "_x"])
    held = cell_holds(F.col("lon6"), F.col("lat6"), *map(F.col, ("east", "south", "odd", "edges")))
    return hits.filter(held).select("lat6", "lon6", "osm_id").join(boundaries.select("osm_id", "level", "name", "name_en"), "osm_id")


def boundary_centroid(boundaries: DataFrame) -> DataFrame:
    c = boundaries.withColumn("_c", area_centroid(F.col("polygons")))
    return c.select("osm_id", "level", F.col("_c.lat").alias("centroid_lat"), F.col("_c.lon").alias("centroid_lon"), F.abs(F.col("_c.area")).alias("area"))


def hierarchy(hits: DataFrame, boundaries: DataFrame) -> DataFrame:
    """One row a point: name, osm id and centroid per level; of several on a level the smallest, then by id.

    Areas and centroids are taken once a boundary.
    """
    h = hits.join(boundary_centroid(boundaries).drop("level"), "osm_id")
    pick = F.struct(F.coalesce("name_en", "name").alias("name"), "osm_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))
    rank = F.struct("area", "osm_id")
    g = h.groupBy("lat6", "lon6").agg(*[F.min_by(F.when(F.col("level") == k, pick), F.when(F.col("level") == k, rank)).alias(c) for k, c in LEVELS])
    cols = [x for _, c in LEVELS for x in (F.col(f"{c}.name").alias(c), F.col(f"{c}.osm_id").alias(f"{c}_osm_id"))]
    level = F.coalesce(*[F.when(F.col(f"{c}.name").isNotNull(), F.lit(k)) for k, c in LEVELS])
    centre = F.coalesce(*[F.when(F.col(f"{c}.name").isNotNull(), F.col(c)) for _, c in LEVELS])
    return g.withColumn("_centre", centre).select("lat6", "lon6", *cols, level.alias("admin_level"), F.col("_centre.lat").alias("centroid_lat"), F.col("_centre.lon").alias("centroid_lon"))


def location_key() -> Column:
    """A digest of the four names; null and empty names differ."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("city", "county", "state", "country")]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def upsert_locations(points: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Locations of points with a country, one for each tuple of names (nulls equal), beside the stored ones."""
    p = points.filter(F.col("country").isNotNull()).withColumn("location_id", location_key())
    w = Window.partitionBy("location_id").orderBy("lat6", "lon6")
    new = p.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "lat6", "lon6")
    if stored is None:
        return new
    return stored.unionByName(new.join(stored.select("location_id"), "location_id", "left_anti"))


def geocode_visits(visits: DataFrame, points: DataFrame) -> DataFrame:
    """Visits with the location of their coordinate; misses keep null and are tried again next time."""
    ids = points.filter(F.col("country").isNotNull()).select("lat6", "lon6", location_key().alias("_loc"))
    v = with_coordinates(visits).join(ids, ["lat6", "lon6"], "left")
    kept = F.coalesce("location_id", "_loc") if "location_id" in visits.columns else F.col("_loc")
    return v.withColumn("location_id", kept).drop("_loc", "lat6", "lon6")


def geocode_summary(visits: DataFrame, locations: DataFrame) -> DataFrame:
    """What is geocoded, and locations by level, as (measure, n)."""
    v = visits.agg(F.count(F.lit(1)).alias("total"), F.count("location_id").alias("geocoded"))
    v = v.selectExpr("stack(3, 'visits', total, 'geocoded', geocoded, 'not geocoded', total - geocoded) as (measure, n)")
    return v.unionByName(locations.groupBy(F.concat(F.lit("level "), F.col("admin_level").cast("string")).alias("measure")).agg(F.count(F.lit(1)).alias("n")))

"""Rollups over visits, movements and trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _km() -> Column:
    return F.coalesce(F.sum("distance_meters") / 1000, F.lit(0.0))


def _hours() -> Column:
    return F.coalesce(F.sum("duration_minutes") / 60, F.lit(0.0))


def stats(visits: DataFrame, trips: DataFrame, locations: DataFrame) -> DataFrame:
    """(kind, name, n, first, last): visits by type, trips by category, locations, the span of visits."""
    none = F.lit(None).cast("timestamp_ntz")
    n = F.count(F.lit(1)).alias("n")
    a = visits.groupBy(F.lit("visits").alias("kind"), F.col("visit_type").alias("name")).agg(n, F.min("start_time").alias("first"), F.max("end_time").alias("last"))
    b = trips.groupBy(F.lit("trips").alias("kind"), F.col("category").alias("name")).agg(n, none.alias("first"), none.alias("last"))
    c = locations.agg(n).select(F.lit("locations").alias("kind"), F.lit(None).cast("string").alias("name"), "n", none.alias("first"), none.alias("last"))
    return a.unionByName(b).unionByName(c)


def year_summary(visits: DataFrame, trips: DataFrame, year: int) -> DataFrame:
    a = visits.filter(F.year("start_time") == year).groupBy(F.lit("visits").alias("kind"), F.col("visit_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    b = trips.filter(F.year("start_time") == year).groupBy(F.lit("trips").alias("kind"), F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def visit_summary(visits: DataFrame) -> DataFrame:
    return visits.groupBy("visit_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("location_id").isNull()).alias("ungeocoded"), F.count("local_start_ts").alias("with_local_day"))


def movement_summary(movements: DataFrame) -> DataFrame:
    """By movement type and, for activities, by activity: count, km, hours, with route."""
    a = movements.withColumn("act", F.when(F.col("movement_type") == "activity", F.col("activity_type")))
    g = a.groupingSets([[F.col("movement_type")], [F.col("act")], []], "movement_type", "act").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), _km().alias("km"), _hours().alias("hours"), F.count("route").alias("with_route")
    )
    level = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "activity").otherwise("total")
    return g.withColumn("level", level).filter("level <> 'activity' or act is not null").select("level", F.coalesce("movement_type", "act").alias("name"), "n", "km", "hours", "with_route")


def link_rates(movements: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    before, after = F.col("preceding_visit_id").isNotNull(), F.col("following_visit_id").isNotNull()
    return movements.groupBy("source").agg(F.count(F.lit(1)).alias("n"), share(before).alias("preceding"), share(after).alias("following"), share(before | after).alias("either"))


def overview(visits: DataFrame, trips: DataFrame, movements: DataFrame, locations: DataFrame) -> DataFrame:
    """One row: four counts, the span of visits, km and hours moved."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    v = visits.agg(F.count(F.lit(1)).alias("visits"), F.min("start_time").alias("first_visit"), F.max("end_time").alias("last_visit"))
    m = movements.agg(F.count(F.lit(1)).alias("movements"), F.bround(_km(), 1).alias("km"), F.bround(_hours(), 1).alias("hours"))
    # each side is a single aggregate row
    return v.crossJoin(one(trips, "trips")).crossJoin(one(locations, "locations")).crossJoin(m)


def movement_stats(movements: DataFrame, by: str | None) -> DataFrame:
    """Counts, km, hours by ``by`` (activity_type, movement_type, source) or overall with the routes' share; activities with their mean confidence to three places."""
    m = movements
    aggs = [F.count(F.lit(1)).alias("n"), _km().alias("km"), _hours().alias("hours")]
    if by is None:
        return m.agg(*aggs, F.count("route").alias("with_route"), F.coalesce(100 * F.count("route") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("route_pct"))
    if by == "activity_type":
        m = m.filter("movement_type = 'activity' and activity_type is not null")
        aggs.append(F.round(F.avg("confidence"), 3).alias("confidence"))
    return m.groupBy(by).agg(*aggs)


def trips_by_year(trips: DataFrame, category: str | None = None) -> DataFrame:
    t = trips if category is None else trips.filter(F.col("category") == category)
    return t.groupBy(F.year("local_start_ts").alias("year"), "category").agg(F.count(F.lit(1)).alias("n_trips"))

"""Registered queries of trip detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellpath.operators import trips as T
from dwellpath.operators.slices import time_slices
from dwellpath.plans import fixtures as X
from dwellpath.plans.sqltext import sql
from dwellpath.sources.scratch import staged

RULES = T.TripRules()
#: A rule set in which short single visits are trips, so that orphans occur.
LOOSE = T.TripRules(min_distance_km=0.0, categories=(("Any", 0.0, None),))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return T.classify_visits(X.visits(spark, d), X.homes(spark, d), X.works(spark, d), RULES)


def cuts(spark: SparkSession, d: str) -> DataFrame | None:
    """Slices of subjects with too many visits for one task."""
    return time_slices(X.visits(spark, d))


def splits(spark: SparkSession, d: str, slices: DataFrame | None = None) -> DataFrame:
    return T.gap_splits(classified(spark, d), X.movements(spark, d), X.homes(spark, d), RULES, slices)


def blocks(spark: SparkSession, d: str) -> DataFrame:
    slices = cuts(spark, d)
    return T.trip_blocks(splits(spark, d, slices), RULES, slices)


def trips(spark: SparkSession, d: str) -> DataFrame:
    return T.detect_trips(X.visits(spark, d), X.homes(spark, d), X.works(spark, d), X.movements(spark, d), RULES)


def visit_sequence(spark, d):
    return T.visit_sequence(X.visits(spark, d), cuts(spark, d)).select("subject_id", "id", F.col("rn").cast("long").alias("rn"))


def classify_visits(spark, d):
    return classified(spark, d).select("subject_id", "id", "at_home", "at_work", "away")


def bridged_gaps(spark, d):
    return T.bridged_gaps(X.visits(spark, d), X.movements(spark, d), cuts=cuts(spark, d))


def gap_splits(spark, d):
    return splits(spark, d, cuts(spark, d)).select("subject_id", "id", "split")


def trip_blocks(spark, d):
    return blocks(spark, d).select("subject_id", "id", F.col("block").cast("long").alias("block"), "departed", "returned")


def trip_bounds(spark, d):
    b = T.trip_bounds(blocks(spark, d))
    return b.select("subject_id", F.col("block").cast("long").alias("block"), "start_time", "end_time", "local_start_ts", "local_end_ts", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "n_visits", F.array_join("visit_ids", ",").alias("visit_ids"))


def trip_distance(spark, d):
    b = T.trip_distance(T.trip_bounds(blocks(spark, d)), X.homes(spark, d), RULES)
    return b.select("subject_id", F.col("block").cast("long").alias("block"), F.round("distance_km", 3).alias("distance_km"))


def trip_categories(spark, d):
    return trips(spark, d).select("trip_id", "subject_id", "start_time", "end_time", "category", F.round("hours", 3).alias("hours"), "n_visits")


def trip_visits(spark, d):
    return T.trip_visits(trips(spark, d))


def dedupe_trips(spark, d):
    """Trips again beside stored ones: every second subject's are stored already."""
    t = staged(trips(spark, d))
    return T.dedupe_trips(t, t.filter("subject_id % 2 = 0")).select("trip_id", "subject_id", "start_time", "end_time", "category")


def trip_summary(spark, d):
    t = staged(trips(spark, d))
    return T.trip_summary(t, T.trip_visits(t), RULES).select("category", "n_trips", "n_visits")


def absorb_orphans(spark, d):
    t = T.detect_trips(X.visits(spark, d), X.homes(spark, d), X.works(spark, d), X.movements(spark, d), LOOSE)
    return T.absorb_orphans(t, LOOSE).select("subject_id", "start_time", "end_time", F.col("n_visits").cast("long").alias("n_visits"), "category", F.round("hours", 3).alias("hours"))


def active_anchor(spark, d):
    v = T.active_anchor(X.visits(spark, d), X.homes(spark, d), F.to_date("start_time"), "home")
    return v.select("subject_id", "id", "home_name", F.round("home_lat", 3).alias("home_lat"))


QUERIES = {
    f.__name__: f
    for f in (visit_sequence, classify_visits, bridged_gaps, gap_splits, trip_blocks, trip_bounds, trip_distance, trip_categories, trip_visits, dedupe_trips, trip_summary, absorb_orphans, active_anchor)
}

ORACLES = {
    "visit_sequence": sql("SELECT subject_id, id, row_number() OVER (PARTITION BY subject_id ORDER BY start_time, id) AS rn FROM visits"),
    "classify_visits": sql("SELECT subject_id, id, at_home, at_work, away FROM classified"),
    "bridged_gaps": sql("SELECT subject_id, id FROM bridges"),
    "gap_splits": sql("SELECT subject_id, id, split FROM splits"),
    "trip_blocks": sql("SELECT subject_id, id, CAST(block AS BIGINT) AS block, departed, returned FROM blocks"),
    "trip_bounds": sql("SELECT subject_id, block, start_time, end_time, local_start_ts, local_end_ts, round(lat, 3) AS lat, round(lon, 3) AS lon, n_visits, array_to_string(visit_ids, ',') AS visit_ids FROM bounds"),
    "trip_distance": sql("SELECT subject_id, block, round(distance_km, 3) AS distance_km FROM far_trips"),
    "trip_categories": sql("SELECT trip_id, subject_id, start_time, end_time, category, round(hours, 3) AS hours, n_visits FROM trip_rows"),
    "trip_visits": sql("SELECT trip_id, subject_id, visit_id FROM bridge"),
    "dedupe_trips": sql("SELECT trip_id, subject_id, start_time, end_time, category FROM trip_rows WHERE subject_id % 2 <> 0"),
    "trip_summary": sql(
        "SELECT category, count(DISTINCT t.trip_id) AS n_trips, count(visit_id) AS n_visits FROM trip_rows t LEFT JOIN bridge b ON t.trip_id = b.trip_id GROUP BY category"
    ),
    "active_anchor": sql("SELECT subject_id, id, home_name, round(home_lat, 3) AS home_lat FROM home_now"),
}

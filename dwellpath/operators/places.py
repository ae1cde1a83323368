"""Home and work places from dwell times."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions.geo import haversine_km


def place_candidates(visits: DataFrame, start: date, end: date, min_hours: float = 100.0, n: int = 20) -> DataFrame:
    """Places with the most hours among visits that lie in the range of days."""
    v = visits.filter(F.col("place_id").isNotNull() & (F.to_date("start_time") >= F.lit(start)) & (F.to_date("end_time") <= F.lit(end)))
    g = v.groupBy("subject_id", "place_id", "lat", "lon", "semantic_type").agg(F.count(F.lit(1)).alias("n_visits"), (F.sum("duration_minutes") / 60).alias("hours"), F.min("start_time").alias("first"), F.max("end_time").alias("last"))
    return g.filter(F.col("hours") >= min_hours).orderBy(F.col("hours").desc(), "subject_id", "place_id", "lat", "lon", "semantic_type").limit(n)


def _months(visits: DataFrame, least: int) -> DataFrame:
    g = visits.groupBy("subject_id", "place_id", F.trunc("start_time", "month").alias("month"), "lat", "lon").agg(F.count(F.lit(1)).alias("n_visits"), F.sum("duration_minutes").alias("minutes"))
    return g.filter(F.col("minutes") > least)


def home_months(visits: DataFrame, works: DataFrame | None = None, min_minutes: int = 5000) -> DataFrame:
    """Months with more than the minutes at a place that is no known work place."""
    v = visits.filter(F.col("place_id").isNotNull())
    if works is not None:
        v = v.join(works.select("place_id").filter("place_id is not null").distinct(), "place_id", "left_anti")
    return _months(v, min_minutes)


def work_months(visits: DataFrame, min_minutes: int = 2000) -> DataFrame:
    return _months(visits.filter("place_id is not null and semantic_type = 'Work'"), min_minutes)


def dwell_periods(months: DataFrame, max_gap: int = 2, min_months: int = 2) -> DataFrame:
    """Islands of a place's months with gaps of at most ``max_gap``; islands of enough rows stay.

    An island's coordinate is that of its first month, where several are the one with most minutes.
    """
    w = Window.partitionBy("subject_id", "place_id").orderBy("month", "lat", "lon")
    number = F.year("month") * 12 + F.month("month")
    m = months.withColumn("_no", number).withColumn("_new", (F.col("_no") - F.lag("_no").over(w) > max_gap).cast("int"))
    m = m.withColumn("island", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    first = F.struct("month", (-F.col("minutes")).alias("most"), "lat", "lon")
    g = m.groupBy("subject_id", "place_id", "island").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count(F.lit(1)).alias("n_rows"), (F.sum("minutes") / 60).alias("hours"), F.min(first).alias("_f"))
    return g.filter(F.col("n_rows") >= min_months).select("subject_id", "place_id", "island", "first_month", "last_month", "n_rows", "hours", F.col("_f.lat").alias("lat"), F.col("_f.lon").alias("lon"))


def period_bounds(periods: DataFrame, visits: DataFrame) -> DataFrame:
    """Periods with the days of the place's first and last visit from the first month to a month after the last begins.

    Visits are summed up by month before they meet the months of periods, so none is copied and
    none meets a period of another time. The day on which the month after begins is kept apart.
    """
    keys = ["subject_id", "place_id"]
    by_month = visits.groupBy(*keys, F.trunc("start_time", "month").alias("_month"), (F.dayofmonth("start_time") == 1).alias("_first_day")).agg(F.min("start_time").alias("_s"), F.max("end_time").alias("_e"))
    after = F.add_months("last_month", 1)
    months = periods.select(*keys, "island", "last_month", F.explode(F.sequence("first_month", after, F.expr("interval 1 month"))).alias("_month"))
    j = months.join(by_month, [*keys, "_month"]).filter((F.col("_month") <= F.col("last_month")) | F.col("_first_day"))
    b = j.groupBy(*keys, "island").agg(F.to_date(F.min("_s")).alias("start_date"), F.to_date(F.max("_e")).alias("end_date"))
    return periods.join(b, [*keys, "island"])


def reconcile_anchors(detected: DataFrame, configured: DataFrame, km: float = 1.0) -> DataFrame:
    """Detected periods with the first configured range that overlaps them within ``km``; null is open."""
    c = configured.select("subject_id", "pos", F.col("name").alias("matched_name"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("start_date").alias("_s"), F.col("end_date").alias("_e"))
    j = detected.join(c, "subject_id").filter("(_s is null or _s <= end_date) and (_e is null or _e >= start_date)").filter(haversine_km("lat", "lon", "_lat", "_lon") < km)
    keys = ["subject_id", "place_id", "island"]
    best = j.groupBy(*keys).agg(F.min_by("matched_name", "pos").alias("matched_name"))
    d = detected.join(best, keys, "left")
    return d.withColumn("status", F.when(F.col("matched_name").isNull(), "new").otherwise("configured"))

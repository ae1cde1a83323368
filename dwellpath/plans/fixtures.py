"""Timeline tables derived from the given tables by integer rules, on Spark and as DuckDB SQL.

The given tables have no coordinates. Each derived table is written twice, so that a query and
its SQL start from the same rows; the rules use integers until the last step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the rules below.
HOME_KM, WORK_KM, MIN_KM, MAX_GAP_H, LONG_GAP_H, LONG_GAP_KM = 20, 1, 80, 8, 24, 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("start_time"))
    w = Window.partitionBy("subject_id").orderBy("start_time", "id")
    e = e.withColumn("nts", F.lead("start_time").over(w))
    e = e.withColumn("d", F.expr("dayofyear(start_time) div 3 + subject_id"))
    short = "timestampadd(MINUTE, cast(10 + (id * 37) % 50 as int), start_time)"
    e = e.withColumn("end_time", F.expr(f"CASE WHEN nts IS NULL OR id % 4 = 0 OR timestampdiff(MICROSECOND, start_time, nts) < 1800000000 THEN {short} ELSE timestampadd(MINUTE, -15, nts) END"))
    e = e.withColumn("lat", F.expr("20 + ((subject_id * 37) % 400) / 10.0D + CASE WHEN d % 9 = 0 THEN 0.5D WHEN d % 3 = 0 THEN ((id * 7) % 13 + 4) * 0.35D ELSE 0D END + 0.0001234D"))
    e = e.withColumn("lon", F.expr("-120 + ((subject_id * 91) % 2400) / 10.0D + 0.0004321D"))
    e = e.withColumn("place_id", F.expr("CASE WHEN d % 3 = 0 THEN concat('p', cast((id * 7) % 13 as string)) ELSE concat('h', cast(subject_id as string)) END"))
    e = e.withColumn("semantic_type", F.expr("CASE WHEN id % 11 = 0 THEN NULL WHEN d % 3 = 0 THEN 'Searched' ELSE 'Home' END"))
    e = e.withColumn("visit_type", F.expr("CASE WHEN id % 10 = 0 THEN 'manual' ELSE 'timeline' END"))
    e = e.withColumn("place_name", F.expr("CASE WHEN id % 5 = 0 THEN concat('name', cast((id * 7) % 13 as string)) END"))
    e = e.withColumn("duration_minutes", F.expr("cast(greatest(1, bround(timestampdiff(MICROSECOND, start_time, end_time) / 60000000.0D)) as int)"))
    e = e.withColumn("off_h", F.expr("cast(((subject_id * 91) % 2400) div 150 - 8 as int)"))
    e = e.withColumn("local_start_ts", F.expr("timestampadd(HOUR, off_h, start_time)")).withColumn("local_end_ts", F.expr("timestampadd(HOUR, off_h, end_time)"))
    return e.drop("nts", "d")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visits(spark, sf_dir)
    w = Window.partitionBy("subject_id").orderBy("start_time", "id")
    for c in ("start_time", "lat", "lon", "id"):
        v = v.withColumn(f"n_{c}", F.lead(c).over(w))
    m = v.filter("id % 3 <> 0 AND timestampdiff(MICROSECOND, end_time, n_start_time) > 180000000")
    m = m.select(
        "subject_id",
        (F.col("id") * 2 + 1).alias("id"),
        F.expr("timestampadd(MINUTE, 1, end_time)").alias("start_time"),
        F.expr("timestampadd(MINUTE, -1, n_start_time)").alias("end_time"),
        F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"), F.col("n_lat").alias("end_lat"), F.col("n_lon").alias("end_lon"),
        F.expr("CASE WHEN id % 5 = 0 THEN 'tracker' ELSE 'phone' END").alias("source"),
        F.expr("CASE WHEN id % 7 = 0 THEN 'breadcrumb_trail' ELSE 'activity' END").alias("movement_type"),
        F.expr("CASE WHEN id % 7 = 0 THEN NULL WHEN id % 2 = 0 THEN 'WALKING' ELSE 'IN_PASSENGER_VEHICLE' END").alias("activity_type"),
        F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 100) / 100.0D END").alias("confidence"),
        F.expr("CASE WHEN id % 7 = 0 THEN NULL ELSE cast((id * 131) % 90000 as double) END").alias("distance_meters"),
        F.expr("CASE WHEN id % 2 = 1 THEN array(named_struct('lon', lon, 'lat', lat), named_struct('lon', lon + 0.05D, 'lat', lat + 0.05D), named_struct('lon', n_lon, 'lat', n_lat)) END").alias("route"),
        F.col("id").alias("prev_visit"), F.col("n_id").alias("next_visit"), "off_h",
    )
    m = m.withColumn("duration_minutes", F.expr("cast(greatest(1, bround(timestampdiff(MICROSECOND, start_time, end_time) / 60000000.0D)) as int)"))
    return m.withColumn("local_start_ts", F.expr("timestampadd(HOUR, off_h, start_time)")).withColumn("local_end_ts", F.expr("timestampadd(HOUR, off_h, end_time)"))


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One open home a subject; every tenth has two ranges that overlap in mid January."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id")).distinct()
    s = s.withColumn("lat", F.expr("20 + ((subject_id * 37) % 400) / 10.0D + 0.0001234D")).withColumn("lon", F.expr("-120 + ((subject_id * 91) % 2400) / 10.0D + 0.0004321D"))
    ranges = F.expr(
        "CASE WHEN subject_id % 10 = 0 THEN array(named_struct('pos', 0, 's', cast(NULL as date), 'e', DATE'2024-01-20'), named_struct('pos', 1, 's', DATE'2024-01-10', 'e', cast(NULL as date)))"
        " ELSE array(named_struct('pos', 0, 's', cast(NULL as date), 'e', cast(NULL as date))) END"
    )
    s = s.withColumn("r", F.explode(ranges))
    return s.select(
        "subject_id", F.col("r.pos").alias("pos"), (F.col("lat") + F.col("r.pos") * 0.3).alias("lat"), "lon",
        F.concat(F.lit("h"), F.col("subject_id").cast("string")).alias("place_id"), F.concat(F.lit("home"), F.col("r.pos").cast("string")).alias("name"),
        F.col("r.s").alias("start_date"), F.col("r.e").alias("end_date"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work place for every third subject, known by its place_id."""
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id")).distinct().filter("subject_id % 3 = 0")
    return s.select(
        "subject_id", F.lit(0).alias("pos"), F.expr("20 + ((subject_id * 37) % 400) / 10.0D + 1.4001234D").alias("lat"), F.expr("-120 + ((subject_id * 91) % 2400) / 10.0D + 0.0004321D").alias("lon"),
        F.lit("p1").alias("place_id"), F.lit("work0").alias("name"), F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
    )


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of four levels over the cells in use: osm_id, level, name, name_en, polygons."""
    p = visits(spark, sf_dir).select("lat", "lon").distinct()
    levels = [(2, 40.0), (4, 10.0), (6, 2.5), (8, 0.5)]
    made = None
    for level, size in levels:
        c = p.select(F.floor((F.col("lat") + 0.0317) / size).alias("iy"), F.floor((F.col("lon") + 0.0271) / size).alias("ix")).distinct()
        if level == 8:
            c = c.filter("abs(iy + ix) % 3 <> 0")
        if level == 2:
            c = c.filter("abs(iy + ix) <> 3")
        c = c.select(F.lit(level).alias("level"), "iy", "ix", F.lit(size).alias("size"))
        made = c if made is None else made.unionByName(c)
    south, west = F.col("iy") * F.col("size") - 0.0317, F.col("ix") * F.col("size") - 0.0271
    pt = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(pt(west, south), pt(west + F.col("size"), south), pt(west + F.col("size"), south + F.col("size")), pt(west, south + F.col("size")), pt(west, south))
    name = F.concat(F.lit("L"), F.col("level").cast("string"), F.lit("_"), F.col("iy").cast("string"), F.lit("_"), F.col("ix").cast("string"))
    return made.select(
        (F.col("level") * 100000000 + (F.col("iy") + 1000) * 10000 + F.col("ix") + 1000).cast("long").alias("osm_id"), "level", name.alias("name"),
        F.when(F.col("iy") % 2 == 0, F.concat(name, F.lit("e"))).alias("name_en"), south.alias("south"), west.alias("west"), (south + F.col("size")).alias("north"), (west + F.col("size")).alias("east"),
        F.array(F.array(ring)).alias("polygons"),
    )


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays over many months, for home and work inference."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("subject_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("start_time"))
    o = o.withColumn("mi", F.expr("year(start_time) * 12 + month(start_time)")).filter("(mi + subject_id) % 17 > 2")
    o = o.withColumn("duration_minutes", F.expr("cast(600 + o_orderkey % 900 as int)"))
    place = "CASE o_orderkey % 4 WHEN 0 THEN concat('x', o_orderkey % 7) WHEN 1 THEN concat('w', subject_id, '-', mi div 11) ELSE concat('h', subject_id, '-', mi div 9) END"
    o = o.withColumn("place_id", F.expr(place)).withColumn("semantic_type", F.expr("CASE WHEN o_orderkey % 4 = 1 THEN 'Work' ELSE 'Home' END"))
    o = o.withColumn("end_time", F.expr("timestampadd(MINUTE, duration_minutes, start_time)"))
    lat = "20 + subject_id + CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 7) * 0.25D WHEN 1 THEN 0.0625D ELSE (mi div 9 % 5) * 0.125D END"
    o = o.withColumn("lat", F.expr(lat)).withColumn("lon", F.expr("cast(10 + subject_id as double)"))
    o = o.withColumn("local_start_ts", F.col("start_time")).withColumn("local_end_ts", F.col("end_time"))
    return o.withColumnRenamed("o_orderkey", "id").drop("mi")


#: The same tables as DuckDB SQL; later ones use earlier ones.
SQL: dict[str, str] = {
    "visits": """
SELECT *, CAST(greatest(1, round_even(date_diff('microsecond', start_time, end_time) / 60000000.0::DOUBLE, 0)) AS INTEGER) AS duration_minutes,
  start_time + to_hours(off_h) AS local_start_ts, end_time + to_hours(off_h) AS local_end_ts
FROM (
  SELECT subject_id, id, start_time,
    CASE WHEN nts IS NULL OR id % 4 = 0 OR date_diff('microsecond', start_time, nts) < 1800000000 THEN start_time + to_minutes(CAST(10 + (id * 37) % 50 AS INTEGER)) ELSE nts - to_minutes(15) END AS end_time,
    20 + ((subject_id * 37) % 400) / 10.0::DOUBLE + CASE WHEN d % 9 = 0 THEN 0.5::DOUBLE WHEN d % 3 = 0 THEN ((id * 7) % 13 + 4) * 0.35::DOUBLE ELSE 0::DOUBLE END + 0.0001234::DOUBLE AS lat,
    -120 + ((subject_id * 91) % 2400) / 10.0::DOUBLE + 0.0004321::DOUBLE AS lon,
    CASE WHEN d % 3 = 0 THEN 'p' || (id * 7) % 13 ELSE 'h' || subject_id END AS place_id,
    CASE WHEN id % 11 = 0 THEN NULL WHEN d % 3 = 0 THEN 'Searched' ELSE 'Home' END AS semantic_type,
    CASE WHEN id % 10 = 0 THEN 'manual' ELSE 'timeline' END AS visit_type,
    CASE WHEN id % 5 = 0 THEN 'name' || (id * 7) % 13 END AS place_name,
    CAST(((subject_id * 91) % 2400) // 150 - 8 AS INTEGER) AS off_h
  FROM (SELECT user_id AS subject_id, event_id AS id, ts AS start_time, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nts, dayofyear(ts) // 3 + user_id AS d FROM events)
)""",
    "movements": """
SELECT *, CAST(greatest(1, round_even(date_diff('microsecond', start_time, end_time) / 60000000.0::DOUBLE, 0)) AS INTEGER) AS duration_minutes,
  start_time + to_hours(off_h) AS local_start_ts, end_time + to_hours(off_h) AS local_end_ts
FROM (
  SELECT subject_id, id * 2 + 1 AS id, end_time + to_minutes(1) AS start_time, ns - to_minutes(1) AS end_time, lat AS start_lat, lon AS start_lon, nlat AS end_lat, nlon AS end_lon,
    CASE WHEN id % 5 = 0 THEN 'tracker' ELSE 'phone' END AS source, CASE WHEN id % 7 = 0 THEN 'breadcrumb_trail' ELSE 'activity' END AS movement_type,
    CASE WHEN id % 7 = 0 THEN NULL WHEN id % 2 = 0 THEN 'WALKING' ELSE 'IN_PASSENGER_VEHICLE' END AS activity_type,
    CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 100) / 100.0::DOUBLE END AS confidence,
    CASE WHEN id % 7 = 0 THEN NULL ELSE CAST((id * 131) % 90000 AS DOUBLE) END AS distance_meters,
    CASE WHEN id % 2 = 1 THEN [{'lon': lon, 'lat': lat}, {'lon': lon + 0.05::DOUBLE, 'lat': lat + 0.05::DOUBLE}, {'lon': nlon, 'lat': nlat}] END AS route,
    id AS prev_visit, nid AS next_visit, off_h
  FROM (SELECT *, lead(start_time) OVER w AS ns, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, lead(id) OVER w AS nid FROM visits WINDOW w AS (PARTITION BY subject_id ORDER BY start_time, id))
  WHERE id % 3 <> 0 AND date_diff('microsecond', end_time, ns) > 180000000
)""",
    "homes": """
SELECT subject_id, r.pos AS pos, 20 + ((subject_id * 37) % 400) / 10.0::DOUBLE + 0.0001234::DOUBLE + r.pos * 0.3::DOUBLE AS lat, -120 + ((subject_id * 91) % 2400) / 10.0::DOUBLE + 0.0004321::DOUBLE AS lon,
  'h' || subject_id AS place_id, 'home' || r.pos AS name, r.s AS start_date, r.e AS end_date
FROM (SELECT subject_id, unnest(CASE WHEN subject_id % 10 = 0 THEN [{'pos': 0, 's': NULL::DATE, 'e': DATE '2024-01-20'}, {'pos': 1, 's': DATE '2024-01-10', 'e': NULL::DATE}] ELSE [{'pos': 0, 's': NULL::DATE, 'e': NULL::DATE}] END) AS r
  FROM (SELECT DISTINCT user_id AS subject_id FROM events))""",
    "works": """
SELECT DISTINCT user_id AS subject_id, 0 AS pos, 20 + ((user_id * 37) % 400) / 10.0::DOUBLE + 1.4001234::DOUBLE AS lat, -120 + ((user_id * 91) % 2400) / 10.0::DOUBLE + 0.0004321::DOUBLE AS lon,
  'p1' AS place_id, 'work0' AS name, NULL::DATE AS start_date, NULL::DATE AS end_date FROM events WHERE user_id % 3 = 0""",
    "boundaries": """
SELECT CAST(level * 100000000 + (iy + 1000) * 10000 + ix + 1000 AS BIGINT) AS osm_id, level, 'L' || level || '_' || iy || '_' || ix AS name,
  CASE WHEN iy % 2 = 0 THEN 'L' || level || '_' || iy || '_' || ix || 'e' END AS name_en,
  iy * size - 0.0317::DOUBLE AS south, ix * size - 0.0271::DOUBLE AS west, iy * size - 0.0317::DOUBLE + size AS north, ix * size - 0.0271::DOUBLE + size AS east
FROM (
  SELECT DISTINCT level, size, CAST(floor((lat + 0.0317::DOUBLE) / size) AS BIGINT) AS iy, CAST(floor((lon + 0.0271::DOUBLE) / size) AS BIGINT) AS ix
  FROM (SELECT DISTINCT lat, lon FROM visits), (VALUES (2, 40.0::DOUBLE), (4, 10.0::DOUBLE), (6, 2.5::DOUBLE), (8, 0.5::DOUBLE)) AS l(level, size)
) WHERE NOT (level = 8 AND abs(iy + ix) % 3 = 0) AND NOT (level = 2 AND abs(iy + ix) = 3)""",
    "stays": """
SELECT id, subject_id, start_time, duration_minutes, place_id, semantic_type, start_time + to_minutes(duration_minutes) AS end_time, lat, lon, start_time AS local_start_ts, start_time + to_minutes(duration_minutes) AS local_end_ts
FROM (
  SELECT o_orderkey AS id, subject_id, start_time, CAST(600 + o_orderkey % 900 AS INTEGER) AS duration_minutes,
    CASE o_orderkey % 4 WHEN 0 THEN 'x' || o_orderkey % 7 WHEN 1 THEN 'w' || subject_id || '-' || mi // 11 ELSE 'h' || subject_id || '-' || mi // 9 END AS place_id,
    CASE WHEN o_orderkey % 4 = 1 THEN 'Work' ELSE 'Home' END AS semantic_type,
    20 + subject_id + CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 7) * 0.25::DOUBLE WHEN 1 THEN 0.0625::DOUBLE ELSE (mi // 9 % 5) * 0.125::DOUBLE END AS lat, CAST(10 + subject_id AS DOUBLE) AS lon
  FROM (SELECT o_orderkey, o_custkey % 20 AS subject_id, o_orderdate AS start_time, year(o_orderdate) * 12 + month(o_orderdate) AS mi FROM orders)
  WHERE (mi + subject_id) % 17 > 2
)""",
}

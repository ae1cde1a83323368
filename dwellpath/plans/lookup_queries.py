"""Registered queries of geocoding, filters, lookups, rollups and timelines, with their SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellpath.functions.names import format_full as full_name
from dwellpath.functions.names import format_short as short_name
from dwellpath.operators import geocode as G
from dwellpath.operators import query as Q
from dwellpath.operators import stats as S
from dwellpath.operators import timeline as L
from dwellpath.operators import trips as T
from dwellpath.plans import fixtures as X
from dwellpath.plans import sqltext
from dwellpath.plans.sqltext import spheroid, sql
from dwellpath.plans.trip_queries import trips as found_trips
from dwellpath.sources.scratch import staged

DAY = date(2024, 1, 17)
BOX = (25.0, -100.0, 45.0, 40.0)
SPOT = (38.9, -14.0, 400.0)
#: The first and last instants of a range.
FROM, TO = datetime(2024, 1, 10, 6, 0), datetime(2024, 1, 20, 18, 0)

sqltext.STEPS.update(
    {
        "points": "SELECT round(lat, 6) AS lat6, round(lon, 6) AS lon6, count(*) AS n_visits FROM visits GROUP BY 1, 2",
        "hits": "SELECT p.lat6, p.lon6, b.* FROM points p JOIN boundaries b ON p.lat6 > b.south AND p.lat6 < b.north AND p.lon6 > b.west AND p.lon6 < b.east",
        "hier": """
SELECT *, CASE WHEN city IS NOT NULL THEN 8 WHEN county IS NOT NULL THEN 6 WHEN state IS NOT NULL THEN 4 ELSE 2 END AS admin_level, coalesce(c8, c6, c4, c2).lat AS centroid_lat, coalesce(c8, c6, c4, c2).lon AS centroid_lon
FROM (SELECT lat6, lon6, """
        + ", ".join(
            f"max(CASE WHEN level = {k} THEN coalesce(name_en, name) END) AS {c}, max(CASE WHEN level = {k} THEN osm_id END) AS {c}_osm_id, max(CASE WHEN level = {k} THEN {{'lat': (south + north) / 2, 'lon': (west + east) / 2}} END) AS c{k}"
            for k, c in G.LEVELS
        )
        + " FROM hits GROUP BY lat6, lon6)",
        "keyed": "SELECT *, substr(md5(concat_ws('|', coalesce('=' || city, '-'), coalesce('=' || county, '-'), coalesce('=' || state, '-'), coalesce('=' || country, '-'))), 1, 16) AS location_id FROM hier WHERE country IS NOT NULL",
        "locs": "SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY lat6, lon6) = 1",
        "gvisits": "SELECT v.*, k.location_id FROM visits v LEFT JOIN keyed k ON round(v.lat, 6) = k.lat6 AND round(v.lon, 6) = k.lon6",
        "tlocated": "SELECT b.trip_id, g.id, g.start_time, g.location_id, l.city, l.county, l.state, l.country FROM bridge b JOIN gvisits g ON b.subject_id = g.subject_id AND b.visit_id = g.id LEFT JOIN locs l ON g.location_id = l.location_id",
        "tcities": "SELECT trip_id, coalesce(list_sort(list(DISTINCT city) FILTER (WHERE city IS NOT NULL)), []) AS cities FROM tlocated GROUP BY trip_id",
        "tnames": """
SELECT trip_id, CASE WHEN len(ci) = 1 THEN ci[1] WHEN len(co) = 1 AND len(ci) <= 3 THEN co[1] WHEN len(st) = 1 THEN st[1] WHEN len(cn) = 1 THEN cn[1] WHEN len(cn) = 0 THEN 'Unknown Location' WHEN len(cn) <= 3 THEN array_to_string(cn, ', ') ELSE len(cn) || ' Countries' END AS display_name
FROM (SELECT trip_id, """
        + ", ".join(f"coalesce(list_sort(list(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL)), []) AS {a}" for c, a in (("city", "ci"), ("county", "co"), ("state", "st"), ("country", "cn")))
        + " FROM tlocated GROUP BY trip_id)",
        "tprimary": "SELECT trip_id, location_id AS primary_location_id FROM (SELECT trip_id, location_id, count(*) AS n, min(start_time) AS s, min(id) AS i FROM tlocated WHERE location_id IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY n DESC, s, i) = 1",
        "dayv": f"SELECT * FROM gvisits WHERE CAST(local_start_ts AS DATE) <= DATE '{DAY}' AND CAST(local_end_ts AS DATE) >= DATE '{DAY}'",
        "daym": f"SELECT * FROM movements WHERE CAST(local_start_ts AS DATE) <= DATE '{DAY}' AND CAST(local_end_ts AS DATE) >= DATE '{DAY}'",
        "mlinked": "SELECT *, CASE WHEN id % 8 <> 1 THEN prev_visit END AS preceding_visit_id, CASE WHEN id % 4 <> 1 THEN next_visit END AS following_visit_id FROM movements",
    }
)


def points(spark: SparkSession, d: str) -> DataFrame:
    return G.unique_coords(X.visits(spark, d))


def tree(spark: SparkSession, d: str) -> DataFrame:
    b = staged(X.boundaries(spark, d))  # a stored table, as an engine has it
    return G.hierarchy(G.point_in_boundary(points(spark, d), b), b)


def geocoded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Visits with their location and the locations, from one geocoding that is stored as the engine would."""
    points = staged(tree(spark, d))
    return G.geocode_visits(X.visits(spark, d), points), G.upsert_locations(points)


def gvisits(spark: SparkSession, d: str) -> DataFrame:
    return G.geocode_visits(X.visits(spark, d), tree(spark, d))


def locs(spark: SparkSession, d: str) -> DataFrame:
    return G.upsert_locations(tree(spark, d))


def stored_trips(spark: SparkSession, d: str) -> DataFrame:
    """Trips found once, for queries that read them more than once."""
    return staged(found_trips(spark, d))


def located(spark: SparkSession, d: str, trips: DataFrame | None = None) -> DataFrame:
    """Visits of trips with their places: one geocoding for names, cities and primary locations."""
    return T.located(T.trip_visits(found_trips(spark, d) if trips is None else trips), *geocoded(spark, d))


def mlinked(spark: SparkSession, d: str) -> DataFrame:
    m = X.movements(spark, d)
    return m.withColumn("preceding_visit_id", F.when(F.col("id") % 8 != 1, F.col("prev_visit"))).withColumn("following_visit_id", F.when(F.col("id") % 4 != 1, F.col("next_visit")))


def r3(*cols: str):
    return [F.round(c, 3).alias(c) for c in cols]


V = ("subject_id", "id", "start_time", "end_time")
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def keep(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return f

    return keep


@query("SELECT round(lat6, 3) AS lat6, round(lon6, 3) AS lon6, n_visits FROM points")
def q_unique_coords(spark, d):
    return points(spark, d).select(*r3("lat6", "lon6"), "n_visits")


@query("SELECT round(lat6, 3) AS lat6, round(lon6, 3) AS lon6, osm_id, level, name FROM hits")
def q_point_in_boundary(spark, d):
    return G.point_in_boundary(points(spark, d), staged(X.boundaries(spark, d))).select(*r3("lat6", "lon6"), "osm_id", "level", "name")


@query("SELECT round(lat6, 3) AS lat6, round(lon6, 3) AS lon6, city, county, state, country, coalesce(city_osm_id, 0) AS city_osm_id, coalesce(country_osm_id, 0) AS country_osm_id, admin_level, round(centroid_lat, 3) AS centroid_lat, round(centroid_lon, 3) AS centroid_lon FROM hier")
def q_geocode_hierarchy(spark, d):
    return tree(spark, d).select(*r3("lat6", "lon6"), "city", "county", "state", "country", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("city_osm_id", "country_osm_id")], "admin_level", *r3("centroid_lat", "centroid_lon"))


@query("SELECT osm_id, level, round((south + north) / 2, 3) AS centroid_lat, round((west + east) / 2, 3) AS centroid_lon, round((north - south) * (east - west), 3) AS area FROM boundaries")
def q_boundary_centroid(spark, d):
    return G.boundary_centroid(X.boundaries(spark, d)).select("osm_id", "level", *r3("centroid_lat", "centroid_lon", "area"))


@query("SELECT osm_id, level, name, name_en, 'c' || (osm_id % 7) AS country_code FROM boundaries WHERE osm_id % 5 <> 0 AND level <> 6")
def q_admin_boundaries(spark, d):
    """Relations with tag maps, of which some are no administrative areas."""
    b = X.boundaries(spark, d)
    tags = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("boundary", "admin_level", "name", "name:en", "country_code")]),
        F.array(F.expr("if(osm_id % 5 = 0, 'maritime', 'administrative')"), F.col("level").cast("string"), F.col("name"), F.col("name_en"), F.concat(F.lit("c"), (F.col("osm_id") % 7).cast("string"))),
    )
    return G.admin_boundaries(b.select("osm_id", tags.alias("tags"), "polygons"), (2, 4, 8)).drop("polygons")


@query("SELECT location_id, city, county, state, country, admin_level, round(centroid_lat, 3) AS centroid_lat FROM locs")
def q_location_dim(spark, d):
    return locs(spark, d).select("location_id", "city", "county", "state", "country", "admin_level", *r3("centroid_lat"))


@query("SELECT subject_id, id, location_id FROM gvisits")
def q_geocode_visits(spark, d):
    return gvisits(spark, d).select("subject_id", "id", "location_id")


@query("SELECT 'visits' AS measure, count(*) AS n FROM gvisits UNION ALL SELECT 'geocoded', count(location_id) FROM gvisits UNION ALL SELECT 'not geocoded', count(*) - count(location_id) FROM gvisits UNION ALL SELECT 'level ' || admin_level, count(*) FROM locs GROUP BY admin_level")
def q_geocode_summary(spark, d):
    return G.geocode_summary(*geocoded(spark, d))


@query("SELECT trip_id, display_name FROM tnames")
def q_trip_names(spark, d):
    return T.trip_names(located(spark, d))


@query("SELECT trip_id, array_to_string(cities, ',') AS cities FROM tcities")
def q_trip_cities(spark, d):
    c = T.trip_cities(located(spark, d))
    return c.select("trip_id", F.array_join("cities", ",").alias("cities"))


@query("SELECT trip_id, primary_location_id FROM tprimary")
def q_trip_primary_location(spark, d):
    return T.trip_primary_location(located(spark, d))


@query("SELECT city, count(*) AS n_trips FROM (SELECT unnest(cities) AS city FROM tcities) GROUP BY city ORDER BY n_trips DESC, city LIMIT 10")
def q_top_destinations(spark, d):
    return T.top_destinations(T.trip_cities(located(spark, d)))


@query("SELECT location_id, CASE WHEN country <> '' THEN concat_ws(', ', coalesce(city, county), state, country) END AS name FROM locs")
def q_format_full(spark, d):
    return locs(spark, d).select("location_id", full_name().alias("name"))


@query("SELECT g.id, CASE WHEN l.location_id IS NULL THEN format('({:.4f}, {:.4f})', g.lat, g.lon) WHEN city IS NOT NULL THEN concat_ws(', ', city, coalesce(state, country)) WHEN state IS NOT NULL THEN concat_ws(', ', state, country) ELSE country END AS name FROM gvisits g LEFT JOIN locs l ON g.location_id = l.location_id")
def q_format_short(spark, d):
    g, l = geocoded(spark, d)
    return g.join(l, "location_id", "left").select("id", short_name().alias("name"))


# ------------------------------------------------------------------ filters

@query("SELECT subject_id, id, start_time, end_time FROM dayv")
def q_visits_on_day(spark, d):
    return Q.apply_filter(X.visits(spark, d), Q.VisitFilter(day=DAY)).select(*V)


@query(f"SELECT subject_id, id, start_time, end_time FROM visits WHERE lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}")
def q_visits_in_bbox(spark, d):
    return Q.apply_filter(X.visits(spark, d), Q.VisitFilter(box=BOX)).select(*V)


@query(f"SELECT subject_id, id, start_time, end_time FROM visits WHERE {spheroid('lat', 'lon', f'{SPOT[0]}::DOUBLE', f'{SPOT[1]}::DOUBLE')} <= {SPOT[2] * 1000}")
def q_visits_in_radius(spark, d):
    return Q.apply_filter(X.visits(spark, d), Q.VisitFilter(near=SPOT)).select(*V)


@query("SELECT subject_id, id, start_time, end_time FROM visits WHERE CAST(local_end_ts AS DATE) >= DATE '2024-01-10' AND CAST(local_start_ts AS DATE) <= DATE '2024-01-12'")
def q_visits_in_dates(spark, d):
    return Q.apply_filter(X.visits(spark, d), Q.VisitFilter(start=date(2024, 1, 10), end=date(2024, 1, 12))).select(*V)


@query(f"SELECT subject_id, id, start_time, end_time FROM visits WHERE start_time >= TIMESTAMP '{FROM}' AND end_time <= TIMESTAMP '{TO}'")
def q_visits_in_instants(spark, d):
    return Q.apply_filter(X.visits(spark, d), Q.VisitFilter(start=FROM, end=TO)).select(*V)


@query("SELECT subject_id, id, start_time, end_time FROM gvisits WHERE location_id IN (SELECT max(location_id) FROM gvisits)")
def q_visits_by_location(spark, d):
    v = staged(gvisits(spark, d))
    return Q.apply_filter(v, Q.VisitFilter(location_id=v.agg(F.max("location_id")).first()[0])).select(*V)


@query("SELECT v.subject_id, v.id, v.start_time, v.end_time FROM visits v JOIN bridge b ON v.subject_id = b.subject_id AND v.id = b.visit_id WHERE b.trip_id IN (SELECT max(trip_id) FROM trip_rows)")
def q_visits_by_trip(spark, d):
    t = stored_trips(spark, d)
    return Q.apply_filter(X.visits(spark, d), Q.VisitFilter(trip_id=t.agg(F.max("trip_id")).first()[0]), T.trip_visits(t)).select(*V)


@query("SELECT subject_id, id, start_time, end_time FROM visits ORDER BY start_time DESC, id DESC LIMIT 100 OFFSET 50")
def q_paged_visits(spark, d):
    return Q.page(X.visits(spark, d), Q.newest(), 100, 50).select(*V)


@query("SELECT g.subject_id, g.id, g.start_time, coalesce(place_name, concat_ws(', ', coalesce(city, county), state, country)) AS location_name FROM gvisits g LEFT JOIN locs l ON g.location_id = l.location_id WHERE place_name IS NOT NULL OR country IS NOT NULL UNION ALL SELECT g.subject_id, g.id, g.start_time, NULL FROM gvisits g WHERE place_name IS NULL AND location_id IS NULL")
def q_visits(spark, d):
    return Q.list_visits(*geocoded(spark, d)).select("subject_id", "id", "start_time", "location_name")


@query("SELECT round(lat6, 3) AS lat6, round(lon6, 3) AS lon6, n_visits, minutes, first_visit, last_visit, last_day, location_id, place_name FROM (SELECT round(lat, 6) AS lat6, round(lon, 6) AS lon6, count(*) AS n_visits, CAST(sum(duration_minutes) AS BIGINT) AS minutes, min(start_time) AS first_visit, max(end_time) AS last_visit, max(CAST(local_start_ts AS DATE)) AS last_day, max(location_id) AS location_id FROM gvisits GROUP BY 1, 2) a LEFT JOIN (SELECT * FROM (SELECT round(lat, 6) AS la, round(lon, 6) AS lo, place_name, count(*) AS k FROM gvisits WHERE place_name IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY la, lo ORDER BY k DESC, place_name) = 1) m ON m.la = a.lat6 AND m.lo = a.lon6")
def q_spots(spark, d):
    return Q.spots(gvisits(spark, d)).select(*r3("lat6", "lon6"), "n_visits", "minutes", "first_visit", "last_visit", "last_day", "location_id", "place_name")


@query("SELECT round(lat, 3) AS lat6, round(lon, 3) AS lon6, n_visits, minutes, last_day, place_name FROM (SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, count(*) AS n_visits, CAST(sum(duration_minutes) AS BIGINT) AS minutes, max(CAST(local_start_ts AS DATE)) AS last_day, arg_min(place_name, {'s': start_time, 'i': id}) FILTER (WHERE place_name IS NOT NULL) AS place_name FROM dayv GROUP BY 1, 2)")
def q_day_spots(spark, d):
    return Q.day_spots(gvisits(spark, d), DAY).select(*r3("lat6", "lon6"), "n_visits", "minutes", "last_day", "place_name")


@query(f"SELECT g.id, round({spheroid('lat', 'lon', f'{SPOT[0]}::DOUBLE', f'{SPOT[1]}::DOUBLE')} / 1000, 3) AS km, city, country FROM gvisits g LEFT JOIN locs l ON g.location_id = l.location_id WHERE {spheroid('lat', 'lon', f'{SPOT[0]}::DOUBLE', f'{SPOT[1]}::DOUBLE')} <= {SPOT[2] * 1000} ORDER BY start_time DESC, id DESC LIMIT 50")
def q_nearby(spark, d):
    return Q.nearby(*geocoded(spark, d), *SPOT).select("id", *r3("km"), "city", "country")


@query(f"SELECT id, start_time, round({spheroid('lat', 'lon', f'{SPOT[0]}::DOUBLE', f'{SPOT[1]}::DOUBLE')} / 1000, 3) AS km FROM visits WHERE {spheroid('lat', 'lon', f'{SPOT[0]}::DOUBLE', f'{SPOT[1]}::DOUBLE')} <= {SPOT[2] * 1000}")
def q_when_at(spark, d):
    return Q.when_at(X.visits(spark, d), *SPOT).select("id", "start_time", *r3("km"))


@query("SELECT city, state, country, count(*) AS n_visits, round(sum(duration_minutes) / 60.0::DOUBLE, 3) AS hours FROM gvisits g JOIN locs l ON g.location_id = l.location_id WHERE city IS NOT NULL GROUP BY 1, 2, 3 ORDER BY n_visits DESC, city, state, country LIMIT 10")
def q_top_places(spark, d):
    return Q.top_places(*geocoded(spark, d)).select("city", "state", "country", "n_visits", *r3("hours"))


@query("SELECT g.id, g.start_time, l.city, sum(g.duration_minutes) OVER () / 60.0::DOUBLE AS hours FROM (SELECT g.*, l.city AS c FROM gvisits g JOIN locs l ON g.location_id = l.location_id WHERE lower(l.city) = 'l8_102_71e' ORDER BY start_time DESC, g.id DESC LIMIT 100) g JOIN locs l ON g.location_id = l.location_id")
def q_city_visits(spark, d):
    return Q.city_visits(*geocoded(spark, d), "L8_102_71E").select("id", "start_time", "city", "hours")


@query("SELECT l.location_id, city, state, country, admin_level, count(g.id) AS n_visits FROM locs l LEFT JOIN gvisits g ON l.location_id = g.location_id GROUP BY ALL ORDER BY admin_level DESC, city NULLS LAST, state NULLS LAST, country NULLS LAST, l.location_id LIMIT 1000")
def q_locations(spark, d):
    g, l = geocoded(spark, d)
    return Q.list_locations(l, g, limit=1000).select("location_id", "city", "state", "country", "admin_level", "n_visits")


# ------------------------------------------------------------------ trips

def _cities(spark, d, trips):
    return T.trip_cities(located(spark, d, trips))


@query("SELECT t.trip_id, t.start_time, CAST(floor(hours / 24) AS BIGINT) AS days, array_to_string(cities[1:3], ', ') || CASE WHEN len(cities) > 3 THEN ' (+' || (len(cities) - 3) || ' more)' ELSE '' END AS city_list FROM trip_rows t LEFT JOIN tcities c ON t.trip_id = c.trip_id ORDER BY t.start_time DESC, t.trip_id DESC LIMIT 50")
def q_list_trips(spark, d):
    t = stored_trips(spark, d)
    return Q.list_trips(t, _cities(spark, d, t)).select("trip_id", "start_time", "days", "city_list")


@query("SELECT trip_id, category, n_visits AS visit_count FROM trip_rows")
def q_trip_details(spark, d):
    t = stored_trips(spark, d)
    return Q.trip_details(t, T.trip_visits(t)).select("trip_id", "category", "visit_count")


@query("SELECT t.trip_id, t.category, p.primary_location_id, n_visits AS visit_count FROM trip_rows t LEFT JOIN tprimary p ON t.trip_id = p.trip_id WHERE t.category = 'Short Trip'")
def q_trips(spark, d):
    one = Q.trips_in_range(stored_trips(spark, d), None, None, "Short Trip")
    return Q.trip_details(one, T.trip_visits(one)).join(T.trip_primary_location(located(spark, d, one)), "trip_id", "left").select("trip_id", "category", "primary_location_id", "visit_count")


@query(f"SELECT 'local' AS how, trip_id FROM trip_rows WHERE CAST(local_start_ts AS DATE) <= DATE '2024-01-20' AND CAST(local_end_ts AS DATE) >= DATE '2024-01-10' UNION ALL SELECT 'instant', trip_id FROM trip_rows WHERE start_time < TIMESTAMP '{TO}' AND end_time > TIMESTAMP '{FROM}'")
def q_trips_in_range(spark, d):
    t = stored_trips(spark, d)
    a = Q.trips_in_range(t, FROM.date(), TO.date()).select(F.lit("local").alias("how"), "trip_id")
    return a.unionByName(Q.trips_in_range(t, FROM, TO).select(F.lit("instant").alias("how"), "trip_id"))


@query("""SELECT b.trip_id, b.visit_id, v.start_time AS visit_start, coalesce(CASE WHEN t.n_visits % 2 = 1 THEN nullif(n.display_name, '') END, CASE WHEN t.n_visits % 4 <> 0 THEN nullif(array_to_string(c.cities, ', '), '') END, CASE WHEN l.country <> '' THEN concat_ws(', ', coalesce(l.city, l.county), l.state, l.country) END) AS name
FROM bridge b JOIN trip_rows t ON b.trip_id = t.trip_id JOIN tnames n ON b.trip_id = n.trip_id JOIN tcities c ON b.trip_id = c.trip_id LEFT JOIN tprimary p ON b.trip_id = p.trip_id LEFT JOIN locs l ON p.primary_location_id = l.location_id JOIN visits v ON b.subject_id = v.subject_id AND b.visit_id = v.id""")
def q_trip_detail(spark, d):
    """Under stored names of which every second is missing, and of these every second has no cities either."""
    t = stored_trips(spark, d)
    b, (g, l) = T.trip_visits(t), geocoded(spark, d)
    located = T.located(b, g, l)
    primary = T.trip_primary_location(located).join(l.select(F.col("location_id").alias("primary_location_id"), full_name().alias("primary_name")), "primary_location_id")
    names = T.trip_names(located).join(T.trip_cities(located), "trip_id").join(primary, "trip_id", "left").join(t.select("trip_id", F.col("n_visits").alias("k")), "trip_id")
    names = names.withColumn("display_name", F.when(F.col("k") % 2 == 1, F.col("display_name"))).withColumn("cities", F.when(F.col("k") % 4 != 0, F.col("cities")))
    return Q.trip_detail(t, b, X.visits(spark, d), names).select("trip_id", "visit_id", "visit_start", "name")


QUERIES["trips_by_year"] = lambda spark, d: S.trips_by_year(found_trips(spark, d))
ORACLES["trips_by_year"] = sql("SELECT CAST(year(local_start_ts) AS INTEGER) AS year, category, count(*) AS n_trips FROM trip_rows GROUP BY 1, 2")


# ------------------------------------------------------------------ rollups

@query("SELECT 'visits' AS kind, visit_type AS name, count(*) AS n, min(start_time) AS first, max(end_time) AS last FROM visits GROUP BY visit_type UNION ALL SELECT 'trips', category, count(*), NULL, NULL FROM trip_rows GROUP BY category UNION ALL SELECT 'locations', NULL, count(*), NULL, NULL FROM locs")
def q_stats(spark, d):
    return S.stats(X.visits(spark, d), found_trips(spark, d), locs(spark, d))


@query("SELECT 'visits' AS kind, visit_type AS name, count(*) AS n FROM visits WHERE year(start_time) = 2024 GROUP BY visit_type UNION ALL SELECT 'trips', category, count(*) FROM trip_rows WHERE year(start_time) = 2024 GROUP BY category")
def q_year_summary(spark, d):
    return S.year_summary(X.visits(spark, d), found_trips(spark, d), 2024)


@query("SELECT visit_type, count(*) AS n, count(*) - count(location_id) AS ungeocoded, count(local_start_ts) AS with_local_day FROM gvisits GROUP BY visit_type")
def q_visit_summary(spark, d):
    return S.visit_summary(gvisits(spark, d))


_SUMS = "count(*) AS n, round(coalesce(sum(distance_meters), 0) / 1000, 3) AS km, round(coalesce(sum(duration_minutes), 0) / 60.0::DOUBLE, 3) AS hours"


@query(f"SELECT 'type' AS level, movement_type AS name, {_SUMS}, count(route) AS with_route FROM movements GROUP BY movement_type UNION ALL SELECT 'activity', activity_type, {_SUMS}, count(route) FROM movements WHERE movement_type = 'activity' AND activity_type IS NOT NULL GROUP BY activity_type UNION ALL SELECT 'total', NULL, {_SUMS}, count(route) FROM movements")
def q_movement_summary(spark, d):
    return S.movement_summary(X.movements(spark, d)).select("level", "name", "n", *r3("km", "hours"), "with_route")


@query("SELECT source, count(*) AS n, round(avg(CAST(preceding_visit_id IS NOT NULL AS INTEGER)), 3) AS preceding, round(avg(CAST(following_visit_id IS NOT NULL AS INTEGER)), 3) AS following, round(avg(CAST(preceding_visit_id IS NOT NULL OR following_visit_id IS NOT NULL AS INTEGER)), 3) AS either FROM mlinked GROUP BY source")
def q_link_rates(spark, d):
    return S.link_rates(mlinked(spark, d)).select("source", "n", *r3("preceding", "following", "either"))


@query("SELECT (SELECT count(*) FROM visits) AS visits, (SELECT min(start_time) FROM visits) AS first_visit, (SELECT max(end_time) FROM visits) AS last_visit, (SELECT count(*) FROM trip_rows) AS trips, (SELECT count(*) FROM locs) AS locations, (SELECT count(*) FROM movements) AS movements, (SELECT round_even(sum(distance_meters) / 1000, 1) FROM movements) AS km, (SELECT round_even(sum(duration_minutes) / 60.0::DOUBLE, 1) FROM movements) AS hours")
def q_overview(spark, d):
    return S.overview(X.visits(spark, d), found_trips(spark, d), X.movements(spark, d), locs(spark, d))


@query(f"SELECT {_SUMS}, count(route) AS with_route, round(100.0::DOUBLE * count(route) / count(*), 3) AS route_pct FROM movements")
def q_movement_stats_overall(spark, d):
    return S.movement_stats(X.movements(spark, d), None).select("n", *r3("km", "hours"), "with_route", *r3("route_pct"))


@query(f"SELECT activity_type, {_SUMS}, round(avg(confidence), 3) AS confidence FROM movements WHERE movement_type = 'activity' AND activity_type IS NOT NULL GROUP BY activity_type")
def q_movement_stats_activity(spark, d):
    return S.movement_stats(X.movements(spark, d), "activity_type").select("activity_type", "n", *r3("km", "hours", "confidence"))


@query(f"SELECT movement_type, {_SUMS} FROM movements GROUP BY movement_type")
def q_movement_stats_type(spark, d):
    return S.movement_stats(X.movements(spark, d), "movement_type").select("movement_type", "n", *r3("km", "hours"))


@query(f"SELECT source, {_SUMS} FROM movements GROUP BY source")
def q_movement_stats_source(spark, d):
    return S.movement_stats(X.movements(spark, d), "source").select("source", "n", *r3("km", "hours"))


# ------------------------------------------------------------------ movements and timelines

@query("SELECT subject_id, id, source, movement_type FROM daym m WHERE source <> 'phone' OR NOT EXISTS (SELECT 1 FROM daym t WHERE t.source = 'tracker' AND t.subject_id = m.subject_id)")
def q_preferred_source(spark, d):
    return L.preferred_source(X.movements(spark, d), DAY).select("subject_id", "id", "source", "movement_type")


@query("SELECT subject_id, id, source FROM daym WHERE source = 'phone' AND movement_type = 'activity' AND activity_type = 'WALKING' AND distance_meters BETWEEN 1000 AND 50000")
def q_movements_on_day(spark, d):
    f = L.MovementFilter(DAY, activity_type="WALKING", movement_type="activity", source="phone", min_metres=1000, max_metres=50000)
    return L.list_movements(X.movements(spark, d), f).select("subject_id", "id", "source")


def _segment(i: int) -> str:
    a, b = f"route[{i}]", f"route[{i + 1}]"
    parts = []
    for axis, lo, hi in (("lon", BOX[1], BOX[3]), ("lat", BOX[0], BOX[2])):
        p, dd = f"{a}.{axis}", f"({b}.{axis} - {a}.{axis})"
        flat = f"{dd} = 0"
        parts.append((f"CASE WHEN {flat} THEN 0 ELSE least(({lo} - {p}) / nullif({dd}, 0), ({hi} - {p}) / nullif({dd}, 0)) END", f"CASE WHEN {flat} THEN 1 ELSE greatest(({lo} - {p}) / nullif({dd}, 0), ({hi} - {p}) / nullif({dd}, 0)) END", f"(NOT {flat} OR {p} BETWEEN {lo} AND {hi})"))
    (x0, x1, okx), (y0, y1, oky) = parts
    return f"({okx} AND {oky} AND greatest({x0}, {y0}, 0) <= least({x1}, {y1}, 1))"


_IN = lambda a, b: f"({a} BETWEEN {BOX[0]} AND {BOX[2]} AND {b} BETWEEN {BOX[1]} AND {BOX[3]})"


@query(f"SELECT subject_id, id FROM daym WHERE {_IN('start_lat', 'start_lon')} OR {_IN('end_lat', 'end_lon')} OR (route IS NOT NULL AND ({_segment(1)} OR {_segment(2)}))")
def q_movements_in_bbox(spark, d):
    return L.on_day(X.movements(spark, d), DAY).filter(L.route_in_box(BOX)).select("subject_id", "id")


@query("SELECT DISTINCT b.trip_id, m.id FROM mlinked m JOIN bridge b ON m.subject_id = b.subject_id AND (b.visit_id = m.preceding_visit_id OR b.visit_id = m.following_visit_id)")
def q_movements_by_trip(spark, d):
    return L.movements_by_trip(mlinked(spark, d), T.trip_visits(found_trips(spark, d)))


@query("SELECT id, (CAST(distance_meters AS BIGINT) // 10 + CASE WHEN CAST(distance_meters AS BIGINT) % 10 > 5 OR (CAST(distance_meters AS BIGINT) % 10 = 5 AND (CAST(distance_meters AS BIGINT) // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS km, round_even(nullif(distance_meters, 0) / nullif(duration_minutes, 0) * 60 / 1000, 1) AS kmh, route IS NOT NULL AS routed FROM movements")
def q_movement_detail(spark, d):
    return L.movement_detail(X.movements(spark, d)).select("id", "km", "kmh", F.col("geojson").isNotNull().alias("routed"))


@query("SELECT id, 'LineString' AS kind, CAST(len(route) AS INTEGER) AS n, round(route[1].lon, 3) AS lon, round(route[-1].lat, 3) AS lat FROM movements WHERE route IS NOT NULL")
def q_movement_geojson(spark, d):
    """The exported text, read back."""
    m = X.movements(spark, d).filter("route is not null").select("id", F.from_json(L.route_geojson(F.col("route")), "type string, coordinates array<array<double>>").alias("g"))
    at = lambda i, j: F.round(F.element_at(F.element_at("g.coordinates", i), j), 3)
    return m.select("id", F.col("g.type").alias("kind"), F.size("g.coordinates").alias("n"), at(1, 1).alias("lon"), at(-1, 2).alias("lat"))


@query("SELECT subject_id, kind, id, local_start_ts, CAST(row_number() OVER w AS INTEGER) AS place, round(lead(lat) OVER w, 3) AS next_lat, round(lead(lon) OVER w, 3) AS next_lon, round(to_lat, 3) AS to_lat FROM (SELECT subject_id, 'visit' AS kind, id, local_start_ts, lat, lon, lat AS to_lat FROM dayv UNION ALL SELECT subject_id, 'movement', id, local_start_ts, start_lat, start_lon, coalesce(route[-1].lat, end_lat) FROM daym) WINDOW w AS (PARTITION BY subject_id ORDER BY local_start_ts, kind, id)")
def q_day_timeline(spark, d):
    return L.day_timeline(X.visits(spark, d), X.movements(spark, d), DAY).select("subject_id", "kind", "id", "local_start_ts", "place", *r3("next_lat", "next_lon", "to_lat"))


_BITS = lambda x, low, span, n: f"greatest(0, least({(1 << n) - 1}, CAST(ceil(({x} - ({low})) / {span} * {float(1 << n)}) AS BIGINT) - 1))"


def _geohash_sql(precision: int) -> str:
    bits = precision * 5
    nlon, nlat = (bits + 1) // 2, bits // 2
    chars = []
    for k in range(precision):
        terms = []
        for j in range(5):
            b = k * 5 + j
            axis, shift = ("gx", nlon - 1 - b // 2) if b % 2 == 0 else ("gy", nlat - 1 - b // 2)
            terms.append(f"(({axis} >> {shift}) & 1) * {1 << (4 - j)}")
        chars.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(terms)} AS INTEGER) + 1, 1)")
    return f"SELECT {' || '.join(chars)} AS geohash, count(*) AS n_visits, CAST(sum(duration_minutes) AS BIGINT) AS minutes FROM (SELECT *, {_BITS('lon', -180, 360.0, nlon)} AS gx, {_BITS('lat', -90, 180.0, nlat)} AS gy FROM visits) GROUP BY 1"


@query(_geohash_sql(6))
def q_geohash_rollup(spark, d):
    return L.geohash_rollup(X.visits(spark, d), 6)


@query(" UNION ALL ".join(f"SELECT {n} AS days, id FROM visits WHERE CAST(local_end_ts AS DATE) >= DATE '{DAY}' - {n} AND CAST(local_start_ts AS DATE) <= DATE '{DAY}' + {n}" for n in (0, 1, 3, 15))
       + " UNION ALL SELECT -1, id FROM visits WHERE CAST(local_end_ts AS DATE) >= DATE '2024-01-01' AND CAST(local_start_ts AS DATE) <= DATE '2024-12-31'")
def q_visits_around(spark, d):
    v = X.visits(spark, d)
    out = None
    for n in (0, 1, 3, 15, None):
        x = Q.visits_around(v, DAY, n).select(F.lit(-1 if n is None else n).alias("days"), "id")
        out = x if out is None else out.unionByName(x)
    return out


@query(" UNION ALL ".join(f"SELECT '{n}' AS span, id FROM visits WHERE CAST(local_end_ts AS DATE) >= DATE '{DAY}' - INTERVAL {n} AND CAST(local_start_ts AS DATE) <= DATE '{DAY}'" for n in ("7 DAY", "1 MONTH", "2 YEAR")))
def q_visits_trailing(spark, d):
    v = X.visits(spark, d)
    spans = {"7 DAY": {"days": 7}, "1 MONTH": {"months": 1}, "2 YEAR": {"years": 2}}
    first, *rest = [Q.visits_trailing(v, DAY, **span).select(F.lit(name).alias("span"), "id") for name, span in spans.items()]
    for x in rest:
        first = first.unionByName(x)
    return first


@query("SELECT subject_id, id, place_name FROM visits ORDER BY place_name DESC NULLS LAST, subject_id, id LIMIT 1000")
def q_visit_table(spark, d):
    return Q.visit_table(X.visits(spark, d), "place_name", ascending=False).select("subject_id", "id", "place_name")

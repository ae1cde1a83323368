"""Layout by space, links through cells of space, pages by key."""

import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from dwellpath.functions.geo import distance_m, z_key, z_ranges
from dwellpath.operators import ingest as I
from dwellpath.operators import joins as J
from dwellpath.operators import query as Q
from dwellpath.sources import exports as E
from dwellpath.plans import registry
from tests.conftest import DATA
from tests.test_models import T0


def z_of(lat, lon):
    side = 1 << 16
    at = lambda v, low, span: max(0, min(side - 1, math.floor((v - low) / span * side)))
    x, y = at(lon, -180, 360), at(lat, -90, 180)
    return sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(16))


def test_z_keys(spark):
    g = random.Random(1)
    points = [(g.uniform(-90, 90), g.uniform(-180, 180)) for _ in range(300)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (95.0, 400.0)]
    got = {(r["y"], r["x"]): r["z"] for r in spark.createDataFrame(points, "y double, x double").withColumn("z", z_key("y", "x")).collect()}
    assert got == {p: z_of(*p) for p in points}
    for _ in range(200):
        s, w = g.uniform(-90, 89), g.uniform(-180, 179)
        n, e = min(90, s + g.choice([0.001, 1, 60])), min(180, w + g.choice([0.001, 1, 90]))
        ranges = z_ranges(s, w, n, e)
        assert len(ranges) <= 32 and all(a <= z for a, z in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
        for _ in range(20):
            z = z_of(g.uniform(s, n), g.uniform(w, e))
            assert any(a <= z <= b for a, b in ranges)


def rows_read(df):
    """Rows of the groups that the scan of a plan without shuffles reads."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


@pytest.fixture
def visits(spark):
    n = 60_000
    at = lambda s: F.timestamp_add("SECOND", (F.col("id") * 60 + s).cast("int"), F.lit(T0).cast("timestamp_ntz"))
    v = spark.range(n).select(F.lit(1).cast("long").alias("subject_id"), "id", at(0).alias("start_time"), at(50).alias("end_time"), (F.rand(1) * 20 + 40).alias("lat"), (F.rand(2) * 30).alias("lon"))
    return v.withColumn("local_start_ts", F.col("start_time")).withColumn("local_end_ts", F.col("end_time")).cache()


def test_small_boxes_read_few_rows(spark, visits, tmp_path):
    E.append_visits(visits, str(tmp_path / "v"), rows_a_group=500)
    stored = E.visit_store(spark, str(tmp_path / "v")).read()
    assert stored.count() == visits.count()
    for f in (Q.VisitFilter(near=(50.0, 15.0, 1.0)), Q.VisitFilter(box=(45.0, 10.0, 45.2, 10.2)), Q.VisitFilter(near=(41.0, 0.1, 30.0))):
        got, want = Q.apply_filter(stored, f), Q.apply_filter(visits, f)
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
        assert rows_read(got) < 0.05 * visits.count()


def test_pages_by_key_join_to_the_whole_and_read_alike(spark, visits, tmp_path):
    v = visits.filter("id < 3000").withColumn("start_time", F.timestamp_add("DAY", (F.col("id") % 200).cast("int"), F.lit(T0).cast("timestamp_ntz")))
    store = E.visit_store(spark, str(tmp_path / "v"))
    E.append_visits(v, str(tmp_path / "v"))
    want = [(r["start_time"], r["id"]) for r in v.orderBy(*Q.newest()).collect()]
    got, after = [], None
    for _ in range(4):
        page = [(r["start_time"], r["id"]) for r in Q.newest_after(store, 400, after).collect()]
        got, after = got + page, page[-1]
    assert got == want[:1600]
    last = [(r["start_time"], r["id"]) for r in Q.newest_after(store, 50_000, want[2600]).collect()]
    assert last == want[2601:] and Q.newest_after(store, 5, want[-1]).count() == 0
    late = Q.newest_after(store, 50, want[2000])
    assert len(late.inputFiles()) <= 4 * len(Q.newest_after(store, 50).inputFiles())
    with pytest.raises(ValueError):
        Q.newest_after(store, 0)


# ------------------------------------------------------------------ space in the key

def test_cells_hold_every_near_pair(spark):
    """Round cell edges, at 180 degrees and at the poles."""
    g = random.Random(2)
    rows = []
    for k in range(1200):
        lat = g.choice([0.0, 60.0, -45.0, 89.99, 90.0, -89.999, -90.0, 85.0, g.uniform(-90, 90)])
        lon = g.choice([180.0, -180.0, 179.999, 0.0, g.uniform(-180, 180)])
        turn, far = g.uniform(0, 2 * math.pi), g.choice([0, 100, 480, 499, 520])
        lat2 = max(-90.0, min(90.0, lat + far * math.cos(turn) / 111_200))
        lon2 = lon + far * math.sin(turn) / (111_200 * max(1e-9, math.cos(math.radians(lat))))
        rows.append((k, lat, lon, lat2, (lon2 + 180) % 360 - 180))
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double")
    met = J.with_cells_near(J.with_cell(df, "c", "d", 500.0), "a", "b", 500.0)
    out = met.groupBy("k", distance_m("a", "b", "c", "d").alias("m")).agg(F.count_if(F.expr("_row = _r_row and _col = _r_col")).alias("met"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["met"] == 1 for r in out if r["m"] <= 500) and sum(r["m"] <= 500 for r in out) > 400
    assert all(r["met"] <= 1 and r["n"] <= 6 for r in out) and len(out) == 1200


def test_links_equal_brute_force_and_a_full_minute_is_quick(spark):
    import time

    g = random.Random(3)
    where = lambda: (g.choice([0.0, 0.004, 0.0045, 0.01]), g.choice([179.998, -179.999, 0.0, 0.0044]))
    visits = [(g.randrange(2), k, T0 + timedelta(minutes=g.randrange(60)), T0 + timedelta(minutes=g.randrange(60)), *where()) for k in range(120)]
    moves = [(g.randrange(2), k, T0 + timedelta(minutes=g.randrange(60)), T0 + timedelta(minutes=g.randrange(60)), *where(), *where()) for k in range(120)]
    v = spark.createDataFrame(visits, "subject_id long, id long, start_time timestamp_ntz, end_time timestamp_ntz, lat double, lon double")
    m = spark.createDataFrame(moves, "subject_id long, id long, start_time timestamp_ntz, end_time timestamp_ntz, start_lat double, start_lon double, end_lat double, end_lon double")
    got = {(r["subject_id"], r["id"]): (r["preceding_visit_id"], r["following_visit_id"]) for r in I.link_visits(m, v).collect()}
    pairs = m.select("subject_id", F.col("id").alias("m"), F.col("start_time").alias("t"), F.col("end_time").alias("u"), "start_lat", "start_lon", "end_lat", "end_lon").join(v, "subject_id")
    five = 300_000_000
    for k, (t, vt, la, lo) in enumerate((("t", "end_time", "start_lat", "start_lon"), ("u", "start_time", "end_lat", "end_lon"))):
        gap, far = F.abs(J.between_micros(t, vt)), distance_m(la, lo, "lat", "lon")
        best = pairs.filter((gap <= five) & (far <= 500)).groupBy("subject_id", "m").agg(F.min_by("id", F.struct(gap.alias("g"), far.alias("d"), "id")).alias("v")).collect()
        want = {(r["subject_id"], r["m"]): r["v"] for r in best}
        assert {key: x[k] for key, x in got.items() if x[k] is not None} == want and want
    # ten thousand visits in one minute, of one person, in many places
    at = F.lit(T0).cast("timestamp_ntz")
    place = [(F.col("id") % 100 * 0.05).alias("lat"), (F.floor(F.col("id") / 100) * 0.05).alias("lon")]
    many = spark.range(10_000).select(F.lit(1).cast("long").alias("subject_id"), "id", at.alias("start_time"), at.alias("end_time"), *place)
    went = many.withColumnsRenamed({"lat": "start_lat", "lon": "start_lon"}).withColumn("end_lat", F.col("start_lat")).withColumn("end_lon", F.col("start_lon"))
    began = time.time()
    assert I.link_visits(went, many).filter("preceding_visit_id = id and following_visit_id = id").count() == 10_000
    assert time.time() - began < 20


def test_surveyed_orders(spark):
    from datetime import date

    from dwellpath.operators import stats as S
    from dwellpath.operators import timeline as L

    rows = [(1, k, T0 + timedelta(hours=h), "phone", "activity", "WALKING", c) for k, (h, c) in enumerate(((3, 0.1), (1, 0.2), (2, 0.9), (3, 0.6665)))]
    m = spark.createDataFrame(rows, "subject_id long, id long, start_time timestamp_ntz, source string, movement_type string, activity_type string, confidence double")
    for c in ("local_start_ts", "local_end_ts"):
        m = m.withColumn(c, F.col("start_time"))
    f = L.MovementFilter(date(2024, 1, 1))
    assert [r["id"] for r in L.list_movements(m, f).collect()] == [3, 0, 2, 1]
    assert [r["id"] for r in L.list_movements(m, f, limit=2, offset=1).collect()] == [0, 2]
    v = m.withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0))
    assert [r["id"] for r in Q.when_at(v, 0.0, 0.0).collect()] == [1, 2, 0, 3]
    m = m.withColumn("distance_meters", F.lit(1.0)).withColumn("duration_minutes", F.lit(1)).withColumn("route", F.lit(None).cast("array<int>"))
    assert S.movement_stats(m, "activity_type").first()["confidence"] == 0.467


@pytest.mark.parametrize("name", ["trips", "trip_summary"])
def test_trips_that_are_read_twice_are_found_once(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "_bridged" not in plan

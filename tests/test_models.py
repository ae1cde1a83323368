"""Operators against plain Python on random rows, and on edge rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dwellpath.functions import parse as P
from dwellpath.functions.geo import area_centroid, geohash, segment_hits_box, spheroid_m, strictly_inside
from dwellpath.operators import joins as J
from dwellpath.operators import places as H
from dwellpath.operators import trips as T
from dwellpath.operators.query import VisitFilter, page

T0 = datetime(2024, 1, 1)


def scan_blocks(rows, max_gap):
    """Blocks of away visits by going through them one by one; rows: (id, start, end, away, split)."""
    blocks, current = [], []
    for r in rows:
        if not r[3]:
            blocks, current = blocks + ([current] if current else []), []
        elif current and r[4]:
            blocks, current = [*blocks, current], [r]
        else:
            current = [*current, r]
    return [[r[0] for r in b] for b in [*blocks, *([current] if current else [])]]


def test_blocks_equal_a_scan(spark):
    g = random.Random(5)
    rows, want = [], {}
    for s in range(40):
        t, own = T0, []
        for k in range(30):
            t += timedelta(hours=g.choice([0, 1, 7, 8, 9, 30]))
            end = t + timedelta(hours=g.choice([0, 1, 3]))
            own.append((s * 100 + k, t, end, g.random() < 0.7, g.random() < 0.3))
        own.sort(key=lambda r: (r[1], r[0]))
        want[s] = scan_blocks(own, 8)
        rows += [(s, *r) for r in own]
    df = spark.createDataFrame(rows, "subject_id long, id long, start_time timestamp_ntz, end_time timestamp_ntz, away boolean, split boolean")
    df = df.withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0))
    b = T.trip_bounds(T.trip_blocks(T.sequence_gaps(df)))
    got = {}
    for r in b.orderBy("subject_id", "block").collect():
        got.setdefault(r["subject_id"], []).append(list(r["visit_ids"]))
    assert got == {s: w for s, w in want.items() if w}


def test_anchor_binds_at_eight_hours_and_gap_splits_at_eight(spark):
    h = timedelta(hours=1)
    rows = [(1, 1, T0, T0 + h, False), (1, 2, T0 + 9 * h, T0 + 10 * h, True), (1, 3, T0 + 18 * h, T0 + 19 * h, True), (1, 4, T0 + 27 * h, T0 + 28 * h, False)]
    df = spark.createDataFrame(rows, "subject_id long, id long, start_time timestamp_ntz, end_time timestamp_ntz, away boolean").withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0))
    none = spark.createDataFrame([], "subject_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    homes = spark.createDataFrame([], "subject_id long, pos int, lat double, lon double, place_id string, name string, start_date date, end_date date")
    b = T.trip_blocks(T.gap_splits(df, none, homes)).orderBy("id").collect()
    assert [r["block"] for r in b] == [1, 2]
    assert b[0]["departed"] == T0 + h and b[1]["returned"] == T0 + 27 * h


@pytest.mark.parametrize("hours,name", [(3.9, None), (4.0, "Day Trip"), (16.0, "Short Trip"), (96.0, "Long Trip")])
def test_categories_at_their_edges(spark, hours, name):
    assert spark.range(1).select(T.trip_category(F.lit(hours)).alias("c")).first()["c"] == name


def test_orphans(spark):
    m = timedelta(minutes=1)
    rows = [(1, T0, T0 + 600 * m, 5, [1, 2, 3, 4, 5]), (1, T0 + 700 * m, T0 + 710 * m, 1, [6]), (1, T0 + 800 * m, T0 + 1500 * m, 2, [7, 8]), (2, T0, T0 + 5 * m, 1, [9])]
    df = spark.createDataFrame(rows, "subject_id long, start_time timestamp_ntz, end_time timestamp_ntz, n_visits long, visit_ids array<long>").withColumn("hours", F.lit(0.0))
    out = T.absorb_orphans(df, T.TripRules(categories=(("Any", 0.0, None),))).orderBy("start_time").collect()
    # 100 minutes from either side: the earlier trip takes it; the lone one is dropped
    assert [list(r["visit_ids"]) for r in out] == [[1, 2, 3, 4, 5, 6], [7, 8]]
    assert out[0]["end_time"] == T0 + 710 * m


def plain_orphans(trips):
    """Go through one subject's trips as they stand; rows [start, end, ids]."""
    trips = sorted(trips, key=lambda t: t[:2])
    short = lambda t: len(t[2]) == 1 and t[1] - t[0] < timedelta(minutes=30)
    kept = [list(t) for t in trips if not short(t)]
    for o in filter(short, trips):
        best = None
        for k in kept:
            for gap in (o[0] - k[1], k[0] - o[0]):
                if timedelta(0) < gap < timedelta(hours=24) and (best is None or (gap, k[0]) < best[0]):
                    best = ((gap, k[0]), k)
                    break
        if best:
            k = best[1]
            k[0], k[1], k[2] = min(k[0], o[0]), max(k[1], o[1]), sorted([*k[2], *o[2]])
    return sorted((k[0], k[1], tuple(sorted(k[2]))) for k in kept)


def test_orphans_equal_a_plain_scan(spark):
    g = random.Random(9)
    rows, want = [], {}
    for s in range(40):
        t, own = T0, []
        for k in range(25):
            t += timedelta(hours=g.choice([0.2, 1, 5, 23, 24, 25, 50]))
            n = g.choice([1, 1, 3])
            end = t + (timedelta(minutes=g.randrange(5, 29)) if n == 1 else timedelta(hours=g.randrange(1, 9)))
            own.append((t, end, [100 * k + j for j in range(n)]))
            t = end
        want[s] = plain_orphans(own)
        rows += [(s, a, b, len(i), i) for a, b, i in own]
    df = spark.createDataFrame(rows, "subject_id long, start_time timestamp_ntz, end_time timestamp_ntz, n_visits long, visit_ids array<long>").withColumn("hours", F.lit(0.0))
    got = {s: [] for s in want}
    for r in T.absorb_orphans(df, T.TripRules(categories=(("Any", 0.0, None),))).collect():
        got[r["subject_id"]].append((r["start_time"], r["end_time"], tuple(sorted(r["visit_ids"]))))
    assert {s: sorted(x) for s, x in got.items()} == want


def test_near_in_time_equals_brute_force(spark):
    g = random.Random(1)
    a = [(k, g.randrange(3), T0 + timedelta(seconds=g.randrange(0, 9000, 60))) for k in range(150)]
    b = [(k, g.randrange(3), T0 + timedelta(seconds=g.randrange(0, 9000, 60))) for k in range(150)]
    x, y = spark.createDataFrame(a, "i long, s long, t timestamp_ntz"), spark.createDataFrame(b, "j long, s long, u timestamp_ntz")
    got = J.near_in_time(x, y, "t", "u", ["s"], 300_000_000)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    pairs = {(r["i"], r["j"]) for r in got.collect()}
    assert got.count() == len(pairs)
    assert pairs == {(i, j) for i, s, t in a for j, z, u in b if s == z and abs((t - u).total_seconds()) <= 300}


def test_overlapping_equals_brute_force(spark):
    g = random.Random(2)
    span = lambda: (lambda t: (t, t + timedelta(hours=g.randrange(0, 60))))(T0 + timedelta(hours=g.randrange(200)))
    a, b = [(k, g.randrange(2), *span()) for k in range(80)], [(k, g.randrange(2), *span()) for k in range(80)]
    x, y = spark.createDataFrame(a, "i long, s long, t timestamp_ntz, u timestamp_ntz"), spark.createDataFrame(b, "j long, s long, v timestamp_ntz, w timestamp_ntz")
    got = [(r["i"], r["j"]) for r in J.overlapping(x, y, ["s"], ("t", "u"), ("v", "w")).collect()]
    assert sorted(got) == sorted((i, j) for i, s, t, u in a for j, z, v, w in b if s == z and t < w and u > v)


def test_overlapping_of_long_spans(spark):
    """Spans of hours, months and thousands of years meet each other; none is copied to each of its days."""
    g = random.Random(3)
    span = lambda: (lambda t: (t, t + timedelta(hours=g.choice([3, 40, 24 * 40, 24 * 3000, 24 * 365 * 7000]))))(T0 + timedelta(hours=g.randrange(20000)))
    a, b = [(k, g.randrange(2), *span()) for k in range(120)], [(k, g.randrange(2), *span()) for k in range(120)]
    x, y = spark.createDataFrame(a, "i long, s long, t timestamp_ntz, u timestamp_ntz"), spark.createDataFrame(b, "j long, s long, v timestamp_ntz, w timestamp_ntz")
    got = [(r["i"], r["j"]) for r in J.overlapping(x, y, ["s"], ("t", "u"), ("v", "w")).collect()]
    assert sorted(got) == sorted((i, j) for i, s, t, u in a for j, z, v, w in b if s == z and t < w and u > v)


def test_nearest_record_equals_brute_force_and_is_linear(spark):
    import time

    g = random.Random(4)
    at = lambda: T0 + timedelta(seconds=g.randrange(4000))
    p, r = [(k % 2, k, at()) for k in range(150)], [(k % 2, at(), k) for k in range(90)]
    x, y = spark.createDataFrame(p, "s long, id long, t timestamp_ntz"), spark.createDataFrame(r, "s long, at timestamp_ntz, v int")
    got = {q["id"]: q["v"] for q in J.nearest_record(x, y, "t", "at", "v", ["s"]).collect()}
    when = {(s, v): t for s, t, v in r}
    for s, k, t in p:
        best = min(abs(t - u) for z, u, _ in r if z == s)
        assert abs(when[s, got[k]] - t) == best and (when[s, got[k]] <= t or not any(z == s and u == t - best for z, u, _ in r))
    many = spark.range(40_000).select(F.lit(1).alias("s"), "id", F.timestamp_add("SECOND", (F.col("id") * 2).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("t"))
    began = time.time()
    out = J.nearest_record(many, many.filter("id % 3 = 0").select("s", F.col("t").alias("at"), F.col("id").alias("v")), "t", "at", "v", ["s"])
    assert out.filter("v is null").count() == 0 and time.time() - began < 30


def test_large_outlines_are_not_carried_to_points(spark):
    """A ring of 100,000 vertices with a hole: the same hits as the ray cast over the whole, from cells with few edges."""
    import math

    from dwellpath.operators import geocode as G

    circle = lambda r, n, turn: [{"lon": 5 + r * math.cos(turn * 2 * math.pi * k / n), "lat": 50 + r * math.sin(turn * 2 * math.pi * k / n)} for k in range(n)]
    shape = [[circle(9.0, 100_000, 1), circle(2.0, 501, -1)]]
    b = spark.createDataFrame([(1, 2, "big", None, shape)], f"osm_id long, level int, name string, name_en string, polygons {POLY}").cache()
    g = random.Random(6)
    points = [(round(g.uniform(39, 61), 6), round(g.uniform(-6, 16), 6)) for _ in range(400)]
    p = spark.createDataFrame(points, "lat6 double, lon6 double")
    got = {(r["lat6"], r["lon6"]) for r in G.point_in_boundary(p, b).collect()}
    assert got == {(y, x) for y, x in points if 2 < math.hypot(x - 5, y - 50) < 9}
    n = [r["n"] for r in G.boundary_cells(b).select(F.size("edges").alias("n")).collect()]
    assert max(n) <= 64 and sum(n) < 3 * 100_501 and n.count(0) > 30
    tree = G.hierarchy(G.point_in_boundary(p, b), b)
    assert tree.filter("country = 'big'").count() == len(got)


def test_nearest_record_prefers_the_earlier(spark):
    p = spark.createDataFrame([(1, 1, T0 + timedelta(hours=1)), (1, 2, T0 + timedelta(hours=9))], "s long, id long, t timestamp_ntz")
    r = spark.createDataFrame([(1, T0, 60), (1, T0 + timedelta(hours=2), 120)], "s long, at timestamp_ntz, v int")
    assert {x["id"]: x["v"] for x in J.nearest_record(p, r, "t", "at", "v", ["s"]).collect()} == {1: 60, 2: 120}


def ring(*p):
    return [{"lon": float(x), "lat": float(y)} for x, y in p]


POLY = "array<array<array<struct<lon:double,lat:double>>>>"


def test_point_in_polygon_with_hole_part_and_edges(spark):
    shape = [[ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4))], [ring((20, 0), (30, 0), (25, 10))]]
    points = {(1, 1): True, (5, 5): False, (25, 3): True, (0, 5): False, (10, 10): False, (4, 5): False, (15, 5): False, (21, 9): False}
    df = spark.createDataFrame([(float(x), float(y), shape) for x, y in points], f"x double, y double, g {POLY}")
    got = {(r["x"], r["y"]): r["i"] for r in df.select("x", "y", strictly_inside(F.col("x"), F.col("y"), F.col("g")).alias("i")).collect()}
    assert got == points
    c = df.limit(1).select(area_centroid(F.slice("g", 1, 1)).alias("c")).first()["c"]
    assert (c["area"], c["lon"], c["lat"]) == pytest.approx((96.0, 5.0, 5.0))


def test_segment_meets_box(spark):
    df = spark.createDataFrame([(ring((-5, 5), (15, 5)), True), (ring((-5, -5), (-1, 20)), False), (ring((5, 20), (5, 10)), True), (ring((-1, 9), (2, 12)), True), (ring((-3, 9), (1, 13)), False)], "r array<struct<lon:double,lat:double>>, want boolean")
    for r in df.select(segment_hits_box(F.col("r")[0], F.col("r")[1], 0, 0, 10, 10).alias("hit"), "want").collect():
        assert r["hit"] == r["want"]


def test_spheroid_and_geohash(spark):
    r = spark.range(1).select(spheroid_m(0.0, 0.0, 0.0, 1.0).alias("e"), spheroid_m(0.0, 0.0, 1.0, 0.0).alias("n"), spheroid_m(5.0, 5.0, 5.0, 5.0).alias("z"), geohash(F.lit(57.64911), F.lit(10.40744), 9).alias("g")).first()
    assert r["e"] == pytest.approx(111319.49, abs=1) and r["n"] == pytest.approx(110574.4, abs=1) and r["z"] == 0
    assert r["g"] == "u4pruydqq"


def test_parsing_edges(spark):
    rows = [("2024-01-01T10:00:00Z",), ("2024-01-01T10:00:00+00:00",), ("2024-01-01T10:00:00.5+05:30",), ("2024-01-01T10:00:00-08:00",), ("x",), (None,)]
    df = spark.createDataFrame(rows, "s string").select(P.utc_instant("s").alias("u"), P.explicit_offset_minutes("s").alias("o")).collect()
    assert [r["o"] for r in df] == [None, 0, 330, -480, None, None]
    assert [r["u"] for r in df] == [datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 4, 30, 0, 500000), datetime(2024, 1, 1, 18), None, None]
    secs = spark.createDataFrame([(T0, T0 + timedelta(seconds=s)) for s in (0, 30, 90, 150, 210, -60)], "a timestamp_ntz, b timestamp_ntz")
    assert [r["m"] for r in secs.select(P.duration_minutes("a", "b").alias("m")).collect()] == [1, 1, 2, 2, 4, 1]


def test_month_islands(spark):
    d = lambda *m: [(1, "p", datetime(2020 + (x - 1) // 12, (x - 1) % 12 + 1, 1).date(), 0.0, 0.0, 9000) for x in m]
    df = spark.createDataFrame(d(1, 2, 4, 7, 9, 20), "subject_id long, place_id string, month date, lat double, lon double, minutes long")
    assert [(r["first_month"].month, r["n_rows"]) for r in H.dwell_periods(df).orderBy("first_month").collect()] == [(1, 3), (7, 2)]


def test_bad_filters_are_refused(spark):
    with pytest.raises(ValueError):
        VisitFilter(box=(1, 1, 0, 0))
    with pytest.raises(ValueError):
        page(spark.range(3), [F.col("id")], 0)


def test_sources_read_both_containers(spark, tmp_path):
    from dwellpath.operators.ingest import route_records, visits_from_timeline
    from dwellpath.sources.exports import read_anchor_ranges, read_timeline, read_tracker

    visit = '{"startTime":"2024-01-01T10:00:00Z","endTime":"2024-01-01T11:00:00Z","visit":{"topCandidate":{"placeLocation":"geo:1.5,2.5","placeID":"a"}}}'
    (tmp_path / "a.json").write_text(f"[{visit},{visit}]")
    (tmp_path / "b.json").write_text('{"timelineObjects":[' + visit + "]}")
    r = read_timeline(spark, f"{tmp_path}/*.json")
    assert r.count() == 3 and visits_from_timeline(route_records(r)).filter("lat = 1.5 and lon = 2.5").count() == 3
    import gzip

    (tmp_path / "2024-01-01.json.gz").write_bytes(gzip.compress(b'{"timelineItems":[{"isVisit":true,"startDate":"2024-01-01T10:00:00Z"},{"isVisit":false}]}'))
    assert [x["isVisit"] for x in read_tracker(spark, f"{tmp_path}/*.json.gz").orderBy("seq").collect()] == [True, False]
    (tmp_path / "home.txt").write_text('[{"lat":1.0,"lon":2.0,"name":"h","start_date":null,"end_date":"2024-01-05"}]')
    a = read_anchor_ranges(spark, f"{tmp_path}/home.txt").first()
    assert a["start_date"] is None and str(a["end_date"]) == "2024-01-05"

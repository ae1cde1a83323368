"""Import jobs on exports that overlap, and stored tables under writers that die or meet."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dwellpath.operators import imports as IM
from dwellpath.operators import ingest as I
from dwellpath.operators import places as H
from dwellpath.operators import trips as T
from dwellpath.operators.query import spots
from dwellpath.plans import registry
from dwellpath.sources import exports as E
from dwellpath.sources.store import Conflict, Store
from tests.conftest import DATA, plain
from tests.test_models import T0, plain_orphans

VISITS = "subject_id long, id long, start_time timestamp_ntz, end_time timestamp_ntz, lat double, lon double"


def export():
    at = lambda h, off="Z": (datetime(2024, 1, 1) + timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%S") + off
    visit = lambda h, place: {"subject_id": 1, "startTime": at(h), "endTime": at(h + 1), "visit": {"topCandidate": {"placeLocation": "geo:1.5,2.5", "placeID": place}}}
    trail = lambda h: {"subject_id": 1, "startTime": at(h), "endTime": at(h + 1), "timelinePath": [{"point": "geo:1,2"}, {"point": "geo:1,3"}]}
    drive = lambda h: {"subject_id": 1, "startTime": at(h, "+02:00"), "endTime": at(h + 1, "+02:00"), "activity": {"start": "geo:1,2", "end": "geo:3,4", "topCandidate": {"type": "walking"}}}
    return [visit(0, "a"), trail(1), visit(2, "b"), drive(3), trail(5), drive(6), visit(0, "again"), visit(30, "c"), drive(31)]


def imported(spark, folder):
    raw = E.read_timeline(spark, str(folder), "subject_id bigint")
    visits, _ = IM.import_visits(raw)
    moves = IM.import_movements(raw, visits)
    return plain(visits.drop("file", "seq").collect()), plain(moves.select("id", "movement_type", "start_time", "local_start_ts", "preceding_visit_id").collect())


def test_three_files_give_the_rows_of_one(spark, tmp_path):
    records = export()
    (tmp_path / "one").mkdir(), (tmp_path / "three").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps(records))
    (tmp_path / "three" / "a.json").write_text(json.dumps(records))
    # later files: the same records, moved, and in the last another name for a place known already
    (tmp_path / "three" / "b.json").write_text(json.dumps({"timelineObjects": records[::-1]}))
    late = json.loads(json.dumps(records).replace('"placeID": "a"', '"placeID": "late"'))
    (tmp_path / "three" / "c.json").write_text(json.dumps([{"unknown": 1}, *late]))
    one, three = imported(spark, tmp_path / "one"), imported(spark, tmp_path / "three")
    assert one == three
    assert len(one[0]) == 3 and len(one[1]) == 5
    assert {r["place_id"] for r in IM.import_visits(E.read_timeline(spark, str(tmp_path / "three"), "subject_id bigint"))[0].collect()} == {"a", "b", "c"}


# ------------------------------------------------------------------ stored tables

def rows_of(store):
    return sorted((r["source"], r["k"]) for r in store.read().collect())


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ("source",))
    s.write(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "source string, k long"))
    return s


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, store, monkeypatch):
    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            store.write(spark.createDataFrame([("a", 9)], "source string, k long"), replace=lambda p: True)
    assert rows_of(store) == [("a", 1), ("a", 2), ("b", 3)]
    assert store.vacuum() == 1 and rows_of(store) == [("a", 1), ("a", 2), ("b", 3)]


def test_rows_made_from_the_table_replace_it(spark, store):
    store.write(store.read().filter("source = 'a' and k = 2"), replace=lambda p: p[0] == "a")
    assert rows_of(store) == [("a", 2), ("b", 3)]
    store.write(spark.createDataFrame([("b", 4)], "source string, k long"))
    assert rows_of(store) == [("a", 2), ("b", 3), ("b", 4)] and len(store.partitions()[("b",)]) == 2
    store.write(store.read().limit(0), replace=lambda _: True)
    assert rows_of(store) == []


def test_a_reader_keeps_its_view_and_a_second_writer_is_told(spark, store):
    view, number = store.read(), store._manifest()
    store.write(spark.createDataFrame([("a", 5)], "source string, k long"), replace=lambda _: True)
    assert sorted(r["k"] for r in view.collect()) == [1, 2, 3]
    with pytest.raises(Conflict):
        store._commit(*number)


def test_a_revision_writes_only_the_months_it_changes(spark, tmp_path):
    path = str(tmp_path / "m")
    make = lambda days: spark.createDataFrame([(1, d, "phone", T0 + timedelta(days=d), T0 + timedelta(days=d, hours=1)) for d in days], "subject_id long, id long, source string, start_time timestamp_ntz, end_time timestamp_ntz")
    E.write_movements(make(range(0, 100, 5)), path)
    before = E.movement_store(spark, path).partitions()
    written = E.revise_movements(make(range(2, 103, 5)), path, "phone")
    after = E.movement_store(spark, path).partitions()
    assert written == {("phone", "2024-03"), ("phone", "2024-04")} and {p for p in after if after[p] != before.get(p)} == written
    days = sorted(r["id"] for r in E.movement_store(spark, path).read().collect())
    # the last stored day is 95, so what ends by day 88 stays and what ends later is new
    assert days == [*range(0, 88, 5), *range(92, 103, 5)]


def test_trips_are_stored_once_and_reloaded_whole(spark, tmp_path):
    path = str(tmp_path / "trips")
    make = lambda ks: spark.createDataFrame([(f"t{k}", 1, T0 + timedelta(days=k), T0 + timedelta(days=k, hours=5), "Day Trip", [k, k + 1, k]) for k in ks], "trip_id string, subject_id long, start_time timestamp_ntz, end_time timestamp_ntz, category string, visit_ids array<long>")
    names = spark.createDataFrame([("t1", "Town", ["Town"])], "trip_id string, display_name string, cities array<string>")
    assert E.write_trips(make([1, 2]), path, names).count() == 2
    assert E.write_trips(make([1, 2, 40]), path, names).count() == 1
    trips, bridge = E.read_trips(spark, path)
    assert sorted((r["trip_id"], r["display_name"]) for r in trips.collect()) == [("t1", "Town"), ("t2", None), ("t40", None)]
    assert sorted(map(tuple, bridge.select("trip_id", "visit_id").collect())) == [("t1", 1), ("t1", 2), ("t2", 2), ("t2", 3), ("t40", 40), ("t40", 41)]
    E.write_trips(make([7]), path, names, force=True)
    trips, bridge = E.read_trips(spark, path)
    assert [r["trip_id"] for r in trips.collect()] == ["t7"] and bridge.count() == 2


# ------------------------------------------------------------------ orphans, periods, spots

def test_many_orphans_of_one_subject(spark):
    import random
    import time

    g = random.Random(4)
    rows = []
    for k in range(24_000):
        t = T0 + timedelta(minutes=20 * k + g.randrange(10))
        lone = g.random() < 0.85
        rows.append((1, t, t + timedelta(minutes=g.randrange(1, 30) if lone else g.randrange(30, 300)), 1 if lone else 2, [2 * k] if lone else [2 * k, 2 * k + 1]))
    schema = "subject_id long, start_time timestamp_ntz, end_time timestamp_ntz, n_visits long, visit_ids array<long>"
    any_trip = T.TripRules(categories=(("Any", 0.0, None),))
    df = spark.createDataFrame(rows, schema).withColumn("hours", F.lit(0.0)).cache()
    df.count()
    began = time.time()
    out = T.absorb_orphans(df, any_trip).collect()
    assert time.time() - began < 15 and len(out) == sum(r[3] == 2 for r in rows) < sum(r["n_visits"] for r in out)
    few = rows[:1500]
    got = sorted((r["start_time"], r["end_time"], tuple(sorted(r["visit_ids"]))) for r in T.absorb_orphans(spark.createDataFrame(few, schema).withColumn("hours", F.lit(0.0)), any_trip).collect())
    assert got == plain_orphans([[r[1], r[2], r[4]] for r in few])


def test_orphans_move_local_clocks(spark):
    h = timedelta(hours=1)
    rows = [(1, T0 + 10 * h, T0 + 20 * h, 5, [1, 2], T0 + 12 * h, T0 + 22 * h), (1, T0 + 9 * h, T0 + 9 * h + h / 6, 1, [0], T0 + 7 * h, T0 + 8 * h)]
    df = spark.createDataFrame(rows, "subject_id long, start_time timestamp_ntz, end_time timestamp_ntz, n_visits long, visit_ids array<long>, local_start_ts timestamp_ntz, local_end_ts timestamp_ntz").withColumn("hours", F.lit(0.0))
    r = T.absorb_orphans(df, T.TripRules(categories=(("Any", 0.0, None),))).first()
    assert (r["start_time"], r["local_start_ts"], r["local_end_ts"], list(r["visit_ids"])) == (T0 + 9 * h, T0 + 7 * h, T0 + 22 * h, [0, 1, 2])


def test_trip_clocks_come_from_the_anchors(spark):
    h = timedelta(hours=1)
    east = lambda t: t + 5 * h
    rows = [(1, 1, T0, T0 + h, False, T0, T0 + h), (1, 2, T0 + 3 * h, T0 + 4 * h, True, east(T0 + 3 * h), east(T0 + 4 * h)), (1, 3, T0 + 5 * h, T0 + 6 * h, True, east(T0 + 5 * h), east(T0 + 6 * h)), (1, 4, T0 + 30 * h, T0 + 31 * h, False, T0 + 30 * h, T0 + 31 * h)]
    df = spark.createDataFrame(rows, "subject_id long, id long, start_time timestamp_ntz, end_time timestamp_ntz, away boolean, local_start_ts timestamp_ntz, local_end_ts timestamp_ntz").withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0))
    b = T.trip_bounds(T.trip_blocks(T.sequence_gaps(df).withColumn("split", F.lit(False)))).first()
    # left home at its local time; the way back took too long, so the trip ends with its last visit, on that visit's clock
    assert (b["start_time"], b["local_start_ts"], b["end_time"], b["local_end_ts"]) == (T0 + h, T0 + h, T0 + 6 * h, east(T0 + 6 * h))


def test_period_coordinate_is_that_of_most_minutes(spark):
    rows = [(1, "h", datetime(2024, m, 1).date(), lat, 0.0, 3, minutes) for m, lat, minutes in ((1, 10.0, 6000), (1, 20.0, 9000), (2, 10.0, 99_000))]
    p = H.dwell_periods(spark.createDataFrame(rows, "subject_id long, place_id string, month date, lat double, lon double, n_visits long, minutes long")).first()
    assert (p["lat"], p["n_rows"]) == (20.0, 3)


def test_spot_names(spark):
    rows = [(1.0, 2.0, n) for n in (None, None, None, "b", "a", "b", "a", "c")] + [(5.0, 5.0, None)] + [(9.0, 9.0, f"name {k:05}") for k in range(3000)]
    v = spark.createDataFrame(rows, "lat double, lon double, place_name string").withColumn("duration_minutes", F.lit(1)).withColumn("location_id", F.lit("l"))
    for c in ("start_time", "end_time", "local_start_ts"):
        v = v.withColumn(c, F.lit(T0).cast("timestamp_ntz"))
    assert {(r["lat6"], r["n_visits"], r["minutes"], r["place_name"]) for r in spots(v).collect()} == {(1.0, 8, 8, "a"), (5.0, 1, 1, None), (9.0, 3000, 3000, "name 00000")}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tracker_movements", "activities_old", "activities_new", "breadcrumbs"])
def test_a_record_is_parsed_once(spark, name):
    plan = _plan(registry.queries()[name](spark, DATA))
    assert plan.count("from_json(") == 1


def test_files_of_records_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"subject_id": 1, "startTime": "x", "visit": {}}\n')
    records = I.route_records(E.read_timeline_lines(spark, str(tmp_path), "subject_id bigint")).filter("kind = 'visit' and startTime = 'x'")
    assert _plan(records).count("from_json(") == 1 and records.count() == 1


def test_anchor_ranges_need_no_file_a_subject(spark):
    found = registry.queries()["anchor_ranges"](spark, DATA)
    assert len(found.inputFiles()) <= 8 < found.select("subject_id").distinct().count()


def test_anchor_ranges_of_a_whole_file(spark, tmp_path):
    (tmp_path / "homes.json").write_text('[\n {"lat": 1.5, "lon": 2.0, "name": "a", "end_date": "2024-01-02"},\n {"lat": 3.0, "lon": 4.0, "name": "b"}\n]\n')
    r = E.read_anchor_ranges(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(x["pos"], x["name"], x["lat"], str(x["end_date"])) for x in r] == [(0, "a", 1.5, "2024-01-02"), (1, "b", 3.0, "None")]


def test_growing_sides_of_joins_are_not_broadcast(spark):
    v, m = (registry.queries()[name](spark, DATA) for name in ("link_visits", "label_places"))
    assert "BroadcastHashJoin" not in _plan(v) + _plan(m)

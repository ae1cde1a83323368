"""Subjects cut into slices of time give the rows of subjects that are not."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dwellpath.operators import joins as J
from dwellpath.operators import slices as S
from dwellpath.operators import trips as T
from dwellpath.plans import fixtures as X
from tests.conftest import DATA, plain

T0 = datetime(2024, 1, 1)


def timeline(spark, seed, subjects=(2000, 300, 5)):
    """Visits in which times repeat; the first subject is by far the largest."""
    g, rows = random.Random(seed), []
    for s, n in enumerate(subjects):
        t = T0
        for k in range(n):
            t += timedelta(hours=g.choice([0, 0, 1, 7, 9, 30]))
            end = t + timedelta(hours=g.choice([0, 1, 3]))
            rows.append((s, s * 10_000 + k, t, end, float(g.randrange(5)), 0.0, g.random() < 0.6, t, end))
    g.shuffle(rows)
    return spark.createDataFrame(rows, "subject_id long, id long, start_time timestamp_ntz, end_time timestamp_ntz, lat double, lon double, away boolean, local_start_ts timestamp_ntz, local_end_ts timestamp_ntz")


def test_only_large_subjects_are_cut(spark):
    v = timeline(spark, 1)
    assert S.time_slices(v) is None
    cuts = S.time_slices(v, slice_rows=100).collect()
    assert {r["subject_id"] for r in cuts} == {0, 1}
    sizes = S.sliced(v, S.time_slices(v, slice_rows=100)).groupBy("subject_id", "_slice").count().collect()
    assert max(r["count"] for r in sizes) < 220 and sum(r["subject_id"] == 0 for r in sizes) >= 15


@pytest.mark.parametrize("rows", [20, 150])
def test_sequences_gaps_and_blocks(spark, rows):
    v = timeline(spark, 2)
    cuts = S.time_slices(v, slice_rows=rows)
    for make in (
        lambda c: T.visit_sequence(v, c),
        lambda c: T.sequence_gaps(v, c).drop("_slice"),
        lambda c: T.trip_blocks(T.sequence_gaps(v, c).withColumn("split", F.col("gap_us") > 8 * T.HOUR), cuts=c),
    ):
        whole = make(None)
        assert plain(make(cuts).select(*whole.columns).collect()) == plain(whole.collect())


def test_whole_chain(spark):
    v, h, w, m = (f(spark, DATA) for f in (X.visits, X.homes, X.works, X.movements))
    # one subject of all rows, whose visits then overlap, beside subjects as they are
    one = lambda df: df.withColumn("subject_id", F.lit(77).cast("long")).unionByName(df)
    v, m = one(v).cache(), one(m).cache()
    args = v, h.unionByName(h.limit(1).withColumn("subject_id", F.lit(77).cast("long"))), w, m
    whole = T.detect_trips(*args)
    assert plain(T.detect_trips(*args, slice_rows=60).select(*whole.columns).collect()) == plain(whole.collect()) and whole.count() > 10


@pytest.mark.parametrize("seed", [3, 4])
def test_nearest_record(spark, seed):
    v = timeline(spark, seed)
    probes, records = v.filter("id % 3 = 0").select("subject_id", "id", "start_time"), v.filter("id % 3 = 1 and (id < 500 or id > 900)").select("subject_id", F.col("start_time").alias("at"), (F.col("id") % 7).alias("v"))
    args = probes, records, "start_time", "at", "v", ["subject_id"]
    cuts = S.time_slices(records, "at", 40)
    assert plain(J.nearest_record(*args, cuts).select("subject_id", "id", "v").collect()) == plain(J.nearest_record(*args).select("subject_id", "id", "v").collect())


def test_nearest_record_keeps_equal_probes_apart(spark):
    p = spark.createDataFrame([(1, "a", T0)] * 3, "s long, x string, t timestamp_ntz")
    r = spark.createDataFrame([(1, T0 + timedelta(hours=1), 60)] * 2, "s long, at timestamp_ntz, v int")
    assert [tuple(x) for x in J.nearest_record(p, r, "t", "at", "v", ["s"]).select("x", "v").collect()] == [("a", 60)] * 3


def test_bridges_equal_brute_force_and_many_at_once_are_quick(spark):
    g = random.Random(6)
    v = timeline(spark, 5, (150, 150))
    near = lambda t: t + timedelta(seconds=g.randrange(-700, 700))
    visits = sorted(v.collect(), key=lambda r: (r["subject_id"], r["start_time"], r["id"]))
    moves = [(a["subject_id"], near(a["end_time"]), near(b["start_time"])) for a, b in zip(visits, visits[1:]) if g.random() < 0.7] + [(0, None, T0), (0, T0, None)]
    m = spark.createDataFrame(moves, "subject_id long, start_time timestamp_ntz, end_time timestamp_ntz")
    five = timedelta(minutes=5)
    want = set()
    for a, b in zip(visits, visits[1:]):
        if a["subject_id"] == b["subject_id"] and any(s == a["subject_id"] and x and y and abs(x - a["end_time"]) <= five and abs(y - b["start_time"]) <= five for s, x, y in moves):
            want.add((b["subject_id"], b["id"]))
    got = [tuple(r) for r in T.bridged_gaps(v, m).collect()]
    assert set(got) == want and len(got) == len(want) > 20
    at = lambda shift: F.timestamp_add("MILLISECOND", (F.col("id") * 75 + shift).cast("int"), F.lit(T0).cast("timestamp_ntz"))
    many = spark.range(32_000).select(F.lit(1).cast("long").alias("subject_id"), "id", at(0).alias("start_time"), at(40).alias("end_time"))
    T.bridged_gaps(many.limit(10), many.limit(10)).count()
    began = time.time()
    assert T.bridged_gaps(many, many.filter("id % 2 = 0")).count() == 31_999 and time.time() - began < 15

"""Trips from ordered visits: anchors, gaps, blocks, bounds, categories, names.

A block of visits away from home and work is found with lag and lead alone: an anchor ends any
block and an away visit always lies in one, so every decision looks one visit back or ahead.
Everything up to the categories shares one shuffle by subject, or by slices of a subject's time where
a subject is too large for one task (``slices``).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.functions.geo import haversine_km
from dwellpath.operators.joins import between_micros, bucket, micros, shuffled
from dwellpath.operators.slices import SLICE, SLICE_ROWS, keys, neighbours, running_count, sliced, time_slices

HOUR = 3_600_000_000
MINUTE = 60_000_000
_DAY, _SHORT = timedelta(hours=24), timedelta(minutes=30)


@dataclass(frozen=True)
class TripRules:
    """Thresholds and categories; categories are (name, at least hours, below hours or None), first match wins."""

    home_km: float = 20.0
    work_km: float = 1.0
    min_distance_km: float = 80.0
    max_gap_hours: float = 8.0
    extended_gap_hours: float = 24.0
    extended_gap_min_distance_km: float = 80.0
    categories: tuple = field(default=(("Day Trip", 4.0, 16.0), ("Short Trip", 16.0, 96.0), ("Long Trip", 96.0, None)))


ORDER = ("start_time", "id")


def visit_sequence(visits: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Visits numbered by (start, id) within their subject. ``cuts``: of subjects too large for one task, see ``slices``."""
    return running_count(visits, "rn", F.lit(True), ORDER, cuts).drop(SLICE)


def active_anchor(df: DataFrame, ranges: DataFrame, day: Column, prefix: str) -> DataFrame:
    """``df`` with {prefix}_lat, {prefix}_lon, {prefix}_place of the anchor that covers ``day``.

    Of several, the one that starts last; of these, the one listed first. Ranges are gathered per subject (a subject has a handful) and picked from in place,
    so ``df`` is joined once and no row multiplies.
    """
    r = ranges.groupBy("subject_id").agg(
        F.sort_array(
            F.collect_list(F.struct(F.coalesce(F.col("start_date"), F.lit("0001-01-01").cast("date")).alias("s"), (-F.col("pos")).alias("p"), F.col("end_date").alias("e"), "lat", "lon", "place_id", "name")),
            asc=False,
        ).alias("_ranges")
    )
    d = df.withColumn("_day", day).join(r, "subject_id", "left")
    d = d.withColumn("_hit", F.get(F.expr("filter(_ranges, x -> x.s <= _day and (x.e is null or x.e >= _day))"), 0))
    return d.select(*df.columns, *[F.col(f"_hit.{c}").alias(f"{prefix}_{n}") for c, n in (("lat", "lat"), ("lon", "lon"), ("place_id", "place"), ("name", "name"))])


def classify_visits(visits: DataFrame, homes: DataFrame, works: DataFrame, rules: TripRules = TripRules()) -> DataFrame:
    """Adds at_home, at_work and away, by the anchors active on the UTC day of the start."""
    v = active_anchor(visits, homes, F.to_date("start_time"), "home")
    v = active_anchor(v, works, F.to_date("start_time"), "work")
    home = F.coalesce(haversine_km("lat", "lon", "home_lat", "home_lon") <= rules.home_km, F.lit(False))
    work = F.coalesce(F.col("place_id") == F.col("work_place"), F.lit(False)) | F.coalesce(haversine_km("lat", "lon", "work_lat", "work_lon") <= rules.work_km, F.lit(False))
    return v.withColumn("at_home", home).withColumn("at_work", work).withColumn("away", ~(F.col("at_home") | F.col("at_work")))


def sequence_gaps(visits: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """Each visit with the visit before it: prev_* columns and gap_us (which may be negative)."""
    before = [c for c in ("id", "end_time", "lat", "lon", "away", "local_end_ts") if c in visits.columns]
    v = neighbours(visits, ORDER, {f"prev_{c}": c for c in before}, cuts=cuts)
    return v.withColumn("gap_us", between_micros("prev_end_time", "start_time"))


def bridges(gaps: DataFrame, movements: DataFrame, minutes: int = 5) -> DataFrame:
    """The keys and id of gaps with a movement that starts within the minutes of the visit before and ends within those of this one.

    Both times are in the key of the join, as buckets twice as wide as the minutes, so a gap looks
    at the few movements that start and end near it, and at none further once it has found one.
    """
    near = minutes * MINUTE
    by = keys(gaps)
    at = lambda t: F.array_distinct(F.array(bucket(F.col(t) - near, 2 * near), bucket(F.col(t) + near, 2 * near)))
    g = gaps.filter("prev_id is not null and prev_end_time is not null").select(*by, "id", micros("prev_end_time").alias("_a"), micros("start_time").alias("_z"))
    g = g.withColumn("_x", F.explode(at("_a"))).withColumn("_y", F.explode(at("_z")))
    m = movements.filter("start_time is not null and end_time is not null").select(F.col("subject_id").alias("_s"), micros("start_time").alias("_ma"), micros("end_time").alias("_mz"))
    m = m.withColumn("_mx", bucket(F.col("_ma"), 2 * near)).withColumn("_my", bucket(F.col("_mz"), 2 * near))
    on = [F.col("subject_id") == F.col("_s"), F.col("_x") == F.col("_mx"), F.col("_y") == F.col("_my"), F.abs(F.col("_a") - F.col("_ma")) <= near, F.abs(F.col("_z") - F.col("_mz")) <= near]
    return g.join(shuffled(m), on, "left_semi").select(*by, "id").distinct()


def with_bridges(gaps: DataFrame, movements: DataFrame, minutes: int = 5, least_us: int = 0) -> DataFrame:
    """Visits with their gaps, and ``bridged``: whether a movement leads from the visit before to this one.

    Gaps shorter than ``least_us`` are not asked about and count as not bridged; of the others a
    subject has no more than its years hold, so they are gathered by subject and the layout of the
    visits stays as it is for what follows.
    """
    by = keys(gaps)
    found = bridges(gaps.filter(F.col("gap_us") >= least_us), movements, minutes).groupBy(*by).agg(F.collect_set("id").alias("_bridged"))
    asked = F.when(F.col("gap_us") >= least_us, F.array_contains("_bridged", F.col("id")))
    return gaps.join(found, by, "left").withColumn("bridged", F.coalesce(asked, F.lit(False))).drop("_bridged")


def bridged_gaps(visits: DataFrame, movements: DataFrame, minutes: int = 5, cuts: DataFrame | None = None) -> DataFrame:
    """(subject_id, id) of visits to which a movement leads from the visit before."""
    gaps = sequence_gaps(visits.select("subject_id", "id", "start_time", "end_time"), cuts)
    return bridges(gaps, movements, minutes).select("subject_id", "id")


def gap_splits(visits: DataFrame, movements: DataFrame, homes: DataFrame, rules: TripRules = TripRules(), cuts: DataFrame | None = None) -> DataFrame:
    """Classified visits with prev_* columns and ``split``: whether the gap before ends a block."""
    # shorter gaps never split, bridged or not
    g = with_bridges(sequence_gaps(visits, cuts), movements, least_us=int(rules.max_gap_hours * HOUR))
    g = active_anchor(g, homes, F.to_date("prev_end_time"), "gap_home")
    far = lambda lat, lon: F.coalesce(haversine_km(lat, lon, "gap_home_lat", "gap_home_lon") >= rules.extended_gap_min_distance_km, F.lit(False))
    split = (
        F.when(F.col("prev_id").isNull() | F.col("bridged"), False)
        .when(F.col("gap_us") < rules.max_gap_hours * HOUR, False)
        .when((F.col("gap_us") < rules.extended_gap_hours * HOUR) & far("prev_lat", "prev_lon") & far("lat", "lon"), False)
        .otherwise(True)
    )
    return g.withColumn("split", split)


def trip_blocks(splits: DataFrame, rules: TripRules = TripRules(), cuts: DataFrame | None = None) -> DataFrame:
    """Away visits with their block number and the times of the anchors that bound the block.

    ``departed`` is the end of the anchor just before the block and ``returned`` the start of the
    anchor just after it, each only within the largest gap; with the anchors' local clocks beside
    them where visits have local clocks.
    """
    first = F.col("away") & (F.col("prev_away").isNull() | ~F.col("prev_away") | F.col("split"))
    b = running_count(splits, "block", first, ORDER, cuts)
    local = "local_start_ts" in splits.columns
    b = neighbours(b, ORDER, ahead={"next_away": "away", "next_start": "start_time"} | ({"next_local": "local_start_ts"} if local else {}), cuts=cuts)
    limit = rules.max_gap_hours * HOUR
    left = first & ~F.col("prev_away") & (F.col("gap_us") <= limit)
    back = ~F.col("next_away") & (between_micros("end_time", "next_start") <= limit)
    b = b.withColumn("departed", F.when(left, F.col("prev_end_time"))).withColumn("returned", F.when(back, F.col("next_start")))
    if local:
        b = b.withColumn("departed_local", F.when(left, F.col("prev_local_end_ts"))).withColumn("returned_local", F.when(back, F.col("next_local")))
    return b.filter("away").drop(SLICE)


def trip_bounds(blocks: DataFrame) -> DataFrame:
    """One row a block: door-to-door start and end, their local clocks where visits have them, centre, visit ids in order.

    A side without an anchor takes the clock of the visit it is taken from: the first visit, or of
    those that end last the first.
    """
    order = F.struct("start_time", "id")
    local = "departed_local" in blocks.columns
    latest = F.struct((-micros("end_time")).alias("e"), "start_time", "id")
    clocks = [F.min_by("departed_local", order).alias("_dl"), F.min_by("local_start_ts", order).alias("_fl"), F.max_by("returned_local", order).alias("_rl"), F.min_by("local_end_ts", latest).alias("_ll")] if local else []
    g = blocks.groupBy("subject_id", "block").agg(
        F.min_by("departed", order).alias("departed"),
        F.min("start_time").alias("first_start"),
        F.max_by("returned", order).alias("returned"),
        F.max("end_time").alias("last_end"),
        *clocks,
        F.avg("lat").alias("lat"),
        F.avg("lon").alias("lon"),
        F.count(F.lit(1)).alias("n_visits"),
        # a block is one person's stretch between two anchors
        F.transform(F.sort_array(F.collect_list(order)), lambda x: x["id"]).alias("visit_ids"),
    )
    own = lambda anchor, a, b, name: F.when(F.col(anchor).isNotNull(), F.col(a)).otherwise(F.col(b)).alias(name)
    clocks = [own("departed", "_dl", "_fl", "local_start_ts"), own("returned", "_rl", "_ll", "local_end_ts")] if local else []
    return g.select("subject_id", "block", F.coalesce("departed", "first_start").alias("start_time"), F.coalesce("returned", "last_end").alias("end_time"), *clocks, "lat", "lon", "n_visits", "visit_ids")


def trip_category(hours: Column, rules: TripRules = TripRules()) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in reversed(rules.categories):
        test = hours >= (low or 0)
        out = F.when(test if high is None else test & (hours < high), F.lit(name)).otherwise(out)
    return out


def trip_distance(bounds: DataFrame, homes: DataFrame, rules: TripRules = TripRules()) -> DataFrame:
    """Blocks far enough from the home active on the trip's first UTC day; blocks without a home stay."""
    b = active_anchor(bounds, homes, F.to_date("start_time"), "home")
    b = b.withColumn("distance_km", haversine_km("lat", "lon", "home_lat", "home_lon"))
    return b.filter(F.col("distance_km").isNull() | (F.col("distance_km") >= rules.min_distance_km)).drop("home_lat", "home_lon", "home_place", "home_name")


def trip_categories(trips: DataFrame, rules: TripRules = TripRules()) -> DataFrame:
    t = trips.withColumn("hours", between_micros("start_time", "end_time") / HOUR)
    return t.withColumn("category", trip_category(F.col("hours"), rules)).filter(F.col("category").isNotNull())


def _absorbed(trips: list[dict]) -> list[dict]:
    """One island's trips, by start and end, after its orphans are merged.

    Orphans come in order of time. The nearest trip that ended before is the top of a heap by end,
    to which trips move as their ends are passed; the nearest that starts after is the next one that
    hasn't begun. Merges only lengthen trips, so an old entry of a heap is told by its end.
    """
    lone = lambda t: t["n_visits"] == 1 and t["end_time"] - t["start_time"] < _SHORT
    kept = [t | {"visit_ids": deque(t["visit_ids"])} for t in trips if not lone(t)]
    open_ends = [(t["end_time"], k) for k, t in enumerate(kept)]
    heapify(open_ends)
    ended: list[tuple] = []  # (end reversed, start, place)
    following = 0
    epoch = datetime(1970, 1, 1)
    for orphan in filter(lone, trips):
        at = orphan["start_time"]
        while open_ends and open_ends[0][0] < at:
            end, k = heappop(open_ends)
            if kept[k]["end_time"] == end:
                heappush(ended, (epoch - end, kept[k]["start_time"], k))
        while following < len(kept) and kept[following]["start_time"] <= at:
            following += 1
        while ended and epoch - ended[0][0] != kept[ended[0][2]]["end_time"]:
            heappop(ended)
        near = [(at - kept[k]["end_time"], kept[k]["start_time"], k) for _, _, k in ended[:1]]
        near += [(kept[following]["start_time"] - at, kept[following]["start_time"], following)] if following < len(kept) else []
        # of equally near trips the one that began earlier
        gap, _, k = min(near, default=(_DAY, None, None))
        if gap >= _DAY:
            continue
        trip = kept[k]
        for c, bound in (("start_time", min), ("end_time", max)):
            was = trip[c]
            trip[c] = bound(was, orphan[c])
            local = f"local_{c.split('_')[0]}_ts"
            if trip[c] != was and local in trip:
                trip[local] = orphan[local]
            if c == "end_time" and trip[c] != was:
                heappush(open_ends, (trip[c], k))
        if at > trip["start_time"]:
            trip["visit_ids"].extend(orphan["visit_ids"])
        else:
            trip["visit_ids"].extendleft(reversed(orphan["visit_ids"]))
        trip["n_visits"] += 1
    return [t | {"visit_ids": list(t["visit_ids"]), "hours": (t["end_time"] - t["start_time"]).total_seconds() / 3600} for t in kept]


def absorb_orphans(trips: DataFrame, rules: TripRules = TripRules()) -> DataFrame:
    """Merge single-visit trips under half an hour into the nearest trip less than a day from their start.

    Merges change the gaps that follow, so trips (not visits) are gone through in order, but only
    within islands: where a subject is a day or more without a trip, nothing merges across. Ties
    go to the earlier trip; an orphan without a near trip is dropped. Local clocks move with the times.
    """
    cols = ["subject_id", "start_time", "end_time", "n_visits", "visit_ids", "hours", *[c for c in ("local_start_ts", "local_end_ts") if c in trips.columns]]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda t: (t["start_time"], t["end_time"], t["visit_ids"]))
        return pa.Table.from_pylist(_absorbed(rows), schema=table.schema).select(cols)

    schema = trips.select(*cols).schema
    w = Window.partitionBy("subject_id").orderBy("start_time", "end_time")
    t = trips.select(*cols).withColumn("_until", F.max("end_time").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    apart = F.coalesce(between_micros("_until", "start_time") >= 24 * HOUR, F.lit(False))
    t = t.withColumn("_island", F.sum(apart.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_until")
    merged = t.groupBy("subject_id", "_island").applyInArrow(run, schema)
    return merged.withColumn("category", trip_category(F.col("hours"), rules))


def detect_trips(visits: DataFrame, homes: DataFrame, works: DataFrame, movements: DataFrame, rules: TripRules = TripRules(), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The whole chain: one row a trip with subject, times, category, visit ids and trip_id."""
    cuts = time_slices(visits, slice_rows=slice_rows)
    away = classify_visits(sliced(visits, cuts), homes, works, rules)
    blocks = trip_blocks(gap_splits(away, movements, homes, rules, cuts), rules, cuts)
    trips = trip_categories(trip_distance(trip_bounds(blocks), homes, rules), rules)
    return dedupe_trips(trips).withColumn("trip_id", F.concat_ws("-", "subject_id", micros("start_time"), micros("end_time")))


def dedupe_trips(trips: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One trip for each (subject, start, end), the first block's; stored trips stay as they are."""
    w = Window.partitionBy("subject_id", "start_time", "end_time").orderBy("block")
    t = trips.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return t if stored is None else t.join(stored.select("subject_id", "start_time", "end_time"), ["subject_id", "start_time", "end_time"], "left_anti")


def trip_visits(trips: DataFrame) -> DataFrame:
    """The bridge: trip_id, visit_id."""
    return trips.select("trip_id", "subject_id", F.explode("visit_ids").alias("visit_id")).distinct()


def located(trip_visits: DataFrame, visits: DataFrame, locations: DataFrame) -> DataFrame:
    """The visits of trips with their location and its names, for names, cities and primary locations alike."""
    v = visits.select("subject_id", F.col("id").alias("visit_id"), "start_time", "location_id")
    return trip_visits.join(v, ["subject_id", "visit_id"]).join(locations.select("location_id", "city", "county", "state", "country"), "location_id", "left")


def trip_names(located: DataFrame) -> DataFrame:
    """trip_id and display_name by the fewest places that cover the trip."""
    sets = located.groupBy("trip_id").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("city", "county", "state", "country")])
    n = lambda c: F.size(F.col(c))
    one = lambda c: F.get(F.col(c), 0)
    name = (
        F.when(n("city") == 1, one("city"))
        .when((n("county") == 1) & (n("city") <= 3), one("county"))
        .when(n("state") == 1, one("state"))
        .when(n("country") == 1, one("country"))
        .when(n("country") == 0, F.lit("Unknown Location"))
        .when(n("country") <= 3, F.array_join("country", ", "))
        .otherwise(F.concat(n("country").cast("string"), F.lit(" Countries")))
    )
    return sets.select("trip_id", name.alias("display_name"))


def trip_cities(located: DataFrame) -> DataFrame:
    return located.groupBy("trip_id").agg(F.sort_array(F.collect_set("city")).alias("cities"))


def trip_primary_location(located: DataFrame) -> DataFrame:
    """The most frequent location of a trip; of equals the one seen first."""
    c = located.filter("location_id is not null").groupBy("trip_id", "location_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("start_time", "visit_id")).alias("first"))
    best = F.struct((-F.col("n")).alias("n"), "first", "location_id")
    return c.groupBy("trip_id").agg(F.min(best)["location_id"].alias("primary_location_id"))


def trip_summary(trips: DataFrame, trip_visits: DataFrame, rules: TripRules = TripRules()) -> DataFrame:
    """Trips and visits by category, in the rules' order."""
    place = F.lit(len(rules.categories))
    for k, (name, _, _) in reversed(list(enumerate(rules.categories))):
        place = F.when(F.col("category") == name, F.lit(k)).otherwise(place)
    joined = trips.join(trip_visits.groupBy("trip_id").agg(F.count(F.lit(1)).alias("v")), "trip_id", "left")
    return joined.groupBy("category").agg(F.count(F.lit(1)).alias("n_trips"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_visits")).withColumn("place", place).orderBy("place")


def top_destinations(trip_cities: DataFrame, n: int = 10) -> DataFrame:
    c = trip_cities.select(F.explode("cities").alias("city")).groupBy("city").agg(F.count(F.lit(1)).alias("n_trips"))
    return c.orderBy(F.col("n_trips").desc(), "city").limit(n)

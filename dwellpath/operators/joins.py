"""Join helpers for times: near in time, overlapping in time, nearest in time.

Each turns a range condition into an equality on a time bucket, so that the join shuffles by
(key, bucket) instead of comparing all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(t) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(t) if isinstance(t, str) else t)


def between_micros(a, b) -> Column:
    return micros(b) - micros(a)


def bucket(t: Column, width_us: int) -> Column:
    return F.floor(t / F.lit(width_us)).cast("long")


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, as the other does.

    Spark judges a table by the size of its files, in which a few columns of well packed rows count
    next to nothing, and would send it through the driver to every executor.
    """
    return side.hint("merge")


def near_in_time(left: DataFrame, right: DataFrame, left_t: str, right_t: str, by: list[str], within_us: int, place: tuple[tuple[str, str], tuple[str, str], float] | None = None) -> DataFrame:
    """Join rows of one key whose times are at most ``within_us`` apart, edges included.

    Buckets are twice that wide: a right row has one, a left row at most two, so no pair comes
    twice. The sides may share the ``by`` columns only. ``place``: (lat, lon) of the left, of the
    right, and metres; rows then meet only in cells of about that size, and no pair within the metres is missed.
    """
    width = max(1, 2 * within_us)
    lo, hi = bucket(micros(left_t) - within_us, width), bucket(micros(left_t) + within_us, width)
    a = left.withColumn("_b", F.explode(F.when(lo == hi, F.array(lo)).otherwise(F.array(lo, hi))))
    b = _own_names(right, by).withColumn("_c", bucket(micros(right_t), width))
    on = [F.col(c) == F.col(f"_r_{c}") for c in by] + [F.col("_b") == F.col("_c")]
    if place is not None:
        here, there, metres = place
        a, b = with_cells_near(a, *here, metres), with_cell(b, *there, metres)
        on += [F.col("_row") == F.col("_r_row"), F.col("_col") == F.col("_r_col")]
    on.append(F.abs(micros(left_t) - micros(right_t)) <= within_us)
    return a.join(shuffled(b), on).drop("_b", "_c", "_row", "_col", "_r_row", "_r_col", *[f"_r_{c}" for c in by])


#: Metres of a degree of latitude at least, on the sphere and the spheroid.
METRES_A_DEGREE = 110_500.0


def _height(metres: float) -> float:
    """Degrees of a cell: a little over twice the metres."""
    return 2.001 * metres / METRES_A_DEGREE


def _columns(row: Column, metres: float) -> Column:
    """Cells round the earth in a row: each is as wide in metres as high where the row is narrowest; rows within a degree of a pole have one."""
    h = _height(metres)
    far = F.abs((row + 0.5) * h - 90) + h / 2
    return F.when(far > 89, 1).otherwise(F.floor(F.cos(F.radians(far)) * (360 / h))).cast("long")


def with_cell(df: DataFrame, lat: str, lon: str, metres: float) -> DataFrame:
    """``df`` with the cell of each point (_r_row, _r_col), in a grid whose cells are over twice the metres high and wide."""
    d = df.withColumn("_r_row", F.floor((F.col(lat) + 90) / _height(metres)).cast("long")).withColumn("_n", _columns(F.col("_r_row"), metres))
    return d.withColumn("_r_col", F.pmod(F.floor((F.col(lon) + 180) / 360 * F.col("_n")).cast("long"), F.col("_n"))).drop("_n")


def with_cells_near(df: DataFrame, lat: str, lon: str, metres: float) -> DataFrame:
    """A row of ``df`` for each cell (_row, _col) that may have points within the metres: mostly one or two, six at most."""
    reach = metres / METRES_A_DEGREE
    at = lambda d: F.floor((F.col(lat) + 90 + d) / _height(metres)).cast("long")
    d = df.withColumn("_wide", reach / F.cos(F.radians(F.least(F.abs(lat) + reach, F.lit(89.9)))))
    d = d.withColumn("_row", F.explode(F.array_distinct(F.array(at(-reach), at(reach))))).withColumn("_n", _columns(F.col("_row"), metres))
    for name, sign in (("_a", -1), ("_z", 1)):
        d = d.withColumn(name, F.floor((F.col(lon) + 180 + sign * F.col("_wide")) / 360 * F.col("_n")).cast("long"))
    some = F.array_distinct(F.transform(F.array("_a", F.least(F.col("_a") + 1, F.col("_z")), "_z"), lambda c: F.pmod(c, F.col("_n"))))
    return d.withColumn("_col", F.explode(some)).drop("_wide", "_n", "_a", "_z")


def _own_names(right: DataFrame, by: list[str]) -> DataFrame:
    """``right`` with its keys renamed, so that both sides can come from one table."""
    return right.withColumnsRenamed({c: f"_r_{c}" for c in by})


#: A span over more buckets than this goes to buckets COARSE times as wide.
LONG, COARSE = 32, 1024


def overlapping(left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width_us: int = 86_400_000_000) -> DataFrame:
    """Join rows of one key whose open intervals overlap; the sides may share ``by`` columns only.

    Two short spans meet in a bucket that both touch. A long span, as one with a far end date, meets
    all others in wide buckets, so no row is copied more often than its length in wide buckets.
    A pair is kept in the first bucket that both touch.
    """
    def spread(df: DataFrame, span: tuple[str, str], short: tuple[int, ...], long: tuple[int, ...], first: str) -> DataFrame:
        at = lambda width: (bucket(micros(span[0]), width), F.greatest(bucket(micros(span[0]), width), bucket(micros(span[1]), width)))
        (lo, hi), (wide_lo, wide_hi) = at(width_us), at(width_us * COARSE)
        put = lambda kind, a, b: F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("b"), a.alias("first")))
        of_short = F.concat(*[put(k, lo, hi) if k == 0 else put(k, wide_lo, wide_hi) for k in short])
        of_long = F.concat(*[put(k, wide_lo, wide_hi) for k in long])
        return df.withColumn(first, F.explode(F.when(hi - lo > LONG, of_long).otherwise(of_short)))

    # kinds: 0 short with short, 1 a long left with any right, 2 a short left with a long right
    a, b = spread(left, left_span, (0, 2), (1,), "_x"), spread(_own_names(right, by), right_span, (0, 1), (1, 2), "_y")
    on = [F.col(c) == F.col(f"_r_{c}") for c in by] + [F.col("_x.kind") == F.col("_y.kind"), F.col("_x.b") == F.col("_y.b"), F.col("_x.b") == F.greatest("_x.first", "_y.first")]
    joined = a.join(shuffled(b), [*on, F.col(left_span[0]) < F.col(right_span[1]), F.col(left_span[1]) > F.col(right_span[0])])
    return joined.drop("_x", "_y", *[f"_r_{c}" for c in by])


def nearest_record(probes: DataFrame, records: DataFrame, probe_t: str, record_t: str, value: str, by: list[str], parts: DataFrame | None = None) -> DataFrame:
    """``probes`` with the ``value`` of the record nearest in time; of two as near, the earlier.

    Both are ordered together once, each probe as a whole, and values are carried from either side:
    no pair is made and nothing is joined back, so probes need no id and equal ones stay apart.
    ``parts``: (key, cuts) of keys that are too large for one task; such a key is ordered in slices
    of time, and a slice learns the nearest records outside from one row a slice.
    """
    keys = [F.col(c) for c in by]
    width = records.schema[value].dataType
    row = F.struct(*[F.col(c).alias(c) for c in probes.columns])
    p = probes.select(*keys, F.col(probe_t).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(width).alias("_v"), row.alias("_row"))
    r = records.select(*keys, F.col(record_t).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_v"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"))
    mark = F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    u = p.unionByName(r).withColumn("_mark", mark)
    on = by
    if parts is not None:
        # one row for each key of several slices
        u = u.join(F.broadcast(parts.select(*by, F.col("cuts").alias("_cuts"))), by, "left")
        u = u.withColumn("_slice", F.when(F.col("_cuts").isNotNull(), F.coalesce(F.size(F.filter("_cuts", lambda c: c <= micros("_t"))), F.lit(0))).otherwise(0))
        on = [*by, "_slice"]
    order = ("_t", "_kind", "_v")
    earlier = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # the rows after one are those before it in reversed order: a running value, not a new search for each row
    later = Window.partitionBy(*on).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = u.withColumn("_before", F.last("_mark", ignorenulls=True).over(earlier)).withColumn("_after", F.last("_mark", ignorenulls=True).over(later))
    if parts is not None:
        ends = u.filter("_cuts is not null").groupBy(*on).agg(F.max("_mark").alias("_z"), F.min("_mark").alias("_a"))
        slices = Window.partitionBy(*by).orderBy("_slice")
        past, future = slices.rowsBetween(Window.unboundedPreceding, -1), slices.rowsBetween(1, Window.unboundedFollowing)
        carried = ends.select(*on, F.last("_z", ignorenulls=True).over(past).alias("_past"), F.first("_a", ignorenulls=True).over(future).alias("_future"))
        found = found.join(F.broadcast(carried), on, "left")  # one row a slice
        found = found.withColumn("_before", F.coalesce("_before", "_past")).withColumn("_after", F.coalesce("_after", "_future"))
    gap_before, gap_after = between_micros(F.col("_before.t"), F.col("_t")), between_micros(F.col("_t"), F.col("_after.t"))
    pick = F.when(F.col("_before").isNull(), F.col("_after.v")).when(F.col("_after").isNull() | (gap_before <= gap_after), F.col("_before.v")).otherwise(F.col("_after.v"))
    return found.filter("_kind = 1").select("_row.*", pick.alias(value))

"""Ordered looks back and ahead over subjects of any size.

A window by subject puts a subject into one task. Where a subject has more than ``SLICE_ROWS`` rows
its time is cut into slices of about that many; windows then run by (subject, slice), and what a
slice needs from outside, the row before it, the row after it or a count so far, comes from one row
a slice. Results are the same however a subject is cut. Rows of one instant are never parted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellpath.operators.joins import micros
from dwellpath.sources.scratch import staged

SLICE_ROWS = 1_000_000
#: A subject is cut into at most this many slices.
MAX_SLICES = 1_000
SUBJECT, SLICE = "subject_id", "_slice"


def time_slices(rows: DataFrame, t: str = "start_time", slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """(subject_id, cuts) of subjects with more rows than a slice should have; None where there is no such subject.

    The cuts are written down, as approximate quantiles of one time are not those of another.
    """
    large = rows.groupBy(SUBJECT).agg(F.count(t).alias("n")).filter(F.col("n") > slice_rows)
    if large.isEmpty():
        return None
    # no more subjects than all rows hold slices
    of_large = rows.join(F.broadcast(large), SUBJECT)
    marks = F.percentile_approx(micros(t), [k / MAX_SLICES for k in range(1, MAX_SLICES)], 20 * MAX_SLICES)
    g = of_large.groupBy(SUBJECT, "n").agg(marks.alias("marks"))
    n = F.least(F.lit(MAX_SLICES), F.ceil(F.col("n") / slice_rows)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.get("marks", (k * MAX_SLICES / n).cast("int") - 1))
    return staged(g.select(SUBJECT, F.array_distinct(chosen).alias("cuts")))


def sliced(rows: DataFrame, cuts: DataFrame | None, t: str = "start_time") -> DataFrame:
    """``rows`` with the number of their slice; without cuts, as they are."""
    if cuts is None or SLICE in rows.columns:
        return rows
    at = micros(t)
    number = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= at)), F.lit(0))
    # one row for each subject of several slices
    c = F.broadcast(cuts.select(SUBJECT, F.col("cuts").alias("_cuts")))
    return rows.join(c, SUBJECT, "left").withColumn(SLICE, F.when(F.col("_cuts").isNotNull(), number).otherwise(0)).drop("_cuts")


def keys(rows: DataFrame) -> list[str]:
    """What windows over these rows are partitioned by."""
    return [SUBJECT, SLICE] if SLICE in rows.columns else [SUBJECT]


def _of_large(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(cuts.select(SUBJECT)), SUBJECT, "left_semi")


def _over_slices():
    return Window.partitionBy(SUBJECT).orderBy(SLICE)


def neighbours(rows: DataFrame, order: tuple[str, ...], back: dict[str, str] | None = None, ahead: dict[str, str] | None = None, cuts: DataFrame | None = None) -> DataFrame:
    """``rows`` with columns of the row before (``back``: new name to column) and of the row after (``ahead``)."""
    back, ahead = back or {}, ahead or {}
    d = sliced(rows, cuts)
    w = Window.partitionBy(*keys(d)).orderBy(*order)
    out = d
    if cuts is not None:
        out = out.withColumn("_head", F.row_number().over(w) == 1).withColumn("_tail", F.lead(F.lit(True)).over(w).isNull())
    for name, c in back.items():
        out = out.withColumn(name, F.lag(c).over(w))
    for name, c in ahead.items():
        out = out.withColumn(name, F.lead(c).over(w))
    if cuts is None:
        return out
    taken = lambda names: F.struct(F.lit(True).alias("_"), *[F.col(c).alias(name) for name, c in names.items()])
    ends = _of_large(d, cuts).groupBy(SUBJECT, SLICE).agg(F.max_by(taken(back), F.struct(*order)).alias("_z"), F.min_by(taken(ahead), F.struct(*order)).alias("_a"))
    carried = ends.select(SUBJECT, SLICE, F.lag("_z").over(_over_slices()).alias("_from"), F.lead("_a").over(_over_slices()).alias("_to"))
    out = out.join(F.broadcast(carried), [SUBJECT, SLICE], "left")  # one row a slice
    for edge, other, names in (("_head", "_from", back), ("_tail", "_to", ahead)):
        for name in names:
            out = out.withColumn(name, F.when(F.col(edge), F.col(f"{other}.{name}")).otherwise(F.col(name)))
    return out.drop("_head", "_tail", "_from", "_to")


def running_count(rows: DataFrame, name: str, flag: Column, order: tuple[str, ...], cuts: DataFrame | None = None) -> DataFrame:
    """``rows`` with the number of flagged rows up to each."""
    d = sliced(rows, cuts)
    one = F.coalesce(flag.cast("int"), F.lit(0)).cast("long")
    w = Window.partitionBy(*keys(d)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumn(name, F.sum(one).over(w))
    if cuts is None:
        return out
    totals = _of_large(d, cuts).groupBy(SUBJECT, SLICE).agg(F.sum(one).alias("_n"))
    so_far = totals.select(SUBJECT, SLICE, F.sum("_n").over(_over_slices().rowsBetween(Window.unboundedPreceding, -1)).alias("_so_far"))
    out = out.join(F.broadcast(so_far), [SUBJECT, SLICE], "left")  # one row a slice
    return out.withColumn(name, F.col(name) + F.coalesce("_so_far", F.lit(0))).drop("_so_far")

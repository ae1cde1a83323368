"""Parity cells against the ray cast over the whole outline, also at vertices, on edges and at corners of cells."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellpath.functions.geo import strictly_inside
from dwellpath.operators import cells as C
from dwellpath.operators import geocode as G

POLY = "array<array<array<struct<lon:double,lat:double>>>>"


def pts(ring):
    return [{"lon": float(x), "lat": float(y)} for x, y in ring]


def star(g, x, y, r, n, step=None):
    """A ring round a point; with ``step`` its vertices lie on multiples of it, so that cells meet them at corners."""
    out = []
    for k in range(n):
        far = r * g.uniform(0.3, 1)
        p = x + far * math.cos(2 * math.pi * k / n), y + far * math.sin(2 * math.pi * k / n)
        out.append(tuple(round(v / step) * step for v in p) if step else p)
    return out


def check(spark, shapes, points):
    b = spark.createDataFrame([(k, 2, "n", None, s) for k, s in enumerate(shapes)], f"osm_id long, level int, name string, name_en string, polygons {POLY}").cache()
    p = spark.createDataFrame([(float(y), float(x)) for x, y in points], "lat6 double, lon6 double").distinct().cache()
    got = {(r["osm_id"], r["lat6"], r["lon6"]) for r in G.point_in_boundary(p, b).collect()}
    plain = p.crossJoin(b).filter(strictly_inside(F.col("lon6"), F.col("lat6"), F.col("polygons")))
    want = {(r["osm_id"], r["lat6"], r["lon6"]) for r in plain.collect()}
    assert got == want
    return b, got


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_equal_the_ray_cast(spark, seed):
    g = random.Random(seed)
    shapes = [[[pts(star(g, g.uniform(-20, 20), g.uniform(-20, 20), g.choice([0.1, 1, 7, 30]), g.choice([3, 5, 40, 400])))]] for _ in range(12)]
    shapes.append([[pts([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), pts([(4, 4), (6, 4), (6, 6), (4, 6)])], [pts([(20, 0), (30, 0), (25, 10)])]])
    points = [(g.uniform(-40, 40), g.uniform(-40, 40)) for _ in range(300)] + [(g.uniform(-2, 2), g.uniform(-2, 2)) for _ in range(100)]
    _, got = check(spark, shapes, points)
    assert len(got) > 50


@pytest.mark.parametrize("seed", [4, 5])
def test_vertices_and_edges_on_cell_corners(spark, seed):
    """All coordinates are multiples of an eighth of a cell: outlines run through corners and along sides of cells."""
    g = random.Random(seed)
    shapes = [[[pts(star(g, g.randrange(-8, 8), g.randrange(-8, 8), g.choice([2, 6, 16]), g.choice([4, 12, 90]), g.choice([0.25, 2, 0.03125])))]] for _ in range(12)]
    shapes += [[[pts([(-16, -16), (16, -16), (16, 16), (-16, 16)])]], [[pts([(0, 0), (2, 0), (2, 2), (0, 2)]), pts([(0.25, 0.25), (1.75, 0.25), (1.75, 1.75), (0.25, 1.75)])]]]
    step = g.choice([0.25, 0.125])
    points = [(g.randrange(-96, 96) * step, g.randrange(-96, 96) * step) for _ in range(700)]
    check(spark, shapes, points)


def test_null_empty_and_flat_outlines(spark):
    shapes = [None, [], [[]], [[pts([])]], [[pts([(1, 1)])]], [[pts([(1, 1), (3, 1)])]], [[pts([(0, 0), (4, 0), (4, 4)])]]]
    b, got = check(spark, shapes, [(3, 1), (2, 1), (1, 1), (5, 5)])
    assert {k for k, _, _ in got} == {6}
    assert C.boundary_cells(b.limit(0)).count() == 0


def test_dense_outlines_split_and_small_ones_do_not():
    g = random.Random(7)
    ring = star(g, 10, 50, 8, 50_000)
    e = C._edges([(np.array([x for x, _ in ring]), np.array([y for _, y in ring]))])
    rows = list(C.polygon_cells(e))
    assert max(r[-1].shape[1] for r in rows) <= C.MAX_EDGES
    assert len(list(C.polygon_cells(C._edges([(np.array([0.0, 9, 9, 0]), np.array([0.0, 0, 9, 9]))])))) <= 81
    many = C._edges([(np.array([0.0, math.cos(k), math.cos(k + 0.01)]), np.array([0.0, math.sin(k), math.sin(k + 0.01)])) for k in range(100)])
    assert list(C.polygon_cells(many))  # all meet in one point: splitting ends at the smallest size

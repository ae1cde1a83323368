"""Polygons as grid cells that each hold few edges and the parity of one corner.

A point's place in a polygon is told inside its cell. The path from the point to the cell's
south-east corner goes east to the cell's side, then south along it; the polygon holds the point
where the corner's parity and the number of edges that the path crosses together are odd. So a cell
needs the edges inside it and one bit, however large the outline is. A cell with more than
``MAX_EDGES`` edges is split by eight a side and its parts' corners are told in it, so splitting
goes on where the outline is dense and nowhere else.

A crossing is decided from one sign, the side of an edge that a point lies on, and points count as
moved east and north by next to nothing, east by more: both legs of a path then agree at vertices
and on edges that pass through corners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cell sizes in degrees, each an eighth of the one before; a boundary starts with the smallest that needs few cells.
SIZES = tuple(16.0 / 8**k for k in range(7))
MAX_CELLS_A_SIDE = 8
MAX_EDGES = 64
_FLUSH = 200_000

#: An outline of so few edges is listed whole in each of its cells.
FEW_EDGES = 16

SCHEMA = "osm_id long, _size double, _y long, _x long, east double, south double, odd boolean, edges array<struct<ax double, ay double, bx double, by double>>"


# ------------------------------------------------------------------ cutting polygons, in numpy

def _west(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie to the west of edges; on an edge counts as east. ``e``: ax, ay, bx, by in its first axis."""
    ax, ay, bx, by = e
    cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    side = np.where(by > ay, cross, -cross) > 0
    return (side | (np.minimum(ax, bx) > x)) & ~(np.maximum(ax, bx) <= x)


def _above(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points that lie within the edges' longitudes lie above them."""
    ax, ay, bx, by = e
    west = _west(e, x, y)
    # the north-west side of a rising edge, the north-east side of a falling one
    side = np.where((bx > ax) == (by > ay), west, ~west)
    side = np.where(ay == by, y >= ay, side)
    return (side | (np.maximum(ay, by) <= y)) & ~(np.minimum(ay, by) > y)


def _corners(e: np.ndarray, xs: np.ndarray, ys: np.ndarray, east: float, south: float, odd: bool) -> np.ndarray:
    """Parity of the points (ys x xs), from the parity of (east, south); no edge outside matters to paths between them."""
    out = np.full((len(ys), len(xs)), odd)
    upright = e[:, (e[0] > east) != (e[2] > east)]
    if upright.shape[1]:
        low = _above(upright, east, south)
        out ^= (np.sum(_above(upright[:, None, :], east, ys[:, None]) != low, axis=1) % 2 == 1)[:, None]
    first, last = np.searchsorted(ys, np.minimum(e[1], e[3])), np.searchsorted(ys, np.maximum(e[1], e[3]))  # lines y with low <= y < high
    many = last - first
    which = np.repeat(np.arange(e.shape[1]), many)
    row = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    for a in range(0, len(which), 100_000):
        level, r = e[:, which[a : a + 100_000]], row[a : a + 100_000]
        crossed = _west(level[:, :, None], xs[None, :], ys[r][:, None]) != _west(level, east, ys[r])[:, None]
        flips = np.zeros(out.shape, dtype=np.int64)
        np.add.at(flips, r, crossed)
        out ^= flips % 2 == 1
    return out


def _touched(e: np.ndarray, size: float, x0: int, y0: int, nx: int, ny: int) -> tuple[np.ndarray, np.ndarray]:
    """(edge, cell) pairs of the cells of a grid that edges touch, sorted by cell; a touch by next to nothing counts."""
    ax, ay, bx, by = e
    slack = size * 1e-9
    low, high = np.minimum(ay, by), np.maximum(ay, by)
    r0 = np.clip(np.floor((low - slack) / size).astype(np.int64) - y0, 0, ny)
    r1 = np.clip(np.floor((high + slack) / size).astype(np.int64) - y0, -1, ny - 1)
    many = np.maximum(r1 - r0 + 1, 0)
    which = np.repeat(np.arange(len(ax)), many)
    row = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + r0[which]
    ax, ay, bx, by = ax[which], ay[which], bx[which], by[which]
    south = (row + y0) * size
    with np.errstate(divide="ignore", invalid="ignore"):
        at = lambda y: np.where(by == ay, np.nan, ax + (bx - ax) * np.clip((y - ay) / (by - ay), 0, 1))
        p, q = at(south - slack), at(south + size + slack)
    flat = by == ay
    p, q = np.where(flat, ax, p), np.where(flat, bx, q)
    c0 = np.clip(np.floor((np.minimum(p, q) - slack) / size).astype(np.int64) - x0, 0, nx)
    c1 = np.clip(np.floor((np.maximum(p, q) + slack) / size).astype(np.int64) - x0, -1, nx - 1)
    wide = np.maximum(c1 - c0 + 1, 0)
    edge = np.repeat(which, wide)
    cell = np.repeat(row * nx + c0, wide) + np.arange(len(edge)) - np.repeat(np.cumsum(wide) - wide, wide)
    order = np.argsort(cell, kind="stable")
    return edge[order], cell[order]


def polygon_cells(e: np.ndarray) -> Iterator[tuple[float, int, int, float, float, bool, np.ndarray]]:
    """(size, y, x, longitude and latitude of the corner, its parity, edges) of the cells that a polygon covers or touches.

    The corner is the cell's south-east one; where the edges are few, all are listed and the corner
    is one outside of them.
    """
    if not e.shape[1]:
        return
    west, south, east, north = min(e[0].min(), e[2].min()), min(e[1].min(), e[3].min()), max(e[0].max(), e[2].max()), max(e[1].max(), e[3].max())
    extent = max(east - west, north - south)
    level = max([k for k, s in enumerate(SIZES) if extent <= s * MAX_CELLS_A_SIDE], default=0)
    at = lambda v: int(np.floor(v / SIZES[level]))
    x0, y0 = at(west), at(south)
    nx, ny = at(east) - x0 + 1, at(north) - y0 + 1
    far = (x0 + nx) * SIZES[level], y0 * SIZES[level]
    if e.shape[1] <= FEW_EDGES:
        yield from ((SIZES[level], y0 + k // nx, x0 + k % nx, *far, False, e) for k in range(nx * ny))
        return
    grids = [(level, x0, y0, nx, ny, e, *far, False)]
    while grids:
        level, x0, y0, nx, ny, e, east, south, odd = grids.pop()
        size = SIZES[level]
        xs, ys = (x0 + np.arange(nx) + 1) * size, (y0 + np.arange(ny)) * size
        odd = _corners(e, xs, ys, east, south, odd)
        edge, cell = _touched(e, size, x0, y0, nx, ny)
        starts = np.searchsorted(cell, np.arange(nx * ny + 1)).tolist()
        for k in range(nx * ny):
            y, x = divmod(k, nx)
            own = edge[starts[k] : starts[k + 1]]
            parity = bool(odd[y, x])
            if len(own) <= MAX_EDGES or level + 1 == len(SIZES):
                if len(own) or parity:
                    yield size, y0 + y, x0 + x, float(xs[x]), float(ys[y]), parity, e[:, own]
            else:
                grids.append((level + 1, (x0 + x) * 8, (y0 + y) * 8, 8, 8, e[:, own], xs[x], ys[y], parity))


def _edges(rings: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ax, ay, bx, by of all rings, each closed."""
    parts = []
    for x, y in rings:
        if len(x) > 1:
            if x[0] != x[-1] or y[0] != y[-1]:
                x, y = np.append(x, x[0]), np.append(y, y[0])
            parts.append(np.array([x[:-1], y[:-1], x[1:], y[1:]]))
    e = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0))
    return e[:, (e[0] != e[2]) | (e[1] != e[3])]


def _outlines(column: pa.Array) -> Iterator[np.ndarray]:
    """The edges of each row's polygons; a null row has none."""
    polygons = column.values
    rings = polygons.values
    points = rings.values
    lon, lat = (np.asarray(points.field(c).to_numpy(zero_copy_only=False), dtype=np.float64) for c in ("lon", "lat"))
    of_row, of_polygon, of_ring = (np.asarray(a.offsets) for a in (column, polygons, rings))
    for a, b in zip(of_polygon[of_row[:-1]].tolist(), of_polygon[of_row[1:]].tolist(), strict=True):
        yield _edges((lon[of_ring[r] : of_ring[r + 1]], lat[of_ring[r] : of_ring[r + 1]]) for r in range(a, b))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list = []
    held = 0
    for batch in batches:
        for osm_id, e in zip(batch.column(0).to_pylist(), _outlines(batch.column(1)), strict=True):
            for row in polygon_cells(e):
                rows.append((osm_id, *row))
                held += 8 + row[-1].shape[1]
                if held > _FLUSH:
                    yield _batch(rows)
                    rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    ids, sizes, ys, xs, east, south, odd, edges = zip(*rows, strict=True)
    e = np.concatenate(edges, axis=1)
    offsets = pa.array(np.cumsum([0, *[x.shape[1] for x in edges]]), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in e], names=["ax", "ay", "bx", "by"]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(ys, pa.int64()), pa.array(xs, pa.int64()), pa.array(east), pa.array(south), pa.array(odd), lists], names=["osm_id", "_size", "_y", "_x", "east", "south", "odd", "edges"])


# ------------------------------------------------------------------ on Spark

def boundary_cells(boundaries: DataFrame) -> DataFrame:
    """(osm_id, _size, _y, _x, east, south, odd, edges): the grid cells that each boundary covers or touches.

    Each boundary is cut where its row is, so nothing is shuffled. A cell without edges is listed
    only if it lies inside.
    """
    # many rows share a task only as far as their outlines fit a batch
    return boundaries.select("osm_id", "polygons").mapInArrow(_cut, SCHEMA)


def cell_keys(lat: Column, lon: Column) -> Column:
    """The cells of all sizes that hold a point, as an array of (_size, _y, _x)."""
    at = lambda v, s: F.floor(v / F.lit(s)).cast("long")
    return F.array(*[F.struct(F.lit(s).alias("_size"), at(lat, s).alias("_y"), at(lon, s).alias("_x")) for s in SIZES])


def cell_holds(lon: Column, lat: Column, east: Column, south: Column, odd: Column, edges: Column) -> Column:
    """Whether a polygon holds a point of the cell strictly: by the corner's parity and the edges in the cell."""
    def west(e: Column, x: Column, y: Column) -> Column:
        ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        side = F.when(by > ay, cross > 0).otherwise(cross < 0)
        return F.when(F.least(ax, bx) > x, True).when(F.greatest(ax, bx) <= x, False).otherwise(side)

    def above(e: Column, y: Column) -> Column:
        ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
        side = F.when(ay == by, y >= ay).otherwise(west(e, east, y) == ((bx > ax) == (by > ay)))
        return F.when(F.greatest(ay, by) <= y, True).when(F.least(ay, by) > y, False).otherwise(side)

    def on(e: Column) -> Column:
        ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
        return lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by)) & ((bx - ax) * (lat - ay) == (by - ay) * (lon - ax))

    def crossed(e: Column) -> Column:
        level = ((e["ay"] > lat) != (e["by"] > lat)) & (west(e, lon, lat) != west(e, east, lat))
        upright = ((e["ax"] > east) != (e["bx"] > east)) & (above(e, lat) != above(e, south))
        return level != upright

    flips = F.size(F.filter(edges, crossed))
    return ((flips % 2 == 1) != odd) & ~F.exists(edges, on)

"""Distances, boxes, rings and geohashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: WGS84: equatorial radius in metres and flattening.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
KM_PER_DEGREE = 110.5


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x)


def _half_chord(p1: Column, p2: Column, dlon: Column) -> Column:
    return F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)


def _arc(h: Column) -> Column:
    """Half the angle of a squared half chord; null for null, which least() would pass over."""
    return F.when(h > 1, F.asin(F.lit(1.0))).otherwise(F.asin(F.sqrt(h)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return F.lit(2 * EARTH_KM) * _arc(_half_chord(F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)))


def spheroid_m(lat1, lon1, lat2, lon2) -> Column:
    """Distance on the WGS84 spheroid: great circle over reduced latitudes, corrected to first order in the flattening."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    b1, b2 = (F.atan(F.lit(1 - WGS84_F) * F.tan(F.radians(x))) for x in (lat1, lat2))
    s = 2 * _arc(_half_chord(b1, b2, F.radians(lon2 - lon1)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.pow(F.sin(p) * F.cos(q) / F.cos(s / 2), 2)
    y = (s + F.sin(s)) * F.pow(F.cos(p) * F.sin(q) / F.sin(s / 2), 2)
    return F.when(s == 0, F.lit(0.0)).otherwise(F.lit(WGS84_A) * (s - F.lit(WGS84_F / 2) * (x + y)))


def distance_m(lat1, lon1, lat2, lon2, model: str = "spheroid") -> Column:
    if model == "sphere":
        return haversine_km(lat1, lon1, lat2, lon2) * 1000
    if model == "spheroid":
        return spheroid_m(lat1, lon1, lat2, lon2)
    raise ValueError("model is 'sphere' or 'spheroid'")


def in_box(lat, lon, south: float, west: float, north: float, east: float) -> Column:
    """Point in a latitude/longitude box, edges included."""
    return _c(lat).between(south, north) & _c(lon).between(west, east)


def radius_box(lat, lon, at_lat: float, at_lon: float, km: float) -> Column:
    """A box that holds every point within ``km``; it can be pushed to a scan."""
    south, west, north, east = radius_extent(at_lat, at_lon, km)
    box = _c(lat).between(south, north)
    return box if (west, east) == (-180.0, 180.0) else box & _c(lon).between(west, east)


Z_BITS = 16


def z_key(lat, lon) -> Column:
    """Z-order key: the cell numbers of both axes with their bits in turn, so that points near each other mostly have keys near each other."""
    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return x

    def cell(v: Column, low: float, span: float) -> Column:
        at = F.floor((v - F.lit(low)) / F.lit(span) * F.lit(float(1 << Z_BITS))).cast("long")
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit((1 << Z_BITS) - 1).cast("long"), at))

    x, y = spread(cell(_c(lon), -180.0, 360.0)), spread(cell(_c(lat), -90.0, 180.0))
    return F.shiftleft(y, 1).bitwiseOR(x)


def z_ranges(south: float, west: float, north: float, east: float, most: int = 32) -> list[tuple[int, int]]:
    """At most about ``most`` ranges of keys, ends included, that hold the keys of all points of a box: quarters of the world, split where the box's edge runs through them."""
    side = 1 << Z_BITS
    at = lambda v, low, span: max(0, min(side - 1, int((v - low) / span * side // 1)))
    x0, x1, y0, y1 = at(west, -180.0, 360.0), at(east, -180.0, 360.0), at(south, -90.0, 180.0), at(north, -90.0, 180.0)
    whole, open_cells = [], [(0, 0, side)]
    while open_cells and len(whole) + len(open_cells) < most:
        x, y, n = max(open_cells, key=lambda c: c[2])
        open_cells.remove((x, y, n))
        h = n // 2
        for a, b in ((x, y), (x + h, y), (x, y + h), (x + h, y + h)):
            if a > x1 or a + h - 1 < x0 or b > y1 or b + h - 1 < y0:
                continue
            inside = h == 1 or (x0 <= a and a + h - 1 <= x1 and y0 <= b and b + h - 1 <= y1)
            (whole if inside else open_cells).append((a, b, h))
    key = lambda x, y: sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(Z_BITS))
    out: list[tuple[int, int]] = []
    for a, z in sorted((key(x, y), key(x, y) + n * n - 1) for x, y, n in whole + open_cells):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def radius_extent(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """A box (south, west, north, east) that holds every point within ``km``; all longitudes where the circle meets a pole or 180 degrees."""
    import math

    dlat = km / KM_PER_DEGREE
    south, north = lat - dlat, lat + dlat
    far = max(abs(south), abs(north))
    dlon = km / (KM_PER_DEGREE * math.cos(math.radians(far))) if far < 89.0 else 360.0
    return (south, -180.0, north, 180.0) if lon - dlon < -180 or lon + dlon > 180 else (south, lon - dlon, north, lon + dlon)


def ring_edges(ring: Column) -> Column:
    """Pairs (a, b) of consecutive points of a ring, closed if it isn't; in time linear in its points."""
    closed = F.when(F.get(ring, 0) == F.try_element_at(ring, F.lit(-1)), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    legs = F.greatest(F.size(closed) - 1, F.lit(0))
    return F.zip_with(F.slice(closed, F.lit(1), legs), F.slice(closed, F.lit(2), legs), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def strictly_inside(lon: Column, lat: Column, polygons: Column) -> Column:
    """Point in a multipolygon by the even-odd rule over all rings; a point on an edge is outside.

    ``polygons`` is an array of polygons, each an array of rings of points (lon, lat). Holes and
    further parts need no special case.
    """
    flat = lambda e: F.struct(e["a"]["lon"].alias("ax"), e["a"]["lat"].alias("ay"), e["b"]["lon"].alias("bx"), e["b"]["lat"].alias("by"))
    return edges_hold(lon, lat, F.transform(F.flatten(F.transform(F.flatten(polygons), ring_edges)), flat))


def edges_hold(lon: Column, lat: Column, edges: Column) -> Column:
    """Whether a ray from the point to the east meets an odd number of edges (ax, ay, bx, by) and no edge holds it.

    Edges that don't reach the point's latitude, or lie to its west, can be left out.
    """
    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))

    def step(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
        cross = (bx - ax) * (lat - ay) - (by - ay) * (lon - ax)
        on = (cross == 0) & lon.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by))
        spans = (ay > lat) != (by > lat)
        right = F.when(by > ay, cross > 0).otherwise(cross < 0)
        return F.struct((s["odd"] != (spans & right)).alias("odd"), (s["on"] | on).alias("on"))

    return F.aggregate(edges, start, step, lambda s: s["odd"] & ~s["on"])


def ring_moments(ring: Column) -> Column:
    """(signed area, area * x, area * y) of a ring by the shoelace sum."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("a"), zero.alias("x"), zero.alias("y"))

    def step(s: Column, e: Column) -> Column:
        c = e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]
        return F.struct((s["a"] + c / 2).alias("a"), (s["x"] + (e["a"]["lon"] + e["b"]["lon"]) * c / 6).alias("x"), (s["y"] + (e["a"]["lat"] + e["b"]["lat"]) * c / 6).alias("y"))

    return F.aggregate(ring_edges(ring), start, step)


def area_centroid(polygons: Column) -> Column:
    """Struct (area, lon, lat): planar area and centroid; a polygon's first ring counts up, others down."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("a"), zero.alias("x"), zero.alias("y"))

    def signed(ring: Column, i: Column) -> Column:
        m = ring_moments(ring)
        turn = F.when((m["a"] >= 0) == (i == 0), F.lit(1.0)).otherwise(F.lit(-1.0))
        return F.struct((m["a"] * turn).alias("a"), (m["x"] * turn).alias("x"), (m["y"] * turn).alias("y"))

    parts = F.flatten(F.transform(polygons, lambda p: F.transform(p, signed)))
    total = lambda s, m: F.struct((s["a"] + m["a"]).alias("a"), (s["x"] + m["x"]).alias("x"), (s["y"] + m["y"]).alias("y"))
    return F.aggregate(parts, start, total, lambda s: F.struct(s["a"].alias("area"), (s["x"] / s["a"]).alias("lon"), (s["y"] / s["a"]).alias("lat")))


def segment_hits_box(a: Column, b: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether the straight segment between two points meets a box: the slab test on both axes."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]

    def span(p: Column, d: Column, lo: float, hi: float) -> tuple[Column, Column, Column]:
        t1, t2 = (F.lit(lo) - p) / F.nullif(d, F.lit(0.0)), (F.lit(hi) - p) / F.nullif(d, F.lit(0.0))
        flat = d == 0
        return F.when(flat, F.lit(0.0)).otherwise(F.least(t1, t2)), F.when(flat, F.lit(1.0)).otherwise(F.greatest(t1, t2)), ~flat | p.between(lo, hi)

    x0, x1, okx = span(a["lon"], dx, west, east)
    y0, y1, oky = span(a["lat"], dy, south, north)
    return okx & oky & (F.greatest(x0, y0, F.lit(0.0)) <= F.least(x1, y1, F.lit(1.0)))


def path_length_m(route: Column, model: str = "spheroid") -> Column:
    """Length of a route (array of points); null for a null route."""
    legs = F.zip_with(F.slice(route, F.lit(1), F.size(route) - 1), F.slice(route, F.lit(2), F.size(route) - 1), lambda a, b: distance_m(a["lat"], a["lon"], b["lat"], b["lon"], model))
    return F.when(F.size(route) >= 2, F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)).when(route.isNotNull(), F.lit(0.0))


#: The geohash alphabet.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat, lon, precision: int = 10) -> Column:
    """Geohash by interleaving the binary cell numbers of both axes, longitude first.

    A value on a cell's lower edge belongs to the half below it, as only a larger one goes up.
    """
    bits = precision * 5
    nlon, nlat = (bits + 1) // 2, bits // 2

    def cell(x: Column, low: float, span: float, n: int) -> Column:
        scaled = (x - F.lit(low)) / F.lit(span) * F.lit(float(1 << n))
        return F.greatest(F.lit(0), F.least(F.lit((1 << n) - 1), (F.ceil(scaled) - 1).cast("long")))

    x, y = cell(_c(lon), -180.0, 360.0, nlon), cell(_c(lat), -90.0, 180.0, nlat)
    chars = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            b = k * 5 + j
            axis, shift = (x, nlon - 1 - b // 2) if b % 2 == 0 else (y, nlat - 1 - b // 2)
            value = value * 2 + F.shiftright(axis, shift).bitwiseAND(F.lit(1).cast("long"))
        chars.append(F.substring(F.lit(GEOHASH), value.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)

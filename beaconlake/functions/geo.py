"""Distances, centroids and boxes as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
#: Metres of a degree of latitude on that sphere.
DEGREE_M = 111194.92664455873


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance; good to a fraction of a percent within a metropolitan area."""
    mid = F.radians((lat1 + lat2) / 2)
    dy, dx = (lat2 - lat1) * DEGREE_M, (lon2 - lon1) * DEGREE_M * F.cos(mid)
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dy) * F.sin(dy) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dx) * F.sin(dx)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would pass over a null


def usable(lat: Column, lon: Column) -> Column:
    """A real point: not null, not NaN and not (0, 0)."""
    return lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & ((lat != 0) | (lon != 0))


def ring_centroid(ring: Column) -> Column:
    """Centroid (x, y, area) of a ring, an array of struct(x, y); the mean of the points where the area is 0."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edge = F.zip_with(ring, after, lambda p, q: F.struct((p.x * q.y - q.x * p.y).alias("c"), (p.x + q.x).alias("sx"), (p.y + q.y).alias("sy")))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    area = total(F.transform(edge, lambda e: e.c)) / 2
    cx = total(F.transform(edge, lambda e: e.sx * e.c)) / (6 * area)
    cy = total(F.transform(edge, lambda e: e.sy * e.c)) / (6 * area)
    mean = lambda field: total(F.transform(ring, lambda p: p[field])) / F.size(ring)
    flat = area == 0
    return F.struct(F.when(flat, mean("x")).otherwise(cx).alias("x"), F.when(flat, mean("y")).otherwise(cy).alias("y"), F.abs(area).alias("area"))


def multi_centroid(rings: Column) -> Column:
    """Area-weighted centroid (x, y) of several rings; the middle of their box where no ring has an area."""
    each = F.transform(rings, ring_centroid)
    total = lambda f: F.aggregate(each, F.lit(0.0), lambda a, c: a + f(c))
    area = total(lambda c: c.area)
    points = F.flatten(rings)
    middle = lambda field: (F.array_min(F.transform(points, lambda p: p[field])) + F.array_max(F.transform(points, lambda p: p[field]))) / 2
    of = lambda field: F.when(area > 0, total(lambda c: c[field] * c.area) / area).otherwise(middle(field))
    return F.struct(of("x").alias("x"), of("y").alias("y"))


def interval_gap(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Gap between two spans, 0 where they overlap."""
    return F.greatest(F.lit(0), from_b - to_a, from_a - to_b)

"""Geometry as Column expressions (points) and as plain Python (shapes, codecs)."""

from __future__ import annotations

import math
import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the alphabet of geohashes


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lon: Column, lat: Column, lo_lon: float, lo_lat: float, hi_lon: float, hi_lat: float) -> Column:
    """Both ends included."""
    return lon.between(lo_lon, hi_lon) & lat.between(lo_lat, hi_lat)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test against a closed or open ring."""
    pts = ring if ring[0] != ring[-1] else ring[:-1]
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
        if y1 != y2:
            crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            hits = hits + F.when(crosses, 1).otherwise(0)
    return hits % 2 == 1


def geohash(lon: Column, lat: Column, length: int = 8) -> Column:
    """Base-32 geohash: interleaved halvings of longitude and latitude, five bits a letter."""
    bits = length * 5
    cells = lambda v, lo, hi, n: F.least(F.floor((v - lo) / (hi - lo) * float(1 << n)), F.lit((1 << n) - 1)).cast("long")
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    a, b = cells(lon, -180.0, 180.0, n_lon), cells(lat, -90.0, 90.0, n_lat)
    letters = []
    for k in range(length):
        v = F.lit(0).cast("long")
        for j in range(5):
            i = k * 5 + j
            src, left = (a, n_lon - 1 - i // 2) if i % 2 == 0 else (b, n_lat - 1 - i // 2)
            v = v * 2 + F.shiftright(src, left).bitwiseAND(1)
        letters.append(F.substring(F.lit(BASE32), (v + 1).cast("int"), F.lit(1)))
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(*letters))


def geohash_bounds(h: str) -> tuple[float, float, float, float]:
    """(lon_min, lat_min, lon_max, lat_max) of a geohash cell."""
    box, even = [[-180.0, 180.0], [-90.0, 90.0]], True
    for c in h:
        v = BASE32.index(c)
        for bit in (16, 8, 4, 2, 1):
            axis = box[0 if even else 1]
            mid = (axis[0] + axis[1]) / 2
            axis[0 if v & bit else 1] = mid
            even = not even
    return box[0][0], box[1][0], box[0][1], box[1][1]


def geohash_text(lon: float, lat: float, length: int = 8) -> str:
    out, box, even = [], [[-180.0, 180.0], [-90.0, 90.0]], True
    for _ in range(length):
        v = 0
        for _ in range(5):
            axis, x = (box[0], lon) if even else (box[1], lat)
            mid = (axis[0] + axis[1]) / 2
            v = v * 2 + (x >= mid)
            axis[0 if x >= mid else 1] = mid
            even = not even
        out.append(BASE32[v])
    return "".join(out)


def in_geohash(df: DataFrame, prefix: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows whose geohash begins with a prefix, that is whose position lies in its cell; the cell's box reaches the scan as a filter first."""
    lo_lon, lo_lat, hi_lon, hi_lat = geohash_bounds(prefix)
    return df.where(in_box(F.col(lon), F.col(lat), lo_lon, lo_lat, hi_lon, hi_lat)).where(geohash(F.col(lon), F.col(lat), len(prefix)) == prefix)


def geohash_within(df: DataFrame, x: float, y: float, metres: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows within some metres of a place: those in the cell of the place or one beside it, cells being larger than the radius, measured exactly.

    Near a pole and for radii beyond a twentieth of the globe all rows are measured.
    """
    wide = metres / 111_000.0 / max(math.cos(math.radians(min(89.9, abs(y) + metres / 111_000.0))), 1e-6)
    length = next((n for n in range(8, 0, -1) if 360 / (1 << ((5 * n + 1) // 2)) > wide * 1.01 and 180 / (1 << (5 * n // 2)) > metres / 110_000.0), 0)
    if length and abs(y) + metres / 110_000.0 < 85:
        home = geohash_text(x, y, length)
        df = df.where(geohash(F.col(lon), F.col(lat), length).isin([home, *geohash_neighbours(home)]))
    return df.where(haversine(F.col(lon), F.col(lat), F.lit(x), F.lit(y)) <= metres)


def geohash_neighbours(h: str) -> list[str]:
    """The up to eight cells round a cell; longitudes wrap, cells beyond a pole are left out."""
    lo_lon, lo_lat, hi_lon, hi_lat = geohash_bounds(h)
    w, t, x, y = hi_lon - lo_lon, hi_lat - lo_lat, (lo_lon + hi_lon) / 2, (lo_lat + hi_lat) / 2
    out = []
    for dy in (1, 0, -1):
        for dx in (-1, 0, 1):
            la = y + dy * t
            if (dx or dy) and -90 < la < 90:
                out.append(geohash_text((x + dx * w + 180) % 360 - 180, la, len(h)))
    return out


# Shapes: ("point", (x, y)), ("linestring", [..]), ("polygon", [ring, ...]), ("multipolygon", [polygon, ...])


def from_wkt(text: str) -> tuple:
    kind, body = re.fullmatch(r"\s*(\w+)\s*(\(.*\))\s*", text, re.S).groups()
    nested = re.sub(r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)", r"(\1,\2)", body).replace("(", "[").replace(")", "]")
    import json

    value = json.loads(nested)

    def pairs(v):
        return tuple(map(float, v)) if not isinstance(v[0], list) else [pairs(x) for x in v]

    value = pairs(value)
    return kind.lower(), value[0] if kind.lower() == "point" else value


def to_wkt(shape: tuple) -> str:
    kind, v = shape

    def text(x):
        return f"{x[0]:g} {x[1]:g}" if isinstance(x, tuple) else "(" + ", ".join(map(text, x)) + ")"

    return kind.upper() + (f" ({text(v)})" if kind == "point" else f" {text(v)}")


CODES = {"point": 1, "linestring": 2, "polygon": 3, "multipolygon": 6}  # fixed values: WKB type codes


def to_wkb(shape: tuple) -> bytes:
    kind, v = shape
    pts = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
    head = struct.pack("<BI", 1, CODES[kind])
    if kind == "point":
        return head + struct.pack("<dd", *v)
    if kind == "linestring":
        return head + pts(v)
    if kind == "polygon":
        return head + struct.pack("<I", len(v)) + b"".join(map(pts, v))
    return head + struct.pack("<I", len(v)) + b"".join(to_wkb(("polygon", p)) for p in v)


def from_wkb(data: bytes) -> tuple:
    at = 0

    def take(fmt):
        nonlocal at
        out = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return out

    def points():
        return [take("dd") for _ in range(take("I")[0])]

    def shape():
        nonlocal order, at
        order = "<" if data[at] else ">"
        at += 1
        code = take("I")[0]
        if code == 1:
            return "point", take("dd")
        if code == 2:
            return "linestring", points()
        if code == 3:
            return "polygon", [points() for _ in range(take("I")[0])]
        if code == 6:
            return "multipolygon", [shape()[1] for _ in range(take("I")[0])]
        raise ValueError(f"unknown shape code {code}")

    order = "<"
    return shape()


def vertices(shape: tuple) -> list[tuple[float, float]]:
    def flat(v):
        return [v] if isinstance(v, tuple) else [p for x in v for p in flat(x)]

    return flat(shape[1])


def bbox(shape: tuple) -> tuple[float, float, float, float]:
    p = vertices(shape)
    return min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)


def centroid(shape: tuple) -> tuple[float, float]:
    """Area centroid of polygons, mean of the vertices of other shapes."""
    polys = [shape[1]] if shape[0] == "polygon" else shape[1] if shape[0] == "multipolygon" else []
    area = sx = sy = 0.0
    for p in polys:
        ring = p[0]
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            c = x1 * y2 - x2 * y1
            area, sx, sy = area + c, sx + (x1 + x2) * c, sy + (y1 + y2) * c
    if area:
        return sx / (3 * area), sy / (3 * area)
    p = vertices(shape)
    return sum(x for x, _ in p) / len(p), sum(y for _, y in p) / len(p)


def _edges(shape: tuple):
    lines = {"point": lambda v: [], "linestring": lambda v: [v], "polygon": lambda v: v, "multipolygon": lambda v: [r for p in v for r in p]}[shape[0]](shape[1])
    closed = shape[0] in ("polygon", "multipolygon")
    return [(a, b) for r in lines for a, b in zip(r, r[1:] + (r[:1] if closed and r[0] != r[-1] else []))]


def _side(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(a, b, p):
    return _side(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def covers(shape: tuple, p: tuple[float, float]) -> bool:
    """Whether a point lies in a shape or on its edge; holes are outside."""
    if shape[0] == "point":
        return shape[1] == p
    if any(_on(a, b, p) for a, b in _edges(shape)):
        return True
    inside = False
    if shape[0] in ("polygon", "multipolygon"):
        for a, b in _edges(shape):
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return inside


def intersects(a: tuple, b: tuple) -> bool:
    la, lb = bbox(a), bbox(b)
    if la[0] > lb[2] or lb[0] > la[2] or la[1] > lb[3] or lb[1] > la[3]:
        return False
    if any(covers(a, p) for p in vertices(b)) or any(covers(b, p) for p in vertices(a)):
        return True
    return any(_side(p, q, r) * _side(p, q, s) < 0 and _side(r, s, p) * _side(r, s, q) < 0 for p, q in _edges(a) for r, s in _edges(b))


def contains(a: tuple, b: tuple) -> bool:
    """Every part of b lies in a: all its vertices do and no edges cross."""
    return all(covers(a, p) for p in vertices(b)) and not any(_side(p, q, r) * _side(p, q, s) < 0 and _side(r, s, p) * _side(r, s, q) < 0 for p, q in _edges(a) for r, s in _edges(b))


def relate(a: tuple, b: tuple) -> str:
    """equals, contains, within, overlaps, touches, crosses or disjoint, the first that holds."""
    if a[0] == b[0] and sorted(set(vertices(a))) == sorted(set(vertices(b))):
        return "equals"
    if not intersects(a, b):
        return "disjoint"
    if contains(a, b):
        return "contains"
    if contains(b, a):
        return "within"
    strict = any(_side(p, q, r) * _side(p, q, s) < 0 and _side(r, s, p) * _side(r, s, q) < 0 for p, q in _edges(a) for r, s in _edges(b))
    on_edge = lambda s, p: any(_on(x, y, p) for x, y in _edges(s))
    inner = any(covers(a, p) and not on_edge(a, p) for p in vertices(b)) or any(covers(b, p) and not on_edge(b, p) for p in vertices(a))
    if not strict and not inner:
        return "touches"
    return "overlaps" if a[0].endswith("polygon") and b[0].endswith("polygon") else "crosses"


def distance_m(a: tuple, b: tuple) -> float:
    """Great-circle metres between points, or between centroids of other shapes."""
    from quillon.operators.near import distance_m as metres

    p, q = (s[1] if s[0] == "point" else centroid(s) for s in (a, b))
    return float(metres(p[0], p[1], q[0], q[1]))


def wkt_relation(a: str, b: str) -> Column:
    """relate() over two WKT columns, batch-wise."""

    @F.pandas_udf("string")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([relate(from_wkt(p), from_wkt(q)) if p is not None and q is not None else None for p, q in zip(x, y)], dtype=object)

    return f(a, b)

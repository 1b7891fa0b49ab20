import random

import numpy as np
import pytest

from quillon.operators.near import containing_regions, distance_m, near_pairs

P = "point_id long, entity_id string, lon double, lat double, leaf int, role string"
N = "node_id string, center_lng double, center_lat double, radius_m double, leaf int"


def made():
    r, out = random.Random(6), []
    spots = [(180.0, 0.0), (0.0, 89.9999), (45.0, 35.2643897), (12.5, 55.7), (-135.0, -35.26), (0.0, 45.0), (90.0, -90.0)]
    for i in range(900):
        lon, lat = spots[i % len(spots)]
        lon = lon + r.uniform(-1, 1) * 0.003 / max(0.00001, np.cos(np.radians(lat))) if abs(lat) < 89 else r.uniform(-180, 180)
        lat = max(-90.0, min(90.0, lat + r.uniform(-0.003, 0.003)))
        out.append((i, f"e{i % 50}", float((lon + 180) % 360 - 180), float(lat)))
    out += [(1000, "x", None, 1.0), (1001, "x", 181.0, 0.0), (1002, "x", 0.0, 91.0), (1003, "x", 0.0, 0.0), (1004, None, 12.5, 55.7), (1005, "y", float("nan"), 1.0)]
    return out + out[:20]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "z") for x in rows], P)


@pytest.mark.parametrize("leaf,block", [(50, 20), (4000, 20000)])
def test_pairs(spark, leaf, block):
    pts = {p[0]: p for p in made() if p[0] < 1000}
    ids = sorted(pts)
    lon, lat, ent = (np.array([pts[i][k] for i in ids]) for k in (2, 3, 1))
    want = {(a, b) for a in ids for b in np.flatnonzero(distance_m(lon[a], lat[a], lon, lat) <= 40).tolist() if a < b and ent[a] != ent[b]}
    got = [tuple(r) for r in near_pairs(frame(spark, made()), leaf_rows=leaf, block_rows=block).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("leaf,block", [(50, 20), (4000, 20000)])
def test_regions(spark, leaf, block):
    nodes = [("n", 0.0, 90.0, 300.0), ("d", 180.0, 0.0, 20_000.0), ("d2", -180.0, 0.0, 150.0), ("big", 10.0, 50.0, 2_000_000.0), ("zero", 12.5, 55.7, 0.0), ("u", None, 1.0, 5.0), ("v", 1.0, 1.0, None), ("w", 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame([(*n, 1) for n in [*nodes, nodes[1]]], N)
    want = {(p[0], n[0]) for p in made() if p[0] < 1000 or p[0] == 1004 for n in nodes[:5] if distance_m(p[2], p[3], n[1], n[2]) <= n[3]}
    got = [tuple(r) for r in containing_regions(frame(spark, made()), df, leaf_rows=leaf, block_rows=block).collect()]
    assert len(want) > 50 and len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    none = frame(spark, [])
    assert near_pairs(none).count() == 0 and containing_regions(none, spark.createDataFrame([], N)).count() == 0

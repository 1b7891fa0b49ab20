import datetime as dt

from quillon.operators.grid import regular_grid

P = "point_id long, series_key string, ts timestamp_ntz, value double, slot int, k string, step long"
S = "series_key string, step_s long, chunk int"
T0 = dt.datetime(2025, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def grid(spark, points, steps, **kw):
    p = spark.createDataFrame([(i, k, t, v, 9, "x", 1) for i, k, t, v in points], P)
    return {(r.series_key, r.slot_start_s): r for r in regular_grid(p, spark.createDataFrame([(*s, 1) for s in steps], S), **kw).collect()}


def test_interpolation_gaps_and_dirt(spark):
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    points = [
        (1, "a", at(0), 0.0), (1, "a", at(0), 0.0), (2, "a", at(30), 30.0), (3, "a", at(35), None), (4, "a", at(36), float("nan")), (5, "a", None, 1.0), (6, None, at(5), 1.0),
        (7, "a", at(45), 45.0), (8, "a", at(245), 245.0), (9, "none", at(0), 1.0), (10, "null", at(0), 1.0),
    ]
    for chunk in (2, 4096):
        g = grid(spark, points, [("a", 10), ("a", 10), ("null", None)], gap_limit_steps=5.0, chunk_slots=chunk)
        assert {k for k, _ in g} == {"a"}
        assert sorted(s - base for _, s in g) == list(range(0, 250, 10))
        assert [g["a", base + s].status for s in (0, 10, 20, 30, 40, 50, 240)] == ["observed", "interpolated", "interpolated", "observed", "observed", "gap", "observed"]
        assert [g["a", base + s].value for s in (0, 10, 20, 30, 40)] == [0.0, 10.0, 20.0, 30.0, 40.0]
        assert g["a", base + 50].value is None and g["a", base + 240].value == 245.0
    g = grid(spark, points, [("a", 10)], gap_limit_steps=None)
    assert abs(g["a", base + 100].value - 100.0) < 1e-9


def test_same_time_and_before_1970(spark):
    early = dt.datetime(1969, 12, 31, 23, 59, 45)
    g = grid(spark, [(2, "a", early, 2.0), (1, "a", early, 1.0), (3, "a", dt.datetime(1970, 1, 1, 0, 0, 5), 3.0)], [("a", 10)])
    assert sorted(s for _, s in g) == [-20, -10, 0]


def test_empty(spark):
    assert grid(spark, [], [("a", 10)]) == {} and grid(spark, [(1, "a", T0, 1.0)], []) == {}

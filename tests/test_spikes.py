import datetime as dt
import math
import random

import numpy as np
import pytest

from quillon.operators.spikes import flag_readings, gesd_critical
from quillon.queries import corpus

R = "report_id long, ts timestamp_ntz, readings array<struct<sensor_id: string, sensor_type: string, value: double, unit: string, ts: timestamp_ntz>>, v double, us long"
L = "sensor_type string, unit string, min_value double, max_value double"
T0 = dt.datetime(2025, 1, 1)


def flags(spark, series, hot_rows=10**6, **kw):
    rows = []
    for sid, values in series.items():
        for i, v in enumerate(values):
            t = T0 + dt.timedelta(minutes=30 * i)
            rows.append((len(rows), t, [(sid, "temperature", v, "C", t)], 0.0, 0))
    rows += rows[:7] + [(10**6, T0, None, 0.0, 0), (10**6 + 1, T0, [], 0.0, 0), (10**6 + 2, T0, [None, (None, "t", 1.0, "C", T0), ("u", "unknown", 5.0, None, None)], 0.0, 0)]
    df, lim = spark.createDataFrame(rows, R), spark.createDataFrame([("temperature", "C", -60.0, 150.0)], L)
    return {(r.sensor_id, r.report_id): r for r in flag_readings(df, lim, hot_rows=hot_rows, **kw).collect()}


@pytest.mark.parametrize("hot", [20, 10**6])
def test_fixed_limit(spark, hot):
    r = random.Random(2)
    a = [20 + r.random() for _ in range(60)]
    a[10], a[20] = 400.0, 90.0
    a[30:37] = [20.5] * 7
    a[40:45] = [20.25] * 5
    a[50] = None
    f = flags(spark, {"a": a}, hot, trend_s=None, period_s=None, max_mads=20.0)
    assert {i for (s, i), x in f.items() if x.out_of_range} == {10}
    assert {i for (s, i), x in f.items() if x.spike} == {10, 20}
    assert {i for (s, i), x in f.items() if x.frozen} == set(range(30, 37))
    assert ("a", 50) not in f and ("u", 10**6 + 2) in f and len(f) == 60


@pytest.mark.parametrize("hot", [50, 10**6])
def test_seasonal(spark, hot):
    r = random.Random(4)
    a = [50 + 20 * math.sin(2 * math.pi * (i % 48) / 48) + i * 0.02 + r.gauss(0, 0.5) for i in range(48 * 10)]
    a[100] += 15  # well inside the daily swing
    a[333] -= 12
    f = flags(spark, {"a": a, "b": [5.0]}, hot, phases=48)
    spikes = {i for (s, i), x in f.items() if x.spike and s == "a"}
    assert {100, 333} <= spikes and len(spikes) < 8


def plain_esd(y, most, alpha):
    """Indexes that the test takes away, by its definition."""
    left, gone, best = list(range(len(y))), [], 0
    for i, limit in enumerate(gesd_critical(len(y), np.arange(1, most + 1), alpha)):
        v = y[left]
        d = np.abs(v - v.mean())
        k = int(d.argmax())
        over = d[k] > limit * v.std(ddof=1)
        gone.append(left.pop(k))
        best = i + 1 if over else best
    return set(gone[:best])


def test_critical_values():
    # published for n = 54, alpha = 0.05
    assert gesd_critical(54, np.array([1, 2, 3, 4, 5]), 0.05) == pytest.approx([3.158794, 3.151430, 3.143890, 3.136165, 3.128247], abs=2e-3)


@pytest.mark.parametrize("scale", [0.002, 0.5])
def test_esd_is_the_same_in_segments_and_by_definition(spark, scale):
    r = random.Random(6)
    a = [20 + r.gauss(0, scale) for _ in range(1500)]
    for i in range(0, 1500, 25):
        a[i] += scale * r.choice([-1, 1, 1, 1]) * r.uniform(6, 60)  # 60 outliers, most of them above, which pull the mean
    b = [20 + r.gauss(0, scale) for _ in range(30)]
    got = {}
    for hot in (500_000, 50):
        f = flags(spark, {"a": a, "b": b}, hot, trend_s=None, period_s=None)
        got[hot] = {i for (s, i), x in f.items() if x.spike}
    y = np.array(a) - np.median(a)
    want = plain_esd(y, int(len(y) * 0.05) + 1, 0.001)
    assert got[50] == got[500_000] == want and set(range(0, 1500, 25)) <= want


def test_seasonal_parts_are_the_same_in_segments(spark):
    r = random.Random(8)
    a = [0.5 + 0.02 * math.sin(2 * math.pi * (i % 48) / 48) + i * 2e-5 + r.gauss(0, 0.002) for i in range(48 * 8)]
    a[77] += 0.03
    a[200:208] = [0.51] * 8
    whole, parts = (flags(spark, {"a": a}, hot) for hot in (10**6, 40))
    assert {k: (x.spike, x.frozen, x.out_of_range, round(x.residual, 9)) for k, x in whole.items()} == {k: (x.spike, x.frozen, x.out_of_range, round(x.residual, 9)) for k, x in parts.items()}
    assert whole["a", 77].spike and all(whole["a", i].frozen for i in range(200, 208))


@pytest.mark.parametrize("hot", [50, 10**6])
def test_limit_after_the_esd_test(spark, hot):
    r = random.Random(9)
    n = 48 * 10
    swing = [20 + 5 * math.sin(2 * math.pi * i / 48) + r.gauss(0, 0.2) for i in range(n)]
    swing[100], swing[300], swing[301] = 130.0, -55.0, 400.0  # the last one is out of range
    many = [20 + r.gauss(0, 0.2) + (60 if r.random() < 0.3 else 0) for _ in range(n)]  # more than the test may take away
    daily = [20 + r.gauss(0, 0.2) + (30 if i % 48 == 7 else 0) for i in range(n)]  # all of it season
    shifted = [20 + r.gauss(0, 0.2) + (30 if i > n - 60 else 0) for i in range(n)]  # all of it trend
    still = [20.0] * 40 + [20.1, 19.0] + [20.0] * 40
    series = {"swing": swing, "many": many, "daily": daily, "shifted": shifted, "still": still, "few": [20.0, 21.0, 20.5, 99.0, 20.2]}
    f = flags(spark, series, hot, max_mads=20.0, phases=48)
    for s, values in series.items():
        rows = sorted((i, x) for (name, i), x in f.items() if name == s)
        v = np.array(values)
        inside = (v >= -60) & (v <= 150)
        off = np.abs(v - np.median(v[inside]))
        assert [x.spike for _, x in rows] == (off > 20 * np.median(off[inside])).tolist(), s
        y = np.array([x.residual for _, x in rows])[inside]
        esd = [x.esd for _, x in rows]
        want = plain_esd(y - np.median(y), min(int(len(y) * 0.05) + 1, len(y) - 3), 0.001)
        if s not in ("still", "few"):  # equal values, which of them go is open here
            assert {k for k, i in enumerate(np.flatnonzero(inside)) if esd[i]} == want, s
        if s == "swing":
            assert {100, 300} <= {k for k, e in enumerate(esd) if e} and [x.checked for _, x in rows] == (np.array(esd) | ~inside).tolist()


def test_p5_found_runs_the_esd_test(spark, small):
    assert "esd_taken(" in corpus.p5_found(spark, small)._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    assert flag_readings(spark.createDataFrame([], R), spark.createDataFrame([], L)).count() == 0
    assert flag_readings(spark.createDataFrame([], R), spark.createDataFrame([], L), trend_s=None, period_s=None, max_mads=20.0).count() == 0

import random

from pyspark.sql import functions as F

from quillon.operators.ordered import Segmented, exact_medians


def rows(seed=1):
    r = random.Random(seed)
    return [("hot", float(r.randrange(40)), 1) for _ in range(500)] + [("cold", float(r.randrange(5)), 1) for _ in range(9)] + [(None, 1.0, 1)]


def test_places_do_not_depend_on_segments(spark):
    df = spark.createDataFrame(rows(), "k string, v double, w int")

    def places(limit):
        s = Segmented(df, ["k"], "v", limit)
        d = s.add_sums(s.df, {"n": F.lit(1), "x": F.col("v") / 7})
        d = d.withColumns({"rk": F.rank().over(s.window()) + F.col("n"), "x": F.col("x") + F.sum(F.col("v") / 7).over(s.window())})
        return s.hot is not None, sorted((str(r.k), r.v, r.rk, round(r.x, 9)) for r in d.collect())

    assert places(10**6)[0] is False
    for limit in (5, 50, 200):
        assert places(limit) == (True, places(10**6)[1])
    values = sorted(v for k, v, _ in rows() if k == "hot")
    assert all(rk == values.index(v) + 1 for k, v, rk, _ in places(50)[1] if k == "hot")


def test_segments_follow_the_size(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    sizes = [r["count"] for r in Segmented(df, ["k"], "v", 500).df.groupBy("__seg").count().collect()]
    assert 30 <= len(sizes) <= 60 and max(sizes) < 1000


def test_exact_medians(spark):
    df = spark.createDataFrame(rows(), "k string, v double, w int")
    counts = df.groupBy("k", "v").agg(F.count("w").alias("w"))
    for limit in (5, 10**6):
        got = {r.k: (r.m, r["__total"]) for r in exact_medians(counts, ["k"], "v", "w", "m", limit).collect() if r.k}
        for k in ("hot", "cold"):
            v = sorted(x for kk, x, _ in rows() if kk == k)
            n = len(v)
            assert got[k] == ((v[(n - 1) // 2] + v[n // 2]) / 2, n)


def test_equal_values_share_a_segment(spark):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("a", 2.0)] * 50, "k string, v double")
    s = Segmented(df, ["k"], "v", 10)
    assert s.hot is not None
    assert s.df.groupBy("v").agg(F.count_distinct("__seg").alias("n")).where("n > 1").isEmpty()


def test_empty(spark):
    df = spark.createDataFrame([], "k string, v double, w long")
    assert Segmented(df, ["k"], "v", 5).df.count() == 0
    assert exact_medians(df, ["k"], "v", "w", "m").count() == 0

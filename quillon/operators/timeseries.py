"""Time series (series, ts, value): statistics, windows, anomalies, warping distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import epoch_us


def between(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Readings from start (included) to end (excluded)."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def statistics(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, mean, population deviation, min and max of each series."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_dev"), F.min(value).alias("min"), F.max(value).alias("max"))


def nearest_rank_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """(keys, total, value): the value at place round(p / 100 * (n - 1)) of each series in ascending order, nulls left out."""
    from quillon.operators.ordered import Segmented

    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("w"))
    s = Segmented(counts, keys, value)
    d = s.add_before(s.df, "w", "base").withColumn("upto", F.col("base") + F.sum("w").over(s.window().rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.groupBy(*keys).agg(F.sum("w").alias("total"))
    place = F.floor(F.lit(p / 100) * (F.col("total") - 1) + 0.5) + 1
    return d.join(total, keys).where((F.col("upto") >= place) & (F.col("upto") - F.col("w") < place)).select(*keys, "total", value)


def tumbling(df: DataFrame, keys: list[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Windows aligned to the epoch: (keys, start, n, total)."""
    return df.groupBy(*keys, F.window(ts, f"{seconds} seconds").start.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def hopping(df: DataFrame, keys: list[str], seconds: int, slide: int, ts: str = "ts", value: str = "value") -> DataFrame:
    return df.groupBy(*keys, F.window(ts, f"{seconds} seconds", f"{slide} seconds").start.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sessions(df: DataFrame, keys: list[str], gap_s: int, ts: str = "ts", value: str = "value") -> DataFrame:
    w = df.groupBy(*keys, F.session_window(ts, f"{gap_s} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(*keys, F.col("w.start").alias("start"), "n", "total")


def anchored_tumbling(df: DataFrame, keys: list[str], seconds: float, ts: str = "ts", value: str = "value") -> DataFrame:
    """Windows anchored to the data: one opens at the first reading, the next at the reading that closed the one before.

    (keys, start, n, mean). Each window's start depends on the one before, so a series is folded in order: readings
    are sorted by series and time on each task, and a series streams through it in batches without being held.
    """
    width = int(seconds * 1_000_000)
    src = df.where(F.col(ts).isNotNull()).select(*keys, epoch_us(ts).alias("us"), F.col(value).cast("double").alias("v"))
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, n, total = None, 0, 0, 0.0
        for d in parts:
            rows = []
            for row in d.itertuples(index=False):
                k, us, v = row[:-2], row[-2], row[-1]
                if k != key or us - start >= width:
                    if n:
                        rows.append((*key, start, n, total / n))
                    key, start, n, total = k, us, 0, 0.0
                n += 1
                total += 0.0 if v is None or v != v else v
            yield pd.DataFrame(rows, columns=[*keys, "start_us", "n", "mean"])
        if n:
            yield pd.DataFrame([(*key, start, n, total / n)], columns=[*keys, "start_us", "n", "mean"])

    return src.repartition(*keys).sortWithinPartitions(*keys, "us").mapInPandas(fold, f"{kinds}, start_us long, n long, mean double")


def anomalies(df: DataFrame, keys: list[str], value: str = "value", limit: float = 2.0) -> DataFrame:
    """Readings further than `limit` population deviations from their series' mean; none in series of under 3 readings or without spread."""
    s = df.groupBy(*keys).agg(F.count(value).alias("__n"), F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(s, keys).where((F.col("__n") >= 3) & (F.col("__s") >= 1e-10) & (F.abs(F.col(value) - F.col("__m")) > limit * F.col("__s"))).drop("__n", "__m", "__s")


def dtw(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """Dynamic time warping distance with absolute differences and an optional band; infinite for empty or over-long series.

    Worked diagonal by diagonal (cells i + j = d), each of which follows from the two before in a few array operations.
    """
    n, m = len(a), len(b)
    if not n or not m or n > 100_000 or m > 100_000:
        return float("inf")
    band = max(n, m) if window is None else max(window, abs(n - m))
    before, last, now = (np.full(n + 2, np.inf) for _ in range(3))
    before[0] = 0.0
    turned = b[::-1]
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m, -((band - d) // 2)), min(n, d - 1, (d + band) // 2)
        if lo > hi:  # a band of 0 has no cell on every other diagonal
            now[:] = np.inf
        else:
            cost = np.abs(a[lo - 1 : hi] - turned[m - d + lo : m - d + hi + 1])
            best = np.minimum(np.minimum(last[lo - 1 : hi], last[lo : hi + 1]), before[lo - 1 : hi])
            now[lo : hi + 1] = cost + best
            now[lo - 1] = now[hi + 1] = np.inf
        before, last, now = last, now, before
    return float(last[n])


def dtw_distances(pairs: DataFrame, a: str, b: str, window: int | None = None) -> DataFrame:
    """Add `dtw` for two array columns."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([dtw(np.asarray(p, float), np.asarray(q, float), window) if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    return pairs.withColumn("dtw", f(a, b))

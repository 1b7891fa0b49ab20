"""Implausible readings, judged by each sensor's own behaviour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordered import HOT_ROWS, Segmented, exact_medians
from quillon.runtime import cut, epoch_us

HOT_SENSORS = 10_000


def sensor_readings(reports: DataFrame) -> DataFrame:
    """One row per reading of a report: report_id, pos, sensor_id, sensor_type, unit, v, us; repeated rows are still there.

    Null and empty lists, null readings, null sensors and null or NaN values give no row. A null ts takes the report's.
    """
    r = reports.select("report_id", epoch_us("ts").alias("report_us"), F.posexplode("readings").alias("pos", "r"))
    r = r.select("report_id", "pos", "r.sensor_id", "r.sensor_type", "r.unit", F.col("r.value").cast("double").alias("v"), F.coalesce(epoch_us(F.col("r.ts")), "report_us").alias("us"))
    return r.where("report_id is not null and sensor_id is not null and v is not null and not isnan(v)")


def _upper_normal(p: np.ndarray) -> np.ndarray:
    """z with P(Z > z) = p for 0 < p <= 0.5 (Abramowitz and Stegun 26.2.23, error below 4.5e-4)."""
    # fixed values: coefficients of the published approximation
    c, d = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
    t = np.sqrt(-2 * np.log(p))
    return t - (c[0] + c[1] * t + c[2] * t * t) / (1 + d[0] * t + d[1] * t * t + d[2] * t * t * t)


def gesd_critical(n: int, steps: np.ndarray, alpha: float) -> np.ndarray:
    """Critical values of the given steps (from 1) of the generalised extreme studentised deviate test over n values."""
    left = n - np.asarray(steps, float) + 1
    z = _upper_normal(alpha / (2 * left))
    nu = np.maximum(left - 2, 1)
    t = z + (z**3 + z) / (4 * nu) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * nu**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * nu**3)
    return (left - 1) * t / np.sqrt((nu + t * t) * left)


def gesd(low: np.ndarray, high: np.ndarray, n: int, total: float, square: float, most: int, alpha: float) -> tuple[int, int]:
    """How many of the lowest and of the highest of n values the generalised ESD test takes away.

    low: the lowest `most` values, ascending; high: the highest, descending; total and square: sums of all values
    and of their squares. Each step takes away the value furthest from the mean of those left, which is the lowest
    or the highest left (the highest of equally far ones); the last step over its critical value counts.
    """
    most = min(most, n - 3, len(low))
    if most < 1:
        return 0, 0
    limit = gesd_critical(n, np.arange(1, most + 1), alpha).tolist()
    lo, hi, a, b, best = low.tolist(), high.tolist(), 0, 0, (0, 0)
    for i in range(most):
        left = n - i
        mean = total / left
        upper = hi[b] - mean >= mean - lo[a]
        x = hi[b] if upper else lo[a]
        a, b = (a, b + 1) if upper else (a + 1, b)
        spread = (square - left * mean * mean) / (left - 1)
        if spread > 1e-12 * square / left and abs(x - mean) > limit[i] * spread**0.5:
            best = (a, b)
        total -= x
        square -= x * x
    return best


def _taken(low: np.ndarray, high: np.ndarray, n: int, total: float, square: float, alpha: float, max_share: float) -> tuple[int, int]:
    """gesd of which up to max_share of the n values can be taken away."""
    k = int(n * max_share) + 1
    return gesd(low[:k], high[:k], n, total, square, k, alpha)


class _Whole:
    """Sensors that fit into a task: rows are partitioned by sensor once, and every step keeps that."""

    def prepared(self, r: DataFrame) -> DataFrame:
        return r.repartition("sensor_id").distinct()

    def frozen(self, r: DataFrame, run_length: int) -> DataFrame:
        w = Window.partitionBy("sensor_id").orderBy("us", "report_id", "pos")
        r = r.withColumn("new", F.when(F.lag("v").over(w) == F.col("v"), 0).otherwise(1))
        r = r.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return r.withColumn("frozen", F.count(F.lit(1)).over(Window.partitionBy("sensor_id", "run")) >= run_length).drop("new", "run")

    def median(self, r: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
        return r.withColumn(name, F.median(F.when(F.col("inside"), F.col(col))).over(Window.partitionBy(*keys)))

    def beside(self, r: DataFrame, col: str) -> DataFrame:
        by = Window.partitionBy("sensor_id").orderBy("span")
        return r.withColumns({"before": F.max(col).over(by.rangeBetween(-1, -1)), "after": F.max(col).over(by.rangeBetween(1, 1))})

    def ranked(self, r: DataFrame) -> DataFrame:
        w = Window.partitionBy("sensor_id", "inside").orderBy("y", "us", "report_id", "pos")
        return r.withColumn("place", F.row_number().over(w).cast("long"))

    def tested(self, r: DataFrame, alpha: float, max_share: float) -> DataFrame:
        """Add `taken`: how many of the lowest and of the highest in-range y the ESD test takes away, and how many there are."""

        def esd_taken(y: pd.Series, inside: pd.Series) -> list:
            own = np.sort(y.to_numpy(float)[inside.to_numpy(bool)])
            return [*_taken(own, own[::-1], len(own), float(own.sum()), float((own * own).sum()), alpha, max_share), len(own)]

        return r.withColumn("taken", F.pandas_udf(esd_taken, "array<long>")("y", "inside").over(Window.partitionBy("sensor_id")))

    def largest(self, r: DataFrame, col: Column, name: str) -> DataFrame:
        return r.withColumn(name, F.max(col).over(Window.partitionBy("sensor_id")))


class _Cut:
    """Sensors with more rows than a task should sort: medians from value counts, orders in segments."""

    def __init__(self, limit: int):
        self.limit = limit

    def prepared(self, r: DataFrame) -> DataFrame:
        return cut(r.distinct())

    def frozen(self, r: DataFrame, run_length: int) -> DataFrame:
        s = Segmented(r, ["sensor_id"], "us", self.limit)
        w = s.window("us", "report_id", "pos")
        d = s.carry(s.df, "v", ("us", "report_id", "pos"), "carried")
        d = d.withColumn("new", F.when(F.coalesce(F.lag("v").over(w), "carried") == F.col("v"), 0).otherwise(1))
        d = s.add_before(d, "new", "runs_before").withColumn("run", F.col("runs_before") + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        runs = d.groupBy("sensor_id", "run").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= run_length).select("sensor_id", "run", F.lit(True).alias("frozen"))
        d = d.join(runs, ["sensor_id", "run"], "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
        return cut(d.drop("__seg", "carried", "new", "runs_before", "run"))

    def median(self, r: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
        counts = r.where("inside").groupBy(*keys, col).agg(F.count(F.lit(1)).alias("w"))
        med = exact_medians(counts, keys, col, "w", "__m", self.limit).drop("__total")
        return cut(r.join(med, keys, "left").withColumnRenamed("__m", name))

    def beside(self, r: DataFrame, col: str) -> DataFrame:
        per = r.groupBy("sensor_id", "span").agg(F.max(col).alias("m"))
        for name, step in (("before", 1), ("after", -1)):
            r = r.join(per.select("sensor_id", (F.col("span") + step).alias("span"), F.col("m").alias(name)), ["sensor_id", "span"], "left")
        return r

    def ranked(self, r: DataFrame) -> DataFrame:
        s = Segmented(r, ["sensor_id", "inside"], "y", self.limit)
        d = s.add_before(s.df, F.lit(1), "earlier")
        return cut(d.withColumn("place", F.col("earlier") + F.row_number().over(s.window("y", "us", "report_id", "pos"))).drop("earlier", "__seg"))

    def tested(self, r: DataFrame, alpha: float, max_share: float) -> DataFrame:
        per = r.where("inside").groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.sum(F.col("y") * F.col("y")).alias("square"))
        most = F.floor(F.col("n") * F.lit(max_share)) + 1
        ends = r.where("inside").join(F.broadcast(per), "sensor_id").where((F.col("place") <= most) | (F.col("place") > F.col("n") - most)).select("sensor_id", "place", "y", "n", "total", "square")

        def esd_taken(d: pd.DataFrame) -> pd.DataFrame:
            n, total, square = int(d["n"].iloc[0]), float(d["total"].iloc[0]), float(d["square"].iloc[0])
            y = d["y"].to_numpy()[np.argsort(d["place"].to_numpy())]
            return pd.DataFrame({"sensor_id": [d["sensor_id"].iloc[0]], "taken": [[*_taken(y, y[::-1], n, total, square, alpha, max_share), n]]})

        out = ends.groupBy("sensor_id").applyInPandas(esd_taken, "sensor_id string, taken array<long>")
        return r.join(F.broadcast(out), "sensor_id", "left")  # at most HOT_SENSORS rows

    def largest(self, r: DataFrame, col: Column, name: str) -> DataFrame:
        per = r.groupBy("sensor_id").agg(F.max(col).alias(name))
        return r.join(F.broadcast(per), "sensor_id", "left")  # at most HOT_SENSORS rows


def decompose(r: DataFrame, way: _Whole | _Cut, *, trend_s: int | None, period_s: int | None, phases: int, rounds: int = 2) -> DataFrame:
    """Add `trend`, `season` and `residual`, the robust parts that a value is the sum of; level: the sensor's median.

    Only rows `inside` shape the parts. Trend: medians of spans of `trend_s` seconds of what the season leaves, joined
    by lines between the spans' middles where the neighbouring span has readings (None: the level). Season: the
    median of what the trend leaves in each of `phases` parts of the period (None: 0). Both are found in turn,
    `rounds` times, so that a season doesn't bend the trend.
    """
    r = way.median(r, ["sensor_id"], "v", "level").withColumn("season", F.lit(0.0))
    if trend_s is not None:
        width = trend_s * 1_000_000
        r = r.withColumn("span", F.floor(F.col("us") / width))
        part = (F.col("us") - F.col("span") * width) / width - 0.5  # from -0.5 to 0.5 round the span's middle
    if period_s is not None:
        r = r.withColumn("phase", F.floor(F.pmod(F.col("us"), F.lit(period_s * 1_000_000)) * phases / (period_s * 1_000_000)))
    r = r.withColumn("trend", F.coalesce("level", "v"))
    for _ in range(rounds if trend_s is not None and period_s is not None else 1):
        if trend_s is not None:
            r = way.median(r.withColumn("rest", F.col("v") - F.col("season")), ["sensor_id", "span"], "rest", "m")
            r = way.beside(r, "m")
            other = F.coalesce(F.when(part < 0, F.col("before")).otherwise(F.col("after")), "m")
            r = r.withColumn("trend", F.coalesce(F.col("m") + (other - F.col("m")) * F.abs(part), "level", "v")).drop("rest", "m", "before", "after")
        if period_s is not None:
            r = way.median(r.withColumn("rest", F.col("v") - F.col("trend")), ["sensor_id", "phase"], "rest", "m")
            r = r.withColumn("season", F.coalesce("m", F.lit(0.0))).drop("rest", "m")
    return r.withColumn("residual", F.col("v") - F.col("trend") - F.col("season")).drop("span", "phase")


def _with_esd(r: DataFrame, way: _Whole | _Cut, alpha: float, max_share: float) -> DataFrame:
    """Add `esd` by the generalised ESD test over each sensor's in-range residuals, of which up to max_share can be spikes.

    The test only ever looks at the lowest and highest max_share of the residuals; it gives back how many of each end
    are spikes, and the places of the residuals, ranked in the JVM, say which.
    """
    r = way.median(r, ["sensor_id"], "residual", "mid")
    r = way.tested(way.ranked(r.withColumn("y", F.col("residual") - F.coalesce("mid", F.lit(0.0)))), alpha, max_share)
    lows, highs, n = (F.get("taken", F.lit(i)) for i in range(3))
    return r.withColumn("esd", F.coalesce(F.col("inside") & ((F.col("place") <= lows) | (F.col("place") > n - highs)), F.lit(False)))


def _beyond(r: DataFrame, way: _Whole | _Cut, max_mads: float) -> DataFrame:
    """Add `mad`, `checked` and `spike`: readings further from the level than max_mads median departures.

    Only readings `checked` are compared with the limit: those that the ESD test took away or that are out of range, and
    those of which trend, season and `kept`, the largest residual that the test left the sensor, could together reach it.
    No other reading can be beyond it, as its departure is at most their sum.
    """
    r = way.median(r.withColumn("off", F.abs(F.col("v") - F.col("level"))), ["sensor_id"], "off", "mad")
    r = way.largest(r, F.when(F.col("inside") & ~F.col("esd"), F.abs("residual")), "kept")
    limit = F.col("mad") * max_mads
    within = (F.abs(F.col("trend") - F.col("level")) + F.abs("season") + F.col("kept")) * 1.001 < limit  # a thousandth for rounding
    r = r.withColumn("checked", F.col("esd") | ~F.col("inside") | ~F.coalesce(within, F.lit(False)))
    return r.withColumn("spike", F.coalesce(F.col("checked") & (F.col("off") > limit), F.lit(False)))


def flag_readings(
    reports: DataFrame, limits: DataFrame, *, trend_s: int | None = 86_400, period_s: int | None = 86_400, phases: int = 24,
    max_mads: float | None = None, alpha: float = 0.001, max_share: float = 0.05, run_length: int = 6, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every reading with three independent flags and its residual from the sensor's usual behaviour.

    out_of_range: below min_value or above max_value for its sensor_type and unit (never without such a limit).
    spike: the residual of a robust trend and season (see decompose) lies beyond the generalised ESD limit at
    `alpha`, where up to `max_share` of a sensor's in-range readings can be spikes. With `max_mads` the result of this
    test is `esd`, and a spike is a reading whose departure from the sensor's level (trend - level + season + residual)
    is more than that many times the median departure of in-range readings; trend, season and the test say which
    readings are `checked` for it (see _beyond). In-range readings alone shape trend, season, level and limits; a
    sensor without any has no spikes.
    frozen: one of `run_length` or more equal values that follow each other by time (then report and position).

    A sensor of more than `hot_rows` readings is ordered in segments and its medians come from value counts; the
    flags are the same (runs may span segments). See sensor_readings for nulls; rows repeated verbatim count once.
    Empty tables give no rows; extra columns are ignored. Columns: report_id, pos, sensor_id, sensor_type, unit, v,
    us, out_of_range, residual, mad (with max_mads, else null), esd, checked (true without max_mads), spike, frozen.
    """
    lim = limits.groupBy(F.col("sensor_type").alias("lt"), F.col("unit").alias("lu")).agg(F.min("min_value").alias("lo"), F.max("max_value").alias("hi"))
    r = sensor_readings(reports)
    large = r.groupBy("sensor_id").count().where(F.col("count") > hot_rows).orderBy(F.desc("count"), "sensor_id").limit(HOT_SENSORS)
    hot = [(x["sensor_id"],) for x in large.collect()]
    keys = F.broadcast(r.sparkSession.createDataFrame(hot, "sensor_id string"))  # at most HOT_SENSORS keys
    sides = [(r.join(keys, "sensor_id", "left_anti") if hot else r, _Whole())] + ([(r.join(keys, "sensor_id", "left_semi"), _Cut(hot_rows))] if hot else [])
    out = None
    for side, way in sides:
        d = way.prepared(side).join(lim, (F.col("sensor_type") == F.col("lt")) & (F.col("unit") == F.col("lu")), "left")
        d = d.withColumn("out_of_range", F.coalesce((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")), F.lit(False))).withColumn("inside", ~F.col("out_of_range")).drop("lt", "lu", "lo", "hi")
        d = decompose(way.frozen(d, run_length), way, trend_s=trend_s, period_s=period_s, phases=phases)
        d = _with_esd(d, way, alpha, max_share)
        if max_mads is not None:
            d = _beyond(d, way, max_mads)
        else:
            d = d.withColumns({"mad": F.lit(None).cast("double"), "checked": F.lit(True), "spike": F.col("esd")})
        d = d.select("report_id", "pos", "sensor_id", "sensor_type", "unit", "v", "us", "out_of_range", "residual", "mad", "esd", "checked", "spike", "frozen")
        out = d if out is None else out.union(d)
    return out

"""Spatio-temporal rules over events (entity_id, lon, lat, us). Each rule returns the events that fire it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.geo import haversine

Circle = tuple[float, float, float]  # lon, lat, metres


def _within(c: Circle) -> Column:
    return haversine(F.col("lon"), F.col("lat"), F.lit(c[0]), F.lit(c[1])) <= c[2]


def _by_entity(*more: str) -> Window:
    return Window.partitionBy("entity_id").orderBy("us", *more)


def enter(ev: DataFrame, region: Circle) -> DataFrame:
    """Every event inside."""
    return ev.where(_within(region))


def exit_(ev: DataFrame, region: Circle) -> DataFrame:
    """Outside now, and inside at some earlier event of the entity."""
    w = _by_entity("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return ev.withColumn("was", F.max(F.when(_within(region), 1)).over(w)).where(F.col("was").isNotNull() & ~_within(region)).drop("was")


def dwell(ev: DataFrame, region: Circle, seconds: float, *, true_dwell: bool = False) -> DataFrame:
    """Inside now, and at least `seconds` after the most recent earlier event inside; with true_dwell after the first
    event of the present unbroken stay."""
    w = _by_entity("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = ev.withColumn("in", _within(region))
    if true_dwell:
        left = F.max(F.when(~F.col("in"), F.col("us"))).over(w)
        e = e.withColumn("left", left)
        since = F.min(F.when(F.col("in"), F.col("us"))).over(Window.partitionBy("entity_id", "left").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1))
        return e.withColumn("since", since).where(F.col("in") & (F.col("us") - F.col("since") >= seconds * 1e6)).drop("in", "left", "since")
    return e.withColumn("last", F.last(F.when(F.col("in"), F.col("us")), ignorenulls=True).over(w)).where(F.col("in") & (F.col("us") - F.col("last") >= seconds * 1e6)).drop("in", "last")


def proximity(ev: DataFrame, other: str, metres: float) -> DataFrame:
    """Events of other entities within `metres` of any earlier event of the entity `other`.

    Both sides meet by cells of latitude, so the other entity's track is not compared with every event.
    """
    step = metres / 111_000.0 + 1e-9
    track = ev.where(F.col("entity_id") == other).select(F.col("lon").alias("olon"), F.col("lat").alias("olat"), F.col("us").alias("ous"), F.floor(F.col("lat") / step).alias("cell"))
    mine = ev.where(F.col("entity_id") != other).withColumn("cell", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("lat") / step) + k)))
    near = mine.join(track, "cell").where((F.col("ous") <= F.col("us")) & (haversine(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat")) <= metres))
    return near.select(*ev.columns).distinct()


def _moves(ev: DataFrame) -> DataFrame:
    w = _by_entity("event_id")
    e = ev.withColumns({"plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w), "pus": F.lag("us").over(w)}).where("pus is not null")
    return e.withColumns({"moved": haversine(F.col("plon"), F.col("plat"), F.col("lon"), F.col("lat")), "secs": (F.col("us") - F.col("pus")) / 1e6})


def speeding(ev: DataFrame, metres_per_s: float) -> DataFrame:
    """Faster than the limit since the entity's previous event."""
    return _moves(ev).where((F.col("secs") > 0) & (F.col("moved") > metres_per_s * F.col("secs"))).select(*ev.columns)


def stopped(ev: DataFrame, metres: float, seconds: float) -> DataFrame:
    """Moved at most `metres` in at least `seconds` since the previous event."""
    return _moves(ev).where((F.col("moved") <= metres) & (F.col("secs") >= seconds)).select(*ev.columns)


def turned(ev: DataFrame, low: float, high: float) -> DataFrame:
    """Moved in a bearing (degrees from north, clockwise) from low to high."""
    lat1, lat2, d = F.radians("plat"), F.radians("lat"), F.radians(F.col("lon") - F.col("plon"))
    bearing = F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d))), F.lit(360.0))
    return _moves(ev).where((F.col("moved") > 0) & bearing.between(low, high)).select(*ev.columns)


def recurring(ev: DataFrame, region: Circle, seconds: int, visits: int) -> DataFrame:
    """Inside, with at least `visits` events inside within the last `seconds`, this one included."""
    w = Window.partitionBy("entity_id").orderBy("us").rangeBetween(-int(seconds * 1e6), 0)
    return ev.where(_within(region)).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= visits).drop("n")


def unusual_place(ev: DataFrame, known: list[Circle]) -> DataFrame:
    return ev.where(~reduce(lambda a, b: a | b, map(_within, known), F.lit(False)))


def unusual_hour(ev: DataFrame, region: Circle, hours: list[int]) -> DataFrame:
    """Inside at a UTC hour that isn't expected."""
    return ev.where(_within(region) & ~F.floor(F.pmod(F.col("us") / 3.6e9, F.lit(24.0))).cast("int").isin(hours))


def evaluate(ev: DataFrame, rules: dict[str, tuple]) -> DataFrame:
    """All rules at once: name -> (function, arguments...); rows are the events with the rule's name."""
    parts = [f(ev, *args).select(*ev.columns).withColumn("rule", F.lit(name)) for name, (f, *args) in rules.items()]
    return reduce(DataFrame.unionByName, parts)


def nearest(points: DataFrame, lon: float, lat: float, k: int, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """The k points nearest to a place in a time range (both ends included), nearest first, with metres."""
    if start_us is not None:
        points = points.where(F.col("us").between(start_us, end_us))
    return points.withColumn("metres", haversine(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))).orderBy("metres", points.columns[0]).limit(k)

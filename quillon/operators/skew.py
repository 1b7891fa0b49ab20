"""Per-key results where a few keys hold most records."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import cut, tidy_name

HEAVY_SHARE = 1 / 1000
SKETCH_ITEMS = 10_000
BROADCAST_BYTES = 2 << 20
ROW_BYTES = 48  # of a broadcast pair of keys, besides their letters


def tidy_links(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(s, t): all links, with keys trimmed and in lower case; blank keys are null."""
    return links.select(tidy_name(source).alias("s"), tidy_name(target).alias("t"))


def heavy_keys(links: DataFrame, *, source: str = "source", target: str = "target", share: float = HEAVY_SHARE, sketch_items: int = SKETCH_ITEMS) -> dict[str, tuple[int, int]]:
    """Keys that hold at least about `share` of the links at one of their ends: key -> (links from it, links to it).

    One pass with two frequent-item sketches of at most `sketch_items` keys each, which are merged in two steps
    without moving rows. At most 2 / share keys can come out, so they may be broadcast whatever the size of the data. The numbers
    are estimates; a key missed or added only changes which of two equivalent ways its rows go.
    """
    k = int(1 / share)
    items = max(sketch_items, 3 * k)
    e = tidy_links(links, source, target).where("s != t")
    groups = max(1, math.isqrt(e.rdd.getNumPartitions()))  # sketches are merged in two steps, so that no task reads those of all others
    part = cut(e.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups))).agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"approx_top_k_accumulate({c}, {items})").alias(c) for c in "st")))
    if part.isEmpty():
        return {}
    state = part.agg(F.sum("n").alias("n"), *(F.expr(f"approx_top_k_combine({c}, {items})").alias(c) for c in "st"))
    got = state.select(F.coalesce("n", F.lit(0)).alias("n"), *(F.expr(f"approx_top_k_estimate({c}, {k})").alias(c) for c in "st")).first()
    ends = [{r["item"]: r["count"] for r in got[end] or []} for end in ("s", "t")]
    # a key that isn't listed at an end has at most as many links there as the last one listed, or as the sketch may miss
    rest = [max(min(e.values()) if len(e) == k else 0, -(-4 * got["n"] // items)) for e in ends]
    least = max(2.0, share * got["n"])
    return {x: (ends[0].get(x, rest[0]), ends[1].get(x, rest[1])) for x in sorted({x for e in ends for x, n in e.items() if n >= least})}


def reciprocal_pairs(links: DataFrame, *, source: str = "source", target: str = "target", share: float = HEAVY_SHARE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the pairs of keys linked in both directions, once each.

    Three passes over the links. A sketch finds heavy keys (a link between two broadcast ones belongs to the smaller one).
    Of a heavy key, the direction with fewer links is broadcast, fewest first, while all broadcast pairs together
    stay within `broadcast_bytes` by the sketch's counts; the links of the other direction stream past them in the last pass, and
    only those that meet their counterpart go on. All other links, among them those of heavy keys beyond the bound,
    are reduced to one row per pair on the map side before an ordinary shuffle by both ends, which spreads even one
    key over all tasks, so nothing hangs on the broadcast. Both kinds are united in that last aggregation.

    Null and blank keys and links of a key to itself don't count; keys are compared trimmed and in lower case;
    parallel and repeated links count once. Empty tables give no rows; extra columns are ignored.
    """
    spark, e = links.sparkSession, tidy_links(links, source, target).where("s != t")
    heavy = heavy_keys(links, source=source, target=target, share=share)
    used, chosen, hit = 0, set(), F.lit(None).cast("boolean")
    for n, k in sorted((min(x), k) for k, x in heavy.items()):
        used += n * (2 * len(k) + ROW_BYTES)
        if used > broadcast_bytes:
            break
        chosen.add(k)
    if chosen:
        keys = spark.createDataFrame([(k, o <= i) for k, (o, i) in heavy.items() if k in chosen], "k string, small boolean")
        e = _tagged(e, F.broadcast(keys))  # at most 2 / share rows
        build = e.where("out = small").select("h", "o").distinct().withColumn("met", F.lit(True))
        e = e.join(F.broadcast(build), ["h", "o"], "left").where("h is null or (out != small and met)")  # within broadcast_bytes
        hit = F.col("met")
    ahead, back = F.coalesce(hit, F.col("s") < F.col("t")), F.coalesce(hit, F.col("s") > F.col("t"))
    pair = e.select(F.least("s", "t").alias("key_a"), F.greatest("s", "t").alias("key_b"), ahead.alias("ahead"), back.alias("back"))
    return pair.groupBy("key_a", "key_b").agg(F.max("ahead").alias("ahead"), F.max("back").alias("back")).where("ahead and back").select("key_a", "key_b")


def _tagged(e: DataFrame, keys: DataFrame) -> DataFrame:
    """e with h and o (the end that is in keys (k, small) and the other one; null where none is), out (h is the source) and small."""
    end = lambda c: keys.select(F.col("k").alias(c), F.col("small").alias(f"small_{c}"))
    both = e.join(end("s"), "s", "left").join(end("t"), "t", "left")
    out = F.when(F.expr("small_s is not null and (small_t is null or s < t)"), True).when(F.expr("small_t is not null"), False)
    pick = lambda a, b: F.when(F.col("out"), F.col(a)).when(~F.col("out"), F.col(b))
    return both.withColumn("out", out).select("s", "t", "out", pick("s", "t").alias("h"), pick("t", "s").alias("o"), pick("small_s", "small_t").alias("small"))


def partner_counts(links: DataFrame, *, source: str = "source", target: str = "target") -> DataFrame:
    """(key, links, partners_out, partners_in, reciprocal): per-key figures, each counted over all links of the key.

    Pairs are reduced to one row with its number of links before keys are grouped, both on the map side, so a
    heavy key costs its distinct partners and never meets in one task unreduced. links counts a verbatim
    repeated row again; the other figures don't.
    """
    e = tidy_links(links, source, target).groupBy("s", "t").agg(F.count(F.lit(1)).alias("n")).where("s != t")
    ends = e.select(F.col("s").alias("k"), "n", F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("t", "n", F.lit(0), F.lit(1)))
    total = ends.groupBy("k").agg(F.sum("n").alias("links"), F.sum("o").alias("partners_out"), F.sum("i").alias("partners_in"))
    both = reciprocal_pairs(links, source=source, target=target)
    per = both.select(F.explode(F.array("key_a", "key_b")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("r"))
    return total.join(per, "k", "left").select(F.col("k").alias("key"), "links", "partners_out", "partners_in", F.coalesce("r", F.lit(0)).alias("reciprocal"))

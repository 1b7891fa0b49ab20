"""One ranking from several differently scaled scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ordered import HOT_ROWS, Segmented
from quillon.runtime import cut

HOT_GROUPS = 10_000
LEAST_LOADING = 0.1


def _loadings(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Loadings of the first principal component per group, oriented to the declared directions.

    The component's sign is the one with which most loading goes the declared way (scores are ranked best to worst
    before). A column that still loads against it contradicts the others: it counts with the least loading,
    LEAST_LOADING of the largest, in its declared direction. Where as much goes one way as the other (two columns
    that disagree) there is no common direction, and all columns count alike.

    sums holds the products of all pairs of columns, summed over the group's items, with an item's constant 1
    standing for the column "" (so sums of columns and the number of items are among them).
    """
    for d in parts:
        rows = []
        for g, weights, sums in zip(d["g"], d["weights"], d["sums"]):
            at = {(s["a"], s["b"]): s["x"] for s in sums}
            w = dict(weights)
            cols = sorted(w)
            n = at["", ""]
            mean = np.array([at.get(("", c), 0.0) for c in cols]) / n
            cov = np.array([[at.get((min(x, y), max(x, y)), 0.0) for y in cols] for x in cols]) / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            live = sd > 1e-12
            safe = np.where(live, sd, 1)
            corr = np.where(np.outer(live, live), cov / safe[:, None] / safe[None], 0)
            first = np.linalg.eigh(corr)[1][:, -1] if live.any() else np.ones(len(cols))
            way = first[live].sum()
            first = np.where(live, 1.0, 0.0) if abs(way) < 1e-6 else first * np.sign(way)
            load = np.where(live, np.maximum(first, LEAST_LOADING * first.max()), 0) * np.array([w[c] for c in cols]) / safe
            rows.append((g, dict(zip(cols, load.tolist()))))
        yield pd.DataFrame(rows, columns=["g", "per"])


def _places(s: DataFrame, limit: int | None) -> DataFrame:
    """(g, item, c, down) with `rank` (ties share the first place), `ties` and `m`, the rows of the group's column.

    Without a limit every group lies in one task; with one, groups of more rows are ranked in segments.
    """
    if limit is None:
        w = Window.partitionBy("g", "c")
        return s.withColumns({"m": F.count(F.lit(1)).over(w), "rank": F.rank().over(w.orderBy("down")), "ties": F.count(F.lit(1)).over(w.orderBy("down").rangeBetween(0, 0))})
    seg = Segmented(s, ["g", "c"], "down", limit)
    ties = F.count(F.lit(1)).over(Window.partitionBy("g", "c", "__seg", "down"))
    df = seg.add_before(seg.df, F.lit(1), "before").withColumn("rank", F.rank().over(seg.window()) + F.col("before")).withColumn("ties", ties)
    return df.join(s.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")), ["g", "c"])


def fuse_rankings(
    results: DataFrame, specs: DataFrame, *, group: str = "search_id", item: str = "doc_key", scores: str = "per_column_scores",
    column: str = "column_name", weight: str = "weight", directions: dict[str, str] | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One ranking per group from a map of scores per item.

    `directions` declares for a column whether "high" (the default) or "low" scores are better. Every score becomes
    its rank among the group's scores of that column (ties share the mean rank), as a share of 1 for the best; an
    item without a score there gets 0. From the correlation matrix of these, summed over all rows in parallel,
    comes the first principal component, whose loadings are oriented to the declared directions (see _loadings),
    are never below a tenth of the largest, so that no declared column is lost, and are multiplied by the
    weights. Items are sorted by their projection: an item that is no worse in every column never stands lower,
    and no column counts more because its numbers are larger.

    Only columns with a weight above zero for the group count (of several the largest; null and NaN don't, nor do null and empty column names).
    Null and NaN scores, columns without weight, null groups and items are left out; of several scores of an
    item in a column the best counts, so repeated rows change nothing. An item without any counting score
    isn't ranked. Groups of more than `hot_rows` rows are ranked in segments. Empty tables give no rows; other
    columns are ignored. Columns: group, item, position (ties share the first place), projection, columns (how
    many count in the group), present (how many the item has), worst_rank (its lowest place in any of them).
    """
    kind = dict(results.dtypes)[group]
    good = F.col(weight).isNotNull() & ~F.isnan(weight) & (F.col(weight) > 0) & F.col(group).isNotNull() & (F.length(column) > 0)
    w = specs.where(good).groupBy(F.col(group).cast(kind).alias("g"), F.col(column).alias("c")).agg(F.max(weight).alias("w"))
    w = w.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("c", "w"))).alias("weights"))  # one entry per declared column
    r = results.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(scores).alias("scores"))
    low = sorted(c for c, way in (directions or {}).items() if way == "low")
    if unknown := {way for way in (directions or {}).values()} - {"high", "low"}:
        raise ValueError(f"unknown direction {sorted(unknown)[0]}")
    large = r.groupBy("g").count().where(F.col("count") > hot_rows).orderBy(F.desc("count"), "g").limit(HOT_GROUPS)
    hot = [(x["g"],) for x in large.collect()]
    keys = F.broadcast(r.sparkSession.createDataFrame(hot, f"g {kind}"))  # at most HOT_GROUPS keys
    out = [_fused((r.join(keys, "g", "left_anti") if hot else r).repartition("g"), w, kind, low, None)]
    out += [_fused(r.join(keys, "g", "left_semi"), w, kind, low, hot_rows)] if hot else []
    ranked = out[0] if len(out) == 1 else out[0].union(out[1])
    return ranked.select(F.col("g").alias(group), F.col("item").alias(item), "position", "projection", "columns", "present", "worst_rank")


def _fused(r: DataFrame, w: DataFrame, kind: str, low: list[str], limit: int | None) -> DataFrame:
    """fuse_rankings over groups of one sort. Without a limit rows are partitioned by group once, and everything else keeps that."""
    s = r.join(w, "g").select("g", "item", F.explode(F.map_filter("scores", lambda k, x: x.isNotNull() & ~F.isnan(x) & F.array_contains(F.map_keys("weights"), k))).alias("c", "x"))
    best = F.when(F.col("c").isin(low), F.min("x")).otherwise(-F.max("x")) if low else -F.max("x")
    s = s.groupBy("g", "item", "c").agg((best + F.lit(0.0)).alias("down"))
    df = _places(s, limit).select("g", "item", "c", F.col("rank").cast("long").alias("rank"), ((F.col("m") - F.col("rank") - (F.col("ties") - 1) / 2 + 0.5) / F.col("m")).alias("p"))
    items = df.groupBy("g", "item").agg(F.sort_array(F.collect_list(F.struct("c", "p", "rank"))).alias("xs"))  # one entry per counting column

    one = F.concat(F.array(F.struct(F.lit("").alias("c"), F.lit(1.0).alias("p"))), F.transform("xs", lambda e: F.struct(e["c"].alias("c"), e["p"].alias("p"))))
    pairs = items.select("g", one.alias("ys")).select("g", F.explode("ys").alias("a"), "ys").select("g", "a", F.explode("ys").alias("b")).where("a.c <= b.c")
    sums = pairs.groupBy("g", F.col("a.c").alias("a"), F.col("b.c").alias("b")).agg(F.sum(F.col("a.p") * F.col("b.p")).alias("x"))
    model = sums.groupBy("g").agg(F.collect_list(F.struct("a", "b", "x")).alias("sums")).join(w, "g")
    load = model.mapInPandas(_loadings, f"g {kind}, per map<string, double>")

    out = items.join(load, "g")
    proj = F.aggregate("xs", F.lit(0.0), lambda t, e: t + e["p"] * F.element_at(F.col("per"), e["c"]))
    out = out.select("g", "item", proj.alias("projection"), F.size("per").alias("columns"), F.size("xs").alias("present"), F.array_max(F.transform("xs", lambda e: e["rank"])).alias("worst_rank")).withColumn("down", -F.col("projection"))
    if limit is None:
        return out.withColumn("position", F.rank().over(Window.partitionBy("g").orderBy("down")).cast("long"))
    seg = Segmented(cut(out), ["g"], "down", limit)
    return seg.add_before(seg.df, F.lit(1), "before").withColumn("position", (F.rank().over(seg.window()) + F.col("before")).cast("long")).drop("__seg", "before")


def front(ranking: DataFrame, first: int = 5) -> DataFrame:
    """The items of a fused ranking that are among the `first` in every counting column.

    Whatever stands before such an item beats it in some column, where at most first - 1 items do, so it is among
    the first (first - 1) * columns + 1 positions of the ranking. Those are the candidates; their places in the
    columns are then checked exactly, and it is this check that decides.
    """
    candidates = ranking.where((F.col("position") <= (first - 1) * F.col("columns") + 1) & (F.col("present") == F.col("columns")))
    return candidates.where(F.col("worst_rank") <= first)

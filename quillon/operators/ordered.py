"""Orderings within groups of any size.

A window over a group sorts that group in one task. Where one group may hold a third of all rows, the group is
cut into value ranges ("segments") first; sums over segments then link the ranges. A group of n rows above
`limit` gets about n / limit segments, so every task sorts about `limit` rows whatever the size of the data.
The driver holds the cuts, of which there are never more than MAX_CUTS: where that many segments of `limit` rows
don't suffice, segments grow with the data (at 10^12 rows to some 10^7 rows, which a task still sorts).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CUTS = 100_000
HOT_ROWS = 500_000
PER_SEGMENT = 64  # sampled rows a segment, from which the cuts are taken


class Segmented:
    """A DataFrame with a column `__seg`; rows of equal order value always share a segment."""

    def __init__(self, df: DataFrame, keys: list[str], order: str, limit: int = HOT_ROWS):
        self.keys, self.order = keys, order
        per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
        hot = per.orderBy(F.desc("__n"), *keys).limit(MAX_CUTS).collect()
        self.hot = None
        if not hot:
            self.df = df.withColumn("__seg", F.lit(0))
            return
        limit *= max(1.0, sum(r["__n"] for r in hot) / limit * 2 / MAX_CUTS)
        hot = [r for r in hot if r["__n"] > limit] or hot[:1]
        spark, key = df.sparkSession, [df.schema[k] for k in keys]
        rate = min(1.0, PER_SEGMENT / limit)
        own = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], T.StructType(key))
        hit = df.alias("d").join(F.broadcast(own.alias("h")), self._same("h")("d"), "left_semi")  # at most MAX_CUTS rows
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        cuts = hit.select(*keys, order).sample(rate, seed=13).withColumn("__i", place).where(F.col("__i") % PER_SEGMENT == 0).select(*keys, order).distinct().collect()
        by: dict[tuple, list] = {tuple(r[k] for k in keys): [] for r in hot}
        for r in cuts:
            by[tuple(r[k] for k in keys)].append(r[order])
        rows = []
        for k, own_cuts in by.items():  # a list of lists, so that a place is found in two short scans
            own_cuts.sort()
            step = max(1, math.isqrt(len(own_cuts)))
            parts = [own_cuts[i : i + step] for i in range(0, len(own_cuts), step)]
            rows.append((*k, [p[-1] for p in parts], parts, step))
        kind = T.ArrayType(df.schema[order].dataType)
        schema = T.StructType([*key, T.StructField("__top", kind), T.StructField("__cuts", T.ArrayType(kind)), T.StructField("__step", T.IntegerType())])
        self.hot = spark.createDataFrame(rows, schema)
        less = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col(f"d.{order}")))
        at = df.alias("d").join(F.broadcast(self.hot.alias("h")), self._same("h")("d"), "left").withColumn("__at", less("h.__top"))
        inner = F.coalesce(less(F.get("h.__cuts", F.col("__at"))), F.lit(0))
        seg = F.when(F.col("h.__step").isNull(), 0).otherwise(F.col("__at") * F.col("h.__step") + F.greatest(inner, F.lit(0)))
        self.df = at.select("d.*", seg.cast("int").alias("__seg"))

    def _same(self, right: str):
        def build(left: str) -> Column:
            on = F.lit(True)
            for k in self.keys:
                on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
            return on

        return build

    def window(self, *order: Column | str) -> Window:
        return Window.partitionBy(*self.keys, "__seg").orderBy(*(order or (self.order,)))

    def _per_segment(self, df: DataFrame, *values: Column) -> DataFrame:
        """One row per segment of the cut groups (at most 2 * MAX_CUTS rows)."""
        own = df.alias("d").join(F.broadcast(self.hot.alias("h")), self._same("h")("d"), "left_semi")
        return own.groupBy(*self.keys, "__seg").agg(*values)

    def _join(self, df: DataFrame, table: DataFrame, *columns: Column) -> DataFrame:
        on = self._same("b")("d") & (F.col("d.__seg") == F.col("b.__seg"))
        return df.alias("d").join(F.broadcast(table.alias("b")), on, "left").select("d.*", *columns)

    def add_sums(self, df: DataFrame, amounts: dict[str, Column]) -> DataFrame:
        """Add, by name, the sum of each amount over all earlier segments of the row's group (0 in whole groups).

        A long for whole numbers, else a double.
        """
        kinds = {n: "long" if isinstance(df.select(a).schema[0].dataType, T.IntegralType) else "double" for n, a in amounts.items()}
        if self.hot is None:
            return df.withColumns({n: F.lit(0).cast(k) for n, k in kinds.items()})
        sums = self._per_segment(df, *(F.sum(a).alias(f"__s_{n}") for n, a in amounts.items()))
        w = Window.partitionBy(*self.keys).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(*self.keys, "__seg", *(F.sum(f"__s_{n}").over(w).alias(f"__b_{n}") for n in amounts))
        return self._join(df, before, *(F.coalesce(f"b.__b_{n}", F.lit(0)).cast(k).alias(n) for n, k in kinds.items()))

    def add_before(self, df: DataFrame, amount: Column | str, name: str) -> DataFrame:
        """add_sums for one amount."""
        return self.add_sums(df, {name: F.col(amount) if isinstance(amount, str) else amount})

    def carry(self, df: DataFrame, value: str, order: tuple, name: str) -> DataFrame:
        """Add `name`: `value` of the last row before the row's segment in its group (null in whole groups and at the start)."""
        if self.hot is None:
            return df.withColumn(name, F.lit(None).cast(df.schema[value].dataType))
        last = self._per_segment(df, F.max_by(F.struct(value), F.struct(*order)).alias("__l"))
        before = last.select(*self.keys, "__seg", F.lag("__l").over(Window.partitionBy(*self.keys).orderBy("__seg")).alias("__c"))
        return self._join(df, before, F.col(f"b.__c.{value}").alias(name))


def exact_medians(counts: DataFrame, keys: list[str], value: str, weight: str, name: str, limit: int = HOT_ROWS) -> DataFrame:
    """Exact median per group of values given with multiplicities (one row per group and value).

    The mean of the two middle values for an even total. Groups without rows are absent; null values must be
    filtered before. Returns keys, `name` and `__total`.
    """
    s = Segmented(counts, keys, value, limit)
    df = s.add_before(s.df, weight, "__base")
    totals = counts.groupBy(*keys).agg(F.sum(weight).alias("__total"))
    df = df.withColumn("__upto", F.col("__base") + F.sum(weight).over(s.window().rowsBetween(Window.unboundedPreceding, 0)))
    df = df.alias("d").join(totals.alias("t"), s._same("t")("d")).select("d.*", "t.__total")
    lo, hi = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    holds = lambda pos: (F.col("__upto") >= pos) & (F.col("__upto") - F.col(weight) < pos)
    return (
        df.where(holds(lo) | holds(hi)).groupBy(*keys)
        .agg(((F.min(F.when(holds(lo), F.col(value))) + F.max(F.when(holds(hi), F.col(value)))) / 2).alias(name), F.first("__total").alias("__total"))
    )

"""Irregular readings onto a regular grid, per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import epoch_us

CHUNK_SLOTS = 4096


def regular_grid(
    points: DataFrame, steps: DataFrame, *, series: str = "series_key", ts: str = "ts", value: str = "value", step: str = "step_s",
    point_id: str | None = "point_id", gap_limit_steps: float | None = 10.0, chunk_slots: int = CHUNK_SLOTS,
) -> DataFrame:
    """One row per slot of every series, from its first to its last slot with a reading.

    A slot begins at a multiple of the series' step (seconds since 1970) and excludes its end. The grid time of
    a slot is its start; its value is an as-of merge of the grid with the sorted readings: the last reading
    before and the first one at or after the grid time, weighted by time. The merge runs over occupied slots
    (readings are first reduced to the first and last one of each slot, on the map side too), and a run of empty
    slots is carried as one range until the very end, so a long outage costs one row until it is written.
    A series is cut into chunks of `chunk_slots` slots and neighbours across chunks come from a table of one row
    per chunk, so a series of any length is spread over many tasks.

    status: 'observed' (a reading lies in the slot), 'interpolated' (none, and the neighbours are at most
    `gap_limit_steps` steps apart; None sets no limit) or 'gap' (none, value null).
    An observed slot whose neighbours are too far apart, or whose first reading starts the series, has its own
    first reading as value.

    Null or NaN values, null times and null series don't count as readings. Of readings at one time the one
    with the smallest point_id is first and the one with the largest is last (without point_id: the smallest and
    largest value); rows repeated verbatim therefore change nothing. Series whose step is null, not positive or
    missing in `steps` have no slots; of several steps the largest counts. Empty tables give no rows; other
    columns of either table are ignored. Columns: series, slot_start_s, status, value, prev_us, next_us.
    """
    size = steps.where(F.col(series).isNotNull() & (F.col(step) > 0)).groupBy(F.col(series).alias("k")).agg(F.max(step).cast("long").alias("step"))
    good = F.col(ts).isNotNull() & F.col(series).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    pid = F.col(point_id) if point_id else F.lit(0)
    p = points.where(good).select(F.col(series).alias("k"), epoch_us(ts).alias("us"), F.col(value).cast("double").alias("v"), pid.alias("id")).join(size, "k")
    width = F.col("step") * 1_000_000
    p = p.withColumn("slot", ((F.col("us") - F.pmod(F.col("us"), width)) / width).cast("long"))
    occ = p.groupBy("k", "step", "slot").agg(
        F.min(F.struct("us", "id", "v")).alias("first"), F.max(F.struct("us", "id", "v")).alias("last"),
    ).withColumn("chunk", F.floor(F.col("slot") / chunk_slots))
    w, by = Window.partitionBy("k", "chunk").orderBy("slot"), Window.partitionBy("k").orderBy("chunk")
    tails = occ.groupBy("k", "chunk").agg(F.max("slot").alias("t_slot"), F.max_by("last", "slot").alias("t_last"))
    tails = tails.select("k", "chunk", F.lag("t_slot").over(by).alias("b_slot"), F.lag("t_last").over(by).alias("b_last"))
    cell = occ.withColumns({"in_slot": F.lag("slot").over(w), "in_last": F.lag("last").over(w)}).join(tails, ["k", "chunk"])
    before = F.coalesce("in_last", "b_last")

    reach = F.col("n_us") - F.col("p_us")
    near = F.lit(True) if gap_limit_steps is None else reach <= gap_limit_steps * F.col("step") * 1_000_000
    at = F.col("slot") * F.col("step") * 1_000_000
    line = F.when(reach <= 0, F.col("n_v")).otherwise(F.col("p_v") + (F.col("n_v") - F.col("p_v")) * ((at - F.col("p_us")) / F.nullif(reach, F.lit(0))))
    cell = cell.select("k", "step", "slot", F.coalesce("in_slot", "b_slot").alias("p_slot"), before["us"].alias("p_us"), before["v"].alias("p_v"), F.col("first.us").alias("n_us"), F.col("first.v").alias("n_v"))
    seen = cell.select(
        "k", (F.col("slot") * F.col("step")).alias("slot_start_s"), F.lit("observed").alias("status"),
        F.when(F.col("p_us").isNull() | ~near | (F.col("n_us") == at), F.col("n_v")).otherwise(line).alias("value"), "p_us", "n_us",
    )
    ranges = cell.where(F.col("slot") > F.col("p_slot") + 1).select(
        "k", "step", "p_us", "p_v", "n_us", "n_v", (F.col("slot") - 1).alias("end"),
        F.explode(F.sequence(F.col("p_slot") + 1, F.col("slot") - 1, F.lit(chunk_slots).cast("long"))).alias("begin"),
    ).repartition("k", "begin")  # spreads the ranges of long outages before they unfold
    missing = ranges.select("*", F.explode(F.sequence("begin", F.least(F.col("begin") + (chunk_slots - 1), F.col("end")))).alias("slot")).select(
        "k", (F.col("slot") * F.col("step")).alias("slot_start_s"), F.when(near, "interpolated").otherwise("gap").alias("status"),
        F.when(near, line).alias("value"), "p_us", "n_us",
    )
    out = seen.unionByName(missing)
    return out.select(F.col("k").alias(series), "slot_start_s", "status", "value", F.col("p_us").alias("prev_us"), F.col("n_us").alias("next_us"))

"""Streaming forms: windowed counts, degrees, change capture, alerts. All run once over what is available by default."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from quillon.runtime import is_folder
from quillon.sources.tables import scratch


def source(spark: SparkSession, d: str, table: str, max_files: int | None = None) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{d}/{table}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{d}/{table}.parquet") if is_folder(spark, f"{d}/{table}.parquet") else r.option("pathGlobFilter", f"{table}.parquet").parquet(d)


def run(stream: DataFrame, mode: str = "update", path: str | None = None) -> DataFrame:
    """Run a stream over what is available into files and return them, with the number of the batch as `batch`.

    A batch that is run again after a failure replaces its own files, so rows are never doubled.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")
    out = f"{path}/out"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key among the updates of a stream."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def window_counts(events: DataFrame, keys: list[str], size: str, late: str = "1 hour", slide: str | None = None, ts: str = "ts") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *keys, "n", "total")


def session_counts(events: DataFrame, keys: list[str], gap: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(start, end, keys, n, total) of sessions that end after a silence of `gap`; to be run in complete or append mode."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = e.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "n", "total")


def windowed_degrees(edges: DataFrame, size: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """(start, vertex, out_degree, in_degree) of the edges (src, dst, ts) of each window of event time."""
    e = edges.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    ends = e.select(ts, F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    out = ends.groupBy(F.window(ts, size).alias("w"), F.col("x.v").alias("vertex")).agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "vertex", "out_degree", "in_degree")


def run_components(edges: DataFrame, path: str | None = None) -> DataFrame:
    """(vertex, component) after a stream of edges (src, dst): each batch joins its edges to the components known before.

    Edges are only ever added. A batch that is run again starts from the same components and replaces its own result.
    """
    from quillon.operators.graph import connected_components

    spark, path = edges.sparkSession, path or scratch(edges.sparkSession, "components")
    schema, done = "vertex string, component string", []

    def step(df: DataFrame, batch: int) -> None:
        before = [b for b in done if b < batch]
        links = df.select("src", "dst")
        if before:
            links = links.union(spark.read.schema(schema).parquet(f"{path}/out/{before[-1]}").select("vertex", "component"))
        connected_components(links).write.mode("overwrite").parquet(f"{path}/out/{batch}")
        done.append(batch)

    q = edges.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out/{done[-1]}") if done else spark.createDataFrame([], schema)


def degree_stream(edges: DataFrame) -> DataFrame:
    """(vertex, out_degree, in_degree) over a stream of (src, dst, op); op 'delete' takes an edge away, never below 0."""
    sign = F.when(F.col("op") == "delete", -1).otherwise(1) if "op" in edges.columns else F.lit(1)
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), sign.alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("v"), F.lit(0).alias("o"), sign.alias("i")))).alias("x"))
    zero = F.lit(0).cast("long")
    return ends.groupBy(F.col("x.v").alias("vertex")).agg(F.greatest(zero, F.sum("x.o")).alias("out_degree"), F.greatest(zero, F.sum("x.i")).alias("in_degree"))


def apply_changes(changes: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last row per key by `order`; with `deleted`, a condition under which the last change removes the row."""
    values = [c for c in changes.columns if c not in keys]
    out = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*")
    return out.where(f"not coalesce({deleted}, false)") if deleted else out


ALERT_OUT = "entity string, us long, status string, value double"
ALERT_STATE = "status string, since long, last_fired long"


def alerts(events: DataFrame, threshold: float, for_s: float = 0, cooldown_s: float = 0) -> DataFrame:
    """(entity, us, status, value) on every change of state per entity over a stream of (entity, us, value).

    'firing' once the value has been above the threshold for `for_s` seconds, unless the last alert is less than
    `cooldown_s` old; 'resolved' when it falls back. Readings of a batch are taken in order of time; nulls are skipped.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since, fired = state.get if state.exists else ("ok", -1, -1)
        rows = []
        for d in [pd.concat(list(parts))]:
            for us, v in d.dropna(subset=["value"]).sort_values(["us", "value"])[["us", "value"]].itertuples(index=False):
                if v > threshold:
                    since = us if since < 0 else since
                    if status != "firing" and us - since >= for_s * 1e6 and (fired < 0 or us - fired >= cooldown_s * 1e6):
                        status, fired = "firing", us
                        rows.append((key[0], us, "firing", v))
                else:
                    since = -1
                    if status == "firing":
                        rows.append((key[0], us, "resolved", v))
                    status = "ok"
        state.update((status, int(since), int(fired)))
        yield pd.DataFrame(rows, columns=["entity", "us", "status", "value"])

    return events.groupBy("entity").applyInPandasWithState(step, ALERT_OUT, ALERT_STATE, "append", "NoTimeout")


def published(changes: DataFrame, send, *, retries: int = 3, dead_letters: str | None = None):
    """A foreachBatch function that sends each partition's rows with retries; rows that still fail go to files under dead_letters."""

    def write(df: DataFrame, batch: int) -> None:
        def part(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in rows:
                lost = []
                for r in d["value"]:
                    for k in range(retries):
                        try:
                            send(r)
                            break
                        except Exception as e:
                            if k == retries - 1:
                                lost.append((r, str(e)))
                yield pd.DataFrame(lost, columns=["value", "error"])

        failed = df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(part, "value string, error string")
        failed.write.mode("overwrite").json(f"{dead_letters or scratch(df.sparkSession, 'dead')}/batch={batch}")

    return write

"""Reading, writing and changing tables. A change returns a new DataFrame; nothing is modified in place."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.runtime import ensure_checkpoint_dir

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
FORMATS = ("csv", "json", "parquet", "orc", "text")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{name}-{uuid.uuid4().hex}"


def imported(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None, *, skip_errors: bool = False) -> DataFrame:
    """Read csv (with header), json lines, parquet, orc or text. With skip_errors malformed rows are dropped, else they raise."""
    if kind.lower() not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    r = spark.read.option("header", True).option("mode", "DROPMALFORMED" if skip_errors else "FAILFAST")
    if kind.lower() == "csv":
        r = r.option("enforceSchema", False).option("multiLine", True).option("escape", '"')
    r = r.option("timestampNTZFormat", STAMP).option("timestampFormat", STAMP)
    if schema is not None:
        r = r.schema(schema)
    return r.format(kind.lower()).load(path)


def export(df: DataFrame, path: str, kind: str = "json", mode: str = "errorifexists") -> None:
    """Write one class as json lines (the default), csv with header, parquet or orc."""
    w = df.write.mode(mode).option("timestampNTZFormat", STAMP).option("timestampFormat", STAMP)
    if kind == "csv":
        w = w.option("header", True).option("escape", '"')
    if kind == "json":
        w = w.option("ignoreNullFields", False)
    w.format(kind).save(path)


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """An external relational source; filters and columns are pushed down by Spark."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def insert(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; columns they lack become null, types follow the table."""
    named = rows.select([F.col(c).cast(df.schema[c].dataType).alias(c) if c in df.columns else F.col(c) for c in rows.columns])
    return df.unionByName(named, allowMissingColumns=True)


def one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several rows with one key the one that is largest over its other columns, in their order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*") if rest else rows.distinct()


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """Insert rows whose key is new; where it is known, set the columns `update` (default: all others).

    Keys are compared null-safely. Of several rows with one key the one that is largest over its other columns, in
    their order, counts, so a key is inserted or updates its row once.
    """
    rows = one_per_key(rows, keys)
    update = [c for c in rows.columns if c not in keys] if update is None else update
    on = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys))
    old = df.withColumn("__old", F.lit(True)).alias("o")
    new = rows.withColumn("__new", F.lit(True)).alias("n")

    def pick(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"o.{c}").alias(c)
        n, o = F.col(f"n.{c}").cast(df.schema[c].dataType), F.col(f"o.{c}")
        take_new = F.col("o.__old").isNull() if c not in update else F.col("n.__new").isNotNull()
        return F.when(take_new, n).otherwise(o).alias(c)

    return old.join(new, on, "full").select([pick(c) for c in df.columns])


def update(df: DataFrame, values: dict[str, Column], where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Set columns of the rows for which `where` is true (null counts as false), of at most `limit` of them: the first by
    all columns in order."""
    if limit is not None:
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        some = df.where(hit).orderBy(*df.columns).limit(limit).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__most"))
        same = reduce(lambda a, b: a & b, (F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in df.columns))
        place = F.row_number().over(Window.partitionBy(*df.columns).orderBy(F.lit(0)))  # equal rows
        rows = df.withColumn("__i", place).alias("d").join(F.broadcast(some.alias("s")) if limit <= 100_000 else some.alias("s"), same, "left")
        taken = rows.select("d.*", (F.col("__i") <= F.coalesce("s.__most", F.lit(0))).alias("__hit")).drop("__i")
        return update(taken, values, F.col("__hit")).drop("__hit")
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.select([F.when(hit, values[c].cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Drop the rows for which `where` is true; rows where it is null stay. Without `where` all rows go."""
    return df.limit(0) if where is None else df.where(~F.coalesce(where, F.lit(False)))


def page(df: DataFrame, keys: list[str], size: int, after: tuple | None = None) -> DataFrame:
    """The next page of a keyset cursor: rows after the last key, in key order. Keys must be unique and not null."""
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for k, v in zip(keys, after):
            beyond, same = beyond | (same & (F.col(k) > v)), same & (F.col(k) == v)
        df = df.where(beyond)
    return df.orderBy(*keys).limit(size)

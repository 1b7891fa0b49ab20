"""Session plumbing shared by all operators: reading tables, cutting lineage, times and names."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that it names (local, shared or an object store)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir; only where none is set, a local one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or str(Path(tempfile.gettempdir(), "quillon-checkpoints")))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which survives the loss of an executor.

    A checkpoint keeps the attributes and constraints of the plan that it cuts, and Spark fails to plan unions of several
    that share some; so its rows are taken as a new source. Joins are then chosen by the sizes met at run time.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def epoch_us(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a timestamp without zone, whatever the session's zone."""
    c = F.col(col) if isinstance(col, str) else col
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT"):
        return F.unix_micros(c.cast("timestamp"))
    second = F.date_part(F.lit("SECOND"), c) * 1_000_000
    return F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000 + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + second.cast("long")


def spread(df: DataFrame, key: str) -> DataFrame:
    """More partitions, by hash of a key, where the input has too few for work that is heavy per row; else df as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores, key)


#: What counts as blank around a name.
BLANKS = " \t\n\r\x0b\x0c\u00a0\u3000"


def tidy_name(col: Column | str) -> Column:
    """Names are compared without surrounding blanks and in lower case; blank ones become null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.trim(c, F.lit(BLANKS))), F.lit(""))

"""Exact vector search over columns of arrays, and fusion of several searches by reciprocal ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _doubles(v: Column | str | list) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, list) else F.transform(v, lambda x: x.cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column | str, b: Column | str | list, metric: str) -> Column:
    """l2; cosine (1 - cos, 1 where a norm is 0); ip (minus the product); hamming and tanimoto over 0/1 vectors."""
    a, b = _doubles(a), _doubles(b)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    if metric == "l2":
        return F.sqrt(add(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    if metric == "cosine":
        norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
        return F.when(norm == 0, 1.0).otherwise(1 - _dot(a, b) / norm)
    if metric in ("ip", "innerproduct", "inner_product"):
        return -_dot(a, b)
    if metric == "hamming":
        return add(F.zip_with(a, b, lambda x, y: F.when((x != 0) != (y != 0), 1.0).otherwise(0.0)))
    if metric == "tanimoto":
        both = add(F.zip_with(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0)))
        any_ = add(F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)))
        return F.when(any_ == 0, 0.0).otherwise(1 - both / any_)
    raise ValueError(f"unknown metric {metric}")


def normalized(v: Column | str) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    v = _doubles(v)
    n = F.sqrt(_dot(v, v))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def packed_bits(v: Column | str) -> Column:
    """A 0/1 vector as a string of hex digits, first element in the highest bit, padded with zeros to whole bytes."""
    v = F.transform(v, lambda x: F.when(x != 0, "1").otherwise("0"))
    bits = F.array_join(v, "")
    padded = F.rpad(bits, F.ceil(F.length(bits) / 8).cast("int") * 8, F.lit("0"))
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(padded) / 8).cast("int") - 1), lambda i: F.lpad(F.conv(F.substring(padded, (i * 8 + 1).cast("int"), F.lit(8)), 2, 16), 2, F.lit("0")))
    return F.lower(F.array_join(bytes_, ""))


def top_k(df: DataFrame, column: str, query: list[float], k: int, metric: str = "cosine", tie: str | None = None) -> DataFrame:
    """The k rows nearest to the query with `_distance`, nearest first. Filter `df` before: the result is the top k among matches.

    Null vectors and those of another length are left out. Exact, by a distributed top-k without a shuffle of the rows.
    """
    fit = df.where(F.col(column).isNotNull() & (F.size(column) == len(query)))
    return fit.withColumn("_distance", distance(column, query, metric)).orderBy("_distance", tie or df.columns[0]).limit(k)


def fused(searches: list[tuple[DataFrame, float]], key: str, k: int) -> DataFrame:
    """(key, score): reciprocal rank fusion of searches with weights, sum of weight / (60 + rank) with ranks from 0.

    Each search is a top-k result with `_distance`, so the window that numbers its rows is over k rows.
    """
    parts = [s.select(key, (F.lit(float(w)) / (RRF_K + F.row_number().over(Window.orderBy("_distance", key)) - 1)).alias("s")) for s, w in searches]
    return reduce(DataFrame.union, parts).groupBy(key).agg(F.sum("s").alias("score")).orderBy(F.desc("score"), key).limit(k)


def kmeans(df: DataFrame, key: str, column: str, k: int, *, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """(key, cluster) by seeded k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = df.select(key, array_to_vector(F.transform(column, lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed, maxIter=max_iter).fit(v).transform(v).select(key, F.col("prediction").alias("cluster"))

"""Queries of the problems tagged llm, over the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import encode, langid, mix, ranking, vectors
from quillon.runtime import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = vectors.near_pairs(load(spark, d, "vector_search_spec"), load(spark, d, "vector_index_meta"), reach=1.0)  # exact
    return pairs.select(F.col("a").alias("spec_id_a"), F.col("b").alias("spec_id_b"))


def p1_most_similar(spark: SparkSession, d: str) -> DataFrame:
    return vectors.most_similar(load(spark, d, "vector_search_spec"), load(spark, d, "vector_index_meta"))


def p1_exact(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.most_similar(load(spark, d, "vector_search_spec"), load(spark, d, "vector_index_meta"), share=1.0)  # visits every cell
    return near.select("id", "other", F.round("distance", 6).alias("distance"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.fuse_rankings(load(spark, d, "hybrid_search_result"), load(spark, d, "vector_search_spec"))
    return ranking.front(ranked).select("search_id", "doc_key")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.fuse_rankings(load(spark, d, "hybrid_search_result"), load(spark, d, "vector_search_spec"))
    return ranked.select("search_id", "doc_key", "position", F.round("projection", 6).alias("projection"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(load(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixed(load(spark, d, "documents"), load(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = load(spark, d, "mix_target")
    return mix.reached_shares(mix.mixed(load(spark, d, "documents"), targets), targets)


def p9_on_target(spark: SparkSession, d: str) -> DataFrame:
    return p9_shares(spark, d).select("source", "target_share", (F.abs(F.col("actual_share") - F.col("target_share")) < 0.002).alias("met"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(load(spark, d, "documents")).where("sentences > 0 and (label is null or label != lang)").select("doc_id", "lang")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(load(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.languages(load(spark, d, "documents"), segments=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_most_similar, p1_exact, p2_found, p2_ranking, p8_ids, p9_mix, p9_shares, p9_on_target, p10_found, p10_languages, p10_segments)}

_USABLE = """
WITH v AS (SELECT DISTINCT s.spec_id AS id, s.owner_class AS oc, s.column_name AS cn, s.query_vector::DOUBLE[] AS v, dimension, metric, near_distance AS nd
 FROM vector_search_spec s JOIN vector_index_meta m ON s.owner_class = m.owner_class AND s.column_name = m.column_name
 WHERE query_vector IS NOT NULL AND len(query_vector) = dimension AND len(list_filter(query_vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
 AND (metric != 'cosine' OR len(list_filter(query_vector, lambda x: x != 0)) > 0))"""
_APART = "CASE WHEN a.metric = 'cosine' THEN 1 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) ELSE list_distance(a.v, b.v) END"

ORACLES = {
    "p1_found": f"{_USABLE} SELECT a.id AS spec_id_a, b.id AS spec_id_b FROM v a JOIN v b ON a.oc = b.oc AND a.cn = b.cn AND a.id < b.id WHERE {_APART} <= a.nd",
    "p1_exact": f"""{_USABLE}, n AS (SELECT a.id, b.id AS other, {_APART} AS d FROM v a JOIN v b ON a.oc = b.oc AND a.cn = b.cn AND a.id != b.id WHERE a.id % 20 = 0)
SELECT id, other, round(d, 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) <= 10""",
    "p9_on_target": "SELECT lower(source_name) AS source, target_share, true AS met FROM mix_target",
    "p2_found": """
WITH w AS (SELECT DISTINCT search_id, column_name AS c FROM vector_search_spec WHERE weight > 0 AND NOT isnan(weight)),
s AS (SELECT DISTINCT search_id, doc_key, e.key AS c, e."value" AS x FROM (SELECT search_id, doc_key, unnest(map_entries(per_column_scores)) AS e FROM hybrid_search_result) WHERE e."value" IS NOT NULL AND NOT isnan(e."value")),
r AS (SELECT s.*, rank() OVER (PARTITION BY s.search_id, s.c ORDER BY x DESC) AS r FROM s SEMI JOIN w ON s.search_id = w.search_id AND s.c = w.c),
n AS (SELECT search_id, count(*) AS n FROM w GROUP BY 1)
SELECT r.search_id, doc_key FROM r JOIN n USING (search_id) WHERE r <= 5 GROUP BY 1, 2, n HAVING count(*) = n""",
}

"""Queries of the general data problems (p3 to p7) over the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import grid, hierarchy, near, skew, spikes
from quillon.runtime import load


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    g = grid.regular_grid(load(spark, d, "ts_point"), load(spark, d, "ts_block"))
    return g.where("status != 'observed'").select("series_key", "slot_start_s")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(load(spark, d, "ts_point"), load(spark, d, "ts_block")).withColumn("value", F.round("value", 6))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.tops(load(spark, d, "class_info"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(load(spark, d, "class_info"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(load(spark, d, "class_info"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(load(spark, d, "class_info"), members=True)


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.full_paths(load(spark, d, "class_info"))


def p4_all_paths(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.all_paths(load(spark, d, "class_info"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # TESTDATA.md fixes the limit to 20 median departures from the sensor's median; trend, season and the ESD test say which readings are held against it
    r = spikes.flag_readings(load(spark, d, "report_request"), load(spark, d, "sensor_limit"), max_mads=20.0)
    return r.where("out_of_range or spike or frozen").select("report_id", "sensor_id").distinct()


def p5_seasonal(spark: SparkSession, d: str) -> DataFrame:
    r = spikes.flag_readings(load(spark, d, "report_request"), load(spark, d, "sensor_limit"))
    return r.where("out_of_range or spike or frozen").select("report_id", "pos", "sensor_id", "out_of_range", "spike", "frozen")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.reciprocal_pairs(load(spark, d, "d3_link"))


def p6_partners(spark: SparkSession, d: str) -> DataFrame:
    return skew.partner_counts(load(spark, d, "d3_link"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    points, nodes = load(spark, d, "st_point"), load(spark, d, "region_node")
    pairs = near.near_pairs(points, radius_m=40.0).select(F.col("id_a").alias("point_id"), F.lit("point").alias("other_kind"), F.col("id_b").cast("string").alias("other_id"))
    return pairs.union(near.containing_regions(points, nodes).select("id", F.lit("region"), "region"))


QUERIES = {f.__name__: f for f in (p3_found, p3_grid, p4_found, p4_hierarchy, p4_descendants, p4_counts, p4_paths, p4_all_paths, p5_found, p5_seasonal, p6_found, p6_partners, p7_found)}

_TIDY = "nullif(lower(trim({})), '')"

ORACLES = {
    "p3_found": """
WITH s AS (SELECT series_key, max(step_s) AS step FROM ts_block WHERE step_s > 0 GROUP BY 1),
occ AS (SELECT DISTINCT p.series_key, step, epoch_us(ts) // 1000000 // step AS slot FROM ts_point p JOIN s USING (series_key) WHERE value IS NOT NULL AND NOT isnan(value)),
r AS (SELECT series_key, step, unnest(generate_series(min(slot), max(slot))) AS slot FROM occ GROUP BY 1, 2)
SELECT series_key, slot * step AS slot_start_s FROM r ANTI JOIN occ USING (series_key, slot)""",
    "p3_grid": """
WITH s AS (SELECT series_key, max(step_s) AS step FROM ts_block WHERE step_s > 0 GROUP BY 1),
p AS (SELECT DISTINCT p.series_key, step, point_id, epoch_us(ts) AS us, value AS v, epoch_us(ts) // 1000000 // step AS slot FROM ts_point p JOIN s USING (series_key) WHERE value IS NOT NULL AND NOT isnan(value)),
occ AS (SELECT series_key, step, slot, min(us) AS f_us, arg_min(v, (us, point_id)) AS f_v, max(us) AS l_us, arg_max(v, (us, point_id)) AS l_v FROM p GROUP BY 1, 2, 3),
r AS (SELECT series_key, step, unnest(generate_series(min(slot), max(slot))) AS slot FROM occ GROUP BY 1, 2),
x AS (SELECT r.series_key, r.slot, r.slot * r.step * 1000000 AS t, r.step, o.f_us IS NOT NULL AS seen, o.f_us, o.f_v, a.l_us AS p_us, a.l_v AS p_v, b.f_us AS n_us, b.f_v AS n_v
 FROM r LEFT JOIN occ o ON o.series_key = r.series_key AND o.slot = r.slot
 ASOF LEFT JOIN occ a ON a.series_key = r.series_key AND a.slot < r.slot
 ASOF LEFT JOIN occ b ON b.series_key = r.series_key AND b.slot >= r.slot),
y AS (SELECT *, n_us - p_us <= 10 * step * 1000000 AS near, p_v + (n_v - p_v) * ((t - p_us) / nullif(n_us - p_us, 0)) AS line FROM x)
SELECT series_key, slot * step AS slot_start_s, CASE WHEN seen THEN 'observed' WHEN near THEN 'interpolated' ELSE 'gap' END AS status,
 round(CASE WHEN seen AND (p_us IS NULL OR NOT near OR n_us = t) THEN n_v WHEN near THEN line END, 6) AS value, p_us AS prev_us, n_us AS next_us FROM y""",
    "p4_paths": """
WITH RECURSIVE nodes AS (SELECT DISTINCT lower(trim(class_name)) AS n FROM class_info WHERE trim(class_name) != ''),
links AS (SELECT DISTINCT lower(trim(class_name)) AS n, lower(trim(p)) AS p FROM (SELECT class_name, unnest(superclasses) AS p FROM class_info) WHERE lower(trim(p)) IN (SELECT n FROM nodes)),
up(n, a) AS (SELECT n, p FROM links UNION SELECT up.n, links.p FROM up JOIN links ON up.a = links.n),
bad AS (SELECT n FROM up WHERE n = a),
w(n, path) AS (SELECT n, [n] FROM nodes WHERE n NOT IN (SELECT n FROM links) UNION ALL SELECT links.n, list_append(path, links.n) FROM w JOIN links ON links.p = w.n WHERE links.n NOT IN (SELECT n FROM bad))
SELECT n AS class_name, path[1] AS top_name, path, (len(path) - 1)::BIGINT AS levels FROM w""",
    "p4_hierarchy": """
WITH RECURSIVE nodes AS (SELECT DISTINCT lower(trim(class_name)) AS n FROM class_info WHERE trim(class_name) != ''),
links AS (SELECT DISTINCT lower(trim(class_name)) AS n, lower(trim(p)) AS p FROM (SELECT class_name, unnest(superclasses) AS p FROM class_info) WHERE lower(trim(p)) IN (SELECT n FROM nodes)),
up(n, a) AS (SELECT n, p FROM links UNION SELECT up.n, links.p FROM up JOIN links ON up.a = links.n),
loop AS (SELECT x.n, min(y.n) AS loop FROM up x JOIN up y ON x.a = y.n AND x.n = y.a GROUP BY 1),
c AS (SELECT nodes.n, loop, coalesce(loop, nodes.n) AS m FROM nodes LEFT JOIN loop ON loop.n = nodes.n),
e AS (SELECT DISTINCT a.m AS n, b.m AS p FROM links JOIN c a ON a.n = links.n JOIN c b ON b.n = links.p WHERE a.m != b.m),
t(n, a, k) AS (SELECT n, p, 1 FROM e UNION SELECT t.n, e.p, k + 1 FROM t JOIN e ON e.n = t.a),
s AS (SELECT n, a, min(k) AS k FROM t GROUP BY 1, 2), root AS (SELECT n FROM nodes WHERE n NOT IN (SELECT n FROM links)),
d AS (SELECT n, min(k)::BIGINT AS depth FROM s WHERE a IN (SELECT n FROM root) GROUP BY 1 UNION ALL SELECT n, 0 FROM root)
SELECT c.n AS class_name, depth, (SELECT count(*) FROM s WHERE s.n = c.m) AS ancestors, (SELECT count(*) FROM s WHERE s.a = c.m) AS descendants, loop FROM c LEFT JOIN d ON d.n = c.m""",
    "p4_descendants": """
WITH RECURSIVE nodes AS (SELECT DISTINCT lower(trim(class_name)) AS n FROM class_info WHERE trim(class_name) != ''),
links AS (SELECT DISTINCT lower(trim(class_name)) AS n, lower(trim(p)) AS p FROM (SELECT class_name, unnest(superclasses) AS p FROM class_info) WHERE lower(trim(p)) IN (SELECT n FROM nodes)),
t(n, a, k) AS (SELECT n, p, 1 FROM links UNION SELECT t.n, links.p, k + 1 FROM t JOIN links ON links.n = t.a WHERE k < (SELECT count(*) FROM nodes)),
s AS (SELECT n, a, min(k)::BIGINT AS k FROM t GROUP BY 1, 2), d AS (SELECT * FROM s WHERE n != a)
SELECT a AS class_name, n AS descendant, k AS levels FROM d""",
    "p4_counts": """
WITH RECURSIVE nodes AS (SELECT DISTINCT lower(trim(class_name)) AS n FROM class_info WHERE trim(class_name) != ''),
links AS (SELECT DISTINCT lower(trim(class_name)) AS n, lower(trim(p)) AS p FROM (SELECT class_name, unnest(superclasses) AS p FROM class_info) WHERE lower(trim(p)) IN (SELECT n FROM nodes)),
t(n, a, k) AS (SELECT n, p, 1 FROM links UNION SELECT t.n, links.p, k + 1 FROM t JOIN links ON links.n = t.a WHERE k < (SELECT count(*) FROM nodes)),
s AS (SELECT n, a, min(k)::BIGINT AS k FROM t GROUP BY 1, 2), d AS (SELECT * FROM s WHERE n != a),
loop AS (SELECT x.n, min(y.n) AS loop FROM s x JOIN s y ON x.a = y.n AND x.n = y.a GROUP BY 1), root AS (SELECT n FROM nodes WHERE n NOT IN (SELECT n FROM links)),
z AS (SELECT n, min(k) AS depth FROM d WHERE a IN (SELECT n FROM root) GROUP BY 1 UNION ALL SELECT n, 0 FROM root)
SELECT nodes.n AS class_name, depth, (SELECT count(*) FROM d WHERE d.n = nodes.n) AS ancestors, (SELECT count(*) FROM d WHERE d.a = nodes.n) AS descendants, loop
FROM nodes LEFT JOIN loop USING (n) LEFT JOIN z USING (n)""",
    "p7_found": """
WITH p AS (SELECT DISTINCT point_id, entity_id, lon, lat FROM st_point WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0)),
q AS (SELECT *, floor(lat * 1000)::BIGINT AS band FROM p), b AS (SELECT q.*, band + k AS cell FROM q, (SELECT unnest([-1, 0, 1]) AS k)),
x AS (SELECT q.point_id AS i, b.point_id AS j FROM q JOIN b ON b.cell = q.band AND q.point_id < b.point_id AND q.entity_id != b.entity_id
 WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(b.lat - q.lat) / 2), 2) + cos(radians(q.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - q.lon) / 2), 2)))) <= 40),
n AS (SELECT DISTINCT node_id, center_lat, center_lng, radius_m FROM region_node WHERE center_lat IS NOT NULL AND center_lng IS NOT NULL AND radius_m IS NOT NULL)
SELECT i AS point_id, 'point' AS other_kind, j::VARCHAR AS other_id FROM x
UNION ALL SELECT point_id, 'region', node_id FROM p, n WHERE 2 * 6371000 * asin(sqrt(least(1, pow(sin(radians(center_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(center_lat)) * pow(sin(radians(center_lng - lon) / 2), 2)))) <= radius_m""",
    "p4_found": """
WITH RECURSIVE nodes AS (SELECT DISTINCT lower(trim(class_name)) AS n FROM class_info WHERE trim(class_name) != ''),
links AS (SELECT DISTINCT lower(trim(class_name)) AS n, lower(trim(p)) AS p FROM (SELECT class_name, unnest(superclasses) AS p FROM class_info) WHERE lower(trim(p)) IN (SELECT n FROM nodes)),
up(n, a) AS (SELECT n, p FROM links UNION SELECT up.n, links.p FROM up JOIN links ON up.a = links.n),
loop AS (SELECT x.n, min(y.n) AS loop FROM up x JOIN up y ON x.a = y.n AND x.n = y.a GROUP BY 1),
own AS (SELECT n, n AS a FROM nodes UNION SELECT n, a FROM up)
SELECT DISTINCT n AS class_name, a AS top_name FROM own WHERE a NOT IN (SELECT n FROM links)
UNION SELECT own.n, loop.loop FROM own JOIN loop ON own.a = loop.n""",
    "p5_found": """
WITH r AS (SELECT DISTINCT report_id, x.sensor_id AS sensor_id, x.sensor_type AS st, x.unit AS un, x."value" AS v, x.ts AS ts FROM (SELECT report_id, unnest(readings) AS x FROM report_request) WHERE x."value" IS NOT NULL AND NOT isnan(x."value")),
l AS (SELECT r.*, coalesce(v < min_value OR v > max_value, false) AS bad FROM r LEFT JOIN sensor_limit s ON s.sensor_type = st AND s.unit = un),
m AS (SELECT sensor_id, median(v) AS med FROM l WHERE NOT bad GROUP BY 1),
mm AS (SELECT sensor_id, any_value(med) AS med, median(abs(v - med)) AS mad FROM l JOIN m USING (sensor_id) WHERE NOT bad GROUP BY 1),
o AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, report_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY sensor_id ORDER BY ts, report_id) AS run FROM o),
c AS (SELECT *, count(*) OVER (PARTITION BY sensor_id, run) AS len FROM g)
SELECT DISTINCT report_id, c.sensor_id FROM c LEFT JOIN mm ON mm.sensor_id = c.sensor_id WHERE bad OR len >= 6 OR abs(v - med) > 20 * mad""",
    "p6_found": f"""
WITH e AS (SELECT DISTINCT {_TIDY.format("source")} AS s, {_TIDY.format("target")} AS t FROM d3_link)
SELECT a.s AS key_a, a.t AS key_b FROM e a JOIN e b ON a.s = b.t AND a.t = b.s WHERE a.s < a.t""",
    "p6_partners": f"""
WITH r AS (SELECT {_TIDY.format("source")} AS s, {_TIDY.format("target")} AS t FROM d3_link),
e AS (SELECT s, t, count(*) AS n FROM r WHERE s IS NOT NULL AND t IS NOT NULL AND s != t GROUP BY 1, 2),
x AS (SELECT s AS k, n, 1 AS o, 0 AS i FROM e UNION ALL SELECT t, n, 0, 1 FROM e),
b AS (SELECT a.s AS k, count(*) AS r FROM e a JOIN e b ON a.s = b.t AND a.t = b.s GROUP BY 1)
SELECT x.k AS key, sum(n)::BIGINT AS links, sum(o)::BIGINT AS partners_out, sum(i)::BIGINT AS partners_in, coalesce(any_value(r), 0)::BIGINT AS reciprocal FROM x LEFT JOIN b ON b.k = x.k GROUP BY 1""",
}

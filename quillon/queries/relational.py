"""Relational operators: one query per operator, with its SQL twin where the dialects differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.engine import open_dir
from quillon.runtime import load
from quillon.sources import tables

# name: SQL that both engines run, or (Spark SQL, DuckDB SQL)
SQL: dict[str, str | tuple[str, str]] = {
    # scans
    "scan_star": "SELECT * FROM nation",
    "scan_derived_table": "SELECT n, count(*) AS c FROM (SELECT c_nationkey AS n FROM customer WHERE c_acctbal > 0) AS d GROUP BY n",
    "scan_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000",
    "scan_point": "SELECT * FROM orders WHERE o_orderkey = 33",
    # predicates
    "filter_compare": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_retailprice < 1500",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'",
    "filter_not_like": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT LIKE 'B%'",
    "filter_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "filter_in": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')",
    "filter_in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "filter_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "filter_exists": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "filter_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "filter_is_null": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "filter_and_or_not": "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_retailprice > 1400) AND (p_brand = 'Brand#11' OR p_size > 30)",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "case_when": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size_class FROM orders",
    "cte": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    # joins
    "join_inner": "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_full": "SELECT a.c_custkey AS left_key, b.s_suppkey AS right_key FROM customer a FULL OUTER JOIN supplier b ON a.c_custkey = b.s_suppkey",
    "join_cross": "SELECT r_name, s_suppkey FROM region, supplier",
    "join_implicit": "SELECT c_name, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 180000",
    "join_multiway": (
        "SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20, 4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    ),
    "join_semi": ("SELECT * FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT * FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT * FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT * FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "join_hash": ("SELECT /*+ SHUFFLE_HASH(o) */ o_orderkey, c_name FROM orders o JOIN customer c ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders o JOIN customer c ON o_custkey = c_custkey"),
    "join_merge": ("SELECT /*+ MERGE(l) */ l_orderkey, l_linenumber, o_orderstatus FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey", "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey"),
    "join_theta": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    # aggregates
    "agg_global": ("SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(l_shipdate) AS first, max(l_shipdate) AS last, avg(CAST(l_quantity AS DECIMAL(10, 0))) AS q FROM lineitem WHERE l_quantity > 10", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS lines, min(l_shipdate) AS first, max(l_shipdate) AS last, round(sum(l_quantity)::DECIMAL(18, 0)::DOUBLE / count(*), 4) AS q FROM lineitem WHERE l_quantity > 10"),
    "agg_empty": "SELECT count(*) AS n, count(c_name) AS names FROM customer WHERE c_custkey < 0",
    "agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20, 4))) AS DOUBLE) AS revenue, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_rollup": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)",
    # windows
    "win_row_number": ("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders"),
    "win_rank": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS r FROM part",
    "win_dense_rank": "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS r FROM part",
    "win_lag": "SELECT event_id, lag(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events",
    "win_lead": "SELECT event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events",
    "win_first": "SELECT event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events",
    "win_last": "SELECT event_id, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events",
    "win_nth": "SELECT event_id, nth_value(event_id, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third FROM events",
    "win_running_sum": "SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM lineitem",
    "win_moving_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS around FROM events",
    "win_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part",
    "win_min_max_count": "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    # order, limit, sets
    "order_multi": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal DESC NULLS LAST, c_custkey",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20",
    "distinct": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40",
    # scalar functions
    "fn_coalesce": "SELECT c_custkey, coalesce(o_orderpriority, 'none') AS p FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "fn_nullif": "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders",
    "fn_concat": ("SELECT n_nationkey, concat(n_name, '-', r_name) AS s FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT n_nationkey, n_name || '-' || r_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "fn_substring": "SELECT p_partkey, substring(p_name, 2, 4) AS a, substring(p_name, 3) AS b FROM part",
    "fn_case": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l FROM part",
    "fn_length_trim": ("SELECT p_partkey, CAST(length(trim(concat('  ', p_name, ' '))) AS BIGINT) AS n FROM part", "SELECT p_partkey, length(trim('  ' || p_name || ' ')) AS n FROM part"),
    "fn_abs_round": "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r1, round(c_acctbal) AS r0 FROM customer",
    "fn_arith": "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0) * 2 - l_tax + 1, 6) AS x, 7 / 2 AS q FROM lineitem",
}
SQL["agg_global"] = (
    SQL["agg_global"][0].replace("avg(CAST(l_quantity AS DECIMAL(10, 0)))", "round(CAST(sum(CAST(l_quantity AS DECIMAL(18, 0))) AS DOUBLE) / count(*), 4)"),
    SQL["agg_global"][1],
)


def _plain(name: str):
    text = SQL[name] if isinstance(SQL[name], str) else SQL[name][0]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return open_dir(spark, d).sql(text)

    run.__name__ = name
    return run


QUERIES = {name: _plain(name) for name in SQL}
ORACLES = {name: text if isinstance(text, str) else text[1] for name, text in SQL.items()}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def params(spark: SparkSession, d: str) -> DataFrame:
    return open_dir(spark, d).sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice > :price", {"status": "F", "price": 150000})


@query("SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000")
def match_single(spark: SparkSession, d: str) -> DataFrame:
    return open_dir(spark, d).sql("MATCH (p:customer) WHERE p.c_acctbal > 9000 RETURN p.c_name AS name, p.c_acctbal AS balance")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2")
def insert_select(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("INSERT INTO region (r_regionkey, r_name) SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2")
    return e.table("region")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NORTH' UNION ALL SELECT 91, 'it''s'")
def insert_values(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("INSERT INTO region (r_regionkey, r_name) VALUES (90, 'NORTH'), (91, 'it''s')")
    return e.table("region")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN upper('changed') ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 77, 'CHANGED', 0")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    new = spark.createDataFrame([(0,), (1,), (2,), (77,)], "n_nationkey int").withColumns({"n_name": F.lit("CHANGED"), "n_regionkey": F.lit(0)})
    return tables.upsert(nation, new, ["n_nationkey"], update=["n_name"])


@query("SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("UPDATE supplier SET s_acctbal = 0 WHERE s_acctbal < 0")
    return e.table("supplier")


@query("SELECT * FROM customer WHERE NOT coalesce(c_acctbal < 1000, false)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("DELETE FROM customer WHERE c_acctbal < 1000")
    return e.table("customer")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def import_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation")
    path = tables.scratch(spark, "csv")
    tables.export(nation, path, "csv")
    return tables.imported(spark, path, "csv", nation.schema)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def import_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events")
    path = tables.scratch(spark, "json")
    tables.export(events, path, "json")
    return tables.imported(spark, path, "json", events.schema)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return tables.page(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 50, after=(100,))


@query("SELECT n, value FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type) AS n, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i FROM events WHERE value IS NOT NULL) WHERE i = floor(0.9 * (n - 1) + 0.5)")
def agg_percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators.timeseries import nearest_rank_percentile

    return nearest_rank_percentile(load(spark, d, "events"), ["event_type"], "value", 90).select(F.col("total").alias("n"), "value")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, min(value) AS min, max(value) AS max FROM events GROUP BY event_type")
def agg_stddev_pop(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators.timeseries import statistics

    return statistics(load(spark, d, "events"), ["event_type"]).withColumns({"mean": F.round("mean", 6), "std_dev": F.round("std_dev", 6)})


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def fn_content_hash(spark: SparkSession, d: str) -> DataFrame:
    from quillon.functions.scalar import content_hash

    return load(spark, d, "documents").select("doc_id", content_hash("text").alias("h"))


@query("SELECT count(*) AS n FROM lineitem")
def index_count(spark: SparkSession, d: str) -> DataFrame:
    return open_dir(spark, d).sql("SELECT count(*) AS n FROM lineitem")  # from the files' footers; no column is read


@query("SELECT CASE WHEN n_nationkey < 2 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_nationkey, CASE WHEN n_nationkey < 2 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 'new', 77, 3")
def insert_on_conflict(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    names = {r["n_nationkey"]: r["n_name"] for r in load(spark, d, "nation").where("n_nationkey < 2").collect()}
    e.sql(f"INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (0, '{names[0]}', 4), (1, '{names[1]}', 4), (77, 'new', 3), (77, 'new', 2) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = CASE WHEN n_nationkey < 2 THEN concat(upper(excluded.n_name), '!') ELSE n_name END, n_regionkey = excluded.n_regionkey")
    return e.table("nation")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 2) THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")
def update_limit(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("UPDATE nation SET n_regionkey = 9 WHERE n_regionkey = 1 LIMIT 2")
    return e.table("nation")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'it''s, new'")
def insert_set(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("INSERT INTO region SET r_regionkey = 50, r_name = 'it''s, new'")
    return e.table("region")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 0.75 ELSE 0.5 END::DOUBLE AS score, (c_acctbal > 5000)::BIGINT AS activations FROM customer")
def activate(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("SYSTEM ACTIVATE customer BY 0.25 WHERE c_acctbal > 5000")
    return e.table("customer").select("c_custkey", "score", "activations")


@query("SELECT column_name, data_type FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(column_name, data_type)")
def describe(spark: SparkSession, d: str) -> DataFrame:
    return open_dir(spark, d).sql("DESCRIBE nation").select(F.col("col_name").alias("column_name"), "data_type")


_STAT = "SELECT 'customer' AS class_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS nulls, min({c})::VARCHAR AS low, max({c})::VARCHAR AS high FROM customer"


@query(" UNION ALL ".join(_STAT.format(c=c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def table_stats(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("ANALYZE customer")
    return e.sql("SHOW TABLE STATS customer").where("column_name != 'c_acctbal'").drop("about_distinct")  # doubles are written differently

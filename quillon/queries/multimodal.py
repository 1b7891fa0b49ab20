"""Queries of the modalities: vectors, text, graph, ontology, SPARQL, time, space, streams, value, lineage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import geo, scalar
from quillon.operators import graph, movement, ontology, rules, text, timeseries, vector_search
from quillon.plans import sparql
from quillon.plans.engine import open_dir
from quillon.runtime import epoch_us, load
from quillon.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- vectors -------------------------------------------------------------------------------------------------

Q0, Q1 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)", "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)"
V = "embedding::DOUBLE[]"
BITS = "list_transform({}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"
DISTANCE = {
    "l2": f"list_distance({V}, {{q}})", "cosine": f"1 - list_cosine_similarity({V}, {{q}})", "ip": f"-list_inner_product({V}, {{q}})",
    "hamming": f"list_sum(list_transform(list_zip({BITS.format(V)}, {BITS.format('{q}')}), lambda p: CASE WHEN p[1] != p[2] THEN 1.0 ELSE 0.0 END))::DOUBLE",
    "tanimoto": f"1 - list_inner_product({BITS.format(V)}::DOUBLE[], {BITS.format('{q}')}::DOUBLE[]) / list_sum(list_transform(list_zip({BITS.format(V)}, {BITS.format('{q}')}), lambda p: greatest(p[1], p[2])))",
}


def _vector(spark, d, k: int) -> list[float]:
    return [float(x) for x in load(spark, d, "embeddings").where(F.col("vec_id") == k).first()["embedding"]]


def _top(metric: str, where: str | None = None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = load(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
        q = _vector(spark, d, 0)
        if metric in ("hamming", "tanimoto"):
            e, q = e.withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0))), [float(x > 0) for x in q]
        if where:
            e = e.where(where)
        return vector_search.top_k(e, "embedding", q, 10, metric).select("vec_id", F.round("_distance", 6).alias("distance"))

    return run


for _m, _d in DISTANCE.items():
    QUERIES[f"vec_{_m}"] = _top(_m)
    ORACLES[f"vec_{_m}"] = f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {_d.format(q=Q0)} AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10"
QUERIES["vec_filtered"] = _top("cosine", "label = 3")
ORACLES["vec_filtered"] = f"SELECT vec_id, round(d, 6) AS distance FROM (SELECT vec_id, {DISTANCE['cosine'].format(q=Q0)} AS d FROM embeddings WHERE label = 3) ORDER BY d, vec_id LIMIT 10"


@query(ORACLES["vec_l2"])
def vector_search_statement(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    q = _vector(spark, d, 0)
    e.sql(f"CREATE VECTOR INDEX vi ON embeddings (embedding) METRIC l2 DIMENSION {len(q)} M 16")
    return e.sql(f"VECTOR SEARCH ON embeddings (embedding) QUERY {q} TOP 10 EF 100").select("vec_id", F.round("_distance", 6).alias("distance"))


@query(f"""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY {DISTANCE['l2'].format(q=Q0)}, vec_id) - 1 AS r FROM embeddings QUALIFY r < 50),
b AS (SELECT vec_id, row_number() OVER (ORDER BY {DISTANCE['cosine'].format(q=Q1)}, vec_id) - 1 AS r FROM embeddings QUALIFY r < 50),
u AS (SELECT vec_id, 0.7 / (60 + r) AS s FROM a UNION ALL SELECT vec_id, 0.3 / (60 + r) FROM b)
SELECT vec_id, round(sum(s)::DOUBLE, 8) AS score FROM u GROUP BY 1 ORDER BY sum(s) DESC, vec_id LIMIT 10""")
def vec_rrf(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    one = vector_search.top_k(e, "embedding", _vector(spark, d, 0), 50, "l2")
    two = vector_search.top_k(e, "embedding", _vector(spark, d, 1), 50, "cosine")
    return vector_search.fused([(one, 0.7), (two, 0.3)], "vec_id", 10).select("vec_id", F.round("score", 8).alias("score"))


@query()
def vec_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.kmeans(load(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query("SELECT vec_id, round(list_extract(embedding, 1)::DOUBLE / n, 6) AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / n)), 5) AS total FROM (SELECT *, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = vector_search.normalized("embedding")
    return load(spark, d, "embeddings").select("vec_id", n.alias("n")).select("vec_id", F.round(F.col("n")[0], 6).alias("first"), F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


# ---- text ----------------------------------------------------------------------------------------------------

ASKED = "gateway missing periods gateway"
_CJK = "'[一-鿿㐀-䶿豈-﫿぀-ヿ가-힯]'"
_LEN = f"len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) + len(regexp_extract_all(coalesce(text, ''), {_CJK})) + greatest(len(regexp_extract_all(coalesce(text, ''), {_CJK})) - 1, 0)"


@query(f"""
WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('gateway', 'missing', 'periods') GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), l AS (SELECT doc_id, {_LEN} AS len FROM documents), s AS (SELECT count(*) AS n, avg(len) AS al FROM l)
SELECT tf.doc_id AS doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al)) * CASE WHEN term = 'gateway' THEN 2 ELSE 1 END), 6) AS score
FROM tf JOIN df USING (term) JOIN l USING (doc_id), s GROUP BY 1""")
def bm25(spark: SparkSession, d: str) -> DataFrame:
    return text.bm25(load(spark, d, "documents"), "doc_id", ["text"], ASKED).select("doc", F.round("score", 6).alias("score"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'weight of each')")
def ngram_contains(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return text.indexed_search(text.gram_index(docs, "doc_id", "text", 3), docs, "doc_id", "text", "weight of each", 3).select("doc_id")


@query(f"SELECT doc_id, ({_LEN})::BIGINT AS tokens FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.size(text.tokens("text")).cast("long").alias("tokens"))


@query()
def text_vector_rerank(spark: SparkSession, d: str) -> DataFrame:
    found = text.bm25(load(spark, d, "documents"), "doc_id", ["text"], ASKED, 100)
    e = load(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    near = vector_search.top_k(e.join(found, e.vec_id == found.doc, "left_semi"), "embedding", _vector(spark, d, 0), 100)
    lexical = found.select(F.col("doc").alias("vec_id"), (-F.col("score")).alias("_distance"))
    return vector_search.fused([(lexical, 0.5), (near, 0.5)], "vec_id", 10)


# ---- graph ---------------------------------------------------------------------------------------------------

_EDGES = """
E AS (SELECT 'customer::' || c_custkey AS src, 'nation::' || c_nationkey AS dst, 'in_nation' AS label, 1.0::DOUBLE AS weight FROM customer
UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'in_nation', 2.0 FROM supplier
UNION ALL SELECT 'nation::' || n_nationkey, 'region::' || n_regionkey, 'in_region', 1.0 + n_nationkey / 10.0 FROM nation
UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, 'placed_by', o_totalprice / 1000 FROM orders)"""
_CO = """
X AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
C AS (SELECT DISTINCT 'supplier::' || a.s AS src, 'supplier::' || b.s AS dst FROM X a JOIN X b ON a.o = b.o AND a.s < b.s)"""


def _edges(spark, d) -> DataFrame:
    def part(table, a, x, b, y, label, weight):
        return load(spark, d, table).select(F.concat(F.lit(f"{a}::"), F.col(x)).alias("src"), F.concat(F.lit(f"{b}::"), F.col(y)).alias("dst"), F.lit(label).alias("label"), weight.cast("double").alias("weight"))

    return (
        part("customer", "customer", "c_custkey", "nation", "c_nationkey", "in_nation", F.lit(1.0))
        .union(part("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation", F.lit(2.0)))
        .union(part("nation", "nation", "n_nationkey", "region", "n_regionkey", "in_region", F.lit(1.0) + F.col("n_nationkey") / 10.0))
        .union(part("orders", "order", "o_orderkey", "customer", "o_custkey", "placed_by", F.col("o_totalprice") / 1000))
    )


def _co(spark, d) -> DataFrame:
    """Suppliers of lines of one order."""
    x = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).where("o is not null and s is not null")
    x = x.groupBy("o").agg(F.collect_set("s").alias("all")).where("size(all) > 1")
    pair = x.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a < b").distinct()
    return pair.select(F.concat(F.lit("supplier::"), "a").alias("src"), F.concat(F.lit("supplier::"), "b").alias("dst"))


def _bfs_sql(start: str, moves: str, depth: int) -> str:
    return f"""WITH RECURSIVE {_EDGES}, M AS ({moves}), b(v, k) AS (SELECT '{start}', 0 UNION SELECT M.b, k + 1 FROM b JOIN M ON M.a = b.v WHERE k < {depth})
SELECT v AS vertex, min(k)::INT AS depth FROM b WHERE v != '{start}' GROUP BY 1"""


_OUT, _IN = "SELECT src AS a, dst AS b FROM E", "SELECT dst AS a, src AS b FROM E"


@query(_bfs_sql("order::33", _OUT, 3))
def bfs_out(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_edges(spark, d), "order::33")


@query(_bfs_sql("region::1", _IN, 3))
def bfs_in(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_edges(spark, d), "region::1", direction="in")


@query(_bfs_sql("nation::3", f"{_OUT} UNION ALL {_IN}", 2))
def bfs_both(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_edges(spark, d), "nation::3", direction="both", depth=2)


@query(_bfs_sql("region::1", f"SELECT * FROM ({_IN}) WHERE b NOT LIKE 'customer%'", 3))
def bfs_pruned(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs(_edges(spark, d), "region::1", direction="in", where="id not like 'customer%'")


@query(_bfs_sql("nation::3", "SELECT dst AS a, src AS b FROM E WHERE label = 'in_nation'", 2))
def traverse_statement(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d).register("links", _edges(spark, d))
    return e.sql("GRAPH TRAVERSE links FROM 'nation::3' IN LABEL in_nation DEPTH 2")


@query(f"WITH {_EDGES} SELECT dst AS vertex FROM E WHERE src = 'customer::7' UNION SELECT src FROM E WHERE dst = 'customer::7'")
def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), "customer::7", "both")


@query(f"""WITH RECURSIVE {_EDGES}, W AS (SELECT src, dst FROM E UNION SELECT 'region::' || r_regionkey, 'world' FROM region), M AS (SELECT src AS a, dst AS b FROM W UNION SELECT dst, src FROM W),
p(v, path) AS (SELECT 'customer::1', ['customer::1'] UNION ALL SELECT b, list_append(path, b) FROM p JOIN M ON a = v WHERE len(path) < 8 AND NOT list_contains(path, b) AND NOT v = 'customer::2' AND (b LIKE 'nation%' OR b LIKE 'region%' OR b IN ('world', 'customer::2')))
SELECT path, (len(path) - 1)::BIGINT AS length FROM p WHERE v = 'customer::2' ORDER BY len(path), path LIMIT 1""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    world = load(spark, d, "region").select(F.concat(F.lit("region::"), "r_regionkey").alias("src"), F.lit("world").alias("dst"))
    e = _edges(spark, d).select("src", "dst").union(world)
    return graph.shortest_path(e, "customer::1", "customer::2", direction="both")


@query(f"""WITH RECURSIVE {_EDGES}, p(v, c) AS (SELECT 'region::1', 0.0::DOUBLE UNION ALL SELECT src, c + weight FROM p JOIN E ON dst = v)
SELECT v AS vertex, round(min(c), 6) AS cost FROM p GROUP BY 1""")
def dijkstra(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return graph.cheapest(e, "region::1").select("vertex", F.round("cost", 6).alias("cost"))


@query("SELECT c_name AS customer, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def match_1hop(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.register("placed", load(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target")))
    return e.sql("MATCH (o:orders)-[e:placed]->(c:customer) WHERE o.o_totalprice > 200000 RETURN c.c_name AS customer, o.o_orderkey AS o")


@query("SELECT r_name AS region, s_name AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def match_2hop(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.register("part_of", load(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target")))
    e.register("based_in", load(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target")))
    return e.sql("MATCH (r:region)<-[p:part_of]-(n:nation)<-[b:based_in]-(s:supplier) RETURN r.r_name AS region, s.s_name AS supplier")


@query(f"WITH {_CO} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM C x JOIN C y ON x.dst = y.src WHERE x.src != y.dst")
def match_injective(spark: SparkSession, d: str) -> DataFrame:
    return graph.match_pattern(_co(spark, d), [("a", None, "b"), ("b", None, "c")])


@query(f"WITH {_EDGES}, N AS (SELECT src AS v FROM E UNION ALL SELECT dst FROM E), G AS (SELECT v, count(*) AS degree FROM N GROUP BY 1) SELECT degree, count(*) AS vertices FROM G GROUP BY 1")
def degree_dist(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_distribution(_edges(spark, d))


@query(f"""WITH RECURSIVE {_CO}, B AS (SELECT src AS a, dst AS b FROM C UNION SELECT dst, src FROM C), r(v, w) AS (SELECT a, a FROM B UNION SELECT r.v, B.b FROM r JOIN B ON B.a = r.w)
SELECT v AS vertex, min(w) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(_co(spark, d))


@query(f"""WITH {_CO}, B AS (SELECT src AS a, dst AS b FROM C UNION SELECT dst, src FROM C), G AS (SELECT a, count(*) AS n FROM B GROUP BY 1),
T AS (SELECT x.a, count(*) AS t FROM B x JOIN B y ON x.a = y.a AND x.b < y.b JOIN B z ON z.a = x.b AND z.b = y.b GROUP BY 1)
SELECT G.a AS vertex, n AS neighbours, round(2 * coalesce(t, 0) / (n * (n - 1)), 6) AS coefficient FROM G LEFT JOIN T ON T.a = G.a WHERE n >= 2""")
def clustering(spark: SparkSession, d: str) -> DataFrame:
    return graph.clustering(_co(spark, d)).select("vertex", "neighbours", F.round("coefficient", 6).alias("coefficient"))


def _pagerank_sql(rounds: int) -> str:
    sql = f"WITH {_EDGES}, D AS MATERIALIZED (SELECT DISTINCT src, dst FROM E), O AS MATERIALIZED (SELECT src, count(*) AS n FROM D GROUP BY 1), N AS MATERIALIZED (SELECT src AS v FROM D UNION SELECT dst FROM D), K AS MATERIALIZED (SELECT count(*) AS k FROM N), R0 AS MATERIALIZED (SELECT v, 1.0 / k AS r FROM N, K)"
    for i in range(1, rounds + 1):
        sql += f""", F{i} AS (SELECT dst AS v, sum(r / n) AS f FROM D JOIN O ON D.src = O.src JOIN R{i - 1} ON R{i - 1}.v = D.src GROUP BY 1),
L{i} AS (SELECT coalesce(sum(r), 0) AS l FROM R{i - 1} LEFT JOIN O ON O.src = v WHERE n IS NULL),
R{i} AS MATERIALIZED (SELECT N.v, 0.15 / k + 0.85 * (coalesce(f, 0) + l / k) AS r FROM N LEFT JOIN F{i} ON F{i}.v = N.v, K, L{i})"""
    return sql + f" SELECT v AS vertex, round(r, 9) AS rank FROM R{rounds}"


@query(_pagerank_sql(10))
def pagerank_10(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_edges(spark, d), iterations=10, tolerance=0).select("vertex", F.round("rank", 9).alias("rank"))


@query(f"WITH {_EDGES} SELECT src, dst FROM E WHERE (src LIKE 'nation%' OR src LIKE 'supplier%') AND (dst LIKE 'nation%' OR dst LIKE 'supplier%')")
def subgraph_label(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    ends = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("labels", F.array(F.split("id", "::")[0]))
    return graph.subgraph(e, ends, ["nation", "supplier"]).select("src", "dst")


@query(f"WITH {_EDGES} SELECT src, dst, label FROM E WHERE label = 'in_region'")
def subgraph_edge_label(spark: SparkSession, d: str) -> DataFrame:
    return graph.subgraph_by_edge_label(_edges(spark, d), ["in_region"]).select("src", "dst", "label")


@query()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(_co(spark, d)).select("vertex", F.round("centrality", 9).alias("centrality"))


GCN = ((0.5, -1.0), (0.25, 0.75))  # two features to two


@query(f"""WITH {_CO}, N AS (SELECT 'supplier::' || s_suppkey AS id, s_acctbal / 10000 AS x FROM supplier),
B AS (SELECT src AS a, dst AS b FROM C UNION SELECT dst, src FROM C UNION SELECT id, id FROM N), G AS (SELECT a, count(*) AS n FROM B GROUP BY 1),
H AS (SELECT B.a AS id, sum(x / sqrt(g.n * h.n)) AS p, sum(1 / sqrt(g.n * h.n)) AS q FROM B JOIN G g ON g.a = B.a JOIN G h ON h.a = B.b JOIN N ON N.id = B.b GROUP BY 1)
SELECT id, round(greatest(0, p * {GCN[0][0]} + q * {GCN[1][0]}), 6)::DOUBLE AS x0, round(greatest(0, p * {GCN[0][1]} + q * {GCN[1][1]}), 6)::DOUBLE AS x1 FROM H""")
def gcn(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    f = load(spark, d, "supplier").select(F.concat(F.lit("supplier::"), "s_suppkey").alias("id"), F.array(F.col("s_acctbal") / 10000, F.lit(1.0)).alias("x"))
    h = graph.gcn_layer(_co(spark, d), f, np.array(GCN))
    return h.select("id", F.round(F.col("x")[0], 6).alias("x0"), F.round(F.col("x")[1], 6).alias("x1"))


@query("SELECT 'supplier::' || s_suppkey AS s, p, 'Place::' || x AS o FROM (SELECT s_suppkey, 'in' AS p, s_nationkey AS x FROM supplier UNION ALL SELECT s_suppkey, 'in', 100 + n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def graph_forward_chain(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select(F.concat(F.lit("supplier::"), "s_suppkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("Place::"), "s_nationkey").alias("o"))
    n = load(spark, d, "nation").select(F.concat(F.lit("Place::"), "n_nationkey"), F.lit("in"), F.concat(F.lit("Place::"), F.col("n_regionkey") + 100))
    rule = spark.createDataFrame([("in", "type", "TransitiveProperty")], "s string, p string, o string")
    return graph.forward_chain(s.union(n).union(rule)).where("p = 'in' and s like 'supplier%'")


# ---- ontology ------------------------------------------------------------------------------------------------


def _parts(spark, d) -> tuple[ontology.Ontology, DataFrame]:
    part = load(spark, d, "part")
    o = ontology.Ontology().add_class("Part").add_class("Item", equivalents=["Part"])
    for r in part.select("p_type", "p_brand").distinct().collect():  # the class tree: types and brands
        o.add_class(r["p_type"], ["Part"])
        o.add_class(f"{r['p_type']}_{r['p_brand']}", [r["p_type"]])
    facts = part.select(F.concat(F.lit("part::"), "p_partkey").alias("s"), F.lit(ontology.TYPE).alias("p"), F.concat_ws("_", "p_type", "p_brand").alias("o"))
    return o, facts


def _places(spark, d) -> tuple[ontology.Ontology, DataFrame]:
    o = ontology.Ontology()
    o.add_property("located_in", transitive=True, inverse="contains", equivalents={"situated_in"})
    o.add_property("in_nation", parents={"located_in"}).add_property("in_region", parents={"located_in"}).add_property("placed_by", parents={"located_in"}).add_property("next_to", symmetric=True)
    facts = _edges(spark, d).select(F.col("src").alias("s"), F.col("label").alias("p"), F.col("dst").alias("o"))
    return o, facts


_LOC = f"{_EDGES}, L AS (SELECT src AS s, dst AS o FROM E)"


@query("SELECT DISTINCT p_type || '_' || p_brand AS child, a AS ancestor FROM part, LATERAL (SELECT unnest([p_type, 'Part']) AS a) UNION SELECT DISTINCT p_type, 'Part' FROM part")
def subclass_closure(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select("p_type", "p_brand").distinct()
    links = part.select(F.concat_ws("_", "p_type", "p_brand").alias("child"), F.col("p_type").alias("parent")).union(part.select("p_type", F.lit("Part")))
    return ontology.closure_pairs(links)


@query("SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def subclass_scan(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("CREATE CLASS Buyer EXTENDS Partner")
    e.sql("CREATE CLASS Vendor SUBCLASS OF Partner")
    e.register("Buyer", load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))
    e.register("Vendor", load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))
    return e.table("Partner")


@query("SELECT 'part::' || p_partkey AS s, a AS o FROM part, LATERAL (SELECT unnest([p_type, 'Part']) AS a)")
def cax_sco(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _parts(spark, d)
    return ontology.cax_sco(facts, o).select("s", "o")


@query("SELECT 'part::' || p_partkey AS s, 'Part' AS o FROM part")
def cax_eqc(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _parts(spark, d)
    return ontology.cax_eqc(facts.withColumn("o", F.lit("Item")), o).select("s", "o")


@query(f"WITH {_LOC} SELECT s, 'located_in' AS p, o FROM L")
def prp_spo(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _places(spark, d)
    return ontology.prp_spo(facts, o)


@query(f"WITH {_LOC} SELECT s, 'situated_in' AS p, o FROM L")
def prp_eqp(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _places(spark, d)
    return ontology.prp_eqp(facts.withColumn("p", F.lit("located_in")), o)


@query(f"WITH {_LOC} SELECT o AS s, 'contains' AS p, s AS o FROM L")
def prp_inv(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _places(spark, d)
    return ontology.prp_inv(facts.withColumn("p", F.lit("located_in")), o)


@query(f"WITH {_LOC} SELECT a.s, 'located_in' AS p, b.o FROM L a JOIN L b ON a.o = b.s")
def prp_trp(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _places(spark, d)
    return ontology.prp_trp(facts.withColumn("p", F.lit("located_in")), o)


@query(f"WITH {_LOC} SELECT o AS s, 'next_to' AS p, s AS o FROM L")
def prp_symp(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _places(spark, d)
    return ontology.prp_symp(facts.withColumn("p", F.lit("next_to")), o)


@query(f"""WITH RECURSIVE {_LOC}, A(s, o) AS (SELECT s, o FROM L UNION SELECT A.s, L.o FROM A JOIN L ON A.o = L.s)
SELECT s, 'located_in' AS p, o FROM A UNION ALL SELECT s, 'situated_in', o FROM A UNION ALL SELECT o, 'contains', s FROM A""")
def infer_facts(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _places(spark, d)
    return ontology.inferred(facts, o).where("rule is not null").select("s", "p", "o")


@query("SELECT 'part::' || p_partkey AS s, a AS o FROM part, LATERAL (SELECT unnest([p_type, 'Part', p_type || '_' || p_brand]) AS a)")
def infer_types(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _parts(spark, d)
    return ontology.inferred(facts, o, rules=["cax-sco", "cax-eqc"]).select("s", "o")


@query("SELECT 'customer::' || c_custkey AS s, 'Poor' AS a, 'Rich' AS b FROM customer WHERE c_acctbal > 5000 AND c_acctbal < 5500")
def disjoint_check(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select(F.concat(F.lit("customer::"), "c_custkey").alias("s"), "c_acctbal")
    f = c.where("c_acctbal > 5000").select("s", F.lit("Rich").alias("o")).union(c.where("c_acctbal < 5500").select("s", F.lit("Poor")))
    o = ontology.Ontology().add_class("Rich", disjoint=["Poor"])
    return ontology.inconsistent(f.select("s", F.lit(ontology.TYPE).alias("p"), "o"), o)


@query("""SELECT 'region::' || n_regionkey AS s, 'contains' AS p, 'nation::1' AS o, 'inferred' AS status, 'prp-inv' AS rule, 2 AS round FROM nation WHERE n_nationkey = 1
UNION ALL SELECT 'nation::1', 'in_region', 'region::' || n_regionkey, 'stated', NULL, 0 FROM nation WHERE n_nationkey = 1""")
def explain_chain(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _places(spark, d)
    known, home = ontology.inferred(facts, o), facts.where("s = 'nation::1' and p = 'in_region'").first()["o"]
    return ontology.explained(known, home, "contains", "nation::1").union(ontology.explained(known, "nation::1", "in_region", home))


@query("""SELECT 1 AS step, 'region::' || n_regionkey AS s, 'contains' AS p, 'nation::1' AS o, 'prp-inv' AS rule, ['nation::1 located_in region::' || n_regionkey] AS premises FROM nation WHERE n_nationkey = 1
UNION ALL SELECT 2, 'nation::1', 'located_in', 'region::' || n_regionkey, 'prp-spo', ['nation::1 in_region region::' || n_regionkey] FROM nation WHERE n_nationkey = 1
UNION ALL SELECT 3, 'nation::1', 'in_region', 'region::' || n_regionkey, NULL, [] FROM nation WHERE n_nationkey = 1""")
def explain_reasoning(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.ontology, facts = _places(spark, d)
    e.register("facts", facts)
    home = facts.where("s = 'nation::1' and p = 'in_region'").first()["o"]
    return e.sql(f"EXPLAIN REASONING facts '{home}' 'contains' 'nation::1'")


@query("""SELECT 'nation::' || n_nationkey AS s, 'located_in' AS p, 'region::' || n_regionkey AS o, 'prp-spo' AS rule, 1 AS round FROM nation""")
def infer_statement(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    for s in ("CREATE PROPERTY located_in TRANSITIVE", "CREATE PROPERTY in_region EXTENDS located_in"):
        e.sql(s)
    e.register("facts", _edges(spark, d).select(F.col("src").alias("s"), F.col("label").alias("p"), F.col("dst").alias("o")))
    return e.sql("INFER SELECT s, p, o FROM facts WHERE p = 'in_region' SCOPE property")


@query("SELECT n_nationkey, ['Area', 'Land', 'nation'] AS __types__, ['Area', 'Land'] AS __inferred__ FROM nation WHERE n_nationkey > 3")
def select_infer(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    for s in ("CREATE CLASS Land", "ALTER CLASS nation ADD PARENT Land", "ALTER CLASS Land ADD EQUIVALENT Area"):
        e.sql(s)
    return e.sql("SELECT n_nationkey FROM nation WHERE n_nationkey > 3 INFER @onto(SUBCLASS)")


@query("""WITH T AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) SELECT 'supplier::' || k AS s, 'Seller' AS cls, 'sells' AS property, kind FROM
(SELECT k, 'min' AS kind FROM T WHERE k % 3 < 2 UNION ALL SELECT k, 'some' FROM T WHERE NOT (k % 3 >= 1 AND k % 2 = 0) UNION ALL SELECT k, 'all' FROM T WHERE k % 3 >= 1 AND (k % 2 != 0 OR k % 3 = 2))""")
def restrictions(spark: SparkSession, d: str) -> DataFrame:
    s, k = load(spark, d, "supplier"), F.col("s_suppkey")
    who = F.concat(F.lit("supplier::"), k)
    f = s.select(who.alias("s"), F.lit(ontology.TYPE).alias("p"), F.lit("Shop").alias("o"))
    f = f.union(s.where("s_suppkey % 3 >= 1").select(who, F.lit("sells"), F.concat(F.lit("thing::"), k))).union(s.where("s_suppkey % 3 = 2").select(who, F.lit("sells"), F.lit("thing::x")))
    f = f.union(s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("thing::"), k), F.lit(ontology.TYPE), F.lit("Good")))
    o = ontology.Ontology().add_class("Shop", ["Seller"]).add_class("Good")
    return ontology.unmet(f, o, [ontology.Restriction("Seller", "sells", "min", 2), ontology.Restriction("Seller", "sells", "some", "Good"), ontology.Restriction("Seller", "sells", "all", "Good")])


@query("SELECT 'part::' || p_partkey AS s FROM part WHERE p_type IN ('ECONOMY', 'SMALL')")
def class_union(spark: SparkSession, d: str) -> DataFrame:
    o, facts = _parts(spark, d)
    return ontology.of_expression(facts, o, "union", ["ECONOMY", "SMALL"])


@query(f"WITH {_EDGES} SELECT src AS s, label AS p, dst AS o FROM E WHERE label = 'in_region' AND src != 'nation::3' UNION ALL SELECT 'nation::99', 'in_region', 'region::1'")
def triples_changed(spark: SparkSession, d: str) -> DataFrame:
    t = _edges(spark, d).select(F.col("src").alias("s"), F.col("label").alias("p"), F.col("dst").alias("o"))
    one = lambda s: ontology.matched(t, s=s, p="in_region")
    t2 = ontology.removed(ontology.added(t, one("nation::1").withColumns({"s": F.lit("nation::99"), "o": F.lit("region::1")})), one("nation::3"))
    return ontology.matched(t2, p="in_region")


@query("""WITH ends AS (SELECT DISTINCT o_custkey AS k FROM orders), known AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT (SELECT count(*) FROM orders) AS edges, count(*) AS endpoints, count(known.k) AS resolved, round(100.0 * count(known.k) / count(*), 4) AS percent FROM ends LEFT JOIN known USING (k)""")
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    rel = load(spark, d, "orders").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target"))
    return ontology.gap_report(rel, load(spark, d, "customer").where("c_acctbal > 0"), "c_custkey")


@query("SELECT n_name, s_name, 1.0::DOUBLE AS score FROM nation JOIN supplier ON lower(n_name) = lower('nation_' || s_suppkey)")
def bridge_match(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "nation").select("n_name")
    b = load(spark, d, "supplier").select("s_name", F.concat(F.lit("nation_"), "s_suppkey").alias("key"))
    return ontology.bridge(a, "n_name", b, "key", "case_insensitive").select("n_name", "s_name", "score")


@query("""WITH x AS (SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
y AS (SELECT a, b, max(CASE WHEN k <= least(length(a), length(b)) AND left(a, k::BIGINT) = left(b, k::BIGINT) THEN k ELSE 0 END) AS n FROM x, (SELECT unnest(generate_series(1, 40)) AS k) GROUP BY 1, 2)
SELECT a, b, round(n / greatest(length(a), length(b)), 6) AS score FROM y WHERE n > 0""")
def bridge_prefix(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    own = lambda x: n.select(F.col("n_name").alias(x), F.col("n_nationkey").alias(f"k{x}"))
    return ontology.bridge(own("a"), "a", own("b"), "b", "prefix").where("ka < kb").select("a", "b", F.round("score", 6).alias("score"))


@query("SELECT ['region::1', 'nation::' || n_nationkey, 'customer::' || c_custkey, 'order::' || o_orderkey] AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def trace_chain(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    table = lambda label: e.where(F.col("label") == label)
    return graph.trace(spark.createDataFrame([("region::1",)], "vertex string"), [(table("in_region"), "in"), (table("in_nation").where("src like 'customer%'"), "in"), (table("placed_by"), "in")], limit=5000)


@query(f"WITH {_EDGES}, C AS (SELECT src, dst FROM E WHERE label = 'in_nation' AND src LIKE 'customer%' QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 3) SELECT [dst, src] AS path FROM C WHERE dst IN ('nation::1', 'nation::2')")
def trace_limited(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).where("label = 'in_nation' and src like 'customer%'")
    return graph.trace(spark.createDataFrame([("nation::1",), ("nation::2",)], "vertex string"), [(e, "in")], limit=3)


@query(f"""WITH RECURSIVE {_EDGES}, p(v, path) AS (SELECT 'order::33', ['order::33'] UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN E ON src = v WHERE len(path) < 4)
SELECT v AS vertex, (len(path) - 1)::INT AS depth, path FROM p WHERE len(path) > 1""")
def bfs_with_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.bfs_paths(_edges(spark, d), "order::33")


@query(f"""WITH {_EDGES}, N AS (SELECT src, dst FROM E WHERE label != 'placed_by') SELECT 'nation::' || n_nationkey AS vertex, 1 AS depth, ['region::1', 'nation::' || n_nationkey] AS path FROM nation WHERE n_regionkey = 1
UNION ALL SELECT N.src, 2, ['region::1', N.dst, N.src] FROM N JOIN nation ON N.dst = 'nation::' || n_nationkey WHERE n_regionkey = 1 ORDER BY path""")
def depth_first(spark: SparkSession, d: str) -> DataFrame:
    return graph.dfs(_edges(spark, d), "region::1", depth=2, direction="in")


@query(f"WITH {_EDGES}, V AS (SELECT 'nation::3' AS v UNION SELECT dst FROM E WHERE src = 'nation::3' UNION SELECT src FROM E WHERE dst = 'nation::3') SELECT src, dst, label FROM E WHERE src IN (FROM V) AND dst IN (FROM V)")
def subgraph_around(spark: SparkSession, d: str) -> DataFrame:
    return graph.around(_edges(spark, d), "nation::3", depth=1, nodes=100_000).select("src", "dst", "label")


@query(f"""WITH {_EDGES}, D AS (SELECT v, count(*) AS n FROM (SELECT src AS v FROM E UNION ALL SELECT dst FROM E) GROUP BY 1)
SELECT min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, median(n) AS median FROM D""")
def degree_statistics(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d).register("links", _edges(spark, d))
    return e.sql("GRAPH ANALYZE links degree_statistics").withColumn("mean", F.round("mean", 6))


@query(_pagerank_sql(3))
def pagerank_statement(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d).register("links", _edges(spark, d))
    return e.sql("GRAPH ANALYZE links pagerank DAMPING 0.85 ITERATIONS 3 TOLERANCE 0").select("vertex", F.round("rank", 9).alias("rank"))


@query("SELECT 'a' AS src, 'b' AS dst, 'knows' AS label, 2.5::DOUBLE AS weight UNION ALL SELECT 'b', 'c', NULL, NULL")
def graph_tables(spark: SparkSession, d: str) -> DataFrame:
    e = open_dir(spark, d)
    e.sql("CREATE VERTEX TABLE people (name STRING)")
    e.sql("CREATE EDGE TABLE ties (label STRING, weight DOUBLE)")
    for s in ("INSERT VERTEX people 'a' SET name = 'Ann'", "INSERT EDGE ties FROM 'a' TO 'b' SET label = 'knows', weight = 2.5", "INSERT EDGE ties FROM 'b' TO 'c'"):
        e.sql(s)
    return e.sql("SELECT * FROM ties")


@query("SELECT 'supplier::' || s_suppkey AS s, 'type' AS p, x AS o FROM supplier, (SELECT unnest(['Shop', 'Seller', 'Agent']) AS x) WHERE s_suppkey <= 50")
def graph_backward_chain(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").where("s_suppkey <= 50").select(F.concat(F.lit("supplier::"), "s_suppkey").alias("s"), F.lit("runs").alias("p"), F.lit("till").alias("o"))
    rule = spark.createDataFrame([("runs", "domain", "Shop"), ("Shop", "subClassOf", "Seller"), ("Seller", "subClassOf", "Agent")], "s string, p string, o string")
    return graph.backward_chain(s.union(rule), p="type")


@query("""WITH L AS (SELECT 'supplier::' || s_suppkey AS s, 'n' || s_nationkey AS o FROM supplier), P AS (SELECT s, o FROM L UNION SELECT L.s, 'r' || n_regionkey FROM L JOIN nation ON L.o = 'n' || n_nationkey)
SELECT s, 'near' AS p, o FROM L UNION ALL SELECT o, 'near', s FROM L UNION ALL SELECT o, 'holds', s FROM P UNION ALL SELECT s, 'in', o FROM P
UNION ALL SELECT 'n' || n_nationkey, 'in', 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || n_regionkey, 'holds', 'n' || n_nationkey FROM nation
UNION ALL SELECT DISTINCT s, 'type', x FROM (SELECT s FROM L UNION SELECT 'n' || n_nationkey FROM nation), (SELECT unnest(['Inner', 'Thing']) AS x)
UNION ALL SELECT DISTINCT o, 'type', x FROM (SELECT o FROM P UNION SELECT 'r' || n_regionkey FROM nation), (SELECT unnest(['Outer', 'Thing']) AS x)
EXCEPT SELECT 'x', 'type', 'x'""")
def graph_forward_chain_all(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select(F.concat(F.lit("supplier::"), "s_suppkey").alias("s"), F.concat(F.lit("n"), "s_nationkey").alias("o"))
    n = load(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.concat(F.lit("r"), "n_regionkey").alias("o"))
    rules_ = [("in", "type", "TransitiveProperty"), ("near", "type", "SymmetricProperty"), ("in", "inverseOf", "holds"), ("in", "domain", "Inner"), ("in", "range", "Outer"), ("Inner", "subClassOf", "Thing"), ("Outer", "subClassOf", "Thing")]
    f = s.select("s", F.lit("in").alias("p"), "o").union(s.select("s", F.lit("near"), "o")).union(n.select("s", F.lit("in"), "o")).union(spark.createDataFrame(rules_, "s string, p string, o string"))
    return graph.forward_chain(f).where("p in ('near', 'holds', 'in') or (p = 'type' and o in ('Inner', 'Outer', 'Thing'))")


@query("SELECT DISTINCT p_type AS class_name, 1::INT AS depth FROM part UNION SELECT DISTINCT p_type || '_' || p_brand, 2 FROM part")
def expand_down(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select("p_type", "p_brand").distinct()
    links = part.select(F.concat_ws("_", "p_type", "p_brand").alias("src"), F.col("p_type").alias("dst")).union(part.select("p_type", F.lit("Part")))
    return graph.bfs(links, "Part", direction="in").withColumnRenamed("vertex", "class_name")


# ---- SPARQL --------------------------------------------------------------------------------------------------

SPARQL = {
    "sparql_star": ("SELECT ?s ?p_name ?p_size WHERE { ?s a :part ; :p_name ?p_name ; :p_size ?p_size . }", "SELECT p_partkey AS s, p_name, p_size FROM part WHERE p_name IS NOT NULL AND p_size IS NOT NULL"),
    "sparql_filter": ('SELECT ?n WHERE { ?s rdf:type :part . ?s :p_name ?n . ?s :p_size ?z . FILTER(?z > 40 || ?z < 3 && regex(?n, "a.*e")) }', "SELECT p_name AS n FROM part WHERE p_size > 40 OR (p_size < 3 AND regexp_matches(p_name, 'a.*e'))"),
    "sparql_optional": ("SELECT ?s ?n ?b WHERE { ?s a :customer . ?s :c_name ?n . OPTIONAL { ?s :c_acctbal ?b } FILTER(?b > 5000) }", "SELECT c_custkey AS s, c_name AS n, c_acctbal AS b FROM customer WHERE c_acctbal > 5000"),
    "sparql_union": ("SELECT ?n WHERE { { ?s a :customer . ?s :c_name ?n } UNION { ?t a :supplier . ?t :s_name ?n } } ORDER BY ?n LIMIT 40", "SELECT n FROM (SELECT c_name AS n FROM customer UNION ALL SELECT s_name FROM supplier) ORDER BY n LIMIT 40"),
    "sparql_exists": ("SELECT ?s WHERE { ?s a :supplier . FILTER EXISTS { ?s :s_acctbal ?x } FILTER(!bound(?s) || ?s != 3) }", "SELECT s_suppkey AS s FROM supplier WHERE s_acctbal IS NOT NULL AND s_suppkey != 3"),
    "sparql_order_limit": ("SELECT DISTINCT ?z WHERE { ?s a :part . ?s :p_size ?z } ORDER BY DESC(?z) LIMIT 10 OFFSET 5", "SELECT DISTINCT p_size AS z FROM part ORDER BY z DESC LIMIT 10 OFFSET 5"),
    "sparql_construct": ("CONSTRUCT { ?s :name ?n } WHERE { ?s a :nation . ?s :n_name ?n }", "SELECT n_nationkey::VARCHAR AS s, 'name' AS p, n_name AS o FROM nation"),
    "sparql_ask": ("ASK { ?s a :nation . ?s :n_name ?n . FILTER(?n = \"nowhere\") }", "SELECT false AS ask"),
}


def _sparql(q: str):
    return lambda spark, d: sparql.query(open_dir(spark, d), q)


for _n, (_q, _o) in SPARQL.items():
    QUERIES[_n], ORACLES[_n] = _sparql(_q), _o

# ---- time ----------------------------------------------------------------------------------------------------

_ROUND = "round(sum(value), 2) AS total"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.round("total", 2))


@query(f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, {_ROUND} FROM events GROUP BY 1, 2")
def ts_epoch_tumble(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(timeseries.tumbling(load(spark, d, "events"), ["event_type"], 3600))


@query(f"SELECT event_type, start, count(*) AS n, {_ROUND} FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2")
def ts_hop(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(timeseries.hopping(load(spark, d, "events"), ["event_type"], 3600, 1800))


@query(f"""SELECT user_id, min(ts) AS start, count(*) AS n, {_ROUND} FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def ts_session(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(timeseries.sessions(load(spark, d, "events"), ["user_id"], 6 * 3600))


@query("SELECT event_id FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type)) WHERE n >= 3 AND s >= 1e-10 AND abs(value - m) > 2 * s")
def ts_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.anomalies(load(spark, d, "events"), ["event_type"]).select("event_id")


@query("SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-04'")
def ts_range(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.between(load(spark, d, "events"), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 4)).select("event_id", "value")


@query("""WITH RECURSIVE E AS (SELECT event_type, epoch_us(ts) AS us, value FROM events), W(event_type, us) AS (SELECT event_type, min(us) FROM E GROUP BY 1
UNION ALL SELECT W.event_type, (SELECT min(us) FROM E WHERE E.event_type = W.event_type AND E.us >= W.us + 5400000000) FROM W WHERE W.us IS NOT NULL),
B AS (SELECT event_type, us AS start_us, lead(us) OVER (PARTITION BY event_type ORDER BY us) AS stop FROM W WHERE us IS NOT NULL)
SELECT B.event_type, start_us, count(*) AS n, round(sum(coalesce(value, 0)) / count(*), 6) AS mean FROM B JOIN E ON E.event_type = B.event_type AND E.us >= start_us AND (stop IS NULL OR E.us < stop) GROUP BY 1, 2""")
def ts_anchored_tumble(spark: SparkSession, d: str) -> DataFrame:
    return timeseries.anchored_tumbling(load(spark, d, "events"), ["event_type"], 5400).withColumn("mean", F.round("mean", 6))


@query()
def dtw(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").where("value is not null")
    s = e.groupBy("event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("vs"))  # beyond 100,000 readings a distance is infinite
    pairs = s.alias("a").join(s.alias("b"), F.col("a.event_type") < F.col("b.event_type")).select(F.col("a.event_type").alias("a"), F.col("b.event_type").alias("b"), F.col("a.vs").alias("x"), F.col("b.vs").alias("y"))
    return timeseries.dtw_distances(pairs.repartition("a", "b"), "x", "y", 10).select("a", "b", F.round("dtw", 6).alias("dtw"))


# ---- space ---------------------------------------------------------------------------------------------------

_PLACE = "P AS (SELECT c_custkey AS id, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 91 % 1700) / 10.0::DOUBLE - 85 AS lat FROM customer)"
_HAV = "2 * 6371000 * asin(sqrt(least(1, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({y} - {x}) / 2), 2))))"


def _hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return _HAV.format(x=lon1, a=lat1, y=lon2, b=lat2)


def _places_of(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(k.alias("id"), ((k * 37 % 3600) / 10.0 - 180).alias("lon"), ((k * 91 % 1700) / 10.0 - 85).alias("lat"))


@query(f"WITH {_PLACE} SELECT id, round({_hav('lon', 'lat', '13.4', '52.5')}, 3) AS metres FROM P")
def geo_haversine(spark: SparkSession, d: str) -> DataFrame:
    return _places_of(spark, d).select("id", F.round(geo.haversine(F.col("lon"), F.col("lat"), F.lit(13.4), F.lit(52.5)), 3).alias("metres"))


@query(f"WITH {_PLACE} SELECT id FROM P WHERE lon BETWEEN -20 AND 40 AND lat BETWEEN 30 AND 60")
def geo_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _places_of(spark, d).where(geo.in_box(F.col("lon"), F.col("lat"), -20, 30, 40, 60)).select("id")


@query(f"WITH {_PLACE} SELECT id FROM P WHERE {_hav('lon', 'lat', '13.4', '52.5')} <= 2500000")
def geo_radius(spark: SparkSession, d: str) -> DataFrame:
    return _places_of(spark, d).where(geo.haversine(F.col("lon"), F.col("lat"), F.lit(13.4), F.lit(52.5)) <= 2_500_000).select("id")


@query(f"WITH {_PLACE} SELECT id, round(m, 3) AS metres FROM (SELECT id, {_hav('lon', 'lat', '13.4', '52.5')} AS m FROM P) ORDER BY m, id LIMIT 15")
def geo_knn(spark: SparkSession, d: str) -> DataFrame:
    return movement.nearest(_places_of(spark, d), 13.4, 52.5, 15).select("id", F.round("metres", 3).alias("metres"))


RING = [(-30.0, -10.0), (50.0, 0.0), (40.0, 60.0), (0.0, 30.0), (-25.0, 55.0)]
_PIP = " + ".join(
    f"CASE WHEN (({y1} > lat) != ({y2} > lat)) AND lon < ({x2 - x1}) * (lat - ({y1})) / ({y2 - y1}) + ({x1}) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(RING, RING[1:] + RING[:1])
)


@query(f"WITH {_PLACE} SELECT id FROM P WHERE ({_PIP}) % 2 = 1")
def geo_pip(spark: SparkSession, d: str) -> DataFrame:
    return _places_of(spark, d).where(geo.in_polygon(F.col("lon"), F.col("lat"), RING)).select("id")


def _geohash_sql(length: int) -> str:
    bits = length * 5
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    letters = []
    for k in range(length):
        at = [f"((a >> {n_lon - 1 - i // 2}) & 1)" if i % 2 == 0 else f"((b >> {n_lat - 1 - i // 2}) & 1)" for i in range(k * 5, k * 5 + 5)]
        letters.append(f"substring('{geo.BASE32}', ({' + '.join(f'{x} * {1 << (4 - j)}' for j, x in enumerate(at))} + 1)::BIGINT, 1)")
    return f"WITH {_PLACE} SELECT id, {' || '.join(letters)} AS hash FROM (SELECT id, least(floor((lon + 180) / 360 * {1 << n_lon}), {(1 << n_lon) - 1})::BIGINT AS a, least(floor((lat + 90) / 180 * {1 << n_lat}), {(1 << n_lat) - 1})::BIGINT AS b FROM P)"


@query(_geohash_sql(6))
def geohash(spark: SparkSession, d: str) -> DataFrame:
    return _places_of(spark, d).select("id", geo.geohash(F.col("lon"), F.col("lat"), 6).alias("hash"))


@query(_geohash_sql(1).replace("SELECT id, ", "SELECT id FROM (SELECT id, ", 1) + ") WHERE hash = 'u'")
def geohash_prefix(spark: SparkSession, d: str) -> DataFrame:
    return geo.in_geohash(_places_of(spark, d), "u").select("id")


@query(f"WITH {_PLACE} SELECT id FROM P WHERE {_hav('lon', 'lat', '-179.5', '10.0')} <= 900000")
def geohash_radius(spark: SparkSession, d: str) -> DataFrame:
    return geo.geohash_within(_places_of(spark, d), -179.5, 10.0, 900_000).select("id")


# ---- movement rules ------------------------------------------------------------------------------------------

_EV = "V AS (SELECT event_id, user_id AS entity_id, epoch_us(ts) AS us, (user_id % 90) + (event_id * 7 % 50) / 1000.0::DOUBLE AS lon, (user_id % 40) + (event_id * 11 % 40) / 1000.0::DOUBLE AS lat FROM events)"
HOME = (20.02, 20.02, 400_000.0)
_IN_HOME = f"({_hav('lon', 'lat', str(HOME[0]), str(HOME[1]))} <= {HOME[2]})"
_BEFORE = "(PARTITION BY entity_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LAG = "M AS (SELECT *, lag(lon) OVER o AS plon, lag(lat) OVER o AS plat, lag(us) OVER o AS pus FROM V WINDOW o AS (PARTITION BY entity_id ORDER BY us, event_id))"


def _events(spark, d) -> DataFrame:
    e, i, u = load(spark, d, "events"), F.col("event_id"), F.col("user_id")
    return e.select("event_id", u.cast("string").alias("entity_id"), epoch_us("ts").alias("us"), ((u % 90) + (i * 7 % 50) / 1000.0).alias("lon"), ((u % 40) + (i * 11 % 40) / 1000.0).alias("lat"))


RULE_SQL = {
    "rule_enter": f"SELECT event_id FROM V WHERE {_IN_HOME}",
    "rule_exit": f"SELECT event_id FROM (SELECT *, max(CASE WHEN ({_hav('lon', 'lat', str(HOME[0]), str(HOME[1]))} <= 2500) THEN 1 END) OVER {_BEFORE} AS was FROM V) WHERE was = 1 AND NOT ({_hav('lon', 'lat', str(HOME[0]), str(HOME[1]))} <= 2500)",
    "rule_dwell": f"SELECT event_id FROM (SELECT *, max(CASE WHEN {_IN_HOME} THEN us END) OVER {_BEFORE} AS lst FROM V) WHERE {_IN_HOME} AND us - lst >= 3600000000",
    "rule_speed": f", {_LAG} SELECT event_id FROM M WHERE us > pus AND {_hav('plon', 'plat', 'lon', 'lat')} > 0.5 * (us - pus) / 1000000",
    "rule_stop": f", {_LAG} SELECT event_id FROM M WHERE {_hav('plon', 'plat', 'lon', 'lat')} <= 2000 AND us - pus >= 1800000000",
    "rule_recurring": f"SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY entity_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM V WHERE {_IN_HOME}) WHERE n >= 2",
    "rule_unusual": f"SELECT event_id FROM V WHERE NOT {_IN_HOME}",
    "rule_time_anomaly": f"SELECT event_id FROM V WHERE {_IN_HOME} AND (us // 3600000000 % 24) NOT IN (8, 9, 10, 11, 12, 13, 14, 15, 16, 17)",
    "rule_proximity": f"SELECT DISTINCT a.event_id FROM V a JOIN V b ON b.entity_id = 7 AND a.entity_id != 7 AND b.us <= a.us WHERE {_hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 200000",
}
RULE_CALLS = {
    "rule_enter": (movement.enter, HOME), "rule_exit": (movement.exit_, (*HOME[:2], 2500.0)), "rule_dwell": (movement.dwell, HOME, 3600), "rule_speed": (movement.speeding, 0.5), "rule_stop": (movement.stopped, 2000.0, 1800),
    "rule_recurring": (movement.recurring, HOME, 86400, 2), "rule_unusual": (movement.unusual_place, [HOME]), "rule_time_anomaly": (movement.unusual_hour, HOME, list(range(8, 18))), "rule_proximity": (movement.proximity, "7", 200_000.0),
}


def _rule(f, *args):
    return lambda spark, d: f(_events(spark, d), *args).select("event_id")


for _n, _c in RULE_CALLS.items():
    QUERIES[_n] = _rule(*_c)
    ORACLES[_n] = f"WITH {_EV} " + RULE_SQL[_n]


# ---- streams -------------------------------------------------------------------------------------------------


@query(f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, {_ROUND} FROM events GROUP BY 1, 2")
def stream_tumble_count(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.run(jobs.window_counts(jobs.source(spark, d, "events"), ["event_type"], "1 hour"))
    return _rounded(jobs.latest(out, ["event_type", "start"]))


@query("""SELECT vertex, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT 'customer::' || o_custkey AS vertex, 0 AS o, 1 AS i FROM orders UNION ALL SELECT 'order::' || o_orderkey, 1, 0 FROM orders) GROUP BY 1""")
def stream_degrees(spark: SparkSession, d: str) -> DataFrame:
    o = jobs.source(spark, d, "orders").select(F.concat(F.lit("order::"), "o_orderkey").alias("src"), F.concat(F.lit("customer::"), "o_custkey").alias("dst"))
    return jobs.latest(jobs.run(jobs.degree_stream(o)), ["vertex"])


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type != 'error'")
def cdc_apply_latest(spark: SparkSession, d: str) -> DataFrame:
    changes = jobs.source(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    state = jobs.latest(jobs.run(jobs.apply_changes(changes, ["user_id"], ["ts", "event_id"])), ["user_id"])
    return state.where("event_type != 'error'").select("user_id", "event_id", "event_type", "value")


@query(f"SELECT user_id, min(ts) AS start, count(*) AS n, {_ROUND} FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.run(jobs.session_counts(jobs.source(spark, d, "events"), ["user_id"], "6 hours"), "complete")
    return _rounded(jobs.latest(out, ["user_id", "start"])).drop("end")


@query("SELECT start, vertex, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS start, 'customer::' || o_custkey AS vertex, 0 AS o, 1 AS i FROM orders UNION ALL SELECT time_bucket(INTERVAL 7 DAY, o_orderdate, TIMESTAMP '1970-01-01'), 'order::' || o_orderkey, 1, 0 FROM orders) GROUP BY 1, 2")
def stream_window_degrees(spark: SparkSession, d: str) -> DataFrame:
    o = jobs.source(spark, d, "orders").select(F.concat(F.lit("order::"), "o_orderkey").alias("src"), F.concat(F.lit("customer::"), "o_custkey").alias("dst"), F.col("o_orderdate").alias("ts"))
    return jobs.latest(jobs.run(jobs.windowed_degrees(o, "7 days")), ["start", "vertex"])


@query("""WITH x AS (SELECT 'customer::' || o_custkey AS c, 'order::' || o_orderkey AS o FROM orders)
SELECT c AS vertex, c AS component FROM x GROUP BY 1 UNION ALL SELECT o, c FROM x""")
def stream_components(spark: SparkSession, d: str) -> DataFrame:
    o = jobs.source(spark, d, "orders").select(F.concat(F.lit("order::"), "o_orderkey").alias("src"), F.concat(F.lit("customer::"), "o_custkey").alias("dst"))
    return jobs.run_components(o)


@query()
def alerts_state(spark: SparkSession, d: str) -> DataFrame:
    e = jobs.source(spark, d, "events").select(F.col("event_type").alias("entity"), epoch_us("ts").alias("us"), F.col("value").cast("double").alias("value"))
    return jobs.run(jobs.alerts(e, 100.0, cooldown_s=600), "append").drop("batch")


# ---- value, rules, lineage -----------------------------------------------------------------------------------

AS_OF = 1_706_745_600_000_000


@query(f"SELECT user_id, round(greatest(0, least(1, 0.8 * exp(-ln(2) / (70 * 86400) * ({AS_OF} - max(epoch_us(ts))) / 1e6))), 9) AS score FROM events GROUP BY 1")
def value_decay_asof(spark: SparkSession, d: str) -> DataFrame:
    per = load(spark, d, "events").groupBy("user_id").agg(F.max(epoch_us("ts")).alias("us"))
    return per.select("user_id", F.round(scalar.current_score(F.lit(0.8), scalar.DECAY["normal"], F.col("us"), AS_OF), 9).alias("score"))


@query("""SELECT n_nationkey, round(0.5 + 0.1 + 0.1 + CASE WHEN length('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') > 50 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS score FROM nation""")
def value_assess(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation")
    return n.select("n_nationkey", F.round(scalar.assessed(n), 6).alias("score"))


DSL = """
RULE "large and cheap"
ID r1
WHEN Part.p_size >= 30 AND Part.p_retailprice < 1200
THEN Part.flag = bargain
PRIORITY 1
ENABLED true
RULE "brand"
ID r2
WHEN Part.p_brand contains 1
THEN Part.flag = ours
PRIORITY 5
ENABLED true
RULE "off"
ID r3
WHEN Part.p_size > 0
THEN Part.flag = never
ENABLED false
"""


@query("SELECT p_partkey, CASE WHEN contains(p_brand, '1') THEN 'ours' WHEN p_size >= 30 AND p_retailprice < 1200 THEN 'bargain' END AS flag, ((p_size >= 30 AND p_retailprice < 1200)::INT + contains(p_brand, '1')::INT)::BIGINT AS fired FROM part")
def rule_dsl(spark: SparkSession, d: str) -> DataFrame:
    out = rules.apply_rules(load(spark, d, "part"), rules.parse_rules(DSL))
    return out.select("p_partkey", "flag", F.size("fired").cast("long").alias("fired"))


@query("SELECT ['region::1', 'nation::' || n_nationkey, 'supplier::' || s_suppkey] AS path, 2::BIGINT AS depth, 'root' AS ended FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT ['region::1', 'nation::' || n_nationkey], 1, 'root' FROM nation WHERE n_regionkey = 1 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def lineage_upstream(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "nation").groupBy(F.concat(F.lit("region::"), "n_regionkey").alias("entity")).agg(F.collect_list(F.concat(F.lit("nation::"), "n_nationkey")).alias("parents"))
    n = load(spark, d, "supplier").groupBy(F.concat(F.lit("nation::"), "s_nationkey").alias("entity")).agg(F.collect_list(F.concat(F.lit("supplier::"), "s_suppkey")).alias("parents"))
    return rules.upstream(r.union(n), "region::1")


_EXTENSIONS = {"JPG": "image/jpeg", "png": "image/png", "Mp4": "video/mp4", "mp3": "audio/mpeg", "pdf": "application/pdf", "csv": "text/csv", "xyz": "application/octet-stream"}


@query(f"SELECT doc_id, {list(_EXTENSIONS.values())}[(doc_id % {len(_EXTENSIONS)} + 1)::BIGINT] AS kind FROM documents")
def media_types(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("doc_id") % len(_EXTENSIONS) + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", scalar.media_type(F.concat(F.lit("note-"), "doc_id", F.lit("."), ext)).alias("kind"))

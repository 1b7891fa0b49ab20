"""Operators without an SQL twin, and edge cases of the rest."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import geo
from quillon.operators import graph, movement, ontology, rules, text, timeseries, vector_search
from quillon.plans import dialect, sparql
from quillon.plans.engine import Engine
from quillon.sources import rdf, tables


def edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, label string, weight double")


def test_betweenness_and_paths(spark):
    e = edges(spark, [("a", "b", "x", 1.0), ("b", "c", "x", 1.0), ("c", "d", "y", 5.0), ("a", "d", "y", 9.0), ("d", "a", "y", None)])
    got = {r.vertex: r.centrality for r in graph.betweenness(e).collect()}
    # by hand, over (n - 1)(n - 2) = 6: b lies on a-c and d-c, c on b-d and b-a
    assert got["b"] == pytest.approx(2 / 6) and got["c"] == pytest.approx(2 / 6)
    assert {r.vertex: r.cost for r in graph.cheapest(e, "a").collect()} == {"a": 0.0, "b": 1.0, "c": 2.0, "d": 7.0}
    assert graph.shortest_path(e, "a", "a").count() == 0 and graph.shortest_path(e, "a", "c").first().path == ["a", "b", "c"]
    assert graph.bfs(e, "zzz").count() == 0
    with pytest.raises(ValueError):
        graph.cheapest(edges(spark, [("a", "b", "x", -1.0)]), "a")
    assert "a" in graph.rendered(e, "dot") and "graph TD" in graph.rendered(e, "mermaid")


def test_gcn_and_pooling(spark):
    e = edges(spark, [("a", "b", "x", 1.0)])
    f = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [2.0, -4.0])], "id string, x array<double>")
    got = {r.id: r.x for r in graph.gcn_layer(e, f, np.eye(2)).collect()}
    assert got["a"] == pytest.approx([0.5, 0.5]) and got["c"] == pytest.approx([2.0, 0.0])
    assert [r.value for r in graph.pooled(f, "max").orderBy("k").collect()] == [2.0, 1.0]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])], "id int, v array<double>")
    got = vector_search.top_k(df, "v", [1.0, 0.0], 5, "cosine").collect()
    assert [(r.id, round(r["_distance"], 6)) for r in got] == [(2, 0.0), (3, 0.292893), (1, 1.0)]
    assert df.where("id = 3").select(vector_search.packed_bits("v")).first()[0] == "c0"
    assert df.where("id = 1").select(vector_search.normalized("v")).first()[0] == [0.0, 0.0]
    assert vector_search.top_k(df.where("id = 1"), "v", [0.0, 0.0], 1, "tanimoto").first()["_distance"] == 0.0


def test_text(spark):
    row = spark.createDataFrame([("Ab_1 知識グ x",)], "t string").select(text.tokens("t")).first()[0]
    assert row == ["ab_1", "x", "知", "識", "グ", "知識", "識グ"]
    df = spark.createDataFrame([(1, "abcdef"), (2, "a"), (3, None), (4, "bcd")], "id int, t string")
    idx = text.gram_index(df, "id", "t")
    assert {r.id for r in text.indexed_search(idx, df, "id", "t", "bcd").collect()} == {1, 4}
    assert {r.id for r in text.indexed_search(idx, df, "id", "t", "a").collect()} == {1, 2}
    assert idx.where("id = 2").first().gram == "a"


def test_time(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = [("s", t0 + dt.timedelta(seconds=i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    assert [r.n for r in timeseries.anchored_tumbling(df, ["k"], 3).orderBy("start_us").collect()] == [3, 3, 3, 1]
    assert timeseries.dtw(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3])) == 0.0 and timeseries.dtw(np.array([]), np.array([1.0])) == float("inf")
    assert timeseries.nearest_rank_percentile(df, ["k"], "value", 90).first().value == 8.0
    assert timeseries.anomalies(df.limit(2), ["k"]).count() == 0


def test_geometry(spark):
    a, b = geo.from_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), geo.from_wkt("POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))")
    far, side = geo.from_wkt("POINT (9 9)"), geo.from_wkt("POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))")
    assert [geo.relate(a, x) for x in (a, b, far, side)] == ["equals", "contains", "disjoint", "touches"] and geo.relate(b, a) == "within"
    for s in (a, far, geo.from_wkt("LINESTRING (0 0, 1.5 2)"), geo.from_wkt("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))")):
        assert geo.from_wkb(geo.to_wkb(s)) == s and geo.from_wkt(geo.to_wkt(s)) == s
    assert geo.centroid(a) == pytest.approx((2, 2)) and geo.bbox(a) == (0, 0, 4, 4)
    assert geo.geohash_text(-5.6, 42.6, 5) == "ezs42"
    assert spark.range(1).select(geo.geohash(F.lit(-5.6), F.lit(42.6), 5)).first()[0] == "ezs42"
    assert len(geo.geohash_neighbours("ezs42")) == 8


def test_movement_turn_and_dwell(spark):
    ev = spark.createDataFrame([(i, "e", 0.0, i * 0.01, i * 60_000_000) for i in range(5)], "event_id int, entity_id string, lon double, lat double, us long")
    assert movement.turned(ev, 0, 10).count() == 4 and movement.turned(ev, 80, 100).count() == 0
    assert [r.event_id for r in movement.dwell(ev, (0.0, 0.0, 5000.0), 120, true_dwell=True).orderBy("event_id").collect()] == [2, 3, 4]


def test_reasoning(spark):
    o = ontology.Ontology().add_class("Person", ["Thing"]).add_class("Employee", ["Person"]).add_class("Manager", ["Employee"]).add_class("Worker", equivalents=["Employee"])
    assert o.subclasses("Person") == {"Person", "Employee", "Manager", "Worker"} and o.is_subclass("Manager", "Thing") and not o.is_subclass("Thing", "Manager")
    f = spark.createDataFrame([("m", ontology.TYPE, "Manager"), ("w", ontology.TYPE, "Worker")], "s string, p string, o string")
    got = {(r.s, r.o): (r.rule, r.round) for r in ontology.inferred(f, o).collect()}
    assert got["m", "Thing"] == ("cax-sco", 1) and got["w", "Employee"] == ("cax-eqc", 1) and got["w", "Thing"] == ("cax-sco", 2) and got["m", "Manager"] == (None, 0)
    assert ontology.explained(ontology.inferred(f, o), "w", ontology.TYPE, "Thing").first().status == "inferred"
    o.add_property("name", required=True, domain="Person")
    assert o.violations("Manager", spark.createDataFrame([(None,), ("x",)], "name string")).count() == 1
    loop = ontology.Ontology().add_class("a", ["b"]).add_class("b", ["a"])
    assert loop.subclasses("a") == {"a", "b"} and loop.problems()


def test_rules_and_lineage(spark):
    r = rules.parse_rules('RULE "x"\nID a\nWHEN T.v > 5 AND T.s contains ab\nTHEN T.flag = hot\nPRIORITY 2\nENABLED true\n')
    df = spark.createDataFrame([(9, "cab"), (9, None), (None, "ab")], "v int, s string")
    assert [x.flag for x in rules.apply_rules(df, r).collect()] == ["hot", None, None]
    rec = spark.createDataFrame([("a", ["b", "c"]), ("b", ["a", "d"]), ("c", None)], "entity string, parents array<string>")
    got = {(tuple(x.path), x.ended) for x in rules.upstream(rec, "a").collect()}
    assert got == {(("a", "b"), "loop"), (("a", "b", "d"), "root"), (("a", "c"), "root")}


def test_statements(spark):
    e = Engine(spark)
    e.register("items", spark.createDataFrame([("a", 1), ("b", 2)], "name string, price int"))
    assert [s for s, _ in dialect.run_batch(e, "INSERT INTO items (name, price) VALUES ('x;y', 3); SELECT * FROM items")] == ["INSERT INTO items (name, price) VALUES ('x;y', 3)", "SELECT * FROM items"]
    assert e.table("items").count() == 3 and e.sql("SELECT sum(price) AS s FROM items").first().s == 6
    e.sql("TRUNCATE TABLE items")
    assert e.table("items").count() == 0 and "plan" in e.sql("EXPLAIN ANALYZE SELECT * FROM items").columns
    for bad in ("BEGIN", "VECTOR SEARCH ON items (v) QUERY [1] TOP 1", "DROP VECTOR INDEX nope"):
        with pytest.raises((ValueError, KeyError)):
            e.sql(bad)
    out = dialect.run_batch(e, "BEGIN; SHOW CLASSES", fail_fast=False)
    assert isinstance(out[0][1], ValueError) and out[1][1].count() == 1
    for text_ in ("", "SELECT (", "'"):
        with pytest.raises(Exception):
            e.sql(text_).count()


def test_sparql_text(spark):
    e = Engine(spark)
    e.register("P", spark.createDataFrame([(1, "Ann", 5), (2, "bob", None), (3, None, 7)], "id int, name string, age int"))
    q = lambda t: [tuple(r) for r in sparql.query(e, t).collect()]
    assert q("PREFIX x: <http://e/> SELECT ?n WHERE { ?s a x:P ; x:name ?n . OPTIONAL { ?s x:age ?a } FILTER(regex(?n, \"^a\", \"i\")) }") == [("Ann",)]
    assert q("SELECT ?s WHERE { ?s a :P . FILTER NOT EXISTS { ?s :age ?x } }") == [(2,)]
    assert '"bindings"' in sparql.w3c_json(sparql.query(e, "SELECT * WHERE { ?s a :P . ?s :name ?n }"))


def test_changes_and_pages(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "k int, v string")
    up = tables.upsert(df, spark.createDataFrame([(2, "b"), (None, "m"), (3, "c")], "k int, v string"), ["k"])
    assert sorted(map(str, map(tuple, up.collect()))) == sorted(map(str, [(1, "a"), (2, "b"), (None, "m"), (3, "c")]))
    assert tables.delete(df, F.col("v") == "a").count() == 2 and tables.delete(df).count() == 0
    assert [r.k for r in tables.page(spark.range(9).withColumnRenamed("id", "k"), ["k"], 3, (4,)).collect()] == [5, 6, 7]


def test_rdf(spark, tmp_path):
    t = rdf.parse_turtle('@prefix x: <http://e/> .\nx:a a x:C ; x:p "v 1" , <http://e/b> .\n')
    assert t == [("http://e/a", "rdf:type", "http://e/C"), ("http://e/a", "http://e/p", "v 1"), ("http://e/a", "http://e/p", "http://e/b")]
    df = spark.createDataFrame([("http://e/a", "http://e/p", 'say "x"\nand \\'), ("http://e/a", "http://e/q", "http://e/b")], "s string, p string, o string")
    rdf.write_ntriples(df, str(tmp_path / "nt"))
    assert sorted(map(tuple, rdf.read_ntriples(spark, str(tmp_path / "nt")).collect())) == sorted(map(tuple, df.collect()))
    rdf.write_jsonld(df, str(tmp_path / "ld"))
    assert spark.read.json(str(tmp_path / "ld")).first()["@id"] == "http://e/a"

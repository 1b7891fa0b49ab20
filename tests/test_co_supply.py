"""The graph queries over the links of all order lines, against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import graph
from quillon.queries.multimodal import GCN, QUERIES

N = 7


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    r, d = random.Random(5), str(tmp_path_factory.mktemp("co"))
    rows = [(o, r.randrange(N - 2), float(r.randrange(1, 51))) for o in range(6) for _ in range(3)] + [(99, N - 2, 1.0), (99, N - 1, 2.0), (100, 0, 50.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(i, 100.0 * i) for i in range(N)], "s_suppkey long, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    links = {(a, b) for o, a, _ in rows for p, b, _ in rows if o == p and a < b}
    return d, {(f"supplier::{a}", f"supplier::{b}") for a, b in links}


def both(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def test_components_and_clustering(spark, lines):
    d, links = lines
    near, comp = both(links), {}
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            todo += [w for w in near[todo.pop()] if w not in seen and not seen.add(w)]
        comp[v] = min(seen)
    assert {r.vertex: r.component for r in QUERIES["components"](spark, d).collect()} == comp and len(set(comp.values())) == 2
    share = {v: sum(b in near[a] for a, b in itertools.combinations(ns, 2)) / (len(ns) * (len(ns) - 1) / 2) for v, ns in near.items() if len(ns) > 1}
    assert {r.vertex: r.coefficient for r in QUERIES["clustering"](spark, d).collect()} == pytest.approx(share, abs=1e-6)


def test_matches(spark, lines):
    d, links = lines
    want = sorted((a, b, c) for a, b in links for x, c in links if b == x)
    assert sorted((r.a, r.b, r.c) for r in QUERIES["match_injective"](spark, d).collect()) == want


def test_betweenness(spark, lines):
    d, links = lines
    names = sorted(both(links))
    out = {v: sorted(b for a, b in links if a == v) for v in names}
    want = dict.fromkeys(names, 0.0)
    for s, t in itertools.permutations(names, 2):
        ways, found = [[s]], []
        while ways and not found:
            ways = [[*w, x] for w in ways for x in out[w[-1]]]
            found = [w for w in ways if w[-1] == t]
        for w in found:
            for v in w[1:-1]:
                want[v] += 1 / len(found) / ((len(names) - 1) * (len(names) - 2))
    assert {r.vertex: r.centrality for r in QUERIES["betweenness"](spark, d).collect()} == pytest.approx(want)


def test_gcn(spark, lines):
    d, links = lines
    a = np.eye(N)
    for x, y in links:
        i, j = int(x[10:]), int(y[10:])
        a[i, j] = a[j, i] = 1
    n = 1 / np.sqrt(a.sum(1))
    x = np.column_stack([np.arange(N) / 100, np.ones(N)])
    want = np.maximum(0, (n[:, None] * a * n) @ x @ np.array(GCN))
    for r in QUERIES["gcn"](spark, d).collect():
        assert [r.x0, r.x1] == pytest.approx(list(want[int(r.id[10:])]), abs=1e-6)


def written(spark):
    """Bytes that all shuffles of the session wrote so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    known = sc.statusStore().executorList(False)
    return sum(known.apply(i).totalShuffleWrite() for i in range(known.size()))


@pytest.mark.parametrize("group_rows", [2_000_000, 40])
def test_clustering_in_groups(spark, group_rows):
    r = random.Random(3)
    links = {(a, b) for a, b in itertools.product(range(150), repeat=2) if r.random() < (0.9 if max(a, b) < 40 else 0.03)} | {(0, x) for x in range(150)}  # dense, sparse, a hub, loops
    near = both({(f"n{a}", f"n{b}") for a, b in links if a != b})
    share = {v: (len(ns), sum(b in near[a] for a, b in itertools.combinations(ns, 2)) / (len(ns) * (len(ns) - 1) / 2)) for v, ns in near.items() if len(ns) > 1}
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in [*links, *links]], "src string, dst string")
    got = {x.vertex: (x.neighbours, x.coefficient) for x in graph.clustering(e, group_rows=group_rows).collect()}
    assert {v: n for v, (n, _) in got.items()} == {v: n for v, (n, _) in share.items()}
    assert {v: c for v, (_, c) in got.items()} == pytest.approx({v: c for v, (_, c) in share.items()})


def test_clustering_writes_no_triangles(spark):
    ids = spark.range(300)
    e = ids.alias("a").join(ids.alias("b"), F.col("a.id") < F.col("b.id")).select(F.concat(F.lit("n"), "a.id").alias("src"), F.concat(F.lit("n"), "b.id").alias("dst"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more links than can be broadcast
    try:
        before = written(spark)
        assert {(r.neighbours, r.coefficient) for r in graph.clustering(e).collect()} == {(299, 1.0)}
        assert written(spark) - before < 5_000_000  # 4.5 million triangles take more
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def brandes(links, names):
    out, want = {v: sorted({b for a, b in links if a == v}) for v in names}, dict.fromkeys(names, 0.0)
    for s in names:
        level, paths, queue, part = {s: 0}, {s: 1}, [s], dict.fromkeys(names, 0.0)
        for v in queue:
            for w in out[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0
                    queue.append(w)
                paths[w] += paths[v] * (level[w] == level[v] + 1)
        for v in reversed(queue):
            part[v] = sum(paths[v] / paths[w] * (1 + part[w]) for w in out[v] if level[w] == level[v] + 1)
            want[v] += part[v] * (v != s)
    return {v: c / ((len(names) - 1) * (len(names) - 2)) for v, c in want.items()}


def test_betweenness_dense_and_deep(spark):
    r = random.Random(8)
    dense = {(f"d{a}", f"d{b}") for a, b in itertools.product(range(60), repeat=2) if r.random() < 0.5}  # loops too
    deep = {(f"p{i}", f"p{i + k}") for i in range(120) for k in (1, 3)} | {(f"p{120 + 3}", "p5"), ("d3", "p0"), ("x", "x")}
    links = sorted(dense | deep)
    e = spark.createDataFrame([*links, *links], "src string, dst string")
    assert {x.vertex: x.centrality for x in graph.betweenness(e).collect()} == pytest.approx(brandes(links, sorted({v for x in links for v in x})))


@pytest.mark.parametrize("most", [1, 7])
def test_dependencies_either_way(most):
    r = random.Random(9)
    n = 50
    links = [(a, b) for a, b in itertools.product(range(n), repeat=2) if r.random() < 0.08]
    near = [sorted(b for a, b in links if a == v) for v in range(n)]
    count = np.array([len(x) for x in near])
    to, start, total, each = np.array(sum(near, []), np.int32), np.cumsum(count) - count, np.zeros(n), []
    for sources, reach, part in graph._blocks(np.arange(n), to, start, count, most):
        m = np.zeros((len(reach), len(reach)))
        m[np.repeat(np.arange(len(reach)), part[2]), part[0]] = 1
        assert graph._sparse(sources, *part) == pytest.approx(graph._dense(sources, m))
        total[reach] += graph._sparse(sources, *part)
        each += reach[sources].tolist()
    assert sorted(each) == np.flatnonzero(count).tolist()
    want = brandes(links, range(n))
    assert total / ((n - 1) * (n - 2)) == pytest.approx([want[v] for v in range(n)])


def test_betweenness_over_two_million_edges(spark):
    many = spark.range(1500).select(F.concat(F.lit("a"), "id").alias("src"))
    e = many.crossJoin(spark.range(1500).select(F.concat(F.lit("b"), "id").alias("dst"))).union(many.select("src", F.lit("m"))).union(spark.createDataFrame([("m", "t")], "src string, dst string"))
    got = {r.vertex: r.centrality for r in graph.betweenness(e).where("centrality != 0").collect()}
    assert got == pytest.approx({"m": 1500 / (3001 * 3000)})

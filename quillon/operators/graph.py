"""Property graph operators over edges (src, dst, label, weight) and vertices (id, labels, ...).

Relation tables with source and target columns are taken as edges without copying. Traversals are loops of
frontier joins: each round joins the frontier with the edges and drops what was visited, and its result is cut
off by a checkpoint. Only betweenness needs the whole graph in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import cut


def as_edges(df: DataFrame) -> DataFrame:
    """(src, dst, label, weight) from a table with src/dst or source/target; label may be missing, weight defaults to 1."""
    c = df.columns
    src, dst = ("src", "dst") if "src" in c else ("source", "target")
    label = next((x for x in ("label", "link_label") if x in c), None)
    return df.select(
        F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
        (F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in c else F.lit(1.0)).alias("weight"),
    ).where("src is not null and dst is not null")


def steps(edges: DataFrame, direction: str = "out", label: str | None = None) -> DataFrame:
    """(a, b): the moves that a traversal may make."""
    e = as_edges(edges)
    e = e if label is None else e.where(F.col("label") == label)
    out, in_ = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": out, "in": in_, "both": out.union(in_)}[direction]


def neighbours(edges: DataFrame, vertex: str, direction: str = "out", label: str | None = None) -> DataFrame:
    return steps(edges, direction, label).where(F.col("a") == vertex).select(F.col("b").alias("vertex")).distinct()


def bfs(edges: DataFrame, start: str, *, depth: int = 3, direction: str = "out", label: str | None = None, where: str | None = None, vertices: DataFrame | None = None, prune: bool = True) -> DataFrame:
    """(vertex, depth): vertices reached within `depth` steps, each once at its smallest depth, the start left out.

    `where` is a condition on `vertices` (id, ...), or on the column id alone. With prune a vertex that fails it
    is neither returned nor passed through; without, it is only not returned.
    """
    spark, move = edges.sparkSession, steps(edges, direction, label)
    ok = None if where is None else (vertices if vertices is not None else move.select(F.col("b").alias("id")).distinct()).where(where).select(F.col("id").alias("b"))
    seen = spark.createDataFrame([(start, 0)], "vertex string, depth int")
    front = seen
    for d in range(1, depth + 1):
        nxt = move.join(front.select(F.col("vertex").alias("a")), "a", "left_semi").select(F.col("b").alias("vertex")).distinct()
        if ok is not None and prune:  # only what the frontier reaches is held against the condition
            nxt = nxt.join(ok.withColumnRenamed("b", "vertex"), "vertex", "left_semi") if vertices is not None else nxt.withColumnRenamed("vertex", "id").where(where).withColumnRenamed("id", "vertex")
        front = cut(nxt.join(seen, "vertex", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    out = seen.where("depth > 0")
    if ok is not None and not prune:
        out = out.join(ok.withColumnRenamed("b", "vertex"), "vertex", "left_semi")
    return out


def bfs_paths(edges: DataFrame, start: str, *, depth: int = 3, direction: str = "out", label: str | None = None) -> DataFrame:
    """(vertex, depth, path): vertices reached within `depth` steps with one shortest path each, the smallest in string order."""
    move, spark = steps(edges, direction, label), edges.sparkSession
    front = spark.createDataFrame([(start, [start])], "vertex string, path array<string>")
    parts = [front]
    for _ in range(depth):
        nxt = move.join(front.withColumnRenamed("vertex", "a"), "a").select(F.col("b").alias("vertex"), F.concat("path", F.array("b")).alias("path"))
        seen = reduce(DataFrame.union, [p.select("vertex") for p in parts])
        front = cut(nxt.groupBy("vertex").agg(F.min("path").alias("path")).join(seen, "vertex", "left_anti"))
        if front.isEmpty():
            break
        parts.append(front)
    return reduce(DataFrame.union, parts).where(F.size("path") > 1).select("vertex", (F.size("path") - 1).alias("depth"), "path")


def dfs(edges: DataFrame, start: str, *, depth: int = 3, direction: str = "out", label: str | None = None) -> DataFrame:
    """The vertices of bfs_paths in depth-first order: sorted by path, so that a vertex stands before all that lies behind it."""
    return bfs_paths(edges, start, depth=depth, direction=direction, label=label).orderBy("path")


def shortest_path(edges: DataFrame, a: str, b: str, *, max_depth: int = 10, direction: str = "out", same: bool = False) -> DataFrame:
    """(path, length): one shortest path from a to b, the smallest in string order; no row without one. Where a is b there
    is no row either, or with `same` the path of length 0."""
    if a == b and same:
        return edges.sparkSession.createDataFrame([([a], 0)], "path array<string>, length long")
    found = bfs_paths_to(edges, a, b, max_depth if a != b else 0, direction)
    return found.select("path", (F.size("path") - 1).cast("long").alias("length"))


def bfs_paths_to(edges: DataFrame, a: str, b: str, max_depth: int, direction: str) -> DataFrame:
    """The path of bfs_paths to one vertex; the search ends once it is met."""
    move, spark = steps(edges, direction), edges.sparkSession
    front = spark.createDataFrame([(a, [a])], "v string, path array<string>")
    seen = front.select("v")
    for _ in range(max_depth):
        nxt = move.join(front.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), F.concat("path", F.array("b")).alias("path"))
        front = cut(nxt.groupBy("v").agg(F.min("path").alias("path")).join(seen, "v", "left_anti"))
        hit = front.where(F.col("v") == b)
        if not hit.isEmpty():
            return hit.select("path")
        if front.isEmpty():
            break
        seen = seen.union(front.select("v"))
    return front.where("false").select("path")


def trace(starts: DataFrame, hops: list[tuple[DataFrame, str]], *, limit: int = 100) -> DataFrame:
    """(path): ordered hops from the vertices of `starts` (vertex) over relation tables, each "out" or "in".

    Each vertex of a path goes on to at most `limit` (5,000 at most) next ones per hop, the smallest in string order.
    """
    out = starts.select(F.col("vertex").cast("string").alias("at")).distinct().select("at", F.array("at").alias("path"))
    for relation, direction in hops:
        place = F.row_number().over(Window.partitionBy("a").orderBy("b"))
        move = steps(relation, direction).join(out.select(F.col("at").alias("a")).distinct(), "a", "left_semi").distinct().withColumn("i", place).where(F.col("i") <= min(limit, 5000))
        out = out.join(move, F.col("at") == F.col("a")).select(F.col("b").alias("at"), F.concat("path", F.array("b")).alias("path"))
    return out.select("path")


def around(edges: DataFrame, start: str, *, depth: int = 2, nodes: int = 200) -> DataFrame:
    """Edges between the vertices within `depth` (5 at most) steps either way of a vertex; of more than `nodes` vertices the nearest, then smallest."""
    near = bfs(edges, start, depth=min(depth, 5), direction="both").orderBy("depth", "vertex").limit(nodes - 1).select("vertex")
    near = cut(near.union(edges.sparkSession.createDataFrame([(start,)], "vertex string")))
    return as_edges(edges).join(near.withColumnRenamed("vertex", "src"), "src", "left_semi").join(near.withColumnRenamed("vertex", "dst"), "dst", "left_semi").select("src", "dst", "label", "weight")


def cheapest(edges: DataFrame, start: str, *, max_rounds: int = 1000) -> DataFrame:
    """(vertex, cost): least sum of weights over out-edges; negative weights raise, unreachable vertices have no row.

    Rounds relax only the edges of vertices whose cost fell in the round before.
    """
    e = as_edges(edges).groupBy("src", "dst").agg(F.min("weight").alias("w"))
    if not e.where("w < 0").isEmpty():
        raise ValueError("negative weights")
    best = edges.sparkSession.createDataFrame([(start, 0.0)], "vertex string, cost double")
    changed = best
    for _ in range(max_rounds):
        offer = e.join(changed.withColumnRenamed("vertex", "src"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.min(F.col("cost") + F.col("w")).alias("offer"))
        merged = cut(best.join(offer, "vertex", "full").select("vertex", F.least("cost", "offer").alias("now"), (F.coalesce(F.col("offer") < F.col("cost"), F.col("cost").isNull())).alias("fell")))
        best, changed = merged.select("vertex", F.col("now").alias("cost")), merged.where("fell").select("vertex", F.col("now").alias("cost"))
        if changed.isEmpty():
            break
    return best


def pagerank(edges: DataFrame, *, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(vertex, rank): ranks that add up to 1; the rank of vertices without out-edges is spread over all."""
    e = as_edges(edges).select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    e = cut(e.join(out, "src"))
    v = cut(e.select(F.col("src").alias("vertex")).union(e.select("dst")).distinct().join(out.select(F.col("src").alias("vertex"), "n"), "vertex", "left"))
    total = v.count()
    rank = v.select("vertex", "n", F.lit(1.0 / max(1, total)).alias("rank"))
    for _ in range(iterations):
        flow = e.join(rank.select(F.col("vertex").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("vertex")).agg(F.sum(F.col("rank") / F.col("n")).alias("in"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        new = rank.join(flow, "vertex", "left").crossJoin(F.broadcast(lost)).select(  # one row
            "vertex", "n", ((1 - damping) / total + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / total)).alias("rank"), F.col("rank").alias("old"))
        new = cut(new)  # referred to three times in the next round
        rank = new.drop("old")
        if tolerance and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
            break
    return rank.select("vertex", "rank")


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component): undirected components, named by their smallest vertex.

    Every round takes the smallest label among neighbours and then that label's own label, so labels jump along
    paths and the number of rounds grows with the logarithm of the diameter.
    """
    e = steps(edges, "both").distinct()
    e = cut(e.union(e.select("a", F.col("a").alias("b"))).distinct())
    lab = cut(e.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("component")))
    while True:
        near = e.join(lab.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("m"))
        jump = near.join(lab.select(F.col("vertex").alias("m"), F.col("component").alias("mm")), "m").select("vertex", F.least("m", "mm").alias("c"))
        nxt = cut(jump.join(lab, "vertex").select("vertex", F.col("c").alias("component"), (F.col("c") != F.col("component")).alias("moved")))
        lab = nxt.select("vertex", "component")
        if nxt.where("moved").isEmpty():
            return lab


def degrees(edges: DataFrame) -> DataFrame:
    """(vertex, out_degree, in_degree, degree)."""
    e = as_edges(edges)
    ends = e.select(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("vertex").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    """(degree, vertices): histogram of in- plus out-degrees."""
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("vertices"))


def degree_statistics(edges: DataFrame) -> DataFrame:
    """(low, high, mean, median) of the vertices' degrees."""
    return degrees(edges).agg(F.min("degree").alias("low"), F.max("degree").alias("high"), F.avg("degree").alias("mean"), F.median("degree").alias("median"))


def mean_clustering(edges: DataFrame) -> DataFrame:
    """(vertices, mean): the mean local coefficient over vertices with two or more neighbours."""
    return clustering(edges).agg(F.count(F.lit(1)).alias("vertices"), F.avg("coefficient").alias("mean"))


def numbered(edges: DataFrame, *, few: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(id, vertex), numbered from 0 in the order of the names, and the edges as numbers (a, b), repeats kept.

    Up to `few` vertices are broadcast; with more, the edges are shuffled by both ends.
    """
    e = as_edges(edges).select("src", "dst")
    names = e.select(F.col("src").alias("vertex")).union(e.select("dst")).distinct().orderBy("vertex")
    ids = cut(names.select(F.monotonically_increasing_id().alias("k"), "vertex"))  # such a number is the partition's and the row's in it
    sizes = {r.part: r["count"] for r in ids.groupBy(F.shiftright("k", 33).alias("part")).count().collect()}
    before = np.cumsum([0, *(sizes.get(i, 0) for i in range(max(sizes, default=0)))])
    start = F.element_at(F.array(*(F.lit(int(x)) for x in before)), (F.shiftright("k", 33) + 1).cast("int"))
    ids = ids.select((start + F.col("k").bitwiseAND((1 << 33) - 1)).cast("long").alias("id"), "vertex")
    a, b = ids.select(F.col("id").alias("a"), F.col("vertex").alias("src")), ids.select(F.col("id").alias("b"), F.col("vertex").alias("dst"))
    if before[-1] + sizes.get(len(before) - 1, 0) <= few:
        a, b = F.broadcast(a), F.broadcast(b)
    return ids, e.join(a, "src").join(b, "dst").select("a", "b")


def clustering(edges: DataFrame, *, group_rows: int = 2_000_000) -> DataFrame:
    """(vertex, neighbours, coefficient): share of a vertex's neighbour pairs that are linked, for two or more neighbours.

    Links count once whatever their direction. A vertex's neighbours are kept as words of 64 bits; words are dealt to k
    colours, and a task has the links between three of them, so every triangle is counted in one task and none is written.
    A task holds `group_rows` words or so, each word is sent to k tasks; k grows with the square root of all words.
    """
    ids, e = numbered(edges)
    both = e.where("a != b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").repartition("a")  # else words of one bit are sent
    words = cut(both.groupBy("a", F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("mask")))
    rows = words.count()
    k = max(1, int(np.ceil(np.sqrt(6 * rows / group_rows))), min(6, int(np.ceil(np.sqrt(6 * rows / 50_000)))))
    colour = lambda w: F.pmod(F.hash(w), F.lit(k))
    dealt = words.select("*", colour(F.shiftright("a", 6)).alias("p"), colour(F.col("w")).alias("q"))
    three = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda r: F.sort_array(F.array("p", "q", r)))).alias("x")
    groups, cores = k * (k + 1) * (k + 2) // 6, words.sparkSession.sparkContext.defaultParallelism
    packed = dealt.select("a", "w", "mask", "p", "q", three).selectExpr("a", "w", "mask", "shiftleft(bigint(p), 20) | q AS pq", "shiftleft(bigint(x[0]), 40) | shiftleft(bigint(x[1]), 20) | x[2] AS three")
    found = packed.repartition(max(1, min(groups, max(8 * cores, groups // 8))), "three").groupBy("three").applyInPandas(_triangles, "a long, t long")
    deg = words.groupBy("a").agg(F.sum(F.bit_count("mask").cast("long")).alias("n")).where("n >= 2")
    per = deg.join(found.groupBy("a").agg(F.sum("t").alias("t")), "a", "left").withColumnRenamed("a", "id").join(ids, "id")
    return per.select("vertex", F.col("n").alias("neighbours"), (2 * F.coalesce("t", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).alias("coefficient"))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... as many as count[0], then those of start[1], and so on."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def _pieces(count: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of entries that count up to some `most` together."""
    ends = np.cumsum(count)
    at = 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def _triangles(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
    """(a, t): triangles at each vertex with corners of the key's three colours. d: a vertex's neighbours by word (a, w, mask), colours p of a and q of w in 20 bits each."""
    a, w, pq = (d[c].to_numpy() for c in ("a", "w", "pq"))
    p, q = pq >> 20, pq & 0xFFFFF
    mask, (vertex, code), (word, place) = d["mask"].to_numpy().astype("<u8"), np.unique(a, return_inverse=True), np.unique(w, return_inverse=True)
    order = np.lexsort((place, code))
    w, mask, p, q, code, place = (x[order] for x in (w, mask, p, q, code, place))
    three, total = [int(key[0]) >> s & 0xFFFFF for s in (40, 20, 0)], np.zeros(len(vertex), np.int64)
    for x in set(three):  # the corner that is counted for, and the colours of the other two
        y, z = [c for i, c in enumerate(three) if i != three.index(x)]
        near = q == z
        keys, bits, owner = code[near] * len(word) + place[near], mask[near], code[near]
        start, count = np.searchsorted(owner, np.arange(len(vertex))), np.bincount(owner, minlength=len(vertex))
        places, sums, base = place[near], np.zeros(len(vertex)), np.flatnonzero((p == x) & (q == y))
        for at in range(0, len(base), 8192):
            rows = base[at : at + 8192]
            row, bit = np.nonzero(np.unpackbits(mask[rows].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            u, v = code[rows[row]], w[rows[row]] * 64 + bit
            other = np.minimum(np.searchsorted(vertex, v), len(vertex) - 1)
            known = (vertex[other] == v) & (count[u] > 0) & (count[other] > 0)
            u, v = u[known], other[known]
            few, many = np.where(count[u] <= count[v], (u, v), (v, u))  # the words of the one that has fewer are looked up
            for s in _pieces(count[few], 1_000_000):
                n = count[few[s]]
                i = _ranges(start[few[s]], n)
                want = np.repeat(many[s] * len(word), n) + places[i]
                j = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                shared = np.where(keys[j] == want, np.bitwise_count(bits[i] & bits[j]), 0)
                sums += np.bincount(u[s], np.add.reduceat(shared, np.cumsum(n) - n, dtype=np.int64), len(vertex))
        total += sums.astype(np.int64) // (2 if y == z else 1)
    k = np.flatnonzero(total)
    return pd.DataFrame({"a": vertex[k], "t": total[k]})


def betweenness(edges: DataFrame, *, max_edges: int | None = None) -> DataFrame:
    """(vertex, centrality): Brandes over out-edges, scaled by 1 / ((n - 1)(n - 2)).

    Sources are spread over the cluster, several at a time; each task holds the whole graph, 4 bytes an edge and 20 a vertex.
    More than `max_edges` edges raise, if given.
    """
    ids, e = numbered(edges)
    n, spark = ids.count(), edges.sparkSession
    if n == 0:
        return ids.select("vertex", F.lit(0.0).alias("centrality"))
    lists = e.groupBy("a").agg(F.collect_set(F.col("b").cast("int")).alias("to")).toArrow()
    to = np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in lists["to"].chunks] or [np.zeros(0, np.int32)])
    if max_edges is not None and len(to) > max_edges:
        raise ValueError(f"betweenness was given a limit of {max_edges} edges; the graph has {len(to)}")
    a, many = lists["a"].to_numpy(), pc.list_value_length(lists["to"]).to_numpy()
    start, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start[a], count[a] = np.cumsum(many) - many, many
    shared = spark.sparkContext.broadcast((to, start, count))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        todo = np.concatenate([d["id"].to_numpy() for d in parts] or [np.zeros(0, np.int64)])
        total = np.zeros(n)
        for sources, reach, links in _blocks(todo, *shared.value):
            total[reach] += _dependencies(sources, *links)
        k = np.flatnonzero(total)
        yield pd.DataFrame({"id": k, "c": total[k]})

    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    got = spark.range(0, n, 1, max(1, min(256, n // 64 + 1))).mapInPandas(run, "id long, c double").groupBy("id").agg((F.sum("c") * scale).alias("centrality"))
    return ids.join(got, "id", "left").select("vertex", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


def _blocks(todo: np.ndarray, to: np.ndarray, start: np.ndarray, count: np.ndarray, most: int = 256) -> Iterator[tuple]:
    """(sources, reach, links): sources that share what they reach, the vertices that they reach, and the links among these.

    Sources and links are given by the places in `reach`; links are (to, start, count) as those of the whole graph.
    """
    def reached(v: np.ndarray) -> np.ndarray:
        seen[v] = True
        parts = [v]
        while len(v):
            fresh = []
            for s in _pieces(count[v], 2_000_000):
                t = to[_ranges(start[v[s]], count[v[s]])]
                t = np.unique(t[~seen[t]])
                seen[t] = True
                fresh.append(t)
            parts.append(v := np.concatenate(fresh))
        return np.concatenate(parts)

    seen, place = np.zeros(len(start), bool), np.zeros(len(start), np.int64)
    todo = todo[count[todo] > 0]
    while len(todo):
        reach = reached(todo[:1])
        near = seen[todo] | seen[to[start[todo]]]
        seen[reach] = False
        sources = todo[near][:most]
        todo = np.concatenate([todo[near][most:], todo[~near]])
        reach = np.sort(reached(sources))
        seen[reach], place[reach] = False, np.arange(len(reach))
        c = count[reach]
        local = np.empty(c.sum(), np.int32)
        ends = np.cumsum(c)
        for s in _pieces(c, 2_000_000):
            local[(ends[s.start] - c[s.start]) : ends[s.stop - 1]] = place[to[_ranges(start[reach[s]], c[s])]]
        yield place[sources], reach, (local, ends - c, c)


def _dependencies(sources: np.ndarray, to: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Brandes' dependencies of all sources on each vertex, added up."""
    n, total = len(start), np.zeros(len(start))
    if n <= 4096 and len(to) * 32 >= n * n:  # many links between few vertices
        links = np.zeros((n, n))
        links[np.repeat(np.arange(n), count), to] = 1
        return _dense(sources, links)
    for at in range(0, len(sources), step := max(1, 4_000_000 // n)):
        total += _sparse(sources[at : at + step], to, start, count)
    return total


def _dense(sources: np.ndarray, links: np.ndarray) -> np.ndarray:
    level, paths, part = np.full((len(sources), len(links)), -1), np.zeros((len(sources), len(links))), np.zeros((len(sources), len(links)))
    mine = np.arange(len(sources)), sources
    level[mine], paths[mine], k = 0, 1.0, 0
    while len(at := np.flatnonzero((level == k).any(0))):
        more = np.where(level[:, at] == k, paths[:, at], 0) @ links[at]
        more[level >= 0] = 0
        paths += more
        k += 1
        level[more > 0] = k
    for k in range(k - 1, 0, -1):
        at = np.flatnonzero((level == k).any(0))
        share = np.divide(1 + part[:, at], paths[:, at], out=np.zeros((len(sources), len(at))), where=level[:, at] == k)
        part += np.where(level == k - 1, paths * (share @ links[:, at].T), 0)
    part[mine] = 0
    return part.sum(0)


def _sparse(sources: np.ndarray, to: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The pairs of a source and a vertex are cells, n of them for each source; a step takes the cells of one level."""
    n, b = len(start), len(sources)
    level, first = np.full(b * n, -1, np.int32), np.empty(b * n, np.int32)
    paths, part = np.zeros(b * n), np.zeros(b * n)
    cells = np.arange(b) * n + sources
    level[cells], paths[cells], levels = 0, 1.0, []

    def onward(cells: np.ndarray) -> Iterator[tuple]:
        v = cells % n
        for s in _pieces(count[v], 1_000_000):
            c = count[v[s]]
            yield cells[s], c, np.repeat(cells[s] - v[s], c) + to[_ranges(start[v[s]], c)]

    while len(cells):
        levels.append(cells := cells[count[cells % n] > 0])
        fresh = [np.zeros(0, np.int64)]
        for f, c, t in onward(cells):
            ok = (level[t] < 0) | (level[t] == len(levels))
            t, p = t[ok], np.repeat(paths[f], c)[ok]
            np.add.at(paths, t, p)
            t = t[level[t] < 0]
            first[t] = np.arange(len(t))
            fresh.append(t := t[first[t] == np.arange(len(t))])
            level[t] = len(levels)
        cells = np.concatenate(fresh)
    for k in range(len(levels) - 1, -1, -1):
        for f, c, t in onward(levels[k]):
            share = np.zeros(len(t))
            np.divide(1 + part[t], paths[t], out=share, where=level[t] == k + 1)
            if len(f):
                part[f] = paths[f] * np.add.reduceat(share, np.cumsum(c) - c)
    part[np.arange(b) * n + sources] = 0
    return part.reshape(b, n).sum(0)


def subgraph(edges: DataFrame, vertices: DataFrame, labels: list[str]) -> DataFrame:
    """Edges between vertices (id, labels) that carry one of the labels."""
    keep = vertices.where(F.arrays_overlap("labels", F.array(*map(F.lit, labels)))).select("id")
    return as_edges(edges).join(keep.select(F.col("id").alias("src")), "src", "left_semi").join(keep.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "label", "weight")


def subgraph_by_edge_label(edges: DataFrame, labels: list[str]) -> DataFrame:
    return as_edges(edges).where(F.col("label").isin(labels))


def match_pattern(edges: DataFrame, pattern: list[tuple[str, str | None, str]], vertices: DataFrame | None = None, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """One column per variable for every injective match of a pattern of (a, edge label, b) triples.

    labels: the labels that a variable's vertex must all carry, looked up in `vertices` (id, labels).
    """
    e, out = as_edges(edges).select("src", "dst", "label").distinct(), None
    for a, label, b in pattern:
        step = (e if label is None else e.where(F.col("label") == label)).select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()
        shared = [] if out is None else [v for v in (a, b) if v in out.columns]
        if out is not None and not shared:
            raise ValueError("each triple must share a variable with those before it")
        out = step if out is None else out.join(step, shared)
    for v, need in (labels or {}).items():
        fit = vertices.where(F.forall(F.array(*map(F.lit, need)), lambda x: F.array_contains("labels", x))).select(F.col("id").alias(v))
        out = out.join(fit, v, "left_semi")
    cols = out.columns
    for i, x in enumerate(cols):
        for y in cols[i + 1 :]:
            out = out.where(F.col(x) != F.col(y))
    return out


def match_classes(engine, path: str, where: str | None, returns: str) -> DataFrame:
    """MATCH (a:Class)[-[e:Relation]->(b:Class)]... over registered classes; a relation's source and target hold keys.

    A node's key is its column `id`, or else its first column.
    """
    nodes = re.findall(r"\(\s*(\w+)\s*(?::\s*([\w.]+))?\s*\)", path)
    links = re.findall(r"(<?)-\[\s*(\w*)\s*:\s*([\w.]+)\s*\]-(>?)", path)
    if len(links) != len(nodes) - 1:
        raise ValueError(f"unreadable path {path}")

    def node(var: str, cls: str) -> DataFrame:
        df = engine.table(cls)
        key = "id" if "id" in df.columns else df.columns[0]
        return df.select(F.col(key).cast("string").alias(f"__{var}"), F.struct("*").alias(var))

    out = node(*nodes[0])
    for (left, var, rel, right), (a, _), (b, cls) in zip(links, nodes, nodes[1:]):
        r = engine.table(rel)
        src, dst = ("src", "dst") if "src" in r.columns else ("source", "target")
        e = r.select(F.col(src).cast("string").alias("__s"), F.col(dst).cast("string").alias("__d"), F.struct("*").alias(var or f"__e_{b}"))
        way = [e.withColumnsRenamed({"__s": f"__{a}", "__d": f"__{b}"})] if right else []
        if left or not right:
            way.append(e.withColumnsRenamed({"__d": f"__{a}", "__s": f"__{b}"}).select(*e.withColumnsRenamed({"__s": f"__{a}", "__d": f"__{b}"}).columns))
        step = way[0]
        for w in way[1:]:
            step = step.unionByName(w)
        out = out.join(step, f"__{a}").join(node(b, cls), f"__{b}")
    if where:
        out = out.where(where)
    return out.selectExpr(*split_list(returns))


def split_list(text: str) -> list[str]:
    """Items between commas outside brackets and quotes."""
    return [x.strip() for x in re.findall(r"(?:[^,(']|\([^()]*\)|'[^']*')+", text) if x.strip()]


def analyze(edges: DataFrame, algorithm: str, **options) -> DataFrame:
    """GRAPH ANALYZE: one of the algorithms by name; `labels` keeps edges of these labels first."""
    if labels := options.pop("labels", None):
        edges = subgraph_by_edge_label(edges, labels)
    known = {"degree_statistics": degree_statistics, "mean_clustering": mean_clustering, "pagerank": pagerank, "connected_components": connected_components, "degree_distribution": degree_distribution, "clustering_coefficient": clustering, "betweenness_centrality": betweenness, "degrees": degrees}
    if algorithm not in known:
        raise ValueError(f"unknown algorithm {algorithm}; known: {', '.join(sorted(known))}")
    return known[algorithm](edges, **options)


def gcn_layer(edges: DataFrame, features: DataFrame, weights: np.ndarray) -> DataFrame:
    """(id, x): one graph convolution with self loops, symmetric normalisation, a dense map and ReLU. features: (id, x array<double>)."""
    e = steps(edges, "both").where("a != b").distinct()
    nodes = features.select("id")
    e = e.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").union(nodes.select(F.col("id").alias("a"), F.col("id").alias("b")))
    deg = e.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    near = e.join(deg, "a").join(deg.select(F.col("a").alias("b"), F.col("n").alias("m")), "b").join(features.select(F.col("id").alias("b"), "x"), "b")
    parts = near.select("a", F.posexplode(F.transform("x", lambda v: v / F.sqrt(F.col("n") * F.col("m")))).alias("k", "v")).groupBy("a", "k").agg(F.sum("v").alias("v"))
    rows = parts.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("h"))
    cols = [F.greatest(F.lit(0.0), F.aggregate(F.zip_with("h", F.array(*map(F.lit, map(float, w))), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)) for w in np.asarray(weights).T]
    return rows.select(F.col("a").alias("id"), F.array(*cols).alias("x"))


def pooled(features: DataFrame, how: str = "mean") -> DataFrame:
    """(k, value): mean, sum or max of each feature over all vertices."""
    f = {"mean": F.avg, "sum": F.sum, "max": F.max}[how]
    return features.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(f("v").alias("value"))


def forward_chain(triples: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """(s, p, o): closure under the graph reasoner's rules over the predicates type, subClassOf, inverseOf, domain and range,
    and the types SymmetricProperty and TransitiveProperty.

    Semi-naive: each join has the facts of the last round on one of its sides, and only new facts are written.
    """
    parts = [cut(triples.select("s", "p", "o").where("s is not null and p is not null and o is not null").distinct())]
    fresh = parts[0]
    for _ in range(max_rounds):
        every = reduce(DataFrame.union, parts)
        new = None
        for a, b in ((fresh, every), (every, fresh)):  # the two sides of each rule's join
            of = lambda f, p: f.where(F.col("p") == p)
            kind = lambda f, t: f.where((F.col("p") == "type") & (F.col("o") == t)).select(F.col("s").alias("p"))
            pairs = of(b, "inverseOf").select(F.col("s").alias("k"), F.col("o").alias("v"))
            pairs = pairs.union(pairs.select("v", "k"))
            on = lambda p: of(b, p).select(F.col("s").alias("k"), F.col("o").alias("v"))
            up = of(b, "subClassOf").select(F.col("s").alias("k"), F.col("o").alias("v"))
            steps_ = [
                a.where("p in ('subClassOf', 'type')").join(up, F.col("o") == F.col("k")).select("s", "p", F.col("v").alias("o")),
                a.join(kind(b, "SymmetricProperty"), "p", "left_semi").select(F.col("o").alias("s"), "p", F.col("s").alias("o")),
                a.join(pairs, F.col("p") == F.col("k")).select(F.col("o").alias("s"), F.col("v").alias("p"), F.col("s").alias("o")),
                a.join(on("domain"), F.col("p") == F.col("k")).select("s", F.lit("type").alias("p"), F.col("v").alias("o")),
                a.join(on("range"), F.col("p") == F.col("k")).select(F.col("o").alias("s"), F.lit("type").alias("p"), F.col("v").alias("o")),
            ]
            for x in steps_:
                new = x if new is None else new.union(x)
        # a transitive property: new facts with all others, and all with all where the property has only now become transitive
        through, now = kind(every, "TransitiveProperty"), kind(fresh, "TransitiveProperty")
        for x, y, ps in ((fresh, every, through), (every, fresh, through), (every, every, now)):
            x = x.join(ps, "p", "left_semi")
            new = new.union(x.alias("x").join(y.alias("y"), (F.col("x.p") == F.col("y.p")) & (F.col("x.o") == F.col("y.s"))).select("x.s", "x.p", "y.o"))
        fresh = cut(new.distinct().join(every, ["s", "p", "o"], "left_anti"))
        if fresh.isEmpty():
            break
        parts.append(fresh)
    return reduce(DataFrame.union, parts)


def backward_chain(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, **options) -> DataFrame:
    """(s, p, o): the facts, stated or derived by forward_chain's rules, that meet a goal; a part that isn't given is a variable."""
    out = forward_chain(triples, **options)
    for c, v in (("s", s), ("p", p), ("o", o)):
        out = out if v is None else out.where(F.col(c) == v)
    return out


def rendered(edges: DataFrame, kind: str = "dot", max_edges: int = 10_000) -> str:
    """Text for DOT, Mermaid, D3 or Cytoscape; more than max_edges edges raise."""
    import json

    rows = as_edges(edges).orderBy("src", "dst", "label").limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"more than {max_edges} edges to draw")
    nodes = sorted({x for r in rows for x in (r.src, r.dst)})
    if kind == "dot":
        return "digraph g {\n" + "".join(f"  {json.dumps(r.src)} -> {json.dumps(r.dst)} [label={json.dumps(r.label or '')}];\n" for r in rows) + "}\n"
    if kind == "mermaid":
        at = {x: f"n{i}" for i, x in enumerate(nodes)}
        return "graph TD\n" + "".join(f'  {at[r.src]}["{r.src}"] -->|{r.label or ""}| {at[r.dst]}["{r.dst}"]\n' for r in rows)
    if kind == "d3":
        return json.dumps({"nodes": [{"id": x} for x in nodes], "links": [{"source": r.src, "target": r.dst, "label": r.label} for r in rows]})
    if kind == "cytoscape":
        return json.dumps({"elements": [{"data": {"id": x}} for x in nodes] + [{"data": {"source": r.src, "target": r.dst, "label": r.label}} for r in rows]})
    raise ValueError(f"unknown drawing {kind}")

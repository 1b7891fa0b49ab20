import numpy as np
import pytest

from quillon.llm.vectors import _bins, by_sum, most_similar, near_pairs

S = "spec_id long, owner_class string, column_name string, query_vector array<float>, idx int, cell int"
M = "owner_class string, column_name string, dimension int, metric string, near_distance double"
META = [("A", "cos", 32, "cosine", 0.05), ("A", "l2", 32, "l2", 1.0), ("B", "none", 32, "l2", None), ("B", "odd", 3, "l2", 0.5), ("C", "bad", 8, "dot", 0.5)]


def made(n=700, seed=8):
    r = np.random.default_rng(seed)
    rows = []
    for c in ("cos", "l2"):
        x = r.standard_normal((n, 32))
        twin = x[: n // 5] + r.standard_normal((n // 5, 32)) * (0.06 if c == "cos" else 0.1)
        for v in np.concatenate([x, twin, x[:20]]):
            rows.append((len(rows), "A", c, [float(y) for y in v * (r.uniform(0.01, 30) if c == "cos" else 1)]))
    k = len(rows)
    good = rows[0][3]
    rows += [(k, "A", "cos", None), (k + 1, "A", "cos", good[:31]), (k + 2, "A", "cos", [0.0] * 32), (k + 3, "A", "cos", [float("nan"), *good[1:]]), (k + 4, "A", "cos", [float("inf"), *good[1:]]), (k + 5, "A", "cos", [None, *good[1:]]), (k + 6, "Z", "cos", good), (None, "A", "cos", good), (k + 7, "C", "bad", [1.0] * 8), (k + 8, "C", "bad", [1.0] * 8), (k + 9, "B", "none", good), (k + 10, "B", "none", good)]
    rows += [(k + 11, "B", "odd", [0.0, 0.0, 0.0]), (k + 12, "B", "odd", [0.0, 0.0, 0.4]), (k + 13, "B", "odd", [0.0, 0.0, 0.9])]
    return rows + rows[:15]


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, 2) for x in rows], S), spark.createDataFrame(META, M)


def usable(rows, col):
    d = {i: np.asarray(v, np.float32).astype(float) for i, o, c, v in rows if o == "A" and c == col and i is not None and v is not None and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v) and (c != "cos" or any(v))}
    ids = np.array(sorted(d))
    x = np.stack([d[i] for i in ids])
    if col == "cos":
        x = x / np.linalg.norm(x, axis=1)[:, None]
    dist = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    return ids, dist


@pytest.mark.parametrize("opts", [{}, {"reach": 1.0, "cell_rows": 20, "block_rows": 8}, {"cell_rows": 40, "sample_rows": 60}])
def test_pairs_against_brute_force(spark, opts):
    rows, want = made(), set()
    for col, limit in (("cos", np.sqrt(0.1)), ("l2", 1.0)):
        ids, dist = usable(rows, col)
        want |= {(int(ids[i]), int(ids[j])) for i, j in np.argwhere(dist <= limit) if i < j}
    k = max(i for i, *_ in rows if i is not None)
    want |= {(k - 2, k - 1), (k - 1, k)}
    got = [(r.a, r.b) for r in near_pairs(*frame(spark, rows), **opts).collect()]
    assert len(got) == len(set(got)) and not set(got) - want
    assert len(set(got)) >= len(want) * (1.0 if opts.get("reach") == 1.0 else 0.995)


@pytest.mark.parametrize("n,opts,least", [(1500, {}, 0.9), (6000, {}, 0.9), (400, {"share": 1.0, "block_rows": 60}, 0.998)])
def test_recall_of_most_similar(spark, n, opts, least):
    rows = made(n, 3)
    got = {}
    for r in most_similar(*frame(spark, rows), every=5, **opts).collect():
        got.setdefault(r.id, []).append((r.rank, r.other, r.distance))
    for col in ("cos", "l2"):
        ids, dist = usable(rows, col)
        np.fill_diagonal(dist, np.inf)
        hit = total = 0
        for k in np.flatnonzero(ids % 5 == 0):
            found = sorted(got[int(ids[k])])
            assert [x[0] for x in found] == list(range(1, 11)) and [x[2] for x in found] == sorted(x[2] for x in found)
            hit += len({int(i) for i in ids[np.argsort(dist[k])[:10]]} & {x[1] for x in found})
            total += 10
        assert hit / total >= least  # not 1 even if exact: of equally near vectors brute force may name another


def test_bins_hold_what_they_should():
    sizes = np.array([5, 0, 3, 30, 2, 9, 0, 1])
    first, many = _bins(sizes, 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5, 5, 5] and many.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]


def test_heap_order():
    a, b = np.random.default_rng(1).random(6), np.random.default_rng(2).random(5)
    got = list(by_sum(a, b))
    assert [g[0] for g in got] == sorted(float(x + y) for x in a for y in b) and len({g[1:] for g in got}) == 30


def test_empty(spark):
    specs, meta = frame(spark, [])
    assert near_pairs(specs, meta).count() == 0 and most_similar(specs, meta).count() == 0
    assert near_pairs(frame(spark, made(20))[0], spark.createDataFrame([], M)).count() == 0


def test_query_loses_no_pair_of_few_dimensions(spark, tmp_path):
    from quillon.llm.queries import p1_found

    x = np.random.default_rng(9).random((20_000, 2)).astype("float32")
    rows = [(i, 0, "c", "v", 1.0, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "spec_id long, search_id long, owner_class string, column_name string, weight double, query_vector array<float>").write.parquet(f"{tmp_path}/vector_search_spec.parquet")
    spark.createDataFrame([("c", "v", 2, "l2", 0.004)], "owner_class string, column_name string, dimension int, metric string, near_distance double").write.parquet(f"{tmp_path}/vector_index_meta.parquet")
    y = x.astype(float)
    want = {(i, int(j)) for i in range(len(y)) for j in i + 1 + np.flatnonzero(((y[i + 1 :] - y[i]) ** 2).sum(1) <= 0.004**2)}
    assert {(r.spec_id_a, r.spec_id_b) for r in p1_found(spark, str(tmp_path)).collect()} == want

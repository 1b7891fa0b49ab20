import random

from quillon.operators.hierarchy import all_paths, descendants, full_paths, hierarchy, tops

S = "class_name string, superclasses array<string>, n string, top string"


def frame(spark, rows):
    return spark.createDataFrame([(n, p, "x", "y") for n, p in rows], S)


def brute(rows):
    up = {}
    for n, ps in rows:
        if n and n.strip():
            up.setdefault(n.strip().lower(), set()).update(p.strip().lower() for p in ps or [] if p)
    up = {n: {p for p in ps if p in up} for n, ps in up.items()}

    def above(n):
        seen, todo = set(), list(up[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up[x]
        return seen

    anc = {n: above(n) for n in up}
    loop = {n: min(x for x in anc[n] if n in anc[x]) for n in up if n in anc[n]}
    return {(n, r) for n in up for r in anc[n] | {n} if not up[r]} | {(n, loop[x]) for n in up for x in anc[n] | {n} if x in loop}


def test_against_brute_force(spark):
    r = random.Random(3)
    names = [f"C{i}" for i in range(60)]
    rows = [(n, [r.choice([*names[: i + 2], " c3 ", "", None, "nobody"]) for _ in range(r.randrange(3))]) for i, n in enumerate(names)]
    rows += [(" c5 ", None), ("C5", []), (None, ["C1"]), ("  ", ["C1"]), ("self", ["SELF"]), ("below", ["self", "C1"])] + rows[:4]
    got = {(x.class_name, x.top_name) for x in tops(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_chain_and_paths(spark):
    rows = [(f"n{i}", [f"n{i - 1}"] if i else []) for i in range(70)] + [("two", ["n3", "n5"]), ("a", ["b"]), ("b", ["a"]), ("c", ["b"])]
    df = frame(spark, rows)
    h = {x.class_name: x for x in hierarchy(df).collect()}
    assert (h["n69"].depth, h["n69"].ancestors, h["n0"].descendants, h["two"].depth) == (69, 69, 70, 4)
    assert (h["a"].loop, h["b"].loop, h["c"].loop, h["c"].depth, h["c"].ancestors) == ("a", "a", None, None, 1)
    paths = [(x.class_name, tuple(x.path)) for x in full_paths(df).collect()]
    assert len(paths) == len(set(paths)) == 72
    assert ("two", ("n0", "n1", "n2", "n3", "two")) in paths and not any(n in "abc" for n, _ in paths)


def test_paths_below_loops(spark):
    rows = [("root", None), ("l1", ["l2"]), ("l2", ["l1", "root"]), ("x", ["root", "l1"]), ("y", ["x"]), ("z", ["l2"]), ("own", ["own", "root"])]
    paths = [(x.class_name, tuple(x.path)) for x in full_paths(frame(spark, rows)).collect()]
    assert sorted(paths) == [("root", ("root",)), ("x", ("root", "x")), ("y", ("root", "x", "y"))]


def test_empty(spark):
    assert tops(frame(spark, [])).count() == hierarchy(frame(spark, [])).count() == full_paths(frame(spark, [])).count() == 0
    assert [tuple(r) for r in tops(frame(spark, [("a", None)])).collect()] == [("a", "a")]


def test_all_paths_below_and_through_loops(spark):
    rows = [("r", None), ("k", ["r"]), ("a", ["b"]), ("b", ["c", "k"]), ("c", ["a"]), ("self", ["self"]), ("d", ["k", "a"]), ("e", ["d", "self"]), ("x", ["y", "z"]), ("y", ["x"]), ("z", ["y"])]
    up = {n: list(dict.fromkeys(ps or [])) for n, ps in rows}
    name = {"a": "a", "b": "a", "c": "a", "self": "self", "x": "x", "y": "x", "z": "x"}

    def walks(way):  # bottom first
        if not up[way[-1]]:
            yield tuple(way[::-1]), None
        for p in up[way[-1]]:
            if p in way:
                yield tuple(way[::-1]), name[p]
            else:
                yield from walks([*way, p])

    want = {(n, path, loop) for n in up for path, loop in walks([n])}
    got = [(x.class_name, tuple(x.path), x.loop) for x in all_paths(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ("d", ("r", "k", "d"), None) in want and ("d", ("r", "k", "b", "a", "d"), None) in want and ("d", ("b", "c", "a", "d"), "a") not in want


def test_all_paths_end_in_all_tops(spark):
    r = random.Random(8)
    names = [f"c{i}" for i in range(40)]
    rows = [(n, [r.choice(names[max(0, i - 9) : i + 3]) for _ in range(r.randrange(3))]) for i, n in enumerate(names)]
    assert {(x.class_name, x.top_name) for x in all_paths(frame(spark, rows)).collect()} == brute(rows)
    assert all_paths(frame(spark, [])).count() == 0


def test_descendants_count_every_member_of_a_loop(spark):
    ring = [(f"m{i}", [f"m{(i + 1) % 10}"]) for i in range(10)]
    rows = [("root", None), *ring, ("m0", ["root"]), ("low", ["m4", "low"])]
    up = {}
    for n, ps in rows:
        up.setdefault(n, set()).update(ps or [])
    want = {}
    for n in up:
        level, k = {n}, 0
        while level:
            k, level = k + 1, {p for x in level for p in up[x]} - {n} - {a for a, b in want if b == n}
            want |= {(a, n): k for a in level}
    got = descendants(frame(spark, rows)).collect()
    assert len(got) == len(want) and {(x.class_name, x.descendant): x.levels for x in got} == want
    h = {x.class_name: x for x in hierarchy(frame(spark, rows), members=True).collect()}
    assert {n: (x.descendants, x.ancestors) for n, x in h.items()} == {n: (sum(a == n for a, _ in want), sum(b == n for _, b in want)) for n in up}
    assert (h["root"].descendants, h["m3"].descendants, h["m1"].depth, h["m3"].loop, h["low"].loop) == (11, 10, 10, "m0", "low")
    assert descendants(frame(spark, [])).count() == 0

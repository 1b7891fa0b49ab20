import random

import numpy as np

from quillon.llm.mix import flight, land, mixed, reached_shares, settle

D = "doc_id long, text string, source string, tokens int, p double"
M = "source_name string, target_share double, max_repeats int"


def docs(spark, seed=3):
    r = random.Random(seed)
    rows = []
    for name, n in (("Big Source", 900), ("big_source ", 300), ("small", 60), ("MIDDLE", 200)):
        rows += [(len(rows) + k, "word " * r.choice([1, 5, 20, 200]), name, 0, 0.0) for k in range(n)]
    k = len(rows)
    return spark.createDataFrame(rows + [(k, None, "small", 0, 0.0), (k + 1, "", "small", 0, 0.0), (k + 2, "text", None, 0, 0.0), (k + 3, "text", "other", 0, 0.0)], D)


TARGETS = [("big_source", 0.5, 1), ("small", 0.2, 3), ("middle", 0.3, 2), ("absent", 0.0, 2), ("never", -1.0, 2)]


def test_shares_and_caps(spark):
    t = spark.createDataFrame(TARGETS, M)
    for block in (50, 20_000):
        mix = mixed(docs(spark), t, block_rows=block)
        rows = mix.collect()
        assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats >= 1 and r.tokens > 0 for r in rows)
        rep = {r.source: r for r in reached_shares(mix, t).collect()}
        for name, share, most in TARGETS[:3]:
            assert abs(rep[name].actual_share - share) < 0.0005 and rep[name].most_repeats <= most
        assert rep["absent"].tokens == 0
        assert max(rep[n].most_repeats / m for n, _, m in TARGETS[:3]) == 1  # the total is the largest possible
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixed(docs(spark), t).collect()))


def test_flight_keeps_constraints_and_expectation():
    tokens, total = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 7, 7]), np.zeros(12)
    for seed in range(1500):
        p = flight(np.full(12, 0.3), tokens, np.random.default_rng(seed))
        assert abs(p.sum() - 3.6) < 1e-6 and abs((p * tokens).sum() - 0.3 * tokens.sum()) < 1e-5
        assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
        total += p
        assert set(land(p, tokens)) <= {0.0, 1.0}
    assert np.abs(total / 1500 - 0.3).max() < 0.06


def test_misses_are_made_good():
    r = np.random.default_rng(4)
    for _ in range(50):
        t = np.concatenate([r.integers(5, 300, 200), r.integers(2000, 30_000, 6)])
        p = np.full(len(t), 0.4)
        done = settle(land(flight(p, t, r), t), t, float((p * t).sum()))
        assert set(done) <= {0.0, 1.0} and abs((done * t).sum() - (p * t).sum()) <= 150 and abs(done.sum() - p.sum()) < 0.2 * len(t)


def test_equal_sizes_and_single():
    for n in (1, 2, 5):
        p = land(flight(np.full(n, 0.5), np.full(n, 4), np.random.default_rng(1)), np.full(n, 4))
        assert set(p) <= {0.0, 1.0} and abs(p.sum() - n / 2) <= 0.5


def test_empty(spark):
    t = spark.createDataFrame(TARGETS, M)
    assert mixed(docs(spark).limit(0), t).count() == 0 and mixed(docs(spark), spark.createDataFrame([], M)).count() == 0
    assert reached_shares(mixed(docs(spark).limit(0), t), t).count() == 5

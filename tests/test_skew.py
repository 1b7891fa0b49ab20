import random

import pytest

from quillon.operators.skew import heavy_keys, partner_counts, reciprocal_pairs

S = "link_id long, source string, target string, h string, k string"


def links(spark, rows):
    return spark.createDataFrame([(i, a, b, "x", "y") for i, (a, b) in enumerate(rows)], S)


def made():
    r = random.Random(5)
    rows = [("Hub ", f"p{r.randrange(300)}") for _ in range(900)] + [(f"p{r.randrange(300)}", "hub") for _ in range(500)]
    rows += [("hub2", "hub"), (" HUB", "hub2"), ("hub2", "p1"), ("p1", "hub2")] + [(f"q{r.randrange(40)}", f"Q{r.randrange(40)}") for _ in range(700)]
    return rows + [(None, "p1"), ("p1", None), ("", "p2"), ("p2", "  "), ("hub", "hub"), ("a", "b")] + rows[:50]


def brute(rows):
    e = {(a.strip().lower(), b.strip().lower()) for a, b in rows if a and b and a.strip() and b.strip()}
    return {(a, b) for a, b in e if a < b and (b, a) in e}


@pytest.mark.parametrize("room", [0, 40_000, 10**8])
def test_pairs(spark, room):
    got = [(r.key_a, r.key_b) for r in reciprocal_pairs(links(spark, made()), share=0.01, broadcast_bytes=room).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(made())


def test_heavy_and_counts(spark):
    df = links(spark, made())
    assert list(heavy_keys(df, share=0.2)) == ["hub"]
    out, into = heavy_keys(df, share=0.01)["hub"]
    assert 900 <= out <= 960 and 500 <= into <= 560
    per = {r.key: r for r in partner_counts(df).collect()}
    assert per["hub"].reciprocal == sum("hub" in p for p in brute(made()))
    assert per["a"].partners_out == 1 and per["a"].partners_in == 0 and None not in per and "" not in per


def test_empty(spark):
    assert reciprocal_pairs(links(spark, [])).count() == 0 and partner_counts(links(spark, [])).count() == 0
    assert reciprocal_pairs(links(spark, [(None, None), ("a", "A")])).count() == 0

"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.encode import TOKENIZER_DIR, token_counts
from quillon.runtime import cut, tidy_name

BLOCK_ROWS = 20_000
SEED = 20_250_301
EPS = 1e-9
RESERVE = 256  # documents a block that stay undecided until the last round


def source_name(col: str | Column) -> Column:
    """Spellings of one source name: case, surrounding blanks and the marks between words don't matter."""
    return F.regexp_replace(tidy_name(col), r"[\s\-]+", "_")


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase of the cube method with two constraints: sum of p and sum of p * tokens keep their values.

    Three undecided units at a time move along the null space of the constraints until one reaches 0 or 1, each
    way with the chance that keeps its expectation. At most two units are left undecided.
    """
    p, hand, t = p.astype(float).copy(), [], tokens.astype(float)
    draws = iter(rng.random(len(p) * 2 + 8))
    todo = iter(np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist())
    while True:
        while len(hand) < 3 and (k := next(todo, None)) is not None:
            hand.append(k)
        if len(hand) < 2 or (len(hand) == 2 and t[hand[0]] != t[hand[1]]):
            return p
        if len(hand) == 2:
            u = (1.0, -1.0)
        else:
            a, b, c = (t[k] for k in hand)
            u = (b - c, c - a, a - b)
            if a == b == c:
                u = (1.0, -1.0, 0.0)
            top = max(map(abs, u))
            u = tuple(x / top for x in u)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(hand, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(hand, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        for k, x in zip(hand, u):
            p[k] += step * x
        for k in [k for k in hand if not EPS < p[k] < 1 - EPS]:
            p[k] = round(p[k])
            hand.remove(k)


def land(p: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Landing phase for the few undecided units: the 0/1 choice whose tokens come closest to the expected ones."""
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(left):
        return p
    want, size = (p[left] * tokens[left]).sum(), (p[left]).sum()
    picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    off = np.abs(picks @ tokens[left] - want)
    best = picks[np.lexsort((np.abs(picks.sum(1) - size), off))[0]]
    p = p.copy()
    p[left] = best
    return p


def settle(p: np.ndarray, tokens: np.ndarray, want: float) -> np.ndarray:
    """After landing: documents are taken in or left out, largest fitting one first, until no other one brings the tokens closer to `want`.

    A large document tends to stay undecided to the end of a flight, as little of it outweighs many small ones;
    what its rounding misses is made good by a few others.
    """
    p, miss = p.copy(), want - float((p * tokens).sum())
    side = p < 0.5 if miss > 0 else p > 0.5
    at = np.flatnonzero(side)
    at = at[np.argsort(tokens[at], kind="stable")]
    free, miss, sign = tokens[at].tolist(), abs(miss), miss > 0
    while free:
        k = int(np.searchsorted(free, miss, side="right")) - 1
        if k < 0:
            if 2 * miss > free[0]:
                p[at[0]] = 1.0 if sign else 0.0
            break
        p[at[k]] = 1.0 if sign else 0.0
        miss -= free.pop(k)
        at = np.delete(at, k)
    return p


def _flights(last: bool, reserve: int = RESERVE):
    def run(d: pd.DataFrame) -> pd.DataFrame:
        # the largest documents first, so that what is left undecided is small
        d = d.sort_values(["tokens", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        rng = np.random.default_rng([SEED, int(last), len(d), int(d["doc_id"].iloc[0]) & 0xFFFFFFFF])
        t, p = d["tokens"].to_numpy(np.int64), d["p"].to_numpy(float).copy()
        if last:
            done = flight(p, t, rng)
            return d.assign(p=settle(land(done, t), t, float((p * t).sum())) if ((p > EPS) & (p < 1 - EPS)).any() else done)
        kept = np.zeros(len(d), bool)  # of all sizes
        kept[np.unique(np.linspace(0, len(d) - 1, min(len(d), reserve)).astype(int))] = True
        p[~kept] = flight(p[~kept], t[~kept], rng)
        return d.assign(p=p)

    return run


def mixed(
    docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", block_rows: int = BLOCK_ROWS,
    tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """(doc_id, source, tokens, repeats): the documents to take, and how often each.

    The total is the largest one at which no source must be repeated more than max_repeats times: the least of
    max_repeats * tokens / share over the sources. A source then needs share * total / tokens passes over its
    documents. Each document is taken for every whole pass, and the rest of a pass is a balanced sample by the
    cube method: equal fractional inclusion probabilities move through the null space of the constraints (number
    of documents and number of tokens of the source stay as expected) in blocks of some `block_rows` documents,
    however large the source. At most two documents of each block and RESERVE of all sizes stay undecided and meet
    in further rounds of the same; in the last one at most two per source are decided by the choice that misses the
    source's tokens least, and a few others make good what is still missed (see settle).

    Source names are compared in lower case, without surrounding blanks, with "_" for blanks and hyphens.
    Documents of no target source, and those without tokens (null and empty texts), are left out: they can't add
    to a share. Targets with a null, zero or negative share or fewer than one repeat count as absent; several
    rows of one name add up their shares. Targets without any token are ignored and the other shares scaled up
    to one. doc_id must be unique. Empty tables give no rows; other columns are ignored.
    """
    t = targets.select(source_name("source_name").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats >= 1 and not isnan(target_share)")
    t = t.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most"))
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), source_name(source).alias("source")).join(t.select("source"), "source", "left_semi")
    counts = token_counts(named, keep=("source",), tokenizer=tokenizer, tokenizer_dir=tokenizer_dir)
    base = cut(counts.where("tokens > 0").select("doc_id", "source", "tokens"))
    rows = base.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).join(t, "source").collect()  # one row per target
    if not rows:
        return base.select("doc_id", "source", "tokens", F.lit(0).cast("long").alias("repeats"))
    shares = sum(r["share"] for r in rows)
    total = min(r["most"] * r["tokens"] / (r["share"] / shares) for r in rows)
    plan = []
    for r in rows:
        passes = min(float(r["most"]), total * r["share"] / shares / r["tokens"])
        whole = int(np.floor(passes + 1e-9))
        plan.append((r["source"], whole, max(0.0, passes - whole) if passes - whole > 1e-9 else 0.0, max(1, -(-r["n"] // block_rows))))
    spark = docs.sparkSession
    p = base.join(F.broadcast(spark.createDataFrame(plan, "source string, whole int, p double, blocks int")), "source")
    state = p.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).select("source", "block", "doc_id", "tokens", "p")
    schema = "source string, block long, doc_id long, tokens long, p double"
    open_, decided, left, largest = f"p > {EPS} and p < {1 - EPS}", [], state, max(r["n"] for r in rows)
    reserve = min(RESERVE, block_rows // 8)
    while largest > block_rows:  # the largest number of undecided documents of a source
        done = cut(left.groupBy("source", "block").applyInPandas(_flights(False, reserve), schema))
        decided.append(done.where(f"not ({open_})"))
        largest = -(-largest // block_rows) * (reserve + 2)
        left = done.where(open_).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(largest)), F.lit(-(-largest // block_rows))))
    decided.append(left.withColumn("block", F.lit(0).cast("long")).groupBy("source").applyInPandas(_flights(True), schema))
    chosen = decided[0]
    for x in decided[1:]:
        chosen = chosen.unionByName(x)
    part = F.broadcast(spark.createDataFrame([x[:2] for x in plan], "source string, whole int"))
    out = chosen.join(part, "source").select("doc_id", "source", "tokens", (F.col("whole") + F.round("p").cast("int")).cast("long").alias("repeats"))
    return out.where("repeats > 0")


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats): what a mix reaches, one row per target.

    A target without documents in the mix has zeros.
    """
    t = targets.select(source_name("source_name").alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    per = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    all_ = per.agg(F.sum("tokens").alias("total"))
    zero = F.lit(0).cast("long")
    return t.join(per, "source", "left").crossJoin(F.broadcast(all_)).select(  # one row
        "source", "target_share", F.coalesce(F.col("tokens") / F.nullif("total", zero), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_repeats", zero).alias("most_repeats"))

"""Rules over rows as text, and lineage of records."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import cut


@dataclass
class Rule:
    name: str
    id: str = ""
    when: list[tuple[str, str, str]] = field(default_factory=list)
    then: list[tuple[str, str]] = field(default_factory=list)
    priority: int = 0
    enabled: bool = True


def parse_rules(text: str) -> list[Rule]:
    """RULE name / ID x / WHEN Entity.attr op value [AND ...] / THEN Entity.attr = value [AND ...] / PRIORITY n / ENABLED true."""
    rules: list[Rule] = []
    for line in text.splitlines():
        line = re.sub(r"\s*(#|//).*$", "", line).strip()
        word, _, rest = line.partition(" ")
        word, rest = word.upper(), rest.strip()
        if word == "RULE":
            rules.append(Rule(rest.strip("\"'")))
        elif not rules or not word:
            continue
        elif word == "ID":
            rules[-1].id = rest.strip("\"'")
        elif word in ("WHEN", "AND"):
            for part in re.split(r"\s+AND\s+", rest, flags=re.I):
                if m := re.fullmatch(r"(?:\w+\.)?(\w+)\s*(>=|<=|!=|=|>|<|contains)\s*(.+)", part.strip(), re.I):
                    rules[-1].when.append((m[1], m[2].lower(), m[3].strip().strip("\"'")))
        elif word == "THEN":
            for part in re.split(r"\s+AND\s+", rest, flags=re.I):
                if m := re.fullmatch(r"(?:SET\s+)?(?:\w+\.)?(\w+)\s*=\s*(.+)", part.strip(), re.I):
                    rules[-1].then.append((m[1], m[2].strip().strip("\"'")))
        elif word == "PRIORITY":
            rules[-1].priority = int(rest)
        elif word == "ENABLED":
            rules[-1].enabled = rest.lower() == "true"
    return rules


def condition(attr: str, op: str, value: str) -> Column:
    """Numbers are compared as numbers where both sides are numbers; otherwise = != and contains compare text."""
    text, want = F.col(attr).cast("string"), F.lit(value)
    a, b = text.try_cast("double"), want.try_cast("double")
    number = a.isNotNull() & b.isNotNull()
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, ">": lambda x, y: x > y, "<": lambda x, y: x < y, ">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y}
    if op == "contains":
        return F.coalesce(F.contains(text, want), F.lit(False))
    as_text = ops[op](text, want) if op in ("=", "!=") else F.lit(False)
    return F.coalesce(F.when(number, ops[op](a, b)).otherwise(as_text), F.lit(False))


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Set what the enabled rules say, lowest priority first so that the highest one stands; `fired` names the rules of a row."""
    hits = []
    for r in sorted((r for r in rules if r.enabled), key=lambda r: (r.priority, r.name)):
        hit = F.lit(True)
        for c in r.when:
            hit = hit & condition(*c)
        hits.append((r, f"__hit{len(hits)}", hit))
    out = df.withColumns({name: hit for _, name, hit in hits}) if hits else df
    for r, name, _ in hits:
        for attr, value in r.then:
            old = F.col(attr).cast("string") if attr in out.columns else F.lit(None).cast("string")
            out = out.withColumn(attr, F.when(F.col(name), F.lit(value)).otherwise(old))
    fired = F.filter(F.array(*[F.when(F.col(n), F.lit(r.id or r.name)) for r, n, _ in hits] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    return out.withColumn("fired", fired).drop(*[n for _, n, _ in hits])


def upstream(records: DataFrame, start: str, *, max_depth: int = 10) -> DataFrame:
    """(path, depth, ended): every upstream path of an entity over records (entity, parents array), emitted at roots, at
    loops and at the depth limit. A path never visits an entity twice."""
    links = records.select(F.col("entity").alias("e"), F.explode("parents").alias("parent")).where("parent is not null").distinct()
    has = links.select(F.col("e").alias("at")).distinct().withColumn("more", F.lit(True))
    spark = records.sparkSession
    open_ = spark.createDataFrame([([start],)], "path array<string>")
    done = None
    for d in range(max_depth + 1):
        at = open_.withColumn("at", F.element_at("path", -1)).join(has, "at", "left")
        end = at.where("more is null").select("path", F.lit("root").alias("ended"))
        if d == max_depth:
            end = end.union(at.where("more").select("path", F.lit("depth")))
        else:
            step = at.where("more").join(links, F.col("at") == F.col("e")).select("path", "parent")
            loop = F.array_contains("path", F.col("parent"))
            end = end.union(step.where(loop).select("path", F.lit("loop")).distinct())
            open_ = cut(step.where(~loop).select(F.concat("path", F.array("parent")).alias("path")))
        done = end if done is None else done.union(end)
        if d < max_depth and open_.isEmpty():
            break
    return done.select("path", (F.size("path") - 1).cast("long").alias("depth"), "ended")

"""Triples in and out: Turtle (the common part), N-Triples, JSON-LD; graphs as JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NT = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) from N-Triples, line by line in the JVM; other lines are ignored."""
    t = spark.read.text(path)
    part = lambda i: F.regexp_extract("value", NT, i)
    bare = lambda c: F.regexp_replace(c, r"^<(.*)>$", "$1")
    lit = F.regexp_extract(part(3), r'^"((?:[^"\\]|\\.)*)"', 1)
    unescape = F.replace(F.replace(F.replace(F.replace(lit, F.lit("\\\\"), F.lit("\u0000")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\u0000"), F.lit("\\"))
    return t.where(F.col("value").rlike(NT)).select(bare(part(1)).alias("s"), bare(part(2)).alias("p"), F.when(part(3).startswith('"'), unescape).otherwise(bare(part(3))).alias("o"))


def ntriples(triples: DataFrame) -> Column:
    """A line of N-Triples per row; objects that look like IRIs are written as such."""
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    text = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    return F.concat_ws(" ", iri("s"), iri("p"), F.when(F.col("o").rlike(r"^[a-zA-Z][\w+.-]*:\S+$"), iri("o")).otherwise(text), F.lit("."))


def write_ntriples(triples: DataFrame, path: str) -> None:
    triples.select(ntriples(triples).alias("value")).write.text(path)


def write_jsonld(triples: DataFrame, path: str) -> None:
    """One JSON-LD node per subject and line; a subject's values stay with its predicates."""
    per = triples.groupBy("s", "p").agg(F.collect_set("o").alias("os")).groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "os"))).alias("ps"))
    per.select(F.to_json(F.struct(F.col("s").alias("@id"), F.col("ps").alias("properties"))).alias("value")).write.text(path)


TURTLE = re.compile(r"""\s*(?:\#[^\n]*\n)*\s*(@prefix|@base|<[^>]*>|"{3}(?:.|\n)*?"{3}|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|[;,.](?=\s|$)|_:[\w-]+|[\w-]*:[\w.\-]*[\w-]|[\w-]*:|[-+\w.]+)""")


def parse_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of one Turtle document: prefixes, a, predicate and object lists, literals."""
    toks, at = [], 0
    body = text.rstrip() + "\n"
    while body[at:].strip() and (m := TURTLE.match(body, at)):
        toks.append(m[1])
        at = m.end()
    prefix, out, i, s, p = {}, [], 0, None, None

    def full(t: str) -> str:
        if t == "a":
            return "rdf:type"
        if t[0] == "<":
            return t[1:-1]
        if t[0] == '"':
            return re.match(r'"{3}((?:.|\n)*)"{3}|"((?:[^"\\]|\\.)*)"', t).group(1) or re.match(r'"((?:[^"\\]|\\.)*)"', t)[1]
        head, colon, tail = t.partition(":")
        return prefix[head] + tail if colon and head in prefix else t

    while i < len(toks):
        t = toks[i]
        if t == "@prefix":
            prefix[toks[i + 1].rstrip(":")] = toks[i + 2][1:-1]
            i += 3
        elif t == ".":
            s = p = None
            i += 1
        elif t == ";":
            p = None
            i += 1
        elif t == ",":
            i += 1
        elif s is None:
            s = full(t)
            i += 1
        elif p is None:
            p = full(t)
            i += 1
        else:
            out.append((s, p, full(t)))
            i += 1
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of Turtle files; each file is one document and is parsed whole by one task."""
    import pandas as pd

    def work(parts):
        for d in parts:
            yield pd.DataFrame([t for text in d["value"] for t in parse_turtle(text)], columns=["s", "p", "o"])

    return spark.read.text(path, wholetext=True).mapInPandas(work, "s string, p string, o string")


def graph_json(edges: DataFrame) -> DataFrame:
    """One JSON line per edge."""
    return edges.select(F.to_json(F.struct(*edges.columns)).alias("value"))


def from_graph_json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("e")).select("e.*")



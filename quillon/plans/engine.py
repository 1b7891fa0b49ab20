"""The engine's session: classes registered as tables, an ontology over them, and one entry for query text."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.ontology import Ontology
from quillon.runtime import exists, load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


class Frames(dict):
    """Classes by name; one given as a function is read when it is first needed."""

    def __getitem__(self, name: str) -> DataFrame:
        df = super().__getitem__(name)
        if not isinstance(df, DataFrame):
            self[name] = df = df()
        return df

    def get(self, name: str, default=None):
        return self[name] if name in self else default

    def items(self):
        return [(k, self[k]) for k in self]


class Engine:
    """Class registry and query entry. Registered classes are lazy DataFrames; nothing is copied.

    `sql` takes plain SQL and the class-aware statements of quillon.plans.dialect. Reading a class also reads its
    subclasses and equivalents where the ontology names any.
    """

    def __init__(self, spark: SparkSession, ontology: Ontology | None = None):
        self.spark, self.ontology = spark, ontology or Ontology()
        self.classes = Frames()
        self.indexes: dict[str, dict] = {}
        self.statistics: dict[str, DataFrame] = {}
        self.namespace = ""

    def qualified(self, name: str) -> str:
        return name if not self.namespace or "." in name else f"{self.namespace}.{name}"

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> Engine:
        self.classes[self.qualified(name)] = df
        self.ontology.add_class(self.qualified(name))
        return self

    def table(self, name: str, expand: bool = True) -> DataFrame:
        """The rows of a class and, with `expand`, of its subclasses and equivalents; columns missing there are null."""
        name = self.qualified(name)
        names = [name, *sorted(self.ontology.subclasses(name) - {name})] if expand else [name]
        frames = [self.classes[n] for n in names if n in self.classes]
        if not frames:
            raise KeyError(f"unknown class {name}")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        from quillon.plans import dialect

        return dialect.run(self, text, args)

    def plain_sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        parts = re.split(r"('(?:[^'\\]|\\.|'')*')", text)  # string literals are the odd ones
        for name in self.classes:
            word = rf"(?<![\w.]){re.escape(name)}(?![\w])"
            if not any(re.search(word, p) for p in parts[::2]):
                continue
            self.table(name).createOrReplaceTempView(name.replace(".", "__"))
            if "." in name:
                parts[::2] = [re.sub(word, name.replace(".", "__"), p) for p in parts[::2]]
        text = "".join(parts)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)


def open_dir(spark: SparkSession, d: str) -> Engine:
    """An engine over the tables of a directory."""
    e = Engine(spark)
    for t in TABLES:
        if exists(spark, f"{d}/{t}.parquet"):
            e.register(t, partial(load, spark, d, t))
    return e

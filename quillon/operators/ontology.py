"""Classes and properties, and reasoning over triples.

The ontology itself is metadata of bounded size and lives on the driver; facts are DataFrames (s, p, o). Each
rule joins facts with a small table made from the ontology; only transitivity joins facts with facts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import cut

TYPE = "rdf:type"


@dataclass
class ClassDef:
    parents: set[str] = field(default_factory=set)
    equivalents: set[str] = field(default_factory=set)
    disjoint: set[str] = field(default_factory=set)


@dataclass
class PropertyDef:
    domain: str | None = None
    range: str | None = None
    required: bool = False
    parents: set[str] = field(default_factory=set)
    equivalents: set[str] = field(default_factory=set)
    inverse: str | None = None
    transitive: bool = False
    symmetric: bool = False
    functional: bool = False


class Ontology:
    def __init__(self) -> None:
        self.classes: dict[str, ClassDef] = {}
        self.properties: dict[str, PropertyDef] = {}

    def add_class(self, name: str, parents=(), equivalents=(), disjoint=()) -> Ontology:
        c = self.classes.setdefault(name, ClassDef())
        c.parents |= set(parents)
        c.equivalents |= set(equivalents)
        c.disjoint |= set(disjoint)
        for other in (*parents, *equivalents, *disjoint):
            self.classes.setdefault(other, ClassDef())
        return self

    def drop_class(self, name: str) -> None:
        self.classes.pop(name, None)
        for c in self.classes.values():
            for s in (c.parents, c.equivalents, c.disjoint):
                s.discard(name)

    def add_property(self, name: str, **kw) -> Ontology:
        self.properties[name] = PropertyDef(**kw)
        return self

    def _closure(self, start: str, step) -> set[str]:
        seen, todo = {start}, [start]
        while todo:
            for n in step(todo.pop()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    def _equals(self) -> dict[str, set[str]]:
        """Declared equivalents of each class, both ways."""
        out: dict[str, set[str]] = {}
        for n, c in self.classes.items():
            for e in c.equivalents:
                out.setdefault(n, set()).add(e)
                out.setdefault(e, set()).add(n)
        return out

    def subclasses(self, name: str) -> set[str]:
        """The class, its descendants and the equivalents of all these, both ways; loops are safe."""
        below: dict[str, set[str]] = {}
        for c, d in self.classes.items():
            for p in d.parents:
                below.setdefault(p, set()).add(c)
        equal = self._equals()
        return self._closure(name, lambda n: below.get(n, set()) | equal.get(n, set()))

    def superclasses(self, name: str) -> set[str]:
        equal = self._equals()
        return self._closure(name, lambda n: self.classes.get(n, ClassDef()).parents | equal.get(n, set()))

    def ancestors(self, name: str) -> set[str]:
        """Strict ancestors by declared parents only."""
        return self._closure(name, lambda n: self.classes.get(n, ClassDef()).parents) - {name}

    def is_subclass(self, a: str, b: str) -> bool:
        return b in self.superclasses(a)

    def disjoint_pairs(self) -> list[tuple[str, str]]:
        return sorted({tuple(sorted((a, b))) for a, c in self.classes.items() for b in c.disjoint})

    def problems(self) -> list[str]:
        """Loops of parents, and disjoint classes with a common descendant."""
        out = [f"loop at {n}" for n in self.classes if any(n in self.ancestors(p) | {p} for p in self.classes[n].parents)]
        return out + [f"{a} and {b} are disjoint but share descendants" for a, b in self.disjoint_pairs() if self.subclasses(a) & self.subclasses(b)]

    def is_equivalent(self, a: str, b: str) -> bool:
        return b in self._closure(a, lambda n: self._equals().get(n, set()))

    def is_disjoint(self, a: str, b: str) -> bool:
        """Whether the classes, or ancestors of theirs, are declared disjoint."""
        up = lambda n: self.ancestors(n) | {n}
        return any((x in up(a) and y in up(b)) or (y in up(a) and x in up(b)) for x, y in self.disjoint_pairs())

    def expand(self, name: str, depth: int = 3) -> list[tuple[str, str, int]]:
        """(class, "ancestor", "descendant" or "synonym", levels) up to `depth` (10 at most) levels away; synonyms are equivalents."""
        down: dict[str, set[str]] = {}
        for c, d in self.classes.items():
            for p in d.parents:
                down.setdefault(p, set()).add(c)
        out = [(e, "synonym", 0) for e in sorted(self._equals().get(name, set()))]
        for kind, step in (("ancestor", lambda n: self.classes.get(n, ClassDef()).parents), ("descendant", lambda n: down.get(n, set()))):
            seen, front = {name}, {name}
            for k in range(1, min(depth, 10) + 1):
                front = {x for n in front for x in step(n)} - seen
                seen |= front
                out += [(x, kind, k) for x in sorted(front)]
        return out

    def violations(self, cls: str, rows: DataFrame) -> DataFrame:
        """Rows that lack a required property of the class or its ancestors, with `missing` naming them."""
        own = self.ancestors(cls) | {cls}
        need = [p for p, d in self.properties.items() if d.required and d.domain in own]
        missing = F.filter(F.array(*[F.when(F.col(p).isNull() if p in rows.columns else F.lit(True), F.lit(p)) for p in need] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
        return rows.withColumn("missing", missing).where(F.size("missing") > 0)


@dataclass
class Restriction:
    """What individuals of a class must meet by a property: some (a value of class `value` exists), all (all values are
    of class `value`), has (the value `value` exists), min, max or exact (so many distinct values)."""

    cls: str
    property: str
    kind: str
    value: str | int


def unmet(facts: DataFrame, o: Ontology, restrictions: list[Restriction]) -> DataFrame:
    """(s, cls, property, kind): individuals of a class, its descendants and equivalents that don't meet a restriction on it.

    Values are counted once; a class counts with its descendants and equivalents. Only stated facts are looked at.
    """
    typed, out = facts.where(F.col("p") == TYPE).select("s", F.col("o").alias("c")).distinct(), None
    of = lambda c: typed.where(F.col("c").isin(sorted(o.subclasses(c))))
    for r in restrictions:
        own, got = of(r.cls).select("s").distinct(), facts.where(F.col("p") == r.property).select("s", "o").distinct()
        if r.kind in ("some", "all"):
            fit = of(str(r.value)).select(F.col("s").alias("o")).distinct()
            bad = own.join(got.join(fit, "o", "left_semi"), "s", "left_anti") if r.kind == "some" else own.join(got.join(fit, "o", "left_anti"), "s", "left_semi")
        elif r.kind == "has":
            bad = own.join(got.where(F.col("o") == str(r.value)), "s", "left_anti")
        elif r.kind in ("min", "max", "exact"):
            n = own.join(got.groupBy("s").agg(F.count(F.lit(1)).alias("n")), "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            bad = n.where({"min": F.col("n") < r.value, "max": F.col("n") > r.value, "exact": F.col("n") != r.value}[r.kind]).select("s")
        else:
            raise ValueError(f"unknown restriction {r.kind}")
        part = bad.select("s", F.lit(r.cls).alias("cls"), F.lit(r.property).alias("property"), F.lit(r.kind).alias("kind"))
        out = part if out is None else out.union(part)
    return out


def of_expression(facts: DataFrame, o: Ontology, kind: str, parts: list[str]) -> DataFrame:
    """(s): the members of a class expression: "union" or "intersection" of classes, or an "enum" of individuals."""
    typed = facts.where(F.col("p") == TYPE)
    members = [typed.where(F.col("o").isin(sorted(o.subclasses(c)))).select("s").distinct() for c in parts]
    if kind == "enum":
        return facts.where(F.col("s").isin(parts)).select("s").distinct()
    return reduce(DataFrame.union, members).distinct() if kind == "union" else reduce(lambda a, b: a.join(b, "s", "left_semi"), members)


def matched(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, limit: int | None = None) -> DataFrame:
    """The triples that agree with the parts that are given."""
    out = triples
    for c, v in (("s", s), ("p", p), ("o", o)):
        out = out if v is None else out.where(F.col(c) == v)
    return out if limit is None else out.limit(limit)


def added(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """Triples with those of rows, each once."""
    return triples.select("s", "p", "o").union(rows.select("s", "p", "o")).distinct()


def removed(triples: DataFrame, rows: DataFrame) -> DataFrame:
    return triples.join(rows.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti")


def closure_pairs(links: DataFrame) -> DataFrame:
    """(child, ancestor): transitive closure of (child, parent) links, doubling its reach each round; loops are safe."""
    from quillon.operators.hierarchy import ancestor_pairs

    l1 = links.select(F.col("child").alias("n"), F.col("parent").alias("p")).where("n is not null and p is not null").distinct()
    return ancestor_pairs(l1).select(F.col("n").alias("child"), F.col("anc").alias("ancestor"))


MAX_PAIRS = 100_000


def _lookup(facts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pairs of the schema as a table; it is broadcast up to MAX_PAIRS pairs, and shuffled beyond."""
    table = facts.sparkSession.createDataFrame(pairs or [], "k string, v string")
    return F.broadcast(table) if len(pairs) <= MAX_PAIRS else table


def cax_sco(facts: DataFrame, o: Ontology) -> DataFrame:
    """x type C gives x type every ancestor of C, and every equivalent that an ancestor declares."""
    pairs = [(c, t) for c in o.classes for a in o.ancestors(c) for t in {a} | o.classes[a].equivalents if t != c]
    return facts.where(F.col("p") == TYPE).join(_lookup(facts, pairs), F.col("o") == F.col("k")).select("s", "p", F.col("v").alias("o"))


def cax_eqc(facts: DataFrame, o: Ontology) -> DataFrame:
    """x type C gives x type every equivalent that C declares."""
    pairs = [(c, e) for c, d in o.classes.items() for e in d.equivalents]
    return facts.where(F.col("p") == TYPE).join(_lookup(facts, pairs), F.col("o") == F.col("k")).select("s", "p", F.col("v").alias("o"))


def _properties(facts: DataFrame, pairs: list[tuple[str, str]], swap: bool = False) -> DataFrame:
    j = facts.where(F.col("p") != TYPE).join(_lookup(facts, pairs), F.col("p") == F.col("k"))
    return j.select(F.col("o").alias("s"), F.col("v").alias("p"), F.col("s").alias("o")) if swap else j.select("s", F.col("v").alias("p"), "o")


def prp_spo(facts: DataFrame, o: Ontology) -> DataFrame:
    """x P y gives x Q y for every super-property Q of P."""
    return _properties(facts, [(p, a) for p in o.properties for a in o._closure(p, lambda n: o.properties.get(n, PropertyDef()).parents) - {p}])


def prp_eqp(facts: DataFrame, o: Ontology) -> DataFrame:
    """x P y gives x Q y where P and Q are equivalent, both ways."""
    pairs = {(p, e) for p, d in o.properties.items() for e in d.equivalents}
    return _properties(facts, sorted(pairs | {(b, a) for a, b in pairs}))


def prp_inv(facts: DataFrame, o: Ontology) -> DataFrame:
    """x P y gives y Q x where Q is the inverse of P, both ways."""
    pairs = {(p, d.inverse) for p, d in o.properties.items() if d.inverse}
    return _properties(facts, sorted(pairs | {(b, a) for a, b in pairs}), swap=True)


def prp_symp(facts: DataFrame, o: Ontology) -> DataFrame:
    """x P y gives y P x for symmetric P."""
    return _properties(facts, [(p, p) for p, d in o.properties.items() if d.symmetric], swap=True)


def prp_trp(facts: DataFrame, o: Ontology, others: DataFrame | None = None) -> DataFrame:
    """x P y and y P z give x P z for transitive P, never x P x; y P z may come from `others` instead of the facts."""
    mine = F.col("p").isin([p for p, d in o.properties.items() if d.transitive] or [""])
    return facts.where(mine).alias("a").join((facts if others is None else others).where(mine).alias("b"), (F.col("a.p") == F.col("b.p")) & (F.col("a.o") == F.col("b.s")) & (F.col("a.s") != F.col("b.o"))).select("a.s", "a.p", "b.o")


RULES = {"cax-sco": cax_sco, "cax-eqc": cax_eqc, "prp-spo": prp_spo, "prp-eqp": prp_eqp, "prp-inv": prp_inv, "prp-trp": prp_trp, "prp-symp": prp_symp}


def inferred(facts: DataFrame, o: Ontology, *, rules: list[str] | None = None, max_rounds: int = 100, custom: dict | None = None, max_facts: int | None = None) -> DataFrame:
    """(s, p, o, rule, round): the facts and all that follow, each with the rule and round that first gave it (null and 0 if stated).

    Rules in the order of RULES, then custom ones (facts, ontology) -> facts; where several give a fact in one
    round the first by name stands. Semi-naive: rules see the last round's facts only (transitivity joins them with
    all others; custom rules see all), and only new facts are written.
    """
    use = {k: f for k, f in RULES.items() if rules is None or k in rules} | (custom or {})
    stated = cut(facts.select("s", "p", "o").distinct().withColumns({"rule": F.lit(None).cast("string"), "round": F.lit(0)}))
    parts, fresh, total = [stated], stated, None if max_facts is None else stated.count()
    for k in range(1, max_rounds + 1):
        base, last, new = reduce(DataFrame.union, parts).select("s", "p", "o"), fresh.select("s", "p", "o"), None
        for name, f in use.items():
            if f is prp_trp:  # joins facts with facts: the last round's with all others, either way round
                part = prp_trp(last, o, base).union(prp_trp(base, o, last)) if k > 1 else prp_trp(base, o)
            else:  # the other rules follow from one fact each; of custom ones that isn't known
                part = f(last if name in RULES else base, o)
            part = part.select("s", "p", "o").withColumn("rule", F.lit(name))
            new = part if new is None else new.union(part)
        fresh = cut(new.groupBy("s", "p", "o").agg(F.min("rule").alias("rule")).join(base, ["s", "p", "o"], "left_anti").withColumn("round", F.lit(k)))
        n = fresh.count()
        if not n:
            break
        parts.append(fresh)
        if max_facts is not None:
            total += n
            if total > max_facts:
                raise ValueError(f"more than {max_facts} facts after {k} rounds")
    return reduce(DataFrame.union, parts)


def inconsistent(facts: DataFrame, o: Ontology) -> DataFrame:
    """(s, a, b): individuals typed with two disjoint classes."""
    t = facts.where(F.col("p") == TYPE).select("s", "o").distinct()
    pairs = _lookup(facts, o.disjoint_pairs())
    return t.alias("x").join(pairs, F.col("x.o") == F.col("k")).join(t.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("y.o") == F.col("v"))).select("x.s", F.col("k").alias("a"), F.col("v").alias("b"))


def explained(known: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """(s, p, o, status, rule, round) of one fact, stated or inferred; no row if it doesn't hold."""
    hit = known.where((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o))
    return hit.select("s", "p", "o", F.when(F.col("rule").isNull(), "stated").otherwise("inferred").alias("status"), "rule", "round")


def derivation(known: DataFrame, o: Ontology, s: str, p: str, obj: str, max_steps: int = 20) -> DataFrame:
    """(step, s, p, o, rule, premises): how a fact follows, itself first; premises are the facts that its rule used, as texts.

    Walked back on the driver, a fact at a time, from the rule and round that inferred() kept; of several premises that
    would do, those of the earliest rounds, then the smallest. No row if the fact doesn't hold; an empty
    list where it is stated or its rule is a custom one.
    """
    spark, rows, todo, seen = known.sparkSession, [], [(s, p, obj)], set()
    while todo and len(rows) < max_steps:
        fact = todo.pop(0)
        if fact in seen:
            continue
        seen.add(fact)
        hit = known.where((F.col("s") == fact[0]) & (F.col("p") == fact[1]) & (F.col("o") == fact[2])).first()
        if hit is None:
            continue
        used = [] if hit["rule"] is None else _premises(known, o, fact, hit["rule"], hit["round"])
        rows.append((len(rows) + 1, *fact, hit["rule"], [" ".join(f) for f in used]))
        todo += used
    return spark.createDataFrame(rows, "step int, s string, p string, o string, rule string, premises array<string>")


def _premises(known: DataFrame, o: Ontology, fact: tuple, rule: str, turn: int) -> list[tuple]:
    s, p, v = fact
    before = known.where(F.col("round") < turn)
    if rule == "prp-trp":
        a, b = before.where((F.col("s") == s) & (F.col("p") == p)), before.where((F.col("o") == v) & (F.col("p") == p))
        mid = a.select(F.col("o").alias("m"), F.col("round").alias("r")).join(b.select(F.col("s").alias("m"), F.col("round").alias("q")), "m").orderBy(F.col("r") + F.col("q"), "m").first()
        return [(s, p, mid["m"]), (mid["m"], p, v)] if mid else []
    if rule not in RULES:
        return []
    pair = ((F.col("s") == s) & (F.col("o") == v)) | ((F.col("s") == v) & (F.col("o") == s))
    near = before.where((F.col("s") == s) & (F.col("p") == TYPE) if rule.startswith("cax") else pair)
    for r in near.orderBy("round", "s", "p", "o").collect():  # the types of one individual, or the facts between two
        one = known.sparkSession.createDataFrame([(r["s"], r["p"], r["o"])], "s string, p string, o string")
        if fact in {tuple(x) for x in RULES[rule](one, o).select("s", "p", "o").collect()}:
            return [(r["s"], r["p"], r["o"])]
    return []


def gap_report(relation: DataFrame, entities: DataFrame, key: str, source: str = "source", target: str = "target") -> DataFrame:
    """(edges, endpoints, resolved, percent): how many of a relation's endpoints exist among the entities; 100 when empty."""
    ends = relation.select(F.explode(F.array(source, target)).alias("k")).where("k is not null").distinct()
    known = entities.select(F.col(key).alias("k"), F.lit(1).alias("hit")).distinct()
    got = ends.join(known, "k", "left").agg(F.count(F.lit(1)).alias("endpoints"), F.count("hit").alias("resolved"))
    n = relation.agg(F.count(F.lit(1)).alias("edges"))
    return n.crossJoin(F.broadcast(got)).withColumn("percent", F.when(F.col("endpoints") == 0, 100.0).otherwise(F.round(100.0 * F.col("resolved") / F.col("endpoints"), 4)))  # one row


def bridge(a: DataFrame, a_name: str, b: DataFrame, b_name: str, mode: str = "exact") -> DataFrame:
    """Rows of a and b whose names match under bridge_score, with score; column names must differ. Names meet by an
    equal key: the name, its lower case, or its first character; contains compares all pairs and refuses where
    b has more than MAX_PAIRS rows."""
    x, y = F.col(a_name), F.col(b_name)
    if mode == "contains":
        if b.limit(MAX_PAIRS + 1).count() > MAX_PAIRS:
            raise ValueError(f"contains compares all pairs: more than {MAX_PAIRS} names")
        pairs = a.join(F.broadcast(b), F.contains(x, y) | F.contains(y, x))
    else:
        key = {"exact": lambda c: c, "case_insensitive": F.lower, "prefix": lambda c: F.substring(c, 1, 1)}[mode]
        pairs = a.join(b, key(x) == key(y))
    return pairs.withColumn("score", bridge_score(x, y, mode)).where("score is not null")


def bridge_score(a: Column, b: Column, mode: str) -> Column:
    """Null where the names don't match; else 1 for exact, case_insensitive and contains, the share of the common prefix for prefix."""
    if mode == "exact":
        return F.when(a == b, 1.0)
    if mode == "case_insensitive":
        return F.when(F.lower(a) == F.lower(b), 1.0)
    if mode == "contains":
        return F.when(F.contains(a, b) | F.contains(b, a), 1.0)
    if mode == "prefix":
        n = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
        return F.when((n > 0) & (F.least(F.length(a), F.length(b)) > 0), n / F.greatest(F.octet_length(a), F.octet_length(b)))
    raise ValueError(f"unknown mode {mode}")

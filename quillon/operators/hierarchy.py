"""Parent-child links to full hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import cut, tidy_name


def class_links(rows: DataFrame, *, name: str = "class_name", parents: str = "superclasses") -> tuple[DataFrame, DataFrame]:
    """The names of the classes (n) and their links (n, p), among them those to parents that are never defined.

    Names are trimmed and lower-cased; rows of a null or blank name are left out, all rows of a name together
    define the class. Null and blank parents and null or empty lists give no link.
    """
    r = rows.select(tidy_name(name).alias("n"), F.col(parents).alias("ps")).where("n is not null")
    links = r.select("n", F.explode("ps").alias("p")).select("n", tidy_name("p").alias("p")).where("p is not null").distinct()
    return r.select("n").distinct(), links


def class_graph(rows: DataFrame, *, name: str, parents: str) -> tuple[DataFrame, DataFrame]:
    """Classes (id, name) and links (n, p) by id, under the rules of class_links. Ids are in the order of the names."""
    names, links = class_links(rows, name=name, parents=parents)
    nodes = cut(names.orderBy("n").select(F.monotonically_increasing_id().alias("id"), F.col("n").alias("name")))
    own, up = nodes.select(F.col("id").alias("a"), F.col("name").alias("n")), nodes.select(F.col("id").alias("b"), F.col("name").alias("p"))
    return nodes, cut(links.join(own, "n").join(up, "p").select(F.col("a").alias("n"), F.col("b").alias("p")))


def _climb(base: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, endless): base's pairs (n, top), carried down to every node from which links (n, p) lead to base's n, and
    the nodes (n) that are in a loop or below one.

    Reach doubles: round k extends the pairs found within 2^k levels by the walks over exactly 2^k levels, so a chain
    of a million levels takes 20 rounds. Walks thin out as levels end; a node whose longest walk has m levels has nodes with
    every smaller length on that walk, so once a round loses no node, all nodes left walk forever. Once a round
    finds no pair either, none lies further: its shortest walk would pass a node that this round had found.
    """
    found, jump, alive = cut(base.select("n", "top").distinct()), links, None
    while True:
        more = jump.join(found.select(F.col("n").alias("p"), "top"), "p").select("n", "top").distinct()
        fresh = cut(more.join(found, ["n", "top"], "left_anti"))
        jump = cut(jump.alias("x").join(jump.alias("y"), F.col("x.p") == F.col("y.n")).select("x.n", "y.p").distinct())
        now = jump.select("n").distinct().count()
        if not now:
            return found.union(fresh), jump.select("n")
        if now == alive and fresh.isEmpty():
            return found, jump.select("n").distinct()
        found, alive = found.union(fresh), now


def find_loops(links: DataFrame, below: DataFrame) -> DataFrame:
    """(n, loop): members of loops, a loop being named by its smallest member; below: the nodes in or below loops."""
    inner = links.join(below, "n", "left_semi").join(below.select(F.col("n").alias("p")), "p", "left_semi").select("n", "p")
    nothing = inner.select("n", F.col("p").alias("top")).limit(0)
    _, above = _climb(nothing, cut(inner.select(F.col("p").alias("n"), F.col("n").alias("p"))))
    above = cut(above)
    core = inner.join(above, "n", "left_semi").join(above.select(F.col("n").alias("p")), "p", "left_semi").select("n", "p")
    reach = ancestor_pairs(core).select("n", F.col("anc").alias("p"))  # only nodes on loops or between two loops are left here
    mutual = reach.join(reach.select(F.col("p").alias("n"), F.col("n").alias("p")), ["n", "p"], "left_semi")
    return cut(mutual.groupBy("n").agg(F.min("p").alias("loop")))


def _loops(nodes: DataFrame, links: DataFrame) -> DataFrame:
    nothing = nodes.select(F.col("id").alias("n"), F.col("id").alias("top")).limit(0)
    return find_loops(links, cut(_climb(nothing, links)[1]))


def _named(df: DataFrame, nodes: DataFrame, **columns: str) -> DataFrame:
    """Names in place of ids: new column = column of ids (null stays null)."""
    for new, old in columns.items():
        df = df.join(nodes.select(F.col("id").alias(old), F.col("name").alias(new)), old, "left").drop(old)
    return df


def tops(rows: DataFrame, *, name: str = "class_name", parents: str = "superclasses") -> DataFrame:
    """(class_name, top_name): every root and every loop that a class is, is in, or has among its ancestors.

    Level-wise frontier joins from the roots downwards, each round covering twice the levels of the one before
    (see _climb); classes that no round ends are in or below a loop, and loops are carried down as roots are. Names
    are numbered first, so that only numbers are shuffled.
    Rules for names and lists: class_links. A root is a class without a defined parent; a class that is only its
    own parent is a loop, not a root. An empty table gives no rows; repeated rows and extra columns change nothing.
    """
    nodes, links = class_graph(rows, name=name, parents=parents)
    roots = nodes.select(F.col("id").alias("n")).join(links, "n", "left_anti").select("n", F.col("n").alias("top"))
    clear, below = _climb(roots, links)
    below = cut(below)
    out = clear
    if not below.isEmpty():
        loops = find_loops(links, below)
        inner = cut(links.join(below, "n", "left_semi").join(below.select(F.col("n").alias("p")), "p", "left_semi").select("n", "p"))
        out = clear.union(_climb(loops.select("n", F.col("loop").alias("top")), inner)[0])
    return _named(out, nodes, class_name="n", top_name="top")


def ancestor_pairs(links: DataFrame) -> DataFrame:
    """(n, anc, levels): all ancestors with the fewest levels between; members of a loop are their own and each other's."""
    found, far = cut(links.select("n", F.col("p").alias("anc"), F.lit(1).cast("long").alias("levels"))), 1
    while True:
        # a shortest way of more than `far` levels begins with one of exactly `far`, so in a tree every pair is made once
        edge = found.where(F.col("levels") == far)
        if edge.isEmpty():
            return found
        step = edge.alias("x").join(found.alias("y"), F.col("x.anc") == F.col("y.n")).select("x.n", "y.anc", (F.col("x.levels") + F.col("y.levels")).alias("levels"))
        found, far = cut(found.union(step).groupBy("n", "anc").agg(F.min("levels").alias("levels"))), 2 * far


def descendants(rows: DataFrame, *, name: str = "class_name", parents: str = "superclasses") -> DataFrame:
    """(class_name, descendant, levels): all descendants of each class with the fewest levels between.

    Members of a loop are descendants of each other and each of every class above; no class is its own.
    """
    nodes, links = class_graph(rows, name=name, parents=parents)
    return _named(ancestor_pairs(links).where("n != anc"), nodes, class_name="anc", descendant="n").select("class_name", "descendant", "levels")


def hierarchy(rows: DataFrame, *, name: str = "class_name", parents: str = "superclasses", members: bool = False) -> DataFrame:
    """One row per class: depth, number of ancestors and descendants, its loop.

    A loop counts as one node whose members share their figures; with `members`, all figures are those of
    descendants(), where each member counts. depth is the fewest levels to a root above (0
    for a root; null where no root is above). Columns: class_name, depth, ancestors, descendants, loop (null
    outside loops).
    """
    nodes, links = class_graph(rows, name=name, parents=parents)
    loops, ids = _loops(nodes, links), nodes.select(F.col("id").alias("n"))
    if members:
        pairs = ancestor_pairs(links).where("n != anc")
    else:  # loops become single nodes
        tag = lambda end: loops.select(F.col("n").alias(end), F.col("loop").alias(f"l{end}"))
        whole = links.join(tag("n"), "n", "left").join(tag("p"), "p", "left").select(F.coalesce("ln", "n").alias("n"), F.coalesce("lp", "p").alias("p"))
        pairs = ancestor_pairs(whole.where("n != p").distinct())
    roots = ids.join(links, "n", "left_anti")
    depth = pairs.join(roots.select(F.col("n").alias("anc")), "anc", "left_semi").groupBy("n").agg(F.min("levels").alias("depth"))
    depth = depth.union(roots.select("n", F.lit(0).cast("long")))
    up = pairs.groupBy("n").agg(F.count(F.lit(1)).alias("ancestors"))
    down = pairs.groupBy(F.col("anc").alias("n")).agg(F.count(F.lit(1)).alias("descendants"))
    base = ids.join(loops, "n", "left").select(F.col("n").alias("class"), (F.col("n") if members else F.coalesce("loop", "n")).alias("n"), "loop")
    all_ = reduce(lambda x, y: x.join(y, "n", "left"), (depth, up, down), base)
    out = all_.select("class", "depth", F.coalesce("ancestors", F.lit(0)).alias("ancestors"), F.coalesce("descendants", F.lit(0)).alias("descendants"), F.col("loop").alias("ring"))
    return _named(out, nodes, class_name="class", loop="ring")


def full_paths(rows: DataFrame, *, name: str = "class_name", parents: str = "superclasses") -> DataFrame:
    """(class_name, top_name, path, levels): every path from a root down to a class that meets no member of a loop.

    A path is an array of names, root first. Paths are extended by joins that double in length; a class with
    several parents has a path for each way up. Members of loops have no such path; classes below loops have
    those of their ways up that touch none. all_paths() has the ways through and into loops too.
    """
    names, links, loops = _named_links(rows, name, parents)
    members = loops.select("n")
    free = links.join(members, "n", "left_anti").join(members.select(F.col("n").alias("p")), "p", "left_anti").select("n", "p")
    done = names.join(links, "n", "left_anti").select("n", F.array("n").alias("path"))
    jump = free.select("n", "p", F.array("n").alias("way"))  # way: the names from below p down to n
    while True:
        done = cut(done.union(jump.join(done.select(F.col("n").alias("p"), "path"), "p").select("n", F.concat("path", "way"))))
        jump = cut(jump.alias("x").join(jump.alias("y"), F.col("x.p") == F.col("y.n")).select("x.n", "y.p", F.concat("y.way", "x.way").alias("way")))
        if jump.isEmpty():
            return done.select(F.col("n").alias("class_name"), F.col("path")[0].alias("top_name"), "path", (F.size("path") - 1).cast("long").alias("levels"))


def _named_links(rows: DataFrame, name: str, parents: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names (n), links (n, p) and members of loops (n, loop), all by name."""
    nodes, links = class_graph(rows, name=name, parents=parents)
    loops = _named(_loops(nodes, links).withColumnsRenamed({"n": "a", "loop": "b"}), nodes, n="a", loop="b")
    by_name = _named(links.withColumnsRenamed({"n": "a", "p": "b"}), nodes, n="a", p="b")
    return nodes.select(F.col("name").alias("n")), cut(by_name), cut(loops)


def all_paths(rows: DataFrame, *, name: str = "class_name", parents: str = "superclasses") -> DataFrame:
    """(class_name, top_name, path, levels, loop): every way up from every class that meets no class twice, top first.

    A way ends at a root (top_name; loop is null), or where a parent already lies on it: then it ends in a loop,
    which loop and top_name name by its smallest member. So every class has a row, and the top_names of a class
    are those of tops(). Ways through a loop to a root above it are kept. Joins double in length as in
    full_paths; tightly knit loops have as many ways as there are orders to walk them.
    """
    names, links, own = _named_links(rows, name, parents)
    roots = names.join(links, "n", "left_anti")
    back = links.join(own, "n").join(own.select(F.col("n").alias("p"), F.col("loop").alias("l2")), "p").where("loop = l2")  # links inside a loop
    done = roots.select("n", F.array("n").alias("path"), F.lit(None).cast("string").alias("again"), F.lit(None).cast("string").alias("loop"))
    done = done.union(back.select("n", F.array("n").alias("path"), F.col("p").alias("again"), "loop"))  # again: must lie further down
    jump = links.where("n != p").select("n", "p", F.array("n").alias("way"))
    while True:
        more = jump.join(done.withColumnRenamed("n", "p"), "p").where(~F.arrays_overlap("path", "way")).select("n", F.concat("path", "way"), "again", "loop")
        done = cut(done.union(more))
        # the lower way's upper end, y.n = x.p, is the last name of y.way; x.way and y.way and y.p must share none
        pair = jump.alias("x").join(jump.alias("y"), F.col("x.p") == F.col("y.n")).where(~F.arrays_overlap("x.way", "y.way") & ~F.array_contains("x.way", F.col("y.p")))
        jump = cut(pair.select("x.n", "y.p", F.concat("y.way", "x.way").alias("way")))
        if jump.isEmpty():
            break
    free, caught = done.where("again is null").drop("again"), done.where("array_contains(path, again)").drop("again")
    done = free.union(caught.distinct())  # several parents of the last class may lie on the way
    return done.select(F.col("n").alias("class_name"), F.coalesce("loop", F.col("path")[0]).alias("top_name"), "path", (F.size("path") - 1).cast("long").alias("levels"), "loop")

"""The order in which a forest of any size and depth loses its leaves, the first of them always first.

A tree hangs from its last vertex, which stays. A vertex goes when all below it have gone: at once after them, if it comes
before one of them in the order of vertices, else in its turn. So the order is that of (the last vertex in its subtree, the
distance to that one), and the vertex that stays follows those of its last other one.

Both are found in rounds. Leaves hand them to the vertex they hang from and go; where leaves are few, vertices of two
neighbours go too, not two beside each other, and leave an edge that knows the last vertex inside it and how far it is from
either end. So each round takes a good part of what is left, and the way back gives the vertices inside edges theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.durable import Stored, numbered, replaced
from .components import linked


def _pair(x, y) -> list[Column]:
    return [F.least(x, y).alias("g_a"), F.greatest(x, y).alias("g_b")]


def _later(*values: tuple) -> Column:
    """Of values (last vertex, distance) the one of the last vertex; -1 is none, and no vertex is there twice."""
    return F.greatest(*(F.struct(F.col(m).alias("m") if isinstance(m, str) else m.alias("m"), d.alias("l")) for m, d in values))


def _with_held(vertices: DataFrame, held: DataFrame | None) -> DataFrame:
    """Vertices v with the value, as ``own``, of all that has gone into each and of itself."""
    if held is None:
        return vertices.withColumn("own", F.struct(F.col("v").alias("m"), F.lit(0).cast("long").alias("l")))
    h = held.select(F.col("v").alias("h_v"), F.col("m").alias("h_m"), F.col("l").alias("h_l"))
    met = vertices.join(h, F.col("v") == F.col("h_v"), "left")
    return met.withColumn("own", _later(("v", F.lit(0).cast("long")), (F.coalesce("h_m", F.lit(-1)), F.coalesce("h_l", F.lit(0))))).drop("h_v", "h_m", "h_l")


def _edge(edges: DataFrame, k: int) -> DataFrame:
    return edges.select(*(F.col(c).alias(f"{c}{k}") for c in ("a", "b", "e", "len", "m", "da", "db")))


def _squeezed(free: DataFrame, edges: DataFrame, held: DataFrame | None, turn: int) -> DataFrame:
    """Vertices of two neighbours x and y none of which goes in this round, with the edges there."""
    key = lambda leaf: F.struct(leaf.alias("leaf"), F.xxhash64("v", F.lit(turn)).alias("h"), F.col("v").alias("k"))
    near = free.select("v", key(F.col("k") == 1).alias("key"))
    n1, n2 = (near.select(F.col("v").alias(f"v{i}"), F.col("key").alias(f"key{i}")) for i in (1, 2))
    chain = free.where("k = 2").select("v", F.col("lo").alias("x"), F.col("hi").alias("y"), key(F.lit(False)).alias("key"))
    chain = chain.join(n1, F.col("x") == F.col("v1"), "left").join(n2, F.col("y") == F.col("v2"), "left")
    chain = chain.where("(key1 is null or key1 < key) and (key2 is null or key2 < key)").select("v", "x", "y")
    for i, end in ((1, "x"), (2, "y")):
        chain = chain.join(_edge(edges, i), (F.least("v", end) == F.col(f"a{i}")) & (F.greatest("v", end) == F.col(f"b{i}")))
        first = F.col(f"a{i}") == F.col("v")
        chain = chain.withColumn(f"to{i}", F.when(first, F.col(f"da{i}")).otherwise(F.col(f"db{i}"))).withColumn(f"out{i}", F.when(first, F.col(f"db{i}")).otherwise(F.col(f"da{i}")))
    kept = [f"{c}{i}" for i in (1, 2) for c in ("e", "len", "m", "to", "out")]
    return _with_held(chain.select("v", "x", "y", *kept), held)


def leaf_order(g: Graph) -> DataFrame | None:
    """(id, position) of a forest as ``order.least_degree_order`` has it, vertices without edges first; nothing if there is a cycle."""
    no = Stored(numbered(g.vertices.select("id", "ord"), ["ord", "id"], "no"), "numbers")
    s, t = (no.df.select(F.col("id").alias(f"_{c}"), F.col("no").alias(c)) for c in "st")
    links = Stored(g.edges.select("src", "dst").join(s, F.col("src") == F.col("_s")).join(t, F.col("dst") == F.col("_t")).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")), "links")
    labels = linked(links.df)
    tops = Stored(labels.df.groupBy("c").agg(F.count("*").alias("n"), F.max("v").alias("top")), "tops")
    labels.drop()
    n, trees = tops.df.agg(F.sum("n"), F.count("*")).first()
    if links.df.count() != (n or 0) - trees:
        return None
    number = lambda x: F.lit(x).cast("long")
    stored, edges, held = links, links.df.select("a", "b", number(None).alias("e"), number(1).alias("len"), number(-1).alias("m"), number(0).alias("da"), number(0).alias("db")), None
    raked: list[Stored] = []
    squeezed: list[Stored] = []
    turn = 0
    while True:
        ends = edges.select(F.col("a").alias("v"), F.col("b").alias("o")).union(edges.select("b", "a"))
        degree = Stored(ends.groupBy("v").agg(F.count("*").alias("k"), F.min("o").alias("lo"), F.max("o").alias("hi")), "degrees")
        left, thin = degree.df.agg(F.count("*"), F.count_if(F.col("k") == 1)).first()
        if not left:
            degree.drop()
            break
        free = degree.df.where("k <= 2").join(tops.df.select("top"), F.col("v") == F.col("top"), "left_anti")
        hung = _with_held(free.where("k = 1").select("v", F.col("lo").alias("p")), held and held.df)
        if squeezed:
            hung = hung.join(_edge(edges, 1), (F.least("v", "p") == F.col("a1")) & (F.greatest("v", "p") == F.col("b1")))
            up = _later((F.col("own.m"), F.col("own.l") + F.col("len1")), ("m1", F.when(F.col("p") == F.col("a1"), F.col("da1")).otherwise(F.col("db1"))))
        else:
            hung, up = hung.withColumn("e1", number(None)), F.struct(F.col("own.m").alias("m"), (F.col("own.l") + 1).alias("l"))
        raked.append(Stored(hung.select("v", "own.m", "own.l", "p", F.col("e1").alias("e"), up.alias("up")), "raked"))
        out = raked[-1].df.select("v", "p")
        gone, pairs, more = out.select("v"), out.select(*_pair("v", "p")), None
        if 4 * thin < left:
            squeezed.append(Stored(_squeezed(free, edges, held and held.df, turn), "squeezed"))
            q = squeezed[-1].df
            gone = gone.union(q.select("v"))
            pairs = pairs.union(q.select(*_pair("v", "x"))).union(q.select(*_pair("v", "y")))
            inside = F.greatest(*(F.struct(m.alias("m"), x.alias("dx"), y.alias("dy")) for m, x, y in (
                (F.col("m1"), F.col("out1"), F.col("to1") + F.col("len2")),
                (F.col("own.m"), F.col("own.l") + F.col("len1"), F.col("own.l") + F.col("len2")),
                (F.col("m2"), F.col("to2") + F.col("len1"), F.col("out2")),
            )))
            more = q.select("x", "y", "v", (F.col("len1") + F.col("len2")).alias("len"), inside.alias("i")).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("v").alias("e"), "len", "i.m", F.col("i.dx").alias("da"), F.col("i.dy").alias("db"))
        rest = edges.join(pairs, (F.col("a") == F.col("g_a")) & (F.col("b") == F.col("g_b")), "left_anti")
        sent = raked[-1].df.select(F.col("p").alias("v"), "up.m", "up.l")
        sent = (sent if held is None else held.df.union(sent)).groupBy("v").agg(F.max(F.struct("m", "l")).alias("x")).select("v", "x.m", "x.l")
        held = replaced(held, sent.join(gone.select(F.col("v").alias("o")), F.col("v") == F.col("o"), "left_anti"), "held")
        stored = replaced(stored, rest if more is None else rest.union(more), "edges")
        edges = stored.df
        degree.drop()
        turn += 1
    found = [x.df.select("v", "m", "l") for x in raked] + ([held.df] if held else [])
    # the way back: from which end each edge is gone along, with the value there
    ways = [x.df.where("e is not null").select("e", F.col("v").alias("from"), "m", "l") for x in raked] if squeezed else []
    for q in reversed(squeezed):
        every = ways[0]
        for more in ways[1:]:
            every = every.union(more)
        w = every.select(F.col("e").alias("w"), "from", F.struct("m", "l").alias("at"))
        first = F.col("from") == F.col("x")
        value = lambda i: F.greatest("own", F.struct(F.col("at.m").alias("m"), (F.col("at.l") + F.col(f"len{i}")).alias("l")), F.struct(F.col(f"m{i}").alias("m"), F.col(f"to{i}").alias("l")))  # noqa: B023, E731
        met = Stored(q.df.join(w, F.col("v") == F.col("w")).select("v", "e1", "e2", first.alias("first"), "from", "at", F.when(first, value(1)).otherwise(value(2)).alias("now")), "inside").df
        found.append(met.select("v", "now.m", "now.l"))
        before, after = F.when(F.col("first"), F.col("e1")).otherwise(F.col("e2")), F.when(F.col("first"), F.col("e2")).otherwise(F.col("e1"))
        ways.append(met.select(before.alias("e"), "from", "at.m", "at.l").union(met.select(after, "v", "now.m", "now.l")).where("e is not null"))
    values = no.df.select(F.col("no"), "id")
    if found:
        every = found[0]
        for more in found[1:]:
            every = every.union(more)
        values = values.join(every, F.col("no") == F.col("v"), "left")
    else:
        values = values.withColumn("m", number(None)).withColumn("l", number(None))
    ordered = Stored(numbered(values.select("id", F.coalesce("m", F.lit(-1)).alias("m"), F.coalesce("l", "no").alias("l")), ["m", "l"], "position").select("id", "position"), "leaf-order").df
    for table in (no, stored, tops, *raked, *squeezed, *([held] if held else [])):
        table.drop()
    return ordered

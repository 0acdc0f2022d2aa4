"""Maximum flow beyond one task: push and relabel in supersteps.

Heights are exact distances, found by searching backward from the sink through what is left of the capacities, no farther
than to all that is held. A search takes each edge out of the rest when it comes to the first of its ends, so its levels are
tables of edges, each edge in one of them. Level by level from the highest, each vertex pushes what it holds over its edges
that lead one level down, and has then nothing more to receive. What is stuck then has a greater distance in the next phase,
so the phases end. When nothing that is held can reach the sink, the rest goes back to the source in the same way.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError, NegativeCapacityError
from ..graph import Graph
from ..plans.durable import Stored, cut, replaced

#: Tables of so many vertices at most go to every task; larger ones are dealt by key together with the edges.
SENT = 1_000_000
#: Edges of a vertex that are summed in one task; beyond, parts of so many are summed side by side, so that a hub is not one task's.
PART = 100_000
#: Ways of a level beyond which only those are put in order that lie near the place where what is held ends.
BANDED = 1_000_000
#: Searches store what they have not come to each time they have filtered it so often.
FOLD = 4
#: Edge a between the keys u and v; rf is left of its capacity, rb is its flow.
_EDGE = ("a", "u", "v", "cap", "rf", "rb")


def _keys(vertices: DataFrame) -> Callable[[str], Column]:
    """A whole number for each id: itself where it is one, else a hash by which no two vertices are alike."""
    if isinstance(vertices.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return lambda c: F.col(c).cast("long")
    ids = vertices.select("id").where("id is not null").distinct()
    for seed in itertools.count():
        key = lambda c, seed=seed: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(seed), F.col(c)))
        if ids.groupBy(key("id").alias("k")).count().where("count > 1").isEmpty():
            return key


def _met(rows: DataFrame, few: DataFrame, n: int, on: Column, how: str) -> DataFrame:
    """Rows joined to a table of n vertices, each there once."""
    return rows.join(F.broadcast(few) if n <= SENT else few.hint("shuffle_hash"), on, how)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


class _Few:
    """Some of all vertices as a table that joins read: themselves, or the others where only these are few enough to be sent."""

    def __init__(self, some: DataFrame, n: int, every: Every | None):
        self.some, self.n, self.stored = some.select("id"), n, None
        self.others = n > SENT and every is not None and every.n - n <= SENT
        if self.others:
            self.stored = Stored(every.df.join(self.some, "id", "left_anti"), "others")
            self.some, self.n = self.stored.df, self.stored.df.count()

    @property
    def sent(self) -> bool:
        return self.n <= SENT

    def marked(self, rows: DataFrame, on: str, mark: str) -> DataFrame:
        """Rows with a mark: whether the vertex in a column is one of them."""
        at = _met(rows, self.some.select(F.col("id").alias("_at")), self.n, F.col(on) == F.col("_at"), "left")
        met = (F.col(on).isNotNull() & F.col("_at").isNull()) if self.others else F.col("_at").isNotNull()
        return at.select(*rows.columns, met.alias(mark))

    def drop(self) -> None:
        if self.stored is not None:
            self.stored.drop()


class Every:
    """All vertices, stored as (id) by their keys, ends of edges among them."""

    def __init__(self, df: DataFrame):
        self.stored = Stored(df.where("id is not null").distinct(), "vertices")
        self.df = self.stored.df
        self.n = self.df.count()


def reached(ways: DataFrame, root: int, every: Every | None = None) -> DataFrame:
    """(id): the keys to which ways (at, to) lead from the root, itself included; all of them and the root are in ``every``, if that is given."""
    front = Stored(ways.sparkSession.range(1).select(F.lit(root).cast("long").alias("id")), "reached")
    known, n, found = [front], 1, 1
    while n and not (every is not None and found >= every.n):
        few, left = _Few(front.df, n, every), None
        near, old = ways, _all([x.df for x in known])
        if every is not None and every.n - found <= SENT:
            left = Stored(every.df.join(old, "id", "left_anti"), "left")
            near = near.join(F.broadcast(left.df), F.col("to") == F.col("id"), "left_semi")
        ahead = few.marked(near, "at", "met").where("met").select(F.col("to").alias("id")).where("id is not null").distinct()
        front = Stored(ahead if left is not None else ahead.join(old, "id", "left_anti"), "reached")
        n = front.df.count()
        found += n
        known.append(front)
        for table in (few, left):
            if table is not None:
                table.drop()
        if len(known) > 2 * FOLD:
            whole = Stored(_all([x.df for x in known]), "reached")
            for table in known:
                if table is not front:
                    table.drop()
            known = [whole]
    return _all([x.df for x in known])


def _marked(rest: DataFrame, root: int, front: _Few | None, shut: int) -> DataFrame:
    """Edges with kind: 0 not at the front, 1 no way to it, 2 a way to it of which something is left; forth where it leads from u to v."""
    at = rest
    for x in "uv":
        at = at.withColumn(f"m{x}", F.coalesce(F.col(x) == F.lit(root), F.lit(False))) if front is None else front.marked(at, x, f"m{x}")
    open_ = F.when(F.col("mv"), (F.col("rf") > 0) & (F.col("u") != F.lit(shut))).otherwise((F.col("rb") > 0) & (F.col("v") != F.lit(shut)))
    kind = F.when(~F.col("mu") & ~F.col("mv"), 0).when((F.col("mu") != F.col("mv")) & open_, 2).otherwise(1)
    return at.select(*_EDGE, F.col("mv").alias("forth"), kind.alias("kind"))


def _ways(near: DataFrame, dealt: str | None = None) -> DataFrame:
    """The edges of kind 2 with their direction (tail, head) and what is left in it, r; dealt by one of these, if asked."""
    pick = lambda a, b: F.when(F.col("forth"), F.col(a)).otherwise(F.col(b))
    made = {"tail": pick("u", "v"), "head": pick("v", "u"), "r": pick("rf", "rb")}
    rows = near.where("kind = 2").select(*_EDGE, "forth", *(made[c].alias(c) for c in [dealt] if c))
    if dealt:
        rows = rows.repartition(dealt)
    return rows.select(*_EDGE, "forth", *(F.col(c) if c == dealt else made[c].alias(c) for c in made))


def _bands(ways: DataFrame, held: DataFrame) -> DataFrame:
    """(id, x, n, low, high, b): over ways of turns below low all goes that they can take, b in sum, over those from high on nothing.

    Turns are even, so a vertex that holds a share of what its ways can take comes to its end near that share of the turns;
    where sums say that it does not come to it between low and high, these are all its turns.
    """
    q = F.col("x") / F.col("s")
    m = 3 * F.sqrt(q * (1 - q) / F.col("n")) + 1 / F.col("n")
    some = held.where("x > 0 and x < s").select(F.col("id").alias("t2"), F.col("x").alias("x2"), (q - m).alias("low"), (q + m).alias("high"))
    sums = ways.join(F.broadcast(some), F.col("tail") == F.col("t2")).groupBy("t2", "x2", "low", "high")
    sums = sums.agg(F.sum(F.when(F.col("turn") < F.col("low"), F.col("r")).otherwise(0.0)).alias("b"), F.sum(F.when(F.col("turn") < F.col("high"), F.col("r")).otherwise(0.0)).alias("b2"))
    low = F.when(F.col("b") <= F.col("x2"), F.col("low")).otherwise(-1.0)
    b = F.when(F.col("b") <= F.col("x2"), F.col("b")).otherwise(0.0)
    sums = sums.select("t2", low.alias("low"), F.when(F.col("b2") >= F.col("x2"), F.col("high")).otherwise(2.0).alias("high"), b.alias("b"))
    # the others give all or nothing
    end = F.when(F.col("x") >= F.col("s"), 2.0).otherwise(-1.0)
    pick = lambda c, other: F.coalesce(F.when(F.col("t2").isNotNull(), F.col(c)), other).alias(c)
    return held.join(sums, F.col("id") == F.col("t2"), "left").select("id", "x", "n", pick("low", end), pick("high", end), pick("b", F.lit(0.0)))


def _pushed(near: DataFrame, held: DataFrame, n: int, lent: list) -> DataFrame:
    """Ways with p, what n vertices that hold x push over them: all they can, or what they hold in the order of the edges' hashes.

    Tables that the rows are made of are added to ``lent``.
    """
    ways = _ways(near)
    facts = held.agg(F.max("n").alias("most"), F.sum("n").alias("ways"), F.count(F.when(F.col("x") < F.col("s"), 1)).alias("short")).first()
    if not facts["short"]:
        return ways.withColumn("p", F.col("r"))

    def shared(at: DataFrame, parted: bool) -> DataFrame:
        turn = F.xxhash64("u", "v")
        at = at.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / PART)) if parted else F.lit(0))
        first = W.partitionBy("tail", "part").orderBy(turn, "a").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum("r").over(first), F.lit(0.0))
        if parted:
            sums = at.where(F.col("n") > PART).groupBy(F.col("tail").alias("t2"), F.col("part").alias("part2")).agg(F.sum("r").alias("r2"))
            sums = sums.select("t2", "part2", F.sum("r2").over(W.partitionBy("t2").orderBy("part2").rowsBetween(W.unboundedPreceding, -1)).alias("before2"))
            at = at.withColumn("before", before).join(F.broadcast(sums), (F.col("tail") == F.col("t2")) & (F.col("part") == F.col("part2")), "left")
            before = F.col("before") + F.coalesce("before2", F.lit(0.0))
        return at.withColumn("p", F.greatest(F.least("r", F.col("x") - F.col("b") - before), F.lit(0.0))).select(*ways.columns, "p")

    same, hub = F.col("tail") == F.col("id"), F.col("n") > PART
    all_ = F.when(F.col("x") >= F.col("s"), F.col("r")).otherwise(0.0)
    some, rest = held.where("x > 0 and x < s").select("id", "x", "n", F.lit(0.0).alias("b")), held.where("x <= 0 or x >= s").select("id", "x", "s")
    if n <= SENT:
        if facts["ways"] <= BANDED:
            return _met(ways, rest, n, same, "inner").select(*ways.columns, all_.alias("p")).union(shared(_met(ways, some, n, same, "inner"), facts["most"] > PART))
        turned = ways.withColumn("turn", F.xxhash64("u", "v") / F.lit(2.0**64) + 0.5)
        lent.append(Stored(_bands(turned, held), "bands"))
        at = _met(turned, lent[-1].df, n, same, "inner")
        inside = (F.col("turn") >= F.col("low")) & (F.col("turn") < F.col("high"))
        whole = at.where(~inside).select(*ways.columns, F.when(F.col("turn") < F.col("low"), F.col("r")).otherwise(0.0).alias("p"))
        return whole.union(shared(at.where(inside), facts["most"] > PART))
    if facts["most"] <= PART:
        # dealt before what is made of an edge's columns is added to them
        dealt = _ways(near, "tail")
        return _met(dealt, rest, n, same, "inner").select(*ways.columns, all_.alias("p")).union(shared(_met(dealt, some, n, same, "inner"), False))
    whole = _met(ways, rest, n, same, "inner").select(*ways.columns, all_.alias("p"))
    hubs = F.broadcast(some.where(hub))  # one row for PART edges at least
    return whole.union(shared(ways.join(hubs, same), True)).union(shared(_met(ways, some.where(~hub), n, same, "inner"), False))


def _phase(parts: list, excess: Stored, root: int, shut: int, every: Every):
    """Tables of the edges, and what is held, after all that is held has gone toward the root as far as it can; None where nothing can."""
    left = excess.df.where((F.col("x") > 0) & ~F.col("id").isin(root, shut)).select("id")
    n_left, top, lazy = left.count(), 0, 0
    levels, waiting, front, rest = [], [], None, _all([df for _, df in parts])
    while n_left:
        marked = _marked(rest, root, front, shut)
        if (front is None or front.sent) and lazy < FOLD:
            near, lazy = Stored(marked.where("kind > 0"), "level"), lazy + 1
            rest = marked.where("kind = 0").select(*_EDGE)
        else:
            near, lazy = Stored(marked, "level"), 0
            rest = near.df.where("kind = 0").select(*_EDGE)
        tails = Stored(_ways(near.df).groupBy(F.col("tail").alias("id")).agg(F.sum("r").alias("s"), F.count("*").alias("n")), "tails")
        n = tails.df.count()
        levels.append((near, tails, n))
        if not n:
            break
        front = _Few(tails.df, n, every)
        waiting += [front, Stored(front.marked(left, "id", "met").where("not met").select("id"), "waiting")]
        left, before = waiting[-1].df, n_left
        n_left = left.count()
        if n_left < before:
            top = len(levels)
    after = []
    if top:
        rest = Stored(rest, "rest")
        after.append((rest, rest.df))
    for k in range(len(levels), 0, -1):
        near, tails, n = levels[k - 1]
        if top and k <= top:
            held = Stored(tails.df.join(excess.df.where("x > 0"), "id", "left").select("id", "s", "n", F.coalesce("x", F.lit(0.0)).alias("x")), "held")
            p, forth = F.col("p"), F.col("forth")
            rf, rb = F.when(forth, F.col("rf") - p).otherwise(F.col("rf") + p), F.when(forth, F.col("rb") + p).otherwise(F.col("rb") - p)
            lent = [held]
            push = Stored(_pushed(near.df, held.df, n, lent).select(*_EDGE[:-2], rf.alias("rf"), rb.alias("rb"), "forth", "p"), "pushes")
            gone = held.df.where("x > 0").select("id", -F.least("x", "s"))
            come = push.df.where("p > 0").groupBy(F.when(forth, F.col("v")).otherwise(F.col("u"))).agg(F.sum("p"))
            excess = replaced(excess, excess.df.union(gone).union(come).groupBy("id").agg(F.sum("x").alias("x")), "excess")
            for table in lent:
                table.drop()
            after += [(near, near.df.where("kind = 1").select(*_EDGE)), (push, push.df.select(*_EDGE))]
        elif top:
            after.append((near, near.df.where("kind > 0").select(*_EDGE)))
        else:
            near.drop()
        tails.drop()
    for table in waiting:
        table.drop()
    if not top:
        return None
    return after, excess


def _drop(parts: list) -> None:
    for table in {id(table): table for table, _ in parts}.values():
        table.drop()


class Solved:
    """A largest flow; ``edges`` is (a, u, v, cap, rf, rb), u and v being the keys of the ends, and rf what is left where rb flows.

    What is not named keeps no ids of edges and ends. Raises as the kernel does: for equal ends, capacities below 0 or undefined, and a path of unbounded capacity.
    """

    def __init__(self, g: Graph, source, sink, named: bool = True):
        if source == sink:
            raise GraphError("source and sink are the same")
        self.vertices, self.key = g.vertices, _keys(g.vertices)
        key, inf = self.key, F.lit(float("inf"))
        names = ["edge_id", "src", "dst"] if named else []
        given = g.edges.select(*names, F.col("weight").alias("cap"), key("src").alias("u"), key("dst").alias("v"), F.monotonically_increasing_id().alias("a"))
        self.given = Stored(given, "capacities")
        e = self.given.df
        bad = F.max(F.when(F.col("cap").isNull() | F.isnan("cap") | (F.col("cap") < 0), 1))
        facts = e.agg(bad.alias("bad"), F.coalesce(F.sum(F.when(F.col("cap") < inf, F.col("cap"))), F.lit(0.0)).alias("s"), F.max("cap").alias("m")).first()
        if facts["bad"]:
            raise NegativeCapacityError("capacities must be at least 0")
        kind, one = g.vertices.schema["id"].dataType, e.sparkSession.range(1)
        s, t = self.source, self.sink = [one.select(F.lit(x).cast(kind).alias("id")).select(key("id")).first()[0] for x in (source, sink)]
        ends = [e.select("u"), e.select("v"), g.vertices.select(key("id")), *(one.select(F.lit(x)) for x in (s, t))]
        every = self.every = Every(_all([x.toDF("id").distinct() for x in ends]))
        if facts["m"] == float("inf"):
            free = e.where(F.col("cap") == inf).select(F.col("u").alias("at"), F.col("v").alias("to"))
            if not reached(free, s, every).where(F.col("id") == F.lit(t)).isEmpty():
                raise GraphError("a path of unbounded capacity")
        # without such a path no flow is above the sum of the bounded capacities
        cap = F.least("cap", F.lit(facts["s"] + 1.0))
        first = F.coalesce((F.col("u") == F.lit(s)) & (F.col("v") != F.lit(s)), F.lit(False))
        parts = [(self.given, e.select(*_EDGE[:-2], F.when(first, 0.0).otherwise(cap).alias("rf"), F.when(first, cap).otherwise(0.0).alias("rb")))]
        excess = Stored(e.where(first).groupBy(F.col("v").alias("id")).agg(F.sum(cap).alias("x")), "excess")
        for root, shut in ((t, s), (s, t)):
            while (got := _phase(parts, excess, root, shut, every)) is not None:
                if parts[0][0] is not self.given:
                    _drop(parts)
                parts, excess = got
        excess.drop()
        self.edges = _all([df for _, df in parts])

    def named(self, keyed: DataFrame) -> DataFrame:
        """Rows (a, ...) with (edge_id, src, dst) as well."""
        return keyed.join(self.given.df.select("edge_id", "src", "dst", F.col("a").alias("a0")), F.col("a") == F.col("a0")).drop("a0")

    def into_sink(self) -> DataFrame:
        """(edge_id, src, flow) of the edges that lead to the sink."""
        at = F.col("v") == F.lit(self.sink)
        names = self.given.df.where(at).select("edge_id", "src", F.col("a").alias("a0"))
        return self.edges.where(at).join(names, F.col("a") == F.col("a0")).select("edge_id", "src", F.col("rb").alias("flow"))

    def with_cut(self) -> DataFrame:
        """(a, u, v, weight, flow, residual, in_cut): in_cut marks the edges that leave what the source still reaches."""
        e = self.edges
        forth = e.where("rf > 0").select(F.col("u").alias("at"), F.col("v").alias("to"))
        near = reached(forth.union(e.where("rb > 0").select(F.col("v").alias("at"), F.col("u").alias("to"))), self.source, self.every)
        # the edges meet the smaller side, which has one of their ends
        far = Stored(self.every.df.join(near, "id", "left_anti"), "far-side")
        sizes = near.count(), far.df.count()
        few, n = (near, sizes[0]) if sizes[0] < sizes[1] else (far.df, sizes[1])
        full = e.where("rf <= 0")  # as all edges of the cut are
        for x in "uv":
            full = _met(full, few.select(F.col("id").alias(f"f{x}")), n, F.col(x) == F.col(f"f{x}"), "left")
        leaves = (F.col("fu").isNotNull() & F.col("fv").isNull()) if sizes[0] < sizes[1] else (F.col("fu").isNull() & F.col("fv").isNotNull())
        out = full.select(*_EDGE, leaves.alias("in_cut")).union(e.where("rf > 0").select(*_EDGE, F.lit(False)))
        return out.select("a", "u", "v", F.col("cap").alias("weight"), F.col("rb").alias("flow"), (F.col("cap") - F.col("rb")).alias("residual"), "in_cut")


def push_relabel(g: Graph, source, sink) -> DataFrame:
    """(edge_id, flow, residual, in_cut) of a largest flow; capacities are the edges' ``weight``.

    in_cut marks the edges that leave what the source still reaches. Raises as ``Solved`` does.
    """
    found = Solved(g, source, sink)
    return cut(found.named(found.with_cut()).select("edge_id", "flow", "residual", "in_cut"), "flow")

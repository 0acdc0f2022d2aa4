"""Trails over all edges of a graph of any size.

Edges are paired at each vertex, what comes in with what goes out, so that they fall into circuits. Circuits that meet
are made one at the vertices of a spanning forest of vertices and circuits: there each circuit goes on as the next one
did. As that forest has no cycle, all turns are made at once. Temporary edges make vertices even first; a trail runs
from one of them to the next. Places along trails come from doubling how far each edge looks ahead.

Components of few edges are walked whole, many in a task, side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError
from ..graph import Graph
from ..plans.durable import Stored, numbered, replaced
from ..plans.iterate import supersteps
from .components import labels_of, linked
from .trees import minimum_spanning_forest

#: Edges of a component that a task walks whole, and of those that it takes at once.
LOCAL_EDGES, _CHUNK = 100_000, 100_000


def _within(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 within each value of ``by``, by one sort of all rows, so that a value is nobody's single task."""
    at = numbered(df, [*by, *order], "_no")
    first = at.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("_no").alias("_first"))
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    return at.join(first, same).withColumn(name, F.col("_no") - F.col("_first")).drop("_no", "_first", *(f"_{c}" for c in by))


def temporary_edges(g: Graph) -> DataFrame:
    """(src, dst): fewest edges that, added, make every component one closed trail; taken either way if g is undirected.

    Undirected: odd vertices of a component in order, by twos. Directed: what has more in-edges to what has more
    out-edges, in order.
    """
    v = g.vertices.select("id", "ord")
    part = labels_of(v, g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    if g.directed:
        ends = g.edges.select(F.col("src").alias("e"), F.lit(1).alias("s")).union(g.edges.select("dst", F.lit(-1)))
    else:
        ends = g.edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("e"), F.lit(1).alias("s"))
    over = ends.groupBy("e").agg(F.sum("s").alias("s"))
    odd = v.join(over, F.col("id") == F.col("e")).join(part.withColumnRenamed("id", "p"), F.col("id") == F.col("p"))
    if not g.directed:
        at = Stored(_within(odd.where("s % 2 = 1").select("label", "ord", "id"), ["label"], ["ord", "id"], "k"), "odd").df
        a = at.where("k % 2 = 0").select("label", "k", F.col("id").alias("src"))
        return a.join(at.select(F.col("label").alias("l2"), (F.col("k") - 1).alias("k2"), F.col("id").alias("dst")), (F.col("label") == F.col("l2")) & (F.col("k") == F.col("k2"))).select("src", "dst")
    units = odd.where("s <> 0").select("label", "ord", "id", F.signum("s").cast("int").alias("side"), F.explode(F.sequence(F.lit(1).cast("long"), F.abs("s"))).alias("u"))
    at = Stored(_within(units, ["label", "side"], ["ord", "id", "u"], "k"), "uneven").df
    a = at.where("side < 0").select("label", "k", F.col("id").alias("src"))
    return a.join(at.where("side > 0").select(F.col("label").alias("l2"), F.col("k").alias("k2"), F.col("id").alias("dst")), (F.col("label") == F.col("l2")) & (F.col("k") == F.col("k2"))).select("src", "dst")


def _turns(e: DataFrame, directed: bool) -> Stored:
    """(at, ein, eout): edges paired at each vertex, as arrivals and departures of darts.

    A dart is an edge in a direction, (edge, way); way 0 is from src to dst. Undirected, each pairing holds both ways.
    """
    dart = lambda way: F.struct(F.col("e").alias("e"), F.lit(way).alias("way"))
    if directed:
        ends = e.select(F.col("dst").alias("at"), F.lit(0).alias("side"), dart(0).alias("d")).union(e.select("src", F.lit(1), dart(0)))
        at = Stored(_within(ends, ["at", "side"], ["d"], "k"), "ends").df
        out = at.where("side = 1").select(F.col("at").alias("at2"), F.col("k").alias("k2"), F.col("d").alias("eout"))
        return Stored(at.where("side = 0").join(out, (F.col("at") == F.col("at2")) & (F.col("k") == F.col("k2"))).select("at", F.col("d").alias("ein"), "eout"), "turns")
    # both ends of each edge, named by the dart that arrives there
    ends = e.select(F.col("dst").alias("at"), dart(0).alias("d")).union(e.select("src", dart(1)))
    at = Stored(_within(ends, ["at"], ["d"], "k"), "ends").df
    out = at.where("k % 2 = 1").select(F.col("at").alias("at2"), (F.col("k") - 1).alias("k2"), F.col("d").alias("other"))
    leaving = F.struct(F.col("other.e").alias("e"), (1 - F.col("other.way")).alias("way"))
    return Stored(at.where("k % 2 = 0").join(out, (F.col("at") == F.col("at2")) & (F.col("k") == F.col("k2"))).select("at", F.col("d").alias("ein"), leaving.alias("eout")), "turns")


def _joined(turns: Stored) -> Stored:
    """The turns after those of a spanning forest are changed so that circuits that meet are one."""
    label = linked(turns.df.select(F.col("ein.e").alias("a"), F.col("eout.e").alias("b")))
    named = turns.df.join(label.df, F.col("ein.e") == F.col("v"), "left").select("at", "ein", "eout", F.coalesce("c", "ein.e").alias("c"))
    named = Stored(named, "circuits")
    label.drop()
    reps = Stored(named.df.groupBy("at", "c").agg(F.min(F.struct("ein", "eout")).alias("t")), "meetings")
    several = reps.df.groupBy(F.col("at").alias("m")).agg(F.count("*").alias("n")).where("n > 1").select("m")
    met = reps.df.join(several, F.col("at") == F.col("m"), "left_semi")
    tag = lambda kind, c: F.concat(F.lit(kind), F.to_json(F.struct(c)))
    links = Stored(met.select(tag("v", "at").alias("src"), tag("c", "c").alias("dst"), "at", "c", "t").withColumn("edge_id", F.concat_ws("|", "src", "dst")).withColumn("ord", F.col("edge_id")), "links")
    if links.df.isEmpty():
        return replaced(turns, named.df.select("at", "ein", "eout"), "turns")
    nodes = links.df.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    tree = minimum_spanning_forest(Graph(nodes.withColumn("ord", F.col("id")), links.df.select("edge_id", "ord", "src", "dst"), directed=False)).select(F.col("edge_id").alias("t_id"))
    here = Stored(_within(links.df.join(tree, F.col("edge_id") == F.col("t_id"), "left_semi").select("at", "c", "t"), ["at"], ["c"], "k"), "rotations").df
    size = here.groupBy(F.col("at").alias("at2")).agg(F.count("*").alias("n"))
    nxt = here.select(F.col("at").alias("at3"), F.col("k").alias("k3"), F.col("t.eout").alias("eout"))
    turned = here.join(size, F.col("at") == F.col("at2")).join(nxt, (F.col("at") == F.col("at3")) & (F.col("k3") == (F.col("k") + 1) % F.col("n"))).select("at", F.col("t.ein").alias("ein"), "eout")
    kept = named.df.select("at", "ein", "eout").join(here.select(F.col("t.ein").alias("gone")), F.col("ein") == F.col("gone"), "left_anti")
    out = replaced(turns, kept.union(turned), "turns")
    for table in (named, reps, links):
        table.drop()
    return out


def _placed(steps: DataFrame) -> DataFrame:
    """(d, last, ahead) of lists (d, nxt), nxt null at a list's end: each one's end and how far ahead it is."""
    start = steps.select("d", "nxt", F.col("d").alias("last"), F.lit(0).cast("long").alias("ahead"), F.col("nxt").isNotNull().alias("open"))
    start = start.withColumn("ahead", F.when(F.col("nxt").isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"))

    def step(state: DataFrame, _: int) -> DataFrame:
        on = state.select(F.col("d").alias("m"), F.col("nxt").alias("n2"), F.col("last").alias("l2"), F.col("ahead").alias("a2"))
        met = state.join(on, F.col("nxt") == F.col("m"), "left")
        more = F.col("m").isNotNull()
        return met.select("d", F.when(more, F.col("n2")).alias("nxt"), F.when(more, F.col("l2")).otherwise(F.col("last")).alias("last"), (F.col("ahead") + F.coalesce("a2", F.lit(0))).alias("ahead"), F.col("n2").isNotNull().alias("open"))

    return supersteps(start, step, "open", rounds=64, name="places", beyond=GraphError("a list has no end")).select("d", "last", "ahead")


def _walked(src: list[int], dst: list[int], directed: bool, start: int | None) -> list[list[tuple[int, int]]]:
    """The fewest trails of one component, edges as (number, 1 if against its direction); temporary edges are numbered on from m."""
    m, a, b = len(src), list(src), list(dst)
    if directed:
        over: dict[int, int] = {}
        for x, y in zip(a, b):
            over[x] = over.get(x, 0) + 1
            over[y] = over.get(y, 0) - 1
        a += [v for v, n in over.items() for _ in range(-n)]
        b += [v for v, n in over.items() for _ in range(n)]
    else:
        odd: dict[int, None] = {}
        for v in (v for x, y in zip(a, b) if x != y for v in (x, y)):
            odd.pop(v) if v in odd else odd.setdefault(v)
        a += list(odd)[::2]
        b += list(odd)[1::2]
    at: dict[int, list[tuple[int, int]]] = {}
    for k, (x, y) in enumerate(zip(a, b)):
        at.setdefault(x, []).append((k, 0))
        if not directed:
            at.setdefault(y, []).append((k, 1))
    used, circuit = bytearray(len(a)), []
    # an edge that is left comes before what was found already, so the circuit is found from its end
    stack = [(start if start in at else a[0], None)]
    while stack:
        v, came = stack[-1]
        left = at[v]
        while left and used[left[-1][0]]:
            left.pop()
        if left:
            k, way = left.pop()
            used[k] = 1
            stack.append((a[k] if way else b[k], (k, way)))
        else:
            stack.pop()
            if came is not None:
                circuit.append(came)
    circuit.reverse()
    if len(a) == m:
        return [circuit]
    first = next(i for i, (k, _) in enumerate(circuit) if k >= m)
    trails: list[list[tuple[int, int]]] = []
    for k, way in circuit[first:] + circuit[:first]:
        if k >= m:
            trails.append([])
        else:
            trails[-1].append((k, way))
    return [t for t in trails if t]


def _walks(directed: bool, start) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trails of edges (label, edge_id, src, dst) that come component by component, each in order."""

    def found(rows: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks]).combine_chunks().dictionary_encode()
        at, n = ends.indices.to_numpy(), len(rows)
        from_ = ends.dictionary.index(pa.scalar(start, ends.dictionary.type)).as_py() if start is not None else None
        label = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), n]
        last, place, edge, ways = [], [], [], []
        for lo, hi in zip(bounds, bounds[1:]):
            for trail in _walked(at[lo:hi].tolist(), at[n + lo : n + hi].tolist(), directed, from_):
                last += [lo + trail[-1][0]] * len(trail)
                place += range(len(trail))
                edge += [lo + k for k, _ in trail]
                ways += [way for _, way in trail]
        edge, ways = np.array(edge, dtype=np.int64), np.array(ways, dtype=np.int64)
        both = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks])
        ids = rows["edge_id"]
        columns = [ids.take(pa.array(last, pa.int64())), pa.array(place, pa.int64()), ids.take(pa.array(edge)), both.take(pa.array(edge + n * ways)), both.take(pa.array(edge + n * (1 - ways)))]
        return pa.table(columns, names=["trail", "position", "edge_id", "src", "dst"])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            # a component may go on in the next batch
            if n >= _CHUNK and batch["label"][0] != batch["label"][-1]:
                names = batch["label"].dictionary_encode().indices.to_numpy()
                whole = int(np.flatnonzero(names != names[-1])[-1]) + 1
                yield from found(pa.Table.from_batches([*held[:-1], batch.slice(0, whole)])).to_batches()
                held = [batch.slice(whole)]
                n = held[0].num_rows
        if held:
            yield from found(pa.Table.from_batches(held)).to_batches()

    return walks


def all_trails(g: Graph, start=None, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(trail, position, edge_id, src, dst): the fewest trails that take every edge once, in the direction they take it.

    As ``_wide_trails``, which takes the components of more than ``local_edges`` edges; the others are walked in tasks.
    """
    atoms = (T.IntegralType, T.StringType)
    if local_edges <= 0 or not all(isinstance(g.edges.schema[c].dataType, atoms) for c in ("edge_id", "src", "dst")):
        return _wide_trails(g, start)
    own = Stored(g.edges.select("edge_id", "ord", "src", "dst"), "edges")
    label = linked(own.df.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = replaced(own, own.df.join(label.df, F.col("src") == F.col("v"), "left").select(F.coalesce("c", "src").alias("label"), "edge_id", "ord", "src", "dst"), "named-edges")
    label.drop()
    wide = Stored(named.df.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("n")).where(F.col("n") > local_edges).select("l"), "wide")
    few, many = named.df, None
    if not wide.df.isEmpty():
        few = named.df.join(wide.df, F.col("label") == F.col("l"), "left_anti")
        many = named.df.join(wide.df, F.col("label") == F.col("l"), "left_semi").drop("label")
    sorted_ = few.repartition("label").sortWithinPartitions("label", "ord", "edge_id").select("label", "edge_id", "src", "dst")
    kinds = {c: few.schema[c].dataType for c in ("edge_id", "src", "dst")}
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("trail", "position", "edge_id", "src", "dst"), (kinds["edge_id"], T.LongType(), kinds["edge_id"], kinds["src"], kinds["dst"]))])
    out = Stored(sorted_.mapInArrow(_walks(g.directed, start), schema), "trails").df
    if many is not None:
        ends = many.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        out = out.union(_wide_trails(Graph(g.vertices.join(ends, "id", "left_semi"), many, g.directed), start))
    for table in (named, wide):
        table.drop()
    return out


def _wide_trails(g: Graph, start=None) -> DataFrame:
    """(trail, position, edge_id, src, dst): the fewest trails that take every edge once, in the direction they take it.

    A component whose vertices are even is one closed trail, from ``start`` if that is its vertex, else from its first
    edge's source. ``trail`` is the last edge of each. Directed graphs keep their edges' direction; undirected ones take
    them either way. No edge, no row.
    """
    own = g.edges.select(F.struct(F.lit(0).alias("temp"), F.col("ord").alias("o"), F.col("edge_id").alias("id")).alias("e"), "src", "dst")
    own = Stored(own, "edges")
    extra = temporary_edges(g)
    kinds = own.df.schema["e"].dataType
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in kinds.fields}
    # temporary edges are told apart by number alone
    more = numbered(extra, ["src", "dst"], "n").select(F.struct((F.col("n") + 1).cast("int").alias("temp"), nothing["o"].alias("o"), nothing["id"].alias("id")).alias("e"), "src", "dst")
    e = Stored(own.df.union(more), "even")
    turns = _joined(_turns(e.df, g.directed))
    steps = turns.df.select(F.col("ein").alias("d"), F.col("eout").alias("nxt"))
    if not g.directed:
        back = lambda c: F.struct(F.col(f"{c}.e").alias("e"), (1 - F.col(f"{c}.way")).alias("way"))
        steps = steps.union(turns.df.select(back("eout"), back("ein")))
    steps = Stored(steps, "steps")
    turns.drop()
    # each component is one closed list of darts, or two that mirror each other: the one with the first edge forward is kept
    label = linked(steps.df.select(F.col("d").alias("a"), F.col("nxt").alias("b")))
    named = steps.df.join(label.df, F.col("d") == F.col("v"), "left").select("d", "nxt", F.coalesce("c", "d").alias("c")).where("c.way = 0")
    named = Stored(named, "named-steps")
    label.drop()
    # a list is cut before its temporary edges, and one without any before the first edge
    heads = named.df.groupBy("c").agg(F.max("d.e.temp").alias("temps"), F.min("d").alias("first"))
    if start is not None:
        from_start = e.df.select(F.col("e").alias("se"), "src", "dst").join(named.df.select("d", F.col("c").alias("c2")), F.col("d.e") == F.col("se"))
        at = F.when(F.col("d.way") == 0, F.col("src")).otherwise(F.col("dst"))
        chosen = from_start.where(at == F.lit(start)).groupBy("c2").agg(F.min("d").alias("chosen"))
        heads = heads.join(chosen, F.col("c") == F.col("c2"), "left").select("c", "temps", F.coalesce("chosen", "first").alias("first"))
    cuts = heads.where("temps = 0").select(F.col("first").alias("stop"))
    lists = named.df.where("d.e.temp = 0").join(cuts, F.col("nxt") == F.col("stop"), "left")
    lists = lists.select("d", F.when(F.col("stop").isNull() & (F.col("nxt.e.temp") == 0), F.col("nxt")).alias("nxt"))
    placed = Stored(_placed(lists), "placed").df
    long_ = placed.groupBy(F.col("last").alias("l")).agg(F.max("ahead").alias("most"))
    met = placed.join(long_, F.col("last") == F.col("l")).join(own.df.select(F.col("e").alias("oe"), "src", "dst"), F.col("d.e") == F.col("oe"))
    forward = F.col("d.way") == 0
    out = met.select(F.col("last.e.id").alias("trail"), (F.col("most") - F.col("ahead")).alias("position"), F.col("d.e.id").alias("edge_id"), F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    found = Stored(out, "trails").df
    for table in (own, e, steps, named):
        table.drop()
    return found


def whole_circuit(g: Graph, start=None) -> DataFrame:
    """(position, edge_id, src, dst): one closed trail over all edges, from ``start``; raises GraphError where there is none."""
    found = all_trails(g, start)
    ends = found.groupBy("trail").agg(F.min_by("src", "position").alias("a"), F.max_by("dst", "position").alias("b")).limit(2).collect()
    if len(ends) > 1 or (ends and ends[0]["a"] != ends[0]["b"]):
        raise GraphError("no closed trail takes all edges")
    if start is not None and ends and ends[0]["a"] != start:
        raise GraphError(f"{start!r} has no edges")
    return found.drop("trail")

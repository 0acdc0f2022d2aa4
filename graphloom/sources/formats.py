"""Graph documents: GraphML, generic XML, DGML, DOT, drawing models, schema graphs and Parquet."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Sequence
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FormatError
from ..graph import Graph
from ..plans.durable import numbered

#: The GraphML namespace and its attribute types with those of Spark.
NAMESPACE = "http://graphml.graphdrawing.org/xmlns"
TYPES = {"boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string"}


# ---- Parquet ----------------------------------------------------------------------------------------------------


def write_parquet(g: Graph, path: str) -> None:
    g.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_parquet(spark: SparkSession, path: str, **flags) -> Graph:
    return Graph.of(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), **flags)


# ---- GraphML ----------------------------------------------------------------------------------------------------


def read_corpus(spark: SparkSession, paths: str | Sequence[str]) -> Graph:
    """Many GraphML files as one frame of graphs: a ``graph_id`` column on both frames, the file's name.

    Reads nodes and edges with the XML reader, one pass each; attributes and validation are read_graphml's.
    """
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string").load(paths).select(name.alias("graph_id"), F.col("_id").alias("id"))
    links = spark.read.format("xml").option("rowTag", "edge").schema("_id string, _source string, _target string").load(paths)
    links = links.select(name.alias("graph_id"), F.col("_source").alias("src"), F.col("_target").alias("dst"), F.monotonically_increasing_id().alias("_m"))
    links = numbered(links, ["_m"], "edge_id").drop("_m")
    number = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).cast("long"), F.lit(0))
    return Graph.of(nodes.withColumn("ord", number), links.withColumn("ord", F.col("edge_id")))


def _value(kind: str, text: str | None):
    if kind.endswith("[]"):
        if text is None or text == "null":
            return None
        text = text[:-1] if text.endswith(" ") else text
        return [] if text == "" else [_value(kind[:-2], t) for t in text.split(" ")]
    if text is None:
        return None
    if kind == "string":
        return text
    try:
        if kind == "boolean":
            return {"true": True, "false": False, "1": True, "0": False}[text.strip().lower()]
        if kind in ("int", "long"):
            n = int(text)
            if not -(1 << (31 if kind == "int" else 63)) <= n < 1 << (31 if kind == "int" else 63):
                raise ValueError(text)
            return n
        return float({"INF": "inf", "-INF": "-inf"}.get(text.strip(), text))
    except (KeyError, ValueError):
        raise FormatError(f"{text!r} is no {kind}") from None


def parse_graphml(text: str, *, legacy: bool = False, problem: Callable[[str], None] | None = None) -> tuple[bool, dict, list[tuple], list[tuple], dict[str, dict[str, str]]]:
    """(directed, graph data, nodes (id, data), edges (id, source, target, data), declared kinds by scope); strict.

    One graph without nesting, hyperedges or ports; unique ids; ends that exist; data of a declared key once, by type.
    ``legacy`` drops a DOCTYPE and takes documents without namespace or edgedefault, which are directed. What is wrong
    raises FormatError, or goes to ``problem`` where the rest can still be read.
    """

    def bad(message: str) -> None:
        if problem is None:
            raise FormatError(message)
        problem(message)

    if legacy:
        text = re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?\s*>", "", text, count=1, flags=re.S)
    elif "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise FormatError("document type definitions are not read")
    try:
        top = ET.fromstring(text)
    except ET.ParseError as e:
        raise FormatError(str(e)) from None
    space = f"{{{NAMESPACE}}}" if top.tag.startswith("{") or not legacy else ""
    if top.tag != f"{space}graphml":
        raise FormatError("the document element is not graphml")
    graphs = top.findall(f"{space}graph")
    if len(graphs) != 1:
        raise FormatError("exactly one graph is wanted")
    keys: dict[str, dict] = {}
    for k in top.findall(f"{space}key"):
        kind, id_ = k.get("attr.type", "string"), k.get("id")
        base = kind.removesuffix("[]")
        defaults = k.findall(f"{space}default")
        if not id_ or id_ in keys or base not in TYPES or k.get("for", "all") not in ("all", "graph", "node", "edge") or len(defaults) > 1:
            bad(f"bad key {id_!r}")
            continue
        value = None
        try:
            value = _value(kind, defaults[0].text) if defaults else None
        except FormatError as e:
            bad(str(e))
        keys[id_] = {"name": k.get("attr.name", id_), "kind": kind, "for": k.get("for", "all"), "value": value, "has": bool(defaults)}

    def data(x: ET.Element, scope: str) -> dict:
        mine = {i: k for i, k in keys.items() if k["for"] in ("all", scope)}
        out = {k["name"]: k["value"] for k in mine.values() if k["has"]}
        seen = set()
        for d in x.findall(f"{space}data"):
            k = mine.get(d.get("key"))
            if k is None or d.get("key") in seen:
                bad(f"data of key {d.get('key')!r} is not declared here or comes twice")
                continue
            seen.add(d.get("key"))
            try:
                out[k["name"]] = _value(k["kind"], d.text)
            except FormatError as e:
                bad(str(e))
        return out

    graph = graphs[0]
    way = graph.get("edgedefault", "directed" if legacy else None)
    if way not in ("directed", "undirected"):
        bad("edgedefault must be directed or undirected")
    nodes, edges, ids, edge_ids = [], [], set(), set()
    for x in graph:
        tag = x.tag.removeprefix(space)
        if tag == "node":
            id_ = x.get("id")
            if not id_ or id_ in ids or any(c.tag != f"{space}data" for c in x):
                bad(f"bad node {id_!r}")
                continue
            ids.add(id_)
            nodes.append((id_, data(x, "node")))
        elif tag == "edge":
            a, b, id_ = x.get("source"), x.get("target"), x.get("id")
            if id_ is not None and id_ in edge_ids or x.get("directed") not in (None, "true" if way == "directed" else "false") or any(c.tag != f"{space}data" for c in x):
                bad(f"bad edge {id_!r}")
                continue
            edge_ids.add(id_)
            edges.append((id_ if id_ is not None else str(len(edges)), a, b, data(x, "edge")))
        elif tag not in ("data", "desc"):
            bad(f"{tag} is not read")
    for id_, a, b, _ in edges:
        if a not in ids or b not in ids:
            bad(f"edge {id_!r} has an end that is no node")
    scoped = {s: {k["name"]: k["kind"] for k in keys.values() if k["for"] in ("all", s)} for s in ("graph", "node", "edge")}
    return way == "directed", data(graph, "graph"), nodes, edges, scoped


def read_graphml(spark: SparkSession, text: str, *, legacy: bool = False) -> Graph:
    """One document as a graph; typed data become columns. A document is read whole, so it must fit the driver."""
    directed, _, nodes, edges, kinds = parse_graphml(text, legacy=legacy)
    ddl = lambda k: f"array<{TYPES[k[:-2]]}>" if k.endswith("[]") else TYPES[k]
    columns = {s: [n for n in kinds[s]] for s in ("node", "edge")}
    v = spark.createDataFrame([(i, k, *(d.get(c) for c in columns["node"])) for k, (i, d) in enumerate(nodes)], ", ".join(["id string", "ord bigint", *(f"`{c}` {ddl(kinds['node'][c])}" for c in columns["node"])]))
    rows = [(i, k, a, b, *(d.get(c) for c in columns["edge"])) for k, (i, a, b, d) in enumerate(edges)]
    e = spark.createDataFrame(rows, ", ".join(["edge_id string", "ord bigint", "src string", "dst string", *(f"`{c}` {ddl(kinds['edge'][c])}" for c in columns["edge"])]))
    return Graph.of(v, e, directed=directed)


def validate_graphml(text: str, *, legacy: bool = False) -> list[str]:
    """All that is wrong with a document, in its order; nothing if it can be read."""
    found: list[str] = []
    try:
        parse_graphml(text, legacy=legacy, problem=found.append)
    except FormatError as e:
        found.append(str(e))
    return found


def _kind_of(spark_type: str) -> str | None:
    back = {v: k for k, v in TYPES.items()}
    return back.get(spark_type) or (f"{back[spark_type[6:-1]]}[]" if spark_type.startswith("array<") and spark_type[6:-1] in back else None)


def _xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def graphml_lines(g: Graph, *, name: str = "G", defaults: dict[str, object] | None = None) -> DataFrame:
    """(part, ord, line) of a GraphML document, to be written in order; ids are ordinals, null data are left out.

    The graph element tells the numbers of nodes and edges. ``defaults`` are values of attributes by ``node_name`` or
    ``edge_name``: they are declared with their keys, and data equal to them are left out.
    """
    known = defaults or {}
    spark = g.vertices.sparkSession
    v = numbered(g.vertices, ["ord", "id"], "_n")
    cols = {"node": [(f.name, _kind_of(f.dataType.simpleString())) for f in g.vertices.schema if f.name not in ("id", "ord")], "edge": [(f.name, _kind_of(f.dataType.simpleString())) for f in g.edges.schema if f.name not in ("edge_id", "ord", "src", "dst")]}
    head = ['<?xml version="1.0" encoding="utf-8"?>', f'<graphml xmlns="{NAMESPACE}">']
    for s in cols:
        for c, k in cols[s]:
            if k:
                start, value = f"<key id={quoteattr(f'{s}_{c}')} for=\"{s}\" attr.name={quoteattr(c)} attr.type=\"{k}\"", known.get(f"{s}_{c}")
                text = str(value).lower() if isinstance(value, bool) else str(value)
                head.append(f"{start} />" if value is None else f"{start}><default>{escape(text)}</default></key>")
    way = "directed" if g.directed else "undirected"
    counts = f'parse.nodes="{v.count()}" parse.edges="{g.edges.count()}" parse.order="nodesfirst" parse.nodeids="free" parse.edgeids="free"'
    head.append(f'<graph id={quoteattr(name)} edgedefault="{way}" {counts}>')

    def data(scope: str) -> Column:
        parts = []
        for c, k in cols[scope]:
            if k:
                x = F.col(f"`{c}`")
                text = F.array_join(F.transform(x, lambda y: y.cast("string")), " ") if k.endswith("[]") else x
                if known.get(f"{scope}_{c}") is not None:
                    text = F.when(x.eqNullSafe(F.lit(known[f"{scope}_{c}"])), F.lit(None)).otherwise(text)
                parts.append(F.coalesce(F.concat(F.lit(f'<data key="{escape(f"{scope}_{c}")}">'), _xml_text(text), F.lit("</data>")), F.lit("")))
        return F.concat(*parts) if parts else F.lit("")

    nodes = v.select(F.lit(1).alias("part"), F.col("_n").alias("ord"), F.concat(F.lit('<node id="'), F.col("_n").cast("string"), F.lit('">'), data("node"), F.lit("</node>")).alias("line"))
    at = v.select(F.col("id").alias("_v"), F.col("_n"))
    e = numbered(g.edges, ["ord", "edge_id"], "_k").join(at.toDF("_a", "_s"), F.col("src") == F.col("_a")).join(at.toDF("_b", "_d"), F.col("dst") == F.col("_b"))
    edges = e.select(F.lit(2).alias("part"), F.col("_k").alias("ord"), F.concat(F.lit('<edge id="'), F.col("_k").cast("string"), F.lit('" source="'), F.col("_s").cast("string"), F.lit('" target="'), F.col("_d").cast("string"), F.lit('">'), data("edge"), F.lit("</edge>")).alias("line"))
    ends = [(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")]
    return spark.createDataFrame(ends, "part int, ord long, line string").union(nodes).union(edges)


def document(lines: DataFrame) -> str:
    """The text of lines (part, ord, line); for documents that fit the driver."""
    return "\n".join(r["line"] for r in lines.orderBy("part", "ord").collect())


# ---- generic XML and DGML ---------------------------------------------------------------------------------------


def read_xml(spark: SparkSession, path: str, *, node: str = "node", edge: str = "edge", id_: str = "id", source: str = "source", target: str = "target", attributes: str = "", **flags) -> Graph:
    """XML with an element a vertex and an edge, names and attributes given; ``attributes`` is DDL of edge attributes."""
    v = spark.read.format("xml").option("rowTag", node).schema(f"_{id_} string").load(path).select(F.col(f"_{id_}").alias("id"), F.monotonically_increasing_id().alias("_m"))
    extra = ", ".join(f"_{a.strip()}" for a in attributes.split(",") if a.strip())
    e = spark.read.format("xml").option("rowTag", edge).schema(", ".join(x for x in (f"_{source} string, _{target} string", extra) if x)).load(path)
    e = e.select(F.monotonically_increasing_id().alias("_m"), F.col(f"_{source}").alias("src"), F.col(f"_{target}").alias("dst"), *(F.col(c).alias(c[1:]) for c in e.columns if c not in (f"_{source}", f"_{target}")))
    return Graph.of(numbered(v, ["_m"], "ord").drop("_m"), numbered(e, ["_m"], "edge_id").drop("_m"), **flags)


def xml_lines(g: Graph, *, graph: str = "graph", node: str = "node", edge: str = "edge") -> DataFrame:
    """(part, ord, line) with elements <node id> and <edge id source target> of the names given."""
    spark = g.vertices.sparkSession
    q = lambda c: F.concat(F.lit('"'), _xml_text(F.col(c)), F.lit('"'))
    v, e = numbered(g.vertices, ["ord", "id"], "_n"), numbered(g.edges, ["ord", "edge_id"], "_n")
    nodes = v.select(F.lit(1).alias("part"), F.col("_n").alias("ord"), F.concat(F.lit(f"<{node} id="), q("id"), F.lit(" />")).alias("line"))
    edges = e.select(F.lit(2).alias("part"), F.col("_n").alias("ord"), F.concat(F.lit(f"<{edge} id="), q("edge_id"), F.lit(" source="), q("src"), F.lit(" target="), q("dst"), F.lit(" />")).alias("line"))
    ends = spark.createDataFrame([(0, 0, f"<{graph}>"), (3, 0, f"</{graph}>")], "part int, ord long, line string")
    return ends.union(nodes).union(edges)


def dgml_elements(g: Graph, colours: DataFrame | None = None) -> DataFrame:
    """(kind, id, source, target, label, background): Node and Link rows; colours (id, colour 0 to 2) fill nodes."""
    return _dgml(g, colours).drop("ord")


def _dgml(g: Graph, colours: DataFrame | None) -> DataFrame:
    v = numbered(g.vertices, ["ord", "id"], "_n").select("id", "_n")
    e = numbered(g.edges, ["ord", "edge_id"], "_n")
    back = F.lit(None).cast("string")
    if colours is not None:
        v = v.join(colours.select("id", "colour"), "id", "left")
        back = F.when(F.col("colour") == 0, "White").when(F.col("colour") == 1, "LightGray").when(F.col("colour") == 2, "Black")
    none = F.lit(None).cast("string")
    nodes = v.select(F.lit("Node").alias("kind"), F.col("id").cast("string").alias("id"), none.alias("source"), none.alias("target"), F.col("id").cast("string").alias("label"), back.alias("background"), F.col("_n").alias("ord"))
    links = e.select(F.lit("Link"), none, F.col("src").cast("string"), F.col("dst").cast("string"), F.col("edge_id").cast("string"), none, "_n")
    return nodes.union(links)


def dgml_lines(g: Graph, colours: DataFrame | None = None) -> DataFrame:
    """(part, ord, line) of a DGML document."""
    spark = g.vertices.sparkSession
    e = _dgml(g, colours)
    at = lambda n, c: F.coalesce(F.concat(F.lit(f' {n}="'), _xml_text(F.col(c)), F.lit('"')), F.lit(""))
    line = F.concat(F.lit("<"), F.col("kind"), at("Id", "id"), at("Source", "source"), at("Target", "target"), at("Label", "label"), at("Background", "background"), F.lit(" />"))
    body = e.select(F.when(F.col("kind") == "Node", 1).otherwise(3).alias("part"), "ord", line.alias("line"))
    frame = [(0, 0, '<DirectedGraph xmlns="http://schemas.microsoft.com/vs/2009/dgml"><Nodes>'), (2, 0, "</Nodes><Links>"), (4, 0, "</Links></DirectedGraph>")]
    return spark.createDataFrame(frame, "part int, ord long, line string").union(body)


def read_dgml(spark: SparkSession, path: str, **flags) -> Graph:
    """A DGML file's nodes and links."""
    return read_xml(spark, path, node="Node", edge="Link", id_="Id", source="Source", target="Target", **flags)


# ---- DOT and drawing models -------------------------------------------------------------------------------------


def dot_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _dot_list(values: dict[str, str | int | float | bool]) -> str:
    """Attributes as DOT writes them: truth values and numbers plain, texts quoted."""
    plain = lambda x: str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    return ", ".join(f"{k}={plain(v)}" for k, v in values.items())


def _dot_columns(columns: dict[str, Column]) -> Column:
    """`` [k="v", ...]`` of the attributes that are not null; nothing where all are."""
    parts = [F.concat(F.lit(f'{k}="'), dot_escape(c), F.lit('"')) for k, c in columns.items()]
    if not parts:
        return F.lit("")
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "").otherwise(F.concat(F.lit(" ["), text, F.lit("]")))


def dot_lines(
    g: Graph, *, name: str = "G", vertex_label: Column | None = None, edge_label: Column | None = None, vertex: dict[str, Column] | None = None, edge: dict[str, Column] | None = None,
    graph_attributes: dict | None = None, vertex_defaults: dict | None = None, edge_defaults: dict | None = None, clusters: DataFrame | None = None,
) -> DataFrame:
    """(part, ord, line) of a DOT document; vertices are ordinals, labels and other attributes Columns over the frames.

    An attribute that is null is not written. ``clusters`` (cluster, id) puts vertices into subgraphs, each vertex into
    one at most, in order of the clusters' names.
    """
    spark = g.vertices.sparkSession
    of_vertex, of_edge = (({} if c is None else {"label": c}) | (more or {}) for c, more in ((vertex_label, vertex), (edge_label, edge)))
    v = numbered(g.vertices, ["ord", "id"], "_n")
    line = F.concat(F.col("_n").cast("string"), _dot_columns(of_vertex), F.lit(";"))
    nodes = v.select(F.lit(1).alias("part"), F.col("_n").alias("ord"), line.alias("line"))
    if clusters is not None:
        one = clusters.groupBy(F.col("id").alias("_i")).agg(F.min("cluster").alias("_c"))
        names = numbered(one.select("_c").distinct(), ["_c"], "_k")
        held = v.join(one, F.col("id") == F.col("_i"), "left").join(names.withColumnRenamed("_c", "_d"), F.col("_c") == F.col("_d"), "left")
        size = v.count() + 2
        inside = F.col("_k").isNotNull()
        nodes = held.select(F.when(inside, F.lit(1)).otherwise(F.lit(2)).alias("part"), F.when(inside, F.col("_k") * size + F.col("_n") + 1).otherwise(F.col("_n")).alias("ord"), line.alias("line"))
        heads = names.select(F.lit(1), F.col("_k") * size, F.concat(F.lit("subgraph cluster"), (F.col("_k") + 1).cast("string"), F.lit(' { label="'), dot_escape(F.col("_c")), F.lit('";')))
        nodes = nodes.union(heads).union(names.select(F.lit(1), F.col("_k") * size + size - 1, F.lit("}")))
    at = v.select("id", "_n")
    e = numbered(g.edges, ["ord", "edge_id"], "_k").join(at.toDF("_a", "_s"), F.col("src") == F.col("_a")).join(at.toDF("_b", "_d"), F.col("dst") == F.col("_b"))
    arrow = " -> " if g.directed else " -- "
    edges = e.select(F.lit(2 if clusters is None else 3).alias("part"), F.col("_k").alias("ord"), F.concat(F.col("_s").cast("string"), F.lit(arrow), F.col("_d").cast("string"), _dot_columns(of_edge), F.lit(";")).alias("line"))
    title = name if re.fullmatch(r"[A-Za-z_]\w*", name) else '"' + name.replace('"', '\\"') + '"'
    head = [f"{'digraph' if g.directed else 'graph'} {title} {{"]
    head += [f"{_dot_list(graph_attributes)};"] if graph_attributes else []
    head += [f"{kind} [{_dot_list(d)}];" for kind, d in (("node", vertex_defaults), ("edge", edge_defaults)) if d]
    frame = [(0, i, x) for i, x in enumerate(head)] + [(9, 0, "}")]
    return spark.createDataFrame(frame, "part int, ord long, line string").union(nodes).union(edges)


#: The renderers' common look.
RENDERED = {"vertex_defaults": {"fontname": "Tahoma", "fontsize": 8.25, "shape": "box", "style": "filled", "fillcolor": "lightyellow"}, "edge_defaults": {"fontname": "Tahoma", "fontsize": 8.25}}


def condensation_dot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """DOT lines of a condensation: labels are the counts of vertices and edges inside."""
    v = vertices.select(F.col("label").alias("id"), F.col("label").alias("ord"), "n_vertices", "n_edges")
    e = edges.select(F.xxhash64("src", "dst").alias("edge_id"), F.struct("src", "dst").alias("ord"), "src", "dst", "n_edges")
    return dot_lines(Graph.of(v, e), vertex_label=F.concat_ws("-", F.col("n_vertices").cast("string"), F.col("n_edges").cast("string")), edge_label=F.col("n_edges"))


def edge_merge_dot(vertices: DataFrame, merged: DataFrame) -> DataFrame:
    """DOT lines of an edge-merge condensation: vertices (id, ord) by name, merged edges (src, dst, edge_ids) by number and list."""
    e = merged.select(F.xxhash64("src", "dst", "edge_ids").alias("edge_id"), F.struct("src", "dst", "edge_ids").alias("ord"), "src", "dst", "edge_ids")
    each = F.array_join(F.transform("edge_ids", lambda x: F.concat(F.lit("  "), x.cast("string"), F.lit("\n"))), "")
    return dot_lines(Graph.of(vertices, e), vertex_label=F.col("id").cast("string"), edge_label=F.concat(F.size("edge_ids").cast("string"), F.lit("\n"), each), **RENDERED)


def drawing_model(g: Graph, *, label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (source, target, source_label, target_label), ids as strings."""
    text = F.col("id").cast("string") if label is None else label
    v = g.vertices.select(F.col("id").cast("string").alias("id"), text.alias("label"))
    a, b = v.toDF("source", "source_label"), v.toDF("target", "target_label")
    e = g.edges.select(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"))
    return v, e.join(a, "source").join(b, "target").select("source", "target", "source_label", "target_label")


# ---- tables and relations ---------------------------------------------------------------------------------------


def schema_graph(spark: SparkSession, tables: Sequence[str], relations: Sequence[tuple[str, str, str]]) -> Graph:
    """Tables as vertices, relations (name, parent, child) as edges from parent to child."""
    v = spark.createDataFrame([(t, i) for i, t in enumerate(tables)], "id string, ord long")
    e = spark.createDataFrame([(n, i, p, c) for i, (n, p, c) in enumerate(relations)], "edge_id string, ord long, src string, dst string")
    return Graph.of(v, e).checked()

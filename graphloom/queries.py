"""One query an operator over graphs of the star-schema tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import edges as edge_functions
from .functions import codecs, sets
from .graph import Graph
from .operators import augment, clusters, components, exact, order, paths, petri, trees, walks
from .sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

V = "v AS (SELECT n_nationkey::BIGINT AS id FROM nation)"
TRADE = f"""{V}, trade AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS n FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
T3 = f"""{TRADE}, t3 AS (SELECT src, dst, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k
  FROM trade WHERE src <> dst) WHERE k <= 3)"""
DAG = f"{T3}, dag AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(n)::BIGINT AS n FROM t3 GROUP BY 1, 2)"
GEO = """geo AS (SELECT 'W' AS src, 'r' || r_regionkey AS dst FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
  geov AS (SELECT 'W' AS id UNION ALL SELECT dst FROM geo)"""
SUPPLY = """supply AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*) AS w FROM lineitem GROUP BY 1, 2),
  supplyv AS (SELECT 'p' || p_partkey AS id FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier)"""
ETYPE = """etype AS (SELECT event_id AS edge_id, src, dst FROM (SELECT event_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL), etypev AS (SELECT DISTINCT event_type AS id FROM events)"""
SESSION = """session AS (SELECT event_id AS src, dst FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst
  FROM events) WHERE dst IS NOT NULL)"""
REACH = f"{T3}, walk AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN t3 ON src = id WHERE depth < 25)"
#: Distances from nation 0 over t3 with weight n, round by round.
def _rounds(arcs: str, kind: str = "min", n: int = 25) -> str:
    parts = ["d0 AS (SELECT 0::BIGINT AS id, 0::DOUBLE AS distance)"]
    for k in range(n):
        parts.append(f"d{k + 1} AS MATERIALIZED (SELECT id, {kind}(distance) AS distance FROM (SELECT * FROM d{k} UNION ALL SELECT dst, distance + w FROM d{k} JOIN {arcs} ON src = id) GROUP BY id)")
    return ", ".join(parts)


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _one(star: Star, **values) -> DataFrame:
    row = star.spark.range(1)
    return row.select(*(F.lit(v).alias(k) for k, v in values.items()))


def _field(name: str):
    return lambda x: x[name].cast("long")


# ---- adjacency and membership -----------------------------------------------------------------------------------


@_query("out_degree", f"WITH {TRADE} SELECT id, count(src) AS out_degree FROM v LEFT JOIN trade ON src = id GROUP BY id")
def _(s):
    return s.trade().out_degrees()


@_query("in_degree", f"WITH {T3} SELECT id, count(dst) AS in_degree FROM v LEFT JOIN t3 ON dst = id GROUP BY id")
def _(s):
    return s.trade3().in_degrees()


@_query("degree_with_selfloops", f"WITH {TRADE} SELECT id, count(e) AS degree FROM v LEFT JOIN (SELECT src AS e FROM trade UNION ALL SELECT dst FROM trade) ON e = id GROUP BY id")
def _(s):
    return s.trade().degrees()


@_query("adjacent_degree", f"WITH {TRADE} SELECT id, count(e) AS adjacent_degree FROM v LEFT JOIN (SELECT src AS e FROM trade UNION ALL SELECT dst FROM trade WHERE src <> dst) ON e = id GROUP BY id")
def _(s):
    return s.trade().adjacent_degrees()


@_query("adjacent_vertices", f"WITH {T3} SELECT src AS id, dst AS neighbour FROM t3 UNION SELECT dst, src FROM t3")
def _(s):
    return s.trade3().adjacent_vertices()


@_query("roots", f"WITH {GEO} SELECT id FROM geov WHERE id NOT IN (SELECT dst FROM geo)")
def _(s):
    return s.geo().roots().select("id")


@_query("sinks", f"WITH {GEO} SELECT id FROM geov WHERE id NOT IN (SELECT src FROM geo)")
def _(s):
    return s.geo().sinks().select("id")


@_query("isolated", f"WITH {SUPPLY} SELECT id FROM supplyv WHERE id NOT IN (SELECT src FROM supply UNION SELECT dst FROM supply)")
def _(s):
    return s.supply().isolated().select("id")


@_query("odd_vertices", f"WITH {ETYPE} SELECT id FROM (SELECT src AS id, 1 AS k FROM etype UNION ALL SELECT dst, -1 FROM etype) GROUP BY id HAVING abs(sum(k)) % 2 = 1")
def _(s):
    return s.etype().odd_vertices()


@_query("contains_edge_batch", f"WITH {DAG} SELECT src, dst, EXISTS (SELECT 1 FROM t3 WHERE t3.src = dag.src AND t3.dst = dag.dst) AS found FROM dag")
def _(s):
    return s.trade3().contains_edges(s.trade3_dag().edges.select("src", "dst"))


@_query("contains_vertex_batch", f"WITH {SUPPLY} SELECT 's' || s_suppkey AS id, ('s' || s_suppkey) IN (SELECT dst FROM supply) AS found FROM supplier")
def _(s):
    ids = s.table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    g = s.supply()
    return Graph.from_edges(g.edges.select("edge_id", "src", "dst", F.lit(0).alias("ord"))).contains_vertices(ids)


@_query("first_edge_of_pair", f"WITH {ETYPE} SELECT src, dst, min(edge_id) AS edge_id FROM etype GROUP BY src, dst")
def _(s):
    return s.etype().first_edges().select("src", "dst", "edge_id")


@_query("edges_between", f"WITH {ETYPE} SELECT edge_id, src, dst FROM etype WHERE src = (SELECT min(id) FROM etypev) AND dst = (SELECT max(id) FROM etypev)")
def _(s):
    g = s.etype()
    return g.edges_between(g.vertices.agg(F.min("id").alias("src"), F.max("id").alias("dst"))).select("edge_id", "src", "dst")


@_query("nth_out_edge", f"WITH {ETYPE} SELECT src, edge_id FROM (SELECT src, edge_id, row_number() OVER (PARTITION BY src ORDER BY edge_id) AS k FROM etype) WHERE k = 3")
def _(s):
    return s.etype().nth_out_edges(2).select("src", "edge_id")


@_query("nth_in_edge", f"WITH {ETYPE} SELECT dst, edge_id FROM (SELECT dst, edge_id, row_number() OVER (PARTITION BY dst ORDER BY edge_id) AS k FROM etype) WHERE k = 2")
def _(s):
    return s.etype().nth_in_edges(1).select("dst", "edge_id")


@_query("adjacent_edges", f"WITH {T3} SELECT src, dst FROM t3 WHERE src = 3 OR dst = 3")
def _(s):
    return s.trade3().adjacent_edges(3).select("src", "dst")


@_query("self_edges", f"WITH {TRADE} SELECT src, dst FROM trade WHERE src = dst")
def _(s):
    return s.trade().self_edges().select("src", "dst")


# ---- changes and views ------------------------------------------------------------------------------------------


@_query("add_edges_no_parallel", f"WITH {T3} SELECT src, dst FROM t3 UNION SELECT dst, src FROM t3")
def _(s):
    g = s.trade3()
    more = g.reversed().edges.withColumns({"edge_id": F.col("edge_id") + (1 << 40), "ord": F.col("ord") + (1 << 40)})
    return Graph(g.vertices, g.edges, True, False).add_edges(more).edges.select("src", "dst")


@_query("add_vertices_and_edges", f"WITH {T3} SELECT id FROM v UNION SELECT dst + 25 FROM t3")
def _(s):
    g = s.trade3()
    more = g.edges.withColumns({"dst": F.col("dst") + 25, "edge_id": F.col("edge_id") + (1 << 40), "ord": F.col("ord") + (1 << 40)})
    return g.add_edges(more, with_vertices=True).vertices.select("id")


@_query("remove_edges", f"WITH {ETYPE} SELECT src, dst, count(*) - 2 AS n FROM etype GROUP BY src, dst HAVING count(*) > 2")
def _(s):
    g = s.etype()
    pair = g.edges.select("src", "dst").distinct()
    left = Graph(g.vertices, g.edges, identity="endpoints").remove_edges(pair.union(pair))
    return left.edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("remove_edge_if", f"WITH {TRADE} SELECT src, dst, n FROM trade WHERE NOT n % 2 = 0")
def _(s):
    return s.trade().remove_edges_if(F.col("n") % 2 == 0).edges.select("src", "dst", "n")


@_query("remove_vertex_cascade", f"WITH {TRADE} SELECT src, dst FROM trade WHERE src % 5 <> 0 AND dst % 5 <> 0")
def _(s):
    return s.trade().remove_vertices_if(F.col("id") % 5 == 0).edges.select("src", "dst")


@_query("clear_out_edges", f"WITH {T3} SELECT src, dst FROM t3 WHERE src <> 0")
def _(s):
    return s.trade3().clear_edges(0, "out").edges.select("src", "dst")


@_query("clear_adjacent_edges", f"WITH {T3} SELECT src, dst FROM t3 WHERE src <> 1 AND dst <> 1")
def _(s):
    return s.trade3().clear_edges(1).edges.select("src", "dst")


@_query("merge_vertex", f"""WITH {TRADE} SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM trade WHERE src <> 0 AND dst <> 0 UNION ALL
  SELECT a.src, b.dst FROM trade a, trade b WHERE a.dst = 0 AND a.src <> 0 AND b.src = 0 AND b.dst <> 0) GROUP BY src, dst""")
def _(s):
    return s.trade().merge_vertex(0).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("merge_vertices_if")
def _(s):
    return s.trade3().merge_vertices_if(F.col("id") < 3).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("filtered_graph", f"WITH {TRADE} SELECT src, dst, n FROM trade WHERE src % 2 = 0 AND dst % 2 = 0 AND n > 20")
def _(s):
    return s.trade().filtered(F.col("id") % 2 == 0, F.col("n") > 20).edges.select("src", "dst", "n")


@_query("restricted_graph", f"WITH {TRADE}, few AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1) SELECT src, dst FROM trade WHERE src IN (FROM few) AND dst IN (FROM few)")
def _(s):
    return s.trade().restricted(s.table("nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("long").alias("id"))).edges.select("src", "dst")


@_query("residual_edges", f"WITH {T3} SELECT src, dst FROM t3 WHERE n - 20 * (src % 3) > 0")
def _(s):
    g = s.trade3()
    return g.residual(g.edges.select("edge_id", (F.col("n") - 20 * (F.col("src") % 3)).alias("residual"))).select("src", "dst")


@_query("reversed_residual_edges", f"WITH {TRADE} SELECT a.src, a.dst FROM trade a JOIN trade b ON a.src = b.dst AND a.dst = b.src WHERE b.n > 25")
def _(s):
    g = s.trade()
    back = g.edges.select("edge_id", (F.col("dst") * (1 << 20) + F.col("src")).alias("reverse_id"))
    return g.residual(g.edges.select("edge_id", (F.col("n") - 25).alias("residual")), back).select("src", "dst")


@_query("reversed_view", f"WITH {T3} SELECT dst AS src, src AS dst, n FROM t3")
def _(s):
    return s.trade3().reversed().edges.select("src", "dst", "n")


@_query("undirected_view", f"WITH {TRADE} SELECT src, dst, count(*) AS c FROM (SELECT src, dst FROM trade UNION ALL SELECT dst, src FROM trade WHERE src <> dst) GROUP BY src, dst")
def _(s):
    return s.trade().symmetric().edges.groupBy("src", "dst").agg(F.count("*").alias("c"))


@_query("matrix_graph", f"WITH {ETYPE}, ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM etypev) SELECT a.i AS src, b.i AS dst, min(edge_id) AS edge_id FROM etype JOIN ids a ON src = a.id JOIN ids b ON dst = b.id GROUP BY 1, 2")
def _(s):
    from pyspark.sql import Window as W

    g = s.etype()
    ids = g.vertices.select("id", (F.row_number().over(W.orderBy("id")) - 1).cast("long").alias("i"))  # a row an event type
    e = g.edges.join(ids.toDF("a", "s"), F.col("src") == F.col("a")).join(ids.toDF("b", "d"), F.col("dst") == F.col("b"))
    return Graph.matrix(5, e.select("edge_id", "ord", F.col("s").alias("src"), F.col("d").alias("dst"))).edges.select("src", "dst", "edge_id")


@_query("csr_adjacency", f"WITH {T3} SELECT id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst), '') AS targets FROM v LEFT JOIN t3 ON src = id GROUP BY id")
def _(s):
    return s.trade3().compressed().select("id", F.array_join("targets", ",").alias("targets"))


@_query("edge_list_vertices", f"WITH {T3} SELECT src AS id FROM t3 UNION SELECT dst FROM t3")
def _(s):
    return s.trade3().edge_list().vertices.select("id")


@_query("graph_from_columns", "SELECT n_regionkey::BIGINT AS src, n_nationkey::BIGINT AS dst FROM nation")
def _(s):
    both = s.table("nation").agg(*(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey"))), _field(c)).alias(c) for c in ("n_regionkey", "n_nationkey")))
    return Graph.from_columns(both, "n_regionkey", "n_nationkey").edges.select("src", "dst")


@_query("graph_from_adjacency", f"WITH {GEO} SELECT src, dst FROM geo WHERE src LIKE 'r%'")
def _(s):
    rows = s.table("nation").groupBy(F.concat(F.lit("r"), "n_regionkey").alias("id")).agg(F.collect_list(F.concat(F.lit("n"), "n_nationkey")).alias("t"))
    return Graph.from_adjacency(rows, "id", "t").edges.select("src", "dst")


@_query("identities", f"WITH {GEO} SELECT id, row_number() OVER (ORDER BY id) - 1 AS number FROM geov")
def _(s):
    from .plans.durable import numbered

    return numbered(s.geo().vertices.select("id"), ["id"], "number").select("id", "number")


@_query("mapped_clone", f"WITH {T3} SELECT src + 100 AS src, dst + 100 AS dst FROM t3")
def _(s):
    return s.trade3().mapped(F.col("id") + 100, F.col("src") + 100, F.col("dst") + 100).edges.select("src", "dst")


@_query("path_checks", """WITH p AS (SELECT conv_id AS path, turn AS pos, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations),
  q AS (SELECT *, coalesce(lag(dst) OVER (PARTITION BY path ORDER BY pos) = src, true) AS ok, row_number() OVER (PARTITION BY path ORDER BY pos) AS k FROM p WHERE dst IS NOT NULL),
  v AS (SELECT path, dst AS x FROM q UNION ALL SELECT path, src FROM q WHERE k = 1), c AS (SELECT path, count(*) > count(DISTINCT x) AS has_cycles FROM v GROUP BY path)
  SELECT path, bool_and(ok) AS is_path, any_value(has_cycles) AS has_cycles, bool_and(ok) AND NOT any_value(has_cycles) AS is_path_without_cycles FROM q JOIN c USING (path) GROUP BY path""")
def _(s):
    return edge_functions.path_checks(s.turns())


@_query("equate_graphs", "SELECT true AS same, false AS other")
def _(s):
    g = s.trade3()
    return _one(s, same=g.equals(g.reversed().reversed()), other=g.equals(s.trade3_dag()))


for _name, _op, _sql in (
    ("union", sets.union, "UNION"), ("intersection", sets.intersection, "INTERSECT"), ("difference", sets.difference, "EXCEPT"),
):

    @_query(f"graph_set_{_name}", f"WITH {DAG} SELECT src, dst FROM t3 {_sql} SELECT src, dst FROM dag")
    def _(s, op=_op):
        return op(s.trade3().edges.select("src", "dst"), s.trade3_dag().edges.select("src", "dst"))


@_query("graph_set_symmetric_difference", f"WITH {DAG} (SELECT src, dst FROM t3 EXCEPT SELECT src, dst FROM dag) UNION (SELECT src, dst FROM dag EXCEPT SELECT src, dst FROM t3)")
def _(s):
    return sets.symmetric_difference(s.trade3().edges.select("src", "dst"), s.trade3_dag().edges.select("src", "dst"))


@_query("graph_set_relations", f"WITH {DAG} SELECT (SELECT count(*) FROM (SELECT src, dst FROM dag EXCEPT SELECT src, dst FROM t3)) = 0 AS subset, (SELECT count(*) FROM (SELECT src, dst FROM t3 INTERSECT SELECT src, dst FROM dag)) = 0 AS disjoint")
def _(s):
    a, b = s.trade3_dag().edges.select("src", "dst"), s.trade3().edges.select("src", "dst")
    return _one(s, subset=sets.is_subset(a, b), disjoint=sets.is_disjoint(a, b))


@_query("schema_graph", "SELECT * FROM (VALUES ('region', 'nation'), ('nation', 'customer'), ('nation', 'supplier'), ('customer', 'orders'), ('orders', 'lineitem'), ('part', 'lineitem'), ('supplier', 'lineitem')) t(src, dst)")
def _(s):
    from .sources.formats import schema_graph

    return schema_graph(s.spark, STAR_TABLES, STAR_RELATIONS).edges.select("src", "dst")


STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
STAR_RELATIONS = [
    ("nation_region", "region", "nation"), ("customer_nation", "nation", "customer"), ("supplier_nation", "nation", "supplier"), ("orders_customer", "customer", "orders"),
    ("lineitem_orders", "orders", "lineitem"), ("lineitem_part", "part", "lineitem"), ("lineitem_supplier", "supplier", "lineitem"),
]


@_query("dot_lines", f"WITH {T3}, i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v) SELECT a.k || ' -> ' || b.k || ';' AS line FROM t3 JOIN i a ON src = a.id JOIN i b ON dst = b.id UNION ALL SELECT k || ';' FROM i")
def _(s):
    from .sources.formats import dot_lines

    return dot_lines(s.trade3()).where("part in (1, 2)").select("line")


@_query("dgml_elements", f"WITH {T3} SELECT 'Node' AS kind, id::VARCHAR AS id, NULL::VARCHAR AS source, NULL::VARCHAR AS target FROM v UNION ALL SELECT 'Link', NULL, src::VARCHAR, dst::VARCHAR FROM t3")
def _(s):
    from .sources.formats import dgml_elements

    return dgml_elements(s.trade3()).select("kind", "id", "source", "target")


@_query("drawing_model", f"WITH {T3} SELECT src::VARCHAR AS source, dst::VARCHAR AS target, src::VARCHAR AS source_label FROM t3")
def _(s):
    from .sources.formats import drawing_model

    return drawing_model(s.trade3())[1].select("source", "target", "source_label")


@_query("array_codec", f"WITH {T3} SELECT id, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), 'null') AS text, count(dst) AS n FROM v LEFT JOIN t3 ON src = id GROUP BY id")
def _(s):
    rows = s.trade3().compressed().select("id", F.when(F.size("targets") > 0, F.col("targets")).alias("targets"))
    coded = rows.select("id", codecs.encode_array(F.col("targets")).alias("text"))
    return coded.select("id", "text", F.coalesce(F.size(codecs.decode_array(F.col("text"), "bigint")), F.lit(0)).cast("long").alias("n")).withColumn("n", F.greatest("n", F.lit(0)))


@_query("clusters", f"""WITH {TRADE}, m AS (SELECT 'r' || n_regionkey AS cluster, n_nationkey AS id FROM nation UNION ALL SELECT 'world', n_nationkey FROM nation)
  SELECT a.cluster, (SELECT count(*) FROM m x WHERE x.cluster = a.cluster) AS n_vertices, count(*) AS n_edges FROM trade JOIN m a ON src = a.id JOIN m b ON dst = b.id AND a.cluster = b.cluster GROUP BY 1, 2""")
def _(s):
    region = s.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("cluster"), F.lit("world").alias("parent"))
    tree = region.union(s.spark.createDataFrame([("world", None)], "cluster string, parent string"))
    none = s.spark.createDataFrame([], "cluster string, id long")
    more = s.table("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("cluster"), F.col("n_nationkey").cast("long").alias("id"))
    return clusters.Clusters(s.trade(), tree, none).add(more).counts()


# ---- augmentation -----------------------------------------------------------------------------------------------


@_query("reversed_edge_augment", f"WITH {T3} SELECT src, dst, NOT EXISTS (SELECT 1 FROM t3 b WHERE b.src = a.dst AND b.dst = a.src) AS added FROM t3 a")
def _(s):
    return augment.reversed_edges(s.trade3()).select("src", "dst", "added")


@_query("augment_all_vertices", f"WITH {V}, w AS (SELECT id FROM v UNION ALL SELECT 1000 UNION ALL SELECT 1001) SELECT 1000::BIGINT AS src, id AS dst FROM w UNION ALL SELECT id, 1001 FROM w")
def _(s):
    return augment.augment_all(s.trade3(), 1000, 1001)[1].select("src", "dst")


@_query("augment_multi_source_sink", f"""WITH {DAG}, w AS (SELECT id FROM v UNION ALL SELECT 1000 UNION ALL SELECT 1001), r AS (SELECT 1000::BIGINT AS src, id AS dst FROM w WHERE id NOT IN (SELECT dst FROM dag))
  SELECT src, dst FROM r UNION ALL SELECT id, 1001 FROM w WHERE id NOT IN (SELECT src FROM dag UNION ALL SELECT src FROM r)""")
def _(s):
    return augment.augment_sources_sinks(s.trade3_dag(), 1000, 1001)[1].select("src", "dst")


@_query("augment_bipartite", f"WITH {V} SELECT 1000::BIGINT AS src, id AS dst FROM v WHERE id < 12 UNION ALL SELECT id, 1001 FROM v WHERE id >= 12")
def _(s):
    v = s.trade3().vertices.select("id")
    return augment.augment_bipartite(s.trade3(), v.where("id < 12"), v.where("id >= 12"), 1000, 1001)[1].select("src", "dst")


@_query("balance_index", f"WITH {T3} SELECT id, (SELECT count(*) FROM t3 WHERE src = id) - (SELECT count(*) FROM t3 WHERE dst = id) AS index FROM v")
def _(s):
    return augment.balance_index(s.trade3())


@_query("balance_edges", f"""WITH {T3}, b AS (SELECT id, (SELECT count(*) FROM t3 WHERE src = id) - (SELECT count(*) FROM t3 WHERE dst = id) AS i FROM v)
  SELECT 1000::BIGINT AS src, id AS dst, -i AS capacity, 'surplus' AS kind FROM b WHERE i < 0 UNION ALL SELECT id, 1001, i, 'deficient' FROM b WHERE i > 0
  UNION ALL SELECT 1000, 0, {2**62}, 'source' UNION ALL SELECT 1, 1001, {2**62}, 'sink'""")
def _(s):
    return augment.balance(s.trade3(), 0, 1, 1000, 1001)[0]


# ---- traversal and paths ----------------------------------------------------------------------------------------


@_query("bfs_depth", f"WITH RECURSIVE {REACH} SELECT id, min(depth) AS depth FROM walk GROUP BY id")
def _(s):
    return paths.bfs(s.trade3(), 0).select("id", "depth")


@_query("bfs_tree", f"""WITH RECURSIVE {REACH}, d AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) SELECT b.id, b.depth, min(a.id) AS parent FROM d b
  LEFT JOIN (SELECT * FROM t3 JOIN d ON src = id) a ON a.dst = b.id AND a.depth + 1 = b.depth GROUP BY b.id, b.depth""")
def _(s):
    return paths.bfs(s.trade3(), 0, local_edges=0).select("id", "depth", "parent")


@_query("bfs_from_roots", f"WITH RECURSIVE {GEO}, w AS (SELECT 'W' AS id, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM w JOIN geo ON src = id) SELECT id, depth FROM w")
def _(s):
    return paths.bfs_from_roots(s.geo())


@_query("edge_reachable", f"""WITH RECURSIVE {T3}, start AS (SELECT min(src) AS src FROM t3), w AS (SELECT src, dst FROM t3 WHERE (src, dst) = (SELECT (src, dst) FROM t3 ORDER BY src, dst LIMIT 1)
  UNION SELECT t3.src, t3.dst FROM w JOIN t3 ON t3.src = w.dst) SELECT src, dst FROM w""")
def _(s):
    g = s.trade3()
    first = g.edges.agg(F.min("edge_id").alias("e")).first()["e"]
    return paths.edge_reachable(g, first).join(g.edges, "edge_id").select("src", "dst")


@_query("sssp", f"WITH {T3}, arcs AS (SELECT src, dst, n::DOUBLE AS w FROM t3), {_rounds('arcs')} SELECT id, distance FROM d25")
def _(s):
    return paths.shortest_paths(s.trade3(), 0, weight=F.col("n"), local_edges=0).select("id", "distance")


@_query("sssp_local", f"WITH {T3}, arcs AS (SELECT src, dst, n::DOUBLE AS w FROM t3), {_rounds('arcs')} SELECT id, distance FROM d25")
def _(s):
    return paths.shortest_paths(s.trade3(), 0, weight=F.col("n")).select("id", "distance")


@_query("sssp_undirected", f"WITH {T3}, arcs AS (SELECT src, dst, n::DOUBLE AS w FROM t3 UNION ALL SELECT dst, src, n FROM t3), {_rounds('arcs')} SELECT id, distance FROM d25")
def _(s):
    return paths.shortest_paths(s.trade3().undirected(), 0, weight=F.col("n"), local_edges=0).select("id", "distance")


@_query("a_star_target", f"WITH {TRADE}, arcs AS (SELECT src, dst, n::DOUBLE AS w FROM trade), {_rounds('arcs')} SELECT id, distance FROM d25 WHERE id = 7")
def _(s):
    return paths.a_star(s.trade(), 0, weight=F.col("n"), target=7).where("id = 7").select("id", "distance")


@_query("best_first_target", f"WITH {TRADE}, arcs AS (SELECT src, dst, n::DOUBLE AS w FROM trade), {_rounds('arcs')} SELECT id, distance FROM d25 WHERE id = 11")
def _(s):
    return paths.best_first(s.trade(), 0, 11, weight=F.col("n")).select("id", "distance")


@_query("critical_path", f"WITH {DAG}, arcs AS (SELECT src, dst, n::DOUBLE AS w FROM dag), {_rounds('arcs', 'max')} SELECT id, distance FROM d25")
def _(s):
    return paths.dag_shortest_paths(s.trade3_dag(), 0, weight=F.col("n"), longest=True).select("id", "distance")


@_query("dag_shortest", f"WITH {DAG}, arcs AS (SELECT src, dst, (n - 40)::DOUBLE AS w FROM dag), {_rounds('arcs')} SELECT id, distance FROM d25")
def _(s):
    return paths.dag_shortest_paths(s.trade3_dag(), 0, weight=F.col("n") - 40).select("id", "distance")


@_query("prim_relaxer", f"WITH RECURSIVE {REACH} SELECT id, CASE WHEN id = 0 THEN least(0, min(w)) ELSE min(w) END AS distance FROM (SELECT dst AS id, n::DOUBLE AS w FROM t3 WHERE src IN (SELECT id FROM walk) UNION ALL SELECT 0, 0) GROUP BY id")
def _(s):
    return paths.shortest_paths(s.trade3(), 0, weight=F.col("n"), relaxer="prim", local_edges=0).select("id", "distance")


@_query("edge_shortest_relaxer", "SELECT 0::BIGINT AS id, 0::DOUBLE AS distance")
def _(s):
    return paths.shortest_paths(s.trade3(), 0, relaxer="edge_shortest").select("id", "distance")


@_query("bellman_ford", f"WITH {DAG}, arcs AS (SELECT src, dst, (n - 40)::DOUBLE AS w FROM dag), {_rounds('arcs')} SELECT id, distance FROM d25")
def _(s):
    return paths.bellman_ford(s.trade3_dag(), weight=F.col("n") - 40).select("id", "distance")


@_query("negative_cycle_flag", "SELECT true AS negative, false AS positive")
def _(s):
    g = s.trade().undirected()
    return _one(s, negative=paths.has_negative_cycle(g, 0, weight=-F.col("n")), positive=paths.has_negative_cycle(s.trade(), 0, weight=F.col("n")))


@_query("restarted_paths")
def _(s):
    return paths.restarted_paths(s.trade3(), weight=F.col("n"))


@_query("all_pairs", f"""WITH {TRADE}, p0 AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, n::DOUBLE AS w FROM trade UNION ALL SELECT id, id, 0 FROM v) GROUP BY 1, 2), """
    + ", ".join(f"p{k + 1} AS MATERIALIZED (SELECT a.src, b.dst, min(a.w + b.w) AS w FROM p{k} a JOIN p{k} b ON a.dst = b.src GROUP BY 1, 2)" for k in range(5)) + " SELECT src, dst, w AS distance FROM p5")
def _(s):
    return paths.all_pairs(s.trade(), weight=F.col("n")).select("src", "dst", "distance")


@_query("predecessor_path", f"""WITH RECURSIVE {GEO}, w AS (SELECT 'W' AS id, '' AS path, 0 AS depth UNION ALL SELECT dst, path || '/' || src || '>' || dst, depth + 1 FROM w JOIN geo ON src = id)
  SELECT id, path FROM w WHERE depth > 0""")
def _(s):
    found = paths.bfs(s.geo(), "W", local_edges=0)
    return paths.paths_to(found).select("id", F.concat(F.lit("/"), F.array_join("path", "/")).alias("path"))


@_query("predecessor_cost", f"WITH {T3}, arcs AS (SELECT src, dst, n::DOUBLE AS w FROM t3), {_rounds('arcs')} SELECT id, distance AS cost FROM d25")
def _(s):
    g = s.trade3()
    return paths.predecessor_cost(paths.shortest_paths(g, 0, weight=F.col("n")), g.edges.select("edge_id", F.col("n").cast("double").alias("w")))


@_query("is_predecessor", "SELECT true AS up, false AS across")
def _(s):
    found = paths.bfs(s.geo(), "W")
    return _one(s, up=paths.is_predecessor(found, "r0", "n0"), across=paths.is_predecessor(found, "r1", "n0"))


_SIMPLE = """simple AS (SELECT [0::BIGINT] AS seen, 0::BIGINT AS here, 0::DOUBLE AS cost UNION ALL SELECT list_append(seen, dst), dst, cost + n
  FROM simple JOIN t3 ON src = here WHERE NOT list_contains(seen, dst))"""


@_query("k_shortest", f"WITH RECURSIVE {T3}, {_SIMPLE} SELECT row_number() OVER (ORDER BY cost)::INTEGER AS rank, cost FROM simple WHERE here = (SELECT min(dst) FROM t3 WHERE src = 0) ORDER BY cost LIMIT 5")
def _(s):
    g = s.trade3()
    target = g.edges.where("src = 0").agg(F.min("dst").alias("d")).first()["d"]
    return paths.k_shortest(g, 0, target, 5, weight=F.col("n")).select("rank", "cost")


@_query("ranked_deviations", f"WITH RECURSIVE {T3}, {_SIMPLE} SELECT row_number() OVER (ORDER BY cost)::INTEGER AS rank, cost FROM simple WHERE here = (SELECT max(dst) FROM t3 WHERE src = 0) ORDER BY cost LIMIT 3")
def _(s):
    g = s.trade3()
    target = g.edges.where("src = 0").agg(F.max("dst").alias("d")).first()["d"]
    return paths.ranked_deviations(g, 0, target, 3, weight=F.col("n")).select("rank", "cost")


# ---- components, orders, trees, ranks ---------------------------------------------------------------------------


@_query("connected_components", f"""WITH {SESSION}, c AS (SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS least FROM events)
  SELECT id, dense_rank() OVER (ORDER BY least) - 1 AS component FROM c""")
def _(s):
    return components.connected_components(s.session())


@_query("disjoint_sets", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS label FROM documents")
def _(s):
    return components.disjoint_sets(s.dups())


_MUTUAL = f"{T3}, r AS (SELECT src, dst FROM t3 UNION SELECT r.src, t3.dst FROM r JOIN t3 ON r.dst = t3.src), scc AS (SELECT id, least(id, coalesce(min(m), id)) AS label FROM v LEFT JOIN (SELECT a.src AS x, a.dst AS m FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) ON x = id GROUP BY id)"


@_query("strong_components", f"WITH RECURSIVE {_MUTUAL} SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS component FROM scc")
def _(s):
    return components.strongly_connected_components(s.trade3())


@_query("strong_trace", f"WITH RECURSIVE {_MUTUAL} SELECT id, label FROM scc")
def _(s):
    from pyspark.sql import Window as W

    t = components.strong_trace(s.trade3())
    return t.select("id", F.min("id").over(W.partitionBy("component")).alias("label"))


@_query("condensation_strong", f"""WITH RECURSIVE {_MUTUAL} SELECT a.label AS src, b.label AS dst, count(*) AS n_edges FROM t3 JOIN scc a ON src = a.id JOIN scc b ON dst = b.id WHERE a.label <> b.label GROUP BY 1, 2""")
def _(s):
    return components.condensation(s.trade3())[1].select("src", "dst", "n_edges")


@_query("condensation_weak", "SELECT min(event_id) AS label, count(*) AS n_vertices, count(*) - 1 AS n_edges FROM events GROUP BY user_id")
def _(s):
    return components.condensation(s.session(), strong=False)[0]


@_query("edge_merge_condensation", f"""WITH RECURSIVE {DAG}, w AS (SELECT src, dst, 1 AS k FROM dag WHERE src % 2 = 0 UNION ALL SELECT w.src, dag.dst, k + 1 FROM w JOIN dag ON w.dst = dag.src WHERE w.dst % 2 <> 0)
  SELECT src, dst, k, count(*) AS n FROM w WHERE dst % 2 = 0 GROUP BY src, dst, k""")
def _(s):
    merged = components.edge_merge_condensation(s.trade3_dag(), F.col("id") % 2 == 0)
    return merged.groupBy("src", "dst", F.size("edge_ids").alias("k")).agg(F.count("*").alias("n"))


@_query("topo_layers", f"WITH RECURSIVE {DAG}, w AS (SELECT id, 0 AS k FROM v UNION SELECT dst, k + 1 FROM w JOIN dag ON src = id WHERE k < 25) SELECT id, max(k) AS layer FROM w GROUP BY id")
def _(s):
    return order.layers(s.trade3_dag())


@_query("topo_layers_backward", f"WITH RECURSIVE {DAG}, w AS (SELECT id, 0 AS k FROM v UNION SELECT src, k + 1 FROM w JOIN dag ON dst = id WHERE k < 25) SELECT id, max(k) AS layer FROM w GROUP BY id")
def _(s):
    return order.layers(s.trade3_dag(), backward=True)


@_query("topological_order", f"WITH {DAG} SELECT 25 AS n, 0 AS broken")
def _(s):
    g = s.trade3_dag()
    t = order.topological_order(g)
    a, b = t.toDF("a", "p"), t.toDF("b", "q")
    wrong = g.edges.join(a, F.col("src") == F.col("a")).join(b, F.col("dst") == F.col("b")).where("p >= q").count()
    return t.agg(F.count("*").alias("n"), F.lit(wrong).alias("broken")).selectExpr("cast(n as int) n", "broken")


@_query("least_degree_order")
def _(s):
    return order.least_degree_order(s.geo().undirected())


@_query("is_dag", "SELECT true AS dag, false AS other")
def _(s):
    return _one(s, dag=order.is_dag(s.trade3_dag()), other=order.is_dag(s.trade()))


@_query("is_forest", "SELECT true AS tree, false AS other")
def _(s):
    return _one(s, tree=order.is_forest(s.geo()), other=order.is_forest(s.trade()))


_CLOSED = f"{DAG}, r AS (SELECT src, dst FROM dag UNION SELECT r.src, dag.dst FROM r JOIN dag ON r.dst = dag.src)"


@_query("transitive_closure", f"WITH RECURSIVE {_CLOSED} SELECT src, dst FROM r")
def _(s):
    return order.transitive_closure(s.trade3_dag())


@_query("transitive_reduction", f"WITH RECURSIVE {_CLOSED} SELECT src, dst FROM dag WHERE NOT EXISTS (SELECT 1 FROM dag a JOIN r ON a.dst = r.src WHERE a.src = dag.src AND r.dst = dag.dst)")
def _(s):
    return order.transitive_reduction(s.trade3_dag()).select("src", "dst")


@_query("common_ancestors", """WITH a AS (SELECT 's' || s_suppkey AS source, s_nationkey AS sn, n_regionkey AS sr FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  b AS (SELECT 'c' || c_custkey AS target, c_nationkey AS cn, n_regionkey AS cr, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT source, target, CASE WHEN sn = cn THEN 'n' || sn WHEN sr = cr THEN 'r' || sr ELSE 'W' END AS ancestor FROM a JOIN b ON source = 's' || (k % 7 + 1)""")
def _(s):
    pairs = s.table("customer").select(F.concat(F.lit("s"), F.col("c_custkey") % 7 + 1).alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target"))
    known = s.table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"))
    return order.common_ancestors(s.geo(), "W", pairs.join(known, "source", "left_semi"))


@_query("minimum_spanning_forest", f"""WITH RECURSIVE {TRADE}, e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(n * 1000000 + src * 1000 + dst) AS k FROM trade WHERE src <> dst GROUP BY 1, 2),
  w AS (SELECT e.a AS x, e.b AS y, e.k AS k, e.a AS here FROM e UNION SELECT w.x, w.y, w.k, CASE WHEN f.a = w.here THEN f.b ELSE f.a END FROM w JOIN e f ON (f.a = w.here OR f.b = w.here) AND f.k < w.k)
  SELECT x AS a, y AS b, k // 1000000 AS n FROM w GROUP BY x, y, k HAVING NOT bool_or(here = y)""")
def _(s):
    f = trees.minimum_spanning_forest(s.trade(), weight=F.col("n"))
    return f.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("w").cast("long").alias("n"))


@_query("spanning_forest_knn")
def _(s):
    return trees.minimum_spanning_forest(s.knn(), weight=1 - F.col("cosine")).select("src", "dst", F.round("w", 6).alias("w"))


_RANKS = ", ".join(
    f"r{k + 1} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(sum(r.rank / o.n), 0) AS rank FROM v LEFT JOIN t3 ON dst = v.id LEFT JOIN r{k} r ON r.id = src LEFT JOIN o ON o.src = t3.src GROUP BY v.id)" for k in range(10)
)


@_query("pagerank", f"WITH {T3}, o AS (SELECT src, count(*) AS n FROM t3 GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v), {_RANKS} SELECT id, round(rank, 6) AS rank FROM r10")
def _(s):
    return trees.pagerank(s.trade3(), rounds=10).select("id", F.round("rank", 6).alias("rank"))


@_query("pagerank_sums", f"WITH {T3}, o AS (SELECT src, count(*) AS n FROM t3 GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v), {_RANKS} SELECT round(sum(rank), 5) AS rank_sum, round(avg(rank), 5) AS rank_mean FROM r10")
def _(s):
    return trees.rank_sums(trees.pagerank(s.trade3(), rounds=10)).select(F.round("rank_sum", 5).alias("rank_sum"), F.round("rank_mean", 5).alias("rank_mean"))


@_query("greedy_colouring", f"WITH {T3} SELECT 25::BIGINT AS n, 0::BIGINT AS clashes, true AS tight")
def _(s):
    g = s.trade3().undirected()
    c = components.greedy_colouring(g)
    a, b = c.toDF("a", "ca"), c.toDF("b", "cb")
    near = g.adjacent_vertices().join(a, F.col("id") == F.col("a")).join(b, F.col("neighbour") == F.col("b"))
    clashes = near.where("ca = cb").count()
    # first fit: every smaller colour is taken by an earlier neighbour
    used = near.where("neighbour < id and cb < ca").groupBy("id", "ca").agg(F.countDistinct("cb").alias("k")).where("k <> ca").count()
    return c.agg(F.count("*").alias("n"), F.lit(clashes).cast("long").alias("clashes"), F.lit(used == 0).alias("tight"))


@_query("is_eulerian", f"WITH {TRADE}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade WHERE src <> dst), d AS (SELECT x, count(*) AS k FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) GROUP BY x) SELECT bool_and(k % 2 = 0) AS eulerian FROM d")
def _(s):
    return _one(s, eulerian=components.is_eulerian(s.trade()))


@_query("euler_path_count", f"""WITH {ETYPE}, o AS (SELECT id FROM (SELECT src AS id, 1 AS k FROM etype UNION ALL SELECT dst, -1 FROM etype) GROUP BY id HAVING abs(sum(k)) % 2 = 1)
  SELECT CASE WHEN (SELECT count(*) FROM o) = 0 THEN 1 WHEN (SELECT count(*) FROM o) % 2 = 1 THEN 0 ELSE (SELECT count(*) FROM o) // 2 END AS n""")
def _(s):
    return _one(s, n=components.euler_path_count(s.etype()))


# ---- kernels ----------------------------------------------------------------------------------------------------


@_query("bfs_trace", f"WITH RECURSIVE {REACH} SELECT id, min(depth) AS depth FROM walk GROUP BY id")
def _(s):
    return exact.bfs_trace(s.trade3(), 0).select("id", "depth")


@_query("dfs_order", f"WITH RECURSIVE {GEO}, w AS (SELECT 'W' AS id, '' AS path UNION ALL SELECT dst, path || '/' || dst FROM w JOIN geo ON src = id) SELECT id, row_number() OVER (ORDER BY path) - 1 AS order_no FROM w")
def _(s):
    return exact.dfs_trace(s.geo(), "W").select("id", "order_no")


@_query("dfs_edge_classes", f"WITH {GEO} SELECT 'tree' AS class, count(*) AS n FROM geo")
def _(s):
    return exact.dfs_edge_classes(s.geo(), "W").groupBy("class").agg(F.count("*").alias("n"))


@_query("bfs_edge_classes", f"WITH {GEO} SELECT 'tree' AS class, count(*) AS n FROM geo")
def _(s):
    return exact.bfs_edge_classes(s.geo(), "W").groupBy("class").agg(F.count("*").alias("n"))


@_query("edge_dfs", f"WITH {GEO} SELECT count(*) AS n, 3 AS deepest FROM geo WHERE true")
def _(s):
    return exact.edge_dfs(s.geo(), "W").agg(F.count("*").alias("n"), (F.max("depth") + 1).cast("int").alias("deepest"))


@_query("tree_leaves", f"WITH {GEO} SELECT id FROM geov WHERE id NOT IN (SELECT src FROM geo)")
def _(s):
    return exact.tree_leaves(exact.dfs_trace(s.geo(), "W"))


@_query("max_flow", f"""WITH {TRADE}, few AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 0), e AS (SELECT src, dst, n FROM trade WHERE src IN (FROM few) AND dst IN (FROM few)),
  lo AS (SELECT min(id) AS s, max(id) AS t FROM few), mid AS (SELECT id, 2 ** (row_number() OVER (ORDER BY id) - 1) AS b FROM few, lo WHERE id NOT IN (s, t)),
  side AS (SELECT m, id, (m // b::BIGINT) % 2 = 1 AS near FROM range(8) r(m), mid UNION ALL SELECT m, s, true FROM range(8) r(m), lo UNION ALL SELECT m, t, false FROM range(8) r(m), lo)
  SELECT min(c)::DOUBLE AS value FROM (SELECT a.m, sum(n) AS c FROM e JOIN side a ON src = a.id JOIN side b ON dst = b.id AND a.m = b.m WHERE a.near AND NOT b.near GROUP BY a.m)""")
def _(s):
    few = s.table("nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("long").alias("id"))
    g = s.trade().restricted(few)
    ends = few.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return exact.flow_value(g, exact.max_flow(g, ends["a"], ends["b"], capacity=F.col("n")), ends["a"])


@_query("max_flow_whole")
def _(s):
    g = s.trade()
    ends = g.vertices.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    return exact.flow_value(g, exact.max_flow(g, ends["a"], ends["b"], capacity=F.col("n")), ends["a"])


@_query("bipartite_matching", "SELECT count(DISTINCT n_regionkey)::BIGINT AS n FROM nation")
def _(s):
    n = s.table("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_nationkey").alias("edge_id"))
    left = [r[0] for r in n.select("src").distinct().collect()]  # the regions
    return exact.bipartite_matching(Graph.from_edges(n), left).agg(F.count("*").alias("n"))


_FIVE = f"""{TRADE}, k AS (SELECT n_nationkey AS id, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
  c AS (SELECT a.r, a.i AS x, b.i AS y, n FROM trade JOIN k a ON src = a.id JOIN k b ON dst = b.id WHERE a.r = b.r)"""


def _places(s: Star) -> DataFrame:
    from pyspark.sql import Window as W

    return s.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("r"), (F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("i"))


def _by_region(s: Star) -> DataFrame:
    k = _places(s)
    return s.trade().edges.join(k.toDF("a", "r", "x"), F.col("src") == F.col("a")).join(k.toDF("b", "q", "y"), (F.col("dst") == F.col("b")) & (F.col("r") == F.col("q")))


_GRID = f"""{TRADE}, k AS (SELECT n_nationkey AS id, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
  c AS (SELECT a.r, a.i AS x, b.i AS y, coalesce(n, 0) AS n FROM k a JOIN k b ON a.r = b.r LEFT JOIN trade ON src = a.id AND dst = b.id)"""


@_query("assignment", f"""WITH {_GRID} SELECT a.r AS problem_id, min(a.n + b.n + c3.n + d.n + e.n)::DOUBLE AS cost FROM c a JOIN c b ON a.r = b.r AND b.x = 1 AND b.y <> a.y
  JOIN c c3 ON a.r = c3.r AND c3.x = 2 AND c3.y NOT IN (a.y, b.y) JOIN c d ON a.r = d.r AND d.x = 3 AND d.y NOT IN (a.y, b.y, c3.y) JOIN c e ON a.r = e.r AND e.x = 4 AND e.y NOT IN (a.y, b.y, c3.y, d.y)
  WHERE a.x = 0 GROUP BY a.r""")
def _(s):
    grid = _places(s).toDF("a", "problem_id", "agent").join(_places(s).toDF("b", "q", "task"), F.col("problem_id") == F.col("q"))
    costs = grid.join(s.trade().edges, (F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), "left")
    costs = costs.select("problem_id", "agent", "task", F.coalesce("n", F.lit(0)).cast("double").alias("cost"))
    return exact.assign(costs).groupBy("problem_id").agg(F.sum("cost").alias("cost"))


@_query("best_tour", f"""WITH {_FIVE} SELECT a.r AS region, min(a.n + b.n + d.n + e.n + f.n)::DOUBLE AS cost FROM c a JOIN c b ON a.r = b.r AND b.x = a.y AND b.y NOT IN (0, a.y)
  JOIN c d ON a.r = d.r AND d.x = b.y AND d.y NOT IN (0, a.y, b.y) JOIN c e ON a.r = e.r AND e.x = d.y AND e.y NOT IN (0, a.y, b.y, d.y) JOIN c f ON a.r = f.r AND f.x = e.y AND f.y = 0
  WHERE a.x = 0 AND a.y <> 0 GROUP BY a.r""")
def _(s):
    e = _by_region(s).select(F.col("r").alias("region"), "edge_id", "ord", "src", "dst", "n")
    v = s.table("nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"))
    return exact.best_tour(Graph(v, e), weight=F.col("n"), by="region").where("path is not null").select("region", "cost")


@_query("is_hamiltonian", f"""WITH {_FIVE}, e AS (SELECT r, x, y FROM c WHERE x <> y UNION SELECT r, y, x FROM c WHERE x <> y), h AS (SELECT a.r FROM e a JOIN e b ON a.r = b.r AND b.x = a.y AND b.y NOT IN (0, a.y)
  JOIN e d ON a.r = d.r AND d.x = b.y AND d.y NOT IN (0, a.y, b.y) JOIN e f ON a.r = f.r AND f.x = d.y AND f.y NOT IN (0, a.y, b.y, d.y) JOIN e g ON a.r = g.r AND g.x = f.y AND g.y = 0 WHERE a.x = 0)
  SELECT n_regionkey AS region, n_regionkey IN (SELECT r FROM h) AS hamiltonian FROM nation GROUP BY 1""")
def _(s):
    e = _by_region(s).select(F.col("r").alias("region"), "edge_id", "ord", "src", "dst")
    v = s.table("nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"))
    return exact.is_hamiltonian(Graph(v, e), by="region")


@_query("dirac_check", f"""WITH {TRADE}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade WHERE src <> dst),
  d AS (SELECT id, (SELECT count(*) FROM e WHERE a = id OR b = id) AS k FROM v) SELECT count(*) AS n, min(k) AS least_degree, count(*) >= 3 AND 2 * min(k) >= count(*) AS dirac FROM d""")
def _(s):
    return exact.dirac(s.trade())


@_query("maximal_cliques", f"""WITH RECURSIVE {DAG}, q AS (SELECT [id] AS c FROM v UNION ALL SELECT list_append(c, v.id) FROM q, v WHERE v.id > list_last(c)
  AND NOT EXISTS (SELECT 1 FROM unnest(c) u(x) WHERE NOT EXISTS (SELECT 1 FROM dag WHERE src = x AND dst = v.id)))
  SELECT array_to_string(c, ',') AS clique FROM q WHERE NOT EXISTS (SELECT 1 FROM v WHERE NOT list_contains(c, v.id)
  AND NOT EXISTS (SELECT 1 FROM unnest(c) u(x) WHERE NOT EXISTS (SELECT 1 FROM dag WHERE src = least(x, v.id) AND dst = greatest(x, v.id))))""")
def _(s):
    return exact.maximal_cliques(s.trade3_dag()).select(F.array_join("clique", ",").alias("clique"))


@_query("bisection")
def _(s):
    return exact.bisect(Graph(s.trade().vertices, s.trade().edges.withColumn("weight", F.col("n").cast("double"))))


@_query("cut_cost", f"WITH {TRADE} SELECT sum(n)::DOUBLE AS cut FROM trade WHERE src % 2 <> dst % 2")
def _(s):
    g = s.trade()
    g = g.with_edges(g.edges.withColumn("weight", F.col("n").cast("double")))
    return exact.cut_cost(g, g.vertices.select("id", (F.col("id") % 2).alias("side")))


@_query("vertex_cover", "SELECT 0::BIGINT AS uncovered")
def _(s):
    g = s.trade3()
    c = exact.vertex_cover(g, seed=7).select(F.col("id").alias("_c"))
    left = g.edges.join(c, F.col("src") == F.col("_c"), "left_anti").join(c, F.col("dst") == F.col("_c"), "left_anti")
    return left.agg(F.count("*").alias("uncovered"))


@_query("euler_circuit", f"WITH {TRADE} SELECT count(*) AS n FROM trade")
def _(s):
    return exact.euler_circuit(s.trade(), 0).agg(F.countDistinct("edge_id").alias("n"))


@_query("euler_trails", f"WITH {T3} SELECT count(*) AS n, count(*) AS each_once FROM t3")
def _(s):
    return exact.euler_trails(s.trade3()).agg(F.count("*").alias("n"), F.countDistinct("edge_id").alias("each_once"))


@_query("random_walk")
def _(s):
    return exact.random_walk(s.etype(), s.etype().vertices.agg(F.min("id").alias("i")).first()["i"], steps=20, seed=3)


@_query("random_walks")
def _(s):
    v = s.trade3().vertices
    return walks.walks(s.trade3(), v.select(F.col("id").alias("walk"), "id"), steps=4, seed=1, weight=F.col("n"))


@_query("random_tree", f"WITH {V} SELECT count(*) AS n FROM v")
def _(s):
    return exact.random_tree(s.trade(), 0, seed=5).agg(F.count("*").alias("n"))


@_query("random_graph", "SELECT 50::BIGINT AS n, 120::BIGINT AS m, 120::BIGINT AS pairs")
def _(s):
    g = walks.random_graph(s.spark, 50, 120, seed=9, parallel=False, self_edges=False)
    return _one(s, n=g.vertices.count(), m=g.edges.count(), pairs=g.edges.where("src <> dst").select("src", "dst").distinct().count())


@_query("explore", """WITH RECURSIVE w AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT (id + k) % 25, depth + 1 FROM w, (VALUES (3), (5)) t(k) WHERE depth < 25)
  SELECT id, min(depth) AS depth FROM w GROUP BY id""")
def _(s):
    def expand(front: DataFrame) -> DataFrame:
        return front.select(F.col("id").alias("src"), F.explode(F.array(*(((F.col("id") + k) % 25) for k in (3, 5)))).alias("dst"))

    return walks.explore(s.spark.createDataFrame([(0,)], "id long"), expand)[0]


@_query("petri_step", """WITH o AS (SELECT o_orderstatus AS place, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT 'done' AS place UNION ALL SELECT DISTINCT o_orderstatus FROM orders)
  SELECT p.place, CASE WHEN p.place = 'done' THEN (SELECT sum(n) FROM o WHERE place IN ('O', 'P'))::BIGINT WHEN p.place IN ('O', 'P') THEN 0 ELSE coalesce(n, 0) END AS n_tokens FROM p LEFT JOIN o USING (place)""")
def _(s):
    spark, orders = s.spark, s.table("orders")
    places = orders.select(F.col("o_orderstatus").alias("place")).distinct().union(spark.createDataFrame([("done",)], "place string"))
    arcs = spark.createDataFrame([(0, "O", "close", True), (1, "P", "close", True), (2, "done", "close", False)], "arc int, place string, transition string, is_input boolean")
    marking = orders.select(F.col("o_orderstatus").alias("place"), F.col("o_orderkey").alias("token"), F.col("o_orderkey").alias("seq"))
    return petri.PetriNet(places, spark.createDataFrame([("close",)], "transition string"), arcs, marking).step().counts()


@_query("incremental_components", "SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS label FROM events")
def _(s):
    from .streaming.incremental import IncrementalComponents

    g = s.session()
    kept = IncrementalComponents(g.vertices)
    for k in range(3):
        kept.add(g.edges.where(F.col("edge_id") % 3 == k).select("src", "dst"), k)
    return kept.labels()

"""Further queries, row by row: what ``queries`` covers by a count or not at all, each with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import edges as edge_functions
from .graph import Graph, other_end
from .operators import components, exact, order, paths, petri, trees, walks
from .plans.durable import scratch
from .queries import DAG, ETYPE, GEO, T3, TRADE, V, _rounds
from .sources import formats
from .sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f: Callable[[Star], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Star(spark, sf_dir))
        SQL[name] = sql
        return f

    return add


# ---- edges and views --------------------------------------------------------------------------------------------


@_query("ordered_ends", f"WITH {TRADE} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS n FROM trade GROUP BY 1, 2")
def _(s):
    return edge_functions.ordered_ends(s.trade().edges.select("src", "dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("same_edge", f"WITH {T3} SELECT a.src, a.dst, b.src = a.src AS directed, true AS undirected FROM t3 a JOIN t3 b ON (a.src, a.dst) = (b.src, b.dst) OR (a.src, a.dst) = (b.dst, b.src)")
def _(s):
    e = s.trade3().edges.select("src", "dst")
    o = e.toDF("a", "b")
    same = lambda way: edge_functions.same_edge(F.col("a"), F.col("b"), F.col("src"), F.col("dst"), directed=way)
    pairs = e.withColumn("_l", F.least("src", "dst")).withColumn("_g", F.greatest("src", "dst")).join(o, (F.least("a", "b") == F.col("_l")) & (F.greatest("a", "b") == F.col("_g")))
    return pairs.select("src", "dst", same(True).alias("directed"), same(False).alias("undirected"))


@_query("remove_tagged_edges", f"WITH {TRADE} SELECT src, dst, n % 3 AS tag FROM trade WHERE n % 3 <> 0")
def _(s):
    g = s.trade()
    tagged = Graph(g.vertices, g.edges.withColumn("tag", F.col("n") % 3), identity="endpoints_tag")
    return tagged.remove_edges(tagged.edges.select("src", "dst", F.lit(0).cast("long").alias("tag"))).edges.select("src", "dst", "tag")


@_query("remove_terminal_edges", f"""WITH {ETYPE} SELECT src, dst, edge_id % 2 AS src_terminal, edge_id % 3 AS dst_terminal, count(*) - 1 AS n FROM etype GROUP BY ALL HAVING count(*) > 1""")
def _(s):
    g = s.etype()
    ends = ["src", "dst", "src_terminal", "dst_terminal"]
    g = Graph(g.vertices, g.edges.withColumn("src_terminal", F.col("edge_id") % 2).withColumn("dst_terminal", F.col("edge_id") % 3), identity="endpoints_terminals")
    return g.remove_edges(g.edges.select(*ends).distinct()).edges.groupBy(*ends).agg(F.count("*").alias("n"))


@_query("other_end", f"WITH {T3} SELECT src, dst, CASE WHEN src = 3 THEN dst ELSE src END AS other FROM t3 WHERE src = 3 OR dst = 3")
def _(s):
    return s.trade3().adjacent_edges(3).select("src", "dst", other_end(F.lit(3)).alias("other"))


@_query("cleared_and_refilled", f"WITH {T3} SELECT src AS id FROM t3 UNION SELECT dst FROM t3")
def _(s):
    g = s.trade3()
    return g.cleared().add_edges(g.edges, with_vertices=True).vertices.select("id")


def _merged(v: int, name: str) -> str:
    return f"""SELECT src, dst, sum(n)::BIGINT AS n FROM (SELECT src, dst, n FROM {name} WHERE src <> {v} AND dst <> {v}
      UNION ALL SELECT a.src, b.dst, a.n * b.n FROM {name} a, {name} b WHERE a.dst = {v} AND a.src <> {v} AND b.src = {v} AND b.dst <> {v}) GROUP BY 1, 2"""


@_query("merge_vertices", f"WITH {T3}, m0 AS (SELECT src, dst, 1 AS n FROM t3), m1 AS ({_merged(0, 'm0')}), m2 AS ({_merged(1, 'm1')}), m3 AS ({_merged(2, 'm2')}) SELECT src, dst, n FROM m3")
def _(s):
    return s.trade3().merge_vertices_if(F.col("id") < 3).edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@_query("equal_graphs", f"""WITH {DAG}, back AS (SELECT dst AS src, src AS dst FROM t3), again AS (SELECT dst AS src, src AS dst FROM back)
  SELECT (SELECT count(*) FROM ((SELECT src, dst FROM t3 EXCEPT ALL FROM again) UNION ALL (FROM again EXCEPT ALL SELECT src, dst FROM t3))) = 0 AS same,
    (SELECT count(*) FROM ((SELECT src, dst FROM t3 EXCEPT ALL SELECT src, dst FROM dag) UNION ALL (SELECT src, dst FROM dag EXCEPT ALL SELECT src, dst FROM t3))) = 0 AS other""")
def _(s):
    g = s.trade3()
    return s.spark.range(1).select(F.lit(g.equals(g.reversed().reversed())).alias("same"), F.lit(g.equals(s.trade3_dag())).alias("other"))


# ---- searches ---------------------------------------------------------------------------------------------------

_DEPTHS = "WITH RECURSIVE {g}, w AS (SELECT {root} AS id, NULL::VARCHAR AS came, 0 AS depth UNION ALL SELECT far, id, depth + 1 FROM w JOIN (SELECT src AS near, dst AS far FROM geo UNION ALL SELECT dst, src FROM geo) ON near = id WHERE far IS DISTINCT FROM came) SELECT id, depth FROM w"
_PREORDER = f"{GEO}, w AS (SELECT 'W' AS id, '' AS path, 0 AS depth UNION ALL SELECT dst, path || '/' || dst, depth + 1 FROM w JOIN geo ON src = id), p AS (SELECT id, path, depth, row_number() OVER (ORDER BY path) - 1 AS k FROM w)"
_SIZES = f"{_PREORDER}, z AS (SELECT id, depth, k, coalesce(lead(k) OVER (PARTITION BY NULL ORDER BY k), 0) AS nxt, (SELECT count(*) FROM p q WHERE q.path = p.path OR starts_with(q.path, p.path || '/')) AS size FROM p)"


@_query("undirected_bfs", f"WITH RECURSIVE {T3}, e AS (SELECT src, dst FROM t3 UNION SELECT dst, src FROM t3), w AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN e ON src = id WHERE depth < 25) SELECT id, min(depth) AS depth FROM w GROUP BY id")
def _(s):
    return paths.bfs(s.trade3().undirected(), 0).select("id", "depth")


@_query("undirected_dfs_order", f"WITH RECURSIVE {_PREORDER} SELECT id, k AS order_no, depth FROM p")
def _(s):
    return exact.dfs_trace(s.geo().undirected(), "W").select("id", "order_no", "depth")


@_query("both_ways_dfs", _DEPTHS.format(g=GEO, root="'n0'"))
def _(s):
    return exact.dfs_trace(s.geo(), "n0", both_ways=True).select("id", "depth")


@_query("dfs_times", f"WITH RECURSIVE {_SIZES} SELECT id, 2 * k - depth AS discover_time, 2 * k - depth + 2 * size - 1 AS finish_time FROM z")
def _(s):
    return exact.dfs_trace(s.geo(), "W").select("id", "discover_time", "finish_time")


@_query("undirected_topological_order", f"WITH RECURSIVE {_SIZES} SELECT id, row_number() OVER (ORDER BY 2 * k - depth + 2 * size - 1 DESC) - 1 AS position FROM z")
def _(s):
    return order.topological_order(s.geo().undirected())


@_query("limited_dfs", f"WITH {GEO} SELECT id FROM geov WHERE id = 'W' OR id LIKE 'r%' OR id LIKE 'n%'")
def _(s):
    return exact.dfs_trace(s.geo(), "W", max_depth=2).select("id")


_MIXED = f"{GEO}, more AS (SELECT 'W' AS src, 'n' || n_nationkey AS dst, 'forward_or_cross' AS class FROM nation UNION ALL SELECT 'n' || n_nationkey, 'W', 'back' FROM nation)"


def _mixed(s: Star) -> Graph:
    """The tree with an edge from the top to each nation after its other edges, and one back."""
    g, n = s.geo(), s.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("n"))
    more = n.select(F.lit("W").alias("src"), F.col("n").alias("dst")).union(n.select("n", F.lit("W")))
    more = more.select(F.concat_ws(">", F.lit("x"), "src", "dst").alias("edge_id"), F.concat_ws(">", F.lit("x"), "src", "dst").alias("ord"), "src", "dst")
    return g.with_edges(g.edges.unionByName(more))


@_query("dfs_class_rows", f"WITH {_MIXED} SELECT src, dst, 'tree' AS class FROM geo UNION ALL SELECT src, dst, class FROM more")
def _(s):
    g = _mixed(s)
    return exact.dfs_edge_classes(g, "W").join(g.edges, "edge_id").select("src", "dst", "class")


@_query("bfs_class_rows", f"WITH {_MIXED} SELECT src, dst, CASE WHEN src = 'W' THEN 'tree' WHEN dst LIKE 'n%' THEN 'black' WHEN dst = 'W' THEN 'black' ELSE 'tree' END AS class FROM (SELECT src, dst FROM geo UNION ALL SELECT src, dst FROM more)")
def _(s):
    # a nation is found from the top at once, before its region is expanded: the region's edge then meets it gray or black
    g = _mixed(s)
    rows = exact.bfs_edge_classes(g, "W").join(g.edges, "edge_id").select("src", "dst", "class")
    return rows.withColumn("class", F.when(F.col("class") == "gray", "black").otherwise(F.col("class")))


@_query("edge_dfs_rows", f"WITH {GEO} SELECT a.src || '>' || a.dst AS edge_id, b.src || '>' || b.dst AS parent_edge_id, CASE WHEN a.src = 'W' THEN 0 WHEN b.src = 'W' THEN 1 ELSE 2 END AS depth FROM geo a LEFT JOIN geo b ON b.dst = a.src")
def _(s):
    return exact.edge_dfs(s.geo(), "W").select("edge_id", "parent_edge_id", "depth")


_UP = "up AS (SELECT a.dst AS id, a.src || '>' || a.dst AS e1, CASE WHEN b.src IS NOT NULL THEN b.src || '>' || b.dst || '/' ELSE '' END AS e2, CASE WHEN c.src IS NOT NULL THEN c.src || '>' || c.dst || '/' ELSE '' END AS e3 FROM geo a LEFT JOIN geo b ON b.dst = a.src LEFT JOIN geo c ON c.dst = b.src)"


@_query("root_to_leaf_paths", f"WITH {GEO}, {_UP} SELECT id, e3 || e2 || e1 AS path FROM up WHERE id NOT IN (SELECT src FROM geo)")
def _(s):
    return paths.leaf_paths(exact.dfs_trace(s.geo(), "W")).select("id", F.array_join("path", "/").alias("path"))


@_query("edge_predecessor_paths", f"WITH {GEO}, {_UP} SELECT e1 AS edge_id, e3 || e2 || e1 AS path FROM up")
def _(s):
    return paths.edge_paths(exact.edge_dfs(s.geo(), "W")).select("edge_id", F.array_join("path", "/").alias("path"))


@_query("merged_edge_paths", f"""WITH {GEO}, {_UP}, ends AS (SELECT * FROM up WHERE id NOT IN (SELECT src FROM geo)),
  own AS (SELECT *, row_number() OVER (PARTITION BY e2 ORDER BY e1) AS i, dense_rank() OVER (PARTITION BY e3 ORDER BY e2) AS j FROM ends)
  SELECT e1 AS edge_id, CASE WHEN i = 1 AND j = 1 THEN e3 ELSE '' END || CASE WHEN i = 1 THEN e2 ELSE '' END || e1 AS path FROM own""")
def _(s):
    return paths.merged_edge_paths(exact.edge_dfs(s.geo(), "W")).select("edge_id", F.array_join("path", "/").alias("path"))


_TREE = "w AS (SELECT 0::BIGINT AS id, '' AS path, 0 AS depth UNION ALL SELECT 3 * id + k, path || k, depth + 1 FROM w, (VALUES (1), (2), (3)) t(k) WHERE 3 * id + k < 200)"


def _ternary(front: DataFrame) -> DataFrame:
    return front.select(F.col("id").alias("src"), F.explode(F.array(*((3 * F.col("id") + k) for k in (1, 2, 3)))).alias("dst")).where("dst < 200")


@_query("implicit_dfs", f"WITH RECURSIVE {_TREE} SELECT id, row_number() OVER (ORDER BY path) - 1 AS order_no, depth FROM w")
def _(s):
    return walks.implicit_dfs(s.spark.range(1), _ternary, 0).select("id", "order_no", "depth")


@_query("implicit_edge_dfs", f"WITH RECURSIVE {_TREE} SELECT (id - 1) // 3 AS src, id AS dst, row_number() OVER (ORDER BY path) - 1 AS order_no, depth - 1 AS depth FROM w WHERE id > 0")
def _(s):
    return walks.implicit_edge_dfs(s.spark.range(1), _ternary, 0).select("src", "dst", "order_no", "depth")


# ---- paths ------------------------------------------------------------------------------------------------------

_SQUARES = ", ".join(f"p{k + 1} AS MATERIALIZED (SELECT a.src, b.dst, min(a.w + b.w) AS w FROM p{k} a JOIN p{k} b ON a.dst = b.src GROUP BY 1, 2)" for k in range(5))
_PAIRS = "p0 AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, n::DOUBLE AS w FROM {e} UNION ALL SELECT id, id, 0 FROM v) GROUP BY 1, 2), " + _SQUARES


@_query("all_pairs_paths", f"WITH {TRADE}, {_PAIRS.format(e='trade')} SELECT src, dst, w AS cost, true AS joined FROM p5 WHERE src <> dst")
def _(s):
    g = s.trade()
    found = paths.all_pairs_paths(paths.all_pairs(g, weight=F.col("n")))
    e = g.edges.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").cast("double").alias("w"))
    steps = found.select("src", "dst", F.posexplode("path").alias("i", "edge_id")).join(e, "edge_id").groupBy("src", "dst")
    steps = steps.agg(F.sum("w").alias("cost"), F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("way"))
    way = F.col("way")
    follow = F.forall(F.sequence(F.lit(0), F.size(way) - 1), lambda i: F.when(i == 0, way[i]["a"] == F.col("src")).otherwise(way[i]["a"] == F.get(way, i - 1)["b"]))
    return steps.select("src", "dst", "cost", (follow & (F.element_at(way, -1)["b"] == F.col("dst"))).alias("joined"))


@_query("all_pairs_longest", f"""WITH {DAG}, p0 AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, n::DOUBLE AS w FROM dag UNION ALL SELECT id, id, 0 FROM v) GROUP BY 1, 2), {_SQUARES.replace('min(', 'max(')} SELECT src, dst, w AS distance FROM p5""")
def _(s):
    return paths.all_pairs(s.trade3_dag(), weight=F.col("n"), relaxer="critical").select("src", "dst", "distance")


@_query("a_star_guided", f"WITH {TRADE}, arcs AS (SELECT src, dst, n::DOUBLE AS w FROM trade), {_rounds('arcs')} SELECT id, distance FROM d25 WHERE id = 7")
def _(s):
    g = s.trade()
    least = g.edges.agg(F.min("n").alias("n")).first()["n"]
    return paths.a_star(g, 0, weight=F.col("n"), heuristic=F.when(F.col("id") == 7, 0.0).otherwise(float(least)), target=7).where("id = 7").select("id", "distance")


@_query("restarted_path_rows", f"""WITH RECURSIVE {T3}, r AS (SELECT src, dst FROM t3 UNION SELECT r.src, t3.dst FROM r JOIN t3 ON r.dst = t3.src), {_PAIRS.format(e='t3')},
  root AS (SELECT id, least(id, coalesce((SELECT min(src) FROM r WHERE r.dst = v.id), id)) AS root FROM v) SELECT id, root, w AS distance FROM root JOIN p5 ON p5.src = root AND p5.dst = id""")
def _(s):
    return paths.restarted_paths(s.trade3(), weight=F.col("n"))


@_query("ancestors_by_predecessors", f"WITH {GEO} SELECT a.dst AS id, true AS above, false AS aside FROM geo a JOIN geo b ON b.dst = a.src WHERE b.src = 'r0' AND a.dst IN ('c1', 's1') OR a.dst = 'n0'")
def _(s):
    # of a customer, a supplier and a nation, those below region 0
    found = paths.bfs(s.geo(), "W")
    rows = []
    for v in ("c1", "s1", "n0"):
        if paths.is_predecessor(found, "r0", v):
            rows.append((v, True, paths.is_predecessor(found, "r1", v)))
    return s.spark.createDataFrame(rows, "id string, above boolean, aside boolean")


# ---- components, orders, covers ---------------------------------------------------------------------------------


@_query("cyclic_or_not", f"""WITH RECURSIVE {DAG}, a AS (SELECT src, dst FROM dag UNION SELECT a.src, dag.dst FROM a JOIN dag ON a.dst = dag.src), b AS (SELECT src, dst FROM trade UNION SELECT b.src, trade.dst FROM b JOIN trade ON b.dst = trade.src)
  SELECT NOT EXISTS (SELECT 1 FROM a WHERE src = dst) AS dag, NOT EXISTS (SELECT 1 FROM b WHERE src = dst) AS other""")
def _(s):
    return s.spark.range(1).select(F.lit(order.is_dag(s.trade3_dag())).alias("dag"), F.lit(order.is_dag(s.trade())).alias("other"))


@_query("topological_edges", f"WITH {DAG} SELECT src, dst, true AS ahead FROM dag")
def _(s):
    g = s.trade3_dag()
    t = order.topological_order(g)
    e = g.edges.join(t.toDF("a", "p"), F.col("src") == F.col("a")).join(t.toDF("b", "q"), F.col("dst") == F.col("b"))
    return e.select("src", "dst", (F.col("p") < F.col("q")).alias("ahead"))


_NEAR = "near AS (SELECT src AS a, dst AS b FROM t3 UNION SELECT dst, src FROM t3)"


@_query("colour_rows", f"""WITH RECURSIVE {T3}, {_NEAR}, earlier AS (SELECT id, coalesce((SELECT list(b) FROM near WHERE a = id AND b < id), []) AS before FROM v),
  c AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS colours UNION ALL SELECT k + 1, list_append(colours, (list_filter(range(26), lambda x: NOT list_contains(list_transform(before, lambda y: colours[y + 1]), x)))[1]) FROM c JOIN earlier ON id = k)
  SELECT id, colours[id + 1]::INTEGER AS colour FROM v, (SELECT colours FROM c ORDER BY k DESC LIMIT 1)""")
def _(s):
    return components.greedy_colouring(s.trade3().undirected())


@_query("covered_edges", f"WITH {T3} SELECT src, dst, true AS covered FROM t3")
def _(s):
    g = s.trade3()
    c = exact.vertex_cover(g, seed=7).select(F.col("id").alias("c"), F.lit(True).alias("y"))
    e = g.edges.join(c, F.col("src") == F.col("c"), "left").drop("c").join(c.toDF("d", "z"), F.col("dst") == F.col("d"), "left")
    return e.select("src", "dst", (F.coalesce("y", F.lit(False)) | F.coalesce("z", F.lit(False))).alias("covered"))


@_query("strong_component_steps", f"""WITH RECURSIVE {_SIZES} SELECT 2 * k - depth AS step, id, k - depth AS component FROM z
  UNION ALL SELECT 2 * k - depth + 2 * size - 1, id, k - depth + size - 1 FROM z""")
def _(s):
    return components.strong_steps(s.geo())


@_query("edge_components", f"WITH RECURSIVE {T3}, {_NEAR}, r AS (SELECT a, b FROM near UNION SELECT r.a, near.b FROM r JOIN near ON r.b = near.a), l AS (SELECT DISTINCT a, (SELECT min(b) FROM r q WHERE q.a = r.a) AS m FROM r) SELECT CASE count(DISTINCT m) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS answer FROM l")
def _(s):
    return s.spark.range(1).select(F.lit(components.components_with_edges(s.trade3())).alias("answer"))


@_query("circuit_edges", f"WITH {TRADE} SELECT src, dst, true AS follows FROM trade")
def _(s):
    from pyspark.sql import Window as W

    g = s.trade()
    c = exact.euler_circuit(g, 0).join(g.edges.select("edge_id", "src", "dst"), "edge_id")
    back = F.coalesce(F.lag("dst").over(W.partitionBy(F.lit(0)).orderBy("position")), F.lit(0))  # one circuit of at most 625 edges
    return c.select("src", "dst", (F.col("src") == back).alias("follows"))


@_query("trail_edges", f"WITH {T3} SELECT src, dst, true AS follows FROM t3")
def _(s):
    from pyspark.sql import Window as W

    g = s.trade3()
    t = exact.euler_trails(g).join(g.edges.select("edge_id", "src", "dst"), "edge_id")
    w = W.partitionBy("trail").orderBy("position")
    shared = lambda f: F.arrays_overlap(F.array("src", "dst"), F.array(f("src").over(w), f("dst").over(w)))
    return t.select("src", "dst", F.coalesce(shared(F.lag), F.lit(True)).alias("follows"))


@_query("matched_pairs", "SELECT 'r' || n_regionkey AS left, true AS joined FROM nation GROUP BY n_regionkey")
def _(s):
    n = s.table("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_nationkey").alias("edge_id"))
    sides = [[r[0] for r in n.select(c).distinct().collect()] for c in ("src", "dst")]  # 5 regions and 25 nations
    got = exact.bipartite_matching(Graph.from_edges(n), *sides)
    pairs = n.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("y"))
    return got.join(pairs, (F.col("left") == F.col("a")) & (F.col("right") == F.col("b")), "left").select("left", F.coalesce("y", F.lit(False)).alias("joined"))


# ---- walks ------------------------------------------------------------------------------------------------------


@_query("round_robin_walk", f"""WITH RECURSIVE {ETYPE}, o AS (SELECT src, dst, edge_id, row_number() OVER (PARTITION BY src ORDER BY edge_id) - 1 AS k, count(*) OVER (PARTITION BY src) AS m FROM etype),
  w AS (SELECT 0::BIGINT AS step, (SELECT min(id) FROM etypev) AS here, []::VARCHAR[] AS seen, NULL::BIGINT AS edge_id, NULL::VARCHAR AS src
    UNION ALL SELECT step + 1, o.dst, list_append(seen, here), o.edge_id, here FROM w JOIN o ON o.src = here AND o.k = len(list_filter(seen, lambda x: x = here)) % o.m WHERE step < 30)
  SELECT step - 1 AS step, edge_id, src, here AS dst FROM w WHERE step > 0""")
def _(s):
    g = s.etype()
    return exact.random_walk(g, g.vertices.agg(F.min("id").alias("i")).first()["i"], steps=30, chain="round_robin")


@_query("walk_steps", "SELECT chain, step, true AS follows FROM (VALUES ('uniform'), ('weighted'), ('vanishing')) c(chain), range(20) r(step)")
def _(s):
    from pyspark.sql import Window as W

    g = s.etype()
    root = g.vertices.agg(F.min("id").alias("i")).first()["i"]
    out = None
    for k, chain in enumerate(("uniform", "weighted", "vanishing")):
        one = exact.random_walk(g, root, steps=20, chain=chain, seed=k).withColumn("chain", F.lit(chain))
        out = one if out is None else out.union(one)
    back = F.coalesce(F.lag("dst").over(W.partitionBy("chain").orderBy("step")), F.lit(root))
    e = g.edges.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    met = out.withColumn("back", back).join(e, "edge_id", "left")
    return met.select("chain", "step", F.coalesce((F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")) & (F.col("back") == F.col("src")), F.lit(False)).alias("follows"))


@_query("many_walks", f"WITH {V} SELECT id AS walk, step::INTEGER AS step, true AS follows FROM v, range(4) r(step)")
def _(s):
    from pyspark.sql import Window as W

    g = s.trade3()
    w = walks.walks(g, g.vertices.select(F.col("id").alias("walk"), "id"), steps=4, seed=1, weight=F.col("n"))
    back = F.coalesce(F.lag("dst").over(W.partitionBy("walk").orderBy("step")), F.col("walk"))
    known = g.edges.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    met = w.withColumn("back", back).join(known, "edge_id", "left")
    return met.select("walk", "step", F.coalesce((F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")) & (F.col("back") == F.col("src")), F.lit(False)).alias("follows"))


@_query("tree_to_the_root", f"WITH RECURSIVE {TRADE}, r AS (SELECT 0::BIGINT AS id UNION SELECT src FROM trade JOIN r ON dst = r.id) SELECT id, id IN (FROM r) AS reaches FROM v")
def _(s):
    g = s.trade()
    t = exact.random_tree(g, 0, seed=5).join(g.edges.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b")), "edge_id", "left")
    real = t.where("successor is not null and a = id and b = successor").select("id", F.col("successor").alias("parent"), F.col("edge_id").alias("pred_edge_id"))
    # the first edge of a way from the top of its tree tells which vertex is the top
    tops = g.edges.where("dst = 0").select(F.col("edge_id").alias("top"))
    there = paths.paths_to(real).join(tops, F.col("path")[0] == F.col("top")).select(F.col("id").alias("i"), F.lit(True).alias("y"))
    met = t.join(there, F.col("id") == F.col("i"), "left")
    return met.select("id", (F.coalesce("y", F.lit(False)) | ((F.col("id") == 0) & F.col("successor").isNull())).alias("reaches"))


# ---- documents --------------------------------------------------------------------------------------------------


@_query("graphml_round_trip", f"WITH {T3} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, n FROM t3")
def _(s):
    return formats.read_graphml(s.spark, formats.document(formats.graphml_lines(s.trade3()))).edges.select("src", "dst", "n")


@_query("graphml_lines", f"""WITH {T3}, e AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS k, min(n) OVER () AS least FROM t3)
  SELECT '<node id="' || id || '"></node>' AS line FROM v UNION ALL SELECT '<edge id="' || k || '" source="' || src || '" target="' || dst || '">' || CASE WHEN n = least THEN '' ELSE '<data key="edge_n">' || n || '</data>' END || '</edge>' FROM e
  UNION ALL SELECT '<key id="edge_n" for="edge" attr.name="n" attr.type="long"><default>' || min(n) || '</default></key>' FROM t3
  UNION ALL SELECT '<graph id="G" edgedefault="directed" parse.nodes="' || (SELECT count(*) FROM v) || '" parse.edges="' || (SELECT count(*) FROM t3) || '" parse.order="nodesfirst" parse.nodeids="free" parse.edgeids="free">'""")
def _(s):
    g = s.trade3()
    least = g.edges.agg(F.min("n").alias("n")).first()["n"]
    return formats.graphml_lines(g, defaults={"edge_n": least}).where("line like '<node%' or line like '<edge%' or line like '<key%' or line like '<graph id%'").select("line")


@_query("parquet_round_trip", f"WITH {T3} SELECT src, dst, n FROM t3")
def _(s):
    path = scratch(s.spark, "parquet")
    formats.write_parquet(s.trade3(), path)
    return formats.read_parquet(s.spark, path).edges.select("src", "dst", "n")


@_query("dgml_round_trip", f"WITH {T3} SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM t3")
def _(s):
    path = scratch(s.spark, "dgml")
    formats.dgml_lines(s.trade3()).coalesce(1).sortWithinPartitions("part", "ord").select("line").write.text(path)
    return formats.read_dgml(s.spark, path).edges.select("src", "dst")


@_query("xml_line_rows", f"""WITH {T3}, e AS (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS k FROM t3) SELECT 1 AS part, id AS ord, '<node id="' || id || '" />' AS line FROM v
  UNION ALL SELECT 2, k, '<edge id="' || (src * 1048576 + dst) || '" source="' || src || '" target="' || dst || '" />' FROM e UNION ALL SELECT 0, 0, '<graph>' UNION ALL SELECT 3, 0, '</graph>'""")
def _(s):
    return formats.xml_lines(s.trade3())


@_query("dot_attributes", f"""WITH {T3}, m AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS r FROM nation) SELECT 'digraph G {{' AS line UNION ALL SELECT 'rankdir="LR", nodesep=0.5;' UNION ALL SELECT 'node [shape="box"];' UNION ALL SELECT '}}'
  UNION ALL SELECT 'subgraph cluster' || (r + 1) || ' {{ label="r' || r || '";' FROM m GROUP BY r UNION ALL SELECT '}}' FROM m GROUP BY r
  UNION ALL SELECT id || ' [label="n' || id || '"' || CASE WHEN id % 2 = 0 THEN ', color="red"' ELSE '' END || '];' FROM v UNION ALL SELECT src || ' -> ' || dst || ' [label="' || n || '"];' FROM t3""")
def _(s):
    clusters = s.table("nation").select(F.concat(F.lit("r"), "n_regionkey").alias("cluster"), F.col("n_nationkey").cast("long").alias("id"))
    return formats.dot_lines(
        s.trade3(), vertex_label=F.concat(F.lit("n"), F.col("id").cast("string")), edge_label=F.col("n"), vertex={"color": F.when(F.col("id") % 2 == 0, "red")},
        graph_attributes={"rankdir": "LR", "nodesep": 0.5}, vertex_defaults={"shape": "box"}, clusters=clusters,
    ).select("line")


_COMPONENTS = f"{T3}, r AS (SELECT src, dst FROM t3 UNION SELECT r.src, t3.dst FROM r JOIN t3 ON r.dst = t3.src), scc AS (SELECT id, least(id, coalesce(min(m), id)) AS label FROM v LEFT JOIN (SELECT a.src AS x, a.dst AS m FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) ON x = id GROUP BY id)"


@_query("condensation_lines", f"""WITH RECURSIVE {_COMPONENTS}, n AS (SELECT label, count(*) AS c, row_number() OVER (ORDER BY label) - 1 AS k FROM scc GROUP BY label),
  e AS (SELECT a.label AS x, b.label AS y FROM t3 JOIN scc a ON src = a.id JOIN scc b ON dst = b.id)
  SELECT k || ' [label="' || c || '-' || (SELECT count(*) FROM e WHERE x = label AND y = label) || '"];' AS line FROM n
  UNION ALL SELECT p.k || ' -> ' || q.k || ' [label="' || count(*) || '"];' FROM e JOIN n p ON x = p.label JOIN n q ON y = q.label WHERE x <> y GROUP BY p.k, q.k""")
def _(s):
    return formats.condensation_dot(*components.condensation(s.trade3())).where("part in (1, 2)").select("line")


@_query("component_subgraphs", f"WITH RECURSIVE {_COMPONENTS}, c AS (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS component FROM scc) SELECT src, dst, a.component FROM t3 JOIN c a ON src = a.id JOIN c b ON dst = b.id AND a.component = b.component")
def _(s):
    g = s.trade3()
    return components.component_graphs(g, components.strongly_connected_components(g)).edges.select("src", "dst", "component")


@_query("petri_condition", """WITH o AS (SELECT o_orderstatus AS place, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT median(n) AS m FROM o),
  p AS (SELECT DISTINCT o_orderstatus AS place FROM orders UNION ALL SELECT 'done' UNION ALL SELECT 'never')
  SELECT p.place, CASE p.place WHEN 'done' THEN (SELECT sum(n) FROM o WHERE place <> 'F')::BIGINT WHEN 'never' THEN 0 WHEN 'F' THEN coalesce(n, 0) ELSE 0 END AS n_tokens FROM p LEFT JOIN o USING (place)""")
def _(s):
    # a transition for closed orders asks for more tokens than there can be; the others' tokens are negated on their way
    spark, orders = s.spark, s.table("orders")
    places = orders.select(F.col("o_orderstatus").alias("place")).distinct().union(spark.createDataFrame([("done",), ("never",)], "place string"))
    arcs = spark.createDataFrame([(0, "O", "open", True), (1, "P", "open", True), (2, "done", "open", False), (3, "F", "shut", True), (4, "never", "shut", False)], "arc int, place string, transition string, is_input boolean")
    marking = orders.select(F.col("o_orderstatus").alias("place"), F.col("o_orderkey").alias("token"), F.col("o_orderkey").alias("seq"))
    enough = (F.col("transition") == "open") | (F.col("n_tokens") > 1 << 60)
    net = petri.PetriNet(places, spark.createDataFrame([("open",), ("shut",)], "transition string"), arcs, marking, condition=enough, annotation=-F.col("token"))
    return net.step().counts()


@_query("edge_merge_ways", f"""WITH RECURSIVE {T3}, w AS (SELECT src, dst, [src, dst] AS way FROM t3 WHERE src < 20 UNION ALL SELECT w.src, t3.dst, list_append(way, t3.dst) FROM w JOIN t3 ON w.dst = t3.src WHERE w.dst >= 20 AND len(way) < 12),
  f AS (SELECT src, dst, way FROM w WHERE dst < 20),
  ok AS (SELECT src, dst, way FROM f WHERE NOT EXISTS (SELECT 1 FROM unnest(range(2, len(way))) a(i), unnest(range(2, len(way))) b(j)
    WHERE i < j AND way[i] = way[j] AND list_min(way[i:j]) = way[i]))
  SELECT src, dst, len(way) - 1 AS k, count(*) AS n FROM ok GROUP BY ALL""")
def _(s):
    merged = components.edge_merge_condensation(s.trade3(), F.col("id") < 20)
    return merged.groupBy("src", "dst", F.size("edge_ids").cast("long").alias("k")).agg(F.count("*").alias("n"))


@_query("ranks_by_out_edges", f"WITH {T3} SELECT id, (SELECT count(*) FROM t3 WHERE src = id) AS n FROM v")
def _(s):
    # one round without damping's share from outside: what arrives from equal parts, counted back into edges
    g = s.trade3()
    r = trees.pagerank(g.reversed(), damping=1.0, rounds=1).withColumnRenamed("id", "i")
    into = g.in_degrees().withColumnRenamed("id", "t")
    whole = g.edges.join(into, F.col("dst") == F.col("t")).groupBy("src").agg(F.sum(1 / F.col("in_degree")).alias("share"), F.count("*").alias("n"))
    met = r.join(whole, F.col("i") == F.col("src"), "left")
    n = g.vertices.count()
    ok = F.abs(F.col("rank") * n - F.coalesce("share", F.lit(0.0))) < 1e-9
    return met.select(F.col("i").alias("id"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(-1).alias("n"))

"""Every graph query against its SQL on the smallest tables, and that llm is not needed."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from graphloom import queries, row_queries

SF = "/root/testdata/sf0.001"
#: What runs in seconds together; the driver holds all of them at a larger size.
SOME = [
    "adjacent_degree", "add_edges_no_parallel", "merge_vertex", "undirected_view", "csr_adjacency", "path_checks", "reversed_edge_augment", "augment_multi_source_sink", "balance_edges", "bfs_tree",
    "critical_path", "condensation_strong", "edge_merge_condensation", "common_ancestors", "minimum_spanning_forest", "pagerank", "dfs_order", "maximal_cliques", "petri_step",
    "dfs_class_rows", "merged_edge_paths", "implicit_dfs", "all_pairs_paths", "colour_rows", "round_robin_walk", "tree_to_the_root", "edge_merge_ways", "dot_attributes", "dgml_round_trip",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, db, name):
    every, sql = queries.QUERIES | row_queries.QUERIES, queries.SQL | row_queries.SQL
    df = every[name](spark, SF)
    cols = sorted(df.columns)
    rel = db.sql(sql[name])
    assert sorted(rel.columns) == cols
    plain = lambda row: tuple(float(x) if isinstance(x, float) else x for x in row)
    got = sorted((plain(r) for r in df.select(*cols).collect()), key=repr)
    want = sorted((plain(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_library_stands_without_llm(tmp_path):
    code = "import sys; sys.modules['graphloom.llm'] = None\ntry:\n  import graphloom.queries, graphloom.sources.formats, graphloom.streaming.incremental\nfinally:\n  assert not any(m.startswith('graphloom.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True)


def test_entry_lists_queries_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100

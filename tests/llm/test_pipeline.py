"""The pipeline on the smallest tables: each stage's decisions take effect and clean documents stay."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from graphloom.llm.common import Stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = Stored(stage(spark, docs, SF), f"test-{name}").df
        out.append((name, docs))
    return out


def test_columns_and_order(stages):
    names = [n for n, _ in stages]
    assert names == ["documents", "quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, df in stages[1:5]:
        assert df.columns == stages[0][1].columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for _, df in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert len(ids[1]) > 0.7 * len(ids[0])


def test_no_near_duplicates_and_no_leaks_are_left(spark, stages):
    from graphloom.llm.decontaminate import find_contamination
    from graphloom.llm.near_dedup import near_duplicates

    left = stages[3][1]
    assert near_duplicates(left).where("not kept").count() == 0
    clean = stages[4][1]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert find_contamination(clean, bench).where("hits.n_hit > 0").count() == 0
    assert stages[5][1].selectExpr("count(distinct doc_id) n").first()["n"] == clean.count()


def test_lines_are_cut_once(stages):
    from graphloom.llm.line_dedup import dedup_lines

    assert dedup_lines(stages[2][1]).where("n_deleted > 0").count() == 0

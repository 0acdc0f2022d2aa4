"""Documents in and out."""

import pytest

from graphloom.errors import FormatError
from graphloom.sources import formats

DOC = """<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="w" for="edge" attr.name="weight" attr.type="double"><default>1.5</default></key><key id="c" for="node" attr.name="label" attr.type="string" />
<key id="t" for="node" attr.name="tags" attr.type="int[]" />
<graph id="G" edgedefault="undirected"><node id="a"><data key="c">x &amp; "y"</data><data key="t">1 2 </data></node><node id="b" />
<edge source="a" target="b" id="e0"><data key="w">2.25</data></edge><edge source="b" target="b" /></graph></graphml>"""


def test_graphml_round_trip(spark):
    g = formats.read_graphml(spark, DOC)
    assert not g.directed
    assert {(r["id"], r["label"], tuple(r["tags"] or ())) for r in g.vertices.collect()} == {("a", 'x & "y"', (1, 2)), ("b", None, ())}
    assert sorted(r["weight"] for r in g.edges.collect()) == [1.5, 2.25]
    again = formats.read_graphml(spark, formats.document(formats.graphml_lines(g)))
    assert {(r["id"], r["label"]) for r in again.vertices.collect()} == {("0", 'x & "y"'), ("1", None)}
    assert {(r["src"], r["dst"], r["weight"]) for r in again.edges.collect()} == {("0", "1", 2.25), ("1", "1", 1.5)}


@pytest.mark.parametrize(
    "old, new",
    [
        ('<edge source="a"', "<edge"), ('target="b" id', 'target="z" id'), ('<node id="b" />', '<node id="a" />'), ("<graphml xmlns", "<graphm xmlns"), ('edgedefault="undirected"', ""),
        ("2.25", "two"), ('key="c"', 'key="q"'), ("</graph></graphml>", "</graph><graph edgedefault='directed' /></graphml>"), ("<graphml", "<!DOCTYPE x><graphml"), ('id="e0"', 'id="e0" directed="true"'),
    ],
)
def test_malformed_graphml(spark, old, new):
    with pytest.raises(FormatError):
        formats.read_graphml(spark, DOC.replace(old, new))
    assert formats.validate_graphml(DOC.replace(old, new)) and not formats.validate_graphml(DOC)


def test_legacy_and_corpus(spark, tmp_path):
    old = '<!DOCTYPE graphml SYSTEM "x.dtd"><graphml><graph><node id="n0" /><node id="n1" /><edge source="n0" target="n1" /></graph></graphml>'
    assert formats.read_graphml(spark, old, legacy=True).directed
    for i in range(3):
        (tmp_path / f"g{i}.graphml").write_text(old.replace("n1", f"n{i + 1}"))
    many = formats.read_corpus(spark, str(tmp_path))
    assert many.vertices.count() == 6 and many.edges.select("graph_id").distinct().count() == 3
    from graphloom.operators import exact

    assert exact.dfs_trace(many, by="graph_id").groupBy("graph_id").count().where("count = 2").count() == 3


def test_xml_dgml_dot(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<graph><node id="1"/><node id="2"/><edge id="0" source="1" target="2" weight="4.5"/></graph>')
    g = formats.read_xml(spark, str(tmp_path / "a.xml"), attributes="weight double", directed=False)
    assert g.edges.select("src", "dst", "weight").collect() == [("1", "2", 4.5)]
    assert '<edge id="' in formats.document(formats.xml_lines(g)) and formats.document(formats.xml_lines(g)).startswith("<graph>")
    assert formats.document(formats.dot_lines(g)).splitlines() == ["graph G {", "0;", "1;", "0 -- 1;", "}"]
    assert '<Link Source="1" Target="2"' in formats.document(formats.dgml_lines(g))
    formats.write_parquet(g, str(tmp_path / "p"))
    assert formats.read_parquet(spark, str(tmp_path / "p"), directed=False).equals(g)
    nodes, links = formats.drawing_model(g)
    assert nodes.count() == 2 and links.first()["source_label"] == "1"


def test_validation_tells_every_error():
    from graphloom.sources.formats import NAMESPACE, validate_graphml

    text = (
        f'<graphml xmlns="{NAMESPACE}"><key id="k" for="node" attr.name="k" attr.type="int"/><key id="k" for="node"/><graph edgedefault="sideways">'
        '<node id="a"><data key="k">x</data></node><node id="a"/><node id="b"><data key="q">1</data></node><edge source="a" target="z"/><hyperedge/></graph></graphml>'
    )
    found = validate_graphml(text)
    assert len(found) == 7 and all(any(part in m for m in found) for part in ("bad key", "edgedefault", "no int", "bad node", "'q'", "hyperedge", "no node"))
    assert validate_graphml(f'<graphml xmlns="{NAMESPACE}"><graph edgedefault="directed"><node id="a"/></graph></graphml>') == []
    assert len(validate_graphml("<graphml")) == 1

import pytest

from tessera.sources import rdf, tables
from tessera.sources.paging import PagedSource, search_hits


def pages(offset, limit):
    return [f"row {k}" for k in range(offset, offset + limit)]


NT = r'''<http://a> <http://p> "x \"y\" é\\n \U0001F600"@en-GB .
<http://a> <http://p> <http://b> . # note
_:n1 <http://p> "3"^^<http://www.w3.org/2001/XMLSchema#int> <http://g> .
not a statement
# comment
'''


def test_ntriples(spark, tmp_path):
    (tmp_path / "x.nt").write_text(NT)
    rows = {tuple(r) for r in rdf.read_rdf(spark, str(tmp_path / "x.nt")).collect()}
    assert rows == {
        ("http://a", "http://p", 'x "y" é\\n 😀', "literal", "en-GB", None, None), ("http://a", "http://p", "http://b", "uri", None, None, None),
        ("_:n1", "http://p", "3", "literal", None, "http://www.w3.org/2001/XMLSchema#int", "http://g"),
    }
    assert rdf.read_ntriples(spark, str(tmp_path / "x.nt"), permissive=True).where("_corrupt_record is not null").count() == 1


TTL = """@prefix r: <http://r#> . @base <http://base/> .
<a> r:label "one" , 'two'@fr , \"\"\"long "x" \"\"\" ; a r:C ; r:n 1, 2.5, true .
<a> r:list ( <x> "y" ) . [] r:p [ r:q <z> ] . # end
<u\\u0041> r:p r:x.y .
"""


def test_turtle(spark, tmp_path):
    got = rdf.turtle(TTL)
    objects = {r[2] for r in got if r[0] == "http://base/a"}
    assert {"one", "two", 'long "x" ', "http://r#C", "1", "2.5", "true"} <= objects and len(got) == 7 + 5 + 2 + 1
    assert ("http://base/uA", "http://r#p", "http://r#x.y", "uri", None, None, None) in got
    (tmp_path / "x.ttl").write_text(TTL)
    assert rdf.read_rdf(spark, str(tmp_path / "x.ttl")).count() == len(got)
    with pytest.raises(rdf.TurtleError):
        rdf.turtle("<a> b:c <d> .")


RDFXML = """<?xml version="1.0"?><!DOCTYPE rdf:RDF[<!ENTITY w 'http://w/'>]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="&w;e#" xml:lang="en">
<e:Class rdf:about="&w;a"><e:label>A &amp; b</e:label><e:sub rdf:resource="&w;b"/><e:has><e:Sub rdf:about="&w;c"><e:n rdf:datatype="&w;int">3</e:n></e:Sub></e:has></e:Class>
</rdf:RDF>"""


def test_rdfxml(spark, tmp_path):
    got = set(rdf.rdfxml(RDFXML))
    assert ("http://w/a", "http://w/e#label", "A & b", "literal", "en", None, None) in got and ("http://w/a", "http://w/e#has", "http://w/c", "uri", None, None, None) in got
    assert ("http://w/c", "http://w/e#n", "3", "literal", None, "http://w/int", None) in got and len(got) == 6
    (tmp_path / "x.rdf").write_text(RDFXML)
    assert rdf.read_rdf(spark, str(tmp_path / "x.rdf")).count() == 6
    assert len(rdf.rdfxml('<owl:Class rdf:about="http://w/a"><rdfs:label>x</rdfs:label></owl:Class>')) == 2


def test_tables(spark, tmp_path):
    p = lambda n, s: (tmp_path / n).write_text(s) and str(tmp_path / n)
    assert [tuple(r) for r in tables.read_lst(spark, p("a.lst", "(a:x,b:y_(z),1.0)\nnoise\n(c, d, 0.25)\n")).collect()] == [("a:x", "b:y_(z)", 1.0), ("c", "d", 0.25)]
    assert tables.read_md(spark, p("a.md", "http://d/a - http://d/b\nnone\n"), [("d", "http://d/")]).first()[:2] == ("d:a", "d:b")
    s = tables.read_sparse(spark, p("a.sparse", "(2,1,0.2),(2,2,0.07)\n\n(1,0,0.16)\n"))
    assert s.count() == 3
    merged = tables.merge_sparse([s, s.where("i = 1")])
    assert [(x.d, x.m) for x in merged.where("`from` = 1").first().sim] == [(0.16, 0), (0.16, 1)]
    mm = tables.read_matrix_market(spark, p("a.mm", "%%MatrixMarket\n% c\n3 3 2\n1 2 0.5\n3 1 2\n"))
    assert {tuple(r) for r in mm.collect()} == {(1, 2, 0.5), (3, 1, 2.0)}
    d = tables.read_distances(spark, p("a.csv", 'e1;e2;l;x;y\n"a;b";c; ;0,5;inf\n'), 2, with_lcs=True).first()
    assert d.e1 == "a;b" and d.lcs is None and d.dist == [0.5, 1.7976931348623157e308]
    assert tables.read_dot(spark, p("a.dot", 'digraph {\n "a b" -> "c"\n}\n')).first()[:] == ("a b", "c")
    cell = '<map><Cell><entity1 rdf:resource="u"/><entity2 rdf:resource="v"/><relation>=</relation><measure rdf:datatype="f">0.5</measure></Cell></map>'
    x = p("a.rdf", f'<rdf:RDF xmlns:rdf="r"><Alignment>{cell}</Alignment></rdf:RDF>')
    assert tables.read_alignment_xml(spark, x).first()[:] == ("u", "v", "=", 0.5)
    x = p("r.rdf", "<o><output><map:precision>0.9</map:precision><map:recall>1.0</map:recall></output></o>")
    assert tables.read_result_xml(spark, x).first()[:] == (0.9, 1.0)


def test_lines(spark):
    links = spark.createDataFrame([("s", "t", 1.0), ("s", "u", 0.5)], "source string, target string, confidence double")
    assert {r.value for r in tables.link_lines(links).collect()} == {"= s t", "< 0.5 s u"}
    accepted, check = tables.split_by_confidence(links, 0.95)
    assert accepted.count() == 1 == check.count()
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert tables.dot_lines(e).first().value == '  "a" -> "b"'


def test_paging(spark):
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("fetch", "tests.test_sources:pages").option("total", 25).option("pageSize", 10).load()
    assert [r.value for r in df.orderBy("place").collect()] == [f"row {k}" for k in range(25)]
    hits = spark.createDataFrame([('{"ns":0,"title":"t","snippet":"s","size":3,"timestamp":"z"}',), ("{}",), ("x",)], "value string")
    assert [tuple(r) for r in search_hits(hits).collect()] == [("t", "s", 3)]

"""Parsers, terms, the relational bridge, reports and the validator on the life-expectancy shape."""

import io

import pytest
from pyspark.sql import functions as F

from cubeloom.functions.terms import iri, literal, value_key
from cubeloom.functions.vocab import TYPE, XSD, qb
from cubeloom.operators.graph import closure, path, star, star_lookup
from cubeloom.plans.normalize import normalize
from cubeloom.report import section
from cubeloom.sources.rdf import format_of, read_graph, write_graph
from cubeloom.sources.rdf_text import RDFSyntaxError, parse_rdf_xml, parse_turtle
from cubeloom.validator import CubeValidator, create_validator

HEAD = """@prefix qb: <http://purl.org/linked-data/cube#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix xsd: <http://www.w3.org/2001/XMLSchema#> . PREFIX e: <urn:e#>
"""
CUBE = HEAD + """
e:ds a qb:DataSet ; rdfs:label "Life \\"expectancy\\""@en ; qb:structure e:dsd ; e:unit <urn:Year> ; qb:slice e:s1 , e:s2 .
e:dsd a qb:DataStructureDefinition ; # dimensions
  qb:component [ qb:dimension e:area ; qb:order 1 ] , [ qb:dimension e:sex ; qb:componentAttachment qb:Slice ] ;
  qb:component [ qb:measure e:life ] , [ qb:attribute e:unit ; qb:componentRequired "true"^^xsd:boolean ; qb:componentAttachment qb:DataSet ; ] ;
  qb:sliceKey e:key .
e:key a qb:SliceKey ; qb:componentProperty e:sex . e:area a qb:DimensionProperty ; rdfs:range <urn:Area> .
e:life a qb:MeasureProperty .
e:s1 a qb:Slice ; qb:sliceStructure e:key ; e:sex e:m ; qb:observation e:o1 , e:o2 .
e:s2 a qb:Slice ; qb:sliceStructure e:key ; e:sex e:f ; qb:observation e:o3 .
e:o1 a qb:Observation ; qb:dataSet e:ds ; e:area e:x ; e:life 76.7 .
e:o2 a qb:Observation ; qb:dataSet e:ds ; e:area e:y ; e:life 78.7 .
e:o3 a qb:Observation ; qb:dataSet e:ds ; e:area e:x ; e:life 83.3 .
"""


def frame(spark, text):
    return spark.createDataFrame(parse_turtle(text), "s string, p string, o string")


def test_turtle_terms():
    rows = parse_turtle('@base <http://h/a/> . <b> <p> 1, 1.5, 1e3, true, "x"@EN-gb, \'\'\'l\n"q"\'\'\', _:z, [ <q> () ], (1) .')
    objects = [o for s, p, o in rows if s == "<http://h/a/b>"]
    assert objects[:6] == [f'"1"^^<{XSD}integer>', f'"1.5"^^<{XSD}decimal>', f'"1e3"^^<{XSD}double>', f'"true"^^<{XSD}boolean>', '"x"@en-gb', '"l\\n\\"q\\""']
    assert len(rows) == 9 + 1 + 2
    for bad in ("<a> <b> .", "x:a <b> <c> .", '<a> "p" <c> .', "<a> <b> <c>"):
        with pytest.raises(RDFSyntaxError):
            parse_turtle(bad)


def test_rdf_xml_equals_turtle():
    xml = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e#">
      <e:T rdf:about="urn:a" e:k="v"><e:p rdf:resource="urn:b"/><e:q xml:lang="en">x</e:q>
      <e:r rdf:datatype="http://www.w3.org/2001/XMLSchema#integer">1</e:r><e:n><e:U rdf:about="urn:c"/></e:n></e:T></rdf:RDF>"""
    ttl = '@prefix e: <urn:e#> . <urn:a> a e:T ; e:k "v" ; e:p <urn:b> ; e:q "x"@en ; e:r 1 ; e:n <urn:c> . <urn:c> a e:U .'
    assert sorted(parse_rdf_xml(xml)) == sorted(parse_turtle(ttl))


def test_values(spark):
    terms = [f'"1"^^<{XSD}integer>', f'"1.0"^^<{XSD}decimal>', f'"1e0"^^<{XSD}double>', f'"1"^^<{XSD}boolean>', f'"true"^^<{XSD}boolean>', '"1"', f'"10"^^<{XSD}integer>', "<urn:1>"]
    keys = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "o string").select(value_key(F.col("o"))).collect()]
    assert len({keys[0], keys[1]}) == 1 and keys[3] == keys[4] == "?true" and len(set(keys)) <= 6
    assert keys[0] != keys[6] and keys[7] == "<urn:1>"


def test_golden_cube(spark, tmp_path):
    t = CubeValidator(frame(spark, CUBE)).graph
    assert t.count() == len(set(parse_turtle(CUBE)))
    one = normalize(t, phases=(1,))
    # four component properties, and the types of e:sex and e:unit
    assert one.count() - t.count() == 6
    assert normalize(t).count() - one.count() == 6  # unit and sex of three observations
    out = io.StringIO()
    found = CubeValidator(t).normalize().validate_all(out)
    assert {k: v.count() for k, v in found.items() if v.count()} == {4: 1}
    assert found[4].first()[0] == "<urn:e#sex>"
    text = out.getvalue()
    assert "Integrity Constraint 4: Dimensions Have Range" in text and "    urn:e#sex" in text and text.count("Pass.") == 20


@pytest.mark.parametrize("kind", ["nt", "ttl", "rdf"])
def test_files(spark, tmp_path, kind):
    t = CubeValidator(frame(spark, CUBE)).graph
    path_ = str(tmp_path / f"cube.{kind}")
    write_graph(t, path_)
    again = read_graph(spark, path_)
    rest = lambda g: {tuple(r) for r in g.where("s not like '\\_:%' and o not like '\\_:%'").select("s", "p", "o").collect()}
    assert rest(again) == rest(t) and again.count() == t.count()


def test_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="not found"):
        read_graph(spark, str(tmp_path / "none.nt"))
    with pytest.raises(ValueError):
        format_of("cube.csv")
    with pytest.raises(ValueError):
        create_validator(spark, frame(spark, CUBE), semantics="other")
    assert format_of("A.B.TTL") == "TURTLE"


def test_graph_operators(spark):
    t = CubeValidator(frame(spark, CUBE)).graph
    ends = {r[1] for r in path(t, [qb("structure"), qb("sliceKey"), qb("componentProperty")]).collect()}
    assert ends == {"<urn:e#sex>"}
    assert star(t, {TYPE: qb("Slice"), "<urn:e#sex>": "<urn:e#m>"}).collect()[0][0] == "<urn:e#s1>"
    rows = star_lookup(t, {TYPE: qb("Slice")}, ["<urn:e#sex>", "<urn:none>"]).collect()
    assert len(rows) == 4 and sum(r["o"] is None for r in rows) == 2
    edges = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("4", "5")], "a string, b string")
    assert {r[0] for r in closure(spark.createDataFrame([("1",)], "v string"), edges).collect()} == {"1", "2", "3"}


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "obs string, dim string")
    assert section(11, empty)[-2:] == ["Pass.", ""]


def test_n_triples_become_canonical(spark, tmp_path):
    """Escapes, language tags and blank nodes of lines are those that the Turtle reader gives."""
    lines = [r'<urn:a> <urn:p> "café \U0001F642 \t \"q\" \\u0041 \' \b"@EN-gb .', r"<urn:é> <urn:p> _:b1 .", r'<urn:a> <urn:q> "x\u000A"^^<http://www.w3.org/2001/XMLSchema#string> .']
    for name in ("one.nt", "two.nt", "one.ttl"):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    nt, ttl = (read_graph(spark, str(tmp_path / f"one.{kind}")) for kind in ("nt", "ttl"))
    rest = lambda g: sorted(tuple(r) for r in g.where("o not like '\\_:%'").select("s", "p", "o").collect())
    assert rest(nt) == rest(ttl) and len(rest(nt)) == 2
    both = read_graph(spark, str(tmp_path / "*.nt"))
    assert both.where("o like '\\_:%'").select("o").distinct().count() == 2  # blank nodes of two files


def test_value_keys_are_exact(spark):
    terms = [
        f'"0.0000000000000000001"^^<{XSD}decimal>', f'"0"^^<{XSD}decimal>', f'"-0.0"^^<{XSD}decimal>', f'"+007.50"^^<{XSD}decimal>', f'"7.5e0"^^<{XSD}double>',
        f'"2020-01-01T12:00:00Z"^^<{XSD}dateTime>', f'"2020-01-01T14:00:00+02:00"^^<{XSD}dateTime>',
    ]
    a, b, c, d, e, f, g = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "o string").coalesce(1).select(value_key(F.col("o"))).collect()]
    assert a != b and b == c and d == e and f == g


def test_duplicates_by_value_and_by_term(spark):
    """Values that SPARQL holds equal make observations duplicates in the standard meaning only."""
    text = HEAD + """
    e:ds a qb:DataSet ; qb:structure e:dsd . e:dsd a qb:DataStructureDefinition ; qb:component [ qb:dimension e:d ] .
    e:o1 qb:dataSet e:ds ; e:d 1 . e:o2 qb:dataSet e:ds ; e:d 1.0 . e:o3 qb:dataSet e:ds ; e:d 2 ."""
    t = frame(spark, text)
    found = {s: CubeValidator(t, semantics=s).normalize().validate(12).count() for s in ("standard", "setwise")}
    assert found == {"standard": 2, "setwise": 0}


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from cubeloom.__main__ import main

    monkeypatch.chdir(tmp_path)
    assert main([]) is None and main(["cube.csv", "standard"]) is None and main(["cube.ttl", "other"]) is None
    assert capsys.readouterr().out.count("Error: ") == 3
    (tmp_path / "cube.ttl").write_text(CUBE, encoding="utf-8")
    report = (tmp_path / main([str(tmp_path / "cube.ttl"), "setwise"])).read_text()
    assert report.count("Pass.") == 20 and "    urn:e#sex" in report


def test_stream(spark, tmp_path):
    from cubeloom.streaming.ingest import append, stream_triples

    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.nt").write_text(f"<urn:s{k}> <urn:p> \"1\" .\n", encoding="utf-8")
        append(stream_triples(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["s"] for r in spark.read.parquet(str(tmp_path / "table")).collect()) == ["<urn:s0>", "<urn:s1>"]


def test_facts_once_shuffles_rows_not_triples(spark):
    """Rows with a subject in common, and triples of it, give each triple once, by one shuffle of the table's columns."""
    from cubeloom.sources.tables import facts, facts_once, graph

    rows = spark.createDataFrame([(1, None, 5), (None, 1, 5), (None, 1, 6), (2, 2, 7), (2, 2, 7), (3, 1, None)], "a int, b int, v int")
    subject, properties = iri("urn:x:", F.col("a"), F.col("b")), {"<urn:p>": F.lit("<urn:c>"), "<urn:v>": [literal(F.col("v")), literal(F.col("v") % 5)]}
    once = graph(spark.createDataFrame([("<urn:y>", "<urn:p>", "<urn:c>")] * 2, "s string, p string, o string"), apart=[facts_once(rows, subject, properties)])
    got = [(r.s, r.p, r.o) for r in once.collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in facts(rows, subject, properties).collect()} | {("<urn:y>", "<urn:p>", "<urn:c>")}
    plan = facts_once(rows, subject, properties)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("Generate")


def test_stream_of_very_many_predicates(spark, tmp_path):
    """Folders of the table are bounded, however many predicates there are."""
    from cubeloom.streaming.ingest import GROUPS, append, stream_triples

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nt").write_text("".join(f'<urn:s{k}> <urn:p{k}> "{k}" .\n' for k in range(300)))
    append(stream_triples(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    assert {(r["s"], r["p"], r["o"]) for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {(f"<urn:s{k}>", f"<urn:p{k}>", f'"{k}"') for k in range(300)}
    assert len(list((tmp_path / "table").glob("p*=*"))) <= GROUPS

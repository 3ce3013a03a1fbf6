"""Documents in parts: Turtle cut anywhere between lines reads as it does whole, and graphs come back as they were written."""

import json
import random
import re

import pytest

from cubeloom.functions.terms import triples
from cubeloom.sources import parts as in_chunks
from cubeloom.sources import turtle_split, xml_split
from cubeloom.sources.parts import LEAD, crossing
from cubeloom.sources.rdf import read_graph, write_graph
from cubeloom.sources.rdf_text import RDFSyntaxError, parse_rdf_xml, parse_turtle

AWKWARD = r'''@prefix a: <http://a/> . # a comment with a full stop. and [ brackets (
PREFIX
  b:
  <http://b/>
a:x a:p """long . [ (
@prefix a: <http://wrong/> .
"quoted" '' ''' + "'''" + r''' a:y a:z a:w . \""" end""" , 'short . [' , "it's \" . [" ; # more . text
  a:q [ a:r ( 1 2.5 [ a:s "x."@en-GB ] ) ;
        a:t <http://c/d#e.f'g> ] .
a:y.z a a:C . a:v a:w 5 . a:v a:w 5.0 . a:v a:w .5e3 .
@base <http://base/> .
<rel> <p> ''' + "'''" + r'''
a:not a:a a:statement . """ "
@base <http://wrong/> .
''' + "'''" + r''' .
[ a:p
  a:o
] .
@prefix a:
   <other#> .
a:x a:escaped\.name a:tail\(x . _:n a:p _:n , _:m .
BASE <http://last/>
<q> a:p <r> .
( 1 2
3 ) a:p
a:o .
a:last a:p "x" . # no line follows'''


def renumbered(rows):
    """Triples with nodes without a label named by what is said of them."""
    rows = set(rows)
    for _ in range(6):
        names = {x for t in rows for x in (t[0], t[2]) if re.match(r"_:\w*x\d*[yz]?\d+$", x)}
        known = {x: "_:" + str(sorted(("s", p, o if o not in names else "?") for s, p, o in rows if s == x) + sorted(("o", s if s not in names else "?", p) for s, p, o in rows if o == x)) for x in names}
        rows = {(known.get(s, s), p, known.get(o, o)) for s, p, o in rows}
    return rows


def in_parts(text, cuts, base="", form=turtle_split):
    lines = text.split("\n")
    bounds = [0, *sorted(cuts), len(lines)]
    chunks = ["".join(line + "\n" for line in lines[a:b]) for a, b in zip(bounds, bounds[1:]) if b > a]
    starts = [json.dumps(x) for x in form.compose([(form.summary(c), c[:LEAD]) for c in chunks], base)]
    out, parts = [], []
    for k, (c, start) in enumerate(zip(chunks, starts, strict=True)):
        found, end, rest = form.parse_chunk(c, k, json.loads(start), "b")
        out += found
        parts.append((k, end, rest, start))
    for k, t, start in crossing(parts):
        out += form.finish(t, k, json.loads(start), "b")
    return out


XML = """<?xml version="1.0" encoding="UTF-8"?>
<!-- a comment with <rdf:RDF> in it -->
<!DOCTYPE rdf:RDF [
  <!ENTITY e "urn:entity:">
  <!ENTITY r "http://www.w3.org/1999/02/22-rdf-syntax-ns#"> ]>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
   xmlns:p="urn:p:" xml:base="http://base/" xml:lang="en"
   >
  <rdf:Description rdf:about="&e;one"><p:a rdf:resource="two"/></rdf:Description>
  <p:Thing rdf:about="x"
     p:att="a > b &lt; c"
     p:other='quote " and
 line' />
  <!-- <p:Thing> <![CDATA[ --> <p:Thing/>
  <rdf:Description rdf:nodeID="n">
    <p:text><![CDATA[ </rdf:Description> <!--
      </p:text> ]]></p:text>
    <p:nested>
      <p:Inner p:v="1"><p:deep rdf:parseType="Resource"><p:x>y &e; z</p:x>
      </p:deep></p:Inner>
    </p:nested
    >
    <p:list rdf:parseType="Collection"><p:I rdf:nodeID="n"/>
      <rdf:Description/></p:list>
    <?pi <rdf:Description> ?>
  </rdf:Description
  >
  <rdf:Bag rdf:ID="bag"><rdf:li>1</rdf:li>
<rdf:li xml:lang="de">2</rdf:li></rdf:Bag>
</rdf:RDF>
<!-- end -->
"""


def test_every_cut_in_two_of_xml():
    whole = parse_rdf_xml(XML)
    for cut in range(XML.count("\n") + 2):
        got = in_parts(XML, [cut], form=xml_split)
        assert len(got) == len(whole) and renumbered(got) == renumbered(whole), cut


@pytest.mark.parametrize("seed", range(40))
def test_random_cuts_of_xml(seed):
    rng = random.Random(seed)
    whole, lines = parse_rdf_xml(XML, "http://first/"), XML.count("\n") + 1
    got = in_parts(XML, rng.sample(range(1, lines), rng.randint(1, lines - 1)), "http://first/", xml_split)
    assert len(got) == len(whole) and renumbered(got) == renumbered(whole)


def test_parts_of_other_xml():
    """A root that is a node itself, and a root without children, are read whole; what is broken is an error."""
    one = '<p:T xmlns:p="urn:p:"\n xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" rdf:about="urn:s">\n<p:a>1</p:a>\n</p:T>\n'
    none = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"\n/>\n'
    for text in (one, none):
        for cut in range(4):
            assert set(in_parts(text, [min(cut, text.count("\n"))], form=xml_split)) == set(parse_rdf_xml(text))
    for bad in (XML.replace("</p:nested\n    >", ""), XML.replace("</rdf:RDF>", "</rdf:RDF><p:more/>"), XML.replace("<p:Thing/>", "<q:Thing/>")):
        with pytest.raises(Exception):
            in_parts(bad, [12, 20], form=xml_split)


def test_every_cut_in_two():
    whole = parse_turtle(AWKWARD)
    lines = AWKWARD.count("\n") + 1
    for cut in range(lines + 1):
        got = in_parts(AWKWARD, [cut])
        assert len(got) == len(whole) and renumbered(got) == renumbered(whole), cut


@pytest.mark.parametrize("seed", range(60))
def test_random_cuts(seed):
    rng = random.Random(seed)
    text = "\n".join([AWKWARD] * rng.randint(1, 3))
    whole, lines = parse_turtle(text, "http://first/"), text.count("\n") + 1
    got = in_parts(text, rng.sample(range(1, lines), rng.randint(1, lines - 1)), "http://first/")
    assert len(got) == len(whole) and renumbered(got) == renumbered(whole)


def test_parts_of_a_broken_document():
    for text in ("<a> <b> <c> .\n<a> <b>\n", "<a> <b> <c> .\n<a> <b> 'x\n' .\n", "<a> <b> '''x\ny .\n", "<a> <b> [ <c>\n .\n", "<a> <b> x:y .\n"):
        with pytest.raises(RDFSyntaxError):
            in_parts(text, [1])


@pytest.mark.parametrize("chunk", [1, 300, 1 << 21])
def test_reads_documents_in_parts(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(in_chunks, "_CHUNK", chunk)
    big = AWKWARD + "\n" + "".join(f"<urn:s{k}> <urn:p> <urn:o{k}> ,\n  'v{k}' .\n" for k in range(300))
    (tmp_path / "one.ttl").write_text(big)
    (tmp_path / "two.ttl").write_text("_:n <urn:p> _:n .")
    (tmp_path / "three.ttl").write_text("")
    t = read_graph(spark, f"{tmp_path}/*.ttl")
    strip = lambda x: re.sub(r"^_:b[0-9a-f]{32}", "_:b", x)
    rows = [(r.s, r.p, r.o) for r in t.select("s", "p", "o").collect()]
    labels = {x for s, p, o in rows for x in (s, o) if re.match(r"_:b[0-9a-f]{32}nn$", x)}
    assert len(labels) == 2  # the two documents' nodes with one label
    want = {*parse_turtle(big), ("_:bnn", "<urn:p>", "_:bnn")}
    assert renumbered({(strip(s), p, strip(o)) for s, p, o in rows}) == renumbered(want)


@pytest.mark.parametrize("chunk", [1, 300, 1 << 21])
def test_reads_xml_in_parts(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(in_chunks, "_CHUNK", chunk)
    (tmp_path / "one.rdf").write_text(XML)
    t = read_graph(spark, f"{tmp_path}/one.rdf")
    strip = lambda x: re.sub(r"^_:b[0-9a-f]{32}", "_:b", x)
    assert renumbered({(strip(r.s), r.p, strip(r.o)) for r in t.select("s", "p", "o").collect()}) == renumbered(parse_rdf_xml(XML))


def test_a_split_file(spark, tmp_path):
    """Spark's own splits of one file, of a few lines each."""
    text = "@prefix e: <urn:e:> .\n" + "".join(f'e:s{k} e:p e:o{k} ;\n  e:q """{k}\n.""" .\n' for k in range(2000))
    (tmp_path / "x.ttl").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(f"{tmp_path}/x.ttl").rdd.getNumPartitions() > 10
        t = read_graph(spark, f"{tmp_path}/x.ttl")
        assert {(r.s, r.p, r.o) for r in t.select("s", "p", "o").collect()} == set(parse_turtle(text))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


ROWS = [
    ("<urn:s>", "<urn:p>", "<urn:o>"), ("<urn:s>", "<urn:p>", '"a \\"b\\" \\\\ \\n \\r \\t é 😀 <&>"'), ("<urn:s>", "<urn:q>", '"x"@en-gb'), ("<urn:s>", "<urn:q>", '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'),
    ("_:n1", "<urn:p>", "_:n2"), ("_:n2", "<urn:p>", "_:n1"), ("<urn:t>", "<urn:p>", '""'), ("<urn:t>", "<urn:with:7>", "_:n1"), *[(f"<urn:many{k % 7}>", f"<urn:p{'xyz'[k % 3]}>", f"<urn:o{k}>") for k in range(200)],
]


@pytest.mark.parametrize("kind", ["nt", "ttl", "n3", "rdf"])
@pytest.mark.parametrize("single", [False, True])
def test_round_trip(spark, tmp_path, kind, single):
    """Over several parts; nodes of one document stay the same nodes."""
    rows = [r for r in ROWS if kind != "rdf" or ":7>" not in r[1]]
    path = f"{tmp_path}/g.{kind}"
    write_graph(triples(spark.createDataFrame(rows, "s string, p string, o string").repartition(4)), path, single=single)
    assert (tmp_path / f"g.{kind}").is_file() == single
    got = {(r.s, r.p, r.o) for r in read_graph(spark, path).select("s", "p", "o").collect()}
    strip = lambda x: re.sub(r"^_:b[0-9a-f]{32}n", "_:", x)
    assert {(strip(s), p, strip(o)) for s, p, o in got} == set(rows)
    assert len({x for s, _, o in got for x in (s, o) if x.startswith("_:")}) == 2


def test_rdf_xml_names_every_predicate_or_none(spark, tmp_path):
    with pytest.raises(ValueError, match="no element for the predicate <urn:with:7>"):
        write_graph(triples(spark.createDataFrame(ROWS, "s string, p string, o string")), f"{tmp_path}/g.rdf")


@pytest.mark.parametrize("kind", ["nt", "ttl", "rdf"])
def test_empty_graph(spark, tmp_path, kind):
    path = f"{tmp_path}/g.{kind}"
    write_graph(triples(spark.createDataFrame([], "s string, p string, o string")), path)
    assert read_graph(spark, path).count() == 0


@pytest.mark.parametrize("semantics", ["standard", "setwise"])
def test_report_by_all_tasks_is_the_one_by_the_driver(spark, tmp_path, semantics):
    """Section by section: the same lines, in the order of subjects."""
    import io

    from cubeloom import report
    from cubeloom.plans.normalize import normalize
    from cubeloom.sources.store import stored
    from cubeloom.validator import CubeValidator
    from test_constraints import cube

    rng = random.Random(11)
    rows = [r for n in range(25) for r in cube(rng, n)]
    v = CubeValidator(normalize(stored(triples(spark.createDataFrame(rows, "s string, p string, o string")))), semantics=semantics, source="cubes")
    counts = v.report(f"file://{tmp_path}/r.md")
    out = io.StringIO()
    found = v.validate_all(out)
    assert counts == {ic: df.count() for ic, df in found.items()} and sum(n > 0 for n in counts.values()) > 12

    def sections(text):
        parts = re.split(r"(?m)^(Integrity Constraint \d+: .*)\n", text)
        return {title: sorted(body.split("\n")) for title, body in zip(parts[1::2], parts[2::2], strict=True)}

    got, want = sections((tmp_path / "r.md").read_text()), sections(out.getvalue())
    assert list(got) == [report.title(ic) for ic in range(1, 22)] and got == want
    for ic in (11, 13):
        subjects = [line for line in (tmp_path / "r.md").read_text().split(report.title(ic))[1].split("Integrity")[0].split("\n") if line.startswith("urn:obs")]
        assert subjects == sorted(subjects, key=lambda line: line.split()[0] + ">") and len(subjects) == len(set(subjects))

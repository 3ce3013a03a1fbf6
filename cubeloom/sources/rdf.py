"""Reading and writing graphs, in parallel. N-Triples is read by line, Turtle, N3 and RDF/XML in parts of documents.

What is written is a folder of parts, each a document of its format; a folder's parts are read as one document, so their
blank nodes are the same nodes.
"""

from __future__ import annotations

import logging
import re
import uuid
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions.terms import triples
from cubeloom.functions.vocab import RDF
from cubeloom.sources import turtle_split, xml_split
from cubeloom.sources.parts import read_parts
from cubeloom.sources.rdf_text import unescape
from cubeloom.sources.store import Path, join_files

log = logging.getLogger("cubeloom")

# The formats by file name extension.
FORMATS = {"xml": "RDF/XML", "rdf": "RDF/XML", "nt": "N-TRIPLE", "ttl": "TURTLE", "n3": "N3"}

_LINE = r'^\s*(<[^>]*>|_:\S+)\s*(<[^>]*>)\s*(<[^>]*>|_:\S+?|"(?:[^"\\]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def format_of(path: str) -> str:
    """The format by the last extension, in any case; ValueError if there is none for it."""
    found = FORMATS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    if not found:
        raise ValueError(f"File path or filename is not valid: {path}")
    return found


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def _scope() -> Column:
    """What keeps blank nodes of a document apart from those of others: all of a digest of its name. Parts of a folder are one document."""
    return F.concat(F.lit("b"), F.md5(F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", "")))


def _decoded(term: Column, *, literal: bool) -> Column:
    """A term with its escapes decoded, but (in a literal) those that the canonical form has."""
    escape = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\[^uU]|[^\\]+|\\"

    def one(x: Column) -> Column:
        digits = F.lpad(F.substring(x, 3, 8), 8, "0")
        char = F.when(x.rlike(r"^\\[uU]."), F.decode(F.unhex(digits), "UTF-32"))
        plain = F.when(x == r"\b", F.lit("\b")).when(x == r"\f", F.lit("\f")).when(x == r"\'", F.lit("'"))
        if not literal:
            return F.coalesce(char, plain, x)
        char = F.coalesce(char, plain)
        for raw, escaped in (("\\", r"\\"), ('"', r"\""), ("\n", r"\n"), ("\r", r"\r"), ("\t", r"\t")):
            char = F.when(char == raw, F.lit(escaped)).otherwise(char)
        return F.coalesce(char, x)

    parts = F.transform(F.regexp_extract_all(term, F.lit(escape), F.lit(0)), one)
    return F.when(term.contains("\\"), F.array_join(parts, "")).otherwise(term)


def parse_lines(lines: DataFrame) -> DataFrame:
    """(s, p, o) of N-Triples lines (column value), with built-in functions. Comments and blank lines give none.

    Terms become canonical: escapes decoded, language tags in lower case, blank nodes named within their file.
    """
    text = F.col("value")
    rows = lines.where(~text.rlike(r"^\s*(#.*)?$")).withColumn("_scope", _scope())
    rows = rows.select(*[F.regexp_extract(text, _LINE, k).alias(c) for k, c in enumerate("spo", 1)], "value", "_scope")
    # xsd:string is what a plain literal has anyway
    o = F.regexp_replace("o", r'"\^\^<http://www\.w3\.org/2001/XMLSchema#string>$', '"')
    tag = F.regexp_extract(o, r'"(@[A-Za-z\-0-9]+)$', 1)
    o = F.when(F.substring("o", 1, 1) != '"', _decoded(o, literal=False)).when(tag == "", _decoded(o, literal=True)).otherwise(
        F.concat(_decoded(F.expr("substring(o, 1, length(o) - length(regexp_extract(o, '\"(@[A-Za-z\\\\-0-9]+)$', 1)))"), literal=True), F.lower(tag))
    )
    named = lambda x: F.when(x.startswith("_:"), F.concat(F.lit("_:"), F.col("_scope"), F.lit("n"), F.substring(x, 3, 1 << 30))).otherwise(x)
    bad = F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.substring("value", 1, 200)))
    s, p = named(_decoded(F.col("s"), literal=False)), _decoded(F.col("p"), literal=False)
    return rows.select(s.alias("s"), p.alias("p"), F.when(F.col("s") == "", bad.cast("string")).otherwise(named(o)).alias("o"))


def read_graph(spark: SparkSession, path: str, format: str | None = None, *, base: str = "") -> DataFrame:
    """A graph from files at ``path``. Blank nodes of a document keep to it. ValueError if there is no such file."""
    format = (format or format_of(path)).upper()
    if not exists(spark, path):
        raise ValueError(f"File {path} not found")
    if format in ("N-TRIPLE", "N-TRIPLES"):
        return triples(parse_lines(spark.read.text(path)))
    form = {"TURTLE": turtle_split, "N3": turtle_split, "RDF/XML": xml_split}.get(format)
    if form is None:
        raise ValueError(f"Format {format} is not supported")
    return triples(read_parts(spark, path, form, _scope(), base))


def write_graph(t: DataFrame, path: str, format: str | None = None, *, single: bool = False) -> None:
    """Write a graph, in UTF-8, as a folder of parts, or as one file of their bytes if ``single``.

    Turtle and RDF/XML are ordered by subject, and each part has the statements of a range of subjects. ValueError for
    RDF/XML if a predicate ends in a character that no name of an element can end in; an error of the file system is logged.
    """
    format = (format or format_of(path)).upper()
    if format not in ("N-TRIPLE", "N-TRIPLES", "TURTLE", "N3", "RDF/XML"):
        raise ValueError(f"Format {format} is not supported")
    xml = format == "RDF/XML"
    if xml and (bad := t.select("p").where(~nameable(F.col("p"))).limit(1).collect()):
        raise ValueError(f"RDF/XML has no element for the predicate {bad[0][0]}")
    if format.startswith("N-"):
        text = t.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value"))
    else:
        ranges = t.select("s", "p", "o").repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o")
        text = ranges.mapInArrow((lambda batches: _xml_lines(batches, not single)) if xml else _turtle_lines, "value string")
    try:
        if not single:
            text.write.mode("overwrite").text(path)
            return
        parts = f"{path}-{uuid.uuid4().hex}"
        text.write.text(parts)
        join_files(t.sparkSession, [_XML_HEAD if xml else "", Path(parts), _XML_FOOT if xml else ""], path)
    except (OSError, Py4JJavaError) as e:
        log.error("%s", e)


def _turtle_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted triples as the lines of a Turtle document; a subject and its predicates are named once."""
    last: tuple[str, str] | None = None
    held = ""
    for batch in batches:
        out = []
        for s, p, o in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if last is None or s != last[0]:
                out += [held + " ."] * (last is not None)
                held = f"{s} {p} {o}"
            else:
                out.append(held + (" ," if p == last[1] else " ;"))
                held = f"        {o}" if p == last[1] else f"    {p} {o}"
            last = s, p
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([held + " ."])], ["value"])


# What stands around the descriptions of an RDF/XML document.
_XML_HEAD, _XML_FOOT = f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="{RDF}">\n', "</rdf:RDF>\n"
_ELEMENT = r"^<(.*?)([^\W\d][\w.\-]*)>$"


def nameable(p: Column) -> Column:
    """Whether RDF/XML can name a predicate: its end has to be the name of an element."""
    return p.rlike(r"(?U)^<.*?([^\W\d][\w.\-]*)>$")


def _xml_lines(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Triples as the lines of an RDF/XML document, with its first and last line if it is ``whole``."""
    lines = lambda out: pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
    if whole:
        yield lines([_XML_HEAD.rstrip("\n")])
    for batch in batches:
        yield lines([_description(*x) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)])
    if whole:
        yield lines([_XML_FOOT.rstrip("\n")])


def _description(s: str, p: str, o: str) -> str:
    space, local = re.match(_ELEMENT, p).groups()
    who = f"rdf:about={quoteattr(s[1:-1])}" if s[0] == "<" else f"rdf:nodeID={quoteattr(s[2:])}"
    head = f"p:{local} xmlns:p={quoteattr(space)}"
    if o[0] == "<":
        value = f"<{head} rdf:resource={quoteattr(o[1:-1])}/>"
    elif o[0] == "_":
        value = f"<{head} rdf:nodeID={quoteattr(o[2:])}/>"
    else:
        body, tail = re.match(r'(?s)"(.*)"(@[\w\-]+|\^\^<.*>)?$', o).groups()
        extra = f" xml:lang={quoteattr(tail[1:])}" if tail and tail[0] == "@" else f" rdf:datatype={quoteattr(tail[3:-1])}" if tail else ""
        value = f"<{head}{extra}>{escape(unescape(body), {chr(13): '&#13;'})}</p:{local}>"
    return f"  <rdf:Description {who}>{value}</rdf:Description>"


__all__ = ["FORMATS", "exists", "format_of", "nameable", "parse_lines", "read_graph", "write_graph"]

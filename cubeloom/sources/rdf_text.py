"""Parsers of RDF texts to canonical triples: Turtle (with the subset of N3 that data uses), N-Triples, RDF/XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from cubeloom.functions.vocab import OWL, RDF, XSD

Triple = tuple[str, str, str]

TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\r\n]*)
      |(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
      |(?P<long>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*''')
      |(?P<short>"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')
      |(?P<keyword>@prefix\b|@base\b|(?i:prefix|base)(?=\s+[^\s:]*:|\s+<))
      |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+)(?![\w]))
      |(?P<blank>_:[\w](?:[\w.\-·]*[\w\-·])?)
      |(?P<name>(?:[^\W\d_](?:[\w.\-·]*[\w\-·])?)?:(?:(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w:\-.·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:\-·]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
      |(?P<word>true\b|false\b|a(?=[\s<\[_"]))
      |(?P<mark>\^\^|<=|=>|[.;,\[\]()=])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else _PLAIN.get(x, x)

    return _ESCAPE.sub(one, text)


def literal_term(value: str, datatype: str | None = None, lang: str | None = None) -> str:
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = value.replace(raw, escaped)
    if lang:
        return f'"{value}"@{lang.lower()}'
    return f'"{value}"' if datatype in (None, XSD + "string") else f'"{value}"^^<{datatype}>'


def resolve_iri(token: str, base: str) -> str:
    """The IRI that a token in angle brackets stands for."""
    return f"<{urljoin(base, unescape(token[1:-1])) if base else unescape(token[1:-1])}>"


class RDFSyntaxError(ValueError):
    pass


class Incomplete(RDFSyntaxError):
    """The text ends within a statement."""


class Turtle:
    """A recursive-descent reader of a document or a part of one. ``scope`` keeps blank nodes of different documents apart.

    ``prefixes``: those that hold where the part begins; ``part``: keeps its nodes without a label apart from those of other
    parts. ``done``: where the last complete statement ends, and ``whole`` how many triples there are up to it.
    """

    def __init__(self, text: str, base: str = "", scope: str = "b", *, prefixes: dict[str, str] | None = None, part: str = ""):
        self.text, self.base, self.scope, self.part = text, base, scope, part
        self.prefixes: dict[str, str] = dict(prefixes or {})
        self.fresh = self.done = self.whole = 0
        self.out: list[Triple] = []
        self.tokens = self._tokens()
        self.kind, self.value, self.end = next(self.tokens)

    def _tokens(self) -> Iterator[tuple[str, str, int]]:
        at, n = 0, len(self.text)
        while at < n:
            m = TOKEN.match(self.text, at)
            if not m:
                line = self.text.count("\n", 0, at) + 1
                raise RDFSyntaxError(f"line {line}: can't read {self.text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0], at
        while True:
            yield "end", "", n

    def _next(self) -> tuple[str, str]:
        now = self.kind, self.value
        if now[0] == "end":
            raise Incomplete("the text ends within a statement")
        self.kind, self.value, self.end = next(self.tokens)
        return now

    def _take(self, mark: str) -> None:
        if self.kind == "end":
            raise Incomplete(f"expected {mark!r}, found the end")
        if self.value != mark:
            raise RDFSyntaxError(f"expected {mark!r}, found {self.value!r}")
        self._next()

    def _blank(self) -> str:
        self.fresh += 1
        return f"_:{self.scope}x{self.part}{self.fresh}"

    def _iri(self, token: str) -> str:
        return resolve_iri(token, self.base)

    def parse(self) -> list[Triple]:
        while self.kind != "end":
            self._directive() if self.kind == "keyword" else self._statement()
            self.whole = len(self.out)
        return self.out

    def _close(self) -> None:
        """The end of a statement."""
        if self.value == ".":
            self.done = self.end
        self._take(".")

    def _directive(self) -> None:
        _, word = self._next()
        if word.lstrip("@").lower() == "prefix":
            _, name = self._next()
            self.prefixes[name[:-1]] = self._iri(self._next()[1])[1:-1]
        else:
            self.base = self._iri(self._next()[1])[1:-1]
        if word.startswith("@"):
            self._close()

    def _statement(self) -> None:
        brackets = self.value == "["
        subject = self._term()
        if not (brackets and self.value == "."):
            self._predicates(subject)
        self._close()

    def _predicates(self, subject: str) -> None:
        while True:
            while self.value == ";":
                self._next()
            if self.value in (".", "]"):
                return
            backwards = self.value == "<="
            p = self._predicate()
            while True:
                o = self._term()
                self.out.append((o, p, subject) if backwards else (subject, p, o))
                if self.value != ",":
                    break
                self._next()
            if self.value != ";":
                return

    def _predicate(self) -> str:
        words = {"a": f"<{RDF}type>", "=": f"<{OWL}sameAs>", "=>": "<http://www.w3.org/2000/10/swap/log#implies>", "<=": "<http://www.w3.org/2000/10/swap/log#implies>"}
        if self.value in words:
            return words[self._next()[1]]
        term = self._term()
        if not term.startswith("<"):
            raise RDFSyntaxError(f"a predicate can't be {term}")
        return term

    def _term(self) -> str:
        kind, token = self._next()
        if kind == "iri":
            return self._iri(token)
        if kind == "name":
            prefix, local = token.split(":", 1)
            if prefix not in self.prefixes:
                raise RDFSyntaxError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        if kind == "blank":
            return f"_:{self.scope}n{token[2:]}"
        if kind in ("long", "short"):
            body = unescape(token[3:-3] if kind == "long" else token[1:-1])
            if self.kind == "lang":
                return literal_term(body, lang=self._next()[1][1:])
            if self.value == "^^":
                self._next()
                return literal_term(body, self._term()[1:-1])
            return literal_term(body)
        if kind == "number":
            datatype = "double" if "e" in token.lower() else "decimal" if "." in token else "integer"
            return literal_term(token, XSD + datatype)
        if token in ("true", "false"):
            return literal_term(token, XSD + "boolean")
        if token == "[":
            node = self._blank()
            self._predicates(node)
            self._take("]")
            return node
        if token == "(":
            items = []
            while self.value != ")":
                items.append(self._term())
            self._take(")")
            rest = f"<{RDF}nil>"
            for item in reversed(items):
                node = self._blank()
                self.out += [(node, f"<{RDF}first>", item), (node, f"<{RDF}rest>", rest)]
                rest = node
            return rest
        raise RDFSyntaxError(f"unexpected {token or 'end'!r}")


def parse_turtle(text: str, base: str = "", scope: str = "b") -> list[Triple]:
    return Turtle(text, base, scope).parse()


def parse_rdf_xml(text: str, base: str = "", scope: str = "b", *, part: str = "") -> list[Triple]:
    """RDF/XML: typed nodes, property elements and attributes, nested nodes, rdf:resource, nodeID, parseType, xml:base and xml:lang."""
    rdf, xml = f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}"
    out: list[Triple] = []
    fresh = iter(range(1, 1 << 62))
    blank = lambda: f"_:{scope}x{part}{next(fresh)}"
    name = lambda tag: f"<{tag[1:].replace('}', '', 1)}>"

    def resolve(ref: str, at: str) -> str:
        return f"<{urljoin(at, ref) if at else ref}>"

    def node(e: ET.Element, at: str, lang: str | None) -> str:
        at, lang = e.get(xml + "base", at), e.get(xml + "lang", lang)
        if (ref := e.get(rdf + "about")) is not None:
            s = resolve(ref, at)
        elif (ref := e.get(rdf + "ID")) is not None:
            s = resolve("#" + ref, at)
        elif (ref := e.get(rdf + "nodeID")) is not None:
            s = f"_:{scope}n{ref}"
        else:
            s = blank()
        if e.tag != rdf + "Description":
            out.append((s, f"<{RDF}type>", name(e.tag)))
        attributes(e, s, at, lang)
        counter = iter(range(1, 1 << 62))
        for child in e:
            prop(child, s, at, lang, counter)
        return s

    def attributes(e: ET.Element, s: str, at: str, lang: str | None) -> None:
        for key, value in e.attrib.items():
            if key == rdf + "type":
                out.append((s, f"<{RDF}type>", resolve(value, at)))
            elif not key.startswith(xml) and key.startswith("{") and key not in {rdf + k for k in ("about", "ID", "nodeID", "resource", "parseType", "datatype")}:
                out.append((s, name(key), literal_term(value, lang=lang)))

    def prop(e: ET.Element, s: str, at: str, lang: str | None, counter: Iterator[int]) -> None:
        at, lang = e.get(xml + "base", at), e.get(xml + "lang", lang)
        p = f"<{RDF}_{next(counter)}>" if e.tag == rdf + "li" else name(e.tag)
        kind = e.get(rdf + "parseType")
        children = list(e)
        if kind == "Resource":
            o = blank()
            for child in children:
                prop(child, o, at, lang, iter(range(1, 1 << 62)))
        elif kind == "Collection":
            o = f"<{RDF}nil>"
            for item in reversed([node(child, at, lang) for child in children]):
                cell = blank()
                out.extend([(cell, f"<{RDF}first>", item), (cell, f"<{RDF}rest>", o)])
                o = cell
        elif kind == "Literal":
            o = literal_term((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in children), RDF + "XMLLiteral")
        elif (ref := e.get(rdf + "resource")) is not None:
            o = resolve(ref, at)
            attributes(e, o, at, lang)
        elif (ref := e.get(rdf + "nodeID")) is not None:
            o = f"_:{scope}n{ref}"
        elif children:
            o = node(children[0], at, lang)
        elif any(not k.startswith((xml, rdf)) for k in e.attrib):
            o = blank()
            attributes(e, o, at, lang)
        else:
            datatype = e.get(rdf + "datatype")
            o = literal_term(e.text or "", resolve(datatype, at)[1:-1] if datatype else None, None if datatype else lang)
        out.append((s, p, o))

    root = ET.fromstring(text)
    at, lang = root.get(xml + "base", base), root.get(xml + "lang")
    for e in root if root.tag == rdf + "RDF" else [root]:
        node(e, at, lang)
    return out

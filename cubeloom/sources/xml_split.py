"""What chunks of an RDF/XML document mean (see ``parts``).

Statements are the children of the root; a chunk's are parsed between copies of the document's prolog and root tags, which name its
entities, namespaces and base. A chunk can begin in text, in a comment, in a CDATA section, in an instruction, in a tag or in a value of an
attribute; it says for each in which of these it ends and how many elements it opens more than it closes. A document whose prolog and root tag don't
fit in the first chunk, or whose root is no ``rdf:RDF``, is one statement.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from cubeloom.functions.vocab import RDF
from cubeloom.sources.rdf_text import RDFSyntaxError, Triple, parse_rdf_xml

_TEXT, _COMMENT, _CDATA, _INSTRUCTION, _TAG, _QUOTE, _APOSTROPHE, _END_TAG = range(8)
_CLOSED_BY = {_COMMENT: "-->", _CDATA: "]]>", _INSTRUCTION: "?>", _QUOTE: '"', _APOSTROPHE: "'", _END_TAG: ">"}
_OPENED_BY = (("<!--", _COMMENT), ("<![CDATA[", _CDATA), ("<?", _INSTRUCTION), ("</", _END_TAG))
_IN_TAG = re.compile(r"""[^>"']*""")
_PROLOG = re.compile(r"""(?s)\A\ufeff?(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>)*(?P<root><(?P<name>[^\s<>/!?]+)(?:[^<>"']|"[^"]*"|'[^']*')*>)""")

#: State and depth where a chunk begins, and prolog with root tag and the root's name (empty: the document is one statement).
Start = tuple[int, int, str, str]


def _walk(text: str, state: int, at: int = 0) -> Iterator[tuple[int, int]]:
    """(change of depth, where it is complete) of each tag; last: (state at the end, -1)."""
    while True:
        if state == _TEXT:
            begin = text.find("<", at)
            if begin < 0:
                break
            for mark, opened in _OPENED_BY:
                if text.startswith(mark, begin):
                    state, at = opened, begin + len(mark)
                    break
            else:
                state, at = _TAG, begin + 1
        elif state == _TAG:
            at = _IN_TAG.match(text, at).end()
            if at == len(text):
                break
            if text[at] == ">":
                empty = text[at - 1 : at] == "/"
                at += 1
                state = _TEXT
                yield (0 if empty else 1), at
            else:
                state = _QUOTE if text[at] == '"' else _APOSTROPHE
                at += 1
        else:
            close = _CLOSED_BY[state]
            end = text.find(close, at)
            if end < 0:
                break
            at = end + len(close)
            if state == _END_TAG:
                yield -1, at
            state = _TAG if state in (_QUOTE, _APOSTROPHE) else _TEXT
    yield state, -1


def _skim(text: str, state: int, at: int = 0) -> tuple[int, int]:
    depth = 0
    for change, end in _walk(text, state, at):
        if end < 0:
            return change, depth
        depth += change
    raise AssertionError("a walk ends in a state")


def summary(text: str) -> str:
    """For each state: (state at the end, elements left open), as JSON; and, if it is a first chunk, how it is after the prolog."""
    m = _PROLOG.match(text)
    return json.dumps([[_skim(text, s) for s in range(8)], [m[0], m["name"], *_skim(text, _TEXT, m.end())] if m else None])


def compose(chunks: Iterable[tuple[str, str]], base: str) -> Iterator[tuple[int, int, str, str, str]]:
    """How each chunk of a document begins, with its base. ``chunks``: (summary, first characters) of each, in order."""
    state = depth = 0
    prolog = name = ""
    for number, (said, _) in enumerate(chunks):
        by_state, first = json.loads(said)
        if number == 0:
            if first and not first[0].endswith("/>") and _is_rdf(first[0], first[1]):
                prolog, name = first[:2]
            yield _TEXT, 0, prolog, name, base
            state, depth = (first[2], 1 + first[3]) if prolog else (_TEXT, 0)
            continue
        yield state, depth, prolog, name, base
        state, opened = by_state[state]
        depth += opened


def _is_rdf(prolog: str, name: str) -> bool:
    prefix, _, local = name.rpartition(":")
    declared = re.search(rf"""\sxmlns{":" + re.escape(prefix) if prefix else ""}\s*=\s*["']([^"']*)["']""", prolog[prolog.rindex("<" + name) :])
    return local == "RDF" and bool(declared) and (declared[1] == RDF or declared[1].startswith("&"))


def _parse(body: str, start: Start, scope: str, part: str) -> list[Triple]:
    _, _, prolog, name, base = start
    return parse_rdf_xml(f"{prolog}{body}</{name}>", base, scope, part=part)


def parse_chunk(text: str, number: int, start: Start, scope: str) -> tuple[list[Triple], str | None, str]:
    """(triples of the whole children, what ends the child before or None if it goes on, what begins the child after)."""
    state, depth, prolog, _, _ = start
    if not prolog:
        return [], None, text
    head, at = (len(prolog), len(prolog)) if number == 0 else (None, 0)
    depth = 1 if number == 0 else depth
    last = head
    for change, end in _walk(text, state, at):
        if end < 0:
            break
        depth += change
        if depth == 1 and change <= 0:
            head = end if head is None else head
            last = end
    if head is None:
        return [], None, text
    return (_parse(text[head:last], start, scope, f"{number}y") if last > head else []), ("" if number == 0 else text[:head]), text[last:]


def finish(text: str, number: int, start: Start, scope: str) -> list[Triple]:
    """The triples of children that cross chunks; what follows the last one closes the root."""
    _, _, prolog, name, base = start
    if not prolog:
        return parse_rdf_xml(text, base, scope, part=f"{number}z") if text.strip() else []
    tail = list(re.finditer(rf"</{re.escape(name)}\s*>", text))
    if tail:
        after = re.sub(r"(?s)<!--.*?-->|<\?.*?\?>", "", text[tail[-1].end() :])
        if after.strip():
            raise RDFSyntaxError(f"after the end of the document: {after.strip()[:60]!r}")
        text = text[: tail[-1].start()]
    return _parse(text, start, scope, f"{number}z") if text.strip() else []


__all__ = ["compose", "finish", "parse_chunk", "summary"]

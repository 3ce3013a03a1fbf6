"""What chunks of a Turtle or N3 document mean (see ``parts``).

A chunk can begin in three states: outside of long strings, or in one of either kind. It says for each in which
state it ends, how many brackets it opens more than it closes, and which prefixes it declares. Statements end at full stops outside
of brackets and strings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from cubeloom.sources.rdf_text import TOKEN, Incomplete, RDFSyntaxError, Triple, Turtle, resolve_iri

_STATES = (0, 1, 2)  # outside, in a long string of quotes, of apostrophes
_LONG_END = {1: re.compile(r'(?:[^"\\]|\\.|""?(?!"))*+"""', re.DOTALL), 2: re.compile(r"(?:[^'\\]|\\.|''?(?!'))*+'''", re.DOTALL)}
_SKIM = re.compile(
    r"""(?P<long>\"\"\"|''')|"(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*'|(?P<iri><[^<>"{}|^`\\\x00-\x20]*(?:\\[uU][0-9A-Fa-f]+[^<>"{}|^`\\\x00-\x20]*)*>)
      |\#[^\n]*|\\.|(?P<bracket>[\[\]()])|(?P<word>@prefix\b|@base\b|(?<![\w:.\-@%<])(?i:prefix|base)(?=\s|$))""",
    re.VERBOSE | re.DOTALL,
)
_DIRECTIVE = re.compile(r"@?(?i:(?P<prefix>prefix)\s+(?P<name>[^\s:]*):|base)\s*(?P<iri><[^<>]*>)")
_LEAD = 4096

Directive = tuple[str | None, str]
#: State and depth where a chunk begins, where it can be read to, the prefixes and base that hold, and a directive whose end it has.
Start = tuple[int, int, int, dict[str, str], str, list[Directive]]


def summary(text: str) -> str:
    """What a chunk says for each state, as JSON."""
    if '"""' in text or "'''" in text:
        return json.dumps([skim(text, s) for s in _STATES])
    return json.dumps([skim(text, 0), *[(s, 0, 0, [], "") for s in _STATES[1:]]])


def skim(text: str, state: int) -> tuple[int, int, int, list[Directive], str]:
    """(state at the end, brackets left open, where the last unclosed long string begins or the length, directives, a directive that isn't whole)."""
    at, depth, found = 0, 0, []
    if state:
        m = _LONG_END[state].match(text)
        if not m:
            return state, 0, 0, [], ""
        at = m.end()
    while m := _SKIM.search(text, at):
        at = m.end()
        kind = m.lastgroup
        if kind == "long":
            quote = 1 if m[0][0] == '"' else 2
            end = _LONG_END[quote].match(text, at)
            if not end:
                return quote, depth, m.start(), found, ""
            at = end.end()
        elif kind == "bracket":
            depth += 1 if m[0] in "[(" else -1
        elif kind == "word":
            whole = _DIRECTIVE.match(text, m.start())
            if whole:
                found.append((whole["name"] if whole["prefix"] else None, whole["iri"]))
                at = whole.end()
            elif len(text) - m.start() < _LEAD and "<" not in text[m.start() :]:
                return 0, depth, m.start(), found, text[m.start() :]
    return 0, depth, len(text), found, ""


def declared(directives: Iterable[Directive], prefixes: dict[str, str], base: str) -> tuple[dict[str, str], str]:
    """Prefixes and base after some directives."""
    prefixes = dict(prefixes)
    for name, iri in directives:
        if name is None:
            base = resolve_iri(iri, base)[1:-1]
        else:
            prefixes[name] = resolve_iri(iri, base)[1:-1]
    return prefixes, base


def compose(chunks: Iterable[tuple[str, str]], base: str) -> Iterator[Start]:
    """How each chunk of a document begins. ``chunks``: (summary, first characters) of each, in order."""
    state = depth = 0
    prefixes: dict[str, str] = {}
    waiting = ""
    for summary, lead in chunks:
        end, opened, cut, found, carried = json.loads(summary)[state]
        first = _DIRECTIVE.match(waiting + lead) if waiting else None
        ended = [(first["name"] if first["prefix"] else None, first["iri"])] if first else []
        yield state, depth, cut, prefixes, base, ended
        prefixes, base = declared([*ended, *found], prefixes, base)
        state, depth, waiting = end, depth + opened, carried


def first_end(text: str, state: int, depth: int, cut: int) -> int | None:
    """Where the statement ends in which the chunk begins; None if it doesn't."""
    at = 0
    if state:
        m = _LONG_END[state].match(text)
        if not m:
            return None
        at = m.end()
    while at < cut:
        m = TOKEN.match(text, at, cut)
        if not m:
            raise RDFSyntaxError(f"can't read {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup == "mark":
            depth += (m[0] in "[(") - (m[0] in "])")
            if m[0] == "." and depth == 0:
                return at
    return None


def parse_chunk(text: str, number: int, start: Start, scope: str) -> tuple[list[Triple], str | None, str]:
    """(triples of the whole statements, what ends the statement before or None if it goes on, what begins the statement after)."""
    state, depth, cut, prefixes, base, ended = start
    head = 0 if number == 0 else first_end(text, state, depth, cut)
    if head is None:
        return [], None, text
    # what is left to be read with the chunk before may declare something for this one
    prefixes, base = declared([*ended, *skim(text[:head], state)[3]], prefixes, base)
    reader = Turtle(text[head : max(head, cut)], base, scope, prefixes=prefixes, part=f"{number}y")
    try:
        reader.parse()
    except Incomplete:
        pass
    return reader.out[: reader.whole], text[:head], text[head + reader.done :]


def finish(text: str, number: int, start: Start, scope: str) -> list[Triple]:
    """The triples of statements that cross chunks, the last of which is ``number``."""
    return Turtle(text, start[4], scope, prefixes=start[3], part=f"{number}z").parse()

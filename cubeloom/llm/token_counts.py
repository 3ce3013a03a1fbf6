"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once. Byte-level tokens tile the text, so their lengths give their places, mapped from
bytes to characters. Sections (lines by default, each with its line end, so that they tile the text as well) are
spans of characters; each token is given to a section by interval join, and one that crosses a boundary by a rule:

- ``start``: the section in which the token starts;
- ``largest``: the section that holds most of its characters, the earlier one if equal;
- ``shared``: to each section in proportion to its characters (counts are then fractions).

A token that holds no whole character (a part of one) starts in the section of its character. Under each rule the
counts of a document's sections sum to its tokens.

Edge cases: a null or empty text has one empty section with 0 tokens; repeated rows and null ids are counted one by
one; a tokenizer's special strings are ordinary text; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import map_texts, slices

RULES = ("start", "largest", "shared")


def lines(text: str) -> list[int]:
    """Starts of a text's lines."""
    out, at = [0], text.find("\n")
    while at >= 0 and at + 1 < len(text):
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def encoder(path: str, pattern: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """From a file of ranks: a function from text to ids, and the number of bytes of each id."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, sizes


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """The encoder of this Python worker, which outlives its tasks."""
    return encoder(path, pattern)


def spans(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token, and the one after its last, from the bytes of the text and of the tokens."""
    is_start = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(is_start)])  # characters that start before each byte
    end = np.cumsum(lengths)
    start = end - lengths
    first = upto[np.minimum(start + 1, len(raw))] - 1
    return first, np.maximum(upto[end], first + 1)


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; ``starts``: first characters of sections that tile the text, ``last`` exclusive."""
    a = np.searchsorted(starts, first, side="right") - 1
    if rule == "start":
        return np.bincount(a, minlength=len(starts)).astype(np.float64)
    b = np.searchsorted(starts, last - 1, side="right") - 1
    crossing = np.flatnonzero(a != b)
    out = np.bincount(np.delete(a, crossing), minlength=len(starts)).astype(np.float64)
    for t in crossing:
        edges = np.concatenate([[first[t]], starts[a[t] + 1 : b[t] + 1], [last[t]]])
        held = np.diff(edges)
        if rule == "largest":
            out[a[t] + int(np.argmax(held))] += 1
        else:
            out[a[t] : b[t] + 1] += held / held.sum()
    return out


def count(
    docs: DataFrame, ranks: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", rule: str = "start",
    sections: Callable[[str], list[int]] = lines,
) -> DataFrame:
    """doc_id, section (from 0), start, length (characters), tokens: one row for each section of each document."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = _encoder(ranks, pattern)
        for batch in slices(batches):
            rows, parts = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                starts = np.array(sections(text), np.int64)
                lengths = sizes[np.array(encode(text), np.int64)]
                first, last = spans(text.encode(), lengths) if len(lengths) else (lengths, lengths)
                tokens = allocate(first, last, starts, rule)
                rows.append(np.full(len(starts), row, np.int32))
                parts.append((np.arange(len(starts)), starts, np.diff(starts, append=len(text)), tokens))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32))
            kinds = (np.int32, np.int64, np.int64, np.float64 if rule == "shared" else np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), *(pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "section", "start", "length", "tokens"]
            )

    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_texts(rows, run, f"doc_id {kind}, section int, start long, length long, tokens {'double' if rule == 'shared' else 'long'}")

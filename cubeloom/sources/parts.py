"""Documents read in parts, by all tasks at once, however large one document is.

Lines are read by Spark, which splits files, and gathered to chunks of about ``_CHUNK`` characters in a stored table. What a chunk
means depends on what stands before it, but on little of it, so it is found in three passes:

1. Each chunk is summarized, for each of the states in which it can begin.
2. For each document the summaries are composed in order, a small row for each chunk: that gives each chunk's true start.
3. Each chunk is parsed from the first end of a statement on to the last. What is left at both sides is joined with its
   neighbours', and these statements are parsed in the end.

A single statement is parsed by one task, whatever its length; a document's pieces of statements that cross chunks go through one task.
Nodes without a label are numbered by chunk; labels hold for the document.

A format is a module with ``summary``, ``compose``, ``parse_chunk`` and ``finish``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from types import ModuleType

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.sources.store import saved

_CHUNK = 1 << 21
LEAD = 4096
_AT, _SPO = "file string, at long, k int", "s string, p string, o string"


def crossing(parts: Iterable[tuple[int, str | None, str, str]]) -> Iterator[tuple[int, str, str]]:
    """(chunk, text, its start) of the statements that cross chunks. ``parts``: chunk, end (None if it has none), beginning and start of each, in order."""
    held: list[str] = []
    number, start = 0, ""
    for number, end, rest, start in parts:
        if end is None:
            held.append(rest)
            continue
        held.append(end)
        yield number, "".join(held), start
        held = [rest]
    yield number + 1, "".join(held), start


def _chunks(lines: DataFrame) -> DataFrame:
    """(scope, file, at, k, text): the lines of a block of a file, some at a time. ``lines``: scope, file, at, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["scope", "file", "at", "k", "text"]
        now, k, held, size = None, 0, [], 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([now[2]], pa.int64()), pa.array([k], pa.int32()), pa.array(["".join(held)])], names)

        for batch in batches:
            for scope, file, at, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (scope, file, at) != now or size > _CHUNK:
                    if held:
                        yield give()
                    k, held, size = (k + 1 if (scope, file, at) == now else 0), [], 0
                    now = scope, file, at
                held.append(value + "\n")
                size += len(value) + 1
        if held:
            yield give()

    return lines.mapInArrow(run, f"scope string, {_AT}, text string")


def _triples(found: list[tuple[str, str, str]], more: int = 0) -> list[pa.Array]:
    return [pa.array([*[t[k] for t in found], *[None] * more], pa.string()) for k in range(3)]


def read_parts(spark: SparkSession, path: str, form: ModuleType, scope: Column, base: str = "") -> DataFrame:
    """(s, p, o) of the documents at ``path``. ``scope``: what keeps a document's blank nodes apart from others'."""
    lines = spark.read.option("lineSep", "\n").text(path)
    chunks = saved(_chunks(lines.select(scope.alias("scope"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")), "chunks")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *place, text = batch.columns
            text = text.to_pylist()
            yield pa.RecordBatch.from_arrays([*place, pa.array(map(form.summary, text), pa.string()), pa.array([t[:LEAD] for t in text], pa.string())], ["file", "at", "k", "summary", "lead"])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "k"], ignore_index=True)
        starts = form.compose(zip(rows["summary"], rows["lead"], strict=True), base)
        return rows[["file", "at", "k"]].assign(number=range(len(rows)), start=[json.dumps(x) for x in starts])

    summed = chunks.select("file", "at", "k", "text").mapInArrow(summaries, f"{_AT}, summary string, lead string")
    starts = summed.groupBy("file").applyInPandas(composed, f"{_AT}, number int, start string")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, end, rest = form.parse_chunk(row["text"], row["number"], json.loads(row["start"]), row["scope"])
                left = [row["scope"], row["file"], row["number"], end, rest, row["start"]]
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 3]
                columns = _triples(found, 1) + [pa.array([None] * len(found) + [x], t) for x, t in zip(left, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["s", "p", "o", "scope", "file", "number", "end", "rest", "start"])

    every = chunks.join(starts, ["file", "at", "k"]).select("scope", "file", "text", "number", "start")
    found = saved(every.mapInArrow(parsed, f"{_SPO}, scope string, file string, number int, end string, rest string, start string"), "parsed")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number").astype(object).where(rows.notna(), None)
        out = crossing(zip(rows["number"], rows["end"], rows["rest"], rows["start"], strict=True))
        return pd.DataFrame([(rows["scope"].iloc[0], *x) for x in out], columns=["scope", "number", "text", "start"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_triples([t for r in batch.to_pylist() for t in form.finish(r["text"], r["number"], json.loads(r["start"]), r["scope"])]), ["s", "p", "o"])

    parts = found.where("number is not null").select("scope", "file", "number", "end", "rest", "start")
    statements = parts.groupBy("file").applyInPandas(joined, "scope string, number int, text string, start string")
    return found.where("number is null").select("s", "p", "o").unionByName(statements.mapInArrow(last, _SPO))

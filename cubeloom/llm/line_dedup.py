"""Line dedup: three consecutive lines that occur again, anywhere, are removed at every later occurrence.

A window is three consecutive lines that aren't blank (with blank ones between them), each without spaces at its
ends. Occurrences are ordered by doc_id (null last), then by text, then by line. The first occurrence
of a window stays; the lines covered by later ones, merged where they overlap, go. A line is only removed if an
equal line stands earlier in that order, so no line is lost everywhere.

Edge cases: a null text or one of fewer than three such lines stays as it is; rows with equal doc_id and text are
treated alike (neither is the other's later occurrence); an empty table gives no rows; further columns are kept,
whatever their names; a very hot window meets its first occurrence by a join that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import map_texts, materialize, slices, small

_ENDS = " \t\r\x0b\x0c"


def _windows(text: str | None, size: int) -> Iterator[tuple[int, int, bytes]]:
    """(first line, last line, digest) of each window."""
    import xxhash

    full = [(k, line) for k, x in enumerate(text.split("\n")) if (line := x.strip(_ENDS))] if text else []
    for k in range(len(full) - size + 1):
        part = full[k : k + size]
        yield part[0][0], part[-1][0], xxhash.xxh3_128_digest("\n".join(x for _, x in part).encode())


def windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """All windows: _id, _key (hash of the text), _from, _to, _h1, _h2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(row, *w) for row, text in enumerate(batch.column(2).to_pylist()) for w in _windows(text, size)]
            rows, first, last, digests = zip(*found, strict=True) if found else ((), (), (), ())
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                ["_id", "_key", "_from", "_to", "_h1", "_h2"],
            )

    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    return map_texts(rows, run, f"_id {kind}, _key long, _from int, _to int, _h1 long, _h2 long")


def _without(text: str, spans: list[dict]) -> tuple[str, int]:
    edges = np.zeros(text.count("\n") + 2, np.int64)
    for s in spans:
        edges[s["_from"]] += 1
        edges[s["_to"] + 1] -= 1
    covered = np.cumsum(edges) > 0
    return "\n".join(x for k, x in enumerate(text.split("\n")) if not covered[k]), int(covered.sum())


def _cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    done = [(None, 0) if t is None else _without(t, s) for t, s in zip(text, spans, strict=True)]
    return pd.DataFrame(done, columns=["text", "removed"])


def _ordered(docs: DataFrame, occurrences: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """``occurrences`` and what orders texts of one id. Only where an id has several texts are texts sorted, over all tasks."""
    several = occurrences.select("_id", "_key").distinct().groupBy("_id").count().where("count > 1")
    if not several.limit(1).count():
        return occurrences, F.lit(0)
    several = small(materialize(several.select(F.col("_id").alias("_several")), "ids-of-several"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(several, F.col("_id").eqNullSafe(F.col("_several")), "left_semi")
    rows = rows.where(F.col("_text").isNotNull()).distinct().orderBy("_text")
    ranks = rows.select(F.col("_id").alias("_rank_id"), F.xxhash64("_text").alias("_rank_key"), F.monotonically_increasing_id().alias("_rank"))
    ranks = small(materialize(ranks, "text-order"))
    return occurrences.join(ranks, F.col("_id").eqNullSafe(F.col("_rank_id")) & (F.col("_key") == F.col("_rank_key")), "left"), F.coalesce("_rank", F.lit(0))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(_doc: the row as it was, _text: its text after the removal, _removed: how many lines)."""
    occurrences = materialize(windows(docs, id_col=id_col, text_col=text_col, size=size), "windows")
    occurrences, order = _ordered(docs, occurrences, id_col, text_col)
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), order.alias("k"), F.col("_from").alias("f"))
    first = occurrences.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = occurrences.join(first, ["_h1", "_h2"]).where(place != F.col("_first"))
    spans = later.groupBy("_id", "_key").agg(F.collect_set(F.struct("_from", "_to")).alias("_spans"))
    spans = spans.withColumnRenamed("_id", "_span_id").withColumnRenamed("_key", "_span_key")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"))
    rows = rows.join(spans, F.col("_id").eqNullSafe(F.col("_span_id")) & (F.col("_key") == F.col("_span_key")), "left")
    text = F.col("_doc").getField(text_col)
    # "nondeterministic" keeps a caller's filter above it: pushed below, it would run the function again, by a second worker a task
    cut = F.pandas_udf(_cut, "text string, removed long").asNondeterministic()(F.when(F.col("_spans").isNotNull(), text), F.col("_spans"))
    rows = rows.select("_doc", cut.alias("_cut"), F.col("_spans").isNotNull().alias("_touched"))
    return rows.select(
        "_doc",
        F.when(F.col("_touched"), F.col("_cut.text")).otherwise(F.col("_doc").getField(text_col)).alias("_text"),
        F.when(F.col("_touched"), F.col("_cut.removed")).otherwise(F.lit(0)).cast("long").alias("_removed"),
    )


def without_repeats(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents with later occurrences removed; those of which no line is left go. Columns are those of ``docs``."""
    out = dedup_lines(docs, text_col=text_col, **options)
    out = out.where((F.col("_removed") == 0) | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    # n_chars, where the table has it, follows the text
    fields = [
        F.col("_text").alias(c) if c == text_col
        else F.when(F.col("_removed") == 0, F.col("_doc").getField(c)).otherwise(F.length("_text")).cast(t).alias(c) if c == "n_chars"
        else F.col("_doc").getField(c).alias(c)
        for c, t in docs.dtypes
    ]
    return out.select(*fields)

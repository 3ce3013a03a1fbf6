"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source gets a share of the budget in proportion to its weight. A share above ``max_epochs`` times the
source's size is clamped there and the excess goes to the other sources by weight, until no share is above its
clamp. Each round is one aggregate over the table of sources, and sources are numbered range by range, so the
sources themselves may be very many.

A source's target is met by whole repetitions of all its documents and one fractional repetition: documents in a
seeded hash order, up to the one at which the words taken come nearest to the target. The end of the fractional
repetition is found by descending a radix tree over the hash (sums for at most 1,024 cells of each source), so a
source of any size is never sorted or gathered in one task.

Edge cases: a null or blank text has size 0 and is taken 0 times its words; a null source is a source, ordered
last; a null doc_id is a value like another; repeated rows are sampled one by one, told apart by their places in
the files that hold them, and rows of one id and text are interchangeable: how many of them are taken is the same
in each run; a source of weight 0 gets nothing; an empty table gives no rows; further columns are kept, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import materialize, small, word_count

_CELL_BITS = 10
_TOP = 63 - _CELL_BITS


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _in_files(docs: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs`` if it is a plain scan of Parquet files; else it (or some of its columns), written and read back.

    The rows of a scan have places that don't depend on how it is dealt to tasks.
    """
    plan = docs._jdf.queryExecution().analyzed().toString()
    if re.fullmatch(r"Relation \[[^\n]*\] parquet\s*", plan):
        return docs
    return materialize(docs.select(*[f"`{c}`" for c in dict.fromkeys(columns or docs.columns)]), "mix-docs")


def _order(docs: DataFrame, doc_id: Column, text: Column, seed: int) -> tuple[Column, Column]:
    """The seeded place of a document, and what tells repeated rows apart."""
    positive = lambda c: F.shiftrightunsigned(c, 1)
    place = docs.metadataColumn("_metadata")
    return (
        positive(F.xxhash64(F.lit(seed), doc_id, F.xxhash64(text))),
        positive(F.xxhash64(F.lit(seed + 1), place["file_path"], place["row_index"])),
    )


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds _place, the number (from 0) of a source by code point, null last. Sources are sorted by ranges, not in one task."""
    order = F.col("_source").asc_nulls_last()
    ranges = sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    ranges = materialize(ranges, "mix-places").withColumn("_range", F.shiftright("_m", 33))
    # one row for each range
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_m").bitwiseAND(2**33 - 1)
    return ranges.join(small(starts), "_range").withColumn("_place", place).drop("_range", "_m", "_start")


def source_targets(
    sizes: DataFrame, *, weights: Sequence[float] = (5, 2, 1), budget_ratio: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """Targets of sources. ``sizes``: _source, _words (one row for each source; optional _weight).

    Without a _weight column, sources by code point, null last, take ``weights`` in turn. Adds _weight, _target.
    """
    if "_weight" not in sizes.columns:
        turn = (F.col("_place") % len(weights)).cast("int") + 1
        sizes = _numbered(sizes).withColumn("_weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn)).drop("_place")
    x = materialize(sizes.withColumn("_cap", F.col("_words") * F.lit(float(max_epochs))), "mix-sizes")
    total = x.agg(F.sum("_words").alias("words"), F.sum("_weight").alias("weight")).first()
    budget = float(total["words"] or 0) * budget_ratio
    level, clamped = budget / total["weight"] if total["weight"] else 0.0, 0
    while True:  # the level only rises and each round clamps further sources, or is the last
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        now = x.agg(
            F.count_if(full).alias("clamped"), F.sum(F.when(full, F.col("_cap"))).alias("caps"), F.sum(F.when(~full, F.col("_weight"))).alias("weight")
        ).first()
        if now["clamped"] == clamped or not now["weight"]:
            break
        clamped, level = now["clamped"], (budget - now["caps"]) / now["weight"]
    return x.withColumn("_target", F.least("_cap", F.lit(level) * F.col("_weight"))).drop("_cap")


def _thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to ``sources`` _end, the last place (_p1, _p2) of the fractional repetition; null if it is empty.

    ``rows``: _k, _words, _p1, _p2; ``sources``: _k, _rest (words that the fractional repetition should take).
    """
    cells = (
        F.shiftright("_p1", _TOP),
        F.shiftright("_p1", _TOP - _CELL_BITS).bitwiseAND(2**_CELL_BITS - 1),
        F.col("_p1"),
        F.shiftright("_p2", _TOP),
    )
    at = sources.select("_k", "_rest")
    path: list[str] = []
    for depth, cell in enumerate(cells):
        inside = rows.withColumn(f"_c{depth}", cell).join(small(at), ["_k", *path])
        sums = inside.groupBy("_k", *path, f"_c{depth}").agg(F.sum("_words").alias("_w"), F.first("_rest").alias("_rest"))
        running = F.sum("_w").over(Window.partitionBy("_k").orderBy(f"_c{depth}"))
        last = F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("_upto"))) == 1
        path.append(f"_c{depth}")
        at = (
            sums.withColumn("_upto", running)
            # the cell in which the sum reaches the rest, or the last cell
            .withColumn("_hit", F.min(F.when(F.col("_upto") >= F.col("_rest"), F.col(path[-1]))).over(Window.partitionBy("_k")))
            .withColumn("_end", F.max(path[-1]).over(Window.partitionBy("_k")))
            .where(F.col(path[-1]) == F.coalesce("_hit", "_end"))
            .select("_k", *path, (F.col("_rest") - F.col("_upto") + F.col("_w")).alias("_rest"))
        )
        at = materialize(at, "mix-cells")
        rows = inside.drop("_rest")
    final = rows.join(small(at), ["_k", *path])
    before = F.sum("_words").over(Window.partitionBy("_k").orderBy("_p2")) - F.col("_words")
    ends = (
        final.withColumn("_before", before)
        .groupBy("_k")
        .agg(
            F.max(F.when(F.col("_before") + F.col("_words") / 2 < F.col("_rest"), F.struct("_p1", "_p2"))).alias("_in"),
            F.min(F.struct("_p1", "_p2")).alias("_first"),
        )
        # nothing of the last cell is taken: all before it is
        .select("_k", F.coalesce("_in", F.struct(F.col("_first._p1").alias("_p1"), (F.col("_first._p2") - 1).alias("_p2"))).alias("_end"))
    )
    return sources.join(small(materialize(ends, "mix-ends")), "_k", "left")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    budget_ratio: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Plan a mix. Returns (rows, sources).

    rows: _id, _source, _words, _source_words, _target, _times (how often the mix takes the document).
    sources: _k, _source, _words, _weight, _target, _whole (repetitions of all documents), _end.
    """
    docs = _in_files(docs, (id_col, text_col, source_col))
    p1, p2 = _order(docs, F.col(id_col), F.col(text_col), seed)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).cast("string").alias("_source"),
            _source_key(F.col(source_col)).alias("_k"),
            word_count(F.col(text_col)).alias("_words"),
            p1.alias("_p1"),
            p2.alias("_p2"),
        ),
        "mix-rows",
    )
    sums = rows.groupBy("_k").agg(F.first("_source").alias("_source"), F.sum("_words").alias("_words"))
    targets = source_targets(materialize(sums, "mix-sums"), weights=weights, budget_ratio=budget_ratio, max_epochs=max_epochs)
    epochs = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(F.lit(0.0))
    targets = (
        targets.withColumn("_whole", F.floor(epochs + F.lit(1e-9)).cast("int"))
        .withColumn("_rest", F.greatest(F.col("_target") - F.col("_whole") * F.col("_words"), F.lit(0.0)))
    )
    sources = materialize(_thresholds(rows.drop("_id", "_source"), materialize(targets, "mix-targets")), "mix-sources")
    planned = rows.join(
        small(sources.select("_k", F.col("_words").alias("_source_words"), "_target", "_whole", "_rest", "_end")), "_k"
    )
    return planned.withColumn("_times", _times()), sources


def _times() -> Column:
    inside = (F.col("_rest") > 0) & (F.struct("_p1", "_p2") <= F.col("_end"))
    return F.col("_whole") + F.coalesce(inside, F.lit(False)).cast("int")


def sample_mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **options
) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with the columns of ``docs``. No text is shuffled."""
    docs = _in_files(docs)
    _, sources = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    p1, p2 = _order(docs, F.col(id_col), F.col(text_col), seed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, _source_key(F.col(source_col)).alias("_k"), p1.alias("_p1"), p2.alias("_p2"))
    rows = rows.join(small(sources.select("_k", "_whole", "_rest", "_end")), "_k")
    times = F.explode(F.array_repeat(F.lit(1), _times()))
    return rows.select("_doc", times.alias("_copy")).select("_doc.*")

"""Finding links among rows that share a bucket, without emitting a bucket's pairs.

Rows are dealt by bucket and sorted; each task compares the rows of a bucket with vectorised code and emits what
grows with the rows, not the pairs. A bucket of more than ``MOST`` rows is dealt as pairs of its parts, so a hot
bucket is spread over tasks and none holds more than ``MOST`` of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import shuffle_width, slices, small

MOST = 4096


_SHIFT = 20


def dealt(rows: DataFrame, by: str = "_g", spread: str = "_spread", most: int = MOST) -> DataFrame:
    """Rows of a bucket ``by`` in one partition and next to each other.

    Adds _own, a row's part of its bucket (by the hash of ``spread``; 0 in a bucket that isn't hot), and _part, the pair
    of parts that meet. All rows with equal (``by``, _part) are one group. Each pair of rows of a bucket meets in just
    one group, as ``neighbours`` gives them.
    """
    spark = rows.sparkSession
    hot = rows.groupBy(by).count().where(F.col("count") > most)
    hot = hot.select(by, F.ceil(2 * F.col("count") / most).cast("int").alias("_parts"))
    zero = F.lit(0).cast("long")
    if hot.limit(1).count():
        rows = rows.join(small(hot), by, "left")
        rows = rows.withColumn("_own", F.coalesce(F.pmod(F.xxhash64(F.lit(7), spread), F.col("_parts")), zero))
        pair = lambda x: F.shiftleft(F.least(x, F.col("_own")), _SHIFT) + F.greatest(x, F.col("_own"))
        pairs = F.transform(F.sequence(zero, F.coalesce(F.col("_parts"), F.lit(1)).cast("long") - 1), pair)
        rows = rows.withColumn("_part", F.explode(pairs)).drop("_parts")
    else:
        rows = rows.withColumn("_own", zero).withColumn("_part", zero)
    return rows.repartition(shuffle_width(spark), by, "_part").sortWithinPartitions(by, "_part")


def groups(batches: Iterator[pa.RecordBatch], by: str = "_g", at_least: int = 65_536) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Whole groups of sorted rows, some at a time: (group number of each row, rows)."""
    held: list[pa.RecordBatch] = []

    def number(table: pa.Table) -> np.ndarray:
        g, p = (table.column(c).to_numpy() for c in (by, "_part"))
        return np.concatenate([[0], np.cumsum((g[1:] != g[:-1]) | (p[1:] != p[:-1]))]) if len(g) else np.zeros(0, np.int64)

    for batch in slices(batches, at_least):  # what a caller makes of a part is bounded, however large Arrow's batches are
        held.append(batch)
        if sum(b.num_rows for b in held) >= at_least:
            table = pa.Table.from_batches(held)
            n = number(table)
            whole = int(np.searchsorted(n, n[-1]))
            if whole:
                yield n[:whole], table.slice(0, whole)
                held = table.slice(whole).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield number(table), table


def neighbours(n: np.ndarray, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same group, as arrays (i, j), one distance j - i at a time.

    Where a group is two parts of a hot bucket, only pairs across them; a part's own pairs are those of its own group.
    """
    own, part = table.column("_own").to_numpy(), table.column("_part").to_numpy()
    inner = (part >> _SHIFT) == (part & ((1 << _SHIFT) - 1))
    i, k = np.arange(len(n) - 1), 1
    while len(i):
        i = i[i + k < len(n)]
        i = i[n[i] == n[i + k]]
        counted = i[inner[i] | (own[i] != own[i + k])]
        if len(counted):
            yield counted, counted + k
        k += 1


class Forest:
    """Union-find over the rows of one task's groups; keeps the links that joined two trees."""

    def __init__(self, size: int):
        self.up = np.arange(size)
        self.kept: list[tuple[int, int]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        open_ = up[i] != up[j]
        if not open_.any():
            return
        for a, b in zip(i[open_].tolist(), j[open_].tolist(), strict=True):
            x, y = a, b
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                self.kept.append((a, b))
        while True:
            flat = up[up]
            if (flat == up).all():
                break
            up[:] = flat

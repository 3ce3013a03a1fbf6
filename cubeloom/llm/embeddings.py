"""Embedding near-duplicates by iterative quantisation.

Rotations for balanced binary codes are learnt on a bounded sample of vectors (``sample`` rows, taken by a hash of the
vector). All vectors are coded. Equal vectors of a label are one row from the start. A code is cut into ``tables``
substrings; vectors of a label that share a substring meet in its bucket, where the original vectors decide in double
precision. The number of bits of a substring follows the number of vectors, and the number of tables follows from it,
so that a pair at the threshold is expected to meet with probability ``recall``, and a closer one more often.

In a bucket's task each pair is counted in its first common bucket only, and what leaves the task is the number of
links of each vector and a spanning forest: they grow with the vectors, not with the pairs.

Vectors are compared with those of their length. Lengths up to the same power of two share a pass and its rotation, padded with
zeros, so there are few passes however many lengths. Vectors are scaled by a power of two before anything is squared, so that
no component is too large or too small.

Edge cases: a vector that is null or zero, or that has a null or non-finite component, and a null label, link with nothing, and the row is returned with n_links 0; a null vec_id is never the
least of a component unless alone; repeated rows link with each other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.buckets import Forest, dealt, groups, neighbours
from cubeloom.llm.common import materialize, slices, small, with_key_values
from cubeloom.llm.components import components

_PAIRS_AT_ONCE = 1 << 15


def rotation(x: np.ndarray, bits: int, *, rounds: int = 30, seed: int = 42) -> np.ndarray:
    """A projection (dimensions x bits) whose signs are balanced codes: principal axes, turned towards the cube's corners."""
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    values, axes = np.linalg.eigh(x.T @ x / max(1, len(x)))
    axes = axes[:, np.argsort(-values)]
    blocks = []
    for at in range(0, bits, dims):  # more bits than dimensions: further rotations
        width = min(dims, bits - at)
        v = x @ axes[:, :width]
        r = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        blocks.append(axes[:, :width] @ r)
    return np.concatenate(blocks, axis=1)


def keys(x: np.ndarray, projection: np.ndarray, width: int) -> np.ndarray:
    """Substrings of the codes, of ``width`` bits each, as numbers: (rows x tables)."""
    bits = (x @ projection) >= 0
    return bits.reshape(len(x), -1, width) @ (1 << np.arange(width, dtype=np.int64))


def layout(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, tables) for ``n`` vectors."""
    width = max(8, math.ceil(math.log2(max(1, n) / 4096)))
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** width
    return width, (max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column, each of ``width`` numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to norm 1. First by a power of two, which is exact, to components below 1, so that no square over- or underflows to nothing."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _padded(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a list column, with zeros up to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < np.diff(column.offsets.to_numpy())[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def near_duplicates(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93,
    recall: float = 0.99, sample: int = 20_000, seed: int = 42,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    every = rows.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("_label").isNotNull() & F.col("_v").isNotNull() & finite & F.exists("_v", lambda x: x != 0)
    every = every.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    # the least power of two that isn't below the length
    every = every.withColumn("_width", F.when(F.col("_usable"), F.pow(2.0, F.ceil(F.log2(F.size("_v")))).cast("int")))
    widths = sorted(r["_width"] for r in every.where("_usable").select("_width").distinct().collect())
    options = {"threshold": threshold, "recall": recall, "sample": sample, "seed": seed}
    if len(widths) < 2:
        return _of_width(every, widths[0] if widths else 0, **options)
    out = _of_width(every.where(~F.col("_usable")), 0, **options)
    for n in widths:
        out = out.unionByName(_of_width(every.where(F.col("_width") == n), n, **options))
    return out


def _of_width(every: DataFrame, dims: int, *, threshold: float, recall: float, sample: int, seed: int) -> DataFrame:
    """The same for _id, _label, _v and _usable, where the usable vectors have at most ``dims`` components."""
    word = lambda k: F.lpad(F.hex(F.xxhash64(F.lit(k), "_label", "_v")), 16, "0")
    every = every.withColumn("_class", F.when(F.col("_usable"), F.unhex(F.concat(word(1), word(2)))))
    # one row for each distinct vector of a label, named by 128 bits
    classes = every.where("_usable").groupBy("_class", "_label", "_v").agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    classes = materialize(classes, "vector-classes")
    taken = classes.select("_v").orderBy(F.xxhash64(F.lit(seed), "_class")).limit(sample).toArrow() if dims else None
    if taken is None or not taken.num_rows:
        return every.select(F.col("_id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    width, tables = layout(classes.count(), threshold, recall)
    projection = rotation(units(_padded(taken.column("_v"), dims)), width * tables, seed=seed)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            k = keys(units(_padded(batch.column(3), dims)), projection, width)
            offsets = pa.array(np.arange(len(k) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(k.ravel()))], [*batch.schema.names, "_keys"])

    kind = dict(classes.dtypes)
    coded = classes.select("_class", "_n", "_label", "_v").mapInArrow(code, f"_class binary, _n long, _label {kind['_label']}, _v {kind['_v']}, _keys array<long>")
    tabled = coded.select("*", F.posexplode("_keys").alias("_table", "_key"))
    tabled = tabled.select("_class", "_n", "_v", "_keys", F.col("_table").cast("long").alias("_table"), F.xxhash64("_label", F.size("_v"), "_table", "_key").alias("_g"), F.xxhash64("_label", F.size("_v")).alias("_of"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, table in groups(batches):
            v = units(_padded(table.column("_v"), dims))
            k = _matrix(table.column("_keys"), tables)
            names = table.column("_class").combine_chunks()
            weight, own, label = (table.column(c).to_numpy() for c in ("_n", "_table", "_of"))
            forest, links = Forest(len(n)), np.zeros(len(n), np.int64)
            for i, j in neighbours(n, table):
                for at in range(0, len(i), _PAIRS_AT_ONCE):
                    a, b = i[at : at + _PAIRS_AT_ONCE], j[at : at + _PAIRS_AT_ONCE]
                    # a pair counts in the first of its common buckets
                    here = ((k[a] == k[b]).argmax(axis=1) == own[a]) & (label[a] == label[b])
                    a, b = a[here], b[here]
                    near = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
                    a, b = a[near], b[near]
                    forest.add(a, b)
                    np.add.at(links, a, weight[b])
                    np.add.at(links, b, weight[a])
            some = np.flatnonzero(links)
            ends = np.array(forest.kept, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([names.take(pa.array(some)), names.take(pa.array(ends[:, 0]))]),
                    pa.concat_arrays([pa.nulls(len(some), names.type), names.take(pa.array(ends[:, 1]))]),
                    pa.array(np.concatenate([links[some], np.zeros(len(ends), np.int64)])),
                ],
                ["_class", "_other", "_links"],
            )

    found = materialize(dealt(tabled, spread="_class").mapInArrow(verify, "_class binary, _other binary, _links long"), "vector-links")
    counts = found.where(F.col("_other").isNull()).groupBy("_class").agg(F.sum("_links").alias("_links"))
    roots = components(found.where(F.col("_other").isNotNull()).select(F.col("_class").alias("a"), F.col("_other").alias("b")))
    roots = roots.select(F.col("node").alias("_class"), F.col("root").alias("_root"))
    named = classes.select("_class", "_n", "_least").join(counts, "_class", "left").join(roots, "_class", "left")
    named = materialize(named.withColumn("_root", F.coalesce("_root", "_class")), "vector-roots")
    least = materialize(named.groupBy("_root").agg(F.min("_least").alias("_component"), F.count("*").alias("_rows")), "components")
    named = with_key_values(named, least.withColumnRenamed("_rows", "_n"), "_root").select("_class", (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), "_component")
    out = every.select("_id", "_class").join(small(named), "_class", "left")
    component = F.when(F.col("_class").isNull(), F.col("_id")).otherwise(F.col("_component"))
    return out.select(
        F.col("_id").alias("vec_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )

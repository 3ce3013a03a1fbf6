"""Vector codes by product quantisation: one codebook for each part of the vectors, fitted by Yinyang Lloyd over all rows.

A component x becomes the integer floor(1024 x), and all distances are exact integers, so the result is Lloyd's to the last
bit. Each round is one pass over a table of rows. A row carries, for each part, its entry and one lower bound for each *group*
of entries on the distance to the group's entries other than its own. When the entries have moved, a bound falls by the
largest drift in its group; the distance to the row's own entry is computed afresh. Only groups whose bound isn't above that
distance are scanned; a bound that equals it is, so ties are found and go to the lower index by comparing integers. Bounds are
kept as 16-bit multiples of a unit, rounded down.

A pass also sums the parts of each entry within its task; Spark adds the tasks' sums, and the driver gets one sum for each
component of an entry (4 x ``entries`` x the part's width), however many rows there are. A pass's table is deleted when
the next one is written.

Edge cases: a vector that is null or has a null or non-finite component is left out; shorter vectors are extended with zeros
to the longest one's length, and that to a multiple of the number of parts; repeated rows count each; ties of ids among the first are by
vector, a null id is last; with fewer rows than entries the codebooks are smaller; an empty table gives no rows. Components
too large for 64-bit distances are computed with unbounded integers, without bounds; an error that passes 63 bits is null,
and so is the label's.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import discard, materialize, slices, small

#: Entries of a group, on average.
_GROUP = 16
_LIMB = 40
_TOP = 0xFFFF
_ROWS = "_id {id}, _label {label}, _v binary, _a binary, _b binary, _part int, _entry int, _n long, _sums array<long>"


def floors(values: np.ndarray, kind: type) -> np.ndarray:
    """floor(1024 x) as integers of ``kind``; ``object`` are unbounded ones."""
    if kind is not object:
        return np.floor(values * 1024).astype(kind)
    exact = [int(x) * 1024 if abs(x) >= 2.0**53 else math.floor(x * 1024) for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of integers, which may be whole float64 below 2 ** 53."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def grouped(entries: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The group of each entry: entries near each other share one."""
    k = max(1, round(len(entries) / _GROUP))
    if entries.dtype == object:
        return np.arange(len(entries)) % k
    x = entries.astype(np.float64)
    centres = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        of = squared(x, centres).argmin(axis=1)
        for g in np.unique(of):
            centres[g] = x[of == g].mean(axis=0)
    return squared(x, centres).argmin(axis=1)


class Yinyang:
    """One part's codebook in one round. ``drift``: how far each group's entries have moved at most since the bounds were made."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray, drift: np.ndarray, unit: float):
        self.entries, self.of, self.drift, self.unit = entries, groups, drift, unit
        self.members = [np.flatnonzero(groups == g) for g in range(len(drift))]

    def assign(self, x: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, squared distance, new bounds, distances computed) of each row; ``own`` and ``bounds``: what the last round left."""
        at = self.entries[own]
        first = ((x - at) ** 2).sum(axis=1)
        best, entry = first.copy(), own.astype(np.int64)
        below = np.maximum(0, bounds * self.unit - self.drift)  # on distances, not their squares
        scan = below <= np.sqrt(first.astype(np.float64))[:, None] * (1 + 1e-9) if self.unit else np.ones(below.shape, bool)
        one, two = np.full(below.shape, np.inf), np.full(below.shape, np.inf)
        least, done = np.full(below.shape, -1), len(x)
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(scan[:, g])
            if not len(rows) or not len(members):
                continue
            d = squared(x[rows], self.entries[members])
            done += d.size
            k = d.argmin(axis=1)
            found, name = d[np.arange(len(rows)), k], members[k]
            better = (found < best[rows]) | ((found == best[rows]) & (name < entry[rows]))
            best[rows[better]], entry[rows[better]] = found[better], name[better]
            if self.unit:
                one[rows, g], least[rows, g] = found, name
                if len(members) > 1:
                    two[rows, g] = np.partition(d, 1, axis=1)[:, 1]
        if self.unit:
            scanned = np.sqrt(np.where(least == entry[:, None], two, one))
            below = np.where(scan, scanned, below)
            # the old entry is no longer the row's own, so its group's bound has to hold for it too
            left = np.flatnonzero(entry != own)
            group = self.of[own[left]]
            below[left, group] = np.minimum(below[left, group], np.sqrt(first[left].astype(np.float64)))
            bounds = np.minimum(np.floor(below * (1 - 1e-9) / self.unit), _TOP).astype(np.uint16)
        return entry, best, bounds, done


def _limbs(x: np.ndarray, limbs: int) -> np.ndarray:
    """Integers as ``limbs`` numbers each, to base 2 ** ``_LIMB``, the last of them signed; sums of limbs are limbs of the sum."""
    if limbs == 1:
        return x.astype(np.int64)[..., None]
    parts = [(x >> (_LIMB * k)) & ((1 << _LIMB) - 1) if k < limbs - 1 else x >> (_LIMB * k) for k in range(limbs)]
    return np.stack(parts, axis=-1).astype(np.int64)


def _bytes(x: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1) if x.size else np.zeros((len(x), 0), np.uint8)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * raw.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def _matrix(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, kind).reshape(rows, -1) if joined else np.zeros((rows, 0), kind)


class _Form:
    """How vectors are stored and computed: chosen once, by the largest component and length of the table."""

    def __init__(self, largest: float, length: int, parts: int):
        self.parts, self.width = parts, math.ceil(length / parts)
        bound = int(largest) * 1024 + 1024
        most = 4 * bound * bound * max(1, self.width)  # no squared distance is above
        self.exact = bound < 1 << 31 and most * parts < 1 << 62
        self.stored = np.int16 if bound < 1 << 15 else np.int32 if self.exact else object
        self.computed = np.float64 if most < 1 << 52 else np.int64 if self.exact else object
        self.unit = math.sqrt(most) / _TOP if self.exact else 0.0
        self.limbs = 1 if self.exact else bound.bit_length() // _LIMB + 1

    def vectors(self, column: pa.Array) -> np.ndarray:
        """The integers of a list column, padded with zeros."""
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        whole = np.zeros((len(column), self.parts * self.width))
        whole[np.arange(whole.shape[1])[None, :] < lengths[:, None]] = flat
        return floors(whole, self.stored)

    def pack(self, x: np.ndarray) -> pa.Array:
        return _bytes(x) if self.exact else pa.array([",".join(map(str, row)).encode() for row in x.tolist()], pa.binary())

    def unpack(self, column: pa.Array) -> np.ndarray:
        if self.exact:
            return _matrix(column, self.stored, len(column))
        rows = [[int(t) for t in raw.decode().split(",") if t] for raw in column.to_pylist()]
        return np.array(rows, object).reshape(len(rows), self.parts * self.width)


def _fold(sums: DataFrame, form: _Form, before: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: floor(sum / count) where an entry has parts. ``sums``: _part, _entry, _n, _sums of tasks."""
    n = {(r["_part"], r["_entry"]): r["n"] for r in sums.groupBy("_part", "_entry").agg(F.sum("_n").alias("n")).collect()}
    flat = sums.select("_part", "_entry", F.posexplode("_sums").alias("at", "x")).groupBy("_part", "_entry", "at").agg(F.sum("x").alias("x"))
    totals = [np.zeros(c.shape, object) for c in before]
    for r in flat.collect():
        at, limb = divmod(r["at"], form.limbs)
        totals[r["_part"]][r["_entry"], at] += r["x"] << (_LIMB * limb)
    after = []
    for part, entries in enumerate(before):
        new = entries.astype(object)
        for (p, e), count in n.items():
            if p == part:
                new[e] = totals[part][e] // count
        after.append(new)
    return after


def codes(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row."""
    v = F.col(vector_col)
    usable = F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = rows.where(usable).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), v.alias("_v"))
    size = F.coalesce(F.array_max(F.transform("_v", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    largest, length = kept.agg(F.coalesce(F.max(size), F.lit(0.0)), F.coalesce(F.max(F.size("_v")), F.lit(0))).first()
    form = _Form(largest, length, parts)
    firsts = kept.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").toArrow().column(0).combine_chunks()
    start = form.vectors(firsts if isinstance(firsts, pa.Array) else firsts.chunk(0)) if len(firsts) else np.zeros((0, parts * form.width), object)
    books = [start[:, k * form.width : (k + 1) * form.width].astype(object) for k in range(parts)]
    exact = [b.astype(form.computed) for b in books]
    groups = [grouped(b) if len(b) else np.zeros(0, int) for b in exact]
    drifts = [np.zeros(int(g.max()) + 1 if len(g) else 1) for g in groups]
    kinds = dict(kept.dtypes)
    schema = _ROWS.format(id=kinds["_id"], label=kinds["_label"])
    ends = np.cumsum([0, *[len(d) for d in drifts]])
    table = kept
    for turn in range(rounds + 1):
        lloyd = [Yinyang(*x, form.unit) for x in zip(exact, groups, drifts, strict=True)]
        last = turn == rounds

        def run(batches: Iterator[pa.RecordBatch], lloyd=lloyd, first=turn == 0, last=last) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(y.entries), np.int64) for y in lloyd]
            sums = [np.zeros((len(y.entries), form.width * form.limbs), np.int64) for y in lloyd]
            for batch in slices(batches, 4096):
                x = form.vectors(batch.column(2)) if first else form.unpack(batch.column(2))
                own = np.zeros((len(x), parts), np.uint16) if first else _matrix(batch.column(3), np.uint16, len(x))
                bounds = np.zeros((len(x), ends[-1]), np.uint16) if first else _matrix(batch.column(4), np.uint16, len(x))
                found, near, error = np.empty_like(own), np.empty_like(bounds), np.zeros(len(x), form.computed)
                for k, y in enumerate(lloyd):
                    span = x[:, k * form.width : (k + 1) * form.width].astype(form.computed)
                    e, d, b, _ = y.assign(span, own[:, k], bounds[:, ends[k] : ends[k + 1]])
                    found[:, k], near[:, ends[k] : ends[k + 1]] = e, b
                    error += d
                    if not last:
                        counts[k] += np.bincount(e, minlength=len(counts[k]))
                        np.add.at(sums[k], e, _limbs(x[:, k * form.width : (k + 1) * form.width].astype(object if form.limbs > 1 else np.int64), form.limbs).reshape(len(x), -1))
                n, none = len(x), pa.nulls(len(x), pa.int32())
                if last:
                    total = pa.array([int(t) if t < 1 << 63 else None for t in error.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.nulls(n, pa.binary()), _bytes(found), pa.nulls(n, pa.binary()), none, none, total, pa.nulls(n, pa.list_(pa.int64()))], names)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), form.pack(x), _bytes(found), _bytes(near), none, none, pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], names)
            for k in range(parts):  # the task's sums, after its rows
                some = np.flatnonzero(counts[k])
                m = len(some)
                if m:
                    blank = [pa.nulls(m, pa.binary())] * 3
                    lists = pa.array(sums[k][some].tolist(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, types[0]), pa.nulls(m, types[1]), *blank, pa.array(np.full(m, k, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[k][some]), lists], names)

        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.schema(kept.select(c).limit(0).toArrow().schema).field(0).type for c in ("_id", "_label")]
        done = materialize(table.mapInArrow(run, schema), "codes")
        if turn:
            discard(table)
        table = done
        if not last:
            books_now = _fold(table.where(F.col("_part").isNotNull()).select("_part", "_entry", "_n", "_sums"), form, books)
            table = table.where(F.col("_part").isNull()).select("_id", "_label", "_v", "_a", "_b")
            if form.exact:
                for k, g in enumerate(groups):
                    moved = np.sqrt(((books_now[k] - books[k]).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
                    drifts[k] = np.array([moved[g == x].max(initial=0) for x in range(len(drifts[k]))])
            books = books_now
            exact = [b.astype(form.computed) for b in books]
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    pairs = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.hex(F.substring(F.col("_a"), 2 * k + 1, F.lit(1))))
    coded = table.select("_id", "_label", F.lower(F.array_join(pairs, "")).alias("_code"), F.col("_n").alias("_error"))
    fits = F.sum(F.col("_error").cast("decimal(38,0)"))
    errors = coded.groupBy("_label").agg(F.when(F.count("_error") == F.count("*"), fits.try_cast("long")).alias("_sum"))
    errors = small(materialize(errors, "label-errors").withColumnRenamed("_label", "_of"))
    out = coded.join(errors, coded["_label"].eqNullSafe(errors["_of"]))
    return out.select(F.col("_id").alias("vec_id"), F.col("_code").alias("code"), F.col("_error").alias("error"), F.col("_sum").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))

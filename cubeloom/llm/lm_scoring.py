"""Language-model scoring by context-tree weighting over bytes.

The model predicts the next byte of a text (lower-cased words, one space between, one end mark) bit by bit from the
``depth`` bytes before it. Every node, a context and the bits so far of the byte, holds a Krichevsky-Trofimov
estimate, and contexts of all depths are mixed with the weights of the corpus: at a node, the estimate of its own
counts and the product of its longer contexts have prior weight 1/2 each. A score is the code length of the whole
text; per byte it is in ``bits_per_byte``. ``with_words`` mixes it with the base score's model of words.

All training texts are counted, at all depths, and every context that occurs is kept, so the model grows with the corpus.
Texts are dealt to slices of about ``_SLICE`` bytes. A slice's distinct byte sequences of ``depth`` + 1 (grams) and distinct
words go, packed, to buckets by the ``_LOW`` bytes of context next to the predicted one: what hangs below one node of that
depth is in one bucket, where the slices' counts are added and the subtrees built. Only the tree above them, of contexts
shorter than ``_LOW``, is made on the driver and broadcast. A bucket gives each slice the values of its own grams and words,
in the slice's order, so neither is sent back; the slice's texts then look them up. The weights are fixed, so that the
prediction of a node is one number. The base score is an add-one model of words, whose counts come the same way.

Edge cases: a null text is an empty one, and has its end mark to predict; a null id is not held out; repeated rows
are counted and scored one by one; without training text the model predicts each bit with 1/2; an empty table gives
no rows; further columns are left out of the result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import give_back, held_out, map_texts, materialize, shuffle_width, slices

END = b"\xff"  # no byte of UTF-8
_U = np.uint64
_GRAMS_AT_ONCE, _SLICE = 1_000_000, 16_000_000
_LOW = 3
_TEXTS, _GRAMS, _WORDS = 0, 1, 2  # kinds of rows that a slice has


def normal(texts: pa.Array) -> tuple[pa.Array, pa.ListArray]:
    """Lines of texts (lower-cased words, one space between) and their words; a line without words has one empty word."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words = pc.ascii_split_whitespace(plain)
    return pc.binary_join(words, " "), words


def grams(lines: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each line and its end mark: the ``depth`` bytes before it and the byte itself, the latest lowest.

    END stands before the start. Also how many each line has.
    """
    sizes = pc.binary_length(lines).to_numpy().astype(np.int64)
    one = pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines.cast(pa.binary()))
    raw = END * depth + pc.binary_join(one, pa.scalar(END * max(1, depth), pa.binary()))[0].as_py() + END
    b, n = np.frombuffer(raw, np.uint8).astype(_U), len(raw) - depth
    out = b[depth:].copy()
    for k in range(1, depth + 1):
        out |= b[depth - k : depth - k + n] << _U(8 * k)
    if depth > 1:  # what is between the end mark of a line and the next line is nothing of either
        mine = np.ones(n, bool)
        after = np.cumsum(sizes + depth)[:-1] - depth + 1
        mine[(after[:, None] + np.arange(depth - 1)).ravel()] = False
        out = out[mine]
    return out, sizes + 1


_SMALL = 4096
_HALF = np.array([math.lgamma(i + 0.5) for i in range(_SMALL)])
_WHOLE = np.array([math.lgamma(i + 1.0) for i in range(_SMALL)])


def _log_gamma(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    x = np.maximum(n, _SMALL) + plus
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1)], large)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros, _HALF, 0.5) + _log_gamma(ones, _HALF, 0.5) - _log_gamma(zeros + ones, _WHOLE, 1.0) - math.log(math.pi)


def _merge(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values))


def _bits(byte: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each of the eight decisions: the bits before it, after a leading one, and the bit."""
    for j in range(8):
        yield _U(1 << j) | (byte >> _U(8 - j)), (byte >> _U(7 - j)) & _U(1)


@dataclass
class Level:
    """Nodes of one depth: context << 8 | bits so far. final: P(one) if no longer context is kept; half: if this is the
    deepest node of the path that has counts."""

    keys: np.ndarray
    final: np.ndarray
    half: np.ndarray


def _nodes(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes of one depth from its pairs: keys, zeros, ones."""
    ctx, byte, none = key & ~_U(0xFF), key & _U(0xFF), np.zeros_like(n)
    # sorted pairs give sorted nodes for each bit, so each bit is merged alone
    parts = [_merge(ctx | prefix, np.where(bit == 0, n, none), np.where(bit == 1, n, none)) for prefix, bit in _bits(byte)]
    keys, zeros, ones = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], zeros[order], ones[order]


def _levels(
    kept: list[tuple[np.ndarray, np.ndarray]], low: int, depth: int, child: tuple[np.ndarray, ...] | None = None
) -> tuple[list[Level], tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Levels ``low`` to ``depth`` of the tree from ``kept``, their pairs, as if ``low`` were the root.

    ``child``: what the nodes at ``depth`` have below them (keys of ``depth``, zeros, ones, log weight), if they aren't leaves.
    Also what is left for longer contexts at the last level (value so far, weight), and the first level's ``child``.
    """
    nodes: list[tuple[np.ndarray, ...]] = []  # of each depth: keys, own P(one), own weight over longer contexts, P(one) of the rest
    leaves = child is None
    for d in range(depth, low - 1, -1):
        keys, zeros, ones = _nodes(*kept[d - low])
        own = log_kt(zeros, ones)
        p = ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32)
        if child is None:
            nodes.append((keys, p, np.ones(len(keys), np.float32), p))
            log_w = own
        else:
            up, c0, c1, cw = child
            at = np.searchsorted(keys, up)
            r0, r1, below = zeros.copy(), ones.copy(), np.zeros(len(keys))
            r0[at] -= c0
            r1[at] -= c1
            below[at] += cw
            below += log_kt(r0, r1)
            w = 1 / (1 + np.exp(np.clip(below - own, -60, 60)))
            nodes.append((keys, p, w.astype(np.float32), ((r1 + 0.5) / (r0 + r1 + 1)).astype(np.float32)))
            log_w = np.logaddexp(own, below) - math.log(2)
        child = None
        if d:
            mask = _U((1 << 8 * (d - 1)) - 1)
            child = _merge((((keys >> _U(8)) & mask) << _U(8)) | (keys & _U(0xFF)), zeros, ones, log_w)
    nodes.reverse()
    levels: list[Level] = []
    so_far = carry = np.zeros(0, np.float32)
    for d, (keys, p, w, rest) in enumerate(nodes, low):
        if d > low:
            mask = _U((1 << 8 * (d - 1)) - 1)
            at = np.searchsorted(levels[-1].keys, (((keys >> _U(8)) & mask) << _U(8)) | (keys & _U(0xFF)))
            a, c = so_far[at], carry[at]
        else:
            a, c = np.zeros(len(keys), np.float32), np.ones(len(keys), np.float32)
        if d == depth and leaves:
            final = half = a + c * p
        else:
            so_far, carry = a + c * w * p, c * (1 - w)
            final, half = so_far + carry * rest, so_far + carry * np.float32(0.5)
        levels.append(Level(keys, final, half))
    return levels, (so_far, carry), child or ()


def _shorter(key: np.ndarray, n: np.ndarray, low: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The pairs of depths ``low`` to ``depth`` from the sorted ones of ``depth``."""
    out = [(key, n)]
    for d in range(depth - 1, low - 1, -1):
        out.append(_merge(out[-1][0] & _U((1 << 8 * (d + 1)) - 1), out[-1][1]))
    return out[::-1]


def _walk(levels: list[Level], low: int, ctx: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """P(one) at the deepest node of each path that has counts, where every context is kept; 1/2 without one."""
    p, open_ = np.full(len(ctx), 0.5, np.float32), np.arange(len(ctx))
    for d in range(low + len(levels) - 1, low - 1, -1):
        level = levels[d - low]
        if not len(level.keys) or not len(open_):
            continue
        key = ((ctx[open_] & _U((1 << 8 * d) - 1)) << _U(8)) | prefix[open_]
        at = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
        hit = level.keys[at] == key
        p[open_[hit]] = level.half[at[hit]]
        open_ = open_[~hit]
    return p


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in ascending order, by sorting in place (numpy's own way hashes, which takes more time and memory here)."""
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Distinct keys of several arrays, which are let go before they are sorted."""
    keys = np.concatenate(parts)
    parts.clear()
    return _distinct(keys)


def _counted(keys: np.ndarray, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, which are sorted in place, and how often each occurs, or 0 if they aren't counted."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.uint32) if counted else np.zeros(len(first), np.uint32)


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (distinct sorted keys, n) of several such, added; empties ``parts``."""
    if len(parts) == 1:
        return parts.pop()
    keys = _distinct(np.concatenate([k for k, _ in parts]))
    n = np.zeros(len(keys), np.uint32)
    while parts:
        k, m = parts.pop()
        n[np.searchsorted(keys, k)] += m
    return keys, n


def _near_first(gram: np.ndarray, depth: int) -> np.ndarray:
    """Grams as numbers whose order is that of the context next to the predicted byte; ``_gram`` turns them back."""
    low = min(_LOW, depth)
    near, far = (gram >> _U(8)) & _U((1 << 8 * low) - 1), gram >> _U(8 * (low + 1))
    return (near << _U(8 * (depth - low + 1))) | (far << _U(8)) | (gram & _U(0xFF))


def _gram(turned: np.ndarray, depth: int) -> np.ndarray:
    low = min(_LOW, depth)
    near = turned >> _U(8 * (depth - low + 1))
    far = (turned >> _U(8)) & _U((1 << 8 * (depth - low)) - 1)
    return (far << _U(8 * (low + 1))) | (near << _U(8)) | (turned & _U(0xFF))


def _in_buckets(turned: np.ndarray, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted grams (as ``_near_first`` makes them) by bucket, and where each bucket begins in it."""
    near = turned >> _U(8 * (depth - min(_LOW, depth) + 1))
    near *= _U(0x9E3779B97F4A7C15)
    near >>= _U(32)
    near %= _U(buckets)
    bucket = near.astype(np.uint16 if buckets < 1 << 16 else np.int64)
    del near
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _packed(x: np.ndarray) -> bytes:
    """The bytes of numbers, place by place, compressed."""
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, size * n, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Words:
    """The distinct words of texts that come in parts, and for each part's words their places among them."""

    def __init__(self) -> None:
        self.dictionaries: list[pa.Array] = []
        self.counts: list[np.ndarray] = []

    def add(self, words: pa.ListArray, train: np.ndarray | None = None) -> np.ndarray:
        """Places of the words in this part's dictionary; ``train``: whether each text's words are counted."""
        coded = words.flatten().dictionary_encode()
        places = coded.indices.to_numpy()
        self.dictionaries.append(coded.dictionary)
        if train is not None:
            counted = np.repeat(train, np.diff(words.offsets.to_numpy()))
            self.counts.append(np.bincount(places[counted], minlength=len(coded.dictionary)))
        return places

    def merged(self) -> tuple[pa.Array, list[np.ndarray]]:
        """All distinct words, and the place among them of each word of each part's dictionary."""
        coded = pa.concat_arrays(self.dictionaries).dictionary_encode()
        ends = np.cumsum([len(x) for x in self.dictionaries])
        return coded.dictionary, np.split(coded.indices.to_numpy(), ends[:-1])


def _words_in_buckets(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of words by bucket, and where each bucket begins in it."""
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _sliced(rows: DataFrame, depth: int, buckets: int) -> DataFrame:
    """What each slice has: its texts in chunks (ids, lines and their lengths), and by bucket its distinct grams and words with
    their counts in training texts, which may be 0. ``rows``: _id, _text, _train. The empty word stands for the end mark.
    """
    kind = dict(rows.dtypes)["_id"]
    names = ["slice", "kind", "bucket", "n", "ids", "blob", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        words, trained = _Words(), 0
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = waiting = chunk = 0
        id_type = pa.null()

        def row(what: int, bucket: int, n: int, blob: bytes, counts: bytes, ids: pa.Array | None = None) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids) if ids is not None else pa.nulls(1, pa.list_(id_type))
            columns = [pa.array([x], t) for x, t in ((task << 32 | number, pa.int64()), (what, pa.int32()), (bucket, pa.int32()), (n, pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, lists, pa.array([blob], pa.binary()), pa.array([counts], pa.binary())], names)

        def merge() -> None:
            nonlocal waiting
            for train, lists in held.items():
                if lists:
                    g = np.concatenate(lists)
                    lists.clear()
                    parts.append(_counted(g, train))
            if len(parts) > 3:
                parts.append(_sum(parts))
            waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal words, trained, size, number, chunk
            merge()
            g, n = _sum(parts)
            turned = _near_first(g, depth)
            del g
            order = np.argsort(turned)
            turned, n = turned[order], n[order]
            order, at = _in_buckets(turned, depth, buckets)
            turned, n = turned[order], n[order]
            del order
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if b > a:
                    yield row(_GRAMS, k, b - a, _packed(turned[a:b]), _packed(n[a:b]))
            del turned, n
            names_, places = words.merged()
            counts = np.zeros(len(names_), np.uint32)
            for own, n in zip(places, words.counts, strict=True):
                counts[own] += n.astype(np.uint32)
            if (mark := names_.index("").as_py()) >= 0:
                counts[mark] = trained
            order, at = _words_in_buckets(names_, buckets)
            names_, counts = names_.take(pa.array(order)).to_pylist(), counts[order]
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if b > a:
                    raw = " ".join(names_[a:b]).encode()
                    yield row(_WORDS, k, len(raw), pa.compress(raw, codec="zstd", asbytes=True), _packed(counts[a:b]))
            words, trained, size, number, chunk = _Words(), 0, 0, number + 1, 0
            give_back()

        for batch in slices(batches, 4096, 1 << 20):
            id_type = batch.column(0).type
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            lines, own = normal(batch.column(1))
            if chunk == 0:
                own = pa.ListArray.from_arrays(pa.concat_arrays([own.offsets, pa.array([len(own.values) + 1], pa.int32())]), pa.concat_arrays([own.values, pa.array([""])]))
                words.add(own, np.append(train, False))
            else:
                words.add(own, train)
            trained += int(train.sum())
            g, n = grams(lines, depth)
            mine = np.repeat(train, n)
            held[True].append(g[mine])
            held[False].append(g[~mine])
            size, waiting = size + len(g), waiting + len(g)
            del g, mine
            raw = "".join(lines.to_pylist()).encode()
            yield row(_TEXTS, chunk, len(raw), pa.compress(raw, codec="zstd", asbytes=True), _packed((n - 1).astype(np.int32)), batch.column(0))
            chunk += 1
            if waiting >= _GRAMS_AT_ONCE:
                merge()
            if size >= _SLICE:
                yield from out()
        if size:
            yield from out()

    return map_texts(rows, run, f"slice long, kind int, bucket int, n int, ids array<{kind}>, blob binary, counts binary")


def _grams_of(table: pa.Table, depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a bucket: its distinct grams in ascending order, their counts, and the places among them of each row's grams."""
    columns = [table.column(c).to_pylist() for c in ("n", "blob", "counts")]
    parts = [(_unpacked(x, _U, n), _unpacked(c, np.uint32, n)) for n, x, c in zip(*columns, strict=True)]
    turned = _distinct(np.concatenate([x for x, _ in parts]))
    counts, places = np.zeros(len(turned), np.int64), []
    for x, n in parts:
        places.append(np.searchsorted(turned, x))
        counts[places[-1]] += n
    key = _gram(turned, depth)
    order = np.argsort(key)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return key[order], counts[order], [back[x] for x in places]


def _words_of(table: pa.Table) -> tuple[Counter, list[list[bytes]]]:
    columns = [table.column(c).to_pylist() for c in ("n", "blob", "counts")]
    total: Counter = Counter()
    lists = []
    for n, raw, c in zip(*columns, strict=True):
        lists.append(pa.decompress(raw, n, codec="zstd", asbytes=True).split(b" "))
        for w, k in zip(lists[-1], _unpacked(c, np.uint32, len(lists[-1])).tolist(), strict=True):
            total[w] += k
    return total, lists


def _top(rows: DataFrame, depth: int) -> tuple[tuple, int, int]:
    """The tree above the subtrees, the number of training tokens and that of distinct ones. ``rows``: grams and words in buckets."""
    low = min(_LOW, depth)

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == _WORDS:
            known = [n for n in _words_of(table)[0].values() if n]
            return pa.table({"key": pa.array([-1], pa.int64()), "n": pa.array([sum(known)], pa.int64()), "log": pa.array([float(len(known))])})
        key, n, _ = _grams_of(table, depth)
        key, n = key[n > 0], n[n > 0]
        _, _, (up, _, _, log) = _levels(_shorter(key, n, low, depth), low, depth)
        pair, sums = _merge(key & _U((1 << 8 * low) - 1), n)
        return pa.table({
            "key": pa.array(np.concatenate([pair, up]).view(np.int64)),
            "n": pa.concat_arrays([pa.array(sums, pa.int64()), pa.nulls(len(up), pa.int64())]),
            "log": pa.concat_arrays([pa.nulls(len(pair), pa.float64()), pa.array(log, pa.float64())]),
        })

    found = rows.groupBy("kind", "bucket").applyInArrow(run, "key long, n long, log double")
    # keys are pairs and nodes of contexts shorter than _LOW: at most 2 * 256 ** _LOW rows, whatever the size of the corpus
    table = found.groupBy("key", F.col("n").isNull().alias("node")).agg(F.sum("n").alias("n"), F.sum("log").alias("log")).toArrow()
    key, node = table.column("key").to_numpy(), table.column("node").to_numpy()
    n, log = (table.column(c).to_numpy() for c in ("n", "log"))
    words = key < 0
    total, kinds = (int(x[words].sum()) for x in (n, log))
    pairs = np.flatnonzero(~node & ~words)
    pairs = pairs[np.argsort(key[pairs])]
    kept = _shorter(key[pairs].astype(_U), n[pairs].astype(np.int64), 0, low - 1)
    nodes = np.flatnonzero(node)
    nodes = nodes[np.argsort(key[nodes])]
    keys, zeros, ones = _nodes(*kept[-1])  # every context is kept: the longer ones have all counts of theirs
    assert (keys == key[nodes].astype(_U)).all()
    levels, left, _ = _levels(kept, 0, low - 1, (keys, zeros, ones, log[nodes]))
    return (levels, left), total, kinds


def _log10(key: np.ndarray, n: np.ndarray, top: tuple, depth: int) -> np.ndarray:
    """log10 P of the last byte of every gram of a bucket (sorted ``key``, with counts ``n``)."""
    low = min(_LOW, depth)
    below, _, _ = _levels(_shorter(key[n > 0], n[n > 0], low, depth), low, depth)
    levels, (so_far, carry) = top
    ctx, total, last = key >> _U(8), np.zeros(len(key)), levels[-1].keys
    for prefix, bit in _bits(key & _U(0xFF)):
        p = _walk(levels, 0, ctx, prefix)
        if len(last):
            node = ((ctx & _U((1 << 8 * (low - 1)) - 1)) << _U(8)) | prefix
            at = np.minimum(np.searchsorted(last, node), len(last) - 1)
            p = np.where(last[at] == node, so_far[at] + carry[at] * _walk(below, low, ctx, prefix), p)
        # from 2 ** 24 occurrences on, a float of 32 bits may say 1 for what is less than it
        total += np.log10(np.where(bit == 1, p, np.maximum(1 - p, np.float32(2**-25))))
    return total


class _Lookup:
    """Places of keys that are known to be among ``keys``, by a few hash tables: each holds what the ones before couldn't."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        rest, odd = np.arange(len(keys), dtype=np.int32), 0x9E3779B97F4A7C15
        while len(rest):
            bits = max(4, (2 * len(rest)).bit_length())
            table = np.zeros(1 << bits, np.int32)
            at = ((keys[rest] * _U(odd)) >> _U(64 - bits)).astype(np.int64)
            table[at] = rest
            self.tables.append((bits, odd, table))
            rest, odd = rest[table[at] != rest], odd * 0xBF58476D1CE4E5B9 % (1 << 64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.empty(len(keys), np.int32), None
        for bits, odd, table in self.tables:
            own = keys if rest is None else keys[rest]
            found = table[((own * _U(odd)) >> _U(64 - bits)).astype(np.int64)]
            if rest is None:
                out, rest = found, np.flatnonzero(self.keys[found] != own)
            else:
                out[rest] = found
                rest = rest[self.keys[found] != own]
            if not len(rest):
                break
        return out


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, rest: int = 2, depth: int = 6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (~held_out(F.col(id_col), mod, rest)).alias("_train"))
    kind = dict(rows.dtypes)["_id"]
    width = shuffle_width(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = parts = max(width, 2 * math.ceil(size / _SLICE))  # a slice or a bucket is whole in a task
    sliced = materialize(_sliced(rows, depth, buckets), "slices")
    dealt = sliced.where(F.col("kind") != _TEXTS).select("slice", "kind", "bucket", "n", "blob", "counts").repartition(parts, "kind", "bucket")
    found, total, kinds = _top(dealt, depth)
    top = spark.sparkContext.broadcast(found)

    def values(table: pa.Table) -> pa.Table:
        what, bucket = (table.column(c)[0].as_py() for c in ("kind", "bucket"))
        if what == _WORDS:
            known, lists = _words_of(table)
            parts = [np.fromiter(map(known.__getitem__, x), np.int64, len(x)) for x in lists]
        else:
            key, n, places = _grams_of(table, depth)
            log = _log10(key, n, top.value, depth).astype(np.float32)
            parts = [log[x] for x in places]
        n = len(parts)
        columns = {"kind": pa.array([what] * n, pa.int32()), "bucket": pa.array([bucket] * n, pa.int32()), "n": pa.array(map(len, parts), pa.int32())}
        return pa.table({"slice": table.column("slice"), **columns, "blob": pa.array(map(_packed, parts), pa.binary())})

    def texts(own: pa.Table, found: pa.Table) -> pa.Table:
        give_back()  # what the worker's last group left
        own, found = own.sort_by("bucket"), found.sort_by("bucket")
        columns = [found.column(c).to_pylist() for c in ("kind", "n", "blob")]
        log = np.concatenate([_unpacked(x, np.float32, n) for what, n, x in zip(*columns, strict=True) if what == _GRAMS])
        counts = np.concatenate([_unpacked(x, np.int64, n) for what, n, x in zip(*columns, strict=True) if what == _WORDS])
        del found, columns
        # the slice's grams and words once more, in the order in which their values came
        words, chunks, parts, lot, waiting = _Words(), [], [], [], 0
        columns = [own.column(c).to_pylist() for c in ("n", "blob", "counts")]
        for ids, n, raw, sizes in zip(own.column("ids"), *columns, strict=True):
            ends = np.concatenate([[0], np.cumsum(_unpacked(sizes, np.int32, len(ids)))]).astype(np.int32)
            buffers = [None, pa.py_buffer(ends), pa.py_buffer(pa.decompress(raw, n, codec="zstd", asbytes=True))]
            lines = pa.StringArray.from_buffers(len(ids), *buffers[1:])
            split = pc.ascii_split_whitespace(lines)
            chunks.append((lines, words.add(split), np.diff(split.offsets.to_numpy())))
            lot.append(grams(lines, depth)[0])
            waiting += len(lot[-1])
            if waiting >= _GRAMS_AT_ONCE:
                parts.append(_joined(lot))
                waiting = 0
                if len(parts) > 3:
                    parts.append(_joined(parts))
        del columns, raw, buffers
        words.dictionaries[0] = pa.concat_arrays([words.dictionaries[0], pa.array([""])])
        parts += lot
        del lot
        turned = _near_first(_joined(parts), depth)
        turned.sort()
        turned = turned[_in_buckets(turned, depth, buckets)[0]]
        turned = _gram(turned, depth)
        lookup = _Lookup(turned)
        del turned
        names, places = words.merged()
        order, _ = _words_in_buckets(names, buckets)
        known = np.empty(len(names), np.int64)
        known[order] = counts
        logs, mark = np.log10(known + 1), names.index("").as_py()
        results: list[list[np.ndarray]] = [[], [], [], [], []]
        for (lines, own_words, held), place in zip(chunks, places, strict=True):
            at = place[own_words]
            real = at != mark  # the empty word of a blank line is none
            begins = np.cumsum(held) - held
            of = lambda x: np.add.reduceat(np.where(real, x, 0), begins)  # noqa: B023, E731
            g, n = grams(lines, depth)
            scores = np.add.reduceat(log[lookup(g)].astype(np.float64), np.cumsum(n) - n)
            one = [of(1) + 1, of(known[at] > 0) + (known[mark] > 0), of(logs[at]) + logs[mark], scores, n]
            for column, x in zip(results, one, strict=True):
                column.append(x)
        kinds_ = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        out_ = [pa.array(np.concatenate(x), t) for x, t in zip(results, kinds_, strict=True)]
        ids = pa.chunked_array([x.flatten() for x in own.column("ids").chunks]).combine_chunks()
        return pa.Table.from_arrays([ids, *out_], ["doc_id", "n_tokens", "n_known", "base", "score", "n_bytes"])

    back = dealt.groupBy("kind", "bucket").applyInArrow(values, "slice long, kind int, bucket int, n int, blob binary").repartition(parts, "slice")
    own = sliced.where(F.col("kind") == _TEXTS).select("slice", "bucket", "n", "ids", "blob", "counts").repartition(parts, "slice")
    schema = f"doc_id {kind}, n_tokens long, n_known long, base double, score double, n_bytes long"
    out = own.groupBy("slice").cogroup(back.groupBy("slice")).applyInArrow(texts, schema)
    return out.select(
        "doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") - F.lit(math.log10(total + kinds + 1)) * F.col("n_tokens")).alias("base_score"), "score", "n_bytes",
        (F.col("score") * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def with_words(scored: DataFrame) -> DataFrame:
    """``score``'s rows, with the mixture of the tree and the add-one model of words as score: each text is from one of them, with probability 1/2.

    The tree spells words it doesn't know, which the model of words holds to be one outcome. So with little training text, or very many new words, the
    tree alone is far below; the mixture is never more than log10(2) below either. ``bits_per_byte`` stays the tree's code length.
    """
    high, low = F.greatest("score", "base_score"), F.least("score", "base_score")
    return scored.withColumn("score", high + F.log10((F.lit(1.0) + F.pow(F.lit(10.0), low - high)) / 2))

"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most d bits agree on at least b - d of b blocks. Each fingerprint is put, once for
every choice of b - d blocks, into the bucket of those blocks' bits; rows of a bucket are verified by Hamming
distance in the task, which emits a spanning forest of the bucket's links. Documents with one fingerprint are one
row from the start, so copies cost nothing. The number of blocks follows the number of fingerprints, so that
buckets stay small; any number of blocks finds every link.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like others; fewer words than a
shingle: the whole sequence is one shingle; a null doc_id is never the least of a component unless all are null;
repeated rows belong together; an empty table gives no rows; further columns are left out of the result.

``keep_one`` with ``similarity`` links by the Jaccard similarity of the sets of shingles, and its candidates come from SimHash too.
Fingerprints of 64 bits of texts that are 0.8 alike differ in ten bits and more, too many to tell them from others, so a set
(each shingle once) has ``WIDE`` x 64 bits here: a share acos(2s / (1 + s)) / pi of them differs at similarity s (large sets; up to
0.008 more for small ones, 0.04 for sets of 4 and 5). No choice of blocks is a guarantee at such a distance, so blocks are
drawn from all bits, as many as an expected recall of ``RECALL`` at the threshold takes (``_drawn``); fingerprints that share a
block and are within the distance are candidates. Whole sets decide: those of one component of candidates are compared, each
pair within the distance, until they are connected. Texts with one set are one row, and so are sets with one fingerprint
until sets are compared.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.buckets import _SHIFT, Forest, dealt, groups, neighbours
from cubeloom.llm.common import map_texts, materialize, slices, small, with_key_values
from cubeloom.llm.components import components

_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LOT = 1 << 16
#: 64-bit words of a set's fingerprint; expected share of the pairs at the threshold that are candidates; sets compared at a time.
WIDE, RECALL, MOST_SETS = 4, 0.999, 1024
_FP = [f"_f{k}" for k in range(WIDE)]


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64 bits, as an unsigned number."""
    import xxhash

    words = _WORDS.findall(text.encode().translate(_LOWER)) if text else []
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _LOT):
        part = [digest(line[a:b], seed) for a, b in zip(starts[at : min(n, at + _LOT)], stops[at : at + _LOT], strict=True)]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, _text_key (a hash that tells rows with one id apart), _fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "_text_key", "_fp"])

    kind = docs.select(id_col).dtypes[0][1]
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_text_key"), text.alias("_text"))
    return map_texts(rows, run, f"doc_id {kind}, _text_key long, _fp long")


def _blocks(n: int, distance: int) -> tuple[int, int]:
    """(blocks, blocks that must agree): the fewest blocks whose buckets hold about 64 random fingerprints."""
    for b in range(distance + 2, 64):
        bits = 64 * (b - distance) // b
        if n >> bits <= 64 or b >= 2 * distance + 2:
            return b, b - distance
    raise ValueError("distance is too large")


def links(fps: DataFrame, *, distance: int = 4) -> DataFrame:
    """A spanning forest, bucket by bucket, of the links between distinct fingerprints ``_fp``: (a, b)."""
    b, agree = _blocks(fps.count(), distance)
    edges = [64 * k // b for k in range(b + 1)]
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(b), agree)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(t).alias("t"), F.col("_fp").bitwiseAND(F.lit(mask)).alias("bits")))
    rows = fps.select("_fp", F.explode(F.array(*keys)).alias("_k"))
    rows = rows.select("_fp", F.xxhash64("_k.t", "_k.bits").alias("_g"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, table in groups(batches):
            fp = table.column("_fp").to_numpy().view(np.uint64)
            forest = Forest(len(n))
            for i, j in neighbours(n, table):
                near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
                forest.add(i[near], j[near])
            ab = fp.view(np.int64)[np.array(forest.kept, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return dealt(rows, spread="_fp").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, _text_key, _fp, _root (fingerprint that stands for the component)."""
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints")
    roots = components(links(materialize(rows.select("_fp").distinct(), "distinct-fingerprints"), distance=distance))
    roots = roots.select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    return rows.join(small(roots), "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))


def shingle_set(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle: the whole sequence is one."""
    import xxhash

    words = _WORDS.findall(text.encode().translate(_LOWER)) if text else []
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((digest(b" ".join(words[k : k + shingle]), seed) for k in range(n)), np.uint64, n))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes: WIDE numbers, the first by the hashes themselves, the others by mixes of them."""
    out = np.zeros(WIDE, np.uint64)
    for k in range(WIDE if len(shingles) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(shingles), _LOT):
            part = shingles[at : at + _LOT]
            if k:  # splitmix64
                part = part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                part = (part ^ (part >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                part = (part ^ (part >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                part ^= part >> np.uint64(31)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(ones * 2 > len(shingles)).view(np.uint64)[0]
    return out


def _drawn(n: int, similarity: float) -> tuple[int, int, np.ndarray]:
    """(distance of the first word, of all words, places of bits (blocks, bits of each)) for ``n`` fingerprints.

    A bucket holds up to about 1,024 random ones: more blocks of more bits would be fewer comparisons, but more to shuffle. The
    number of bits that differ at the threshold is binomial; a block misses them all if it is drawn from the others.
    """
    width = 64 * WIDE
    share = max(0.01, 1.08 * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    first, distance = (round(w * share + 4 * math.sqrt(w * share * (1 - share))) for w in (64, width))
    bits = max(8, (n >> 10).bit_length())
    chance = [math.comb(width, d) * share**d * (1 - share) ** (width - d) for d in range(distance + 1)]
    misses = np.array([1 - math.comb(width - d, bits) / math.comb(width, bits) for d in range(distance + 1)])
    blocks = 1
    while 1 - np.dot(chance, misses**blocks) - (1 - sum(chance)) < RECALL:
        blocks += 1
    rng = np.random.default_rng(42)
    return first, distance, np.array([rng.choice(width, bits, replace=False) for _ in range(blocks)])


def _differing(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int32)


def _numbers(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The fingerprints of a table's rows: (rows, WIDE)."""
    return np.column_stack([table.column(c).to_numpy() for c in _FP]).view(np.uint64)


def _within(n: np.ndarray, table: pa.Table, word: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs of ``neighbours`` whose ``word`` is within the distance, by 256 rows of a group against all after them."""
    own, part = table.column("_own").to_numpy(), table.column("_part").to_numpy()
    inner = (part >> _SHIFT) == (part & ((1 << _SHIFT) - 1))
    starts = np.flatnonzero(np.diff(n, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(n)], strict=True):
        for at in range(a, b - 1, 256):
            i, j = np.nonzero(np.bitwise_count(word[at : min(b, at + 256), None] ^ word[at:b]) <= distance)
            i, j = at + i, at + j
            counted = (i < j) & (inner[i] | (own[i] != own[j]))
            yield i[counted], j[counted]


def _candidates(fps: DataFrame, first: int, distance: int, places: np.ndarray) -> DataFrame:
    """A spanning forest, bucket by bucket, of the distinct fingerprints (_f0, ...) within the distance: (a, b), by their hashes."""
    blocks, bits = places.shape

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits)
        for batch in slices(batches):
            ones = np.unpackbits(_numbers(batch).view(np.uint8), axis=1)
            keys = np.empty((len(ones), blocks), np.int64)
            for t in range(blocks):
                keys[:, t] = (t << bits) + ones[:, places[t]] @ weights
            again = pa.array(np.repeat(np.arange(len(ones)), blocks))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *batch.take(again).columns], ["_g", *_FP])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, table in groups(batches):
            fp, forest = _numbers(table), Forest(len(n))
            for i, j in _within(n, table, fp[:, 0].copy(), first):
                while len(i):
                    open_ = forest.up[i] != forest.up[j]
                    i, j = i[open_], j[open_]
                    near = _differing(fp, i, j) <= distance
                    i, j = i[near], j[near]
                    one = np.unique(j, return_index=True)[1]  # the others are mostly connected then
                    forest.add(i[one], j[one])
            ab = np.array(forest.kept, np.int64).reshape(-1, 2)
            keys = [pa.array(np.array([_set_key(x) for x in fp[rows]], np.uint64).view(np.int64)) for rows in ab.T]
            yield pa.RecordBatch.from_arrays(keys, ["a", "b"])

    met = dealt(map_texts(fps.select(*_FP), bucket, ", ".join(f"{c} long" for c in ("_g", *_FP))), spread=_FP[0])
    return map_texts(met, verify, "a long, b long")


def _set_key(x: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(x.tobytes())


def similar(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, similarity: float, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, _text_key, _set (hash of its set of shingles), _root (stands for the component)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, shingle, seed) for x in batch.column(2).to_pylist()]
            fps = np.array([wide_fingerprint(x) for x in sets], np.uint64)
            own = [np.array([_set_key(x) for x in rows], np.uint64).view(np.int64) for rows in (sets, fps)]
            columns = [*batch.columns[:2], *map(pa.array, own), *map(pa.array, fps.view(np.int64).T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_text_key", "_set", "_fp", *_FP])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x, shingle, seed) for x in batch.column(0).to_pylist()]
            own = np.array([_set_key(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([x.tobytes() for x in sets], pa.binary())], ["_set", "_shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, table in groups(batches, at_least=MOST_SETS):
            sets = [np.frombuffer(x, np.uint64) for x in table.column("_shingles").to_pylist()]
            size, fp = np.array([len(x) for x in sets]), _numbers(table)
            forest = Forest(len(n))
            for i, j in neighbours(n, table):
                # a pair that is connected already needs no look, nor one whose sizes rule it out
                open_ = (forest.up[i] != forest.up[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
                i, j = i[open_], j[open_]
                close_ = _differing(fp, i, j) <= distance
                i, j = i[close_], j[close_]
                both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
                near = both >= similarity * (size[i] + size[j] - both)
                forest.add(i[near], j[near])
            ab = table.column("_set").to_numpy()[np.array(forest.kept, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    kind = docs.select(id_col).dtypes[0][1]
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("_text_key"), text.alias("_text"))
    longs = ", ".join(f"{c} long" for c in ("_text_key", "_set", "_fp", *_FP))
    rows = materialize(map_texts(rows, keys, f"doc_id {kind}, {longs}"), "wide-fingerprints")
    fps = materialize(rows.select("_fp", *_FP).dropDuplicates(["_fp"]), "distinct-fingerprints")
    first, distance, places = _drawn(fps.count(), similarity)
    roots = components(_candidates(fps, first, distance, places)).select(F.col("node").alias("_fp"), F.col("root").alias("_g"))
    one = rows.groupBy("_set", "_fp", *_FP).agg(F.min("_text_key").alias("_text_key")).join(small(roots), "_fp", "left")
    one = materialize(one.withColumn("_g", F.coalesce("_g", "_fp")), "sets")
    shared = one.groupBy("_g").count().where("count > 1").select("_g")
    close = materialize(one.join(shared, "_g", "left_semi"), "close")
    texts = docs.select(text.alias("_text"), F.xxhash64(text).alias("_text_key")).join(small(close.select("_text_key")), "_text_key", "left_semi")
    sets = map_texts(texts.dropDuplicates(["_text_key"]).select("_text"), whole, "_set long, _shingles binary")
    met = dealt(close.join(materialize(sets, "shingle-sets"), "_set"), spread="_set", most=MOST_SETS)
    found = map_texts(met.select("_g", "_part", "_own", "_set", *_FP, "_shingles"), verify, "a long, b long")
    roots = components(found).select(F.col("node").alias("_set"), F.col("root").alias("_root"))
    return rows.select("doc_id", "_text_key", "_set").join(small(roots), "_set", "left").withColumn("_root", F.coalesce("_root", "_set"))


def component_ids(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach)."""
    rows = materialize(near_duplicates(docs, **options).select("doc_id", "_fp", "_root"), "near-duplicates")
    least = materialize(rows.groupBy("_root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n")), "components")
    return with_key_values(rows, least, "_root").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """The documents without near-duplicates: of each component the one with the least id (null last) stays.

    Links are those of the fingerprints, or with ``similarity`` those of the sets of shingles that are at least so alike. All
    columns are kept, whatever their names; of rows with equal id and text any one stays.
    """
    if similarity is None:
        rows = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    else:
        rows = similar(docs, id_col=id_col, text_col=text_col, similarity=similarity, **options)
    rows = materialize(rows.select("doc_id", "_text_key", "_root"), "near-duplicates")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_text_key").alias("k"))
    least = rows.groupBy("_root").agg(F.min(place).alias("_least"), F.count("*").alias("_n"))
    groups_ = materialize(least.where(F.col("_n") > 1), "components")
    gone = with_key_values(rows, groups_, "_root").where(place != F.col("_least")).select("doc_id", "_text_key").distinct()
    gone = materialize(gone, "dropped").select(F.col("doc_id").alias("_gone_id"), F.col("_text_key").alias("_gone_key"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(whole.alias("_doc"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_text_key"))
    out = out.join(small(gone), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_text_key") == F.col("_gone_key")), "left_anti")
    if rows.groupBy("doc_id", "_text_key").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates(["_id", "_text_key"])
    return out.select("_doc.*")

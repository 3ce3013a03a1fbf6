"""Phrase collocations, mined with suffix automata.

Texts are cleaned to words and pieces and gathered to *shards* of about ``_SHARD`` bytes of one language, which are
written to the shared folder. Each shard is an automaton of the suffixes of its pieces, bounded at ``words`` words: a state
stands for the strings that end at the same positions, so it has one count for all of them, and its suffix link leads to
the state of the longest suffix that ends at more positions. The states enumerate the shard's distinct strings.

1. A shard sends its strings' hashes (48 bits) and counts, sorted and packed, to buckets by the hash. A bucket adds the
   counts up and answers each shard with those of its hashes that reach ``least`` in all. A hash that several strings
   share only lets more of them through.
2. A shard builds its automaton once more and sends the strings that came back, packed with their counts, to lots by the hash; a lot
   adds them up by the strings themselves, exactly. So what shards send is a row for each lot, not one for each string.

A candidate is subsumed by a longer one. Frequencies fall along suffix links (and from a string to one word more on either
side), so whatever longer string subsumes a candidate, one that is longer by just one word does too: it is enough to send
each candidate's frequency along its link, to the string without its first word, and to that without its last.

Edge cases: a null text is empty; a null language is ``und``; repeated rows count each; an empty table gives no rows; texts
without words add nothing; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import give_back, map_texts, materialize, shuffle_width, slices

_U = np.uint64
#: Bytes of cleaned text in a shard; one piece that is longer is a shard of its own.
_SHARD = 16 << 20
#: Strings that a bucket is made for.
_BUCKET = 1 << 21
#: Words of all texts for each lot of frequent strings, in which their exact counts are added.
_LOT = 1 << 23
_BITS = 48
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)
#: Space between words, line feed between pieces, A-Z in lower case.
_CLEAN = bytes(0x20 if b == 0x09 else 0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(body: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word, distinct words, whether a word begins a piece) of a cleaned text."""
    raw = np.frombuffer(body, np.uint8)
    line = raw == 0x0A
    word = ~line & (raw != 0x20)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    starts, ends = edge[::2], edge[1::2]
    lines = np.cumsum(line)[starts] if len(starts) else starts
    first = np.concatenate([[True], lines[1:] > lines[:-1]])[: len(starts)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    every = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[word])])
    coded = every.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, first


class Automaton:
    """The suffix automaton of word sequences, of strings of at most ``depth`` words.

    Made by levels of length: the strings of d words are those of d - 1 and a word, numbered by sorting. A string whose one
    extension to the left ends at all of its end positions is in that extension's state. For each state: ``end`` (an end
    position), ``longest`` and ``shortest`` (words of its strings), ``count`` (end positions) and ``link`` (-1: the root).
    """

    def __init__(self, words: np.ndarray, first: np.ndarray, depth: int):
        self.words, self.depth = words, depth
        n, kinds = len(words), int(words.max(initial=0)) + 1
        piece = np.cumsum(first, dtype=np.int32)
        at, starts, counts, suffix = [], [], [], []  # by level: number of the string that begins at a position, ...
        run = np.arange(n, dtype=np.int32)
        for d in range(1, depth + 1):
            whole = np.flatnonzero(piece[: n - d + 1] == piece[d - 1 :]).astype(np.int32) if n >= d else np.zeros(0, np.int32)
            key = words[whole + d - 1] if d == 1 else run[whole].astype(np.int64) * kinds + words[whole + d - 1]
            _, begins, number, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            del key
            begins = whole[begins]
            suffix.append(run[begins + 1] if d > 1 else np.full(len(begins), -1, np.int32))
            run = np.full(n, -1, np.int32)
            run[whole] = number
            del whole, number
            at.append(run)
            starts.append(begins)
            counts.append(count.astype(np.int32))
        del piece
        # from the longest strings down: a string is in the state of its left extension if that ends wherever it does
        states = 0
        parts: list[list[np.ndarray]] = [[], [], []]
        of: list[np.ndarray] = [np.zeros(0, np.int32)] * depth
        shortest = np.zeros(0, np.int8)
        for d in range(depth, 0, -1):
            own = np.full(len(starts[d - 1]), -1, np.int32)
            if d < depth and len(starts[d]):
                same = counts[d] == counts[d - 1][suffix[d]]
                own[suffix[d][same]] = of[d][same]
                shortest[of[d][same]] = d
            new = np.flatnonzero(own < 0).astype(np.int32)
            own[new] = states + np.arange(len(new), dtype=np.int32)
            states += len(new)
            for part, x in zip(parts, (starts[d - 1][new] + d - 1, np.full(len(new), d, np.int8), counts[d - 1][new]), strict=True):
                part.append(x)
            shortest = np.concatenate([shortest, np.full(len(new), d, np.int8)])
            of[d - 1] = own
        del starts, counts, suffix
        self.end, self.longest, self.count = (np.concatenate(x) for x in parts)
        self.shortest, self.link = shortest, np.full(states, -1, np.int32)
        for d in range(2, depth + 1):
            here = np.flatnonzero(shortest == d)
            self.link[here] = of[d - 2][at[d - 2][self.end[here] - d + 2]]

    def strings(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, start of an occurrence, count) of the distinct strings of each length, state by state."""
        for d in range(1, self.depth + 1):
            here = np.flatnonzero((self.shortest <= d) & (self.longest >= d))
            yield d, self.end[here] - d + 1, self.count[here]


def _hashes(lang: str, words: np.ndarray, names: pa.Array, d: int, starts: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """Hashes of ``_BITS`` bits of strings of ``d`` words. ``known``: holds the words' hashes once they are made."""
    if not known:
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        known.append(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in names.to_pylist()), np.uint64, len(names)))
    h = np.full(len(starts), d, np.uint64)
    for k in range(d):
        h += known[0][words[starts + k]] * _FACTORS[k]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h >> _U(64 - _BITS)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, compressed: the high bytes of small numbers are all alike."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd"), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _shards(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(shard, lang, words, size, body): cleaned texts of a language, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def give() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, parts in held.items():
                body, at = b"\n".join(parts), 0
                while at < len(body):
                    end = len(body) if len(body) - at <= 2 * _SHARD else body.rfind(b"\n", at + 1, at + _SHARD)
                    if end < 0:  # one piece that is longer than a shard
                        end = body.find(b"\n", at + _SHARD)
                        end = len(body) if end < 0 else end
                    part = body[at:end]
                    n = len(tokens(part)[0])
                    if n:
                        made += 1
                        columns = ([f"{task}-{made}"], [lang], [n], [len(part)], [pa.compress(part, codec="zstd", asbytes=True)])
                        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "lang", "words", "size", "body"])
                    at = end
            held.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text.translate(_CLEAN))
                    size += len(text) + 1
            if size >= _SHARD:
                yield from give()
                size = 0
        yield from give()

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, run, "shard string, lang string, words long, size long, body binary")


def _automaton(body: bytes, size: int, depth: int) -> tuple[Automaton, pa.Array]:
    words, names, first = tokens(pa.decompress(body, size, codec="zstd", asbytes=True))
    return Automaton(words, first, depth), names


def frequencies(docs: DataFrame, *, words: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of up to ``words`` words (at most 6) that occur ``least`` times or more; (lang, n)."""
    spark = docs.sparkSession
    shards = materialize(_shards(docs, text_col, lang_col), "shards")
    total, number = shards.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    width = shuffle_width(spark)
    buckets, parts = max(width, math.ceil(words * total / _BUCKET)), max(width, number)
    lots = max(width, math.ceil(total / _LOT))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            auto, names = _automaton(row["body"], row["size"], words)
            known: list[np.ndarray] = []
            found = [(_hashes(row["lang"], auto.words, names, d, starts, known), count) for d, starts, count in auto.strings()]
            del auto, names
            h, n = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]).astype(np.uint32)
            del found
            order = np.argsort(h)
            h, n = h[order], n[order]
            of = ((h >> _U(16)) * _U(buckets)) >> _U(_BITS - 16)
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(h)]])
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                gaps = np.diff(h[a:b], prepend=_U(0))
                out.append((int(of[a]), row["shard"], b - a, _pack(gaps), _pack(n[a:b])))
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "shard", "n", "hashes", "counts"])
            give_back()

    def supported(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        lists = [np.cumsum(_unpack(x, n, np.uint64), dtype=np.uint64) for x, n in zip(table.column("hashes").to_pylist(), sizes, strict=True)]
        counts = np.concatenate([_unpack(x, n, np.uint32) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        h = np.concatenate(lists)
        order = np.argsort(h, kind="stable")
        h = h[order]
        begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        good = h[begins[np.add.reduceat(counts[order].astype(np.int64), begins) >= least]]
        kept = [x[np.isin(x, good)] for x in lists]
        some = pa.array([k for k, x in enumerate(kept) if len(x)], pa.int64())
        return pa.table({"shard": table.column("shard").take(some), "hashes": pa.array([x.tobytes() for x in kept if len(x)], pa.binary())})

    def phrases(own: pa.Table, found: pa.Table) -> pa.Table:
        give_back()
        lang = own.column("lang")[0].as_py() if own.num_rows else ""
        texts: list[str] = []
        of, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if own.num_rows and found.num_rows:
            good = np.concatenate([np.frombuffer(x, np.uint64) for x in found.column("hashes").to_pylist()])
            auto, names = _automaton(own.column("body")[0].as_py(), own.column("size")[0].as_py(), words)
            known: list[np.ndarray] = []
            for d, starts, count in auto.strings():
                h = _hashes(lang, auto.words, names, d, starts, known)
                some = np.flatnonzero(np.isin(h, good))
                spans = auto.words[starts[some][:, None] + np.arange(d)]
                used, place = np.unique(spans, return_inverse=True)
                text = [w.decode("utf-8") for w in names.take(pa.array(used)).to_pylist()]
                texts += [" ".join([text[w] for w in span]) for span in place.reshape(spans.shape).tolist()]
                of.append((h[some] % _U(lots)).astype(np.int64))
                counts.append(count[some].astype(np.int64))
        lot, c = np.concatenate(of), np.concatenate(counts)
        order = np.argsort(lot, kind="stable")
        lot, c = lot[order], c[order]
        cuts = np.concatenate([[0], np.flatnonzero(lot[1:] != lot[:-1]) + 1, [len(lot)]]) if len(lot) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            raw = "\n".join([texts[k] for k in order[a:b].tolist()]).encode()
            out.append((lang, int(lot[a]), len(raw), pa.compress(raw, codec="zstd", asbytes=True), c[a:b].tobytes()))
        columns = zip(*out, strict=True) if out else [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["lang", "lot", "size", "phrases", "counts"])

    def added(table: pa.Table) -> pa.Table:
        columns = [table.column(x).to_pylist() for x in ("size", "phrases")]
        texts = [x for n, raw in zip(*columns, strict=True) for x in pa.decompress(raw, n, codec="zstd", asbytes=True).split(b"\n")]
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        coded = pa.array(texts, pa.binary()).dictionary_encode()
        del texts
        f = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(f, coded.indices.to_numpy(), counts)
        enough = np.flatnonzero(f >= least)
        phrase = coded.dictionary.take(pa.array(enough)).cast(pa.string())
        size = pa.array([x.count(" ") + 1 for x in phrase.to_pylist()], pa.int32())
        lang = pa.array([table.column("lang")[0].as_py()] * len(enough), pa.string())
        return pa.table({"lang": lang, "phrase": phrase, "size": size, "f": pa.array(f[enough])})

    dealt = map_texts(shards, send, "bucket long, shard string, n long, hashes binary, counts binary").repartition(buckets, "bucket")
    back = dealt.groupBy("bucket").applyInArrow(supported, "shard string, hashes binary").repartition(parts, "shard")
    own = shards.repartition(parts, "shard")
    counted = own.groupBy("shard").cogroup(back.groupBy("shard")).applyInArrow(phrases, "lang string, lot long, size long, phrases binary, counts binary")
    frequent = counted.repartition(lots, "lang", "lot").groupBy("lang", "lot").applyInArrow(added, "lang string, phrase string, size int, f long")
    return materialize(frequent, "phrases"), shards.groupBy("lang").agg(F.sum("words").alias("n"))


def collocations(
    docs: DataFrame, *, words: int = 4, least: int = 30, top: int = 2000, share: int = 80, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of 2 to ``words`` words by score.

    score: floor(2000000 a / (l + r)) of the cut with the least, the first of several. A phrase is dropped if a longer one
    with it has ``share`` percent of its frequency or more.
    """
    frequent, sizes = frequencies(docs, words=words, least=least, text_col=text_col, lang_col=lang_col)
    candidates = frequent.where("size > 1").withColumnRenamed("f", "a")
    part = lambda begin, n: F.array_join(F.slice(F.split("phrase", " "), begin, n), " ")
    shorter = F.explode(F.array(part(F.lit(2), F.col("size") - 1), part(F.lit(1), F.col("size") - 1)))
    over = candidates.where("size > 2").select("lang", shorter.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_over"))
    kept = candidates.join(over, ["lang", "phrase"], "left").where(F.col("_over").isNull() | (100 * F.col("_over") < share * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    of = lambda name, as_: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(as_))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = F.expr("(2000000 * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    best = best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first of each part of a language, then the first of these: no task sorts a language's phrases
    near = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Best-fit packing of token sequences by minimum bin slack.

Per bin, subset-sum dynamic programming over the available lengths (a bitset in one integer) finds the fullest
combination that holds the longest remaining piece; the combination is then removed as often as the counts of its
lengths allow. The work is on the histogram of lengths (at most ``capacity`` numbers, whatever the number of
documents), so the driver's share is bounded. Pieces then get a rank among those of their length, counted in
salted parts, and the rank gives bin and place.

Edge cases: a null or empty text is a document of one token, the end mark; a document longer than ``capacity`` is
cut into full pieces and a rest; repeated rows and null ids are packed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import give_back, map_texts, materialize, slices, small

#: A length with more pieces than this is ranked in several parts.
PART_ROWS = 2_000
#: Parts of words in a generation of the cache; two generations are kept, so that frequent parts stay.
_CACHED, _LONGEST_CACHED = 120_000, 64
#: What isn't a visible Latin character, a space or a line break.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\xac\xae-\u024f]").search
# Fixed value: the tokenizer's own word pattern, without its runs of letters.
_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\t-\r \p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary spells each byte: itself if it is visible, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, by a cache from parts of words to ids.

    The tokenizer drops white space and its pattern never spans it, so a text's ids are those of its words. Latin texts
    are lower-cased and split into the pattern's parts by vectorised code, some thousands at a time; each distinct part
    is looked up once and goes to the vocabulary's merges if it is new. Other texts go word by word, and words that
    aren't Latin to the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _part(self, part: str, key: str) -> bytes:
        """Ids of a lower-case part of a word, or (with a ``key`` that no part has) of a whole word that isn't Latin."""
        out = self.older.get(key)
        if out is None and key is part:
            out = _packed([t.id for t in self.whole.model.tokenize("".join([self.letters[b] for b in part.encode()]))])
        elif out is None:
            out = _packed(self.whole.encode(part, add_special_tokens=False).ids)
        if len(part) <= _LONGEST_CACHED:
            if len(self.parts) >= _CACHED:
                self.older, self.parts = self.parts, {}
            self.parts[key] = out
        return out

    def _latin(self, low: list[str]) -> list[bytes]:
        """Ids of lower-case texts of Latin characters."""
        spaced = pc.replace_substring_regex(pa.array(low, pa.string()), _MARKS, r" \0 ")
        lists = pc.ascii_split_whitespace(spaced)
        coded = lists.flatten().dictionary_encode()
        known = [self.parts.get(x) or (self._part(x, x) if x else b"") for x in coded.dictionary.to_pylist()]
        every = pa.array(known, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(every.buffers()[1], np.int64)[: len(every) + 1]
        raw, at = memoryview(every.buffers()[2] or b""), ends[lists.offsets.to_numpy()].tolist()
        return [bytes(raw[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def _word(self, word: str) -> bytes:
        if _OTHER(word) or "<|" in word:
            key = " " + word
            return self.parts.get(key) or self._part(word, key)
        return self._latin([word.lower()])[0]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        latin = [k for k, t in enumerate(texts) if t and not _OTHER(t) and "<|" not in t]
        for k, raw in zip(latin, self._latin([texts[k].lower() for k in latin]), strict=True):
            out[k] = raw
        for k in {k for k, t in enumerate(texts) if t}.difference(latin):
            words = re.split("[\x20\t-\r]+", texts[k])
            plain = [w for w in words if w and not _OTHER(w) and "<|" not in w]
            found = dict(zip(plain, self._latin([w.lower() for w in plain]), strict=True))
            out[k] = b"".join([found[w] if w in found else self._word(w) for w in words if w])
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """Tokenize and cut: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, mark = WordIds(tokenizer), end.to_bytes(4, "little")  # of this task: an idle worker holds neither
        for batch in slices(batches, 4096, 4 << 20):
            raw = [x + mark for x in words.ids(batch.column(1).to_pylist())]
            n = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            parts = -(-n // capacity)
            row = np.repeat(np.arange(len(raw)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            sums = [
                zlib.crc32(raw[r] if a == 0 and b == len(raw[r]) else raw[r][a:b])
                for r, a, b in zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True)
            ]
            columns = [pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])
        del words
        give_back()

    ids = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_texts(rows, cut, f"doc_id {ids}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``, as {length: how many}, by bitset subset sums."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, lot = min(counts[length], room // length), 1
        while left:  # lots of 1, 2, 4, ... and a rest stand for any number up to the count
            lot = min(lot, left)
            steps.append((length * lot, length, lot, reach))
            reach |= (reach << (length * lot)) & mask
            left -= lot
            lot *= 2
            if reach & full:
                left = 0
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, {}
    for size, length, lot, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + lot
            total -= size
    return taken


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins for a histogram of lengths, as (how many bins, {length: how many in each})."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        one = fullest(counts, capacity - longest)
        counts[longest] += 1
        one[longest] = one.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in one.items())
        out.append((times, one))
        for x, n in one.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
    return out


def _table(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A table of the driver's rows, sent as Arrow: from a list, executors would start Python workers of another kind for it."""
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(x, t) for x, t in zip(columns, kinds.values(), strict=True)], names=list(kinds)))


def pack(cut: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Give every piece (a row with a ``length`` of 1 to ``capacity``) a ``sequence_id`` and an ``offset`` in it.

    ``cut`` should be stored (a table or a checkpoint), since its rows are read twice.
    """
    spark = cut.sparkSession
    rows = materialize(
        cut.select(F.struct(*[F.col(f"`{c}`") for c in cut.columns]).alias("_piece"), F.col("length").cast("int").alias("_l"), F.monotonically_increasing_id().alias("_row")),
        "pack-rows",
    )
    histogram = {r[0]: r[1] for r in rows.groupBy("_l").count().collect()}  # at most `capacity` rows
    bins, used, places = 0, {}, []
    for times, one in patterns(histogram, capacity):
        offset = 0
        for length in sorted(one, reverse=True):
            first = used.get(length, 0)
            places.append((length, first, first + times * one[length], one[length], bins, offset))
            used[length] = first + times * one[length]
            offset += length * one[length]
        bins += times
    parts = [(x, max(1, -(-n // PART_ROWS))) for x, n in histogram.items()]
    lengths = _table(spark, parts, {"_l": pa.int32(), "_parts": pa.int32()})
    salted = rows.join(F.broadcast(lengths), "_l").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"))
    sums = salted.groupBy("_l", "_part").count()
    starts = sums.select("_l", "_part", (F.sum("count").over(Window.partitionBy("_l").orderBy("_part")) - F.col("count")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_l", "_part").orderBy("_row")) - 1
    ranked = salted.withColumn("_rank", rank).join(small(starts), ["_l", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    kinds = {"_l": pa.int32(), "_from": pa.int64(), "_to": pa.int64(), "_each": pa.int32(), "_bin": pa.int64(), "_at": pa.int32()}
    table = _table(spark, places, kinds)
    own = F.col("_rank") - F.col("_from")
    return (
        ranked.join(small(table), "_l")
        .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
        .select(
            "_piece.*",
            (F.col("_bin") + F.floor(own / F.col("_each"))).cast("long").alias("sequence_id"),
            (F.col("_at") + F.pmod(own, F.col("_each")) * F.col("_l")).cast("long").alias("offset"),
        )
    )

"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of a whole text are transformed (logarithms and square roots, so that their classes are nearer to normal)
and two normal densities are fitted. Each class's covariance is shrunk towards the pooled one and that towards its
diagonal. The Cholesky factors are computed once; a score is the logistic function of the prior and the difference
of the log densities, by Mahalanobis distances.

Fitting needs only sums of the statistics and of their products by class: the labelled rows are never gathered, and
all of them count. Labels enter the fit only; language, source and id are no inputs.

Edge cases: a null text is an empty one, and has a score like others; labels that are null or belong to no document
are left out; a document with several labels counts once for each; with no label of a class the score is the share
of label 1 (0.5 without labels); repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import sys
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from cubeloom.llm.common import held_out, map_texts, materialize, slices

NAMES = (
    "words", "word_length", "word_spread", "longest_word", "distinct_words", "new_pairs", "same_next", "top_word", "upper", "digit",
    "punctuation", "symbol", "mark_ends", "distinct_ends", "bare_marks", "lines", "distinct_lines", "compression", "non_ascii", "words_upper",
)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each character: 0 other letter, 1 upper case, 2 digit, 3 punctuation, 4 symbol, 5 space."""
    if not _CLASSES:
        of = {"Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 5, "Zl": 5, "Zp": 5, "Cc": 5}
        kinds = (unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1))
        _CLASSES.append(np.array([of.get(k, 3 if k[0] == "P" else 4 if k[0] == "S" else 0) for k in kinds], np.uint8))
    return _CLASSES[0]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics ``NAMES`` of a whole text."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.bincount(_classes()[points], minlength=6)
    chars = max(1, len(points) - int(kinds[5]))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    ends = Counter(w[-1] for w in words)
    marks = sum(v for k, v in ends.items() if not k.isalnum())
    same = sum(map(str.__eq__, words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    raw = text.encode()
    return [
        math.log1p(len(words)),
        math.log1p(lengths.mean()),
        math.log1p(lengths.std()),
        math.log1p(lengths.max()),
        len(counts) / n**0.9,
        math.sqrt(len(set(zip(words, words[1:], strict=False))) / n),
        math.sqrt(same / n),
        math.sqrt(max(counts.values(), default=0) / n),
        math.sqrt(kinds[1] / chars),
        math.sqrt(kinds[2] / chars),
        math.sqrt(kinds[3] / chars),
        math.sqrt(kinds[4] / chars),
        math.sqrt(marks / n),
        math.log1p(len(ends)),
        math.sqrt(sum(1 for w in counts if not (w[0].isalnum() or any(map(str.isalnum, w)))) / n),
        math.log1p(len(lines)),
        len(set(lines)) / max(1, len(lines)),
        math.log(len(zlib.compress(raw, 1)) / (len(raw) + 20)),
        math.sqrt((len(raw) - len(text)) / chars),
        math.sqrt(sum(map(str.isupper, words)) / n),
    ]


@dataclass
class Quadratic:
    """Two normal densities; ``factors`` are inverses of the Cholesky factors of the covariances."""

    prior: float
    means: list[np.ndarray] | None = None
    factors: list[np.ndarray] | None = None
    half_log_dets: tuple[float, float] = (0.0, 0.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        z = np.log(self.prior / (1 - self.prior)) + np.zeros(len(x))
        for sign, mean, factor, half in zip((-1, 1), self.means, self.factors, self.half_log_dets, strict=True):
            z -= sign * (0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) + half)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], *, pooled: float = 0.75, diagonal: float = 0.02) -> Quadratic:
    """``sums``: for label 0 and 1 the count, the sum of statistics and the sum of their products.

    ``pooled``: weight of the pooled covariance in a class's; ``diagonal``: weight of its own diagonal.
    """
    n = [sums[c][0] if c in sums else 0 for c in (0, 1)]
    if min(n) < 2:
        return Quadratic((n[1] / sum(n)) if sum(n) else 0.5)
    means = [sums[c][1] / n[c] for c in (0, 1)]
    scatter = [sums[c][2] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    common = (scatter[0] + scatter[1]) / sum(n)
    floor = 1e-4 * np.diag(common).mean() + 1e-9
    factors, halves = [], []
    for c in (0, 1):
        s = (1 - pooled) * scatter[c] / n[c] + pooled * common
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + floor * np.eye(len(s))
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        halves.append(float(np.log(np.diag(lower)).sum()))
    return Quadratic(n[1] / sum(n), means, factors, tuple(halves))


def _measured(texts: pa.Array) -> pa.Array:
    x = np.array([statistics(t) for t in texts.to_pylist()], np.float64).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES)), pa.array(x))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of the statistics)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _measured(batch.column(1))], ["doc_id", "x"])

    kind = docs.select(id_col).dtypes[0][1]
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), run, f"doc_id {kind}, x array<double>")


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def train(rows: DataFrame, labels: DataFrame, *, label_col: str = "quality", mod: int = 4, rest: int = 2, **options) -> Quadratic:
    """Fit from ``rows`` (doc_id, x) and ``labels`` (doc_id, label), without the rows that are held out."""
    known = labels.where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("_label"))
    known = known.where(~held_out(F.col("doc_id"), mod, rest))
    p = len(NAMES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            y, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        k, c = np.meshgrid(np.arange(total.shape[1]), (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(k.ravel()), pa.array(total.ravel())], ["c", "k", "v"])

    parts = rows.join(known, "doc_id").select("_label", "x").mapInArrow(partial, "c long, k long, v double")
    out = np.zeros((2, 1 + p + p * p))
    for r in parts.groupBy("c", "k").agg(F.sum("v").alias("v")).collect():  # 2 x (1 + p + p * p) numbers
        out[r["c"], r["k"]] = r["v"]
    return fit({c: (out[c, 0], out[c, 1 : 1 + p], out[c, 1 + p :].reshape(p, p)) for c in (0, 1)}, **options)


def score(docs: DataFrame, labels: DataFrame, *, mod: int = 4, rest: int = 2, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = materialize(features(docs), "statistics")
    model = train(rows, labels, mod=mod, rest=rest, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch.column(1))))], ["doc_id", "score"])

    out = rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.7, **options) -> DataFrame:
    """The documents with a score of at least ``threshold``, with their columns, whatever their names.

    The statistics of each text are computed once: documents are written with them, the fit reads the statistics alone.
    """

    name = "x"
    while name in docs.columns:
        name += "_"
    at = docs.columns.index(text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, _measured(batch.column(at))], [*batch.schema.names, name])

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(x.tolist(), np.float64).reshape(-1, len(NAMES))))

    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])
    rows = materialize(map_texts(docs, measure, schema), "statistics")
    model = train(rows.select("doc_id", F.col(name).alias("x")), labels, **options)
    return rows.where(of(F.col(name)) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])

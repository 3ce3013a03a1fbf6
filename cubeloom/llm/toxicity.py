"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word is read as its own embedding (words seen often enough in training; others share hashed ones) beside the
greatest values of the embeddings of its character n-grams, of three to six characters with marks at the word's ends. The network reads windows of ``WINDOW`` words; windows overlap by half and
the last one ends with the text, so every word of a text is read. A word of more than ``LONG`` characters (a text without
white space) is cut into parts that overlap, so that each of its n-grams is in one, and each part is a step as a word is. A text's score comes from all its windows: the
highest logit, and the mean and sum of their probabilities, since one chance word in a long text isn't what several are.

Labels belong to whole texts, so training picks windows: of clean texts any, of toxic ones at first those whose words
and n-grams are the likeliest in toxic texts, then those that the network itself scores highest. It uses a bounded
sample of labelled texts (``sample`` of each class, by a hash of the id; numpy trains on the driver, where more texts would not
fit its memory), up to three windows of
each. A logistic fit on a fourth of the
sample that the network hasn't seen, weighted to the classes' shares among all labels, gives the probability. Source, language and id are no inputs.

Edge cases: a null, empty or blank text has one empty window and a score; labels that are null or belong to no document
are left out; a document with several labels counts as toxic if one says so, and of several texts with one id the least is
learnt from; with no label of a class the score is the share of label 1 (0.5 without labels); repeated rows are scored
alike; an empty table gives no rows; further columns are left out of the result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import held_out, map_texts, slices

WINDOW, STEP = 32, 16
LONG, OVERLAP = 64, 5  # an n-gram has at most OVERLAP + 1 characters
HIDDEN, WORD_DIM, CHAR_DIM, ATTEND = 8, 12, 8, 8
CHAR_BUCKETS, SPARE_WORDS, MOST_WORDS = 1 << 15, 256, 4000
_CACHED_WORDS, _WINDOWS_AT_ONCE, _WORDS_AT_ONCE = 200_000, 2048, 10_000


def normal(word: str) -> str:
    """Lower case, without marks at the ends (a word of marks only stays). A part of a long word, after a space, is so already."""
    if word[:1] == " ":
        return word[1:]
    low = word.lower()
    a, b = 0, len(low)
    while a < b and not low[a].isalnum():
        a += 1
    while b > a and not low[b - 1].isalnum():
        b -= 1
    return low[a:b] or low


def words_of(text: str | None) -> list[str]:
    """Words of a text; long ones as parts, each after a space, of the normal word."""
    words = (text or "").split()
    if not words or max(map(len, words)) <= LONG:
        return words
    out: list[str] = []
    for w in words:
        if len(w) <= LONG:
            out.append(w)
        else:
            w = normal(w)
            out += [f" {w[k : k + LONG]}" for k in range(0, max(1, len(w) - OVERLAP), LONG - OVERLAP)]
    return out


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word: (how many each word has, the buckets in the words' order)."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner, at = np.repeat(np.arange(len(marked)), lengths), np.arange(len(points))
    room = np.cumsum(lengths)[owner] - at if len(at) else at  # characters to the word's end
    padded = np.concatenate([points, np.zeros(6, np.uint64)])
    h = np.zeros(len(points), np.uint64)
    owners, found = [np.flatnonzero(lengths < 3)], [np.zeros(int((lengths < 3).sum()), np.int64)]
    for n in range(1, 7):
        h = h * np.uint64(1000003) + padded[n - 1 : n - 1 + len(points)]
        if n >= 3:
            here = room >= n
            mixed = (h[here] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            owners.append(owner[here])
            found.append((mixed >> np.uint64(40)).astype(np.int64) % CHAR_BUCKETS)
    owners, found = np.concatenate(owners), np.concatenate(found)
    return np.bincount(owners, minlength=len(marked)), found[np.argsort(owners, kind="stable")].astype(np.int32)


def starts(n: int) -> list[int]:
    """First words of the windows of a text of ``n`` words."""
    return [*range(0, max(1, n - WINDOW), STEP), *([n - WINDOW] if n > WINDOW else [])]


class Network:
    """Parameters, forward and backward passes. Gates are stacked as update, reset, candidate."""

    def __init__(self, vocabulary: list[str], prior: np.ndarray, char_prior: np.ndarray | float = 0.0, seed: int = 42):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.place = {w: k for k, w in enumerate(vocabulary)}
        words = (0.1 * rng.standard_normal((len(vocabulary) + SPARE_WORDS, WORD_DIM))).astype(np.float32)
        words[: len(vocabulary), 0] = prior  # how much likelier the word is in toxic texts
        chars = (0.1 * rng.standard_normal((CHAR_BUCKETS, CHAR_DIM))).astype(np.float32)
        chars[:, 0] = char_prior
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.p = {
            "words": words, "chars": chars,
            "w": init(d, 6 * h), "b": np.zeros(6 * h, np.float32), "uf": init(h, 3 * h), "ub": init(h, 3 * h),
            "att": init(2 * h, ATTEND), "v": init(ATTEND), "out": init(2 * h), "bias": np.zeros(1, np.float32),
        }
        self.pooling = np.array([1.0, 0.0, 0.0, 0.0])
        self._reader: Reader | None = None

    def reader(self) -> Reader:
        if self._reader is None:
            self._reader = Reader(self)
        return self._reader

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_reader": None}

    def word_row(self, word: str) -> int:
        known = self.place.get(word)
        return len(self.place) + zlib.crc32(word.encode()) % SPARE_WORDS if known is None else known

    def inputs(self, words: list[str]) -> np.ndarray:
        """Embeddings of words, which are normalised already."""
        sizes, flat = ngrams(words)
        chars = np.maximum.reduceat(self.p["chars"][flat], np.cumsum(sizes) - sizes, axis=0)
        return np.concatenate([self.p["words"][[self.word_row(w) for w in words]], chars], axis=1)

    def _gru(self, x: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
        """States after each step; x: (steps, windows, 3 * hidden) input parts of the gates."""
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)):
            r = h @ u
            gates = 0.5 + 0.5 * np.tanh(0.5 * (x[t, :, : 2 * HIDDEN] + r[:, : 2 * HIDDEN]))
            z, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((h, z, reset, c, r[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def forward(self, parts: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits; parts: (steps, windows, 6 * hidden), the projected inputs of both directions; mask: (steps, windows)."""
        p, f, b = self.p, None if keep is None else [], None if keep is None else []
        ahead = self._gru(parts[..., : 3 * HIDDEN], p["uf"], mask, f)
        back = self._gru(parts[::-1, :, 3 * HIDDEN :], p["ub"], None if mask is None else mask[::-1], b)[::-1]
        h = np.concatenate([ahead, back], axis=2)
        hidden = np.tanh(h @ p["att"])
        s = hidden @ p["v"]
        if mask is not None:
            s = np.where(mask, s, -30.0)
        e = np.exp(s - s.max(axis=0))
        a = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, h)
        if keep is not None:
            keep |= {"f": f, "b": b, "h": h, "hidden": hidden, "a": a, "pooled": pooled}
        return pooled @ p["out"] + p["bias"][0]

    def _gru_back(self, d_out: np.ndarray, kept: list, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d_x, d_u, d_h = np.zeros((*d_out.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            h, z, reset, c, rc = kept[t]
            d_h = d_h + d_out[t]
            own = d_h * mask[t][:, None]
            d_c = own * (1 - z) * (1 - c * c)
            d_z = own * (h - c) * z * (1 - z)
            d_r = d_c * rc * reset * (1 - reset)
            d_x[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            d_rec = np.concatenate([d_z, d_r, d_c * reset], axis=1)
            d_u += h.T @ d_rec
            d_h = d_h - own + own * z + d_rec @ u.T
        return d_x, d_u

    def gradients(self, rows: np.ndarray, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean cross entropy; and that of ``x``. rows: (steps, windows) places in x."""
        p, keep = self.p, {}
        parts = (x @ p["w"] + p["b"])[rows]
        logit = self.forward(parts, mask, keep)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        g = {"bias": d.sum(keepdims=True), "out": keep["pooled"].T @ d}
        d_pool = d[:, None] * p["out"]
        h, a, hidden = keep["h"], keep["a"], keep["hidden"]
        d_h = a[..., None] * d_pool
        d_a = np.einsum("tnh,nh->tn", h, d_pool)
        d_s = a * (d_a - (a * d_a).sum(axis=0))
        g["v"] = np.einsum("tnk,tn->k", hidden, d_s)
        d_hidden = d_s[..., None] * p["v"] * (1 - hidden * hidden)
        g["att"] = np.einsum("tnh,tnk->hk", h, d_hidden)
        d_h = (d_h + d_hidden @ p["att"].T).astype(np.float32)
        d_f, g["uf"] = self._gru_back(d_h[..., :HIDDEN], keep["f"], p["uf"], mask)
        d_b, g["ub"] = self._gru_back(d_h[::-1, :, HIDDEN:], keep["b"], p["ub"], mask[::-1])
        d_parts = np.concatenate([d_f, d_b[::-1]], axis=2) * mask[..., None]
        by_word = np.zeros((len(x), 6 * HIDDEN), np.float32)
        np.add.at(by_word, rows.ravel(), d_parts.reshape(-1, 6 * HIDDEN))
        g["w"], g["b"] = x.T @ by_word, by_word.sum(axis=0)
        return g, by_word @ p["w"].T


class Reader(dict):
    """Word to row of projected inputs, for one network; row 0 is the empty place."""

    def __init__(self, net: Network):
        self.net, self.fresh = net, []
        self.parts = np.zeros((1, 6 * HIDDEN), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self.parts) + len(self.fresh)
        self.fresh.append(normal(word))
        return row

    def logits(self, texts: list[str | None]) -> list[np.ndarray]:
        """Logits of all windows of each text."""
        if len(self) > _CACHED_WORDS:
            self.clear()
            self.parts = self.parts[:1]
        at = np.arange(WINDOW)
        rows, counts = [], []
        for text in texts:
            ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words)) if (words := words_of(text)) else np.zeros(1, np.int64)
            if len(ids) < WINDOW:
                ids = np.concatenate([ids, np.zeros(WINDOW - len(ids), np.int64)])
            own = ids[np.array(starts(len(ids)))[:, None] + at]
            rows.append(own)
            counts.append(len(own))
        if self.fresh:
            lots = [self.fresh[k : k + _WORDS_AT_ONCE] for k in range(0, len(self.fresh), _WORDS_AT_ONCE)]
            new = [(self.net.inputs(lot) @ self.net.p["w"] + self.net.p["b"]).astype(np.float32) for lot in lots]
            self.parts, self.fresh = np.concatenate([self.parts, *new]), []
        every = np.concatenate(rows)
        out = np.empty(len(every), np.float32)
        for k in range(0, len(every), _WINDOWS_AT_ONCE):
            part = every[k : k + _WINDOWS_AT_ONCE].T
            mask = part > 0
            out[k : k + part.shape[1]] = self.net.forward(self.parts[part], None if mask.all() else mask)
        return np.split(out, np.cumsum(counts)[:-1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled(self.logits(texts)) @ self.net.pooling, -500, 500)))


def pooled(logits: list[np.ndarray]) -> np.ndarray:
    """Of each text: the highest logit, the log odds of the windows' mean probability, the log of their sum, and 1."""
    top = np.array([x.max() for x in logits], np.float64)
    p = [1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30))) for x in logits]
    mean, total = np.array([x.mean() for x in p]), np.array([x.sum() for x in p])
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.stack([np.clip(top, -10, 10), np.log(mean / (1 - mean)), np.log(total + 0.1), np.ones(len(top))], axis=1)


def _flat(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and n-grams of words in a row; word 0 is the empty place with one n-gram."""
    sizes, parts = [np.ones(1, np.int64)], [np.zeros(1, np.int32)]
    for k in range(0, len(names), _WORDS_AT_ONCE):
        own, flat = ngrams(names[k : k + _WORDS_AT_ONCE])
        sizes.append(own)
        parts.append(flat)
    return np.concatenate(sizes), np.concatenate(parts)


def _all_logits(net: Network, texts: list[str | None]) -> list[np.ndarray]:
    reader = Reader(net)
    return [x for k in range(0, len(texts), 256) for x in reader.logits(texts[k : k + 256])]


def train(texts: list[str | None], y: np.ndarray, shares: tuple[float, float], *, rounds: int = 2, steps: int = 600, rate: float = 0.01, seed: int = 42) -> Network:
    """``y``: labels; ``shares``: how many labelled texts of each class one text of the sample stands for."""
    rng = np.random.default_rng(seed)
    aside = np.arange(len(texts)) % 4 == 3
    unseen = [t for t, a in zip(texts, aside, strict=True) if a] if len(texts) >= 40 else texts
    y_unseen = y[aside] if len(texts) >= 40 else y
    if len(texts) >= 40:
        texts, y = [t for t, a in zip(texts, aside, strict=True) if not a], y[~aside]
    one: dict[str, str] = {}  # each word is one object, however often it occurs
    split = [[one.setdefault(x, x) for x in map(normal, words_of(t))] or [""] for t in texts]
    del one
    of = [Counter(), Counter()]
    for words, label in zip(split, y, strict=True):
        of[label].update(set(words))
    n = [max(1, int((y == c).sum())) for c in (0, 1)]
    often = [w for w, _ in (of[0] + of[1]).most_common(4 * MOST_WORDS) if of[0][w] + of[1][w] >= 10]
    odds = {w: np.log((of[1][w] + 0.5) / (n[1] + 1)) - np.log((of[0][w] + 0.5) / (n[0] + 1)) for w in often}
    names = sorted({w for words in split for w in words})
    sizes_of, flat_grams = _flat(names)
    ends_of = np.cumsum(sizes_of)
    grams = lambda w: flat_grams[ends_of[w] - sizes_of[w] : ends_of[w]]
    where = {w: k + 1 for k, w in enumerate(names)}
    ids = [np.array([where[w] for w in words], np.int32) for words in split]
    del split, where
    by_char = np.zeros((2, CHAR_BUCKETS))
    for own, label in zip(ids, y, strict=True):
        by_char[label, np.unique(np.concatenate([grams(w) for w in np.unique(own)]))] += 1
    trust = np.minimum(1, by_char.sum(axis=0) / 20)
    char_odds = trust * np.clip(np.log((by_char[1] + 0.5) / (n[1] + 1)) - np.log((by_char[0] + 0.5) / (n[0] + 1)), -2, 2)
    strength = {w: odds[w] * np.sqrt(of[0][w] + of[1][w]) for w in often}
    vocabulary = sorted(often, key=lambda w: -abs(strength[w]))[:MOST_WORDS]
    prior = np.array([np.clip(odds[w], -2, 2) * min(1, (of[0][w] + of[1][w]) / 20) for w in vocabulary], np.float32)
    net = Network(vocabulary, prior, char_odds, seed)
    known = dict(zip(vocabulary, prior, strict=True))
    worth = np.array([0.0, *(known.get(w, 0.0) + char_odds[grams(k)].max() for k, w in enumerate(names, 1))])
    word_rows = np.array([0, *(net.word_row(w) for w in names)])
    frames = [x[np.minimum(np.array(starts(len(x)))[:, None] + np.arange(WINDOW), len(x) - 1)] * (np.array(starts(len(x)))[:, None] + np.arange(WINDOW) < len(x)) for x in ids]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def update(g: dict) -> None:
        nonlocal step
        step += 1
        for k, d in g.items():
            m, s = moments[k]
            m += 0.1 * (d - m)
            s += 0.001 * (d * d - s)
            net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)

    for turn in range(rounds):
        if turn == 0:
            value = [worth[f].max(axis=1) for f in frames]
        else:
            value = _all_logits(net, texts)
        chosen, labels = [], []
        for f, v, label in zip(frames, value, y, strict=True):
            picks = np.argsort(-v)[:3] if label else rng.permutation(len(f))[:3]
            chosen += [f[k] for k in picks]
            labels += [label] * len(picks)
        windows, target = np.array(chosen), np.array(labels, np.float32)
        for _ in range(min(10, max(2, steps // rounds * 128 // len(windows)))):
            order = rng.permutation(len(windows))
            for k in range(0, len(order), 128):
                own = windows[order[k : k + 128]]
                used, rows = np.unique(own, return_inverse=True)
                rows = rows.reshape(own.shape).T
                sizes = sizes_of[used]
                flat = np.concatenate([grams(w) for w in used])
                owner = np.repeat(np.arange(len(used)), sizes)
                values = net.p["chars"][flat]
                chars = np.maximum.reduceat(values, np.cumsum(sizes) - sizes, axis=0)
                x = np.concatenate([net.p["words"][word_rows[used]], chars], axis=1).astype(np.float32)
                g, d_x = net.gradients(rows, x, own.T > 0, target[order[k : k + 128]])
                g["words"], g["chars"] = 1e-4 * net.p["words"], 1e-4 * net.p["chars"]
                np.add.at(g["words"], word_rows[used], d_x[:, :WORD_DIM])
                np.add.at(g["chars"], flat, d_x[:, WORD_DIM:][owner] * (values == chars[owner]))
                update(g)
    net.pooling = _logistic(pooled(_all_logits(net, unseen)), y_unseen, np.where(y_unseen == 1, shares[1], shares[0]))
    return net


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a little shrinkage, by Newton's method."""
    beta, shrink = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    weight = weight / weight.mean()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ ((weight * p * (1 - p))[:, None] * x) + shrink, x.T @ (weight * (p - y)) + shrink @ beta)
        size = np.abs(step).max()
        beta = beta - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", mod: int = 3, rest: int = 1, sample: int = 1500, **options) -> Network | float:
    """The network, or the share of label 1 where a class has no label."""
    known = labels.where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("_y"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, rest)).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    found = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if len(found) < 2:
        return float(next(iter(found), 0.5))
    chosen = [known.where(F.col("_y") == c).orderBy(F.xxhash64(F.lit(42), "doc_id")).limit(sample) for c in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    taken = docs.select("doc_id", F.col("text").alias("_text")).join(ids, "doc_id")
    table = taken.groupBy("doc_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y")).toArrow().sort_by("doc_id")
    y = table.column("_y").to_numpy().astype(np.int64)
    n = np.bincount(y, minlength=2)
    if not n.all():
        return found[1] / (found[0] + found[1])
    return train(table.column("_text").to_pylist(), y, (found[0] / n[0], found[1] / n[1]), **options)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mod: int = 3, rest: int = 1, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    net = fit(base, labels, mod=mod, rest=rest, **options)

    shared = docs.sparkSession.sparkContext.broadcast(net)  # one object in each Python worker, and so one cache of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        reader = None if isinstance(net, float) else net.reader()
        for batch in slices(batches, 256):
            out = np.full(batch.num_rows, net) if reader is None else reader.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    out = map_texts(base, run, f"doc_id {base.dtypes[0][1]}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

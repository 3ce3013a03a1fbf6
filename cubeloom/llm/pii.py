"""Personal data in whole texts: spans by pattern, and further ones by a semi-Markov conditional random field.

The field scores whole candidate spans (a kind and a run of at most ``_LONGEST`` tokens) by features of the span as one: how many
digits and groups it has, which separators, whether its check digit fits, what stands before and after it. A semi-Markov
dynamic program over a region of tokens chooses boundaries and kinds of all its spans jointly. Candidates need a digit or an
at sign, so tokens that none covers are outside all entities, and the program falls apart there: each run of covered tokens
is decoded by itself, exactly, however long the text is.

It is trained in numpy, by the exact gradient of the likelihood: on the driver, on at most ``regions`` regions of at most
``_TRAINED`` tokens from about ``sample`` documents (both bounds are parameters), with the spans found by pattern as labels, and on
spans written in other ways than the patterns take (``drawn``), together with near misses that are none. Everything else reads
all texts.

Spans by pattern stay as they are; of the field's, those are added that overlap none of them. Offsets count code points.

Edge cases: a null text is empty and has no spans; so has an empty one; repeated rows get the same spans; an empty table gives
no rows and trains on what is drawn alone; very long words cost time in proportion to their length; further columns are not
looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import map_texts, slices

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_LONGEST, _TRAINED = 32, 64
#: First tokens of candidates that are looked at together.
_BLOCK = 8192
Span = tuple[str, int, int]

# ---- spans by pattern. Atomic forms of the patterns: each reads a text in time proportional to its length.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def by_pattern(text: str) -> list[Span]:
    """Leftmost spans of each kind that don't overlap their own kind, in order of start, then kind."""
    out: list[tuple[int, int, int]] = []
    if not _ANY.search(text):
        return []
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        free = at + 1
        if host:
            out.append((begin, 0, host.end()))
            free = host.end()
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


# ---- tokens and candidates
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|(?s:.)")
_DIGIT, _LETTER, _SPACE, _DOT, _HYPHEN, _AT, _PLUS, _OPEN, _CLOSE, _WORDY, _SLASH, _OTHER, _NONE = range(13)
_TYPES = {" ": _SPACE, ".": _DOT, "-": _HYPHEN, "@": _AT, "+": _PLUS, "(": _OPEN, ")": _CLOSE, "_": _WORDY, "%": _WORDY, "/": _SLASH}
_GLUE = np.array([ord(c) for c in " .-+()/"], np.uint32)


def regions(text: str) -> list[tuple[int, int]]:
    """Where entities can be: runs of words with a digit or an at sign and of the signs and spaces around them."""
    if not _ANY.search(text):
        return []
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    hot = ((c >= 48) & (c <= 57)) | (c == 64)
    blank = (c == 32) | ((c >= 9) & (c <= 13))
    word = np.cumsum(blank)
    in_hot = np.zeros(int(word[-1]) + 1, bool)
    in_hot[word[hot]] = True
    kept = (in_hot[word] & ~blank) | np.isin(c, _GLUE)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]])))
    upto = np.concatenate([[0], np.cumsum(hot)])
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if upto[b] > upto[a]]


class Tokens:
    """Tokens of many regions, end to end; a token of no kind stands between them."""

    def __init__(self, texts: list[str]):
        self.kind, self.text, self.begin, self.region = [_NONE], [""], [0], [-1]
        for r, text in enumerate(texts):
            for m in _TOKEN.finditer(text):
                t = m[0]
                self.text.append(t)
                self.kind.append(_DIGIT if "0" <= t[0] <= "9" else _TYPES.get(t, _LETTER if t.isalpha() else _OTHER))
                self.begin.append(m.start())
                self.region.append(r)
            self.text.append("")
            self.kind.append(_NONE)
            self.begin.append(len(text))
            self.region.append(-1)
        self.kind, self.begin, self.region = (np.array(x) for x in (self.kind, self.begin, self.region))
        self.size = np.fromiter(map(len, self.text), np.int64, len(self.text))
        # how many tokens of each kind, and how many digits, stand before a token
        self.total = {k: np.concatenate([[0], np.cumsum(self.kind == k, dtype=np.int32)]) for k in range(_NONE + 1)}
        self.digits = np.concatenate([[0], np.cumsum(np.where(self.kind == _DIGIT, self.size, 0))])


#: Features of a candidate: how many values each has.
_WIDTHS = {
    "bias": 1, "digits": 21, "groups": 10, "letters": 8, "dots": 8, "hyphens": 5, "spaces": 8, "parentheses": 9, "plus": 3, "first": 10, "last": 10,
    "opens": 13, "check": 2, "octets": 2, "before": 13, "after": 13, "host_dots": 5, "even": 2, "mixed": 4, "adjoins": 4,
}
_FEATURES = sum(_WIDTHS.values())
_PLACES = np.concatenate([[0], np.cumsum(list(_WIDTHS.values()))[:-1]])


class Candidates:
    """All spans of the tokens that can be an entity: first and past-last token, kind and features (places of weights).

    ``begin`` and ``end`` bound their first tokens, so that a long text is looked at in parts.
    """

    def __init__(self, tokens: Tokens, begin: int = 0, end: int | None = None):
        kind, size, total, chars = tokens.kind, tokens.size, tokens.total, tokens.digits
        n = len(kind)
        starts = begin + np.flatnonzero(np.isin(kind[begin:end], (_DIGIT, _LETTER, _PLUS, _OPEN)))
        ends = np.isin(kind, (_DIGIT, _LETTER))
        a, b = [], []
        for length in range(1, _LONGEST + 1):
            i = starts[starts + length <= n]
            i = i[ends[i + length - 1] & (total[_NONE][i + length] == total[_NONE][i])]
            a.append(i)
            b.append(i + length)
        a, b = np.concatenate(a), np.concatenate(b)
        c = {k: total[k][b] - total[k][a] for k in total}
        digits = chars[b] - chars[a]
        first, last = kind[a], kind[b - 1]
        numeric = (c[_LETTER] + c[_AT] + c[_WORDY] + c[_OTHER] == 0) & (last == _DIGIT)
        bare = numeric & (c[_PLUS] + c[_OPEN] + c[_CLOSE] + c[_SLASH] == 0)
        whole = np.isin(first, (_DIGIT, _LETTER))
        can = (
            whole & (c[_AT] == 1) & (c[_SPACE] + c[_OPEN] + c[_CLOSE] + c[_SLASH] + c[_OTHER] == 0),
            bare & (c[_DIGIT] >= 3) & (c[_DIGIT] <= 5) & (c[_DOT] >= 3) & (c[_HYPHEN] == 0),
            bare & (digits >= 12) & (digits <= 19),
            numeric & (digits >= 7) & (digits <= 15) & (c[_PLUS] <= 1) & (c[_OPEN] <= 1) & (c[_CLOSE] <= 1),
        )
        rows = [np.flatnonzero(x) for x in can]
        self.kind = np.repeat(np.arange(len(KINDS)), [len(x) for x in rows])
        at = np.concatenate(rows)
        self.a, self.b = a[at], b[at]
        c, digits = {k: x[at] for k, x in c.items()}, digits[at]
        check, octets, even, dots = (np.zeros(len(at), np.int64) for _ in range(4))
        for k in range(len(at)):
            span = range(self.a[k], self.b[k])
            if self.kind[k] == 0:
                sign = next(t for t in span if kind[t] == _AT)
                dots[k] = total[_DOT][self.b[k]] - total[_DOT][sign]
                continue
            groups = [tokens.text[t] for t in span if kind[t] == _DIGIT]
            even[k] = len({len(g) for g in groups}) == 1
            if self.kind[k] == 1:
                octets[k] = len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups)
            elif self.kind[k] == 2:
                check[k] = digits[k] >= 13 and luhn("".join(groups))
        separators = (c[_DOT] > 0).astype(int) + (c[_HYPHEN] > 0) + (c[_SPACE] > 0) + (c[_SLASH] > 0)
        end = self.b - 1
        signs = (_DIGIT, _LETTER, _AT)
        values = [
            np.zeros(len(at), int), digits, c[_DIGIT], c[_LETTER], c[_DOT], c[_HYPHEN], c[_SPACE], 3 * np.minimum(c[_OPEN], 2) + np.minimum(c[_CLOSE], 2), c[_PLUS],
            np.where(kind[self.a] == _DIGIT, size[self.a], 0), np.where(kind[end] == _DIGIT, size[end], 0), kind[self.a], check, octets,
            kind[self.a - 1], kind[np.minimum(self.b, n - 1)], dots, even, separators,
            2 * np.isin(kind[self.a - 1], signs) + np.isin(kind[np.minimum(self.b, n - 1)], signs),
        ]
        clipped = [np.minimum(v, w - 1) for v, w in zip(values, _WIDTHS.values(), strict=True)]
        self.features = (np.stack(clipped, axis=1) + _PLACES + (self.kind * _FEATURES)[:, None]).astype(np.int32)

    @classmethod
    def parts(cls, tokens: Tokens) -> Iterator[Candidates]:
        for begin in range(0, len(tokens.kind), _BLOCK):
            yield cls(tokens, begin, begin + _BLOCK)

    @classmethod
    def joined(cls, parts: list[Candidates]) -> Candidates:
        out = object.__new__(cls)
        out.a, out.b, out.kind, out.features = (np.concatenate([getattr(c, name) for c in parts]) for name in ("a", "b", "kind", "features"))
        return out.only(np.lexsort((out.b, out.kind, out.a)))  # the same order however the parts are

    def only(self, rows: np.ndarray) -> Candidates:
        out = object.__new__(Candidates)
        out.a, out.b, out.kind, out.features = self.a[rows], self.b[rows], self.kind[rows], self.features[rows]
        return out


# ---- the field
class Lattice:
    """The semi-Markov program over runs of tokens that candidates cover. Boundaries of all runs have numbers, run by run."""

    def __init__(self, c: Candidates, tokens: int):
        cover = np.zeros(tokens + 1, np.int64)
        np.add.at(cover, c.a, 1)
        np.add.at(cover, c.b, -1)
        inside = np.cumsum(cover) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        begins, self.length = edge[::2], edge[1::2] - edge[::2]
        order = np.argsort(-self.length, kind="stable")
        begins, self.length = begins[order], self.length[order]
        self.zero = np.cumsum(self.length + 1) - (self.length + 1)
        self.boundaries = int((self.length + 1).sum())
        at = np.zeros(tokens + 1, np.int64)
        for run, (begin, size) in enumerate(zip(begins.tolist(), self.length.tolist(), strict=True)):
            at[begin : begin + size] = run
        run = at[c.a]
        self.start, self.end = self.zero[run] + c.a - begins[run], self.zero[run] + c.b - begins[run]
        self.run, t0, t1 = run, c.a - begins[run], c.b - begins[run]
        self.steps = int(self.length.max(initial=0))
        self.by_end, self.by_start = np.argsort(t1, kind="stable"), np.argsort(t0, kind="stable")
        steps = np.arange(self.steps + 2)
        self.end_cut, self.start_cut = np.searchsorted(t1[self.by_end], steps), np.searchsorted(t0[self.by_start], steps)
        self.active = [int((self.length >= t).sum()) for t in range(self.steps + 2)]

    def likelihood(self, score: np.ndarray, adjoining: float) -> tuple[float, np.ndarray, float]:
        """(sum of the log partition functions, probability of each candidate, expected number of adjoining entities)."""
        alpha = np.full((self.boundaries, 2), -np.inf)  # last token outside, or last of an entity
        beta = np.full((self.boundaries, 2), -np.inf)
        alpha[self.zero, 0] = 0
        with np.errstate(invalid="ignore"):
            for t in range(1, self.steps + 1):
                here = self.zero[: self.active[t]] + t
                alpha[here, 0] = np.logaddexp(alpha[here - 1, 0], alpha[here - 1, 1])
                c = self.by_end[self.end_cut[t] : self.end_cut[t + 1]]
                s = self.start[c]
                np.logaddexp.at(alpha[:, 1], self.end[c], np.logaddexp(alpha[s, 0], alpha[s, 1] + adjoining) + score[c])
            beta[self.zero + self.length] = 0
            for t in range(self.steps - 1, -1, -1):
                runs = self.active[t + 1]
                here = self.zero[:runs] + t
                ahead = np.full(self.boundaries, -np.inf)
                c = self.by_start[self.start_cut[t] : self.start_cut[t + 1]]
                np.logaddexp.at(ahead, self.start[c], score[c] + beta[self.end[c], 1])
                beta[here, 0] = np.logaddexp(beta[here + 1, 0], ahead[here])
                beta[here, 1] = np.logaddexp(beta[here + 1, 0], ahead[here] + adjoining)
            z = np.logaddexp(*alpha[self.zero + self.length].T)
            tail = score + beta[self.end, 1] - z[self.run]
            after = np.exp(alpha[self.start, 1] + adjoining + tail)
            return float(z.sum()), np.exp(alpha[self.start, 0] + tail) + after, float(after.sum())

    def best(self, score: np.ndarray, adjoining: float) -> np.ndarray:
        """The candidates of each run's most probable segmentation."""
        value = np.full((self.boundaries, 2), -np.inf)
        back = np.full(self.boundaries, -1)  # the entity that ends at a boundary
        value[self.zero, 0] = 0
        for t in range(1, self.steps + 1):
            here = self.zero[: self.active[t]] + t
            value[here, 0] = value[here - 1].max(axis=1)
            c = self.by_end[self.end_cut[t] : self.end_cut[t + 1]]
            s = self.start[c]
            total = np.maximum(value[s, 0], value[s, 1] + adjoining) + score[c]
            order = np.lexsort((total, self.end[c]))
            c, total = c[order], total[order]
            last = np.concatenate([self.end[c][1:] != self.end[c][:-1], [True]])[: len(c)]
            value[self.end[c[last]], 1], back[self.end[c[last]]] = total[last], c[last]
        chosen = []
        for zero, n in zip(self.zero.tolist(), self.length.tolist(), strict=True):
            at, entity = zero + n, bool(value[zero + n, 1] > value[zero + n, 0])
            while at > zero:
                if entity:
                    chosen.append(int(back[at]))
                    at = int(self.start[back[at]])
                    entity = bool(value[at, 1] + adjoining > value[at, 0])
                else:
                    at -= 1
                    entity = bool(value[at, 1] > value[at, 0])
        return np.array(sorted(chosen), int)


class Field:
    """Weights of the features by kind, and of two entities without a token between them (0 or less)."""

    def __init__(self, weights: np.ndarray, adjoining: float):
        self.weights, self.adjoining = weights, adjoining

    def scores(self, c: Candidates) -> np.ndarray:
        return self.weights[c.features].sum(axis=1)

    @classmethod
    def trained(cls, examples: list[tuple[str, list[Span]]], *, rounds: int = 150, rate: float = 0.15, penalty: float = 1e-3) -> Field:
        """From texts of regions with their spans, by Adam on the penalised likelihood. Spans that are no candidates are left out."""
        tokens = Tokens([text for text, _ in examples])
        c = Candidates.joined(list(Candidates.parts(tokens)))
        lattice = Lattice(c, len(tokens.kind))
        wanted = {(r, KINDS.index(k), a, b) for r, (_, spans) in enumerate(examples) for k, a, b in spans}
        keys = zip(tokens.region[c.a].tolist(), c.kind.tolist(), tokens.begin[c.a].tolist(), (tokens.begin[c.b - 1] + tokens.size[c.b - 1]).tolist(), strict=True)
        gold = np.array([k in wanted for k in keys], bool)
        joined = len(np.intersect1d(lattice.end[gold], lattice.start[gold]))
        n = max(1, len(lattice.length))
        w, m, v = (np.zeros(len(KINDS) * _FEATURES + 1) for _ in range(3))
        flat, width = c.features.ravel(), c.features.shape[1]
        for step in range(1, rounds + 1):
            _, p, after = lattice.likelihood(w[:-1][c.features].sum(axis=1), w[-1])
            g = np.bincount(flat, np.repeat(p - gold, width), len(w)) / n + penalty * w
            g[-1] += (after - joined) / n
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            w[-1] = min(w[-1], 0.0)  # so that no entity pays that doesn't by itself
        return cls(w[:-1], float(w[-1]))

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """The spans of each region."""
        out: list[list[Span]] = [[] for _ in texts]
        tokens = Tokens(texts)
        # a span with a score of 0 or less is in no best segmentation: its tokens are worth 0 outside, and nothing gains by adjoining it
        c = Candidates.joined([part.only(self.scores(part) > 0) for part in Candidates.parts(tokens)])
        if len(c.a):
            c = c.only(Lattice(c, len(tokens.kind)).best(self.scores(c), self.adjoining))
            for k, a, b in zip(c.kind.tolist(), c.a.tolist(), c.b.tolist(), strict=True):
                out[tokens.region[a]].append((KINDS[k], int(tokens.begin[a]), int(tokens.begin[b - 1] + tokens.size[b - 1])))
        return out


def drawn(n: int, seed: int = 42) -> list[tuple[str, list[Span]]]:
    """``n`` regions for each kind with a span in some spelling, and as many near misses without one."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k, more="": "".join(pick("abcdefghijklmnopqrstuvwxyz" + more) for _ in range(k))

    def card(good: bool) -> str:
        while True:
            d = str(rng.integers(1, 10)) + digits(int(pick((14, 15, 15, 15, 18))))
            if luhn(d) == good:
                break
        sign = pick(("", "", " ", "-", ".", "  "))
        return sign.join(d[k : k + 4] for k in range(0, len(d), 4))

    def ip(good: bool) -> str:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        if not good:
            parts = pick((parts[:3], [*parts[:3], str(rng.integers(256, 999))], [*parts, str(rng.integers(0, 99)), "7"]))
        return pick((".", ".", " . ")).join(parts)

    def phone(good: bool) -> str:
        if not good:  # a date, a short or a plain number
            return pick((f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", digits(5) + "-" + digits(2), digits(8), f"{digits(3)}.{digits(4)}", digits(11)))
        area, mid, end = digits(3), digits(3), digits(4)
        sign = pick(("-", ".", " ", "/"))
        return pick((f"({area}) {mid}-{end}", sign.join((area, mid, end)), f"+{rng.integers(1, 99)} {area} {mid} {end}", f"+1 ({area}) {mid}-{end}", f"+{rng.integers(1, 99)}/{area}/{mid}{end}", f"1-{area}-{mid}-{end}"))

    def email(good: bool) -> str:
        name = letters(int(rng.integers(2, 9)), "éüñß") + pick(("", ".", "_", "-")) + pick((letters(4, "öç"), digits(2), ""))
        name = name.rstrip("._-")
        if not good:
            return pick((f"@{letters(6)}", f"{letters(3)}@{digits(1)}", f"{digits(2)}@{digits(2)}", f"{letters(2)}@{letters(2)}@{letters(3)}"))
        return f"{name}@{letters(6)}{pick(('', digits(1)))}.{pick(('', letters(3, 'éü') + '.'))}{pick(('com', 'org', 'net', 'de', 'example'))}"

    out = []
    for kind, make in zip(KINDS, (email, ip, card, phone), strict=True):
        for k in range(2 * n):
            span = make(k < n)
            before, after = pick(("", " ", "(", ": ", "<", "\"")), pick(("", " ", ".", ",", ")", ". ", " - "))
            before = pick(("", letters(4))) + before if kind != "email" or before else before
            if before and before[-1].isalnum():
                before += " "
            text = before + span + after
            out.append((text, [(kind, len(before), len(before) + len(span))] if k < n else by_pattern(text)))
    return out


def _aligned(text: str, spans: list[Span], region: tuple[int, int]) -> list[Span] | None:
    """The spans within a region, by offsets of its own; None if one is only partly in it."""
    a, b = region
    inside = [(k, s - a, e - a) for k, s, e in spans if s < b and e > a]
    return inside if all(s >= 0 and e <= b - a for _, s, e in inside) else None


def train(docs: DataFrame, *, text_col: str = "text", sample: int = 20_000, regions_: int = 4_000, synthetic: int = 150, seed: int = 42) -> Field:
    """The field, from a sample of the documents' regions and from drawn ones."""
    text = F.col(text_col).cast("string")
    rows = docs.select(text.alias("_text"), F.pmod(F.xxhash64(F.lit(seed), text), F.lit(1 << 20)).alias("_h")).where(F.col("_text").rlike("[0-9@]"))
    n = docs.count()
    rows = rows.where(F.col("_h") * max(n, 1) < sample * (1 << 20)).select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple[str, list]] = []
            for t in batch.column(0).to_pylist():
                spans = by_pattern(t)
                for a, b in regions(t):
                    if b - a <= 4 * _TRAINED:
                        inside = _aligned(t, spans, (a, b))
                        if inside is not None:
                            out.append((t[a:b], [{"kind": k, "start": s, "end": e, "base": True} for k, s, e in inside]))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([s for _, s in out], kind)], ["region", "spans"])

    found = map_texts(rows, run, f"region string, spans {SPAN}").distinct()
    order = [F.xxhash64(F.lit(seed), "region"), F.col("region")]
    examples = drawn(synthetic, seed)
    for some in (F.size("spans") > 0, F.size("spans") == 0):
        for r in found.where(some).orderBy(*order).limit(regions_ // 2).collect():
            if len(_TOKEN.findall(r["region"])) <= _TRAINED:
                examples.append((r["region"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]))
    return Field.trained(examples)


def all_spans(texts: list[str | None], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, by pattern) of each text, by start, then kind."""
    base = [by_pattern(t or "") for t in texts]
    places = [(k, a, b) for k, t in enumerate(texts) if t for a, b in regions(t)]
    out = [[(*s, True) for s in spans] for spans in base]
    for (k, a, b), spans in zip(places, field.spans([texts[k][a:b] for k, a, b in places]), strict=True):
        for kind, s, e in spans:
            if not any(x < a + e and y > a + s for _, x, y in base[k]):
                out[k].append((kind, a + s, a + e, False))
    return [sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for spans in out]


def find(docs: DataFrame, field: Field | None = None, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """_id and _spans (kind, start, end, base: found by pattern) of every document. Without a field, one is trained."""
    field = field or train(docs, text_col=text_col, **options)
    kind = docs.select(F.col(id_col)).dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            found = all_spans(batch.column(1).to_pylist(), field)
            rows = [[{"kind": k, "start": s, "end": e, "base": base} for k, s, e, base in spans] for spans in found]
            shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, shape)], ["_id", "_spans"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_texts(rows, run, f"_id {kind}, _spans {SPAN}")

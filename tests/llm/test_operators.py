"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from cubeloom.llm import common, embeddings, line_dedup, lm_scoring, mixing, packing, quality, simhash, spotsigs, token_counts, toxicity

TOKENIZERS = str(Path(public_tokenizers.path("word_bpe_49k.json")).parent)
DOCS = "doc_id long, text string, source string, lang string, n_chars long, _k string, length int"


def documents(spark, texts, sources=None, ids=None):
    rows = [
        ((ids[k] if ids else k), t, (sources[k] if sources else f"s{k % 3}"), "en", None if t is None else len(t), "clash", k)
        for k, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3) if rows else spark.createDataFrame([], DOCS)


WORDS = "alpha beta gamma delta the of and idiot réeux ñandú Zeta. 12 x".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    out = [text(rng, int(n)) for n in rng.integers(1, 60, 40)]
    out += [None, "", "  \n\t ", "word", out[0], out[0], out[1] + " tail", "long " * 9000]
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_mixing(spark, texts):
    sources = [None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 4}" for k in range(len(texts))]
    docs = documents(spark, texts, sources)
    planned, _ = mixing.mix(docs)
    got = rows(planned)
    assert len(got) == len(texts)
    sizes = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:  # water-filling, round by round
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    taken = defaultdict(int)
    for r in got:
        assert r["_target"] == pytest.approx(target[r["_source"]]) and r["_source_words"] == sizes[r["_source"]] and 0 <= r["_times"] <= 2
        taken[r["_source"]] += r["_times"] * r["_words"]
    largest = defaultdict(int)
    for r in got:
        largest[r["_source"]] = max(largest[r["_source"]], r["_words"])
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
    copies = Counter(r["doc_id"] for r in mixing.sample_mix(docs).collect())
    assert copies == Counter({r["_id"]: r["_times"] for r in got if r["_times"]})
    assert mixing.sample_mix(docs).columns == docs.columns
    assert mixing.sample_mix(documents(spark, [])).count() == 0


def filled(sizes, weight, budget, epochs):
    """Targets by water-filling, round by round."""
    target, free, left = {}, set(sizes), budget
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > epochs * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("ratio", [0.01, 0.7, 1.5, 3.0])
def test_mixing_of_many_sources(spark, ratio):
    rng = np.random.default_rng(17)
    sizes = {f"s{k}-{'é' * (k % 3)}": int(2 ** rng.uniform(0, 20)) if k % 7 else 0 for k in range(1500)} | {None: 10**6}
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "_source string, _words long").repartition(3), budget_ratio=ratio).collect()
    want = filled(sizes, weight, ratio * sum(sizes.values()), 2.0)
    assert len(got) == len(sizes) and {r["_source"]: r["_weight"] for r in got} == weight
    assert all(r["_target"] == pytest.approx(want[r["_source"]]) for r in got)


def test_mixing_takes_repeated_rows_alike_however_they_are_dealt(spark):
    table = [(None if k % 2 else 7, "one two three", "hot", k) for k in range(300)] + [(k, "a b " * k, f"s{k % 2}", k) for k in range(20)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string, _metadata int")
    runs = [Counter((r["doc_id"], r["text"]) for r in mixing.sample_mix(docs.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    planned = mixing.mix(docs.repartition(5))[0].groupBy("_id", "_words").sum("_times").collect()
    assert sum(runs[0].values()) == sum(r[2] for r in planned)
    assert any(0 < runs[0][k] % 150 for k in ((7, "one two three"), (None, "one two three")))


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    odd = ["İſK ßs'S 'll <|endoftext|>x\x1cy\xa0z", "漢字🙂 éé²½"]
    got = rows(packing.pack(packing.pieces(documents(spark, [*texts, *odd]), path)))
    tk = Tokenizer.from_file(path)
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate([*texts, *odd]):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == [(a, min(2048, len(ids) - a)) for a in range(0, len(ids), 2048)]
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert packing.pack(packing.pieces(documents(spark, []), path)).count() == 0


def test_fullest_is_best():
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = {int(x): int(c) for x, c in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(0, 60))
        sums = {0}
        for x, c in counts.items():
            sums = {s + k * x for s in sums for k in range(c + 1) if s + k * x <= room}
        one = packing.fullest(counts, room)
        assert sum(x * n for x, n in one.items()) == max(sums) and all(n <= counts[x] for x, n in one.items())


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, texts, rule):
    from tokenizers import Tokenizer

    from cubeloom.llm.queries import TOKEN_PATTERN

    own = [*texts, "a\n\n\nb c\n", "é\n🙂🙂\nñ"]
    tk = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    got = defaultdict(list)
    for r in rows(token_counts.count(documents(spark, own), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", TOKEN_PATTERN, rule=rule)):
        got[r["doc_id"]].append(r)
    for k, t in enumerate(own):
        parts = sorted(got[k], key=lambda r: r["section"])
        assert "".join((t or "")[r["start"] : r["start"] + r["length"]] for r in parts) == (t or "")
        ids = tk.encode(t or "", add_special_tokens=False)
        assert sum(r["tokens"] for r in parts) == pytest.approx(len(ids.ids))
        if rule == "start":
            wanted = Counter(max(i for i, r in enumerate(parts) if r["start"] <= a) for a, _ in ids.offsets)
            assert [r["tokens"] for r in parts] == [wanted[i] for i in range(len(parts))]


def test_quality(spark):
    rng = np.random.default_rng(5)
    good = [text(rng, 80) for _ in range(60)]
    bad = [" ".join(f"{rng.choice(WORDS)}{rng.choice(['!!', '$$', '##'])}".upper() for _ in range(60)) for _ in range(60)]
    docs = documents(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(k, 1 if k < 60 else 0, 0) for k in range(120)] + [(121, None, None), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(quality.score(docs, labels))}
    assert len(got) == 122 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [k for k in range(120) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k]["held_out"] for k in held) and np.mean([got[k]["predicted"] == (k < 60) for k in held]) > 0.95
    kept = {r["doc_id"] for r in rows(quality.keep_good(docs, labels))}
    assert kept == {k for k, r in got.items() if r["predicted"]}
    assert {r["score"] for r in rows(quality.score(docs, labels.limit(0)))} == {0.5}


def lm_tokens(t):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())]


class NaiveCTW:
    """Binary context-tree weighting by its definition: a dictionary of nodes, recursion, logarithms of base e."""

    def __init__(self, lines, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for line in lines:
            padded = b"\xff" * depth + line
            for k in range(depth, len(padded)):
                for d in range(depth + 1):
                    context = padded[k - d : k]
                    for j in range(8):
                        self.counts[context, j, padded[k] >> (8 - j)][padded[k] >> (7 - j) & 1] += 1
                        if d < depth:
                            self.children[context, j, padded[k] >> (8 - j)].add(padded[k - d - 1])
        self.logs = {}

    def kt(self, zeros, ones):
        return sum(math.log((x + 0.5)) for x in range(zeros)) + sum(math.log(x + 0.5) for x in range(ones)) - math.lgamma(zeros + ones + 1)

    def longer(self, context, j, bits):
        return sum(self.log(bytes([x]) + context, j, bits) for x in self.children[context, j, bits])

    def log(self, context, j, bits):
        """Log of the weighted probability of what a node has seen."""
        if (key := (context, j, bits)) not in self.logs:
            own = self.kt(*self.counts[key])
            self.logs[key] = own if len(context) == self.depth else math.log(0.5) + np.logaddexp(own, self.longer(*key))
        return self.logs[key]

    def one(self, past, j, bits):
        """P(next bit is one): along the path, each node's own estimate and the longer contexts' by their weights."""
        d, path = 0, []
        while d <= self.depth and (past[len(past) - d :], j, bits) in self.counts:
            path.append((past[len(past) - d :], j, bits))
            d += 1
        p = 0.5  # a context that wasn't seen
        for context, *rest in reversed(path):
            zeros, ones = self.counts[context, *rest]
            own = (ones + 0.5) / (zeros + ones + 1)
            weight = 1 if len(context) == self.depth else 1 / (1 + math.exp(min(700, self.longer(context, *rest) - self.kt(zeros, ones))))
            p = weight * own + (1 - weight) * p
        return p

    def score(self, line):
        padded, total = b"\xff" * self.depth + line, 0.0
        for k in range(self.depth, len(padded)):
            for j in range(8):
                p = self.one(padded[k - self.depth : k], j, padded[k] >> (8 - j))
                total += math.log10(p if padded[k] >> (7 - j) & 1 else 1 - p)
        return total


def test_lm_scoring(spark, texts):
    docs = documents(spark, texts)
    c = Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            c.update([*lm_tokens(t), b""])
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in rows(lm_scoring.score(docs))}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        own = [*lm_tokens(t), b""]
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (len(own), sum(w in c for w in own), n)
        assert got[k]["n_bytes"] == len(b" ".join(lm_tokens(t))) + 1
        assert got[k]["score"] < 0 and got[k]["bits_per_byte"] == pytest.approx(-got[k]["score"] * math.log2(10) / got[k]["n_bytes"])
    assert lm_scoring.score(documents(spark, [])).count() == 0


@pytest.mark.parametrize("depth", [2, 3, 6])
def test_lm_scoring_is_context_tree_weighting(spark, texts, depth, monkeypatch):
    """Scores of all texts, held out or not, as the definition gives them; slices and merges of a few hundred bytes."""
    monkeypatch.setattr(lm_scoring, "_SLICE", 400)
    monkeypatch.setattr(lm_scoring, "_GRAMS_AT_ONCE", 300)
    own = [t for t in texts if len(t or "") < 120] + ["漢字 é\xff \x00", "a" * 300]
    lines = [b" ".join(lm_tokens(t)) + b"\xff" for t in own]
    naive = NaiveCTW([x for k, x in enumerate(lines) if zlib.crc32(str(k).encode()) % 7 != 2], depth)
    past = b"\xff" * (depth - 2) + b"al"
    every = sum(10 ** (naive.score(past + bytes([x])) - naive.score(past)) for x in range(256))
    assert every == pytest.approx(1)
    got = {r["doc_id"]: r["score"] for r in rows(lm_scoring.score(documents(spark, own), depth=depth))}
    assert got == pytest.approx({k: naive.score(x) for k, x in enumerate(lines)}, rel=1e-5)


def test_lm_scoring_without_training_text(spark):
    got = rows(lm_scoring.score(documents(spark, ["ab", None], ids=[2, 2]), mod=1, rest=0))
    assert sorted(r["score"] for r in got) == pytest.approx([-24 * math.log10(2), -8 * math.log10(2)])
    assert {(r["train_tokens"], r["n_known"]) for r in got} == {(0, 0)}


def test_lm_scoring_of_new_words_isnt_far_below_the_base(spark, tmp_path):
    """Held-out texts of words that little training text has: the tree spells them, the base holds each to be one outcome."""
    from cubeloom.llm.queries import op5_lm_scoring

    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    own = {k: " ".join(f"{x:x}" * 4 for x in range(k * 10**6, k * 10**6 + 40)) if k in ids else "a few known words " * 3 for k in range(60)}
    docs = documents(spark, list(own.values()), ids=list(own))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tree = {r["doc_id"]: r for r in rows(lm_scoring.score(docs))}
    got = {r["doc_id"]: r for r in rows(op5_lm_scoring(spark, str(tmp_path)))}
    assert set(got) == set(own) and {k for k in got if got[k]["held_out"]} >= set(ids)
    for k, r in got.items():
        logs = [tree[k]["score"], tree[k]["base_score"]]
        assert r["score"] == pytest.approx(max(logs) + math.log10(sum(10 ** (x - max(logs)) for x in logs) / 2)) and r["base_score"] == logs[1]
        assert r["bits_per_byte"] == tree[k]["bits_per_byte"]
    assert all(tree[k]["score"] < tree[k]["base_score"] - 100 and got[k]["score"] > got[k]["base_score"] - 0.302 for k in ids)


def test_lm_scoring_is_finite_after_very_frequent_contexts():
    """A byte after a context that 2 ** 26 times had another one: a float of 32 bits says 1 for the other's probability."""
    key, n = np.array([0x6160, 0x6161], np.uint64), np.array([0, 2**26], np.int64)
    levels, _, _ = lm_scoring._levels([(np.array([0x61], np.uint64), n[1:])], 0, 0, None)
    log = lm_scoring._log10(key, n, (levels, (np.zeros(8, np.float32), np.ones(8, np.float32))), 1)
    assert np.isfinite(log).all() and log[0] < -6 and log[1] == pytest.approx(0, abs=1e-5)


def test_lm_scoring_bounds_what_is_held(spark, texts):
    """Texts go to Python in batches of bounded bytes; distinct grams are found without a second copy of all."""
    conf, limit = spark._jsparkSession.sessionState().conf(), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.arrowMaxBytesPerBatch()
    try:
        spark.conf.set(limit, 64 << 20)
        lm_scoring.score(documents(spark, texts[:3]))
        assert conf.arrowMaxBytesPerBatch() <= common.BATCH_BYTES
    finally:
        spark.conf.set(limit, before)
    keys = np.random.default_rng(1).integers(0, 1000, 1_000_000).astype(np.uint64)
    expected = sorted(set(keys.tolist()))
    tracemalloc.start()
    got = lm_scoring._distinct(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == expected and peak < keys.nbytes / 2


def test_toxicity(spark):
    rng = np.random.default_rng(9)
    clean = [w for w in WORDS if w != "idiot"]
    own = [" ".join(rng.choice(clean) for _ in range(70)) for _ in range(160)]
    own = [t if k % 2 else re.sub(r"^(\S+ ){20}\S+", lambda m: m[0] + " idiot idiot", t) for k, t in enumerate(own)]
    labels = spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in range(160)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows(toxicity.score(documents(spark, [*own, None, ""]), labels))}
    held = [k for k in range(160) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(got) == 162 and all(0 <= r["score"] <= 1 for r in got.values()) and all(got[k]["held_out"] for k in held)
    assert np.mean([got[k]["predicted"] == (k % 2 == 0) for k in held]) > 0.95
    assert {r["score"] for r in rows(toxicity.score(documents(spark, ["a"]), labels.limit(0)))} == {0.5}


def test_line_dedup(spark):
    own = ["a\nb\nc\nd", "x\na\n\n b \nc\ny", "a\nb\nc\nd", "q\nq\nq\nq\nq", None, "", "a\nb", "a\nb\nc\nd"]
    docs = documents(spark, own, ids=[0, 1, 2, 3, 4, 5, 6, 0])
    got = {r["_doc"]["doc_id"]: (r["_text"], r["_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {0: (own[0], 0), 1: ("x\ny", 4), 2: ("", 4), 3: ("q", 4), 4: (None, 0), 5: ("", 0), 6: ("a\nb", 0)}
    kept = line_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6]


def naive_components(fps, near):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def naive_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, texts, monkeypatch):
    rng = np.random.default_rng(2)
    base = text(rng, 400).split()
    near = [" ".join(base[:k] + ["edit"] + base[k + 1 :]) for k in range(0, 300, 6)]
    own = [*texts, *near]
    fps = [naive_fingerprint(t) for t in own]
    roots = naive_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r["doc_id"]: r for r in rows(simhash.component_ids(documents(spark, own)))}
    assert [got[k]["fingerprint"] for k in range(len(own))] == [f"{x:016x}" for x in fps]
    assert [got[k]["component_id"] for k in range(len(own))] == roots
    kept = simhash.keep_one(documents(spark, [*own, own[3]], ids=[*range(len(own)), 3]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))


def test_hot_bucket_is_split_without_loss(spark):
    from cubeloom.llm import buckets

    df = spark.createDataFrame([(k % 2, k) for k in range(200)], "_g long, v long")
    out = buckets.dealt(df, spread="v", most=20)

    def pairs(batches):
        import pyarrow as pa

        for n, table in buckets.groups(batches):
            v = table.column("v").to_numpy()
            for i, j in buckets.neighbours(n, table):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(v[i], v[j])), pa.array(np.maximum(v[i], v[j]))], ["a", "b"])

    got = Counter((r["a"], r["b"]) for r in out.mapInArrow(pairs, "a long, b long").collect())
    assert got == Counter((a, b) for a in range(200) for b in range(a + 1, 200) if (a - b) % 2 == 0)
    assert out.groupBy("_g", "_part").count().agg({"count": "max"}).first()[0] <= 40


def test_spotsigs(spark, texts):
    got = {r["doc_id"]: r for r in rows(spotsigs.fingerprints(documents(spark, texts)))}
    assert len(got) == len(texts)
    sets = {k: {r["fingerprint"][i : i + 8] for i in range(0, len(r["fingerprint"]), 8)} for k, r in got.items()}
    for k, t in enumerate(texts):
        t, after = t or "", texts[k - 1] or ""
        third = len(t) // 3
        import hashlib

        assert got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest() and got[k]["n_chars"] == len(t)
        a, b = sets[k], sets[(k - 1) % len(texts)]
        assert got[k]["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[0]["fingerprint"] == got[44]["fingerprint"] and got[40]["fingerprint"] == ""
    # by the definition: the three words after each anchor, over other anchors
    anchors, chain = set(spotsigs.ANCHORS), set()
    t = "Alpha the beta of gamma, delta and and zeta eta theta iota"
    words = re.findall(r"\w+", t.lower())
    for k, w in enumerate(words):
        if w in anchors and words[k + 1 : k + 2] and words[k + 1] not in anchors:
            chain.add(" ".join([x for x in words[k + 1 :] if x not in anchors][:3]))
    frame = spotsigs.with_signatures(spark.createDataFrame([(t,)], "t string"), "t", "s")
    assert len(frame.first()["s"]) == len(chain)


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    vectors = [*base, *(base[k % 5] + rng.normal(size=16) * rng.uniform(0, 0.4) for k in range(150)), *([base[1]] * 20)]
    labels = [int(k % 2) for k in range(60)] + [int(k % 5 % 2) for k in range(150)] + [1] * 20
    table = [(k, [float(x) for x in v], y) for k, (v, y) in enumerate(zip(vectors, labels, strict=True))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] * 16, 1), (903, [float("nan")] * 16, 1), (904, table[0][1], None), (905, [1.0], 1)]
    got = {r["vec_id"]: r for r in rows(embeddings.near_duplicates(spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, label int")))}
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    y = np.array(labels)
    linked = (x @ x.T >= 0.93) & (y[:, None] == y)
    np.fill_diagonal(linked, False)
    found = sum(got[k]["n_links"] for k in range(len(vectors)))
    assert 0.9 * linked.sum() <= found <= linked.sum() and all(got[k]["n_links"] <= linked[k].sum() for k in range(len(vectors)))
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items()) and all(got[k]["n_links"] == 0 for k, *_ in odd)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_near_dedup_stage_by_similarity(spark):
    """The pipeline's stage links what is 0.8 alike in five-word shingles, and nothing else."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 300)] for _ in range(12)]
    own = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 3, 5, 6, 7, 9, 14):  # spread edits of a word each touch five shingles
            changed = list(b)
            for k in range(edits):
                changed[10 + k * 280 // edits] = f"edit{rng.integers(1 << 30)}"
            own.append(" ".join(changed))
    own += [None, "", " ", "two words", "Two  words", own[0]]

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    sets = [shingles(t) for t in own]
    alike = [(a, b) for k, a in enumerate(sets) for b in sets[:k] if near(a, b)]
    assert any(len(a & b) < 0.85 * len(a | b) for a, b in alike)
    roots = naive_components(sets, near)
    kept = corpus_pipeline.near_dedup(spark, documents(spark, own), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))


def test_spotsigs_scheme_is_one_for_all_texts(spark):
    """A text with few common words stays like its edited text, which has many; signatures against brute force."""
    rng = np.random.default_rng(6)
    rare = [f"q{x}" for x in rng.integers(0, 10**6, 240)]
    rare[100] = "the"
    dense = [w if k % 2 else "of" for k, w in enumerate(rare[::-1])]
    own = [" ".join(dense), " ".join(rare)]
    got = {r["doc_id"]: r for r in rows(spotsigs.fingerprints(documents(spark, own)))}
    assert got[1]["near_edited"] > 0.4
    anchors, gap = set(spotsigs.ANCHORS), spotsigs.GAP
    own += [" ".join(rng.choice(["the", "of", *rare[:40]], int(n))) for n in rng.integers(1, 90, 30)] + ["alpha the", "the", "alpha", ""]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(own)], "k int, t string")
    found = {r["k"]: len(r["s"]) for r in spotsigs.with_signatures(frame, "t", "s").collect()}
    for k, t in enumerate(own):
        words, chains = t.split(), set()
        for i, w in enumerate(words):
            near = words[max(0, i - gap) : i + gap + 1]
            if w in anchors and words[i + 1 : i + 2] and words[i + 1] not in anchors:
                chains.add(tuple([x for x in words[i + 1 :] if x not in anchors][:3]))
            elif not anchors & set(near):
                chains.add(tuple([x for x in words[i:] if x not in anchors][:3]))
        assert found[k] == len(chains or set(words))


def test_toxicity_reads_texts_without_white_space():
    net = toxicity.Network([], np.zeros(0, np.float32))
    start = "字符" * 60
    a, b = (toxicity.Reader(net).logits([start + end])[0] for end in ("abcdef", "uvwxyz"))
    assert not np.allclose(a, b)
    word = "".join(chr(0x4E00 + k) for k in range(1000)) + "***" + "z" * 9
    parts = [toxicity.normal(x) for x in toxicity.words_of(word)]
    grams = lambda x: {x[k : k + n] for n in range(3, 7) for k in range(len(x) - n + 1)}
    assert set().union(*map(grams, parts)) == grams(word) and max(map(len, parts)) == toxicity.LONG
    assert toxicity.words_of("A word, of few ") == ["A", "word,", "of", "few"]


def test_embeddings_of_extreme_components(spark):
    """Squares of components over- and underflow; the cosines don't."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    near = base + rng.normal(size=(12, 8)) * 0.02
    scales = [1e-200, 1e200, 1e-308, 1e307, 1.0, 5e-320]
    table = []
    for k in range(12):
        for j, v in enumerate((base[k], near[k], -base[k])):
            table.append((3 * k + j, [float(x) for x in v * scales[(k + j) % 6]], k % 2))
    mixed = [(100, [1e200, 1e-200, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 7), (101, [1e-300, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 7), (102, [0.0, 1e200, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 7), (103, [5e-324, 5e-324] + [0.0] * 6, 7)]
    docs = spark.createDataFrame(table + mixed, "vec_id long, embedding array<double>, label int").withColumn("_class", F.lit("x")).withColumn("_v", F.lit(1)).withColumn("_g", F.lit(2))
    got = {r["vec_id"]: r for r in rows(embeddings.near_duplicates(docs))}
    assert len(got) == 40 and (got[100]["component_id"], got[101]["component_id"], got[102]["component_id"], got[103]["n_links"]) == (100, 100, 102, 0)
    exact = [v for k in range(12) for v in (base[k], near[k], -base[k])]
    for i, (a, _, la) in enumerate(table):
        want = sum(
            j != i and la == lb and np.dot(exact[i], exact[j]) >= 0.94 * np.linalg.norm(exact[i]) * np.linalg.norm(exact[j]) for j, (_, _, lb) in enumerate(table) if scales[(j // 3 + j % 3) % 6] > 5e-320
        )
        if scales[(i // 3 + i % 3) % 6] > 5e-320:
            assert got[a]["n_links"] >= want, a


def test_embeddings_of_many_lengths(spark):
    """Vectors meet those of their length only; lengths share passes."""
    table = [(10 * n + k, [1.0] * (n - 1) + [0.9 + k / 50], 1) for n in range(1, 18) for k in range(3)]
    got = {r["vec_id"]: r for r in rows(embeddings.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")))}
    assert all(got[10 * n + k]["n_links"] == 2 and got[10 * n + k]["component_id"] == 10 * n for n in range(1, 18) for k in range(3))


def test_embeddings_of_several_lengths(spark):
    table = [(0, [1.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.1], 1), (3, [2.0, 1.0], 1), (4, [2.0, 1.1], 1), (5, [2.0, 1.0], 0), (6, None, 1)]
    for own in (table, table[::-1]):
        frame = spark.createDataFrame(own, "vec_id long, embedding array<double>, label int").coalesce(1)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rows(embeddings.near_duplicates(frame))}
        assert got == {0: (0, 0, True), 1: (1, 1, True), 2: (1, 1, False), 3: (1, 3, True), 4: (1, 3, False), 5: (0, 5, True), 6: (0, 6, True)}


def test_spotsigs_similar_pairs(spark):
    rng = np.random.default_rng(8)
    base = [set(rng.integers(0, 10**6, int(n)).tolist()) for n in rng.integers(1, 60, 12)]
    sets = [*base, set(), set()]
    for b in base:
        sets += [set(rng.permutation(sorted(b))[: max(1, int(len(b) * f))].tolist()) | set(rng.integers(0, 10**6, int(k)).tolist()) for f, k in ((1, 3), (0.9, 2), (0.8, 0), (0.5, 1))]
    frame = spark.createDataFrame([(k, sorted(x)) for k, x in enumerate(sets)], "k long, s array<long>").repartition(3)
    for least in (0.5, 0.8, 1.0):
        got = {(r["a"], r["b"]): r["likeness"] for r in spotsigs.similar_pairs(frame, "k", "s", at_least=least).collect()}
        like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(sets)) for a in range(b) if sets[a] and sets[b]}
        assert got == pytest.approx({k: x for k, x in like.items() if x >= least})


def test_quality_is_the_quadratic_discriminant():
    """Scores from sums and Cholesky factors against the two normal densities, written out."""
    rng = np.random.default_rng(1)
    p = len(quality.NAMES)
    x = rng.normal(size=(300, p)) @ rng.normal(size=(p, p))
    y = np.arange(300) % 3 == 0
    x[y] = 1.3 * x[y] + rng.normal(size=p)
    sums = {c: (float((y == c).sum()), x[y == c].sum(axis=0), x[y == c].T @ x[y == c]) for c in (0, 1)}
    got = quality.fit(sums, pooled=0.3, diagonal=0.1).scores(x)
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    common = sum(s * (y == c).mean() for c, s in enumerate(own))
    z = np.full(300, math.log(y.mean() / (1 - y.mean())))
    for c, sign in ((0, -1), (1, 1)):
        s = 0.7 * own[c] + 0.3 * common
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + (1e-4 * np.diag(common).mean() + 1e-9) * np.eye(p)
        d = x - x[y == c].mean(axis=0)
        z += sign * -0.5 * ((d * np.linalg.solve(s, d.T).T).sum(axis=1) + np.linalg.slogdet(s)[1])
    assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -500, 500))), abs=1e-7)


def small_network():
    rng = np.random.default_rng(4)
    net = toxicity.Network([], np.zeros(0, np.float32))
    for k in ("b", "bias", "uf", "ub"):
        net.p[k] = rng.normal(scale=0.5, size=net.p[k].shape).astype(np.float32)
    x = rng.normal(size=(9, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    rows = rng.integers(0, 9, (7, 5))
    mask = np.arange(7)[:, None] < np.array([7, 7, 4, 1, 6])
    return net, x, rows, mask


def naive_logit(p, x):
    """One window of the network, step by step."""
    h, sigmoid = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for order, at, u in ((1, 0, p["uf"]), (-1, 3 * h, p["ub"])):
        state, states = np.zeros(h), []
        for word in x[::order]:
            own = (word @ p["w"] + p["b"])[at : at + 3 * h]
            z, r = sigmoid(own[:h] + state @ u[:, :h]), sigmoid(own[h : 2 * h] + state @ u[:, h : 2 * h])
            state = z * state + (1 - z) * np.tanh(own[2 * h :] + r * (state @ u[:, 2 * h :]))
            states.append(state)
        sides.append(np.array(states[::order]))
    both = np.concatenate(sides, axis=1)
    s = np.exp(np.tanh(both @ p["att"]) @ p["v"])
    return (s / s.sum()) @ both @ p["out"] + p["bias"][0]


def test_toxicity_network_by_definition():
    net, x, rows, mask = small_network()
    got = net.forward((x @ net.p["w"] + net.p["b"])[rows], mask)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    assert got == pytest.approx([naive_logit(p, x[rows[mask[:, k], k]].astype(np.float64)) for k in range(5)], abs=1e-4)


def test_toxicity_gradients_by_differences():
    net, x, rows, mask = small_network()
    y = np.array([0, 1, 1, 0, 1], np.float32)
    p = {k: v.astype(np.float64) for k, v in net.p.items() if k not in ("words", "chars")}

    def loss(x):
        z = np.array([naive_logit(p, x[rows[mask[:, k], k]]) for k in range(5)])
        return np.mean(np.logaddexp(0, z) - y * z)

    g, d_x = net.gradients(rows, x, mask, y)
    wide, rng = x.astype(np.float64), np.random.default_rng(5)
    for values, gradient in [*((p[k], g[k]) for k in p), (wide, d_x)]:
        for at in rng.integers(0, values.size, 6):
            was = values.flat[at]
            values.flat[at] = was + 1e-5
            up = loss(wide)
            values.flat[at] = was - 1e-5
            down = loss(wide)
            values.flat[at] = was
            assert np.ravel(gradient)[at] == pytest.approx((up - down) / 2e-5, rel=1e-2, abs=1e-4)


def test_toxicity_of_repeated_ids_and_labels(spark):
    """Several labels of a document, and several texts with one id, give the same scores in any order."""
    rng = np.random.default_rng(2)
    own = [text(rng, 20) + (" idiot idiot" if k % 2 else "") for k in range(60)]
    docs = documents(spark, [*own, "another", "a third"], ids=[*range(60), 3, 3])
    labels = [(k, k % 2) for k in range(60)] + [(1, 0), (2, 1), (2, None)]
    scored = []
    for part in (labels, labels[::-1]):
        frame = spark.createDataFrame(part, "doc_id long, toxic int")
        scored.append(sorted((r["doc_id"], round(r["score"], 6)) for r in rows(toxicity.score(docs, frame))))
    assert scored[0] == scored[1]


def test_line_dedup_orders_ties_as_its_sql(spark):
    import duckdb

    from cubeloom.llm import queries

    table = [(1, f"{x}\n\na\n b\nc\n{x}") for x in "sqpr"] + [(None, "a\nb\nc"), (None, "b\na\nb\nc"), (0, "a\nb"), (2, "c\nb\na"), (2, "x\nc\nb\na"), (2, "c\nb\na")]
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_lines(docs).select("_doc.doc_id", "_removed", "_text").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", table)
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, con.execute(queries.ORACLE_SQL["op7_line_dedup"]).fetchall()))


CLASHES = ["_id", "_text", "_doc", "_key", "_gone_id", "_gone_key", "_text_key", "_fp", "_root", "_spans", "_k", "_words", "_times", "x", "score", "words", "text_"]


def test_extra_columns_with_the_names_that_operators_use(spark, texts):
    from pyspark.sql import functions as F

    plain = documents(spark, texts[:12]).select("doc_id", "text", "source")
    odd = plain.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
    for run in (
        lambda d: quality.keep_good(d, labels, threshold=0.0), line_dedup.without_repeats, simhash.keep_one,
        lambda d: simhash.keep_one(d, similarity=0.8, shingle=5), mixing.sample_mix,
    ):
        got = run(odd)
        assert got.columns == odd.columns
        assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in run(plain).collect())
    for run in (
        lambda d: packing.pack(packing.pieces(d, f"{TOKENIZERS}/word_bpe_49k.json")).drop("sequence_id", "offset"), lambda d: quality.score(d, labels),
        simhash.component_ids, spotsigs.fingerprints, lambda d: lm_scoring.score(d).select("doc_id", "n_tokens"),
    ):
        assert sorted(map(tuple, run(odd).collect())) == sorted(map(tuple, run(plain).collect()))


def test_empty_tables(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        quality.score(docs, labels), quality.keep_good(docs, labels), toxicity.score(docs, labels), line_dedup.without_repeats(docs), simhash.component_ids(docs),
        simhash.keep_one(docs), simhash.keep_one(docs, similarity=0.8, shingle=5), spotsigs.fingerprints(docs),
        token_counts.count(docs, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", r"\s+|\S+"),
    ):
        assert out.count() == 0


def test_spotsigs_of_string_ids_and_values(spark, texts):
    from pyspark.sql import functions as F

    docs = documents(spark, texts[:20])
    named = rows(spotsigs.fingerprints(docs.withColumn("doc_id", F.format_string("%03d", "doc_id"))))
    plain = rows(spotsigs.fingerprints(docs))
    assert sorted((int(r["doc_id"]), *list(r.values())[1:]) for r in named) == sorted(tuple(r.values()) for r in plain)
    t = "the quick of brown fox and jumps"
    chains = [" quick brown fox", " brown fox jumps", " jumps"]
    frame = spotsigs.with_signatures(spark.createDataFrame([(t,)], "t string"), "t", "s")
    assert frame.first()["s"] == sorted(xxhash.xxh64_intdigest(x.encode(), 42) >> 32 for x in chains)
    for r in plain:
        a, b = ({r[c][i : i + 8] for i in range(0, len(r[c]), 8)} for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_embeddings_recall_at_the_threshold(spark):
    """Planted pairs with a cosine of 0.93 to 0.95 among vectors that are far apart."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turned = rng.normal(size=(800, 64))
    turned -= (turned * base[:800]).sum(axis=1, keepdims=True) * base[:800]
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.95, (800, 1))
    every = np.concatenate([base, cosine * base[:800] + np.sqrt(1 - cosine**2) * turned])
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    linked = every @ every.T >= 0.93
    found = sum(r["n_links"] for r in embeddings.near_duplicates(frame).collect())
    assert 0.97 * (linked.sum() - len(every)) <= found <= linked.sum() - len(every)


@pytest.mark.parametrize("share", [2, 10_000])
def test_values_of_hot_keys(spark, share, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    keys = [7] * 400 + list(range(300)) + [None] * 3 + [-5] * 50
    table = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key long, row long").repartition(3)
    values = table.where("key is not null and key % 3 <> 0").groupBy("key").agg(F.min("row").alias("least"), F.count("*").alias("_n"))
    got = sorted(tuple(r) for r in common.with_key_values(table, values, "key").select("key", "row", "least").collect())
    first = {}
    for n, k in enumerate(keys):
        first.setdefault(k, n)
    assert got == sorted((k, n, first[k]) for n, k in enumerate(keys) if k is not None and k % 3)
    assert common.with_key_values(table.limit(0), values.limit(0), "key").count() == 0


def test_near_dedup_candidates_are_simhash(spark, monkeypatch):
    """The stage's links come from SimHash fingerprints and their blocks; at the threshold hardly a link is lost."""
    rng = np.random.default_rng(15)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
    sets = []
    for k in range(300):  # pairs of sets with a similarity of 0.8 or little more
        both = draw(8 * int(rng.integers(5, 40)))
        sets += [np.unique(np.concatenate([both, draw(len(both) // 8)])) for _ in range(2)]
    one = sets[0]
    mixed = [int(x) for x in one]
    for k in range(simhash.WIDE):
        if k:
            mixed = [(int(x) + k * 0x9E3779B97F4A7C15) % (1 << 64) for x in one]
            mixed = [(x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64) for x in mixed]
            mixed = [(x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64) for x in mixed]
            mixed = [x ^ x >> 31 for x in mixed]
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed))
        assert int(simhash.wide_fingerprint(one)[k]) == bits

    fps = np.array([simhash.wide_fingerprint(x) for x in sets])
    frame = spark.createDataFrame([tuple(x.view(np.int64).tolist()) for x in fps], "_f0 long, _f1 long, _f2 long, _f3 long")
    keys = {simhash._set_key(x): k for k, x in enumerate(fps)}
    first, distance, places = simhash._drawn(len(sets), 0.8)
    found = {frozenset(keys[r[c] % (1 << 64)] for c in "ab") for r in simhash._candidates(frame, first, distance, places).collect()}
    assert sum(frozenset((k, k + 1)) in found for k in range(0, 600, 2)) >= 297
    assert all(int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= distance for a, b in map(tuple, found))

    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    docs = documents(spark, [" ".join(words), " ".join([*words, "more"]), "another text of some words"])
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs, shingle=5, similarity=0.8).collect()) == [0, 2]
    monkeypatch.setattr(simhash, "_candidates", lambda *a: spark.createDataFrame([], "a long, b long"))
    assert simhash.keep_one(docs, shingle=5, similarity=0.8).count() == 3


def test_python_runs_once_and_in_workers_of_one_kind(spark, texts, monkeypatch):
    """Line dedup's function is in the filtered plan once; packing sends its tables without Python in the executors."""
    docs = documents(spark, ["a\nb\nc", "a\nb\nc\nd", "x"])
    plan = line_dedup.without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    made = []
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: made.append(a))
    cut = packing.pieces(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40), f"{TOKENIZERS}/word_bpe_49k.json")
    placed = rows(packing.pack(cut))
    assert not made and len(placed) >= 40

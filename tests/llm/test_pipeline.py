"""The pipeline's stages keep the columns of documents and apply their decisions."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as p
    from cubeloom.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert docs.agg({"length": "max"}).first()[0] <= 2048


def test_stages_against_brute_force(spark):
    """Each stage on its own input, against what it is defined to keep."""
    import zlib
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from cubeloom.llm import quality
    from cubeloom.llm.common import materialize

    rng = np.random.default_rng(8)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 400, 9))
    shared = [line() for _ in range(5)]
    texts = ["\n".join([line(), *(shared if k % 4 == 0 else []), line(), line()]) for k in range(40)]
    texts += [texts[1], texts[2] + " end", "!!! $$$ ###\n" * 9, "!! $$ ##\n" * 30, None, ""]
    docs = [(k, t, f"s{k % 3}", k) for k, t in enumerate(texts)]
    frame = materialize(spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long"), "docs")
    labels = spark.createDataFrame([(k, int(k < 40)) for k in range(44)], "doc_id long, quality int")

    x = np.array([quality.statistics(t) for t in texts])
    known = [k for k in range(44) if zlib.crc32(str(k).encode()) % 4 != 2]
    sums = {c: (len(own), x[own].sum(axis=0), x[own].T @ x[own]) for c in (0, 1) if (own := [k for k in known if (k < 40) == c])}
    scores = quality.fit(sums).scores(x)
    kept = materialize(quality.keep_good(frame, labels), "a")
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k in range(len(texts)) if scores[k] >= 0.7] and kept.count() > 30

    def naive_lines(rows):
        seen, out = set(), {}
        for k, t in sorted(rows, key=lambda r: r[0]):
            own = (t or "").split("\n")
            full = [i for i, w in enumerate(own) if w.strip()]
            gone = set()
            for i in range(len(full) - 2):
                body = tuple(own[j].strip() for j in full[i : i + 3])
                if body in seen:
                    gone.update(range(full[i], full[i + 2] + 1))
                seen.add(body)
            rest = "\n".join(w for i, w in enumerate(own) if i not in gone)
            if not gone or rest.strip():
                out[k] = rest if t is not None else None
        return out

    lines = materialize(p.line_dedup(spark, kept, ""), "b")
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == naive_lines([(r["doc_id"], r["text"]) for r in kept.collect()])

    one = materialize(p.near_dedup(spark, lines, ""), "c")
    sets = {}
    for r in lines.collect():
        words = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(root.values()))

    mixed = materialize(p.mixing(spark, one, ""), "d")
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in one.collect()}
    source = {r["doc_id"]: r["source"] for r in one.collect()}
    total = {s: sum(n for k, n in sizes.items() if source[k] == s) for s in set(source.values())}
    target, left, free = {}, 1.5 * sum(total.values()), dict(zip(sorted(total), (5, 2, 1), strict=False))
    while full := {s for s in free if left * free[s] / sum(free.values()) > 2 * total[s]}:
        left -= sum(2 * total[s] for s in full)
        target |= {s: 2 * total[s] for s in full}
        free = {s: w for s, w in free.items() if s not in full}
    target |= {s: left * w / sum(free.values()) for s, w in free.items()}
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert max(times.values()) <= 2
    for s, n in target.items():
        taken = sum(times[k] * sizes[k] for k in sizes if source[k] == s)
        assert abs(taken - n) <= max(sizes[k] for k in sizes if source[k] == s) / 2 + 1

    tk = Tokenizer.from_file(p.WORD_TOKENIZER)
    packed = p.packing(spark, mixed, "").collect()
    lengths = {k: len(tk.encode(texts_.get(k) or "", add_special_tokens=False).ids) + 1 for texts_ in [{r["doc_id"]: r["text"] for r in mixed.collect()}] for k in times}
    assert Counter(r["doc_id"] for r in packed) == times and all(r["length"] == lengths[r["doc_id"]] for r in packed)
    bins = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) + 1


def saved_tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert p.run(spark, saved_tables(spark, tmp_path, docs, labels)).collect() == []


@pytest.mark.parametrize("known", [[], [1, 1, 1, 1], [0, 0, 0, 0]])
def test_quality_without_labels_of_both_classes(spark, known):
    """As the pipeline's docstring states: every score is alike, so all documents stay or none does."""
    from cubeloom.llm import quality

    docs = spark.createDataFrame([(k, f"some words of document {k}", "s", k) for k in range(8)], "doc_id long, text string, source string, n_chars long")
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(known)], "doc_id long, quality int")
    scores = {round(r["score"], 9) for r in quality.score(docs, labels).select("score").collect()}
    kept = quality.keep_good(docs, labels).count()
    assert len(scores) == 1 and kept == (8 if scores.pop() >= 0.7 else 0)

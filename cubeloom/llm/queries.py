"""The queries of the training-data operators, by the names under which they are registered."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tokenizer files; a parameter of every operator that reads one.
WORD_TOKENIZER, BYTE_RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The pattern that belongs to the rank files.
TOKEN_PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.mixing import mix

    rows, _ = mix(_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_words").alias("size"),
        F.col("_source_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_times") * F.col("_words")).alias("taken"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.token_counts import count

    return count(_table(spark, sf_dir, "documents"), BYTE_RANKS, TOKEN_PATTERN)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.packing import pack, pieces

    return pack(pieces(_table(spark, sf_dir, "documents"), WORD_TOKENIZER))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.quality import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.lm_scoring import score, with_words

    return with_words(score(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.line_dedup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select(F.col("_doc.doc_id").alias("doc_id"), F.col("_removed").alias("lines_removed"), F.col("_text").alias("text"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.simhash import component_ids

    return component_ids(_table(spark, sf_dir, "documents"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.spotsigs import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.vector_codes import codes

    return codes(_table(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are those of the spans by pattern; ``spans`` has the field's too."""
    from cubeloom.llm.pii import KINDS, find

    found = find(_table(spark, sf_dir, "documents"))
    base = F.filter("_spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("_id").alias("doc_id"), *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cubeloom.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_token_counts, op3_best_fit_packing, op4_quality, op5_lm_scoring, op6_toxicity,
        op7_line_dedup, op8_simhash, op9_spotsigs, op10_embeddings, op11_vector_codes, op12_pii, op13_phrases,
    )
}

_TRIM = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"

_ROUND = """
a{0} AS MATERIALIZED (SELECT p.vec_id, p.j, any_value(p.v) AS v, min((p.nv - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)) * 256 + c.e)::BIGINT AS m
    FROM p JOIN c{0} c ON c.j = p.j GROUP BY p.vec_id, p.j),
c{1} AS MATERIALIZED (SELECT c.j, c.e, coalesce(n.v, c.v) AS v FROM c{0} c LEFT JOIN (
    SELECT j, e, list(floor(s / n) ORDER BY pos) AS v FROM (
        SELECT j, m % 256 AS e, pos, sum(v[pos]) AS s, count(*) AS n FROM a{0}, range(1, 1 + (SELECT max(len(v)) FROM p)) t(pos) GROUP BY ALL) GROUP BY j, e) n ON n.j = c.j AND n.e = c.e),"""

ORACLE_SQL: dict[str, str] = {
    # integers below 2 ** 53 in doubles; vec_id names a row
    "op11_vector_codes": """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS nv FROM (
    SELECT vec_id, label, j, v[j * len(v) // 4 + 1 : (j + 1) * len(v) // 4] AS v FROM k, range(4) t(j))),
c0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),"""
    + "".join(_ROUND.format(k, k + 1) for k in range(4))
    + """
f AS (SELECT p.vec_id, p.j, min((p.nv - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)) * 256 + c.e)::BIGINT AS m FROM p JOIN c4 c ON c.j = p.j GROUP BY p.vec_id, p.j),
r AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY j) AS code, sum(m // 256)::BIGINT AS error FROM f GROUP BY vec_id),
h AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY j, e, pos)) AS codebooks_sha256 FROM (SELECT j, e, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM c4))
SELECT r.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN k ON k.vec_id = r.vec_id, h""",
    "op7_line_dedup": f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM d),
f AS (SELECT doc_id, text, k, {_TRIM} AS t FROM l WHERE {_TRIM} <> ''),
w AS (SELECT doc_id, text, k AS a, lead(k, 2) OVER o AS b, t || chr(10) || lead(t) OVER o || chr(10) || lead(t, 2) OVER o AS body
      FROM f WINDOW o AS (PARTITION BY doc_id, text ORDER BY k)),
r AS (SELECT doc_id, text, a, b, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, text, a) AS n FROM w WHERE b IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(a, b + 1)) AS k FROM r WHERE n > 1),
kept AS (SELECT l.doc_id, l.text, string_agg(line, chr(10) ORDER BY l.k) FILTER (gone.k IS NULL) AS rest, count(gone.k) AS removed
         FROM l LEFT JOIN gone ON l.doc_id IS NOT DISTINCT FROM gone.doc_id AND l.text = gone.text AND l.k = gone.k GROUP BY l.doc_id, l.text)
SELECT x.doc_id, coalesce(kept.removed, 0) AS lines_removed, CASE WHEN x.text IS NULL THEN NULL ELSE coalesce(kept.rest, '') END AS text
FROM documents x LEFT JOIN kept ON x.doc_id IS NOT DISTINCT FROM kept.doc_id AND x.text = kept.text""",
    "op13_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i : i + d - 1] AS ws, d FROM i, range(1, 5) t(d) WHERE i + d - 1 <= len(ws)),
f AS (SELECT lang, ws, d, count(*) AS f FROM g GROUP BY ALL HAVING f >= 30),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, ws[k : k + m - 1] AS ws, max(f) AS f FROM f, range(1, 4) a(k), range(2, 4) b(m) WHERE m < d AND k + m - 1 <= d GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN o ON f.lang = o.lang AND f.ws = o.ws WHERE f.d > 1 AND (o.f IS NULL OR 100 * o.f < 80 * f.f)),
u AS (SELECT c.lang, c.ws, c.f AS a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.f) // (l.f::HUGEINT + r.f))::BIGINT AS score
      FROM c, range(1, 4) t(k), f l, f r WHERE k < c.d AND l.lang = c.lang AND r.lang = c.lang AND l.ws = c.ws[1 : k] AND r.ws = c.ws[k + 1 :]),
b AS (SELECT lang, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM u QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang QUALIFY rank <= 2000""",
}

"""SpotSigs document fingerprints, with DataFrame functions only.

Common words are anchors; the chain of the first content words after an anchor is a signature. A text's fingerprint
is the sorted set of its signatures' 32-bit hashes, eight hexadecimal digits each, so two fingerprints can be
compared without their texts. Sets are compared by Jaccard similarity; where a threshold is asked for, sets whose
lengths alone rule it out aren't intersected.

Words far from common ones (another language, a table, junk) are anchors themselves, with themselves as the chain's first
word: those with no common word among the ``GAP`` words before and after. So what a passage's signatures are depends on it
and the few words around it, whatever the rest of the text is.

Edge cases: a null text is an empty one; a text that would have no signature (it ends with its only anchor, say) takes every
word for an anchor; a text without words has an empty fingerprint, with likeness 1 to another
empty one and 0 to others; documents are ordered by id downwards, null last, then by a hash of the text; the next
document of the last is the first; a single document is its own next one; repeated rows follow each other; an empty
table gives no rows; further columns are left out of the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import materialize, shuffle_width, small

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was as with be by are this at from or an not "
    "le la les de des du un une et en que qui dans pour par sur est au aux pas ne se ce "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las del y con una su al lo como más pero sus"
).split()
CHAIN, GAP = 3, 4


def _anchor_pattern(anchors: list[str] | tuple[str, ...]) -> str:
    """A space and an anchor, before a space or the end; the alternatives are grouped by first letter."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(anchors)):
        by_first.setdefault(w[0], []).append(w[1:])
    return " (?:" + "|".join(f"{a}(?:{'|'.join(sorted(rest, reverse=True))})" for a, rest in by_first.items()) + ")(?= |$)"


def with_signatures(
    rows: DataFrame, text_col: str, out: str, *, anchors: list[str] | tuple[str, ...] = tuple(ANCHORS), chain: int = CHAIN, gap: int = GAP
) -> DataFrame:
    """``rows`` with ``out``: the sorted distinct signature hashes of a text, array of long below 2**32.

    Each step is a column of its own, so that a lambda function reads it and doesn't work it out for each element.
    """
    plain = F.rtrim(F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+", " "))))
    rows = rows.withColumn("_plain", plain).withColumn("_parts", F.split("_plain", _anchor_pattern(anchors)))
    # a part's words stand after an empty string, so word k is element k + 1; the first part has no anchor before it, the last none after
    rows = rows.withColumn("_words", F.transform("_parts", lambda x: F.split(x, " ")))
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "))
    none = F.array().cast("array<string>")

    def runs(words: Column, i: Column) -> Column:
        m = F.size(words) - 1
        after = F.when(i == 0, 0).otherwise(gap)  # words after this one and up to `until` are anchors themselves
        until = m - F.when(i == F.size("_parts") - 1, 0).otherwise(gap)
        head = F.when(i == 0, none).otherwise(F.array(spaced(F.slice(words, 2, gap))))
        own = F.transform(F.slice(words, after + 2, until - after - 1), lambda x: F.concat(F.lit(" "), x))
        far = F.concat(head, own, F.array(spaced(F.slice(words, until + 1, m - until + 1))))
        return F.when(until > after, far).when((i > 0) & (m > 0), F.array(spaced(F.slice(words, 2, m)))).otherwise(none)

    rows = rows.withColumn("_found", F.flatten(F.transform("_words", runs)))
    words = F.transform(F.filter(F.split("_plain", " "), lambda x: x != ""), lambda x: F.concat(F.lit(" "), x))
    rows = rows.withColumn("_runs", F.when(F.size("_found") == 0, words).otherwise(F.col("_found")))
    # each run has a word at least, so that a run and the `chain - 1` runs after it hold a chain
    hashed = F.transform(
        "_runs",
        lambda x, i: F.shiftrightunsigned(F.xxhash64(F.substring_index(F.array_join(F.slice("_runs", i + 1, chain), ""), " ", chain + 1)), 32),
    )
    return rows.withColumn(out, F.array_sort(F.array_distinct(hashed))).drop("_plain", "_parts", "_words", "_found", "_runs")


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(F.transform(signature_set, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column, *, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where their lengths alone keep it below ``at_least``."""
    x, y = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    jaccard = both / (x + y - both)
    bound = F.least(x, y) / F.greatest(x, y)
    return F.when((x == 0) & (y == 0), F.lit(1.0)).when(bound < F.lit(float(at_least)), F.lit(0.0)).otherwise(jaccard).cast("double")


def similar_pairs(rows: DataFrame, id_col: str, sig_col: str, *, at_least: float) -> DataFrame:
    """(a, b, likeness): pairs of rows, a < b, whose signature sets are at least ``at_least`` (above 0) alike; empty sets have none.

    Sets are partitioned by length, so that sets alike enough are in the same partition or the next. They share one of the first
    signatures of each, as many as leave fewer than the common part needs; only sets that do are compared.
    """
    sized = rows.select(F.col(id_col).alias("_id"), F.col(sig_col).alias("_s")).where(F.size("_s") > 0).withColumn("_n", F.size("_s"))
    step = math.log(1 / at_least) if at_least < 1 else math.log(2)
    # the small margins keep rounding from losing a set; what they add is compared and dropped
    part = F.floor(F.log(F.col("_n").cast("double")) / F.lit(step + 1e-9)).cast("int")
    first = F.col("_n") - F.ceil(F.col("_n") * F.lit(at_least) - F.lit(1e-9)).cast("int") + 1
    keyed = sized.withColumn("_part", part).withColumn("_sig", F.explode(F.slice(F.array_sort("_s"), F.lit(1), first))).select("_id", "_part", "_sig")
    other = keyed.withColumn("_part", F.explode(F.array(F.col("_part") - 1, F.col("_part"), F.col("_part") + 1))).withColumnRenamed("_id", "_other")
    met = keyed.join(other, ["_part", "_sig"]).where(F.col("_id") < F.col("_other")).select(F.col("_id").alias("a"), F.col("_other").alias("b")).distinct()
    left = sized.select(F.col("_id").alias("a"), F.col("_s").alias("_left"))
    right = sized.select(F.col("_id").alias("b"), F.col("_s").alias("_right"))
    out = met.join(left, "a").join(right, "b")
    return out.select("a", "b", likeness(F.col("_left"), F.col("_right"), at_least=at_least).alias("likeness")).where(F.col("likeness") >= at_least)


def _bucket(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are above ``value``, by two steps of about sqrt(len(bounds)) comparisons."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    rows = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    # rows that lie above the value as a whole, and the bounds above it in the last row that doesn't
    whole = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda x: x > value))
    table = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    edge = F.element_at(table, F.greatest(F.size(table) - whole, F.lit(1)))
    above = F.when(whole == F.size(table), F.lit(0)).otherwise(F.size(F.filter(edge, lambda x: x > value)))
    sizes = F.array(*[F.lit(len(bounds) - min(len(bounds), k * width)) for k in range(len(rows) + 1)])
    return above + F.element_at(sizes, F.size(table) - whole + 1)


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text, _sigs and the text and signatures of the next document, _next_text and _next_sigs.

    Rows are dealt by ranges of ids with one shuffle of the texts; each range also gets the next range's first row.
    """
    spark = docs.sparkSession
    n = 4 * shuffle_width(spark)
    at = [k / n for k in range(1, n)]
    if dict(docs.select(id_col).dtypes)[id_col] == "string":  # bounds from a sample by hash; they only balance the tasks
        taken = docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(F.lit(n), id_col)).limit(64 * n)
        own = sorted(r[0] for r in taken.collect())
        bounds = [own[int(x * len(own))] for x in at] if own else []
    else:
        bounds = docs.select(F.percentile_approx(id_col, at, 100 * n)).first()[0] or []
    bucket = F.coalesce(_bucket(F.col("_id"), sorted(set(bounds))), F.lit(n)).cast("int")
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_text")).withColumn("_bucket", bucket)
    place = F.struct(F.col("_id"), F.col("_key"))
    firsts = rows.groupBy("_bucket").agg(F.max(place).alias("_first"))
    order = Window.orderBy("_bucket")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(everything))
    firsts = materialize(firsts.select("_first", before.alias("_before")), "first-of-range")
    heads = (
        rows.join(small(firsts), rows["_id"].eqNullSafe(F.col("_first._id")) & (rows["_key"] == F.col("_first._key")))
        .dropDuplicates(["_before"])
        .select("_id", "_text", "_key", F.col("_before").alias("_bucket"), F.lit(1).alias("_head"))
    )
    both = rows.select("_id", "_text", "_key", "_bucket", F.lit(0).alias("_head")).unionByName(heads)
    both = with_signatures(both, "_text", "_sigs")
    w = Window.partitionBy("_bucket").orderBy("_head", F.col("_id").desc_nulls_last(), F.col("_key").desc())
    both = both.withColumn("_next", F.lead(F.struct("_text", "_sigs")).over(w)).where(F.col("_head") == 0)
    return both.select("_id", "_text", "_sigs", F.col("_next._text").alias("_next_text"), F.col("_next._sigs").alias("_next_sigs"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as many first code points of ``following`` (or all)."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(text.substr(F.lit(1), n - third), following.substr(F.lit(1), third))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how like the edited and the next text are."""
    rows = with_next(docs, id_col=id_col, text_col=text_col)
    rows = rows.withColumn("_edited", edited(F.col("_text"), F.col("_next_text")))
    rows = with_signatures(rows, "_edited", "_edited_sigs")
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("_sigs")).alias("fingerprint"),
        fingerprint(F.col("_edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("_sigs"), F.col("_edited_sigs")).alias("near_edited"),
        likeness(F.col("_sigs"), F.col("_next_sigs")).alias("near_next"),
    )

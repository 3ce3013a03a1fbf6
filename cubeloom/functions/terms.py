"""RDF terms as columns: canonical N-Triples strings, their kind, and the key by which SPARQL compares values."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cubeloom.functions.vocab import XSD

TRIPLES = StructType([StructField(c, StringType(), False) for c in ("s", "p", "o", "o_kind", "o_val")])

_NUMERIC = (
    "integer decimal double float byte short int long unsignedByte unsignedShort unsignedInt unsignedLong "
    "nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger"
).split()


def iri(prefix: str, *parts: Column) -> Column:
    """``<prefix...>`` from the parts, dash-separated."""
    return F.concat(F.lit(f"<{prefix}"), F.concat_ws("-", *[p.cast("string") for p in parts]), F.lit(">"))


def literal(value: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    text = value.cast("string")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    tail = f'"^^<{XSD}{datatype}>' if datatype else f'"@{lang}' if lang else '"'
    return F.concat(F.lit('"'), text, F.lit(tail))


def kind(term: Column) -> Column:
    first = F.substring(term, 1, 1)
    return F.when(first == "<", "iri").when(first == "_", "bnode").otherwise("literal")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _number(lexical: Column, term: Column) -> Column:
    """The key of a number: its digits without an exponent, compared as they are to any length, or else its double."""

    def of_digits(digits: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(F.regexp_replace(digits, r"^[+-]?0*", ""), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        whole = lambda b: F.when(b == "", F.lit("0")).when(b.startswith("."), F.concat(F.lit("0"), b)).otherwise(b)
        signed = lambda b: F.concat(F.when(digits.startswith("-") & (b != "0"), F.lit("#-")).otherwise(F.lit("#")), b)
        return _let(_let(body, whole), signed)

    def of_double(double: Column) -> Column:
        near = double.try_cast("decimal(38,18)")
        exact = F.when(near.cast("double") == double, near.cast("string"))
        return F.coalesce(_let(exact, of_digits), F.concat(F.lit("#e"), double.cast("string")), term)

    return (
        F.when(lexical.rlike(r"^[1-9]\d*$"), F.concat(F.lit("#"), lexical))
        .when(lexical.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), _let(lexical, of_digits))
        .otherwise(_let(lexical.try_cast("double"), of_double))
    )


def value_key(term: Column) -> Column:
    """Equal for literals that SPARQL's ``=`` holds equal: numbers by value, booleans by truth, plain strings as xsd:string,
    points of time with a zone by instant, those without by what they say. NaN, which SPARQL holds unequal to itself, has the key ``NAN_KEY``.
    """
    # a typed literal ends in its datatype, after the last of these marks
    datatype = lambda t: F.substring_index(t, '"^^<', -1)
    lexical = lambda t: F.substring(t, F.lit(2), F.length(t) - F.length(datatype(t)) - F.lit(5))

    def typed(t: Column) -> Column:
        def by(kind: Column) -> Column:
            zoned = F.when(lexical(t).rlike(r"T.*(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(lexical(t)))
            local = F.when(lexical(t).rlike(r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$"), lexical(t).try_cast("timestamp_ntz"))
            return (
                F.when(kind.isin(*[XSD + n + ">" for n in _NUMERIC]), _let(lexical(t), lambda x: _number(x, t)))
                .when(kind == XSD + "boolean>", F.when(lexical(t).isin("true", "1"), F.lit("?true")).when(lexical(t).isin("false", "0"), F.lit("?false")).otherwise(t))
                .when(kind == XSD + "dateTime>", F.coalesce(F.concat(F.lit(ZONED), F.unix_micros(zoned).cast("string")), F.concat(F.lit(LOCAL), local.cast("string")), t))
                .otherwise(t)
            )

        return _let(datatype(t), by)

    return (
        F.when(F.substring(term, 1, 1) != '"', term)
        .when(term.rlike(rf'^"[1-9][0-9]*"\^\^<{re.escape(XSD)}integer>\z'), F.concat(F.lit("#"), F.substring_index(F.substring(term, 2, 1 << 30), '"', 1)))  # most numbers: what follows says so too, but isn't compiled
        .when(term.endswith('"'), F.concat(term, F.lit(f"^^<{XSD}string>")))
        .when(term.endswith(">") & term.contains('"^^<'), typed(term))
        .otherwise(term)
    )


#: How keys begin that are of times with and without a zone, and the key of NaN.
ZONED, LOCAL, NAN_KEY = "#t", "#u", "#eNaN"


def unknown_key(key: Column) -> Column:
    """Whether a value key is of a literal that SPARQL can't compare with a different one: its datatype is none of XSD's, or its text none of the datatype's."""
    datatype = F.substring_index(key, '"^^<', -1)
    valued = [XSD + n + ">" for n in (*_NUMERIC, "boolean", "dateTime")]  # their keys have no datatype
    return key.startswith('"') & key.endswith(">") & key.contains('"^^<') & (~datatype.startswith(XSD) | datatype.isin(*valued))


def triples(df: DataFrame, *, apart: bool = False) -> DataFrame:
    """A graph from rows (s, p, o) of canonical terms: rows without nulls, each once, with kind and value key. ``apart``: no row is there twice."""
    spo = df.select("s", "p", "o").where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())
    spo = spo if apart else spo.distinct()
    return spo.withColumn("o_kind", kind(F.col("o"))).withColumn("o_val", value_key(F.col("o")))

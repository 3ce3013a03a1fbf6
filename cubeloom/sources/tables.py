"""Cubes from relational tables: a declarative mapping of a wide DataFrame to triples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions.terms import triples
from cubeloom.functions.vocab import TYPE, qb
from cubeloom.sources.store import saved


def facts(rows: DataFrame, subject: Column, properties: Mapping[str, Column | Iterable[Column]]) -> DataFrame:
    """(s, p, o) of one subject for each row, from one scan; a null value gives no triple, several columns several."""
    pairs = [
        F.struct(F.lit(p).alias("p"), o.alias("o"))
        for p, values in properties.items()
        for o in ([values] if isinstance(values, Column) else values)
    ]
    return rows.select(subject.alias("s"), F.explode(F.array(*pairs)).alias("x")).select("s", "x.p", "x.o").where(F.col("o").isNotNull())


#: How many rows of a table one task makes triples of; sorting these takes some 200 bytes each.
_PART_ROWS = 50_000


def parts_of(spark: SparkSession, size: int) -> int:
    """In how many parts ``facts_once`` deals so many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-size // _PART_ROWS))


def facts_once(rows: DataFrame, subject: Column, properties: Mapping[str, Column | Iterable[Column]], *, size: int | None = None) -> DataFrame:
    """As ``facts``, each triple once. Rows are dealt by subject before they are made triples, so what is shuffled is the table's columns, not text.

    ``size``: about how many rows there are, if that is known; the number of parts follows it, so a task's work is bounded.
    """
    parts = parts_of(rows.sparkSession, rows.count() if size is None else size)
    # equal triples have equal subjects, so they are in one part already and this needs no further shuffle
    return facts(rows.repartition(parts, subject), subject, properties).distinct()


#: How many rows of a table one task makes distinct where they aren't made triples.
_PLAIN_ROWS = 250_000


def rows_once(rows: DataFrame) -> DataFrame | None:
    """The distinct rows, stored; None if a value is null, so that rows can't be told apart by the subjects that ``iri`` makes of all their columns."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // _PLAIN_ROWS))
    out = saved(rows.repartition(parts, *rows.columns).distinct(), "rows")
    return out if out.where(reduce(Column.__or__, [F.col(c).isNull() for c in out.columns])).isEmpty() else None


@dataclass(frozen=True)
class Mapped:
    """Facts of a stored table, as for ``facts``, where each row has a subject of its own. So neither triples nor the star table need be
    stored: both are made from the rows where they are read, and only of the columns that are asked for.
    """

    rows: DataFrame
    subject: Column
    properties: Mapping[str, Column | Iterable[Column]]

    def objects(self, p: str) -> list[Column]:
        """A row's objects of a predicate; those that aren't null are distinct."""
        columns = self.properties.get(p, [])
        columns = [columns] if isinstance(columns, Column) else list(columns)
        new = lambda k: reduce(Column.__and__, [~columns[k].eqNullSafe(c) for c in columns[:k]])
        return [F.when(new(k), c) if k else c for k, c in enumerate(columns)]

    def triples(self) -> DataFrame:
        """A frame for each object, so a search for a predicate reads its columns only."""
        found = [self.rows.select(self.subject.alias("s"), F.lit(p).alias("p"), o.alias("o")) for p in self.properties for o in self.objects(p)]
        return reduce(DataFrame.unionByName, [triples(x, apart=True) for x in found])


_views: WeakKeyDictionary[DataFrame, tuple[DataFrame, tuple[Mapped, ...]]] = WeakKeyDictionary()


def view(rest: DataFrame, *mapped: Mapped) -> DataFrame:
    """A graph of a stored graph and of mapped facts, all of whose subjects differ from each other."""
    out = reduce(DataFrame.unionByName, [m.triples() for m in mapped], rest)
    _views[out] = rest, mapped
    return out


def of_view(graph: DataFrame) -> tuple[DataFrame, tuple[Mapped, ...]] | None:
    """What a graph was made of by ``view``; None for others."""
    return _views.get(graph)


def constants(spark: SparkSession, rows: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A few triples, as a frame."""
    return spark.createDataFrame(list(rows), "s string, p string, o string")


def structure(
    dsd: str, *, dimensions: Iterable[str] = (), measures: Iterable[str] = (), attributes: Iterable[str] = (),
    required: Iterable[str] = (), optional: Iterable[str] = (), attachment: Mapping[str, str] | None = None,
) -> list[tuple[str, str, str]]:
    """Triples of a structure definition, in abbreviated form (normalization adds what they imply)."""
    boolean = lambda x: f'"{x}"^^<http://www.w3.org/2001/XMLSchema#boolean>'
    out = [(dsd, TYPE, qb("DataStructureDefinition"))]
    for kind, props in (("dimension", dimensions), ("measure", measures), ("attribute", attributes)):
        for p in props:
            spec = f"_:{dsd.strip('<>').replace(':', '-')}-{p.strip('<>').replace(':', '-').replace('/', '-').replace('#', '-')}"
            out += [(dsd, qb("component"), spec), (spec, qb(kind), p)]
            if p in set(required):
                out.append((spec, qb("componentRequired"), boolean("true")))
            if p in set(optional):
                out.append((spec, qb("componentRequired"), boolean("false")))
            if p in (attachment or {}):
                out.append((spec, qb("componentAttachment"), qb(attachment[p])))
    return out


def graph(*parts: DataFrame, apart: Iterable[DataFrame] = ()) -> DataFrame:
    """One graph of several frames of (s, p, o). ``apart``: frames of distinct triples (``facts_once``), none of which another frame has."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = triples(out)
    for part in apart:
        out = out.unionByName(triples(part, apart=True))
    return out

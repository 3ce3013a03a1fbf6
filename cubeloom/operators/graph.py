"""Access operators over a graph ``T(s, p, o, o_kind, o_val)``, as compositions of joins.

Every operator takes and returns DataFrames; sets are distinct one-column (or two-column) frames. None of them
collects, but for a few names. Sides are broadcast only as adaptive execution finds them small.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.functions.vocab import TYPE
from cubeloom.sources.store import saved

log = logging.getLogger("cubeloom")

#: Tables with at most so many rows are broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 100_000

#: So few names are looked for by themselves, so that a scan skips what has none of them.
FEW = 16

#: How many rows of a large table are dealt to one task.
_DEALT_ROWS = 100_000
_PARTS = 16
#: Rounds of single steps before jumps are made; most hierarchies end within them.
_SINGLE = 3
_GROWTH = 4


def links(t: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    """(s, o) of one predicate, under the given names."""
    return t.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def subjects(t: DataFrame, p: str, o: str | None = None, name: str = "s") -> DataFrame:
    """Subjects that have the predicate, with the object if one is given."""
    match = F.col("p") == p
    return t.where(match if o is None else match & (F.col("o") == o)).select(F.col("s").alias(name)).distinct()


def objects(t: DataFrame, p: str, s: str | None = None, name: str = "o") -> DataFrame:
    match = F.col("p") == p
    return t.where(match if s is None else match & (F.col("s") == s)).select(F.col("o").alias(name)).distinct()


def statements(t: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that match a pattern; None matches all."""
    tests = [F.col(c) == v for c, v in (("s", s), ("p", p), ("o", o)) if v is not None]
    return t.where(reduce(Column.__and__, tests)) if tests else t


def typed(t: DataFrame, cls: str, name: str = "s") -> DataFrame:
    return subjects(t, TYPE, cls, name)


def resources(t: DataFrame) -> DataFrame:
    """Triples whose object is an IRI or a blank node."""
    return t.where(F.col("o_kind") != "literal")


def properties(t: DataFrame) -> DataFrame:
    """Triples whose object can be a predicate: an IRI."""
    return t.where(F.col("o_kind") == "iri")


def predicates(t: DataFrame) -> DataFrame:
    """The predicates of a graph (column p), stored; they are few unless the graph names them by key."""
    return saved(t.select("p").distinct(), "predicates")


def small(side: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def dealt(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """``rows`` by keys, in as many parts as ``size`` rows need; Spark would join parts by their compressed bytes, and terms compress to a few each."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // _DEALT_ROWS)), *keys)


def having(t: DataFrame, names: DataFrame) -> DataFrame:
    """Triples whose predicate is one of ``names`` (column p).

    Names that are no predicate of the graph are left out first, so a schema may be large. What is left is broadcast: by shuffle, all
    triples of a predicate would meet in one task. A few are looked for by themselves.
    """
    names = saved(names.select("p").distinct(), "names")
    few = [r["p"] for r in names.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return t.where(F.col("p").isin(few))
    return t.join(small(saved(names.join(predicates(t), "p", "left_semi"), "names")), "p", "left_semi")


def path(t: DataFrame, steps: Sequence[str], s: str | None = None, o: str | None = None, *, from_: str = "s", to: str = "o") -> DataFrame:
    """Ends (from_, to) of a sequence path. Literals end a path only at its last step; each hop is made distinct."""
    out = links(t if len(steps) == 1 else resources(t), steps[0], from_, to)
    if s is not None:
        out = out.where(F.col(from_) == s)
    for k, p in enumerate(steps[1:], 2):
        hop = links(t if k == len(steps) else resources(t), p, "_via", "_next")
        out = out.distinct().join(hop, F.col(to) == F.col("_via")).select(from_, F.col("_next").alias(to))
    return (out if o is None else out.where(F.col(to) == o)).distinct()


def star(t: DataFrame, pattern: dict[str, str | None], subject: str | None = None) -> DataFrame:
    """Subjects that satisfy all (predicate, object) of ``pattern``; an object of None is any."""
    sets = [subjects(t, p, o) for p, o in pattern.items()]
    out = reduce(lambda a, b: a.join(b, "s", "left_semi"), sets)
    return out if subject is None else out.where(F.col("s") == subject)


def star_lookup(t: DataFrame, pattern: dict[str, str | None], wanted: Sequence[str], subject: str | None = None) -> DataFrame:
    """(s, p, o) of the wanted predicates of ``star``'s subjects; a subject without one keeps a row with null o."""
    found = t.where(F.col("p").isin(list(wanted))).select("s", "p", "o")
    every = star(t, pattern, subject).withColumn("p", F.explode(F.array(*[F.lit(p) for p in wanted])))
    return every.join(found, ["s", "p"], "left")


def forward(nodes: DataFrame, t: DataFrame, p: str) -> DataFrame:
    """Objects that the nodes (column s) have for a predicate."""
    return links(t, p).join(nodes, "s", "left_semi").select("o").distinct()


def backward(nodes: DataFrame, t: DataFrame, p: str) -> DataFrame:
    """Subjects that have one of the nodes (column o) for a predicate."""
    return links(t, p).join(nodes, "o", "left_semi").select("s").distinct()


def connected(pairs: DataFrame, t: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Those of ``pairs`` (s, o) that a path connects."""
    return pairs.join(path(t, steps), ["s", "o"], "left_semi")


def connected_repeatedly(pairs: DataFrame, t: DataFrame, steps: Sequence[str], p: str, *, inverse: bool = False) -> DataFrame:
    """Those of ``pairs`` (s, o) that a path and then any number of steps of ``p``, none included, connects."""
    seeds = path(t, steps).join(pairs.select("s").distinct(), "s", "left_semi").select(F.col("s").alias("g"), F.col("o").alias("v"))
    reached = closure(seeds, edges(t, p, inverse=inverse), keys=("g",))
    return pairs.join(reached.select(F.col("g").alias("s"), F.col("v").alias("o")), ["s", "o"], "left_semi")


def edges(t: DataFrame, p: str, *, inverse: bool = False) -> DataFrame:
    """(a, b) steps of a predicate between resources, against its direction if ``inverse``."""
    e = links(resources(t), p, "a", "b")
    return e.select(F.col("b").alias("a"), F.col("a").alias("b")) if inverse else e


def _paths(jump: DataFrame, at: Sequence[str]) -> int:
    """How many pairs of steps follow each other, from the numbers that end and begin at each node."""
    ends = jump.groupBy(*at, F.col("b").alias("x")).agg(F.count("*").alias("n"))
    begins = jump.groupBy(*at, F.col("a").alias("x")).agg(F.count("*").alias("m"))
    return ends.join(begins, [*at, "x"]).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def closure(seeds: DataFrame, steps: DataFrame, *, keys: Sequence[str] = (), node: str = "v") -> DataFrame:
    """All (keys, node) that steps (keys that they have, a, b) reach from the seeds, the seeds included.

    The first ``_SINGLE`` rounds go one step each, from what the last one found. If there is more to find, steps are joined
    with themselves to jumps of 2, 4, 8, ... steps, and each jump is made from all that is known, so the rounds are
    logarithmic in the depth. Jumps stop growing where there would be more than ``_GROWTH`` times as many as steps; rounds
    then go on with the jumps there are. What is known is dropped, so cycles end. All groups advance together. What a
    round finds is written to the shared folder, so the plan doesn't grow and no executor is needed to keep a round.
    """
    columns = [*keys, node]
    shared = [k for k in keys if k in steps.columns]
    frontier = saved(seeds.select(*columns).distinct(), "reached")
    parts, jump, rounds, longer = [frontier], steps.select(*shared, "a", "b"), 0, True
    union = lambda: reduce(DataFrame.unionByName, parts)
    while not frontier.isEmpty():
        if rounds == _SINGLE:
            jump = saved(jump.distinct(), "jumps")
            most = _GROWTH * jump.count()
        if rounds >= _SINGLE and longer:  # known: all within fewer than 2 ** (rounds - _SINGLE + 2) steps
            for _ in range(2 if rounds == _SINGLE else 1):
                longer = longer and _paths(jump, shared) <= most
                if longer:
                    on = jump.select(*shared, F.col("a").alias("_from"), F.col("b").alias("a"))
                    jump = saved(on.join(jump, [*shared, "a"]).select(*shared, F.col("_from").alias("a"), "b").distinct(), "jumps")
            frontier = union()
        found = frontier.join(jump.withColumnRenamed("a", node), [*shared, node]).select(*keys, F.col("b").alias(node)).distinct()
        frontier = saved(found.join(union(), columns, "left_anti"), "reached")
        parts.append(frontier)
        rounds += 1
        if len(parts) > _PARTS:
            parts = [saved(union(), "reached")]
    log.info("closure: %d rounds", rounds)
    return union()


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set intersection, as a semi-join on all columns of ``a``."""
    return a.join(b.select(*a.columns), a.columns, "left_semi")


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set difference, as an anti-join on all columns of ``a``."""
    return a.join(b.select(*a.columns), a.columns, "left_anti")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two maps in long form (key, value)."""
    return a.unionByName(b).distinct()


def as_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Key and sorted set of values, from the long form."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(value))

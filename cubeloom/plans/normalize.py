"""Normalization of an abbreviated cube: implied types and component properties, then attached values pushed down.

Each phase reads the graph it is given and adds triples; no rule of a phase enables another of the same phase except
that types follow links, so one pass of each phase is a fixpoint: normalizing twice adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.functions.terms import triples
from cubeloom.functions.vocab import COMPONENT_KINDS, TYPE, qb
from cubeloom.operators.graph import having, links, properties, resources, small, typed
from cubeloom.sources.store import saved


def _is(s: str, cls: str) -> Column:
    return F.struct(F.col(s).alias("s"), F.lit(TYPE).alias("p"), F.lit(cls).alias("o"))


def implied(t: DataFrame, *, observations: bool = True) -> DataFrame:
    """What phase 1 adds (N1-N6), from one scan (and one of the links to datasets, without types of observations): types of observations (unless left out), datasets and slices; component properties and their classes."""
    p, none = F.col("p"), F.array().cast("array<struct<s:string,p:string,o:string>>")
    found = F.when(p == qb("slice"), F.array(_is("o", qb("Slice"))))
    if observations:
        found = found.when(p == qb("observation"), F.array(_is("o", qb("Observation"))))
        found = found.when(p == qb("dataSet"), F.array(_is("s", qb("Observation")), _is("o", qb("DataSet"))))
    for kind, cls in COMPONENT_KINDS.items():
        link = F.struct(F.col("s").alias("s"), F.lit(qb("componentProperty")).alias("p"), F.col("o").alias("o"))
        found = found.when(p == kind, F.array(link, _is("o", cls)))
    # only resources can be subjects, so an implied type of a literal is dropped
    subject_ok = F.col("x.s").startswith("<") | F.col("x.s").startswith("_")
    names = [qb("observation"), qb("dataSet"), qb("slice"), *COMPONENT_KINDS]
    out = t.where(p.isin(names)).select(F.explode(F.coalesce(found, none)).alias("x")).where(subject_ok).select("x.*")
    if observations:
        return out
    # datasets are few, and made distinct before anything is made of them
    return out.unionByName(links(t, qb("dataSet"), "_s").select("o").distinct().select(_is("o", qb("DataSet")).alias("x")).where(subject_ok).select("x.*"))


def attached(t: DataFrame) -> DataFrame:
    """What phase 2 adds (N7-N9): values of datasets and slices, copied to their observations."""
    spec = links(resources(t), qb("component"), "dsd", "spec")
    prop = links(properties(t), qb("componentProperty"), "spec", "p")
    of_dsd = spec.join(prop, "spec")
    structure = links(resources(t), qb("structure"), "ds", "dsd")
    attachment = links(t, qb("componentAttachment"), "spec", "to")
    by_ds = structure.join(of_dsd.join(attachment, "spec", "left"), "dsd").select("ds", "p", "to").distinct()
    values = lambda of: having(t, of).select(F.col("s").alias("holder"), "p", "o").join(small(of), ["holder", "p"], "left_semi")
    # values attached to the dataset
    on_ds = saved(by_ds.where(F.col("to") == qb("DataSet")).select(F.col("ds").alias("holder"), "p"), "on-datasets")
    obs = links(t, qb("dataSet"), "obs", "holder")
    # a dataset's values are few and its observations many: by shuffle, they would meet in one task
    from_ds = obs.join(small(saved(values(on_ds), "attached")), "holder").select(F.col("obs").alias("s"), "p", "o")
    # values on the slice: attached ones, and of any dimension
    dims = typed(t, qb("DimensionProperty"), "p")
    on_slice = by_ds.where(F.col("to") == qb("Slice")).select("ds", "p").unionByName(by_ds.select("ds", "p").join(dims, "p", "left_semi").select("ds", "p"))
    of_slices = links(resources(t), qb("slice"), "ds", "holder")
    # of the datasets with slices, so few and broadcast even if there are very many structures: by shuffle, a dataset's slices would meet in one task
    wanted = saved(on_slice.distinct().join(of_slices.select("ds").distinct(), "ds", "left_semi"), "wanted")
    slices = saved(of_slices.join(small(wanted), "ds").select("holder", "p").distinct(), "on-slices")
    members = links(resources(t), qb("observation"), "holder", "obs")
    from_slice = small(saved(values(slices), "attached")).join(members, "holder").select(F.col("obs").alias("s"), "p", "o")
    return from_ds.unionByName(from_slice)


def lacking(t: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the triples found that the graph lacks, each once. Only its triples with their predicates are looked at.

    What a rule finds is stored first, so that the rule runs once.
    """
    added = saved(triples(found), "found").select(*t.columns)
    there = having(t, added).select("s", "p", "o")
    return added.join(there, ["s", "p", "o"], "left_anti").select(*t.columns)


def normalize(t: DataFrame, phases: tuple[int, ...] = (1, 2), *, keep: Callable[[DataFrame], DataFrame] = lambda added: added, observations: bool = True) -> DataFrame:
    """The graph (distinct triples) with what the phases add, each triple once.

    ``keep``: what to do with the triples of a phase, such as to store them; the graph itself isn't rewritten.
    ``observations``: whether to add the types of observations, as many as these; a context whose graph isn't ``stated`` does without.
    """
    for phase, rule in ((1, lambda t: implied(t, observations=observations)), (2, attached)):
        if phase in phases:
            added = keep(lacking(t, rule(t)))
            t = t if added.isEmpty() else t.unionByName(added)
    return t

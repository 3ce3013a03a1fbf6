"""The integrity constraints of a cube: each gives its violations as rows, never more than once.

Two semantics: ``standard`` is what the constraints' query definitions mean, ``setwise`` what set algebra over term
sets gives (see README). Where both agree there is one definition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.functions.vocab import INVERSE_OF, RANGE, TYPE, qb, skos
from cubeloom.operators.graph import closure, dealt, having, links, small, typed
from cubeloom.plans.context import MEASURE_TYPE, CubeContext
from cubeloom.plans.points import class_links, duplicates, pairs_once, point_lists, same_point_weight, to_members
from cubeloom.sources.store import saved


def _not_one(c: CubeContext, cls: str, p: str, name: str) -> DataFrame:
    """Instances with a number of different objects other than one."""
    every, found = c.typed(cls, name), c.links(p, name, "value")
    return every.join(found, name, "left").groupBy(name).agg(F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") != 1)


def ic1(c: CubeContext) -> DataFrame:
    """Observations without exactly one dataset: obs, values."""
    return c.star.where(F.col("typed") & (F.size("datasets") != 1)).select("obs", F.col("datasets").alias("values"))


def ic2(c: CubeContext) -> DataFrame:
    """Datasets without exactly one structure definition: dataset, values."""
    return _not_one(c, "DataSet", qb("structure"), "dataset")


def ic3(c: CubeContext) -> DataFrame:
    """Structure definitions without a measure: dsd."""
    with_measure = c.components.where("measure").select("dsd")
    return c.typed("DataStructureDefinition", "dsd").join(with_measure, "dsd", "left_anti")


def ic4(c: CubeContext) -> DataFrame:
    """Dimensions without a range: dim."""
    return c.typed("DimensionProperty", "dim").join(c.links(RANGE, "dim", "o"), "dim", "left_anti")


def ic5(c: CubeContext) -> DataFrame:
    """Dimensions that range over concepts and have no code list: dim."""
    coded = c.links(RANGE, "dim", "o").where(F.col("o") == skos("Concept"))
    return c.typed("DimensionProperty", "dim").join(coded, "dim", "left_semi").join(c.links(qb("codeList"), "dim", "o"), "dim", "left_anti")


def _required(c: CubeContext, truth: str) -> DataFrame:
    """(dsd, prop): component properties whose specification is marked required with the given truth."""
    marked = c.t.where((F.col("p") == qb("componentRequired")) & (F.col("o_val") == f"?{truth}")).select(F.col("s").alias("spec"))
    spec = c.links(qb("component"), "dsd", "spec").join(marked, "spec", "left_semi")
    return spec.join(c.links(qb("componentProperty"), "spec", "prop"), "spec").select("dsd", "prop").distinct()


def ic6(c: CubeContext) -> DataFrame:
    """Optional component properties that aren't attributes: component."""
    optional = _required(c, "false").select("prop").distinct()
    return optional.join(c.typed("AttributeProperty", "prop"), "prop", "left_anti").where(~F.col("prop").startswith('"')).select(F.col("prop").alias("component"))


def ic7(c: CubeContext) -> DataFrame:
    """Slice keys of no structure definition: sliceKey."""
    owned = c.links(qb("sliceKey"), "dsd", "sliceKey").join(c.typed("DataStructureDefinition", "dsd"), "dsd", "left_semi")
    return c.typed("SliceKey", "sliceKey").join(owned, "sliceKey", "left_anti")


def ic8(c: CubeContext) -> DataFrame:
    """Properties of slice keys that a structure definition with the key lacks: prop."""
    props = c.typed("SliceKey", "sliceKey").join(c.links(qb("componentProperty"), "sliceKey", "prop"), "sliceKey")
    needed = props.join(c.links(qb("sliceKey"), "dsd", "sliceKey"), "sliceKey")
    return needed.join(c.dsd_prop, ["dsd", "prop"], "left_anti").where(~F.col("prop").startswith('"')).select("prop").distinct()


def ic9(c: CubeContext) -> DataFrame:
    """Slices without exactly one structure: slice, values."""
    return _not_one(c, "Slice", qb("sliceStructure"), "slice")


def ic10(c: CubeContext) -> DataFrame:
    """Slices without a value for a property of their key: slice, dim."""
    needed = c.links(qb("sliceStructure"), "slice", "key").join(c.links(qb("componentProperty"), "key", "dim"), "key").select("slice", "dim").distinct()
    has = having(c.t, needed.select(F.col("dim").alias("p"))).select(F.col("s").alias("slice"), F.col("p").alias("dim"))
    return needed.join(has, ["slice", "dim"], "left_anti").where(~F.col("dim").startswith('"'))


def _lacking(c: CubeContext, needed: DataFrame, name: str) -> DataFrame:
    """Observations without a value of a property that their dataset needs: obs, name. ``needed``: ds, prop."""
    rows = c.with_list(c.star.select(F.explode("datasets").alias("ds"), "obs", "props", "datasets"), needed.withColumnRenamed("prop", "need"), "need")
    rows = rows.select("obs", "datasets", F.explode(F.array_except("needs", "props")).alias(name))
    return c.once(rows, "obs", name)  # what several datasets ask for counts once


def ic11(c: CubeContext) -> DataFrame:
    """Observations without a value for a dimension: obs, dim."""
    return _lacking(c, c.ds_dim.withColumnRenamed("dim", "prop"), "dim")


def points(c: CubeContext) -> DataFrame:
    """The observations' points by all dimensions, stored once: ds, obs, point, complete, place."""
    if "points" not in c.tables:
        c.tables["points"] = saved(point_lists(c, c.obs_with(c.ds_dim), c.ds_dim), "points")
    return c.tables["points"]


def ic12(c: CubeContext) -> DataFrame:
    """Pairs of observations of a dataset that agree on every dimension both have: obs1, obs2 (both orders)."""
    return pairs_once(points(c))


def ic12_groups(c: CubeContext) -> DataFrame:
    """What ic12 finds among complete observations, without listing pairs: obs, ds, group_size."""
    return duplicates(points(c), pairs=False)


def ic12_classes(c: CubeContext) -> DataFrame:
    """What ic12 finds, in one row for each observation of a dataset: obs, ds, class_id, class_size, n_links."""
    return class_links(points(c))


def ic12_setwise(c: CubeContext) -> DataFrame:
    """All but the first of the complete observations whose dimensions have the same set of values: obs."""
    rows = c.with_list(c.obs.join(c.small(c.structures.select("ds").distinct()), "ds", "left_semi"), c.ds_dim, "dim", how="left")
    dims = F.coalesce("dims", F.array().cast("array<string>"))
    least = F.transform(dims, lambda d: F.array_min(F.transform(c.values_of(d), lambda v: v["o"])))
    rows = rows.select("ds", "obs", least.alias("least")).where(~F.exists("least", lambda x: x.isNull()))
    key = F.array_sort(F.array_distinct("least"))
    rows = saved(rows.select("ds", "obs", F.unhex(F.md5(F.to_json(F.struct(key)))).alias("place")), "sets")
    groups = saved(rows.groupBy("ds", "place").agg(F.min("obs").alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    return to_members(rows, groups).where(F.col("obs") != F.col("first")).select("obs").distinct()


def ic13(c: CubeContext) -> DataFrame:
    """Observations without a value for a required component: obs, attr."""
    return _lacking(c, c.structures.join(_required(c, "true"), "dsd").select("ds", "prop"), "attr")


def ic14(c: CubeContext) -> DataFrame:
    """Observations without a declared measure, in cubes without a measure dimension: obs, measure."""
    typed_dsd = c.dsd_prop.where(F.col("prop") == MEASURE_TYPE).select("dsd")
    measures = c.components.where("measure").join(typed_dsd, "dsd", "left_anti")
    return _lacking(c, c.structures.join(measures, "dsd").select("ds", "prop"), "measure")


def ic14_setwise(c: CubeContext) -> DataFrame:
    """As ic14, but in cubes with a measure dimension every component counts: obs, measure."""
    typed_ds = c.ds_prop.where(F.col("prop") == MEASURE_TYPE).select("ds")
    needed = c.ds_prop.join(typed_ds, "ds", "left_semi").unionByName(c.ds_measure.select("ds", F.col("measure").alias("prop")))
    return _lacking(c, needed, "measure")


def _types(c: CubeContext, ds: DataFrame) -> DataFrame:
    """Rows of the star table by dataset, of some datasets."""
    return c.obs.join(c.small(ds.distinct()), "ds", "left_semi")


def ic15(c: CubeContext) -> DataFrame:
    """Observations with a measure type but no value of that measure: obs, measure."""
    rows = _types(c, c.ds_prop.where(F.col("prop") == MEASURE_TYPE).select("ds"))
    without = F.array_except("types", "props")
    return c.once(rows.where(F.size(without) > 0).select("obs", "datasets", F.explode(without).alias("measure")), "obs", "measure")


def ic16(c: CubeContext) -> DataFrame:
    """Observations with a measure type and a value of another declared measure: obs, measure (the type)."""
    cubes = c.dsd_prop.where(F.col("prop") == MEASURE_TYPE).select("dsd")
    measures = c.structures.join(cubes, "dsd", "left_semi").join(c.components.where("measure").select("dsd", "prop"), "dsd").select("ds", F.col("prop").alias("measure"))
    rows = c.with_list(_types(c, measures.select("ds")), measures, "measure").select("obs", "datasets", "props", "measures", F.explode("types").alias("measure"))
    other = F.exists("measures", lambda m: (m != F.col("measure")) & F.array_contains("props", m))
    return c.once(rows.where(other), "obs", "measure")


def ic15_setwise(c: CubeContext) -> DataFrame:
    """Observations whose one measure type isn't a measure of the dataset, or has other than one value: obs, measure."""
    rows = c.with_list(_types(c, c.ds_prop.where(F.col("prop") == MEASURE_TYPE).select("ds")), c.ds_measure, "measure", how="left")
    rows = rows.where(F.size("types") == 1).withColumn("measure", F.get("types", F.lit(0)))
    odd = ~F.coalesce(F.array_contains("measures", F.col("measure")), F.lit(False)) | (F.size(F.filter("props", lambda p: p == F.col("measure"))) != 1)
    return c.once(rows.where(odd), "obs", "measure")


def ic16_setwise(c: CubeContext) -> DataFrame:
    """Observations with no or several measure types: obs, measure (null if none)."""
    rows = _types(c, c.ds_prop.where(F.col("prop") == MEASURE_TYPE).select("ds"))
    return c.once(rows.where(F.size("types") != 1).select("obs", "datasets", F.explode_outer("types").alias("measure")), "obs", "measure")


def _other_dims(c: CubeContext) -> DataFrame:
    return c.ds_dim.where(F.col("dim") != MEASURE_TYPE)


def _with_type(c: CubeContext) -> DataFrame:
    """Rows of the star table by dataset, of observations with a measure type, with their values of other dimensions and their number of types as weight."""
    return c.obs_with(_other_dims(c)).withColumn("weight", F.size("types").cast("long")).where("weight > 0").drop("types")


def ic17(c: CubeContext) -> DataFrame:
    """Observations at whose point there are more or fewer observations than measures: obs, numMeasures, cnt.

    Others are at its point unless a dimension's values are different; values that can't be compared aren't.
    """
    n = c.components.where("measure").groupBy("dsd").agg(F.sum("copies").alias("numMeasures"))
    found = saved(point_lists(c, _with_type(c), _other_dims(c), three_valued=c.value == "o_val"), "points")
    of = c.small(c.structures.join(n, "dsd").groupBy("ds", "numMeasures").agg(F.count("*").alias("structures")))
    out = same_point_weight(found).join(of, "ds").select("obs", "numMeasures", (F.col("total") * F.col("weight") * F.col("structures")).alias("cnt"))
    if not found.where("several").isEmpty():  # else each is there once
        out = dealt(out, found.count(), "obs", "numMeasures").groupBy("obs", "numMeasures").agg(F.sum("cnt").alias("cnt"))
    return out.where(F.col("cnt") != F.col("numMeasures"))


def ic17_setwise(c: CubeContext) -> DataFrame:
    """As ic17 by the number of observations that differ: ds, obs, differing."""
    every = _with_type(c).join(c.small(c.ds_prop.select("ds").distinct()), "ds", "left_semi").withColumn("weight", F.lit(1))
    found = saved(point_lists(c, every, _other_dims(c), drop_multiple=True), "points")
    totals = found.groupBy("ds").agg(F.count("*").alias("observations"))
    n = c.ds_measure.groupBy("ds").agg(F.count("*").alias("measures"))
    out = same_point_weight(found).join(c.small(totals.join(n, "ds", "left")), "ds")
    out = out.where(F.col("total") != F.coalesce("measures", F.lit(0)))
    return out.select("ds", "obs", (F.col("observations") - F.col("total")).alias("differing"))


def ic18(c: CubeContext) -> DataFrame:
    """Observations of a dataset's slices that don't name the dataset: obs, dataset."""
    through = c.links(qb("slice"), "dataset", "slice").join(c.links(qb("observation"), "slice", "obs"), "slice").select("obs", "dataset").distinct()
    named = c.ds_obs.withColumnRenamed("ds", "dataset")
    return through.join(named, ["obs", "dataset"], "left_anti").where(~F.col("obs").startswith('"'))


def _code_lists(c: CubeContext) -> DataFrame:
    """(ds, dim, lst, kind): code lists of dimensions, of each kind that they are."""
    lists = c.ds_dim.join(c.links(qb("codeList"), "dim", "lst"), "dim")
    kinds = c.links(TYPE, "lst", "kind").where(F.col("kind").isin(skos("ConceptScheme"), skos("Collection"), qb("HierarchicalCodeList")))
    return lists.join(kinds, "lst").select("ds", "dim", "lst", "kind").distinct()


def _in_lists(c: CubeContext) -> DataFrame:
    """(v, lst, kind): concepts of schemes and, through members of members, of collections."""
    concept = typed(c.t, skos("Concept"), "v")
    scheme = c.links(skos("inScheme"), "v", "lst").withColumn("kind", F.lit(skos("ConceptScheme")))
    member = c.links(skos("member"), "a", "b")
    lists = typed(c.t, skos("Collection"), "lst")
    first = lists.join(member, lists["lst"] == member["a"]).select("lst", F.col("b").alias("v"))
    members = closure(first, member, keys=("lst",)).withColumn("kind", F.lit(skos("Collection")))
    return scheme.unionByName(members.select("v", "lst", "kind")).join(concept, "v", "left_semi").distinct()


def ic19(c: CubeContext) -> DataFrame:
    """Observations with a dimension value that one of its code lists lacks: obs, dim."""
    lists = _code_lists(c).where(F.col("kind") != qb("HierarchicalCodeList"))
    values = c.dim_values(lists.select("ds", "dim"))
    used = values.select("ds", "dim", "v").distinct().join(lists, ["ds", "dim"])
    bad = saved(used.join(_in_lists(c), ["v", "lst", "kind"], "left_anti").select("ds", "dim", "v").distinct(), "bad")
    return values.join(small(bad), ["ds", "dim", "v"], "left_semi").select("obs", "dim").distinct()


def ic19_setwise(c: CubeContext) -> DataFrame:
    """Values, of dimensions with one value, that are in none of the lists of a kind: value, lst."""
    lists = _code_lists(c).where(F.col("kind") != qb("HierarchicalCodeList"))
    used = c.single_values(lists.select("ds", "dim")).select("ds", "dim", "v").distinct().join(lists, ["ds", "dim"])
    fine = used.join(_in_lists(c), ["v", "lst", "kind"], "left_semi").where(~F.col("v").startswith("_:")).select("ds", "dim", "v", "kind").distinct()
    return used.join(fine, ["ds", "dim", "v", "kind"], "left_anti").select(F.col("v").alias("value"), "lst").distinct()


def _steps(c: CubeContext) -> DataFrame:
    """(lst, pcp, dir): the parent-child properties that each hierarchical list declares, direct or inverse."""
    own = typed(c.t, qb("HierarchicalCodeList"), "lst").join(c.links(qb("parentChildProperty"), "lst", "x"), "lst")
    direct = own.where(F.col("x").startswith("<")).select("lst", F.col("x").alias("pcp"), F.lit("DIRECT").alias("dir"))
    inverse = own.where(F.col("x").startswith("_:")).join(links(c.t, INVERSE_OF, "x", "pcp"), "x").where(F.col("pcp").startswith("<"))
    return direct.unionByName(inverse.select("lst", "pcp", F.lit("INVERSE").alias("dir"))).distinct()


def _reached(c: CubeContext, pairs: DataFrame) -> DataFrame:
    """(lst, pcp, dir, v): what is reached from a list's roots; ``pairs``: lst, pcp, dir. All lists advance together."""
    roots = c.links(qb("hierarchyRoot"), "lst", "v")
    pcps = saved(pairs.select("pcp", "dir").distinct(), "parent-child")
    e = having(c.t, pcps.select(F.col("pcp").alias("p"))).where(F.col("o_kind") != "literal").join(pcps, F.col("p") == F.col("pcp"))
    down = F.col("dir") == "DIRECT"
    e = e.select("pcp", "dir", F.when(down, F.col("s")).otherwise(F.col("o")).alias("a"), F.when(down, F.col("o")).otherwise(F.col("s")).alias("b"))
    return closure(roots.join(pairs, "lst").select("lst", "pcp", "dir", "v"), e, keys=("lst", "pcp", "dir"))


def _hierarchy(c: CubeContext, direction: str) -> DataFrame:
    lists = _code_lists(c).where(F.col("kind") == qb("HierarchicalCodeList"))
    pcps = _steps(c).select("pcp", "dir").distinct().where(F.col("dir") == direction)
    # every property found in the graph counts for every hierarchical list; both sides are parts of the schema
    pairs = lists.select("lst").distinct().join(pcps)
    used = c.dim_values(lists.select("ds", "dim")).select("ds", "dim", "v").distinct().join(lists, ["ds", "dim"]).select("v", "lst").distinct()
    wanted = used.join(pairs, "lst")
    return wanted.join(_reached(c, pairs), ["lst", "pcp", "dir", "v"], "left_anti").select("v", "lst").distinct()


def ic20(c: CubeContext) -> DataFrame:
    """Values that a parent-child property doesn't connect to a root of their hierarchy: v, lst."""
    return _hierarchy(c, "DIRECT")


def ic21(c: CubeContext) -> DataFrame:
    """As ic20, against the direction of the properties that are declared by their inverse: v, lst."""
    return _hierarchy(c, "INVERSE")


def _hierarchy_setwise(c: CubeContext, direction: str) -> DataFrame:
    lists = _code_lists(c).where(F.col("kind") == qb("HierarchicalCodeList"))
    own = _steps(c).where(F.col("dir") == direction)
    # a list without a property in this direction holds its roots only
    roots = c.links(qb("hierarchyRoot"), "lst", "v").join(own, "lst", "left_anti")
    hit = _reached(c, own).select("lst", "v").unionByName(roots).distinct()
    used = c.single_values(lists.select("ds", "dim")).select("ds", "dim", "v").distinct().join(lists, ["ds", "dim"])
    fine = used.join(hit, ["lst", "v"], "left_semi").select("ds", "dim", "v").distinct()
    return used.join(fine, ["ds", "dim", "v"], "left_anti").select("v", "lst").distinct()


def ic20_setwise(c: CubeContext) -> DataFrame:
    """Values, of dimensions with one value, that no hierarchy of the dimension reaches by its own properties: v, lst."""
    return _hierarchy_setwise(c, "DIRECT")


def ic21_setwise(c: CubeContext) -> DataFrame:
    """As ic20_setwise, by inverse properties: v, lst."""
    return _hierarchy_setwise(c, "INVERSE")


STANDARD: dict[int, Callable[[CubeContext], DataFrame]] = {
    k: f for k, f in enumerate((ic1, ic2, ic3, ic4, ic5, ic6, ic7, ic8, ic9, ic10, ic11, ic12, ic13, ic14, ic15, ic16, ic17, ic18, ic19, ic20, ic21), 1)
}
SETWISE = STANDARD | {
    12: ic12_setwise, 14: ic14_setwise, 15: ic15_setwise, 16: ic16_setwise, 17: ic17_setwise, 19: ic19_setwise, 20: ic20_setwise, 21: ic21_setwise,
}

__all__ = ["SETWISE", "STANDARD", *[f"ic{k}" for k in range(1, 22)]]

"""Observations at the same point of a cube, by hashing instead of comparing pairs.

An observation is *full* if it has just one value for each dimension asked for. Full observations of a dataset are at
the same point if and only if their sorted (dimension, value) lists are equal, so grouping decides. The others agree with
an observation if their values are equal in all dimensions that both have. Which dimensions those are depends on the two
observations' *patterns* only (the dimensions present, and which have several values), and patterns are few: for each
pair of patterns the observations meet on the values of all common dimensions at once.

What it is for two values to agree is one of two things. For constraint 12 they have to be equal. For constraint 17 they must
not be different, and SPARQL's ``!=`` knows a third case: a literal of an unknown datatype can't be compared with another
literal, nor a time with a zone with one without. So an entry of a list has a *mode*, and patterns have the modes: 0 is compared by key; 1 (several
values, or NaN, which is different from itself) agrees with nothing comparable; 2 (unknown datatype) agrees with any literal; 3 and 4
(times with and without a zone) agree with each other, and by key with their like.

Observations with equal lists are one *class*. What is counted is counted by class: weights are added by class before
anything meets, and a class's total goes back to its members by a join in which the classes that hold a large part of the
rows are broadcast, so a point with half of all observations is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.functions.terms import LOCAL, NAN_KEY, ZONED, unknown_key
from cubeloom.operators.graph import BROADCAST_ROWS, dealt, small
from cubeloom.plans.context import CubeContext
from cubeloom.sources.store import saved

#: A class with more than one in so many of the rows is hot; there are fewer such classes than this.
HOT_SHARE = 10_000
#: Observations of one key that meet the other side in one task; those of a key with more are dealt to several.
_LEFT = 1000

_KEY, _NEVER, _OPEN, _ZONED, _LOCAL = range(5)
_POINT = "array<struct<dim:string,key:string,mode:int,literal:boolean>>"


def _digest(parts: Column) -> Column:
    """128 bits that name an array of strings; their lengths keep them apart."""
    return F.unhex(F.md5(F.array_join(F.transform(parts, lambda x: F.concat_ws(":", F.length(x), x)), "")))


def _entry(keys: Column, by_value: bool, three_valued: bool) -> Column:
    """(key, mode, literal) of a dimension's distinct keys; literal: whether all of them are."""
    literal = F.forall(keys, lambda k: ~k.startswith("<") & ~k.startswith("_:"))
    if not three_valued:
        one = F.get(keys, F.lit(0))
        never = (F.size(keys) > 1) | (one == NAN_KEY) if by_value else F.size(keys) > 1
        return F.struct(F.when(~never, one).alias("key"), F.when(never, _NEVER).otherwise(_KEY).alias("mode"), literal.alias("literal"))

    def of(known: Column) -> Column:
        one = F.get(known, F.lit(0))
        never = (F.size(known) > 1) | ((F.size(known) < F.size(keys)) & ~literal) | (one == NAN_KEY)
        mode = F.when(F.size(known) == 0, _OPEN).when(never, _NEVER).when(one.startswith(ZONED), _ZONED).when(one.startswith(LOCAL), _LOCAL)
        return F.transform(F.array(mode.otherwise(_KEY)), lambda m: F.struct(F.when(~m.isin(_NEVER, _OPEN), one).alias("key"), m.alias("mode"), literal.alias("literal")))[0]

    return F.transform(F.array(F.filter(keys, lambda k: ~unknown_key(k))), of)[0]


def point_lists(c: CubeContext, rows: DataFrame, dims: DataFrame, *, drop_multiple: bool = False, three_valued: bool = False) -> DataFrame:
    """``rows`` of the star table by dataset, with point, complete, place and several instead of props, vals and datasets. ``dims``: ds, dim.

    point: sorted list of (dim, key, mode, literal), one for each dimension present (or, with ``drop_multiple``, with one value).
    complete: whether all dimensions are compared by key. place: the point's digest. several: whether the observation is in several
    datasets. All of it is decided within the row.
    """
    listed = c.with_list(rows, dims, "dim", how="left").withColumn("dims", F.coalesce("dims", F.array().cast("array<string>")))
    keys = lambda d: F.array_distinct(F.transform(c.values_of(d), c.key))
    found = F.transform("dims", lambda d: F.struct(d.alias("dim"), keys(d).alias("keys")))
    kept = F.filter(found, lambda x: F.size(x["keys"]) == 1 if drop_multiple else F.size(x["keys"]) > 0)
    entries = F.transform(kept, lambda x: F.struct(x["dim"].alias("dim"), _entry(x["keys"], c.value == "o_val", three_valued).alias("e")))
    point = F.transform(entries, lambda x: F.struct(x["dim"].alias("dim"), x["e"]["key"].alias("key"), x["e"]["mode"].alias("mode"), x["e"]["literal"].alias("literal")))
    out = listed.withColumn("point", point.cast(_POINT))
    full = F.size(F.filter("point", lambda x: x["mode"] == _KEY)) == F.size("dims")
    return out.withColumn("complete", full).withColumn("place", F.unhex(F.md5(F.to_json("point")))).withColumn("several", F.size("datasets") > 1).drop("props", "vals", "types", "dims", "datasets")


def classes_of(points: DataFrame, weight: str | None = None) -> DataFrame:
    """(ds, place, point, complete, first, n, weight): observations with equal points are one class, named by its first."""
    total = F.count("*") if weight is None else F.sum(weight)
    return points.groupBy("ds", "place").agg(
        F.first("point").alias("point"), F.first("complete").alias("complete"), F.min("obs").alias("first"), F.count("*").alias("n"), total.alias("weight")
    )


def to_members(points: DataFrame, values: DataFrame) -> DataFrame:
    """``points`` with the columns of ``values`` (ds, place, n: its rows, ...), n included. Both are stored tables.

    The classes with more than one in ``HOT_SHARE`` of the rows, at most that many by construction, are broadcast, so their
    members stay where they are; no class of the others is a large part of what is shuffled, in parts of a bounded number of rows.
    """
    at = ["ds", "place"]
    if values.count() <= BROADCAST_ROWS:
        return points.join(F.broadcast(values), at)
    hot = F.col("n") * HOT_SHARE > (values.agg(F.sum("n")).first()[0] or 0)
    size = points.count()
    meet = lambda rows, values: dealt(rows, size, *at).join(dealt(values, size, *at), at)
    if not values.where(hot).limit(1).count():
        return meet(points, values)
    rest = points.join(F.broadcast(values.where(hot).select(*at)), at, "left_anti")
    return points.join(F.broadcast(values.where(hot)), at).unionByName(meet(rest, values.where(~hot)))


def _sides(points: DataFrame, *, at_least: int) -> tuple[DataFrame, DataFrame]:
    """(those that aren't full, all), each with the columns of ``points`` and _pair, _key, _full.

    Two agree if and only if they are in the two sides with equal (ds, _pair, _key). ``at_least``: how many
    dimensions both must have. _full: whether that of the second side is full.
    """
    rows = points.withColumn("_pattern", F.transform("point", lambda x: F.struct(x["dim"].alias("dim"), x["mode"].alias("mode"))))
    patterns = saved(rows.select("ds", "_pattern", "complete").distinct(), "patterns")
    other = patterns.select("ds", F.col("_pattern").alias("_other"), F.col("complete").alias("_full"))
    # patterns of a dataset are a matter of its structure, not of its size
    pairs = patterns.where(~F.col("complete")).select("ds", "_pattern").join(other, "ds")
    mode_of = lambda d: F.get(F.filter("_other", lambda y: y["dim"] == d), F.lit(0))["mode"]
    both = F.transform("_pattern", lambda x: F.struct(x["dim"].alias("dim"), x["mode"].alias("a"), mode_of(x["dim"]).alias("b")))
    pairs = pairs.withColumn("_both", F.filter(both, lambda x: x["b"].isNotNull()))
    is_open = lambda x: (x["a"] == _OPEN) | (x["b"] == _OPEN)
    clash = F.exists("_both", lambda x: ~is_open(x) & ((x["a"] == _NEVER) | (x["b"] == _NEVER)))
    times = lambda x: x["a"].isin(_ZONED, _LOCAL) & x["b"].isin(_ZONED, _LOCAL) & (x["a"] != x["b"])
    compared = F.transform(F.filter("_both", lambda x: ~times(x)), lambda x: F.struct(x["dim"].alias("dim"), is_open(x).alias("open")))
    pairs = pairs.where(~clash & (F.size("_both") >= at_least)).withColumn("_common", compared).withColumn("_pair", F.md5(F.to_json(F.struct("_pattern", "_other"))))
    pairs = saved(pairs.select("ds", "_pattern", "_other", "_common", "_full", "_pair"), "pattern-pairs")
    entry = lambda d: F.get(F.filter("point", lambda p: p["dim"] == d), F.lit(0))
    said = lambda x: F.when(x["open"], entry(x["dim"])["literal"].cast("string")).otherwise(entry(x["dim"])["key"])
    key = _digest(F.transform("_common", said)).alias("_key")
    own = [*points.columns, "_pair", key, "_full"]
    left = rows.where(~F.col("complete")).join(pairs, ["ds", "_pattern"]).select(*own)
    right = rows.join(pairs.drop("_pattern").withColumnRenamed("_other", "_pattern"), ["ds", "_pattern"]).select(*own)
    return left, right


def _twice() -> Column:
    return (F.col("_several1") & F.col("_several2")).alias("twice")


def duplicates(points: DataFrame, *, pairs: bool = True) -> DataFrame:
    """Full observations that share their point with others: (obs1, obs2, twice), or (obs, ds, group_size) without pairs.

    twice: whether both are in several datasets, so that the pair may be found in each.

    ``points`` is a stored table. Only members of classes with several go on.
    """
    full = points.where(F.col("complete") & (F.size("point") > 0))
    groups = saved(full.groupBy("ds", "place").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    members = to_members(full.select("ds", "place", "obs", "several"), groups)
    if not pairs:
        return members.select("obs", "ds", F.col("n").alias("group_size"))
    members = saved(members.select("ds", "place", "obs", "several", "n"), "members")
    parts = F.ceil(F.col("n") / _LEFT).cast("int")
    a = members.select("ds", "place", F.pmod(F.xxhash64("obs"), parts).cast("int").alias("_part"), F.col("obs").alias("obs1"), F.col("several").alias("_several1"))
    b = members.select("ds", "place", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.col("obs").alias("obs2"), F.col("several").alias("_several2"))
    return a.join(b, ["ds", "place", "_part"]).where(F.col("obs1") != F.col("obs2")).select("obs1", "obs2", _twice())


def partial_duplicates(points: DataFrame) -> DataFrame:
    """Pairs with an observation that isn't full, which agree in all dimensions that both have, one at least: (obs1, obs2, twice)."""
    left, right = _sides(points, at_least=1)
    at = ["ds", "_pair", "_key"]
    a = left.select(*at, F.col("obs").alias("obs1"), F.col("several").alias("_several1"))
    b = right.select(*at, F.col("obs").alias("obs2"), F.col("several").alias("_several2"), "_full")
    hot = saved(a.groupBy(*at).agg(F.ceil(F.count("*") / _LEFT).cast("int").alias("_parts")).where("_parts > 1"), "hot")
    if hot.isEmpty():
        met = a.join(b, at)
    else:  # each part of a hot key's first side meets the whole second side
        hot, parts = small(hot), F.coalesce("_parts", F.lit(1))
        a = a.join(hot, at, "left").withColumn("_part", F.pmod(F.xxhash64("obs1"), parts).cast("int")).drop("_parts")
        b = b.join(hot, at, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        met = a.join(b, [*at, "_part"])
    one = lambda x, y: F.struct(F.col(x).alias("obs1"), F.col(y).alias("obs2"))
    both = F.when(F.col("_full"), F.array(one("obs1", "obs2"), one("obs2", "obs1"))).otherwise(F.array(one("obs1", "obs2")))
    return met.where(F.col("obs1") != F.col("obs2")).select(F.explode(both).alias("x"), _twice()).select("x.obs1", "x.obs2", "twice")


def pairs_once(points: DataFrame) -> DataFrame:
    """(obs1, obs2): the pairs of ``duplicates`` and ``partial_duplicates``, each once. ``points`` is a stored table.

    Within a dataset no pair is found twice, so only pairs of observations that are both in several datasets are made distinct; the
    others, however many, aren't shuffled.
    """
    of = lambda rows, test: duplicates(rows).unionByName(partial_duplicates(rows)).where(test).select("obs1", "obs2")
    several = points.where("several")
    if several.isEmpty():
        return of(points, F.lit(True))
    return of(points, ~F.col("twice")).unionByName(of(several, F.col("twice")).distinct())


def _met_weight(classes: DataFrame, *, at_least: int) -> DataFrame:
    """(ds, place, total): the weights of the classes that a class agrees with, one of the two at least not full. A class that agrees with itself is one of them."""
    left, right = _sides(classes, at_least=at_least)
    at = ["ds", "_pair", "_key"]
    sums = lambda side: side.groupBy(*at).agg(F.sum("weight").alias("total"))
    own = left.select(*at, "place").join(sums(right), at)
    theirs = right.where("_full").select(*at, "place").join(sums(left), at)
    both = own.select("ds", "place", "total").unionByName(theirs.select("ds", "place", "total"))
    return both.groupBy("ds", "place").agg(F.sum("total").alias("total"))


def same_point_weight(points: DataFrame) -> DataFrame:
    """``points`` with total: the weights of all observations of the dataset that clash with it nowhere; its own is one of them unless it clashes with itself.

    ``points``, a stored table, has a column weight. Observations that nothing is added for, not even themselves, are left out.
    """
    if points.where(~F.col("complete")).isEmpty():  # only equal points meet, so classes are their places and sums
        return to_members(points, saved(points.groupBy("ds", "place").agg(F.count("*").alias("n"), F.sum("weight").alias("total")), "totals")).drop("n")
    classes = saved(classes_of(points, "weight"), "classes")
    full = classes.where("complete").select("ds", "place", F.col("weight").alias("total"))
    totals = full.unionByName(_met_weight(classes, at_least=0)).groupBy("ds", "place").agg(F.sum("total").alias("total"))
    values = saved(classes.select("ds", "place", "n").join(totals, ["ds", "place"]), "totals")
    return to_members(points, values).drop("n")


def class_links(points: DataFrame) -> DataFrame:
    """(obs, ds, class_id, class_size, n_links) of every observation: what the pairs of ``duplicates`` and ``partial_duplicates`` say, in as many rows as observations.

    class_id: the first observation with an equal point; n_links: in how many pairs the observation is the first one.
    """
    classes = saved(classes_of(points), "classes")
    met = _met_weight(classes, at_least=1)
    some = F.size("point") > 0
    itself = F.when(F.col("complete"), F.when(some, F.col("n") - 1).otherwise(F.lit(0))).otherwise(-F.when(some & ~F.exists("point", lambda x: x["mode"] == _NEVER), F.lit(1)).otherwise(F.lit(0)))
    values = classes.join(met, ["ds", "place"], "left").select(
        "ds", "place", "n", F.col("first").alias("class_id"), (itself + F.coalesce("total", F.lit(0))).cast("long").alias("n_links")
    )
    out = to_members(points.select("ds", "place", "obs"), saved(values, "class-links"))
    return out.select("obs", "ds", "class_id", F.col("n").alias("class_size"), "n_links")

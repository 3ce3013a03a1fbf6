"""Shapes that tell plans apart: deep chains, hot points, many partial observations; and values that can't be compared."""

import logging
import random
import re
from collections import Counter, defaultdict
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom import queries
from cubeloom.functions.terms import triples
from cubeloom.functions.vocab import TYPE, qb
from cubeloom.operators import graph as op
from cubeloom.plans import constraints, points
from cubeloom.plans import normalize as normalization
from cubeloom.plans.context import CubeContext, star_table
from cubeloom.plans.normalize import normalize
from cubeloom.sources import tables
from cubeloom.sources.store import saved, stored
from cubeloom.sources.tables import structure


def closed(spark, edges, seeds, keys=()):
    steps = spark.createDataFrame(edges, "a string, b string")
    start = spark.createDataFrame(seeds, "k string, v string")
    return {(r["k"], r["v"]) for r in op.closure(start, steps, keys=("k",)).collect()}


def reached(edges, seeds):
    after = defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = set()
    for k, v in seeds:
        seen, todo = {v}, [v]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out |= {(k, x) for x in seen}
    return out


def test_closure_of_a_deep_chain(spark, caplog):
    edges = [(f"n{k}", f"n{k + 1}") for k in range(10_000)]
    with caplog.at_level(logging.INFO, "cubeloom"):
        got = closed(spark, edges, [("x", "n0"), ("y", "n9990")])
    assert got == {("x", f"n{k}") for k in range(10_001)} | {("y", f"n{k}") for k in range(9990, 10_001)}
    assert int(re.search(r"closure: (\d+) rounds", caplog.text)[1]) <= 20


@pytest.mark.parametrize("seed", range(6))
def test_closure_of_random_graphs(spark, seed, monkeypatch):
    """Sparse ones jump, dense ones stop jumping; cycles and nodes without steps are in."""
    rng = random.Random(seed)
    n, m = [(40, 44), (60, 60), (12, 60), (50, 49), (30, 200), (80, 82)][seed]
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [(f"n{k}", f"n{k + 1}") for k in range(0, n - 1) if seed % 2]
    seeds = [(k, f"n{rng.randrange(n)}") for k in "xyz"] + [("x", "alone")]
    monkeypatch.setattr(op, "_SINGLE", rng.choice([3, 3, 5]))
    assert closed(spark, edges, seeds) == reached(edges, seeds)
    assert closed(spark, [("a", "a")], [("x", "a")]) == {("x", "a")} and closed(spark, [("a", "b")], []) == set()


DIMS = [f"<urn:d{k}>" for k in range(4)]


def cube_of(spark, rows, by_value=True):
    """``rows``: (observation, {dimension: values})."""
    schema = structure("<urn:dsd>", dimensions=DIMS, measures=["<urn:m>"]) + [("<urn:ds>", qb("structure"), "<urn:dsd>")]
    facts = [(o, qb("dataSet"), "<urn:ds>") for o, _ in rows] + [(o, d, v) for o, values in rows for d, vs in values.items() for v in vs]
    t = triples(spark.createDataFrame(schema + facts, "s string, p string, o string"))
    return CubeContext(normalize(stored(t)), by_value=by_value)


def partial(seed, n=60):
    rng = random.Random(seed)
    return [(f"<urn:o{k}>", {d: rng.sample(['"1"', '"2"'], rng.choice([0, 1, 1, 1, 2])) for d in DIMS[: rng.choice([2, 4, 4])]}) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_classes_say_what_the_pairs_say(spark, seed):
    c = cube_of(spark, partial(seed))
    pairs = Counter(r["obs1"] for r in constraints.ic12(c).collect())
    rows = {r["obs"]: r for r in constraints.ic12_classes(c).collect()}
    assert len(rows) == 60 and {o: r["n_links"] for o, r in rows.items() if r["n_links"]} == dict(pairs)
    equal = defaultdict(list)
    for o, values in partial(seed):
        equal[tuple(sorted((d, tuple(sorted(v)) if len(v) == 1 else None) for d, v in values.items() if v))].append(o)
    for same in equal.values():
        assert {(rows[o]["class_id"], rows[o]["class_size"]) for o in same} == {(min(same), len(same))}


def test_a_hot_point_is_spread(spark):
    """Half of all observations at one point: its members get their class's total where they are."""
    rows = [(f"<urn:o{k}>", {d: ['"1"'] if k % 2 else [f'"{k}"'] for d in DIMS}) for k in range(4000)]
    c = cube_of(spark, rows)
    found = saved(constraints.points(c).repartition(8), "points")
    classes = saved(points.classes_of(found), "classes")
    out = points.to_members(found, classes.select("ds", "place", "n"))
    spread = [n for (n,) in out.where("n > 1").groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert sum(spread) == 2000 and len(spread) >= 4 and max(spread) <= 2 * sorted(spread)[len(spread) // 2]
    assert {r["group_size"] for r in constraints.ic12_groups(c).collect()} == {2000}
    assert all("Window" not in rule(c)._jdf.queryExecution().executedPlan().toString() for rule in (constraints.ic12_groups, constraints.ic12_setwise, constraints.ic17))


def test_types_of_observations_only(spark):
    """A subject with values of dimensions that is no observation is in no star."""
    c = cube_of(spark, [("<urn:o>", {DIMS[0]: ['"1"']})])
    extra = triples(spark.createDataFrame([("<urn:slice>", DIMS[0], '"1"'), ("<urn:typed>", TYPE, qb("Observation"))], "s string, p string, o string"))
    c = CubeContext(c.t.unionByName(extra))
    assert {(r["obs"], r["typed"], tuple(r["datasets"])) for r in c.star.collect()} == {("<urn:o>", True, ("<urn:ds>",)), ("<urn:typed>", True, ())}
    assert [(r["obs"], r["values"]) for r in constraints.ic1(c).collect()] == [("<urn:typed>", [])]


def test_a_large_schema_is_broadcast_by_what_is_used(spark, monkeypatch):
    """Names that are no predicate of the graph don't make a hot predicate's triples meet in one task."""
    monkeypatch.setattr(op, "BROADCAST_ROWS", 2)
    t = triples(spark.createDataFrame([(f"<urn:s{k}>", "<urn:hot>", f'"{k}"') for k in range(50)] + [("<urn:s1>", "<urn:other>", '"1"')], "s string, p string, o string"))
    names = spark.createDataFrame([(f"<urn:p{k}>",) for k in range(20)] + [("<urn:hot>",)], "p string")
    found = op.having(t, names)
    assert found.count() == 50 and "strategy=broadcast" in found._jdf.queryExecution().optimizedPlan().toString()


def test_types_of_observations_need_not_be_stated(spark):
    rows = [(f"<urn:o{k}>", {DIMS[0]: [f'"{k}"']}) for k in range(5)]
    schema = structure("<urn:dsd>", dimensions=DIMS[:1], measures=["<urn:m>"]) + [("<urn:ds>", qb("structure"), "<urn:dsd>"), ("<urn:slice>", qb("observation"), "<urn:alone>"), ("<urn:slice>", qb("observation"), '"no"')]
    facts = [(o, qb("dataSet"), "<urn:ds>") for o, _ in rows] + [(o, d, v) for o, values in rows for d, vs in values.items() for v in vs]
    t = stored(triples(spark.createDataFrame(schema + facts, "s string, p string, o string")))
    without = normalize(t, observations=False)
    assert without.where(F.col("o") == qb("Observation")).isEmpty() and without.where(F.col("o") == qb("DataSet")).count() == 1
    stars = [{(r["obs"], r["typed"], tuple(r["datasets"]), tuple(r["props"])) for r in c.star.collect()} for c in (CubeContext(normalize(t)), CubeContext(without, stated=False))]
    assert stars[0] == stars[1] and len(stars[0]) == 6


@pytest.mark.parametrize("seed", range(2))
def test_pairs_arent_shuffled(spark, seed, monkeypatch):
    """Each pair once, however many datasets name both of its observations; keys of many observations are dealt to parts."""
    monkeypatch.setattr(points, "_LEFT", 3)
    rows = partial(seed)
    c = cube_of(spark, rows)
    out = constraints.ic12(c)
    assert "obs1" not in " ".join(re.findall(r"hashpartitioning\([^)]*\)", out._jdf.queryExecution().executedPlan().toString()))
    one = Counter((r["obs1"], r["obs2"]) for r in out.collect())
    known = {o: {d: v for d, v in values.items() if v} for o, values in rows}
    agree = lambda a, b: (common := set(a) & set(b)) and all(len(a[d]) == len(b[d]) == 1 and a[d] == b[d] for d in common)
    assert one and one == Counter((a, b) for a in known for b in known if a != b and agree(known[a], known[b]))
    more = [(f"<urn:o{k}>", qb("dataSet"), "<urn:other>") for k in range(0, 60, 2)] + [("<urn:other>", qb("structure"), "<urn:dsd>")]
    both = normalize(stored(c.t.unionByName(triples(spark.createDataFrame(more, "s string, p string, o string")))))
    assert Counter((r["obs1"], r["obs2"]) for r in constraints.ic12(CubeContext(both)).collect()) == one


def test_tables_are_written_by_small_tasks(spark, tmp_path):
    """A table is read and written in parts of a few MB where Spark's settings would make one task of it; these are as before afterwards."""
    settings = {"spark.sql.files.minPartitionNum": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 600_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 512).alias("s"))
        rows.write.option("parquet.block.size", 1 << 20).parquet(f"{tmp_path}/rows")
        before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}
        t = spark.read.parquet(f"{tmp_path}/rows")
        assert len(saved(t, "scanned").inputFiles()) >= 4
        assert len(saved(t.groupBy("s").agg(F.count("*").alias("n")), "dealt").inputFiles()) >= 4
        assert before == {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql")}
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_members_meet_their_classes_in_parts_of_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(points, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(points, "HOT_SHARE", 10)
    monkeypatch.setattr(op, "_DEALT_ROWS", 50)
    c = cube_of(spark, [(f"<urn:o{k}>", {d: [f'"{k // 2}"'] for d in DIMS}) for k in range(400)])
    found = saved(constraints.points(c), "points")
    out = points.to_members(found, saved(points.classes_of(found), "classes").select("ds", "place", "n"))
    assert len(re.findall(r"place#\d+, 8\), REPARTITION_BY_NUM", out._jdf.queryExecution().executedPlan().toString())) == 2
    assert Counter(r["n"] for r in out.select("n").collect()) == {2: 400}


def test_a_graph_dealt_by_subject_is_grouped_where_it_lies(spark):
    """The star table of lines shuffles nothing, unless something was added to an observation; it is that of the same graph in any order."""
    graph, *added = queries.context(queries.lines, spark, "/root/testdata/sf0.001").parts
    more = stored(triples(spark.createDataFrame([(graph.where(F.col("p") == qb("dataSet")).first()["s"], "<urn:dim:line>", '"x"')], "s string, p string, o string")))
    for parts, moves in (((graph, *added), False), ((graph, *added, more), True)):
        out = star_table(*parts, stated=False)
        assert ("hashpartitioning(" in out._jdf.queryExecution().executedPlan().toString()) is moves
        same = star_table(stored(reduce(DataFrame.unionByName, parts).repartition(3)), stated=False)
        assert out.count() == same.count() > 10_000 and out.exceptAll(same).isEmpty()


def test_equal_points_meet_by_hash(spark, monkeypatch):
    """Where all points are complete, ic17 sorts nothing to find classes, and observations of one dataset aren't dealt again; two datasets and two structures count as before."""
    kept = {}
    monkeypatch.setattr(points, "saved", lambda rows, name: kept.update({name: rows}) or saved(rows, name))
    schema = [row for k in range(2) for row in structure(f"<urn:dsd{k}>", dimensions=["<urn:d>", qb("measureType")], measures=["<urn:m>"])] + [("<urn:ds>", qb("structure"), f"<urn:dsd{k}>") for k in range(2)]
    facts = [(f"<urn:o{k}>", p, o) for k in range(5) for p, o in ((qb("dataSet"), "<urn:ds>"), ("<urn:d>", f'"{k // 2}"'), (qb("measureType"), "<urn:m>"))]
    of = lambda rows: CubeContext(normalize(stored(triples(spark.createDataFrame(rows, "s string, p string, o string")))))
    out = constraints.ic17(of(schema + facts))
    assert set(kept) == {"totals"} and "SortAggregate" not in kept["totals"]._jdf.queryExecution().executedPlan().toString()
    assert "obs" not in " ".join(re.findall(r"hashpartitioning\([^)]*\)", out._jdf.queryExecution().executedPlan().toString()))
    assert {tuple(r) for r in out.collect()} == {(f"<urn:o{k}>", 1, 4) for k in range(4)} | {("<urn:o4>", 1, 2)}
    both = schema + facts + [("<urn:o4>", qb("dataSet"), "<urn:other>"), ("<urn:other>", qb("structure"), "<urn:dsd0>")]
    assert {tuple(r) for r in constraints.ic17(of(both)).collect()} == {(f"<urn:o{k}>", 1, 4) for k in range(4)} | {("<urn:o4>", 1, 3)}


def test_lines_are_a_view_of_their_table(spark, tmp_path):
    """Neither triples nor stars of a mapped table are stored or grouped; both are those of the triples, also where rows are there twice or lack values."""
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(600)
    rows.unionByName(rows.limit(100)).write.parquet(f"{tmp_path}/plain/lineitem.parquet")
    rows.withColumn("l_suppkey", F.when(F.col("l_linenumber") != 1, F.col("l_suppkey"))).write.parquet(f"{tmp_path}/nulls/lineitem.parquet")
    for cube in (queries.lines, queries.line_points):
        graph = cube(spark, f"{tmp_path}/plain")
        rest, mapped = tables.of_view(graph)
        x = mapped[0].rows.unionByName(mapped[0].rows.limit(50))
        made = [tables.facts_once(x if k == 0 else x.where("l_partkey % 10 <> 0"), m.subject, m.properties) for k, m in enumerate(mapped)]
        same = tables.graph(rest.select("s", "p", "o"), apart=made)
        assert graph.count() == same.count() > 2000 and graph.exceptAll(same).isEmpty()
        out, grouped = star_table(graph, stated=False), star_table(stored(same), stated=False)
        assert not re.search("Aggregate|Exchange", out._jdf.queryExecution().executedPlan().toString())
        assert out.columns == grouped.columns and out.count() == grouped.count() and out.exceptAll(grouped).isEmpty()
        one = CubeContext(graph, stated=False).stars(["<urn:dim:line>", "<urn:dim:order>"])
        assert {p for r in one.collect() for p in r["props"]} <= {"<urn:dim:line>", "<urn:dim:order>"} and one.count() == out.count()
        assert tables.of_view(cube(spark, f"{tmp_path}/nulls")) is None


def test_a_stored_graph_keeps_value_keys(spark):
    """They are written where they aren't the object, and there for all when read."""
    t = triples(spark.createDataFrame([("<urn:s>", "<urn:p>", o) for o in ("<urn:o>", '"01"^^<http://www.w3.org/2001/XMLSchema#integer>', '"a"@en')], "s string, p string, o string"))
    out = stored(t)
    assert out.exceptAll(t).isEmpty() and out.count() == 3 and out.columns == t.columns
    assert [r["o"][:3] for r in spark.read.parquet(*out.inputFiles()).where("o_val is not null").collect()] == ['"01']


def test_slices_of_a_dataset_dont_meet_in_one_task(spark, monkeypatch):
    """What slices are asked for is broadcast, however many structures of other datasets there are."""
    kept = {}
    monkeypatch.setattr(normalization, "saved", lambda rows, name: kept.update({name: (out := saved(rows, name))}) or out)
    schema = [row for k in range(30) for row in structure(f"<urn:dsd{k}>", dimensions=["<urn:d>"]) + [(f"<urn:ds{k}>", qb("structure"), f"<urn:dsd{k}>")]]
    facts = [("<urn:ds0>", qb("slice"), f"<urn:slice{k}>") for k in range(5)] + [(f"<urn:slice{k}>", p, o) for k in range(5) for p, o in ((qb("observation"), f"<urn:o{k}>"), ("<urn:d>", f'"{k}"'))]
    t = normalize(stored(triples(spark.createDataFrame(schema + facts, "s string, p string, o string"))), phases=(1,))
    assert {(r["s"], r["p"], r["o"]) for r in normalization.attached(t).collect()} == {(f"<urn:o{k}>", "<urn:d>", f'"{k}"') for k in range(5)}
    assert [(r["ds"], r["p"]) for r in kept["wanted"].collect()] == [("<urn:ds0>", "<urn:d>")]


def test_phase_2_reads_what_phase_1_found(spark):
    """What phase 1 adds is stored, and not made again wherever phase 2 reads the graph."""
    out = queries.norm_phase2(spark, "/root/testdata/sf0.001")
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 1

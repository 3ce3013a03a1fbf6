"""The constraint queries over cubes mapped from the relational tables, and their oracle SQL.

Two cubes. *Sales*: an order is an observation; its dimensions are customer, date, status (coded by a scheme and a
collection) and place (the customer's nation, coded by hierarchies); customers are slices. *Lines*: each line of an
order has an observation for its quantity and one for its price, told apart by the measure dimension. Faults are
planted by remainders of keys, so that the oracle can name the violations from the tables alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions.terms import iri, literal, triples
from cubeloom.functions.vocab import INVERSE_OF, RANGE, TYPE, qb, skos
from cubeloom.operators import graph as op
from cubeloom.plans import constraints
from cubeloom.plans.context import CubeContext
from cubeloom.plans.normalize import attached, implied, lacking, normalize
from cubeloom.sources.rdf import nameable, read_graph, write_graph
from cubeloom.sources.store import saved, shared_dir, stored
from cubeloom.sources.tables import Mapped, constants, facts, facts_once, graph, of_view, parts_of, rows_once, structure, view

_DS, _DSD, _KEY = "<urn:ds:{}>", "<urn:dsd:sales>", "<urn:key:customer>"
_DIMS = {k: f"<urn:dim:{k}>" for k in ("customer", "date", "status", "place")}
_PRICE, _PRIORITY, _CURRENCY = "<urn:measure:price>", "<urn:attribute:priority>", "<urn:attribute:currency>"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _drop(column, key: str, mod: int):
    """The column, but null where the key is a multiple."""
    return F.when(F.col(key) % mod != 0, column)


def sales_schema() -> list[tuple[str, str, str]]:
    concept, scheme = skos("Concept"), "<urn:codes:status>"
    rows = structure(
        _DSD, dimensions=_DIMS.values(), measures=[_PRICE], attributes=[_PRIORITY, _CURRENCY],
        required=[_PRIORITY], optional=[_DIMS["place"], _CURRENCY], attachment={_CURRENCY: "DataSet", _DIMS["customer"]: "Slice"},
    )
    rows += structure("<urn:dsd:nomeasure>", dimensions=[_DIMS["date"]])
    rows += [(_DS.format(k), qb("structure"), _DSD) for k in range(3)] + [(_DS.format(k), _CURRENCY, '"EUR"') for k in range(3)]
    rows += [("<urn:ds:none>", TYPE, qb("DataSet")), ("<urn:ds:two>", TYPE, qb("DataSet"))]
    rows += [("<urn:ds:two>", qb("structure"), d) for d in (_DSD, "<urn:dsd:nomeasure>")]
    rows += [(_DIMS["customer"], RANGE, "<urn:Customer>"), (_DIMS["status"], RANGE, concept), (_DIMS["place"], RANGE, concept)]
    rows += [("<urn:dim:uncoded>", TYPE, qb("DimensionProperty")), ("<urn:dim:uncoded>", RANGE, concept)]
    rows += [(_DSD, qb("sliceKey"), _KEY), (_KEY, TYPE, qb("SliceKey")), (_KEY, qb("componentProperty"), _DIMS["customer"])]
    rows += [(_KEY, qb("componentProperty"), "<urn:dim:unknown>"), ("<urn:key:lost>", TYPE, qb("SliceKey"))]
    rows += [(_DIMS["status"], qb("codeList"), scheme), (scheme, TYPE, skos("ConceptScheme"))]
    rows += [(f"<urn:status:{k}>", TYPE, concept) for k in "FOP"] + [(f"<urn:status:{k}>", skos("inScheme"), scheme) for k in "FO"]
    collection = "<urn:codes:collection>"
    rows += [(_DIMS["status"], qb("codeList"), collection), (collection, TYPE, skos("Collection")), (collection, skos("member"), "<urn:codes:inner>")]
    rows += [("<urn:codes:inner>", skos("member"), x) for x in ("<urn:status:O>", "<urn:status:P>", collection)]
    for name in ("geo", "back"):
        lst = f"<urn:codes:{name}>"
        rows += [(_DIMS["place"], qb("codeList"), lst), (lst, TYPE, qb("HierarchicalCodeList"))]
        rows += [(lst, qb("hierarchyRoot"), f"<urn:region:{r}>") for r in range(3)]
    rows += [("<urn:codes:geo>", qb("parentChildProperty"), "<urn:narrower>"), ("<urn:codes:back>", qb("parentChildProperty"), "_:inverse"), ("_:inverse", INVERSE_OF, "<urn:broader>")]
    return rows


def _supplier_schemas(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """A dataset, a structure and a slice key for each supplier, without observations, with faults by remainders of its key."""
    k = F.col("s_suppkey")
    of = lambda name: iri(f"urn:{name}:s", k)
    drop = lambda column, mod: _drop(column, "s_suppkey", mod)
    only = lambda column, mod: F.when(k % mod == 0, column)
    node = lambda name: F.concat(F.lit(f"_:supplier-{name}"), k.cast("string"))
    parts = [
        (of("ds"), {TYPE: F.lit(qb("DataSet")), qb("structure"): [drop(of("dsd"), 7), only(F.lit("<urn:dsd:nomeasure>"), 5)]}),
        (of("dsd"), {TYPE: F.lit(qb("DataStructureDefinition")), qb("component"): [node("d"), drop(node("m"), 3)], qb("sliceKey"): drop(of("key"), 6)}),
        (node("d"), {qb("dimension"): of("dim"), qb("componentRequired"): only(F.lit('"false"^^<http://www.w3.org/2001/XMLSchema#boolean>'), 4)}),
        (node("m"), {qb("measure"): drop(of("measure"), 3)}),
        (of("dim"), {RANGE: drop(F.lit(skos("Concept")), 8), qb("codeList"): drop(of("list"), 9)}),
        (of("key"), {TYPE: F.lit(qb("SliceKey")), qb("componentProperty"): [of("dim"), only(of("other"), 11)]}),
    ]
    x = _table(spark, sf_dir, "supplier")
    return [facts(x, s, properties) for s, properties in parts]


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abbreviated graph of orders, and the suppliers' schemas."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    size = _table(spark, sf_dir, "orders").count()
    orders = _table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    key = F.col("o_orderkey")
    dataset = lambda k: F.concat(F.lit("<urn:ds:"), k.cast("string"), F.lit(">"))
    status = iri("urn:status:", F.col("o_orderstatus"))
    observations = facts_once(
        orders, iri("urn:order:", key),
        {
            qb("dataSet"): [_drop(dataset(key % 3), "o_orderkey", 101), F.when((key % 103 == 0) & (key % 101 != 0), dataset((key + 1) % 3))],
            TYPE: F.lit(qb("Observation")),
            _DIMS["customer"]: iri("urn:customer:", F.col("o_custkey")),
            _DIMS["date"]: _drop(literal(F.date_format("o_orderdate", "yyyy-MM-dd"), "date"), "o_orderkey", 97),
            _DIMS["status"]: [status, F.when(key % 89 == 0, F.lit("<urn:status:X>"))],
            _DIMS["place"]: iri("urn:nation:", F.col("c_nationkey")),
            _PRICE: _drop(literal(F.round(F.col("o_totalprice") * 100).cast("long"), "integer"), "o_orderkey", 53),
            _PRIORITY: _drop(literal(F.col("o_orderpriority")), "o_orderkey", 59),
        },
        size=size,
    )
    member = facts(_table(spark, sf_dir, "orders"), iri("urn:slice:", F.col("o_custkey")), {qb("observation"): iri("urn:order:", key)})
    c = F.col("c_custkey")
    slices = facts(
        customers, iri("urn:slice:", c),
        {
            TYPE: F.lit(qb("Slice")),
            qb("sliceStructure"): [_drop(F.lit(_KEY), "c_custkey", 11), F.when(c % 13 == 0, F.lit("<urn:key:lost>"))],
            _DIMS["customer"]: _drop(iri("urn:customer:", c), "c_custkey", 17),
            "<urn:dim:unknown>": _drop(F.lit("<urn:any>"), "c_custkey", 19),
        },
    )
    of = customers.select(F.lit(_DS.format(0)).alias("s"), F.lit(qb("slice")).alias("p"), iri("urn:slice:", c).alias("o"))
    n = _table(spark, sf_dir, "nation")
    nation, region = iri("urn:nation:", F.col("n_nationkey")), iri("urn:region:", F.col("n_regionkey"))
    down = n.select(region.alias("s"), F.lit("<urn:narrower>").alias("p"), nation.alias("o"))
    up = n.where("n_nationkey % 2 = 0").select(nation.alias("s"), F.lit("<urn:broader>").alias("p"), region.alias("o"))
    return graph(constants(spark, sales_schema()), member, slices, of, down, up, *_supplier_schemas(spark, sf_dir), apart=[observations])


_LINES_DSD, _QUANTITY = "<urn:dsd:lines>", "<urn:measure:quantity>"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the measure-dimension cube; one observation for each line and measure. Prices of parts divisible by 10 lack."""
    x = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("e")
    )
    line = lambda tail: iri(f"urn:{tail}:", *[F.col(k) for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", "e")])
    dims = {qb("dataSet"): F.lit("<urn:ds:lines>"), "<urn:dim:line>": line("line")}
    quantity = dims | {
        qb("measureType"): [F.lit(_QUANTITY), F.when(F.col("l_partkey") % 31 == 0, F.lit(_PRICE))],
        _QUANTITY: _drop(literal(F.col("q"), "integer"), "l_partkey", 23),
        _PRICE: F.when(F.col("l_partkey") % 29 == 0, literal(F.col("e"), "integer")),
    }
    price = dims | {qb("measureType"): F.lit(_PRICE), _PRICE: literal(F.col("e"), "integer")}
    schema = structure(_LINES_DSD, dimensions=["<urn:dim:line>", qb("measureType")], measures=[_QUANTITY, _PRICE])
    schema = constants(spark, [*schema, ("<urn:ds:lines>", qb("structure"), _LINES_DSD)])
    of = lambda rows: [(rows, line("quantity"), quantity), (rows.where("l_partkey % 10 <> 0"), line("price"), price)]
    rows = rows_once(x)
    if rows is not None:
        return view(stored(triples(schema)), *[Mapped(*mapping) for mapping in of(rows)])
    size = x.count()
    return graph(schema, apart=[facts_once(*mapping, size=size) for mapping in of(x)])


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of lines as observations with the dimensions order and line number, the second missing for orders divisible by 7."""
    x = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("e")
    )
    subject = iri("urn:line:", *[F.col(k) for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", "e")])
    number = _drop(literal(F.col("l_linenumber"), "integer"), "l_orderkey", 7)
    properties = {qb("dataSet"): F.lit("<urn:ds:points>"), "<urn:dim:order>": iri("urn:order:", F.col("l_orderkey")), "<urn:dim:number>": number, _QUANTITY: literal(F.col("q"), "integer")}
    schema = structure("<urn:dsd:points>", dimensions=["<urn:dim:order>", "<urn:dim:number>"], measures=[_QUANTITY])
    schema = constants(spark, [*schema, ("<urn:ds:points>", qb("structure"), "<urn:dsd:points>")])
    rows = rows_once(x)
    if rows is not None:
        return view(stored(triples(schema)), Mapped(rows, subject, properties))
    return graph(schema, apart=[facts_once(x, subject, properties)])


Query = Callable[[SparkSession, str], DataFrame]

_kept: dict[tuple, DataFrame] = {}

#: Cubes whose observations are all dealt by subject from one table, and that table: their graphs are stored so, unless they are views.
_DEALT = {"lines": "lineitem", "line_points": "lineitem"}


def kept(name: str, make: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that several queries of a session read, stored once in the shared folder."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _kept:
        parts = parts_of(spark, _table(spark, sf_dir, _DEALT[name]).count()) if name in _DEALT else 0
        t = make(spark, sf_dir)
        _kept[key] = t if of_view(t) else stored(t, parts=parts)
    return _kept[key]


def normalized(cube: Query, spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """A cube's normalized graph but for implied types of observations: the stored graph and the stored additions of each phase."""
    parts = [kept(cube.__name__, cube, spark, sf_dir)]

    def keep(added: DataFrame) -> DataFrame:
        parts.append(stored(added))
        return parts[-1]

    normalize(parts[0], keep=keep, observations=False)
    return parts


_contexts: dict[tuple, CubeContext] = {}


def context(cube: Query, spark: SparkSession, sf_dir: str, *, by_value: bool = True) -> CubeContext:
    """A cube's context; its tables are made once, for both kinds of equality."""
    key = (spark.sparkContext.applicationId, cube.__name__, sf_dir, by_value)
    if key not in _contexts:
        like = None if by_value else context(cube, spark, sf_dir)
        parts = normalized(cube, spark, sf_dir) if like is None else like.parts
        _contexts[key] = CubeContext(*parts, by_value=by_value, stated=False, like=like)
    return _contexts[key]


def _on(cube: Query, rule: Callable[[CubeContext], DataFrame], *, by_value: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = rule(context(cube, spark, sf_dir, by_value=by_value))
        return out.withColumn("values", F.concat_ws(" ", "values")) if "values" in out.columns else out

    return run


def norm_phase1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What phase 1 adds to the sales graph, by predicate and object if that is a class."""
    t = kept("sales", sales, spark, sf_dir)
    new = implied(t).distinct().join(t.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    return new.where(F.col("p") == TYPE).groupBy("o").agg(F.count("*").alias("n"))


def norm_phase2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What phase 2 adds: values pushed down to observations."""
    t = normalize(kept("sales", sales, spark, sf_dir), phases=(1,), keep=stored, observations=False)  # no rule of phase 2 asks for types of observations
    new = lacking(t, attached(t))
    return new.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("observations"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of customers by place, with two hierarchies that have different roots: one goes down by a property, the other up by the inverse of one."""
    x = _table(spark, sf_dir, "customer")
    dim, schema = "<urn:dim:place>", structure("<urn:dsd:places>", dimensions=["<urn:dim:place>"], measures=["<urn:measure:balance>"])
    schema += [("<urn:ds:places>", qb("structure"), "<urn:dsd:places>"), (dim, RANGE, skos("Concept")), ("_:up", INVERSE_OF, "<urn:broader>")]
    for lst, pcp, roots in (("<urn:codes:down>", "<urn:narrower>", range(3)), ("<urn:codes:up>", "_:up", (3,))):
        schema += [(dim, qb("codeList"), lst), (lst, TYPE, qb("HierarchicalCodeList")), (lst, qb("parentChildProperty"), pcp)]
        schema += [(lst, qb("hierarchyRoot"), f"<urn:region:{r}>") for r in roots]
    obs = facts(
        x, iri("urn:customer:", F.col("c_custkey")),
        {qb("dataSet"): F.lit("<urn:ds:places>"), dim: iri("urn:nation:", F.col("c_nationkey")), "<urn:measure:balance>": literal(F.round(F.col("c_acctbal") * 100).cast("long"), "integer")},
    )
    n = _table(spark, sf_dir, "nation")
    nation, region = iri("urn:nation:", F.col("n_nationkey")), iri("urn:region:", F.col("n_regionkey"))
    down = n.select(region.alias("s"), F.lit("<urn:narrower>").alias("p"), nation.alias("o"))
    up = n.where("n_nationkey % 2 = 0").select(nation.alias("s"), F.lit("<urn:broader>").alias("p"), region.alias("o"))
    return graph(constants(spark, schema), obs, down, up)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' graph, written as N-Triples files and read as a stream, in two runs of which the second finds nothing new."""
    from cubeloom.streaming.ingest import append, stream_triples

    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    write_graph(kept("suppliers", suppliers, spark, sf_dir), f"{where}/in", "N-Triples")
    for _ in range(2):
        append(stream_triples(spark, f"{where}/in"), f"{where}/table", f"{where}/checkpoint").awaitTermination()
    name = lambda c: F.regexp_replace(c, "^_:b[0-9a-f]{32}n", "_:").alias(c)
    return spark.read.parquet(f"{where}/table").select(name("s"), "p", name("o"), "o_kind")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure-dimension cube of parts: an observation has its brand and, by the key, a reading of some datatype, comparable with
    others or not: NaN, an unknown datatype, times with and without a zone, numbers, a resource, or none.
    """
    x = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr("p_partkey div 8 % 3").alias("n"))
    n, xsd = F.col("n").cast("string"), "http://www.w3.org/2001/XMLSchema#"
    text = lambda body, datatype: F.concat(F.lit('"'), body, F.lit(f'"^^<{datatype}>'))
    day = F.concat(F.lit("2020-01-0"), (F.col("n") + 1).cast("string"), F.lit("T00:00:00"))
    kinds = [
        text(F.lit("NaN"), xsd + "double"), text(n, "urn:unit"), text(F.concat(day, F.lit("Z")), xsd + "dateTime"), text(F.concat(day, F.lit(".0")), xsd + "dateTime"),
        text(n, xsd + "integer"), text(F.concat(n, F.lit(".0")), xsd + "decimal"), iri("urn:reading:", n), F.lit(None).cast("string"),
    ]
    value = F.element_at(F.array(*kinds), (F.col("p_partkey") % 8 + 1).cast("int"))
    obs = facts(
        x, iri("urn:part:", F.col("p_partkey")),
        {qb("dataSet"): F.lit("<urn:ds:readings>"), "<urn:dim:brand>": literal(F.col("p_brand")), "<urn:dim:reading>": value, qb("measureType"): F.lit(_QUANTITY), _QUANTITY: literal(F.col("p_partkey"), "integer")},
    )
    schema = structure("<urn:dsd:readings>", dimensions=["<urn:dim:brand>", "<urn:dim:reading>", qb("measureType")], measures=[_QUANTITY])
    return graph(constants(spark, [*schema, ("<urn:ds:readings>", qb("structure"), "<urn:dsd:readings>")]), obs)


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An abbreviated graph of schemas: each supplier has a dataset, a structure with a dimension, a measure and an attribute, a
    slice key, a slice and an observation, with faults by remainders of its key. A third has an attribute of slices. Types that links imply are left out.
    """
    x = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    of = lambda name: iri(f"urn:{name}:", k)
    drop = lambda column, mod: _drop(column, "s_suppkey", mod)
    only = lambda column, mod: F.when(k % mod == 0, column)
    node = lambda name: F.concat(F.lit(f"_:{name}"), k.cast("string"))
    truth = lambda t: F.lit(f'"{t}"^^<http://www.w3.org/2001/XMLSchema#boolean>')
    concept = F.lit(skos("Concept"))
    parts = [
        (of("ds"), {qb("structure"): [drop(of("dsd"), 5), only(F.lit("<urn:dsd:shared>"), 7)], qb("slice"): of("slice"), "<urn:label>": literal(F.col("s_name"), lang="en")}),
        (of("dsd"), {TYPE: F.lit(qb("DataStructureDefinition")), qb("component"): [node("d"), drop(node("m"), 4), node("a"), only(node("n"), 3)], qb("sliceKey"): drop(of("key"), 10)}),
        (node("d"), {qb("dimension"): of("dim"), qb("componentRequired"): only(truth("false"), 8)}),
        (node("m"), {qb("measure"): drop(of("measure"), 4)}),
        (node("a"), {qb("attribute"): of("att"), qb("componentRequired"): only(truth("false"), 2), qb("componentAttachment"): F.lit(qb("DataSet"))}),
        (node("n"), {qb("attribute"): only(of("note"), 3), qb("componentAttachment"): only(F.lit(qb("Slice")), 3)}),
        (of("dim"), {RANGE: drop(F.when(k % 3 == 0, concept).otherwise(F.lit("<urn:any>")), 6), qb("codeList"): drop(of("list"), 9)}),
        (of("key"), {TYPE: F.lit(qb("SliceKey")), qb("componentProperty"): [of("dim"), only(of("other"), 11)]}),
        (of("slice"), {qb("sliceStructure"): of("key"), qb("observation"): of("obs")}),
        (of("obs"), {qb("dataSet"): drop(of("ds"), 13)}),
    ]
    rows = [facts(x, s, properties) for s, properties in parts]
    # predicates that the key names: the attribute's value on the dataset, and the dimension's and another attribute's on the slice
    rows.append(x.select(of("ds").alias("s"), of("att").alias("p"), F.lit('"EUR"').alias("o")))
    rows.append(x.where(k % 4 != 1).select(of("slice").alias("s"), of("dim").alias("p"), iri("urn:nation:", F.col("s_nationkey")).alias("o")))
    rows.append(x.select(of("slice").alias("s"), of("note").alias("p"), literal(F.col("s_name")).alias("o")))
    return graph(*rows)


def _source(kind: str) -> Query:
    """The suppliers' graph written in a format and read back, triple by triple; blank nodes by the names they had in the file.

    RDF/XML can't name predicates that end in a number, so there the graph is without them.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_dir(spark)}/suppliers-{uuid.uuid4().hex}.{kind}"
        t = kept("suppliers", suppliers, spark, sf_dir)
        write_graph(t.where(nameable(F.col("p"))) if kind == "rdf" else t, path)
        name = lambda c: F.regexp_replace(c, "^_:b[0-9a-f]{32}n", "_:").alias(c)
        return read_graph(spark, path).select(name("s"), "p", name("o"), "o_kind")

    return run


def _added(phase: int) -> Query:
    """What a phase of normalization adds to the suppliers' graph, by predicate and class or kind of value."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = kept("suppliers", suppliers, spark, sf_dir)
        if phase == 2:
            t = normalize(t, phases=(1,))
        new = (attached if phase == 2 else implied)(t).distinct().join(t.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
        name = lambda c: F.regexp_replace(F.regexp_replace(c, r"[:0-9]+>$", ">"), r"[#0-9]+\"$", "\"")
        return new.groupBy(name("p").alias("p"), F.when(F.col("p") == TYPE, F.col("o")).otherwise(name("o")).alias("o")).agg(F.count("*").alias("n"))

    return run


def _graph_query(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: saved(f(kept("sales", sales, spark, sf_dir)), "answer")


_CUSTOMER_17 = "<urn:customer:17>"
GRAPH_QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "path_search": lambda t: op.path(t, [qb("slice"), qb("observation"), _DIMS["status"]]).groupBy(F.col("o").alias("status")).agg(F.count("*").alias("n")),
    "path_pairs": lambda t: op.path(t, [qb("observation"), _DIMS["place"]], from_="slice", to="nation"),
    "star_filter": lambda t: op.star(t, {qb("dataSet"): "<urn:ds:0>", _DIMS["status"]: "<urn:status:F>", _PRICE: None}),
    "star_lookup": lambda t: op.star_lookup(t, {qb("dataSet"): "<urn:ds:1>", _DIMS["status"]: "<urn:status:P>"}, [_PRIORITY, _DIMS["place"]]),
    "forward": lambda t: op.forward(op.subjects(t, qb("sliceStructure"), "<urn:key:lost>"), t, qb("observation")),
    "backward": lambda t: op.backward(t.where(F.col("s") == "<urn:region:2>").where(F.col("p") == "<urn:narrower>").select("o").distinct(), t, _DIMS["place"]),
    "connected": lambda t: op.connected(op.links(t, _DIMS["status"]), t, [qb("dataSet"), "<urn:label>"]).unionByName(op.connected(op.links(t, _DIMS["place"]), t, [_DIMS["place"]])),
    "connected_repeatedly": lambda t: op.connected_repeatedly(
        op.subjects(t, qb("hierarchyRoot"), "<urn:region:0>").join(op.objects(t, _DIMS["place"])), t, [qb("hierarchyRoot")], "<urn:broader>", inverse=True
    ),
    "set_operations": lambda t: op.merged(
        op.in_both(op.subjects(t, _PRICE), op.subjects(t, _PRIORITY)).select(F.lit("both").alias("key"), F.col("s").alias("value")),
        op.without(op.subjects(t, _PRICE), op.subjects(t, _PRIORITY)).select(F.lit("price only").alias("key"), F.col("s").alias("value")),
    ).groupBy("key").agg(F.count("*").alias("n")),
    "statements_of": lambda t: op.statements(t, p=_DIMS["customer"], o=_CUSTOMER_17).select("s", "o"),
    "slices_by_structure": lambda t: op.as_map(op.links(t, qb("sliceStructure"), "value", "key"), "key", "value").select("key", F.size("value").alias("n")),
}


QUERIES: dict[str, Query] = {
    "source_nt": _source("nt"), "source_ttl": _source("ttl"), "source_rdf": _source("rdf"), "norm_suppliers_1": _added(1), "norm_suppliers_2": _added(2),
    **{name: _graph_query(f) for name, f in GRAPH_QUERIES.items()},
    **{f"ic{k:02d}_suppliers": _on(suppliers, constraints.STANDARD[k]) for k in (1, 2, 3, 4, 5, 6, 7, 8, 10)},
    "ic12_line_pairs": _on(line_points, constraints.ic12),
    "norm_phase1": norm_phase1,
    "norm_phase2": norm_phase2,
    **{f"ic{k:02d}": _on(sales, constraints.STANDARD[k]) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 18, 19, 20, 21)},
    **{f"ic{k:02d}": _on(lines, constraints.STANDARD[k]) for k in (15, 16, 17)},
    "ic11_lines": _on(line_points, constraints.ic11),
    "ic12_lines": _on(line_points, constraints.ic12_groups),
    "ic12_line_classes": _on(line_points, constraints.ic12_classes),
    "ic12_readings": _on(readings, constraints.ic12),
    "source_stream": streamed,
    **{f"ic{k}_places": _on(places, constraints.STANDARD[k]) for k in (20, 21)},
    **{f"ic{k}_places_setwise": _on(places, constraints.SETWISE[k], by_value=False) for k in (20, 21)},
    "ic17_readings": _on(readings, constraints.ic17),
    "ic12_classes": _on(sales, constraints.ic12_classes),
    **{f"ic{k:02d}_setwise": _on(sales, constraints.SETWISE[k], by_value=False) for k in (12, 19, 20, 21)},
    **{f"ic{k:02d}_setwise": _on(lines, constraints.SETWISE[k], by_value=False) for k in (14, 15, 16, 17)},
}

_ORDER = "'<urn:order:' || o_orderkey || '>'"
_DATASETS = """ob AS (
  SELECT o_orderkey, o_orderkey % 3 AS ds FROM orders WHERE o_orderkey % 101 <> 0
  UNION SELECT o_orderkey, (o_orderkey + 1) % 3 FROM orders WHERE o_orderkey % 103 = 0 AND o_orderkey % 101 <> 0)"""
_LINE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) || '-' || CAST(round(l_extendedprice * 100) AS BIGINT)"
_POINTS = f"pt AS (SELECT *, {_LINE} AS line FROM lineitem)"
_FACTS = f"""{_DATASETS},
f AS (SELECT ob.ds, o.o_orderkey AS k, o.o_custkey AS cust, CAST(o.o_orderdate AS DATE) AS day, o.o_orderstatus AS st, c.c_nationkey AS nat,
        o.o_orderkey % 97 = 0 AS no_day, o.o_orderkey % 89 = 0 AS two
      FROM ob JOIN orders o ON o.o_orderkey = ob.o_orderkey LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"""

ORACLE_SQL: dict[str, str] = {
    "norm_phase1": f"""SELECT '{qb("DataSet")}' AS o, 3 AS n UNION ALL SELECT '{qb("DimensionProperty")}', 4 + count(*) FROM supplier
        UNION ALL SELECT '{qb("MeasureProperty")}', 1 + count(*) FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT '{qb("AttributeProperty")}', 2""",
    "norm_phase2": f"""WITH {_DATASETS} SELECT '{_CURRENCY}' AS p, count(DISTINCT o_orderkey) AS n, count(DISTINCT o_orderkey) AS observations FROM ob""",
    "ic01": f"""SELECT {_ORDER} AS obs, CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE
          '<urn:ds:' || least(o_orderkey % 3, (o_orderkey + 1) % 3) || '> <urn:ds:' || greatest(o_orderkey % 3, (o_orderkey + 1) % 3) || '>' END AS "values"
        FROM orders WHERE o_orderkey % 101 = 0 OR o_orderkey % 103 = 0""",
    "ic02": """SELECT '<urn:ds:none>' AS dataset, '' AS "values" UNION ALL SELECT '<urn:ds:two>', '<urn:dsd:nomeasure> <urn:dsd:sales>'
        UNION ALL SELECT '<urn:ds:s' || s_suppkey || '>', CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '<urn:dsd:nomeasure> <urn:dsd:s' || s_suppkey || '>' END
        FROM supplier WHERE (s_suppkey % 7 = 0) <> (s_suppkey % 5 = 0)""",
    "ic03": "SELECT '<urn:dsd:nomeasure>' AS dsd UNION ALL SELECT '<urn:dsd:s' || s_suppkey || '>' FROM supplier WHERE s_suppkey % 3 = 0",
    "ic04": "SELECT '<urn:dim:date>' AS dim UNION ALL SELECT '<urn:dim:s' || s_suppkey || '>' FROM supplier WHERE s_suppkey % 8 = 0",
    "ic05": "SELECT '<urn:dim:uncoded>' AS dim UNION ALL SELECT '<urn:dim:s' || s_suppkey || '>' FROM supplier WHERE s_suppkey % 8 <> 0 AND s_suppkey % 9 = 0",
    "ic06": "SELECT '<urn:dim:place>' AS component UNION ALL SELECT '<urn:dim:s' || s_suppkey || '>' FROM supplier WHERE s_suppkey % 4 = 0",
    "ic07": "SELECT '<urn:key:lost>' AS \"sliceKey\" UNION ALL SELECT '<urn:key:s' || s_suppkey || '>' FROM supplier WHERE s_suppkey % 6 = 0",
    "ic08": "SELECT '<urn:dim:unknown>' AS prop UNION ALL SELECT '<urn:other:s' || s_suppkey || '>' FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 6 <> 0",
    "ic09": f"""SELECT '<urn:slice:' || c_custkey || '>' AS slice, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '{_KEY} <urn:key:lost>' END AS "values"
        FROM customer WHERE (c_custkey % 11 = 0) <> (c_custkey % 13 = 0)""",
    "ic10": f"""SELECT '<urn:slice:' || c_custkey || '>' AS slice, '{_DIMS["customer"]}' AS dim FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 17 = 0
        UNION ALL SELECT '<urn:slice:' || c_custkey || '>', '<urn:dim:unknown>' FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 19 = 0""",
    "ic11": f"""SELECT {_ORDER} AS obs, '{_DIMS["date"]}' AS dim FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey % 101 <> 0""",
    "ic12": f"""WITH {_FACTS} SELECT DISTINCT '<urn:order:' || a.k || '>' AS obs1, '<urn:order:' || b.k || '>' AS obs2 FROM f a JOIN f b
        ON a.ds = b.ds AND a.k <> b.k AND a.cust = b.cust AND a.st = b.st AND NOT a.two AND NOT b.two
        AND (a.no_day OR b.no_day OR a.day = b.day) AND a.nat IS NOT DISTINCT FROM b.nat""",
    "ic12_setwise": f"""WITH {_FACTS}, v AS (SELECT ds, k, cust, day, least(st, CASE WHEN two THEN 'X' ELSE st END) AS st, nat FROM f WHERE NOT no_day AND nat IS NOT NULL)
        SELECT DISTINCT '<urn:order:' || k || '>' AS obs FROM (SELECT k, row_number() OVER (PARTITION BY ds, cust, day, st, nat ORDER BY '<urn:order:' || k || '>') AS n FROM v) WHERE n > 1""",
    "ic13": f"""SELECT {_ORDER} AS obs, '{_PRIORITY}' AS attr FROM orders WHERE o_orderkey % 59 = 0 AND o_orderkey % 101 <> 0""",
    "ic14": f"""SELECT {_ORDER} AS obs, '{_PRICE}' AS measure FROM orders WHERE o_orderkey % 53 = 0 AND o_orderkey % 101 <> 0""",
    "ic14_setwise": f"""WITH {_POINTS} SELECT DISTINCT * FROM (
        SELECT '<urn:quantity:' || line || '>' AS obs, '{_QUANTITY}' AS measure FROM pt WHERE l_partkey % 23 = 0
        UNION ALL SELECT '<urn:quantity:' || line || '>', '{_PRICE}' FROM pt WHERE l_partkey % 29 <> 0
        UNION ALL SELECT '<urn:price:' || line || '>', '{_QUANTITY}' FROM pt WHERE l_partkey % 10 <> 0)""",
    "ic15": f"""WITH {_POINTS} SELECT DISTINCT * FROM (
        SELECT '<urn:quantity:' || line || '>' AS obs, '{_QUANTITY}' AS measure FROM pt WHERE l_partkey % 23 = 0
        UNION ALL SELECT '<urn:quantity:' || line || '>', '{_PRICE}' FROM pt WHERE l_partkey % 31 = 0 AND l_partkey % 29 <> 0)""",
    "ic15_setwise": f"""WITH {_POINTS} SELECT DISTINCT '<urn:quantity:' || line || '>' AS obs, '{_QUANTITY}' AS measure FROM pt WHERE l_partkey % 23 = 0 AND l_partkey % 31 <> 0""",
    "ic16": f"""WITH {_POINTS} SELECT DISTINCT * FROM (
        SELECT '<urn:quantity:' || line || '>' AS obs, '{_QUANTITY}' AS measure FROM pt WHERE l_partkey % 29 = 0
        UNION ALL SELECT '<urn:quantity:' || line || '>', '{_PRICE}' FROM pt WHERE l_partkey % 31 = 0 AND l_partkey % 23 <> 0)""",
    "ic16_setwise": f"""WITH {_POINTS} SELECT DISTINCT '<urn:quantity:' || line || '>' AS obs, m.measure FROM pt
        CROSS JOIN (SELECT '{_QUANTITY}' AS measure UNION ALL SELECT '{_PRICE}') m WHERE l_partkey % 31 = 0""",
    "ic17": f"""WITH {_POINTS}, d AS (SELECT DISTINCT line, l_partkey FROM pt),
        w AS (SELECT '<urn:quantity:' || line || '>' AS obs, line, CASE WHEN l_partkey % 31 = 0 THEN 2 ELSE 1 END AS w FROM d
              UNION ALL SELECT '<urn:price:' || line || '>', line, 1 FROM d WHERE l_partkey % 10 <> 0)
        SELECT obs, 2 AS "numMeasures", CAST(w * sum(w) OVER (PARTITION BY line) AS BIGINT) AS cnt FROM w QUALIFY cnt <> 2""",
    "ic17_setwise": f"""WITH {_POINTS}, d AS (SELECT DISTINCT line, l_partkey FROM pt),
        w AS (SELECT '<urn:quantity:' || line || '>' AS obs, line FROM d UNION ALL SELECT '<urn:price:' || line || '>', line FROM d WHERE l_partkey % 10 <> 0)
        SELECT '<urn:ds:lines>' AS ds, obs, count(*) OVER () - count(*) OVER (PARTITION BY line) AS differing FROM w QUALIFY count(*) OVER (PARTITION BY line) <> 2""",
    "ic18": f"""WITH {_DATASETS} SELECT {_ORDER} AS obs, '<urn:ds:0>' AS dataset FROM orders o JOIN customer ON c_custkey = o_custkey
        WHERE NOT EXISTS (SELECT 1 FROM ob WHERE ob.o_orderkey = o.o_orderkey AND ob.ds = 0)""",
    "ic19": f"""SELECT {_ORDER} AS obs, '{_DIMS["status"]}' AS dim FROM orders WHERE (o_orderstatus <> 'O' OR o_orderkey % 89 = 0) AND o_orderkey % 101 <> 0""",
    "ic19_setwise": """SELECT DISTINCT '<urn:status:' || o_orderstatus || '>' AS value, CASE o_orderstatus WHEN 'P' THEN '<urn:codes:status>' ELSE '<urn:codes:collection>' END AS lst
        FROM orders WHERE o_orderkey % 89 <> 0 AND o_orderkey % 101 <> 0 AND o_orderstatus IN ('F', 'P')""",
    "ic20": """WITH u AS (SELECT DISTINCT c_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 101 <> 0)
        SELECT '<urn:nation:' || n || '>' AS v, l.lst FROM u JOIN nation ON n_nationkey = n
        CROSS JOIN (SELECT '<urn:codes:geo>' AS lst UNION ALL SELECT '<urn:codes:back>') l WHERE n_regionkey >= 3""",
    "ic21": """WITH u AS (SELECT DISTINCT c_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 101 <> 0)
        SELECT '<urn:nation:' || n || '>' AS v, l.lst FROM u JOIN nation ON n_nationkey = n
        CROSS JOIN (SELECT '<urn:codes:geo>' AS lst UNION ALL SELECT '<urn:codes:back>') l WHERE n_regionkey >= 3 OR n_nationkey % 2 <> 0""",
    "ic11_lines": f"""WITH {_POINTS} SELECT DISTINCT '<urn:line:' || line || '>' AS obs, '<urn:dim:number>' AS dim FROM pt WHERE l_orderkey % 7 = 0""",
    "ic12_lines": f"""WITH {_POINTS}, d AS (SELECT DISTINCT line, l_orderkey, l_linenumber FROM pt WHERE l_orderkey % 7 <> 0)
        SELECT '<urn:line:' || line || '>' AS obs, '<urn:ds:points>' AS ds, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS group_size FROM d QUALIFY group_size > 1""",
}
ORACLE_SQL |= {
    # in as many rows as observations: the class of equal points, and the pairs of ic12 counted by their first observation
    "ic12_classes": f"""WITH {_FACTS}, l AS (SELECT a.ds, a.k, count(*) AS n FROM f a JOIN f b ON a.ds = b.ds AND a.k <> b.k AND a.cust = b.cust AND a.st = b.st
          AND NOT a.two AND NOT b.two AND (a.no_day OR b.no_day OR a.day = b.day) AND a.nat IS NOT DISTINCT FROM b.nat GROUP BY a.ds, a.k)
        SELECT '<urn:order:' || f.k || '>' AS obs, '<urn:ds:' || f.ds || '>' AS ds, min('<urn:order:' || f.k || '>') OVER w AS class_id, count(*) OVER w AS class_size, coalesce(l.n, 0) AS n_links
        FROM f LEFT JOIN l ON l.ds = f.ds AND l.k = f.k WINDOW w AS (PARTITION BY f.ds, cust, CASE WHEN no_day THEN NULL ELSE day END, CASE WHEN two THEN NULL ELSE st END, nat)""",
    # every property, for each list: what its roots reach
    **{
        f"ic{k}_places": f"""WITH u AS (SELECT DISTINCT n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT '<urn:nation:' || n || '>' AS v, '<urn:codes:down>' AS lst FROM u WHERE NOT ({step} AND r < 3)
        UNION ALL SELECT '<urn:nation:' || n || '>', '<urn:codes:up>' FROM u WHERE NOT ({step} AND r = 3)"""
        for k, step in ((20, "true"), (21, "n % 2 = 0"))
    },
    # a list's own property, and reached in one list is enough; both lists are named if it is in none
    **{
        f"ic{k}_places_setwise": f"""WITH u AS (SELECT DISTINCT n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT '<urn:nation:' || n || '>' AS v, lst FROM u, (SELECT '<urn:codes:down>' AS lst UNION ALL SELECT '<urn:codes:up>') WHERE NOT ({own})"""
        for k, own in ((20, "r < 3"), (21, "r = 3 AND n % 2 = 0"))
    },
    # equal: the same number, time, resource or term, but no NaN
    "ic12_readings": """WITH p AS (SELECT p_partkey AS k, p_brand AS brand, p_partkey % 8 AS kind, p_partkey // 8 % 3 AS n FROM part)
        SELECT '<urn:part:' || a.k || '>' AS obs1, '<urn:part:' || b.k || '>' AS obs2 FROM p a JOIN p b ON a.brand = b.brand AND a.k <> b.k
        WHERE a.kind = 7 OR b.kind = 7 OR (a.n = b.n AND a.kind <> 0 AND (a.kind = b.kind OR (a.kind IN (4, 5) AND b.kind IN (4, 5))))""",
    # not different: one is missing, or it is a literal of an unknown datatype and the other no resource, or times of which one has a zone, or equal
    "ic17_readings": """WITH p AS (SELECT p_partkey AS k, p_brand AS brand, p_partkey % 8 AS kind, p_partkey // 8 % 3 AS n FROM part),
        c AS (SELECT a.k, count(*) FILTER (a.kind = 7 OR b.kind = 7 OR (a.kind = 1 AND b.kind <> 6) OR (b.kind = 1 AND a.kind <> 6) OR (a.kind = 2 AND b.kind = 3) OR (a.kind = 3 AND b.kind = 2)
            OR (a.n = b.n AND a.kind <> 0 AND (a.kind = b.kind OR (a.kind IN (4, 5) AND b.kind IN (4, 5))))) AS cnt FROM p a JOIN p b ON a.brand = b.brand GROUP BY a.k)
        SELECT '<urn:part:' || k || '>' AS obs, 1 AS "numMeasures", cnt FROM c WHERE cnt <> 1 AND cnt > 0""",
    "ic12_line_classes": f"""WITH {_POINTS}, d AS (SELECT DISTINCT '<urn:line:' || line || '>' AS obs, l_orderkey, CASE WHEN l_orderkey % 7 <> 0 THEN l_linenumber END AS number FROM pt)
        SELECT obs, '<urn:ds:points>' AS ds, min(obs) OVER w AS class_id, count(*) OVER w AS class_size, count(*) OVER w - 1 AS n_links FROM d WINDOW w AS (PARTITION BY l_orderkey, number)""",
}
# the suppliers' graph, triple by triple: subject, predicate and object from the key, and for which keys
_U, _B = (lambda name: f"'<urn:{name}:' || k || '>'"), (lambda name: f"'_:{name}' || k")
_FALSE = "'\"false\"^^<http://www.w3.org/2001/XMLSchema#boolean>'"
_SUPPLIER_TRIPLES = [
    (_U("ds"), qb("structure"), _U("dsd"), "k % 5 <> 0"), (_U("ds"), qb("structure"), "'<urn:dsd:shared>'", "k % 7 = 0"),
    (_U("ds"), qb("slice"), _U("slice"), ""), (_U("ds"), "<urn:label>", "'\"' || s_name || '\"@en'", ""),
    (_U("dsd"), TYPE, f"'{qb('DataStructureDefinition')}'", ""), (_U("dsd"), qb("component"), _B("d"), ""), (_U("dsd"), qb("component"), _B("m"), "k % 4 <> 0"),
    (_U("dsd"), qb("component"), _B("a"), ""), (_U("dsd"), qb("component"), _B("n"), "k % 3 = 0"), (_B("n"), qb("attribute"), _U("note"), "k % 3 = 0"),
    (_B("n"), qb("componentAttachment"), f"'{qb('Slice')}'", "k % 3 = 0"), (_U("dsd"), qb("sliceKey"), _U("key"), "k % 10 <> 0"),
    (_B("d"), qb("dimension"), _U("dim"), ""), (_B("d"), qb("componentRequired"), _FALSE, "k % 8 = 0"), (_B("m"), qb("measure"), _U("measure"), "k % 4 <> 0"),
    (_B("a"), qb("attribute"), _U("att"), ""), (_B("a"), qb("componentRequired"), _FALSE, "k % 2 = 0"), (_B("a"), qb("componentAttachment"), f"'{qb('DataSet')}'", ""),
    (_U("dim"), RANGE, f"CASE WHEN k % 3 = 0 THEN '{skos('Concept')}' ELSE '<urn:any>' END", "k % 6 <> 0"), (_U("dim"), qb("codeList"), _U("list"), "k % 9 <> 0"),
    (_U("key"), TYPE, f"'{qb('SliceKey')}'", ""), (_U("key"), qb("componentProperty"), _U("dim"), ""), (_U("key"), qb("componentProperty"), _U("other"), "k % 11 = 0"),
    (_U("slice"), qb("sliceStructure"), _U("key"), ""), (_U("slice"), qb("observation"), _U("obs"), ""), (_U("obs"), qb("dataSet"), _U("ds"), "k % 13 <> 0"),
]


def _supplier_triples(*, keyed: bool) -> str:
    """``keyed``: with the predicates that a key names."""
    rows = [(s, f"'{p}'", o, test) for s, p, o, test in _SUPPLIER_TRIPLES]
    if keyed:
        rows += [(_U("ds"), _U("att"), "'\"EUR\"'", ""), (_U("slice"), _U("dim"), "'<urn:nation:' || s_nationkey || '>'", "k % 4 <> 1"), (_U("slice"), _U("note"), "'\"' || s_name || '\"'", "")]
    parts = [f"SELECT {s} AS s, {p} AS p, {o} AS o FROM x {f'WHERE {test}' if test else ''}" for s, p, o, test in rows]
    kind = "CASE substr(o, 1, 1) WHEN '<' THEN 'iri' WHEN '_' THEN 'bnode' ELSE 'literal' END"
    return f"WITH x AS (SELECT *, s_suppkey AS k FROM supplier) SELECT DISTINCT s, p, o, {kind} AS o_kind FROM ({' UNION ALL '.join(parts)})"


_SUPPLIER = lambda name: f"'<urn:{name}:' || s_suppkey || '>'"
ORACLE_SQL |= {
    "source_nt": _supplier_triples(keyed=True), "source_ttl": _supplier_triples(keyed=True), "source_rdf": _supplier_triples(keyed=False), "source_stream": _supplier_triples(keyed=True),
    # observations, datasets and slices have no type in the graph; a slice's dataset isn't an implied one
    "norm_suppliers_1": f"""WITH x AS (SELECT s_suppkey AS k FROM supplier), t AS (
        SELECT '{TYPE}' AS p, c AS o FROM x, (SELECT '{qb("Slice")}' AS c UNION ALL SELECT '{qb("Observation")}' UNION ALL SELECT '{qb("DimensionProperty")}' UNION ALL SELECT '{qb("AttributeProperty")}')
        UNION ALL SELECT '{TYPE}', '{qb("DataSet")}' FROM x WHERE k % 13 <> 0 UNION ALL SELECT '{TYPE}', '{qb("MeasureProperty")}' FROM x WHERE k % 4 <> 0
        UNION ALL SELECT '{qb("componentProperty")}', c FROM x, (SELECT '<urn:dim>' AS c UNION ALL SELECT '<urn:att>')
        UNION ALL SELECT '{qb("componentProperty")}', '<urn:measure>' FROM x WHERE k % 4 <> 0
        UNION ALL SELECT p, o FROM x, (SELECT '{TYPE}' AS p, '{qb("AttributeProperty")}' AS o UNION ALL SELECT '{qb("componentProperty")}', '<urn:note>') WHERE k % 3 = 0)
        SELECT p, o, count(*) AS n FROM t GROUP BY p, o""",
    # the attribute's value goes from the dataset to its observation, the dimension's and the other attribute's from the slice
    "norm_suppliers_2": """SELECT * FROM (SELECT '<urn:note>' AS p, '"Supplier"' AS o, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0
        UNION ALL SELECT '<urn:att>' AS p, '"EUR"' AS o, count(*) AS n FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 13 <> 0
        UNION ALL SELECT '<urn:dim>', '<urn:nation>', count(*) FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 1) WHERE n > 0""",
    "ic01_suppliers": f"""SELECT {_SUPPLIER("obs")} AS obs, '' AS "values" FROM supplier WHERE s_suppkey % 13 = 0""",
    "ic02_suppliers": f"""SELECT {_SUPPLIER("ds")} AS dataset, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE {_SUPPLIER("dsd")} || ' <urn:dsd:shared>' END AS "values"
        FROM supplier WHERE (s_suppkey % 5 = 0) = (s_suppkey % 7 <> 0) AND s_suppkey % 13 <> 0""",
    "ic03_suppliers": f"SELECT {_SUPPLIER('dsd')} AS dsd FROM supplier WHERE s_suppkey % 4 = 0",
    "ic04_suppliers": f"SELECT {_SUPPLIER('dim')} AS dim FROM supplier WHERE s_suppkey % 6 = 0",
    "ic05_suppliers": f"SELECT {_SUPPLIER('dim')} AS dim FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 6 <> 0 AND s_suppkey % 9 = 0",
    "ic06_suppliers": f"SELECT {_SUPPLIER('dim')} AS component FROM supplier WHERE s_suppkey % 8 = 0",
    "ic07_suppliers": f"SELECT {_SUPPLIER('key')} AS \"sliceKey\" FROM supplier WHERE s_suppkey % 10 = 0",
    "ic08_suppliers": f"SELECT {_SUPPLIER('other')} AS prop FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 10 <> 0",
    "ic10_suppliers": f"""SELECT {_SUPPLIER("slice")} AS slice, {_SUPPLIER("dim")} AS dim FROM supplier WHERE s_suppkey % 4 = 1
        UNION ALL SELECT {_SUPPLIER("slice")}, {_SUPPLIER("other")} FROM supplier WHERE s_suppkey % 11 = 0""",
    "ic12_line_pairs": f"""WITH {_POINTS}, d AS (SELECT DISTINCT '<urn:line:' || line || '>' AS obs, l_orderkey, l_linenumber FROM pt)
        SELECT a.obs AS obs1, b.obs AS obs2 FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.obs <> b.obs AND (a.l_orderkey % 7 = 0 OR a.l_linenumber = b.l_linenumber)""",
    "path_pairs": """SELECT DISTINCT '<urn:slice:' || o_custkey || '>' AS slice, '<urn:nation:' || c_nationkey || '>' AS nation FROM orders JOIN customer ON c_custkey = o_custkey""",
    "star_filter": f"""WITH {_DATASETS} SELECT DISTINCT '<urn:order:' || ob.o_orderkey || '>' AS s FROM ob JOIN orders o ON o.o_orderkey = ob.o_orderkey
        WHERE ds = 0 AND o_orderstatus = 'F' AND ob.o_orderkey % 53 <> 0""",
    "star_lookup": f"""WITH {_DATASETS}, x AS (SELECT DISTINCT o.* FROM ob JOIN orders o ON o.o_orderkey = ob.o_orderkey WHERE ds = 1 AND o_orderstatus = 'P')
        SELECT {_ORDER} AS s, '{_PRIORITY}' AS p, CASE WHEN o_orderkey % 59 <> 0 THEN '"' || o_orderpriority || '"' END AS o FROM x
        UNION ALL SELECT {_ORDER}, '{_DIMS["place"]}', '<urn:nation:' || c_nationkey || '>' FROM x LEFT JOIN customer ON c_custkey = o_custkey""",
    "forward": "SELECT '<urn:order:' || o_orderkey || '>' AS o FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 13 = 0",
    "backward": """SELECT '<urn:order:' || o_orderkey || '>' AS s FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2""",
    "connected": """SELECT '<urn:order:' || o_orderkey || '>' AS s, '<urn:nation:' || c_nationkey || '>' AS o FROM orders JOIN customer ON c_custkey = o_custkey""",
    "connected_repeatedly": """SELECT lst AS s, '<urn:nation:' || n_nationkey || '>' AS o FROM nation, (SELECT '<urn:codes:geo>' AS lst UNION ALL SELECT '<urn:codes:back>')
        WHERE n_regionkey < 3 AND n_nationkey % 2 = 0 AND n_nationkey IN (SELECT c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey)""",
    "set_operations": """SELECT CASE WHEN o_orderkey % 59 <> 0 THEN 'both' ELSE 'price only' END AS key, count(*) AS n FROM orders WHERE o_orderkey % 53 <> 0 GROUP BY 1""",
    "statements_of": f"SELECT {_ORDER} AS s, '{_CUSTOMER_17}' AS o FROM orders WHERE o_custkey = 17",
    "slices_by_structure": f"""SELECT '{_KEY}' AS key, count(*) AS n FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT '<urn:key:lost>', count(*) FROM customer WHERE c_custkey % 13 = 0""",
}
_PATHS = "SELECT '<urn:status:' || st || '>' AS status, count(DISTINCT ds) AS n FROM (SELECT 0 AS ds, o_orderstatus AS st FROM orders JOIN customer ON c_custkey = o_custkey UNION SELECT 0, 'X' FROM orders WHERE o_orderkey % 89 = 0) GROUP BY st"
ORACLE_SQL["path_search"] = _PATHS
ORACLE_SQL["ic20_setwise"] = ORACLE_SQL["ic20"]
ORACLE_SQL["ic21_setwise"] = ORACLE_SQL["ic21"]

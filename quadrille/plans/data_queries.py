"""Queries over documents, shapes, ledger, derived values, governance and audits."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.functions.digests import hmac_sql
from quadrille.operators import audits as A
from quadrille.operators import derived as D
from quadrille.operators import documents as O
from quadrille.operators import governance as G
from quadrille.operators import ledger as L
from quadrille.operators import shapes as S
from quadrille.plans import model as M
from quadrille.session import read_table
from quadrille.streaming import outbox as X

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- documents -------------------------------------------------------------------------------------------------


def parts(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("urn:x:type/Part").alias("type"), "p_name", "p_type", "p_size", "p_retailprice")


def orders(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("urn:x:type/Order").alias("type"), F.col("o_orderdate").alias("ts"), "o_custkey", "o_totalprice", "o_orderstatus")


PART_KEYS = {"name": "p_name", "kind": "p_type", "size": "p_size", "price": "p_retailprice"}
FILTERS = {
    "eq": ("kind", "PROMO", "p_type = 'PROMO'"),
    "neq": ("kind", "PROMO", "p_type <> 'PROMO'"),
    "lt": ("size", "10", "p_size < 10"),
    "lte": ("size", "10", "p_size <= 10"),
    "gt": ("size", "45", "p_size > 45"),
    "gte": ("price", "950.5", "p_retailprice >= 950.5"),
    "contains": ("name", "l_rge b", "p_name LIKE '%l_rge b%'"),
}


def _filter(op: str, key: str, literal: str):
    return lambda spark, sf: O.query(parts(spark, sf), [(key, op, literal)], PART_KEYS, limit=1000).select("id", "p_name")


for _op, (_key, _literal, _where) in FILTERS.items():
    query(f"query_{_op}", f"SELECT p_partkey AS id, p_name FROM part WHERE {_where} ORDER BY p_partkey LIMIT 1000")(_filter(_op, _key, _literal))


@query("query_limit_offset", "SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def query_limit_offset(spark, sf):
    return O.query(orders(spark, sf), [("o_totalprice", "gt", "1000")], {"o_totalprice": "o_totalprice"}, 50, 100).select("id", "o_totalprice")


@query("query_unshaped_key_resolution", "SELECT event_id AS id FROM events WHERE json_extract_string(props, '$.k')::DOUBLE > 50 ORDER BY event_id LIMIT 1000")
def query_unshaped(spark, sf):
    docs = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), F.replace("props", F.lit('"k"'), F.lit('"urn:x:p/k"')).alias("body"))
    return O.query(docs, [("k", "gt", "50")], None, 1000).select("id")


@query("instance_get", "SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey = 42")
def instance_get(spark, sf):
    return O.get(read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name"), 42)


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "labels", "pages", "benchmark", "embeddings", "conversations"]


@query("instance_count_by_type", " UNION ALL ".join(f"SELECT 'urn:x:type/{t}' AS type, count(*) AS n FROM {t}" for t in TABLES))
def instance_count_by_type(spark, sf):
    out = None
    for t in TABLES:
        one = read_table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"urn:x:type/{t}").alias("type"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("instances_last_n", "SELECT o_orderkey AS id, o_orderdate AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def instances_last_n(spark, sf):
    return O.last(O.of_type(orders(spark, sf), "Order"), 25).select("id", "ts")


RANK_SQL = "CASE WHEN lower({c}) = '{t}' THEN 1 WHEN starts_with(lower({c}), '{t}') THEN 2 ELSE 3 END"


@query("match_ranked", f"SELECT * FROM (SELECT n_nationkey AS id, n_name AS label, {RANK_SQL.format(c='n_name', t='nation_1')} AS rank FROM nation WHERE contains(lower(n_name), 'nation_1') ORDER BY n_name, n_nationkey LIMIT 5)")
def match_ranked(spark, sf):
    labels = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    return O.match_labels(labels, "NATION_1", 5)


@query("match_fallback", f"SELECT p_partkey AS id, p_name AS label, {RANK_SQL.format(c='p_name', t='small')} AS rank FROM part WHERE contains(lower(p_name), 'small') ORDER BY rank, label, id LIMIT 40")
def match_fallback(spark, sf):
    labels = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return O.match_labels(labels, "small", 40, rank_first=True)


@query("snapshot_bodies", """SELECT event_id AS id, '{"id":' || event_id || ',"type":"' || event_type || '","user":' || user_id || '}' AS body FROM events""")
def snapshot_bodies(spark, sf):
    return M.event_bodies(spark, sf).select(F.col("seq").alias("id"), "body").orderBy("id")


@query("instance_update", """SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN '{"id":' || event_id || ',"o":{"k":[1,2.5]},"ok":true,"state":"done","type":"patched","user":' || user_id || '}'
ELSE '{"id":' || event_id || ',"type":"' || event_type || '","user":' || user_id || '}' END AS body FROM events""")  # fmt: skip
def instance_update(spark, sf):
    docs = M.event_bodies(spark, sf).select(F.col("seq").alias("id"), "body")
    patches = docs.where("id % 10 = 0").select("id", F.lit('{"type":"patched","ok":true,"state":"done","o":{"k":[1,2.5]}}').alias("patch"))
    return O.patch(docs, patches)


PRIORITY = "CASE left(o_orderpriority, 1) WHEN '1' THEN 5 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 2 ELSE 1 END"


def tasks(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_custkey").alias("kernel"), F.col("o_orderkey").alias("task_id"), F.expr(PRIORITY).alias("priority"), F.col("o_orderkey").alias("queue_seq"))


@query("board_sort_tasks", f"SELECT o_custkey AS kernel, o_orderkey AS task_id, row_number() OVER (PARTITION BY o_custkey ORDER BY {PRIORITY} DESC, o_orderkey) AS place FROM orders")
def board_sort_tasks(spark, sf):
    return O.sort_tasks(tasks(spark, sf)).select("kernel", "task_id", F.col("place").cast("bigint").alias("place"))


@query("board_snapshot", """SELECT o_custkey AS kernel, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS tasks, count(*) AS n FROM orders GROUP BY o_custkey""")
def board_snapshot(spark, sf):
    return tasks(spark, sf).groupBy("kernel").agg(F.array_join(F.transform(F.sort_array(F.collect_list("task_id")), lambda x: x.cast("string")), ",").alias("tasks"), F.count(F.lit(1)).alias("n"))


@query("task_allocate_queue_seq", "SELECT c_custkey AS kernel, c_custkey * 10 + k AS task_id, coalesce(m, 0) + row_number() OVER (PARTITION BY c_custkey ORDER BY k) AS queue_seq FROM customer, range(2) t(k) LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def task_allocate(spark, sf):
    new = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("kernel"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("kernel", (F.col("kernel") * 10 + F.col("k")).alias("task_id"))
    return O.allocate(tasks(spark, sf), new)


@query("task_next_id", "SELECT 'FC-T-' || lpad((max(regexp_replace(c_name, '[^0-9]', '', 'g')::BIGINT) + 1)::VARCHAR, 12, '0') AS next_id FROM customer")
def task_next_id(spark, sf):
    return O.next_ids(read_table(spark, sf, "customer").select(F.col("c_name").alias("id")), "FC-T-", 12)


@query("kernels_list", "SELECT 'backlog:' || c_mktsegment AS id, count(*) AS members FROM customer GROUP BY c_mktsegment")
def kernels_list(spark, sf):
    return read_table(spark, sf, "customer").groupBy(F.concat(F.lit("backlog:"), "c_mktsegment").alias("id")).agg(F.count(F.lit(1)).alias("members")).where(F.startswith("id", F.lit("backlog:")))


# --- shapes ------------------------------------------------------------------------------------------------------

P = "urn:x:p/"


def order_values(spark, sf):
    """Orders as property values: customer (IRI), price, status, priority, id, and a note here and there."""
    o = read_table(spark, sf, "orders")
    cell = lambda p, v, k, dt=None: F.struct(F.lit(P + p).alias("path"), v.cast("string").alias("o"), F.lit(k).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"))
    cells = F.array(
        cell("customer", M.iri("customer", "o_custkey"), T.IRI),
        cell("price", F.col("o_totalprice").cast("decimal(18,2)"), T.LITERAL, T.XSD + "decimal"),
        cell("status", F.col("o_orderstatus"), T.LITERAL),
        cell("priority", F.col("o_orderpriority"), T.LITERAL),
        cell("id", F.col("o_orderkey"), T.LITERAL, T.XSD + "integer"),
        cell("note", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderpriority")), T.LITERAL),
    )
    return o.select(M.iri("order", "o_orderkey").alias("focus"), F.explode(cells).alias("c")).select("focus", "c.*").where("o IS NOT NULL")


def order_focus(spark, sf):
    return read_table(spark, sf, "orders").select(M.iri("order", "o_orderkey").alias("focus"))


def customer_types(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.where("c_acctbal > 0").select(M.iri("customer", "c_custkey").alias("s"), F.lit("urn:x:type/Solvent").alias("c"))


ORDER = "'urn:x:order/' || o_orderkey"
CUST = "'urn:x:customer/' || o_custkey"
SOLVENT = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"
SHAPE = "urn:x:shape/Order"
#: The shape of orders as a shapes graph; the queries compile and check it.
ORDER_SHAPES = f"""
@prefix sh: <{T.SHACL}> . @prefix xsd: <{T.XSD}> . @prefix p: <{P}> .
<{SHAPE}> a sh:NodeShape ; sh:targetClass <urn:x:type/order> ; sh:closed true ; sh:severity sh:Warning ;
  sh:ignoredProperties ( <{T.RDF_TYPE}> p:ignored ) ;
  sh:property [ sh:path p:customer ; sh:class <urn:x:type/Solvent> ; sh:severity sh:Warning ; sh:message "no solvent customer" ] ,
    [ sh:path p:customer ; sh:qualifiedValueShape [ sh:class <urn:x:type/Solvent> ] ; sh:qualifiedMinCount 1 ] ,
    [ sh:path p:price ; sh:nodeKind sh:IRI ] , [ sh:path p:id ; sh:minCount 2 ] ,
    [ sh:path p:status ; sh:datatype xsd:integer ; sh:in ( "F" "O" ) ] , [ sh:path p:status ; sh:hasValue "O" ] ,
    [ sh:path p:priority ; sh:pattern "^[1-3]" ; sh:minLength 6 ; sh:maxCount 0 ] , [ sh:path p:priority ; sh:disjoint p:note ] .
"""
NOTE = "o_orderkey % 50 = 0"
# component: path, value and condition of its violations, and severity
CONSTRAINTS = {
    "mincount": ("minCount", "id", "NULL", "true", "Violation"),
    "maxcount": ("maxCount", "priority", "NULL", "true", "Violation"),
    "datatype": ("datatype", "status", "o_orderstatus", "true", "Violation"),
    "nodekind": ("nodeKind", "price", "o_totalprice::DECIMAL(18,2)::VARCHAR", "true", "Violation"),
    "in": ("in", "status", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')", "Violation"),
    "pattern": ("pattern", "priority", "o_orderpriority", "NOT regexp_matches(o_orderpriority, '^[1-3]')", "Violation"),
    "minlength": ("minLength", "priority", "o_orderpriority", "length(o_orderpriority) < 6", "Violation"),
    "hasvalue": ("hasValue", "status", "NULL", "o_orderstatus <> 'O'", "Violation"),
    "disjoint": ("disjoint", "priority", "o_orderpriority", NOTE, "Violation"),
    "class": ("class", "customer", CUST, f"NOT {SOLVENT}", "Warning"),
    "qualified": ("qualifiedMinCount", "customer", "NULL", f"NOT {SOLVENT}", "Violation"),
    "closed": ("closed", "note", "o_orderpriority", NOTE, "Warning"),
}


def _violations_sql(name: str) -> str:
    component, path, value, where, severity = CONSTRAINTS[name]
    return f"SELECT {ORDER} AS focus, '{P}{path}' AS path, '{component}' AS component, '{severity}' AS severity, {value}::VARCHAR AS value, '{SHAPE}' AS shape FROM orders WHERE {where}"


@functools.cache
def _compiled(app: str) -> tuple:
    from pyspark.sql import SparkSession

    from quadrille.sources import turtle

    return tuple(S.constraints_of(turtle.read_text(SparkSession.active(), ORDER_SHAPES, "g")).collect())  # the twelve of one shape


def order_constraints(spark, *components: str):
    """The constraints of the shapes graph, compiled once a session."""
    rows = [r for r in _compiled(spark.sparkContext.applicationId) if not components or r.component in components]
    return spark.createDataFrame(rows, S.CONSTRAINT)


def _violations(name: str):
    def run(spark, sf):
        rules = order_constraints(spark, CONSTRAINTS[name][0])
        return S.check(rules, order_focus(spark, sf).select(F.lit(SHAPE).alias("shape"), "focus"), order_values(spark, sf), customer_types(spark, sf)).select(*S.REPORT)

    return run


for _name in CONSTRAINTS:
    query(f"shacl_{_name}", _violations_sql(_name))(_violations(_name))


def _report(spark, sf):
    return S.check(order_constraints(spark), order_focus(spark, sf).select(F.lit(SHAPE).alias("shape"), "focus"), order_values(spark, sf), customer_types(spark, sf)).select(*S.REPORT)


REPORT_SQL = "report AS (" + " UNION ALL ".join(f"({_violations_sql(n)})" for n in CONSTRAINTS) + ")"


@query("shacl_report", f"WITH {REPORT_SQL} SELECT component, severity, count(*) AS n, count(DISTINCT focus) AS nodes FROM report GROUP BY component, severity")
def shacl_report(spark, sf):
    return _report(spark, sf).groupBy("component", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("focus").alias("nodes"))


@query("shacl_severity_split", f"WITH {REPORT_SQL} SELECT count(*) FILTER (severity = 'Violation') = 0 AS conforms, count(*) FILTER (severity = 'Violation') AS violations, count(*) FILTER (severity = 'Warning') AS warnings FROM report")
def shacl_severity_split(spark, sf):
    return S.conforms(_report(spark, sf))


@query("shacl_from_graph", f"WITH {REPORT_SQL} SELECT shape, path, component, severity, count(*) AS n, count(DISTINCT value) AS vals, CASE WHEN component = 'class' THEN 'no solvent customer' END AS message FROM report GROUP BY ALL")
def shacl_from_graph(spark, sf):
    """Data quads against the shapes graph: targets, lists, severities and messages all come from quads."""
    from quadrille.operators import quads as Q
    from quadrille.sources import turtle

    cells = order_values(spark, sf)
    kind, value, path, dt = F.col("o_kind"), F.col("o"), F.col("path"), F.col("o_dt")
    data = cells.select(F.lit(M.MAIN).alias("g"), F.col("focus").alias("s"), path.alias("p"), value.alias("o"), F.lit(T.IRI).alias("s_kind"), kind.alias("o_kind"), dt.alias("o_dt"), F.lit(None).cast("string").alias("o_lang"), F.lit(False).alias("inferred"))
    types = [Q.quads_of(order_focus(spark, sf), F.col("focus"), T.RDF_TYPE, F.lit("urn:x:type/order"), M.MAIN), Q.quads_of(customer_types(spark, sf), F.col("s"), T.RDF_TYPE, F.col("c"), M.MAIN)]
    report = S.validate_graph(Q.union(data, *types), turtle.read_text(spark, ORDER_SHAPES, "g"))
    return report.groupBy("shape", "path", "component", "severity", "message").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("vals"))


SHAPES = [  # shape, class, properties (path, datatype, min), graph
    ("urn:x:PlaceShape", "urn:x:c/Place", [("urn:x:p/name", T.XSD + "string", 1), ("urn:x:p/code", T.XSD + "integer", None)], "core"),
    ("urn:x:CityShape", "urn:x:c/City", [("urn:x:p/mayor", None, 1)], "core"),
    ("urn:x:CityShape2", "urn:x:c/City", [("urn:y:p/name", T.XSD + "string", None)], "kernel"),
]


def surface(spark):
    rows = [("core", c, T.RDF_TYPE, T.OWL + "Class", 1, 1, None, None, False) for c in ("urn:x:c/Place", "urn:x:c/City", "urn:x:c/Ghost")]
    rows += [("core", "urn:x:c/City", T.SUBCLASS, "urn:x:c/Place", 1, 1, None, None, False), ("core", "urn:x:c/City", T.COMMENT, "a city", 1, 3, None, None, False), ("core", "urn:x:p/mayor", T.COMMENT, "who governs", 1, 3, None, None, False)]
    for shape, target, props, g in SHAPES:
        rows += [(g, shape, T.RDF_TYPE, T.SHACL + "NodeShape", 1, 1, None, None, False), (g, shape, T.SHACL + "targetClass", target, 1, 1, None, None, False)]
        for path, dt, least in props:
            node = f"{shape}/{path}"
            rows += [(g, shape, T.SHACL + "property", node, 1, 2, None, None, False), (g, node, T.SHACL + "path", path, 2, 1, None, None, False)]
            if dt:
                rows.append((g, node, T.SHACL + "datatype", dt, 2, 1, None, None, False))
            if least is not None:
                rows.append((g, node, T.SHACL + "minCount", str(least), 2, 3, T.XSD + "integer", None, False))
    from quadrille.operators.quads import SCHEMA

    return spark.createDataFrame(rows, SCHEMA)


@query("propmap_with_ancestors", "SELECT * FROM (VALUES ('urn:x:c/City', 'name', 'urn:y:p/name'), ('urn:x:c/City', 'code', 'urn:x:p/code'), ('urn:x:c/City', 'mayor', 'urn:x:p/mayor'), ('urn:x:c/Place', 'name', 'urn:x:p/name'), ('urn:x:c/Place', 'code', 'urn:x:p/code')) t(type, key, path)")
def propmap(spark, sf):
    q = surface(spark)
    ancestors = spark.createDataFrame([("urn:x:c/City", "urn:x:c/City"), ("urn:x:c/City", "urn:x:c/Place"), ("urn:x:c/Place", "urn:x:c/Place")], "type string, ancestor string")
    return S.property_map(S.property_shapes(q), ancestors, {"kernel": 0, "core": 1})


@query("surface_unshaped", "SELECT 'urn:x:c/Ghost' AS class")
def surface_unshaped(spark, sf):
    return S.unshaped(surface(spark))


@query("surface_explain", "SELECT * FROM (VALUES ('urn:x:c/City', NULL, 'a city'), ('urn:x:c/City', 'urn:x:p/mayor', 'who governs'), ('urn:x:c/City', 'urn:y:p/name', NULL)) t(type, path, comment)")
def surface_explain(spark, sf):
    return S.explained(surface(spark), spark.createDataFrame([("urn:x:c/City",)], "type string"))


@query("declared_predicates", "SELECT 'urn:y:p/name' AS predicate")
def declared_predicates(spark, sf):
    """The paths that the kernel's own shapes declare."""
    from quadrille.dispatch import declared_predicates as declared

    return declared(surface(spark), "kernel")


@query("affordance_schema", "SELECT * FROM (VALUES ('urn:x:PlaceShape', 'urn:x:p/name', 'http://www.w3.org/2001/XMLSchema#string', 1), ('urn:x:PlaceShape', 'urn:x:p/code', 'http://www.w3.org/2001/XMLSchema#integer', NULL)) t(shape, path, datatype, min_count)")
def affordance_schema(spark, sf):
    return S.property_shapes(surface(spark)).where("shape = 'urn:x:PlaceShape'").select("shape", "path", "datatype", "min_count")


@query("type_admitted", "SELECT 'urn:x:type/' || event_type AS type, count(*) AS n, bool_or(event_type IN ('click', 'view', 'error')) AS admitted, bool_or(event_type IN ('click', 'view')) AS shaped FROM events GROUP BY event_type")
def type_admitted(spark, sf):
    from quadrille.operators.quads import SCHEMA

    q = spark.createDataFrame([("core", f"urn:x:{t}Shape", T.SHACL + "targetClass", f"urn:x:type/{t}", 1, 1, None, None, False) for t in ("click", "view")] + [("core", "urn:x:type/error", T.RDF_TYPE, T.OWL + "Class", 1, 1, None, None, False)], SCHEMA)
    n = read_table(spark, sf, "events").groupBy(F.concat(F.lit("urn:x:type/"), "event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return S.admitted(n.select("type"), q).join(n, "type").select("type", "n", "admitted", "shaped")


@query("shapes_self_test", "SELECT * FROM (VALUES ('urn:x:PlaceShape', 'urn:x:c/Place', true), ('urn:x:CityShape', 'urn:x:c/City', true), ('urn:x:CityShape2', 'urn:x:c/City', true)) t(shape, target, present)")
def shapes_self_test(spark, sf):
    return S.self_test(surface(spark))


# --- ledger ------------------------------------------------------------------------------------------------------


def ledger_of(spark, sf):
    rows = L.hashed(M.event_bodies(spark, sf), M.KEY)
    return L.chained(rows, "instance_id")


def proofs_of(spark, sf):
    b = L.hashed(M.event_bodies(spark, sf), M.KEY)
    return b.select(F.col("seq").alias("id"), F.col("instance_id").alias("about"), F.lit("sha256").alias("method"), F.when(F.col("instance_id").endswith("7"), "0").otherwise(F.col("body_sha256")).alias("digest"))


SIG = hmac_sql("body", M.KEY)


@query("seal_hash_sign", f"WITH {M.BODIES_SQL} SELECT seq, sha256(body) AS body_sha256, {SIG} AS sig FROM bodies")
def seal_hash_sign(spark, sf):
    return L.hashed(M.event_bodies(spark, sf), M.KEY).select("seq", "body_sha256", "sig")


@query("ledger_chain", f"WITH {M.BODIES_SQL} SELECT seq, instance_id, lag(seq) OVER (PARTITION BY instance_id ORDER BY seq) AS prev_seq FROM bodies")
def ledger_chain(spark, sf):
    return ledger_of(spark, sf).select("seq", "instance_id", "prev_seq")


@query("ledger_append", f"WITH {M.BODIES_SQL}, old AS (SELECT * FROM bodies WHERE type <> 'purchase'), n AS (SELECT max(seq) AS m FROM old) SELECT m + row_number() OVER (ORDER BY ts, instance_id, sha256(body)) AS seq, sha256(body) AS body_sha256 FROM bodies, n WHERE type = 'purchase'")
def ledger_append(spark, sf):
    b = M.event_bodies(spark, sf)
    old = ledger_of(spark, sf).where("type != 'purchase'").select("seq", "instance_id", "body_sha256", "sig", "prev_seq", "ts")
    return L.append(b.where("type = 'purchase'").select("instance_id", "body", "ts"), old, M.KEY).select("seq", "body_sha256")


@query("ledger_append_ties", f"""WITH {M.BODIES_SQL}, n AS (SELECT row_number() OVER (ORDER BY instance_id, sha256(body)) AS seq, instance_id, sha256(body) AS body_sha256 FROM bodies)
SELECT seq, instance_id, body_sha256, lag(seq) OVER (PARTITION BY instance_id ORDER BY seq) AS prev_seq FROM n""")  # fmt: skip
def ledger_append_ties(spark, sf):
    """All events sealed at one moment: order by id and body hash, numbers without gaps."""
    rows = M.event_bodies(spark, sf).select("instance_id", "body", F.lit("2025-01-01").cast("timestamp").alias("ts"))
    return L.append(rows, ledger_of(spark, sf).where("seq < 0").select("seq", "instance_id", "body_sha256", "sig", "prev_seq", "ts"), M.KEY).select("seq", "instance_id", "body_sha256", "prev_seq")


@query("verify_instances", f"""WITH {M.BODIES_SQL}, last AS (SELECT instance_id, max(seq) AS seq FROM bodies GROUP BY 1)
SELECT instance_id AS id, NOT ends_with(instance_id, '7') AND NOT ends_with(instance_id, '3') AS verified FROM last""")  # fmt: skip
def verify_instances(spark, sf):
    b = M.event_bodies(spark, sf)
    now = b.groupBy(F.col("instance_id").alias("id")).agg(F.max_by("body", "seq").alias("body"))
    tampered = now.withColumn("body", F.when(F.col("id").endswith("3"), F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return L.verify(tampered, ledger_of(spark, sf), proofs_of(spark, sf), M.KEY)


@query("verify_full_chain", f"""WITH {M.BODIES_SQL}, c AS (SELECT seq, instance_id, lag(seq) OVER (PARTITION BY instance_id ORDER BY seq) AS real_prev FROM bodies)
SELECT seq, instance_id FROM c WHERE seq % 97 = 0 AND (real_prev IS NULL OR real_prev <> -1)""")  # fmt: skip
def verify_full_chain(spark, sf):
    broken = ledger_of(spark, sf).withColumn("prev_seq", F.when(F.col("seq") % 97 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("prev_seq")))
    return L.broken_links(broken).select("seq", "instance_id")


@query("latest_proof", f"WITH {M.BODIES_SQL} SELECT instance_id AS about, arg_max(CASE WHEN ends_with(instance_id, '7') THEN '0' ELSE sha256(body) END, seq) AS digest, count(*) AS n_proofs FROM bodies GROUP BY 1")
def latest_proof(spark, sf):
    return L.latest_proof(proofs_of(spark, sf))


@query("provenance_rollup", f"WITH {M.BODIES_SQL} SELECT instance_id AS id, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS seqs, count(*) AS n_rows, count(*) AS n_proofs, arg_max(CASE WHEN ends_with(instance_id, '7') THEN '0' ELSE sha256(body) END, seq) AS digest FROM bodies GROUP BY 1")
def provenance_rollup(spark, sf):
    return L.provenance(ledger_of(spark, sf), proofs_of(spark, sf))


@query("proofs_plural", f"WITH {M.BODIES_SQL} SELECT instance_id AS about, count(*) AS n FROM bodies GROUP BY 1 HAVING count(*) > 1")
def proofs_plural(spark, sf):
    return proofs_of(spark, sf).groupBy("about").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("latest_view", f"WITH {M.BODIES_SQL} SELECT instance_id, max(seq) AS seq, arg_max(body, seq) AS body FROM bodies GROUP BY 1")
def latest_view(spark, sf):
    return L.latest(M.event_bodies(spark, sf).select("instance_id", "seq", "body"), "instance_id").select("instance_id", "seq", "body")


@query("seal_gate", f"""SELECT {ORDER} AS id, CASE WHEN o_orderstatus = 'P' THEN 'type not admitted: urn:x:type/P' ELSE '{P}priority pattern' END AS reason FROM orders
WHERE o_orderstatus = 'P' OR NOT regexp_matches(o_orderpriority, '^[1-3]')""".replace("CASE WHEN", f"CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]') AND '{P}priority pattern' < 'type not admitted' THEN '{P}priority pattern' WHEN"))  # fmt: skip
def seal_gate(spark, sf):
    o = read_table(spark, sf, "orders").select(M.iri("order", "o_orderkey").alias("id"), F.concat(F.lit("urn:x:type/"), "o_orderstatus").alias("type"))
    report = _violations("pattern")(spark, sf)
    known = spark.createDataFrame([("urn:x:type/F", True), ("urn:x:type/O", True), ("urn:x:type/P", False)], "type string, admitted boolean")
    _, refused = L.gate(o, report, known)
    return refused


@query("seal_stamps", f"SELECT {ORDER} AS id, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' END AS conforms_to, 'shop' AS produced_by, 7::BIGINT AS sealed_at_epoch FROM orders")
def seal_stamps(spark, sf):
    o = read_table(spark, sf, "orders").select(M.iri("order", "o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"))
    shapes = spark.createDataFrame([("B", "F"), ("A", "F"), ("B", "O")], "shape string, target string")
    return L.stamped(o, shapes, 7, "me", "shop").select("id", "conforms_to", "produced_by", "sealed_at_epoch")


# --- derived values ----------------------------------------------------------------------------------------------


def _scope(spark, sf):
    return read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", "c_acctbal")


NUM = D.NUMBER.upper()


@query("derived_sum", f"SELECT c_nationkey AS concept, sum(round(c_acctbal * 1.5, 4)::{NUM}) AS value, count(c_acctbal) AS scored FROM customer GROUP BY 1")
def derived_sum(spark, sf):
    return D.derived_sum(D.contributions(_scope(spark, sf), F.col("c_nationkey"), "round(c_acctbal * 1.5, 4)"))


@query("derived_dispersion", f"SELECT c_nationkey AS concept, sum((c_acctbal - 4500)::{NUM}) AS net, sum(abs((c_acctbal - 4500)::{NUM})) AS volume FROM customer GROUP BY 1")
def derived_dispersion(spark, sf):
    return D.dispersion(D.contributions(_scope(spark, sf), F.col("c_nationkey"), "cast(c_acctbal AS decimal(18,2)) - 4500"))


SQL["derived_dispersion"] = f"SELECT c_nationkey AS concept, sum((c_acctbal::DECIMAL(18,2) - 4500)::{NUM}) AS net, sum(abs((c_acctbal::DECIMAL(18,2) - 4500)::{NUM})) AS volume FROM customer GROUP BY 1"
SQL["derived_sum"] = f"SELECT c_nationkey AS concept, sum((c_acctbal::DECIMAL(18,2) * 1.5)::{NUM}) AS value, count(c_acctbal) AS scored FROM customer GROUP BY 1"
QUERIES["derived_sum"] = lambda spark, sf: D.derived_sum(D.contributions(_scope(spark, sf), F.col("c_nationkey"), "cast(c_acctbal AS decimal(18,2)) * 1.5"))


@query("source_watermark", "SELECT c_nationkey AS concept, coalesce(max(s), 0)::BIGINT AS watermark FROM customer LEFT JOIN (SELECT user_id, max(event_id) AS s FROM events GROUP BY 1) ON user_id = c_custkey GROUP BY 1")
def source_watermark(spark, sf):
    ledger = read_table(spark, sf, "events").select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("seq"))
    scope = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("concept"), F.col("c_custkey").alias("instance_id"))
    return D.watermark(ledger, scope)


def _pointers(spark, sf):
    """Two pointers for each nation, the second at the watermark of even nations only."""
    n = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("concept"))
    p = n.select(F.lit("sum").alias("plan"), "concept", F.explode(F.array(F.lit(1), F.lit(2))).alias("built_at"))
    return p.select("plan", "concept", F.concat_ws("/", F.lit("urn:x:built"), "concept", "built_at").alias("graph_iri"), F.lit(3).alias("epoch"), F.when((F.col("built_at") == 2) & (F.col("concept") % 2 == 0), 100).otherwise(50).alias("watermark"), F.when(F.col("concept") % 3 == 0, F.lit("2020-01-01").cast("timestamp")).alias("valid_until"), "built_at")


@query("phenotype_fresh", "SELECT 'sum' AS plan, n_nationkey AS concept, n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AS fresh FROM nation")
def phenotype_fresh(spark, sf):
    marks = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("concept"), F.lit(100).alias("watermark"))
    return D.fresh(_pointers(spark, sf), marks, 3, F.lit("2024-01-01").cast("timestamp"))


@query("phenotype_gc", "SELECT 'urn:x:built/' || n_nationkey || '/1' AS graph_iri FROM nation")
def phenotype_gc(spark, sf):
    p = _pointers(spark, sf)
    return D.unreferenced(p.select("graph_iri"), p)


@query("score_decay", """SELECT user_id AS concept, sum(round(coalesce(CASE WHEN event_type <> 'view' THEN value END, 0.5 * (1 - exp(-value / 30.0))) * exp(-0.1 * ((epoch(TIMESTAMP '2025-01-01') - floor(epoch(ts))) / 86400.0)), 9)::DECIMAL(38,9)) AS score FROM events GROUP BY 1""")
def score_decay(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("concept"), "ts", F.when(F.col("event_type") != "view", F.col("value")).alias("weight"), F.col("value").alias("dwell"))
    return D.decayed_score(e, F.lit("2025-01-01").cast("timestamp"), 0.1, 30.0, 0.5)


# --- governance --------------------------------------------------------------------------------------------------


@query("quorum_distinct_approvers", """SELECT event_type AS proposal, count(DISTINCT user_id) FILTER (value >= 100 AND user_id % 10 <> 0) AS approvers, count(DISTINCT user_id) FILTER (value >= 100 AND user_id % 10 <> 0) >= 120 AS applied FROM events GROUP BY 1""")
def quorum(spark, sf):
    e = read_table(spark, sf, "events")
    who = F.when(F.col("user_id") % 10 == 0, F.lit("anonymous")).otherwise(F.col("user_id").cast("string"))
    votes = e.select(F.col("event_type").alias("proposal"), F.when(F.col("value") >= 100, "approve").otherwise("reject").alias("value"), who.alias("created_by"))
    return G.quorum(votes, e.select(F.col("event_type").alias("proposal")).distinct().withColumn("requires_quorum", F.lit(120)))


@query("epoch_bump", "SELECT c_mktsegment AS kernel, count(*) AS epoch FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def epoch_bump(spark, sf):
    return G.epochs(read_table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_mktsegment").alias("kernel"), F.col("c_custkey").alias("seq")))


def _plans(spark, sf):
    o = read_table(spark, sf, "orders")
    owner = F.when(F.col("o_orderkey") % 4 == 0, F.lit(G.FLOOR)).otherwise((F.col("o_custkey") % 50).cast("string"))
    return o.select(owner.alias("kernel"), F.col("o_orderstatus").alias("verb"), F.col("o_orderkey").alias("epoch"))


@query("plan_resolution_own_then_floor", """WITH plans AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'floor' ELSE (o_custkey % 50)::VARCHAR END AS owner, o_orderstatus AS verb, o_orderkey AS epoch FROM orders),
asked AS (SELECT k::VARCHAR AS kernel, v AS verb FROM range(60) t(k), (VALUES ('F'), ('P')) w(v))
SELECT kernel, verb, owner, epoch FROM (SELECT a.kernel, a.verb, p.owner, p.epoch, row_number() OVER (PARTITION BY a.kernel, a.verb ORDER BY p.owner <> a.kernel, p.epoch DESC) AS nth
FROM asked a JOIN plans p ON p.verb = a.verb AND p.owner IN (a.kernel, 'floor')) WHERE nth = 1""")  # fmt: skip
def plan_resolution(spark, sf):
    asked = spark.range(60).select(F.col("id").cast("string").alias("kernel"), F.explode(F.array(F.lit("F"), F.lit("P"))).alias("verb"))
    newest = _plans(spark, sf).groupBy("kernel", "verb").agg(F.max("epoch").alias("epoch"))
    return G.resolve_plans(newest, asked).select("kernel", "verb", "owner", "epoch")


@query("registry_lookup", """WITH reg AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'floor' ELSE c_nationkey::VARCHAR END AS owner, 'do.' || (c_custkey % 40) AS verb, max(c_custkey) AS epoch FROM customer GROUP BY 1, 2),
asked AS (SELECT DISTINCT n_nationkey::VARCHAR AS kernel, 'do.' || v AS verb FROM nation, range(40) t(v))
SELECT a.kernel, a.verb, coalesce(o.owner, f.owner) AS owner, coalesce(o.epoch, f.epoch) AS epoch FROM asked a LEFT JOIN reg o ON o.owner = a.kernel AND o.verb = a.verb
LEFT JOIN reg f ON f.owner = 'floor' AND f.verb = a.verb WHERE o.owner IS NOT NULL OR f.owner IS NOT NULL""")  # fmt: skip
def registry_lookup(spark, sf):
    c = read_table(spark, sf, "customer")
    owner = F.when(F.col("c_custkey") % 3 == 0, F.lit(G.FLOOR)).otherwise(F.col("c_nationkey").cast("string"))
    plans = c.select(owner.alias("kernel"), F.concat(F.lit("do."), (F.col("c_custkey") % 40).cast("string")).alias("verb"), F.col("c_custkey").alias("epoch"))
    asked = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("kernel"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("v"))
    return G.resolve_plans(plans, asked.select("kernel", F.concat(F.lit("do."), F.col("v").cast("string")).alias("verb"))).select("kernel", "verb", "owner", "epoch")


PAIRS = [("click", "view"), ("view", "purchase"), ("view", "click"), ("signup", "view"), ("planned", "signup"), ("planned", "view")]


def _steps(spark, sf):
    return G.steps(read_table(spark, sf, "events").select(F.lit("urn:x:type/Visit").alias("type"), "event_id", "user_id", "event_type", "ts"), "user_id", "event_type", "ts", "event_id")


def _transitions(spark, sf, typed: bool):
    allowed = spark.createDataFrame([("urn:x:type/Visit" if typed else None, a, b) for a, b in PAIRS], "type string, from_state string, to_state string")
    return G.transitions(_steps(spark, sf), allowed)


STEPS_SQL = "steps AS (SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'planned') AS f, event_type AS t FROM events)"
PAIR_SQL = "(" + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ")"


@query("transition_legal", f"WITH {STEPS_SQL} SELECT event_id, f AS from_state, t AS to_state FROM steps WHERE (f, t) IN {PAIR_SQL}")
def transition_legal(spark, sf):
    return _transitions(spark, sf, True).where("legal").select("event_id", "from_state", "to_state")


@query("transition_illegal", f"WITH {STEPS_SQL} SELECT f AS from_state, t AS to_state, count(*) AS n FROM steps WHERE (f, t) NOT IN {PAIR_SQL} GROUP BY 1, 2")
def transition_illegal(spark, sf):
    return _transitions(spark, sf, True).where("NOT legal").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


@query("transition_fallback", f"WITH {STEPS_SQL} SELECT 'fallback' AS source, (f, t) IN {PAIR_SQL} AS legal, count(*) AS n FROM steps GROUP BY 1, 2")
def transition_fallback(spark, sf):
    return _transitions(spark, sf, False).groupBy("source", "legal").agg(F.count(F.lit(1)).alias("n"))


@query("obligation_digest_match", """SELECT event_id AS id, user_id::VARCHAR AS digest, floor(value / 50)::BIGINT AS epoch FROM events WHERE event_type <> 'view'
AND (user_id, floor(value / 50)::BIGINT) NOT IN (SELECT user_id, floor(value / 50)::BIGINT FROM events WHERE event_type = 'view' AND value IS NOT NULL) AND value IS NOT NULL""")  # fmt: skip
def obligation_digest_match(spark, sf):
    """Views seal an epoch, all other events cite one."""
    e = read_table(spark, sf, "events").where("value IS NOT NULL").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("digest"), F.floor(F.col("value") / 50).cast("bigint").alias("epoch"), "event_type")
    return G.unmatched_digests(e.where("event_type != 'view'"), e.where("event_type = 'view'").select("digest", "epoch").distinct())


@query("obligation_adopts_resolves", "SELECT doc_id AS id, source AS adopts FROM documents WHERE source NOT IN (SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND l.quality = 0)")
def obligation_adopts(spark, sf):
    d, lab = read_table(spark, sf, "documents"), read_table(spark, sf, "labels").where("toxic = 1 AND quality = 0")
    graphs = d.join(lab, "doc_id").select(F.col("source").alias("g"), F.lit(False).alias("inferred"))
    return G.unresolved_adoptions(d.select(F.col("doc_id").alias("id"), F.col("source").alias("adopts")), graphs).select("id", "adopts")


@query("obligation_structural_pin", f"""WITH {M.STRUCTURE_SQL} SELECT g, digest AS digest_now, g <> '{M.MAIN}' AS drifted FROM structure UNION ALL SELECT 'urn:x:g/gone', NULL, true""")
def obligation_structural_pin(spark, sf):
    from quadrille.operators.quads import structural_digest

    now = structural_digest(M.quads(spark, sf))
    pins = now.withColumn("digest", F.when(F.col("g") == M.MAIN, F.col("digest")).otherwise(F.lit("old"))).unionAll(spark.createDataFrame([("urn:x:g/gone", "old")], "g string, digest string"))
    return G.drifted(pins, now).select("g", "digest_now", "drifted")


QUERIES["adoption_drift"], SQL["adoption_drift"] = lambda spark, sf: obligation_structural_pin(spark, sf).where("drifted").select("g"), f"SELECT * FROM (VALUES ('{M.ALT}'), ('urn:x:g/gone')) t(g)"


@query("obligation_no_warnings", f"WITH {REPORT_SQL} SELECT focus AS id, count(*) AS warnings FROM report WHERE severity = 'Warning' GROUP BY 1")
def obligation_no_warnings(spark, sf):
    return G.warned(_report(spark, sf))


@query("affordances_unsealed", "SELECT DISTINCT 'do.' || o_orderpriority AS verb FROM orders EXCEPT SELECT 'do.' || o_orderpriority FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2')")
def affordances_unsealed(spark, sf):
    verbs = read_table(spark, sf, "orders").select(F.concat(F.lit("do."), "o_orderpriority").alias("verb"))
    return A.declared_not_sealed(verbs, verbs.where(F.substring("verb", 4, 1).isin("1", "2")))


# --- audits ------------------------------------------------------------------------------------------------------


def _adoptions(spark, sf):
    into = F.when(F.col("doc_id") % 2 == 0, F.lit("shop")).when(F.col("doc_id") % 3 == 0, F.lit("urn:x:project/shop")).otherwise(F.lit("other"))
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("adopts"), into.alias("into_project"), F.col("n_chars").alias("ts"))


def _supersessions(spark, sf):
    return read_table(spark, sf, "labels").select(F.col("doc_id").alias("supersedes"))


@query("adopted_graphs", "SELECT doc_id AS id, source AS adopts, n_chars AS ts FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND (doc_id % 2 = 0 OR doc_id % 3 = 0)")
def adopted_graphs(spark, sf):
    return A.adopted(_adoptions(spark, sf), _supersessions(spark, sf), "shop")


@query("fleet_adoptions", """SELECT doc_id AS id, source AS adopts, CASE WHEN doc_id % 2 = 0 THEN 'shop' WHEN doc_id % 3 = 0 THEN 'urn:x:project/shop' ELSE 'other' END AS into_project,
coalesce(n, 0) AS quads, true AS malformed, CASE WHEN source = 'src1' THEN 'd' END AS pin FROM documents LEFT JOIN (SELECT 'src' || (event_id % 15) AS s, count(*) AS n FROM events GROUP BY 1) ON s = source WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")  # fmt: skip
def fleet_adoptions(spark, sf):
    graphs = read_table(spark, sf, "events").select(F.concat(F.lit("src"), (F.col("event_id") % 15).cast("string")).alias("g"))
    return A.fleet(_adoptions(spark, sf), _supersessions(spark, sf), graphs, spark.createDataFrame([("src1", "d")], "g string, digest string"))


@query("integrity_dangling", "SELECT 'dangling' AS check_name, user_id::VARCHAR AS subject, (user_id * 50)::VARCHAR AS detail FROM (SELECT DISTINCT user_id FROM events) WHERE user_id * 50 NOT IN (SELECT c_custkey FROM customer)")
def integrity_dangling(spark, sf):
    refs = read_table(spark, sf, "events").select("user_id", (F.col("user_id") * 50).alias("ref")).distinct()
    return A.dangling(refs, "ref", read_table(spark, sf, "customer"), "c_custkey", "dangling", "user_id")


@query("integrity_vacuous", "SELECT 'vacuous' AS check_name, doc_id::VARCHAR AS subject, 'no label' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def integrity_vacuous(spark, sf):
    bare = read_table(spark, sf, "documents").join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")
    return A.findings("vacuous", bare, F.col("doc_id"), "no label")


@query("integrity_unattributed", "SELECT 'unattributed' AS check_name, p_partkey::VARCHAR AS subject, 'nobody supplies it' AS detail FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def integrity_unattributed(spark, sf):
    supplied = read_table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return A.findings("unattributed", read_table(spark, sf, "part").join(supplied, "p_partkey", "left_anti"), F.col("p_partkey"), "nobody supplies it")


@query("authority_chain", """WITH held AS (SELECT n_nationkey AS role, n_regionkey AS grant_id FROM nation UNION SELECT n_nationkey, n_nationkey % 5 FROM nation)
SELECT c_custkey AS participant, min(role) AS role, grant_id::VARCHAR AS grant_id, 'read:' || r_name AS permission FROM customer JOIN held ON role = c_nationkey JOIN region ON r_regionkey = grant_id GROUP BY c_custkey, grant_id, r_name""")  # fmt: skip
def authority_chain(spark, sf):
    members = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("participant"), F.col("c_nationkey").alias("role"))
    roles = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("role"), F.array(F.col("n_regionkey").cast("string")).alias("granted"), (F.col("n_nationkey") % 5).cast("string").alias("via"))
    grants = read_table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("grant_id"), F.concat(F.lit("read:"), "r_name").alias("permission"))
    return A.authority(members, roles, grants)


@query("wave_signals_counts", "SELECT count(*) AS total, count(DISTINCT event_type) AS states, count(*) FILTER (event_type = 'error') AS findings, count(*) FILTER (event_type = 'signup' AND value > 100) AS pending FROM events")
def wave_signals_counts(spark, sf):
    return A.census(read_table(spark, sf, "events"), "event_type", {"findings": F.col("event_type") == "error", "pending": (F.col("event_type") == "signup") & (F.col("value") > 100)})


@query("wave_this_pass", "SELECT event_id AS id FROM events WHERE event_type = 'purchase' OR value > 450 OR (event_type = 'error' AND value > 300)")
def wave_this_pass(spark, sf):
    e = read_table(spark, sf, "events")
    return e.where((F.col("event_type") == "purchase") | (F.col("value") > 450) | ((F.col("event_type") == "error") & (F.col("value") > 300))).select(F.col("event_id").alias("id"))


@query("wave_next_queue", "SELECT o_custkey AS kernel, count(*) AS open_tasks, min(o_orderkey) AS next_task FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def wave_next_queue(spark, sf):
    return read_table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("kernel")).agg(F.count(F.lit(1)).alias("open_tasks"), F.min("o_orderkey").alias("next_task"))


@query("outbox_project", f"""WITH {M.BODIES_SQL} SELECT seq AS ledger_seq, 'event.kernel.shop.' || type || '.sealed' AS subject, body AS payload, seq::VARCHAR AS seq_header, 'user' AS by_header FROM bodies""")
def outbox_project(spark, sf):
    rows = M.event_bodies(spark, sf).withColumn("created_by", F.lit("user"))
    e = X.events(rows, "shop")
    return e.select("ledger_seq", "subject", F.decode("payload", "UTF-8").alias("payload"), F.col("headers")["Ck-Seq"].alias("seq_header"), F.col("headers")["by"].alias("by_header"))


@query("outbox_drain_batch", "SELECT floor((event_id - 1) / 100.0)::BIGINT AS batch, count(*) AS n, min(event_id) AS first_seq FROM events GROUP BY 1")
def outbox_drain_batch(spark, sf):
    b = X.batches(read_table(spark, sf, "events").select(F.col("event_id").alias("ledger_seq")))
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("ledger_seq").alias("first_seq"))


@query("permissions", """SELECT 'u' || c_custkey AS sub, d AS direction, replace(replace(t, 'K', k), 'S', 'u' || c_custkey) AS subject FROM customer,
(VALUES ('publish', 'input.kernel.K.id.S.action.>'), ('subscribe', 'result.kernel.K.>'), ('subscribe', 'event.kernel.K.>')) w(d, t), (VALUES (0), (1)) x(i),
LATERAL (SELECT CASE i WHEN 0 THEN lower(c_mktsegment) ELSE 'common' END AS k) y""")  # fmt: skip
def permissions(spark, sf):
    c = read_table(spark, sf, "customer")
    return A.permissions(c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("sub"), F.array(F.lower("c_mktsegment"), F.lit("common")).alias("kernels")))

"""Queries over quads: patterns, reachability, entailment, digests, scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quadrille.dispatch import Context, dispatch
from quadrille.functions import terms as T
from quadrille.operators import closure as C
from quadrille.operators import entail as E
from quadrille.operators import pattern as P
from quadrille.operators import quads as Q
from quadrille.operators.numbering import numbered
from quadrille.plans import model as M
from quadrille.session import ensure_checkpoint_dir, read_table
from quadrille.sources import nquads

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TYPE = T.RDF_TYPE

REACH_SQL = f"""WITH RECURSIVE {M.EDGES_SQL},
r(node) AS (SELECT o FROM edges WHERE s = 'urn:x:region/1' UNION SELECT e.o FROM edges e JOIN r ON e.s = r.node)
SELECT node FROM r"""


@query("reach_transitive", REACH_SQL)
def reach_transitive(spark, sf):
    ctx = Context("checks", quads=M.contains_edges(spark, sf), declared=[M.CONTAINS])
    return dispatch(ctx, "instance.reach", {"from": "urn:x:region/1", "via": M.CONTAINS}).select("node")


@query("reach_cycle", """WITH RECURSIVE e AS (SELECT DISTINCT user_id AS s, user_id - user_id % 5 + (user_id + 1) % 5 AS o FROM events),
r(s, o) AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON e.s = r.o)
SELECT s::BIGINT AS src, o::BIGINT AS dst FROM r""")  # fmt: skip
def reach_cycle(spark, sf):
    """All users, in rings of five; rounds go on until one finds nothing."""
    u = F.col("user_id")
    e = read_table(spark, sf, "events").select(u.alias("src"), (u - u % 5 + (u + 1) % 5).alias("dst"))
    return C.closure(e, max_depth=None).pairs.select("src", "dst")


@query("bgp_two_hop", f"""WITH {M.QUADS_SQL} SELECT DISTINCT a.s AS region, b.o AS customer FROM quads a JOIN quads b ON a.o = b.s
JOIN quads t ON t.s = b.o AND t.p = '{TYPE}' AND t.o = 'urn:x:type/customer' JOIN quads u ON u.s = a.s AND u.p = '{TYPE}' AND u.o = 'urn:x:type/region'
WHERE a.p = '{M.CONTAINS}' AND b.p = '{M.CONTAINS}'""")  # fmt: skip
def bgp_two_hop(spark, sf):
    q = M.quads(spark, sf)
    return P.match(q, [("?region", TYPE, "urn:x:type/region"), ("?region", M.CONTAINS, "?nation"), ("?nation", M.CONTAINS, "?customer"), ("?customer", TYPE, "urn:x:type/customer")]).select("region", "customer").distinct()


@query("bgp_optional", f"""WITH {M.QUADS_SQL} SELECT DISTINCT t.s AS node, l.o AS label FROM quads t LEFT JOIN quads l ON l.s = t.s AND l.p = '{T.LABEL}'
WHERE t.p = '{TYPE}' AND t.o IN ('urn:x:type/nation', 'urn:x:type/supplier')""")  # fmt: skip
def bgp_optional(spark, sf):
    q = M.quads(spark, sf)
    nodes = P.alternatives(P.one(q, ("?node", TYPE, "urn:x:type/nation")), P.one(q, ("?node", TYPE, "urn:x:type/supplier")))
    return P.optional(nodes, P.one(q, ("?node", T.LABEL, "?label"))).select("node", "label")


@query("bgp_union", f"""WITH {M.QUADS_SQL} SELECT DISTINCT s AS node FROM quads WHERE p = '{T.LABEL}' UNION SELECT DISTINCT s FROM quads WHERE p = '{M.SUPPLIES}'""")
def bgp_union(spark, sf):
    """Nodes alone are made distinct, so no task holds the pairs."""
    q = M.quads(spark, sf, repeats=True)
    return P.alternatives(*(P.one(q, ("?node", p, "?x"), distinct=False).select("node") for p in (T.LABEL, M.SUPPLIES)))


@query("bgp_minus", f"""WITH {M.QUADS_SQL} SELECT DISTINCT s AS supplier FROM quads t WHERE p = '{TYPE}' AND o = 'urn:x:type/supplier'
AND NOT EXISTS (SELECT 1 FROM quads c WHERE c.s = t.s AND c.p = '{M.SUPPLIES}' AND c.o = 'urn:x:part/7')""")  # fmt: skip
def bgp_minus(spark, sf):
    q = M.quads(spark, sf)
    return P.minus(P.one(q, ("?supplier", TYPE, "urn:x:type/supplier")), P.one(q, ("?supplier", M.SUPPLIES, "urn:x:part/7")))


@query("bgp_filter_strstarts", f"WITH {M.QUADS_SQL} SELECT DISTINCT s, p, o FROM quads WHERE starts_with(o, 'urn:x:nation/1') AND p <> '{TYPE}'")
def bgp_filter_strstarts(spark, sf):
    return P.one(M.quads(spark, sf), ("?s", "?p", "?o")).where(F.startswith("o", F.lit("urn:x:nation/1")) & (F.col("p") != TYPE))


@query("bgp_filter_contains", f"WITH {M.QUADS_SQL} SELECT DISTINCT s, o AS label FROM quads WHERE p = '{T.LABEL}' AND o_kind = 3 AND contains(lower(o), 'ation_2')")
def bgp_filter_contains(spark, sf):
    q = M.quads(spark, sf).where(F.col("o_kind") == T.LITERAL)
    return P.one(q, ("?s", T.LABEL, "?label")).where(F.contains(F.lower("label"), F.lit("ation_2")))


@query("bgp_group_count", f"WITH {M.QUADS_SQL} SELECT s AS node, count(DISTINCT o) AS n FROM quads WHERE p = '{M.CONTAINS}' GROUP BY s")
def bgp_group_count(spark, sf):
    return P.one(M.quads(spark, sf), ("?node", M.CONTAINS, "?x")).groupBy("node").agg(F.count_distinct("x").alias("n"))


@query("bgp_ask", f"WITH {M.QUADS_SQL} SELECT count(*) > 0 AS answer FROM quads WHERE s = 'urn:x:region/0' AND p = '{M.CONTAINS}'")
def bgp_ask(spark, sf):
    return P.ask(P.one(M.quads(spark, sf), ("urn:x:region/0", M.CONTAINS, "?x")))


@query("bgp_any_graph", f"""WITH {M.QUADS_SQL} SELECT DISTINCT a.g, a.s AS supplier, b.o AS part FROM quads a JOIN quads b ON a.g = b.g AND a.s = b.s
WHERE a.p = '{M.SUPPLIES}' AND b.p = '{M.SUPPLIES}' AND a.o = 'urn:x:part/7'""")  # fmt: skip
def bgp_any_graph(spark, sf):
    return P.match(M.quads(spark, sf), [("?supplier", M.SUPPLIES, "urn:x:part/7"), ("?supplier", M.SUPPLIES, "?part")], same_graph=True).select("g", "supplier", "part")


@query("board_recover_kernels", """SELECT n_nationkey AS nation, count(DISTINCT c_custkey) AS kernels, count(*) AS tasks FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def board_recover_kernels(spark, sf):
    o, c, n = (read_table(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_nationkey").alias("nation")).agg(F.count_distinct("c_custkey").alias("kernels"), F.count(F.lit(1)).alias("tasks"))


# --- entailment ---------------------------------------------------------------------------------------------


def _classes(spark, sf):
    """part -> noun of its name -> its type -> root, as subclasses; parts as members."""
    p = read_table(spark, sf, "part")
    noun = F.concat(F.lit("urn:x:noun/"), F.element_at(F.split("p_name", " "), 2))
    kind = F.concat(F.lit("urn:x:kind/"), "p_type")
    return Q.union(
        Q.quads_of(p, M.iri("part", "p_partkey"), TYPE, noun, M.MAIN),
        Q.quads_of(p.select(noun.alias("n"), kind.alias("k")).distinct(), F.col("n"), T.SUBCLASS, F.col("k"), M.MAIN),
        Q.quads_of(p.select(kind.alias("k")).distinct(), F.col("k"), T.SUBCLASS, F.lit("urn:x:kind"), M.MAIN),
    )


CLASSES_SQL = """sub AS (SELECT DISTINCT 'urn:x:noun/' || split_part(p_name, ' ', 2) AS c, 'urn:x:kind/' || p_type AS d FROM part
  UNION SELECT DISTINCT 'urn:x:kind/' || p_type, 'urn:x:kind' FROM part),
up AS (SELECT c, d FROM sub UNION SELECT a.c, b.d FROM sub a JOIN sub b ON a.d = b.c),
typ AS (SELECT 'urn:x:part/' || p_partkey AS x, 'urn:x:noun/' || split_part(p_name, ' ', 2) AS c FROM part)"""


@query("entail_subclass", f"""WITH {CLASSES_SQL} SELECT x AS s, '{TYPE}' AS p, d AS o FROM typ JOIN up USING (c) GROUP BY x, d
UNION ALL SELECT c, '{T.SUBCLASS}', d FROM up EXCEPT SELECT c, '{T.SUBCLASS}', d FROM sub""")  # fmt: skip
def entail_subclass(spark, sf):
    return E.entail(_classes(spark, sf)).where("inferred").select("s", "p", "o")


def _declare(spark, *rows):
    return spark.createDataFrame([(M.MAIN, s, p, o, T.IRI, T.IRI, None, None, False) for s, p, o in rows], Q.SCHEMA)


#: Containment and all that lies at any depth below.
DEEP_SQL = f"""{M.EDGES_SQL}, deep(s, o) AS (SELECT s, o FROM edges UNION SELECT d.s, e.o FROM deep d JOIN edges e ON d.o = e.s)"""


@query("entail_transitive", f"WITH RECURSIVE {DEEP_SQL} SELECT s, o FROM deep EXCEPT SELECT s, o FROM edges")
def entail_transitive(spark, sf):
    q = Q.union(M.contains_edges(spark, sf), _declare(spark, (M.CONTAINS, TYPE, T.OWL + "TransitiveProperty")))
    return E.entail(q).where(F.col("inferred") & (F.col("p") == M.CONTAINS)).select("s", "o")


@query("entail_transitive_inverse", f"""WITH RECURSIVE {DEEP_SQL} SELECT s, '{M.CONTAINS}' AS p, o FROM deep WHERE (s, o) NOT IN (SELECT s, o FROM edges)
UNION ALL SELECT o, 'urn:x:p/within', s FROM deep""")  # fmt: skip
def entail_transitive_inverse(spark, sf):
    """The suppliers' edges are told the other way round, so each rule needs the other's results."""
    edges = M.contains_edges(spark, sf)
    turned = F.startswith("o", F.lit("urn:x:supplier/"))
    within = edges.where(turned).select("g", F.col("o").alias("s"), F.lit("urn:x:p/within").alias("p"), F.col("s").alias("o"), "s_kind", "o_kind", "o_dt", "o_lang", "inferred")
    rules = _declare(spark, (M.CONTAINS, TYPE, T.OWL + "TransitiveProperty"), (M.CONTAINS, T.OWL + "inverseOf", "urn:x:p/within"))
    found = E.entail(Q.union(edges.where(~turned), within, rules)).where(F.col("p").isin(M.CONTAINS, "urn:x:p/within"))
    # what the tables say either way is no inference; the rest is
    told = (F.col("p") == M.CONTAINS) & (~F.col("inferred") | F.startswith("o", F.lit("urn:x:supplier/")) & F.startswith("s", F.lit("urn:x:nation/")))
    return found.where(~told).select("s", "p", "o")


@query("entail_inverse", f"WITH {M.EDGES_SQL} SELECT o AS s, s AS o FROM edges")
def entail_inverse(spark, sf):
    q = Q.union(M.contains_edges(spark, sf), _declare(spark, (M.CONTAINS, T.OWL + "inverseOf", "urn:x:p/within")))
    return E.entail(q).where("inferred AND p = 'urn:x:p/within'").select("s", "o")


@query("entail_hasvalue", f"WITH {M.EDGES_SQL} SELECT s FROM edges WHERE o = 'urn:x:order/7'")
def entail_hasvalue(spark, sf):
    q = Q.union(M.contains_edges(spark, sf), _declare(spark, ("urn:x:c/HasSeven", T.OWL + "onProperty", M.CONTAINS), ("urn:x:c/HasSeven", T.OWL + "hasValue", "urn:x:order/7")))
    return E.entail(q).where("inferred AND o = 'urn:x:c/HasSeven'").select("s")


@query("entail_chain", f"WITH {M.EDGES_SQL} SELECT DISTINCT a.s, c.o FROM edges a JOIN edges b ON a.o = b.s JOIN edges c ON b.o = c.s")
def entail_chain(spark, sf):
    """A property chain of three steps, as an RDF list."""
    cells = [(f"urn:x:l/{k}", T.RDF + "first", M.CONTAINS) for k in (1, 2, 3)] + [("urn:x:l/1", T.RDF + "rest", "urn:x:l/2"), ("urn:x:l/2", T.RDF + "rest", "urn:x:l/3"), ("urn:x:l/3", T.RDF + "rest", T.RDF + "nil")]
    q = Q.union(M.contains_edges(spark, sf), _declare(spark, ("urn:x:p/regionOf", T.OWL + "propertyChainAxiom", "urn:x:l/1"), *cells))
    return E.entail(q).where("inferred AND p = 'urn:x:p/regionOf'").select("s", "o")


@query("entail_domain", f"WITH {M.EDGES_SQL} SELECT DISTINCT s FROM edges")
def entail_domain(spark, sf):
    q = Q.union(M.contains_edges(spark, sf), _declare(spark, (M.CONTAINS, T.DOMAIN, "urn:x:c/Place")))
    return E.entail(q).where("inferred AND o = 'urn:x:c/Place'").select("s")


@query("entail_somevalues", f"WITH {M.EDGES_SQL} SELECT DISTINCT s FROM edges WHERE starts_with(o, 'urn:x:supplier/')")
def entail_somevalues(spark, sf):
    typed = Q.quads_of(read_table(spark, sf, "supplier"), M.iri("supplier", "s_suppkey"), TYPE, F.lit("urn:x:type/supplier"), M.MAIN)
    rule = _declare(spark, ("urn:x:c/Supplied", T.OWL + "onProperty", M.CONTAINS), ("urn:x:c/Supplied", T.OWL + "someValuesFrom", "urn:x:type/supplier"))
    return E.entail(Q.union(M.contains_edges(spark, sf), typed, rule)).where("inferred AND o = 'urn:x:c/Supplied'").select("s")


@query("entail_equivalent", "SELECT 'urn:x:supplier/' || s_suppkey AS s FROM supplier")
def entail_equivalent(spark, sf):
    typed = Q.quads_of(read_table(spark, sf, "supplier"), M.iri("supplier", "s_suppkey"), TYPE, F.lit("urn:x:type/supplier"), M.MAIN)
    return E.entail(Q.union(typed, _declare(spark, ("urn:x:c/Vendor", T.OWL + "equivalentClass", "urn:x:type/supplier")))).where("inferred AND o = 'urn:x:c/Vendor'").select("s")


@query("explain_direct_vs_inferred", f"""WITH {CLASSES_SQL} SELECT (SELECT count(*) FROM typ) + (SELECT count(*) FROM sub) AS direct,
(SELECT count(*) FROM (SELECT DISTINCT x, d FROM typ JOIN up USING (c))) + (SELECT count(*) FROM up) - (SELECT count(*) FROM sub) AS inferred""")  # fmt: skip
def explain_direct_vs_inferred(spark, sf):
    return Q.direct_and_inferred(E.entail(_classes(spark, sf)))


# --- digests, census, documents as quads ---------------------------------------------------------------------


@query("copy_digest", f"WITH {M.QUADS_SQL}, lines AS (SELECT g, s || '|' || p || '|' || o AS line FROM quads), {M.tree_sql('digests', 'lines', 'g')} SELECT g, digest FROM digests")
def copy_digest(spark, sf):
    return Q.copy_digest(M.quads(spark, sf))


@query("structural_digest", f"WITH {M.STRUCTURE_SQL} SELECT g, digest FROM structure")
def structural_digest(spark, sf):
    return Q.structural_digest(M.quads(spark, sf))


@query("surface_grounding", f"""WITH {M.QUADS_SQL} SELECT g, count(*) AS asserted, 0::BIGINT AS inferred, count(*) FILTER (s_kind <> 2 AND o_kind <> 2) AS ground, count(*) FILTER (s_kind = 2 OR o_kind = 2) AS blank,
count(DISTINCT s) FILTER (s_kind = 2) AS blank_nodes, 0::BIGINT AS nodeshapes, 0::BIGINT AS property_shapes, 0::BIGINT AS declared_properties FROM quads GROUP BY g""")  # fmt: skip
def surface_grounding(spark, sf):
    return Q.grounding(M.quads(spark, sf))


@query("compose_surface", f"WITH {M.QUADS_SQL} SELECT DISTINCT 'urn:x:g/all' AS g, s, p, o FROM quads")
def compose_surface(spark, sf):
    return Q.compose(M.quads(spark, sf), "urn:x:g/all", M.MAIN, M.ALT).select("g", "s", "p", "o")


@query("body_to_quads", f"""SELECT 'urn:x:event/' || event_id AS s, '{TYPE}' AS p, 'urn:x:type/' || event_type AS o, NULL AS o_dt FROM events
UNION ALL SELECT 'urn:x:event/' || event_id, 'urn:x:p/user', 'urn:x:user/' || user_id, NULL FROM events
UNION ALL SELECT 'urn:x:event/' || event_id, 'urn:x:p/k', json_extract_string(props, '$.k'), '{T.XSD}integer' FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")  # fmt: skip
def body_to_quads(spark, sf):
    e = read_table(spark, sf, "events")
    body = F.to_json(F.struct(F.concat(F.lit("urn:x:type/"), "event_type").alias("type"), M.iri("user", "user_id").alias("urn:x:p/user"), F.get_json_object("props", "$.k").cast("bigint").alias("urn:x:p/k"), F.lit(1).alias("plain")))
    return Q.body_to_quads(e.select(M.iri("event", "event_id").alias("id"), body.alias("body")), M.MAIN).select("s", "p", "o", "o_dt")


@query("json_explode_props", """SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events""")
def json_explode_props(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("predicate_census", f"WITH {M.QUADS_SQL} SELECT p AS predicate, count(*) AS n FROM quads GROUP BY p ORDER BY n DESC, p LIMIT 18")
def predicate_census(spark, sf):
    return M.quads(spark, sf).groupBy(F.col("p").alias("predicate")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predicate").limit(18)


# --- scalars -------------------------------------------------------------------------------------------------


@query("slug", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS slug FROM part")
def slug(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("urn_normalise", "SELECT c_custkey, regexp_replace(lower(trim(c_name)), '[^a-z0-9-]+', '-', 'g') AS urn FROM customer")
def urn_normalise(spark, sf):
    return read_table(spark, sf, "customer").select("c_custkey", T.urn_normalise(F.col("c_name")).alias("urn"))


@query("publish_subject", "SELECT event_id, 'event.kernel.' || user_id || '.' || event_type || '.sealed' AS subject FROM events")
def publish_subject(spark, sf):
    return read_table(spark, sf, "events").select("event_id", T.publish_subject(F.col("user_id").cast("string"), F.concat(F.lit("urn:x:type/"), "event_type")).alias("subject"))


@query("local_and_namespace", f"WITH {M.QUADS_SQL} SELECT DISTINCT p, regexp_replace(p, '^.*[/#]', '') AS local, regexp_replace(p, '[^/#]*$', '') AS ns FROM quads")
def local_and_namespace(spark, sf):
    return M.quads(spark, sf).select("p", T.local_name(F.col("p")).alias("local"), T.namespace(F.col("p")).alias("ns")).distinct()


VERBS = [*T.CANONICAL_VERBS, "instance.query", "concept.match"]


@query("verb_canon", "SELECT verb, CASE verb " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.CANONICAL_VERBS.items()) + " ELSE verb END AS canonical FROM (VALUES " + ", ".join(f"('{v}')" for v in VERBS) + ") t(verb)")
def verb_canon(spark, sf):
    return spark.createDataFrame([(v,) for v in VERBS], "verb string").select("verb", T.canonical_verb(F.col("verb")).alias("canonical"))


@query("dict_intern", "SELECT iri, row_number() OVER (ORDER BY first, iri) AS handle FROM (SELECT p_name AS iri, min(p_partkey) AS first FROM part GROUP BY p_name)")
def dict_intern(spark, sf):
    first = read_table(spark, sf, "part").groupBy(F.col("p_name").alias("iri")).agg(F.min("p_partkey").alias("first"))
    return numbered(first, ["first", "iri"], name="handle").select("iri", "handle")


@query("subject_match", "SELECT event_type, count(*) AS n FROM events WHERE regexp_matches('event.kernel.' || user_id || '.' || event_type || '.sealed', '^event\\.kernel\\.[^.]+\\.click\\..+$') GROUP BY event_type")
def subject_match(spark, sf):
    e = read_table(spark, sf, "events").withColumn("subject", T.publish_subject(F.col("user_id").cast("string"), F.col("event_type")))
    return e.where(T.subject_matches(F.col("subject"), "event.kernel.*.click.>")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("route_inbound", """SELECT event_id, user_id::VARCHAR AS kernel, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS sender, 'do.' || event_type AS verb FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_type = 'error'""")  # fmt: skip
def route_inbound(spark, sf):
    sender = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(".id.u"), F.col("user_id").cast("string"))).otherwise(F.lit(""))
    good = F.concat(F.lit("input.kernel."), F.col("user_id").cast("string"), sender, F.lit(".action.do."), "event_type")
    subject = F.when(F.col("event_type") == "error", F.concat(F.lit("output."), good)).otherwise(good)
    return read_table(spark, sf, "events").select("event_id", *T.route(subject))


@query("nquads_round_trip", f"WITH RECURSIVE {M.QUADS_SQL} SELECT DISTINCT g, s, p, o, s_kind, o_kind FROM quads")
def nquads_round_trip(spark, sf):
    path = f"{ensure_checkpoint_dir(spark)}/nquads-{uuid.uuid4().hex}"
    nquads.write(M.quads(spark, sf), path)
    return nquads.read(spark, path).select("g", "s", "p", "o", "s_kind", "o_kind")

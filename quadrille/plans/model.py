"""The model's frames over the driver's tables, and the same frames as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import quads as Q
from quadrille.session import read_table

MAIN, ALT = "urn:x:g/main", "urn:x:g/alt"
CONTAINS, SUPPLIES = "urn:x:p/contains", "urn:x:p/supplies"
KEY = b"a key for checks"


def iri(table: str, column: str):
    return F.concat(F.lit(f"urn:x:{table}/"), F.col(column).cast("string"))


def contains_edges(spark: SparkSession, sf: str) -> DataFrame:
    """region -> nation -> customer -> order, and nation -> supplier."""
    t = lambda n: read_table(spark, sf, n)
    return Q.union(
        Q.quads_of(t("nation"), iri("region", "n_regionkey"), CONTAINS, iri("nation", "n_nationkey"), MAIN),
        Q.quads_of(t("customer"), iri("nation", "c_nationkey"), CONTAINS, iri("customer", "c_custkey"), MAIN),
        Q.quads_of(t("supplier"), iri("nation", "s_nationkey"), CONTAINS, iri("supplier", "s_suppkey"), MAIN),
        Q.quads_of(t("orders"), iri("customer", "o_custkey"), CONTAINS, iri("order", "o_orderkey"), MAIN),
    )


def quads(spark: SparkSession, sf: str, repeats: bool = False) -> DataFrame:
    """Containment, types, labels and addresses (blank nodes) in one graph; what suppliers supply in another, with ``repeats`` once a lineitem, for patterns that bind distinct nodes anyway."""
    t = lambda n: read_table(spark, sf, n)
    typed = [Q.quads_of(t(n), iri(k, c), T.RDF_TYPE, F.lit(f"urn:x:type/{k}"), MAIN) for n, k, c in (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("orders", "order", "o_orderkey"))]
    labels = [Q.quads_of(t("region"), iri("region", "r_regionkey"), T.LABEL, F.col("r_name"), MAIN, T.LITERAL), Q.quads_of(t("nation"), iri("nation", "n_nationkey"), T.LABEL, F.col("n_name"), MAIN, T.LITERAL)]
    pairs = t("lineitem").select("l_suppkey", "l_partkey")
    supplies = Q.quads_of(pairs if repeats else pairs.distinct(), iri("supplier", "l_suppkey"), SUPPLIES, iri("part", "l_partkey"), ALT)
    c = t("customer")
    blank = F.concat(F.lit("address"), F.col("c_custkey").cast("string"))
    addresses = [Q.quads_of(c, iri("customer", "c_custkey"), "urn:x:p/address", blank, MAIN, T.BNODE), Q.quads_of(c, blank, "urn:x:p/inNation", iri("nation", "c_nationkey"), MAIN, s_kind=T.BNODE)]
    return Q.union(contains_edges(spark, sf), *typed, *labels, supplies, *addresses)


EDGES_SQL = f"""edges AS (
  SELECT 'urn:x:region/' || n_regionkey AS s, 'urn:x:nation/' || n_nationkey AS o FROM nation
  UNION ALL SELECT 'urn:x:nation/' || c_nationkey, 'urn:x:customer/' || c_custkey FROM customer
  UNION ALL SELECT 'urn:x:nation/' || s_nationkey, 'urn:x:supplier/' || s_suppkey FROM supplier
  UNION ALL SELECT 'urn:x:customer/' || o_custkey, 'urn:x:order/' || o_orderkey FROM orders)"""
QUADS_SQL = f"""{EDGES_SQL},
quads AS (
  SELECT '{MAIN}' AS g, s, '{CONTAINS}' AS p, o, 1 AS o_kind, 1 AS s_kind FROM edges
  UNION ALL SELECT '{MAIN}', 'urn:x:region/' || r_regionkey, '{T.RDF_TYPE}', 'urn:x:type/region', 1, 1 FROM region
  UNION ALL SELECT '{MAIN}', 'urn:x:nation/' || n_nationkey, '{T.RDF_TYPE}', 'urn:x:type/nation', 1, 1 FROM nation
  UNION ALL SELECT '{MAIN}', 'urn:x:customer/' || c_custkey, '{T.RDF_TYPE}', 'urn:x:type/customer', 1, 1 FROM customer
  UNION ALL SELECT '{MAIN}', 'urn:x:supplier/' || s_suppkey, '{T.RDF_TYPE}', 'urn:x:type/supplier', 1, 1 FROM supplier
  UNION ALL SELECT '{MAIN}', 'urn:x:order/' || o_orderkey, '{T.RDF_TYPE}', 'urn:x:type/order', 1, 1 FROM orders
  UNION ALL SELECT '{MAIN}', 'urn:x:region/' || r_regionkey, '{T.LABEL}', r_name, 3, 1 FROM region
  UNION ALL SELECT '{MAIN}', 'urn:x:nation/' || n_nationkey, '{T.LABEL}', n_name, 3, 1 FROM nation
  UNION ALL SELECT '{MAIN}', 'urn:x:customer/' || c_custkey, 'urn:x:p/address', 'address' || c_custkey, 2, 1 FROM customer
  UNION ALL SELECT '{MAIN}', 'address' || c_custkey, 'urn:x:p/inNation', 'urn:x:nation/' || c_nationkey, 1, 2 FROM customer
  UNION ALL SELECT DISTINCT '{ALT}', 'urn:x:supplier/' || l_suppkey, '{SUPPLIES}', 'urn:x:part/' || l_partkey, 1, 1 FROM lineitem)"""


def tree_sql(name: str, source: str, by: str) -> str:
    """The digest tree of ``quads.tree_digest`` as named queries; the last is ``name`` (by, digest)."""
    joined = lambda x: f"sha256(string_agg({x}, chr(10) ORDER BY {x}))"
    return f"""{name}_leaves AS (SELECT {by}, substr(sha256(line), 1, {Q.LEAF}) AS leaf, {joined('line')} AS d FROM {source} GROUP BY {by}, leaf),
{name}_branches AS (SELECT {by}, substr(leaf, 1, {Q.BRANCH}) AS branch, {joined("leaf || ' ' || d")} AS d FROM {name}_leaves GROUP BY {by}, branch),
{name} AS (SELECT {by}, {joined("branch || ' ' || d")} AS digest FROM {name}_branches GROUP BY {by})"""


_TERM = "CASE {0}_kind WHEN 1 THEN '<' || {0} || '>' WHEN 2 THEN '_:other' ELSE '\"' || {0} || '\"' END"
STRUCTURE_SQL = f"""{QUADS_SQL}, terms AS (SELECT *, {_TERM.format('s')} AS ts, '<' || p || '>' AS tp, {_TERM.format('o')} AS o_term FROM quads),
around AS (SELECT g, s AS b, '_:self ' || tp || ' ' || o_term AS line FROM terms WHERE s_kind = 2 UNION ALL SELECT g, o, ts || ' ' || tp || ' _:self' FROM terms WHERE o_kind = 2),
{tree_sql('nodes', 'around', 'g, b')},
lines AS (SELECT g, ts || ' ' || tp || ' ' || o_term AS line FROM terms WHERE s_kind <> 2 AND o_kind <> 2 UNION ALL SELECT g, digest FROM nodes),
{tree_sql('structure', 'lines', 'g')}"""


def event_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sealed bodies: seq, instance (the user), canonical JSON body, ts."""
    e = read_table(spark, sf, "events")
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return e.select(F.col("event_id").alias("seq"), iri("user", "user_id").alias("instance_id"), F.col("event_type").alias("type"), "value", body.alias("body"), "ts")


BODIES_SQL = """bodies AS (
  SELECT event_id AS seq, 'urn:x:user/' || user_id AS instance_id, event_type AS type, value,
    '{"id":' || event_id || ',"type":"' || event_type || '","user":' || user_id || '}' AS body, ts FROM events)"""

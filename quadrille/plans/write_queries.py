"""Queries over writes, references, the queue, audits of sealed documents and the vocabulary's governed reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import audits as A
from quadrille.operators import boot
from quadrille.operators import derived as D
from quadrille.operators import governed as V
from quadrille.operators import ledger as L
from quadrille.operators import quads as Q
from quadrille.operators import references as R
from quadrille.operators import seal as K
from quadrille.operators import writes as W
from quadrille.plans import model as M
from quadrille.session import read_table

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


TEXT = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
C = T.CORE

# --- writes ------------------------------------------------------------------------------------------------------


@query("instance_create", """SELECT event_id AS rid, event_type || '-' || event_id AS id, '{"@id":"doc://' || event_type || '#' || event_type || '-' || event_id || '","type":"urn:x:type/' || event_type || '","urn:x:board/created_at":"then","urn:x:p/own":true,"'
|| CASE event_type WHEN 'click' THEN 'urn:x:p/user' ELSE 'urn:x:type/user' END || '":' || user_id || '}' AS body FROM events""")  # fmt: skip
def instance_create(spark, sf):
    e = read_table(spark, sf, "events")
    asked = e.select(F.col("event_id").alias("rid"), TEXT("urn:x:type/", F.col("event_type")).alias("type"), TEXT('{"user":', F.col("user_id"), ',"urn:x:p/own":true,"sub":"forged"}').alias("fields"))
    return W.create(asked, spark.createDataFrame([("urn:x:type/click", "user", "urn:x:p/user")], "type string, key string, path string"), "then")[0]


def event_docs(spark, sf):
    return M.event_bodies(spark, sf).select(F.col("seq").cast("string").alias("id"), "type", "body", "ts")


@query("instance_retire", """SELECT event_id AS rid, CASE WHEN event_type = 'error' THEN NULL ELSE '{"id":' || event_id || ',"type":"' || event_type || '","urn:x:core#reason":"old","urn:x:core#retiredAtEpoch":7,"user":' || user_id || '}' END AS body,
CASE WHEN event_type = 'error' THEN 'reason required' END AS reason FROM events UNION ALL SELECT -1, NULL, 'unknown instance'""")  # fmt: skip
def instance_retire(spark, sf):
    e = read_table(spark, sf, "events")
    asked = e.select(F.col("event_id").alias("rid"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.lit(" old ")).alias("reason"))
    good, refused = W.retire(asked.unionAll(spark.createDataFrame([(-1, "none", "old")], asked.schema)), event_docs(spark, sf), 7)
    return good.select("rid", "body", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("rid", F.lit(None).cast("string").alias("body"), "reason"))


ORDER_STATE = "CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'planned' END"


@query("instance_transition", f"""SELECT CASE WHEN f = 'open' THEN '-' ELSE 'no step from ' || f || ' to done' END AS reason, count(*) AS n FROM (SELECT {ORDER_STATE} AS f FROM orders) GROUP BY 1""")
def instance_transition(spark, sf):
    o = read_table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "O", TEXT('{"state":"open"}')).when(F.col("o_orderstatus") == "F", TEXT('{"urn:x:board/lifecycle_state":"done"}')).otherwise(F.lit("{}"))
    docs = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("urn:x:type/Order").alias("type"), state.alias("body"))
    asked = o.select(F.col("o_orderkey").alias("rid"), F.col("o_orderkey").cast("string").alias("id"), F.lit("done").alias("to_state"))
    pairs = spark.createDataFrame([("urn:x:type/Order", "planned", "open"), ("urn:x:type/Order", "open", "done"), (None, "planned", "done")], "type string, from_state string, to_state string")
    good, refused, _ = W.transition(asked, docs, pairs)
    return good.select(F.lit("-").alias("reason")).unionAll(refused.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("instance_link", """SELECT o_orderkey AS rid, 'edge:' || c || '.has.' || o AS id, sha256('{"@id":"doc://Edge#edge:' || c || '.has.' || o || '","type":"urn:x:t/Edge","urn:x:t/created_at":"then","urn:x:t/predicate":"has","urn:x:t/source":"' || c || '","urn:x:t/target":"' || o || '","urn:x:t/topic":"link.has.' || c || '.' || o || '"}') AS sha
FROM (SELECT o_orderkey, 'c' || o_custkey AS c, 'o' || o_orderkey AS o FROM orders)""")  # fmt: skip
def instance_link(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("rid"), TEXT("c", F.col("o_custkey")).alias("source"), F.lit("has").alias("predicate"), TEXT("o", F.col("o_orderkey")).alias("target"), F.lit("urn:x:t/Edge").alias("type"))
    good, _ = W.link(o, spark.createDataFrame([("has",)], "predicate string"), "then")
    return good.select("rid", "id", F.sha2("body", 256).alias("sha"))


@query("reference_edges", """SELECT 'doc://c#' || o_custkey AS s, 'urn:x:board/has' AS p, CASE WHEN o_orderkey % 2 = 0 THEN 'doc://o#' || o_orderkey ELSE 'urn:x:instance:o' || o_orderkey END AS o FROM orders WHERE o_orderkey % 3 <> 0""")
def reference_edges(spark, sf):
    """Customers have stamped IRIs, even orders too, odd ones get minted ones, and every third order is unknown."""
    c, o = read_table(spark, sf, "customer"), read_table(spark, sf, "orders")
    docs = c.select(TEXT("c", F.col("c_custkey")).alias("id"), TEXT('{"@id":"doc://c#', F.col("c_custkey"), '"}').alias("body"))
    k = F.col("o_orderkey")
    docs = docs.unionAll(o.where(k % 3 != 0).select(TEXT("o", k).alias("id"), F.when(k % 2 == 0, TEXT('{"@id":"doc://o#', k, '"}')).otherwise(F.lit("{}"))))
    links = o.select(k.alias("rid"), TEXT("c", F.col("o_custkey")).alias("source"), F.lit("has").alias("predicate"), TEXT("o", k).alias("target"))
    return R.edges(links, docs, "g")[0].select("s", "p", "o")


LAW = f"""@prefix sh: <{T.SHACL}> . @prefix p: <urn:x:p/> . @prefix owl: <{T.OWL}> .
<urn:x:type/Order> a owl:Class .
<urn:x:shape/Sealed> a sh:NodeShape ; sh:targetClass <urn:x:type/Order> ; sh:property [ sh:path p:priority ; sh:pattern "^[1-3]" ] , [ sh:path p:price ; sh:minCount 1 ] .
"""


@query("seal_pipeline", """SELECT 'urn:x:order/' || o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'type not admitted: urn:x:type/Odd' WHEN NOT regexp_matches(o_orderpriority, '^[1-3]') THEN 'urn:x:p/priority pattern' END AS refused,
CASE WHEN o_orderstatus <> 'P' AND regexp_matches(o_orderpriority, '^[1-3]') THEN sha256('{"type":"urn:x:type/Order","urn:x:core#conformsToShape":"urn:x:shape/Sealed","urn:x:core#createdBy":"urn:x:participant:ann","urn:x:core#participant":"urn:x:participant:ann","urn:x:core#producedBy":"urn:x:shop/kernel/ck","urn:x:core#sealedAtEpoch":3,"urn:x:p/price":'
|| o_orderkey || ',"urn:x:p/priority":"' || o_orderpriority || '"}') END AS digest FROM orders""")  # fmt: skip
def seal_pipeline(spark, sf):
    """All orders through the whole seal: stamps, admitted types, shapes, hashes and numbers."""
    from quadrille.sources import turtle

    o = read_table(spark, sf, "orders")
    body = TEXT('{"type":"urn:x:type/', F.when(F.col("o_orderstatus") == "P", "Odd").otherwise("Order"), '","urn:x:p/priority":"', F.col("o_orderpriority"), '","urn:x:p/price":', F.col("o_orderkey"), ',"urn:x:core#createdBy":"forged"}')
    rows = o.select(F.col("o_orderkey").alias("rid"), M.iri("order", "o_orderkey").alias("id"), body.alias("body"))
    empty = spark.createDataFrame([], "seq bigint, instance_id string, body_sha256 string, sig string, prev_seq bigint, ts timestamp")
    out = K.seal(rows, empty, K.Surface.of(turtle.read_text(spark, LAW, "law")), K.Who("shop", "ann", M.KEY, 3), F.lit("2025-01-01").cast("timestamp"))
    none = F.lit(None).cast("string")
    return out.ledger.select(F.col("instance_id").alias("id"), none.alias("refused"), F.col("body_sha256").alias("digest")).unionAll(out.refused.select("id", "reason", none))


@query("queue_waiting", """WITH last AS (SELECT event_type AS plan, user_id::VARCHAR AS concept, max(ts) AS enqueued_at FROM events GROUP BY 1, 2), done AS (SELECT user_id::VARCHAR AS concept, max(ts) AS drained FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT plan, concept, enqueued_at FROM last LEFT JOIN done USING (concept) WHERE drained IS NULL OR drained < enqueued_at""")  # fmt: skip
def queue_waiting(spark, sf):
    e = read_table(spark, sf, "events").withColumn("concept", F.col("user_id").cast("string"))
    jobs = e.select(F.col("event_type").alias("plan"), "concept", F.col("ts").alias("enqueued_at"))
    done = e.where("event_type = 'purchase'").select("concept", F.col("ts").alias("drained_at"))
    plans = e.select(F.col("event_type").alias("plan"), "concept").distinct()
    return D.waiting(jobs, plans.join(done, "concept")).select("plan", "concept", "enqueued_at")


@query("registry_refresh", """SELECT c_mktsegment AS kernel, 'do.' || (c_custkey % 10) AS verb, 'urn:x:a/' || max(c_custkey) AS affordance, max(c_custkey)::INTEGER AS epoch, arg_max(CASE WHEN c_custkey % 2 = 0 THEN 'query' ELSE 'instance' END, c_custkey) AS plane,
arg_max(c_custkey % 3 = 0, c_custkey) AS delegate FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1, 2""")  # fmt: skip
def registry_refresh(spark, sf):
    """Customers as affordances; every seventh has a topic that is no route."""
    c, g, k = read_table(spark, sf, "customer"), "urn:x:g/a", F.col("c_custkey")
    node = M.iri("a", "c_custkey")
    topic = F.when(k % 7 == 0, F.lit("output.kernel.x")).otherwise(TEXT("input.kernel.", F.col("c_mktsegment"), ".action.do.", k % 10))
    lit = lambda rows, prop, value: Q.quads_of(rows, node, C + prop, value, g, T.LITERAL)
    q = Q.union(
        Q.quads_of(c, node, T.RDF_TYPE, F.lit(C + "Affordance"), g), lit(c, "inTopic", topic), lit(c, "epoch", TEXT(k, "^^<int>")),
        lit(c.where(k % 2 == 0), "plane", F.lit("query")), lit(c, "delegate", F.when(k % 3 == 0, "true").otherwise("false")),
    )
    return boot.registry(q).select("kernel", "verb", "affordance", "epoch", "plane", "delegate")


# --- audits of sealed documents ------------------------------------------------------------------------------------


def sealed_docs(spark, sf):
    """Customers as sealed documents of five core types."""
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Affordance", "Adoption", "Module", "Grant", "Organ")]), (k % 5 + 1).cast("int"))
    iri = F.when(k % 5 == 2, TEXT("urn:x:m/", k % 3)).when(k % 5 == 4, TEXT("urn:x:organ/", k % 2)).otherwise(TEXT("doc://", k))
    more = F.when(k % 5 == 0, TEXT(f',"{C}derivedBy":"urn:x:mat/', k % 7, '"')).when(k % 5 == 1, TEXT(f',"{C}adopts":"urn:x:m/', k % 4, '"')).when(k % 5 == 3, TEXT(f',"{C}permTarget":"urn:x:organ/', k % 3, '"')).otherwise(F.lit(""))
    by = F.when(k % 11 != 0, F.lit(f',"{C}createdBy":"ann"')).otherwise(F.lit(""))
    epoch = TEXT(f',"{C}sealedAtEpoch":', k % 2)
    body = TEXT('{"@id":"', iri, '"', more, by, epoch, F.when(k % 13 != 0, F.lit(f',"{C}conformsToShape":"urn:x:s"')).otherwise(F.lit("")), "}")
    return read_table(spark, sf, "customer").select(k.cast("string").alias("id"), TEXT(C, kind).alias("type"), body.alias("body"), F.lit("2025-01-01").cast("timestamp").alias("ts"))


@query("integrity_findings", """WITH k AS (SELECT c_custkey AS k FROM customer)
SELECT 'unattributed' AS check_name, k::VARCHAR AS subject, 'no one created it' AS detail FROM k WHERE k % 11 = 0
UNION ALL SELECT 'vacuous', k::VARCHAR, 'sealed under a gate that targeted nothing' FROM k WHERE k % 13 = 0 AND k % 2 = 1
UNION ALL SELECT 'dangling derivedBy', k::VARCHAR, 'urn:x:mat/' || (k % 7) FROM k WHERE k % 5 = 0
UNION ALL SELECT 'adoption without a module', k::VARCHAR, 'urn:x:m/' || (k % 4) FROM k WHERE k % 5 = 1 AND k % 4 NOT IN (SELECT k % 3 FROM k WHERE k % 5 = 2)
UNION ALL SELECT 'grant off the organs', k::VARCHAR, 'urn:x:organ/' || (k % 3) FROM k WHERE k % 5 = 3 AND k % 3 NOT IN (SELECT k % 2 FROM k WHERE k % 5 = 4)""")  # fmt: skip
def integrity_findings(spark, sf):
    return A.integrity(sealed_docs(spark, sf), spark.createDataFrame([], Q.SCHEMA))


@query("wave_signals", """SELECT 'inbox' AS section, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 3 = 0 UNION ALL SELECT 'thisPass', count(*) FROM events WHERE user_id % 20 = 7
UNION ALL SELECT 'openFindings', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 'blindSpots', 4""")  # fmt: skip
def wave_signals(spark, sf):
    w = T.WAVE
    e = read_table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "click", "Operation").when(F.col("event_type") == "error", "Finding").otherwise("Note")
    body = TEXT(f'{{"{w}opAtPass":', F.col("user_id") % 20, f',"{w}findingState":"open","{w}opTarget":"', F.when(F.col("user_id") % 3 == 0, "urn:x:shop/kernel").otherwise("urn:x:other"), '"}')
    docs = e.select(F.col("event_id").cast("string").alias("id"), TEXT(w, kind).alias("type"), body.alias("body"), "ts")
    found = A.signals(docs, "shop", 7)
    return found.where("section IN ('inbox', 'thisPass', 'openFindings', 'blindSpots')").groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("board_proofs", """SELECT 'k' || (user_id % 9) AS kernel, event_id AS queue_seq, 't' || event_id AS id, event_id % 4 <> 0 AS verified FROM events""")
def board_proofs(spark, sf):
    e = read_table(spark, sf, "events")
    body = TEXT(f'{{"{T.BOARD}target_kernel":"k', F.col("user_id") % 9, f'","{T.BOARD}queue_seq":', F.col("event_id"), "}")
    docs = e.select(TEXT("t", F.col("event_id")).alias("id"), F.lit(C + "Task").alias("type"), body.alias("body"), "ts", "event_id")
    log = L.hashed(docs.select(F.col("event_id").alias("seq"), F.col("id").alias("instance_id"), "body", "ts"), M.KEY).withColumn("prev_seq", F.lit(None).cast("bigint"))
    proofs = log.select(F.col("seq").alias("id"), F.col("instance_id").alias("about"), F.lit("sha256").alias("method"), F.when(F.col("seq") % 4 == 0, F.lit("0")).otherwise(F.col("body_sha256")).alias("digest"))
    return A.board(docs, log, proofs, M.KEY).select("kernel", "queue_seq", "id", "verified")


# --- the vocabulary's reads over a wave ---------------------------------------------------------------------------


def wave_quads(spark, sf):
    """Orders as tickets, events as operations, parts as defects, suppliers as rulings, customers as indexes with statements, regions as passes."""
    w, g = T.WAVE, "urn:x:g/wave"
    t = lambda n: read_table(spark, sf, n)
    o, e, p, s, c, r = t("orders"), t("events"), t("part"), t("supplier"), t("customer"), t("region")
    lit = lambda rows, node, prop, value: Q.quads_of(rows, node, w + prop, value, g, T.LITERAL)
    iri = lambda rows, node, prop, value: Q.quads_of(rows, node, w + prop, value, g)
    kind = lambda rows, node, name: Q.quads_of(rows, node, T.RDF_TYPE, F.lit(w + name), g)
    ticket, op, defect, ruling, index, passed = M.iri("t", "o_orderkey"), M.iri("op", "event_id"), M.iri("d", "p_partkey"), M.iri("r", "s_suppkey"), M.iri("i", "c_custkey"), M.iri("pass", "r_regionkey")
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("delivered")
    said = M.iri("st", "c_custkey")
    return Q.union(
        kind(o, ticket, "Ticket"), lit(o, ticket, "openedAtPass", F.col("o_custkey") % 20), lit(o, ticket, "ticketState", state),
        iri(o.where("o_orderkey % 2 = 0"), M.iri("cf", "o_orderkey"), "confirmsTicket", ticket),
        kind(e, op, "Operation"), lit(e, op, "opKind", F.when(F.col("event_type") == "error", "refute").when(F.col("event_type") == "signup", "supersede").otherwise(F.col("event_type"))), lit(e, op, "opAtPass", F.col("user_id") % 20),
        lit(e.where("value > 50"), op, "opEvidence", F.col("event_id")), iri(e.where("event_type = 'signup'"), op, "supersedes", M.iri("root", "user_id")),
        Q.quads_of(e, op, C + "createdBy", M.iri("user", "user_id"), g),
        kind(p, defect, "Defect"), lit(p, defect, "discoveredAtPass", F.col("p_size")), lit(p, defect, "resolvedAtPass", F.col("p_size") + F.col("p_partkey") % 7), lit(p.where("p_partkey % 3 = 0"), defect, "defectState", F.lit("declared")),
        kind(s, ruling, "Ruling"), lit(s.where("s_acctbal < 0"), ruling, "refutedAtPass", F.lit(3)),
        kind(c, index, "Index"), lit(c, index, "capacity", F.col("c_mktsegment")), iri(c, index, "filedBy", M.iri("nation", "c_nationkey")), iri(c.where("c_acctbal < 0"), index, "blockedOn", M.iri("t", "c_custkey")), iri(c, index, "forPass", M.iri("pass", "c_nationkey")),
        iri(c, M.iri("nation", "c_nationkey"), "statement", said), iri(c, said, "bindsRoot", M.iri("root", "c_custkey")), iri(c, said, "forPass", F.concat(F.lit("urn:x:pass/"), (F.col("c_custkey") % 5).cast("string"))),
        kind(r, passed, "Pass"), Q.quads_of(r, passed, C + "surfaceDigest", F.concat(F.lit("urn:x:root/"), "r_regionkey"), g),
    )


OP_KIND = "CASE event_type WHEN 'error' THEN 'refute' WHEN 'signup' THEN 'supersede' ELSE event_type END"
VOCABULARY_SQL = {
    "blocked": "SELECT 'urn:x:nation/' || c_nationkey AS c, 'urn:x:t/' || c_custkey AS t, 'urn:x:pass/' || c_nationkey AS p FROM customer WHERE c_acctbal < 0",
    "stale_tickets": "SELECT 'urn:x:t/' || o_orderkey AS t, (o_custkey % 20)::VARCHAR AS opened FROM orders WHERE o_orderstatus <> 'F'",
    "bound_elsewhere": "SELECT 'urn:x:nation/' || c_nationkey AS c, 'urn:x:root/' || c_custkey AS bound, 'urn:x:root/' || (c_custkey % 5) AS surface FROM customer JOIN region ON r_regionkey = c_custkey % 5 WHERE c_custkey <> c_custkey % 5",
    "capacity": "SELECT c_mktsegment AS cap, count(*) AS n FROM customer GROUP BY 1",
    "correction_rate": "SELECT count(*) AS n FROM supplier WHERE s_acctbal < 0",
    "unconfirmed": "SELECT 'urn:x:t/' || o_orderkey AS t FROM orders WHERE o_orderstatus NOT IN ('O', 'F') AND o_orderkey % 2 = 1",
    "stale_overwrite": "SELECT DISTINCT 'urn:x:root/' || user_id AS old FROM events WHERE event_type = 'signup' AND user_id IN (SELECT c_custkey FROM customer)",
    "operations_of_pass": f"SELECT {OP_KIND} AS k, count(*) AS n FROM events WHERE user_id % 20 = 12 GROUP BY 1",
    "declared_defects": "SELECT 'urn:x:d/' || p_partkey AS d FROM part WHERE p_partkey % 3 = 0",
    "belief_age": "SELECT 'urn:x:d/' || p_partkey AS d, (p_partkey % 7)::BIGINT AS passes FROM part",
    "without_evidence": "SELECT 'urn:x:op/' || event_id AS o FROM events WHERE NOT coalesce(value > 50, false)",
    "own_corrections": "SELECT count(*) AS n FROM events WHERE event_type = 'error'",
}


def _vocabulary(name: str):
    def run(spark, sf):
        spec = V.VOCABULARY[name]
        params = ["pass"] if "$pass$" in str(spec) else []
        return V.read(wave_quads(spark, sf), V.bind(spec, params, {"pass": "12"} if params else {}))

    return run


for _name, _sql in VOCABULARY_SQL.items():
    query(f"vocabulary_{_name}", _sql)(_vocabulary(_name))

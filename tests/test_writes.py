"""Write verbs through the door: create to verify, states, governance, refusals."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille.dispatch import Context, dispatch, dispatch_safe
from quadrille.functions import terms as T
from quadrille.operators import audits as A
from quadrille.operators import entail as E
from quadrille.operators import seal as K
from quadrille.operators import writes as W
from quadrille.operators.documents import Refused
from quadrille.sources import turtle

LAW = f"""
@prefix sh: <{T.SHACL}> . @prefix xsd: <{T.XSD}> . @prefix owl: <{T.OWL}> . @prefix rdfs: <{T.RDFS}> . @prefix c: <{T.CORE}> . @prefix t: <urn:t/> .
c:Proposal a owl:Class . c:Vote a owl:Class . c:Epoch a owl:Class . c:Materialization a owl:Class . c:Project a owl:Class . c:Kernel a owl:Class . t:Edge a owl:Class . t:Note a owl:Class .
t:Ship a owl:Class ; rdfs:subClassOf t:Vessel .
t:VesselShape a sh:NodeShape ; sh:targetClass t:Vessel ; sh:property [ sh:path t:name ; sh:minCount 1 ; sh:datatype xsd:string ] .
t:ShipShape a sh:NodeShape ; sh:targetClass t:Ship ; sh:property [ sh:path t:crew ; sh:datatype xsd:integer ; sh:maxCount 1 ] , [ sh:path t:flag ; sh:minLength 3 ; sh:severity sh:Warning ; sh:message "short flag" ] .
"""


@pytest.fixture(scope="module")
def law(spark):
    return E.entail(turtle.read_text(spark, LAW, "urn:x:demo/kernel/ck")).checkpoint()


def context(law, who="ann", **more):
    return Context("demo", who, b"secret", surface=law, **more)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_create_update_retire_and_verify(spark, law):
    ctx = context(law)
    rows = spark.createDataFrame(
        [(1, "urn:t/Ship", '{"name":"Ann","crew":5,"flag":"xy","@id":"forged","urn:x:core#createdBy":"urn:mallory"}'), (2, "urn:t/Ship", '{"crew":"many","name":"B"}'), (3, "urn:t/Rock", '{"name":"C"}'), (4, None, "{}"), (5, "Ship", "{}"), (6, "urn:t/Ship", "[1]"), (7, "urn:t/Ship", '{"crew":1}')],
        "rid bigint, type string, fields string",
    )
    got = {r.rid: r for r in dispatch(ctx, "instance.create", {"rows": rows}).collect()}
    assert {k for k, r in got.items() if r.ok} == {1} and got[1].id == "ship-1" and got[1].warnings == 1
    assert got[2].refused == "urn:t/crew datatype" and got[3].refused == "type not admitted: urn:t/Rock" and got[7].refused == "urn:t/name minCount"
    assert (got[4].refused, got[5].refused, got[6].refused) == ("type required", "the type must be an IRI", "fields must be an object")
    body = json.loads(one(dispatch(ctx, "instance.get", {"id": "ship-1"})).body)
    assert body["urn:t/crew"] == 5 and body["@id"] == "doc://Ship#ship-1" and body[T.CORE + "createdBy"] == "urn:x:participant:ann" and body[T.CORE + "conformsToShape"] == "urn:t/ShipShape"
    assert one(dispatch(ctx, "instance.verify", {"id": "ship-1"})).verified
    quads = {(r.p, r.o, r.o_dt) for r in ctx.quads.where("s = 'ship-1'").collect()}
    assert ("urn:t/crew", "5", T.XSD + "integer") in quads and (T.RDF_TYPE, "urn:t/Ship", None) in quads
    event = one(ctx.events)
    assert event.subject == "event.kernel.demo.Ship.sealed" and event.headers["by"] == "urn:x:participant:ann"
    # typed patch: numbers stay numbers, other fields stay as they are; the reference may be the stamped IRI
    asked = spark.createDataFrame([(10, "doc://Ship#ship-1", '{"crew":7,"urn:x:more":{"k":[1,2]},"type":"urn:t/Edge"}'), (11, "ship-1", '{"speed":1}'), (12, "nobody", "{}"), (13, "ship-1", "[]"), (14, None, "{}")], "rid bigint, id string, patch string")
    got = {r.rid: r for r in dispatch(ctx, "instance.update", {"rows": asked}).collect()}
    assert got[10].ok and (got[11].refused, got[12].refused, got[13].refused, got[14].refused) == ("undeclared patch key speed", "unknown instance", "the patch must be an object", "id required")
    after = json.loads(one(dispatch(ctx, "instance.get", {"id": "ship-1"})).body)
    assert after["urn:t/crew"] == 7 and after["urn:x:more"] == {"k": [1, 2]} and after["type"] == "urn:t/Ship" and after["urn:t/name"] == "Ann"
    assert one(dispatch(ctx, "instance.verify", {"id": "ship-1"})).verified
    assert one(dispatch(ctx, "instance.provenance", {"id": "ship-1"})).n_rows == 2
    assert one(dispatch(ctx, "instance.retire", {"id": "ship-1", "reason": " "})).refused == "reason required"
    assert one(dispatch(ctx, "instance.retire", {"id": "ship-1", "reason": "sunk"})).ok
    assert one(dispatch(ctx, "instance.retire", {"id": "ship-1", "reason": "again"})).refused == "already retired"
    assert [(r.check_name, r.subject) for r in A.integrity(ctx.docs, law).collect()] == []


def test_identity_and_evidence(spark, law):
    row = spark.createDataFrame([(1, "note-1", '{"type":"urn:t/Note"}')], "rid bigint, id string, body string")
    empty = spark.createDataFrame([], "seq bigint, instance_id string, body_sha256 string, sig string, prev_seq bigint, ts timestamp")
    seal = lambda who: K.seal(row, empty, K.Surface.of(law), who, F.current_timestamp())
    for who in (K.Who("demo", None, b"k"), K.Who("demo", " ", b"k"), K.Who("demo", "ann", b"k", residue="eyJ.token"), K.Who("demo", "ann", b"k", grant_ref="no iri >")):
        with pytest.raises(Refused):
            seal(who)
    out = seal(K.Who("demo", "Ann B", b"k", 3, "a" * 64, "urn:x:grant/1"))
    assert {(r.method, r.digest == "a" * 64) for r in out.proofs.collect()} == {("sha256", False), ("token-residue", True), ("grant-ref:urn:x:grant/1", False)}
    assert json.loads(one(out.instances).body)[T.CORE + "sealedAtEpoch"] == 3
    refused = one(dispatch_safe(spark, context(law, None), "instance.create", {"type": "urn:t/Note"}))
    assert not refused.ok and "unattributed" in refused.refused


def test_links_states_and_messages(spark, law):
    pairs = spark.createDataFrame([("urn:t/Note", "planned", "open"), ("urn:t/Note", "open", "done"), (None, "planned", "started")], "type string, from_state string, to_state string")
    ctx = context(law, allowed=pairs)
    notes = spark.createDataFrame([(k, "urn:t/Note", "{}") for k in (1, 2, 3)], "rid bigint, type string, fields string")
    assert dispatch(ctx, "instance.create", {"rows": notes}).where("ok").count() == 3
    steps = lambda *rows: {r.rid: r for r in dispatch(ctx, "instance.transition", {"rows": spark.createDataFrame(rows, "rid bigint, id string, to_state string")}).collect()}
    got = steps((1, "note-1", "open"), (2, "note-2", "started"), (3, "note-3", "no state!"), (4, "none", "open"), (5, "note-1", "open"))
    assert got[1].ok and (got[1].from_state, got[1].source) == ("planned", "sealed")
    assert (got[2].refused, got[3].refused, got[4].refused, got[5].refused) == ("no step from planned to started", "invalid state", "unknown instance", "changed twice in one batch")
    assert steps((6, "note-1", "done"))[6].ok and json.loads(one(dispatch(ctx, "instance.get", {"id": "note-1"})).body)["state"] == "done"
    links = [(1, "note-1", "urn:t/name", "note-2", "urn:t/Edge"), (2, "note-1", "urn:t/name", "note-1", "urn:t/Edge"), (3, "note-1", "unheard", "note-2", "urn:t/Edge"), (4, "note-1", "urn:t/name", "missing", "urn:t/Edge"), (5, "note-1", "urn:t/name", "note-3", None), (6, None, "urn:t/name", "note-3", "urn:t/Edge")]
    got = {r.rid: r for r in dispatch(ctx, "edge.create", {"rows": spark.createDataFrame(links, "rid bigint, source string, predicate string, target string, type string")}).collect()}
    assert got[1].ok and got[1].reachable and got[4].ok and not got[4].reachable
    assert [got[k].refused for k in (2, 3, 5, 6)] == ["no self loops", "undeclared predicate unheard", "edge type required", "source, predicate and target required"]
    reached = dispatch(ctx, "instance.reach", {"from": "doc://Note#note-1", "via": "urn:t/name"}).collect()
    assert [r.node for r in reached] == ["doc://Note#note-2"]
    assert one(dispatch(ctx, "notify", {"sender": "note-1", "predicate": "asks", "target": "note-2", "text": "hi", "type": "urn:t/Note"})).ok
    assert one(dispatch(ctx, "wave.project", {})).projected == ctx.docs.count()


def test_governed_change(spark, law):
    """Propose, vote, apply: the quorum is of distinct named parties, and what is applied judges what comes after."""
    ctx = context(law)
    said = dispatch(ctx, "kernel.propose_change", {"op": "add_property", "detail": {"class": "urn:t/Note", "path": "urn:t/topic", "minCount": 1}, "requires_quorum": 2})
    about = "doc://Proposal#" + one(said).id
    assert one(dispatch(ctx, "kernel.propose_change", {"op": "paint", "detail": {}})).refused == "no such operation"
    assert one(dispatch(ctx, "kernel.propose_change", {"op": "add_affordance", "detail": {"verb": "x"}})).refused == "the detail projects nothing"
    vote = lambda who, value="approve": (setattr(ctx, "requester", who), one(dispatch(ctx, "kernel.vote", {"about": about, "value": value})))[1]
    assert vote("ann").ok and vote("ann").ok and vote("bob", "reject").ok and vote("bob", "maybe").refused == "invalid vote"
    assert one(dispatch(ctx, "kernel.apply", {"about": about})).refused == "quorum not met: 1 of 2"
    assert vote("bob").ok
    done = dispatch(ctx, "kernel.apply", {"about": about}).collect()
    assert all(r.ok for r in done) and len(done) == 3 and ctx.epoch == 1
    assert one(dispatch(ctx, "instance.create", {"type": "urn:t/Note"})).refused == "urn:t/topic minCount"
    assert one(dispatch(ctx, "instance.create", {"type": "urn:t/Note", "topic": "x"})).ok
    assert one(dispatch(ctx, "kernel.vote", {"about": about, "value": "approve"})).refused == "the proposal is not pending"
    check = one(dispatch(ctx, "surface.check", {}))
    assert check.state == "named" and check.healthy and check.pinned == check.actual
    # a query and an obligation travel the same road
    query = {"where": [["?n", "urn:t/topic", "$topic$"]], "select": ["?n"]}
    for op, detail in (("add_affordance", {"verb": "notes.about", "query": query, "params": ["topic"]}), ("add_proof_obligation", {"obligation": "cites", "targetType": "urn:t/Note", "check": "adopts-resolves"})):
        about = "doc://Proposal#" + one(dispatch(ctx, "kernel.propose_change", {"op": op, "detail": detail})).id
        assert one(dispatch(ctx, "kernel.vote", {"about": about, "value": "approve"})).ok
        assert all(r.ok for r in dispatch(ctx, "kernel.apply", {"about": about}).collect())
    assert dispatch(ctx, "notes.about", {"topic": "x"}).count() == 1 and dispatch(ctx, "notes.about", {"topic": "y"}).isEmpty()
    for bad in ({}, {"topic": 'x"}'}, {"topic": "x", "more": "1"}):
        with pytest.raises(Refused):
            dispatch(ctx, "notes.about", bad)
    with pytest.raises(Refused):
        dispatch(ctx, "no.such", {})
    refused = one(dispatch(ctx, "instance.create", {"type": "urn:t/Note", "topic": "x", T.CORE + "adopts": "urn:x:nowhere"}))
    assert refused.refused == "proof obligation cites"
    ok = one(dispatch(ctx, "instance.create", {"type": "urn:t/Note", "topic": "z"}))
    assert "obligation:cites" in {r.method for r in ctx.proofs.where(F.col("about") == ok.id).collect()}
    with pytest.raises(Refused):
        dispatch(ctx, "kernel.germinate", {"project": "Not Canonical"})
    assert dispatch(ctx, "kernel.germinate", {"project": "fleet", "label": "Fleet"}).where("ok").count() == 2
    assert ctx.quads.where("g = 'urn:x:fleet/kernel/ck' AND p = 'urn:x:core#hasOrgan'").count() == 3


def test_requests_of_nothing(spark, law):
    none = spark.createDataFrame([], "rid bigint, type string, fields string")
    good, refused = W.create(none, spark.createDataFrame([], "type string, key string, path string"), "now")
    assert good.isEmpty() and refused.isEmpty()
    assert dispatch(context(law), "instance.create", {"rows": none}).isEmpty()


def test_what_the_surface_says_of_a_class(spark, law):
    extra = turtle.read_text(spark, f"@prefix sh: <{T.SHACL}> . <urn:m/S> a sh:NodeShape ; sh:targetClass <urn:t/Ship> ; sh:property [ sh:path <urn:m/port> ] .", "urn:m")
    board = turtle.read_text(spark, f"<urn:b/Card> a <{T.OWL}Class> .", "urn:x:demo/kernel/board")
    ctx = Context("demo", "ann", b"k", surface=law.unionByName(extra), quads=board, epoch=4)
    told = lambda name: one(dispatch(ctx, "surface.typecheck", {"type": name}))
    ship, card, none = told("urn:t/Ship"), told("urn:b/Card"), told("urn:t/Rock")
    assert (ship.admitted, ship.shaped, ship.via, ship.epoch) == (True, True, "composed", 4) and len(ship.digest) == 64
    assert (card.admitted, card.shaped, card.via) == (True, False, "board") and (none.admitted, none.via) == (False, None)
    got = {r.key: (r.path, r.kernel_path) for r in dispatch(ctx, "surface.declared", {"@type": "urn:t/Ship"}).collect()}
    assert got["port"] == ("urn:m/port", None) and got["crew"] == ("urn:t/crew", "urn:t/crew") and got["name"] == ("urn:t/name", "urn:t/name")
    for verb in ("surface.typecheck", "surface.declared"):
        for bad in ({}, {"type": " "}, {"type": "t:Ship"}):
            with pytest.raises(Refused):
                dispatch(ctx, verb, bad)

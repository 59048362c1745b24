import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quadrille.dispatch import Context, dispatch, dispatch_safe
from quadrille.functions import terms as T
from quadrille.operators import audits as A
from quadrille.operators import derived as D
from quadrille.operators import documents as O
from quadrille.operators import governance as G
from quadrille.operators import ledger as L
from quadrille.operators import quads as Q
from quadrille.operators import shapes as S
from quadrille.streaming import outbox as X

KEY = b"secret"


@pytest.fixture(scope="module")
def docs(spark):
    data = [("e1", "urn:t:E", '{"urn:t#color":"red","urn:t#rank":"3"}'), ("e2", "urn:t:E", '{"urn:t#color":"blue","urn:t#rank":"7"}'), ("e3", "urn:t:E", '{"urn:t#color":"red","urn:t#rank":"9"}'), ("e4", "urn:t:E", '{"urn:t#rank":"1.2.3"}')]
    return spark.createDataFrame(data, "id string, type string, body string").withColumn("ts", F.lit(dt.datetime(2024, 1, 1)))


def ids(df):
    return [r.id for r in df.collect()]


def test_filters(spark, docs):
    assert ids(O.query(docs, [("urn:t#color", "eq", "red")])) == ["e1", "e3"]
    assert ids(O.query(docs, [("rank", "gt", "5")])) == ["e2", "e3"]
    assert ids(O.query(docs, [("color", "neq", "red")])) == ["e2"]  # a missing key never passes
    assert ids(O.query(docs, [("color", "contains", "l_e")])) == ["e2"]
    assert ids(O.query(docs, [("rank", "lt", "x' OR '1'='1")])) == []
    assert ids(O.query(docs, [("color", "eq", "red' OR '1'='1")])) == []
    assert ids(O.query(docs, [], limit=2, offset=1)) == ["e2", "e3"]
    with pytest.raises(O.Refused):
        O.query(docs, [("color", "like", "r")])
    with pytest.raises(O.Refused):
        O.query(docs, [("speed", "eq", "1")], {"color": "color"})
    with pytest.raises(O.Refused):
        O.query(docs, [("speed", "eq", "1")])
    assert O.query(docs.limit(0), [("speed", "eq", "1")]).isEmpty()


def test_match(spark):
    labels = spark.createDataFrame([("1", "Rotate SPIFFE certificates"), ("2", "Audit firewall rules"), ("3", "Rotate database passwords"), ("4", "rotate")], "id string, label string")
    got = [(r.id, r["rank"]) for r in O.match_labels(labels, "ROTATE").collect()]
    assert got == [("4", 1), ("1", 2), ("3", 2)]
    assert O.match_labels(labels, "rotate' --").isEmpty()


def test_patch_and_allocate(spark):
    d = spark.createDataFrame([("a", '{"x":1,"y":"2","b":true,"o":{"k":[1,2]}}'), ("b", '{"x":"3"}'), ("c", '{"n":1.5}'), ("d", "[1]")], "id string, body string")
    p = spark.createDataFrame([("a", '{"y":9,"z":"8","n":null}'), ("c", "[7]"), ("d", '{"x":1}'), ("none", '{"x":1}')], "id string, patch string")
    assert {r.id: r.body for r in O.patch(d, p).collect()} == {"a": '{"b":true,"n":null,"o":{"k":[1,2]},"x":1,"y":9,"z":"8"}', "b": '{"x":"3"}', "c": '{"n":1.5}', "d": "[1]"}
    tasks = spark.createDataFrame([("k", 4)], "kernel string, queue_seq int")
    new = spark.createDataFrame([("k", "t2"), ("k", "t1"), ("m", "t3")], "kernel string, task_id string")
    assert sorted(map(tuple, O.allocate(tasks, new).collect())) == [("k", "t1", 5), ("k", "t2", 6), ("m", "t3", 1)]


def test_shapes_on_a_small_graph(spark):
    ship = [("g", "s1", T.RDF_TYPE, "Ship", 1, 1, None, None, False), ("g", "s1", "crew", "ten", 1, 3, T.XSD + "integer", None, False), ("g", "s2", T.RDF_TYPE, "Ship", 1, 1, None, None, False), ("g", "s2", "crew", "5", 1, 3, T.XSD + "integer", None, False), ("g", "s2", "name", "Ann", 1, 3, None, None, False)]
    q = spark.createDataFrame(ship, Q.SCHEMA)
    rules = [S.Constraint("Ship", "minCount", "name", 1), S.Constraint("Ship", "datatype", "crew", T.XSD + "integer"), S.Constraint("Ship", "datatype", "name", T.XSD + "string"), S.Constraint("Ship", "minLength", "name", 5, "Warning")]
    report = S.validate(rules, {"Ship": S.focus_by_class(q, "Ship")}, S.values(q))
    assert sorted((r.focus, r.component) for r in report.collect()) == [("s1", "datatype"), ("s1", "minCount"), ("s2", "minLength")]
    assert tuple(S.conforms(report).first()) == (False, 2, 1)
    assert S.summary(report).first().summary == "s1 crew datatype; s1 name minCount"
    with pytest.raises(ValueError):
        S.violations_of(S.Constraint("Ship", "sparkle"), S.focus_by_class(q, "Ship"), S.values(q))


def sealed(spark):
    data = [("a", "b1", dt.datetime(2024, 1, 1)), ("b", "b2", dt.datetime(2024, 1, 2)), ("a", "b3", dt.datetime(2024, 1, 3))]
    new = spark.createDataFrame(data, "instance_id string, body string, ts timestamp")
    empty = spark.createDataFrame([], "seq bigint, instance_id string, body_sha256 string, sig string, prev_seq bigint, ts timestamp")
    return new, L.append(new, empty, KEY)


def test_append_and_verify(spark):
    new, ledger = sealed(spark)
    assert [(r.seq, r.instance_id, r.prev_seq) for r in ledger.orderBy("seq").collect()] == [(1, "a", None), (2, "b", None), (3, "a", 1)]
    more = L.append(spark.createDataFrame([("b", "b4", dt.datetime(2024, 1, 1))], "instance_id string, body string, ts timestamp"), ledger, KEY)
    assert [(r.seq, r.prev_seq) for r in more.collect()] == [(4, 2)]
    now = spark.createDataFrame([("a", "b3"), ("b", "b2!")], "id string, body string")
    proofs = ledger.select(F.col("seq").alias("id"), F.col("instance_id").alias("about"), F.lit("sha256").alias("method"), F.col("body_sha256").alias("digest"))
    assert {r.id: r.verified for r in L.verify(now, ledger, proofs, KEY).collect()} == {"a": True, "b": False}
    assert not L.verify(now.where("id = 'a'"), ledger, proofs, b"other").first().verified
    assert L.broken_links(ledger).isEmpty()
    assert L.broken_links(ledger.withColumn("prev_seq", F.lit(2).cast("bigint"))).count() == 3


def test_derived_and_freshness(spark):
    items = spark.createDataFrame([(i, "t", Decimal(v)) for i, v in enumerate(["1.0", "-0.8", "1.0"])] + [(9, "t", None)], "id int, topic string, value decimal(10,2)")
    c = D.contributions(items, F.col("topic"), "value")
    assert D.derived_sum(c).first()["value"] == Decimal("1.2") and D.derived_sum(c).first()["scored"] == 3
    split = spark.createDataFrame([(i, "t", Decimal(v)) for i, v in enumerate(["1", "1", "-0.8", "-0.8"])], "id int, topic string, value decimal(10,2)")
    row = D.dispersion(D.contributions(split, F.col("topic"), "value")).first()
    assert (row.net, row.volume) == (Decimal("0.4"), Decimal("3.6"))
    ledger = spark.createDataFrame([("a", 1), ("a", 5)], "instance_id string, seq bigint")
    scope = spark.createDataFrame([("t", "a"), ("u", "z")], "concept string, instance_id string")
    marks = D.watermark(ledger, scope)
    assert {r.concept: r.watermark for r in marks.collect()} == {"t": 5, "u": 0}
    pointers = spark.createDataFrame([("p", "t", "g1", 1, 4, None, 1), ("p", "t", "g2", 1, 5, None, 2)], "plan string, concept string, graph_iri string, epoch int, watermark int, valid_until timestamp, built_at int")
    now = F.current_timestamp()
    assert D.fresh(pointers, marks, 1, now).first().fresh and not D.fresh(pointers, marks, 2, now).first().fresh
    assert [r.graph_iri for r in D.unreferenced(pointers.select("graph_iri"), pointers).collect()] == ["g1"]


def test_materialise_is_versioned(spark, tmp_path):
    c = spark.createDataFrame([("t", 1, Decimal(2))], "concept string, id int, contrib decimal(38,18)")
    path = str(tmp_path / "v=1")
    assert D.derived_sum(D.materialise(spark, c, path)).first()["value"] == 2
    with pytest.raises(Exception):
        D.materialise(spark, c, path)


def test_governance(spark):
    votes = spark.createDataFrame([("p", "approve", "u1"), ("p", "approve", "u1"), ("p", "approve", "anonymous"), ("p", "approve", None), ("p", "reject", "u2"), ("p", "approve", "u3")], "proposal string, value string, created_by string")
    props = spark.createDataFrame([("p", 2), ("q", 1)], "proposal string, requires_quorum int")
    assert sorted(map(tuple, G.quorum(votes, props).collect())) == [("p", 2, True), ("q", 0, False)]
    q = G.operation_quads(spark, "add_class", {"class": "urn:x:Item", "closed": True, "properties": [{"path": "urn:x:p/size", "datatype": T.XSD + "integer", "minCount": 1}]}, "g")
    assert S.property_shapes(q).first()["min_count"] == 1 and G.fenced(q).isEmpty()
    with pytest.raises(O.Refused):
        G.operation_quads(spark, "drop_everything", {}, "g")
    with pytest.raises(O.Refused):
        G.operation_quads(spark, "add_class", {"class": "no iri"}, "g")
    assert G.bind("name = :term", {"term": "a b"}, ["term"]) == "name = 'a b'"
    for bad in ({"term": "x'y"}, {}, {"term": "a", "other": "b"}):
        with pytest.raises(O.Refused):
            G.bind("name = :term", bad, ["term"])


def test_transitions_never_bleed(spark):
    allowed = spark.createDataFrame([("Ship", "planned", "crewed"), ("Ship", "crewed", "deployed"), (None, "planned", "done")], "type string, from_state string, to_state string")
    log = spark.createDataFrame([("Ship", None, "crewed"), ("Ship", "planned", "deployed"), ("Ship", "planned", "done"), ("Task", None, "done")], "type string, from_state string, to_state string")
    got = sorted((r.type, r.to_state, r.legal, r.source) for r in G.transitions(log, allowed).collect())
    assert got == [("Ship", "crewed", True, "sealed"), ("Ship", "deployed", False, "sealed"), ("Ship", "done", False, "sealed"), ("Task", "done", True, "fallback")]


def test_obligations(spark):
    c = spark.createDataFrame([("i1", "T"), ("i2", "T"), ("i3", "U")], "id string, type string")
    duty = spark.createDataFrame([("b", "T", "digest-match", True), ("a", "T", "no-warnings", True), ("c", "U", "digest-match", False)], "obligation string, target_type string, check_name string, active boolean")
    failed = {"digest-match": spark.createDataFrame([("i1",), ("i3",)], "id string"), "no-warnings": spark.createDataFrame([("i1",)], "id string")}
    assert list(map(tuple, G.first_failure(c, duty, failed).collect())) == [("i1", "a")]


def test_resolver(spark):
    sealed_names = spark.createDataFrame([("Alpha",), ("beta",), ("BETA",)], "name string")
    graphs = spark.createDataFrame([("Gamma",)], "name string")
    ask = lambda s: tuple(A.resolve_kernel(s, sealed_names, graphs).first())
    assert ask("Alpha") == ("sealed", "Alpha") and ask("alpha") == ("sealed-case", "Alpha")
    assert ask("Beta") == ("ambiguous", None) and ask("gamma") == ("graph", "Gamma")
    assert ask("Delta") == ("open", "Delta") and ask("no good") == ("refused", None) and ask("") == ("unset", None)


def test_claims(spark):
    import base64
    import json

    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    make = lambda h, c: f"{part(h)}.{part(c)}.sig"
    head, good = {"alg": "EdDSA", "kid": "1"}, {"iss": "i", "aud": ["x", "a"], "sub": "me", "exp": 1000}
    cases = [(make(head, good), "ok"), (make(head, good | {"aud": "a"}), "ok"), (make({"alg": "none"}, good), "algorithm"), (make({"alg": "EdDSA"}, good), "key"), (make(head, good | {"iss": "j"}), "issuer"), (make(head, good | {"aud": "b"}), "audience"), (make(head, {k: v for k, v in good.items() if k != "exp"}), "expiry"), (make(head, good | {"exp": 900}), "expired"), (make(head, good | {"nbf": 2000}), "early"), ("x.y", "malformed")]
    got = {r.token: r.state for r in A.claim_state(spark.createDataFrame([(t,) for t, _ in cases], "token string"), 960, "i", "a").collect()}
    assert got == dict(cases)


def test_dispatch(spark, docs):
    ctx = Context("p", "me", docs=docs, grants=spark.createDataFrame([("me", "snapshot")], "grantee string, permission string"))
    assert dispatch(ctx, "instance.query", {"type": "E", "filter": [{"key": "color", "op": "eq", "value": "red"}]}).count() == 2
    assert dispatch(ctx, "instances.count", {}).first().n == 4
    assert dispatch(ctx, "instance.snapshot", {}).count() == 4
    ctx.requester = "you"
    answer = dispatch_safe(spark, ctx, "instance.snapshot", {}).first()
    assert not answer.ok and "grant" in answer.refused
    assert not dispatch_safe(spark, ctx, "no.verb", {}).first().ok
    assert not dispatch_safe(spark, ctx, "instance.get", {}).first().ok
    ctx.plans["colour.of"] = (lambda c, id: c.need("docs").where(F.col("id") == id).select("body"), ["id"])
    assert dispatch(ctx, "colour.of", {"id": "e1"}).count() == 1
    assert not dispatch_safe(spark, ctx, "colour.of", {"who": "e1"}).first().ok


def test_outbox_stream(spark, tmp_path):
    rows = lambda *seqs: spark.createDataFrame([(s, f"i{s % 2}", "urn:t:E", f'{{"n":{s}}}', None if s == 2 else "me", dt.datetime(2024, 1, 1)) for s in seqs], X.LEDGER)
    ledger, out, mark = (str(tmp_path / n) for n in ("ledger", "out", "mark"))
    rows(1, 2).coalesce(1).write.mode("append").parquet(ledger)
    X.capture(spark, ledger, out, mark, "K")
    rows(3).coalesce(1).write.mode("append").parquet(ledger)
    X.capture(spark, ledger, out, mark, "K")
    got = {r.ledger_seq: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [1, 2, 3] and got[1].subject == "event.kernel.K.E.sealed"
    assert got[1].headers == {"Ck-Seq": "1", "Content-Type": "application/json", "by": "me"} and "by" not in got[2].headers
    seen = []
    X.drain(X.events(X.read_ledger(spark, ledger), "K"), lambda b, n: seen.extend(r.ledger_seq for r in b.collect()), str(tmp_path / "mark2"))
    assert sorted(seen) == [1, 2, 3]


def test_fold_stream(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    data = [(1, "a", "t", "one", "me", dt.datetime(2024, 1, 1)), (2, "a", "t", "two", "me", dt.datetime(2024, 1, 1)), (3, "b", "t", "x", "me", dt.datetime(2024, 1, 1))]
    for d in data:
        spark.createDataFrame([d], X.LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    state = {}
    query = X.fold(X.read_ledger(spark, ledger)).writeStream.outputMode("update").foreachBatch(lambda b, n: state.update({r.id: (r.body, r.changes) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert state == {"a": ("two", 2), "b": ("x", 1)}

"""Audits over sealed documents, derived values with their queue, numbering."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import audits as A
from quadrille.operators import derived as D
from quadrille.operators import governed as V
from quadrille.operators import quads as Q
from quadrille.operators.documents import Refused
from quadrille.operators.numbering import numbered

C = T.CORE


def documents(spark, rows):
    return spark.createDataFrame([(i, C + t if t else "urn:t/Score", json.dumps(b)) for i, t, b in rows], "id string, type string, body string").withColumn("ts", F.lit("2025-01-01").cast("timestamp"))


def test_adoptions_and_pins(spark):
    docs = documents(spark, [
        ("a1", "Adoption", {"@id": "urn:a1", C + "adopts": "urn:m1", C + "intoProject": "demo", C + "sourceDigest": "s1"}),
        ("a2", "Adoption", {"@id": "urn:a2", C + "adopts": "urn:m2", C + "intoProject": "urn:x:project/demo", C + "sourceDigest": "s2"}),
        ("a3", "Adoption", {"@id": "urn:a3", C + "adopts": "urn:m3", C + "intoProject": "demo"}), ("s", "Supersession", {C + "supersedes": "urn:a3"}),
        ("a4", "Adoption", {"@id": "urn:a4", C + "adopts": "urn:m4", C + "intoProject": "demo"}), ("a5", "Adoption", {"@id": "urn:a5", C + "adopts": "urn:m1", C + "intoProject": "other"}),
    ])
    quads = spark.createDataFrame([(g, "s", "p", "o", 1, 1, None, None, False) for g in ("urn:m1", "urn:m2", "urn:m3")], Q.SCHEMA)
    now = {r.g: r.digest for r in Q.copy_digest(quads).collect()}
    pins = spark.createDataFrame([("urn:m1", now["urn:m1"], None), ("urn:m2", "old", "old")], "g string, digest string, structural string")
    got = {r.g: r for r in A.adoption_check("demo", docs, quads, pins, spark.createDataFrame([("urn:m1", "s1"), ("urn:m2", "x")], "g string, source_sha256 string")).collect()}
    assert got.keys() == {"urn:m1", "urn:m2", "urn:m4"}
    assert (got["urn:m1"].drifted, got["urn:m1"].source_match, got["urn:m2"].drifted, got["urn:m2"].structure_drifted, got["urn:m2"].source_match) == (False, True, True, True, False)
    assert (got["urn:m4"].digest_now, got["urn:m4"].drifted, got["urn:m4"].source_match) == (None, False, None)
    made, gone = A.adoption_rows(docs)
    assert {r.id: (r.quads, r.pin) for r in A.fleet(made, gone, quads, pins).collect()} == {"a1": (1, now["urn:m1"]), "a2": (1, "old"), "a4": (0, None), "a5": (1, now["urn:m1"])}


def test_states_of_a_surface(spark):
    law = spark.createDataFrame([("law", "urn:s", T.RDF_TYPE, T.SHACL + "NodeShape", 1, 1, None, None, False)], Q.SCHEMA)
    digest = Q.copy_digest(law.withColumn("g", F.lit("surface"))).first().digest
    kernel = ("k", "Kernel", {"@id": "urn:x:demo/kernel"})
    epoch = lambda d: ("e", "Epoch", {C + "producedBy": "urn:x:demo/kernel/ck", C + "epoch": 2, C + "surfaceDigest": d})
    check = lambda project, n, *rows, adopted=None, surface=law: A.surface_check(project, n, documents(spark, [*rows, ("x", None, {})]), surface, surface, adopted).first()
    assert (check(None, 0).state, check(None, 0).healthy) == ("core-only", True)
    assert (check("demo", 0).state, check("demo", 0).healthy) == ("named", True)
    bare = check("demo", 2, kernel)
    assert bare.state == "germinated" and len(bare.findings) == 2 and not bare.healthy  # no kernel graph, no pin
    good = check("demo", 2, epoch(digest))
    assert good.healthy and good.pinned == good.actual
    assert check("demo", 2, epoch("old")).findings == ["surface drift: the digest differs from the one its epoch sealed"]
    assert check("demo", 0, adopted=["urn:none"]).findings == ["adopted module is absent or empty: urn:none"]
    assert "the surface has no shapes: every gate is vacuous" in check("demo", 0, surface=law.limit(0)).findings


def test_authority_and_affordances(spark):
    docs = documents(spark, [
        ("m1", "Membership", {C + "member": "ann", C + "inRole": "urn:r1"}), ("m2", "Membership", {C + "member": T.PARTICIPANT + "ann", C + "inRole": "urn:r2"}), ("m3", "Membership", {C + "member": "bob", C + "inRole": "urn:r2"}),
        ("r1", "Role", {"@id": "urn:r1", C + "grant": ["urn:g1", "urn:g2"]}), ("r2", "Role", {"@id": "urn:r2", C + "grant": "urn:g2", C + "grantedVia": "urn:g3"}),
        *[(f"g{k}", "Grant", {"@id": f"urn:g{k}", C + "permission": f"do{k}"}) for k in (1, 2, 3)],
        ("f1", "Affordance", {C + "verb": "ship.sail", C + "producedBy": "urn:k", C + "inShape": "urn:none"}), ("f2", "Affordance", {C + "verb": "ship.sink", C + "producedBy": "urn:k", C + "retiredAtEpoch": 1}),
    ])
    of = lambda who: sorted((r.role, r.permission) for r in A.authority_of(docs, who).collect())
    assert of(T.PARTICIPANT + "ann") == of("ann") == [("urn:r1", "do1"), ("urn:r1", "do2"), ("urn:r2", "do3")]
    assert of("bob") == [("urn:r2", "do2"), ("urn:r2", "do3")] and of("eve") == []
    assert A.authority_of(docs, None).first().participant == "anonymous"
    got = A.affordances(docs, spark.createDataFrame([], Q.SCHEMA), "urn:k", ["ship.sail", "ship.sink", "instance.get"]).collect()
    assert sorted((r.verb, r.sealed) for r in got) == [("instance.get", False), ("ship.sail", True), ("ship.sink", False)]


def test_derived_values_and_queue(spark):
    score = lambda i, about, w: (i, None, {"urn:t/about": about, "urn:t/w": w, "note": "x"})
    rows = [score("s1", "c", 1.5), score("s2", "c", -0.3), score("s3", "d", 9), score("s4", "c", "many")]
    docs = documents(spark, rows)
    ledger = spark.createDataFrame([(k + 1, r[0]) for k, r in enumerate(rows)], "seq bigint, instance_id string")
    scope, text, none = {"type": "urn:t/Score", "about_prop": "urn:t/about", "about": "c"}, "n['urn:t/w'] * 2", spark.createDataFrame([], D.POINTER)
    first, pointers = D.derive(docs, ledger, "sum", scope, text, 1, none)
    assert [float(x) for x in first.select("value", "volume").first()] == [2.4, 3.6] and first.first().scored == 2 and first.first().rebuilt
    again, same = D.derive(docs, ledger, "sum", scope, text, 1, pointers)
    assert not again.first().rebuilt and same.count() == 1 and float(again.first().value) == 2.4
    more, log = documents(spark, [*rows, score("s5", "c", 0.5)]), ledger.unionAll(spark.createDataFrame([(9, "s5")], ledger.schema))
    later, pointers = D.derive(more, log, "sum", scope, text, 1, pointers)
    assert later.first().rebuilt and float(later.first().value) == 3.4 and later.first().watermark == 9
    assert D.derive(more, log, "sum", scope, text, 2, pointers)[0].first().rebuilt  # a new epoch
    late = F.current_timestamp() + F.expr("INTERVAL '2 hours'")
    assert D.derive(more, log, "sum", scope, text, 1, pointers, late)[0].first().rebuilt  # no longer valid
    for bad in ("", "v['a'] || java_method('x')", "n['a']; DROP", "reflect(1)", '"x"'):
        with pytest.raises(Refused):
            D.formula(bad)
    jobs = spark.createDataFrame([("sum", "c", json.dumps(scope), "0", 1), ("sum", "c", json.dumps(scope), text, 2), ("sum", "d", json.dumps(scope | {"about": "d"}), text, 3)], "plan string, concept string, scope string, formula string, at int")
    jobs = jobs.select("plan", "concept", "scope", "formula", F.lit(1).cast("bigint").alias("epoch"), F.timestamp_seconds("at").alias("enqueued_at"))
    done = spark.createDataFrame([], "plan string, concept string, drained_at timestamp")
    assert [(r.concept, r.formula) for r in D.waiting(jobs, done).collect()] == [("c", text), ("d", text)]
    pointers = none
    for left in (1, 0, 0):
        n, done, pointers = D.drain_once(jobs, done, docs, ledger, pointers)
        assert D.waiting(jobs, done).count() == left
    assert n == 0 and {r.concept for r in pointers.collect()} == {"c", "d"}


def test_numbers_have_no_gaps(spark):
    """Ties, many partitions and coalescing: numbers follow the order and are the same in every reading."""
    rows = spark.range(5000).select((F.col("id") % 7).alias("a"), (F.col("id") % 50).alias("b"), "id").repartition(37)
    for enabled in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", enabled)
        try:
            got = numbered(rows, ["a", "b", "id"], after=10)
            told = got.collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert [(r.a, r.b, r.id) for r in sorted(told, key=lambda r: r.seq)] == sorted((k % 7, k % 50, k) for k in range(5000))
        assert sorted(r.seq for r in told) == list(range(11, 5011)) and sorted(map(tuple, got.collect())) == sorted(map(tuple, told))
    assert numbered(rows.limit(0), ["a"]).isEmpty()


def test_reads_are_refused_or_bound(spark):
    q = spark.createDataFrame([("g", s, p, o, 1, 3, None, None, False) for s, p, o in (("a", "p", "1"), ("a", "q", "x"), ("b", "p", "5"), ("c", "r", "9"))], Q.SCHEMA)
    read = lambda spec: sorted(map(tuple, V.read(q, spec).collect()), key=str)
    assert read({"where": [["?s", "p", "?v"]], "optional": [[["?s", "q", "?w"]]], "select": ["?s", "?w"]}) == [("a", "x"), ("b", None)]
    assert read({"any": [[["?s", "p", "?v"]], [["?s", "r", "?v"]]], "filters": [["?v", ">", 4]], "select": ["?s"]}) == [("b",), ("c",)]
    assert read({"where": [["?s", "p", "?v"]], "minus": [[["?s", "q", "?w"]]], "count": ["?s"]}) == [(1,)]
    for bad in ({}, {"where": []}, {"where": [["?s", "p"]]}, {"where": [["?s", "p", "?o"]], "drop": 1}, {"where": [["?s", "p", "?o"]], "filters": [["?o", "~", "x"]]}):
        with pytest.raises(Refused):
            V.check(bad)
    for detail in ({"verb": "Bad Verb", "query": {}}, {"verb": "x", "query": "[]"}, {"verb": "x", "query": {"where": [["?s", "p", "?o"]]}, "params": ["a b"]}, {"verb": "x", "formula": "1", "scope": {}}):
        with pytest.raises(Refused):
            V.registered(spark, "k", 1, detail)
    row = V.registered(spark, "k", 3, {"verb": "x.y", "query": {"where": [["?s", "p", "$v$"]]}, "params": ["v"]}).first()
    assert (row.kernel, row.verb, row.epoch, row.kind, row.params) == ("k", "x.y", 3, "query", ["v"])

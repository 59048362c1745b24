"""Bringing a store up from Turtle, and what is refused on the way."""

import pytest

from quadrille.functions import terms as T
from quadrille.operators import boot as K
from quadrille.operators import quads as Q
from quadrille.operators.documents import Refused
from quadrille.sources import turtle

LAW = f"@prefix sh: <{T.SHACL}> . @prefix owl: <{T.OWL}> . @prefix rdfs: <{T.RDFS}> . <urn:t/A> a owl:Class ; rdfs:subClassOf <urn:t/B> . <urn:t/B> rdfs:subClassOf <urn:t/C> . <urn:t/S> a sh:NodeShape ; sh:targetClass <urn:t/A> ; sh:property [ sh:path <urn:t/z> ; sh:group <urn:g1> ; sh:order 2 ] , [ sh:path <urn:t/y> ; sh:group <urn:g1> ; sh:order 1 ] , [ sh:path <urn:t/x> ] ."


def test_law_and_surface(spark):
    law = turtle.read_text(spark, LAW, "law")
    assert K.boot(law).where("inferred").select("s", "o").first() == ("urn:t/A", "urn:t/C")
    with pytest.raises(Refused):
        K.boot(law.where("p != '" + T.RDF_TYPE + "'"))
    module = turtle.read_text(spark, "<urn:m/x> <urn:t/says> <urn:m/y> .", "urn:m1")
    whole = Q.union(law, module)
    assert {r.g for r in K.surface(whole, "all", "law", None, ["urn:m1"]).select("g").distinct().collect()} == {"all"}
    with pytest.raises(Refused):
        K.surface(whole, "all", "law", None, ["urn:m1", "urn:m2"])
    assert K.surface(whole, "all", "law", None, ["urn:m1", "urn:m2"], excluded="urn:m2").where("s = 'urn:m/x'").count() == 1
    pins = K.first_pins(K.empty_store(spark)["pins"], whole)
    assert {r.g for r in pins.collect()} == {"law", "urn:m1"} and K.first_pins(pins, whole).isEmpty()
    assert [(r.reason, r.term) for r in K.staged(module).collect()] == [("predicate", "urn:t/says")]
    minted = turtle.read_text(spark, f"<{T.CORE}Own> a <{T.OWL}Class> .", "new")
    for bad in (module, minted):
        with pytest.raises(Refused):
            K.adopt(law, bad, "law")
    assert K.adopt(law, turtle.read_text(spark, f"<urn:t/D> a <{T.OWL}Class> .", "new"), "law").where("s = 'urn:t/D' AND g = 'law'").count() == 1
    assert [(r.group, r.place, r.path) for r in K.form(law).orderBy("place").collect()] == [("urn:g1", 0, "urn:t/y"), ("urn:g1", 1, "urn:t/z"), (None, 2, "urn:t/x")]
    lines = [r.line for r in Q.turtle_lines(law).collect()]
    again = turtle.read_text(spark, "\n".join(lines), "law")
    assert Q.structural_digest(again).first() == Q.structural_digest(law).first()


def test_settings_and_older_verbs():
    assert K.policy("on_seal", "rdfs")["materialize_profile"] == "rdfs"
    for bad in ((None, "rdfs"), ("batch", "owl"), ("daily", "rdfs")):
        with pytest.raises(Refused):
            K.policy(*bad)
    told = [K.legacy_verb(v, p) for v, p in (("instance.create", {"task": 1, "name": 2}), ("instance.create", {"name": 1}), ("instance.create", {}), ("instance.link", {}), ("instance.query", {}), ("instance.provenance", {}), ("instance.get", {}))]
    assert told == ["task.create", "kernel.create", "task.create", "edge.create", "instances.list", "provenance", "instance.get"]

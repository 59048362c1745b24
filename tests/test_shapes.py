"""Shapes graphs to constraints to reports, against a plain check in Python."""

import random
import re

import pytest

from quadrille.functions import terms as T
from quadrille.operators import quads as Q
from quadrille.operators import shapes as S
from quadrille.sources import turtle

SHAPES = f"""
@prefix sh: <{T.SHACL}> . @prefix xsd: <{T.XSD}> . @prefix : <urn:c/> . @prefix p: <urn:p/> .
:A a sh:NodeShape ; sh:targetClass :Ship ; sh:closed true ; sh:ignoredProperties ( <{T.RDF_TYPE}> ) ;
  sh:property [ sh:path p:name ; sh:minCount 1 ; sh:maxCount 1 ; sh:datatype xsd:string ; sh:minLength 3 ; sh:message "a name" ] ,
    [ sh:path p:crew ; sh:datatype xsd:integer ; sh:severity sh:Warning ] , [ sh:path p:flag ; sh:in ( "red" "blue" ) ] ,
    [ sh:path p:port ; sh:class :Port ; sh:nodeKind sh:IRI ; sh:qualifiedValueShape [ sh:class :Port ] ; sh:qualifiedMinCount 1 ] ,
    [ sh:path p:off ; sh:minCount 9 ; sh:deactivated true ] .
:B a sh:NodeShape ; sh:targetSubjectsOf p:flag ; sh:property :B1 . :B1 sh:path p:flag ; sh:hasValue "red" ; sh:pattern "^[a-z]+$" ; sh:disjoint p:name ; sh:severity sh:Info .
"""


def plain(triples, types):
    """The report, constraint by constraint, over Python lists."""
    of = lambda s, p: [(o, k, dt) for a, q, o, k, dt in triples if (a, q) == (s, "urn:p/" + p)]
    out = set()
    add = lambda s, p, c, sev, v, sh, m=None: out.add((s, "urn:p/" + p, c, sev, v, "urn:c/" + sh, m))
    for s in {s for s, c in types if c == "urn:c/Ship"}:
        names = of(s, "name")
        if not names:
            add(s, "name", "minCount", "Violation", None, "A", "a name")
        if len(names) > 1:
            add(s, "name", "maxCount", "Violation", None, "A", "a name")
        for o, k, dt in names:
            if k != T.LITERAL or dt is not None:
                add(s, "name", "datatype", "Violation", o, "A", "a name")
            if len(o) < 3:
                add(s, "name", "minLength", "Violation", o, "A", "a name")
        for o, _, dt in of(s, "crew"):
            if dt != T.XSD + "integer" or not re.match(r"^[+-]?[0-9]+$", o):
                add(s, "crew", "datatype", "Warning", o, "A")
        for o, _, _ in of(s, "flag"):
            if o not in ("red", "blue"):
                add(s, "flag", "in", "Violation", o, "A")
        for o, k, _ in of(s, "port"):
            if k != T.IRI:
                add(s, "port", "nodeKind", "Violation", o, "A")
            if (o, "urn:c/Port") not in types:
                add(s, "port", "class", "Violation", o, "A")
        if not any((o, "urn:c/Port") in types for o, _, _ in of(s, "port")):
            add(s, "port", "qualifiedMinCount", "Violation", None, "A")
        for a, p, o, _, _ in triples:
            if a == s and p not in [T.RDF_TYPE, *("urn:p/" + x for x in ("name", "crew", "flag", "port"))]:
                out.add((s, p, "closed", "Violation", o, "urn:c/A", None))
    for s in {s for s, p, *_ in triples if p == "urn:p/flag"}:
        if "red" not in [o for o, _, _ in of(s, "flag")]:
            add(s, "flag", "hasValue", "Info", None, "B")
        for o, _, _ in of(s, "flag"):
            if not re.match("^[a-z]+$", o):
                add(s, "flag", "pattern", "Info", o, "B")
            if o in [n for n, _, _ in of(s, "name")]:
                add(s, "flag", "disjoint", "Info", o, "B")
    return out


@pytest.mark.parametrize("broadcast", [S.BROADCAST_CONSTRAINTS, 0])
def test_shapes_graph_against_plain_python(spark, broadcast, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_CONSTRAINTS", broadcast)
    r, triples = random.Random(3), set()
    lit, iri, integer = (T.LITERAL, None), (T.IRI, None), (T.LITERAL, T.XSD + "integer")
    for n in range(120):
        s = f"urn:s/{n}"
        if n % 10:
            triples.add((s, T.RDF_TYPE, "urn:c/Ship", *iri))
        for p, values in (("name", [("red", *lit), ("ab", *lit), ("Ann Marie", *lit), ("urn:x", *iri)]), ("crew", [("5", *integer), ("5.5", *integer), ("7", *lit)]), ("flag", [("red", *lit), ("blue", *lit), ("Green!", *lit)]), ("port", [("urn:s/1", *iri), ("urn:port/1", *iri), ("text", *lit)]), ("more", [("x", *lit)])):
            for v in r.sample(values, r.choice([0, 1, 1, 2]) if len(values) > 1 else r.randrange(2)):
                triples.add((s, "urn:p/" + p, *v))
    triples |= {("urn:port/1", T.RDF_TYPE, "urn:c/Port", *iri), ("urn:s/1", T.RDF_TYPE, "urn:c/Port", *iri)}
    data = spark.createDataFrame([("g", s, p, o, T.IRI, k, dt, None, False) for s, p, o, k, dt in sorted(triples, key=str)], Q.SCHEMA)
    report = S.validate_graph(data, turtle.read_text(spark, SHAPES, "shapes"))
    rows = report.collect()
    got = {(x.focus, x.path, x.component, x.severity, x.value, x.shape, x.message) for x in rows}
    assert got == plain(triples, {(s, o) for s, p, o, *_ in triples if p == T.RDF_TYPE})
    assert len(rows) == len(got) and {x.component for x in rows} == set(S.COMPONENTS)
    if broadcast:
        quads = S.report_quads(report, "g").collect()
        assert sum(q.p == T.SHACL + "result" for q in quads) == len(got) and ("urn:x:report", T.SHACL + "conforms", "false") in {(q.s, q.p, q.o) for q in quads}
        assert {q.o for q in quads if q.p == T.SHACL + "resultMessage"} == {"a name"}


def test_empty_shapes_and_data(spark):
    shapes, none = turtle.read_text(spark, SHAPES, "shapes"), spark.createDataFrame([], Q.SCHEMA)
    assert S.validate_graph(none, shapes).isEmpty() and S.validate_graph(shapes, none).isEmpty()
    assert S.constraints_of(none).isEmpty()
    q = S.report_quads(S.validate_graph(none, shapes), "g").collect()
    assert ("urn:x:report", T.SHACL + "conforms", "true") in {(x.s, x.p, x.o) for x in q}


def test_targets_are_not_shuffled_by_class(spark):
    """All nodes may be of one class: joined by shuffle on it, they would all come to one task."""
    shapes = spark.createDataFrame([("s", "urn:S", T.SHACL + "targetClass", "urn:C", 1, 1, None, None, False)], Q.SCHEMA).checkpoint()
    data = spark.createDataFrame([("g", f"urn:{i}", T.RDF_TYPE, "urn:C", 1, 1, None, None, False) for i in range(9)], Q.SCHEMA).checkpoint()
    found = S.targets(shapes, data, S.types_of(data))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 9 and "SortMergeJoin" not in plan, plan


def test_values_of_several_graphs_count_once_without_a_shuffle_of_their_own(spark):
    rows = [(g, "urn:a", p, o, 1, k, None, None, False) for g in "xy" for p, o, k in ((T.RDF_TYPE, "urn:C", 1), ("urn:p", "1", 3))]
    shapes = turtle.read_text(spark, f"@prefix sh: <{T.SHACL}> . <urn:S> a sh:NodeShape ; sh:targetClass <urn:C> ; sh:property [ sh:path <urn:p> ; sh:maxCount 1 ] .", "s")
    data = spark.createDataFrame(rows, Q.SCHEMA)
    assert S.validate_graph(data, shapes).count() == 0
    assert "Aggregate" not in S.values(data)._jdf.queryExecution().optimizedPlan().toString()

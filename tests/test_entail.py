"""Entailment against a naive fixpoint over Python sets."""

import random

import pytest

from quadrille.functions import terms as T
from quadrille.operators import entail as E
from quadrille.operators import quads as Q

OWL = T.OWL


def naive(triples, literals):
    """All rules over and over until nothing is new; ``literals`` are objects that are no nodes."""
    known = set(triples)
    lists = {s: o for s, p, o in known if p == T.RDF + "first"}, {s: o for s, p, o in known if p == T.RDF + "rest"}
    chains = []
    for q, p, cell in sorted(known):
        if p == OWL + "propertyChainAxiom":
            steps = []
            while cell in lists[0]:
                steps.append(lists[0][cell])
                cell = lists[1][cell]
            chains.append((q, steps))
    while True:
        new = set()
        by = lambda p: [(s, o) for s, q, o in known if q == p]  # noqa: E731, B023
        sub, typ, eq = by(T.SUBCLASS), by(T.RDF_TYPE), by(OWL + "equivalentClass")
        new |= {(a, T.SUBCLASS, d) for a, b in sub for c, d in sub if b == c}
        new |= {(x, T.RDF_TYPE, d) for x, c in typ for a, d in sub + eq + [(o, s) for s, o in eq] if a == c}
        for p, c in by(T.DOMAIN):
            new |= {(s, T.RDF_TYPE, c) for s, _ in by(p)}
        for p, c in typ:
            if c == OWL + "TransitiveProperty":
                new |= {(a, p, d) for a, b in by(p) for c_, d in by(p) if b == c_ and b not in literals}
        for p, q in by(OWL + "inverseOf"):
            new |= {(o, q, s) for s, o in by(p) if o not in literals} | {(o, p, s) for s, o in by(q) if o not in literals}
        for q, steps in chains:
            ends = [(s, o) for s, o in by(steps[0])]
            for p in steps[1:]:
                ends = [(s, o) for s, m in ends for m_, o in by(p) if m == m_ and m not in literals]
            new |= {(s, q, o) for s, o in ends}
        for c, p in by(OWL + "onProperty"):
            for c_, v in by(OWL + "hasValue"):
                if c == c_:
                    new |= {(s, T.RDF_TYPE, c) for s, o in by(p) if o == v} | {(s, p, v) for s, k in typ if k == c}
            for c_, k in by(OWL + "someValuesFrom"):
                if c == c_:
                    new |= {(s, T.RDF_TYPE, c) for s, o in by(p) if (o, k) in set(typ)}
        if new <= known:
            return known
        known |= new


def frame(spark, triples, literals, g="g"):
    return spark.createDataFrame([(g, s, p, o, T.BNODE if s.startswith("_") else T.IRI, T.LITERAL if o in literals else T.BNODE if o.startswith("_") else T.IRI, None, None, False) for s, p, o in sorted(triples)], Q.SCHEMA)


def check(spark, triples, literals=frozenset()):
    got = E.entail(frame(spark, triples, literals)).collect()
    want = naive(triples, literals)
    assert {(r.s, r.p, r.o) for r in got} == want
    assert {(r.s, r.p, r.o) for r in got if r.inferred} == want - set(triples) and len(got) == len(want)
    for r in got:
        assert r.o_kind == (T.LITERAL if r.o in literals else T.BNODE if r.o.startswith("_") else T.IRI) and r.s_kind == (T.BNODE if r.s.startswith("_") else T.IRI)


def test_later_premises_meet_earlier_ones(spark):
    """An inverse gives the right-hand edge of a transitive pair; declarations come from other rules."""
    check(spark, {("a", "p", "b"), ("c", "q", "b"), ("p", OWL + "inverseOf", "q"), ("p", T.RDF_TYPE, OWL + "TransitiveProperty")})
    late = {("p", T.RDF_TYPE, "Deep"), ("Deep", T.SUBCLASS, "Deeper"), ("Deeper", T.SUBCLASS, OWL + "TransitiveProperty"), ("a", "p", "b"), ("b", "p", "c"), ("c", "p", "d")}
    late |= {("said", OWL + "inverseOf", T.DOMAIN), ("K", "said", "p"), ("turned", OWL + "inverseOf", OWL + "inverseOf"), ("p", "turned", "r"), ("pays", OWL + "inverseOf", OWL + "hasValue"), ("v", "pays", "R"), ("R", OWL + "onProperty", "p"), ("x", "p", "v")}
    check(spark, late)


def test_chains_of_any_length(spark):
    first, rest, nil = T.RDF + "first", T.RDF + "rest", T.RDF + "nil"
    triples = {("up", OWL + "propertyChainAxiom", "_l1"), ("_l1", first, "p"), ("_l1", rest, "_l2"), ("_l2", first, "q"), ("_l2", rest, "_l3"), ("_l3", first, "p"), ("_l3", rest, nil)}
    triples |= {("same", OWL + "propertyChainAxiom", "m1"), ("m1", first, "up"), ("m1", rest, nil), ("up", T.RDF_TYPE, OWL + "TransitiveProperty")}
    triples |= {("a", "p", "b"), ("b", "q", "c"), ("c", "p", "d"), ("d", "p", "_e"), ("_e", "q", "f"), ("f", "p", "five")}
    check(spark, triples, {"five"})


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("small", [E.BROADCAST_QUADS, 0])
def test_random_graphs(spark, seed, small, monkeypatch):
    monkeypatch.setattr(E, "BROADCAST_QUADS", small)
    r = random.Random(seed)
    node, prop, kind = (lambda: f"n{r.randrange(7)}"), (lambda: f"p{r.randrange(4)}"), (lambda: f"C{r.randrange(4)}")
    triples = {(node(), prop(), node()) for _ in range(9)} | {(node(), prop(), "lit") for _ in range(2)} | {(node(), T.RDF_TYPE, kind()) for _ in range(3)}
    for _ in range(7):
        triples |= r.choice([
            {(kind(), T.SUBCLASS, kind())}, {(kind(), OWL + "equivalentClass", kind())}, {(prop(), T.DOMAIN, kind())}, {(prop(), T.RDF_TYPE, OWL + "TransitiveProperty")},
            {(prop(), OWL + "inverseOf", prop())}, {(c := kind(), OWL + "onProperty", prop()), (c, OWL + "hasValue", r.choice([node(), "lit"]))}, {(c := kind(), OWL + "onProperty", prop()), (c, OWL + "someValuesFrom", kind())},
        ])
    check(spark, triples, {"lit"})


def test_graphs_entail_for_themselves(spark):
    one = frame(spark, {("a", T.RDF_TYPE, "C")}, (), "g1").unionByName(frame(spark, {("C", T.SUBCLASS, "D")}, (), "g2"))
    assert E.entail(one).where("inferred").isEmpty()
    assert E.entail(one.limit(0)).isEmpty()


def test_no_join_by_the_property_alone(spark):
    """A property of the schema names most quads of a graph: joined by shuffle, they would all come to one task."""
    rows = [("g", "urn:p", T.RDF_TYPE, OWL + "TransitiveProperty", 1, 1, None, None, False)] + [("g", f"urn:{i}", "urn:p", f"urn:{i + 1}", 1, 1, None, None, False) for i in range(5)]
    facts = spark.createDataFrame(rows, Q.SCHEMA).selectExpr("g", "s", "p", "o", "o_kind = 3 AS lit").checkpoint()
    counts = E._counts(facts)
    found = E.one_round(facts, facts, counts, counts, first=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {(r.s, r.o) for r in found.collect()} == {(f"urn:{i}", f"urn:{i + 2}") for i in range(4)}
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") >= 2, plan


def chain(q, *steps, at=""):
    cells = [f"{q}{at}{i}" for i in range(len(steps))] + [T.RDF + "nil"]
    return {(q, OWL + "propertyChainAxiom", cells[0])} | {(c, T.RDF + "first", p) for c, p in zip(cells, steps)} | {(c, T.RDF + "rest", n) for c, n in zip(cells, cells[1:])}


def test_a_round_of_a_chain_is_one_join(spark, monkeypatch):
    """A chain takes a round for each join, and a round joins nothing that has no quads of the properties it asks for."""
    plans, one_round = [], E.one_round

    def watched(*args, **more):
        found = one_round(*args, **more)
        if found is not None:
            plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(E, "one_round", watched)
    triples = chain("up", "p", "p", "p") | {(f"n{i}", "p", f"n{i + 1}") for i in range(6)} | {("n0", "p", "n2"), ("n9", "r", "n0")}
    check(spark, triples)
    assert [p.count("SortMergeJoin") for p in plans] == [1, 1]


def test_a_round_meets_only_what_it_may_give(spark):
    facts = spark.createDataFrame([("g", "a", "p", "b", False), ("g", "b", "q", "c", False)], "g string, s string, p string, o string, lit boolean")
    found = facts.selectExpr("g", "s", "'q' AS p", "o", "lit")
    both = found.unionAll(found)
    names = lambda given, counts: sorted((r.s, r.p) for r in E._unknown(both, facts, given, counts).collect())
    assert names([{"q"}], {"p": 1, "q": 1}) == names([None], {}) == [("a", "q")]
    apart = E._unknown(both.where("s = 'a'"), facts, [{"q"}], {"p": 1})
    assert [(r.s, r.p) for r in apart.collect()] == [("a", "q")] and "Join" not in apart._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1_000, 0])
def test_chains_share_their_steps(spark, most, monkeypatch):
    """Chains of common steps, one of them recursive and one alone, whose properties other rules give late."""
    monkeypatch.setattr(E, "NAMING_QUADS", most)
    triples = chain("one", "p", "q") | chain("two", "q", "p", "q") | chain("same", "two") | chain("far", "p") | chain("far", "far", "q", at="again")
    triples |= {("q", OWL + "inverseOf", "t"), ("turned", OWL + "inverseOf", OWL + "inverseOf"), ("t", "turned", "u")}
    triples |= {("a", "p", "b"), ("c", "t", "b"), ("c", "u", "d"), ("c", "p", "d"), ("e", "t", "d"), ("e", "p", "five")}
    check(spark, triples, {"five"})

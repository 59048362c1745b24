"""Entailment by semi-naive rounds; rules are data, every inferred quad is flagged.

A rule is a list of triple patterns and a head. In a round each of its patterns in turn takes what the last round
found, the others take everything, so a premise that comes late meets the earlier ones on either side. Patterns whose
predicates do not occur are not planned, and what a round gives is compared only with quads of the predicates that it
may give. Each graph entails for itself.

Rules: subClassOf is transitive and types are inherited, also over equivalent classes; domains type their subjects;
transitive and inverse properties; property chains of any length; hasValue restrictions both ways, someValuesFrom in
the direction that types its members.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.session import ensure_checkpoint_dir

KEY = ["g", "s", "p", "o", "lit"]
#: Quads of one schema predicate (or of the class of transitive properties) up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_QUADS = 100_000
#: Quads that name properties for the rules up to which their quads are counted one by one; with more, each is taken to occur.
NAMING_QUADS = 1_000

TYPE, SUB, DOMAIN = T.RDF_TYPE, T.SUBCLASS, T.DOMAIN
EQUIVALENT, INVERSE, TRANSITIVE = T.OWL + "equivalentClass", T.OWL + "inverseOf", T.OWL + "TransitiveProperty"
ON, HAS, SOME, CHAIN = T.OWL + "onProperty", T.OWL + "hasValue", T.OWL + "someValuesFrom", T.OWL + "propertyChainAxiom"
#: Steps of chains, internal to the rounds: the properties they join, what they give; what a chain of one property gives.
STATE, LEFT, RIGHT, GIVES, ALONE = "chain:", "chain:left", "chain:right", "chain:gives", "chain:alone"

Triple = tuple[str, str, str]
RULES: list[tuple[list[Triple], Triple]] = [
    ([("?c", SUB, "?d"), ("?d", SUB, "?e")], ("?c", SUB, "?e")),
    ([("?x", TYPE, "?c"), ("?c", SUB, "?d")], ("?x", TYPE, "?d")),
    ([("?x", TYPE, "?c"), ("?c", EQUIVALENT, "?d")], ("?x", TYPE, "?d")),
    ([("?x", TYPE, "?d"), ("?c", EQUIVALENT, "?d")], ("?x", TYPE, "?c")),
    ([("?s", "?p", "?o"), ("?p", DOMAIN, "?c")], ("?s", TYPE, "?c")),
    ([("?p", TYPE, TRANSITIVE), ("?s", "?p", "?m"), ("?m", "?p", "?o")], ("?s", "?p", "?o")),
    ([("?p", INVERSE, "?q"), ("?s", "?p", "?o")], ("?o", "?q", "?s")),
    ([("?p", INVERSE, "?q"), ("?s", "?q", "?o")], ("?o", "?p", "?s")),
    ([("?c", ON, "?p"), ("?c", HAS, "?v"), ("?s", "?p", "?v")], ("?s", TYPE, "?c")),
    ([("?c", ON, "?p"), ("?c", HAS, "?v"), ("?s", TYPE, "?c")], ("?s", "?p", "?v")),
    ([("?c", ON, "?p"), ("?c", SOME, "?k"), ("?s", "?p", "?o"), ("?o", TYPE, "?k")], ("?s", TYPE, "?c")),
    ([("?p", ALONE, "?t"), ("?s", "?p", "?m")], ("?s", "?t", "?m")),
    ([("?a", LEFT, "?k"), ("?p", RIGHT, "?k"), ("?k", GIVES, "?t"), ("?s", "?a", "?m"), ("?m", "?p", "?o")], ("?s", "?t", "?o")),
]
VOCABULARY = sorted({p for body, _ in RULES for _, p, _ in body if not p.startswith("?")})


def chain_states(quads: DataFrame, longest: int = 64) -> DataFrame | None:
    """Property chains, read from their RDF lists, as quads of steps; None without any.

    A step (``chain:`` and property, a space, the list cell it reads) joins what the cells before lead to with the
    property of its cell. What it gives is a property named like the next step, after the last cell the chain's own.
    """
    about = lambda p, s, o: quads.where(F.col("p") == p).select("g", F.col("s").alias(s), F.col("o").alias(o)).distinct()
    cells = about(CHAIN, "q", "cell").checkpoint()
    if cells.isEmpty():
        return None
    first, rest = about(T.RDF + "first", "cell", "p"), about(T.RDF + "rest", "cell", "next")
    step = lambda c: F.concat(F.lit(STATE), F.col("q"), F.lit(" "), F.col(c))
    last = F.col("next") == T.RDF + "nil"
    quad = lambda rows, s, p, o: rows.select("g", s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(False).alias("lit"))
    out, head = [], True
    for _ in range(longest):
        read = cells.join(first, ["g", "cell"]).join(rest, ["g", "cell"]).checkpoint()
        if read.isEmpty():
            return reduce(DataFrame.unionAll, out).distinct() if out else None
        if head:
            out.append(quad(read.where(last), F.col("p"), ALONE, F.col("q")))
        else:
            out.append(quad(read, F.col("p"), RIGHT, step("cell")))
            out.append(quad(read, step("cell"), GIVES, F.when(last, F.col("q")).otherwise(step("next"))))
        out.append(quad(read.where(~last), F.col("p") if head else step("next"), LEFT, step("next")))
        cells, head = read.where(~last).select("g", "q", F.col("next").alias("cell")), False
    raise ValueError(f"a property chain is longer than {longest}")


def _atom(facts: DataFrame, triple: Triple, subjects: set[str]) -> DataFrame:
    """Bindings of one pattern, with ``lit_x`` for an object variable that is nowhere a subject; others bind no literals."""
    rows, out = facts, [F.col("g")]
    for column, term in zip("spo", triple, strict=True):
        if not term.startswith("?"):
            rows = rows.where(F.col(column) == term)
        elif column == "o" and term in subjects:
            rows = rows.where("NOT lit")
            out.append(F.col("o").alias(term[1:]))
        elif column == "o":
            out += [F.col("o").alias(term[1:]), F.col("lit").alias("lit_" + term[1:])]
        else:
            out.append(F.col(column).alias(term[1:]))
    return rows.select(*out)


def _word(triple: Triple) -> str:
    """The name that ``_counts`` counts a pattern's quads by; those of other types have none."""
    return triple[2] if triple[1] == TYPE and triple[2] == TRANSITIVE else triple[1]


def _apply(rule: tuple[list[Triple], Triple], sources: list[DataFrame], small: set[str]) -> DataFrame:
    """The head of a rule, each pattern taken from its own source; patterns whose word is ``small`` are broadcast."""
    body, head = rule
    subjects = {t[0] for t in (*body, head)} | {t[1] for t in (*body, head) if t[1].startswith("?")}
    frames = []
    for triple, facts in zip(body, sources, strict=True):
        frame = _atom(facts, triple, subjects)
        if triple[1].startswith("?"):
            # only quads of predicates that a small pattern names are joined at all
            for other, others in zip(body, sources, strict=True):
                if _word(other) in small and triple[1] in (other[0], other[2]):
                    names = _atom(others, other, subjects).select("g", triple[1][1:]).distinct()
                    frame = frame.join(F.broadcast(names), ["g", triple[1][1:]], "left_semi")
        frames.append((F.broadcast(frame) if _word(triple) in small else frame, frame.columns))
    # the widest first, then whatever shares a variable with what is there
    frames.sort(key=lambda f: -len(f[1]))
    out, names = frames.pop(0)
    while frames:
        k = next(i for i, (_, c) in enumerate(frames) if set(c) & set(names) - {"g"})
        frame, c = frames.pop(k)
        # the graph comes last among the keys, as it tells the fewest rows apart when they are sorted
        out, names = out.join(frame, sorted((x for x in names if x in c), key=lambda x: x == "g")), [*names, *(x for x in c if x not in names)]
    value = lambda term: F.col(term[1:]) if term.startswith("?") else F.lit(term)
    lit = F.col("lit_" + head[2][1:]) if "lit_" + head[2][1:] in names else F.lit(False)
    return out.select("g", value(head[0]).alias("s"), value(head[1]).alias("p"), value(head[2]).alias("o"), lit.alias("lit")).toDF(*KEY)


#: Words of the schema patterns that name properties of their rules.
NAMING = sorted({_word(t) for body, head in RULES for t in body if not t[1].startswith("?") and {t[0], t[2]} & {x[1] for x in (*body, head)}})

Names = dict[str, set[tuple[str, str]]]


def _names(facts: DataFrame) -> Names | None:
    """Subjects and objects of the quads that name properties, by word; None if they are more than ``NAMING_QUADS``."""
    word = F.when((F.col("p") == TYPE) & (F.col("o") == TRANSITIVE), TRANSITIVE).otherwise(F.col("p"))
    rows = facts.select(word.alias("word"), "s", "o").where(F.col("word").isin(NAMING)).distinct().limit(NAMING_QUADS + 1).collect()
    return {w: {(r.s, r.o) for r in rows if r.word == w} for w in NAMING} if len(rows) <= NAMING_QUADS else None


def _counts(facts: DataFrame, names: Names | None = None) -> dict[str, int]:
    """Quads of each predicate of the rules' vocabulary and of ``names``, under the class's name for transitive properties, and of all others (under '')."""
    told = sorted({*VOCABULARY, *(n for pairs in (names or {}).values() for pair in pairs for n in pair)})
    kind = F.when((F.col("p") == TYPE) & (F.col("o") == TRANSITIVE), TRANSITIVE).when(F.col("p").isin(told), F.col("p")).otherwise("")
    return {r.k: r.n for r in facts.groupBy(kind.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per word of the vocabulary and name


def _gives(rule: tuple[list[Triple], Triple], held: list[dict[str, int]], names: Names | None) -> set[str] | None:
    """The predicates that a rule may give, each pattern taken from quads that are counted in ``held``; None if unknown."""
    body, head = rule
    occurs = lambda p, counts: p in counts or p == TYPE and TRANSITIVE in counts
    variables = {t[1] for t in (*body, head) if t[1].startswith("?")}
    if not all(occurs(_word(t), counts) for t, counts in zip(body, held, strict=True) if not t[1].startswith("?")):
        return set()
    if not variables:
        return {head[1]}
    if names is None:
        return None if head[1].startswith("?") else {head[1]}
    found: list[dict[str, str]] = [{}]
    for t in body:
        if not t[1].startswith("?") and _word(t) in NAMING and {t[0], t[2]} & variables:
            ends = [{x: n for x, n in ((t[0], s), (t[2], o)) if x.startswith("?")} for s, o in names[_word(t)]]
            found = [f | e for f in found for e in ends if all(f.get(x, n) == n for x, n in e.items())]
    for t, counts in zip(body, held, strict=True):
        if t[1].startswith("?"):
            found = [f for f in found if occurs(f[t[1]], counts)]
    return {f.get(head[1], head[1]) for f in found}


def _planned(new_counts: dict[str, int], counts: dict[str, int], first: bool, names: Names | None) -> list[tuple[list[Triple], Triple, int, set[str] | None]]:
    """Rules that may give something, each with the pattern that takes what is new and with the predicates it may give."""
    out = []
    for body, head in RULES:
        for k in range(1 if first else len(body)):
            given = _gives((body, head), [counts if first or i != k else new_counts for i in range(len(body))], names)
            if given is None or given:
                out.append((body, head, k, given))
    return out


def one_round(new: DataFrame, every: DataFrame, new_counts: dict[str, int], counts: dict[str, int], first: bool = False, names: Names | None = None) -> DataFrame | None:
    """What the rules give from ``new`` together with ``every`` quad, which includes it, with repeats; None if no rule can give any."""
    # a property of the schema has few names, so a join by it alone would bring all its quads to one task
    small = {p for p in (*VOCABULARY, TRANSITIVE) if p != TYPE and counts.get(p, 0) <= BROADCAST_QUADS}
    out = [_apply((body, head), [every if first or i != k else new for i in range(len(body))], small) for body, head, k, _ in _planned(new_counts, counts, first, names)]
    return reduce(DataFrame.unionAll, out) if out else None


def _unknown(found: DataFrame, every: DataFrame, given: list[set[str] | None], counts: dict[str, int]) -> DataFrame:
    """The quads of a round, once each, that are not among ``every``, which is read only where it has predicates that the round may give."""
    found = found.distinct()
    if None in given:
        return found.join(every, KEY, "left_anti")
    held = {p for some in given for p in some if p in counts or p == TYPE and TRANSITIVE in counts}
    return found.join(every.where(F.col("p").isin(sorted(held))), KEY, "left_anti") if held else found


def entail(quads: DataFrame, max_rounds: int = 32) -> DataFrame:
    """``quads`` with everything the rules add, flagged ``inferred``."""
    ensure_checkpoint_dir(quads.sparkSession)
    blank = lambda node, kind: quads.where(F.col(kind) == T.BNODE).select("g", F.col(node).alias("node"))
    base = quads.select("g", "s", "p", "o", (F.col("o_kind") == T.LITERAL).alias("lit"))
    states = chain_states(quads)
    every = (base if states is None else base.unionByName(states)).distinct().checkpoint()
    names = _names(every)
    new, added, counts = every, None, _counts(every, names)
    new_counts = counts
    for k in range(max_rounds):
        planned = _planned(new_counts, counts, k == 0, names)
        if not planned:
            break
        found = one_round(new, every, new_counts, counts, k == 0, names)
        fresh = _unknown(found, every, [given for *_, given in planned], counts).checkpoint()
        new_counts = _counts(fresh, names)
        if not new_counts:
            break
        added = fresh if added is None else added.unionAll(fresh)
        every, new = every.unionAll(fresh), fresh
        if names is not None and any(w in new_counts for w in NAMING):
            # the schema itself has grown, and quads that are there already may be of properties it names now
            names = _names(every)
            new_counts, counts = _counts(fresh, names), _counts(every, names)
        else:
            counts = {p: counts.get(p, 0) + new_counts.get(p, 0) for p in counts | new_counts}
    else:
        raise RuntimeError(f"entailment did not settle in {max_rounds} rounds")
    if added is None:
        return quads
    told = added.where(~F.startswith("p", F.lit(STATE)))
    blanks = blank("s", "s_kind").unionAll(blank("o", "o_kind")).distinct().checkpoint()
    kind = {x: F.lit(T.IRI) for x in "so"}
    if not blanks.isEmpty():
        for x in "so":
            told = told.join(blanks.select("g", F.col("node").alias(x), F.lit(T.BNODE).alias(f"{x}_blank")), ["g", x], "left")
            kind[x] = F.coalesce(F.col(f"{x}_blank"), F.lit(T.IRI))
    o_kind = F.when(F.col("lit"), T.LITERAL).otherwise(kind["o"])
    null = F.lit(None).cast("string")
    return quads.unionByName(told.select("g", "s", "p", "o", kind["s"].alias("s_kind"), o_kind.alias("o_kind"), null.alias("o_dt"), null.alias("o_lang"), F.lit(True).alias("inferred")))

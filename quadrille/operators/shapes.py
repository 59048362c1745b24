"""Shape validation: constraints are rows, and one plan checks all of them.

A constraint (``CONSTRAINT`` columns) belongs to a shape and mostly to a path; it comes from a shapes graph by
``constraints_of`` or from Python by ``Constraint``. Focus nodes are (shape, focus), values (focus, path, o, o_kind,
o_dt). Values meet the constraints of their shape and path once; tests of single values are expressions over both,
counts are one aggregation whose missing values enter as zero rows, so a hundred shapes cost what one costs.
Severity decides what refuses: a report conforms if it holds no Violation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators.closure import closure
from quadrille.session import bounded, ensure_checkpoint_dir

REPORT = ["focus", "path", "component", "severity", "value", "shape"]
# Names of the constraint components.
COMPONENTS = ["minCount", "maxCount", "datatype", "nodeKind", "in", "pattern", "minLength", "hasValue", "disjoint", "class", "closed", "qualifiedMinCount"]
SEVERITIES = ["Violation", "Warning", "Info"]
#: A constraint as a row. ``value``: its argument as text; ``allowed``: its list, or the class that qualifies.
CONSTRAINT = "shape string, component string, path string, value string, severity string, message string, allowed array<string>"
COUNTS = ["minCount", "maxCount", "hasValue", "qualifiedMinCount"]
#: Constraints up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_CONSTRAINTS = 100_000


@dataclass
class Constraint:
    shape: str
    component: str
    path: str | None = None
    value: object = None
    severity: str = "Violation"
    allowed: list[str] = field(default_factory=list)
    message: str | None = None

    def row(self) -> tuple:
        if self.component not in COMPONENTS:
            raise ValueError(f"unknown constraint component {self.component!r}")
        return self.shape, self.component, self.path, None if self.value is None else str(self.value), self.severity, self.message, self.allowed


def rows_of(spark, constraints: list[Constraint]) -> DataFrame:
    return spark.createDataFrame([c.row() for c in constraints], CONSTRAINT)


def focus_by_class(quads: DataFrame, target: str) -> DataFrame:
    return quads.where((F.col("p") == T.RDF_TYPE) & (F.col("o") == target)).select(F.col("s").alias("focus")).distinct()


def focus_by_subjects_of(quads: DataFrame, predicate: str) -> DataFrame:
    return quads.where(F.col("p") == predicate).select(F.col("s").alias("focus")).distinct()


def values(quads: DataFrame) -> DataFrame:
    """Values of nodes; one that several graphs tell is repeated."""
    return quads.select(F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", "o_dt")


def _lexical(name: Column, text: Column) -> Column:
    """Whether a text is in the lexical space of the datatype of this local name; datatypes other than these take any."""
    number = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"
    return (
        F.when(name == "integer", text.rlike(r"^[+-]?[0-9]+$"))
        .when(name == "decimal", text.rlike(number + "$"))
        .when(name.isin("double", "float"), text.rlike(number + r"([eE][+-]?[0-9]+)?$"))
        .when(name == "boolean", text.isin("true", "false", "0", "1"))
        .when(name == "dateTime", text.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}") & F.try_to_timestamp(text).isNotNull())
        .otherwise(F.lit(True))
    )


def _fails() -> Column:
    """Whether a value fails its constraint, for the components that look at one value alone."""
    o, kind, arg, name = F.col("o"), F.col("o_kind"), F.col("value"), F.col("name")
    kinds = {"IRI": [T.IRI], "BlankNode": [T.BNODE], "Literal": [T.LITERAL], "BlankNodeOrIRI": [T.IRI, T.BNODE], "BlankNodeOrLiteral": [T.BNODE, T.LITERAL], "IRIOrLiteral": [T.IRI, T.LITERAL]}
    of_kind = F.lit(False)
    for told, some in kinds.items():
        of_kind = F.when(name == told, kind.isin(some)).otherwise(of_kind)
    typed = (kind == T.LITERAL) & (F.coalesce("o_dt", F.lit(T.XSD + "string")) == arg) & F.coalesce(_lexical(name, o), F.lit(False))
    c = F.col("component")
    return (
        F.when(c == "datatype", ~typed)
        .when(c == "nodeKind", ~of_kind)
        .when(c == "in", ~F.array_contains("allowed", o))
        .when(c == "pattern", (kind == T.BNODE) | ~F.rlike(o, arg))
        .when(c == "minLength", (kind == T.BNODE) | (F.length(o) < arg.cast("int")))
        .when(c == "closed", ~F.array_contains("allowed", F.col("at")) & (F.col("at") != T.RDF_TYPE))
        .otherwise(F.lit(False))
    )


def check(constraints: DataFrame, focus: DataFrame, vals: DataFrame, types: DataFrame | None = None, repeats: bool = False) -> DataFrame:
    """The report (``REPORT``, message) of constraint rows on (shape, focus). ``types`` (s, c): entailed classes, for ``class`` and ``qualifiedMinCount``; with ``repeats``, values may come more than once and count once."""
    ensure_checkpoint_dir(constraints.sparkSession)
    told = constraints.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per component
    has = {r.component: r.n for r in told}
    if set(has) - set(COMPONENTS):
        raise ValueError(f"unknown constraint components {sorted(set(has) - set(COMPONENTS))}")
    if types is None and has.keys() & {"class", "qualifiedMinCount"}:
        raise ValueError("constraints on classes need the types of nodes")
    small = (lambda df: F.broadcast(df)) if sum(has.values()) <= BROADCAST_CONSTRAINTS else (lambda df: df)
    # with the local name of the argument, for datatypes and node kinds: once a rule, not once a value
    rules = constraints.distinct().withColumns({"cid": F.xxhash64("shape", "component", "path", "value", "severity", "message", "allowed"), "name": F.regexp_replace("value", "^.*#", "")}).checkpoint()
    of = lambda *names: rules.where(F.col("component").isin(*names))
    nodes = focus.distinct()
    # values of focus nodes, written once: each kind of test reads them again
    mine = nodes.join(vals.withColumnRenamed("path", "at"), "focus")
    mine = mine.distinct() if repeats else mine  # they lie by focus already: no further shuffle, and none of other nodes
    mine = mine.checkpoint() if has.keys() & {"class", "closed", "qualifiedMinCount"} else mine
    # what a constraint hears of: single values that fail, counted values, values on the sides of a pair
    by_path = of(*[c for c in COMPONENTS if c not in ("class", "closed", "qualifiedMinCount")]).withColumns({"at": F.col("path"), "side": F.lit(1)})
    if "disjoint" in has:
        by_path = by_path.unionByName(of("disjoint").withColumns({"at": F.col("value"), "side": F.lit(2)}))
    heard = mine.join(small(by_path), ["shape", "at"])
    counted = F.col("component").isin(COUNTS)
    matters = F.when(F.col("component") == "hasValue", F.col("o") == F.col("value")).when(counted | (F.col("component") == "disjoint"), True).otherwise(_fails())
    event = lambda rows, n=1, key="o", side=0: rows.select("focus", "cid", F.col("at") if "at" in rows.columns else F.lit(None).cast("string").alias("at"), (F.col(key) if key else F.lit(None)).cast("string").alias("key"), F.lit(n).alias("n"), (F.col("side") if "side" in rows.columns else F.lit(side)).alias("side"))
    heard = heard.where(matters)
    events = [event(heard.withColumns({"key": F.when(counted, F.lit(None)).otherwise(F.col("o")), "at": F.lit(None).cast("string")}), key="key")]
    if "closed" in has:
        events.append(event(mine.join(small(of("closed")), "shape").where(_fails())))
    if "class" in has:
        member = types.select(F.col("s").alias("o"), F.col("c").alias("value")).distinct()
        events.append(event(mine.join(small(of("class").withColumn("at", F.col("path"))), ["shape", "at"]).join(member, ["o", "value"], "left_anti").drop("at")))
    if "qualifiedMinCount" in has:
        member = types.select(F.col("s").alias("o"), F.col("c").alias("of")).distinct()
        rows = mine.join(small(of("qualifiedMinCount").withColumns({"at": F.col("path"), "of": F.get("allowed", F.lit(0))})), ["shape", "at"])
        events.append(event(rows.join(member, ["o", "of"], "left_semi").drop("at"), key=None))
    if has.keys() & (set(COUNTS) - {"maxCount"}):  # what a focus node lacks counts as zero
        events.append(event(nodes.join(small(of("minCount", "hasValue", "qualifiedMinCount")), "shape"), 0, None))
    every = events[0]
    for e in events[1:]:
        every = every.unionByName(e)
    found = every.groupBy("focus", "cid", "at", "key").agg(F.sum("n").alias("n"), F.bit_or("side").alias("sides")).join(small(rules), "cid")
    wanted = F.when(F.col("component") == "hasValue", F.lit(1)).otherwise(F.col("value").try_cast("int"))
    bad = F.when(F.col("component") == "maxCount", F.col("n") > wanted).when(F.col("component").isin(COUNTS), F.col("n") < wanted).when(F.col("component") == "disjoint", F.col("sides") == 3).otherwise(F.lit(True))
    return found.where(bad).select("focus", F.coalesce("at", "path").alias("path"), "component", "severity", F.col("key").alias("value"), "shape", "message")


def validate(constraints: list[Constraint], focus: dict[str, DataFrame], vals: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """The report (``REPORT``) of constraints told in Python; ``focus`` by shape."""
    nodes = None
    for shape, frame in focus.items():
        one = frame.select(F.lit(shape).alias("shape"), "focus")
        nodes = one if nodes is None else nodes.unionByName(one)
    return check(rows_of(vals.sparkSession, constraints), nodes, vals, types).select(*REPORT)


def violations_of(c: Constraint, focus: DataFrame, vals: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """The violations of one constraint."""
    return validate([c], {c.shape: focus}, vals, types)


# --- constraints from a shapes graph -----------------------------------------------------------------------


def list_members(quads: DataFrame, heads: DataFrame) -> DataFrame:
    """(g, head, members): the sorted members of RDF lists that start at ``heads`` (g, head)."""
    rest = quads.where(F.col("p") == T.RDF + "rest").select("g", F.col("s").alias("src"), F.col("o").alias("dst"))
    further = closure(rest, heads.select(F.col("head").alias("src")), max_depth=None, keys=("g",)).pairs.select("g", F.col("src").alias("head"), F.col("dst").alias("cell"))
    cells = heads.select("g", "head", F.col("head").alias("cell")).unionByName(further)
    first = quads.where(F.col("p") == T.RDF + "first").select("g", F.col("s").alias("cell"), "o")
    return cells.join(first, ["g", "cell"]).groupBy("g", "head").agg(F.sort_array(F.collect_set("o")).alias("members"))


def constraints_of(quads: DataFrame) -> DataFrame:
    """Constraint rows of a shapes graph: property shapes, lists, severities, messages, closed shapes; deactivated ones are left out."""
    ensure_checkpoint_dir(quads.sparkSession)
    sh = lambda name: T.SHACL + name
    # what is said of each subject, in one row: shapes have tens of properties
    facts = quads.groupBy("g", F.col("s").alias("node")).agg(F.collect_set(F.struct("p", "o")).alias("po")).checkpoint()
    get = lambda name: F.array_sort(F.transform(F.filter("po", lambda x: x["p"] == sh(name)), lambda x: x["o"]))
    on = ~F.array_contains(get("deactivated"), "true")
    is_shape = F.exists("po", lambda x: x["p"].isin([sh(n) for n in ("property", "targetClass", "targetSubjectsOf", "targetNode")]) | (x["p"] == T.RDF_TYPE) & (x["o"] == sh("NodeShape")))
    least = lambda name: F.get(get(name), F.lit(0))
    severity = F.coalesce(F.regexp_replace(least("severity"), "^.*#", ""), F.lit("Violation"))
    shapes = facts.where(is_shape & on).withColumnRenamed("node", "shape")
    props = shapes.select("g", "shape", F.explode(get("property")).alias("node")).join(facts, ["g", "node"]).where(on)
    nodes = props.select("g", "shape", "node", F.explode(get("path")).alias("path"), severity.alias("severity"), least("message").alias("message"), "po").checkpoint()
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    told = ["shape", "component", "path", "value", "severity", "message", "allowed"]
    plain = [sh(n) for n in ("minCount", "maxCount", "datatype", "nodeKind", "pattern", "minLength", "hasValue", "disjoint", "class")]
    args = nodes.select("*", F.explode(F.filter("po", lambda x: x["p"].isin(plain))).alias("x"))
    out = args.select("shape", F.regexp_replace("x.p", "^.*#", "").alias("component"), "path", F.col("x.o").alias("value"), "severity", "message", none.alias("allowed"))
    inner = facts.select("g", F.col("node").alias("inner"), least("class").alias("of")).where("of IS NOT NULL")
    qualified = nodes.select("*", least("qualifiedMinCount").alias("value"), F.explode(get("qualifiedValueShape")).alias("inner")).where("value IS NOT NULL").join(inner, ["g", "inner"])
    out = out.unionAll(qualified.select("shape", F.lit("qualifiedMinCount"), "path", "value", "severity", "message", F.array("of")))
    enums = nodes.select("*", F.explode(get("in")).alias("head"))
    # closed shapes: their own paths, and what they ignore, told singly or as a list
    closed = shapes.where(F.array_contains(get("closed"), "true")).select("g", "shape", severity.alias("severity"), least("message").alias("message"), get("ignoredProperties").alias("ignored"))
    heads = enums.select("g", "head").unionAll(closed.select("g", F.explode("ignored").alias("head"))).distinct().checkpoint()
    lists = list_members(quads, heads)
    listed = enums.join(lists, ["g", "head"], "left").select("shape", F.lit("in"), "path", null, "severity", "message", F.coalesce("members", none))
    ignored = closed.select("g", "shape", F.explode("ignored").alias("head")).join(lists, ["g", "head"], "left").select("g", "shape", F.explode(F.coalesce("members", F.array("head"))).alias("path"))
    own = nodes.select("g", "shape", "path").unionAll(ignored).groupBy("g", "shape").agg(F.sort_array(F.collect_set("path")).alias("allowed"))
    closed = closed.join(own, ["g", "shape"], "left").select("shape", F.lit("closed"), null, null, "severity", "message", F.coalesce("allowed", none))
    return out.unionAll(listed).unionAll(closed).toDF(*told).distinct()


def targets(shapes: DataFrame, quads: DataFrame, types: DataFrame) -> DataFrame:
    """(shape, focus): the nodes of ``quads`` that the shapes of a shapes graph are for; ``types`` (s, c): entailed classes."""
    # nearly all nodes may be of one class: a shuffle by it would bring them to one task
    of = lambda name, o: bounded(shapes.where(F.col("p") == T.SHACL + name).select(F.col("s").alias("shape"), F.col("o").alias(o)).distinct())
    by_class = types.select(F.col("s").alias("focus"), F.col("c").alias("target")).join(of("targetClass", "target"), "target").select("shape", "focus")
    by_use = quads.select(F.col("s").alias("focus"), F.col("p").alias("target")).join(of("targetSubjectsOf", "target"), "target").select("shape", "focus")
    return by_class.unionByName(by_use).unionByName(of("targetNode", "focus").select("shape", "focus")).distinct()


def types_of(quads: DataFrame) -> DataFrame:
    """(s, c): the classes of nodes, as far as ``quads`` entail them already."""
    return quads.where(F.col("p") == T.RDF_TYPE).select("s", F.col("o").alias("c")).distinct()


def validate_graph(quads: DataFrame, shapes: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """The report (``REPORT``, message) of data quads against a shapes graph."""
    types = types_of(quads) if types is None else types
    return check(constraints_of(shapes).checkpoint(), targets(shapes, quads, types), values(quads), types, repeats=True)


def report_quads(report: DataFrame, g: str, subject: str = "urn:x:report") -> DataFrame:
    """A report as quads: the report node, whether it conforms, and a node for each result."""
    from quadrille.operators.quads import quads_of, union

    node = F.concat(F.lit(subject + "/"), F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("shape", "focus", "path", "component", "value")]), 256))
    rows, sh = report.distinct(), T.SHACL
    whole = report.agg((F.count_if(F.col("severity") == "Violation") == 0).cast("string").alias("conforms"))
    kind = F.concat(F.lit(sh), F.upper(F.substring("component", 1, 1)), F.expr("substring(component, 2)"), F.lit("ConstraintComponent"))
    said = {T.RDF_TYPE: F.lit(sh + "ValidationResult"), sh + "focusNode": F.col("focus"), sh + "resultPath": F.col("path"), sh + "resultSeverity": F.concat(F.lit(sh), "severity"), sh + "value": F.col("value"), sh + "sourceShape": F.col("shape"), sh + "sourceConstraintComponent": kind}
    if "message" in report.columns:
        said[sh + "resultMessage"] = F.col("message")
    cells = F.array(F.struct(F.lit(subject).alias("s"), F.lit(sh + "result").alias("p"), node.alias("o")), *[F.struct(node.alias("s"), F.lit(p).alias("p"), o.alias("o")) for p, o in said.items()])
    cell = rows.select(F.explode(cells).alias("c")).select("c.*")
    literal = F.when(F.col("p").isin(sh + "value", sh + "resultMessage"), T.LITERAL).otherwise(T.IRI)
    out = quads_of(cell, F.col("s"), F.col("p"), F.col("o"), g, literal)
    head = [quads_of(whole, F.lit(subject), T.RDF_TYPE, F.lit(sh + "ValidationReport"), g), quads_of(whole, F.lit(subject), sh + "conforms", F.col("conforms"), g, T.LITERAL, T.XSD + "boolean")]
    return union(out, *head)


def conforms(report: DataFrame) -> DataFrame:
    return report.agg((F.count_if(F.col("severity") == "Violation") == 0).alias("conforms"), F.count_if(F.col("severity") == "Violation").alias("violations"), F.count_if(F.col("severity") == "Warning").alias("warnings"))


def summary(report: DataFrame) -> DataFrame:
    """Violations as one text, in a fixed order."""
    line = F.concat_ws(" ", "focus", "path", "component")
    return report.where("severity = 'Violation'").agg(F.array_join(F.sort_array(F.collect_list(line)), "; ").alias("summary"))


# --- the declared surface, from shape quads ----------------------------------------------------------------


def property_shapes(quads: DataFrame) -> DataFrame:
    """(g, shape, target, node, path, datatype, min_count, max_count, node_kind, pattern), one row per declared property."""
    about = lambda p, name: quads.where(F.col("p") == p).select("g", F.col("s").alias("node"), F.col("o").alias(name))
    shape = quads.where(F.col("p") == T.SHACL + "targetClass").select("g", F.col("s").alias("shape"), F.col("o").alias("target"))
    props = quads.where(F.col("p") == T.SHACL + "property").select("g", F.col("s").alias("shape"), F.col("o").alias("node"))
    out = shape.join(props, ["g", "shape"]).join(about(T.SHACL + "path", "path"), ["g", "node"])
    for p, name in (("datatype", "datatype"), ("minCount", "min_count"), ("maxCount", "max_count"), ("nodeKind", "node_kind"), ("pattern", "pattern")):
        out = out.join(about(T.SHACL + p, name), ["g", "node"], "left")
    return out.select("g", "shape", "target", "node", "path", "datatype", F.expr("try_cast(min_count AS int)").alias("min_count"), F.expr("try_cast(max_count AS int)").alias("max_count"), "node_kind", "pattern")


def property_map(shapes: DataFrame, ancestors: DataFrame, priority: dict[str, int]) -> DataFrame:
    """(type, key, path): the property of each local name for each type, with its ancestors'; the graph of least priority number wins, then the path's order.

    ``ancestors``: (type, ancestor), a type among its own.
    """
    rank = F.lit(len(priority))
    for name, n in priority.items():
        rank = F.when(F.col("g") == name, F.lit(n)).otherwise(rank)
    rows = ancestors.join(shapes.select("g", F.col("target").alias("ancestor"), "path"), "ancestor")
    return rows.groupBy("type", T.local_name(F.col("path")).alias("key")).agg(F.min_by("path", F.struct(rank, F.col("path"))).alias("path"))


def unshaped(quads: DataFrame) -> DataFrame:
    """(class): classes that are declared and that no shape targets."""
    declared = quads.where((F.col("p") == T.RDF_TYPE) & F.col("o").isin(T.OWL + "Class", T.RDFS + "Class")).select(F.col("s").alias("class"))
    return declared.subtract(quads.where(F.col("p") == T.SHACL + "targetClass").select(F.col("o").alias("class")))


def admitted(types: DataFrame, quads: DataFrame) -> DataFrame:
    """(type, admitted, shaped) of asked types: a shape targets it, or it is a declared class."""
    shaped = quads.where(F.col("p") == T.SHACL + "targetClass").select(F.col("o").alias("type")).distinct().withColumn("shaped", F.lit(True))
    declared = quads.where((F.col("p") == T.RDF_TYPE) & F.col("o").isin(T.OWL + "Class", T.RDFS + "Class")).select(F.col("s").alias("type")).distinct().withColumn("declared", F.lit(True))
    both = types.join(shaped, "type", "left").join(declared, "type", "left")
    no = F.lit(False)
    return both.select("type", (F.coalesce("shaped", no) | F.coalesce("declared", no)).alias("admitted"), F.coalesce("shaped", no).alias("shaped"))


def self_test(quads: DataFrame) -> DataFrame:
    """(shape, target, present): every shape's target and whether it is a declared class."""
    targets = quads.where(F.col("p") == T.SHACL + "targetClass").select(F.col("s").alias("shape"), F.col("o").alias("target")).distinct()
    declared = quads.where((F.col("p") == T.RDF_TYPE) & F.col("o").isin(T.OWL + "Class", T.RDFS + "Class")).select(F.col("s").alias("target")).distinct().withColumn("present", F.lit(True))
    return targets.join(declared, "target", "left").select("shape", "target", F.coalesce("present", F.lit(False)).alias("present"))


def explained(quads: DataFrame, types: DataFrame) -> DataFrame:
    """(type, path, comment): asserted comments of types (path null) and of their declared properties."""
    comments = quads.where((F.col("p") == T.COMMENT) & ~F.col("inferred")).groupBy("s").agg(F.min("o").alias("comment"))
    own = types.select("type", F.lit(None).cast("string").alias("path"), F.col("type").alias("s"))
    props = property_shapes(quads).join(types.select(F.col("type").alias("target")), "target", "left_semi").select(F.col("target").alias("type"), "path", F.col("path").alias("s")).distinct()
    return own.unionByName(props).join(comments, "s", "left").select("type", "path", "comment")

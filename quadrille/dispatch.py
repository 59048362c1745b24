"""One door: ``dispatch(context, verb, payload)`` routes a verb to the operator that answers it, as a DataFrame.

Reads are lazy plans. Writes judge and seal what they are asked for, one request in the payload or a whole DataFrame
of them under ``rows``; the context's frames then hold the new rows, and the answer has a row for each request. What
the rules refuse for a whole call raises ``Refused``; ``dispatch_safe`` gives that as a row instead.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import bodies as B
from quadrille.functions import terms as T
from quadrille.functions.terms import CANONICAL_VERBS
from quadrille.operators import audits, closure, derived, documents, entail, governance, governed, ledger, quads, references, shapes, writes
from quadrille.operators import seal as sealing
from quadrille.operators.documents import Refused
from quadrille.session import ensure_checkpoint_dir

OBLIGATION = "target_type string, obligation string, check_name string, active boolean"


@dataclass
class Context:
    """Who asks, and the frames that a project's store has. Frames that a verb does not touch may be missing."""

    project: str
    requester: str | None = None
    key: bytes = b""
    docs: DataFrame | None = None
    quads: DataFrame | None = None
    ledger: DataFrame | None = None
    proofs: DataFrame | None = None
    grants: DataFrame | None = None
    surface: DataFrame | None = None
    declared: list[str] | None = None
    keys: dict[str, dict[str, str]] = field(default_factory=dict)
    plans: dict[str, tuple[Callable[..., DataFrame], list[str]]] = field(default_factory=dict)
    governed: DataFrame | None = None
    allowed: DataFrame | None = None
    obligations: DataFrame | None = None
    evidence: dict[str, DataFrame] = field(default_factory=dict)
    events: DataFrame | None = None
    pointers: DataFrame | None = None
    epoch: int = 0
    _judge: tuple | None = None

    def need(self, name: str) -> DataFrame:
        frame = getattr(self, name)
        if frame is None:
            raise Refused(f"the context has no {name}")
        return frame


    def judge(self) -> sealing.Surface:
        """The surface, compiled once for as long as it stays."""
        surface = self.need("surface")
        if self._judge is None or self._judge[0] is not surface:
            self._judge = (surface, sealing.Surface.of(surface))
        return self._judge[1]

    def who(self) -> sealing.Who:
        return sealing.Who(self.project, self.requester, self.key, self.epoch)

    def absorb(self, sealed: sealing.Sealed) -> None:
        """Hold what a seal adds: new versions replace documents, all else is appended. Documents are checkpointed, so that plans don't grow with the calls."""
        plus = lambda old, new: new if old is None else old.unionByName(new, allowMissingColumns=True)
        rest = None if self.docs is None else self.docs.join(sealed.instances.select("id"), "id", "left_anti").checkpoint()
        self.docs, self.ledger, self.proofs = plus(rest, sealed.instances), plus(self.ledger, sealed.ledger), plus(self.proofs, sealed.proofs)
        self.quads, self.events = plus(self.quads, sealed.quads), plus(self.events, sealed.events)


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _spark(ctx: Context):
    return ctx.need("surface").sparkSession


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def _requests(ctx: Context, p: dict, schema: str) -> DataFrame:
    """The payload as request rows; ``rid`` is the time of the call where it is one request."""
    ensure_checkpoint_dir(_spark(ctx))
    if isinstance(p.get("rows"), DataFrame):
        return p["rows"]
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    names = [c.split()[0] for c in schema.split(", ")]
    return _spark(ctx).createDataFrame([(time.time_ns(), *(text(p.get(n)) for n in names))], f"rid bigint, {schema}")


def _docs(ctx: Context) -> DataFrame:
    return ctx.docs if ctx.docs is not None else _empty(_spark(ctx), "id string, type string, body string, ts timestamp")


def _sealed(ctx: Context, good: DataFrame, refused: DataFrame) -> DataFrame:
    """Seal what requests made, hold it, and answer (rid, id, ok, refused, digest, warnings) for each request."""
    log = ctx.ledger if ctx.ledger is not None else _empty(_spark(ctx), "seq bigint, instance_id string, body_sha256 string, sig string, prev_seq bigint, ts timestamp")
    ensure_checkpoint_dir(_spark(ctx))
    good = good.checkpoint()
    out = sealing.seal(good, log, ctx.judge(), ctx.who(), F.current_timestamp(), ctx.obligations, ctx.evidence)
    refused = refused.checkpoint()
    ctx.absorb(out)
    warned = out.warnings.groupBy("id").agg(F.count(F.lit(1)).alias("warnings"))
    digest = out.ledger.select(F.col("instance_id").alias("id"), F.col("body_sha256").alias("digest"))
    said = good.join(out.refused.select("rid", "reason"), "rid", "left").join(digest, "id", "left").join(warned, "id", "left")
    ok = F.col("reason").isNull()
    rows = said.select("rid", "id", ok.alias("ok"), F.col("reason").alias("refused"), F.when(ok, F.col("digest")).alias("digest"), F.coalesce("warnings", F.lit(0)).alias("warnings"))
    none = F.lit(None).cast("string")
    return rows.unionByName(refused.select("rid", none.alias("id"), F.lit(False).alias("ok"), F.col("reason").alias("refused"), none.alias("digest"), F.lit(0).alias("warnings")))


def _propmap(ctx: Context, surface: DataFrame | None = None) -> DataFrame:
    """(type, key, path) of all declared types, their ancestors' properties included; the kernel's graph goes before the others."""
    surface = ctx.need("surface") if surface is None else surface
    shaped = shapes.property_shapes(surface)
    own = shaped.select(F.col("target").alias("type"), F.col("target").alias("ancestor")).distinct()
    above = surface.where(F.col("p") == T.SUBCLASS).select(F.col("s").alias("type"), F.col("o").alias("ancestor"))
    return shapes.property_map(shaped, own.unionByName(above).distinct(), {ctx.who().kernel: 0})


def _create(ctx: Context, p: dict) -> DataFrame:
    if "rows" not in p:
        inner = p["body"] if isinstance(p.get("body"), dict) and "type" in p["body"] else p
        p = {"type": inner.get("type"), "fields": {k: v for k, v in inner.items() if k != "rid"}}
    return _sealed(ctx, *writes.create(_requests(ctx, p, "type string, fields string"), _propmap(ctx), _now()))


def _transition(ctx: Context, p: dict) -> DataFrame:
    pairs = ctx.allowed if ctx.allowed is not None else _empty(_spark(ctx), "type string, from_state string, to_state string")
    good, refused, steps = writes.transition(_requests(ctx, p, "id string, to_state string"), _docs(ctx), pairs)
    return _sealed(ctx, good, refused).join(steps, "rid", "left")


def _link(ctx: Context, p: dict) -> DataFrame:
    asked = _requests(ctx, p, "source string, predicate string, target string, type string").checkpoint()
    names = declared_predicates(ctx.need("surface"), ctx.who().kernel)
    before = _docs(ctx)
    answer = _sealed(ctx, *writes.link(asked, names, _now())).checkpoint()
    made, reachable = references.edges(asked.join(answer.where("ok").select("rid"), "rid", "left_semi"), before, f"urn:x:{ctx.project}/edges")
    ctx.quads = ctx.quads.unionByName(made)
    return answer.join(reachable, "rid", "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def _update(ctx: Context, p: dict) -> DataFrame:
    asked = _requests(ctx, p, "id string, patch string")
    ids = references.resolve_ids(asked.select(F.col("id").alias("ref")), _docs(ctx)).select(F.col("ref").alias("id"), F.col("id").alias("real"))
    asked = asked.join(ids, "id", "left").withColumn("id", F.coalesce("real", "id")).drop("real")
    return _sealed(ctx, *writes.update(asked, _docs(ctx), _propmap(ctx)))


def _apply(ctx: Context, p: dict) -> DataFrame:
    """One accepted proposal after the other: its quads join the kernel's graph, the epoch advances and is sealed with its surface's digests."""
    spark, who = _spark(ctx), ctx.who()
    asked = _requests(ctx, p, "about string")
    good, refused = writes.applied(asked, _docs(ctx), ctx.epoch + 1)
    said = writes.proposals(_docs(ctx)).join(good.select("id", "rid"), "id").select("rid", "op", "detail").limit(2).collect()
    if len(said) > 1:
        raise Refused("proposals are applied one by one")
    if not said:
        return _sealed(ctx, good, refused)
    detail = json.loads(said[0].detail)
    if said[0].op in ("add_affordance",):
        row = governed.registered(spark, ctx.project, ctx.epoch + 1, detail)
        ctx.governed = row if ctx.governed is None else ctx.governed.unionByName(row)
    elif said[0].op == "add_proof_obligation":
        row = governance.obligation(spark, detail)
        rest = None if ctx.obligations is None else ctx.obligations.where(F.col("obligation") != detail["obligation"])
        ctx.obligations = row if rest is None else rest.unionByName(row)
    elif said[0].op == "set_transition_map":
        new = governance.transition_rows(spark, detail)
        rest = None if ctx.allowed is None else ctx.allowed.where(~F.col("type").eqNullSafe(F.lit(detail["class"])))
        ctx.allowed = new if rest is None else rest.unionByName(new)
    if said[0].op in ("add_class", "add_property", "set_transition_map"):
        added = governance.operation_quads(spark, said[0].op, detail, who.kernel)
        ctx.surface = entail.entail(ctx.need("surface").where("NOT inferred").unionByName(added)).checkpoint()
    ctx.epoch += 1
    digests = ctx.surface.withColumn("g", F.lit("surface"))
    copy, shape = (d.first().digest for d in (quads.copy_digest(digests), quads.structural_digest(digests)))
    c = T.CORE
    epoch = {"type": c + "Epoch", "@id": f"urn:x:{ctx.project}/epoch/{ctx.epoch}", c + "epoch": ctx.epoch, c + "surfaceDigest": copy, c + "structuralDigest": shape}
    built = {"type": c + "Materialization", "@id": f"urn:x:{ctx.project}/materialization/{ctx.epoch}", c + "materializes": who.kernel, c + "fromEpoch": ctx.epoch - 1, c + "toEpoch": ctx.epoch, c + "surfaceDigest": copy, c + "producesEpoch": epoch["@id"]}
    acts = spark.createDataFrame([(-1, f"epoch-{ctx.project}-{ctx.epoch}", json.dumps(epoch)), (-2, f"mat-{ctx.project}-{ctx.epoch}", json.dumps(built))], "rid bigint, id string, body string")
    row = spark.createDataFrame([(copy, ctx.epoch)], "digest string, epoch bigint")
    ctx.evidence["epochs"] = ctx.evidence["epochs"].unionByName(row) if "epochs" in ctx.evidence else row
    return _sealed(ctx, good.unionByName(acts), refused)


def _germinate(ctx: Context, p: dict) -> DataFrame:
    """A new project with its kernel and organs, owned by who asks."""
    import re

    name, c = p.get("project") or "", T.CORE
    if not re.fullmatch("[a-z0-9]+(-[a-z0-9]+)*", name):
        raise Refused(f"{name!r} is no canonical project name: lower case, single dashes")
    who, label = ctx.who(), p.get("label") or name
    who.check()
    base = f"urn:x:{name}"
    made = _spark(ctx).createDataFrame(writes.organs(name, label, f"{base}/kernel/ck"), quads.SCHEMA)
    ctx.quads = made if ctx.quads is None else quads.clear_graph(ctx.quads, f"{base}/kernel/ck").unionByName(made)
    project = {"type": c + "Project", "@id": f"urn:x:project:{name}", T.LABEL: label, c + "ownedBy": who.iri} | ({c + "projectKind": p["kind"]} if p.get("kind") else {})
    kernel = {"type": c + "Kernel", "@id": f"{base}/kernel", T.LABEL: label, c + "epoch": 0, c + "inProject": project["@id"], c + "hasOrgan": [f"{base}/organ/{k}" for k in ("ck", "tool", "data")]}
    rows = _spark(ctx).createDataFrame([(1, project["@id"], json.dumps(project)), (2, kernel["@id"], json.dumps(kernel))], "rid bigint, id string, body string")
    return _sealed(ctx, rows, _empty(_spark(ctx), "rid bigint, reason string"))


def declared_predicates(surface: DataFrame, kernel: str) -> DataFrame:
    """(predicate): the paths that the shapes of a kernel's own graph declare."""
    return surface.where((F.col("g") == kernel) & (F.col("p") == T.SHACL + "path")).select(F.col("o").alias("predicate")).distinct()


def _project_spine(ctx: Context, p: dict) -> DataFrame:
    """Project all documents anew; how many."""
    g, docs = f"urn:x:{ctx.project}/instances", _docs(ctx)
    made = quads.body_to_quads(docs.select("id", "body"), g)
    ctx.quads = made if ctx.quads is None else quads.clear_graph(ctx.quads, g).unionByName(made)
    return docs.agg(F.count(F.lit(1)).alias("projected"))


def _governed(ctx: Context, verb: str, p: dict) -> DataFrame:
    """A registered read or derived value: the project's own plan before the floor's, the newest of it."""
    asked = ctx.need("governed").sparkSession.createDataFrame([(ctx.project, verb)], "kernel string, verb string")
    plan = governance.resolve_plans(ctx.governed, asked).first()
    spec = json.loads(plan.statement)
    if plan.kind == "query":
        return governed.read(ctx.need("quads"), governed.bind(spec, plan.params, p))
    bound = governed.bind(spec["scope"] | {"about": "$concept$"}, ["concept"], p)
    pointers = ctx.pointers if ctx.pointers is not None else _empty(ctx.docs.sparkSession, derived.POINTER)
    answer, ctx.pointers = derived.derive(_docs(ctx), ctx.need("ledger"), verb, bound, spec["formula"], plan.epoch, pointers)
    return answer


def _typed(ctx: Context, p: dict) -> DataFrame:
    docs = ctx.need("docs")
    return documents.of_type(docs, p["type"]) if p.get("type") else docs


def _query(ctx: Context, p: dict) -> DataFrame:
    filters = [(f["key"], f["op"], str(f["value"])) for f in p.get("filter", [])]
    return documents.query(_typed(ctx, p), filters, ctx.keys.get(p.get("type")), int(p.get("limit", 100)), int(p.get("offset", 0)))


def _reach(ctx: Context, p: dict) -> DataFrame:
    found = closure.reach(ctx.need("quads"), p["from"], p["via"], int(p.get("max_depth", 64)), ctx.declared)
    return found.pairs.select(F.col("dst").alias("node"), "g", "depth", F.lit(found.depth).alias("max_depth"), F.lit(found.truncated).alias("truncated"))


def _match(ctx: Context, p: dict) -> DataFrame:
    labels = documents.project_labels(ctx.need("docs"), p.get("keys", ["label", "title", "name", "prefLabel", "subject", "topic"]))
    return documents.match_labels(labels, p["term"], int(p.get("limit", 10)))


def _snapshot(ctx: Context, p: dict) -> DataFrame:
    allowed = ctx.need("grants").where((F.col("grantee") == F.lit(ctx.requester)) & (F.col("permission") == "snapshot")).limit(1)
    if allowed.isEmpty():
        raise Refused("no grant to take a snapshot")
    return ctx.need("docs").select("id", "type")


def _class(p: dict) -> str:
    """The asked class; prefixed names are refused, as nothing expands them and they would look unknown."""
    name = (p.get("type") or p.get("@type") or "").strip()
    if not name:
        raise Refused("type required")
    if "://" not in name and not name.startswith("urn:"):
        raise Refused(f"{name!r} is a prefixed name, not an IRI")
    return name


def _typecheck(ctx: Context, p: dict) -> DataFrame:
    """(type, admitted, shaped, via, digest, epoch): whether the composed surface or the project's board admits a class, and under which surface."""
    surface = ctx.need("surface")
    asked = _spark(ctx).createDataFrame([(_class(p),)], "type string")
    rows = shapes.admitted(asked, surface)
    board = asked.select("type", F.lit(False).alias("by_board"))
    if ctx.quads is not None:
        board = shapes.admitted(asked, quads.graph(ctx.quads, f"urn:x:{ctx.project}/kernel/board")).select("type", F.col("admitted").alias("by_board"))
    digest = quads.copy_digest(surface.withColumn("g", F.lit("surface"))).select("digest")
    via = F.when(F.col("admitted"), "composed").when(F.col("by_board"), "board")
    one = rows.join(board, "type").select("type", (F.col("admitted") | F.col("by_board")).alias("admitted"), "shaped", via.alias("via"), F.lit(ctx.epoch).alias("epoch"))
    return one.withColumn("digest", F.lit((digest.first() or [None])[0]).cast("string"))


def _declared(ctx: Context, p: dict) -> DataFrame:
    """(key, path, kernel_path): what a class's short names stand for on the whole surface, and in the kernel's graph alone."""
    of = lambda rows: rows.where(F.col("type") == _class(p)).select("key", "path")
    own = _propmap(ctx, ctx.need("surface").where(F.col("g") == ctx.who().kernel))
    return of(_propmap(ctx)).join(of(own).withColumnRenamed("path", "kernel_path"), "key", "left")


def _validate(ctx: Context, p: dict) -> DataFrame:
    focus = {c.shape: shapes.focus_by_class(ctx.need("quads"), p["type"]) for c in p["constraints"]}
    return shapes.validate(p["constraints"], focus, shapes.values(ctx.need("quads")))


VERBS: dict[str, Callable[[Context, dict], DataFrame]] = {
    "instance.query": _query,
    "instances.list": lambda c, p: documents.last(_typed(c, p), int(p.get("n", p.get("limit", 50)))),
    "instances.last": lambda c, p: documents.last(_typed(c, p), int(p.get("n", 10))),
    "instances.count": lambda c, p: _typed(c, p).agg(F.count(F.lit(1)).alias("n")),
    "instance.get": lambda c, p: documents.get(c.need("docs"), p["id"]),
    "instance.reach": _reach,
    "instance.snapshot": _snapshot,
    "snapshot.bodies": lambda c, p: _typed(c, p).select("id", "body").orderBy("id"),
    "concept.match": _match,
    "instance.explain": lambda c, p: quads.direct_and_inferred(c.need("quads")),
    "instance.validate": _validate,
    "instance.verify": lambda c, p: ledger.verify(documents.get(c.need("docs"), p["id"]), c.need("ledger").where(F.col("instance_id") == p["id"]), c.need("proofs").where(F.col("about") == p["id"]), c.key),
    "instance.provenance": lambda c, p: ledger.provenance(c.need("ledger").where(F.col("instance_id") == p["id"]), c.need("proofs").where(F.col("about") == p["id"])),
    "surface.grounding": lambda c, p: quads.grounding(c.need("surface")),
    "surface.unshaped": lambda c, p: shapes.unshaped(c.need("surface")),
    "surface.declared": _declared,
    "surface.typecheck": _typecheck,
    "surface.explain": lambda c, p: shapes.explained(c.need("surface"), c.need("surface").sparkSession.createDataFrame([(p["type"],)], "type string")),
    "surface.check": lambda c, p: audits.surface_check(c.project, c.epoch, _docs(c), c.need("surface"), c.need("quads") if c.quads is not None else c.need("surface"), p.get("adopted")),
    "integrity.check": lambda c, p: audits.integrity(c.need("docs"), c.need("surface")),
    "adoption.check": lambda c, p: audits.adoption_check(c.project, c.need("docs"), c.need("quads"), p["pins"], p.get("sources")),
    "fleet.adoptions": lambda c, p: audits.fleet(*audits.adoption_rows(c.need("docs")), c.need("quads"), p["pins"]),
    "authority.mine": lambda c, p: audits.authority_of(c.need("docs"), c.who().iri if c.requester else None),
    "wave.signals": lambda c, p: audits.signals(c.need("docs"), c.project, p.get("pass"), p.get("component"), c.obligations),
    "wave.project": _project_spine,
    "affordances": lambda c, p: audits.affordances(c.need("docs"), c.need("surface"), c.who().kernel, [*VERBS, *c.plans]),
    "kernels.list": lambda c, p: c.need("docs").where(F.startswith("id", F.lit("backlog:"))).orderBy("id"),
    "snapshot.board": lambda c, p: audits.board(c.need("docs"), c.need("ledger"), c.need("proofs"), c.key),
    "participant.join": lambda c, p: _spark(c).createDataFrame([(p["name"],)], "name string").select(F.concat(F.lit(T.PARTICIPANT), T.slug(F.col("name"))).alias("participant")),
    "instance.create": _create,
    "instance.update": _update,
    "instance.transition": _transition,
    "instance.retire": lambda c, p: _sealed(c, *writes.retire(_requests(c, p, "id string, reason string"), _docs(c), c.epoch)),
    "instance.link": _link,
    "notify": lambda c, p: _sealed(c, *writes.notify(_requests(c, p, "sender string, predicate string, target string, text string, type string"), _now())),
    "kernel.propose_change": lambda c, p: _sealed(c, *writes.propose(_requests(c, p, "op string, about string, detail string, requires_quorum string"), c.who().kernel)),
    "kernel.vote": lambda c, p: _sealed(c, *writes.vote(_requests(c, p, "about string, value string"), _docs(c))),
    "kernel.apply": _apply,
    "kernel.germinate": _germinate,
    "project.resolve": lambda c, p: audits.resolve_kernel(p.get("segment", ""), p["sealed"], p["graphs"]),
}


def dispatch(ctx: Context, verb: str, payload: dict) -> DataFrame:
    verb = CANONICAL_VERBS.get(verb, verb)
    if verb in ctx.plans:  # reads that a caller registered as functions
        plan, declared = ctx.plans[verb]
        governed.bind({}, declared, {k: str(v) for k, v in payload.items()})
        return plan(ctx, **payload)
    try:
        if verb in VERBS:
            return VERBS[verb](ctx, payload)
        if ctx.governed is not None and not ctx.governed.where((F.col("verb") == verb) & F.col("kernel").isin(ctx.project, governance.FLOOR)).isEmpty():
            return _governed(ctx, verb, payload)
    except KeyError as e:
        raise Refused(f"missing parameter {e.args[0]!r}") from e
    raise Refused(f"unknown verb {verb!r}")


def dispatch_safe(spark, ctx: Context, verb: str, payload: dict) -> DataFrame:
    """The answer, or one row (ok, refused) if the request is refused."""
    try:
        return dispatch(ctx, verb, payload)
    except Refused as e:
        return spark.createDataFrame([(False, str(e))], "ok boolean, refused string")

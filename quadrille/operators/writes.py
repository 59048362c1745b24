"""What the write verbs make of requests: candidates to seal and refusals, whole tables of them at a time.

Each function takes rows with ``rid``, a number that tells requests apart, and gives (candidates: rid, id, body) and
(refused: rid, reason); the seal judges the candidates. Documents are (id, type, body), bodies JSON text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import bodies as B
from quadrille.functions import terms as T
from quadrille.operators import governance as G
from quadrille.session import bounded

#: Keys of a request that are never fields, and core keys that keep their namespace.
CONTROL, CORE_KEYS, FIXED = ["type", "sub", "@id", "participant"], ["lifecycle_state"], ["id", "type", "@id"]
PROPOSAL, VOTE = T.CORE + "Proposal", T.CORE + "Vote"
STATE = T.BOARD + "lifecycle_state"

Outcome = tuple[DataFrame, DataFrame]


def _first(*cases: tuple[Column, str | Column]) -> Column:
    """The reason of the first case that holds, else null."""
    as_column = lambda r: r if isinstance(r, Column) else F.lit(r)
    return reduce(lambda rest, c: F.when(F.coalesce(c[0], F.lit(False)), as_column(c[1])).otherwise(rest), reversed(cases), F.lit(None).cast("string"))


def _split(rows: DataFrame) -> Outcome:
    """Rows (rid, id, body, reason) as candidates and refusals."""
    return rows.where("reason IS NULL").select("rid", "id", "body"), rows.where("reason IS NOT NULL").select("rid", "reason")


def _keys(propmap: DataFrame) -> DataFrame:
    """(type, keys): declared local names and their properties as one map for each type."""
    return propmap.groupBy("type").agg(F.map_from_entries(F.collect_list(F.struct("key", "path"))).alias("keys"))


def _keyed(fields: Column, keys: Column, space: Column, skip: list[str]) -> Column:
    """Fields by property: full names stay, declared names get theirs, core keys the board's, others the type's namespace."""
    own = F.coalesce(keys, F.create_map().cast("map<string,string>"))
    name = lambda k: F.when(F.contains(k, F.lit(":")), k).when(F.map_contains_key(own, k), F.try_element_at(own, k)).when(k.isin(CORE_KEYS), F.concat(F.lit(T.BOARD), k)).otherwise(F.concat(space, k))
    entries = F.filter(F.map_entries(fields), lambda x: ~x["key"].isin(skip))
    return B.from_entries(F.transform(entries, lambda x: F.struct(name(x["key"]).alias("key"), x["value"].alias("value"))))


def create(requests: DataFrame, propmap: DataFrame, now: str) -> Outcome:
    """Documents of requests (rid, type, fields: JSON object); ids are the type's local name and the request's number."""
    local = F.regexp_replace("type", "^.*[/#]", "")
    rows = requests.join(bounded(_keys(propmap)), "type", "left").withColumns({"f": B.fields("fields"), "id": F.concat(F.lower(local), F.lit("-"), F.col("rid").cast("string"))})
    reason = _first((F.coalesce(F.trim("type"), F.lit("")) == "", "type required"), (~F.contains("type", F.lit(":")), "the type must be an IRI"), (F.col("f").isNull(), "fields must be an object"))
    head = B.of_pairs({"type": F.col("type"), "@id": F.concat(F.lit("doc://"), local, F.lit("#"), "id"), T.BOARD + "created_at": F.lit(now)})
    body = B.canonical(B.overlaid(_keyed(F.col("f"), F.col("keys"), F.regexp_replace("type", "[^/#]*$", ""), CONTROL), head))
    return _split(rows.select("rid", "id", body.alias("body"), reason.alias("reason")))


def update(requests: DataFrame, docs: DataFrame, propmap: DataFrame) -> Outcome:
    """Documents with the fields of requests (rid, id, patch: JSON object) laid over theirs, types kept. A type with declared properties takes no others by short name."""
    rows = requests.withColumn("f", B.fields("patch")).join(docs.select("id", "type", "body"), "id", "left").join(bounded(_keys(propmap)), "type", "left")
    names = F.filter(F.map_keys("f"), lambda k: ~k.isin(FIXED) & ~F.contains(k, F.lit(":")) & ~F.map_contains_key("keys", k))
    reason = _first(
        (F.coalesce(F.trim("id"), F.lit("")) == "", "id required"), (F.col("f").isNull(), "the patch must be an object"), (F.col("body").isNull(), "unknown instance"),
        (F.col("keys").isNotNull() & (F.size(names) > 0), F.concat(F.lit("undeclared patch key "), F.array_join(F.array_sort(names), ", "))),
    )
    space = F.when(F.col("type").rlike("[/#]"), F.regexp_replace("type", "[^/#]*$", "")).otherwise(F.lit(""))
    body = B.canonical(B.overlaid(B.without(B.fields("body"), "participant"), _keyed(F.col("f"), F.col("keys"), space, FIXED)))
    return _split(rows.select("rid", "id", body.alias("body"), reason.alias("reason")))


def transition(requests: DataFrame, docs: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents moved to the states of requests (rid, id, to_state), if ``allowed`` (type, from_state, to_state; a null type: any without pairs of its own) has the step; and (rid, from_state, to_state, source)."""
    f = B.fields("body")
    rows = requests.join(docs.select("id", "type", "body"), "id", "left")
    rows = rows.withColumn("from_state", F.coalesce(B.text(f, STATE), B.text(f, "state"), B.text(f, T.CORE + "lifecycle_state")))
    steps = G.transitions(rows, allowed)
    reason = _first((~F.coalesce(F.col("to_state").rlike(T.STATE_NAME), F.lit(False)), "invalid state"), (F.col("body").isNull(), "unknown instance"), (~F.col("legal"), F.concat(F.lit("no step from "), "from_state", F.lit(" to "), "to_state")))
    body = B.canonical(B.overlaid(f, B.of_pairs({STATE: F.col("to_state"), "state": F.col("to_state")})))
    out = steps.select("rid", "id", body.alias("body"), reason.alias("reason"), "from_state", "to_state", "source")
    return *_split(out), out.where("reason IS NULL").select("rid", "from_state", "to_state", "source")


def retire(requests: DataFrame, docs: DataFrame, epoch: int) -> Outcome:
    """Documents marked as retired, with the reason of requests (rid, id, reason); a proposal is rejected by it."""
    f, why = B.fields("body"), F.trim("reason")
    rows = requests.join(docs.select("id", "type", "body"), "id", "left")
    no = _first((F.coalesce(F.length(why), F.lit(0)) < 1, "reason required"), (F.col("body").isNull(), "unknown instance"), (F.map_contains_key(f, T.CORE + "retiredAtEpoch"), "already retired"))
    state = F.when(F.col("type") == PROPOSAL, F.lit("rejected"))
    body = B.canonical(B.overlaid(f, B.of_pairs({T.CORE + "retiredAtEpoch": F.lit(epoch), T.CORE + "reason": why, T.CORE + "proposalState": state})))
    return _split(rows.select("rid", "id", body.alias("body"), no.alias("reason")))


def link(requests: DataFrame, declared: DataFrame, now: str) -> Outcome:
    """Edges of requests (rid, source, predicate, target, type) as documents; with any ``declared`` (predicate), only those may link."""
    known = declared.select("predicate").distinct().withColumn("known", F.lit(True))
    some = not declared.isEmpty()
    rows = requests.join(bounded(known), "predicate", "left")
    ends = F.col("source").isNull() | F.col("predicate").isNull() | F.col("target").isNull()
    reason = _first(
        (ends, "source, predicate and target required"), (F.coalesce(F.trim("type"), F.lit("")) == "", "edge type required"), (~F.contains("type", F.lit(":")), "the type must be an IRI"),
        (F.col("source") == F.col("target"), "no self loops"), (F.lit(some) & F.col("known").isNull(), F.concat(F.lit("undeclared predicate "), "predicate")),
    )
    path = F.concat("source", F.lit("."), "predicate", F.lit("."), "target")
    topic = F.concat(F.lit("link."), "predicate", F.lit("."), "source", F.lit("."), "target")
    space = F.regexp_replace("type", "[^/#]*$", "")
    told = {"source": F.col("source"), "predicate": F.col("predicate"), "target": F.col("target"), "topic": topic, "created_at": F.lit(now)}
    # a null key is no field; such rows are refused anyway
    pairs = F.array(*[F.struct(F.concat(F.coalesce(space, F.lit("")), F.lit(k)).alias("key"), v.cast("variant").alias("value")) for k, v in told.items()])
    head = B.of_pairs({"type": F.col("type"), "@id": F.concat(F.lit("doc://Edge#edge:"), path)})
    body = B.canonical(B.overlaid(F.map_from_entries(pairs), head))
    return _split(rows.select("rid", F.concat(F.lit("edge:"), path).alias("id"), body.alias("body"), reason.alias("reason")))


def notify(requests: DataFrame, now: str) -> Outcome:
    """Messages of requests (rid, sender, predicate, target, text, type) as documents with their topic."""
    reason = _first((F.col("target").isNull() | F.col("predicate").isNull(), "target and predicate required"), (F.coalesce(F.trim("type"), F.lit("")) == "", "message type required"), (~F.contains("type", F.lit(":")), "the type must be an IRI"))
    space = F.coalesce(F.regexp_replace("type", "[^/#]*$", ""), F.lit(""))
    told = {"from": F.col("sender"), "predicate": F.col("predicate"), "to": F.col("target"), "body": F.col("text"), "topic": F.concat(F.lit("notify."), "predicate", F.lit("."), "target"), "created_at": F.lit(now)}
    pairs = F.array(*[F.struct(F.concat(space, F.lit(k)).alias("key"), v.cast("variant").alias("value")) for k, v in told.items()])
    id_ = F.concat(F.lit("message-"), F.col("rid").cast("string"))
    body = B.canonical(B.overlaid(F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())), B.of_pairs({"type": F.col("type"), "@id": F.concat(F.lit("doc://Message#"), id_)})))
    return _split(requests.select("rid", id_.alias("id"), body.alias("body"), reason.alias("reason")))


def propose(requests: DataFrame, kernel: str) -> Outcome:
    """Pending proposals of requests (rid, op, about, detail: JSON object, requires_quorum: text). An operation that its detail gives nothing to project is refused."""
    d = B.fields("detail")
    lacks = lambda *names: reduce(lambda a, b: a | b, [~F.coalesce(F.map_contains_key(d, n), F.lit(False)) for n in names])
    about = F.coalesce("about", F.lit(kernel))
    quorum = F.coalesce("requires_quorum", F.lit("1")).try_cast("int")
    op = F.col("op")
    off = F.coalesce(B.text(d, "active"), F.lit("true")) == "false"
    nothing = (op == "add_affordance") & (lacks("verb") | lacks("query") & lacks("formula", "scope")) | (op == "add_proof_obligation") & (lacks("obligation") | ~off & lacks("targetType", "check"))
    reason = _first((~F.coalesce(op.isin(G.OPERATIONS), F.lit(False)), "no such operation"), (nothing, "the detail projects nothing"), (~about.rlike(T.SAFE_IRI), "invalid about"), (quorum.isNull() | (quorum < 1), "invalid quorum"))
    id_ = F.concat(F.lit("proposal-"), F.col("rid").cast("string"))
    told = {"type": F.lit(PROPOSAL), "@id": F.concat(F.lit("doc://Proposal#"), id_), T.CORE + "about": about, T.CORE + "proposalState": F.lit("pending"), T.CORE + "proposalOp": op, T.CORE + "requiresQuorum": quorum.cast("string"), "proposalDetail": F.parse_json(F.coalesce("detail", F.lit("{}")))}
    return _split(requests.select("rid", id_.alias("id"), B.canonical(B.of_pairs(told)).alias("body"), reason.alias("reason")))


def proposals(docs: DataFrame) -> DataFrame:
    """(proposal: its IRI, id, state, op, requires_quorum, detail, body) of the proposals among documents."""
    f = B.fields("body")
    return docs.where(F.col("type") == PROPOSAL).select(
        B.text(f, "@id").alias("proposal"), "id", B.text(f, T.CORE + "proposalState").alias("state"), B.text(f, T.CORE + "proposalOp").alias("op"),
        F.coalesce(B.text(f, T.CORE + "requiresQuorum").try_cast("int"), F.lit(1)).alias("requires_quorum"), F.coalesce(B.text(f, "proposalDetail"), F.lit("{}")).alias("detail"), "body",
    )


def votes(docs: DataFrame) -> DataFrame:
    """(proposal, value, created_by) of the votes among documents; what an anonymous participant said has no party."""
    f = B.fields("body")
    by = B.text(f, T.CORE + "createdBy")
    return docs.where(F.col("type") == VOTE).select(B.text(f, T.CORE + "about").alias("proposal"), B.text(f, T.CORE + "voteValue").alias("value"), F.when(~F.startswith(by, F.lit(T.PARTICIPANT + "anon")), by).alias("created_by"))


def vote(requests: DataFrame, docs: DataFrame) -> Outcome:
    """Votes of requests (rid, about: a proposal's IRI, value) on pending proposals."""
    rows = requests.join(proposals(docs).select(F.col("proposal").alias("about"), "state").distinct(), "about", "left")
    reason = _first((~F.coalesce(F.col("value").isin("approve", "reject"), F.lit(False)), "invalid vote"), (~F.coalesce(F.col("about").rlike(T.SAFE_IRI), F.lit(False)), "invalid about"), (F.col("state").isNull(), "unknown proposal"), (F.col("state") != "pending", "the proposal is not pending"))
    id_ = F.concat(F.lit("vote-"), F.col("rid").cast("string"))
    told = {"type": F.lit(VOTE), "@id": F.concat(F.lit("doc://Vote#"), id_), T.CORE + "about": F.col("about"), T.CORE + "voteValue": F.col("value")}
    return _split(rows.select("rid", id_.alias("id"), B.canonical(B.of_pairs(told)).alias("body"), reason.alias("reason")))


def applied(requests: DataFrame, docs: DataFrame, epoch: int) -> Outcome:
    """Proposals of requests (rid, about) that reach their quorum of distinct named approvers, as applied at ``epoch``."""
    tally = G.quorum(votes(docs), proposals(docs).select("proposal", "requires_quorum"))
    rows = requests.join(proposals(docs).withColumnRenamed("proposal", "about"), "about", "left").join(tally.withColumnRenamed("proposal", "about"), "about", "left")
    reason = _first((F.col("id").isNull(), "unknown proposal"), (F.col("state") != "pending", "the proposal is not pending"), (~F.col("applied"), F.concat(F.lit("quorum not met: "), F.col("approvers").cast("string"), F.lit(" of "), F.col("requires_quorum").cast("string"))))
    body = B.canonical(B.overlaid(B.fields("body"), B.of_pairs({T.CORE + "proposalState": F.lit("applied"), T.CORE + "appliedEpoch": F.lit(str(epoch))})))
    return _split(rows.select("rid", "id", body.alias("body"), reason.alias("reason")))


def organs(project: str, label: str, g: str) -> list[tuple]:
    """Quads of a new kernel: the kernel, its project and its three organs, as rows."""
    base, c = f"urn:x:{project}", T.CORE
    row = lambda s, p, o, kind=T.IRI, dt=None: (g, s, p, o, T.IRI, kind, dt, None, False)
    out = [row(f"{base}/kernel", T.RDF_TYPE, c + "Kernel"), row(f"{base}/kernel", T.LABEL, label, T.LITERAL), row(f"{base}/kernel", c + "epoch", "0", T.LITERAL, T.XSD + "integer"), row(f"{base}/kernel", c + "inProject", f"urn:x:project:{project}")]
    for k, (kind, authority) in enumerate((("ck", "governed-only"), ("tool", "readonly-on-ontology"), ("data", "readwrite"))):
        organ = f"{base}/organ/{kind}"
        out += [row(f"{base}/kernel", c + "hasOrgan", organ), row(organ, T.RDF_TYPE, c + "Organ"), row(organ, T.RDF_TYPE, c + kind.upper()), row(organ, c + "organKind", kind, T.LITERAL), row(organ, c + "writeAuthority", authority, T.LITERAL)]
        out += [row(organ, c + "dependsOn", f"{base}/organ/{below}") for below in ("ck", "tool", "data")[:k]]
    return out

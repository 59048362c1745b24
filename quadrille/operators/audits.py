"""Integrity audits as anti-joins and counts; findings are rows (check_name, subject, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions import bodies as B
from quadrille.functions import terms as T
from quadrille.operators import ledger as L
from quadrille.operators import quads as Q
from quadrille.operators import shapes as S

C, W = T.CORE, T.WAVE


def findings(check: str, rows: DataFrame, subject: Column, detail: Column | str) -> DataFrame:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return rows.select(F.lit(check).alias("check_name"), subject.cast("string").alias("subject"), text.cast("string").alias("detail"))


def dangling(rows: DataFrame, ref: str, targets: DataFrame, target: str, check: str, subject: str) -> DataFrame:
    """Rows whose reference names nothing."""
    missing = rows.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias(ref)).distinct(), ref, "left_anti")
    return findings(check, missing, F.col(subject), F.col(ref))


def adopted(adoptions: DataFrame, supersessions: DataFrame, project: str) -> DataFrame:
    """Adoptions (id, adopts, into_project, ts) into a project, under any spelling of its name, that nothing supersedes, in seal order."""
    names = [project, f"urn:x:{project}", f"urn:x:project/{project}", f"urn:x:instance:{project}"]
    live = adoptions.join(supersessions.select(F.col("supersedes").alias("id")).distinct(), "id", "left_anti")
    return live.where(F.col("into_project").isin(names)).orderBy("ts", "id").select("id", "adopts", "ts")


def fleet(adoptions: DataFrame, supersessions: DataFrame, graphs: DataFrame, pins: DataFrame) -> DataFrame:
    """All live adoptions with their graph's size, whether its name is no IRI, and its pin."""
    live = adoptions.join(supersessions.select(F.col("supersedes").alias("id")).distinct(), "id", "left_anti")
    sizes = graphs.groupBy(F.col("g").alias("adopts")).agg(F.count(F.lit(1)).alias("quads"))
    both = live.join(sizes, "adopts", "left").join(pins.select(F.col("g").alias("adopts"), F.col("digest").alias("pin")), "adopts", "left")
    return both.select("id", "adopts", "into_project", F.coalesce("quads", F.lit(0)).alias("quads"), (~F.col("adopts").rlike("^[a-z][a-z0-9+.-]*:[^ ]")).alias("malformed"), "pin")


def authority(memberships: DataFrame, roles: DataFrame, grants: DataFrame) -> DataFrame:
    """(participant, role, permission): what each participant may do, through memberships (participant, role), roles (role, granted: array, via) and grants (grant_id, permission); one row per grant, from its first role."""
    held = roles.select("role", F.explode_outer(F.array_union(F.coalesce("granted", F.array().cast("array<string>")), F.when(F.col("via").isNull(), F.array().cast("array<string>")).otherwise(F.array("via")))).alias("grant_id")).where("grant_id IS NOT NULL")
    chain = memberships.join(held, "role").join(grants, "grant_id")
    nth = F.row_number().over(Window.partitionBy("participant", "grant_id").orderBy("role"))
    return chain.withColumn("nth", nth).where("nth = 1").select("participant", "role", "grant_id", "permission")


def census(docs: DataFrame, state: str, conditions: dict[str, Column]) -> DataFrame:
    """One row of conditional counts over documents."""
    return docs.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(state).alias("states"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def declared_not_sealed(routable: DataFrame, sealed: DataFrame) -> DataFrame:
    """Verbs that can be routed and that no sealed affordance declares."""
    return routable.select("verb").subtract(sealed.select("verb"))


def resolve_kernel(segment: str, sealed: DataFrame, graphs: DataFrame) -> DataFrame:
    """(clause, project): how a name resolves: unset, sealed as it is, sealed in another case (one only), a graph of its own (one only), open canonical name, or refused."""
    spark = sealed.sparkSession
    if not segment:
        return spark.createDataFrame([("unset", None)], "clause string, project string")
    same = sealed.where(F.lower("name") == segment.lower()).agg(F.count_if(F.col("name") == segment).alias("exact"), F.count_distinct("name").alias("names"), F.min("name").alias("name"))
    made = graphs.where(F.lower("name") == segment.lower()).agg(F.count_distinct("name").alias("graphs"), F.min("name").alias("graph"))
    both = same.select("*", F.lit(1).alias("k")).join(made.select("*", F.lit(1).alias("k")), "k")  # one row each
    canonical = F.lit(segment).rlike("^[A-Za-z][A-Za-z0-9.-]*$")
    clause = F.when(F.col("exact") > 0, "sealed").when(F.col("names") == 1, "sealed-case").when(F.col("names") > 1, "ambiguous").when(F.col("graphs") == 1, "graph").when(F.col("graphs") > 1, "ambiguous").when(canonical, "open").otherwise("refused")
    name = F.when(F.col("exact") > 0, F.lit(segment)).when(F.col("names") == 1, F.col("name")).when(F.col("names") > 1, F.lit(None)).when(F.col("graphs") == 1, F.col("graph")).when(F.col("graphs") > 1, F.lit(None)).when(canonical, F.lit(segment))
    return both.select(clause.alias("clause"), name.alias("project"))


def claim_state(tokens: DataFrame, now: int, issuer: str, audience: str, leeway: int = 30) -> DataFrame:
    """Claims of tokens (token) and the first thing wrong with each: unsigned parts only; signatures are the identity provider's business."""

    def part(i: int) -> Column:
        text = F.translate(F.split_part("token", F.lit("."), F.lit(i)), "-_", "+/")
        return F.try_to_binary(F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string")

    claims = F.from_json(part(2), "iss string, sub string, exp bigint, nbf bigint")
    aud = F.get_json_object(part(2), "$.aud")
    has = F.coalesce((aud == audience) | F.array_contains(F.from_json(aud, "array<string>"), audience), F.lit(False))
    head = F.from_json(part(1), "alg string, kid string")
    rows = tokens.withColumn("h", head).withColumn("c", claims).withColumn("aud_ok", has)
    state = F.when(F.size(F.split("token", r"\.")) != 3, "malformed").when(F.col("h.alg").isNull() | F.col("c").isNull(), "malformed").when(F.col("h.alg") != "EdDSA", "algorithm").when(F.col("h.kid").isNull(), "key").when(~F.coalesce(F.col("c.iss") == issuer, F.lit(False)), "issuer").when(~F.col("aud_ok"), "audience").when(F.col("c.exp").isNull(), "expiry").when(F.col("c.exp") + leeway < now, "expired").when(F.coalesce(F.col("c.nbf"), F.lit(0)) - leeway > now, "early").otherwise("ok")
    return rows.select("token", F.col("c.sub").alias("sub"), state.alias("state"))


def permissions(admissions: DataFrame) -> DataFrame:
    """(sub, direction, subject): what an admitted identity (sub, kernels: array) may publish and hear."""
    rows = admissions.select("sub", F.explode("kernels").alias("k"))
    out = F.array(
        F.struct(F.lit("publish").alias("direction"), F.concat(F.lit("input.kernel."), "k", F.lit(".id."), "sub", F.lit(".action.>")).alias("subject")),
        F.struct(F.lit("subscribe").alias("direction"), F.concat(F.lit("result.kernel."), "k", F.lit(".>")).alias("subject")),
        F.struct(F.lit("subscribe").alias("direction"), F.concat(F.lit("event.kernel."), "k", F.lit(".>")).alias("subject")),
    )
    return rows.select("sub", F.explode(out).alias("x")).select("sub", "x.direction", "x.subject")


# --- audits over sealed documents (id, type, body, ts) ------------------------------------------------------


def field(key: str) -> Column:
    """A field of the body as text."""
    return B.text(B.fields("body"), key)


def of(docs: DataFrame, *types: str, **columns: Column) -> DataFrame:
    """(id, iri, ts, ...): documents of some core types with fields of theirs."""
    return docs.where(F.col("type").isin([C + t for t in types])).select("id", field("@id").alias("iri"), "ts", *[c.alias(n) for n, c in columns.items()])


def superseded(docs: DataFrame) -> DataFrame:
    """(iri): what sealed supersessions name."""
    return of(docs, "Supersession", names=field(C + "supersedes")).where("names IS NOT NULL").select(F.col("names").alias("iri")).distinct()


def adoption_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adoptions (id, adopts, into_project, ts, source_digest) and supersessions (supersedes: an adoption's id)."""
    made = of(docs, "Adoption", adopts=field(C + "adopts"), into_project=field(C + "intoProject"), source_digest=field(C + "sourceDigest"))
    gone = made.join(superseded(docs), "iri", "left_semi").select(F.col("id").alias("supersedes"))
    return made.where("adopts IS NOT NULL").drop("iri"), gone


def integrity(docs: DataFrame, surface: DataFrame) -> DataFrame:
    """All findings (check_name, subject, detail) on sealed documents: unattributed ones, gates that judged nothing, references that name nothing, grants off the organs."""
    f = B.fields("body")
    has = lambda key: F.coalesce(F.map_contains_key(f, C + key), F.lit(False))
    out = [
        findings("unattributed", docs.where(~has("createdBy")), F.col("id"), "no one created it"),
        findings("vacuous", docs.where(~has("conformsToShape") & (field(C + "sealedAtEpoch").try_cast("int") > 0)), F.col("id"), "sealed under a gate that targeted nothing"),
    ]
    live = of(docs, "Affordance", derived_by=field(C + "derivedBy"), in_shape=field(C + "inShape")).join(superseded(docs), "iri", "left_anti")
    known = lambda *types: of(docs, *types).where("iri IS NOT NULL").select("iri").distinct()
    shaped = S.property_shapes(surface).select(F.col("shape").alias("iri")).distinct()
    out.append(dangling(live, "derived_by", known("Materialization"), "iri", "dangling derivedBy", "id"))
    out.append(dangling(live, "in_shape", shaped, "iri", "unresolvable inShape", "id"))
    out.append(dangling(of(docs, "Adoption", adopts=field(C + "adopts")), "adopts", known("Module"), "iri", "adoption without a module", "id"))
    out.append(dangling(of(docs, "Grant", target=field(C + "permTarget")), "target", known("Organ", "CK", "TOOL", "DATA"), "iri", "grant off the organs", "id"))
    return Q.union(*out)


def adoption_check(project: str, docs: DataFrame, quads: DataFrame, pins: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Each module that a project adopts: its digests now and pinned (pins: g, digest, structural), whether they drifted, and whether the bytes that were loaded (sources: g, source_sha256) are those that the adoption claims."""
    made, gone = adoption_rows(docs)
    live = adopted(made, gone, project).join(made.select("id", "source_digest"), "id")
    modules = live.groupBy(F.col("adopts").alias("g")).agg(F.max_by("source_digest", F.struct("ts", "id")).alias("claimed"))
    mine = quads.join(modules.select("g"), "g", "left_semi")
    now = Q.copy_digest(mine).withColumnRenamed("digest", "digest_now").join(Q.structural_digest(mine).withColumnRenamed("digest", "structural_now"), "g", "left")
    loaded = sources if sources is not None else docs.sparkSession.createDataFrame([], "g string, source_sha256 string")
    rows = modules.join(now, "g", "left").join(pins.select("g", F.col("digest").alias("pinned"), F.col("structural").alias("structural_pinned")), "g", "left").join(loaded, "g", "left")
    off = lambda pin, is_: F.coalesce(F.col(pin).isNotNull() & ~F.col(pin).eqNullSafe(F.col(is_)), F.lit(False))
    return rows.select("g", "digest_now", "pinned", off("pinned", "digest_now").alias("drifted"), "structural_now", "structural_pinned", off("structural_pinned", "structural_now").alias("structure_drifted"), "claimed", F.col("source_sha256").alias("loaded"), (F.col("claimed") == F.col("source_sha256")).alias("source_match"))


def surface_check(project: str | None, epoch: int, docs: DataFrame, surface: DataFrame, quads: DataFrame, adopted_graphs: list[str] | None = None) -> DataFrame:
    """One row (state, epoch, pinned, actual, nodeshapes, kernel_quads, findings, healthy) on what a project's gate stands on.

    ``state`` tells how far the project is (core-only, named, germinated) and is no fault; a missing pin is one only
    where an epoch is in force.
    """
    spark, kernel = surface.sparkSession, f"urn:x:{project}/kernel/ck"
    whole = surface.withColumn("g", F.lit("surface"))
    one = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"))
    facts = Q.copy_digest(whole).select(F.col("digest").alias("actual"), F.lit(1).alias("k"))
    shapes = one(surface.where((F.col("p") == T.RDF_TYPE) & (F.col("o") == T.SHACL + "NodeShape"))).select(F.col("n").alias("nodeshapes"), F.lit(1).alias("k"))
    own = one(quads.where(F.col("g") == kernel)).select(F.col("n").alias("kernel_quads"), F.lit(1).alias("k"))
    sealed = one(of(docs, "Kernel").where(F.col("iri") == f"urn:x:{project}/kernel")).select((F.col("n") > 0).alias("germinated"), F.lit(1).alias("k"))
    pins = of(docs, "Epoch", by=field(C + "producedBy"), at=field(C + "epoch").try_cast("int"), digest=field(C + "surfaceDigest")).where((F.col("by") == kernel) & (F.col("at") == epoch))
    pin = pins.agg(F.max_by("digest", F.struct("ts", "id")).alias("pinned")).withColumn("k", F.lit(1))
    graphs = spark.createDataFrame([(g,) for g in adopted_graphs or []], "g string")
    absent = graphs.join(quads.select("g").distinct(), "g", "left_anti").agg(F.sort_array(F.collect_list(F.concat(F.lit("adopted module is absent or empty: "), "g"))).alias("absent")).withColumn("k", F.lit(1))
    rows = shapes.join(facts, "k", "left").join(own, "k").join(sealed, "k").join(pin, "k").join(absent, "k")  # one row each
    state = F.lit("core-only") if project is None else F.when(F.col("germinated"), "germinated").otherwise("named")
    found = F.array_compact(
        F.array(
            F.when(F.col("germinated") & (F.col("kernel_quads") == 0), "the kernel graph is empty though a kernel is sealed"),
            F.when(F.col("nodeshapes") == 0, "the surface has no shapes: every gate is vacuous"),
            F.when(F.col("germinated") & F.lit(epoch > 0) & F.col("pinned").isNull(), "no epoch seals the digest of the surface in force"),
            F.when(F.col("pinned") != F.col("actual"), "surface drift: the digest differs from the one its epoch sealed"),
        )
    )
    every = F.concat(found, "absent") if project is not None else F.array().cast("array<string>")
    return rows.select(F.lit(project).cast("string").alias("kernel"), state.alias("state"), F.lit(epoch).alias("epoch"), "pinned", "actual", "nodeshapes", "kernel_quads", every.alias("findings"), (F.size(every) == 0).alias("healthy"))


def authority_of(docs: DataFrame, participant: str | None) -> DataFrame:
    """What a participant may do, of sealed memberships, roles and grants, in both spellings of an identity; an anonymous one has a row that says so."""
    spark = docs.sparkSession
    if participant is None:
        return spark.createDataFrame([("anonymous", None, None, None)], "participant string, role string, grant_id string, permission string")
    bare = participant.removeprefix(T.PARTICIPANT)
    member = of(docs, "Membership", participant=field(C + "member"), role=field(C + "inRole")).where(F.col("participant").isin(bare, T.PARTICIPANT + bare)).select(F.lit(participant).alias("participant"), "role").distinct()
    granted = F.try_variant_get(F.try_element_at(B.fields("body"), F.lit(C + "grant")), "$", "array<string>")
    single = F.when(granted.isNull() & field(C + "grant").isNotNull(), F.array(field(C + "grant")))
    roles = of(docs, "Role", granted=F.coalesce(granted, single), via=field(C + "grantedVia")).select(F.col("iri").alias("role"), "granted", "via")
    grants = of(docs, "Grant", permission=field(C + "permission")).select(F.col("iri").alias("grant_id"), "permission")
    return authority(member, roles, grants)


PASS_STAMPS = ["discoveredAtPass", "resolvedAtPass", "ruledAtPass", "opAtPass", "rebasedAtPass"]
#: What the signals cannot see; they say so themselves.
BLIND_SPOTS = ["facts without a stamp of their pass", "operations addressed by another spelling of the component", "passes and epochs of other projects", "whether an operation was answered"]


def signals(docs: DataFrame, project: str, pass_: int | None = None, component: str | None = None, obligations: DataFrame | None = None) -> DataFrame:
    """(section, id, detail, n): facts of a pass, open findings, pending proposals, the inbox, counts of health, active obligations and declared blind spots."""
    f = B.fields("body")
    row = lambda section, rows, detail: rows.select(F.lit(section).alias("section"), "id", detail.cast("string").alias("detail"), F.lit(None).cast("bigint").alias("n"))
    kind = lambda c: F.col("type") == c
    opened = kind(W + "Finding") & (field(W + "findingState") == "open")
    retired = F.coalesce(F.map_contains_key(f, C + "retiredAtEpoch"), F.lit(False))
    pending = kind(C + "Proposal") & (field(C + "proposalState") == "pending") & ~retired
    named = [component or f"{W}c-{project.replace('-', '')}", f"urn:x:{project}/kernel", f"urn:x:{project}/kernel/ck"]
    inbox = kind(W + "Operation") & field(W + "opTarget").isin(named)
    judged = F.coalesce(F.map_contains_key(f, C + "conformsToShape"), F.lit(False))
    at = field(C + "sealedAtEpoch").try_cast("int")
    out = [row("openFindings", docs.where(opened), F.left(F.coalesce(field(T.LABEL), field(W + "label")), F.lit(140))), row("pendingProposals", docs.where(pending), field(C + "proposalOp")), row("inbox", docs.where(inbox), field(W + "opKind"))]
    if pass_ is not None:
        of_pass = field(W + "forPass") == f"{W}pass-{pass_}"
        for s in PASS_STAMPS:
            of_pass = F.coalesce(of_pass, F.lit(False)) | F.coalesce(field(W + s).try_cast("int") == pass_, F.lit(False))
        out.append(row("thisPass", docs.where(of_pass), F.regexp_replace("type", "^.*[/#]", "")))
    counts = {"unjudged": (at >= 1) & ~judged, "preEnforcement": ~F.map_contains_key(f, C + "sealedAtEpoch"), "anonymousSeals": F.startswith(field(C + "createdBy"), F.lit(T.PARTICIPANT + "anon")), "openFindings": opened, "pendingProposals": pending}
    whole = docs.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()])
    out.append(whole.select(F.explode(F.array(*[F.struct(F.lit(n).alias("detail"), F.col(n).alias("n")) for n in counts])).alias("c")).select(F.lit("signals").alias("section"), F.lit(None).cast("string").alias("id"), "c.detail", "c.n"))
    if obligations is not None:
        out.append(row("obligations", obligations.where("active").select(F.col("obligation").alias("id"), "check_name"), F.col("check_name")))
    blind = docs.sparkSession.createDataFrame([(b,) for b in BLIND_SPOTS], "detail string")
    out.append(blind.select(F.lit("blindSpots").alias("section"), F.lit(None).cast("string").alias("id"), "detail", F.lit(None).cast("bigint").alias("n")))
    return Q.union(*out)


def affordances(docs: DataFrame, surface: DataFrame, kernel: str, routable: list[str]) -> DataFrame:
    """(verb, sealed, id, path, datatype, min_count): sealed affordances of a kernel that are not retired, with the properties of their input shape, and the verbs that route without one."""
    retired = F.coalesce(F.map_contains_key(B.fields("body"), C + "retiredAtEpoch"), F.lit(False))
    mine = of(docs.where(~retired), "Affordance", verb=field(C + "verb"), by=field(C + "producedBy"), shape=field(C + "inShape")).where(F.col("by") == kernel)
    props = S.property_shapes(surface).select("shape", "path", "datatype", "min_count")
    sealed = mine.join(props, "shape", "left").select("verb", F.lit(True).alias("sealed"), "id", "path", "datatype", "min_count")
    verbs = docs.sparkSession.createDataFrame([(v,) for v in routable], "verb string")
    null = lambda t: F.lit(None).cast(t)
    rest = declared_not_sealed(verbs, mine).select("verb", F.lit(False).alias("sealed"), null("string").alias("id"), null("string").alias("path"), null("string").alias("datatype"), null("int").alias("min_count"))
    return sealed.unionByName(rest)


def board(docs: DataFrame, ledger: DataFrame, proofs: DataFrame, key: bytes) -> DataFrame:
    """Tasks with kernel, place in the queue, newest proof and whether they verify, in order of (kernel, queue_seq, id)."""
    tasks = docs.where(F.endswith("type", F.lit("Task"))).select("id", "body", field(T.BOARD + "target_kernel").alias("kernel"), field(T.BOARD + "queue_seq").try_cast("bigint").alias("queue_seq"))
    ids = tasks.select("id")
    mine = lambda rows, c: rows.join(ids.withColumnRenamed("id", c), c, "left_semi")
    checked = L.verify(tasks.select("id", "body"), mine(ledger, "instance_id"), mine(proofs, "about"), key)
    proof = L.latest_proof(mine(proofs, "about").where("method = 'sha256'")).select(F.col("about").alias("id"), "digest")
    return tasks.join(proof, "id", "left").join(checked, "id").select("kernel", "queue_seq", "id", "digest", "verified").orderBy("kernel", "queue_seq", "id")

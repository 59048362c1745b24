"""Scalar rules of the graph model as Column expressions: identifiers, names, subjects, verbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the RDF, RDFS, OWL and SHACL vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
LABEL, COMMENT, SUBCLASS, DOMAIN = RDFS + "label", RDFS + "comment", RDFS + "subClassOf", RDFS + "domain"
OWL = "http://www.w3.org/2002/07/owl#"
SHACL = "http://www.w3.org/ns/shacl#"
XSD = "http://www.w3.org/2001/XMLSchema#"

#: Namespaces of this engine's own model.
CORE, BOARD, WAVE = "urn:x:core#", "urn:x:board/", "urn:x:wave#"
#: What a seal stamps on a document; claims of them are stripped.
STAMPS = [CORE + "producedBy", CORE + "createdBy", CORE + "sealedAtEpoch", CORE + "conformsToShape"]
INSTANCE, PARTICIPANT = "urn:x:instance:", "urn:x:participant:"
# An absolute IRI that is safe to write, a state's name, a name of a verb or parameter.
SAFE_IRI, STATE_NAME, VERB_NAME = r"^[A-Za-z][A-Za-z0-9+.:#/_-]*$", r"^[A-Za-z][A-Za-z0-9_-]*$", r"^[a-z][a-z0-9_.]*$"

#: Kinds of a term.
IRI, BNODE, LITERAL = 1, 2, 3

# What counts as an IRI, a number and a bound parameter.
IRI_PATTERN = r"^[a-z][a-z0-9+.-]*:[^ ]"
NUMBER_PATTERN = r"^-?[0-9.]+$"
PARAMETER_PATTERN = r"^[A-Za-z0-9 ._:#/-]*$"

# Keys of a document that are never properties.
CONTROL_KEYS = ["type", "@id", "participant", "participant_display_name", "participant_email"]

# Legacy verbs and their canonical names.
CANONICAL_VERBS = {
    "task.create": "instance.create",
    "kernel.create": "instance.create",
    "task.update": "instance.update",
    "edge.create": "instance.link",
    "provenance": "instance.provenance",
    "wave.oracle": "wave.signals",
}


def is_iri(value: Column) -> Column:
    return value.rlike(IRI_PATTERN)


def slug(value: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, no dash at the ends, never empty."""
    dashed = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit("x"))


def urn_normalise(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(value)), "[^a-z0-9-]+", "-")


def local_name(iri: Column) -> Column:
    return F.regexp_replace(iri, "^.*[/#]", "")


def namespace(iri: Column) -> Column:
    return F.regexp_replace(iri, "[^/#]*$", "")


def without_datatype(value: Column) -> Column:
    """A literal's text without a ``^^<datatype>`` suffix."""
    return F.split_part(value, F.lit("^^"), F.lit(1))


def publish_subject(kernel: Column, type_iri: Column) -> Column:
    return F.concat(F.lit("event.kernel."), kernel, F.lit("."), F.regexp_replace(local_name(type_iri), "^.*:", ""), F.lit(".sealed"))


def subject_token(value: Column) -> Column:
    """A text as one token of a message subject."""
    return F.regexp_replace(value, "[^A-Za-z0-9_-]", "_")


def canonical_verb(verb: Column) -> Column:
    out = verb
    for old, new in CANONICAL_VERBS.items():
        out = F.when(verb == old, F.lit(new)).otherwise(out)
    return out


def subject_pattern(pattern: str) -> str:
    """A subject pattern as a regular expression: ``*`` is one token, a final ``>`` one or more."""
    tokens = pattern.split(".")
    out = []
    for i, t in enumerate(tokens):
        out.append("[^.]+" if t == "*" else ".+" if t == ">" and i == len(tokens) - 1 else "".join(c if c.isalnum() or c in "_-" else "\\" + c for c in t))
    return "^" + "\\.".join(out) + "$"


def subject_matches(subject: Column, pattern: str) -> Column:
    return subject.rlike(subject_pattern(pattern))


INBOUND = r"^input\.kernel\.([^.]+)(?:\.id\.([^.]+))?\.action\.(.+)$"


def route(subject: Column) -> list[Column]:
    """kernel, sender and verb of an inbound subject; null where it is none."""
    ok = subject.rlike(INBOUND)
    part = lambda i: F.when(ok, F.nullif(F.regexp_extract(subject, INBOUND, i), F.lit("")))
    return [part(1).alias("kernel"), part(2).alias("sender"), part(3).alias("verb")]

"""Turtle files as quads. One file is one graph; files are read in parallel, each by a small reader in its task.

The reader takes prefixes and bases, ``a``, lists by ``;`` and ``,``, blank nodes, collections, literals with
datatype or language, numbers, booleans and comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators.quads import SCHEMA

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TOKEN = re.compile(
    r'\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')'
    r'|(?P<text>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)'
    r"|(?P<number>[+-]?(?:[0-9]*\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<blank>_:[\w.-]*\w)|(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%:-]|\.(?=[\w%:-])|\\.)*|\w+)|(?P<mark>[\[\]().;,])",
    re.S,
)
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
Term = tuple[str, int, "str | None", "str | None"]


def _unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPES.get(m[3], m[3]), text, flags=re.S)


class Reader:
    """One pass over the tokens of a text; ``triples`` holds (subject, predicate, object) terms."""

    def __init__(self, text: str, base: str = "urn:x:base#", label: str = "b"):
        self.base, self.label, self.prefixes, self.triples, self.count, self.named = base, label, {}, [], 0, {}
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if m is None or m.end() == at:
                raise ValueError(f"Turtle: unexpected {text[at : at + 20]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if mark is not None and token[1] != mark:
            raise ValueError(f"Turtle: expected {mark!r}, found {token[1]!r}")
        self.at += 1
        return token

    def fresh(self) -> Term:
        self.count += 1
        return (f"{self.label}{self.count}", T.BNODE, None, None)

    def iri(self, token: tuple[str, str]) -> str:
        kind, text = token
        if kind == "iri":
            text = _unescape(text[1:-1])
            return text if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", text) else self.base + text
        prefix, colon, rest = text.partition(":")
        if not colon or prefix not in self.prefixes:
            raise ValueError(f"Turtle: unknown name {text!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)

    def read(self) -> list[tuple[Term, str, Term]]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            word = text.lower().lstrip("@")
            if word in ("prefix", "base") and kind in ("at", "name"):
                self.take()
                if word == "prefix":
                    name = self.take()[1]
                    self.prefixes[name.rstrip(":")] = self.iri(self.take())
                else:
                    self.base = self.iri(self.take())
                if kind == "at":
                    self.take(".")
                continue
            blank = text == "["
            subject = self.term()
            if not (blank and self.peek()[1] == "."):
                self.properties(subject)
            self.take(".")
        return self.triples

    def properties(self, subject: Term) -> None:
        while True:
            kind, text = self.take()
            predicate = T.RDF_TYPE if (kind, text) == ("name", "a") else self.iri((kind, text))
            while True:
                self.triples.append((subject, predicate, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            again = False
            while self.peek()[1] == ";":
                self.take()
                again = True
            if not again or self.peek()[1] in (".", "]"):
                return

    def term(self) -> Term:
        kind, text = self.take()
        if text == "[" and kind == "mark":
            node = self.fresh()
            if self.peek()[1] != "]":
                self.properties(node)
            self.take("]")
            return node
        if text == "(" and kind == "mark":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            rest: Term = (RDF + "nil", T.IRI, None, None)
            for item in reversed(items):
                node = self.fresh()
                self.triples += [(node, RDF + "first", item), (node, RDF + "rest", rest)]
                rest = node
            return rest
        if kind == "blank":
            if text not in self.named:
                self.named[text] = self.fresh()
            return self.named[text]
        if kind in ("text", "long"):
            cut = 3 if kind == "long" else 1
            value, dt, lang = _unescape(text[cut:-cut]), None, None
            if self.peek()[0] == "type":
                self.take()
                dt = self.iri(self.take())
            elif self.peek()[0] == "at":
                lang = self.take()[1][1:]
            return (value, T.LITERAL, None if dt == T.XSD + "string" else dt, lang)
        if kind == "number":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return (text, T.LITERAL, T.XSD + name, None)
        if kind == "name" and text in ("true", "false"):
            return (text, T.LITERAL, T.XSD + "boolean", None)
        return (self.iri((kind, text)), T.IRI, None, None)


def parse(text: str, g: str, base: str = "urn:x:base#") -> list[tuple]:
    """A Turtle text as quad rows."""
    return [(g, s[0], p, o[0], s[1], o[1], o[2], o[3], False) for s, p, o in Reader(text, base).read()]


def read_text(spark: SparkSession, text: str, g: str, base: str = "urn:x:base#") -> DataFrame:
    return spark.createDataFrame(list(dict.fromkeys(parse(text, g, base))), SCHEMA)


def read_files(spark: SparkSession, path: str, prefix: str = "urn:x:file:") -> DataFrame:
    """Quads of all ``*.ttl`` files below a folder; a file's graph is the prefix and its path below the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ttl").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.decode("content", "UTF-8").alias("text"))
    root = path.rstrip("/").split("://")[-1]
    names = ["g", "s", "p", "o", "s_kind", "o_kind", "o_dt", "o_lang", "inferred"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.bool_()]
        for batch in batches:
            for where, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                quads = parse(text, prefix + where.partition(root)[2].lstrip("/"))
                columns = list(zip(*quads, strict=True)) or [[]] * 9
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(read, SCHEMA).distinct()

"""Quads as a DataFrame: ``g, s, p, o, s_kind, o_kind, o_dt, o_lang, inferred``.

Graph names are a column to partition by; composing graphs is a union, copying one a rewrite of ``g``. A set of
quads has no duplicates, so whatever may repeat ends in ``distinct``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.session import bounded

COLUMNS = ["g", "s", "p", "o", "s_kind", "o_kind", "o_dt", "o_lang", "inferred"]
SCHEMA = "g string, s string, p string, o string, s_kind int, o_kind int, o_dt string, o_lang string, inferred boolean"


def quads_of(rows: DataFrame, s: Column, p: str | Column, o: Column, g: str | Column, o_kind: int | Column = T.IRI, o_dt: str | None = None, s_kind: int = T.IRI) -> DataFrame:
    """One quad per row whose subject and object are not null."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = rows.select(as_col(g).alias("g"), s.alias("s"), as_col(p).alias("p"), o.cast("string").alias("o"), F.lit(s_kind).alias("s_kind"), as_col(o_kind).cast("int").alias("o_kind"), F.lit(o_dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"), F.lit(False).alias("inferred"))
    return out.where(F.col("s").isNotNull() & F.col("o").isNotNull())


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def graph(quads: DataFrame, *names: str) -> DataFrame:
    return quads.where(F.col("g").isin(*names))


def copy_graph(quads: DataFrame, source: str, target: str) -> DataFrame:
    """``quads`` with the quads of one graph in another too."""
    return union(quads, graph(quads, source).withColumn("g", F.lit(target))).distinct()


def clear_graph(quads: DataFrame, name: str) -> DataFrame:
    return quads.where(F.col("g") != name)


def compose(quads: DataFrame, name: str, *parts: str) -> DataFrame:
    """The surface that several graphs make together, under one name."""
    return graph(quads, *parts).withColumn("g", F.lit(name)).distinct()


def body_to_quads(rows: DataFrame, g: str, declared: DataFrame | None = None) -> DataFrame:
    """Quads of documents (``id``, ``body``: JSON text) by their IRI keys.

    Numbers and booleans become typed literals, texts that look like IRIs become IRIs unless ``declared``
    (``path``, ``datatype``) gives their property a datatype, arrays one quad per element; objects, nulls, control
    keys and keys without a colon are no properties. The document's type is a quad too.
    """
    body = F.parse_json("body")
    typed = quads_of(rows, F.col("id"), T.RDF_TYPE, F.coalesce(F.get_json_object("body", "$.type"), F.lit("urn:x:Unknown")), g)
    pairs = rows.select("id", body.alias("v")).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer())).select("id", "key", "value")
    pairs = pairs.where(~F.col("key").isin(T.CONTROL_KEYS) & F.col("key").contains(":"))
    kind = F.schema_of_variant("value")
    items = pairs.select("id", "key", F.when(kind.startswith("ARRAY"), F.variant_get("value", "$", "array<variant>")).otherwise(F.array("value")).alias("items"))
    one = items.select("id", "key", F.explode("items").alias("value"))
    kind = F.schema_of_variant("value")
    one = one.withColumn("kind", kind).where(~F.col("kind").startswith("OBJECT") & ~F.col("kind").startswith("ARRAY") & (F.col("kind") != "VOID"))
    one = one.withColumn("o", F.variant_get("value", "$", "string"))
    if declared is not None:
        one = one.join(bounded(declared.select(F.col("path").alias("key"), F.col("datatype").alias("dt")).distinct()), "key", "left")
    else:
        one = one.withColumn("dt", F.lit(None).cast("string"))
    number = F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    datatype = F.when(F.col("kind") == "BOOLEAN", T.XSD + "boolean").when(number & F.col("kind").contains("INT"), T.XSD + "integer").when(number, T.XSD + "decimal").otherwise(F.nullif(F.col("dt"), F.lit(T.XSD + "string")))
    as_iri = (F.col("kind") == "STRING") & T.is_iri(F.col("o")) & F.col("dt").isNull()
    values = one.select(F.lit(g).alias("g"), F.col("id").alias("s"), F.col("key").alias("p"), "o", F.lit(T.IRI).alias("s_kind"), F.when(as_iri, T.IRI).otherwise(T.LITERAL).alias("o_kind"), F.when(~as_iri, datatype).alias("o_dt"), F.lit(None).cast("string").alias("o_lang"), F.lit(False).alias("inferred"))
    return union(typed, values).distinct()


def rendered(kind: Column, value: Column, datatype: Column | None = None, lang: Column | None = None) -> Column:
    """A term as text, as in Turtle: IRIs in angle brackets, blank nodes with ``_:``, literals quoted."""
    text = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    tail = F.lit("") if datatype is None else F.coalesce(F.concat(F.lit("^^<"), datatype, F.lit(">")), F.lit(""))
    if lang is not None:
        tail = F.coalesce(F.concat(F.lit("@"), lang), tail)
    return F.when(kind == T.IRI, F.concat(F.lit("<"), value, F.lit(">"))).when(kind == T.BNODE, F.concat(F.lit("_:"), value)).otherwise(F.concat(F.lit('"'), text, F.lit('"'), tail))


def turtle_lines(quads: DataFrame) -> DataFrame:
    """(g, line): one Turtle statement per quad, for a text sink."""
    return quads.select("g", F.concat_ws(" ", rendered(F.col("s_kind"), F.col("s")), F.concat(F.lit("<"), F.col("p"), F.lit(">")), rendered(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")), F.lit(".")).alias("line"))


#: Hex digits of a line's hash that tell its leaf, and of a leaf that tell its branch, in a digest tree.
LEAF, BRANCH = 5, 2


def tree_digest(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, digest): SHA-256 over the ``line`` values of each key, as a tree, so that no group holds a whole graph.

    A leaf is the sorted lines whose hashes begin alike; a branch is its sorted leaves, the root its branches, each as
    ``name digest`` lines. The order and the partitions of the rows do not matter; repeated lines do.
    """
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    leaves = lines.withColumn("leaf", F.substring(F.sha2("line", 256), 1, LEAF)).groupBy(*by, "leaf").agg(joined("line").alias("d"))
    branches = leaves.groupBy(*by, F.substring("leaf", 1, BRANCH).alias("branch")).agg(joined(F.concat_ws(" ", "leaf", "d")).alias("d"))
    return branches.groupBy(*by).agg(joined(F.concat_ws(" ", "branch", "d")).alias("digest"))


def copy_digest(quads: DataFrame) -> DataFrame:
    """(g, digest) of each graph's ``s|p|o`` lines, closure included."""
    return tree_digest(quads.select("g", F.concat_ws("|", "s", "p", "o").alias("line")), ["g"])


def structural_digest(quads: DataFrame) -> DataFrame:
    """(g, digest) that no renaming of blank nodes changes, asserted quads only.

    Lines without blank nodes count as they are; each blank node counts as the digest of the lines around it, in
    which it is ``_:self`` and other blank nodes are ``_:other``. A line between two blank nodes counts for both.
    """
    q = quads.where("NOT inferred")
    term = lambda kind, value, *more: F.when(kind == T.BNODE, F.lit("_:other")).otherwise(rendered(kind, value, *more))
    s, o = term(F.col("s_kind"), F.col("s")), term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
    p = F.concat(F.lit("<"), F.col("p"), F.lit(">"))
    blank_s, blank_o = F.col("s_kind") == T.BNODE, F.col("o_kind") == T.BNODE
    ground = q.where(~blank_s & ~blank_o).select("g", F.concat_ws(" ", s, p, o).alias("line"))
    # two equi-selections instead of a join on either end
    own_s = q.where(blank_s).select("g", F.col("s").alias("b"), F.concat_ws(" ", F.lit("_:self"), p, F.when(blank_o & (F.col("o") == F.col("s")), F.lit("_:self")).otherwise(o)).alias("line"))
    own_o = q.where(blank_o & ~(blank_s & (F.col("o") == F.col("s")))).select("g", F.col("o").alias("b"), F.concat_ws(" ", s, p, F.lit("_:self")).alias("line"))
    nodes = tree_digest(own_s.unionByName(own_o), ["g", "b"]).select("g", F.col("digest").alias("line"))
    return tree_digest(ground.unionByName(nodes), ["g"])


def grounding(quads: DataFrame) -> DataFrame:
    """Census of each graph: one aggregation of counts, and the few distinct nodes beside it."""
    blank = (F.col("s_kind") == T.BNODE) | (F.col("o_kind") == T.BNODE)
    told = ~F.col("inferred")
    counts = quads.groupBy("g").agg(
        F.count_if(told).alias("asserted"),
        F.count_if("inferred").alias("inferred"),
        F.count_if(told & ~blank).alias("ground"),
        F.count_if(told & blank).alias("blank"),
        F.count_if(told & (F.col("p") == T.SHACL + "property")).alias("property_shapes"),
    )
    nodes = {
        "blank_nodes": (F.col("s_kind") == T.BNODE, "s"),
        "nodeshapes": ((F.col("p") == T.RDF_TYPE) & (F.col("o") == T.SHACL + "NodeShape"), "s"),
        "declared_properties": (F.col("p") == T.SHACL + "path", "o"),
    }
    for name, (condition, node) in nodes.items():
        some = quads.where(told & condition).select("g", node).distinct().groupBy("g").agg(F.count(F.lit(1)).alias(name))
        counts = counts.join(some, "g", "left")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in nodes]
    return counts.select("g", "asserted", "inferred", "ground", "blank", zero[0], zero[1], "property_shapes", zero[2])


def direct_and_inferred(quads: DataFrame) -> DataFrame:
    return quads.agg(F.count_if(~F.col("inferred")).alias("direct"), F.count_if("inferred").alias("inferred"))

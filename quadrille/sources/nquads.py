"""N-Quads text as quads, and back: one statement a line, so that one file is read by many tasks.

All of it is column expressions, so ``parse`` takes the lines of a stream as well. Labels of blank nodes stay as
they are, as a folder of parts is one document; whether a quad was inferred is not written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import terms as T
from quadrille.operators import quads as Q

_NODE, _IRI = r'(?:<[^<>"\s]*+>|_:[^\s<>"]*[^\s<>".])', r'<[^<>"\s]*+>'
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\^\^<[^<>"\s]*+>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
STATEMENT = rf"^\s*({_NODE})\s*({_IRI})\s*({_NODE}|{_LITERAL})\s*({_NODE})?\s*\.\s*(?:#.*)?$"
# what STATEMENT matches up to the end of the text, a last line terminator included
_WHOLE = STATEMENT[:-1] + r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\z"
EMPTY = r"^\s*(?:#.*)?$"
# Characters that stand for others after a backslash.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescaped(text: Column) -> Column:
    """A text without its backslash escapes, code points in hex digits included."""

    def one(x: Column) -> Column:
        mark = F.substring(x, 2, 1)
        point = F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(c) for pair in ESCAPES.items() for c in pair]), mark), mark)
        return F.when(~F.startswith(x, F.lit("\\")), x).when((mark.isin("u", "U")) & (F.length(x) > 2), point).otherwise(named)

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)[^\\]++|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\."), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def _kind(term: Column) -> Column:
    return F.when(F.startswith(term, F.lit("<")), T.IRI).when(F.startswith(term, F.lit("_:")), T.BNODE).otherwise(T.LITERAL)


def _node(term: Column) -> Column:
    """An IRI without its brackets, or a blank node's label."""
    return F.when(F.startswith(term, F.lit("<")), unescaped(F.substr(term, F.lit(2), F.length(term) - 2))).otherwise(F.substr(term, F.lit(3)))


def parse(lines: DataFrame, g: str, column: str = "value") -> DataFrame:
    """Quads of lines, repeated ones included; ``g`` is the graph of statements that name none. A line that is neither a statement nor empty nor a comment fails the query (``faults`` lists such lines)."""
    line = F.col(column)
    wrong = F.raise_error(F.concat(F.lit("N-Quads: no statement: "), F.substring("line", 1, 200))).cast("array<string>")
    # one pass gives all terms, the object last as only it may hold a newline; a statement always changes, as its full stop goes
    terms = lines.select(line.alias("line"), F.regexp_replace(line, _WHOLE, "$4\n$1\n$2\n$3").alias("terms"))
    one = F.when(F.col("terms") != F.col("line"), F.array("terms")).when(F.col("line").rlike(EMPTY), F.array().cast("array<string>")).otherwise(wrong)
    cells = terms.select(F.explode(one).alias("t")).select(F.split("t", "\n", 4).alias("t"))
    rows = cells.select(*[F.get("t", F.lit(i)).alias(n) for i, n in enumerate(("graph", "s", "p", "o"))])
    # a literal's closing quote is its last one: datatypes and languages hold none
    cut = F.length("o") - F.locate('"', F.reverse("o")) + 1
    text, tail = unescaped(F.substr("o", F.lit(2), cut - 2)), F.substr("o", cut + 1)
    literal = F.startswith("o", F.lit('"'))
    datatype = F.when(literal & F.startswith(tail, F.lit("^^")), unescaped(F.substr(tail, F.lit(4), F.length(tail) - 4)))
    named = F.when(F.col("graph") == "", F.lit(g)).when(F.startswith("graph", F.lit("_:")), F.col("graph")).otherwise(_node(F.col("graph")))
    return rows.select(
        named.alias("g"), _node(F.col("s")).alias("s"), _node(F.col("p")).alias("p"), F.when(literal, text).otherwise(_node(F.col("o"))).alias("o"),
        _kind(F.col("s")).alias("s_kind"), _kind(F.col("o")).alias("o_kind"), F.nullif(datatype, F.lit(T.XSD + "string")).alias("o_dt"),
        F.when(literal & F.startswith(tail, F.lit("@")), F.substr(tail, F.lit(2))).alias("o_lang"), F.lit(False).alias("inferred"),
    )


def faults(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that ``parse`` refuses."""
    return lines.where(~F.col(column).rlike(STATEMENT) & ~F.col(column).rlike(EMPTY))


def read(spark: SparkSession, path: str, g: str = "urn:x:default") -> DataFrame:
    """The quads of a file or folder of N-Quads or N-Triples, without duplicates."""
    return parse(spark.read.text(path), g).distinct()


def lines(quads: DataFrame) -> DataFrame:
    """(value): one statement per quad. Graphs are IRIs, or blank nodes where they begin with ``_:``."""
    graph = F.when(F.startswith("g", F.lit("_:")), F.col("g")).otherwise(F.concat(F.lit("<"), "g", F.lit(">")))
    terms = [Q.rendered(F.col("s_kind"), F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), Q.rendered(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang")), graph, F.lit(".")]
    return quads.select(F.replace(F.concat_ws(" ", *terms), F.lit("\r"), F.lit("\\r")).alias("value"))


def write(quads: DataFrame, path: str, mode: str = "error") -> None:
    lines(quads).write.mode(mode).text(path)

"""Chat formatting with typed content parts.

A visitor walks the parts of each message in order: text is escaped, images, audio and documents become
placeholders ``<|image:0|>`` numbered by their place among the message's parts; each reference is recorded with
the number of tokens that it expands to. Turns of a conversation are then joined under a template that marks
turns, and the loss mask holds the spans of assistant text in the output. Everything is a Spark expression;
one conversation is one output row, as its formatted text is one string.

Template of a turn: ``<|turn|>role<|text|>content<|end|>``. Control strings inside roles and texts are escaped
with a backslash (``<|`` as ``<\\|``, ``</s>`` as ``<\\/s>``, ``[INST]`` as ``[\\INST]``, a backslash as two), and
``unescape`` takes it back exactly. A text part that starts with a character from inside a control string gets a
backslash before it, unless it is the message's first part, so parts cannot put one together either.

Defined results: null text or role is empty; null parts, or parts of an unknown type, give nothing; turns are
ordered by turn, role, text, so ties have one order; repeated rows are turns of their own; a row with a null
conv_id is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that may not stand in a text: theirs is the first character, then a backslash, then the rest.
CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]"]
#: A text that could go on with a control string begun before it.
INNER = "^[" + "".join("\\" + x if not x.isalnum() else x for x in sorted({x for c in CONTROL for x in c[1:]})) + "]"
LOSS_ROLE = "assistant"
#: Tokens that a part expands to: an image by patches of 14 x 14 pixels, audio by second, documents by page.
PATCH, AUDIO_TOKENS_S, PAGE_TOKENS = 14, 25, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """Plain text as a message of one text part."""
    null = F.lit(None)
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"))
    return F.array(part).cast(f"array<{PART}>")


def part_tokens(p: Column) -> Column:
    """Tokens that an attachment expands to; 0 for text and for missing sizes."""
    image = F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH)
    return F.coalesce(F.when(p["type"] == "image", image).when(p["type"] == "audio", F.ceil(p["seconds"] * AUDIO_TOKENS_S)).when(p["type"] == "document", p["pages"].cast("bigint") * PAGE_TOKENS), F.lit(0)).cast("bigint")


def visit(parts: Column) -> Column:
    """Each part as (piece of content, attachment or null)."""

    def one(p: Column, i: Column) -> Column:
        kind = p["type"]
        known = F.coalesce(kind.isin("image", "audio", "document"), F.lit(False))
        text = escape(p["text"])
        apart = F.when((i > 0) & text.rlike(INNER), F.concat(F.lit("\\"), text)).otherwise(text)
        piece = F.when(kind == "text", apart).when(known, F.concat(F.lit("<|"), kind, F.lit(":"), i.cast("string"), F.lit("|>"))).otherwise(F.lit(""))
        mark = F.when(known, F.struct(i.alias("part"), kind.alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
        return F.struct(piece.alias("piece"), mark.alias("mark"))

    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), one)


def format_conversations(rows: DataFrame, parts: Column | None = None) -> DataFrame:
    """conv_id, formatted, turns (role, content as written, with escapes), loss_spans (start, length in code points of ``formatted``), attachments (turn, part, type, ref, tokens), n_attachment_tokens."""
    parts = text_parts(F.col("text")) if parts is None else parts
    said = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts")).alias("t"))
    together = said.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.collect_list("t").alias("ts")).unionAll(said.where("conv_id IS NULL").select("conv_id", F.array("t").alias("ts")))

    def told(t: Column) -> Column:
        seen, texts = visit(t["parts"]), F.filter(t["parts"], lambda p: p["type"] == "text")
        return F.struct(
            t["turn"].alias("turn"),
            t["role"].alias("role"),
            F.array_join(F.transform(texts, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"),
            F.array_join(F.transform(seen, lambda s: s["piece"]), "").alias("content"),
            F.filter(F.transform(seen, lambda s: s["mark"]), lambda m: m.isNotNull()).alias("marks"),
        )

    turns = together.select("conv_id", F.sort_array(F.transform("ts", told)).alias("ts"))
    pieces = turns.withColumn("pieces", F.transform("ts", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), t["content"], F.lit(END))))
    # where each turn's content starts: the lengths of the turns before it, and its own head
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def span(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(escape(t["role"])) + len(TURN) + len(TEXT)
        size = F.length(t["content"])
        mine = F.array(F.struct(begin.cast("int").alias("start"), size.cast("int").alias("length")))
        return F.struct((begin + size + len(END)).cast("int").alias("at"), F.when(t["role"] == LOSS_ROLE, F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

    marks = F.flatten(F.transform("ts", lambda t, i: F.transform(t["marks"], lambda m: F.struct(i.alias("turn"), m["part"].alias("part"), m["type"].alias("type"), m["ref"].alias("ref"), m["tokens"].alias("tokens")))))
    return pieces.select(
        "conv_id",
        F.array_join("pieces", "").alias("formatted"),
        F.aggregate("ts", start, span)["spans"].alias("loss_spans"),
        marks.alias("attachments"),
        F.aggregate(marks, F.lit(0).cast("bigint"), lambda a, m: a + m["tokens"]).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, parsed back: array of (role, text)."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda s: s != "")

    def turn(s: Column) -> Column:
        sides = F.split(s, r"<\|text\|>", 2)
        return F.struct(unescape(sides[0]).alias("role"), unescape(F.regexp_replace(F.get(sides, F.lit(1)), r"<\|end\|>\z", "")).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def op4_chat_parts(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_conversations(rows.unionByName(extra))
    read = out.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _escaped_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP4_SQL = f"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(TURN) + len(TEXT) + len(END)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id, own
"""

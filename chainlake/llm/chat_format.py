"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts.  A visitor with one case per part type
(text, image, audio, document) flattens them in order: text is escaped, every
other part becomes a placeholder ``<|type turn.part|>`` and an attachment
record with the number of tokens that it expands to.

Template: ``### role: body</turn>\\n`` per turn.  A backslash begins a code in
escaped text: ``\\b`` backslash, ``\\h`` number sign, ``<\\s`` for ``</``,
``<\\p`` for ``<|`` and, in roles, ``\\c`` for a colon.  So neither ``###`` nor
``</turn>`` nor a placeholder can stand inside a text, or begin in one part and
end in the next, and unescaping (the backslash last) gives every text back.
Expanded token counts are those of the placeholders; text tokens are not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODES = (("\\", "\\b"), ("#", "\\h"), ("</", "<\\s"), ("<|", "<\\p"))
ROLE_CODES = (*CODES, (":", "\\c"))
TURN, END = "### ", "</turn>\n"
IMAGE_PATCH = 28       # pixels of a side that one token covers
AUDIO_PER_SECOND = 25  # tokens
DOCUMENT_PER_PAGE = 512
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
LEARNED = "assistant"  # the role under the loss mask


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _part(field) -> Column:
    """A part with every field of PART; ``field`` gives a column or None by name."""
    columns = []
    for spec in PART[len("struct<"):-1].split(", "):
        name, kind = spec.split(": ")
        value = field(name)
        columns.append((F.lit(None) if value is None else value).cast(kind).alias(name))
    return F.struct(*columns)


def text_parts(text: Column) -> Column:
    """A plain text as an array of one text part."""
    known = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(_part(known.get))


def _all_parts(df: DataFrame, name: str) -> Column:
    """A part column with the missing fields filled in; null lists become empty."""
    own = df.schema[name].dataType.elementType.names
    return F.transform(F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)),
                       lambda p: _part(lambda f: p[f] if f in own else None))


def _tokens(part: Column) -> Column:
    """Tokens that a part's placeholder expands to."""
    def n(c: Column) -> Column:
        return F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))

    return (F.when(part["type"] == "image", F.ceil(n(part["width"]) / IMAGE_PATCH) * F.ceil(n(part["height"]) / IMAGE_PATCH))
            .when(part["type"] == "audio", F.ceil(n(part["seconds"]) * AUDIO_PER_SECOND))
            .when(part["type"] == "document", n(part["pages"]).cast("long") * DOCUMENT_PER_PAGE)
            .otherwise(F.lit(0)).cast("long"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def flatten(parts: Column, turn: Column) -> Column:
    """The visitor: escaped text and placeholders of all parts, in order.

    Control strings may begin in one text part and end in a later one, so all
    but the backslash is escaped in the joined body.  Until then placeholders
    stand between ``\\[`` and ``\\]``, which no escaped text holds.
    """
    def visit(part: Column, i: Column) -> Column:
        mark = F.concat(F.lit("\\["), escape(part["type"], ROLE_CODES), F.lit(" "), turn.cast("string"), F.lit("."),
                        (i + 1).cast("string"), F.lit("\\]"))
        return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")), CODES[:1])).otherwise(mark)

    joined = escape(F.array_join(F.transform(parts, visit), ""), CODES[1:])
    return escape(joined, (("\\[", "<|"), ("\\]", "|>")))


def attachments(parts: Column, turn: Column) -> Column:
    """(turn, part, type, ref, tokens) of all parts that are no text, in order."""
    def record(part: Column, i: Column) -> Column:
        return F.struct(turn.cast("int").alias("turn"), (i + 1).cast("int").alias("part"), part["type"].alias("type"),
                        part["ref"].alias("ref"), _tokens(part).alias("tokens"), _is_text(part).alias("is_text"))

    kept = F.filter(F.transform(parts, record), lambda r: ~r["is_text"])
    return F.transform(kept, lambda r: r.dropFields("is_text"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str | None = None, text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, turns, attachments, expanded_tokens.

    Turns stand by turn number (nulls first), then role, then content; equal
    rows are kept.  A null role is the empty role, a null text or part list the
    empty text, a null conv_id a conversation of its own; an empty table gives
    an empty result; other columns are not read.  ``turns`` has per turn its
    start and length in ``formatted`` and, for turns under the loss mask, the
    loss_start and loss_length of its body inside the turn (code points).

    With ``parts_col``, an array of structs with some fields of PART (unknown
    types are placeholders of no tokens), without it the plain ``text_col``.
    A conversation is one output row, so its turns meet in one task; no other
    row does.
    """
    parts = _all_parts(turns, parts_col) if parts_col else text_parts(F.col(text_col))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    rows = rows.withColumn("n", F.row_number().over(order))
    head = F.concat(F.lit(TURN), escape(F.col("role"), ROLE_CODES), F.lit(": "))
    rows = rows.select("conv_id", "turn", "role", "parts", "n", head.alias("head"),
                       flatten(F.col("parts"), F.col("n")).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    learned = F.col("role") == LEARNED
    rows = rows.withColumn("size", size.cast("long")).withColumn(
        "start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    one = F.struct(
        F.col("n"), F.concat("head", "body", F.lit(END)).alias("text"), F.col("start"), F.col("size").alias("length"),
        F.when(learned, F.length("head")).cast("long").alias("loss_start"),
        F.when(learned, F.length("body")).cast("long").alias("loss_length"),
        attachments(F.col("parts"), F.col("n")).alias("attached"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    chats = chats.select(
        "conv_id", F.array_join(F.col("all.text"), "").alias("formatted"),
        F.transform("all", lambda t: t.dropFields("n", "text", "attached")).alias("turns"),
        F.flatten("all.attached").alias("attachments"))
    return chats.withColumn("expanded_tokens", F.aggregate(
        "attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with read (role, text per turn) and learned (texts under the loss mask), from ``formatted`` alone
    and the mask in ``turns``."""
    pieces = F.split("formatted", END)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, ": ", 1)
        return F.struct(unescape(F.substr(role, F.lit(len(TURN) + 1)), ROLE_CODES).alias("role"),
                        unescape(F.substr(piece, F.length(role) + 3)).alias("text"))

    cut = chats.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    masked = F.filter(F.arrays_zip(F.col("_pieces").alias("piece"), F.col("turns").alias("mask")),
                      lambda x: x["mask"]["loss_start"].isNotNull())
    return (cut.withColumn("read", F.transform("_pieces", turn))
            .withColumn("learned", F.transform(masked, lambda x: unescape(F.substr(
                x["piece"], (x["mask"]["loss_start"] + 1).cast("int"), x["mask"]["loss_length"].cast("int")))))
            .drop("_pieces"))

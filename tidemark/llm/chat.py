"""Chat turns of typed parts as one training text, in column expressions only.

A turn is ``<turn role="...">body</turn>`` and a line feed.  Texts and roles are escaped by
three plain replacements, after which they hold neither ``<`` nor ``"``: every ``<`` of the
output belongs to the template, whatever the texts contain, and the escaping can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = '<turn role="', '">', "</turn>\n"

#: A part: text carries ``text``; the others carry ``ref`` and a size.
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit('"'), F.lit("\\q"))


def unescaped(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\q"), F.lit('"')), F.lit("\\l"), F.lit("<"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def text_part(c: Column) -> Column:
    names = ("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")
    return F.struct(F.lit("text").alias("kind"), c.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in names])


def expanded_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens a placeholder stands for: image patches, audio frames, document pages."""
    def size(c: Column, default: int) -> Column:
        return F.greatest(F.coalesce(c, F.lit(default)), F.lit(default))
    return (F.when(part["kind"] == "image", F.ceil(size(part["width"], 1) / patch) * F.ceil(size(part["height"], 1) / patch))
            .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate))
            .when(part["kind"] == "document", size(part["pages"], 1) * page_tokens).otherwise(F.lit(0))).cast("long")


def formatted_turns(messages: DataFrame, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256) -> DataFrame:
    """(conv_id, turn, role, piece, loss, attachments) per row of (conv_id, turn, role, parts).

    ``parts`` is an array of :data:`PART`; the visitor walks it in order: a text part gives
    its escaped text, any other part a placeholder ``<kind turn.part>`` and an attachment
    (part, kind, ref, at, tokens).  ``loss`` lists (at, chars) of the text parts of assistant
    turns, as code points inside the piece.  Null parts, texts and roles count as empty.
    """
    turn = F.coalesce(F.col("turn").cast("string"), F.lit(""))

    def visit(part: Column, i: Column) -> Column:
        is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
        holder = F.concat(F.lit("<"), escaped(part["kind"]), F.lit(" "), turn, F.lit("."), i.cast("string"), F.lit(">"))
        return F.struct(F.when(is_text, escaped(part["text"])).otherwise(holder).alias("out"), is_text.alias("is_text"),
                        part["kind"].alias("kind"), part["ref"].alias("ref"), i.alias("part"),
                        expanded_tokens(part, patch, audio_rate, page_tokens).alias("tokens"))

    parts = F.coalesce(F.filter("parts", lambda p: p.isNotNull()), F.array().cast(f"array<{PART}>"))
    head = F.concat(F.lit(HEAD), escaped(F.col("role")), F.lit(MIDDLE))
    step = messages.select("conv_id", "turn", "role", head.alias("_head"), F.transform(parts, visit).alias("_seen"))
    # Where each part starts, by one pass over the lengths.
    starts = F.aggregate("_seen", F.array(F.length("_head").cast("long")),
                         lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p["out"]))))
    step = step.withColumn("_at", starts)
    placed = F.transform("_seen", lambda p, i: F.struct(F.get(F.col("_at"), i).alias("at"), F.length(p["out"]).cast("long").alias("chars"), p.alias("p")))
    step = step.withColumn("_placed", placed)
    body = F.array_join(F.transform("_seen", lambda p: p["out"]), "")
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    loss = F.transform(F.filter("_placed", lambda x: x["p"]["is_text"] & assistant), lambda x: F.struct(x["at"].alias("at"), x["chars"].alias("chars")))
    files = F.transform(F.filter("_placed", lambda x: ~x["p"]["is_text"]), lambda x: F.struct(
        x["p"]["part"].alias("part"), x["p"]["kind"].alias("kind"), x["p"]["ref"].alias("ref"), x["at"].alias("at"), x["p"]["tokens"].alias("tokens")))
    return step.select("conv_id", "turn", "role", F.concat("_head", body, F.lit(END)).alias("piece"), loss.alias("loss"), files.alias("attachments"))


def formatted_chats(messages: DataFrame, **sizes) -> DataFrame:
    """(conv_id, formatted, loss, attachments): the turns of a conversation in order.

    ``loss`` is (no, at, chars) with the turn's place in the conversation.  Turns follow by
    number, null first, ties by role and piece.  A conversation is one output row, so it must
    fit a task; :func:`formatted_turns` is the form without that bound.
    """
    turns = formatted_turns(messages, **sizes)
    rows = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "role", "piece", "loss", "attachments")))
    chats = turns.groupBy("conv_id").agg(rows.alias("_turns"))
    loss = F.flatten(F.transform("_turns", lambda t, i: F.transform(t["loss"], lambda x: F.struct(i.alias("no"), x["at"].alias("at"), x["chars"].alias("chars")))))
    return chats.select("conv_id", F.array_join(F.transform("_turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"),
                        F.flatten(F.transform("_turns", lambda t: t["attachments"])).alias("attachments"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): roles and texts, and the text under the loss mask, parsed from ``formatted``.

    Placeholders stay in the texts as they are; only template marks are taken away.
    """
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    step = chats.select("conv_id", "formatted", "loss", "attachments", pieces.alias("_pieces"))
    turns = F.transform("_pieces", lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, len(HEAD) + 1, 2**31 - 1), MIDDLE, 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, MIDDLE) + len(MIDDLE), F.lit(2**31 - 1))).alias("text")))
    loss_text = F.array_join(F.transform("loss", lambda x: unescaped(F.substring(F.get(F.col("_pieces"), x["no"]), x["at"].cast("int") + 1, x["chars"].cast("int")))), "")
    return step.select("conv_id", "formatted", "attachments", turns.alias("turns"), loss_text.alias("loss_text"))

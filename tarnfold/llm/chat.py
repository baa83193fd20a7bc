"""Chat formatting of typed content parts, with DataFrame functions only.

A message is text, or an array of parts struct<kind, text, ref, width, height, seconds, pages>. A visitor flattens the
parts in order, as rows with running counts, so its work is linear: text parts are escaped, image, audio and document parts become
placeholders `<kind:N>` whose ordinal N counts through the conversation, with the reference and the expanded token count kept beside.
The loss mask holds the ranges of the formatted text that are text parts of the `loss_role`.

Layout of a turn: `<turn>` role `<text>` body `</turn>` newline. In roles and texts a backslash becomes `\\b` and `<`
becomes `\\l`; a raw `<` is therefore always the template's own, and two replacements in the opposite order undo it.

Defined cases: null text, role or part fields count as empty; a null or empty part list is an empty body; a null
conversation id is a group of its own; turns with equal numbers are ordered by role and text, null turns first; repeated
rows stay repeated turns; an empty table gives an empty result; further columns are ignored.

A conversation is one output value, so it has to fit in a row; that is its only bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<turn>", "<text>", "</turn>\n"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(c: Column) -> Column:
    """A one-part message from plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]))


def expanded_tokens(part: Column, tile: int = 512, tile_tokens: int = 170, base_tokens: int = 85, audio_rate: float = 25.0, page_tokens: int = 800) -> Column:
    """Tokens that a placeholder stands for: image tiles, audio seconds or document pages; unknown sizes count as one unit."""
    tiles = F.ceil(F.greatest(F.coalesce(part["width"], F.lit(1)), F.lit(1)) / tile) * F.ceil(F.greatest(F.coalesce(part["height"], F.lit(1)), F.lit(1)) / tile)
    return (
        F.when(part["kind"] == "image", base_tokens + tile_tokens * tiles)
        .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(1.0)), F.lit(0.0)) * audio_rate))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * page_tokens)
        .otherwise(0)
        .cast("long")
    )


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text", parts: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_messages, formatted, loss, attachments.

    loss: array<struct<turn, within, start, length>>, places in code points from 0, `within` the turn and from the `start` of all.
    attachments: array<struct<ordinal, turn, kind, ref, tokens>> in reading order.
    """
    given = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), (F.col(parts).cast(f"array<{PART}>") if parts else F.lit(None).cast(f"array<{PART}>")).alias("_parts"), (F.col(text) if text else F.lit(None).cast("string")).alias("_text"))
    order = [F.col("_turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), F.col("_text").asc_nulls_first()] + ([F.to_json("_parts").asc_nulls_first()] if parts else [])
    rows = given.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    none = F.array().cast(f"array<{PART}>")
    # a message's text is its first part
    rows = rows.withColumn("_parts", F.concat(text_part(F.col("_text")).cast(f"array<{PART}>") if text else none, F.coalesce("_parts", none)))
    rows = rows.select("conv_id", "_turn", "_role", "_n", F.size("_parts").alias("_size"), F.posexplode_outer("_parts").alias("_pos", "_p"))

    so_far = Window.partitionBy("conv_id").orderBy("_n", "_pos").rowsBetween(Window.unboundedPreceding, -1)
    in_turn = Window.partitionBy("conv_id", "_n").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.coalesce(F.col("_p.kind"), F.lit("text"))
    rows = rows.withColumn("_file", kind.isin("image", "audio", "document"))
    rows = rows.withColumn("_ordinal", F.coalesce(F.sum(F.col("_file").cast("long")).over(so_far), F.lit(0)))
    body = F.when(F.col("_file"), F.concat(F.lit("<"), kind, F.lit(":"), F.col("_ordinal").cast("string"), F.lit(">"))).otherwise(escape(F.col("_p.text")))
    head = F.when(F.coalesce("_pos", F.lit(0)) == 0, F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(TEXT))).otherwise("")
    tail = F.when(F.coalesce("_pos", F.lit(0)) >= F.col("_size") - 1, END).otherwise("")
    rows = rows.withColumns({"_head": head, "_body": body, "_tail": tail})
    size = F.length("_head") + F.length("_body") + F.length("_tail")
    rows = rows.withColumn("_size", size.cast("long"))
    rows = rows.withColumn("_start", F.coalesce(F.sum("_size").over(so_far), F.lit(0)) + F.length("_head"))
    rows = rows.withColumn("_within", F.coalesce(F.sum("_size").over(in_turn), F.lit(0)) + F.length("_head"))
    said = F.coalesce(F.col("_role") == loss_role, F.lit(False)) & ~F.col("_file") & (F.length("_body") > 0)
    mask = F.when(said, F.struct((F.col("_n") - 1).alias("turn"), F.col("_within").cast("int").alias("within"), F.col("_start").cast("long").alias("start"), F.length("_body").alias("length")))
    file = F.when(F.col("_file"), F.struct(F.col("_ordinal").cast("long").alias("ordinal"), F.col("_turn").cast("long").alias("turn"), kind.alias("kind"), F.col("_p.ref").alias("ref"), expanded_tokens(F.col("_p")).alias("tokens")))
    piece = F.struct(F.col("_n").alias("n"), F.col("_pos").alias("pos"), F.concat("_head", "_body", "_tail").alias("piece"), mask.alias("mask"), file.alias("file"))
    grouped = rows.select("conv_id", "_n", piece.alias("_m")).groupBy("conv_id").agg(F.max("_n").cast("long").alias("n_messages"), F.array_sort(F.collect_list("_m")).alias("_ms"))
    each = lambda field: F.transform("_ms", lambda m: m[field])
    return grouped.select("conv_id", "n_messages", F.array_join(each("piece"), "").alias("formatted"), F.array_compact(each("mask")).alias("loss"), F.array_compact(each("file")).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted text-only conversation."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def one(piece: Column) -> Column:
        return F.struct(unescape(F.substring(F.substring_index(piece, TEXT, 1), len(TURN) + 1, 2**31 - 1)).alias("role"), unescape(F.substring_index(piece, TEXT, -1)).alias("text"))

    return F.transform(pieces, one)


def loss_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask, in order, read from the formatted text. Places within turns keep this linear."""
    both = F.array(F.struct(F.split(formatted, END).alias("turns"), loss.alias("loss")))  # bound once, or each range would split the text anew
    texts = F.transform(both, lambda b: F.array_join(F.transform(b["loss"], lambda r: F.substring(b["turns"][r["turn"]], r["within"] + 1, r["length"])), ""))
    return unescape(texts[0])

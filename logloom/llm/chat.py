r"""Operator 10: chat formatting with typed content parts, in DataFrame operations only.

A turn's content is a list of parts: struct<type, text, ref, tokens>. A visitor (one CASE over the part's type,
applied to the exploded parts) flattens them in order: text is escaped, and an image, audio or document
part becomes a placeholder ``<|part:type:k|>`` where k numbers the conversation's attachments from 0. For
each attachment the reference, its type, the turn, the place of its placeholder and the tokens it expands to are recorded.
Numbers and places are running sums over the conversation's parts, so work grows with the parts, not their square.

Template: every turn is ``<|turn:role|>`` newline, body, ``<|end|>`` newline. Texts escape ``\`` as ``\\`` and ``<``
as ``\l``; roles and types escape ``|`` too, as ``\p``. So ``<|`` starts a control string of the template and
nothing else does, the first ``|>`` behind it ends it, and no role or type spells another kind of control string:
every role and text reads back. Other templates' control strings need nothing: nothing reads them here.

The loss mask covers the bodies of the roles in `loss_roles`, as (start, length) code points from 0.

Defined cases: turns are ordered by number, null first, ties by role, then content; null texts are empty and
null roles an empty role; rows that repeat are turns that repeat; a turn without parts has an empty body; a null conversation id
is one conversation; an empty table gives an empty result; columns of any other name are left unread. A
conversation is one string, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed strings of the template.
TURN, PART, SHUT, CLOSE = "<|turn:", "<|part:", "|>", "<|end|>\n"
PART_TYPE = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
#: Code points of a block of formatted text, by which spans are read.
BLOCK = 4096


def escape(text: Column, name: bool = False) -> Column:
    """A text (or a name: a role or type) without control strings."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("|"), F.lit("\\p")) if name else out


def unescape(text: Column) -> Column:
    # Split at escaped backslashes first: within a piece every backslash starts an escaped character.
    plain = lambda piece: F.replace(F.replace(piece, F.lit("\\l"), F.lit("<")), F.lit("\\p"), F.lit("|"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("tokens"))).cast(PART_TYPE)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    parts: the content as PART_TYPE; default: the column `text` as one text part.
    """
    content = text_parts(F.col("text")) if parts is None else F.coalesce(parts.cast(PART_TYPE), F.array().cast(PART_TYPE))
    named = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), content.alias("parts"))
    named = named.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "parts")))
    named = named.withColumn("last", F.greatest(F.size("parts") - 1, F.lit(0)))
    part = named.select("conv_id", "seq", "turn", "role", "last", F.posexplode_outer("parts").alias("pos", "part")).withColumn("pos", F.coalesce("pos", F.lit(0)))

    before = Window.partitionBy("conv_id").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
    attached = F.col("part").isNotNull() & (F.coalesce(F.col("part.type"), F.lit("text")) != "text")
    part = part.withColumn("attached", attached).withColumn("number", so_far(F.col("attached").cast("int")))
    # The visitor: what each kind of part becomes.
    shown = F.when(F.col("attached"), F.concat(F.lit(PART), escape(F.col("part.type"), True), F.lit(":"), F.col("number").cast("string"), F.lit(SHUT))).otherwise(escape(F.coalesce(F.col("part.text"), F.lit(""))))
    part = part.withColumn("body", shown).withColumn("head", F.when(F.col("pos") == 0, F.concat(F.lit(TURN), escape(F.col("role"), True), F.lit(f"{SHUT}\n"))).otherwise(F.lit("")))
    part = part.withColumn("piece", F.concat("head", "body", F.when(F.col("pos") == F.col("last"), F.lit(CLOSE)).otherwise(F.lit(""))))
    part = part.withColumn("start", so_far(F.length("piece")) + F.length("head"))

    record = F.struct(F.col("number").cast("int").alias("number"), "turn", F.col("part.type").alias("type"), F.col("part.ref").alias("ref"), F.coalesce("part.tokens", F.lit(0)).cast("bigint").alias("tokens"), "start")
    turn = part.groupBy("conv_id", "seq").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "").alias("piece"),
        F.min("start").alias("start"),
        F.sum(F.length("body")).cast("bigint").alias("length"),
        F.first("role").isin(*loss_roles).alias("loss"),
        F.collect_list(F.when(F.col("attached"), record)).alias("attachments"),
    )
    rows = F.array_sort(F.collect_list(F.struct("seq", "piece", "loss", "start", "length", "attachments")))
    made = turn.groupBy("conv_id").agg(rows.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    # The bound columns are read by one later projection each: nothing is computed twice.
    return made.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.array_sort(F.flatten(F.transform("turns", lambda t: t["attachments"]))).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, t: a + F.aggregate(t["attachments"], F.lit(0).cast("bigint"), lambda b, x: b + x["tokens"])).alias("expanded_tokens"),
    )


def parse_formatted(formatted: Column) -> Column:
    """Turns read back from a formatted conversation: array<struct<role, body>>; bodies are unescaped texts with placeholders."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")  # a turn has a head at least: only the end is empty
    head = lambda p: F.substring_index(p, f"{SHUT}\n", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substr(head(p), F.lit(len(TURN) + 1))).alias("role"), unescape(F.substr(p, F.length(head(p)) + len(SHUT) + 2)).alias("body")))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped text under the loss mask, read from the formatted string, by blocks: a span is never sought from the start."""
    blocks = F.regexp_extract_all(formatted, F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))

    def read(b: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / BLOCK).cast("int"), F.floor((s["start"] + s["length"]) / BLOCK).cast("int")
        return unescape(F.substr(F.array_join(F.slice(b, first + 1, last - first + 1), ""), (s["start"] % BLOCK + 1).cast("int"), s["length"].cast("int")))

    # One element arrays bind the blocks once.
    return F.array_join(F.flatten(F.transform(F.array(F.struct(blocks.alias("b"))), lambda x: F.transform(loss_spans, lambda s: read(x["b"], s)))), "")

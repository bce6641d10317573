"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations in sequence. A turn is opened by its first event; deltas
append to the turn's text, an edit replaces it, and a regeneration starts it anew. Folding
takes, for each turn, the last event that replaces what came before and the deltas after it.
The final messages are rendered under a template whose marks cannot occur inside a text.

Template: ``<turn:ROLE>`` TEXT ``</turn>`` and a line end, for each turn. Inside roles and
texts a backslash is written ``\\b`` and ``<`` is written ``\\l``, so a ``<`` in the output is
always a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import settings

# Kinds of events.
DELTA, EDIT, REGENERATE, DELETE = "delta", "edit", "regenerate", "delete"
OPEN, CLOSE, END = "<turn:", ">", "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Undo ``escape`` and ``escape_role``: a backslash in escaped text always begins a pair."""
    found = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(found, F.lit("\\b"), F.lit("\\"))


def events_of_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A log of finished messages: each row is one delta, in the order of the turns.

    Rows of one conversation and turn, repeated ones and those with a null turn too, stay turns
    of their own: ``tie`` numbers them by role, then text.
    """
    ties = Window.partitionBy(conv, turn).orderBy("role", "text")
    return messages.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("seq"),
        F.col(turn).alias("turn"),
        F.lit(DELTA).alias("kind"),
        "role",
        F.col("text").alias("text"),
        F.row_number().over(ties).alias("tie"),
    )


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of a log ``conv_id, seq, turn, kind, role, text``.

    A further column ``tie``, if there, tells turns of one number apart.

    For each turn the last edit, regeneration or deletion sets the text anew (an edit and a
    regeneration to their own text, a deletion to nothing, after which the turn is gone unless
    later deltas bring it back) and later deltas are appended by sequence. Events of one
    sequence number go by kind, role, then text. The role is the last one given. Null texts
    are empty; null turns are one turn, before all others.
    """
    settings(events.sparkSession)
    rows = events.withColumn("text", F.coalesce("text", F.lit("")))
    order = F.struct("seq", "kind", "role", "text")
    sets = F.col("kind").isin(EDIT, REGENERATE, DELETE)
    # The turn is a group of one message's events; its conversation may be of any size.
    turns = rows.groupBy("conv_id", "turn", *[c for c in events.columns if c == "tie"]).agg(
        F.max(F.when(sets, order)).alias("_set"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("_role"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == DELTA, order))).alias("_deltas"),
    )
    after = F.filter("_deltas", lambda d: F.col("_set").isNull() | (d > F.col("_set")))
    base = F.when(F.col("_set.kind") == DELETE, F.lit("")).otherwise(F.coalesce("_set.text", F.lit("")))
    live = (F.size("_after") > 0) | (F.coalesce("_set.kind", F.lit("")) != DELETE)
    return (
        turns.withColumn("_after", after)
        .where(live)
        .select(
            "conv_id",
            "turn",
            F.col("_role.role").alias("role"),
            F.concat(base, F.array_join(F.transform("_after", lambda d: d["text"]), "")).alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, turn_spans, loss_spans`` of final messages, one row per conversation.

    ``turn_spans`` are the stretches of ``formatted`` (code points, end exclusive) that hold the
    turns' texts, and whether each counts for the loss; ``loss_spans`` are those that do, an
    assistant's texts. A null role is written as an empty one. A conversation is one training
    text, so its turns meet in one row, in turn order (ties by role, then text); its length
    costs time in proportion, as places come from a running sum over the turns. No messages
    give no row; other columns are ignored.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    parts = messages.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.concat(F.lit(OPEN), role, F.lit(CLOSE)).alias("head"),
        text.alias("body"),
        (F.coalesce("role", F.lit("")) == ASSISTANT).alias("loss"),
    )
    size = F.length("head") + F.length("body") + len(END)
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size).over(earlier), F.lit(0))
    placed = parts.withColumn("start", (at + F.length("head")).cast("int"))
    turn = F.struct("start", (F.col("start") + F.length("body")).cast("int").alias("end"), "loss", "head", "body")
    # Every turn has a place of its own, so sorting by it keeps the turns' order.
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    span = lambda *names: lambda t: F.struct(*[t[n].alias(n) for n in names])
    return gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform("turns", span("start", "end", "loss")).alias("turn_spans"),
        F.transform(F.filter("turns", lambda t: t["loss"]), span("start", "end")).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``role, text``."""
    pieces = F.split(formatted, END, -1)
    turns = F.filter(pieces, lambda p: p != "")
    head = F.lit(len(OPEN) + 1)

    def turn(piece):
        close = F.instr(piece, CLOSE)
        return F.struct(
            unescape(F.substring(piece, head, close - head)).alias("role"),
            unescape(F.substring(piece, close + 1, F.length(piece))).alias("text"),
        )

    return F.transform(turns, turn)


def loss_text(formatted: Column, turn_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    Reading every span from the start of the text would take square time, so the text is cut at
    the ends of turns and each span is held against its own piece: it has to begin where the
    piece's text does, counted from the span before, and end with the piece. Spans that are
    not a turn's whole text are read from the start.
    """
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    begins = F.transform(
        turn_spans, lambda t, i: t["start"] - F.when(i == 0, 0).otherwise(F.get(turn_spans, i - 1)["end"] + len(END))
    )
    whole = F.transform(turn_spans, lambda t: t["end"] - t["start"])
    fits = F.zip_with(
        F.zip_with(pieces, begins, lambda p, b: F.when(F.instr(p, CLOSE) == b, F.length(p) - b)),
        whole,
        lambda left, size: F.coalesce(left == size, F.lit(False)),
    )
    own = F.zip_with(
        pieces, turn_spans, lambda p, t: F.when(t["loss"], unescape(F.substring(p, F.instr(p, CLOSE) + 1, F.length(p))))
    )
    apart = F.transform(
        F.filter(turn_spans, lambda t: t["loss"]),
        lambda t: unescape(F.substring(formatted, t["start"] + 1, t["end"] - t["start"])),
    )
    return F.when(F.forall(fits, lambda f: f), F.array_join(own, "")).otherwise(F.array_join(apart, ""))

"""Chat formatting by event-sourced reconstruction.

An event log has conv_id, seq, turn, kind, role, text. Kinds, folded in the order
of (seq, turn):

* ``delta``: appends its text to the turn (the first one opens it and gives the role);
* ``edit``: replaces what the turn says so far;
* ``regenerate``: empties the turn, and deltas that follow build it anew;
* ``delete``: takes the turn away.

Turns of a conversation fold on their own, so the log is dealt by conversation and turn, and a
conversation of any length is spread until its messages are put together. Events of an
unknown or null kind say nothing and are left out; a null ``seq`` comes first, and events tied in
seq stand in the order of their texts.

A conversation's messages are then rendered by a template that marks turns with
control strings; the same strings inside a text are escaped reversibly. The
rendered conversation is kept as segments, each with a flag that says whether the
loss covers it, and their concatenation is the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("delta", "edit", "regenerate", "delete")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    r"""``\`` becomes ``\b``, a new line in a header ``\n`` (see ``escaped_role``), ``<|`` becomes ``<\p``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, nth, role, text) from a log of events.

    Deltas before the last edit or regeneration of their turn no longer count for its text.
    The role is that of this last event, or else the first that the turn was given since
    it was last deleted. A null text is empty, as is the role of a turn without any. nth tells turns apart that carry the same
    number (rows that share conv_id, turn and ``part`` belong together). Turns
    whose last word is a deletion are left out. Columns beyond those named are
    ignored; an empty log gives no messages.
    """
    log = events.where(F.col("kind").isin(*KINDS)).select(
        "conv_id", "turn", "nth", F.coalesce(F.col("seq").cast("long"), F.lit(-(2**63))).alias("seq"), "kind",
        "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    of_turn = Window.partitionBy("conv_id", "turn", "nth")
    cut = F.max(F.when(F.col("kind") != "delta", F.struct("seq", "kind", "role"))).over(of_turn)
    deleted = F.max(F.when(F.col("kind") == "delete", F.col("seq"))).over(of_turn)
    opened = F.col("role").isNotNull() & (F.col("_deleted").isNull() | (F.col("seq") > F.col("_deleted")))
    first = F.min(F.when(opened, F.struct("seq", "role"))).over(of_turn)
    role = F.coalesce(F.when(F.col("_cut.kind") != "delete", F.col("_cut.role")), first["role"], F.lit(""))
    alive = log.withColumns({"_cut": cut, "_deleted": deleted}).withColumn("role", role).where(
        F.col("_cut").isNull()
        | ((F.col("_cut.kind") != "delete") & (F.col("seq") >= F.col("_cut.seq")))
        | ((F.col("_cut.kind") == "delete") & (F.col("seq") > F.col("_cut.seq")))
    )
    said = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))))
    return alive.groupBy("conv_id", "turn", "nth").agg(
        F.min("role").alias("role"),  # the same in all rows of the turn
        F.array_join(F.transform(said, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, segments (array of text and loss), formatted_chars.

    Turns stand in the order of (turn, nth). The loss covers the content of
    ``learn_from`` turns, not their marks.
    """
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n"))
    segments = F.array(
        F.struct(head.alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(F.col("text")).alias("text"), (F.col("role") == learn_from).alias("loss")),
        F.struct(F.lit(CLOSE + "\n").alias("text"), F.lit(False).alias("loss")),
    )
    turns = F.array_sort(F.collect_list(F.struct("turn", "nth", segments.alias("segments"))))
    joined = messages.groupBy("conv_id").agg(F.flatten(F.transform(turns, lambda t: t["segments"])).alias("segments"))
    return joined.withColumn("formatted_chars", F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.length(s["text"])))


def formatted(rendered: DataFrame) -> DataFrame:
    """The whole text of each conversation."""
    return rendered.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(rendered: DataFrame) -> DataFrame:
    """Parses formatted texts again: conv_id, turns (array of role and text), learnt, formatted_chars.

    The turns come from the text alone (split at its marks, then unescaped); learnt is
    all text under the loss mask, unescaped.
    """
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    pieces = F.split(whole, "\\Q" + CLOSE + "\n\\E")
    body = F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.substring(p, len(OPEN) + 1, 2147483647),
    )
    turns = F.transform(
        body,
        lambda p: F.struct(
            unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.lit(2147483647))).alias("text"),
        ),
    )
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return rendered.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), F.length(whole).cast("long").alias("formatted_chars"))


def as_events(conversations: DataFrame, piece: int = 256) -> DataFrame:
    """A log of events (conv_id, turn, nth, seq, kind, role, text) that fold into the rows (conv_id, turn, role, text).

    Each text is streamed in deltas of ``piece`` code points. An ``assistant`` turn first streams
    its last and its first piece as a draft and is then regenerated; any other turn opens with its
    last piece, which an edit replaces by the first. Only the first event of a turn names the role. Rows
    that share a turn number become turns of their own (nth), in the order of role and text (nulls first).
    """
    tied = Window.partitionBy("conv_id", "turn").orderBy(F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("nth", F.row_number().over(tied))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    first, last = F.get(F.col("_pieces"), F.lit(0)), F.get(F.col("_pieces"), F.size("_pieces") - 1)
    deltas = lambda own: F.transform(own, lambda x: event("delta", x))
    redone = F.concat(F.array(event("delta", last), event("delta", first), event("regenerate", F.lit(None).cast("string"))), deltas(F.col("_pieces")))
    edited = F.concat(F.array(event("delta", last), event("edit", first)), deltas(F.slice("_pieces", 2, F.greatest(F.size("_pieces"), F.lit(1)))))
    events = F.when(F.col("role") == "assistant", redone).otherwise(edited)
    return rows.withColumn("_pieces", pieces).select("conv_id", "turn", "nth", "role", F.posexplode(events).alias("seq", "_e")).select(
        "conv_id", "turn", "nth", "seq", F.col("_e.kind").alias("kind"), F.when(F.col("seq") == 0, F.col("role")).alias("role"), F.col("_e.text").alias("text"),
    )

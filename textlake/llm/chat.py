"""Chat formatting from event logs, in DataFrame functions only.

A log has rows (conv_id, seq, message, kind, role, text): `delta` appends to a message, `edit` replaces what it holds so far,
`regenerate` empties it. Logs are grouped by conversation and sorted by sequence; a fold makes each message's
final text from its last edit or regeneration on. Messages in order of their first event are then rendered:

    <turn>role
    text
    </turn>

Backslashes in texts are doubled and `<turn`, `</turn` get one in front, so the marks can't occur in a text;
roles also write a line feed as backslash n. The loss mask lists the code point ranges of the assistant texts.

A conversation is the unit of work, as its rendering and its hash cover it whole. Defined results: null roles and texts are empty; rows of equal
turn are separate turns, by role and text; a null conv_id is a conversation of its own; events of unknown kind are
appended. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE = "<turn>", "\n</turn>\n"
ASSISTANT = "assistant"
_MESSAGE = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<turn"), F.lit("\\<turn")), F.lit("</turn"), F.lit("\\</turn"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # parts between doubled backslashes hold single ones only
    single = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\<"), F.lit("<")))
    return F.array_join(single, "\\")


def events_of_rows(rows: DataFrame) -> DataFrame:
    """A streamed log whose messages end as the rows (conv_id, turn, role, text).

    Every text comes in two deltas. Of three messages, one does so at once, one after a wrong draft that an edit replaces by the first part,
    and one after a first part that a regeneration throws away. Events of neighbouring messages are interleaved.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    said = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), place.cast("long").alias("message"))
    half = (F.length("text") / 2).cast("int")
    parts = said.withColumn("one", F.substr("text", F.lit(1), half)).withColumn("two", F.substr("text", half + 1))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    streamed = [event("delta", F.col("one")), event("delta", F.col("two"))]
    edited = [event("delta", F.concat(F.lit("draft "), F.substring("text", 1, 20))), event("edit", F.col("one")), streamed[1]]
    again = [streamed[0], event("regenerate", F.lit("")), *streamed]
    log = F.when(F.col("message") % 3 == 0, F.array(*streamed)).when(F.col("message") % 3 == 1, F.array(*edited)).otherwise(F.array(*again))
    return parts.select("conv_id", "message", "role", F.posexplode(log).alias("at", "e")).select("conv_id", (F.col("message") * 10 + F.col("at") * 13).alias("seq"), "message", "e.kind", "role", "e.text")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, first, role, text) for every message: the state after the log's last event."""
    step = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(step)).alias("log"))
    resets = F.expr("greatest(0, array_max(transform(log, (e, i) -> case when e.kind in ('edit', 'regenerate') then i + 1 else 0 end)))")
    live = F.expr("filter(slice(log, greatest(reset, 1), size(log)), e -> not e.kind <=> 'regenerate')")
    return logs.withColumn("reset", resets).select("conv_id", F.col("log")[0]["seq"].alias("first"), F.col("log")[0]["role"].alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(finals: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss_mask: ranges (start, end) of the assistant texts in code points of formatted."""
    parts = finals.select("conv_id", "first", (F.col("role") == ASSISTANT).alias("loss"), F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    whole = F.length("head") + F.length("body") + len(CLOSE)
    before = Window.partitionBy("conv_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("first", F.concat("head", "body", F.lit(CLOSE)).alias("s"), "loss", F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end"))
    chats = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return chats.select("conv_id", F.array_join(F.transform("turns", lambda t: t["s"]), "").alias("formatted"), F.expr("transform(filter(turns, t -> t.loss), t -> named_struct('start', t.start, 'end', t.end))").alias("loss_mask"))


def parse(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, read back from formatted and loss_mask."""
    parts = F.expr(f"transform(filter(split(formatted, '\\\\n</turn>\\\\n', -1), p -> p <> ''), p -> substring(p, {len(OPEN) + 1}))")
    turns = F.transform("parts", lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))
    loss = F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    return chats.withColumn("parts", parts).select("conv_id", "formatted", "loss_mask", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def format_chats(events: DataFrame) -> DataFrame:
    """Fold, render: conv_id, formatted, loss_mask."""
    return render(messages(events))


def digest(chats: DataFrame) -> DataFrame:
    """The digest columns, from what parse() reads back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parse(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

"""Chat formatting from an event log: fold events into messages, render, read back.

A log row is ``(conv, seq, message, kind, role, text)``: ``start`` opens a message and
gives its role, ``delta`` appends a streamed piece, ``edit`` replaces what the message
holds, ``regenerate`` empties it so that later deltas write it anew. Rows are sorted by
``seq`` within a conversation; messages keep the order in which they were opened.

A message is folded on its own before its conversation is put together, so one task
holds one message, then one rendered conversation, which is a single value by nature.

Defined results: null texts and roles are empty, a message without a start has an empty
role, events of equal seq are ordered by kind, role and text, an empty log has no
conversations, and columns other than the six are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import col

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CLOSE_PATTERN = r"<\|im_end\|>\n"
# Control strings of this and of other templates: a bracket, any backslashes, the rest.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"
LOSS_ROLE = "assistant"
PIECE = 200  # characters of a streamed piece


def escaped(text: Column) -> Column:
    """One backslash more after the bracket of every control string, so none is left."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes and line ends are spelled out."""
    return F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """Read back from left to right, so a spelled-out backslash never joins what follows it."""
    parts = F.regexp_extract_all(role, F.lit(r"\\\\|\\n|[^\\]+|\\"), F.lit(0))
    plain = F.transform(parts, lambda p: F.when(p == "\\\\", "\\").when(p == "\\n", "\n").otherwise(p))
    return unescaped(F.array_join(plain, ""))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: ``(conv, first, message, role, text)``."""
    one = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.select("conv", "message", one.alias("e")).groupBy("conv", "message")
    log = log.agg(F.sort_array(F.collect_list("e")).alias("log"))
    resets = F.transform("log", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(-1)))
    log = log.withColumn("_from", F.array_max(resets))
    live = F.filter("log", lambda e, i: (i >= F.col("_from")) & e["kind"].isin("delta", "edit"))
    roles = F.filter("log", lambda e: e["kind"] == "start")
    return log.select(
        "conv",
        F.col("log")[0]["seq"].alias("first"),
        "message",
        F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """``(conv, segments, formatted)``: segments are ``(text, loss)`` and join to ``formatted``.

    The loss mask covers what the assistant says, without the marks around it.
    """
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    is_loss = F.col("role") == LOSS_ROLE
    parts = F.array(
        F.struct(head.alias("text"), F.lit(False).alias("loss")),
        F.struct(body.alias("text"), is_loss.alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
    )
    rows = messages.select("conv", F.struct("first", "message", parts.alias("parts")).alias("m"))
    rows = rows.groupBy("conv").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    rows = rows.select("conv", F.flatten(F.transform("ms", lambda m: m["parts"])).alias("segments"))
    return rows.select("conv", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def format_log(events: DataFrame) -> DataFrame:
    """The log folded and rendered: one row per conversation."""
    return render(fold(events))


def read_turns(formatted: Column) -> Column:
    """The ``(role, text)`` turns a formatted text holds."""
    pieces = F.filter(F.split(formatted, CLOSE_PATTERN), lambda p: p.startswith(OPEN))
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    role = lambda p: F.substring_index(body(p), "\n", 1)
    text = lambda p: F.substr(body(p), F.length(role(p)) + 2)
    return F.transform(
        pieces, lambda p: F.struct(unescaped_role(role(p)).alias("role"), unescaped(text(p)).alias("text"))
    )


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, each segment once and in order."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescaped(s["text"])), "")


def streamed(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Final messages as the log a chat service would have kept of them.

    Every row opens a message and streams its text in pieces. By a hash of conversation and
    message, some stream a draft of one or several pieces that is regenerated, and some a wrong
    draft that an edit replaces before later pieces follow. The messages of a conversation
    interleave: each event's step counts before its message. Rows of the same turn follow by
    role and text.
    """
    order = Window.partitionBy(col(conv)).orderBy(col(turn), col(role), col(text))
    base = rows.select(
        col(conv).alias("conv"),
        F.row_number().over(order).cast("long").alias("message"),
        F.coalesce(col(role), F.lit("")).alias("role"),
        F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("_pieces"),
    )
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.transform("_pieces", lambda p: event("delta", p))
    kind = F.pmod(F.xxhash64("conv", "message"), F.lit(4))
    again = F.array(event("regenerate", F.lit("")))
    wrong = F.array(event("delta", F.concat(F.lit("no: "), F.reverse(F.coalesce(F.get("_pieces", F.lit(0)), F.lit(""))))))
    edit = F.array(event("edit", F.coalesce(F.get("_pieces", F.lit(0)), F.lit(""))))
    later = F.slice(deltas, 2, F.greatest(F.size("_pieces"), F.lit(1)))
    body = (
        F.when(kind == 0, F.concat(wrong, edit, later))
        .when((kind == 1) & (F.col("role") == LOSS_ROLE), F.concat(F.slice(deltas, 1, 3), again, wrong, again, deltas))
        .when(F.col("role") == LOSS_ROLE, F.concat(F.slice(deltas, 1, 1), again, deltas))
        .otherwise(deltas)
    )
    log = F.concat(F.array(event("start", F.lit(""))), body)
    base = base.select("conv", "message", "role", F.posexplode(log).alias("_step", "_e"))
    seq = F.struct(F.col("_step").alias("step"), F.col("message").alias("message"))
    return base.select(
        "conv",
        seq.alias("seq"),
        "message",
        F.col("_e.kind").alias("kind"),
        F.when(F.col("_e.kind") == "start", F.col("role")).alias("role"),
        F.col("_e.text").alias("text"),
    )

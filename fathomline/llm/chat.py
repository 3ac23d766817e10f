"""Chat logs folded into conversations and rendered, with DataFrame functions only.

A log holds events of one conversation in sequence: a message opens, streamed deltas add to it, an edit
replaces its text, a regeneration empties it for a new stream. Folding gives the final messages, rendering
one string in which control strings inside roles and texts are escaped, with the spans that carry loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The template and every control string it keeps out of roles and texts.
TURN_OPEN, ROLE_CLOSE, TURN_CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# A backslash is doubled, and one is put after the first character of a control string.
EVENTS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """``text`` without control strings; ``unescape`` gives it back."""
    return F.regexp_replace(text, r"(\\|<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): each row opens a message and streams its text.

    ``seq`` orders by turn, then by role and text, nulls first; null roles and texts are empty.
    """
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
            # keeps the two events of a row together where rows repeat; which of equal rows comes first is open
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
        F.explode(F.array(F.lit("message"), F.lit("delta"))).alias("kind"),
    ).select(
        "conv_id", "seq", F.when(F.col("kind") == "message", 0).otherwise(1).alias("step"), "kind",
        F.when(F.col("kind") == "message", F.col("seq.role")).otherwise(F.col("seq.text")).alias("value"),
    )


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, messages): the final messages of each conversation, array<struct<role, text>>.

    Events (conv_id, seq, step, kind, value) are taken in the order of (seq, step). ``message`` opens a
    message with the role ``value``, ``delta`` appends to the open message, ``edit`` replaces its text and
    ``regenerate`` empties it; events before the first message and of other kinds change nothing. Null
    values are empty. Rows without conv_id form one conversation without id.

    A conversation ends up in one string, so one conversation is one row of the shuffle; rows of a
    conversation are combined there and nowhere else.
    """
    log = events.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(F.struct("seq", "step", "kind", F.coalesce("value", F.lit("")).alias("value")))
        ).alias("log")
    )
    # Each message's events lie between its opening and the next: gather them first, so that the work
    # grows with the events and not with the length of what has been folded so far.
    opened = F.filter(
        F.transform("log", lambda e, i: F.when(e["kind"] == "message", i)), lambda i: i.isNotNull()
    )
    bounds = log.withColumn("opened", opened)
    count = F.size("opened")

    def message(at: Column) -> Column:
        first = F.get("opened", at)
        last = F.when(at + 1 < count, F.get("opened", at + 1)).otherwise(F.size("log"))
        own = F.slice("log", first + 2, last - first - 1)
        # what counts begins after the last edit or regeneration
        restart = F.coalesce(
            F.array_max(F.transform(own, lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i))), F.lit(0)
        )
        kept = F.filter(
            F.slice(own, restart + 1, F.greatest(F.size(own) - restart, F.lit(0))), lambda e: e["kind"].isin("delta", "edit")
        )
        return F.struct(
            F.get("log", first)["value"].alias("role"),
            F.array_join(F.transform(kept, lambda e: e["value"]), "").alias("text"),
        )

    indexes = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return bounds.select("conv_id", F.transform(indexes, message).alias("messages"))


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): the rendered string and the spans under the loss mask.

    A span is (start, length) in code points of ``formatted`` and covers the escaped text of one message
    of ``loss_role``. A conversation without messages is an empty string.
    """
    parts = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(TURN_OPEN), escape(m["role"]), F.lit(ROLE_CLOSE)).alias("head"),
            escape(m["text"]).alias("body"),
            (m["role"] == loss_role).alias("loss"),
        ),
    )
    rendered = conversations.select("conv_id", parts.alias("parts")).select(
        "conv_id",
        "parts",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_CLOSE))), "").alias(
            "formatted"
        ),
    )
    close = len(TURN_CLOSE)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate(
        "parts",
        empty,
        lambda state, p: F.struct(
            (state["at"] + F.length(p["head"]) + F.length(p["body"]) + close).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    return rendered.select("conv_id", "formatted", walked["spans"].alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, messages, loss_texts) read back from rendered conversations."""
    turns = F.filter(F.split("formatted", "</s>"), lambda t: t != "")
    messages = F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(TURN_OPEN) + 1)), ROLE_CLOSE, 1)).alias("role"),
            unescape(F.substr(t, F.instr(t, ROLE_CLOSE) + len(ROLE_CLOSE))).alias("text"),
        ),
    )
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "formatted", messages.alias("messages"), loss.alias("loss_texts"))

"""Chat formatting: turns to one training text and its loss mask, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template, once per run of turns with one role:
#: ``<s>role[INST]text[/INST]text ... </s>``.  Inside roles and texts a backslash is
#: doubled and each of these strings gets one after its first character; ``\N``
#: stands for a null role.
OPEN, BODY, NEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
NULL_ROLE = "\\N"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<|\[)(?=/?s>|/?INST\])", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, and ``loss_mask``, an
    array with (skip, take, rest) per turn: lengths in characters that together run
    through ``formatted``; ``take`` is the assistant's text, which the loss covers.

    ``turns`` has conv_id, turn, role, text; other columns are ignored.  Turns are
    sorted by turn, then role, then text (nulls first); repeated rows stay.  Adjacent
    turns of one role share a header.  A null text is empty, a null role is kept as
    such, rows with a null conv_id form one conversation.
    """
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _in_order).alias("turns"))
    t = F.col("turns")
    places = F.sequence(F.lit(0), F.size(t) - 1)
    begins = F.filter(places, lambda i: (i == 0) | ~F.get(t, i)["role"].eqNullSafe(F.get(t, i - 1)["role"]))
    chats = chats.withColumn("begins", begins)
    b = F.col("begins")
    runs = F.transform(b, lambda at, k: F.slice(t, at + 1, F.coalesce(F.get(b, k + 1), F.size(t)) - at))
    pieces = F.flatten(F.transform(F.col("runs"), _pieces))
    chats = chats.withColumn("runs", runs).withColumn("pieces", pieces)
    return chats.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.transform("pieces", lambda p: F.struct(
            (F.length(p["before"]) + F.when(p["loss"], 0).otherwise(F.length(p["text"]))).alias("skip"),
            F.when(p["loss"], F.length(p["text"])).otherwise(0).alias("take"),
            F.length(p["after"]).alias("rest"))).alias("loss_mask"))


def _in_order(x: Column, y: Column) -> Column:
    order = F.lit(0)
    for name in ("text", "role", "turn"):
        a, b = x[name], y[name]
        order = F.when(a.eqNullSafe(b), order).when(a.isNull() | (a < b), -1).otherwise(1)
    return order


def _pieces(run: Column) -> Column:
    """A merged run's turns, each with the marks before and after its text."""
    role = F.get(run, F.lit(0))["role"]
    head = F.concat(F.lit(OPEN), F.coalesce(escape(role), F.lit(NULL_ROLE)), F.lit(BODY))
    return F.transform(run, lambda x, i: F.struct(
        F.when(i == 0, head).otherwise(NEXT).alias("before"), escape(x["text"]).alias("text"),
        F.when(i == F.size(run) - 1, CLOSE).otherwise("").alias("after"),
        F.coalesce(role == "assistant", F.lit(False)).alias("loss")))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    blocks = F.split(formatted, "(?<=</s>)(?=<s>)", -1)

    def of(block: Column) -> Column:
        head = F.substring_index(block, BODY, 1)
        body = F.substr(block, F.length(head) + len(BODY) + 1, F.length(block) - F.length(head) - len(BODY) - len(CLOSE))
        role = F.substr(head, F.lit(len(OPEN) + 1))
        role = F.when(role != NULL_ROLE, unescape(role))
        return F.transform(F.split(body, r"\[/INST\]", -1), lambda text: F.struct(
            role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, of))


def read_loss_text(formatted: Column, loss_mask: Column) -> Column:
    """The text under the loss mask, unescaped and concatenated."""
    pieces = F.split(formatted, r"(?<=</s>)(?=<s>)|(?=\[/INST\])", -1)
    return F.array_join(F.zip_with(pieces, loss_mask, lambda piece, m: unescape(
        F.substr(piece, m["skip"] + 1, m["take"]))), "")

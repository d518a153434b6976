"""Chat formatting by event-sourced reconstruction.

A log has events (conversation, sequence, message, kind, role, text). Logs are
partitioned by conversation and message, sorted by sequence, and folded:
``message`` begins a message, ``delta`` adds to it, ``edit`` replaces its text,
``regenerate`` empties it for new deltas. The final messages are rendered as

    <|turn|>role<|text|>text<|end|>

with each of the signs ``<``, ``[`` and backslash in roles and texts followed by a backslash,
so that no control string, of this template or of others that use such
brackets, survives inside a text, and every text can be read back.

Definitions for odd rows. A null text or role is empty. Null conversations
are one conversation; a null message or sequence sorts first. Events of other
kinds are ignored. Two ``message`` events of one message number are two
messages, in order of sequence, role and text; equal rows too. A delta or an
edit before any ``message`` begins one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_SPECIAL = r"([<\[\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL + r"\\", "$1")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<role, text>>) of events (conv_id, seq, message, kind, role, text)."""
    # texts are kept as the deltas they are made of and joined once, so that a message takes time in proportion to its length
    blank = F.expr("cast(array() as array<struct<role:string,texts:array<string>>>)")
    event = F.struct(F.col("seq"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("kind"))
    one = lambda role, texts: F.struct(role.alias("role"), texts.alias("texts"))

    def fold(done: Column, e: Column) -> Column:
        # done[0] is the newest message
        last, rest = F.get(done, F.lit(0)), F.slice(done, 2, F.greatest(F.size(done), F.lit(1)))
        fresh = (e["kind"] == "message") | (F.size(done) == 0) & e["kind"].isin("delta", "edit")
        changed = F.when(e["kind"] == "delta", F.array_append(last["texts"], e["text"])).when(e["kind"] == "edit", F.array(e["text"])).otherwise(F.array().cast("array<string>"))
        return F.when(fresh, F.concat(F.array(one(e["role"], F.array(e["text"]))), done)).when(e["kind"].isin("delta", "edit", "regenerate") & (F.size(done) > 0), F.concat(F.array(one(last["role"], changed)), rest)).otherwise(done)

    by_message = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("events"))
    by_message = by_message.select("conv_id", "message", F.aggregate("events", blank, fold).alias("parts"))
    whole = F.transform(F.reverse("parts"), lambda m: F.struct(m["role"].alias("role"), F.array_join(m["texts"], "").alias("text")))
    by_message = by_message.select("conv_id", "message", whole.alias("done"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("message").isNotNull().alias("real"), "message", "done")))
    return by_message.groupBy("conv_id").agg(ordered.alias("all")).select("conv_id", F.flatten(F.transform("all", lambda m: m["done"])).alias("messages"))


def render(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>) of (conv_id, messages).

    loss holds the code-point spans of the escaped texts of ``loss_role``.
    """
    parts = F.transform("messages", lambda m: F.struct(F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT)).alias("head"), escape(m["text"]).alias("body"), (m["role"] == loss_role).alias("loss")))
    parted = conversations.select("conv_id", parts.alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    span = "cast(array() as array<struct<start:long,end:long>>)"

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.char_length(p["head"])
        to = at + F.char_length(p["body"])
        return F.struct((to + len(END)).alias("at"), F.when(p["loss"], F.array_append(acc["out"], F.struct(at.alias("start"), to.alias("end")))).otherwise(acc["out"]).alias("out"))

    loss = F.aggregate("parts", F.struct(F.lit(0).cast("long").alias("at"), F.expr(span).alias("out")), step, lambda acc: acc["out"])
    return parted.select("conv_id", formatted.alias("formatted"), loss.alias("loss"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of an event log."""
    return render(messages(events), loss_role)


def parsed(formatted: Column) -> Column:
    """The messages of a formatted conversation: array<struct<role, text>>."""
    cut = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x, i: i > 0)

    def one(x: Column) -> Column:
        return F.struct(unescape(F.substring_index(x, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text"))

    return F.transform(cut, one)


def under_mask(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the mask, one after the other."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")

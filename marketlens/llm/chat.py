"""Chat formatting from an event log.

An event is (conversation, sequence number, message, kind, role, payload). Kinds: ``open`` starts a message
with its role, ``delta`` appends a piece, ``edit`` replaces the text so far, ``regenerate`` drops the
text so far and starts again from its payload, ``delete`` withdraws the message. ``fold`` replays each
message's events in order; ``render`` writes the conversation with turn marks and an assistant loss mask;
``read_back`` recovers turns and masked text from what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = ("conv_id", "seq", "message_id", "kind", "role", "payload")
START, END = "<|im_start|>", "<|im_end|>\n"
TURN = r"<\|im_start\|>([^\n]*)\n([^<]*)<\|im_end\|>\n"


def escape(c: Column) -> Column:
    """No ``<`` or ``[`` is left, so that no control string of this or a bracket template can occur."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def _unrole(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """One row per message that is left: conv_id, message_id, at (its first seq), role, text.

    Events are replayed by seq; equal seqs by kind, then payload. Null payloads are empty, the role is the
    last one named (null: empty). A null conv_id or message_id is a key of its own. A message is one value,
    so its events meet in one task; conversations do not.
    """
    e = events.select(*EVENT_COLUMNS)
    item = F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload"), "role")
    log = e.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(item)).alias("log"), F.min("seq").alias("at"))
    resets = F.filter(F.transform("log", lambda x, i: F.when(x["kind"] == "delta", F.lit(0)).otherwise(i + 1)), lambda i: i > 0)
    live = log.select("conv_id", "message_id", "at", "log", F.greatest(F.coalesce(F.array_max(resets), F.lit(1)), F.lit(1)).alias("from"))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return (
        live.where(F.element_at("log", F.col("from"))["kind"] != "delete")
        .select(
            "conv_id",
            "message_id",
            "at",
            F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise(F.lit("")).alias("role"),
            F.array_join(F.transform(F.slice("log", F.col("from"), F.size("log")), lambda x: x["payload"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start and end code points of the
    text of each ``loss_role`` turn in ``formatted``). A rendered conversation is one value of one row."""
    item = F.struct("at", "message_id", _role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"), (F.col("role") == loss_role).alias("loss"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(START), x["r"], F.lit("\n"), x["t"], F.lit(END))), "")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("spans"))

    def step(acc, x):
        s = acc["at"] + len(START) + F.length(x["r"]) + 1
        e = s + F.length(x["t"])
        span = F.array(F.struct(s.cast("long").alias("s"), e.cast("long").alias("e")))
        return F.struct((e + len(END)).cast("long").alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        text.alias("formatted"),
        F.aggregate("turns", state, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss_spans`` alone: conv_id, turns (role, text) and loss_text."""
    roles = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    pair = lambda r, t: F.struct(_unrole(r).alias("role"), unescape(t).alias("text"))
    masked = F.transform("loss_spans", lambda x: unescape(F.substring(F.col("formatted"), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))))
    return rendered.select("conv_id", "formatted", F.zip_with(roles, texts, pair).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def events_of(rows: DataFrame) -> DataFrame:
    """Stored turns (conv_id, turn, role, text) as a log: one ``open`` per row, by turn, then role, then text."""
    from pyspark.sql import Window as W

    by_turn = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.row_number().over(by_turn).cast("long").alias("seq"),
        F.row_number().over(by_turn).cast("long").alias("message_id"),
        F.lit("open").alias("kind"),
        "role",
        F.col("text").alias("payload"),
    )

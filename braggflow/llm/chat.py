r"""Chat formatting: fold an event log into final messages, then render each conversation.

The log has one row per event: ``message`` (a whole text), ``delta`` (text to append), ``edit`` (a
whole new text) or ``regenerate`` (forget what there was; deltas follow). Events are ordered by
sequence number within a message; a message stands where its first event stands.

A conversation is rendered as ``### role: text</turn>\n`` for each message. Inside texts the strings
``\``, ``###`` and ``</turn>`` become ``\e``, ``\h`` and ``\t``, and in roles ``%``, ``:``, ``<``, ``#``
and line ends are percent-encoded, so no text can forge a mark and ``read_back`` restores every turn
exactly. The loss mask is kept with the string, as one run per turn: code points before, under and
after the mask.

Everything is DataFrame expressions. Messages are folded per message key, then joined to strings in
blocks of consecutive turns, and only then per conversation, so that a conversation with very many
rows is spread over tasks until its one output string is put together.

Defined results: null text and null role count as empty; rows with a null conversation id form one
conversation; events with a null sequence come first; equal sequence numbers are ordered by kind and
text. Repeated rows stay (as turns of their own if their keys differ). Other columns are ignored.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
HEAD = "### "
#: Control string and what stands for it inside a text; the escape character itself comes first.
TEXT_ESCAPES = [("\\", "\\e"), ("###", "\\h"), ("</turn>", "\\t")]
ROLE_ESCAPES = [("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23"), ("\n", "%0A")]


def _escape(text: Column, table: list[tuple[str, str]]) -> Column:
    for plain, coded in table:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def _unescape(text: Column, table: list[tuple[str, str]]) -> Column:
    for plain, coded in reversed(table):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold(events: DataFrame, *, conv: str = "conv_id", message: list[str] | str = "msg_id") -> DataFrame:
    """Final messages (conv, seq, message columns, role, text) of a log with columns seq, kind, role, text."""
    keys = [message] if isinstance(message, str) else list(message)
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    log = events.groupBy(conv, *[k for k in keys if k != "seq"], *(["seq"] if "seq" in keys else [])).agg(
        F.array_sort(F.collect_list(event)).alias("log")
    )
    whole = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(F.lit(1))))
    live = F.slice("log", whole, F.size("log"))
    roles = F.filter(F.col("log"), lambda e: e["role"] != "")
    return log.select(
        conv,
        F.element_at("log", 1)["seq"].alias("seq"),
        *[k for k in keys if k != "seq"],
        F.coalesce(F.try_element_at(roles, F.lit(1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def raw_events(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A plain table of turns as a log of ``message`` events; rows that share a turn become messages of their own."""
    ties = Window.partitionBy(conv, "seq").orderBy("role", "text")
    return (
        rows.select(F.col(conv), F.col(turn).alias("seq"), F.lit("message").alias("kind"), "role", "text")
        .withColumn("tie", F.row_number().over(ties))
    )


def streamed_events(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", loss_role: str = "assistant") -> DataFrame:
    """A table of turns as the log that a chat server would have kept of it, with columns conv, turn, tie, seq, kind, role, text.

    A turn of the loss role is streamed, given up half way, regenerated, and streamed again in three parts; any other turn is
    a draft (the text reversed) and an edit. fold(.., message=["turn", "tie"]) gives the turns back. Eight numbers are left
    for the events of a turn; a null turn comes first; rows that share a turn become messages of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    part = lambda of, k, n: F.substring(of, F.floor(F.length(of) * k / n).cast("int") + 1, F.floor(F.length(of) * (k + 1) / n).cast("int") - F.floor(F.length(of) * k / n).cast("int"))
    event = lambda step, kind, value: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), value.alias("text"))
    nothing = F.lit(None).cast("string")
    streamed = F.array(event(0, "delta", part(text, 0, 2)), event(1, "regenerate", nothing), *[event(2 + k, "delta", part(text, k, 3)) for k in range(3)])
    edited = F.array(event(0, "message", F.reverse(text)), event(1, "edit", text))
    ties = Window.partitionBy(conv, turn).orderBy("role", "text")
    first = F.coalesce(F.col(turn).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)"))
    told = rows.select(conv, F.col(turn).alias("turn"), F.row_number().over(ties).alias("tie"), first.alias("first"), "role", F.when(F.col("role") == loss_role, streamed).otherwise(edited).alias("events"))
    told = told.select(conv, "turn", "tie", "first", "role", F.explode("events").alias("e"))
    return told.select(conv, "turn", "tie", (F.col("first") * 8 + F.col("e.step")).cast("decimal(24,0)").alias("seq"), "e.kind", "role", "e.text")


def render(messages: DataFrame, *, conv: str = "conv_id", tie: str = "tie", loss_role: str = "assistant", block: int = 64) -> DataFrame:
    """(conv, formatted, runs): the string of each conversation and its loss mask, a run (head, body, tail) a turn."""
    role = _escape(F.col("role"), ROLE_ESCAPES)
    body = _escape(F.col("text"), TEXT_ESCAPES)
    head = F.concat(F.lit(HEAD), role, F.lit(": "))
    turns = messages.select(
        conv,
        F.floor(F.col("seq") / block).alias("block"),
        F.struct(
            F.col("seq"),
            F.col(tie),
            F.concat(head, body, F.lit(TURN_END)).alias("turn"),
            F.struct(
                F.length(head).cast("long").alias("head"),
                F.when(F.col("role") == loss_role, F.length(body)).otherwise(F.lit(0)).cast("long").alias("body"),
                (F.lit(len(TURN_END)) + F.when(F.col("role") == loss_role, F.lit(0)).otherwise(F.length(body))).cast("long").alias("tail"),
            ).alias("run"),
        ).alias("t"),
    )
    blocks = turns.groupBy(conv, "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    blocks = blocks.select(
        conv,
        F.struct("block", F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("part"), F.transform("ts", lambda t: t["run"]).alias("runs")).alias("b"),
    )
    whole = blocks.groupBy(conv).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return whole.select(
        conv,
        F.array_join(F.transform("bs", lambda b: b["part"]), "").alias("formatted"),
        F.flatten(F.transform("bs", lambda b: b["runs"])).alias("runs"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The input with two more columns: turns, array<struct<role, text>>, and loss_text, all that the mask covers."""
    pieces = F.split(F.col("formatted"), TURN_END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, ": ")
        role = F.substring(piece, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1))
        return F.struct(
            _unescape(role, ROLE_ESCAPES).alias("role"),
            _unescape(F.substring(piece, at + 2, F.length(piece)), TEXT_ESCAPES).alias("text"),
        )

    def masked(piece: Column, run: Column) -> Column:
        return F.when(run["body"] > 0, _unescape(F.substring(piece, (run["head"] + 1).cast("int"), run["body"].cast("int")), TEXT_ESCAPES)).otherwise(F.lit(""))

    return (
        formatted.withColumn("pieces", pieces)
        .withColumn("turns", F.transform("pieces", turn))
        .withColumn("loss_text", F.array_join(F.zip_with("pieces", "runs", masked), ""))
        .drop("pieces")
    )

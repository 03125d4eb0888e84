"""Chat formatting by event-sourced reconstruction, with DataFrame operations only.

A log holds events of conversations. They are dealt by conversation and message, ordered by sequence
number, and folded into the final messages:

* ``message``, ``edit`` and ``regenerate`` set a message's text anew; what came before is void,
* ``delta`` appends to it (streamed text); one that shares its number with a setting event comes before it,
* a null or unknown kind counts as ``message``.

Then each conversation is rendered by a template that marks turns. In texts and roles the characters
``\\``, ``<`` and ``[``, with which all control strings begin, are escaped, so that no text can imitate a
control string, and unescaping gives the text back.

Large conversations are folded and joined in chunks of CHUNK turns before their chunks meet, so the
task that writes a hot conversation's one string gets a few rows and not all events.

Defined cases: a null text or role is empty; events of one sequence number are ordered by kind, role and
text; a null conversation id is a conversation of its own; messages of one turn number are ordered by
``part``; an empty log gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemql.llm import common

CHUNK = 256
TURN, TEXT, END = "[TURN]", "[TEXT]", "</s>"
TRAINED_ROLE = "assistant"
SETTING = ("message", "edit", "regenerate")


def escape(c: Column) -> Column:
    for plain, code in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in (("<", "\\l"), ("[", "\\b"), ("\\", "\\e")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """Events (conv_id, turn, part, seq, kind, role, text) to messages (conv_id, turn, part, role, text).

    The window sees one message's events at a time. A message's role is that of its last setting event.
    """
    e = common.pick(events, conv_id="conv_id", turn="turn", part="part", seq="seq", kind="kind", role="role", text="text")
    kind = F.when(F.col("kind").isin("delta", *SETTING), F.col("kind")).otherwise(F.lit("message"))
    e = e.withColumns({"kind": kind, "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    key = F.struct("seq", "kind", "role", "text")
    last = F.max(F.when(F.col("kind") != "delta", key)).over(Window.partitionBy("conv_id", "turn", "part"))
    live = e.withColumn("_last", last).where(F.col("_last").isNull() | (key >= F.col("_last")))
    pieces = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    folded = live.groupBy("conv_id", "turn", "part").agg(pieces.alias("p"))
    return folded.select("conv_id", "turn", "part", F.col("p")[0]["role"].alias("role"), F.array_join(F.col("p.text"), "").alias("text"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(TEXT), escape(text), F.lit(END))


def render(messages: DataFrame) -> DataFrame:
    """Messages to (conv_id, formatted), a row per conversation."""
    one = F.struct("turn", "part", "role", render_turn(F.col("role"), F.col("text")).alias("s"))
    chunked = messages.withColumn("_chunk", F.floor(F.col("turn") / CHUNK)).groupBy("conv_id", "_chunk")
    chunks = chunked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), "").alias("s"))
    whole = F.array_sort(F.collect_list(F.struct("_chunk", "s")))
    return chunks.groupBy("conv_id").agg(F.array_join(F.transform(whole, lambda x: x["s"]), "").alias("formatted"))


def format_chat(events: DataFrame) -> DataFrame:
    """Event log to (conv_id, formatted)."""
    return render(fold_events(events))


def message_events(rows: DataFrame) -> DataFrame:
    """A table of whole messages (conv_id, turn, role, text) as a log; rows of one turn are messages of their own."""
    r = common.pick(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    part = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).cast("long")
    return r.withColumns({"part": part, "seq": F.col("turn"), "kind": F.lit("message")})


def parse(formatted: Column) -> Column:
    """A formatted conversation back to an array of (role, text)."""
    turns = F.split(formatted, END)

    def turn(s: Column) -> Column:
        body = F.substr(s, F.lit(len(TURN) + 1))
        at = F.instr(body, TEXT)
        role = F.substr(body, F.lit(1), at - 1)
        text = F.substr(body, at + len(TEXT))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(turns, 1, F.size(turns) - 1), turn)


def loss_texts(turns: Column, role: str = TRAINED_ROLE) -> Column:
    """The texts under the loss mask: those of the trained role, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"])


def loss_spans(formatted: DataFrame) -> DataFrame:
    """(conv_id, start, end): code-point spans of the formatted text that training takes its loss from."""
    turns = F.split(F.col("formatted"), END)
    sliced = F.slice(turns, 1, F.size(turns) - 1)
    at = formatted.select("conv_id", F.posexplode(sliced).alias("i", "s"))
    w = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("s") + len(END)).over(w), F.lit(0))
    head = F.instr(F.col("s"), TEXT) - 1 + len(TEXT)
    spans = at.select("conv_id", "s", (before + head).alias("start"), (before + F.length("s")).alias("end"))
    return spans.where(F.col("s").startswith(f"{TURN}{TRAINED_ROLE}{TEXT}")).select("conv_id", "start", "end")


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations: counts and hex digests, a row per conversation."""
    back = formatted.withColumn("_turns", parse(F.col("formatted"))).withColumn("_loss", F.array_join(loss_texts(F.col("_turns")), ""))
    told = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

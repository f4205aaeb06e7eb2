"""Chat formatting from event logs.

A log has one row per event: a conversation, a sequence number, the message it belongs to, a role, a kind and a
text.  ``delta`` appends to the message, ``edit`` replaces what it said so far, ``regenerate`` starts it
anew.  The events of a message are folded in the order of their sequence numbers, the messages of a conversation
are ordered by their first event, and the conversation is rendered with a template:

    ### assistant: text</turn>

Backslash, ``#`` and ``<`` in a text (and ``:`` in a role) are preceded by a backslash, and the ``<`` of a
``</turn>`` before a line end is written as a backslash and ``l``, so no text can contain a control string, and
unescaping gives the text back exactly.  ``mask`` holds the assistant texts as spans of the formatted
string: start in code points, and the turn and the offset in it.

DataFrame functions only.  The events of a conversation need one shuffle, by conversation and message; a
conversation becomes one string at the very end, which is what a formatted example is: its size is
bounded by Spark's limit for a value.  Offsets are running sums, so long conversations cost no
more a turn than short ones.

Defined cases: a null text is empty; a null role is empty and not in the mask; rows without a conversation form
one conversation; a null sequence number comes first, ties follow role, text and place in the input;
repeated rows of a table of turns are turns of their own; a conversation of any length is one value, up to Spark's 2 GB for
a value; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augury.llm.common import query, table

END = "</turn>\n"
LEARNED = "assistant"


def escaped(text: Column, characters: str = r"\\#<") -> Column:
    # A backslash alone would leave END in the text. The one before a '<' is always its own.
    marked = F.regexp_replace(text, f"([{characters}])", r"\\$1")
    return F.replace(marked, F.lit("\\" + END), F.lit("\\l" + END[1:]))


def unescaped(text: Column) -> Column:
    # An 'l' is an escaped '<' only after an odd number of backslashes.
    marked = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*+)\\l", r"$1\\<")
    return F.regexp_replace(marked, r"\\([\\#<:])", "$1")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, seq, role, text): final messages of events(conv_id, seq, message, role, kind, text).

    seq and role are those of the message's first event."""
    reset = F.col("kind").isin("edit", "regenerate")
    by = Window.partitionBy("conv_id", "message").orderBy("seq", "role", "kind", "text")
    events = events.select("conv_id", "seq", "message", "role", "kind", "text")
    versions = events.withColumn("version", F.count(F.when(reset, 1)).over(by))
    # The events of the last version, in order; earlier versions are dropped before anything is collected.
    last = F.max("version").over(Window.partitionBy("conv_id", "message"))
    first = F.first(F.struct("seq", "role")).over(by)
    current = versions.withColumn("last", last).withColumn("first", first).where("version = last")
    parts = F.sort_array(F.collect_list(F.struct("seq", "role", "kind", F.coalesce("text", F.lit("")).alias("text"))))
    return (
        current.groupBy("conv_id", "message")
        .agg(F.first("first").alias("first"), F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text"))
        .select("conv_id", "message", "first.seq", "first.role", "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): mask is array<struct<start, turn, at, length>>."""
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit("### "), escaped(role, r"\\#<:"), F.lit(": "))
    rows = messages.select("conv_id", "seq", "message", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    rows = rows.withColumn("at", F.length("head")).withColumn("length", F.length("body"))
    by = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "message")
    size = F.col("at") + F.col("length") + len(END)
    rows = rows.withColumn("start", F.sum(size).over(by) - size + F.col("at")).withColumn("turn", F.row_number().over(by) - 1)
    span = F.when(F.col("role") == LEARNED, F.struct(F.col("start").cast("long").alias("start"), "turn", "at", "length"))
    piece = F.struct("turn", F.concat("head", "body", F.lit(END)).alias("piece"))
    return rows.groupBy("conv_id").agg(
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["piece"])).alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learned): roles and texts, and the text under the mask, from the output alone."""
    # A formatted string ends with END, so the last piece of the split is empty.
    pieces = F.split("formatted", END)
    rows = formatted.withColumn("pieces", F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, r"(?s)^### ((?:\\.|[^:\\])*+): ", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(piece, F.length(role) + 7, F.length(piece))).alias("text"))

    learned = F.transform("mask", lambda m: unescaped(F.substring(F.get("pieces", m["turn"]), m["at"] + 1, m["length"])))
    return rows.select("conv_id", F.transform("pieces", turn).alias("turns"), F.concat_ws("", learned).alias("learned"), "formatted")


SAMPLE = r"\### Assistant: </turn> ok"


def turn_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log in which every row is a message of one delta."""
    return conversations.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.monotonically_increasing_id().alias("message"),
        "role",
        F.lit("delta").alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)
), k AS (SELECT *, role = 'assistant' AS learned FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE learned), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE learned), '')) AS loss_sha256,
       sum(4 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + 2
           + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 8)::BIGINT AS formatted_chars
FROM k GROUP BY conv_id
"""


@query("op8_chat", ORACLE)
def op8_chat(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SAMPLE).alias("text"),
    )
    back = read_back(render(fold(turn_events(given.unionByName(extra)))))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

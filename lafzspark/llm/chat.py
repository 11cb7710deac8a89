"""Chat formatting: conversations become training examples of which only one reply is trained.

Method: prefix-target expansion. Every assistant turn gives an example whose text is all turns before it and the
reply; the loss mask covers the reply's text alone. Turns behind the last assistant turn (or a conversation without
one) give one more example without a mask, so that the output holds every turn.

A turn is written "### role: text</turn>" and a newline. In roles and texts a backslash becomes \\b, "<" \\l, "#" \\h,
and in roles ":" \\c, so no text can look like a mark and each can be read back.

All of it is DataFrame functions: one shuffle brings a conversation's turns together, because each example needs them
in order. The text of n replies is as long as n prefixes: that is the method's output, and is made row by row behind
the explode, never held together. A conversation's own turns must fit in a task.

Defined cases: rows of equal turn are ordered by role, then text, nulls first; a null turn comes first; a null role or
text is empty; a null conv_id is a conversation; repeated rows are turns of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"


def escaped(x: Column, role: bool = False) -> Column:
    for raw, code in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), *(((":", "\\c"),) if role else ())):
        x = F.replace(x, F.lit(raw), F.lit(code))
    return x


def unescaped(x: Column) -> Column:
    for raw, code in (("<", "\\l"), ("#", "\\h"), (":", "\\c"), ("\\", "\\b")):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role, True), F.lit(": "))


def chat_examples(
    turns: DataFrame, target: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id, example (from 1), n_turns, text, loss_start and loss_length (code points; length null: nothing to train)."""
    c = lambda name: F.col(f"`{name}`")
    empty = F.lit("")
    rows = turns.select(c(conv_col).alias("conv_id"), c(turn_col).alias("turn"), F.coalesce(c(role_col).cast("string"), empty).alias("role"), F.coalesce(c(text_col).cast("string"), empty).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    written = F.transform("turns", lambda t: F.concat(_head(t["role"]), escaped(t["text"]), F.lit(CLOSE)))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.element_at("turns", i)["role"] == target) | (i == F.size("turns")))
    examples = convs.select("conv_id", "turns", written.alias("parts"), F.posexplode(ends).alias("at", "n_turns"))
    last = F.element_at("turns", F.col("n_turns"))
    context = F.array_join(F.slice("parts", F.lit(1), F.col("n_turns") - 1), "")
    examples = examples.select("conv_id", (F.col("at") + 1).alias("example"), "n_turns", context.alias("context"), F.element_at("parts", F.col("n_turns")).alias("reply"), last.alias("last"))
    return examples.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("context", "reply").alias("text"),
        (F.length("context") + F.length(_head(F.col("last.role")))).alias("loss_start"),
        F.when(F.col("last.role") == target, F.length(escaped(F.col("last.text")))).alias("loss_length"),
    )


def trained_text(text: Column, start: Column, length: Column) -> Column:
    """What an example's mask covers, as the conversation had it."""
    return unescaped(F.when(length > 0, F.substring(text, start + 1, length)).otherwise(F.lit("")))


def parsed(text: Column) -> Column:
    """An example's turns again: array of (role, text)."""
    parts = F.split(text, F.lit(CLOSE))
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(p: Column) -> Column:
        cut = F.instr(p, ": ")
        role = F.substring(p, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(p, cut + 2, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def op8(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    examples = chat_examples(turns.union(extra))
    loss = trained_text(F.col("text"), F.col("loss_start"), F.col("loss_length"))
    convs = examples.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))).alias("losses"),
        F.max_by("text", "example").alias("whole"),
        F.sum(F.length("text").cast("long")).alias("formatted_chars"),
    )
    convs = convs.select("conv_id", parsed(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return convs.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(read, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS m,
      16 - 3 + length(role) + length(text) + (length(role) - length(translate(role, '\<#:', ''))) + (length(text) - length(translate(text, '\<#', ''))) + 1 AS c FROM t),
p AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR i = m), 0)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

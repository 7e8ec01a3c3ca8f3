"""Prefix-target expansion of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """A text in which no mark can be forged: every ``<|`` of it is written ``<||``."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def prefix_target(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, n_context, text, train_start, train_end): one example for every assistant turn.

    ``text`` is all preceding turns of the conversation and then the reply, each as ``<|role|>``, newline, text,
    newline, ``<|end|>``, newline. Only characters [train_start, train_end) are trainable: the reply and its end mark.

    * Turns are in the order of (turn, role, text), nulls first; equal turns are all used.
    * A null text is an empty turn. An empty reply is an example too, of which the end mark is trainable.
    * A null role is written as ``unknown`` and never trained. In a role, ``|``, ``<`` and ``>`` are written as ``_``.
    * ``<|`` in a text is written ``<||``, so that a text can't contain a mark.
    * Rows without a conversation are a conversation each, without any context.
    * Further columns are not used, whatever their names. An empty table gives no rows.
    """
    role = F.translate(F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")), "|<>", "___")
    body = escaped(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    turns = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("__role"), body.alias("__text"), F.col(role_col).eqNullSafe(target_role).alias("__target"))
    head = F.concat(F.lit("<|"), F.col("__role"), F.lit("|>\n"))
    prompt = lambda before: F.concat(F.array_join(before, ""), head)
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "__role", "__text").rowsBetween(Window.unboundedPreceding, -1)
    context = F.collect_list(F.concat(head, F.col("__text"), F.lit("\n<|end|>\n")))
    inside = turns.where("conv_id IS NOT NULL").withColumn("__before", context.over(w)).where("__target")
    # Lone turns are never gathered.
    lone = turns.where("conv_id IS NULL AND __target").withColumn("__before", F.array().cast("array<string>"))
    target = inside.unionByName(lone).select("conv_id", "turn", F.size("__before").cast("long").alias("n_context"), prompt(F.col("__before")).alias("__prompt"), "__text")
    start = F.length("__prompt").cast("long")
    return target.select("conv_id", "turn", "n_context", F.concat("__prompt", "__text", F.lit("\n<|end|>\n")).alias("text"), start.alias("train_start"), (start + F.length("__text") + 8).cast("long").alias("train_end"))


SQL = r"""
WITH t AS (SELECT conv_id, turn, role = 'assistant' AS target, translate(coalesce(role, 'unknown'), '|<>', '___') AS role, replace(coalesce(text, ''), '<|', '<||') AS text FROM conversations),
s AS (SELECT *, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '') OVER w, '') AS before, count(*) OVER w AS n_context
  FROM t WHERE conv_id IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT *, '', 0 FROM t WHERE conv_id IS NULL),
p AS (SELECT conv_id, turn, n_context, before || '<|' || role || '|>' || chr(10) AS prompt, text FROM s WHERE target)
SELECT conv_id, turn, n_context, prompt || text || chr(10) || '<|end|>' || chr(10) AS text, length(prompt) AS train_start, length(prompt) + length(text) + 8 AS train_end FROM p
"""

"""Harmonic packing of documents into training sequences of a fixed capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import with_position

CAPACITY, BLOCK_ROWS = 2048, 1 << 16
#: Runs of anything but these are words; the same class works in Java's and RE2's regular expressions.
WORD = r"[^ \t\n\r\f]+"


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, place): the words of every row, and its place in the order of both."""
    n = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return with_position(docs.select(F.col(id_col).cast("long").alias("doc_id"), n.alias("n")), ["doc_id", "n"], "place")


def harmonic_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, piece, start, n_tokens, class, bin_id, slot): the bin and place of every piece of every document.

    A piece of n words is of class j = capacity div n, so that n is in (capacity / (j + 1), capacity / j], and a bin of
    class j takes exactly j pieces of its class; only the last bin of a class may hold fewer. Classes are filled
    separately for each block of ``block_rows`` rows in the order of (id, words), so workers need no common state and no
    class is one task, and blocks are full however the ids lie.

    * Texts longer than the capacity are cut into full pieces and a rest; nothing is dropped.
    * Null, empty and blank texts have one row with n_tokens 0 and no class, bin or slot.
    * Null ids come first and are numbered as others are. Repeated rows are packed each; which of equal rows gets which
      slot is open, the set of rows is not.
    * Other columns of ``docs`` are not used, whatever their names. An empty table gives no rows.
    """
    placed = lengths(docs, id_col, text_col)
    last = F.greatest(F.expr(f"(n - 1) div {capacity}"), F.lit(0).cast("long"))
    cut = placed.select("doc_id", "n", F.expr(f"place div {block_rows}").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * capacity
    sized = cut.withColumns({"start": start, "n_tokens": F.least(F.lit(capacity).cast("long"), F.col("n") - start)}).withColumn("class", F.expr(f"CASE WHEN n_tokens > 0 THEN {capacity} div n_tokens END"))
    w = Window.partitionBy("block", "class").orderBy("doc_id", "piece", "n_tokens", "n")
    ranked = sized.withColumn("at", (F.row_number().over(w) - 1).cast("long"))
    full = F.col("class").isNotNull()
    name = F.concat_ws("-", F.col("block").cast("string"), F.col("class").cast("string"), F.expr("at div class").cast("string"))
    return ranked.select("doc_id", "piece", "start", "n_tokens", "class", F.when(full, name).alias("bin_id"), F.when(full, F.expr("at % class")).alias("slot"))


SQL = rf"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
b AS (SELECT *, (row_number() OVER (ORDER BY doc_id NULLS FIRST, n) - 1) // {BLOCK_ROWS} AS block FROM n),
cut AS (SELECT doc_id, n, block, unnest(range(greatest((n - 1) // {CAPACITY}, 0) + 1)) AS piece FROM b),
p AS (SELECT doc_id, n, block, piece, piece * {CAPACITY} AS start, least({CAPACITY}, n - piece * {CAPACITY}) AS n_tokens FROM cut),
c AS (SELECT *, CASE WHEN n_tokens > 0 THEN {CAPACITY} // n_tokens END AS class FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY block, class ORDER BY doc_id NULLS FIRST, piece, n_tokens, n) - 1 AS pos FROM c)
SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(start AS BIGINT) AS start, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(class AS BIGINT) AS class,
  CASE WHEN class IS NOT NULL THEN concat_ws('-', block::VARCHAR, class::VARCHAR, (pos // class)::VARCHAR) END AS bin_id,
  CASE WHEN class IS NOT NULL THEN CAST(pos % class AS BIGINT) END AS slot
FROM r
"""

"""Blocks of rows: vertical format, sentence joining, and the table of a sentence's tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..corpus import WHITE, tokens
from ..functions.tokenization import sentences


def strip(c: str | Column) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, f"^{WHITE}|{WHITE}$", "")


def with_block(df: DataFrame, group: Sequence[str], order: Sequence[str], is_end: Column, name: str = "block") -> DataFrame:
    """Numbers the blocks of each group; an end row belongs to the block that it closes."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(is_end.cast("long")).over(w), F.lit(0)))


def join_vertical(df: DataFrame, group: Sequence[str], order: Sequence[str], column: str = "line", end_marker: str = "") -> DataFrame:
    """One row a block: its stripped lines joined by spaces. Two end rows in turn make an empty one; a rest is a block."""
    end = strip(column) == end_marker
    rows = with_block(df.withColumn("__line", strip(column)), group, order, end)
    words = F.collect_list(F.when(F.col("__line") != end_marker, F.struct(*order, "__line")))
    return rows.groupBy(*group, "block").agg(F.array_join(F.transform(F.array_sort(words), lambda x: x["__line"]), " ").alias(column))


def single_surface_column(df: DataFrame, column: str = "line") -> DataFrame:
    """Every token in a row of its own (``part``), and an empty row after each line."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(F.concat(tokens(column), F.array(F.lit("")))).alias("part", column))


def extract_column(df: DataFrame, index: int, group: Sequence[str], order: Sequence[str], column: str = "line", sep: str = "\t") -> DataFrame:
    """The values of one column, joined into a line for every block between empty rows."""
    rows = with_block(df, group, order, F.col(column) == "").where(F.col(column) != "")
    value = F.split(F.col(column), sep, -1)[index]
    return rows.groupBy(*group, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]), " ").alias(column))


def segment_sentences(df: DataFrame, column: str = "line") -> DataFrame:
    """A row for each sentence of a line, numbered in ``part``."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(sentences(column)).alias("part", column))


def join_lines(lines: list[str], max_chars: int = 75, most_chars: int = 500, most_tokens: int = 100) -> list[str]:
    """Joins runs of short continuation lines with `` ▁``.

    A line takes part if it has at most ``max_chars`` characters and more than one token and, unless it is the first of
    its run, doesn't start upper-case. A full stop ends the run. A run that gets too long stays apart. An empty line
    takes no part.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ▁".join(run)
        out.extend(run if len(text) > most_chars or len(text.split()) > most_tokens else [text] if run else [])
        run.clear()

    for line in lines:
        if not line or len(line) > max_chars or len(line.split()) == 1 or (run and line[0].isupper()):
            flush()
            out.append(line)
        else:
            run.append(line)
            if line[-1] in ".!?":
                flush()
    flush()
    return out


def join_sentences(df: DataFrame, group: str, order: str, column: str = "line") -> DataFrame:
    """``join_lines`` over the lines of each group, of which one at a time is held; ``part`` numbers the new lines."""
    kind = df.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, some = None, [], None
        groups, parts, texts = [], [], []

        def flush() -> None:
            made = join_lines(lines)
            groups.extend([now] * len(made))
            parts.extend(range(len(made)))
            texts.extend(made)
            lines.clear()

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(groups, some), pa.array(parts, pa.int64()), pa.array(texts, pa.string())], names=[group, "part", column])
            for x in (groups, parts, texts):
                x.clear()
            return out

        for batch in batches:
            some = batch.schema.field(0).type
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lines and g != now and (g == g or now == now):  # a NaN is no other than a NaN
                    flush()
                now = g
                lines.append(text)
            yield batch_of()
        flush()
        if some is not None:
            yield batch_of()

    rows = df.select(group, order, F.coalesce(column, F.lit("")).alias(column)).repartition(group).sortWithinPartitions(group, F.col(order).asc_nulls_last())
    return rows.select(group, column).mapInArrow(run, f"{group} {kind}, part long, {column} string")

"""Ordered corpora as DataFrames: every row carries its order key."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

#: White space as Python's ``str.split`` has it; Java's Unicode \s lacks the four separators.
WHITE = r"(?U)[\s\x{1c}-\x{1f}]+"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line): texts cut at newlines; line_no is 0-based within the text. A null text has no lines."""
    return df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))


def tokens(line: str | Column) -> Column:
    """Tokens between runs of white space."""
    return F.filter(F.split(col(line), WHITE), lambda t: t != "")


def tables(spark: SparkSession, sf: str):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def with_position(df: DataFrame, order: list[str], name: str = "position", start: int = 0) -> DataFrame:
    """Adds the 0-based place of each row in the whole order.

    One exchange cuts the rows into ranges of the order key, each of which a task sorts, numbers and writes to the shared
    folder. The ranges' sizes, one number a task, give the place of every range's first row.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed = stored(numbered, "places")
    # An id of Spark's is the number of the task in the upper bits and that of the row in the lower 33.
    task, row = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["task"]: r["count"] for r in placed.groupBy(task.alias("task")).count().collect()}
    before = list(accumulate((sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)), initial=start))
    bases = F.expr("array(" + ",".join(f"{n}L" for n in before) + ")")
    return placed.withColumn(name, F.element_at(bases, (task + 1).cast("int")) + row)

"""The stateless functions over a stream of lines, and running counts over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import tokens


def stream_lines(spark: SparkSession, folder: str, column: str = "line") -> DataFrame:
    """Lines of the text files that arrive in a folder."""
    return spark.readStream.text(folder).withColumnRenamed("value", column)


def apply_cells(stream: DataFrame, functions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Any cell function works on a stream as on a table."""
    return stream.withColumns({c: f(F.col(c)) for c, f in functions.items()})


def remove(stream: DataFrame, predicate: Column) -> DataFrame:
    return stream.where(~F.coalesce(predicate, F.lit(False)))


def running_counts(stream: DataFrame, column: str = "line") -> DataFrame:
    """(word, count) so far; write it in update or complete mode."""
    return stream.select(F.explode(tokens(column)).alias("word")).groupBy("word").count()


def first_within(stream: DataFrame, time_col: str, delay: str, columns: list[str]) -> DataFrame:
    """Drops lines that came before within the watermark, so that the state stays bounded."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(columns)

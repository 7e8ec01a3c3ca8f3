"""Columns inside of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_quote
from .order import safe_zip


def split_columns(df: DataFrame, names: Sequence[str], column: str = "line", delimiter: str = "\t") -> DataFrame:
    """Cuts the line into named columns; another number of parts is an error."""
    parts = F.split(F.col(column), java_quote(delimiter) if delimiter != "\t" else "\t", -1)
    checked = F.when(F.col(column).isNull() | (F.size(parts) == len(names)), parts).otherwise(F.raise_error(F.concat(F.lit(f"not {len(names)} columns: "), F.col(column))))
    return df.withColumn("__parts", checked).withColumns({n: F.col("__parts")[i] for i, n in enumerate(names)}).drop("__parts")


def paste_columns(dfs: Sequence[DataFrame], keys: Sequence[str], delimiter: str = "\t", column: str = "line") -> DataFrame:
    """Aligned tables side by side, their lines joined by the delimiter."""
    both = safe_zip(dfs, list(keys), column)
    return both.select(*keys, F.concat_ws(delimiter, *[F.coalesce(f"c{i}", F.lit("")) for i in range(len(dfs))]).alias(column))

"""Exact de-duplication of lines, over one column or several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deduplicate(df: DataFrame, order: Sequence[str], columns: Sequence[str] = ("line",), truncate: int = 30) -> DataFrame:
    """Drops repeated lines: of the lines that occur more than once, the first with each prefix of ``truncate`` characters stays.

    Lines that occur once are never removed, even if their prefix was seen. Several columns are stages: a column's
    seen prefixes are those of rows that earlier columns did not remove.

    Occurrences are counted by aggregation on a hash of the line and joined back, so that a very frequent line is one
    row of the counts; only repeated lines are then ranked within their prefix.
    """
    out = df
    for c in columns:
        digest = F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
        repeated = df.groupBy(digest.alias("__h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__h", F.lit(True).alias("__many"))
        flagged = out.withColumn("__h", digest).join(repeated, "__h", "left")
        prefix = F.substring(F.coalesce(F.col(c), F.lit("")), 1, truncate)
        # Of equal prefixes only the least key matters: an aggregate, which combines before the exchange.
        keys = F.struct(*order)
        first = flagged.where("__many").groupBy(prefix.alias("__p")).agg(F.min(keys).alias("__first"))
        kept_keys = first.select(*[F.col(f"__first.{k}").alias(k) for k in order], F.lit(True).alias("__keep"))
        out = flagged.join(kept_keys, list(order), "left").where(F.col("__many").isNull() | F.col("__keep")).drop("__h", "__many", "__keep")
    return out

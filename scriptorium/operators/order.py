"""Operators that depend on the order of rows: slices, shards, interleaving, sorting, sampling, zips and masks.

``order`` names the key columns. Positions come from ``corpus.with_position``, which needs no single-task window for
large tables; slices from an end are top-n plans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import with_position

Order = Sequence[str]


def head(df: DataFrame, n: int, order: Order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def skip(df: DataFrame, n: int, order: Order) -> DataFrame:
    """All but the first n rows."""
    return with_position(df, list(order), "__at").where(F.col("__at") >= n).drop("__at")


def slice_rows(df: DataFrame, start: int, end: int, order: Order) -> DataFrame:
    """Rows [start, end)."""
    return df.orderBy(*order).limit(end).orderBy(*order).offset(start)


def last(df: DataFrame, n: int, order: Order) -> DataFrame:
    """The last n rows, in order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def head_tee(df: DataFrame, n: int, order: Order) -> tuple[DataFrame, DataFrame]:
    """(all rows, the first n)."""
    return df, head(df, n, order)


def slice_tee(df: DataFrame, start: int, end: int, order: Order) -> tuple[DataFrame, DataFrame]:
    return df, slice_rows(df, start, end, order)


def skip_tee(df: DataFrame, n: int, order: Order) -> tuple[DataFrame, DataFrame]:
    return df, skip(df, n, order)


def round_robin(df: DataFrame, shard: int, shards: int, order: Order) -> DataFrame:
    return with_position(df, list(order), "__at").where(F.col("__at") % shards == shard).drop("__at")


def de_round_robin(dfs: Sequence[DataFrame], order: Order, multipliers: Sequence[int] | None = None) -> DataFrame:
    """Interleaves tables, ``multipliers`` rows of each in turn, with the new place in ``position``.

    A table that has ended is passed over; the others go on in turn.
    """
    many = multipliers or [1] * len(dfs)
    if len(many) != len(dfs):
        raise ValueError("a multiplier for each table")
    placed = [with_position(d, list(order), "__at").withColumns({"__turn": F.expr(f"__at div {m}"), "__src": F.lit(i), "__in": F.expr(f"__at % {m}")}) for i, (d, m) in enumerate(zip(dfs, many))]
    union = reduce(lambda a, b: a.unionByName(b), placed)
    return with_position(union, ["__turn", "__src", "__in"]).drop("__at", "__turn", "__src", "__in")


def concatenate(dfs: Sequence[DataFrame]) -> DataFrame:
    """All rows of the tables, in order of (file_idx, the tables' own keys)."""
    return reduce(lambda a, b: a.unionByName(b), [d.withColumn("file_idx", F.lit(i)) for i, d in enumerate(dfs)])


def shuffle(df: DataFrame, order: Order, seed: int = 1) -> DataFrame:
    """A uniform shuffle, by the MD5 of the seed and the keys with ``-`` between them; the new place is ``position``."""
    keyed = df.withColumn("__draw", F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in order])))
    return with_position(keyed, ["__draw", *order]).drop("__draw")


def upsample(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, the copies numbered in ``copy``."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")) if n > 0 else df.withColumn("copy", F.lit(0)).limit(0)


def chunk_split(df: DataFrame, size: int, order: Order) -> DataFrame:
    """Adds ``chunk``, the number of the run of ``size`` rows: write with ``partitionBy("chunk")``."""
    return with_position(df, list(order), "__at").withColumn("chunk", F.expr(f"__at div {size}")).drop("__at")


def split_dataset(df: DataFrame, order: Order, dev_size: int = 0, test_size: int = 0, train_size: int | None = None, seed: int = 1) -> dict[str, DataFrame]:
    """Shuffles, then cuts dev, test and train off in this order, of exact sizes; train is the rest unless sized."""
    mixed = shuffle(df, order, seed)
    at, first = F.col("position"), dev_size + test_size
    end = at < first + train_size if train_size is not None else F.lit(True)
    return {"dev": mixed.where(at < dev_size), "test": mixed.where((at >= dev_size) & (at < first)), "train": mixed.where((at >= first) & end)}


def split_dataset_para(dfs: Sequence[DataFrame], order: Order, dev_size: int = 0, test_size: int = 0, train_size: int | None = None, seed: int = 1) -> list[dict[str, DataFrame]]:
    """``split_dataset`` of parallel tables with the same keys: a row goes to the same split and place in all of them.

    A key that one of the tables lacks is an error, as in ``safe_zip``.
    """
    packed = [d.select(*order, F.struct(*d.columns).alias("line")) for d in dfs]
    split = split_dataset(safe_zip(packed, list(order)), order, dev_size, test_size, train_size, seed)
    return [{part: rows.select(f"c{i}.*", "position") for part, rows in split.items()} for i in range(len(dfs))]


def sort_rows(df: DataFrame, key: Column, order: Order, reverse: bool = False) -> DataFrame:
    """A stable sort: ties stay in the old order, with ``reverse`` too. The new place is ``position``."""
    kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
    if reverse and kind in ("string", "binary", "boolean"):
        return df.withColumn("__key", key).orderBy(F.desc("__key"), *order).drop("__key")
    keyed = df.withColumn("__key", -key if reverse else key)
    return with_position(keyed, ["__key", *order]).drop("__key")


def sort_by_length(df: DataFrame, order: Order, column: str = "line", reverse: bool = False) -> DataFrame:
    return sort_rows(df, F.length(column), order, reverse)


def reversed_rows(df: DataFrame, order: Order) -> DataFrame:
    """Last row first."""
    return df.orderBy(*[F.desc(c) for c in order])


def line_numbers(df: DataFrame, order: Order, start: int = 0, column: str = "line") -> DataFrame:
    """Puts the number of the row and a space before the line."""
    return with_position(df, list(order), "__at", start).withColumn(column, F.concat_ws(" ", F.col("__at").cast("string"), F.col(column))).drop("__at")


def safe_zip(dfs: Sequence[DataFrame], keys: list[str], column: str = "line", strict: bool = True) -> DataFrame:
    """One row for each key with the lines of all tables as c0, c1, ...; a key that a table lacks is an error."""
    named = [d.select(*keys, F.col(column).alias(f"c{i}"), F.lit(True).alias(f"__has{i}")) for i, d in enumerate(dfs)]
    out = reduce(lambda a, b: a.join(b, keys, "full_outer"), named)
    has = [F.col(f"__has{i}") for i in range(len(dfs))]
    if strict:
        short = F.coalesce(*[F.when(h.isNull(), F.lit(f"c{i}")) for i, h in enumerate(has)])
        checked = F.when(short.isNotNull(), F.raise_error(F.concat(F.lit("columns are not aligned, short: "), short))).otherwise(F.lit(True))
        return out.where(checked).drop(*[f"__has{i}" for i in range(len(dfs))])
    return out.where(reduce(lambda a, b: a & b, [h.isNotNull() for h in has])).drop(*[f"__has{i}" for i in range(len(dfs))])


# --- masks ------------------------------------------------------------------------------------------------------------


def filter_mask(df: DataFrame, predicate: Column, keys: Sequence[str]) -> DataFrame:
    """(keys, remove): the decision on each row, to be applied later."""
    return df.select(*keys, F.coalesce(predicate, F.lit(False)).alias("remove"))


def combine_masks(masks: Sequence[DataFrame], keys: Sequence[str], func: Callable[[Column], Column] = lambda m: m) -> DataFrame:
    """A row is removed if ``func`` of any mask is true."""
    union = reduce(lambda a, b: a.unionByName(b), [m.select(*keys, F.coalesce(func(F.col("remove")), F.lit(False)).alias("remove")) for m in masks])
    return union.groupBy(*keys).agg(F.bool_or("remove").alias("remove"))


def apply_mask(df: DataFrame, masks: Sequence[DataFrame], keys: Sequence[str], func: Callable[[Column], Column] = lambda m: m) -> tuple[DataFrame, DataFrame]:
    """(kept, rejects). Rows without a mask are kept."""
    bad = combine_masks(masks, keys, func).where("remove").select(*keys)
    return df.join(bad, list(keys), "left_anti"), df.join(bad, list(keys), "left_semi")


def filter_by_score(df: DataFrame, scores: DataFrame, keys: Sequence[str], threshold: float | None = None, keep: int | None = None, score: str = "score") -> tuple[DataFrame, DataFrame | None]:
    """(kept, rejects) by a score aligned with the rows: those up to the threshold, or the ``keep`` lowest.

    Ties at the ``keep``-th place go to the row that comes first; its rejects are not computed.
    """
    if (threshold is None) == (keep is None):
        raise ValueError("either threshold or keep")
    joined = df.join(scores.select(*keys, F.col(score).alias("__score")), list(keys))
    if keep is not None:
        return joined.orderBy("__score", *keys).limit(keep).drop("__score"), None
    return joined.where(F.col("__score") <= threshold).drop("__score"), joined.where(F.col("__score") > threshold).drop("__score")

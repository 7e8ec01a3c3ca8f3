"""Composition of operators: a pipe is a function of DataFrames, planned by Catalyst as a whole."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Cell = Callable[[Column], Column]
Op = Callable[[DataFrame], "DataFrame | Result"]


@dataclass
class Result:
    """The main DataFrame of a pipe and its named side outputs (rejects, models, copies)."""

    main: DataFrame | None
    side: dict[str, DataFrame] = field(default_factory=dict)


def cell(f: Cell, *columns: str) -> Op:
    """Applies ``f`` to each of the columns (``line`` if none is named)."""
    return lambda df: df.withColumns({c: f(F.col(c)) for c in columns or ("line",)})


def for_each(f: Cell, columns: Sequence[str]) -> Op:
    return cell(f, *columns)


def per_column(functions: dict[str, Cell | None] | Sequence[Cell | None], columns: Sequence[str] | None = None) -> Op:
    """A function for each column; None leaves it as it is. A sequence must be as long as ``columns``."""
    if not isinstance(functions, dict):
        if columns is None or len(columns) != len(functions):
            raise ValueError("as many functions as columns")
        functions = dict(zip(columns, functions))
    return lambda df: df.withColumns({c: f(F.col(c)) for c, f in functions.items() if f is not None})


def remove(predicate: Column | Callable[[Column], Column], log: str | None = None) -> Op:
    """Drops the rows for which ``predicate`` is true; ``log`` names a side output of them."""
    test = predicate if isinstance(predicate, Column) else predicate(F.col("line"))
    bad = F.coalesce(test, F.lit(False))
    return lambda df: Result(df.where(~bad), {log: df.where(bad)} if log else {})


def remove_parallel(predicates: dict[str, Cell], log: str | None = None) -> Op:
    """Drops a row if the predicate of any column is true. The rejects have the cells (c0, c1 and so on, and those with a
    predicate) joined by `` ||| ``."""
    bad = reduce(lambda a, b: a | b, [F.coalesce(p(F.col(c)), F.lit(False)) for c, p in predicates.items()])

    def run(df: DataFrame) -> Result:
        cells_ = [c for c in df.columns if c in predicates or re.fullmatch(r"c\d+", c)]
        return Result(df.where(~bad), {log: df.where(bad).withColumn("reject", F.concat_ws(" ||| ", *cells_))} if log else {})

    return run


def tee(name: str) -> Op:
    """Names the stream at this point as a side output and passes it on."""
    return lambda df: Result(df, {name: df})


def dead_end(name: str, make: Callable[[DataFrame], DataFrame]) -> Op:
    """Computes a side output (counts, a model) and passes the stream on."""
    return lambda df: Result(df, {name: make(df)})


def pipe(*ops: Op) -> Callable[[DataFrame], Result]:
    """Chains operators; their side outputs are gathered by name. Nothing runs before an output is used."""

    def run(df: DataFrame) -> Result:
        out = Result(df)
        for op in ops:
            got = op(out.main)
            got = got if isinstance(got, Result) else Result(got)
            if clash := out.side.keys() & got.side.keys():
                raise ValueError(f"side outputs named twice: {sorted(clash)}")
            out = Result(got.main, out.side | got.side)
        return out

    return run


def mono_pipe(ops: Sequence[Op], inputs: Sequence[DataFrame], auto_concat: bool = False) -> Result:
    """Runs a pipe over one input, or over several end to end with ``auto_concat``."""
    from .order import concatenate

    if len(inputs) != 1 and not auto_concat:
        raise ValueError("several inputs need auto_concat")
    return pipe(*ops)(inputs[0] if len(inputs) == 1 else concatenate(inputs))


def parallel_pipe(ops: Sequence[Op], inputs: Sequence[DataFrame], keys: Sequence[str] = ("line_no",)) -> Result:
    """Runs a pipe over aligned inputs (keys, line), as columns c0, c1 and so on."""
    from .order import safe_zip

    return pipe(*ops)(safe_zip(inputs, list(keys)))


def dead_end_pipe(ops: Sequence[Op], inputs: Sequence[DataFrame]) -> dict[str, DataFrame]:
    """Only the side outputs of a pipe."""
    return mono_pipe(ops, inputs, auto_concat=True).side


def split_newlines(df: DataFrame, order: Sequence[str] = ("line_no",), column: str = "line") -> DataFrame:
    """Cuts cells at newlines into rows of their own; ``part`` is the last key of the order then."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode(F.split(F.col(column), "\n", -1)).alias("part", column))

"""Histogram sort: exact byte counts below candidate boundaries, refined until the splitters balance, then one exchange."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

TARGET_BYTES, TOLERANCE, SAMPLES = 32 << 20, 0.05, 16
Key = tuple


@dataclass
class _Gap:
    """Where a splitter may lie: keys from ``lo`` (None: the least) to below ``hi`` (None: beyond all)."""

    target: float
    lo: Key | None
    below_lo: int
    hi: Key | None
    below_hi: int
    open: bool = True

    def best(self) -> Key | None:
        return self.lo if self.target - self.below_lo <= self.below_hi - self.target else self.hi


def _ranked(value: object) -> tuple:
    """A value as part of a key: nulls first and NaN last, as Spark sorts."""
    return (0,) if value is None else (2,) if value != value else (1, value)


def keys_of(columns: list[pa.Array]) -> list[Key]:
    """The rows of key columns as tuples in the order of Spark's sort."""
    return list(zip(*([_ranked(x) for x in c.to_pylist()] for c in columns)))


def _placer(spark: SparkSession, boundaries: list[Key]):
    """Function of key columns: number of the sorted ``boundaries`` that are at or below the key.

    The boundaries go to the workers as data. They are at most ``samples`` for a shard, whatever the rows.
    """
    sent = spark.sparkContext.broadcast(boundaries)

    def place(*columns: pa.Array) -> pa.Array:
        known = sent.value
        return pa.array([bisect_right(known, k) for k in keys_of(list(columns))], pa.int64())

    return F.arrow_udf(place, "long")


def _counted(narrow: DataFrame, probes: list[Key], n_keys: int) -> dict[int, tuple[int, int, int]]:
    """By number of probes at or below the key: (bytes, rows, rows whose key is the last of these probes).

    Every task adds up what it has for each probe before anything is exchanged.
    """
    sent = narrow.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        size, rows, same = (np.zeros(len(known) + 1, np.int64) for _ in range(3))
        for batch in batches:
            keys = keys_of(batch.columns[:n_keys])
            at = np.array([bisect_right(known, k) for k in keys], np.int64)
            np.add.at(size, at, np.asarray(batch.column(n_keys)))
            np.add.at(rows, at, 1)
            np.add.at(same, at, [a > 0 and known[a - 1] == k for a, k in zip(at.tolist(), keys)])
        seen = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, size[seen], rows[seen], same[seen])], names=["at", "bytes", "n", "same"])

    found = narrow.mapInArrow(run, "at long, bytes long, n long, same long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("bytes", "n", "same")]).toArrow()
    return {a: (b, n, s) for a, b, n, s in zip(*(found.column(c).to_pylist() for c in ("at", "bytes", "n", "same")))}


def _drawn(narrow: DataFrame, edges: list[Key], rates: list[float], round_no: int, n_keys: int) -> list[Key]:
    """Distinct keys, drawn by hash with the rate of the range between edges in which they lie."""
    sent = narrow.sparkSession.sparkContext.broadcast((edges, rates))
    names = narrow.columns[:n_keys]
    draw = F.pmod(F.xxhash64(*names, F.lit(round_no)), F.lit(1 << 30)) / float(1 << 30)
    highest = max(rates, default=0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, rates = sent.value
        for batch in batches:
            keys = keys_of(batch.columns[:n_keys])
            keep = [d < rates[bisect_right(edges, k)] for k, d in zip(keys, batch.column(n_keys).to_pylist())]
            yield batch.select(range(n_keys)).filter(pa.array(keep, pa.bool_()))

    found = narrow.select(*names, draw.alias("draw")).where(F.col("draw") < highest).mapInArrow(run, narrow.select(*names).schema).distinct().toArrow()
    return keys_of([found.column(c) for c in names])


def find_splitters(narrow: DataFrame, shards: int, tolerance: float = TOLERANCE, samples: int = SAMPLES) -> list[Key]:
    """Sorted keys that cut ``narrow`` (key columns, and ``bytes`` as the last) into ``shards`` ranges of almost equal bytes.

    Each round draws about ``samples`` keys from every gap that is still open, counts the exact bytes below them in all
    partitions, and narrows the gaps. A gap closes when a boundary is within ``tolerance`` of a shard's size of its
    target, or when no key lies inside it, so that no better boundary exists. Only counts and probes reach the driver;
    there are at most shards x samples of them in expectation, and a round is sorted once.
    """
    rows, total = narrow.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    if not rows or shards < 2 or not total:
        return []
    n_keys = len(narrow.columns) - 1
    gaps = [_Gap(total * i / shards, None, 0, None, total) for i in range(1, shards)]
    allowed, round_no = tolerance * total / shards, 0
    spans: dict[tuple[Key | None, Key | None], tuple[int, int]] = {(None, None): (rows, len(gaps))}  # rows and open gaps
    while spans:
        edges = sorted({e for span in spans for e in span if e is not None})
        rates = [0.0] * (len(edges) + 1)
        for (lo, _), (n, wanted) in spans.items():
            rates[0 if lo is None else bisect_left(edges, lo) + 1] = min(1.0, samples * wanted / n)
        probes = sorted({*_drawn(narrow, edges, rates, round_no, n_keys), *edges})
        got = _counted(narrow, probes, n_keys) if probes else {}
        below = np.cumsum([got.get(i, (0, 0, 0))[0] for i in range(len(probes))])
        places = np.searchsorted(below, [g.target for g in gaps]).tolist()
        spans = {}
        for g, at in zip(gaps, places):
            if not g.open:
                continue
            if at > 0 and below[at - 1] >= g.below_lo:
                g.lo, g.below_lo = probes[at - 1], int(below[at - 1])
            if at < len(probes) and below[at] <= g.below_hi:
                g.hi, g.below_hi = probes[at], int(below[at])
            inside = got.get(at, (0, 0, 0))
            free = inside[1] - (inside[2] if at > 0 else 0)
            if min(g.target - g.below_lo, g.below_hi - g.target) <= allowed or free <= 0:
                g.open = False
            else:
                spans[g.lo, g.hi] = (free, spans.get((g.lo, g.hi), (0, 0))[1] + 1)
        round_no += 1
    return sorted({b for g in gaps if (b := g.best()) is not None})


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with the first number behind it that makes it none of the columns."""
    taken, n, out = {c.lower() for c in df.columns}, 1, name
    while out.lower() in taken:
        n, out = n + 1, f"{name}_{n + 1}"
    return out


def histogram_sort(df: DataFrame, keys: list[str], text_col: str = "text", shards: int | None = None, target_bytes: int = TARGET_BYTES, tolerance: float = TOLERANCE, shard_col: str = "shard") -> DataFrame:
    """``df`` in globally sorted shards of almost equal bytes, with the shard's number in ``shard_col``.

    Partition i of the result is shard i, sorted by ``keys``; all keys of shard i are below those of shard i + 1. The
    data are exchanged once; the search for splitters reads only the keys and sizes.

    * Nulls in a key sort first; a null text has 0 bytes and its row is kept.
    * Equal keys always share a shard, so ties or one very long text can make it larger than the tolerance.
    * Repeated rows are all kept. A column that is already named ``shard_col`` stays, and the number is in the first of
      ``shard_col`` with _2, _3, ... behind that is free.
    * An empty table, or one whose texts are all empty, becomes a single shard.
    """
    size: Column = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    narrow = stored(df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], size.alias("bytes")), "sizes")
    if shards is None:
        total = narrow.agg(F.sum("bytes")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    splitters = find_splitters(narrow, shards, tolerance)
    shard_col = free_name(df, shard_col)
    number = _placer(df.sparkSession, splitters)(*[F.col(k) for k in keys]) if splitters else F.lit(0)
    return df.withColumn(shard_col, number.cast("int")).repartitionById(len(splitters) + 1, F.col(shard_col)).sortWithinPartitions(*keys)

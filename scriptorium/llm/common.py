"""Helpers shared by the operators of this folder: slices, filters by Arrow batches, and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import expire, fresh_path, stored  # noqa: F401


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sizable(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join by sorted exchange, whatever its expected size.

    Spark sizes a table by its compressed files and takes an exploded array or the rows of a Python function for as many
    as their sources, so a table that grows with the corpus may be sent through the driver though it doesn't fit there.
    """
    return df.hint("merge")


def slices(sizes: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together, so that arrays over them stay small; a row is never cut."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def where_kept(docs: DataFrame, columns: list[Column], decide: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, as they are, for which ``decide`` is true. It sees a batch of ``columns`` and returns an array.

    The decision is taken where the row is, so nothing is joined or exchanged. Names of ``docs`` may clash or repeat.
    """
    n, k, schema = len(docs.columns), len(columns), docs.schema
    inner = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    named = docs.toDF(*[f"c{i}" for i in range(n)]) if len(set(docs.columns)) < n else docs
    rows = named.select(*columns, *[F.col(f"`{c}`") for c in named.columns]).toDF(*[f"d{i}" for i in range(k)], *[f"c{i}" for i in range(n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(decide(batch))
            yield batch.select(range(k, k + n)).filter(keep)

    return rows.mapInArrow(run, inner).toDF(*docs.columns)


# --- hashing of words, vectorised over a whole Arrow column ---------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CHUNK = 1 << 20
#: Bytes that belong to a word: ASCII letters and digits, and every byte of a multi-byte character.
_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    k = 1
    step = np.uint64(base)
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * step
        step = step * step
        k += m
    return out


with np.errstate(over="ignore"):
    _POW = _powers(_CHUNK + 1, int(_BASE))
    _INV = _powers(_CHUNK + 1, pow(int(_BASE), -1, 1 << 64))


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, length in bytes) of every word of a string column, in order.

    A word is a run of letters and digits; the caller lower-cases. The hash is a polynomial over the word's bytes
    modulo 2**64, taken from prefix sums, so the cost is a few passes over the bytes.
    """
    hashes, rows, starts, ends = words_in(*utf8_bytes(column))
    return hashes, rows, ends - starts


def words_in(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, end) of every word of rows that are cut at ``offsets``; see ``word_hashes``."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    inside = _WORD[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    start[heads] |= inside[heads]
    starts = np.flatnonzero(start)
    # A word ends before the next start or the next byte outside a word, whichever comes first.
    stop = ~inside
    stop[starts] = True
    stops = np.append(np.flatnonzero(stop), n)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    value = raw.astype(np.uint64) + np.uint64(1)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(starts):
            lo = starts[done]
            upto = int(np.searchsorted(ends, lo + _CHUNK, side="right"))
            if upto <= done:  # one word longer than a chunk: Horner by chunks
                h = np.uint64(0)
                for at in range(lo, ends[done], _CHUNK):
                    part = value[at : min(at + _CHUNK, ends[done])]
                    h = h * _POW[len(part)] + (part * _POW[: len(part)]).sum(dtype=np.uint64)
                hashes[done] = h
                done += 1
                continue
            hi = ends[upto - 1]
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(value[lo:hi] * _POW[: hi - lo], out=sums[1:])
            s, e = starts[done:upto] - lo, ends[done:upto] - lo
            hashes[done:upto] = (sums[e] - sums[s]) * _INV[s]
            done = upto
        hashes += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(hashes), rows, starts, ends

"""Sub-word learning: byte-pair merges of a word-count table, and their application to text."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, total_ordering
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import col
from ..functions.text import Cell, _over, chars

END = "</w>"
#: Pairs of which the places are noted together.
MOST_NOTED = 1 << 16


def pair_counts(counts: DataFrame) -> DataFrame:
    """(left, right, count): neighbouring symbols of the words (word, count), which end with a symbol of their own."""
    symbols = F.concat(chars("word"), F.array(F.lit(END)))
    s = counts.where(F.length("word") > 0).select("count", symbols.alias("s"))
    pairs = s.select("count", F.explode(F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("left"), F.slice("s", 2, F.size("s")).alias("right"))).alias("p")).where("p.right IS NOT NULL AND p.left IS NOT NULL")
    return pairs.groupBy("p.left", "p.right").agg(F.sum("count").alias("count"))


def merge_word(symbols: tuple[str, ...], pair: tuple[str, str]) -> tuple[str, ...]:
    out: list[str] = []
    i = 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return tuple(out)


@total_ordering
class _Greatest:
    """A pair in a heap that gives the greatest of equally frequent pairs first."""

    __slots__ = ("pair",)

    def __init__(self, pair: tuple[str, str]):
        self.pair = pair

    def __eq__(self, other: object) -> bool:
        return self.pair == other.pair

    def __lt__(self, other: _Greatest) -> bool:
        return self.pair > other.pair


def _sums(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """The different keys and the sums of their weights, or their numbers."""
    if not len(keys):
        return [], []
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = np.diff(np.append(cuts, len(keys))) if weights is None else np.add.reduceat(weights[order], cuts)
    return keys[cuts].tolist(), sums.tolist()


def _groups(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, its values in order)."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield from zip(keys[cuts].tolist(), np.split(values, cuts[1:]))


class Learner:
    """All words as one array of symbols, from which merges are learned.

    Every word follows a 0 and ends with ``END``. A merge writes the new symbol in the place of the first of the pair and
    ``dead`` in that of the second; dead places go when the array is searched again. A pair is named by a number and its
    places are those of its second symbols. A search notes the places of the most frequent pairs, at most ``MOST_NOTED`` (and
    equally frequent ones) with ``held`` places together, and those of pairs that are made later are noted then. So the memory is mostly that of the symbols, 2 bytes each if they
    are less than 65,536 different ones.
    """

    def __init__(self, symbols: int = 10_000, held: int = 1 << 24):
        self.symbols, self.held = symbols, held
        self.names, self.ids = ["", END], {END: 1}
        self.coded = np.zeros(0x110000, np.int32)
        self.parts: list[np.ndarray] = []
        self.uses: list[np.ndarray] = []
        self.least, self.heap = 0, []
        self.where: dict[int, list[np.ndarray]] = {}
        self.stats: dict[int, int] = {}

    def _kind(self) -> type:
        return np.uint16 if len(self.names) + self.symbols < 1 << 16 else np.int32

    def add(self, words: Sequence[str], uses: Sequence[int]) -> None:
        kept = [(w, n) for w, n in zip(words, uses) if w]
        if not kept:
            return
        size = np.fromiter((len(w) for w, _ in kept), np.int64, len(kept))
        code = np.frombuffer("".join(w for w, _ in kept).encode("utf-32-le", "surrogatepass"), np.uint32)
        for c in np.unique(code).tolist():
            if not self.coded[c]:
                self.coded[c] = self.ids[chr(c)] = len(self.names)
                self.names.append(chr(c))
        first = np.cumsum(size + 2) - size - 1
        out = np.zeros(int((size + 2).sum()), self._kind())
        out[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(code))] = self.coded[code]
        out[first + size] = 1
        self.parts.append(out)
        self.uses.append(np.fromiter((n for _, n in kept), np.int64, len(kept)))

    def _begin(self) -> None:
        kind = self._kind()
        self.dead = np.iinfo(kind).max
        self.s = np.zeros(sum(map(len, self.parts)) + 1, kind)  # a 0 behind the last word too
        at = 0
        for part in self.parts:
            self.s[at : at + len(part)] = part
            at += len(part)
        self.parts = []
        self.uses = np.concatenate(self.uses) if self.uses else np.zeros(0, np.int64)
        self._find_words()
        for at, keys in self._pairs():
            for k, n in zip(*_sums(keys, self._weights(at))):
                self.stats[k] = self.stats.get(k, 0) + n

    def _find_words(self) -> None:
        self.start = np.flatnonzero(self.s == 0)[:-1].astype(np.int32 if len(self.s) < 1 << 31 else np.int64)

    def _keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, pairs) of an array without dead places, in slices."""
        for a in range(1, len(self.s), 1 << 22):
            right = self.s[a : a + (1 << 22)]
            left = self.s[a - 1 : a - 1 + len(right)]
            at = np.flatnonzero((left > 0) & (right > 0))
            yield (at + a).astype(self.start.dtype), self._keys(left[at], right[at])

    def _weights(self, at: np.ndarray) -> np.ndarray:
        return self.uses[np.searchsorted(self.start, at, side="right") - 1]

    def _entry(self, key: int) -> tuple[int, _Greatest, int]:
        return -self.stats[key], _Greatest((self.names[key >> 32], self.names[key & 0xFFFFFFFF])), key

    def _search(self) -> None:
        """Notes the places of all pairs of at least ``least`` uses."""
        self.where = {}
        self.s = self.s[self.s != self.dead]
        self._find_words()
        places: dict[int, int] = {}
        for _, keys in self._pairs():
            for k, n in zip(*_sums(keys)):
                places[k] = places.get(k, 0) + n
        order = sorted(places, key=lambda k: -self.stats[k])
        total, self.least = 0, 1
        for i, k in enumerate(order):
            total += places[k]
            if i and (total > self.held or i >= MOST_NOTED):
                self.least = self.stats[order[i - 1]]
                break
        chosen = np.sort(np.array([k for k in order if self.stats[k] >= self.least], np.int64))
        for at, keys in self._pairs():
            own = chosen[np.minimum(np.searchsorted(chosen, keys), len(chosen) - 1)] == keys if len(chosen) else np.zeros(len(keys), bool)
            for k, some in _groups(keys[own], at[own]):
                self.where.setdefault(k, []).append(some)
        self.heap = [self._entry(k) for k in chosen.tolist()]
        heapq.heapify(self.heap)

    def _alive(self, at: np.ndarray, step: int) -> np.ndarray:
        """The nearest places that aren't dead, from ``at`` on (1) or back (-1)."""
        dead = np.flatnonzero(self.s[at] == self.dead)
        while len(dead):
            at[dead] += step
            dead = dead[self.s[at[dead]] == self.dead]
        return at

    def _count(self, at: np.ndarray, sign: int) -> set[int]:
        """Adds the uses of the pairs at these places, or takes them off."""
        left, right = self.s[self._alive(at - 1, -1)], self.s[at]
        real = np.flatnonzero((left > 0) & (right > 0))
        at, keys = at[real], self._keys(left[real], right[real])
        found, sums = _sums(keys, self._weights(at))
        fresh = {k for k in found if k not in self.stats} if sign > 0 else set()
        for k, n in zip(found, sums):
            self.stats[k] = self.stats.get(k, 0) + sign * n
        if sign > 0:
            for k, some in _groups(keys, at):
                if k in self.where:
                    self.where[k].append(some)
                elif k in fresh and self.stats[k] >= self.least:
                    self.where[k] = [some]
        return set(found)

    def _merge(self, key: int) -> None:
        a, b = key >> 32, key & 0xFFFFFFFF
        name = self.names[a] + self.names[b]
        new = self.ids.setdefault(name, len(self.names))
        if new == len(self.names):
            self.names.append(name)
        second = np.unique(np.concatenate(self.where.pop(key)))
        second = second[self.s[second] == b]
        first = self._alive(second - 1, -1)
        own = self.s[first] == a
        first, second = first[own], second[own]
        if a == b:  # of a run every other pair, from the left
            i = np.arange(len(first))
            run = np.maximum.accumulate(np.where(np.append(False, first[1:] == second[:-1]), 0, i)) if len(i) else i
            own = (i - run) % 2 == 0
            first, second = first[own], second[own]
        edges = np.unique(np.concatenate([first, self._alive(second + 1, 1)]))
        changed = self._count(np.sort(np.concatenate([edges, second])), -1)
        for k in changed:
            if self.stats[k] <= 0:
                del self.stats[k]
                self.where.pop(k, None)
        self.s[first], self.s[second] = new, self.dead
        changed |= self._count(edges, 1)
        for k in changed:
            if self.stats.get(k, 0) >= self.least:
                heapq.heappush(self.heap, self._entry(k))

    def learn(self, min_frequency: int = 2) -> list[tuple[str, str]]:
        self._begin()
        self._search()
        merges: list[tuple[str, str]] = []
        while len(merges) < self.symbols:
            while self.heap and self.stats.get(self.heap[0][2]) != -self.heap[0][0]:
                heapq.heappop(self.heap)
            if not self.heap and self.least <= 1:
                break
            # Rarer pairs come next, or one of which only some places are noted.
            if not self.heap or self.heap[0][2] not in self.where:
                self._search()
                continue
            n, best, key = heapq.heappop(self.heap)
            if -n < min_frequency:
                break
            merges.append(best.pair)
            self._merge(key)
        return merges


def learn_merges(vocabulary: Iterable[tuple[str, int]], symbols: int = 10_000, min_frequency: int = 2) -> list[tuple[str, str]]:
    """The merges in order: the most frequent pair each time, of equal ones the greatest, until none is frequent enough.

    Every merge depends on the one before, so this is a loop over the words, with counts of pairs kept up to date where
    the words change, and a heap of pairs in which outdated counts are passed over.
    """
    learner, rows = Learner(symbols), iter(vocabulary)
    while some := list(islice(rows, 1 << 16)):
        learner.add(*zip(*some))
    return learner.learn(min_frequency)


def learn_bpe(counts: DataFrame, symbols: int = 10_000, min_frequency: int = 2, min_count: int = 1) -> list[tuple[str, str]]:
    """``learn_merges`` of a count table (word, count), of which words with at least ``min_count`` uses count.

    The loop is sequential by definition, so one task holds the symbols of all distinct words (see ``Learner``). Only the
    merges reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(symbols)
        for batch in batches:
            learner.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        merges = learner.learn(min_frequency)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(merges)), pa.int64()), *[pa.array([m[i] for m in merges], pa.string()) for i in range(2)]], names=["rank", "left", "right"])

    rows = counts.where(F.col("count") >= min_count).select("word", F.col("count").cast("long")).repartition(1)
    return [(r["left"], r["right"]) for r in sorted(rows.mapInArrow(run, "rank long, left string, right string").collect())]


class Segmenter:
    """Applies merges to words, the earliest learned first; words are remembered."""

    def __init__(self, merges: Sequence[tuple[str, str]], separator: str = "@@"):
        self.rank = {p: i for i, p in reversed(list(enumerate(map(tuple, merges))))}
        self.separator = separator
        self.encode = lru_cache(1 << 18)(self._encode)

    def _encode(self, word: str) -> tuple[str, ...]:
        parts = tuple(word) + (END,)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            parts = merge_word(parts, best)
        if parts[-1] == END:
            return parts[:-1]
        return parts[:-1] + (parts[-1].removesuffix(END),)

    def __call__(self, text: str) -> str:
        return " ".join(" ".join([*(p + self.separator for p in parts[:-1]), parts[-1]]) for parts in map(self.encode, text.split()))


def apply_bpe(line: Cell, merges: Sequence[tuple[str, str]], separator: str = "@@") -> Column:
    """Segments the words of a line. The merges, whose number is a parameter of training, are sent with the function."""
    table = tuple(map(tuple, merges))
    name = hashlib.sha256(repr((table, separator)).encode("utf-8", "surrogatepass")).hexdigest()
    return _over(lambda text: _segmenter(_Named(name, table), separator)(text))(col(line))


class _Named:
    """Merges that are compared by their name: to hash them all for every text takes longer than to segment it."""

    def __init__(self, name: str, merges: tuple[tuple[str, str], ...]):
        self.name, self.merges = name, merges

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Named) and self.name == other.name


@lru_cache(4)
def _segmenter(merges: _Named, separator: str) -> Segmenter:
    return Segmenter(merges.merges, separator)

"""Removal of repeated lines by pairwise alignment of overlapping documents.

Every document is aligned by patience diff with every earlier one that can take a block from it, and blocks of aligned
lines are deleted from the later document of the pair (the one with the greater id). The result is that of all pairs:

* A window is a shortest run of neighbouring lines that has ``min_words`` words, from a line on or up to a line. A line
  can only be deleted through an earlier document that has one of the windows around it as well, so no other is tried.
* The documents that have a window are tried in their order, and no further than to the first that deletes the whole
  window: a later one can't change the result. Mostly the first does; rounds of more and more documents follow for the rest.
* Documents that agree in their shared lines and the places of these are aligned once.

Only hashes and positions of lines that several documents have are moved; a text is read to hash its lines and once more
to cut the deleted ones.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sizable, stored, text_or_empty

RARE, MIN_BLOCK_WORDS = 8, 6
WORD = r"[^ \t\n\r\f]+"


def _longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: equal ends, then lines that are unique in both, and so on between them.

    A stretch without a line that is unique in both sides is aligned at its equal ends only.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        once: dict[int, int] = {}
        for i in range(lo, hi):
            once[a[i]] = -1 if a[i] in once else i
        other: dict[int, int] = {}
        for j in range(low, high):
            other[b[j]] = -1 if b[j] in other else j
        both = [(i, other[h]) for h, i in once.items() if i >= 0 and other.get(h, -1) >= 0]
        both.sort()
        chain = [both[k] for k in _longest_increasing([j for _, j in both])]
        if not chain:
            continue
        before = (lo, low)
        for i, j in chain:
            out.append((i, j))
            todo.append((before[0], i, before[1], j))
            before = (i + 1, j + 1)
        todo.append((before[0], hi, before[1], high))
    return sorted(out)


def _with_gaps(place: list[int], hashes: list[int], more: bool, step: int) -> tuple[list[int], list[int]]:
    """The line hashes with a number of no other line in every gap of the places, and the place of each.

    Lines that no other document has can't be aligned, but they end a run of equal ends. ``more``: some follow the last.
    """
    out, at, free, expected = [], [], step << 64, 0
    for p, h in zip(place, hashes):
        if p != expected:
            out.append(free)
            at.append(-1)
            free += step
        out.append(h)
        at.append(p)
        expected = p + 1
    if more:
        out.append(free)
        at.append(-1)
    return out, at


def common_blocks(place_a: list[int], hash_a: list[int], place_b: list[int], hash_b: list[int], words_b: list[int], least: int) -> list[int]:
    """Places in b that lie in an aligned block of at least ``least`` words; a block is contiguous in both documents."""
    out: list[int] = []
    block: list[int] = []
    words, last = 0, (-9, -9)
    for i, j in patience(hash_a, hash_b):
        here = (place_a[i], place_b[j])
        if here != (last[0] + 1, last[1] + 1):
            if words >= least:
                out.extend(block)
            block, words = [], 0
        block.append(here[1])
        words += words_b[j]
        last = here
    if words >= least:
        out.extend(block)
    return out


def windows(place: list[int], hashes: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(key, first, last place) of the shortest runs of neighbouring lines from each line on and up to each line that
    have ``least`` words."""
    out = set()
    for i, w in enumerate(words):
        if w >= least:
            out.add((hashes[i], place[i], place[i]))
            continue
        for step in (1, -1):
            j, total = i, w
            while total < least and 0 <= j + step < len(words) and place[j + step] == place[j] + step:
                j += step
                total += words[j]
            if total >= least:
                lo, hi = min(i, j), max(i, j)
                out.add((hash(tuple(hashes[lo : hi + 1])), place[lo], place[hi]))
    return list(out)


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("body")]


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, body, place, h, words, n): the hash of every line that has a word; ``place`` counts these lines of a document,
    which are ``n``."""
    trimmed = F.transform(F.split(text_or_empty(text_col), "\n", -1), lambda x: F.struct(F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("h")))
    full = F.filter(trimmed, lambda x: x["words"] > 0)
    rows = docs.select(*_key(id_col, text_col), full.alias("full"))
    return rows.select("doc", "body", F.size("full").alias("n"), F.posexplode("full").alias("place", "x")).select("doc", "body", "place", F.col("x.h").alias("h"), F.col("x.words").cast("int").alias("words"), "n")


def _lists(batch: pa.RecordBatch, c: int) -> Callable[[int], list[int]]:
    """The lists of a column by row."""
    at, flat = np.asarray(batch.column(c).offsets).tolist(), np.asarray(batch.column(c).flatten()).tolist()
    base = at[0]
    return lambda i: flat[at[i] - base : at[i + 1] - base]


def _aligned(pairs: DataFrame, groups: DataFrame, min_words: int) -> DataFrame:
    """(g, place, a): what each pair (ga, g) of groups deletes from the second; a is the first document of ``ga``."""
    left = pairs.join(sizable(groups.select(F.col("g").alias("ga"), F.col("head").alias("a"), F.col("p").alias("pa"), F.col("h").alias("ha"), F.col("more").alias("ma"))), "ga")
    # The second column of lists is joined on the later document, so that its pairs lie together.
    both = left.join(sizable(groups.select("g", F.col("p").alias("pb"), F.col("h").alias("hb"), F.col("w").alias("wb"), F.col("more").alias("mb"))), "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gs, docs_, bodies, places = [], [], [], []
            g, doc, body, more_a, more_b = (batch.column(c).to_pylist() for c in range(5))
            pa_, ha, pb, hb, wb = (_lists(batch, c) for c in range(5, 10))
            for i in range(len(g)):
                left, at_left = _with_gaps(pa_(i), ha(i), more_a[i], -1)
                right, at_right = _with_gaps(pb(i), hb(i), more_b[i], 1)
                words = dict(zip(pb(i), wb(i)))
                hit = common_blocks(at_left, left, at_right, right, [words.get(p, 0) for p in at_right], min_words)
                gs.extend([g[i]] * len(hit))
                docs_.extend([doc[i]] * len(hit))
                bodies.extend([body[i]] * len(hit))
                places.extend(hit)
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(places, pa.int32()), pa.array(docs_, pa.int64()), pa.array(bodies, pa.int64())], names=["g", "place", "doc", "body"])

    found = both.select("g", "a.doc", "a.body", "ma", "mb", "pa", "ha", "pb", "hb", "wb").mapInArrow(run, "g long, place int, doc long, body long")
    return found.groupBy("g", "place").agg(F.min(F.struct("doc", "body")).alias("a"))


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc, body, place, earlier): lines to delete, and the least id of the documents that have the aligned block.

    ``rare`` only sets how many documents of a window are tried in the second round; the result doesn't depend on it.
    """
    me = F.struct("doc", "body")
    # Equal rows are one document; a line counts once for each.
    lines = lines_of(docs, id_col, text_col).select(me.alias("k"), "place", "h", "words", "n").distinct()
    spread = lines.groupBy("h").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first <> last").select("h")
    # Lines that only one document has can't be aligned and are dropped before anything else is moved.
    whole = lines.join(sizable(spread), "h").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("place", "h", "words"))).alias("x"), F.first("n").alias("n"))
    whole = whole.select("k", F.col("x.place").alias("p"), F.col("x.h").alias("h"), F.col("x.words").alias("w"), (F.element_at("x.place", -1) + 1 < F.col("n")).alias("more"))
    whole = stored(whole.withColumn("g", F.xxhash64("p", "h", "more")), "line-lists")
    groups = stored(whole.groupBy("g").agg(F.min("k").alias("head"), F.max("k").alias("last"), *[F.first(c).alias(c) for c in ("p", "h", "w", "more")]), "line-groups")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, h, w = (_lists(batch, c) for c in range(1, 4))
            g, found = batch.column(0).to_pylist(), []
            for i in range(len(g)):
                found.extend((g[i], *x) for x in windows(p(i), h(i), w(i), min_words))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["g", "w", "s", "e"])

    heads = groups.select("g", "head", "last")
    cuts = groups.select("g", "p", "h", "w").mapInArrow(cut, "g long, w long, s int, e int").join(sizable(heads), "g")
    first = cuts.groupBy("w").agg(F.min(F.struct("head", "g")).alias("f"), F.max("last").alias("l")).where("f.head < l").select("w", "f")
    # Windows of which no earlier document has a copy take no part.
    uses = stored(cuts.join(sizable(first), "w").where("f.head < last"), "line-windows")
    gone = stored(_aligned(uses.select(F.col("f.g").alias("ga"), "g").distinct(), groups, min_words), "aligned")

    def rest(of: DataFrame) -> DataFrame:
        """Windows of ``of``, and up to which document a line of theirs may still be deleted or have an earlier source."""
        each = of.withColumn("place", F.explode(F.sequence("s", "e"))).join(sizable(gone), ["g", "place"], "left")
        until = F.when(F.count("a") < F.count(F.lit(1)), F.first("last")).otherwise(F.least(F.first("last"), F.max("a")))
        return each.groupBy("w", "g", "s", "e").agg(F.first("last").alias("last"), F.first("t").alias("t"), until.alias("until")).where("t < until")

    # Windows that lost all lines to the first document that has them are done.
    left = stored(rest(uses.select("w", "g", "s", "e", "last", F.col("f.head").alias("t"))), "open-windows")
    others = uses.where("f.head < head").select("w", F.col("g").alias("ga"), "head").join(sizable(left.select("w").distinct()), "w", "left_semi").distinct()
    ranked = stored(others.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("head", "ga"))), "window-documents")
    lo, hi = 1, 1 + max(rare, 1)
    while True:
        onward = ranked.where(F.col("r") == lo).select("w", F.col("head").alias("next"))
        left = stored(left.drop("until").transform(rest).join(sizable(onward), "w").where("next < until").drop("next"), "open-windows", left)
        if left.isEmpty():
            break
        pairs = left.join(sizable(ranked.where((F.col("r") >= lo) & (F.col("r") < hi))), "w").where("head < until").select("ga", "g").distinct()
        gone = stored(gone.unionByName(_aligned(pairs, groups, min_words)).groupBy("g", "place").agg(F.min("a").alias("a")), "aligned", gone)
        lo, hi = hi, 8 * hi
    return whole.select("k", "g").join(sizable(gone), "g").where("a < k").select("k.doc", "k.body", "place", F.col("a.doc").alias("earlier"))


def _cut(docs: DataFrame, id_col: str, text_col: str, rare: int, min_words: int) -> tuple[DataFrame, Column, Column]:
    """``docs`` with the deleted places of each row, the text without them, and whether anything is left."""
    gone = deletions(docs, id_col, text_col, rare, min_words).groupBy("doc", "body").agg(F.array_sort(F.collect_list(F.struct("place", "earlier"))).alias("__gone")).withColumnsRenamed({"doc": "__doc", "body": "__body"})
    doc, body = _key(id_col, text_col)
    joined = docs.join(sizable(gone), doc.eqNullSafe(F.col("__doc")) & (body == F.col("__body")), "left")
    lines = F.split(text_or_empty(text_col), "\n", -1)
    # Lines without a word keep their place in the text but have no number. Each array is bound once, so the cost is linear.
    once = lambda made, use: F.element_at(F.transform(F.array(made), use), 1)
    numbered = lambda x: F.filter(F.transform(x, lambda y, i: F.when(F.regexp_count(y, F.lit(WORD)) > 0, i)), lambda i: i.isNotNull())
    dropped = lambda x: once(numbered(x), lambda full: F.transform(F.col("__gone.place"), lambda p: F.element_at(full, p + 1)))
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), dropped(x)), lambda i: F.element_at(x, i + 1))
    text = F.when(F.col("__gone").isNull(), F.col(text_col).cast("string")).otherwise(once(lines, lambda x: F.array_join(left(x), "\n")))
    return joined, text, F.col("__gone").isNull() | (F.regexp_count(text, F.lit(WORD)) > 0)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_removed, removed, text): every document after the deletion of the blocks that earlier ones have.

    ``removed`` has the deleted lines as (place among the lines with words, least id of a document that has the block).

    * A null or empty text has no lines and stays as it is. Lines without a word are never aligned or deleted, and don't
      part a block.
    * Rows that are equal in id and text are one document: they are not compared, and lose the same lines. Rows that
      share an id but not the text are ordered by a hash of the text. Null ids come first.
    * A text whose every line is deleted becomes empty (or its lines without words). An empty table gives no rows.
    * Further columns are not used, whatever their names.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined, text, _ = _cut(narrow, "doc_id", "text", rare, min_words)
    return joined.select("doc_id", F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"), F.col("__gone").alias("removed"), text.alias("text"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """``docs`` with the blocks deleted that ``align`` finds; a document of which no word is left goes.

    Columns as given; ``n_chars``, where there is one, is set to the new length of a changed text. Other cases as in ``align``.
    """
    # Columns go by their place meanwhile, so that no name of theirs can clash.
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = (names[docs.columns.index(c)] for c in (id_col, text_col))
    joined, text, left = _cut(docs.toDF(*names), id_at, text_at, rare, min_words)
    joined = joined.withColumn("__text", text).where(left)
    out = []
    for c, name in zip(docs.columns, names):
        if name == text_at:
            out.append(F.col("__text").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("__gone").isNotNull(), F.length("__text")).otherwise(F.col(name)).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(name).alias(c))
    return joined.select(*out)

"""SimHash near-duplicates by the generalised pigeonhole principle.

A document has two 64-bit signatures: of its distinct words and of its distinct word pairs. Two documents are near
copies if the first differ in at most ``max_bits`` bits and the second in at most ``max_pair_bits``. The search is exact
for that definition:

1. The co-occurrence of all 64 bits over all documents groups correlated bits into partitions.
2. The histogram of each partition's values gives, by a Walsh-Hadamard transform, the number of pairs within every
   distance; dynamic programming over these counts splits the threshold unevenly (the sum of the parts' thresholds is
   ``max_bits - parts + 1``, -1 skips a part). The cheapest number of parts is taken.
3. Every distinct signature probes each part within that part's threshold, and candidates are verified bit by bit.

Then groups are the connected components of the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, sizable, stored, utf8_bytes, words_in

MAX_BITS, MAX_PAIR_BITS = 10, 20
#: Letters of a long word, and its weight against 1 for a shorter one, which mostly is a function word.
LONG_LETTERS, LONG_WEIGHT = 5, 8


def _signature(hashes: np.ndarray, rows: np.ndarray, n: int, long: np.ndarray | None = None) -> np.ndarray:
    """The 64-bit SimHash of each row's distinct hashes, of which ``long`` ones weigh more; 0 for a row without any."""
    out = np.zeros(n, dtype=np.uint64)
    if not len(hashes):
        return out
    key = (rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(21)) << np.uint64(1)
    if long is not None:
        key |= long.astype(np.uint64)
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    row = (key >> np.uint64(44)).astype(np.int64)
    with np.errstate(over="ignore"):
        h = mix64(key & np.uint64((1 << 44) - 1))
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    weight = np.where(key & np.uint64(1), LONG_WEIGHT, 1).astype(np.int32)
    size = np.add.reduceat(weight, first)
    bits = np.zeros(len(first), dtype=np.uint64)
    for b in range(64):
        ones = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int32) * weight, first)
        bits |= (2 * ones > size).astype(np.uint64) << np.uint64(b)
    out[row[first]] = bits
    return out


def signatures_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word signature, word-pair signature, number of words) of each text.

    In the first signature words of at least ``LONG_LETTERS`` letters have the weight ``LONG_WEIGHT``, shorter ones 1.
    """
    n = len(texts)
    words, pairs, count = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    size = np.diff(np.frombuffer(texts.cast(pa.large_string()).buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]) if n else np.zeros(0)
    edges = [0]
    total = 0
    for i, s in enumerate(size):  # slices of a few MB keep the arrays in cache
        total += s
        if total > 1 << 22 or i - edges[-1] > 1 << 16:
            edges.append(i + 1)
            total = 0
    if edges[-1] < n:
        edges.append(n)
    for a, b in zip(edges, edges[1:]):
        raw, offsets = utf8_bytes(pc.utf8_lower(texts.slice(a, b - a)))
        h, rows, starts, ends = words_in(raw, offsets)
        seen = np.bincount(rows, minlength=b - a)
        letters = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        words[a:b] = _signature(h, rows, b - a, letters[ends] - letters[starts] >= LONG_LETTERS)
        same = rows[1:] == rows[:-1]
        with np.errstate(over="ignore"):
            two = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[same] if len(h) else h
        single = (seen == 1)[rows]
        pairs[a:b] = _signature(np.concatenate([two, h[single]]), np.concatenate([rows[:-1][same] if len(h) else rows, rows[single]]), b - a)
        count[a:b] = seen
    return words, pairs, count


def signature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, body, sig, pair, n_words): one row per input row; body is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, pairs, count = signatures_of(batch.column(2).fill_null(""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(words.view(np.int64)), pa.array(pairs.view(np.int64)), pa.array(count)],
                names=["doc", "body", "sig", "pair", "n_words"],
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("body"), text.alias("t"))
    return narrow.mapInArrow(run, "doc long, body long, sig long, pair long, n_words long")


# --- planning ---------------------------------------------------------------------------------------------------------


def bit_counts(sigs: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, 64 x 64 counts of rows in which both bits are set), over all rows. Only 4,097 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            s = np.asarray(batch.column(0)).view(np.uint64)
            for a in range(0, len(s), 1 << 14):
                m = ((s[a : a + (1 << 14), None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += m.T @ m
            n += len(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["at", "n"])

    got = sigs.select("sig").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for r in got:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(64, 64)


def group_bits(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Splits the 64 bits into ``parts`` groups of almost equal width, greedily by absolute correlation."""
    p = np.diag(both) / max(rows, 1)
    cov = both / max(rows, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for g in range(parts):
        width = len(left) // (parts - g)
        sub = corr[np.ix_(left, left)]
        seed = left[int(np.argmax(sub.max(axis=1)))]
        group = [seed]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def part_value(bits: list[int], sig: str = "sig"):
    """Column: the bits of a part packed into one number. Runs of neighbouring bits are moved together."""
    out, done = None, 0
    while done < len(bits):
        n = 1
        while done + n < len(bits) and bits[done + n] == bits[done] + n:
            n += 1
        piece = F.shiftleft(F.shiftrightunsigned(F.col(sig), bits[done]).bitwiseAND(F.lit((1 << n) - 1).cast("long")), done)
        out = piece if out is None else out.bitwiseOR(piece)
        done += n
    return out.cast("int")


def pairs_within(histogram: np.ndarray) -> np.ndarray:
    """Number of unordered pairs of rows at every distance <= t, t from 0 to the width, from the counts of each value."""
    f = histogram.astype(np.float64).copy()
    h = 1
    while h < len(f):
        f = f.reshape(-1, 2, h)
        f = np.stack([f[:, 0] + f[:, 1], f[:, 0] - f[:, 1]], axis=1).ravel()
        h *= 2
    f = f * f
    h = 1
    while h < len(f):
        f = f.reshape(-1, 2, h)
        f = np.stack([f[:, 0] + f[:, 1], f[:, 0] - f[:, 1]], axis=1).ravel()
        h *= 2
    at = np.bincount(np.bitwise_count(np.arange(len(f), dtype=np.uint32)), weights=f / len(f))
    at[0] -= histogram.sum()
    return np.cumsum(np.maximum(at, 0)) / 2


def pair_counts(sigs: DataFrame, named: dict[int, list[int]]) -> dict[int, np.ndarray]:
    """``pairs_within`` of each named group of bits. Histograms stay in the workers; a group has at most 17 numbers for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histograms: dict[int, np.ndarray] = {}
        for batch in batches:
            part, v, n = (np.asarray(batch.column(c)) for c in range(3))
            for k in np.unique(part).tolist():
                own = part == k
                histograms.setdefault(k, np.zeros(1 << len(named[k])))[v[own]] = n[own]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(histograms), pa.int32()), pa.array([pairs_within(h).tolist() for h in histograms.values()], pa.list_(pa.float64()))], names=["part", "pairs"]
        )

    coded = sigs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), part_value(g).alias("v")) for k, g in named.items()])).alias("x"))
    counted = coded.groupBy("x.part", "x.v").agg(F.count(F.lit(1)).alias("n")).repartition("part")
    got = {r["part"]: np.array(r["pairs"]) for r in counted.mapInArrow(run, "part int, pairs array<double>").collect()}
    return {k: got.get(k, np.zeros(len(g) + 1)) for k, g in named.items()}


def _probes(width: int, t: int) -> int:
    """Rows that a signature sends for one part: all values within half of the threshold, on either side."""
    return 0 if t < 0 else sum(comb(width, i) for i in range(t // 2 + 1)) + sum(comb(width, i) for i in range(t - t // 2 + 1))


def allocate(counts: list[np.ndarray], rows: int, max_bits: int, probe_cost: float = 8.0) -> tuple[float, list[int]]:
    """Thresholds of the parts with the least cost: candidates plus ``probe_cost`` for each probe.

    They add up to ``max_bits - parts + 1``, so by the generalised pigeonhole principle no pair is missed.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in counts:
        width, new = len(c) - 1, {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, width + 1):
                here = cost + (0.0 if t < 0 else c[t] + probe_cost * rows * _probes(width, t))
                if used + t not in new or here < new[used + t][0]:
                    new[used + t] = (here, [*chosen, t])
        best = new
    return best[max_bits - len(counts) + 1]


def plan(sigs: DataFrame, max_bits: int = MAX_BITS, parts: tuple[int, ...] = (4, 5, 6, 8)) -> tuple[list[list[int]], list[int]]:
    """The bit groups and thresholds of least estimated cost. Parts have at most 16 bits, so a histogram is bounded."""
    rows, both = bit_counts(sigs)
    options = {m: group_bits(rows, both, m) for m in parts}
    named = {m * 100 + i: g for m in parts for i, g in enumerate(options[m])}
    within = pair_counts(sigs, named)
    found = [(allocate([within[m * 100 + i] for i in range(m)], rows, max_bits), m) for m in parts]
    (_, thresholds), m = min(found)
    return options[m], thresholds


# --- search -----------------------------------------------------------------------------------------------------------


def _masks(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in at) for k in range(t + 1) for at in combinations(range(width), k)]


def near_signatures(sigs: DataFrame, max_bits: int = MAX_BITS, max_pair_bits: int = MAX_PAIR_BITS) -> DataFrame:
    """(a, b): pairs of ids of ``sigs`` (sig, pair) that are near copies, each once. Every row is a query.

    Probes carry the first signature only. The second one, by which ids are named and pairs judged, is joined to those
    that met.
    """
    once = stored(sigs.select("sig").distinct(), "word-signatures")
    groups, thresholds = plan(once, max_bits)
    left, right = [], []
    for i, (g, t) in enumerate(zip(groups, thresholds)):
        if t >= 0:
            for sides, half in ((left, t - t // 2), (right, t // 2)):
                sides.append((i, part_value(g), _masks(len(g), half)))

    def probes(side: list, name: str) -> DataFrame:
        # One number holds the part and its value, as a part has 16 bits at most.
        rows = []
        for i, v, masks in side:
            coded = v + F.lit(i << 16)
            values = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: coded.bitwiseXOR(m))  # noqa: B023
            rows.append(once.select(F.explode(values).alias("v"), F.col("sig").alias(name)))
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    met = probes(left, "a_sig").join(sizable(probes(right, "b_sig")), "v").where((F.col("a_sig") < F.col("b_sig")) & (F.bit_count(F.col("a_sig").bitwiseXOR(F.col("b_sig"))) <= max_bits)).select("a_sig", "b_sig").distinct()
    one, two = (sigs.select(F.col("sig").alias(f"{x}_sig"), F.col("pair").alias(f"{x}_pair")) for x in "ab")
    far = F.bit_count(F.col("a_pair").bitwiseXOR(F.col("b_pair"))) > max_pair_bits
    other = met.join(sizable(one), "a_sig").join(sizable(two), "b_sig").where(~far).select("a_sig", "a_pair", "b_sig", "b_pair")
    # Texts of the same words in another order.
    same = one.join(sizable(two), (F.col("a_sig") == F.col("b_sig")) & (F.col("a_pair") < F.col("b_pair"))).where(~far).select("a_sig", "a_pair", "b_sig", "b_pair")
    return other.unionByName(same).select(node_id("a_sig", "a_pair").alias("a"), node_id("b_sig", "b_pair").alias("b"))


def node_id(sig: str, pair: str, blank=None):
    """Name of the rows with these signatures; ``blank`` parts texts without words."""
    return F.xxhash64(sig, pair, F.lit(0).cast("long") if blank is None else blank)


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): the connected component of every id in ``pairs`` (a, b), named by its least id.

    Alternates the large-star and small-star steps; each round is written to the shared folder.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(sizable(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sizable(lower), "u").select("u", "v", "m")
        edges = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges", edges)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == tuple(now):
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, max_pair_bits: int = MAX_PAIR_BITS) -> DataFrame:
    """(doc, body, group_id, n_rows, kept): the near-copy group of each distinct (id, text).

    * group_id is the least id in the group; exactly one (id, text) of a group is kept, the least by (id, body).
    * Null ids come first in that order. A null text counts as empty.
    * Texts without any word (empty, spaces, only marks) are equal to each other only if their text is the same.
    * Repeated rows are one (id, text); n_rows counts them.
    * An empty table gives an empty result.
    """
    each = stored(signature_table(docs, id_col, text_col).groupBy("doc", "body").agg(F.min("sig").alias("sig"), F.min("pair").alias("pair"), F.min("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_rows")), "signatures")
    # Rows that agree in both signatures are one node of the search.
    node = node_id("sig", "pair", F.when(F.col("n_words") == 0, F.col("body")).otherwise(F.lit(0)))
    nodes = stored(each.select(node.alias("id"), "sig", "pair", "n_words").groupBy("id").agg(F.min("sig").alias("sig"), F.min("pair").alias("pair"), F.max("n_words").alias("n_words")), "nodes")
    roots = components(near_signatures(nodes.where("n_words > 0"), max_bits, max_pair_bits))
    marked = each.withColumn("id", node).join(sizable(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = F.struct(F.col("doc"), F.col("body"))
    heads = marked.groupBy("root").agg(F.min(first).alias("head"))
    out = marked.join(sizable(heads), "root")
    return out.select("doc", "body", F.col("head.doc").alias("group_id"), "n_rows", (first == F.col("head")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The rows of ``docs`` of which one per near-copy group stays; columns as given. Cases as in ``near_groups``."""
    kept = stored(near_groups(docs, id_col, text_col, **limits).where("kept").select(F.col("doc").alias("kept_doc"), F.col("body").alias("kept_body"), "n_rows"), "kept")
    # Columns go by their place meanwhile, so that no name of theirs can clash.
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    body = F.xxhash64(F.coalesce(F.col(text_at).cast("string"), F.lit("")))
    found = rows.join(sizable(kept), F.col(id_at).cast("long").eqNullSafe(F.col("kept_doc")) & (body == F.col("kept_body")))
    once = found.where("n_rows = 1").select(rows.columns)
    again = found.where("n_rows > 1").dropDuplicates(["kept_doc", "kept_body"]).select(rows.columns)
    return once.unionByName(again).toDF(*docs.columns)

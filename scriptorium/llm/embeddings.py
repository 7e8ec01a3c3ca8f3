"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

Every vector is scaled to length 1, padded to ``bits`` dimensions and rotated at random. Its code is the signs of the
rotated vector; with the stored factor ``<code, vector>`` the code gives, against another rotated vector, an unbiased
estimate of the inner product and a confidence bound on it. The bound alone accepts or rejects a pair, and only pairs
that it leaves open are computed exactly from the vectors.

Candidates come from tables that are keyed by signs of random projections, other ones for every bit of every table, so
that tables miss a pair independently: the number of bits grows with the logarithm of the rows, so buckets stay small, and
the number of tables follows from the recall wanted at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, sizable, stored
from .simhash import components

THRESHOLD, RECALL, EPSILON, SEED = 0.95, 0.98, 3.0, 7
#: Rows that are compared at a time, rows of a bucket up to which its pairs are listed, and pairs listed at a time.
CHUNK, BLOCK, SMALL, PAIRS = 8192, 2048, 64, 50_000


def code_bits(dim: int) -> int:
    """Width of the code: a multiple of 64, at least 128 and twice the dimensions."""
    return max(128, -(-2 * dim // 64) * 64)


@cache
def rotation(dim: int, bits: int, seed: int = SEED) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix of ``bits`` dimensions; the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float32)


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated unit vectors, signs as 0/1, correction factors) of rows of unit length."""
    z = x @ turn
    signs = z > 0
    return z, signs, np.abs(z).sum(axis=1) / sqrt(z.shape[1])


def estimate(signs: np.ndarray, factor: np.ndarray, z: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, bounds) of the inner products of coded rows with rotated vectors ``z``.

    ``<code, z> / <code, vector>`` is unbiased over the rotation; it is off by more than the bound with a probability
    that falls as exp(-epsilon**2 / 2).
    """
    d = z.shape[1]
    code = np.where(signs, np.float32(1 / sqrt(d)), np.float32(-1 / sqrt(d)))
    bound = epsilon * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (d - 1))
    return (code @ z.T) / factor[:, None], bound[:, None]


def plan(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits a key, tables): a pair at the threshold meets in some table with probability ``recall`` at least."""
    key = max(4, ceil(log2(max(rows, 2))))
    meet = (1 - acos(min(max(threshold, -1.0), 1.0)) / pi) ** key
    return key, max(1, ceil(log(1 - recall) / log(1 - meet))) if meet < 1 else 1


@cache
def key_planes(dim: int, key_bits: int, tables: int) -> np.ndarray:
    """Independent normals of the planes whose sides are the bits of the keys, table by table; the same on every worker."""
    return np.random.default_rng(SEED + 1).standard_normal((dim, tables * key_bits)).astype(np.float32)


def bucket_keys(x: np.ndarray, planes: np.ndarray, tables: int) -> np.ndarray:
    """The bucket of each row in every table: rows x tables. Vectors of other dimensions have other buckets."""
    sides = (x @ planes > 0).reshape(len(x), tables, -1)
    salt = mix64(np.arange(1, sides.shape[2] + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        return np.stack([mix64((sides[:, t] * salt).sum(axis=1, dtype=np.uint64) + np.uint64(t + x.shape[1] * 1_000_003)) for t in range(tables)], axis=1)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float32)
    x = flat.reshape(-1, dim)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def distinct_vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(every row with the node of its vector, usable nodes).

    Equal vectors are one node, named by a hash of the vector. Usable are vectors that are finite and not zero.
    """
    v = F.col(vec_col).cast("array<float>")
    node = F.when(v.isNull(), F.xxhash64(F.lit("null"), F.col(id_col).cast("long"))).otherwise(F.xxhash64(v, F.size(v)))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), node.alias("id"))
    fine = F.col("v").isNotNull() & F.expr("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30) AND exists(v, x -> abs(x) > 1e-30)")
    nodes = stored(rows.where(fine).groupBy("id").agg(F.first("v").alias("v")), "vectors")
    return rows, nodes


def near_pairs(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, epsilon: float = EPSILON) -> DataFrame:
    """(a, b): pairs of ids of ``nodes`` (id, v) with a cosine of at least ``threshold``, a < b. Every row is a query.

    Vectors are compared with those of their dimension. Pairs that meet in several tables are judged once, in the first
    table where they meet. Of a large bucket, rows that are surely near to one of them are linked to it, not to each other.
    """
    plans = {r["d"]: plan(r["count"], threshold, recall) for r in nodes.groupBy(F.size("v").alias("d")).count().collect()}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = np.asarray(batch.column(1).value_lengths())
            for dim, at in ((d, at) for d in np.unique(width).tolist() for at in range(0, int((width == d).sum()), 4096)):
                part = batch.take(pa.array(np.flatnonzero(width == dim)[at : at + 4096]))
                key_bits, tables = plans[dim]
                turn, planes = rotation(dim, code_bits(dim)), key_planes(dim, key_bits, tables)
                x = _unit(part.column(1), dim)
                z, signs, factor = encode(x, turn)
                m = len(part)
                keys = bucket_keys(x, planes, tables)
                scale = np.abs(z).max(axis=1) / 127
                query = np.round(z / scale[:, None]).astype(np.int8)  # rotated vector in 8 bits
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * tables, pa.int32()), pa.array(keys.view(np.int64).ravel())), pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary()), pa.array([r.tobytes() for r in query], pa.binary()), pa.array(factor.astype(np.float32)), pa.array(scale.astype(np.float32)), pa.array(np.full(m, dim, np.int32))],
                    names=["id", "keys", "code", "query", "factor", "scale", "d"],
                )

    coded = stored(nodes.select("id", "v").mapInArrow(keyed, "id long, keys array<bigint>, code binary, query binary, factor float, scale float, d int"), "codes")
    met = coded.select("id", F.posexplode("keys").alias("t", "bucket"), "keys", "code", "query", "factor", "scale", "d")
    crowded = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    met = met.join(sizable(crowded), "bucket", "left_semi").repartition("bucket").sortWithinPartitions("bucket")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            b = np.asarray(table.column("bucket"))
            if b[0] == b[-1]:  # one bucket so far
                continue
            cut = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
            yield from by_dimension(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from by_dimension(pa.Table.from_batches(held))

    def by_dimension(t: pa.Table) -> Iterator[pa.RecordBatch]:
        d = np.asarray(t.column("d"))
        for dim in np.unique(d).tolist():
            yield from compare(t.filter(pa.array(d == dim)).combine_chunks(), code_bits(dim), plans[dim][1])

    def compare(t: pa.Table, bits: int, tables: int) -> Iterator[pa.RecordBatch]:
        """Pairs of whole buckets, of which ``t`` has sorted rows of one dimension."""
        m = len(t)
        whole = {c: t.column(c).combine_chunks() for c in t.column_names}
        ids, b, at = np.asarray(whole["id"]), np.asarray(whole["bucket"]), np.asarray(whole["t"])
        keys = np.asarray(whole["keys"].flatten()).reshape(m, tables)
        signs = np.unpackbits(np.frombuffer(b"".join(whole["code"].to_pylist()), np.uint8).reshape(m, -1), axis=1)[:, :bits].astype(bool)
        query = np.frombuffer(b"".join(whole["query"].to_pylist()), np.int8).reshape(m, bits)
        factor, scale = np.asarray(whole["factor"]), np.asarray(whole["scale"])
        bound = epsilon * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (bits - 1))
        # The error of an 8-bit query is at most half a step in every place; its sum has this spread.
        step = epsilon * scale / sqrt(12)

        def open_pairs(one: np.ndarray, two: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of rows x and y with both estimates: what the bounds don't rule out and no earlier table has."""
            off, off2 = bound[x] + step[y] / factor[x], bound[y] + step[x] / factor[y]
            k = np.flatnonzero((one + off >= threshold) & (two + off2 >= threshold))
            k = k[~((keys[x[k]] == keys[y[k]]) & (np.arange(tables) < at[x[k]][:, None])).any(axis=1)]
            if len(k):
                p, q = ids[x[k]], ids[y[k]]
                sure = (one[k] - off[k] >= threshold) | (two[k] - off2[k] >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(sure)], names=["a", "b", "sure"])

        start = np.append(0, np.flatnonzero(b[1:] != b[:-1]) + 1)
        size = np.diff(np.append(start, m))
        # Small buckets together: row i of a bucket with each of the rows behind it.
        small = np.repeat(size <= SMALL, size)
        behind = np.where(small, np.repeat(start + size, size) - np.arange(m) - 1, 0)
        ends = np.cumsum(behind)
        lo = 0
        while lo < m:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            n = behind[lo:hi]
            x = np.repeat(np.arange(lo, hi), n)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            if len(x):
                dot = lambda i, j: np.einsum("ij,ij->i", np.where(signs[i], np.float32(1), np.float32(-1)), query[j].astype(np.float32)) * scale[j] / (sqrt(bits) * factor[i])
                yield from open_pairs(dot(x, y), dot(y, x), x, y)
            lo = hi
        # Large ones by blocks of products, after rows that are near to a leader joined its group.
        for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
            group, free, poor = np.arange(s, s + n), np.arange(s, s + n), 0
            while len(free) > SMALL and poor < 4:
                lead = free[0]
                one, off = estimate(signs[free], factor[free], (query[lead].astype(np.float32) * scale[lead])[None, :], epsilon)
                near = (one[:, 0] - off[:, 0] - step[lead] / factor[free] >= threshold) & (free != lead)
                x, free = free[near], free[1:][~near[1:]]
                group[x - s] = lead
                poor += len(x) < SMALL
                p, q = np.minimum(ids[x], ids[lead]), np.maximum(ids[x], ids[lead])
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(np.ones(len(x), bool))], names=["a", "b", "sure"])
            row = s + np.argsort(group, kind="stable")
            group = group[row - s]
            for i in range(0, n, BLOCK):
                I, gi = row[i : i + BLOCK], group[i : i + BLOCK]
                zi = query[I].astype(np.float32) * scale[I][:, None]
                for j in range(i, n, BLOCK):
                    J, gj = row[j : j + BLOCK], group[j : j + BLOCK]
                    if gi[0] == gj[-1]:
                        continue
                    zj = zi if i == j else query[J].astype(np.float32) * scale[J][:, None]
                    one, _ = estimate(signs[I], factor[I], zj, epsilon)
                    two = estimate(signs[J], factor[J], zi, epsilon)[0].T
                    # A first, looser cut by the largest bounds, so that few pairs are spelt out.
                    reach = threshold - (bound[s : s + n].max() + step[s : s + n].max() / factor[s : s + n].min())
                    possible = (one >= reach) & (two >= reach)
                    possible &= gi[:, None] != gj[None, :]
                    if i == j:
                        possible &= np.tri(len(I), k=-1, dtype=bool).T
                    u, v = np.nonzero(possible)
                    if len(u):
                        yield from open_pairs(one[u, v], two[u, v], I[u], J[v])

    judged = stored(met.select("bucket", "id", "t", "keys", "code", "query", "factor", "scale", "d").mapInArrow(judge, "a long, b long, sure boolean"), "estimated")
    vectors = nodes.select("id", "v")
    open_ = judged.where(~F.col("sure")).join(sizable(vectors.withColumnsRenamed({"id": "a", "v": "va"})), "a").join(sizable(vectors.withColumnsRenamed({"id": "b", "v": "vb"})), "b")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    cosine = dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va"))) / F.sqrt(dot(F.col("vb"), F.col("vb")))
    return judged.where("sure").select("a", "b").unionByName(open_.where(cosine >= threshold).select("a", "b"))


#: All pairs, exactly. The search finds a pair with a probability (``RECALL``), but all of those of well-parted groups.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
c AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT n.b, c.root FROM c JOIN n ON n.a = c.id)
SELECT id AS vec_id, min(root) AS group_id, id = min(root) AS kept FROM c GROUP BY id
"""


def near_groups(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, epsilon: float = EPSILON) -> DataFrame:
    """(vec_id, group_id, kept): the group of near-duplicates of every row; group_id is its least id, whose row is kept.

    A group is a connected component of the pairs with a cosine of at least ``threshold``.

    * Equal vectors are always in one group, whatever they are; null vectors only with rows of the same id.
    * Vectors that are zero, not finite or with null elements have no near-duplicates but equal ones. Vectors of several
      dimensions are each compared with those of their own.
    * Repeated rows are in one group and none but one of them is kept. Null ids come first, and a group of only null ids
      has a null group_id. An empty table gives no rows. Further columns are not used, whatever their names.
    """
    rows, nodes = distinct_vectors(table, id_col, vec_col)
    roots = components(near_pairs(nodes, threshold, recall, epsilon))
    marked = rows.select("vec_id", "id").join(sizable(roots), "id", "left").select("vec_id", F.coalesce("root", "id").alias("root"))
    counted = marked.groupBy("root", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    heads = marked.groupBy("root").agg(F.min(F.struct("vec_id")).alias("head"))
    joined = counted.join(sizable(heads), "root")
    each = joined.select("vec_id", F.col("head.vec_id").alias("group_id"), F.posexplode(F.expr("array_repeat(1, CAST(n AS INT))")).alias("i", "x"))
    return each.select("vec_id", "group_id", (F.col("vec_id").eqNullSafe(F.col("group_id")) & (F.col("i") == 0)).alias("kept"))

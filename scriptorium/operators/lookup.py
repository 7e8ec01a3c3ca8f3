"""Lookups in side tables: mappings, segmentations, missing words, vocabulary tests, triangulation, lexical scores.

Side tables are joined as DataFrames, so their size is Spark's to judge: it broadcasts a small one by its own threshold
and shuffles a large one. Distinct words are looked up, not tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..corpus import tokens
from ..functions.text import FIVEDOT, java_quote, latin_letters, truncate_words
from ..storage import stored
from .counts import word_pairs

#: Tokens of a block, and rows that are looked at together while it is filled.
BLOCK_TOKENS, SLICE_ROWS = 1 << 19, 1 << 10


def last_of(df: DataFrame, key: str, value: str, order: Sequence[str]) -> DataFrame:
    """One row a key: the value of the last one in order."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def _blocks(lines: DataFrame, column: str, block_tokens: int) -> DataFrame:
    """(block, rows, sizes, at, words), written: the rows of a block without ``column``, their numbers of tokens, the place
    of every token in ``words``, and the different tokens."""
    rest = [c for c in lines.columns if c != column]
    split = lines.select(tokens(column).alias("__t"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = whole.column(0).combine_chunks()
            coded = texts.flatten().dictionary_encode()
            sizes = np.asarray(pc.fill_null(pc.list_value_length(texts), 0)).astype(np.int32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.drop_columns("__t").schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole.drop_columns("__t"))
            words = coded.dictionary.cast(pa.string())
            packed = [pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), sizes.tobytes(), np.asarray(coded.indices).astype(np.int32).tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([task + made], pa.int64()), *packed, pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)], names=["block", "rows", "sizes", "at", "words"])

        for batch in batches:
            for a in range(0, len(batch), SLICE_ROWS):
                held.append(batch.slice(a, SLICE_ROWS))
                n += len(held[-1].column(0).flatten())
                if n >= block_tokens:
                    yield block()
                    made, held, n = made + 1, [], 0
        if held:
            yield block()

    return stored(split.mapInArrow(run, "block long, rows binary, sizes binary, at binary, words array<string>"), "token-blocks")


def map_tokens(lines: DataFrame, mapping: DataFrame, keys: Sequence[str], column: str = "line", key_of: Callable[[Column], Column] = lambda t: t, restore: Callable[[Column, Column], Column] = lambda t, to: to, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Replaces tokens by the mapping's (src, trg); tokens without an entry stay. A source has one entry.

    Lines are written in blocks of about ``block_tokens`` tokens. Only the different tokens of a block are joined to the
    mapping, so neither table has to fit anywhere, and those that change go back to their block.
    """
    order = list(lines.columns) if set(lines.columns) - {*keys, column} else [*keys, column]
    rest = [c for c in lines.columns if c != column]
    blocks = _blocks(lines.select(*order), column, block_tokens)
    each = blocks.select("block", F.posexplode("words").alias("i", "t")).withColumn("src", key_of(F.col("t")))
    joined = each.join(mapping.select("src", "trg"), "src").where(F.col("trg").isNotNull())
    changed = joined.select("block", F.struct("i", restore(F.col("t"), F.col("trg")).alias("w")).alias("x"))
    found = changed.groupBy("block").agg(F.array_sort(F.collect_list("x")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(len(batch)):
                rows, sizes, at, words, new = (c[j] for c in batch.columns)
                said = words.values.to_pylist()
                for i, w in (zip(*(new.values.field(k).to_pylist() for k in range(2))) if new.is_valid else ()):
                    said[i] = w
                ends = np.append(0, np.cumsum(np.frombuffer(sizes.as_buffer(), np.int32), dtype=np.int64)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(said, pa.string()).take(pa.array(np.frombuffer(at.as_buffer(), np.int32))))
                whole = pa.ipc.open_stream(rows.as_buffer()).read_all().combine_chunks()
                columns = dict(zip(rest, (whole.column(k).combine_chunks() for k in range(len(rest))))) | {column: pc.binary_join(lists, " ")}
                yield pa.RecordBatch.from_arrays([columns[c] for c in order], names=order)

    schema = T.StructType([T.StructField(c, T.StringType()) if c == column else lines.schema[c] for c in order])
    # Blocks are large and few; what is joined to them is their own.
    return blocks.join(found.hint("merge"), "block", "left").select("rows", "sizes", "at", "words", "found").mapInArrow(run, schema)


def unmapped(lines: DataFrame, mapping: DataFrame, column: str = "line", key_of: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """(word, count) of the tokens that the mapping lacks: the log of a mapping, least frequent first when sorted."""
    words = lines.select(F.explode(tokens(column)).alias("t")).groupBy(key_of(F.col("t")).alias("word")).agg(F.count(F.lit(1)).alias("count"))
    return words.join(mapping.select(F.col("src").alias("word")), "word", "left_anti")


def strip_marker(token: Column, marker: str = FIVEDOT) -> Column:
    m = java_quote(marker)
    return F.regexp_replace(token, f"^(?:{m})+|(?:{m})+$", "")


def segmentation_map(rows: DataFrame, order: Sequence[str], column: str = "line", marker: str = FIVEDOT + " ", pre_marked: bool = False) -> DataFrame:
    """(src, trg) from lines of segmented words; the last of equal surfaces wins."""
    parts = tokens(column)
    joined = F.array_join(parts, "")
    src = F.replace(joined, F.lit(marker.replace(" ", "")), F.lit("")) if pre_marked else joined
    trg = F.trim(F.col(column)) if pre_marked else F.array_join(parts, marker)
    return last_of(rows.select(src.alias("src"), trg.alias("trg"), *order), "src", "trg", order)


def apply_segmentation(lines: DataFrame, mapping: DataFrame, keys: Sequence[str], column: str = "line", marker: str = FIVEDOT) -> DataFrame:
    """Segments tokens; boundary markers at their edges are taken off for the lookup and put back."""

    def restore(t: Column, to: Column) -> Column:
        edge = lambda has: F.when(has, F.lit(marker)).otherwise(F.lit(""))
        return F.concat(edge(F.startswith(t, F.lit(marker))), to, edge(F.endswith(t, F.lit(marker))))

    return map_tokens(lines, mapping, keys, column, lambda t: strip_marker(t, marker), restore)


def missing_segmentations(words: DataFrame, mapping: DataFrame, order: Sequence[str], column: str = "word") -> DataFrame:
    """Words without an entry, each once, in the order of first use."""
    first = words.groupBy(column).agg(F.min(F.struct(*order)).alias("__first"))
    return first.join(mapping.select(F.col("src").alias(column)), column, "left_anti").orderBy("__first").select(column, *[F.col(f"__first.{c}").alias(c) for c in order])


def override_segmentation(main: DataFrame, override: DataFrame, order: Sequence[str], column: str = "line", marker: str = FIVEDOT) -> DataFrame:
    """(src, line): the override's last row of a surface, else the first of the main table."""
    surface = F.replace(F.array_join(tokens(column), ""), F.lit(marker), F.lit(""))
    key = F.struct(*order)
    first = main.groupBy(surface.alias("src")).agg(F.min_by(column, key).alias("m"))
    last = override.groupBy(surface.alias("src")).agg(F.max_by(column, key).alias("o"))
    return first.join(last, "src", "full_outer").select("src", F.coalesce("o", "m").alias(column))


def drop_oov(lines: DataFrame, vocabulary: DataFrame, keys: Sequence[str], column: str = "line") -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): lines of which a token is not among the vocabulary's words."""
    bad = lines.select(*keys, F.explode(tokens(column)).alias("word")).join(vocabulary.select("word"), "word", "left_anti").select(*keys).distinct()
    return lines.join(bad, list(keys), "left_anti"), lines.join(bad, list(keys), "left_semi")


def cluster_examples(clusters: DataFrame, order: Sequence[str]) -> DataFrame:
    """(src, trg) from (word, cluster): every word to the first word of its cluster."""
    key = F.struct(*order)
    first = clusters.groupBy("cluster").agg(F.min_by("word", key).alias("trg"))
    return last_of(clusters.join(first, "cluster").select(F.col("word").alias("src"), "trg", *order), "src", "trg", order)


def add_lookup_feature(lines: DataFrame, features: DataFrame, keys: Sequence[str], column: str = "line", sep: str = "￨", fallback: str = "unk", marker: str = "@@") -> DataFrame:
    """Appends the feature (src, trg) of each token without its markers; a miss is ``<UNK>`` or, with ``copy``, the token."""
    if fallback not in ("unk", "copy"):
        raise ValueError("fallback is unk or copy")
    at = lines.select(*keys, F.posexplode_outer(tokens(column)).alias("__at", "__t")).withColumn("src", F.replace("__t", F.lit(marker), F.lit("")))
    value = F.coalesce("trg", F.lit("<UNK>") if fallback == "unk" else F.col("src"))
    marked = at.join(features.select("src", "trg"), "src", "left").withColumn("w", F.concat("__t", F.lit(sep), value))
    return marked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("__at", "w")))), lambda x: x["w"]), " ").alias(column))


def triangulate(a: DataFrame, b: DataFrame, order: str = "line_no") -> DataFrame:
    """(order, pivot, a, b) of two corpora with columns (order, pivot, text) that share a pivot language.

    Pivots meet in their a-z letters. Of equal pivots in ``a`` the last one counts; rows are those of ``b``.
    """
    key = latin_letters("pivot")
    left = a.groupBy(key.alias("k")).agg(F.max_by("text", order).alias("a"))
    return b.withColumn("k", key).join(left, "k").select(order, "pivot", "a", F.col("text").alias("b"))


def lexical_match_score(rows: DataFrame, pairs: DataFrame, keys: Sequence[str], src: str = "src", trg: str = "trg", truncate: Callable[[str], Column] = truncate_words) -> DataFrame:
    """(keys, score): less the share of tokens that the other side has, or has a partner of; null without tokens.

    ``pairs`` has (src, trg), used in both directions. The linked tokens of a line are found by a join on its tokens.
    """
    cut = rows.select(*keys, tokens(truncate(src)).alias("s"), tokens(truncate(trg)).alias("t"))
    link = pairs.select("src", "trg").distinct()

    def hits(mine: str, other: str, a: str, b: str) -> DataFrame:
        each = cut.select(*keys, F.col(other).alias("o"), F.posexplode(mine).alias("at", "w"))
        partners = link.groupBy(F.col(a).alias("w")).agg(F.collect_set(b).alias("ps"))
        hit = F.array_contains("o", F.col("w")) | F.coalesce(F.arrays_overlap("o", "ps"), F.lit(False))
        return each.join(partners, "w", "left").select(*keys, hit.cast("int").alias("hit"))

    both = hits("s", "t", "src", "trg").unionByName(hits("t", "s", "trg", "src"))
    found = both.groupBy(*keys).agg((-F.sum("hit") / F.count(F.lit(1))).alias("score"))
    return rows.select(*keys).join(found, list(keys), "left")


def train_lexical_match(rows: DataFrame, keys: Sequence[str], align: Callable[[DataFrame], DataFrame], src: str = "src", trg: str = "trg", truncate: Callable[[str], Column] = truncate_words, marker: str | None = FIVEDOT, min_freq: int = 2, at_most: int | None = None) -> DataFrame:
    """(src, trg, count): the word pairs for ``lexical_match_score``, learned from parallel lines.

    Words are truncated as the score does it; ``align`` adds the column ``alignment`` of ``i-j`` links to the truncated
    lines (keys, src, trg), e.g. by aligners in both directions and their symmetrisation (``plans.recipe.program``);
    pairs of linked words are counted, boundary markers aside.
    """
    cut = rows.select(*keys, truncate(src).alias(src), truncate(trg).alias(trg))
    return word_pairs(align(cut), keys, src=src, trg=trg, min_freq=min_freq, at_most=at_most, marker=marker)


def levenshtein(left: str, right: str) -> Column:
    return F.levenshtein(F.col(left), F.col(right))

"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

A block is a run of documents of one input partition of about ``BLOCK_WORDS`` words. It is written as its distinct words
and, for every document, the places of its words among them. So the table of distinct words meets one row a word and
block, not one a word of the text, and the ids come back to the same places.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import expire, fresh_path

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words of a block, words that are looked at together, and pieces that a vocabulary may have to be sent to all workers.
BLOCK_WORDS, SLICE_WORDS, MOST_PIECES = 1 << 22, 1 << 19, 1 << 22
#: The byte-level BPE pattern for Java, in which \s means every Unicode space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _encoder(known: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=known, special_tokens={})


@cache
def encoder(path: str = VOCABULARY):
    return _encoder(ranks(path))


def _sent(spark: SparkSession, vocabulary: str):
    """The vocabulary, read once on the driver and sent to the workers; its size depends on no corpus and is checked."""
    known = ranks(vocabulary)
    if len(known) > MOST_PIECES:
        raise ValueError(f"a vocabulary of more than {MOST_PIECES} pieces")
    return spark.sparkContext.broadcast(known)


def words_of(text: Column) -> Column:
    """The words of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _slices(batch: pa.RecordBatch, most: int = SLICE_WORDS, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` elements of a list column."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(column)), 0)))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _lists(ends: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _one_list(values: np.ndarray | pa.Array) -> pa.ListArray:
    return _lists(np.array([0, len(values)]), values)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the greatest needs: that width, then all their first bytes, all their second ones
    and so on, which compress better apart."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def _unpack(packed: bytes | memoryview) -> np.ndarray:
    width = packed[0]
    out = np.zeros(((len(packed) - 1) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<u4").ravel().astype(np.int64)


def write_blocks(docs: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, docs, sizes, at, words), written and bucketed by ``block``: the ids of its rows, their numbers of words,
    the packed places of all their words in ``words``, and the distinct words, most frequent first."""
    spark = docs.sparkSession
    split = docs.select(F.col(id_col).alias("doc_id"), words_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, n = TaskContext.get().partitionId() << 32, 0, 0
        ids, sizes, coded = [], [], []

        def block() -> pa.RecordBatch:
            both = pa.chunked_array(coded).unify_dictionaries()
            at = np.concatenate([np.asarray(c.indices) for c in both.chunks])
            words = both.chunk(both.num_chunks - 1).dictionary.cast(pa.string())
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words, at = words.take(pa.array(order)), rank[at]
            columns = [pa.array([first + made], pa.int64()), _one_list(pa.concat_arrays(ids)), _one_list(np.concatenate(sizes)), pa.array([_pack(at)], pa.binary()), _one_list(words)]
            return pa.RecordBatch.from_arrays(columns, names=["block", "docs", "sizes", "at", "words"])

        for batch in batches:
            for piece in _slices(batch, min(SLICE_WORDS, block_words)):
                ids.append(piece.column(0))
                sizes.append(np.asarray(pc.list_value_length(piece.column(1))).astype(np.int32))
                coded.append(piece.column(1).flatten().dictionary_encode())
                n += len(coded[-1])
                if n >= block_words:
                    yield block()
                    made, n, ids, sizes, coded = made + 1, 0, [], [], []
        if ids:
            yield block()

    kind = split.schema["doc_id"].dataType.simpleString()
    path = fresh_path(spark, "blocks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    blocks = split.mapInArrow(run, f"block long, docs array<{kind}>, sizes array<int>, at binary, words array<string>")
    blocks.write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    expire(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out


def encode_words(blocks: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(block, places, sizes, ids) from the words of blocks: equal words come together and are encoded once.

    A row holds what one task found for one block, packed: steps from place to place, their numbers of ids, and the ids.
    """
    sent = _sent(blocks.sparkSession, vocabulary)
    each = blocks.select("block", F.posexplode("words").alias("place", "word")).select("word", "block", "place")
    # A word comes once from each block, so a frequent one has as many rows as there are blocks, and no more.
    sorted_words = each.repartition("word").sortWithinPartitions("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        enc = _encoder(known)
        last, last_ids = None, []
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            block, place, size = (np.concatenate([h[i] for h in held]) for i in range(3))
            ids = np.concatenate([h[3] for h in held])
            order = np.lexsort((place, block))
            start = np.cumsum(size) - size
            take = size[order]
            ends = np.cumsum(take)
            ids = ids[np.repeat(start[order] - (ends - take), take) + np.arange(len(ids))]
            block, place = block[order], place[order]
            cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
            at = np.append(0, ends)[cuts]
            for a in range(0, len(cuts) - 1, 1024):
                some = range(a, min(a + 1024, len(cuts) - 1))
                steps = [_pack(np.diff(place[cuts[i] : cuts[i + 1]], prepend=0)) for i in some]
                packed = [steps, [_pack(take[cuts[i] : cuts[i + 1]]) for i in some], [_pack(ids[at[i] : at[i + 1]]) for i in some]]
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts[some[0] : some[-1] + 1]]), *[pa.array(x, pa.binary()) for x in packed]], names=["block", "places", "sizes", "ids"])

        for batch in batches:
            words = batch.column(0)
            new = np.append(True, np.asarray(pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)))) if len(words) else np.zeros(0, bool)
            at = np.flatnonzero(new)
            ids, ends = [], [0]
            for i, w in enumerate(words.take(pa.array(at)).to_pylist()):
                if i or w != last:
                    one = known.get(w.encode())
                    last, last_ids = w, enc.encode_ordinary(w) if one is None else [one]
                ids.extend(last_ids)
                ends.append(len(ids))
            size, flat = np.diff(ends), np.array(ids, np.int32)
            of = np.cumsum(new) - 1
            take = size[of]
            stop = np.cumsum(take)
            every = flat[np.repeat(np.array(ends)[of] - (stop - take), take) + np.arange(stop[-1] if len(stop) else 0)]
            held.append((np.asarray(batch.column(1)), np.asarray(batch.column(2)), take.astype(np.int32), every))
            n += len(words)
            if n >= 1 << 20:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return sorted_words.mapInArrow(run, "block long, places binary, sizes binary, ids binary")


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, block_words: int) -> DataFrame:
    """(docs, sizes, at, found) of every block; ``found`` has what ``encode_words`` gives for it."""
    blocks = write_blocks(docs, id_col, text_col, block_words)
    found = encode_words(blocks, vocabulary).groupBy("block").agg(F.collect_list(F.struct("places", "sizes", "ids")).alias("found"))
    # The blocks lie in the buckets of their table, so only the ids are exchanged.
    return blocks.select("block", "docs", "sizes", "at").join(found, "block", "left").select("docs", "sizes", "at", "found")


def _documents(block: tuple) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids of documents, ends of their lists, token ids) of a row of ``_encoded``, in slices."""
    docs, sizes, at, found = block
    unpack = lambda name, f=lambda x: x: np.concatenate([f(_unpack(x[name])) for x in found]) if found else np.zeros(0, np.int64)
    place, size, flat = unpack("places", np.cumsum), unpack("sizes"), unpack("ids").astype(np.int32)
    start, length = np.full(len(place), -1, np.int64), np.zeros(len(place), np.int64)
    start[place], length[place] = np.cumsum(size) - size, size
    if len(at) and (at.max() >= len(place) or (start < 0).any()):
        raise ValueError("a block without all of its words")
    ends = np.append(0, np.cumsum(sizes))
    a = 0
    while a < len(docs):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_WORDS, side="right")) - 1)
        words = at[ends[a] : ends[b]]
        n = length[words]
        stop = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(start[words] - stop[:-1], n) + np.arange(stop[-1])]
        yield docs.slice(a, b - a), stop[ends[a : b + 1] - ends[a]], ids
        a = b


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(len(batch)):
            docs, sizes, at, found = (c[i] for c in batch.columns)
            yield docs.values, np.asarray(sizes.values), _unpack(at.as_buffer()), found.as_py() or []


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, ids): the token ids of every row's text.

    1. Spark splits the texts into words; blocks of rows are written as distinct words and their places.
    2. A shuffle brings equal words of all blocks together; each distinct word of the corpus is encoded once.
    3. The ids are joined back to the blocks, and by place to every word of every row.

    Texts are never exchanged, and nothing is broadcast but the vocabulary.

    * A null or empty text has an empty list. Repeated rows are each encoded. An empty table gives no rows.
    * Texts are cut at no length; a text of more words than a block is a block of its own. Other columns are not used,
      whatever their names.
    """
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for ids, ends, flat in _documents(block):
                yield pa.RecordBatch.from_arrays([ids, _lists(ends, flat)], names=["doc_id", "ids"])

    return _encoded(docs, id_col, text_col, vocabulary, block_words).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def pieces(spark: SparkSession, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, piece): the bytes of every token of the vocabulary."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(vocabulary).items()], "id int, piece binary")


class _Pieces:
    """The table (id, piece) as the built side of a hash join."""

    def __init__(self, table: pa.Table):
        self.id = table.column("id").combine_chunks()
        piece = table.column("piece").combine_chunks().cast(pa.large_binary())
        self.start, self.raw = np.frombuffer(piece.buffers()[1], np.int64)[: len(piece) + 1], np.frombuffer(piece.buffers()[2], np.uint8)

    def texts(self, lists: pa.ListArray) -> pa.Array:
        """The pieces of every list, joined by id, one after the other."""
        at = pc.index_in(lists.flatten(), self.id)
        if at.null_count:
            raise ValueError("an id is outside of the vocabulary")
        at = np.asarray(at)
        size = self.start[at + 1] - self.start[at]
        ends = np.append(0, np.cumsum(size))
        data = self.raw[np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0))))]
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])], pa.string(), mask=np.asarray(pc.is_null(lists)))


def _sent_pieces(spark: SparkSession, vocabulary: str):
    table = pieces(spark, vocabulary).toArrow()
    if len(table) > MOST_PIECES:
        raise ValueError(f"a vocabulary of more than {MOST_PIECES} pieces")
    return spark.sparkContext.broadcast(table)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids).

    The table of ``pieces`` is sent to all workers, as its size is that of the vocabulary, whatever the corpus, and ids
    are joined to it by hash where they are. Bytes that are no UTF-8 become U+FFFD. A null list gives a null text, an
    empty list an empty one; an id outside of the vocabulary raises an error.
    """
    sent = _sent_pieces(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = _Pieces(sent.value)
        for batch in batches:
            for piece in _slices(batch):
                yield pa.RecordBatch.from_arrays([piece.column(0), join.texts(piece.column(1))], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids, text): every text encoded as in ``encode``, and decoded again from its ids as in ``decode``."""
    sent = _sent_pieces(docs.sparkSession, vocabulary)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = _Pieces(sent.value)
        for block in _blocks(batches):
            for docs_, ends, flat in _documents(block):
                ids = _lists(ends, flat)
                yield pa.RecordBatch.from_arrays([docs_, pa.array(np.diff(ends).astype(np.int32)), ids, join.texts(ids)], names=["doc_id", "n_tokens", "ids", "text"])

    return _encoded(docs, id_col, text_col, vocabulary, block_words).mapInArrow(run, f"doc_id {kind}, n_tokens int, ids array<int>, text string")

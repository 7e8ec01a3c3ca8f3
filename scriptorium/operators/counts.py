"""Counts of tokens and characters, their algebra, TF-IDF, and word pairs of alignments."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..corpus import tokens, with_position
from ..functions.text import chars


def sort_counts(counts: DataFrame) -> DataFrame:
    """Most frequent first, ties by word in the order of code points."""
    return counts.orderBy(F.desc("count"), "word")


def count_tokens(lines: DataFrame, column: str = "line") -> DataFrame:
    """(word, count), in no order; see ``sort_counts``."""
    return lines.select(F.explode(tokens(column)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def count_chars(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.select(F.explode(chars(column)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def common_chars(char_counts: DataFrame, min_count: int = 10) -> list[str]:
    """The characters that occur at least ``min_count`` times; an alphabet, which Unicode bounds."""
    return [r["word"] for r in char_counts.where(F.col("count") >= min_count).select("word").collect()]


def scale_counts(counts: DataFrame, scale: float) -> DataFrame:
    return counts.withColumn("count", F.ceil(F.col("count") * F.lit(float(scale))).cast("long"))


def combine_counts(tables: Sequence[DataFrame], balance: bool = False, threshold: int = 0, marker: str | None = None) -> DataFrame:
    """Sums of counts over tables.

    Rows below ``threshold`` are left out, but count in the sums by which ``balance`` scales each table up to the
    largest one (scaled counts are truncated). ``marker`` is stripped off the words first.
    """
    word = F.regexp_replace("word", f"^(?:{marker})+|(?:{marker})+$", "") if marker else F.col("word")
    rows = reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(i).alias("src"), word.alias("word"), "count") for i, t in enumerate(tables)])
    kept = rows.where(F.col("count") >= threshold).groupBy("src", "word").agg(F.sum("count").alias("count"))
    if balance:
        sums = rows.groupBy("src").agg(F.sum("count").alias("total"))
        largest = sums.agg(F.max("total").alias("largest"))
        scale = sums.crossJoin(largest).select("src", (F.col("largest") / F.col("total")).alias("scale"))  # a row a table
        kept = kept.join(scale, "src").withColumn("count", F.when(F.col("scale") == 1, F.col("count")).otherwise((F.col("count") * F.col("scale")).cast("long")))  # as many rows as input tables
    return kept.groupBy("word").agg(F.sum("count").alias("count"))


def combine_wordlists(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.select("word") for t in tables]).distinct()


def threshold_counts(counts: DataFrame, threshold: int) -> DataFrame:
    return counts.where(F.col("count") >= threshold)


def filter_counts(counts: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Applies a predicate (true removes) to the words."""
    return counts.where(~F.coalesce(predicate(F.col("word")), F.lit(False)))


def remove_counts(counts: DataFrame) -> DataFrame:
    return counts.select("word")


def dampen_counts(counts: DataFrame, how: str | Callable[[Column], Column] = "log") -> DataFrame:
    """``none``, ``log`` (log2 of count + 1, rounded), ``ones``, or a function of the count."""
    f = {"none": lambda c: c, "log": lambda c: F.bround(F.log2(c + 1)).cast("long"), "ones": lambda c: F.lit(1).cast("long")}.get(how, how) if isinstance(how, str) else how
    if isinstance(f, str):
        raise ValueError(f"unknown damping: {f}")
    return counts.withColumn("count", f(F.col("count")))


def reverse_counts(counts: DataFrame) -> DataFrame:
    return counts.select("word", "count")


def segment_counts(counts: DataFrame, segmentation: DataFrame) -> DataFrame:
    """Counts of the parts of words; ``segmentation`` has (surface, parts), a word without an entry is its own part."""
    joined = counts.join(segmentation.select(F.col("surface").alias("word"), "parts"), "word", "left")
    parts = F.coalesce("parts", F.array("word"))
    return joined.select(F.explode(parts).alias("word"), "count").groupBy("word").agg(F.sum("count").alias("count"))


def tf_idf(lines: DataFrame, doc_col: str = "doc_id", column: str = "line", order: Sequence[str] | None = None) -> DataFrame:
    """(word, tf, df, weight) over the corpus: ln(1 + tf) * ln(documents / (1 + df)).

    With ``order`` a document is a run of rows with equal ids in that order, so an id that comes back counts again. A run
    is named by the id and its first place less the number of earlier rows of the id, so no task sees all rows.
    """
    rows = lines
    doc = F.col(doc_col)
    if order:
        rows = with_position(lines, list(order), "__at")
        rows = rows.withColumn("__run", F.col("__at") - F.row_number().over(Window.partitionBy(doc).orderBy("__at")))
        doc = F.struct(doc, "__run")
    per_doc = rows.select(doc.alias("d"), F.explode(tokens(column)).alias("word")).groupBy("word", "d").agg(F.count(F.lit(1)).alias("n"))
    counts = per_doc.groupBy("word").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    total = rows.agg(F.count_distinct(doc).alias("__docs"))
    return counts.crossJoin(total).select("word", "tf", "df", (F.log(1 + F.col("tf")) * F.log(F.col("__docs") / (1 + F.col("df")))).alias("weight"))


def word_pairs(rows: DataFrame, order: Sequence[str], alignment: str = "alignment", src: str = "src", trg: str = "trg", min_freq: int = 2, at_most: int | None = None, marker: str | None = None) -> DataFrame:
    """(src, trg, count) of aligned words, ``alignment`` being ``i-j`` pairs, most frequent first, ties by first use.

    ``at_most`` keeps so many pairs of each word, on either side, counted down the ranked list.
    """
    side = lambda c: tokens(F.replace(F.col(c), F.lit(marker), F.lit("")) if marker else c)
    cut = rows.select(*order, side(src).alias("s"), side(trg).alias("t"), F.posexplode(tokens(alignment)).alias("at", "link"))
    link = F.split("link", "-")
    pick = lambda words, i: F.coalesce(F.try_element_at(words, link[i].cast("int") + 1), F.raise_error(F.concat(F.lit("alignment out of range: "), F.col("link"))))
    pairs = cut.select(pick("s", 0).alias("src"), pick("t", 1).alias("trg"), F.struct(*order, "at").alias("first"))
    counted = pairs.groupBy("src", "trg").agg(F.count(F.lit(1)).alias("count"), F.min("first").alias("first")).where(F.col("count") >= min_freq)
    rank = [F.desc("count"), "first"]
    if at_most is not None:
        for c in ("src", "trg"):
            counted = counted.withColumn(f"__{c}", F.row_number().over(Window.partitionBy(c).orderBy(*rank)))
        counted = counted.where((F.col("__src") <= at_most) & (F.col("__trg") <= at_most)).drop("__src", "__trg")
    return counted.orderBy(*rank).select("src", "trg", "count")

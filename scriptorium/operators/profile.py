"""Corpus profile: size, case, hyphens, markers, quotes and other habits of each group of lines, over all lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..corpus import tokens
from ..functions.text import FIVEDOT

#: heading -> label -> patterns; hits of a label's patterns are added up.
PATTERNS: dict[str, dict[str, tuple[str, ...]]] = {
    "numbers": {"tag": ("[&<]number[;>]",), "raw": (r"(?<=\s)\p{Digit}+(?=\s)",)},
    "boundary": {"comp": (r"(?<=\S)@ ",), "plus": (r" \+(?=\S)", r"\+ (?=\S)"), "5dot": (f" {FIVEDOT}(?=\\S)", f"{FIVEDOT} (?=\\S)"), "omor": (r"\{[^}]+\}",), "none": (r"(?U)\w \w",)},
    "clitics": {"split": (" 's ",), "split escaped": (" &apos;s ",), "over-split": (" ' s ",), "over-split escaped": (" &apos; s ",), "whole": (r"\S's ",), "whole escaped": (r"\S&apos;s ",), "wrong": (r"\S' s ",), "wrong escaped": (r"\S&apos; s ",)},
    "quotes": {"inside": (r'[,.]\s*"',), "inside escaped": (r"[,.]\s*&quot;",), "outside": (r'"\s*[,.]',), "outside escaped": (r"&quot;\s*[,.]",)},
    "escaping": {"plain": ('"', "'", r" \| "), "escaped": ("&quot;", "&apos;", "&#124;")},
    "weird": {"+ +": (r"\+ \+",), "@ @": ("@ @",), "a@a": (r"\S@\S",)},
    "xml": {"tag": ("<[^>]*>",)},
    "unk": {"unk": ("[&<](?:UNK|unk)[;>]",)},
}


def hits(line: Column, patterns: Sequence[str]) -> Column:
    return sum((F.regexp_count(line, F.lit(p)) for p in patterns), F.lit(0))


def magnitude(n: Column) -> Column:
    """The number below 10, else d, h, k or ! for tens, hundreds, thousands and more."""
    return F.when(n < 10, n.cast("string")).when(n < 100, "d").when(n < 1000, "h").when(n < 10000, "k").otherwise("!")


def first_case(line: Column) -> Column:
    c = F.substring(line, 1, 1)
    return F.when(F.regexp_like(c, F.lit(r"\p{Lu}")), "U").when(F.regexp_like(c, F.lit(r"\p{Ll}")), "L").when(F.regexp_like(c, F.lit(r"\p{Nd}")), "N").otherwise("?")


def column_kind(line: Column) -> Column:
    """Number of columns and u, t or p by their separator (unit separator, tab, three bars), or no."""
    n = lambda sep: F.size(F.split(line, sep, -1))
    u, t, p = n("\x1f"), n("\t"), n(r"\|\|\|")
    name = lambda k, s: F.concat(k.cast("string"), F.lit(s))
    return F.when(u > 1, name(u, "u")).when(t > 1, name(t, "t")).when(p > 1, name(p, "p")).otherwise("no")


def pattern_counts(lines: DataFrame, group: Sequence[str], column: str = "line") -> DataFrame:
    """One row a group: the lines, greatest sizes, and the hits of every pattern, in one pass."""
    x = F.col(column)
    named = {f"{head}_{label}".replace(" ", "_").replace("-", "_"): F.sum(hits(x, ps)).cast("long") for head, labels in PATTERNS.items() for label, ps in labels.items()}
    return lines.groupBy(*group).agg(F.count(F.lit(1)).alias("line_count"), F.max(F.size(tokens(x))).cast("long").alias("max_tokens"), F.max(F.length(x)).cast("long").alias("max_chars"), *[e.alias(n) for n, e in named.items()])


def label_counts(lines: DataFrame, group: Sequence[str], column: str = "line") -> DataFrame:
    """(group, heading, label, count) of the case of lines, kinds of columns, and the neighbours of hyphens and periods."""
    x = F.col(column)
    near = lambda p, i: F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(0)), lambda m: F.regexp_replace(i(m), r"(?U)\s", " "))
    head = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("heading"), v.alias("label")))
    every = F.concat(
        head("case", F.array(first_case(x))),
        head("columns", F.array(column_kind(x))),
        head("hyphens", near(".-.", lambda m: F.concat(F.substring(m, 1, 1), F.substring(m, 3, 1)))),
        head("periods", near(r".\.", lambda m: F.substring(m, 1, 1))),
    )
    return lines.select(*group, F.explode(every).alias("x")).groupBy(*group, "x.heading", "x.label").agg(F.count(F.lit(1)).alias("count"))


def summarize_labels(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, heading, label, count, share): the most frequent label under each heading; ties by label."""
    w = Window.partitionBy(*group, "heading")
    ranked = counts.withColumns({"total": F.sum("count").over(w), "rank": F.row_number().over(w.orderBy(F.desc("count"), "label"))})
    return ranked.where((F.col("rank") == 1) & (F.col("total") > 0)).select(*group, "heading", "label", "count", (F.col("count") / F.col("total")).alias("share"))


def summary_cell(label: Column, count: Column, share: Column) -> Column:
    """As a cell of the printed table: label, magnitude, percentage."""
    p = F.floor(share * 100)
    return F.concat_ws(" ", label, magnitude(count), F.when(p == 100, "all").otherwise(F.concat(F.lpad(p.cast("string"), 2, " "), F.lit("%"))))


def profile(lines: DataFrame, group: Sequence[str], column: str = "line") -> DataFrame:
    """(group, heading, label, count, share) over all headings."""
    wide = pattern_counts(lines, group, column)
    long = []
    for h, labels in PATTERNS.items():
        long += [F.struct(F.lit(h).alias("heading"), F.lit(lab).alias("label"), F.col(f"{h}_{lab}".replace(" ", "_").replace("-", "_")).alias("count")) for lab in labels]
    patterns = wide.select(*group, F.explode(F.array(*long)).alias("x")).select(*group, "x.heading", "x.label", "x.count")
    return summarize_labels(patterns.unionByName(label_counts(lines, group, column)), group)


def profile_table(lines: DataFrame, group: Sequence[str], column: str = "line") -> DataFrame:
    """One row a group with the printed cell under each heading."""
    headings = ["case", *PATTERNS, "hyphens", "periods", "columns"]
    cells = profile(lines, group, column).withColumn("cell", summary_cell(F.col("label"), F.col("count"), F.col("share")))
    wide = cells.groupBy(*group).pivot("heading", headings).agg(F.first("cell")).na.fill("-", headings)
    widest = F.col("max_tokens").cast("string")
    padded = F.when(F.length(widest) < 2, F.lpad(widest, 2, " ")).otherwise(widest)
    sizes = pattern_counts(lines, group, column).select(*group, F.col("line_count"), F.concat_ws("/", padded, F.col("max_chars").cast("string")).alias("sizes"))
    return sizes.join(wide, list(group))

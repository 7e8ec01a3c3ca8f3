"""Morphological tables: tab-separated rows of tokens; an empty row ends a sentence."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..corpus import tokens
from ..functions.text import java_quote
from .blocks import strip, with_block

KEEP = ("POS", "NUM", "CASE", "PERS", "MOOD", "TENSE")
JUNK = "()[]<>" + ".,'" + "@#*/-"


def cells(line: str, sep: str = "\t") -> Column:
    return F.split(F.col(line), sep if sep == "\t" else java_quote(sep), -1)


def with_cell(line: str, index: int, value: Callable[[Column], Column], sep: str = "\t") -> Column:
    """The line with one cell changed; empty lines stay."""
    c = cells(line, sep)
    new = F.concat(F.slice(c, 1, index), F.array(value(c[index])), F.slice(c, index + 2, F.greatest(F.size(c) - index - 1, F.lit(0))))
    return F.when(F.col(line) == "", F.lit("")).otherwise(F.array_join(new, sep))


def modify_lemma(lemma: Column, number_tag: str = "<NUM>", proper_tag: str = "<PROPER>", hyphen_compounds: bool = True, strip_numbers: bool = True, strip_hyphens: bool = True, strip_junk: bool = True, collapse_repeats: bool = True) -> Column:
    """Pure punctuation stays, numbers become the tag; else digits, outer hyphens, all but the last part of a compound and
    outer junk go, unless nothing would be left. Runs of a character become two."""
    collapse = (lambda x: F.regexp_replace(x, r"(.)\1+", "$1$1")) if collapse_repeats else (lambda x: x)
    unless_empty = lambda new, old: F.when(new == "", old).otherwise(new)
    x = F.regexp_replace(lemma, "[0-9]", "") if strip_numbers else lemma
    if strip_hyphens:
        x = unless_empty(F.regexp_replace(x, "^-+|-+$", ""), x)
    if hyphen_compounds:
        x = F.element_at(F.split(x, "-", -1), -1)
    if strip_junk:
        j = "".join("\\" + c for c in JUNK)
        x = unless_empty(F.regexp_replace(x, f"^[{j}]+|[{j}]+$", ""), x)
    out = F.when(lemma.isin(number_tag, proper_tag), lemma).when(F.regexp_like(lemma, F.lit("^[-,.]+$")), collapse(lemma))
    if number_tag:
        out = out.when(F.regexp_like(lemma, F.lit("^[-0-9,.]+$")), F.lit(number_tag))
    return out.otherwise(collapse(x))


def modify_lemmas(df: DataFrame, lemma_col: int = 2, tags_col: int = 3, column: str = "line", sep: str = "\t", proper_tag: str = "<PROPER>", **how) -> DataFrame:
    tags = cells(column, sep)[tags_col]
    new = lambda x: F.when(F.contains(tags, F.lit("[PROPER=PROPER]")), F.lit(proper_tag)).otherwise(modify_lemma(x, proper_tag=proper_tag, **how)) if proper_tag else modify_lemma(x, **how)
    return df.withColumn(column, with_cell(column, lemma_col, new, sep))


def filter_tags(df: DataFrame, tags_col: int = 3, keep: Sequence[str] = KEEP, column: str = "line", sep: str = "\t", mangle: Callable[[Column], Column] | None = None) -> DataFrame:
    """Keeps tags of the form ``[CATEGORY=...]`` of some categories, in the order of ``keep``; the last of a category counts.

    ``mangle`` changes the map from category to tag.
    """

    category = lambda t: F.when(F.regexp_like(t, F.lit(r"^\[[A-Z]*=")), F.regexp_extract(t, r"^\[([A-Z]*)=", 1)).otherwise(t)

    def of(k: str) -> Callable[[Column], Column]:
        return lambda t: category(t) == k

    def change(tags: Column) -> Column:
        each = F.split(tags, r"\|", -1)
        last = {k: F.try_element_at(F.filter(each, of(k)), F.lit(-1)) for k in keep}
        if mangle is not None:
            table = mangle(F.create_map(*[x for k, v in last.items() for x in (F.lit(k), v)]))
            last = {k: F.try_element_at(table, F.lit(k)) for k in keep}
        return F.array_join(F.filter(F.array(*last.values()), lambda v: v.isNotNull()), "|")

    return df.withColumn(column, with_cell(column, tags_col, change, sep))


def map_column(df: DataFrame, mapping: DataFrame, index: int, column: str = "line", sep: str = "\t", unk: str | None = None) -> DataFrame:
    """Replaces one cell by the mapping's (src, trg); a miss stays, or becomes ``unk``."""
    joined = df.withColumn("src", F.when(F.col(column) != "", cells(column, sep)[index])).join(mapping.select("src", "trg"), "src", "left")
    miss = lambda x: F.lit(unk) if unk else x
    return joined.withColumn(column, with_cell(column, index, lambda x: F.coalesce("trg", miss(x)), sep)).drop("src", "trg")


def part_map(rows: DataFrame, order: Sequence[str], column: str = "line", marker: str = "@@") -> DataFrame:
    """(src, parts) of lines of segmented words; the last of equal surfaces wins."""
    parts = tokens(column)
    src = F.replace(F.array_join(parts, ""), F.lit(marker), F.lit(""))
    return rows.groupBy(src.alias("src")).agg(F.max_by(parts, F.struct(*order)).alias("parts"))


def bies(at: Column, n: Column) -> Column:
    return F.when(n == 1, "S").when(at == 0, "B").when(at == n - 1, "E").otherwise("I")


def segment_column(df: DataFrame, parts: DataFrame, index: int, column: str = "line", sep: str = "\t", tag: bool = True, replace: tuple[int, str] | None = None) -> DataFrame:
    """A row for each part (``part``) of a cell, with copies of the others and a B/I/E/S tag behind.

    ``replace`` = (column, text) is put into all rows but the last of a word.
    """
    joined = df.withColumn("src", F.when(F.col(column) != "", cells(column, sep)[index])).join(parts.select("src", "parts"), "src", "left")
    each = F.coalesce("parts", F.array(F.coalesce("src", F.lit(""))))
    rows = joined.withColumn("__n", F.size(each)).select(*df.columns, "__n", F.posexplode(each).alias("part", "__p"))
    out = with_cell(column, index, lambda _: F.col("__p"), sep)
    rows = rows.withColumn("__new", out)
    if replace is not None:
        rows = rows.withColumn("__new", F.when(F.col("part") < F.col("__n") - 1, with_cell("__new", replace[0], lambda _: F.lit(replace[1]), sep)).otherwise(F.col("__new")))
    if tag:
        rows = rows.withColumn("__new", F.when(F.col(column) != "", F.concat(F.col("__new"), F.lit(sep), bies(F.col("part"), F.col("__n")))).otherwise(F.lit("")))
    return rows.withColumn(column, F.col("__new")).drop("__new", "__p", "__n")


def interleave(df: DataFrame, group: Sequence[str], order: Sequence[str], keep: Sequence[int] = (2, 3, 0), surface: int | None = 0, parts: DataFrame | None = None, column: str = "line", sep: str = "\t", aux_marker: str = "%%") -> DataFrame:
    """A line for each block: for every token the kept cells, marked, and the parts of its surface unmarked.

    The last block counts even if no empty row closes it.
    """
    rows = with_block(df, group, order, strip(column) == "").where(strip(column) != "").withColumn("src", cells(column, sep)[surface if surface is not None else 0])
    rows = rows.join(parts.select("src", "parts"), "src", "left") if parts is not None else rows.withColumn("parts", F.lit(None).cast("array<string>"))
    c = cells(column, sep)
    words = F.flatten(F.array(*[F.coalesce("parts", F.array("src")) if i == surface else F.array(F.concat(F.lit(aux_marker), c[i])) for i in keep]))
    return rows.groupBy(*group, "block").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, words.alias("w")))), lambda x: x["w"])), " ").alias(column))


def only_first_subword(df: DataFrame, index: int, group: Sequence[str], order: Sequence[str], column: str = "line", sep: str = "\t", marker: str = "@@") -> DataFrame:
    """Drops rows whose predecessor in the sentence has the marker in the cell."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = (F.col(column) != "") & F.contains(F.try_element_at(cells(column, sep), F.lit(index + 1)), F.lit(marker))
    flagged = df.withColumn("__go", F.coalesce(F.lag(marked).over(w), F.lit(False)))
    return flagged.where(~F.col("__go") | (F.col(column) == "")).drop("__go")


def only_first_proper_or_num(df: DataFrame, index: int, group: Sequence[str], order: Sequence[str], column: str = "line", sep: str = "\t", lemmas: Sequence[str] = ("<NUM>", "<PROPER>")) -> DataFrame:
    """Of runs of an equal tag in the cell the first row stays."""
    w = Window.partitionBy(*group).orderBy(*order)
    value = F.when(F.col(column) != "", F.try_element_at(cells(column, sep), F.lit(index + 1)))
    tag = F.when(value.isin(*lemmas), value)
    flagged = df.withColumn("__tag", tag).withColumn("__last", F.lag("__tag").over(w))
    return flagged.where(F.col("__tag").isNull() | F.col("__last").isNull() | (F.col("__tag") != F.col("__last"))).drop("__tag", "__last")


def segment_surface_and_lemma(df: DataFrame, mapping: DataFrame, surface: int, lemma: int, column: str = "line", sep: str = "\t", tag: bool = True, fallback: bool = True) -> DataFrame:
    """Rows for the aligned parts of surface and lemma by ``mapping`` (surf, lemma, morphs, parts).

    A pair that it lacks takes any entry of the surface with ``fallback``, else stays whole. Tags go by the number of
    parts.
    """
    keyed = df.withColumns({"__s": cells(column, sep)[surface], "__l": F.try_element_at(cells(column, sep), F.lit(lemma + 1))})
    pair = mapping.groupBy(F.col("surf").alias("__s"), F.col("lemma").alias("__l")).agg(F.max(F.struct("morphs", "parts")).alias("x"))
    rows = keyed.join(pair, ["__s", "__l"], "left")
    if fallback:
        rows = rows.join(mapping.groupBy(F.col("surf").alias("__s")).agg(F.max(F.struct("morphs", "parts")).alias("y")), "__s", "left")
    whole = F.struct(F.array("__s").alias("morphs"), F.array(F.coalesce("__l", F.lit(""))).alias("parts"))
    chosen = F.coalesce("x", "y", whole) if fallback else F.coalesce("x", whole)
    rows = rows.withColumn("__x", chosen).withColumn("__n", F.when(F.col(column) == "", 1).otherwise(F.size("__x.morphs")))
    rows = rows.select(*df.columns, "__n", F.posexplode(F.when(F.col(column) == "", F.array(F.struct(F.lit("").alias("morphs"), F.lit("").alias("parts")))).otherwise(F.arrays_zip("__x.morphs", "__x.parts"))).alias("part", "__p"))
    rows = rows.withColumn("__new", with_cell(column, surface, lambda _: F.col("__p.morphs"), sep))
    rows = rows.withColumn("__new", F.when(F.col(column) == "", F.lit("")).otherwise(with_cell("__new", lemma, lambda _: F.col("__p.parts"), sep)))
    if tag:
        rows = rows.withColumn("__new", F.when(F.col(column) == "", F.lit("")).otherwise(F.concat(F.col("__new"), F.lit(sep), bies(F.col("part"), F.col("__n")))))
    return rows.withColumn(column, F.col("__new")).drop("__new", "__p", "__n")


def split_lemmas(counts: list[tuple[str, int]], prefixes: Sequence[str] = (), suffixes: Sequence[str] = (), min_len: int = 5, min_count: int = 2) -> list[tuple[str, list[str]]]:
    """(lemma, parts) of lemmas in the order of their counts: a lemma is cut into parts that were seen before it.

    Every step depends on the set that the earlier ones have grown, so this is a loop over the vocabulary on the driver
    (one row a lemma, not a token); count in Spark first.
    """
    seen, out = set(prefixes), []
    least = min([min_len, *map(len, prefixes)])

    def cut(lemma: str) -> list[str] | None:
        if lemma in seen:
            return [lemma]
        for s in suffixes:
            if lemma.endswith(s) and lemma[: -len(s)] in seen:
                return [lemma[: -len(s)]]
        for i in range(least, len(lemma) - least + 1):
            if lemma[:i] in seen and (rest := cut(lemma[i:])) is not None:
                return [lemma[:i], *rest]
        return None

    for lemma, n in counts:
        parts = cut(lemma) or [lemma]
        seen.update(p for p in parts if len(p) >= min_len and n >= min_count)
        out.append((lemma, parts))
    return out

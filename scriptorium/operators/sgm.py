"""Evaluation corpora in SGM markup, and BLEU listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import java_replacement


def _attribute(line: str | Column, name: str) -> Column:
    x = F.col(line) if isinstance(line, str) else line
    found = F.regexp_extract(x, rf'(?i)\b{name}="([^"]*)"', 1)
    return F.when(found != "", found)


def read_sgm(lines: DataFrame, group: Sequence[str], order: Sequence[str], column: str = "line") -> DataFrame:
    """(group, order, sysid, docid, segid, text) of every segment; a document's attributes hold until the next one."""
    x = F.trim(F.col(column))
    is_doc = F.regexp_like(x, F.lit("(?i)^<(doc|refdoc|srcdoc|tstdoc)[ >]"))
    w = Window.partitionBy(*group).orderBy(*order)
    doc = F.last(F.when(is_doc, F.struct(_attribute(x, "sysid").alias("sysid"), _attribute(x, "docid").alias("docid"))), ignorenulls=True).over(w)
    rows = lines.withColumn("__doc", doc).where(F.regexp_like(x, F.lit("(?i)^<seg ")))
    return rows.select(*group, *order, "__doc.sysid", "__doc.docid", _attribute(x, "id").alias("segid"), F.regexp_extract(x, "(?is)^<seg [^>]*>(.*)</seg>", 1).alias("text"))


def read_bleu(lines: DataFrame, column: str = "line") -> DataFrame:
    """(sysid, docid, segid, bleu) of lines such as ``... = 0.25 for system "s" on segment 3 of document "d" (8 words)``."""
    p = r'= *([0-9.eE+-]+) +for system "([^"]*)" on segment ([0-9]+) of document "([^"]*)"'
    get = lambda i: F.regexp_extract(column, p, i)
    return lines.where(F.regexp_like(column, F.lit(p))).select(get(2).alias("sysid"), get(4).alias("docid"), get(3).alias("segid"), get(1).cast("double").alias("bleu"))


def wrap_in_xml(lines: DataFrame, order: str, settype: str, setid: str, sysid: str, srclang: str = "any", trglang: str = "any", template: DataFrame | None = None, column: str = "line") -> DataFrame:
    """(key, line): the lines as SGM. Document and segment ids come from ``template`` (order, docid, segid), or are
    ``dummy`` and the running number from 1. Rows that only one side has are left out.

    Sort by ``key`` for the file.
    """
    tags = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    if template is None:
        rows = lines.withColumns({"docid": F.lit("dummy"), "segid": (F.row_number().over(Window.orderBy(order))).cast("string")})
    else:
        rows = lines.join(template.select(order, "docid", "segid"), order)
    w = Window.orderBy(order)  # a test set, which people read
    first = F.coalesce(F.lag("docid").over(w) != F.col("docid"), F.lit(True))
    last = F.coalesce(F.lead("docid").over(w) != F.col("docid"), F.lit(True))
    open_ = F.when(F.col("__first"), F.array(tags(f'<doc sysid="{sysid}" docid="', F.col("docid"), '">'), F.lit("<p>"))).otherwise(F.array().cast("array<string>"))
    close = F.when(F.col("__last"), F.array(F.lit("</p>"), F.lit("</doc>"))).otherwise(F.array().cast("array<string>"))
    seg = tags('<seg id="', F.col("segid"), '">', F.col(column), "</seg>")
    body = rows.withColumns({"__first": first, "__last": last}).select(F.col(order).cast("long").alias("a"), F.posexplode(F.concat(open_, F.array(seg), close)).alias("b", "line"))
    spark = lines.sparkSession
    head = spark.range(1).select(F.lit(-1).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(f'<{settype}set setid="{setid}" srclang="{srclang}" trglang="{trglang}">').alias("line"))
    foot = spark.range(1).select(F.lit((1 << 62)).cast("long").alias("a"), F.lit(0).alias("b"), F.lit(f"</{settype}set>").alias("line"))
    return head.unionByName(body).unionByName(foot).select(F.struct("a", "b").alias("key"), "line")


def merge_refs(sets: Sequence[DataFrame]) -> DataFrame:
    """(ref, docid, segid, text, at): alternative references behind each document of the first set, in the order of
    (at, ref, segment). A document that an alternative lacks is left out there."""
    main = sets[0].select("docid", "segid", "text", "line_no")
    starts = main.groupBy("docid").agg(F.min("line_no").alias("at"))
    out = main.join(starts, "docid").select(F.lit(0).alias("ref"), "docid", "segid", "text", "at", "line_no")
    for i, alt in enumerate(sets[1:], 1):
        other = alt.select("docid", "segid", F.col("text").alias("alt"))
        got = main.join(other, ["docid", "segid"]).join(starts, "docid").select(F.lit(i).alias("ref"), "docid", "segid", F.col("alt").alias("text"), "at", "line_no")
        out = out.unionByName(got)
    return out


def replace_set_id(lines: DataFrame, setid: str, column: str = "line") -> DataFrame:
    return lines.withColumn(column, F.regexp_replace(column, r'^(<.*\bsetid\s*=\s*")[^"]*', "$1" + java_replacement(setid)))

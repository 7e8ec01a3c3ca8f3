"""Line files in and out: codecs by suffix, charsets, loops of files, indirection, concatenation."""

from __future__ import annotations

import lzma
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import with_position
from ..operators.order import concatenate
from ..storage import copy_bytes, matching

CODECS = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz"}


def codec_of(path: str) -> str | None:
    return next((c for suffix, c in CODECS.items() if path.endswith(suffix)), None)


def read_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(line_no, line) of one file or folder; gzip, bzip2 and xz by suffix. Line ends are \\n, \\r\\n and \\r.

    Spark's text source numbers rows by its splits, so line_no is ordered and unique, and 0, 1, ... for one split; for
    places without gaps use ``corpus.with_position``.
    """
    if codec_of(path) == "xz" or encoding.lower().replace("-", "") != "utf8":
        return decode_lines(spark, path, encoding)
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def decode_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Whole files through Python's codecs: for xz, and for charsets other than UTF-8. Invalid bytes are dropped.

    ``line_no`` is the number of the file, in the order of paths, times 2**33, and the number of the line: 0, 1, ... for
    one file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content, file in zip(pdf["path"], pdf["content"], pdf["file"]):
                raw = lzma.decompress(content) if name.endswith(".xz") else content
                text = bytes(raw).decode(encoding, "ignore").replace("\r\n", "\n").replace("\r", "\n")
                lines = text.split("\n")
                lines = lines[:-1] if lines[-1] == "" else lines
                yield pd.DataFrame({"line_no": range(file << 33, (file << 33) + len(lines)), "line": lines})

    found = spark.read.format("binaryFile").load(path)
    numbered = with_position(found.select("path"), ["path"], "file")
    return found.select("path", "content").join(numbered, "path").mapInPandas(run, "line_no long, line string")


def reencode(raw: str, from_encoding: str):
    """Column of UTF-8 text from bytes in another charset; what is invalid is dropped."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode(from_encoding, "ignore"), na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(raw)


def write_lines(df: DataFrame, path: str, order: Sequence[str] = (), column: str = "line", mode: str = "error") -> None:
    """A text folder, compressed by the suffix of its name, in range-partitioned order."""
    codec = codec_of(path)
    if codec == "xz":
        raise ValueError("Spark has no xz writer; use .gz or .bz2")
    rows = df.orderBy(*order) if order else df
    out = rows.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode(mode)
    (out.option("compression", codec) if codec else out).text(path)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder byte for byte; an existing target is left alone."""
    copy_bytes(spark, source, target)


def concatenate_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_idx, line_no, line) of files end to end, compressed and plain ones mixed."""
    return concatenate([read_lines(spark, p) for p in paths])


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def loop_path(template: str, index: int) -> str:
    return template.replace("{_loop_index}", str(index))


def highest(spark: SparkSession, template: str, wildcard: str = "{_loop_index}") -> int | None:
    """The greatest number for which the path template has a file, in any file system."""
    before, after = template.split(wildcard, 1)
    bare = lambda path: re.sub(r"^\w+:/+", "/", path)  # noqa: E731  a scheme may be written with one or three slashes
    pattern = re.compile(re.escape(bare(before)) + r"(\d+)" + re.escape(after) + "$")
    quote = lambda part: re.sub(r"([][{}*?\\])", r"\\\1", part)
    found = [int(m[1]) for p in matching(spark, quote(before) + "*" + quote(after)) if (m := pattern.match(bare(p)))]
    return max(found, default=None)


def only_match(spark: SparkSession, pattern: str) -> str:
    """The one path that a wildcard matches."""
    found = matching(spark, pattern)
    if len(found) != 1:
        raise ValueError(f"{pattern} matches {len(found)} files")
    return found[0]


def indirect(spark: SparkSession, path: str) -> str:
    """The path that the first line of a file names."""
    first = spark.read.text(path).first()
    return first["value"].strip() if first else ""


def is_empty_folder(spark: SparkSession, path: str) -> bool:
    """Nothing but hidden files is in the folder."""
    return not any(not p.rsplit("/", 1)[-1].startswith(".") for p in matching(spark, path.rstrip("/") + "/*"))

"""The shared folder of a cluster, and tables that are written there to cut a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that every executor can read and write: ``spark.checkpoint.dir``.

    A session without that setting gets a folder of its own if it runs in one process; on a cluster it is an error, as
    a folder of one machine would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            named = context.getCheckpointDir().get()
        elif spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            named = "file://" + tempfile.mkdtemp(prefix="scriptorium-shared-")
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/") if "://" in named or named.startswith("file:") else "file://" + os.path.abspath(named)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/scriptorium-{tag}-{uuid.uuid4().hex[:12]}"


def _on_file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def expire(spark: SparkSession, path: str) -> None:
    """Lets an existing path go when the application ends."""
    fs, where = _on_file_system(spark, path)
    fs.deleteOnExit(where)


def stored(df: DataFrame, tag: str, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    It cuts the lineage as ``checkpoint()`` does, in a columnar and compressed form, and survives lost executors. The
    table goes when the application ends, or with the ``stored`` that replaces it (``instead_of``), e.g. in a loop.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    expire(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead_of is not None and getattr(instead_of, "_stored_at", None):
        fs, where = _on_file_system(spark, instead_of._stored_at)
        fs.delete(where, True)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whichever file system the path names."""
    fs, where = _on_file_system(spark, path)
    return fs.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = _on_file_system(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def modified(spark: SparkSession, path: str) -> int | None:
    """Milliseconds since 1970 of the last change; null if there is nothing."""
    fs, where = _on_file_system(spark, path)
    return fs.getFileStatus(where).getModificationTime() if fs.exists(where) else None


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern with wildcards matches, as the pattern writes them: with a scheme only if it has one."""
    fs, where = _on_file_system(spark, pattern)
    found = [str(x.getPath().toString()) for x in fs.globStatus(where) or []]
    return sorted(found if "://" in pattern or pattern.startswith("file:") else [str(spark._jvm.java.net.URI(p).getPath()) for p in found])


def copy_bytes(spark: SparkSession, source: str, target: str) -> None:
    """Copies a file or folder as it is, between file systems too; a target that exists is left alone."""
    fs, a = _on_file_system(spark, source)
    to, b = _on_file_system(spark, target)
    if not to.exists(b):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, spark._jsc.hadoopConfiguration())

"""WARC files: normalises whole-file gzip streams to one gzip member per record, with a sidecar offset index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Level of compression; bytes that are read at a time, and of a line of a head at most; of a compressed record in memory.
LEVEL, STEP, HELD = 6, 1 << 20, 16 << 20
INDEX = "file string, record_no long, warc_type string, record_id string, target_uri string, offset long, length long, n_bytes long, digest string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _commit(fs: pafs.FileSystem, temporary: str, final: str) -> None:
    """Puts a finished file in its place. Attempts of a task write equal bytes, so the last one to arrive may win."""
    if fs.get_file_info(final).type != pafs.FileType.NotFound and not isinstance(fs, pafs.LocalFileSystem):
        fs.delete_file(final)
    fs.move(temporary, final)


def _header(value: object) -> bytes:
    return str("" if value is None else value).replace("\r", " ").replace("\n", " ").encode("utf-8", "replace")


def response_record(page_id: object, url: str | None, html: str | None) -> bytes:
    """A WARC response record; it depends on its arguments only."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode("utf-8", "replace")
    name = b"-" if page_id is None else _header(page_id)
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:" + name + b">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: " + _header(url) + b"\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n"
    return head + body + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> int:
    """Writes each partition of ``pages`` as one WARC file that is one gzip stream; returns the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, n, out, squeeze = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0, None, None
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        for batch in batches:
            for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is None:
                    out, squeeze = fs.open_output_stream(temporary), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(squeeze.compress(response_record(a, b, c)))
                n += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            _commit(fs, temporary, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows = pages.select(F.col(id_col), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


class _Damaged(Exception):
    pass


class _Record:
    """The compressed pieces of a record until it is whole: in memory, and beyond ``HELD`` bytes in a file beside the target."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.held, self.n, self.size, self.file = fs, path, [], 0, 0, None

    def add(self, piece: bytes) -> None:
        self.held.append(piece)
        self.n += len(piece)
        self.size += len(piece)
        if self.n > HELD:
            self.file = self.file or self.fs.open_output_stream(self.path)
            for p in self.held:
                self.file.write(p)
            self.held, self.n = [], 0

    def move_to(self, out) -> None:
        if self.file:
            self.file.close()
            with self.fs.open_input_stream(self.path, compression=None) as back:
                while block := back.read(STEP):
                    out.write(block)
        for p in self.held:
            out.write(p)
        self.drop()

    def drop(self) -> None:
        if self.file:
            if not self.file.closed:
                self.file.close()
            self.fs.delete_file(self.path)
            self.file = None


def _records(stream: io.BufferedReader) -> Iterator[tuple[bytes, dict[str, str], int]]:
    """(head, headers, body length) of each record; the caller reads the body before it asks for the next one."""
    while True:
        line = stream.readline(STEP)
        while line in (b"\r\n", b"\n"):
            line = stream.readline(STEP)
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise _Damaged
        head, headers, size = [line], {}, len(line)
        while True:
            line = stream.readline(STEP)
            size += len(line)
            if not line.endswith(b"\n") or size > STEP:  # no head is that long
                raise _Damaged
            head.append(line)
            if line in (b"\r\n", b"\n"):
                break
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError):
            raise _Damaged from None
        yield b"".join(head), headers, size


def normalise_file(source: str, target: str, level: int = LEVEL) -> tuple[int, int, bool]:
    """Rewrites one WARC file, inflating it once; (records, bytes written, whole).

    Memory is bounded by ``STEP`` and ``HELD`` whatever the size of the file, a record or a line. The file may be one gzip stream, many
    members, or not compressed. Of a cut or damaged file the records before the damage are kept.
    """
    source_fs, path = _open(source)
    fs, final = _open(target)
    temporary = f"{final}.{uuid.uuid4().hex}.tmp"
    offset = n = 0
    whole = True
    raw = source_fs.open_input_stream(path, compression=None)  # or Arrow inflates by the suffix, and fails on a cut stream
    peek = raw.read(2)
    raw.close()
    raw = source_fs.open_input_stream(path, compression=None)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), STEP) if peek == b"\x1f\x8b" else io.BufferedReader(raw, STEP)
    name = final.rsplit("/", 1)[-1]
    with fs.open_output_stream(temporary) as out, fs.open_output_stream(temporary + "i") as index:
        try:
            for head, headers, size in _records(stream):
                squeeze, digest, left = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1(), size
                # Nothing of a record is written before all of it is read, so a cut one leaves no trace.
                record = _Record(fs, temporary + "r")
                try:
                    record.add(squeeze.compress(head))
                    while left:
                        block = stream.read(min(STEP, left))
                        if not block:
                            raise _Damaged
                        digest.update(block)
                        left -= len(block)
                        record.add(squeeze.compress(block))
                    record.add(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                    length = record.size
                    record.move_to(out)
                finally:
                    record.drop()
                row = {"file": name, "record_no": n, "warc_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id"), "target_uri": headers.get("warc-target-uri"), "offset": offset, "length": length, "n_bytes": len(head) + size, "digest": "sha1:" + base64.b32encode(digest.digest()).decode()}
                index.write((json.dumps(row, ensure_ascii=False) + "\n").encode())
                offset += length
                n += 1
        except (_Damaged, EOFError, zlib.error, gzip.BadGzipFile):
            whole = False
    raw.close()
    _commit(fs, temporary, final)
    _commit(fs, temporary + "i", final + ".idx")
    return n, offset, whole


def normalise(spark: SparkSession, source: str, target: str, level: int = LEVEL) -> tuple[DataFrame, DataFrame]:
    """Rewrites every ``*.warc``/``*.warc.gz`` of folder ``source`` to folder ``target``: (index, files).

    ``target`` gets name.warc.gz, in which every record is a gzip member of its own, and name.warc.gz.idx, a line of
    JSON for each record: a reader seeks to ``offset``, reads ``length`` bytes and inflates them alone. ``index`` has
    the rows of all sidecars, ``files`` (file, records, n_bytes, whole), whole being false for a cut or damaged file.

    * One task handles one file, as a gzip stream can't be split; it works in bounded pieces.
    * Tasks write under a temporary name and rename, so a lost executor leaves no half file.
    * Missing headers are null in the index. Repeated records are all kept. An empty folder or file gives no records.
    """
    fs, root = _open(source)
    found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.path.endswith((".warc", ".warc.gz")))
    prefix = source[: len(source) - len(root)] if source.endswith(root) else "file://"
    out_fs, out_root = _open(target)
    out_fs.create_dir(out_root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1]
                done = normalise_file(prefix + path, f"{target}/{name if name.endswith('.gz') else name + '.gz'}", level)
                yield pa.RecordBatch.from_arrays([pa.array([name]), *[pa.array([x]) for x in done]], names=["file", "records", "n_bytes", "whole"])

    schema = "file string, records long, n_bytes long, whole boolean"
    if not found:
        return spark.createDataFrame([], INDEX), spark.createDataFrame([], schema)
    paths = spark.createDataFrame([(p, i) for i, p in enumerate(found)], "path string, at int").repartitionById(len(found), F.col("at")).select("path")
    files = spark.createDataFrame(paths.mapInArrow(run, schema).collect(), schema)  # one row a file
    return spark.read.schema(INDEX).json(f"{target}/*.idx"), files


def read_record(folder: str, file: str, offset: int, length: int) -> bytes:
    """One record, by random access."""
    fs, root = _open(folder)
    with fs.open_input_file(f"{root}/{file}") as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)

"""Word vectors in the binary word2vec format as a Spark data source.

A file is a line "count dim" and then, per word, the token in UTF-8, a space,
dim little-endian 32-bit floats and, by some writers, a newline. Records have
no length and no marker, so one large file is read by many tasks like this:

* A file is cut into byte ranges of ``splitBytes``; a record belongs to the
  range in which it starts.
* The task of a range looks for the record start at or behind its first byte.
  From two records' length before it, it tries places one by one until
  ``CHAIN`` records in a row read as records (a valid token without control
  characters, finite floats). Such a chain may begin inside a token, but from
  its second record on it lies on true starts.
* When a task reaches its end it searches for the next range's start in the
  same way and compares it with where its own records end. The first range
  starts behind the header, so if all tasks agree every start is right; where
  they do not (vectors that happen to read as text), the job fails and says so
  instead of returning wrong rows. ``splitBytes`` 0 reads each file in one task.

Given a schema of ``tok`` alone, vectors are skipped. Equality and IN filters on ``tok``
are pushed down: vectors of other words are not decoded. A folder is read file by file;
written, it gets one or more files per task, each a whole word2vec file with
its own header, moved into place when the job commits.

Files are opened with pyarrow's file systems (local, hdfs, s3, gs; ``s3a://`` and
``s3n://`` are read as ``s3://``) by the tasks themselves.

Null tokens and vectors are not written, nor are empty tokens (the format has
neither); a token with a space or newline, and vectors of another length than the first,
are errors. An empty table is a file "0 0". Repeated tokens are all read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition,
                                    WriterCommitMessage)

NAME = "word2vec"
SCHEMA = "tok string, vec array<float>"
SPLIT_BYTES = 64 << 20
CHAIN = 16               # records in a row that must read as records
MAX_TOKEN = 4096         # bytes of a token at most
READ_BYTES = 8 << 20     # read at a time
BATCH_ROWS = 4096
FILE_BYTES = 256 << 20   # vectors a written file holds at most; a task collects one file's records
CONTROL = re.compile(rb"[\x00-\x1f\x7f]")


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    path = re.sub("^s3[an]://", "s3://", path)
    path = re.sub("^file:/(?!/)", "file:///", path)
    return pafs.FileSystem.from_uri(path) if re.match("[a-z0-9+.-]+://", path) else (pafs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Bytes [low, high) of a file whose records begin at ``first``."""

    path: str
    size: int
    first: int
    dim: int
    low: int
    high: int


class Window:
    """Bytes of an open file by their places in it, read in blocks."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.start, self.data = stream, size, 0, b""

    def need(self, at: int, n: int) -> bool:
        """Makes [at, at + n) available; False where the file ends before."""
        if at + n > self.size:
            return False
        if not self.start <= at <= at + n <= self.start + len(self.data):
            self.stream.seek(at)
            self.start, self.data = at, self.stream.read(min(max(n, READ_BYTES), self.size - at))
        return True

    def skip(self, at: int) -> int:
        """Behind the newline that some writers put after a record."""
        while at < self.size and self.need(at, 1) and self.data[at - self.start] == 10:
            at += 1
        return at

    def record(self, at: int, dim: int, strict: bool = False):
        """(token, place of its floats, place of the next record), or None where none can start."""
        if at >= self.size:
            return None
        self.need(at, min(MAX_TOKEN + 1, self.size - at))
        local = at - self.start
        space = self.data.find(b" ", local, local + MAX_TOKEN + 1)
        if space <= local:
            return None
        token, floats = self.data[local:space], self.start + space + 1
        if floats + 4 * dim > self.size:
            return None
        if strict:
            if CONTROL.search(token):
                return None
            try:
                token.decode()
            except UnicodeDecodeError:
                return None
            self.need(floats, 4 * dim)
            if not np.isfinite(np.frombuffer(self.data, "<f4", dim, floats - self.start)).all():
                return None
        return token, floats, self.skip(floats + 4 * dim)


def record_start(window: Window, part: Range, at: int) -> int:
    """The first record start at or behind ``at`` (the file's end, if there is none)."""
    if at <= part.first:
        return window.skip(part.first)
    longest = MAX_TOKEN + 2 + 4 * part.dim
    for begin in range(max(part.first, at - 2 * longest), at + 1):
        place, links, found = begin, 0, None
        while links < CHAIN or found is None:
            got = window.record(place, part.dim, strict=links < CHAIN)
            if got is None:
                break
            if found is None and place >= at and (links or begin == part.first):
                found = place
            place, links = got[2], links + 1
        if found is not None and links >= CHAIN:
            return found
        if links and place >= part.size:
            return part.size if found is None else found
    raise ValueError(f"no record begins near byte {at} of {part.path}; read it with splitBytes 0")


class WordVectorReader(DataSourceReader):
    def __init__(self, path: str, split: int, vectors: bool):
        self.path, self.split, self.vectors, self.tokens = path, split, vectors, None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("tok",):
                self.tokens = values if self.tokens is None else self.tokens & values
            else:
                yield f

    def partitions(self):
        fs, folder = open_folder(self.path)
        info = fs.get_file_info(folder)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == pafs.FileType.File else sorted(
            (f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File and f.base_name[0] not in "._"),
            key=lambda f: f.path)
        out = []
        for f in files:
            with fs.open_input_file(f.path) as stream:
                head = stream.read(64)
            got = re.match(rb"(\d+) (\d+)\s*\n", head)
            if not got:
                raise ValueError(f"not a binary word2vec file: {f.path}")
            first, dim = got.end(), int(got[2])
            step = self.split or f.size
            out += [Range(f.path, f.size, first, dim, low, min(low + step, f.size)) for low in range(first, f.size, max(1, step))]
        return out or [Range("", 0, 0, 0, 0, 0)]

    def read(self, part: Range):
        if not part.path:
            return
        fs, _ = open_folder(self.path)
        wanted = None if self.tokens is None else {str(t).encode() for t in self.tokens if t is not None}
        with fs.open_input_file(part.path) as stream:
            window = Window(stream, part.size)
            place, tokens, floats = record_start(window, part, part.low), [], []
            while place < part.high:
                got = window.record(place, part.dim)
                if got is None:
                    raise ValueError(f"no record at byte {place} of {part.path}")
                token, at, place = got
                if wanted is None or token in wanted:
                    tokens.append(token.decode())
                    if self.vectors:
                        window.need(at, 4 * part.dim)
                        floats.append(window.data[at - window.start: at - window.start + 4 * part.dim])
                    if len(tokens) == BATCH_ROWS:
                        yield self._batch(tokens, floats, part.dim)
                        tokens, floats = [], []
            if tokens:
                yield self._batch(tokens, floats, part.dim)
            if part.high < part.size and record_start(window, part, part.high) != place:
                raise ValueError(f"records of {part.path} cannot be told apart near byte {part.high}; read it with splitBytes 0")

    def _batch(self, tokens, floats, dim):
        columns, names = [pa.array(tokens, pa.string())], ["tok"]
        if self.vectors:
            flat = pa.array(np.frombuffer(b"".join(floats), "<f4"))
            columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dim), flat))
            names.append("vec")
        return pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WordVectorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches):
        fs, folder = open_folder(self.path)
        temporary = f"{folder}/_temporary-{self.job}"
        fs.create_dir(temporary, recursive=True)
        files, records, size, dim = [], [], 0, None

        def close():
            name = f"part-{uuid.uuid4().hex}.bin"
            with fs.open_output_stream(f"{temporary}/{name}", compression=None) as out:
                out.write(f"{len(records)} {dim or 0}\n".encode())
                for r in records:
                    out.write(r)
            files.append(name)

        for b in batches:
            for token, vec in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not token or not vec.is_valid:
                    continue
                values = np.asarray(vec.values.to_numpy(zero_copy_only=False), "<f4")
                dim = len(values) if dim is None else dim
                raw = token.encode()
                if len(values) != dim or b" " in raw or b"\n" in raw or len(raw) > MAX_TOKEN:
                    raise ValueError(f"cannot be written as a word vector of {dim} values: {token!r}")
                records.append(raw + b" " + values.tobytes() + b"\n")
                size += len(records[-1])
                if size >= FILE_BYTES:
                    close()
                    records, size = [], 0
        if records:
            close()
        return Written(files)

    def commit(self, messages):
        fs, folder = open_folder(self.path)
        temporary = f"{folder}/_temporary-{self.job}"
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(folder)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        names = [n for m in messages if m for n in m.files]
        for n in names:  # files of attempts that failed or were repeated stay behind and go with the folder
            fs.move(f"{temporary}/{n}", f"{folder}/{n}")
        if not names:
            with fs.open_output_stream(f"{folder}/part-empty.bin", compression=None) as out:
                out.write(b"0 0\n")
        if fs.get_file_info(temporary).type == pafs.FileType.Directory:
            fs.delete_dir(temporary)

    def abort(self, messages):
        fs, folder = open_folder(self.path)
        temporary = f"{folder}/_temporary-{self.job}"
        if fs.get_file_info(temporary).type == pafs.FileType.Directory:
            fs.delete_dir(temporary)


class WordVectorSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        extra = set(schema.fieldNames()) - {"tok", "vec"}
        if extra or schema.fieldNames()[:1] != ["tok"]:
            raise ValueError(f"a word2vec file has the columns tok and vec, not {schema.fieldNames()}")
        return WordVectorReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), "vec" in schema.fieldNames())

    def writer(self, schema, overwrite):
        return WordVectorWriter(self.options["path"], overwrite)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(WordVectorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes token filters


def read_binary_vectors(spark: SparkSession, path: str, vectors: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """S4, binary: (tok, vec), or tokens alone, of a file or a folder of files."""
    _registered(spark)
    return spark.read.format(NAME).schema(SCHEMA if vectors else "tok string").option("splitBytes", split_bytes).load(path)


def write_binary_vectors(df: DataFrame, path: str, tok: str = "tok", vec: str = "vec", mode: str = "overwrite") -> None:
    """(tok, vec) as a folder of binary word2vec files."""
    _registered(df.sparkSession)
    from pyspark.sql import functions as F

    rows = df.select(F.col(tok).cast("string").alias("tok"), F.col(vec).cast("array<float>").alias("vec"))
    rows.write.format(NAME).mode(mode).save(path)

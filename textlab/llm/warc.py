"""Dictionary-compressed WARC archives (.warc.zst): writer and reader.

A file starts with a skippable frame that holds a Zstandard dictionary built
from the file's own first records (at most ``SAMPLE_BYTES`` of them); every
record then is a frame of its own, compressed with that dictionary, so records
can be read singly and a file read alone.

Of pages with equal payloads (SHA-1 of the whole payload) of at least
``min_revisit`` bytes the one with the largest page_id is archived as
response, the others as revisits of it without their payload. The choice is a
grouped maximum over slim rows, combined before the shuffle; AQE splits the
join back where one payload has very many pages.

Tasks write to the folder given (any file system pyarrow knows), first under a
name of their attempt, then renamed to the partition's name, so a lost
executor leaves no half file under a final name. Files end after
``FILE_BYTES``; memory is one file's dictionary sample and one record.

Null html is an empty payload, a null url a urn of the page. Null page_ids are
smaller than all others; if all pages of a payload have none, all of these are
responses. Rows that repeat the response's page_id and payload are responses
too. Other columns are ignored. No pages: no files, an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import scratch_path, stage_table

SKIPPABLE = 0x184D2A5D        # fixed value: magic number of the frame that holds a dictionary
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
FILE_BYTES = 256 << 20
LEVEL = 3
READ_BYTES = 1 << 16
DATE = "2000-01-01T00:00:00Z"  # WARC-Date of pages whose fetch time is unknown
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page_id(record_id: str | None):
    tail = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record, header and block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else _record_id(page_id)[1:-1]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (names in lower case) and block of one record; a broken one raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(out["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of the wrong length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    return out | {"payload": payload, "http": fields}


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on records; of too few records their own tail; of none, none."""
    if not samples:
        return None
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _File:
    """One archive on its way to its final name."""

    def __init__(self, fs, folder: str, name: str, attempt: int, samples: list[bytes]):
        self.fs, self.path, self.temporary = fs, f"{folder}/{name}", f"{folder}/.{name}.{attempt}"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        dictionary = build_dictionary(samples)
        self.size = self.records = 0
        if dictionary is None:
            self.engine = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        else:
            data = dictionary.as_bytes()
            self._put(struct.pack("<II", SKIPPABLE, len(data)) + data)
            self.engine = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=dictionary)
        for s in samples:
            self.add(s)

    def _put(self, data: bytes):
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes):
        self._put(self.engine.compress(record))
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.path, self.records, self.size


def _write_batches(uri: str):
    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(uri)
        ctx = TaskContext.get()
        done, waiting, held, file, n = [], [], 0, None, 0
        for pdf in batches:
            for page, url, html, size, sha1, keep, revisit in pdf.itertuples(index=False):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                raw = record_bytes(page, url, (html or "").encode(), int(size), digest, keep, bool(revisit))
                if file is not None:
                    file.add(raw)
                    if file.size >= FILE_BYTES:
                        done.append(file.close())
                        file = None
                    continue
                waiting.append(raw)
                held += len(raw)
                if held >= SAMPLE_BYTES:
                    file = _File(fs, folder, f"part-{ctx.partitionId():05d}-{n:05d}.warc.zst", ctx.taskAttemptId(), waiting)
                    waiting, held, n = [], 0, n + 1
        if waiting:
            file = _File(fs, folder, f"part-{ctx.partitionId():05d}-{n:05d}.warc.zst", ctx.taskAttemptId(), waiting)
        if file is not None:
            done.append(file.close())
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])
    return run


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` below ``folder`` (a URI or an
    absolute path); returns the manifest ``(file, records, bytes)``."""
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.octet_length(html).cast("bigint").alias("size"), F.sha1(html).alias("sha1"))
    best = rows.groupBy("sha1").agg(F.max("page_id").alias("keep")).withColumnRenamed("sha1", "sha1_2")
    known = rows.join(best, F.col("sha1") == F.col("sha1_2"))
    revisit = (F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keep"))
    # ids travel through pandas as strings: numbers with nulls among them would turn into floats
    records = known.select(F.col("page_id").cast("string"), "url", F.when(~revisit, F.col("html")).alias("html"), "size",
                           "sha1", F.col("keep").cast("string"), revisit.alias("revisit"))
    return stage_table(records.mapInPandas(_write_batches(uri), "file string, records bigint, bytes bigint"), "manifest")


def iter_records(stream):
    """Records of an open archive, one after the other."""
    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", data[4:])[0]))
        data = b""
    engine = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    frame, out = None, []
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                break
        if frame is None:
            frame, out = engine.decompressobj(), []
        out.append(frame.decompress(data))
        if frame.eof:
            data = frame.unused_data
            frame = None
            yield b"".join(out)
        else:
            data = b""
    if frame is not None:
        raise ValueError("archive ends within a record")


def _read_batches(uri: str, with_payload: bool):
    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(uri)
        for pdf in batches:
            for path in pdf["file"]:
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in iter_records(stream):
                        r = parse_record(raw)
                        kind, digest = r["warc-type"], r["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                            raise ValueError(f"payload digest differs in {path}")
                        rows.append((_page_id(r["warc-record-id"]), r["warc-target-uri"], int(r["http"]["content-length"]),
                                     digest, kind, _page_id(r.get("warc-refers-to")),
                                     r["payload"] if with_payload and kind == "response" else None))
                        held += len(raw)
                        if held > SAMPLE_BYTES:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)
    return run


def _frame(rows):
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the files in ``manifest(file)``, payloads of responses checked against their digests."""
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    files = manifest.select("file")
    tasks = max(1, min(files.count(), 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(tasks, "file").mapInPandas(
        _read_batches(uri, with_payload), "page_id bigint, url string, payload_bytes bigint, payload_digest string, "
        "record_type string, refers_to bigint, payload binary")


def archive_folder(spark) -> str:
    """A fresh folder below the shared one."""
    return scratch_path(spark, "warc")

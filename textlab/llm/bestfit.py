"""Best-fit decreasing packing of token pieces into sequences of ``LONGEST``.

Pieces of one length are interchangeable, so the packing depends only on how
many there are of each length: at most ``LONGEST`` counts, whatever the size of
the corpus. Best-fit decreasing runs over these runs of equal pieces: the
open bins are kept by remaining capacity in the leaves of a segment tree, the
tightest open bin with room is the first leaf in use at or above the length
(one descent, logarithmic), and a run of pieces fills whole classes of bins
that are equally full at once. The result is the packing that best-fit
decreasing gives piece by piece. It is a table of fills: "of length L, the
pieces ranked from p on go k to a sequence, from sequence s and offset o on",
with at most as many rows as there are pairs of a length and a capacity in use.

Spark does the rest: texts are tokenised and cut in Arrow batches and written
once; a piece's rank within its length is its rank within its task plus the
counts of tasks before; each task looks its pieces up in the table of fills.
No piece is sorted or gathered.

The ids are those of the ``tokenizers`` file given. That engine works text by
text at some 1 MB/s, so a worker keeps the ids of the chunks between ASCII
white space that it has met (this vocabulary's pre-tokeniser drops white space
and never joins across it); a tokenizer file with other rules is run on whole
texts.

Null texts count as empty: one piece, the end id. Null ids and repeated rows
are packed like others. Other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import stage_table
from textlab.worker import worker_object

LONGEST = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
CHUNKS = 400_000             # chunks whose ids a worker keeps
CHUNK_BYTES = 48             # longer chunks are not kept
SLICE = 1 << 20              # bytes of a text split into chunks at a time
FLUSH = 1 << 16              # pieces of an output batch
FLUSH_IDS = 1 << 20          # ids of an output batch
# fixed values: the normaliser and the pre-tokeniser for which chunks may be encoded one by one
CHUNK_RULES = ({"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END_OF_WORD = "</w>"


def _byte_of():
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(own))}


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = spec["normalizer"], ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]))
                    for t in spec["added_tokens"])
        self.by_chunk = rules == CHUNK_RULES and plain and spec["model"]["type"] == "BPE"
        self.kept: dict[bytes, bytes] = {}
        if self.by_chunk:
            self._words(spec)

    def _words(self, spec):
        """A second engine for the words of Latin-1 chunks: byte pairs merged by
        rank, where a byte outside UTF-8 marks a word's end and joins first."""
        import tiktoken

        added, byte = {t["content"] for t in spec["added_tokens"]}, _byte_of()
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in added:
                end = token.endswith(END_OF_WORD)
                ranks[bytes(byte[c] for c in token.removesuffix(END_OF_WORD)) + b"\xff" * end] = i
        ranks.setdefault(b"\xff", len(ranks) + len(added))
        core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.word = core.encode_single_piece
        # letters, digits and the rest, as the pre-tokeniser parts them, after lower-casing
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        self.ascii = re.compile(f"{short}|[a-z]+|[0-9]|[^a-z0-9]+".encode()).findall
        letters, digits = "a-zªµº\xdf-\xf6\xf8-\xff", "0-9²³¹¼½¾"
        self.parts = re.compile(f"{short}|[{letters}]+|[{digits}]|[^{letters}{digits}]+").findall
        self.latin = re.compile("[\x00-\x84\x86-\x9f\xa1-\xff]*").fullmatch
        self.added = tuple(a.encode() for a in added)
        self.stops = {c: struct.pack("<I", *self.word(bytes([c, 255]))) for c in b".,;:!?"}

    def _encode(self, chunk: bytes) -> list:
        if chunk.isalpha():
            return self.word(chunk.lower() + b"\xff")
        for a in self.added:
            if a in chunk:
                break
        else:
            if chunk.isascii():
                return [i for p in self.ascii(chunk.lower()) for i in self.word(p + b"\xff")]
            text = chunk.decode()
            if self.latin(text):
                if text.isalpha():
                    return self.word(text.lower().encode() + b"\xff")
                return [i for p in self.parts(text.lower()) for i in self.word(p.encode() + b"\xff")]
        return self.whole.encode(chunk.decode(), add_special_tokens=False).ids

    def chunk(self, chunk: bytes) -> bytes:
        """Ids (little-endian, 32 bits each) of a chunk without ASCII white space."""
        stop, head = self.stops.get(chunk[-1]), chunk[:-1]
        if stop and (head.isalpha() or not head.isascii() and self.latin(head.decode()) and head.decode().isalpha()):
            ids = (self.kept.get(head) or self.chunk(head)) + stop  # a word and one mark
        else:
            ids = struct.pack(f"<{len(got := self._encode(chunk))}I", *got)
        if len(chunk) <= CHUNK_BYTES:
            if len(self.kept) >= CHUNKS:
                self.kept.clear()
            self.kept[chunk] = ids
        return ids

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not self.by_chunk:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        out, rest, data, known = [], b"", text.encode(), self.kept.get
        for at in range(0, len(data), SLICE):  # the last chunk of a slice may go on in the next
            chunks = (rest + data[at: at + SLICE]).split()
            rest = chunks.pop() if chunks and at + SLICE < len(data) and not data[at + SLICE - 1: at + SLICE].isspace() else b""
            out += [known(c) or self.chunk(c) for c in chunks]
        if rest:
            out.append(self.chunk(rest))
        return np.frombuffer(b"".join(out), "<u4")


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, part int"


def _cut_batches(path: str | None, longest: int, with_ids: bool):
    def run(batches):
        import public_tokenizers

        where = path or public_tokenizers.path(TOKENIZER)
        encoder = worker_object(("best fit", where), lambda: Encoder(where))
        part, ranks, rows, held = TaskContext.get().partitionId(), {}, [], 0

        def batch():
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"]
            if with_ids:
                types.append(pa.list_(pa.int32()))
                names.append("ids")
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(END))
                for k, at in enumerate(range(0, len(ids), longest)):
                    piece = ids[at: at + longest].astype("<u4")
                    n = len(piece)
                    rank = ranks.get(n, 0)
                    ranks[n] = rank + 1
                    row = (doc, k, at, n, zlib.crc32(piece.tobytes()), rank, part)
                    rows.append(row + (piece.astype(np.int32),) if with_ids else row)
                    held += n
                    if len(rows) >= FLUSH or with_ids and held >= FLUSH_IDS:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()
    return run


class OpenBins:
    """Segment tree over the remaining capacities 0 .. size: leaves hold ranges
    of bins equally full, inner nodes whether any leaf below is in use."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.used = [0] * (2 * self.width)      # classes in use below a node
        self.bins: dict[int, list] = {}         # capacity -> [(first bin, number)]

    def _mark(self, capacity: int, step: int):
        at = self.width + capacity
        while at:
            self.used[at] += step
            at >>= 1

    def add(self, capacity: int, first: int, number: int):
        if number and capacity:
            if capacity not in self.bins:
                self.bins[capacity] = []
                self._mark(capacity, 1)
            self.bins[capacity].append((first, number))

    def take(self, capacity: int, most: int):
        """Up to ``most`` bins of one range of a class: (first bin, number)."""
        first, number = self.bins[capacity].pop()
        if number > most:
            self.bins[capacity].append((first + most, number - most))
            number = most
        elif not self.bins[capacity]:
            del self.bins[capacity]
            self._mark(capacity, -1)
        return first, number

    def tightest(self, length: int) -> int | None:
        """The least capacity in use that is at least ``length``."""
        at = self.width + length
        if self.used[at]:
            return length
        while at > 1:  # up to the first right sibling in use, then down along the left
            if not at & 1 and self.used[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit(counts: dict[int, int], size: int = LONGEST) -> tuple[list, int]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length into bins
    of ``size``: fills ``(length, first rank, first bin, bins, pieces a bin,
    offset)`` and the number of bins. The last bin of a fill may get fewer."""
    open_, opened, fills = OpenBins(size), 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = open_.tightest(length)
            each = (size if room is None else room) // length
            # a bin stays the tightest until it has no room for another piece of this length
            wanted = -(-left // each)
            if room is None:
                room, first, number = size, opened, wanted
                opened += number
            else:
                first, number = open_.take(room, wanted)
            placed = min(left, number * each)
            fills.append((length, rank, first, number, each, size - room))
            last = placed - (number - 1) * each
            open_.add(room - each * length, first, number - 1)
            open_.add(room - last * length, first + number - 1, 1)
            left -= placed
            rank += placed
    return fills, opened


def _place_batches(shared):
    def run(batches):
        lengths, ptr, table = shared.value  # fills of lengths[i]: rows ptr[i] .. ptr[i + 1] of table
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            row = np.zeros(len(length), np.int64)
            for v in np.unique(length):
                i = int(np.searchsorted(lengths, v))
                own = slice(int(ptr[i]), int(ptr[i + 1]))
                mine = length == v
                row[mine] = own.start + np.searchsorted(table[own, 0], rank[mine], side="right") - 1
            at, each = rank - table[row, 0], table[row, 2]
            columns = {n: b.column(n) for n in b.schema.names if n != "rank"}
            columns["sequence_id"] = pa.array(table[row, 1] + at // each)
            columns["offset"] = pa.array(table[row, 3] + at % each * length)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return run


def pack_best_fit(docs: DataFrame, path: str | None = None, longest: int = LONGEST, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset and, if wanted, ids."""
    spark = docs.sparkSession
    more = ", ids array<int>" if with_ids else ""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stage_table(slim.mapInArrow(_cut_batches(path, longest, with_ids), PIECE + more), "pieces")
    counts = stage_table(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # at most ``longest`` rows
    per_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    fills, _ = best_fit(per_length, longest)
    table = np.array(fills, np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    lengths, first = np.unique(table[:, 0], return_index=True)
    shared = spark.sparkContext.broadcast((lengths, np.append(first, len(table)), table[:, [1, 2, 4, 5]].copy()))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = stage_table(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "ahead")
    ranked = pieces.join(ahead, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("rank")).alias("rank"), *(["ids"] if with_ids else []))
    return ranked.mapInArrow(_place_batches(shared), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
                             + more + ", sequence_id bigint, offset bigint")

"""Packing by power-of-two decomposition.

A document's tokens (its ids and one end id) are cut into pieces of 1,024
while they last, and the rest into its binary parts, longest first. A piece is
a sequence of its own: no sequence holds two documents, every sequence has a
length that is a power of two, and none is padded. Sequences of equal length
are numbered one after the other, longest first, so that a trainer reads
batches of one length; within a length, in the order of the documents.

Tokenising and cutting is one Arrow pass whose output is written once. A run is
a block of a file, as Spark splits it; a sequence's number is its rank within its run plus
the counts of the runs and lengths before, so the pieces themselves are never
shuffled or sorted. Spark reads files back in an order of its own, so runs are
put in the order of their files' part numbers and of the blocks in a file: a sorted
table keeps its order (of a table that is not read from Parquet, that of its partitions).

The vocabulary is read from the tokenizer file that is a parameter. The ids
come from tiktoken's engine over that vocabulary, a third of the time of the
``tokenizers`` engine with equal ids (tested); texts that its engine refuses,
and those that hold an added token's content, which gives that token's id, go
to ``tokenizers``.

Null texts count as empty: one piece, the end. Null ids and repeated rows are
packed like others. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import small_batches, stage_table
from textlab.worker import worker_object

LONGEST = 1024
END = 0
TOKENIZER = "byte_bpe_50k.json"
FLUSH_TOKENS = 1 << 20
# fixed value: the pre-tokenising pattern of this vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of():
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    for n, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(256 + n)] = b
    return table


def _fast(path: str):
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = sorted({t["content"] for t in spec["added_tokens"]})
    special = set(added)
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), added


def _plain(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _plain_ids(text: str, path: str) -> np.ndarray:
    plain = worker_object(("packing plain", path), lambda: _plain(path))  # rarely needed, so not held by every worker
    return np.array(plain.encode(text, add_special_tokens=False).ids, np.uint32)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text, without an end."""
    fast, added = worker_object(("packing fast", path), lambda: _fast(path))
    if not text:
        return np.zeros(0, np.uint32)
    if any(content in text for content in added):
        return _plain_ids(text, path)
    try:
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
    except BaseException as e:  # the engine's own panics (its regex on extreme texts) are not Exceptions
        if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return _plain_ids(text, path)


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n tokens, longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _cut_batches(path: str | None, with_ids: bool):
    def run(batches):
        import public_tokenizers

        where = path or public_tokenizers.path(TOKENIZER)
        file, first, ranks = None, 0, {}
        rows, held = [], 0

        def frame():
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "file", "first", "ids"])
            return out if with_ids else out.drop(columns="ids")

        for pdf in batches:
            for doc, text, name, block in zip(pdf["doc_id"], pdf["text"], pdf["file"], pdf["block"], strict=True):
                if name != file or block != first:
                    file, first, ranks = name, block, {}
                ids = np.append(token_ids(text if isinstance(text, str) else None, where), np.uint32(END))
                at = 0
                for length in piece_lengths(len(ids)):
                    piece = ids[at: at + length]
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    rows.append((doc, at, length, zlib.crc32(piece.astype("<u4").tobytes()),
                                 len(ids), rank, file, first, piece.astype(np.int32) if with_ids else None))
                    at += length
                held += len(ids) if with_ids else 64
                if held > FLUSH_TOKENS:
                    yield frame()
                    rows, held = [], 0
        yield frame()
    return run


def _placed(docs: DataFrame) -> DataFrame:
    """Id and text (strings) with the file and its block that each was read from, or its partition."""
    # ids travel through pandas as strings: numbers with nulls among them would turn into floats
    cols = [F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        return docs.select(*cols, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    except AnalysisException:  # not read from Parquet files
        return docs.select(*cols, F.format_string("part-%d", F.spark_partition_id()).alias("file"), F.lit(0).cast("bigint").alias("block"))


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (0: a sequence holds one piece) and, if wanted, ids."""
    schema = ("doc_id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, rank bigint, file string, first bigint"
              + (", ids array<int>" if with_ids else ""))
    run = ["length", "file", "first"]
    with small_batches(docs.sparkSession):
        pieces = stage_table(_placed(docs).mapInPandas(_cut_batches(path, with_ids), schema), "pieces")
    counts = pieces.groupBy(*run).agg(F.count(F.lit(1)).alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).try_cast("bigint")
    before = Window.partitionBy("length").orderBy(number, "file", "first").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per length
    totals = counts.groupBy("length").agg(F.sum("n").alias("all")).withColumn(
        "longer", F.coalesce(F.sum("all").over(longer), F.lit(0))).select("length", "longer")
    at = stage_table(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
        totals, "length").select(*run, (F.col("before") + F.col("longer")).alias("at")), "offsets")
    out = pieces.join(at, run)
    cols = [F.col("doc_id").cast("bigint").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", (F.col("at") + F.col("rank")).alias("sequence_id"),
            F.lit(0).cast("bigint").alias("offset")]
    return out.select(*cols, *(["ids"] if with_ids else []))

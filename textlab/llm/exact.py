"""Exact duplicates by progressive refinement, with built-in functions only.

1. Group by length in bytes: only slim (length, prefix hash) rows shuffle.
2. Within lengths held twice or more, group by the hash of the first
   ``PREFIX_CHARS`` characters.
3. Only for rows whose length and prefix still collide is the whole text
   hashed (SHA-256); equal digests are equal texts.

The surviving (length, prefix hash) keys, 12 bytes each, go back to the scan as
a broadcast when their count is within ``BROADCAST_KEYS``, else as a shuffled
semi-join; both give the same rows. All groupings combine before the shuffle,
and the joins back carry digests and ids, never texts, so a group of copies of
any size costs one slim row per copy.

Of equal texts the row with the largest id stays; null ids are smaller than
all others. Null texts count as empty. Rows that share both id and text are
one document and share the verdict. Other columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.session import stage_table

PREFIX_CHARS = 256
BROADCAST_KEYS = 1_000_000


def exact_duplicates(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS, carry: dict | None = None) -> DataFrame:
    """Rows ``(doc_id, keep_id, group_size, kept)``, one per row of
    ``docs(doc_id, text)``. ``carry``: further columns by name, as expressions
    over ``doc_id`` and ``text``, computed in the scan."""
    carry = {k: v for k, v in (carry or {}).items()}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.octet_length("text").alias("len"),
        F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix"))
    pairs = rows.groupBy("len", "prefix").agg(F.count(F.lit(1)).alias("n"))
    # lengths held once drop out first, then prefixes held once within a length
    lengths = pairs.groupBy("len").agg(F.sum("n").alias("m")).where("m > 1").select("len")
    keys = stage_table(pairs.where("n > 1").join(lengths, "len", "left_semi").select("len", "prefix"), "prefixes")
    few = keys.limit(broadcast_keys + 1).count() <= broadcast_keys
    marked = keys.withColumn("again", F.lit(True))
    out = ["doc_id", "len", "prefix", *(v.alias(f"carry_{k}") for k, v in carry.items())]
    if few:
        read = rows.join(F.broadcast(marked), ["len", "prefix"], "left").select(
            *out, F.when(F.col("again"), F.sha2("text", 256)).alias("digest"))
    else:  # too many keys to broadcast: survivors carry their texts through one shuffle, the others do not
        read = rows.join(keys, ["len", "prefix"], "left_semi").select(*out, F.sha2("text", 256).alias("digest")).unionByName(
            rows.select(*out).join(keys, ["len", "prefix"], "left_anti").withColumn("digest", F.lit(None).cast("string")))
    names = [F.col(f"carry_{k}").alias(k) for k in carry]
    groups = read.where("digest is not null").groupBy("len", "prefix", "digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    alone = read.where("digest is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), *names)
    several = read.where("digest is not null").join(groups, ["len", "prefix", "digest"]).select(
        "doc_id", "keep_id", "group_size", *names)
    return alone.union(several).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))

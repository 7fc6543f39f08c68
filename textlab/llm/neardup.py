"""Near-duplicate documents by b-bit MinHash.

Plan: one Arrow pass turns every whole text into the set of its distinct word
shingles and keeps ``BANDS * ROWS`` minima as band keys, their lowest
``BITS`` bits packed into a few longs, and a 128-bit fingerprint of the
set. Documents with equal sets form one class (its smallest id stands for it),
so copies cost nothing further. Classes that share a band key are candidates;
the collision-corrected estimate from the packed bits rules out those far
below the threshold, and the rest are confirmed on full sets.

Pairs in a bucket: every member is first compared with one hub (linear in the
bucket), in ``HUB_ROUNDS`` rounds with other hubs, each round only for members
not yet in the hub's component. What still lies in different components is
compared exhaustively in blocks (:func:`_residual`), so no link between
components is lost, no table of pairs arises, and a large group of near copies
costs a few comparisons per member.

Null ids take no part (component null, kept). Texts without words, empty and
null texts are linked with nothing. Rows that share an id are one document:
they are linked and kept or dropped together. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.components import components
from textlab.llm.hashing import runs_of, shingle_sets
from textlab.session import small_batches, stage_table

ROWS, BANDS = 5, 25      # 125 minima; at similarity 0.8 a pair misses every band once in 20,000 times, at 0.85 once in 2.5 million
BITS = 2                 # low bits kept of each minimum for the estimate
SLACK = 0.2              # estimate this far below the threshold: 5 standard errors or more
HUB_ROUNDS = 2
PRUNING_ROUNDS = 2
BLOCK = 256              # sets of a block in the exhaustive step
COLUMNS = 1 << 13        # distinct items handled at a time there
BROADCAST_IDS = 500_000  # ids (8 bytes each) broadcast at most; beyond that a shuffle join
PIECE = 1 << 15          # shingles whose minima are computed at a time


def _seeds():
    rng = np.random.Generator(np.random.PCG64(20240607))
    draw = rng.integers(0, 1 << 63, (2, ROWS * BANDS), dtype=np.int64).astype(np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def minima(sets):
    """ROWS*BANDS minima (upper 32 bits of multiply-shift hashes) per non-empty
    set, as a uint32 matrix."""
    a, b = _seeds()
    flat = np.concatenate(sets)
    heads = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    out = np.full((len(sets), len(a)), 0xFFFFFFFF, np.uint32)
    doc = 0
    for at in range(0, len(flat), PIECE):
        to = min(at + PIECE, len(flat))
        while heads[doc + 1] <= at:
            doc += 1
        last = int(np.searchsorted(heads, to, "left"))
        cut = np.maximum(heads[doc:last], at) - at
        part = flat[at:to]
        for k in range(len(a)):
            v = ((part * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
            out[doc:last, k] = np.minimum(out[doc:last, k], np.minimum.reduceat(v, cut))
    return out


def _sketch_batches(words: int):
    def run(batches):
        for pdf in batches:
            for at, to in runs_of(pdf["text"].tolist()):
                part = pdf.iloc[at:to]
                sets = shingle_sets(part["text"].tolist(), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_shingles": [len(s) for s in sets]})
                prints = [hashlib.md5(s.tobytes()).digest() for s in sets]
                out["f1"] = [int.from_bytes(p[:8], "little", signed=True) for p in prints]
                out["f2"] = [int.from_bytes(p[8:], "little", signed=True) for p in prints]
                sig, bands = [None] * len(sets), [None] * len(sets)
                if full:
                    m = minima([sets[i] for i in full])
                    low = (m[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
                    packed = np.packbits(low.astype(np.uint8).reshape(len(m), -1), axis=1)
                    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.int64)
                    keys = np.zeros((len(m), BANDS), np.uint64)
                    for r in range(ROWS):
                        keys = (keys ^ m[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
                        keys ^= keys >> np.uint64(29)
                    keys += np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)  # a key says its band
                    keys = keys.view(np.int64)
                    for j, i in enumerate(full):
                        sig[i], bands[i] = packed[j], keys[j]
                out["sig"], out["bands"] = sig, bands
                yield out
    return run


def _set_batches(words: int):
    def run(batches):
        for pdf in batches:
            for at, to in runs_of(pdf["text"].tolist()):
                part = pdf.iloc[at:to]
                sets = shingle_sets(part["text"].tolist(), words)
                prints = [hashlib.md5(s.tobytes()).digest() for s in sets]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(),
                    "f1": [int.from_bytes(p[:8], "little", signed=True) for p in prints],
                    "f2": [int.from_bytes(p[8:], "little", signed=True) for p in prints],
                    "items": [s.view(np.int64) for s in sets]})
    return run


def _differing(a: str, b: str):
    """Differing bits of two packed signatures, by JVM-side bit counts."""
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(-(-ROWS * BANDS * BITS // 64))]
    return sum(words[1:], words[0])


def estimate(differing, minima_count: int = ROWS * BANDS):
    """Similarity from the number of differing bits. Minima of different items
    differ in each low bit half of the time, so the differing share of bits is
    (1 - J) / 2 and J = 1 - 2 * share; unlike a count of wholly equal b-bit
    values, every bit adds to the evidence."""
    return 1 - 2 * differing / F.lit(float(minima_count * BITS))


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is in ids (one column, doc_id); ids are broadcast
    when they are few enough by count."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _block_links(num: int, den: int):
    """Links between different components inside one pair of blocks; one link
    per set and other component is enough for union-find."""
    def run(pdf):
        if pdf["comp"].nunique() < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        left, right = np.flatnonzero(pdf["side"] <= 1), np.flatnonzero(pdf["side"] >= 1)  # 1: on both sides
        sizes = pdf["items"].map(len).to_numpy()
        column = np.unique(np.concatenate(pdf["items"].to_list()), return_inverse=True)[1]
        row = np.repeat(np.arange(len(pdf)), sizes)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(column[-1]) + 1, COLUMNS):
            i, j = np.searchsorted(column, [at, at + COLUMNS])
            held = np.zeros((len(pdf), COLUMNS), np.float32)
            held[row[i:j], column[i:j] - at] = 1
            common += held[left] @ held[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        comp, cid = pdf["comp"].to_numpy(), pdf["cid"].to_numpy()
        x, y = np.nonzero((common * den >= union * num) & (comp[left][:, None] != comp[right][None, :]))
        links = pd.DataFrame({"a": cid[left[x]], "b": cid[right[y]], "to": comp[right[y]]})
        return links.drop_duplicates(["a", "to"])[["a", "b"]]
    return run


def _residual(rest: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the different components that still share buckets.

    First, sets that cannot be linked leave: an item held in one component only
    adds to no intersection across components and to every union, so a set of n
    items, c of them held in several components, has at most similarity c / n.
    What stays is compared in blocks of about ``BLOCK`` sets of one family
    (sets connected by shared buckets) and like size; a pair of blocks is one
    task of bounded size and gives only links, so no table of pairs arises."""
    comps = rest.select("cid", "comp").distinct()
    for _ in range(PRUNING_ROUNDS):
        items = sets.join(comps, "cid").select("cid", "comp", F.explode("items").alias("item"))
        crossing = items.groupBy("item").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(
            "lo < hi").select("item", F.lit(1).alias("x"))
        comps = stage_table(items.join(crossing, "item", "left").groupBy("cid", "comp").agg(
            F.count(F.lit(1)).alias("n"), F.count("x").alias("c")).where(F.col("c") * den >= F.col("n") * num), "rest")
    live = rest.select("key", "cid").join(comps.select("cid"), "cid", "left_semi")
    heads = live.groupBy("key").agg(F.min("cid").alias("head"))
    family = components(live.join(heads, "key"), "head", "cid")
    # linked sets differ in size by less than the threshold's ratio: equal or neighbouring size classes
    member = comps.join(family, comps["cid"] == family["node"]).select(
        "cid", "comp", F.col("component").alias("fam"), F.floor(F.log("n") / float(np.log(den / num))).alias("s"))
    blocks = member.groupBy("fam", "s").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("nb"))
    member = stage_table(member.join(blocks, ["fam", "s"]).withColumn("b", F.expr("pmod(xxhash64(cid), nb)")).drop("nb"), "blocks")
    every = blocks.select("fam", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)).alias("b"))
    tasks = every.join(every.select("fam", F.col("s").alias("s2"), F.col("b").alias("b2")), "fam").where(
        ((F.col("s2") == F.col("s")) & (F.col("b2") >= F.col("b"))) | (F.col("s2") == F.col("s") + 1))
    sides = tasks.select("fam", F.xxhash64("fam", "s", "b", "s2", "b2").alias("task"), F.explode(F.when(
        (F.col("s") == F.col("s2")) & (F.col("b") == F.col("b2")), F.array(F.struct("s", "b", F.lit(1).alias("side")))).otherwise(
        F.array(F.struct("s", "b", F.lit(0).alias("side")),
                F.struct(F.col("s2").alias("s"), F.col("b2").alias("b"), F.lit(2).alias("side"))))).alias("x")).select(
        "fam", "task", "x.*")
    rows = sides.join(member, ["fam", "s", "b"]).select("fam", "task", "side", "cid", "comp").join(sets, "cid")
    return rows.groupBy("fam", "task").applyInPandas(_block_links(num, den), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, share: tuple = (80, 100)) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id, kept)``, one per row of
    ``docs(doc_id, text)``: documents are linked when intersection * share[1]
    >= union * share[0] over their sets of distinct ``words``-word shingles."""
    num, den = share
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    number = F.col("doc_id").cast("bigint").alias("doc_id")
    # ids travel through pandas as strings: numbers with nulls among them would turn into floats
    with small_batches(docs.sparkSession):
        sketch = stage_table(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
            _sketch_batches(words),
            "doc_id string, n_shingles bigint, f1 bigint, f2 bigint, sig array<bigint>, bands array<bigint>").select(
            number, "n_shingles", "f1", "f2", "sig", "bands"), "sketch")
    known = sketch.where("doc_id is not null and n_shingles > 0")
    # classes of equal sets; all columns but the id are equal within a class
    classes = stage_table(known.groupBy("f1", "f2").agg(
        F.min(F.struct("doc_id", "n_shingles", "sig", "bands")).alias("c")).select(
        F.col("c.doc_id").alias("cid"), "f1", "f2", F.col("c.n_shingles").alias("n"), "c.sig", "c.bands"), "classes")
    bucket = classes.select(F.explode("bands").alias("key"), "cid")
    shared = bucket.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select("key")
    members = stage_table(bucket.join(shared, "key"), "members")
    wanted = members.select("cid").distinct()
    reps = classes.join(wanted, "cid", "left_semi")
    with small_batches(docs.sparkSession):
        sets = stage_table(
            _only(docs, wanted.withColumnRenamed("cid", "doc_id")).mapInPandas(  # no null ids here
                _set_batches(words), "doc_id bigint, f1 bigint, f2 bigint, items array<bigint>").join(
                reps.select(F.col("cid").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi").select(
                F.col("doc_id").alias("cid"), "f1", "f2", "items").dropDuplicates(["cid", "f1", "f2"]).drop(
                "f1", "f2"), "sets")
    bits = reps.select("cid", "n", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those that are linked, by size, estimate and then full sets."""
        left = bits.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        right = bits.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        likely = pairs.join(left, "a").join(right, "b").where(
            (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
            & (estimate(_differing("sa", "sb")) >= num / den - SLACK)).select("a", "b")
        both = likely.join(sets.select(F.col("cid").alias("a"), F.col("items").alias("xa")), "a").join(
            sets.select(F.col("cid").alias("b"), F.col("items").alias("xb")), "b")
        common = F.size(F.array_intersect("xa", "xb"))
        return both.select("a", "b", common.alias("m"), (F.size("xa") + F.size("xb")).alias("t")).where(
            F.col("m") * den >= (F.col("t") - F.col("m")) * num).select("a", "b")

    links, joined = None, None
    for turn in range(HUB_ROUNDS + 1):
        at = members if joined is None else members.join(
            joined, members["cid"] == joined["node"], "left").select(
            "key", "cid", F.coalesce("component", "cid").alias("comp"))
        if joined is None:
            at = at.withColumn("comp", F.col("cid"))
        open_keys = at.groupBy("key").agg(
            F.min("comp").alias("lo"), F.max("comp").alias("hi"),
            F.min_by(F.struct(F.col("cid").alias("hub"), F.col("comp").alias("hub_comp")),
                     F.xxhash64("cid", F.lit(turn))).alias("h")).where("lo < hi").select("key", "h.*")
        if turn < HUB_ROUNDS:
            pairs = at.join(open_keys, "key").where("comp <> hub_comp").select(
                F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
            new = stage_table(confirmed(pairs), "links")
        else:  # whatever still lies in different components, exhaustively
            rest = at.join(open_keys.select("key"), "key", "left_semi")
            new = stage_table(_residual(stage_table(rest, "rest"), sets, num, den), "links")
        if joined is not None and not new.limit(1).count():
            continue
        links = new if links is None else links.union(new)
        joined = stage_table(components(links, "a", "b"), "joined")
    # rows of one id in several classes are linked through the id itself
    member = known.select("doc_id", "f1", "f2").join(classes.select("cid", "f1", "f2"), ["f1", "f2"])
    label = member.join(joined, member["cid"] == joined["node"], "left").select(
        "doc_id", F.coalesce("component", "cid").alias("comp")).distinct()
    ids = label.groupBy("doc_id").agg(F.min("comp").alias("first"), F.max("comp").alias("last"))
    several = ids.where("first < last").select("doc_id", "first").join(label, "doc_id").where("first < comp")
    merged = components(several, "first", "comp")
    final = ids.join(merged, ids["first"] == merged["node"], "left").select(
        "doc_id", F.coalesce("component", "first").alias("component_id"))
    out = sketch.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, share: tuple = (80, 100)) -> DataFrame:
    """The rows of ``docs`` with their own columns that stay when one document
    of each group does. Dropped ids are few or shuffled slim; rows without an
    id stay."""
    dropped = stage_table(near_duplicates(docs, words, share).where("not kept").select(
        F.col("doc_id").alias("__dropped")).distinct(), "dropped")
    # read with its true size, so Spark broadcasts the ids only if they are small
    return docs.join(dropped, F.col("doc_id").cast("bigint") == F.col("__dropped"), "left_anti").select(
        *(F.col(f"`{c}`") for c in docs.columns))

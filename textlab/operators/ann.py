"""Approximate nearest neighbours: an inverted file with product codes and an
exact re-rank.

Index: vectors are assigned to the nearest of some coarse centroids (a list
each); what is left of a vector after its centroid is cut into ``parts``
sub-vectors, each replaced by the number of the nearest of 256 code words. Centroids
and code words are learnt on a sample of about ``SAMPLE_ROWS`` rows, by a
hash of the key; all rows are indexed. The model has lists x d + 256 x d numbers,
with lists at most ``MAX_LISTS``, and is broadcast.

Search: a query goes to its ``probes`` nearest lists. Lists are cut into blocks of
about ``BLOCK_ROWS`` codes by a hash, so one list with a third of all rows is many
blocks, and queries into groups of as many; a (block, query group) is one
cogrouped task that adds up table look-ups for its codes and keeps the ``rerank``
best of each query. The best of all blocks meet the true vectors in a join, and
exact distances (ties: smaller id) choose the k nearest.

Rows moved: every code once per group of queries that probe its list, every
query ``probes`` times its lists' blocks, and ``rerank`` candidates a query. With lists
in proportion to the rows (``LIST_ROWS`` a list) this grows with rows and
queries, not with their product.

Null vectors are not indexed, and null query vectors have no neighbours. Vectors
must all have one length. An empty side gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_uniform
from ..session import stage_table
from .vectors import _vote, kmeans_fit

SAMPLE_ROWS = 65_536
LIST_ROWS = 100          # rows of a list, on average
MAX_LISTS = 16_384
BLOCK_ROWS = 4_096
CODES = 256
LEARN_ROUNDS = 15
HELD = 2_000_000         # distances or table entries that a task holds at a time
PROBES = 16
RERANK = 64


@dataclass
class IvfPq:
    """Coarse centroids (lists, d) and code words (parts, codes, d / parts)."""

    centroids: np.ndarray
    words: np.ndarray

    def assign(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        c, n = self.centroids, min(n, len(self.centroids))
        out, square = np.empty((len(x), n), np.int64), np.einsum("ij,ij->i", c, c)[None, :]
        for s in slices(len(x), len(c)):
            d2 = square - 2.0 * x[s] @ c.T
            near = np.argpartition(d2, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(d2), 1))
            out[s] = np.take_along_axis(near, np.argsort(np.take_along_axis(d2, near, 1), axis=1, kind="stable"), 1)
        return out

    def pieces(self, x: np.ndarray) -> np.ndarray:
        """Sub-vectors (parts, rows, width); a short last one is filled with zeros."""
        parts, _, width = self.words.shape
        full = np.zeros((len(x), parts * width))
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), parts, width).transpose(1, 0, 2)

    def encode(self, rest: np.ndarray) -> np.ndarray:
        """Code words' numbers (rows, parts) of what is left after the centroid."""
        out = np.empty((len(rest), len(self.words)), np.uint8)
        for m, (p, w) in enumerate(zip(self.pieces(rest), self.words)):
            for s in slices(len(rest), len(w)):
                out[s, m] = np.argmin(np.einsum("ij,ij->i", w, w)[None, :] - 2.0 * p[s] @ w.T, axis=1)
        return out

    def tables(self, rest: np.ndarray) -> np.ndarray:
        """Squared distances (rows, parts, codes) of sub-vectors to code words."""
        out = np.empty((len(rest), *self.words.shape[:2]))
        for m, (p, w) in enumerate(zip(self.pieces(rest), self.words)):
            for s in slices(len(rest), w.size):
                out[s, m] = ((p[s, None, :] - w[None]) ** 2).sum(-1)
        return out


def slices(rows: int, wide: int) -> list[slice]:
    """Blocks of rows that hold at most ``HELD`` entries, ``wide`` a row (or one row)."""
    some = max(1, HELD // max(1, wide))
    return [slice(at, min(rows, at + some)) for at in range(0, rows, some)]


def _matrix(column) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def learn_words(x: np.ndarray, codes: int, rounds: int = LEARN_ROUNDS, seed: int = 0) -> np.ndarray:
    """Lloyd's code words of one sub-vector's sample rows; empty ones restart at the row that lies worst."""
    rng = np.random.default_rng(seed)
    w = np.zeros((codes, x.shape[1]))
    w[: min(codes, len(x))] = x[rng.permutation(len(x))[:codes]]
    w[min(codes, len(x)):] = x[0] if len(x) else 0
    for _ in range(rounds):
        best, off = np.empty(len(x), np.int64), np.empty(len(x))
        for s in slices(len(x), w.size):
            d2 = ((x[s, None, :] - w[None]) ** 2).sum(-1)
            best[s], off[s] = d2.argmin(axis=1), d2.min(axis=1)
        size = np.bincount(best, minlength=codes)
        total = np.zeros_like(w)
        np.add.at(total, best, x)
        used = size > 0
        w[used] = total[used] / size[used, None]
        empty = np.flatnonzero(~used)
        worst = np.argsort(-off, kind="stable")[: len(empty)]
        w[empty[: len(worst)]] = x[worst]
    return w


def fit_index(base: DataFrame, parts: int = 16, key: str = "id", vec: str = "vec", seed: int = 0,
              sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS) -> IvfPq | None:
    """Learns centroids and code words on a hash sample of about ``sample_rows`` rows."""
    spark = base.sparkSession
    rows = base.where(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    n = rows.count()
    if not n:
        return None
    some = stage_table(rows.where(md5_uniform(f"{seed}:ann", "id") < min(1.0, 1.2 * sample_rows / n)) if n > sample_rows else rows, "sample")
    lists = max(1, min(MAX_LISTS, n // list_rows, some.count() // 8))
    if lists > 1:
        _, centres, _ = kmeans_fit(some, lists, seed, "id", "vec", 20)
        centroids = np.array([r["cvec"] for r in centres.orderBy("cluster").collect()])
    else:  # one list around the origin
        centroids = np.zeros((1, rows.agg(F.max(F.size("vec"))).first()[0]))
    d = centroids.shape[1]
    width = math.ceil(d / parts)
    shared = spark.sparkContext.broadcast(IvfPq(centroids, np.zeros((parts, CODES, width))).__dict__)

    def split(batches):
        model = IvfPq(**shared.value)
        for b in batches:
            rows = _matrix(b.column("vec"))
            for s in slices(len(rows), rows.shape[1]):
                x = rows[s]
                p = model.pieces(x - model.centroids[model.assign(x)[:, 0]])
                yield pd_batch(np.repeat(np.arange(len(p)), len(x)), p.reshape(-1, p.shape[2]))

    def pd_batch(part, vectors):
        width = vectors.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.ListArray.from_arrays(
            pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(vectors.ravel()))], ["part", "x"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        w = learn_words(np.stack(pdf["x"].to_numpy()), CODES, seed=seed)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "code": np.arange(len(w)), "w": list(w)})

    learnt = some.select("vec").mapInArrow(split, "part int, x array<double>").groupBy("part").applyInPandas(
        learn, "part int, code int, w array<double>").orderBy("part", "code").collect()  # parts * CODES rows
    words = np.array([r["w"] for r in learnt]).reshape(parts, CODES, width)
    return IvfPq(centroids, words)


def encode_rows(base: DataFrame, model: IvfPq, key: str = "id", vec: str = "vec") -> DataFrame:
    """The index: (list, bid, code) of every row with a vector."""
    shared = base.sparkSession.sparkContext.broadcast(model.__dict__)

    def run(batches):
        m = IvfPq(**shared.value)
        for b in batches:
            x = _matrix(b.column("vec"))
            if len(x):
                lists = m.assign(x)[:, 0]
                code = m.encode(x - m.centroids[lists])
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), b.column("bid"),
                                                  pa.array([c.tobytes() for c in code], pa.binary())], ["list", "bid", "code"])
    kind = base.schema[key].dataType.simpleString()
    return base.where(F.col(vec).isNotNull()).select(F.col(key).alias("bid"), F.col(vec).cast("array<double>").alias("vec")).mapInArrow(
        run, f"list int, bid {kind}, code binary")


def search_index(index: DataFrame, model: IvfPq, queries: DataFrame, base: DataFrame, k: int, key: str = "id", vec: str = "vec",
                 probes: int = PROBES, rerank: int = RERANK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, bid, d2, rank): the k nearest of the candidates, by exact distance."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(model.__dict__)
    qkind, bkind = queries.schema[key].dataType.simpleString(), base.schema[key].dataType.simpleString()
    sizes = stage_table(index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")), "lists")

    def probe(batches):
        m = IvfPq(**shared.value)
        for b in batches:
            rows = _matrix(b.column("vec"))
            for s in slices(len(rows), probes * rows.shape[1]):
                near = m.assign(rows[s], probes)
                own = b.take(pa.array(np.repeat(np.arange(s.start, s.stop), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(near.ravel().astype(np.int32))], ["qid", "qvec", "list"])

    asked = queries.where(F.col(vec).isNotNull()).select(F.col(key).alias("qid"), F.col(vec).cast("array<double>").alias("vec"))
    asked = stage_table(asked.mapInArrow(probe, f"qid {qkind}, qvec array<double>, list int"), "probes")
    # groups of queries per list, and one more row for each block that they have to see
    groups = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("groups"))
    plan = stage_table(sizes.join(groups, "list"), "plan")
    ask = asked.join(plan, "list").withColumn("grp", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "grp", "qid", "qvec")
    codes = index.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("bid"), F.col("blocks")).cast("int")).withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("list", "block", "grp", "bid", "code")

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"qid": [], "bid": [], "near": []})
        m, keep = IvfPq(**shared.value), min(rerank, len(c))
        code = np.frombuffer(b"".join(c["code"]), np.uint8).reshape(len(c), -1)
        rest = np.stack(q["qvec"].to_numpy()) - m.centroids[int(q["list"].iloc[0])]
        found, near = np.empty((len(q), keep), np.int64), np.empty((len(q), keep))
        for s in slices(len(q), m.words.shape[0] * m.words.shape[1]):
            for i, t in enumerate(m.tables(rest[s]), s.start):
                d2 = t[np.arange(code.shape[1])[:, None], code.T].sum(axis=0)
                found[i] = np.argpartition(d2, keep - 1)[:keep] if keep < len(d2) else np.arange(len(d2))
                near[i] = d2[found[i]]
        return pd.DataFrame({"qid": np.repeat(q["qid"].to_numpy(), keep), "bid": c["bid"].to_numpy()[found.ravel()], "near": near.ravel()})

    found = ask.groupBy("list", "block", "grp").cogroup(codes.groupBy("list", "block", "grp")).applyInPandas(
        best, f"qid {qkind}, bid {bkind}, near double")
    top = Window.partitionBy("qid").orderBy("near", "bid")
    some = stage_table(found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= rerank).select("qid", "bid"), "candidates")
    both = some.join(base.select(F.col(key).alias("bid"), F.col(vec).cast("array<double>").alias("bvec")), "bid").join(
        queries.select(F.col(key).alias("qid"), F.col(vec).cast("array<double>").alias("qvec")), "qid")

    def exact(batches):
        for b in batches:
            diff = _matrix(b.column("bvec")) - _matrix(b.column("qvec"))
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("bid"), pa.array((diff * diff).sum(axis=1) if len(diff) else [], pa.float64())],
                                             ["qid", "bid", "d2"])
    near = both.select("qid", "bid", "bvec", "qvec").mapInArrow(exact, f"qid {qkind}, bid {bkind}, d2 double")
    w = Window.partitionBy("qid").orderBy("d2", "bid")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ann_neighbours(queries: DataFrame, base: DataFrame, k: int = 5, key: str = "id", vec: str = "vec", parts: int = 16,
                   seed: int = 0, probes: int = PROBES, rerank: int = RERANK, sample_rows: int = SAMPLE_ROWS,
                   list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """M5 at scale: about the k nearest base rows of every query, (qid, bid, d2, rank)."""
    model = fit_index(base, parts, key, vec, seed, sample_rows, list_rows)
    if model is None:
        kinds = [d.schema[key].dataType.simpleString() for d in (queries, base)]
        return queries.sparkSession.createDataFrame([], f"qid {kinds[0]}, bid {kinds[1]}, d2 double, rank int")
    index = stage_table(encode_rows(base, model, key, vec), "index")
    return search_index(index, model, queries, base, k, key, vec, probes, rerank, block_rows)


def ann_classify(queries: DataFrame, base: DataFrame, ks=(5,), key: str = "id", vec: str = "vec", label: str = "target",
                 **options) -> DataFrame:
    """M5 / M6 at scale: the vote of the neighbours found for every k of ``ks`` (ties: smaller label): (key, k, predicted)."""
    near = ann_neighbours(queries, base, max(ks), key, vec, **options)
    voted = near.join(base.select(F.col(key).alias("bid"), F.col(label).alias("label")), "bid")
    voted = voted.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).where(F.col("rank") <= F.col("k"))
    return _vote(voted, ["qid", "k"]).withColumnRenamed("qid", key)

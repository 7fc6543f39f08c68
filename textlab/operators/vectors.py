"""Labelling by vectors: nearest centroid, cluster purity and cluster vote,
k-means (Spark ML), and exact k-nearest-neighbour vote.

Distances are Euclidean. Ties are broken by a total order everywhere:
(distance, cluster id) for centroids, (distance, row id) for neighbours, and
(votes desc, label asc) for the vote.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CENTROID_VALUES = 16_000_000  # k * dim doubles shipped to every task (128 MB)
KNN_BLOCK_ROWS = 2048             # rows per side in one distance block
DISTANCES = 1_000_000             # distances (rows x centroids) that a task holds at a time


def _matrix(s: pd.Series) -> np.ndarray:
    if len(s) == 0:
        return np.zeros((0, 0))
    return np.stack(s.to_numpy()).astype(np.float64)


def _exact_rank(q: np.ndarray, cand_vecs: np.ndarray, cand_ids: np.ndarray):
    diff = cand_vecs - q
    d2 = np.einsum("ij,ij->i", diff, diff)
    order = np.lexsort((cand_ids, d2))
    return order, d2


def _exact_rank_rows(x: np.ndarray, cand: np.ndarray, mat: np.ndarray, ids: np.ndarray):
    """Vectorised re-rank: for every row i the candidate columns cand[i] of
    ``mat`` ordered by (exact squared distance, id). Returns (order, d2)."""
    diff = mat[cand] - x[:, None, :]
    d2 = np.einsum("ijk,ijk->ij", diff, diff)
    order = np.lexsort((ids[cand], d2), axis=-1)
    return order, np.take_along_axis(d2, order, axis=1)


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str = "id", vec: str = "vec",
                     cluster: str = "cluster", cvec: str = "cvec", out: str = "cluster") -> DataFrame:
    """Each vector's closest centroid (ties -> smaller cluster id).

    A centroid table of at most MAX_CENTROID_VALUES numbers (k x dim, counted)
    is broadcast as one numpy matrix; points are scored with one matrix product
    per block of at most DISTANCES row-centre pairs (or one row); only rows with another centre within rounding distance of
    the best are re-checked with exact differences. No shuffle. A larger table
    is searched in blocks by :func:`knn_neighbours` with k = 1, with the same
    result. A null vector gets a null cluster."""
    k = centroids.count()
    dim = len(centroids.select(cvec).first()[0]) if k else 0
    if k * dim > MAX_CENTROID_VALUES:
        base = centroids.select(F.col(cluster).alias(key), F.col(cvec).alias(vec), F.lit(None).cast("int").alias("target"))
        near = knn_neighbours(points.select(key, vec).where(F.col(vec).isNotNull()), base, 1, key, vec, "target")
        return points.select(key).join(near.select(F.col("qid").alias(key), F.col("bid").cast("int").alias(out)), key, "left")
    rows = centroids.select(cluster, cvec).orderBy(cluster).collect()
    ids = np.array([r[0] for r in rows], dtype=np.int64)
    cmat = np.array([r[1] for r in rows], dtype=np.float64)
    bc = points.sparkSession.sparkContext.broadcast((ids, cmat))

    def assign(batches):
        cids, c = bc.value
        cn = np.einsum("ij,ij->i", c, c)
        for pdf in batches:
            known = pdf[vec].notna().to_numpy()
            x = _matrix(pdf[vec][known])
            best = np.empty(len(x), dtype=np.int64)
            rows = max(1, DISTANCES // max(1, len(cids)))
            for at in range(0, len(x) if len(cids) else 0, rows):
                part = x[at: at + rows]
                d2 = part @ c.T
                d2 *= -2.0
                d2 += np.einsum("ij,ij->i", part, part)[:, None]
                d2 += cn[None, :]
                low, own = d2.min(axis=1), np.argmin(d2, axis=1)
                tol = 1e-9 * (1.0 + max(d2.max(), -d2.min()))
                near = d2 <= (low + tol)[:, None]              # every centre that could be the closest
                best[at: at + rows] = cids[own]
                for i in np.nonzero(near.sum(axis=1) > 1)[0]:  # near-ties: exact distances, then smaller id
                    cand = np.nonzero(near[i])[0]
                    order, _ = _exact_rank(part[i], c[cand], cids[cand])
                    best[at + i] = cids[cand[order[0]]]
            label = pd.array([None] * len(pdf), dtype="Int32")
            if len(cids):
                label[known] = best
            yield pd.DataFrame({key: pdf[key].to_numpy(), out: label})

    key_type = points.schema[key].dataType.simpleString()
    return points.select(key, vec).mapInPandas(assign, f"{key} {key_type}, {out} int")


def cluster_purity(assigned: DataFrame, cluster: str = "cluster", target: str = "target") -> DataFrame:
    """M3: per cluster n0, n1, purity = max(n0, n1) / size and the majority
    label (0 on ties). Clusters without rows do not appear; the purity of one
    whose targets are all null is null."""
    g = assigned.groupBy(cluster).agg(F.count_if(F.col(target) == 0).alias("n0"),
                                       F.count_if(F.col(target) == 1).alias("n1"))
    return g.select(cluster, "n0", "n1",
                    F.try_divide(F.greatest("n0", "n1"), F.col("n0") + F.col("n1")).alias("purity"),
                    F.when(F.col("n0") >= F.col("n1"), F.lit(0)).otherwise(F.lit(1)).alias("label"))


def mean_purity(purity: DataFrame) -> DataFrame:
    """M4: unweighted mean of the cluster purities."""
    return purity.agg(F.avg("purity").alias("mean_purity"))


def cluster_label_lookup(assigned: DataFrame, purity: DataFrame, cluster: str = "cluster",
                         out: str = "label") -> DataFrame:
    """Cluster -> majority label (one row per cluster; Spark broadcasts it where its size allows)."""
    return assigned.join(purity.select(cluster, F.col("label").alias(out)), cluster, "left")


def cluster_classify(train: DataFrame, queries: DataFrame, centroids: DataFrame, key: str = "id",
                     vec: str = "vec", target: str = "target") -> DataFrame:
    """M7: label clusters by the training rows, then give each query row the
    label of its nearest cluster (null if that cluster had no training row)."""
    tr = nearest_centroid(train, centroids, key, vec).join(train.select(key, target), key)
    pur = cluster_purity(tr, "cluster", target)
    q = nearest_centroid(queries, centroids, key, vec)
    return cluster_label_lookup(q, pur, "cluster", "predicted")


def num_clusters_rule(df: DataFrame, col: str = "keyword") -> DataFrame:
    """M2: k = 4 * (distinct non-null values) + 20."""
    return df.agg(F.count_distinct(F.col(col)).alias("n_values")) \
        .select("n_values", (F.col("n_values") * 4 + 20).alias("k"))


def kmeans_fit(points: DataFrame, k: int, seed: int = 0, key: str = "id", vec: str = "vec", max_iter: int = 20):
    """M1: Spark ML k-means (k-means|| init) on an array column. Returns the
    model, its centroid table (cluster, cvec) and the assignments (key, cluster)."""
    feats = points.select(key, array_to_vector(F.col(vec)).alias("features")).persist()  # iterative: scan once
    try:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(feats)
    finally:
        feats.unpersist()
    feats = points.select(key, array_to_vector(F.col(vec)).alias("features"))
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    cdf = points.sparkSession.createDataFrame(centers, "cluster INT, cvec ARRAY<DOUBLE>")
    assigned = model.transform(feats).select(key, F.col("cluster").cast("int").alias("cluster"))
    return model, cdf, assigned


def cluster_count_sweep(points: DataFrame, k0: int, seed: int = 0, key: str = "id", vec: str = "vec",
                        target: str = "target", max_iter: int = 20, parallel_fits: int = 4) -> DataFrame:
    """M8: mean purity for k in range(k0 // 3, 3 * k0, k0 // 6) and the best k
    (first on ties). The vectors are cached once for all fits; each fit is a
    distributed Spark ML job and returns one scalar."""
    step = max(1, k0 // 6)
    ks = [k for k in range(k0 // 3, 3 * k0, step) if k >= 1]
    pts = points.select(key, vec, target).persist()

    def one(k):
        _, _, assigned = kmeans_fit(pts, k, seed, key, vec, max_iter)
        return k, float(mean_purity(cluster_purity(assigned.join(pts.select(key, target), key))).first()[0])

    try:
        # independent fits: submitted from a few driver threads so their
        # (small) jobs share the cluster instead of queueing one by one
        with ThreadPoolExecutor(max_workers=max(1, min(parallel_fits, len(ks)))) as ex:
            res = list(ex.map(one, ks))
    finally:
        pts.unpersist()
    best = max(res, key=lambda r: (r[1], -r[0]))[0] if res else None
    return points.sparkSession.createDataFrame([(k, p, k == best) for k, p in res],
                                               "num_clusters INT, mean_purity DOUBLE, is_best BOOLEAN")


def knn_neighbours(queries: DataFrame, base: DataFrame, k: int, key: str = "id", vec: str = "vec",
                   label: str = "target", block_rows: int = KNN_BLOCK_ROWS) -> DataFrame:
    """Exact k nearest base rows for every query row: (qid, bid, label, d2, rank).

    Both sides are hash-cut into blocks of about ``block_rows`` rows; every
    (query block, base block) pair meets in one cogroup task that computes the
    block's distances with numpy and emits only its k best per query (never
    the pairs). A final per-query top-k over the partial lists (WindowGroupLimit)
    gives the answer. Memory per task is bounded by the block size, whatever
    the table sizes; data moved is |Q| x base-blocks + |B| x query-blocks rows."""
    nq, nb = queries.count(), base.count()
    qb, bb = max(1, math.ceil(nq / block_rows)), max(1, math.ceil(nb / block_rows))
    q = queries.select(F.col(key).alias("qid"), F.col(vec).alias("qvec")) \
        .withColumn("qblk", F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int")) \
        .withColumn("bblk", F.explode(F.sequence(F.lit(0), F.lit(bb - 1))))
    b = base.select(F.col(key).alias("bid"), F.col(vec).alias("bvec"), F.col(label).alias("label")) \
        .withColumn("bblk", F.pmod(F.xxhash64("bid"), F.lit(bb)).cast("int")) \
        .withColumn("qblk", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    qtype = queries.schema[key].dataType.simpleString()
    btype = base.schema[key].dataType.simpleString()
    ltype = base.schema[label].dataType.simpleString()
    schema = f"qid {qtype}, bid {btype}, label {ltype}, d2 double"

    def block_topk(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(bpdf) == 0:
            return pd.DataFrame({"qid": [], "bid": [], "label": [], "d2": []})
        qm, bm = _matrix(qpdf["qvec"]), _matrix(bpdf["bvec"])
        bids, labels = bpdf["bid"].to_numpy(), bpdf["label"].to_numpy()
        approx = np.einsum("ij,ij->i", qm, qm)[:, None] - 2.0 * (qm @ bm.T) + np.einsum("ij,ij->i", bm, bm)[None, :]
        tol = 1e-9 * (1.0 + np.abs(approx).max())
        kk = min(k, len(bpdf))
        qids = qpdf["qid"].to_numpy()
        kth = np.partition(approx, kk - 1, axis=1)[:, kk - 1]
        near = approx <= (kth + tol)[:, None]          # every column that could be in the exact top-k
        n_near = near.sum(axis=1)
        sel = np.empty((len(qpdf), kk), dtype=np.int64)
        dist = np.empty((len(qpdf), kk))
        easy = np.nonzero(n_near == kk)[0]              # no tie at the boundary: vectorised
        if len(easy):
            cand = np.argpartition(approx[easy], kk - 1, axis=1)[:, :kk] if kk < len(bpdf) else \
                np.tile(np.arange(len(bpdf)), (len(easy), 1))
            order, d2 = _exact_rank_rows(qm[easy], cand, bm, bids)
            sel[easy] = np.take_along_axis(cand, order, axis=1)
            dist[easy] = d2
        for i in np.nonzero(n_near != kk)[0]:           # ties around the k-th distance: exact per row
            cand = np.nonzero(near[i])[0]
            order, d2 = _exact_rank(qm[i], bm[cand], bids[cand])
            sel[i] = cand[order[:kk]]
            dist[i] = d2[order[:kk]]
        return pd.DataFrame({"qid": np.repeat(qids, kk), "bid": bids[sel].reshape(-1),
                             "label": labels[sel].reshape(-1), "d2": dist.reshape(-1)})

    part = q.groupBy("qblk", "bblk").cogroup(b.groupBy("qblk", "bblk")).applyInPandas(block_topk, schema)
    w = Window.partitionBy("qid").orderBy(F.col("d2").asc(), F.col("bid").asc())
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _vote(nb: DataFrame, keys: list[str]) -> DataFrame:
    votes = nb.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(*keys).agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("predicted"))


def knn_classify(queries: DataFrame, base: DataFrame, k: int = 5, key: str = "id", vec: str = "vec",
                 label: str = "target", block_rows: int = KNN_BLOCK_ROWS) -> DataFrame:
    """M5: uniform vote of the k nearest base rows (ties -> smaller label)."""
    nb = knn_neighbours(queries, base, k, key, vec, label, block_rows)
    return _vote(nb, ["qid"]).withColumnRenamed("qid", key)


def knn_k_sweep(queries: DataFrame, base: DataFrame, ks=(2, 3, 5, 7, 10, 20), key: str = "id", vec: str = "vec",
                label: str = "target", block_rows: int = KNN_BLOCK_ROWS) -> DataFrame:
    """M6: the vote for several k from one neighbour search with max(ks)."""
    nb = knn_neighbours(queries, base, max(ks), key, vec, label, block_rows)
    nbk = nb.withColumn("k", F.explode(F.array(*[F.lit(int(x)) for x in ks]))).where(F.col("rank") <= F.col("k"))
    return _vote(nbk, ["qid", "k"]).withColumnRenamed("qid", key)

"""Registered queries: labelling by vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann as AN
from ..operators import sweep as SW
from ..operators import vectors as VX
from .fixtures import view
from .registry import register


def d2_duck(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), "
            "lambda z: (z[1] - z[2]) * (z[1] - z[2])))")


ASSIGN = (f"asg AS (SELECT id, cluster FROM (SELECT p.id, c.cluster, row_number() OVER (PARTITION BY p.id "
          f"ORDER BY {d2_duck('p.vec', 'c.cvec')}, c.cluster) AS rn FROM points p, centroids c) x WHERE rn = 1)")
PURITY_OF = ("SELECT cluster, n0, n1, CAST(greatest(n0, n1) AS DOUBLE) / (n0 + n1) AS purity, "
             "CASE WHEN n0 >= n1 THEN 0 ELSE 1 END AS label FROM (SELECT a.cluster, "
             "count(*) FILTER (WHERE p.target = 0) AS n0, count(*) FILTER (WHERE p.target = 1) AS n1 "
             "FROM asg a JOIN points p ON a.id = p.id {where} GROUP BY a.cluster) g")


def points_parts(spark, sf):
    pts = view(spark, sf, "points")
    return pts, pts.where(~F.col("is_query")), pts.where(F.col("is_query"))


@register("nearest_centroid", "id:i cluster:i", f"WITH {ASSIGN} SELECT id, cluster FROM asg", ["centroids", "points"])
def q_nearest_centroid(spark, sf):
    return VX.nearest_centroid(view(spark, sf, "points"), view(spark, sf, "centroids"))


@register("cluster_purity", "cluster:i n0:i n1:i purity:d label:i",
          f"WITH {ASSIGN} {PURITY_OF.format(where='')}", ["centroids", "points"])
def q_cluster_purity(spark, sf):
    pts = view(spark, sf, "points")
    asg = VX.nearest_centroid(pts, view(spark, sf, "centroids")).join(pts.select("id", "target"), "id")
    return VX.cluster_purity(asg)


@register("mean_purity", "mean_purity:d",
          f"WITH {ASSIGN}, pur AS ({PURITY_OF.format(where='')}) SELECT avg(purity) AS mean_purity FROM pur",
          ["centroids", "points"])
def q_mean_purity(spark, sf):
    pts = view(spark, sf, "points")
    asg = VX.nearest_centroid(pts, view(spark, sf, "centroids")).join(pts.select("id", "target"), "id")
    return VX.mean_purity(VX.cluster_purity(asg))


@register("cluster_label_lookup", "id:i cluster:i label:i",
          f"WITH {ASSIGN}, pur AS ({PURITY_OF.format(where='WHERE NOT p.is_query')}) "
          "SELECT a.id, a.cluster, pur.label FROM asg a LEFT JOIN pur ON a.cluster = pur.cluster",
          ["centroids", "points"])
def q_cluster_label_lookup(spark, sf):
    pts, train, _ = points_parts(spark, sf)
    cen = view(spark, sf, "centroids")
    tr = VX.nearest_centroid(train, cen).join(train.select("id", "target"), "id")
    return VX.cluster_label_lookup(VX.nearest_centroid(pts, cen), VX.cluster_purity(tr))


@register("cluster_classify", "id:i cluster:i predicted:i",
          f"WITH {ASSIGN}, pur AS ({PURITY_OF.format(where='WHERE NOT p.is_query')}) "
          "SELECT a.id, a.cluster, pur.label AS predicted FROM asg a JOIN points p ON a.id = p.id "
          "LEFT JOIN pur ON a.cluster = pur.cluster WHERE p.is_query", ["centroids", "points"])
def q_cluster_classify(spark, sf):
    _, train, queries = points_parts(spark, sf)
    return VX.cluster_classify(train, queries, view(spark, sf, "centroids"))


@register("num_clusters_rule", "n_values:i k:i",
          "SELECT count(DISTINCT keyword) AS n_values, count(DISTINCT keyword) * 4 + 20 AS k FROM tw", ["tw"])
def q_num_clusters(spark, sf):
    return VX.num_clusters_rule(view(spark, sf, "tw"), "keyword")


KNN_RANKED = (f"rk AS (SELECT q.id AS qid, b.id AS bid, b.target, row_number() OVER (PARTITION BY q.id ORDER BY "
              f"{d2_duck('q.vec', 'b.vec')}, b.id) AS rank FROM points q, points b WHERE q.is_query AND NOT b.is_query)")


@register("knn_classify", "id:i predicted:i",
          f"""WITH {KNN_RANKED}, c AS (SELECT qid, target, count(*) AS n FROM rk WHERE rank <= 5 GROUP BY qid, target)
SELECT qid AS id, target AS predicted FROM (SELECT qid, target, row_number() OVER (PARTITION BY qid ORDER BY n DESC, target) AS z
FROM c) x WHERE z = 1""", ["points"])
def q_knn_classify(spark, sf):
    _, base, queries = points_parts(spark, sf)
    return VX.knn_classify(queries, base, 5)


@register("knn_k_sweep", "id:i k:i predicted:i",
          f"""WITH {KNN_RANKED}, ks AS (SELECT unnest([2, 3, 5, 7, 10, 20]) AS k),
 c AS (SELECT qid, k, target, count(*) AS n FROM rk JOIN ks ON rk.rank <= ks.k GROUP BY qid, k, target)
SELECT qid AS id, k, target AS predicted FROM (SELECT qid, k, target, row_number() OVER (PARTITION BY qid, k ORDER BY n DESC, target) AS z
FROM c) x WHERE z = 1""", ["points"])
def q_knn_sweep(spark, sf):
    _, base, queries = points_parts(spark, sf)
    return VX.knn_k_sweep(queries, base, (2, 3, 5, 7, 10, 20))


@register("knn_ivfpq", "qid:i bid:i rank:i d2:d")
def q_knn_ivfpq(spark, sf):
    """Approximate neighbours of every row whose id is divisible by 20, among all rows."""
    pts = view(spark, sf, "points")
    return AN.ann_neighbours(pts.where("id % 20 = 0"), pts, 5)


@register("knn_ivfpq_sweep", "id:i k:i predicted:i")
def q_knn_ivfpq_sweep(spark, sf):
    _, base, queries = points_parts(spark, sf)
    return AN.ann_classify(queries, base, (2, 3, 5, 7, 10, 20))


# Non-SQL-expressible (iterative Spark ML fits): rows-only check, invariants in pytest.

@register("kmeans_fit", "id:i cluster:i")
def q_kmeans(spark, sf):
    _, _, asg = VX.kmeans_fit(view(spark, sf, "points"), 10, seed=0)
    return asg


@register("cluster_count_sweep", "num_clusters:i mean_purity:d is_best:i")
def q_cluster_sweep(spark, sf):
    return VX.cluster_count_sweep(view(spark, sf, "points"), 12, seed=0, max_iter=10)


@register("cluster_sweep_one_scan", "num_clusters:i mean_purity:d is_best:i")
def q_cluster_sweep_one_scan(spark, sf):
    """The sweep at the reference's settings: k0 from the rule of the keywords."""
    k0 = VX.num_clusters_rule(view(spark, sf, "tw"), "keyword").first()["k"]
    return SW.cluster_count_sweep_lloyd(view(spark, sf, "points"), k0)

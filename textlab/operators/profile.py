"""Profiling a labelled text table: counts, missing values, distinct values,
length statistics, histograms and overlap between two sets of values.

Each report is one aggregation pass; nothing is collected to the driver
except, where stated, a handful of scalars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
MAX_SERIES = 100_000  # histogram edge tables (one row per series) broadcast below this


def target_distribution(df: DataFrame, target: str = "target") -> DataFrame:
    """A1: rows per target value."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def _stack(one: DataFrame, names: list[str], fields: list[str], label: str = "column") -> DataFrame:
    """One-row wide aggregate -> long form, one row per name."""
    rows = [F.struct(F.lit(n).alias(label), *[F.col(f"{n}__{f}").alias(f) for f in fields]) for n in names]
    return one.select(F.inline(F.array(*rows)))


def missing_counts(df: DataFrame, cols: list[str], placeholder: str = T.NONE_KEYWORD) -> DataFrame:
    """A4: per column the count of the placeholder string, of nulls and their
    sum, all columns in one pass."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c) == F.lit(placeholder)).alias(f"{c}__none_count"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}__null_count")]
    one = df.agg(*aggs)
    one = one.select("*", *[(F.col(f"{c}__none_count") + F.col(f"{c}__null_count")).alias(f"{c}__total_missing")
                            for c in cols])
    return _stack(one, cols, ["none_count", "null_count", "total_missing"])


def _distinct_key(df: DataFrame, c: str):
    """What the exact distinct count shuffles: strings travel as their 128-bit
    md5 (16 bytes instead of whole texts; a collision is ~1e-19 likely at
    1e10 values), other types as they are."""
    if df.schema[c].dataType.simpleString() == "string":
        return F.md5(F.col(c))
    return F.col(c)


def distinct_values(df: DataFrame, cols: list[str], approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """A5: distinct non-null values per column (exact, or HyperLogLog++ with
    relative error ``rsd``, which needs no shuffle of the values)."""
    if approx:
        aggs = [F.approx_count_distinct(c, rsd).alias(f"{c}__n_distinct") for c in cols]
    else:
        aggs = [F.count_distinct(_distinct_key(df, c)).alias(f"{c}__n_distinct") for c in cols]
    return _stack(df.agg(*aggs), cols, ["n_distinct"])


def dataset_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column name, type, non-null count and distinct count, plus the
    row and column counts of the table, from one aggregation."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        aggs.append(F.count(F.col(c)).alias(f"{c}__non_null"))
        aggs.append((F.approx_count_distinct(c) if approx else F.count_distinct(_distinct_key(df, c)))
                    .alias(f"{c}__n_distinct"))
    one = df.agg(*aggs)
    types = dict((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                     F.col(f"{c}__non_null").alias("non_null"), F.col(f"{c}__n_distinct").alias("n_distinct"),
                     F.col("__rows").alias("n_rows"), F.lit(len(cols)).alias("n_cols"))
            for c in cols]
    return one.select(F.inline(F.array(*rows)))


def length_stats(df: DataFrame, text: str = "text", by: str | Column | None = None) -> DataFrame:
    """Mean and sample standard deviation (ddof=1) of text length per group."""
    ln = T.text_length(text)
    aggs = [F.avg(ln).alias("mean_len"), F.stddev_samp(ln).alias("std_len")]
    return df.groupBy(by).agg(*aggs) if by is not None else df.agg(*aggs)


def histogram_equal_width(df: DataFrame, value: str | Column, bins: int, series: str | None = None,
                          shared_edges: bool = False) -> DataFrame:
    """``bins`` equal-width bins over [min, max] of each series (numpy
    semantics: last bin closed on the right; min == max widens by 0.5 each
    side), empty bins included. Output (series, bin, lo, hi, n).

    Per-series min/max come from one aggregate (its rows, under a counted
    bound, are broadcast back) joined on the series key; no global window
    over the data.
    """
    v = F.col(value) if isinstance(value, str) else value
    base = df.select((F.col(series) if series else F.lit("all")).alias("series"), v.cast("double").alias("x")) \
        .where(F.col("x").isNotNull())
    if shared_edges:
        # two scalars on the driver, the same edges for every series
        mm = base.agg(F.min("x").alias("mn"), F.max("x").alias("mx")).first()
        stats = base.select("series").distinct().select("series", F.lit(mm["mn"]).alias("mn"),
                                                         F.lit(mm["mx"]).alias("mx"))
    else:
        stats = base.groupBy("series").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    stats = stats.select("series",
                         F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                         F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    # The per-series edges are a tiny table (one row per series). Under a
    # counted bound they come back as literal rows and are broadcast, so a
    # series holding most of the rows is never a shuffle hot spot; above it,
    # the join stays a shuffle join (AQE splits skewed partitions).
    edge_rows = stats.limit(MAX_SERIES + 1).collect()
    if len(edge_rows) <= MAX_SERIES:
        stats = F.broadcast(df.sparkSession.createDataFrame(edge_rows, stats.schema))
    idx = F.least(F.floor((F.col("x") - F.col("lo")) * F.lit(bins) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    edges = stats.withColumnRenamed("series", "of")
    counts = (base.join(edges, F.col("series").eqNullSafe(F.col("of")))  # a null series is a series
              .where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
              .groupBy("series", idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    grid = stats.select("series", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    counts = counts.select(F.col("series").alias("of"), F.col("bin").alias("at"), "n")
    return (grid.join(counts, F.col("series").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at")), "left")
            .select("series", "bin", (F.col("lo") + F.col("bin") * width).alias("lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def histogram_int_edges(df: DataFrame, value: str | Column, edges=tuple(range(10)),
                        series: str | None = None) -> DataFrame:
    """Histogram with integer edges e0 < e1 < ... < ek (numpy semantics:
    values outside [e0, ek] are dropped; the last bin is closed, so with edges
    0..9 the values 8 and 9 share bin 8). Empty bins included."""
    edges = list(edges)
    nb = len(edges) - 1
    v = F.col(value) if isinstance(value, str) else value
    base = df.select((F.col(series) if series else F.lit("all")).alias("series"), v.cast("double").alias("x"))
    # bin index = number of inner edges <= x (edges are a short literal list)
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    idx = F.size(F.filter(inner, lambda e: e <= F.col("x")))
    counts = (base.where(F.col("x").between(float(edges[0]), float(edges[-1])))
              .groupBy("series", idx.alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    grid = base.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bin"))
    counts = counts.select(F.col("series").alias("of"), F.col("bin").alias("at"), "n")
    return (grid.join(counts, F.col("series").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("at")), "left")
            .select("series", "bin", F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def _distinct_tagged(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of both sides with membership flags, by one
    union + one grouped pass (no join)."""
    u = (a.select(F.col(col).alias("value"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
         .unionByName(b.select(F.col(col).alias("value"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
         .where(F.col("value").isNotNull()))
    return u.groupBy("value").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def keyword_overlap(a: DataFrame, b: DataFrame, col: str = "keyword") -> DataFrame:
    """Sizes of both distinct value sets, of their intersection, and the
    share of each side found in the other (percent)."""
    t = _distinct_tagged(a, b, col)
    one = t.agg(F.sum("in_a").alias("n_a"), F.sum("in_b").alias("n_b"),
                F.count_if((F.col("in_a") == 1) & (F.col("in_b") == 1)).alias("n_common"))
    return one.select("n_a", "n_b", "n_common",
                      (F.try_divide(F.col("n_common").cast("double"), F.col("n_a")) * 100).alias("pct_a_in_b"),
                      (F.try_divide(F.col("n_common").cast("double"), F.col("n_b")) * 100).alias("pct_b_in_a"))


def keyword_intersect(a: DataFrame, b: DataFrame, col: str = "keyword") -> DataFrame:
    """Values present on both sides."""
    return a.select(col).where(F.col(col).isNotNull()).intersect(b.select(col))


def keyword_except(a: DataFrame, b: DataFrame, col: str = "keyword") -> DataFrame:
    """Distinct values of ``a`` absent from ``b``."""
    return a.select(col).where(F.col(col).isNotNull()).subtract(b.select(col))


def overlap_flag(rows: DataFrame, other: DataFrame, col: str = "keyword", anti: bool = False) -> DataFrame:
    """Rows whose value is (semi) / is not (anti) among ``other``'s values."""
    return rows.join(other.select(col).where(F.col(col).isNotNull()), col, "left_anti" if anti else "left_semi")


def head_n(df: DataFrame, key: str = "id", n: int = 5) -> DataFrame:
    """First n rows in key order (TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)

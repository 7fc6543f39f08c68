"""Error analysis: predictions against truth (joins, error filters, rates,
text features, correlations, common words).

All operators take DataFrames plus column names and return DataFrames. The
joined table is the natural thing to ``persist`` when several reports run on
it; each report below is a single aggregation pass (partial aggregation before
the shuffle, so a hot key costs one row per map task).
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def pred_actual_join(preds: DataFrame, truth: DataFrame, key: str = "id", target: str = "target",
                     pred_name: str = "predicted_target", actual_name: str = "actual_target") -> DataFrame:
    """Inner equi-join on ``key``; both sides carry ``target``, renamed to
    predicted / actual. Duplicate keys multiply, as in any inner join. The
    strategy (broadcast / sort-merge / skew split) is left to AQE."""
    p = preds.withColumnRenamed(target, pred_name)
    t = truth.withColumnRenamed(target, actual_name)
    return p.join(t, key, "inner")


def error_flag(pred: str = "predicted_target", actual: str = "actual_target") -> Column:
    return F.col(pred) != F.col(actual)


def misclassified(df: DataFrame, pred: str = "predicted_target", actual: str = "actual_target") -> DataFrame:
    """Rows with predicted != actual."""
    return df.where(error_flag(pred, actual))


def correct(df: DataFrame, pred: str = "predicted_target", actual: str = "actual_target") -> DataFrame:
    """Rows with predicted == actual."""
    return df.where(F.col(pred) == F.col(actual))


def error_table(df: DataFrame, key: str = "id", cols=("keyword", "location", "text"),
                pred: str = "predicted_target", actual: str = "actual_target") -> DataFrame:
    """P5: error rows as (key, cols..., actual, predicted), totally ordered by key."""
    return (misclassified(df, pred, actual)
            .select(key, *cols, actual, pred)
            .orderBy(key))


def attach_predictions(rows: DataFrame, preds: DataFrame, key: str = "id", target: str = "target") -> DataFrame:
    """Put predictions next to rows by key (left join); rows without a
    prediction keep a null target instead of failing on a length mismatch."""
    return rows.join(preds.select(key, target), key, "left")


def value_counts(df: DataFrame, col: str, n: int | None = None, dropna: bool = True,
                 count_name: str = "n") -> DataFrame:
    """A2 / A3: counts per value, most frequent first, ties by value (nulls
    first). ``dropna=False`` keeps null as a value. With ``n`` this plans as a
    partial+final aggregate followed by TakeOrderedAndProject."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    out = src.groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
    out = out.orderBy(F.col(count_name).desc(), F.col(col).asc_nulls_first())
    return out.limit(n) if n is not None else out


def rate_align(num: DataFrame, den: DataFrame, key: str, num_col: str = "n_err", den_col: str = "n",
               rate_col: str = "rate") -> DataFrame:
    """Divide two count tables aligned on ``key``; a key missing on either
    side gives rate 0 (pandas ``(a / b).fillna(0)``)."""
    j = num.select(key, num_col).join(den.select(key, den_col), key, "full_outer")
    return j.select(key, num_col, den_col,
                    F.coalesce(F.try_divide(F.col(num_col).cast("double"), F.col(den_col)),
                               F.lit(0.0)).alias(rate_col))


def misclassification_rate(df: DataFrame, pred: str = "predicted_target",
                           actual: str = "actual_target") -> DataFrame:
    """(n_rows, n_errors, rate) in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(error_flag(pred, actual)).alias("n_errors")) \
        .select("n_rows", "n_errors", F.try_divide(F.col("n_errors").cast("double"), F.col("n_rows")).alias("rate"))


def group_error_rate(df: DataFrame, key: str, pred: str = "predicted_target", actual: str = "actual_target",
                     n: int | None = 10, min_count: int = 1) -> DataFrame:
    """Error rate per group, highest first (ties by key), null groups
    dropped. One grouped pass with a conditional sum instead of two counts and
    a join; ``min_count`` hides tiny groups (1 = keep all)."""
    g = (df.where(F.col(key).isNotNull())
         .groupBy(key)
         .agg(F.count_if(error_flag(pred, actual)).alias("n_err"), F.count(F.lit(1)).alias("n"))
         .where(F.col("n") >= min_count)
         .select(key, "n_err", "n", (F.col("n_err") / F.col("n")).alias("rate")))
    g = g.orderBy(F.col("rate").desc(), F.col(key).asc())
    return g.limit(n) if n is not None else g


def length_by_correctness(df: DataFrame, text: str = "text", pred: str = "predicted_target",
                          actual: str = "actual_target") -> DataFrame:
    """A10: mean text length of right (correct=1) and wrong (correct=0) rows."""
    return (df.groupBy((F.col(pred) == F.col(actual)).cast("int").alias("correct"))
            .agg(F.avg(T.text_length(text)).alias("avg_len")))


def feature_columns(text: str = "text") -> dict[str, Column]:
    """F1, F4-F6 as numeric features."""
    return {
        "contains_link": T.contains_link(text).cast("int"),
        "hashtag_count": T.hashtag_count(text),
        "caps_word_count": T.caps_word_count(text),
        "tweet_length": T.text_length(text),
    }


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in feature_columns(text).items()])


def errors_vs_all(df: DataFrame, feature: Column, name: str, pred: str = "predicted_target",
                  actual: str = "actual_target") -> DataFrame:
    """Mean of one feature over error rows and over all rows, in one
    scan (conditional average), long form (grp, name)."""
    err = error_flag(pred, actual)
    one = df.agg(F.avg(F.when(err, feature)).alias("errors"), F.avg(feature).alias("all"))
    return one.select(F.expr("stack(2, 'errors', errors, 'all', `all`)").alias("grp", name))


def link_share(df, text="text", **kw):
    """Share of rows with a link, errors vs all."""
    return errors_vs_all(df, T.contains_link(text).cast("int"), "share", **kw)


def hashtag_avg(df, text="text", **kw):
    """Mean hashtag count, errors vs all."""
    return errors_vs_all(df, T.hashtag_count(text), "avg_hashtags", **kw)


def caps_avg(df, text="text", **kw):
    """Mean caps-word count, errors vs all."""
    return errors_vs_all(df, T.caps_word_count(text), "avg_caps", **kw)


def error_direction(df: DataFrame, pred: str = "predicted_target", actual: str = "actual_target") -> DataFrame:
    """False positives (pred > actual) and false negatives (pred < actual)."""
    return df.agg(F.count_if(F.col(pred) > F.col(actual)).alias("false_positives"),
                  F.count_if(F.col(pred) < F.col(actual)).alias("false_negatives"))


def feature_correlation(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson matrix of numeric columns in ONE aggregation pass, long
    form (a, b, r). A constant column gives null (no divide-by-zero error)."""
    aggs = []
    for f in features:
        aggs.append(F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}"))
    for a, b in product(features, features):
        aggs.append(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{a}_{b}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                     F.try_divide(F.col(f"c_{a}_{b}"), F.nullif(F.col(f"s_{a}") * F.col(f"s_{b}"), F.lit(0.0)))
                     .alias("r"))
            for a, b in product(features, features)]
    return one.select(F.inline(F.array(*rows)))


def top_words(df: DataFrame, text: str = "text", n: int = 10, lower: bool = True) -> DataFrame:
    """Most frequent whitespace words (lower-cased), ties by word.
    explode -> partial count per map task -> shuffle of (word, partial) ->
    TakeOrderedAndProject; a hot word costs one row per task before the shuffle."""
    words = df.select(F.explode(T.tokenize_ws(text, lower=lower)).alias("word"))
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("word").asc()).limit(n))

"""Quality rules: fixed text rules plus a hashed n-gram logistic regression.

The classifier sees relative frequencies of hashed word uni- and bigrams and
of hashed character 3- and 4-grams (two tables of ``BUCKETS`` weights). Spark
ML fits it on at most ``FIT_ROWS`` labelled rows, chosen by a hash of their id;
one row in ``CALIBRATION_FOLD`` of them is left out of the fit and calibrates
the margin to a probability (Platt scaling). Every whole text is then scored
in Arrow batches against the fixed threshold ``MIN_PROBABILITY``.

Null and empty texts have no words and fail the base rules. Labels that are
null, or whose document is absent, are ignored; with fewer than two classes or
``MIN_ROWS`` usable rows there is no model: the probability is null and the
base rules alone decide. Repeated rows are scored alike. Other columns are
passed through or ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from textlab.llm.hashing import mix, runs_of, word_hashes
from textlab.session import without_summary
from textlab.worker import forget_worker_objects

BUCKETS = 1 << 15
FIT_ROWS = 4000          # labelled rows used at most, whatever the size of the corpus
CALIBRATION_FOLD = 4
FIT_TASKS = 6            # the fit reads at most FIT_ROWS rows, so a few tasks are enough
MIN_ROWS = 20
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MIN_PROBABILITY = 0.2    # documents below this probability of being good are rejected
SCALE = 50.0             # frequencies times this are the features
PIECE_CHARS = 1 << 18
SYMBOLS = "#*$%&|<>"


@dataclass
class QualityModel:
    word: np.ndarray
    char: np.ndarray
    bias: float
    slope: float
    shift: float


def _sums(values, ptr):
    """Sums of values between neighbouring pointers."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[ptr[1:]] - total[ptr[:-1]]


def _ngram_buckets(texts):
    """(word n-gram buckets, their pointer, char n-gram buckets, their pointer, word hashes, word pointer)."""
    h, ptr = word_hashes(texts, lower=False)
    two = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    keep = np.ones(len(two), bool)
    inner = ptr[1:-1]
    keep[inner[(inner > 0) & (inner < len(h))] - 1] = False  # no bigram crosses two texts
    n1 = np.diff(ptr)
    n2 = np.maximum(n1 - 1, 0)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cptr = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return h, ptr, two[keep], np.concatenate([[0], np.cumsum(n2)]), code, cptr


def _char_buckets(code, width):
    """Bucket of the width-gram at each position; the last ones of all read zeros."""
    v = np.zeros(len(code), np.uint32)
    for k in range(width):
        part = code[k:]
        v[: len(part)] = (v[: len(part)] * np.uint32(0x01000193)) ^ part
    v *= np.uint32(0x9E3779B1)
    return (v >> np.uint32(32 - 15)).astype(np.int64) & (BUCKETS - 1)


def _word_buckets(h):
    return (h >> np.uint64(49)).astype(np.int64) & (BUCKETS - 1)


def _char_counts(cptr, width):
    """Number of width-grams per text, and a mask of positions that start one."""
    n = np.maximum(np.diff(cptr) - width + 1, 0)
    ok = np.ones(int(cptr[-1]), bool)
    for k in range(1, width):
        tail = cptr[1:] - k
        ok[tail[tail >= cptr[:-1]]] = False
    return n, ok


def base_columns(texts, h, ptr):
    """The fixed rules' measures per text."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array([len(t.encode()) for t in texts], np.int64)
    bptr = np.concatenate([[0], np.cumsum(sizes)])
    visible = np.zeros(256, np.int8)
    visible[[b for b in range(256) if b & 0xC0 != 0x80 and b not in (9, 10, 11, 12, 13, 32)]] = 1
    symbol = np.zeros(256, np.int8)
    symbol[[ord(c) for c in SYMBOLS]] = 1
    word_chars = _sums(visible[data], bptr)
    n_symbols = _sums(symbol[data], bptr)
    n = len(h)
    window = np.zeros(n, np.uint64)
    for k in range(min(WINDOW, n)):
        window[: n - k] += h[k:] * np.uint64((2 * k + 3) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    n_repeat, n_dup = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        a, b = int(ptr[i]), int(ptr[i + 1])
        m = b - a - WINDOW + 1
        if m > 1:
            w = window[a: a + m]
            s = np.sort(w)
            twice = s[1:][s[1:] == s[:-1]]
            if len(twice):
                covered = np.zeros(b - a + 1, np.int64)
                hit = np.flatnonzero(np.isin(w, twice))
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + WINDOW, -1)
                n_repeat[i] = np.count_nonzero(np.cumsum(covered[:-1]) > 0)
        if "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            n_dup[i] = len(lines) - len(set(lines))
    n_words = np.diff(ptr)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
            "n_repeat_words": n_repeat, "base_failed": failed}


def _margins(texts, model: QualityModel, grams):
    h, ptr, two, tptr, code, cptr = grams
    words = _sums(model.word[_word_buckets(h)], ptr) + _sums(model.word[_word_buckets(two)], tptr)
    n_words = np.diff(ptr) + np.diff(tptr)
    chars, n_chars = np.zeros(len(texts)), np.zeros(len(texts))
    for width in (3, 4):
        n, ok = _char_counts(cptr, width)
        weight = model.char[_char_buckets(code, width)]
        weight[~ok] = 0
        chars += _sums(weight, cptr)
        n_chars += n
    return model.bias + SCALE * (words / np.maximum(n_words, 1) + chars / np.maximum(n_chars, 1))


MEASURES = [StructField("n_words", LongType()), StructField("word_chars", LongType()),
            StructField("n_symbols", LongType()), StructField("n_dup_lines", LongType()),
            StructField("n_repeat_words", LongType()), StructField("base_failed", BooleanType()),
            StructField("probability", DoubleType()), StructField("kept", BooleanType())]
PREFIX = "__quality_"  # of the appended columns, so that no column of the input clashes


def _score_batches(shared, text_col):
    def run(batches):
        forget_worker_objects()
        model = shared.value if shared is not None else None
        for batch in batches:
            column = batch.column(text_col)
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            for a, b in runs_of(sizes, PIECE_CHARS):
                part = [t or "" for t in column.slice(a, b - a).to_pylist()]
                grams = _ngram_buckets(part)
                cols = base_columns(part, grams[0], grams[1])
                good, p = np.ones(b - a, bool), pa.nulls(b - a, pa.float64())
                if model is not None:
                    m = model.slope * _margins(part, model, grams) + model.shift
                    p = 1 / (1 + np.exp(-np.clip(m, -50, 50)))
                    good, p = p >= MIN_PROBABILITY, pa.array(p)
                new = [pa.array(v) for v in cols.values()] + [p, pa.array(~cols["base_failed"] & good)]
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(own.columns + new, names=own.schema.names + [PREFIX + f.name for f in MEASURES])
    return run


FEATURES = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _feature_batches(batches):
    """Label, fold and features, as the sparse vectors of Spark ML are laid out (type 0)."""
    forget_worker_objects()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in runs_of(texts, PIECE_CHARS):
            h, ptr, two, tptr, code, cptr = _ngram_buckets(texts[a:b])
            grams = [(_char_buckets(code, w), *_char_counts(cptr, w)) for w in (3, 4)]
            rows = []
            for i in range(b - a):
                words = np.concatenate([_word_buckets(h[ptr[i]:ptr[i + 1]]), _word_buckets(two[tptr[i]:tptr[i + 1]])])
                s = slice(cptr[i], cptr[i + 1])
                chars = np.concatenate([g[s][ok[s]] for g, _, ok in grams])
                x, nx = np.unique(words, return_counts=True)
                y, ny = np.unique(chars, return_counts=True)
                rows.append((np.concatenate([x, y + BUCKETS]),
                             SCALE * np.concatenate([nx / max(len(words), 1), ny / max(len(chars), 1)])))
            size = np.concatenate([[0], np.cumsum([len(r[0]) for r in rows])]).astype(np.int32)
            index = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([r[0] for r in rows]).astype(np.int32)))
            value = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([r[1] for r in rows])))
            vector = pa.StructArray.from_arrays([pa.array(np.zeros(b - a, np.int8)), pa.array(np.full(b - a, 2 * BUCKETS, np.int32)),
                                                 index, value], fields=list(FEATURES))
            own = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([own.column("label"), own.column("fold"), vector], ["label", "fold", "features"])


def _platt(margin, good, rounds: int = 50):
    """Slope and shift of the calibrated log-odds, by Newton steps with Platt's smoothed targets."""
    pos, neg = good.sum(), (~good).sum()
    t = np.where(good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(margin)), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - t) + 1e-6 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> QualityModel | None:
    """Fit on at most ``rows`` labelled documents (smallest hash of the id)."""
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") > 0).alias("good")).groupBy("doc_id").agg(
        F.min("good").alias("good")).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    # bounded by `rows` ids, so it is broadcast and no text is shuffled
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id").where("text is not null").select(
        F.col("text").cast("string").alias("text"), "good", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(CALIBRATION_FOLD)) == 0).alias("fold"))
    schema = StructType([StructField("label", DoubleType()), StructField("fold", BooleanType()), StructField("features", VectorUDT())])
    data = sample.select("text", F.col("good").cast("double").alias("label"), "fold").mapInArrow(
        _feature_batches, schema).repartition(FIT_TASKS).persist(StorageLevel.DISK_ONLY)
    try:
        seen = {(r["fold"], r["label"]): r["count"] for r in data.groupBy("fold", "label").count().collect()}
        if sum(seen.values()) < MIN_ROWS or not all(seen.get((f, y)) for f in (False, True) for y in (0.0, 1.0)):
            return None
        fit = without_summary(LogisticRegression(maxIter=40, regParam=1e-3, standardization=False).fit(data.where("not fold")))
        held = fit.transform(data.where("fold")).select("label", vector_to_array("rawPrediction")[1].alias("m")).collect()
    finally:
        data.unpersist()
    margin = np.array([r["m"] for r in held])
    slope, shift = _platt(margin, np.array([r["label"] for r in held]) > 0)
    w = fit.coefficients.toArray()
    return QualityModel(w[:BUCKETS].copy(), w[BUCKETS:].copy(), float(fit.intercept), slope, shift)


def with_quality(docs: DataFrame, model: QualityModel | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the measures under ``PREFIX`` names."""
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None  # 2 * BUCKETS weights
    schema = StructType(list(docs.schema.fields) + [StructField(PREFIX + f.name, f.dataType) for f in MEASURES])
    return docs.mapInArrow(_score_batches(shared, text_col), schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: id, measures, probability and verdict."""
    model = fit_quality(docs, labels)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_quality(slim, model).select("doc_id", *(F.col(PREFIX + f.name).alias(f.name) for f in MEASURES))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns only."""
    scored = with_quality(docs, fit_quality(docs, labels))
    return scored.where(F.col(PREFIX + "kept")).select(*(F.col(f"`{c}`") for c in docs.columns))

"""Phrase collocations by marginalising the longest windows.

Every word occurrence has one window: itself and the next words, up to
``LONGEST`` columns ``w1 .. w5`` (numpy shifts of the word column), padded with
nulls behind the end of its piece. Only these windows are counted. Spark's
ROLLUP over the columns sums them into the counts of all shorter prefixes, and
each phrase is a prefix of the windows at its occurrences, so no length is
exploded of its own.

A phrase of ``LEAST`` occurrences has only words and neighbouring pairs of as
many, so a window may be padded from the first rarer word or pair on: counts of
phrases at or above ``LEAST``, and of their parts, stay exact. Words are counted
first; where the frequent ones are at most ``MAX_WORDS`` they are broadcast and
the windows hold their numbers; then the pairs (windows of two) are counted,
and the frequent ones broadcast if at most ``MAX_PAIRS``. Beyond these sizes
the windows hold the words themselves, or are padded by words alone: more rows
move, with the same result.

Scores are exact: products are DECIMALs of up to 38 digits, good for corpora
of up to 9e15 words a language. The best per language come from a partial top-k before the
shuffle, so a language with most of the rows is not gathered.

Null texts are empty; a null language is ``und``, and counts with a language of
that name; repeated rows count each. Words are compared byte by byte after
A-Z are lower-cased. Texts of any length are worked off whole, batch by batch.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.hashing import runs_of
from textlab.session import stage_table

LONGEST = 5
LEAST = 100
TOP = 2000
MAX_WORDS = 1 << 20          # frequent words broadcast at most
MAX_PAIRS = 1 << 22          # frequent pairs broadcast at most
PIECE_CHARS = 1 << 22        # characters of texts worked on at a time
BREAK = b"\xff"              # stands for a piece's end; no byte of UTF-8
# factors of 19 digits or fewer, so that a product keeps all 38
SCORE = "cast(1000 * a as decimal(19,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0)))"

_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = BREAK[0]
_TABLE = bytes(_TABLE)


def pieces_of(text: str) -> list[bytes]:
    """The words of a text in order, with ``BREAK`` between its pieces."""
    return text.encode().translate(_TABLE).replace(BREAK, b" " + BREAK + b" ").split()


def _by_lang(batches):
    """(language, words with breaks between texts) of runs of texts."""
    for batch in batches:
        lang, text = batch.column("lang"), batch.column("text")
        sizes = pc.utf8_length(text).to_pylist()
        for a, b in runs_of(sizes, PIECE_CHARS):
            parts: dict = {}
            for g, t in zip(lang.slice(a, b - a).to_pylist(), text.slice(a, b - a).to_pylist(), strict=True):
                words = parts.setdefault(g, [])
                words += pieces_of(t)
                words.append(BREAK)
            yield from parts.items()


def _word_batches(batches):
    for lang, words in _by_lang(batches):
        counts = Counter(words)
        del counts[BREAK]
        yield pa.RecordBatch.from_arrays([
            pa.array([lang] * len(counts), pa.string()), pa.array([w.decode() for w in counts], pa.string()),
            pa.array(list(counts.values()), pa.int64())], ["lang", "word", "c"])


class _Numbers(dict):
    def __missing__(self, word):
        return -1


def _numbered(batches, shared):
    """(language, number of each word with -1 for breaks and rare words, words by number or None)."""
    if shared is not None:
        tables = {lang: _Numbers(zip(words, range(first, first + len(words)))) for lang, (first, words) in shared.value.items()}
        none = _Numbers()
        for lang, words in _by_lang(batches):
            yield lang, np.fromiter(map(tables.get(lang, none).__getitem__, words), np.int32, len(words)), None
        return
    for lang, words in _by_lang(batches):
        own = {BREAK: -1}
        ids = np.fromiter((own.setdefault(w, len(own) - 1) for w in words), np.int32, len(words))
        yield lang, ids, pa.array([w.decode() for w in list(own)[1:]], pa.string())


def _pair_batches(shared):
    def run(batches):
        for _, ids, _ in _numbered(batches, shared):
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            pair, c = np.unique(ids[:-1][ok].astype(np.int64) << 32 | ids[1:][ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(c.astype(np.int64))], ["pair", "c"])
    return run


def window_columns(ids: np.ndarray, order: int, pairs: np.ndarray | None = None):
    """Lead-window columns at each word: the word, and those behind it as far
    as no break or (with ``pairs``, sorted) pair outside of them comes; -1 pads."""
    start = ids >= 0
    joined = start[:-1] & start[1:]  # a word and its next one belong together
    if pairs is not None and len(joined):
        key = ids[:-1].astype(np.int64) << 32 | ids[1:]
        at = np.minimum(np.searchsorted(pairs, key), max(len(pairs) - 1, 0))
        joined &= (pairs[at] == key) if len(pairs) else False
    columns, open_ = [ids], start
    for k in range(1, order):
        lead, on, n = np.full(len(ids), -1, np.int32), np.zeros(len(ids), bool), max(len(ids) - k, 0)
        on[:n] = open_[:n] & joined[k - 1:]
        lead[:n] = ids[k:]
        lead[~on] = -1
        columns.append(lead)
        open_ = on
    return [c[start] for c in columns]


def _window_batches(shared, frequent, order):
    def run(batches):
        pairs = np.frombuffer(frequent.value, np.int64) if frequent is not None else None
        names = ["lang"] + [f"w{k + 1}" for k in range(order)]
        for lang, ids, words in _numbered(batches, shared):
            columns = [pa.array(c, mask=c < 0) for c in window_columns(ids, order, pairs)]
            if words is not None:
                columns = [words.take(c) for c in columns]
            n = len(columns[0])
            for a in range(0, n, 1 << 18):
                part = [c.slice(a, 1 << 18) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0]), pa.string())] + part, names)
    return run


def _shared_words(words: DataFrame, most: int):
    """Broadcast of {lang: (first number, frequent words)}, or None where they are too many."""
    if words.count() > most:
        return None
    tables: dict = {}
    for r in words.orderBy("lang", "word").collect():
        tables.setdefault(r["lang"], []).append(r["word"].encode())
    first, out = 0, {}
    for lang, own in tables.items():
        out[lang] = (first, own)
        first += len(own)
    return words.sparkSession.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, max_words: int = MAX_WORDS,
                  max_pairs: int = MAX_PAIRS) -> tuple[DataFrame, DataFrame]:
    """``(lang, words, f)`` of all phrases of up to ``longest`` words with f >= ``least`` occurrences
    (``words`` an array), and ``(lang, n)`` of all words."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = stage_table(slim.mapInArrow(_word_batches, "lang string, word string, c bigint").groupBy("lang", "word").agg(
        F.sum("c").alias("c")), "words")
    totals = words.groupBy("lang").agg(F.sum("c").alias("n"))
    frequent = words.where(F.col("c") >= least)
    shared, pairs = _shared_words(frequent, max_words), None
    kind = "string" if shared is None else "int"
    if shared is not None:
        two = stage_table(slim.mapInArrow(_pair_batches(shared), "pair bigint, c bigint").groupBy("pair").agg(
            F.sum("c").alias("c")).where(F.col("c") >= least).select("pair"), "pairs")
        if two.count() <= max_pairs:
            own = np.sort(np.array([r[0] for r in two.collect()], np.int64))
            pairs = spark.sparkContext.broadcast(own.tobytes())
    names = [f"w{k + 1}" for k in range(longest)]
    top = slim.mapInArrow(_window_batches(shared, pairs, longest), "lang string, " + ", ".join(f"{w} {kind}" for w in names))
    top = top.groupBy("lang", *names).agg(F.count(F.lit(1)).alias("c"))
    # grouping_id() has a 1 bit per column summed over, so it tells the prefix's length
    sums = top.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("g")).where(F.col("f") >= least)
    known = F.lit(False)
    for k, w in enumerate(names):
        known = known | ((F.col("g") == (1 << (longest - k - 1)) - 1) & F.col(w).isNotNull())
    kept = sums.where(known).select("lang", F.array_compact(F.array(*names)).alias("words"), "f")
    return stage_table(kept, "phrases") if shared is None else _worded(kept, shared), totals


def _worded(counts: DataFrame, shared) -> DataFrame:
    """Numbers replaced by their words."""
    def run(batches):
        every = [w.decode() for _, own in sorted(shared.value.values(), key=lambda v: v[0]) for w in own]
        words = pa.array(every, pa.string())
        for batch in batches:
            own = batch.column("words")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.ListArray.from_arrays(
                own.offsets, words.take(own.values)), batch.column("f")], ["lang", "words", "f"])
    return stage_table(counts.mapInArrow(run, "lang string, words array<string>, f bigint"), "phrases")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP,
                 max_words: int = MAX_WORDS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, longest, least, max_words, max_pairs)
    phrases = counts.where(F.size("words") > 1)
    # a longer phrase as frequent makes those one word shorter as frequent too, so one step finds all
    inside = phrases.where(F.size("words") > 2).select("lang", "f", F.explode(F.array(
        F.slice("words", F.lit(2), F.size("words") - 1), F.slice("words", F.lit(1), F.size("words") - 1))).alias("words")).distinct()
    # f(longer) never exceeds a, so 100 * f(longer) >= 100 * a says that they are equal
    left = phrases.join(inside, ["lang", "words", "f"], "left_anti")
    cut = left.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = cut.withColumn("first", F.slice("words", F.lit(1), F.col("k"))).withColumn(
        "rest", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    cut = cut.join(counts.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cut = cut.join(counts.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cut = cut.join(totals, "lang").withColumn("score", F.expr(SCORE))
    best = cut.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"), F.first("a").alias("a"),
                                            F.first("n").alias("n"))
    best = best.select("lang", F.array_join("words", " ").alias("phrase"), "a", "m.l", "m.r", "n", "m.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Language-model scoring with a weighted backoff automaton of word bigrams.

States are the empty history (root), the text start and every word of the
training part; an arc of a state is a bigram seen in training, and every state
has a failure arc to the root. Weights are log10 probabilities under a
Dirichlet-smoothed model that sums to one over the vocabulary and one unknown:

    p(w)    = (c(w) + 1) / (N + V + 1)
    p(w|h)  = (c(hw) + MU * p(w)) / (c(h) + MU)
    arc(h,w) = log10 p(w|h),  fail(h) = log10(MU / (c(h) + MU)),  root(w) = log10 p(w)

A text is read once from left to right: from the state of the word before, take
the arc if there is one, else the failure arc and the root's arc.

The automaton grows with the corpus, so it is never gathered in one place.
Documents are dealt into blocks; a block sends its sorted distinct n-gram
hashes with their training counts, cut by hash range into shards; a shard adds
up the counts of all blocks and sends each block the totals of its own n-grams;
the block, joined with these, holds exactly the part of the automaton that its
texts can reach. Everything travels as packed arrays, 7 bytes and a count an
n-gram of a block there, a count back. n-grams are 64-bit hashes.

Null and empty texts have one token, the end. A null id counts as training.
Repeated rows count and score each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.hashing import mix, runs_of, word_hashes

MU = 200.0
BLOCK_TOKENS = 1_500_000     # tokens of a block, on average
FLUSH_TOKENS = 2_000_000     # tokens counted in a task before it sends on
FOLDS, HELD_OUT = 7, 2
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _tokens(texts):
    """(hashes with an END after each text, pointer per text)."""
    h, ptr = word_hashes(texts)
    return np.insert(h, ptr[1:], END), ptr + np.arange(len(ptr))


def _bigrams(tok, ptr):
    """The bigram that ends at each token; the first of a text follows START."""
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[ptr[:-1]] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + tok)


def _distinct_of(h):
    """Sorted distinct values, by one sort."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _packed(h) -> bytes:
    """Hashes of one shard without their highest byte, which the shard implies."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpacked(data: bytes):
    raw = np.zeros((len(data) // 7, 8), np.uint8)
    raw[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return raw.view(np.uint64).ravel()


def _cuts(hashes, shards: int):
    """Pointer per shard into sorted hashes: shards are equal ranges of the upper 32 bits."""
    edge = (np.arange(1, shards, dtype=np.uint64) << np.uint64(32)) // np.uint64(shards)
    return np.concatenate([[0], np.searchsorted(hashes, edge << np.uint64(32)), [len(hashes)]])


def _vocabulary_batches(shards: int):
    """Per task and flush: distinct training words by shard, and token totals."""
    def flush(held, n_train, n_all):
        u = _distinct_of(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        at = _cuts(u, shards)
        rows = [(s, u[at[s]:at[s + 1]].tobytes(), 0, 0) for s in range(shards) if at[s + 1] > at[s]]
        return pd.DataFrame(rows + [(0, b"", n_train, n_all)], columns=["shard", "hashes", "n_train", "n_all"])

    def run(batches):
        held, waiting, n_train, n_all = [], 0, 0, 0
        for pdf in batches:
            texts, train = pdf["text"].tolist(), pdf["train"].to_numpy(bool)
            for a, b in runs_of(texts):
                tok, ptr = _tokens(texts[a:b])
                use = np.repeat(train[a:b], np.diff(ptr))
                held.append(_distinct_of(tok[use]))
                waiting += len(held[-1])
                n_train, n_all = n_train + int(use.sum()), n_all + len(tok)
                if waiting > FLUSH_TOKENS:
                    yield flush(held, n_train, n_all)
                    held, waiting, n_train, n_all = [], 0, 0, 0
        yield flush(held, n_train, n_all)
    return run


def _distinct(pdf):
    parts = [np.frombuffer(b, np.uint64) for b in pdf["hashes"]]
    return pd.DataFrame({"v": [len(_distinct_of(np.concatenate(parts)))],
                         "n_train": [int(pdf["n_train"].sum())], "n_all": [int(pdf["n_all"].sum())]})


def _block_ngrams(pdf):
    """(sorted distinct n-gram hashes of a block, their training counts, tokens, pointer, bigrams)."""
    tok, ptr = _tokens(pdf["text"].tolist())
    two = _bigrams(tok, ptr)
    use = np.repeat(pdf["train"].to_numpy(bool), np.diff(ptr))
    starts = np.full(int(pdf["train"].sum()), START)
    seen = np.sort(np.concatenate([tok[use], two[use], starts]))
    first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]])) if len(seen) else np.zeros(0, np.int64)
    known, n = seen[first], np.diff(np.append(first, len(seen)))
    grams = _distinct_of(np.concatenate([known, tok[~use], two[~use], [START]]))
    count = np.zeros(len(grams), np.int64)
    count[np.searchsorted(grams, known)] = n
    return grams, count, tok, ptr, two


def _ask(shards: int):
    def run(pdf):
        grams, count, *_ = _block_ngrams(pdf)
        at = _cuts(grams, shards)
        block = pdf["block"].iloc[0]
        rows = [(block, s, _packed(grams[at[s]:at[s + 1]]), count[at[s]:at[s + 1]].astype(np.uint32).tobytes())
                for s in range(shards) if at[s + 1] > at[s]]
        return pd.DataFrame(rows, columns=["block", "shard", "hashes", "counts"])
    return run


def _answer(pdf):
    """Totals over all blocks, aligned with what each block sent."""
    grams = [_unpacked(b) for b in pdf["hashes"]]
    flat = np.concatenate(grams)
    part = np.concatenate([np.frombuffer(b, np.uint32) for b in pdf["counts"]]).astype(np.int64)
    order = np.argsort(flat)
    ranked = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    total = np.empty(len(flat), np.int64)
    total[order] = np.repeat(np.add.reduceat(part[order], first), np.diff(np.append(first, len(flat))))
    if len(total) and total.max() < 1 << 32:
        total = total.astype(np.uint32)
    ends = np.cumsum([len(g) for g in grams])
    return pd.DataFrame({"block": pdf["block"], "shard": pdf["shard"],
                         "totals": [t.tobytes() for t in np.split(total, ends[:-1])]})


def _places(grams, wanted):
    """Index of every wanted hash; searched in sorted order, which keeps to the cache."""
    order = np.argsort(wanted)
    out = np.empty(len(wanted), np.int64)
    out[order] = np.searchsorted(grams, wanted[order])
    return out


def _traverse(n_train: int, vocabulary: int, mu: float, shards: int):
    floor = float(n_train + vocabulary + 1)

    def run(pdf, answers):
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("doc_id", "train", "n_tokens", "n_known", "base_score", "score")})
        grams, _, tok, ptr, two = _block_ngrams(pdf)
        at = _cuts(grams, shards)
        total = np.zeros(len(grams), np.int64)
        for s, b in zip(answers["shard"], answers["totals"], strict=True):
            n = at[s + 1] - at[s]
            total[at[s]:at[s + 1]] = np.frombuffer(b, np.uint32 if len(b) == 4 * n else np.int64)
        root = np.log10((total + 1) / floor)                 # weight of the root's arc, by n-gram
        fail = np.log10(mu / (total + mu))                   # weight of the failure arc of a state
        w, arc = _places(grams, tok), _places(grams, two)
        state = np.empty_like(w)                             # the state after a word is that word's
        state[1:] = w[:-1]
        state[ptr[:-1]] = np.searchsorted(grams, START)
        p = (total[w] + 1) / floor
        seen = total[arc] > 0
        step = np.where(seen, np.log10((total[arc] + mu * p) / (total[state] + mu)), fail[state] + root[w])
        add = np.add.reduceat
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "train": pdf["train"], "n_tokens": np.diff(ptr),
            "n_known": add((total[w] > 0).astype(np.int64), ptr[:-1]),
            "base_score": add(root[w], ptr[:-1]), "score": add(step, ptr[:-1])})
    return run


def lm_scores(docs: DataFrame, mu: float = MU) -> DataFrame:
    """Rows ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score)`` for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    # ids travel through pandas as strings: numbers with nulls among them would turn into floats
    slim = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (~F.coalesce(fold == HELD_OUT, F.lit(False))).alias("train"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = slim.select("text", "train").mapInPandas(
        _vocabulary_batches(width), "shard int, hashes binary, n_train bigint, n_all bigint").groupBy("shard").applyInPandas(
        _distinct, "v bigint, n_train bigint, n_all bigint").agg(F.sum("v"), F.sum("n_train"), F.sum("n_all")).first()
    vocabulary, n_train, n_all = (int(x or 0) for x in size)
    blocks = max(1, -(-n_all // BLOCK_TOKENS))
    # dealt by row, so that neither repeated rows nor null ids meet in one block
    dealt = slim.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    shards = 256 * -(-2 * blocks // 256)  # a multiple of 256, so that a shard fixes the highest byte
    asked = dealt.groupBy("block").applyInPandas(_ask(shards), "block bigint, shard int, hashes binary, counts binary")
    answered = asked.groupBy("shard").applyInPandas(_answer, "block bigint, shard int, totals binary")
    out = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(
        _traverse(n_train, vocabulary, mu, shards),
        "doc_id string, train boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")

"""Sub-word vocabulary learnt from distributed word counts, and fixed-length
encoding by longest match with attention masks.

Learning: texts are cut into words, distinct words are counted once, and each is
a row of symbols (its characters; all but the first carry ``##``). A round counts the
neighbouring pairs of symbols, weighted by their words, and merges the most frequent ones
(ties: the pair that is smaller by code point). Several merges are made per round
where their order is certain: a pair joins the round if it shares no symbol
with those before it and occurs more often than every pair that does. (A pair
made by a merge occurs at most as often as the pair it replaces, so none can come in between.)
The result is that of one merge at a time. Only the ``WATCHED`` most frequent pairs of a
round reach the driver; the words stay in a written table, renewed each round.

Encoding: the vocabulary (bounded by its size) is broadcast as a trie; a word is
matched from its start by the longest entry, its rest by the longest ``##`` entry; a
word that cannot be matched, or is longer than ``LONGEST_WORD``, is ``[UNK]``. Texts are cut to fit:
one text at its end, of two texts the longer one token at a time. Every row has
``max_len`` ids and a mask of 1 for its tokens, 0 for padding.

Null texts are empty: ``[CLS] [SEP]`` and padding. Repeated rows count each. Empty tables give
the special tokens, or no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import drop_staged, spread, stage_table

SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
CONTINUED = "##"
WATCHED = 2_000
LONGEST_WORD = 100


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of the lower-cased words and punctuation marks."""
    words = spread(texts.select(text)).select(F.explode(T.tokenize_words(F.lower(F.col(text)))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def merged(symbols: list[str], pairs: dict) -> list[str]:
    """The symbols with every occurrence of a pair joined, from the left."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) in pairs:
            out.append(pairs[symbols[i], symbols[i + 1]])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def joined(a: str, b: str) -> str:
    return a + b.removeprefix(CONTINUED)


def certain_merges(top: list[tuple], floor: int) -> list[tuple[str, str]]:
    """Of (a, b, count) in the order of merging, those that one merge at a
    time would make next. ``floor``: pairs not listed occur at most as often."""
    taken, used = [], set()
    for a, b, n in top:
        if not taken:
            taken, used = [(a, b)], {a, b}
            continue
        # pairs that share a symbol with the merges so far change by them, up to their count
        most = max((c for x, y, c in top if (x, y) not in taken and (x in used or y in used)), default=0)
        if a in used or b in used or n <= most or n <= floor:
            break
        taken.append((a, b))
        used |= {a, b}
    return taken


def with_pair(symbols: pa.ListArray, pairs: dict) -> np.ndarray:
    """Whether each row holds one of the pairs, none of which shares a symbol with another."""
    hit, flat = np.zeros(len(symbols), bool), symbols.flatten()
    if len(flat) < 2:
        return hit
    ends = [pc.fill_null(pc.index_in(flat, pa.array([p[i] for p in pairs], pa.string())), -1 - i).to_numpy(zero_copy_only=False) for i in (0, 1)]
    row = np.repeat(np.arange(len(symbols)), pc.fill_null(pc.list_value_length(symbols), 0).to_numpy(zero_copy_only=False))
    hit[row[:-1][(ends[0][:-1] == ends[1][1:]) & (row[:-1] == row[1:])]] = True
    return hit


def _merge_batches(pairs: dict):
    def run(batches):
        for b in batches:
            hit = with_pair(b.column("symbols"), pairs)
            symbols = [merged(s, pairs) for s in b.column("symbols").filter(pa.array(hit)).to_pylist()]
            yield b.filter(pa.array(~hit))
            yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.list_(pa.string())), b.column("n").filter(pa.array(hit))], ["symbols", "n"])
    return run


def learn_vocabulary(texts: DataFrame, merges: int, text: str = "text", least: int = 2, watched: int = WATCHED) -> tuple[list[str], list[tuple]]:
    """(vocabulary, merges in order): special tokens, characters by code point, then one entry per merge."""
    words = word_counts(texts, text)
    first = F.split("word", "")
    words = words.select(F.transform(F.filter(first, lambda c: c != ""), lambda c, i: F.when(i == 0, c).otherwise(
        F.concat(F.lit(CONTINUED), c))).alias("symbols"), "n")
    words = stage_table(words, "words")
    alphabet = sorted(r[0] for r in words.select(F.explode("symbols")).distinct().collect())  # characters of the texts
    done: list[tuple] = []
    while len(done) < merges:
        pairs = words.select("n", F.explode(F.arrays_zip(F.slice("symbols", 1, F.greatest(F.size("symbols") - 1, F.lit(0))).alias("a"),
                                                         F.slice("symbols", 2, F.greatest(F.size("symbols") - 1, F.lit(0))).alias("b"))).alias("p"))
        counts = pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        top = [tuple(r) for r in counts.orderBy(F.col("n").desc(), "a", "b").limit(watched + 1).collect()]
        if not top:
            break
        floor = top[-1][2] if len(top) > watched else 0
        now = certain_merges(top[:watched], floor)[: merges - len(done)]
        done += now
        new = stage_table(words.mapInArrow(_merge_batches({(a, b): joined(a, b) for a, b in now}), "symbols array<string>, n bigint"), "words")
        drop_staged(words)
        words = new
    drop_staged(words)
    entries = dict.fromkeys([*SPECIAL, *alphabet, *(joined(a, b) for a, b in done)])
    return list(entries), done


def trie_of(vocabulary: list[str]) -> tuple[dict, dict]:
    """Tries of the entries that start a word and of those that go on; "" holds the id."""
    roots: tuple[dict, dict] = ({}, {})
    for i, entry in enumerate(vocabulary):
        if i < len(SPECIAL):
            continue
        go_on = entry.startswith(CONTINUED) and len(entry) > len(CONTINUED)
        node = roots[go_on]
        for c in entry.removeprefix(CONTINUED) if go_on else entry:
            node = node.setdefault(c, {})
        node[""] = i
    return roots


def match_word(word: str, tries) -> list[int]:
    """Ids of a word by longest match."""
    out, at = [], 0
    if len(word) > LONGEST_WORD:
        return [SPECIAL.index("[UNK]")]
    while at < len(word):
        node, end, found = tries[at > 0], at, None
        while end < len(word) and word[end] in node:
            node, end = node[word[end]], end + 1
            if "" in node:
                found = (node[""], end)
        if found is None:
            return [SPECIAL.index("[UNK]")]
        out.append(found[0])
        at = found[1]
    return out


def cut_pair(a: list, b: list | None, room: int) -> tuple[list, list | None]:
    """One text at its end; of two the longer, one token at a time (the second where they are equal)."""
    if b is None:
        return a[:room], None
    na, nb = len(a), len(b)
    while na + nb > room:
        if na > nb:
            na -= 1
        else:
            nb -= 1
    return a[:na], b[:nb]


def encode(df: DataFrame, vocabulary: list[str], key: str = "id", text: str = "text", pair: str | None = None,
           max_len: int = 128) -> DataFrame:
    """(key, input_ids, attention_mask, token_type_ids) of each row, ``max_len`` long."""
    shared = df.sparkSession.sparkContext.broadcast(list(vocabulary))
    special = 2 if pair is None else 3
    if max_len < special:
        raise ValueError(f"max_len {max_len} has no room for {special} special tokens")
    pad, _, start, stop = range(len(SPECIAL))
    # every word has an id or more, and what a text has beyond the room is cut: no more words than that are needed
    columns = ["key"] + [F.slice(T.tokenize_words(F.lower(n)), 1, max_len - special).alias(n) if max_len > special else F.array().cast("array<string>").alias(n)
                         for c, n in ((text, "a"), (pair, "b")) if c]
    texts = spread(df.select(F.col(key).alias("key"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "a"), (pair, "b")) if c)))

    def run(batches):
        tries, known = trie_of(shared.value), {}

        def ids(words):
            out = []
            for w in words or []:
                if w not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[w] = match_word(w, tries)
                out += known[w]
            return out

        for batch in batches:
            n = batch.num_rows
            out = np.full((n, max_len), pad, np.int32)
            mask, kind = np.zeros((n, max_len), np.int32), np.zeros((n, max_len), np.int32)
            a = batch.column("a").to_pylist()
            b = batch.column("b").to_pylist() if pair else [None] * n
            for i in range(n):
                x, y = cut_pair(ids(a[i])[: max_len - special], ids(b[i])[: max_len - special] if pair else None, max_len - special)
                row = [start, *x, stop] + ([*y, stop] if y is not None else [])
                out[i, : len(row)], mask[i, : len(row)] = row, 1
                kind[i, len(x) + 2: len(row)] = 1
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * max_len)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.ListArray.from_arrays(offsets, pa.array(m.ravel())) for m in (out, mask, kind))],
                                             [key, "input_ids", "attention_mask", "token_type_ids"])
    kind = df.schema[key].dataType.simpleString()
    return texts.select(*columns).mapInArrow(run, f"`{key}` {kind}, input_ids array<int>, attention_mask array<int>, token_type_ids array<int>")

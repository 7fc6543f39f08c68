"""Sub-word learning against one merge at a time; encoding against plain rules."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from textlab.functions import text as T
from textlab.operators import subword as W


def plain_learner(counts, merges, least=2):
    words = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in counts}
    done = []
    for _ in range(merges):
        pairs = collections.Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        best = min(((-n, p) for p, n in pairs.items() if n >= least), default=None)
        if best is None:
            break
        (a, b) = best[1]
        done.append((a, b))
        for w, s in words.items():
            out, i = [], 0
            while i < len(s):
                if s[i:i + 2] == [a, b]:
                    out.append(a + b.removeprefix("##"))
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            words[w] = out
    return done


def test_merges_of_the_table_equal_a_plain_learner(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("doc_id % 3 = 0")
    counts = {r["word"]: r["n"] for r in W.word_counts(docs).collect()}
    vocabulary, merges = W.learn_vocabulary(docs, 60)
    assert merges == plain_learner(counts, 60)
    assert vocabulary[:4] == list(W.SPECIAL) and len(set(vocabulary)) == len(vocabulary)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_equal_one_merge_at_a_time(seed):
    """The choice of certain merges, on words full of ties and repeats."""
    rng = random.Random(seed)
    counts = collections.Counter("".join(rng.choices("aab" if seed % 2 else "abcde", k=rng.randint(1, 9))) for _ in range(60))
    words = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in counts}
    done = []
    while len(done) < 40:
        pairs = collections.Counter()
        for w, s in words.items():
            for p in zip(s, s[1:]):
                pairs[p] += counts[w]
        top = sorted(((a, b, n) for (a, b), n in pairs.items() if n >= 2), key=lambda t: (-t[2], t[0], t[1]))
        if not top:
            break
        now = W.certain_merges(top[:8], top[7][2] if len(top) > 8 else 0)[: 40 - len(done)]
        done += now
        words = {w: W.merged(s, {(a, b): W.joined(a, b) for a, b in now}) for w, s in words.items()}
    assert done == plain_learner(counts, 40)


def test_encoding(spark):
    vocabulary = [*W.SPECIAL, "a", "b", "##a", "##b", "ab", "##ab", "aba", ".", "#", "##"]
    tries = W.trie_of(vocabulary)
    names = lambda ids: [vocabulary[i] for i in ids]
    assert names(W.match_word("ababab", tries)) == ["aba", "##b", "##ab"]
    assert names(W.match_word("abx", tries)) == ["[UNK]"] and names(W.match_word("a" * 101, tries)) == ["[UNK]"]
    rows = [(1, "AB aba. zz", "b"), (2, None, None), (3, "", "a a a a a a a a"), (4, "a " * 50, "b " * 3)]
    df = spark.createDataFrame(rows, "id long, text string, other string")
    got = {r["id"]: r for r in W.encode(df, vocabulary, max_len=8).collect()}
    assert names(got[1]["input_ids"]) == ["[CLS]", "ab", "aba", ".", "[UNK]", "[SEP]", "[PAD]", "[PAD]"]
    assert got[1]["attention_mask"] == [1] * 6 + [0] * 2 and names(got[2]["input_ids"])[:3] == ["[CLS]", "[SEP]", "[PAD]"]
    assert names(got[4]["input_ids"]) == ["[CLS]"] + ["a"] * 6 + ["[SEP]"]
    two = {r["id"]: r for r in W.encode(df, vocabulary, pair="other", max_len=10).collect()}
    assert names(two[4]["input_ids"]) == ["[CLS]", "a", "a", "a", "a", "[SEP]", "b", "b", "b", "[SEP]"]
    assert two[4]["token_type_ids"] == [0] * 6 + [1] * 4 and sum(two[3]["attention_mask"]) == 10
    assert sum(two[2]["attention_mask"]) == 3
    with pytest.raises(ValueError):
        W.encode(df, vocabulary, max_len=1)


def test_pair_truncation_takes_the_longer_one():
    for na in range(8):
        for nb in range(8):
            for room in range(12):
                a, b = W.cut_pair(list(range(na)), list(range(nb)), room)
                assert len(a) + len(b) == min(room, na + nb) and (len(a) == na or len(a) >= len(b)) and (len(b) == nb or len(b) >= len(a) - 1)


def test_round_trip_of_known_words(spark):
    """Every word of the learnt texts is matched, and its pieces spell it."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["low lower lowest", "new newer newest", "wide wider!"] * 5)], "id long, text string")
    vocabulary, _ = W.learn_vocabulary(docs, 20)
    words = docs.select(F.explode(T.tokenize_words(F.lower("text"))).alias("w")).distinct()
    for r in words.collect():
        pieces = [vocabulary[i] for i in W.match_word(r["w"], W.trie_of(vocabulary))]
        assert pieces[0] + "".join(p.removeprefix("##") for p in pieces[1:]) == r["w"]
    assert W.learn_vocabulary(docs.limit(0), 5) == (list(W.SPECIAL), [])

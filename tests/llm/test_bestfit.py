"""Best-fit packing against the plain rule and the plain tokenizer."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SF_SMALL
from conftest_data import DOCS, edge_docs
from textlab.llm import bestfit as B
from textlab.llm.queries import QUERIES

PATH = public_tokenizers.path(B.TOKENIZER)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def plain_best_fit(lengths, size):
    """What is left in each bin, by best-fit decreasing piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


def test_fills_are_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(150):
        size = rng.choice([1, 7, 50, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 150))]
        counts = collections.Counter(lengths)
        fills, opened = B.best_fit(counts, size)
        fills, spans, placed = sorted(fills), collections.defaultdict(list), collections.Counter()
        for j, (n, rank, first, _, each, offset) in enumerate(fills):
            upto = fills[j + 1][1] if j + 1 < len(fills) and fills[j + 1][0] == n else counts[n]
            for p in range(rank, upto):
                spans[first + (p - rank) // each].append((offset + (p - rank) % each * n, n))
                placed[n] += 1
        left = []
        for parts in spans.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            left.append(size - at)
        assert placed == counts and len(spans) == opened and sorted(left) == plain_best_fit(lengths, size)


def test_tightest_is_the_first_leaf_in_use():
    rng, bins = random.Random(4), B.OpenBins(100)
    for k in range(200):
        bins.add(rng.randint(1, 100), k, 1)
        n = rng.randint(1, 100)
        assert bins.tightest(n) == min((c for c in bins.bins if c >= n), default=None)
        if bins.tightest(n) and k % 3:
            bins.take(bins.tightest(n), 1)


def test_ids_equal_the_plain_call(plain):
    encoder = B.Encoder(PATH)
    assert encoder.by_chunk
    rng = random.Random(1)
    letters = [chr(c) for c in range(0x250)] + list("Σςσ ́̈ ﬁ日本🎉\x85 İǅ") + list("'stremvld.,") * 20
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|startoftext|>", "It's WE'LL i'Ve 's", "x" * 3000, "é é ½² 12ab", " ", "a\x1cb\xa0c\x85d"]
    texts += [f"a{chr(c)}b S{chr(c)}." for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert encoder.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_long_texts_are_cut_at_white_space(plain, monkeypatch):
    monkeypatch.setattr(B, "SLICE", 64)
    encoder = B.Encoder(PATH)
    for t in ["word after word " * 40, "é" * 300, "ab " * 100 + "x" * 200 + " end", "a" * 64 + " " + "b" * 63 + " ", "a" * 63 + " bc"]:
        assert encoder.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files_run_on_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = B.Encoder(path)
    assert not encoder.by_chunk
    assert encoder.ids("Two  words\n é").tolist() == Tokenizer.from_file(path).encode("Two  words\n é", add_special_tokens=False).ids


def check_pieces(rows, ids, longest):
    """Contract of the rows, given the ids of each (doc_id, text) row."""
    left, docs = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    want = collections.defaultdict(list)
    for doc, own in ids:
        for k, at in enumerate(range(0, len(own), longest)):
            piece = np.array(own[at: at + longest], "<u4")
            want[doc].append((k, at, len(piece), zlib.crc32(piece.tobytes())))
    assert {d: sorted(p) for d, p in docs.items()} == {d: sorted(p) for d, p in want.items()}
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, parts in sequences.items():
        for offset, n in sorted(parts):
            assert offset == left[s]
            left[s] += n
        assert left[s] <= longest
    assert sorted(longest - n for n in left.values()) == plain_best_fit([r["length"] for r in rows], longest)


def test_op12_on_the_table(spark, plain):
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    ids = [(r["doc_id"], plain.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in texts]
    check_pieces(QUERIES["op12_best_fit"][0](spark, SF_SMALL).collect(), ids, 4096)


def test_edges(spark, plain):
    ids = [(d[0], plain.encode(d[1] or "", add_special_tokens=False).ids + [1]) for d in DOCS]
    rows = B.pack_best_fit(edge_docs(spark).repartition(5), longest=64).collect()
    check_pieces(rows, ids, 64)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    assert B.pack_best_fit(edge_docs(spark).limit(0)).collect() == []

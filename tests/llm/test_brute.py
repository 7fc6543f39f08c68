"""Registered queries against brute force on the small tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import pytest

from conftest import SF_SMALL
from textlab.llm.queries import QUERIES

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def rows_of(spark, name):
    return QUERIES[name][0](spark, SF_SMALL).collect()


def test_op1_base(spark, texts):
    rows = rows_of(spark, "op1_quality_rules")
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        w = SPACE_WORD.findall(t)
        windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_op1_held_out_accuracy(spark):
    from textlab.llm.quality import fit_quality, with_quality, PREFIX
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = with_quality(docs, fit_quality(docs, train)).join(rest, "doc_id").select(
        "quality", F.col(PREFIX + "kept").alias("kept"), F.col(PREFIX + "base_failed").alias("failed")).collect()
    good = [r["kept"] for r in got if r["quality"] == 1 and not r["failed"]]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def shingles(t, k):
    w = SPACE_WORD.findall(t.translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def brute_links(sets, num, den):
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            m = len(sets[a] & sets[b])
            if m and m * den >= (len(sets[a]) + len(sets[b]) - m) * num:
                yield a, b


def test_op4(spark, texts):
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    comp = components(sets, brute_links(sets, 85, 100))
    rows = rows_of(spark, "op4_minhash_bbit")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {
        i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def near_copies(spark, n=400):
    """Chains and stars of edited copies around the threshold, whose links go through one another."""
    import random
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    docs = []
    for g in range(4):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(n // 4):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = w  # drift: later copies are far from the first
            docs.append(" ".join(w))
    return {i: t for i, t in enumerate(docs)}


@pytest.mark.parametrize("block", [256, 16])
def test_near_duplicates_of_drifting_groups(spark, monkeypatch, block):
    import textlab.llm.neardup as N
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "HUB_ROUNDS", 1)
    docs = near_copies(spark)
    sets = {i: shingles(t, 3) for i, t in docs.items()}
    comp = components(sets, brute_links(sets, 85, 100))
    got = N.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), 3, (85, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert len(set(comp.values())) > 4


def test_broadcast_and_shuffle_of_ids_agree(spark, monkeypatch):
    import textlab.llm.neardup as N
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    a = sorted(map(tuple, N.near_duplicates(docs).collect()))
    monkeypatch.setattr(N, "BROADCAST_IDS", 0)
    assert sorted(map(tuple, N.near_duplicates(docs).collect())) == a


def test_op2(spark, texts):
    """Same kept lines as exact Jaccard over all pairs of lines."""
    from textlab.llm.lines import MIN_CHARS, SHARE, SHINGLE
    first, sets = {}, {}
    for i in sorted(texts):
        for pos, raw in enumerate(texts[i].split("\n")):
            line = raw.strip(" ").lower()
            if len(line) >= MIN_CHARS and line not in sets:
                sets[line] = {line[j:j + SHINGLE] for j in range(len(line) - SHINGLE + 1)}
    names = {line: n for n, line in enumerate(sets)}
    by_number = {n: sets[line] for line, n in names.items()}
    comp = components(by_number, brute_links(by_number, *SHARE))
    expect = {}
    for i in sorted(texts):
        kept = []
        for raw in texts[i].split("\n"):
            line = raw.strip(" ").lower()
            if line in names:
                c = comp[names[line]]
                if c in first:
                    continue
                first[c] = i
            kept.append(raw)
        expect[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in rows_of(spark, "op2_line_dedup")}
    assert got == expect


def test_op2_shuffled_keys_equal_broadcast_keys(spark):
    from textlab.llm.lines import drop_lines
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, drop_lines(docs, broadcast_keys=0).collect())) == sorted(map(tuple, drop_lines(docs).collect()))


def test_op3(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    digest = {i: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for i, h in pages.items()}
    best = {}
    for i, d in digest.items():
        best[d] = max(i, best.get(d, i))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
           for r in rows_of(spark, "op3_warc_dictionary")}
    assert got == {i: (len((h or "").encode()), digest[i], *(("response", None) if best[digest[i]] == i else ("revisit", best[digest[i]])))
                   for i, h in pages.items()}


def test_op5(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    for r in rows_of(spark, "op5_secret_guess_cost"):
        t = texts[r["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_guess_cost():
    from textlab.llm.secrets import guess_cost, scan_text
    assert guess_cost("password") < 1 < guess_cost("password1987") < guess_cost("xK9#qTz!4vLm")
    assert guess_cost("aaaaaaaaaaaa") < 4 and guess_cost("qwertyuiop") < 4 and guess_cost("19870412") < 6
    assert guess_cost("P4ssw0rd") < 5 and guess_cost("") == 0
    spans, top = scan_text("pwd: xK9#qTz!4vLm and pwd: password")
    assert [k for _, k, _ in spans] == [3] and top > 10
    assert scan_text("login = changeme")[0] == []


def test_op6(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    base = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in rows_of(spark, "op6_license_rare_index"):
        w = word.findall(texts[r["doc_id"]].translate(LOWER))
        at = [(i, label) for p, label in base.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        if "general public license, version 3" in texts[r["doc_id"]].lower():
            assert "gpl-3" in r["labels"].split(",")


def test_op7(spark, texts):
    from textlab.llm.lm import MU
    tokens = {i: SPACE_WORD.findall((t or "").translate(LOWER)) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    one, two, starts = collections.Counter(), collections.Counter(), 0
    for i, t in tokens.items():
        if not held[i]:
            one.update(t)
            two.update(zip(["<s>"] + t[:-1], t))
            starts += 1
    n, v = sum(one.values()), len(one)
    rows = rows_of(spark, "op7_lm_backoff")
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens[r["doc_id"]]
        p = {w: (one.get(w, 0) + 1) / (n + v + 1) for w in t}
        history = {h: starts if h == "<s>" else one.get(h, 0) for h in ["<s>"] + t}
        score = sum(math.log10((two.get((h, w), 0) + MU * p[w]) / (history[h] + MU)) for h, w in zip(["<s>"] + t[:-1], t))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[r["doc_id"]], len(t), sum(w in one for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10(x) for x in map(p.get, t)), rel_tol=1e-9)
        assert math.isclose(r["score"], score, rel_tol=1e-9)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op9(spark):
    docs = [r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    size = {r["doc_id"]: len(SPACE_WORD.findall(r["text"])) for r in docs}
    own = collections.Counter()
    for r in docs:
        own[r["source"]] += size[r["doc_id"]]
    order = sorted(own)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(own.values()))
    while True:  # share again until no target is above its cap
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * own[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * own[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    rows = rows_of(spark, "op9_mix_curriculum")
    source = {r["doc_id"]: r["source"] for r in docs}
    taken = collections.Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], own[s]) and math.isclose(r["target"], target[s])
        assert r["taken"] in [k * r["size"] for k in range(4)] and len(r["positions"]) == r["copies"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] for s in order), {s: (taken[s], target[s]) for s in order}
    assert sorted(map(tuple, rows)) == sorted(map(tuple, rows_of(spark, "op9_mix_curriculum")))


def test_targets_reach_the_cap(spark):
    from textlab.llm.mixing import targets
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(
        [("a", 1000), ("b", 10), ("c", 20), (None, 0)], "source string, source_size bigint")).collect()}
    assert got["b"] == 30 and got["c"] == 60 and math.isclose(got["a"], 940) and got[None] == 0


def test_curriculum_follows_the_schedule(spark):
    """The share of a source's copies before time t is its cumulative demand at t."""
    from pyspark.sql import functions as F
    from textlab.llm.mixing import SLOPES, _allocate, _base, positions
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    slim = _base(docs)
    for r in positions(_allocate(slim, slim)).groupBy("rank", "slope").agg(
            F.sum("size").alias("all"), F.sum(F.when(F.col("t") < 0.5, F.col("size"))).alias("half")).collect():
        s = SLOPES[r["rank"] % 3]
        assert r["slope"] == s and abs(r["half"] / r["all"] - ((1 - s) * 0.5 + s * 0.25)) < 0.2


def test_op10(spark, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    rows = rows_of(spark, "op10_pack_binary")
    for r in rows:
        by[r["doc_id"]].append(r)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["offset"] == 0 and r["doc_tokens"] == len(ids)
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024
            assert r["ids_crc32"] == zlib.crc32(ids[at: at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    ranked = sorted(rows, key=lambda r: r["sequence_id"])
    assert all(a["length"] >= b["length"] for a, b in zip(ranked, ranked[1:]))


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000, "x <|endoftext|> y", " \n\n\t z", "日本 it's 12345", "🎉" * 9, "\r\n \r\n"])
def test_engines_agree(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    from textlab.llm.packing import token_ids
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert token_ids(text, path).tolist() == t.encode(text, add_special_tokens=False).ids


def test_pipeline_stages(spark, texts, tmp_path):
    """Each stage against what it must do to its own input."""
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stage = {}
    for name, f in P.STAGES:
        f(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = stage[name] = spark.read.parquet(str(tmp_path / name))
        if name != P.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"]: r["text"] for r in stage["quality"].collect()}
    verdict = {r["doc_id"]: r["kept"] for r in rows_of(spark, "op1_quality_rules")}
    assert set(kept) == {i for i, ok in verdict.items() if ok} and all(texts[i] == t for i, t in kept.items())
    lines = {r["doc_id"]: r["text"] for r in stage["line_dedup"].collect()}
    assert set(lines) == set(kept)
    sets = {i: shingles(t, 5) for i, t in lines.items()}
    comp = components(sets, brute_links(sets, 80, 100))
    near = {r["doc_id"] for r in stage["near_dedup"].collect()}
    assert near == {i for i in sets if comp[i] == i}
    mixed = collections.Counter(r["doc_id"] for r in stage["mixing"].collect())
    assert set(mixed) <= near and max(mixed.values()) <= 3
    pieces = collections.Counter()
    for r in stage["packing"].collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"])) == r["ids_crc32"]
        pieces[r["doc_id"]] += r["start"] == 0
    assert pieces == mixed


def test_packing_keeps_the_training_order(spark, tmp_path):
    """The order of the mixed rows, over many files, is that of the sequences of each length; every copy lies at its position."""
    from textlab.llm.mixing import _allocate, _base, mix_rows, positions
    from textlab.llm.packing import pack
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mix_rows(docs).write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    assert len({r[0] for r in mixed.select("_metadata.file_name").distinct().collect()}) > 2
    slim = _base(docs)
    want = [r["doc_id"] for r in positions(_allocate(slim, slim)).orderBy("t", "rank", "copy", "order", "doc_id").collect()]
    rows = pack(mixed).orderBy("sequence_id").collect()
    assert [r["sequence_id"] for r in rows] == list(range(len(rows)))
    lengths = collections.defaultdict(list)
    for r in rows:
        if r["length"] < 1024:
            lengths[r["length"]].append(r["doc_id"])
    sizes = {r["doc_id"]: r["doc_tokens"] for r in rows}
    for n, ids in lengths.items():
        assert ids == [i for i in want if sizes[i] & n], n

"""Cases that a cut of the job would lose."""

from conftest import SF_SMALL
from test_brute import brute_links, components


def kept_lines(spark, lines):
    from textlab.llm.lines import drop_lines
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    return [r["doc_id"] for r in drop_lines(docs, counts=True).collect() if not r["n_dropped"]]


def test_op2_one_changed_character(spark):
    line = "we were told that all of the small boats had left port before dawn and that none of them came back"
    chinese = "因为今天的天气非常好所以我们决定一起去公园散步然后在湖边的小店里吃了一顿很丰盛的午饭才慢慢地走回家"
    url = "https://example.org/catalogue/2024/spring/shoes/leather-boots-brown-size-forty-two.html"
    tabbed = "alpha\tbeta\tgamma\tdelta\tepsilon\tzeta\teta\ttheta\tiota\tkappa\tlambda"
    edited = [line.replace("small", "smbll"), chinese[:-1] + "乡", url + "5", tabbed + "s"]
    assert sorted(kept_lines(spark, [line, chinese, url, tabbed, *edited])) == [0, 1, 2, 3]


def test_op2_against_plain_character_shingles(spark):
    from textlab.llm.lines import MIN_CHARS, SHARE, drop_lines
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    sets, first, expect = {}, {}, {}
    for t in texts.values():
        for raw in t.split("\n"):
            line = raw.strip(" ").lower()
            if len(line) >= MIN_CHARS:
                sets[line] = {line[j:j + 5] for j in range(len(line) - 4)}
    names = {line: n for n, line in enumerate(sorted(sets))}
    by_number = {n: sets[line] for line, n in names.items()}
    comp = components(by_number, brute_links(by_number, *SHARE))
    for i in sorted(texts):
        kept = []
        for raw in texts[i].split("\n"):
            n = names.get(raw.strip(" ").lower())
            if n is None or comp[n] not in first:
                kept.append(raw)
                if n is not None:
                    first[comp[n]] = i
        expect[i] = "\n".join(kept)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    assert {r["doc_id"]: r["text"] for r in drop_lines(docs).collect()} == expect


def test_op2_banding_at_the_threshold(spark):
    """Pairs of similarity 0.8 (16 of 20 shingles) miss all bands three times in 1,000, not more."""
    import random
    from textlab.llm.lines import BANDS, _banded
    rng = random.Random(3)
    longer = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=24)) for _ in range(4000)]
    docs = spark.createDataFrame([(0, "\n".join(x for line in longer for x in (line, line[:20])))], "doc_id bigint, text string")
    from pyspark.sql import functions as F
    keys = {r["k"]: {r[f"b{b}"] for b in range(BANDS)} for r in _banded(docs).collect()}
    names = spark.createDataFrame([(a, a[:20]) for a in longer], "a string, b string").select(F.xxhash64("a"), F.xxhash64("b")).collect()
    missed = sum(not keys[a] & keys[b] for a, b in names)
    assert missed <= 24, missed


def test_op9_long_document_across_the_cut(spark):
    """The documents behind a long one fill what it leaves of the remainder."""
    from textlab.llm.mixing import mix_report
    # source a: target a quarter of all words, half of its own; only its one long document may lie across
    rows = [(i, "w " * 50, "a") for i in range(1000)] + [(1000, "w " * 50_000, "a")]
    rows += [(2000 + i, "v " * 500, "b") for i in range(100)]
    got = mix_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for ids in (range(1001), range(2000, 2100)):
        mine = [r for r in got if r["doc_id"] in ids]
        taken, target = sum(r["taken"] for r in mine), mine[0]["target"]
        assert abs(taken - target) <= 0.01 * target, (taken, target)
        assert all(0 <= t <= 1 and len(r["positions"]) == r["copies"] for r in mine for t in r["positions"])


def test_op10_added_tokens_in_a_text():
    """Ids of the plain call."""
    import public_tokenizers
    from tokenizers import Tokenizer
    from textlab.llm.packing import token_ids
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert token_ids("a<|endoftext|>b", path).tolist() == [64, 50256, 65]
    for text in ("x <|endoftext|> y", "<|endoftext|>" * 3, "<|endoftext|", "日本 it's 12345", "a" * 1000):
        assert token_ids(text, path).tolist() == t.encode(text, add_special_tokens=False).ids


def test_op5_long_quoted_values():
    from textlab.llm.secrets import scan_text
    value = "".join(chr(33 + (i * 37 + i * i) % 90) for i in range(400)).replace('"', "x").replace("'", "y")
    for text in (f'auth = "{value[:200]}"', f"credentials: '{value[:129]}'", f"pwd: '{value}'"):
        spans, top = scan_text(text)
        assert [(text[s:e], k) for s, k, e in spans] == [(text[text.index(value[:9]):-1], 3)] and top > 10

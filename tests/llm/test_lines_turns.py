"""Line dedup: settled buckets leave the later turns, and no scratch table outlasts its last reader."""

import glob

from pyspark.sql import functions as F

from textlab.llm import lines as L
from textlab.session import shared_dir


def test_settled_buckets_are_left_out(spark, monkeypatch):
    long = "the quick brown fox jumps over the lazy dog near the old river bank while seven grey geese fly south again "
    near = [long + f"no {i:02d}" for i in range(40)]                      # one group: any hub joins it
    chain = ["abcdefghij klmnopqrst uvwxyz 0123456789 "[i:] + "zyxwvutsrqponmlkjihgfedcba9876543210 !?;:+-*/=%&#@"[:20 + i] for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(near + chain)), "doc_id bigint, text string")
    rest, plain = [], L.stage_table

    def staged(df, what):
        out = plain(df, what)
        if what == "line-rest":
            rest.append({r["k"] for r in out.select("k").distinct().collect()})
        return out

    monkeypatch.setattr(L, "stage_table", staged)
    joined = {r["node"]: r["component"] for r in L.line_components(docs, L.BROADCAST_KEYS).collect()}
    keys = [r["k"] for r in docs.where(F.col("doc_id") < len(near)).select(F.xxhash64(F.trim(F.lower("text"))).alias("k")).collect()]
    assert len({joined[k] for k in keys}) == 1
    assert len(rest) == L.HUB_ROUNDS and not any(set(keys) & r for r in rest)


def test_no_scratch_table_is_left(spark):
    before = set(glob.glob(shared_dir(spark).removeprefix("file:") + "/textlab-line-*"))
    docs = spark.createDataFrame([(i, f"a line of text that comes with number {i}") for i in range(30)], "doc_id bigint, text string")
    L.line_components(docs, L.BROADCAST_KEYS).count()
    left = set(glob.glob(shared_dir(spark).removeprefix("file:") + "/textlab-line-*")) - before
    assert {p.rsplit("/textlab-", 1)[1].rsplit("-", 1)[0] for p in left} == {"line-joined"}


def test_lines_alike_but_no_near_copies_make_no_pairs(spark, monkeypatch):
    """A passage with other words before it: many lines of a bucket, similar to one another at some 0.7."""
    import random
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = letters(200)
    lines = [letters(40) + passage for _ in range(90)]
    lines += [lines[7][:-1] + "?", lines[70][:-1] + "!"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    made, plain = {}, L.stage_table

    def staged(df, what):
        out = plain(df, what)
        if what in ("line-pairs", "line-signed"):
            made[what] = out.count()
        return out

    monkeypatch.setattr(L, "stage_table", staged)
    monkeypatch.setattr(L, "WHOLE", 64)
    joined = {r["node"]: r["component"] for r in L.line_components(docs, L.BROADCAST_KEYS).collect()}
    assert made["line-signed"] > L.WHOLE and made["line-pairs"] < len(lines)  # of the last turn
    key = dict(enumerate(r["k"] for r in docs.orderBy("doc_id").select(F.xxhash64("text").alias("k")).collect()))
    assert len(joined) == 4 and joined[key[7]] == joined[key[90]] != joined[key[70]] == joined[key[91]]


def test_parities_bound_the_similarity(spark):
    """No pair at the threshold is left out, whatever the lengths."""
    import random
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdef 因为", k=n))
    rows = []
    for n in (20, 60, 300, 3000):
        for _ in range(20):
            line = letters(n)
            at = rng.randrange(n)
            rows += [(line, line[:at] + "z" + line[at + 1:]), (line, line + letters(n // 6)), (line, line[n // 5:])]
    sets = lambda x: {x[i:i + 5] for i in range(len(x) - 4)}
    share = [len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for a, b in rows]
    texts = spark.createDataFrame([(2 * i + j, x) for i, r in enumerate(rows) for j, x in enumerate(r)], "k bigint, line string")
    full = L._parities(texts)
    pairs = full.join(L._other(full), F.expr("k % 2 = 0 and k2 = k + 1")).select("k", "n", "n2", L._near().alias("near")).collect()
    assert len(pairs) == len(rows)
    for r in pairs:
        a, b = rows[r["k"] // 2]
        assert (r["n"], r["n2"]) == (len(sets(a)), len(sets(b)))
        assert r["near"] or share[r["k"] // 2] < 0.8
    assert not all(r["near"] for r in pairs)

"""Fuzzy line dedup by MinHash, with built-in functions only.

Lines of at least ``MIN_CHARS`` characters (lower-cased, trimmed) take part;
shorter ones always stay. A line's shingles are the ``SHINGLE`` characters from
every position, spaces and all, cut out of the line's code points in UTF-32 (fixed width). The universe of
shingles is dealt into ``GROUPS`` groups by hash. The signature holds, of each group, the
minimum and the maximum of the shingles' 32-bit hashes under ``SEEDS`` multiplications modulo 2^32,
that is two MinHash values a multiplier (of the line's part in the group: every shingle counts in one group, and pairs at a
similarity have it in the groups on average); ``ROWS`` of them make a band. Lines that share a band are candidates; exact Jaccard similarity of the
full shingle sets confirms them at ``SHARE``; distributed union-find over the
links gives components, and the first line by (doc_id, line number) of each
stays.

Equal lines count once from the start (grouped by hash before any band is
made). A bucket of more than ``WHOLE`` lines is dealt by ten pairs of the values
outside its band: two lines at the threshold agree in none of them four times
in 100,000. Of two lines to be compared, first the signatures are (a
byte of each value): at the threshold 19 of ``ROWS * BANDS`` agree on average, and fewer
than ``AGREE`` once in 10,000 pairs, which are then not compared further. Lines whose signature
is like that of no other line of the bucket leave it before anything else, which are
nearly all, so that the turns below work on few rows and one table of texts.

In a bucket every line is compared with one hub, in ``HUB_ROUNDS``
rounds, only while the two are in different components; what is still apart
then is compared in full. For that, lines that are like none of another component leave. For the
others the size of the shingle set and its parities (``PARITY`` words; a
shingle flips one bit) are counted, which bound the similarity exactly: sets
that differ in d shingles differ in at most d bits. Only pairs that the bounds leave are written and confirmed, so lines
that are alike, yet not near copies, make no rows in pairs.

Null ids come last in the order. Rows equal in id and text are one document
and lose the same lines. Null texts stay null, empty ones empty. Other columns
pass through; an empty table gives an empty result. Lines are identified by
64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.components import components
from textlab.session import drop_staged, release_shuffles, stage_table

MIN_CHARS = 20
SHINGLE = 5
ROWS, BANDS = 3, 8       # a pair at the threshold misses all bands three times in 1,000, one at 0.9 three in 100,000
GROUPS = BANDS // 2      # two bands each
VALUES = ROWS * BANDS // GROUPS
SEEDS = VALUES // 2
SHARE = (80, 100)
WORDS = GROUPS            # of the packed signature, a byte a value
LOW = (1 << 32) - 1
MULTIPLIERS = (1640531527, 1190494759, 2146121005)  # odd: hash * multiplier modulo 2^32 is a permutation; below 2^31: no product overflows
AGREE = 11
WHOLE = 1000             # lines of a bucket compared without dealing it further
PARITY = 16              # 64-bit words
HUB_ROUNDS = 2
OWN = "__line_dedup_"    # of the columns that meet the caller's
BROADCAST_KEYS = 2_000_000  # line hashes (8 bytes) or line numbers to drop that are broadcast; beyond, a shuffle join


WIDE = "encode({line}, 'UTF-32')"  # four bytes a character: a shingle is found without counting from the line's start


def _hashes(line: str):
    """Hashes of the distinct shingles of a line."""
    # an array of one, so that the line is encoded once and not for every shingle
    return F.expr(f"array_distinct(transform(array({WIDE.format(line=line)}), w -> transform(sequence(0, length(w) div 4 - {SHINGLE}), "
                  f"i -> xxhash64(substring(w, 4 * i + 1, {4 * SHINGLE}))))[0])")


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, pos, line) of the lines that take part; ``whole``
    tells texts of one id apart."""
    lines = docs.where("text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("whole"),
        F.posexplode(F.split(F.lower(F.col("text").cast("string")), "\n", -1)).alias("pos", "raw"))
    return lines.select("doc_id", "whole", "pos", F.trim("raw").alias("line")).where(
        F.length("line") >= MIN_CHARS).withColumn("k", F.xxhash64("line"))


def _banded(docs: DataFrame) -> DataFrame:
    """(k, b0, b1, ..., s0, s1, ...): the band keys and the packed signature of every distinct line that takes part.

    A shingle is a row, so shingling, hashing and the minima and maxima run in generated code
    (functions over arrays are interpreted), and it changes the values of its group alone; the minima of
    equal lines combine before the shuffle. A group without shingles of the line has null bands.
    No line is without shingles; "outer" only spares the filter for that, which would cut every line again."""
    wide = _occurrences(docs).select("k", F.expr(WIDE.format(line="line")).alias("wide"))
    shingles = wide.select("k", "wide", F.explode_outer(F.expr(f"sequence(0, length(wide) div 4 - {SHINGLE})")).alias("i")).select(
        "k", F.expr(f"xxhash64(substring(wide, 4 * i + 1, {4 * SHINGLE}))").alias("x")).select(
        "k", F.shiftright("x", 32).bitwiseAND(F.lit(GROUPS - 1)).alias("g"), F.col("x").bitwiseAND(F.lit(LOW)).alias("h"))
    ends = shingles.groupBy("k", "g").agg(*(
        f((F.col("h") * F.lit(MULTIPLIERS[seed])).bitwiseAND(F.lit(LOW))).alias(f"m{2 * seed + j}")
        for seed in range(SEEDS) for j, f in enumerate((F.min, F.max))))
    word = F.lit(0).cast("bigint")
    for at in range(VALUES):
        word = word.bitwiseOR(F.shiftleft(F.xxhash64(f"m{at}").bitwiseAND(F.lit(255)), 8 * at))
    # the values of the group's two bands take turns
    parts = ends.select("k", "g", *(F.xxhash64("g", F.lit(j), *(f"m{j + 2 * r}" for r in range(ROWS))).alias(f"b{j}") for j in range(2)),
                        word.alias("s")).repartition("k")  # narrower than the rows of the next grouping
    of = lambda column, g: F.max(F.when(F.col("g") == g, F.col(column)))
    return parts.groupBy("k").agg(*(of(f"b{b % 2}", b // 2).alias(f"b{b}") for b in range(BANDS)),
                                  *(F.coalesce(of("s", w), F.lit(0)).alias(f"s{w}") for w in range(WORDS)))


def _bucketed(banded: DataFrame) -> DataFrame:
    """(bucket, band, large, k) for every band of every distinct line that shares it with another line; ``large``: with more than ``WHOLE`` lines."""
    dealt = banded.select("k", F.posexplode(F.array(*(f"b{b}" for b in range(BANDS)))).alias("band", "bucket")).where(
        "bucket is not null").repartition("bucket")
    # the same shuffle serves the grouping and the join (a semi join would be moved below it, and shuffle again); it does
    # only while both read the same columns, so the grouping takes k and the band too
    shared = dealt.groupBy("bucket").agg(F.count("k").alias("n"), F.max("band").alias("last")).where("n > 1 and last >= 0").select(
        "bucket", (F.col("n") > WHOLE).alias("large"))
    return dealt.join(shared.hint("shuffle_hash"), "bucket").select("bucket", "band", "large", "k")


def _small(rows: DataFrame, broadcast_keys: int) -> DataFrame:
    """A written table, marked for broadcast if its count allows."""
    return F.broadcast(rows) if rows.limit(broadcast_keys + 1).count() <= broadcast_keys else rows


def _alike(x: str, y: str):
    """Whether the packed signatures in columns x0, x1, ... and y0, y1, ... agree in ``AGREE`` places or more."""
    same = F.lit(0)
    for w in range(WORDS):
        apart = F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}"))
        for at in range(VALUES):
            same = same + (apart.bitwiseAND(F.lit(255 << 8 * at)) == 0).cast("int")
    return same >= AGREE


def _linked(pairs: DataFrame, texts: DataFrame, broadcast_keys: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Only the texts of
    lines in a pair are gathered, not their shingles, which are many times as large."""
    num, den = SHARE
    wanted = stage_table(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "line-keys")
    texts = texts.join(_small(wanted, broadcast_keys), "k", "left_semi")
    both = pairs.join(texts.select(F.col("k").alias("a"), F.col("line").alias("la")), "a").join(
        texts.select(F.col("k").alias("b"), F.col("line").alias("lb")), "b")
    sets = both.select("a", "b", _hashes("la").alias("ha"), _hashes("lb").alias("hb"))
    sized = sets.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("m"), (F.size("ha") + F.size("hb")).alias("t"))
    out = stage_table(sized.where(F.col("m") * den >= (F.col("t") - F.col("m")) * num).select("a", "b"), "line-links")
    drop_staged(wanted)
    return out


def _sign(band: int, row: int):
    """A value's byte in the packed signature."""
    return F.shiftright(f"s{band // 2}", 8 * (band % 2 + 2 * row)).bitwiseAND(F.lit(255))


def _dealt(signed: DataFrame) -> DataFrame:
    """(k, s0, s1, ..., bucket): small buckets as they are; in place of a large one its parts, each the
    lines that also agree in two values outside the band."""
    two = [F.when(F.col("band") != b, F.xxhash64("bucket", F.lit(b), _sign(b, 0), _sign(b, 1))) for b in range(BANDS)]
    two += [F.when(F.expr(f"band div 2 != {g}"), F.xxhash64("bucket", F.lit(BANDS + g), _sign(2 * g, 2), _sign(2 * g + 1, 2)))
            for g in range(GROUPS)]
    # nulls (of the own band) leave as rows: a function with a lambda would keep plans from sharing a shuffle
    parts = F.when(F.col("large"), F.array(*two)).otherwise(F.array("bucket"))
    # the bucket last, as Spark has it after explode: a projection on one side alone would do so too
    return signed.select("k", *(f"s{w}" for w in range(WORDS)), F.explode(parts).alias("bucket")).where("bucket is not null")


def _with_partner(signed: DataFrame) -> DataFrame:
    """The rows of ``_dealt`` whose signature is like that of another line of the bucket. A line of many near
    copies meets one at once, so the search is long only for lines that are like none."""
    dealt = _dealt(signed)
    # no column is renamed, so that one shuffle serves both sides
    return dealt.alias("a").join(dealt.alias("b"), (F.col("a.bucket") == F.col("b.bucket"))
                                 & (F.col("a.k") != F.col("b.k")) & _alike("a.s", "b.s"), "left_semi")


def _other(rows: DataFrame) -> DataFrame:
    """The same rows as the other side of a comparison."""
    names = {"k": "k2", "comp": "comp2", "n": "n2"} | {f"s{w}": f"y{w}" for w in range(WORDS)} | {f"p{w}": f"q{w}" for w in range(PARITY)}
    return rows.select(*(F.col(c).alias(names.get(c, c)) for c in rows.columns))


def _texts(docs: DataFrame, keys: DataFrame, broadcast_keys: int) -> DataFrame:
    """(k, line), once each, of the lines in ``keys``."""
    return _occurrences(docs).select("k", "line").join(_small(keys, broadcast_keys), "k", "left_semi").dropDuplicates(["k"])


def _parities(texts: DataFrame) -> DataFrame:
    """(k, n, p0, p1, ...): the size of a line's shingle set and its parities."""
    one = texts.select("k", F.explode(_hashes("line")).alias("h"))
    bit = F.expr("shiftleft(1L, int(h & 63))")
    return one.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *(
        F.bit_xor(F.when(F.shiftright("h", 6).bitwiseAND(F.lit(PARITY - 1)) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"p{w}")
        for w in range(PARITY)))


def _near():
    """Whether the set sizes and parities leave room for the similarity ``SHARE``: sets of n and n2 shingles
    that have it differ in at most (n + n2) * (den - num) / (den + num)."""
    num, den = SHARE
    flips = F.lit(0)
    for w in range(PARITY):
        flips = flips + F.bit_count(F.col(f"p{w}").bitwiseXOR(F.col(f"q{w}")))
    sizes = (F.col("n") * den >= F.col("n2") * num) & (F.col("n2") * den >= F.col("n") * num)
    return sizes & (flips * (den + num) <= (F.col("n") + F.col("n2")) * (den - num))


def _apart_pairs(rest: DataFrame, texts: DataFrame, broadcast_keys: int) -> DataFrame:
    """(a, b), staged: pairs of lines of a bucket and of different components that may be near copies."""
    spark = rest.sparkSession
    differ = F.col("comp") != F.col("comp2")
    like = stage_table(rest.join(_other(rest).withColumnRenamed("bucket", "bucket2"),
                                 (F.col("bucket") == F.col("bucket2")) & differ & _alike("s", "y"), "left_semi"), "line-like")
    release_shuffles(spark)
    keys = stage_table(like.select("k").distinct(), "line-keys")
    parities = stage_table(_parities(texts.join(_small(keys, broadcast_keys), "k", "left_semi")), "line-parities")
    drop_staged(keys)
    release_shuffles(spark)
    # the signatures have told all they can; the bounds are sharper
    full = like.select("bucket", "k", "comp").join(parities, "k")
    pairs = full.join(_other(full), "bucket").where((F.col("k") < F.col("k2")) & differ & _near())
    pairs = stage_table(pairs.select(F.col("k").alias("a"), F.col("k2").alias("b")).distinct(), "line-pairs")
    drop_staged(like, parities)
    return pairs


def line_components(docs: DataFrame, broadcast_keys: int) -> DataFrame:
    """(node, component) of distinct lines that are near duplicates of others."""
    spark = docs.sparkSession
    words = [f"s{w}" for w in range(WORDS)]
    banded = stage_table(_banded(docs), "line-bands")
    release_shuffles(spark)
    buckets = stage_table(_bucketed(banded), "line-buckets")
    release_shuffles(spark)
    signed = stage_table(buckets.join(banded.select("k", *words), "k"), "line-signed")
    drop_staged(banded, buckets)
    release_shuffles(spark)
    members = stage_table(_with_partner(signed), "line-members")
    drop_staged(signed)
    release_shuffles(spark)
    keys = stage_table(members.select("k").distinct(), "line-keys")
    texts = stage_table(_texts(docs, keys, broadcast_keys), "line-texts")
    drop_staged(keys)
    release_shuffles(spark)
    links, joined = None, None
    for turn in range(HUB_ROUNDS + 1):
        if joined is None:
            at = members.withColumn("comp", F.col("k"))
        else:
            at = members.join(joined, members["k"] == joined["node"], "left").select(
                "bucket", "k", F.coalesce("component", "k").alias("comp"), *words)
        hub = F.struct(F.col("k").alias("k2"), F.col("comp").alias("comp2"), *(F.col(f"s{w}").alias(f"y{w}") for w in range(WORDS)))
        open_ = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(
            hub, F.xxhash64("k", F.lit(turn))).alias("hub")).where("lo < hi")
        rest = at.join(open_.select("bucket", "hub.*"), "bucket")
        if turn:
            # components only grow together: a bucket that is one by now stays one, and is left out of the next turns
            rest, old = stage_table(rest, "line-rest"), members
            members = rest.select("bucket", "k", *words)
            drop_staged(old)
            release_shuffles(spark)
        if turn < HUB_ROUNDS:
            pairs = stage_table(rest.where((F.col("comp") != F.col("comp2")) & _alike("s", "y")).select(
                F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct(), "line-pairs")
        else:
            pairs = _apart_pairs(rest.select("bucket", "k", "comp", *words), texts, broadcast_keys)
            drop_staged(rest)
        release_shuffles(spark)
        new = _linked(pairs, texts, broadcast_keys)
        drop_staged(pairs)
        release_shuffles(spark)
        links = new if links is None else links.union(new)
        joined, old = stage_table(components(links, "a", "b"), "line-joined"), joined
        if old is not None:
            drop_staged(old)
        release_shuffles(spark)
    drop_staged(links, texts)
    return joined


def line_drops(docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, whole, drops): line numbers to drop per document that loses any."""
    label = line_components(docs, broadcast_keys)
    slim = _occurrences(docs).select("doc_id", "whole", "pos", "k")
    # written, as two steps read it
    placed = stage_table(slim.join(label, slim["k"] == label["node"], "left").select(
        "doc_id", "whole", "pos", F.coalesce("component", "k").alias("comp")), "line-placed")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("whole"), F.col("pos"))
    first = placed.groupBy("comp").agg(F.min(place).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lost = placed.join(first.select("comp", "keep"), "comp").where(~place.eqNullSafe(F.col("keep")))
    return lost.groupBy("doc_id", "whole").agg(F.collect_set("pos").alias("drops"))


def drop_lines(docs: DataFrame, counts: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with near-duplicate lines removed from ``text``; its own
    columns only, or with ``n_lines`` and ``n_dropped`` (``counts``)."""
    drops = stage_table(line_drops(docs, broadcast_keys).select(
        F.col("doc_id").alias(OWN + "id"), F.col("whole").alias(OWN + "whole"), F.col("drops").alias(OWN + "drops")), "line-drops")
    total = drops.agg(F.sum(F.size(OWN + "drops"))).first()[0] or 0
    drops = F.broadcast(drops) if total <= broadcast_keys else drops
    joined = docs.join(drops, F.col("doc_id").cast("bigint").eqNullSafe(F.col(OWN + "id")) & (F.xxhash64("text") == F.col(OWN + "whole")), "left")
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    clean = F.when(F.col(OWN + "drops").isNull(), F.col("text")).otherwise(F.array_join(
        F.filter(lines, lambda x, i: ~F.array_contains(F.col(OWN + "drops"), i)), "\n"))
    cols = [clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        cols += [F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
                 F.coalesce(F.size(OWN + "drops"), F.lit(0)).cast("bigint").alias("n_dropped")]
    return joined.select(*cols)

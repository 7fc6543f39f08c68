"""Mixing sources to target weights along a time-varying curriculum, with
built-in functions only.

Targets: sources share the total size by weight; a target stops at ``CAP``
times the source's own size and the excess is shared again by weight, which is
the water level of :func:`targets` in closed form. This table has one row per
source.

Documents: within a source, documents in the order of a hash are laid end to
end; every document is taken ``floor(target / size)`` times, and once more
while the running size is within the remainder; the gap that a document across
its end leaves is laid out again with later documents of at most half of it,
until there are none; the gap then left goes to the document closest to it in
size, ``FILLS`` times. Where the closest documents alone come nearer to the
target, they alone are taken. Running sizes come from sums
over hash bins and a running sum inside a bin, so a source with a third of all
rows is spread over its bins and no window holds more than a bin (rows equal in
id and text lie in one bin).

Curriculum: a source's sampling weight changes over training time t in [0, 1]
linearly by 1 + slope * (2t - 1); its integral, the cumulative demand, is
``target * ((1 - slope) * t + slope * t**2)``. A copy that starts where a share
x of its source's taken words is used up gets the t at which the demand reaches
x, and :func:`mix` sorts all copies by t with a range exchange.

Null texts have size 0; null sources are one source, last in order. A document
of size 0 is taken once if any of its source would be (its words are none).
Repeated rows are laid out one after the other and may differ in copies. Other
columns are passed through by :func:`mix`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import stage_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)           # by the source's rank, repeating
SLOPES = (-0.6, 0.0, 0.6)     # change of the sampling weight over training, by rank, repeating
CAP = 3
BIN_ROWS = 2_000              # rows of a bin, on average
FILLS = 3


def _size(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)`` with ``rank, weight, slope, target``. One row
    per source, so one window over them is small."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("rank", F.row_number().over(every) - 1)
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)),
                                       (F.col("rank") % len(values) + 1).cast("int"))
    w = w.withColumn("weight", pick(WEIGHTS)).withColumn("slope", pick(SLOPES)).withColumn(
        "cap", F.col("source_size").cast("double") * CAP)
    # sources fill up in the order of cap / weight; the level is set by those that do not fill up
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    w = w.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn(
        "total", F.sum("source_size").over(whole).cast("double"))
    w = w.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    # the first source that the level of the rest does not fill sets the level for all
    w = w.withColumn("water", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(
        (F.col("cap") / F.col("weight")).alias("at"), "rank", "level"))).over(whole)["level"])
    return w.select("source", "source_size", "rank", "weight", "slope",
                    F.least("cap", F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"))


def _base(docs: DataFrame, *more) -> DataFrame:
    """Id, source, size and the order within the source, which depends on content only."""
    text = F.col("text").cast("string")
    return docs.select(*more, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       _size(text).alias("size"), F.xxhash64("doc_id", text, F.lit("mix")).alias("order"))


def _allocate(base: DataFrame, slim: DataFrame) -> DataFrame:
    """``base`` with its source's plan, ``start`` (words its source has laid out
    before it), ``copies`` and ``taken``. ``slim`` has the same rows."""
    stats = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(stats.select("source", "source_size")).join(
        stats.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # written, so that joins know its true size and broadcast it only when it is small
    plan = stage_table(plan.withColumn("bins", F.ceil(F.col("n") / BIN_ROWS).cast("bigint")).withColumnRenamed(
        "source", "src").drop("n", "weight"), "targets")

    def binned(rows):
        share = F.col("order").cast("double") / F.lit(2.0 ** 64) + 0.5
        return rows.join(plan, F.col("source").eqNullSafe(F.col("src"))).drop("src").withColumn(
            "bin", F.least((share * F.col("bins")).cast("bigint"), F.col("bins") - 1))

    sums = binned(slim).groupBy("rank", "bin").agg(F.sum("size").alias("bin_size"))
    ahead = Window.partitionBy("rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = stage_table(sums.withColumn("ahead", F.coalesce(F.sum("bin_size").over(ahead), F.lit(0))).select(
        F.col("rank").alias("r2"), F.col("bin").alias("b2"), "ahead"), "bins")
    inside = Window.partitionBy("rank", "bin").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))

    def laid_out(rows):
        at = binned(rows)
        at = at.join(sums, (at["rank"] == F.col("r2")) & (at["bin"] == F.col("b2"))).drop("r2", "b2")
        at = at.withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        at = at.withColumn("whole", F.least(whole.cast("bigint"), F.lit(CAP)))
        return at.withColumn("rest", F.when(F.col("whole") < CAP, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(F.lit(0.0)))

    fits = F.col("start") + F.col("size") <= F.col("rest")
    # what the documents that fit wholly leave of the remainder is laid out again with later documents of at most half of
    # it; where one of these lies across its end, less than half is left, so there are few rounds. What is left then has
    # no document of up to its half and goes to the document closest to it, ``FILLS`` times. ``gaps`` is a row per source
    lines = stage_table(laid_out(slim).select(
        "rank", "bin", "order", "doc_id", "start", "size", "rest", fits.alias("fits")), "laid-out")
    gaps = stage_table(lines.groupBy(F.col("rank").alias("r3")).agg(F.max("rest").alias("all"), (
        F.max("rest") - F.coalesce(F.max(F.when(F.col("fits"), F.col("start") + F.col("size"))), F.lit(0))).alias("gap")), "gaps")
    later = lines.where(~F.col("fits") & (F.col("size") > 0)).drop("rest", "fits")
    here = F.col("all") - F.col("gap")

    def closed(gaps, fills):
        """The fills with the closest documents, and the gaps then left."""
        fills = list(fills)
        for _ in range(FILLS):
            free = later
            for f in fills:
                free = free.join(f.select("rank", "start"), ["rank", "start"], "left_anti")
            off = F.abs(F.col("gap") - F.col("size"))
            best = stage_table(free.join(gaps, F.col("rank") == F.col("r3")).where(off < F.col("gap")).groupBy("rank").agg(
                F.min(F.struct(off.alias("off"), "start", "size", "bin")).alias("m"), F.first(here).alias("fill")), "closest")
            fills.append(best.select("rank", "m.bin", "m.start", "fill"))
            gaps = stage_table(gaps.join(best, F.col("r3") == F.col("rank"), "left").select(
                "r3", "all", (F.col("gap") - F.coalesce("m.size", F.lit(0))).alias("gap")), "gaps")
        return fills, gaps

    few, few_gaps = closed(gaps, [])
    fills, left = [], later
    again = Window.partitionBy("rank", "bin").orderBy("order", "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        small = left.join(gaps, F.col("rank") == F.col("r3")).where(F.col("size") * 2 <= F.col("gap")).drop("r3")
        small = stage_table(small, "small")
        if small.isEmpty():
            break
        sizes = small.groupBy("rank", "bin").agg(F.sum("size").alias("bin_size")).withColumn(
            "ahead", F.coalesce(F.sum("bin_size").over(ahead), F.lit(0))).select(
            F.col("rank").alias("r2"), F.col("bin").alias("b2"), "ahead")
        laid = stage_table(small.join(sizes, (F.col("rank") == F.col("r2")) & (F.col("bin") == F.col("b2"))).withColumn(
            "second", F.col("ahead") + F.coalesce(F.sum("size").over(again), F.lit(0))).withColumn(
            "fits", F.col("second") + F.col("size") <= F.col("gap")), "laid-again")
        fills.append(laid.where("fits").select("rank", "bin", "start", (here + F.col("second")).alias("fill")))
        used = laid.where("fits").groupBy("rank").agg(F.sum("size").alias("used"))
        gaps = stage_table(gaps.join(used, F.col("r3") == F.col("rank"), "left").select(
            "r3", "all", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")), "gaps")
        left = laid.where("not fits").select(*later.columns)
    many, many_gaps = closed(gaps, fills)
    # a source whose small documents are few may come closer without the rounds
    pick = stage_table(few_gaps.select("r3", F.col("gap").alias("few")).join(many_gaps, "r3").select(
        "r3", (F.abs("few") <= F.abs("gap")).alias("by_few")), "pick")
    filled = None
    for by_few, part in [(True, f) for f in few] + [(False, f) for f in many]:
        part = part.join(F.broadcast(pick.where(F.col("by_few") == by_few)), F.col("rank") == F.col("r3")).drop("r3", "by_few")
        filled = part if filled is None else filled.union(part)
    # by bin, so that no map holds more than a bin's documents
    filled = stage_table(filled.groupBy(F.col("rank").alias("r3"), F.col("bin").alias("b3")).agg(
        F.map_from_entries(F.collect_list(F.struct("start", "fill"))).alias("fills")), "filled")
    placed = laid_out(base)
    placed = placed.join(filled, (F.col("rank") == F.col("r3")) & (F.col("bin") == F.col("b3")), "left").withColumn(
        "fill", F.when(F.col("size") > 0, F.try_element_at("fills", F.col("start")))).drop("r3", "b3", "fills")
    more = (fits | F.col("fill").isNotNull()) & (F.col("source_size") > 0) & (F.col("rest") > 0)
    placed = placed.withColumn("copies", F.col("whole") + more.cast("bigint"))
    return placed.withColumn("taken", F.col("copies") * F.col("size"))


def position_of(copy):
    """Training position of a copy: the time at which its source's cumulative
    demand reaches the share of the target that lies before the copy. Copies of
    one pass over the source follow those of the pass before."""
    # the last copy of a document that fills the gap lies where it fills it
    ahead = (copy - 1) * F.col("source_size") + F.when(
        copy > F.col("whole"), F.coalesce("fill", "start")).otherwise(F.col("start"))
    # what lies beyond the target goes anywhere, by its hash
    x = F.when(ahead < F.col("target"), ahead / F.col("target")).otherwise(
        F.col("order").cast("double") / F.lit(2.0 ** 64) + 0.5)
    s = F.col("slope")
    t = F.when(s == 0, x).otherwise(
        (F.sqrt((1 - s) * (1 - s) + 4 * s * x) - (1 - s)) / F.when(s == 0, F.lit(1.0)).otherwise(2 * s))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))


def positions(placed: DataFrame) -> DataFrame:
    """One row per copy taken, with its training position ``t`` in [0, 1]."""
    copy = placed.where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return copy.withColumn("t", position_of(F.col("copy")))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mixed corpus: the rows of ``docs`` with their own columns, a row per
    copy, range-sorted by training position."""
    slim = stage_table(_base(docs), "sizes")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    out = positions(_allocate(_base(docs, row), slim)).orderBy("t", "rank", "copy", "order", "doc_id")
    return out.select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, the words and
    copies taken, and the training positions of its copies."""
    slim = stage_table(_base(docs), "sizes")
    placed = _allocate(slim, slim)
    at = F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest("copies", F.lit(1).cast("bigint"))), position_of)
    return placed.select("doc_id", "size", "source_size", "target", "taken", "copies", F.when(
        F.col("copies") > 0, at).otherwise(F.array().cast("array<double>")).alias("positions"))

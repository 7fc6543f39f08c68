"""k-means for many cluster counts at once: every Lloyd step of all counts is
one pass over the vectors.

A row carries, per count, its cluster, an upper bound of the distance to its
centre and a lower bound of the distance to any other. When centres move, the bounds move
with them (triangle inequality); distances to all centres are computed only for
rows whose bounds overlap, and only for counts that still change. A pass writes the
rows with their new bounds and, per task, the sums of the rows of each cluster;
the sums are added up by groups of clusters, and the centres, ``sum(ks) * d``
numbers, are broadcast under ``MAX_CENTRE_VALUES``.

The start of count k are the k rows that come first by a hash of (seed, key),
so the starts of larger counts hold those of smaller ones. Ties go to the
smaller cluster number. A cluster without rows is put on the row that lies farthest
from its centre (ties: smaller key; the next row for the next such cluster), if that
distance is above 0. A count is done when no row changes its cluster, or after
``max_iter`` passes. With fewer rows than k there are as many clusters as rows.

Rows with null vectors are left out; keys are taken as unique. An empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_uniform
from ..session import drop_path, scratch_path, stage_table

MAX_CENTRE_VALUES = 32_000_000   # numbers of all centres together that are broadcast
GROUP = 64                       # clusters whose sums one group adds up
ROWS_AT_A_TIME = 512
TASK_ROWS = 50_000               # rows of a task, at most on average
SLACK = 1e-9                     # relative rounding that a bound allows for

ROW = "task int, which int, cluster int, n bigint, moved bigint, total array<double>"
STATE = "x binary, s binary"     # a row's vector; clusters, upper and lower bounds under all counts. Bytes, as a number in an array costs the JVM a call
PART = {"task": pa.int32(), "which": pa.int32(), "cluster": pa.int32(), "part": pa.binary()}  # sums of a task's rows: ``GROUP`` clusters a row


def _matrix(column, kind=np.float64) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def _lists(m: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel().astype(kind)))


def _bytes(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.itemsize * m.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(m))])


def _from_bytes(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _pack_state(a: np.ndarray, u: np.ndarray, low: np.ndarray) -> pa.Array:
    raw = [np.ascontiguousarray(m.T, kind).view(np.uint8) for m, kind in ((a, np.int32), (u, np.float64), (low, np.float64))]
    return _bytes(np.concatenate(raw, axis=1))


def _state(column, counts: int):
    """Clusters and bounds of :func:`_pack_state`, a line per count."""
    raw = _from_bytes(column, np.uint8)
    cut = [0, 4 * counts, 12 * counts, 20 * counts]
    return [np.ascontiguousarray(raw[:, i:j]).view(kind).T.copy() for i, j, kind in zip(cut, cut[1:], (np.int32, np.float64, np.float64))]


def nearest_two(x: np.ndarray, c: np.ndarray):
    """Per row the nearest centre (ties: smaller number), its distance, and a
    lower bound of the distance to all others. A matrix product in single precision, of rows and
    centres moved to the centres' mean and scaled, leaves the centres that may be nearest within its error (``(d + 8) * 2^-23`` of the
    square of the norms' sum, twice what its products, sums and rounded inputs can be off); of several the nearest is found in double precision."""
    best, first, second = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
    if not len(x):
        return best, first, second
    k, d = c.shape
    mean = c.mean(axis=0)
    off = c - mean
    most = np.sqrt(np.einsum("ij,ij->i", off, off).max())
    at_once = max(1, min(ROWS_AT_A_TIME, len(x)))
    held, ones = np.empty((at_once, k), np.float32), np.ones((at_once, d + 1), np.float32)
    for at in range(0, len(x), at_once):
        part = x[at: at + at_once]
        n = len(part)
        rows, moved = np.arange(n), part - mean
        norm = np.einsum("ij,ij->i", moved, moved)
        scale = max(most, np.sqrt(norm.max())) or 1.0
        error = (d + 8) * 2.0 ** -23 * (np.sqrt(norm) + most) ** 2
        ones[:n, :d] = moved / scale
        weights = np.concatenate([off.T * (-2.0 / scale), (np.einsum("ij,ij->i", off, off) / scale ** 2)[None, :]]).astype(np.float32)
        d2 = np.matmul(ones[:n], weights, out=held[:n])   # less the row's own square, in units of scale^2
        own = d2.argmin(axis=1)
        low = d2[rows, own].astype(np.float64)
        d2[rows, own] = np.inf
        other = d2.min(axis=1).astype(np.float64)
        room = 2.0 * error / scale ** 2
        tied = np.flatnonzero(~(other - low > room))
        d2[tied, own[tied]] = low[tied]
        left = d2[tied] <= (low + room)[tied][:, None]  # candidates of these rows, the nearest so far, its distance
        nearest = np.full(len(tied), np.inf)
        while left.any():                         # one more candidate of every such row, smaller numbers first
            which, some = np.flatnonzero(left.any(axis=1)), left.argmax(axis=1)
            some = some[which]
            left[which, some] = False
            apart = ((c[some] - part[tied[which]]) ** 2).sum(axis=1)
            better = apart < nearest[which]
            own[tied[which[better]]], nearest[which[better]] = some[better], apart[better]
        s = slice(at, at + n)
        best[s], first[s] = own, np.sqrt(((part - c[own]) ** 2).sum(axis=1))
        if k > 1:
            other[tied] = low[tied]               # whichever of them is the nearest, the others are no nearer than this
            second[s] = np.sqrt(np.maximum(other * scale ** 2 + norm - error, 0.0))
    return best, first, second


def _step(shared, first: bool, kind):
    """One Lloyd pass. ``shared``: centres, how far each moved, half the distance to the nearest other centre, and whether the count is open;
    ``kind``: of the vectors' numbers."""
    def run(batches):
        task = TaskContext.get().partitionId()
        centres, drift, gap, open_ = shared.value
        total = [np.zeros_like(c) for c in centres]
        size = [np.zeros(len(c), np.int64) for c in centres]
        moved = np.zeros(len(centres), np.int64)
        slip = [others_drift(d) for d in drift]
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = _matrix(b.column("x")) if first else _from_bytes(b.column("x"), kind).astype(np.float64)
            if first:
                a, u, low = np.full((len(centres), n), -1, np.int32), np.zeros((len(centres), n)), np.zeros((len(centres), n))
            else:
                a, u, low = _state(b.column("s"), len(centres))
            for j, c in enumerate(centres):
                if not first and not open_[j]:
                    continue
                if first:
                    again = np.arange(n)
                else:
                    u[j] += drift[j][a[j]] * (1 + SLACK)
                    low[j] -= slip[j][a[j]] * (1 + SLACK)
                    again = np.flatnonzero(u[j] * (1 + SLACK) >= np.maximum(low[j], gap[j][a[j]]))
                    # the true distance to the own centre may be enough
                    u[j, again] = np.sqrt(((x[again] - c[a[j, again]]) ** 2).sum(axis=1))
                    again = again[u[j, again] * (1 + SLACK) >= np.maximum(low[j, again], gap[j][a[j, again]])]
                if len(again):
                    best, u[j, again], low[j, again] = nearest_two(x[again], c)
                    moved[j] += int((best != a[j, again]).sum())
                    a[j, again] = best
                used, n_used, sums = sums_by(a[j], x)
                total[j][used] += sums
                size[j][used] += n_used
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("target"), _bytes(x.astype(kind)), _pack_state(a, u, low),
                                              *(pa.nulls(n, t) for t in PART.values())], ["id", "target", "x", "s", *PART])
        for j, c in enumerate(centres):
            used = np.flatnonzero(size[j])
            if len(used) and (first or open_[j]):
                yield _parts(_sums(task, j, used, size[j][used], np.where(np.arange(len(used)) == 0, moved[j], 0), total[j][used]))
    return run


def _parts(sums: pa.RecordBatch) -> pa.RecordBatch:
    """A count's sums, a row per group of clusters."""
    group = sums.column("cluster").to_numpy() // GROUP
    cut = [*np.unique(group, return_index=True)[1], len(group)]
    rows = [{"task": sums.column("task")[i].as_py(), "which": sums.column("which")[i].as_py(), "cluster": int(group[i]) * GROUP,
             "part": sums.slice(i, j - i).serialize().to_pybytes()} for i, j in zip(cut, cut[1:])]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(PART.items())))


def _add_parts(table: pa.Table) -> pa.Table:
    schema = pa.schema(list(KINDS.items()))
    return _add_up(pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), schema) for p in table.column("part").to_pylist()], schema))


def others_drift(drift: np.ndarray) -> np.ndarray:
    """Per centre how far any other one moved at most."""
    if len(drift) < 2:
        return np.zeros(len(drift))
    top = drift.argmax()
    out = np.full(len(drift), drift[top])
    out[top] = np.delete(drift, top).max()
    return out


def sums_by(group: np.ndarray, x: np.ndarray):
    """The groups that occur, in order, with their numbers of rows and sums of rows (added in their order)."""
    order = np.argsort(group, kind="stable")
    used, at, n = np.unique(group[order], return_index=True, return_counts=True)
    return used, n, np.add.reduceat(x[order], at, axis=0) if len(at) else x[:0]


KINDS = {"task": pa.int32(), "which": pa.int32(), "cluster": pa.int32(), "n": pa.int64(), "moved": pa.int64(),
         "total": pa.list_(pa.float64())}


def _sums(task, j, used, size, moved, total):
    k = len(used)
    values = [pa.array(np.full(k, task, np.int32)), pa.array(np.full(k, j, np.int32)), pa.array(used.astype(np.int32)),
              pa.array(size), pa.array(moved), _lists(total, np.float64)]
    return pa.RecordBatch.from_arrays(values, list(KINDS))


def _add_up(table: pa.Table) -> pa.Table:
    """Sums of a group of clusters over the tasks, in their order."""
    table = table.sort_by([("cluster", "ascending"), ("task", "ascending")]).combine_chunks()
    cluster = table.column("cluster").to_numpy()
    used, at = np.unique(cluster, return_index=True)
    _, _, total = sums_by(cluster, _matrix(table.column("total").combine_chunks()))
    n, moved = (np.add.reduceat(table.column(c).to_numpy(), at) for c in ("n", "moved"))
    first = [table.column(c).to_numpy()[at] for c in ("task", "which")]
    return pa.Table.from_arrays([*map(pa.array, first), pa.array(used), pa.array(n), pa.array(moved), _lists(total, np.float64)],
                                schema=pa.schema(list(KINDS.items())))


def _half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centre to its nearest other one."""
    return np.zeros(len(c)) + np.inf if len(c) < 2 else nearest_two(c, c)[2] / 2


def lloyd_sweep(points: DataFrame, ks: list[int], seed: int = 0, key: str = "id", vec: str = "vec", target: str = "target",
                max_iter: int = 300) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """All counts of ``ks``: rows (id, target, a: the cluster under each count), the centres and the passes of each count."""
    spark = points.sparkSession
    # dealt out, as all passes go over these files: a file of one row group would be one task's
    tasks = max(spark.sparkContext.defaultParallelism, points.count() // TASK_ROWS)
    rows = stage_table(points.where(F.col(vec).isNotNull()).select(
        F.col(key).alias("id"), F.col(target).cast("int").alias("target"), F.col(vec).cast("array<double>").alias("x")).repartition(tasks), "points")
    most = max(ks, default=0)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if sum(ks) * d > MAX_CENTRE_VALUES:
        raise ValueError(f"centres of {sum(ks)} clusters in {d} dimensions are too many to broadcast; sweep fewer counts at a time")
    start = [r["x"] for r in rows.orderBy(md5_uniform(f"{seed}:start", "id"), "id").limit(most).collect()]
    centres = [np.array(start[:k]) for k in ks if start]
    if not centres:
        return rows.select("id", "target", F.array().cast("array<int>").alias("a")), [], []
    idtype = rows.schema["id"].dataType.simpleString()
    kind = np.float32 if points.schema[vec].dataType.simpleString() == "array<float>" else np.float64
    schema = f"id {idtype}, target int, {STATE}, task int, which int, cluster int, part binary"
    state, path, passes, open_ = rows, None, [0] * len(ks), [True] * len(ks)
    drift, turn = [np.zeros(len(c)) for c in centres], 0
    while any(open_) and turn < max_iter:
        shared = spark.sparkContext.broadcast((centres, drift, [_half_gaps(c) for c in centres], open_))
        new = scratch_path(spark, "sweep")
        state.mapInArrow(_rows_of(_step(shared, turn == 0, kind), [part.split()[0] for part in schema.split(", ")]), schema).write.parquet(new)
        both = spark.read.schema(schema).parquet(new)
        sums = both.where("which is not null").select(*PART).groupBy("which", "cluster").applyInArrow(_add_parts, ROW)
        found = sums.toArrow().combine_chunks()  # a row per cluster
        which, cluster, n, moved = (found.column(c).to_numpy() for c in ("which", "cluster", "n", "moved"))
        total = found.column("total").combine_chunks()
        total = _matrix(total)
        state = both.where("which is null").drop(*PART)
        if path:
            drop_path(spark, path)
        path, turn = new, turn + 1
        for j, c in enumerate(centres):
            if not open_[j]:
                drift[j] = np.zeros(len(c))
                continue
            passes[j] += 1
            mine = which == j
            nxt, full = c.copy(), np.zeros(len(c), bool)
            if mine.any():
                nxt[cluster[mine]] = total[mine] / n[mine, None]
                full[cluster[mine]] = True
            empty = np.flatnonzero(~full)
            seeded = False
            if len(empty):
                for e, x in zip(empty, _farthest(state, j, len(ks), c, len(empty), kind)):
                    nxt[e], seeded = x, True
            open_[j] = seeded or moved[mine].sum() > 0
            drift[j] = np.sqrt(((nxt - c) ** 2).sum(axis=1))
            centres[j] = nxt
        shared.unpersist()
    return _clusters(state, len(ks)), centres, passes


def _clusters(state: DataFrame, counts: int) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                a = _state(b.column("s"), counts)[0]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("target"), _lists(a.T, np.int32)], ["id", "target", "a"])
    return state.select("id", "target", "s").mapInArrow(run, f"id {state.schema['id'].dataType.simpleString()}, target int, a array<int>")


def _farthest(state: DataFrame, j: int, counts: int, c: np.ndarray, n: int, kind) -> list[np.ndarray]:
    """The n rows that lie farthest from the centre they were assigned to."""
    shared = state.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, a = _from_bytes(b.column("x"), kind).astype(np.float64), _state(b.column("s"), counts)[0]
                off = np.sqrt(((x - shared.value[a[j]]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(off)], ["id", "x", "off"])
    far = state.select("id", "x", "s").mapInArrow(run, f"id {state.schema['id'].dataType.simpleString()}, x binary, off double")
    return [np.frombuffer(r["x"], kind).astype(np.float64) for r in far.where("off > 0").orderBy(F.col("off").desc(), "id").limit(n).collect()]


def _rows_of(step, names):
    """A pass's two kinds of rows under one schema."""
    def run(batches):
        empty: dict = {}
        for b in step(batches):
            if "id" in b.schema.names:
                empty = {f.name: f.type for f in b.schema}
                yield b
            else:
                yield pa.RecordBatch.from_arrays([b.column(n) if n in PART else pa.nulls(b.num_rows, empty[n]) for n in names], names)
    return run


def sweep_purity(assigned: DataFrame, ks: list[int]) -> DataFrame:
    """(num_clusters, mean_purity, is_best) of the rows of :func:`lloyd_sweep`; the first best count wins. Only
    clusters with rows of a known target count."""
    each = assigned.where("target is not null").select("target", F.posexplode("a").alias("j", "cluster"))
    sizes = each.groupBy("j", "cluster").agg(F.count_if(F.col("target") == 0).alias("n0"), F.count_if(F.col("target") == 1).alias("n1"))
    mean = sizes.groupBy("j").agg(F.avg(F.greatest("n0", "n1") / (F.col("n0") + F.col("n1"))).alias("mean_purity"))
    counts = assigned.sparkSession.createDataFrame(list(enumerate(ks)), "j int, num_clusters int")
    best = F.max_by("j", F.struct("mean_purity", -F.col("j"))).over(Window.partitionBy(F.lit(1)))  # a row per count
    return counts.join(mean, "j").select("num_clusters", "mean_purity", (F.col("j") == best).alias("is_best"))


def sweep_counts(k0: int) -> list[int]:
    """The reference's counts around k0."""
    return [k for k in range(k0 // 3, 3 * k0, max(1, k0 // 6)) if k >= 1]


def cluster_count_sweep_lloyd(points: DataFrame, k0: int, seed: int = 0, key: str = "id", vec: str = "vec", target: str = "target",
                              max_iter: int = 300) -> DataFrame:
    """M8 in one scan a step: mean purity for k in range(k0 // 3, 3 * k0, k0 // 6) and the best k."""
    ks = sweep_counts(k0)
    assigned, _, _ = lloyd_sweep(points, ks, seed, key, vec, target, max_iter)
    return sweep_purity(assigned, ks)

"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length one, so cosine >= c is Euclidean distance <= eps = sqrt(2 - 2c). They are turned to the
principal axes, sorted by the eps-grid cells of the leading axes, and cut into sequence intervals with a bounding box.
The sequence is joined with itself part by part, where the parts are read: intervals whose boxes are further apart than eps
are skipped, so that vectors are written once, whatever the number of pairs. Pairs of intervals are joined by halving both, again
skipping distant halves. In a leaf a bound from the leading axes and the length of the rest (Cauchy-Schwarz)
leaves few pairs, and those are decided by the dot product in double precision.

Exact copies are one vector with a count, and a tile returns link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, join_counted, stage_table, unite

INTERVAL = 8192  # vectors in a sequence interval, at most
INTERVAL_BYTES = 16 << 20  # bytes of vectors in one, at most; both bound a task's memory
PARTS = 16  # parts of the sequence, at least, if it has as many intervals; tasks are pairs of parts
PART_BYTES = 64 << 20  # bytes of vectors in a part, about
LEAF = 512
HEAD = 16  # principal axes used for boxes and for the bound
CELLS = 4  # of those, axes that the grid order uses
PCA_SAMPLE = 2048  # vectors that the axes are fitted on; any axes give the same result


def _unit(batches):
    for b in batches:
        ids, vecs = b.column(0), b.column(1)
        dims, keys, units = [], [], []
        values = vecs.flatten().to_numpy(zero_copy_only=False).astype("f8")
        ends = np.cumsum(np.nan_to_num(pa.compute.list_value_length(vecs).to_numpy(zero_copy_only=False))).astype("i8")
        for start, end in zip(np.concatenate([[0], ends[:-1]]), ends):
            v = values[start:end]  # a null component is nan here
            top = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
            if top > 0:
                v = v / top
                raw = (v / np.sqrt(v @ v) + 0.0).tobytes()
                dims.append(len(v)), keys.append(hashlib.md5(raw).digest()), units.append(raw)
            else:
                dims.append(None), keys.append(None), units.append(None)
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
            ["vec_id", "dim", "key", "unit"],
        )


def _rows(column, dim):
    return np.frombuffer(b"".join(column.to_pylist()), "f8").reshape(-1, dim)


def _cells(axes, eps):
    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            cells = np.zeros((len(dims), CELLS), "i4")
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                head = _rows(b.column("unit").take(pa.array(at)), d) @ axes[int(d)][:, :CELLS]
                cells[at, : head.shape[1]] = np.floor(head / eps)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(cells[:, i]) for i in range(CELLS))], [*b.schema.names, *(f"c{i}" for i in range(CELLS))]
            )

    return run


def interval_size(dim: int) -> int:
    return max(1, min(INTERVAL, INTERVAL_BYTES // (8 * dim)))


def _intervals(axes, most):
    """Packs consecutive vectors of one length, in grid order, and boxes them. Axes that a short vector lacks are 0."""

    def pack(part, seq, rows):
        dim = rows[0][0]
        unit = np.frombuffer(b"".join(r[3] for r in rows), "f8").reshape(-1, dim)
        head = np.zeros((len(rows), HEAD))
        head[:, : min(dim, HEAD)] = unit @ axes[dim][:, :HEAD]
        return {
            "part": part, "iid": (part << 32) + seq, "dim": dim, "lo": head.min(0).tolist(), "hi": head.max(0).tolist(),
            "keys": b"".join(r[1] for r in rows), "reps": np.array([r[2] for r in rows], "i8").tobytes(),
            "counts": np.array([r[4] for r in rows], "i8").tobytes(), "units": unit.tobytes(),
        }

    def run(batches):
        part, seq, rows = TaskContext.get().partitionId(), 0, []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("dim", "key", "rep", "unit", "n"))):
                if rows and (rows[0][0] != r[0] or len(rows) == most[r[0]]):
                    yield pa.RecordBatch.from_pylist([pack(part, seq, rows)], INTERVAL_ARROW)
                    seq, rows = seq + 1, []
                rows.append(r)
        if rows:
            yield pa.RecordBatch.from_pylist([pack(part, seq, rows)], INTERVAL_ARROW)

    return run


INTERVAL_ARROW = pa.schema([("part", pa.int32()), ("iid", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("keys", pa.binary()), ("reps", pa.binary()), ("counts", pa.binary()), ("units", pa.binary())])
INTERVAL_SQL = "part int, iid long, dim int, lo array<double>, hi array<double>, keys binary, reps binary, counts binary, units binary"


def _tiles(axes, least):
    eps2 = 2 - 2 * least + 1e-9

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield tile(r)

    def tile(r):
        dim, same = r["dim"], r["a"] == r["b"]
        sides = "l" if same else "lr"
        unit = np.concatenate([np.frombuffer(r[f"{s}_units"], "f8") for s in sides]).reshape(-1, dim)
        count, rep = (np.concatenate([np.frombuffer(r[f"{s}_{c}"], "i8") for s in sides]) for c in ("counts", "reps"))
        n, na = len(unit), len(r["l_reps"]) // 8
        head = unit @ axes[dim][:, :HEAD]
        rest = np.sqrt(np.maximum(0, 1 - (head * head).sum(1)))
        bound = np.concatenate([head, rest[:, None]], 1).astype("f4")
        links, label = np.zeros(n, "i8"), np.arange(n)

        def leaf(a, b):
            i, j = np.nonzero(bound[a[0] : a[1]] @ bound[b[0] : b[1]].T >= least - 1e-5)
            i, j = i + a[0], j + b[0]
            if a == b:
                i, j = i[i < j], j[i < j]
            found = [np.zeros(0, bool)]
            for k in range(0, len(i), 32768):
                found.append(np.einsum("xy,xy->x", unit[i[k : k + 32768]], unit[j[k : k + 32768]]) >= least)
            found = np.concatenate(found)
            i, j = i[found], j[found]
            np.add.at(links, i, count[j])
            np.add.at(links, j, count[i])
            unite(label, i, j)

        boxes = {}

        def box(s):
            if s not in boxes:
                boxes[s] = head[s[0] : s[1]].min(0), head[s[0] : s[1]].max(0)
            return boxes[s]

        def join(a, b):
            (alo, ahi), (blo, bhi) = box(a), box(b)
            gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
            if gap @ gap > eps2:
                return
            if max(a[1] - a[0], b[1] - b[0]) <= LEAF:
                return leaf(a, b)
            halves = [[s] if s[1] - s[0] <= LEAF else [(s[0], (s[0] + s[1]) // 2), ((s[0] + s[1]) // 2, s[1])] for s in (a, b)]
            for k, x in enumerate(halves[0]):
                for y in halves[1][k if a == b else 0 :]:
                    join(x, y)

        join((0, n), (0, n)) if same else join((0, na), (na, n))
        at = np.flatnonzero(links)
        keys = b"".join(r[f"{s}_keys"] for s in sides)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), dim, "i4")), pa.array([keys[16 * x : 16 * x + 16] for x in at], pa.binary()), pa.array(links[at]), pa.array(rep[at]), pa.array(rep[label[at]])],
            ["dim", "key", "links", "a", "b"],
        )

    return run


def interval_tiles(seq: DataFrame, eps2: float, tasks: int) -> DataFrame:
    """Pairs of intervals, a <= b in the sequence, whose boxes are within the square root of ``eps2``, with their vectors.

    Either side reads the staged sequence in ``tasks`` parts, and a task joins a part with a part as it reads them. So no vector is
    shuffled or written again, however many pairs there are, and a task holds one part and a pair at a time.
    """
    carried = ("keys", "reps", "counts", "units")
    side = lambda s: seq.coalesce(tasks).select(*(F.col(c).alias(f"{s}_{c}") for c in ("iid", "dim", "lo", "hi", *carried)))
    gap = lambda i: F.greatest(F.lit(0.0), F.get("l_lo", i) - F.get("r_hi", i), F.get("r_lo", i) - F.get("l_hi", i))
    near = (F.col("l_iid") <= F.col("r_iid")) & (F.col("l_dim") == F.col("r_dim")) & (sum((gap(i) * gap(i) for i in range(HEAD)), F.lit(0.0)) <= eps2)
    own = lambda c: F.when(F.col("a") != F.col("b"), F.col(c)).alias(c)  # noqa: E731  a tile of one interval carries it once
    pairs = side("l").join(side("r").hint("shuffle_replicate_nl"), near).withColumnsRenamed({"l_iid": "a", "r_iid": "b", "l_dim": "dim"})
    return pairs.select("a", "b", "dim", *(f"l_{c}" for c in carried), *(own(f"r_{c}") for c in carried))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """Links every two vectors with cosine >= ``least`` and returns one row per input row.

    Columns: vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    Rows that repeat a vector link with each other. A row without an id links with nothing, has no component and is
    kept. Rows that share an id are one node for components. No rows give no rows; other columns are ignored.
    """
    vec = F.col(vec_col).cast("array<double>")
    rows = stage_table(df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v")).mapInArrow(_unit, "vec_id long, dim int, key binary, unit binary"), "units")
    valid = rows.where("dim is not null and vec_id is not null")
    reps = stage_table(valid.groupBy("dim", "key").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"), F.min_by("unit", "vec_id").alias("unit")), "vectors")

    axes, sizes = {}, {r.dim: r.n for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per length
    for dim in sizes:
        few = reps.where(F.col("dim") == dim).orderBy("key").limit(PCA_SAMPLE).select("unit").collect()
        x = np.frombuffer(b"".join(bytes(r[0]) for r in few), "f8").reshape(-1, dim)
        axes[dim] = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])

    eps = float(np.sqrt(2 - 2 * least))
    order = ["dim", *(f"c{i}" for i in range(CELLS)), "key"]
    sized = T.StructType(reps.schema.fields + [T.StructField(f"c{i}", T.IntegerType()) for i in range(CELLS)])
    tasks = max(1, sum(-(-n // interval_size(dim)) for dim, n in sizes.items()))
    cut = reps.mapInArrow(_cells(axes, eps), sized).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    seq = stage_table(cut.mapInArrow(_intervals(axes, {dim: interval_size(dim) for dim in sizes}), INTERVAL_SQL), "intervals")
    parts = max(PARTS, -(-sum(8 * dim * n for dim, n in sizes.items()) // PART_BYTES))
    tiles = interval_tiles(seq, 2 - 2 * least + 1e-9, min(tasks, parts))
    found = stage_table(tiles.mapInArrow(_tiles(axes, least), "dim int, key binary, links long, a long, b long"), "links")

    roots = components(found.select("a", "b"))
    links = found.groupBy("dim", "key").agg(F.sum("links").alias("links"))
    info = reps.drop("unit").join(links, ["dim", "key"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("dim", "key", F.col("n").alias("share"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    info = stage_table(info, "classes")
    linked = join_counted(valid.select("vec_id", "dim", "key"), info, ["dim", "key"], valid.count())
    linked = linked.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("root").alias("component_id"))
    alone = rows.where("dim is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

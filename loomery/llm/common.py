"""What the corpus operators share: joins that no hot key gathers, and connected components.

Their stage tables are those of the core (:mod:`loomery.sources.work`).
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import drop_table, drop_work, shared_dir, stage_table, work_path  # noqa: F401

HOT = 1000  # see join_counted


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def join_counted(rows: DataFrame, per: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Joins rows with ``per``, which has a row per key with ``share``, the number of rows that have it.

    Keys that count over one in HOT of ``total`` rows join by broadcast, wherever their rows are: as the shares add up to no
    more than ``total``, fewer than HOT keys are broadcast. The others are shuffled, so no task gets more than its share.
    """
    often = F.broadcast(per.where(F.col("share") > total / HOT))
    rest = rows.join(often.select(*keys), keys, "left_anti").join(per.where(F.col("share") <= total / HOT), keys)
    return rows.join(often, keys).unionByName(rest)


def give_back() -> None:
    """Gives memory that this process has freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library of Linux
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """A task's function that gives memory back when it has ended, as the worker that ran it goes on to other tasks."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i[k] and j[k] for all k; label[x] is a smaller or equal index in x's class."""
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label[:] = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]


FOREST_EDGES = 1 << 20  # edges that a task contracts at a time


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to one edge per node, to the smallest node that these edges reach."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    label = np.arange(len(nodes))
    unite(label, at[: len(a)], at[len(a) :])
    low = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[low], nodes[label[low]]


def _forest(batches):
    """A task's edges, contracted."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if ends:
        a, b = contract(*(np.concatenate([e[k] for e in ends]) for k in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    ``edges`` has two long columns ``a`` and ``b``. Returns (node, root), root being the smallest node reachable, for
    every node that has an edge to another node. Rows with a null end and loops are ignored; no edges give no rows.

    Tasks of at most ``FOREST_EDGES`` edges contract them first, so that what many edges say of the same nodes is said once; if
    one task holds all, that is the result. Else alternating large-star and small-star steps follow: each needs only a minimum by node (pre-aggregated before its shuffle)
    and a join that Spark may split when one node has very many edges. Every round is a table in the shared folder.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    tasks = max(1, -(-e.count() // FOREST_EDGES))
    e = stage_table(e.repartition(tasks).mapInArrow(_forest, "a long, b long").distinct(), "edges")
    seen = None
    while tasks > 1:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen, old = state, e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stage_table(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m")))
        small = large.join(low, "a").select(pairs.alias("p")).select(F.col("p.a").alias("a"), F.col("p.m").alias("b"))
        e = stage_table(small.where("a <> b").distinct(), "edges")
        drop_table(old, large)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

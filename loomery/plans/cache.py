"""Cache of encoded records by block, as Parquet; complete once its marker is written.

A block is a folder. An epoch's order is a scan of the blocks in that order, each shuffled where it is
read, so records of a cached run are never exchanged to be shuffled.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.prng import draws_of
from ..operators.rows import block_list


def cache_path(directory: str, manifest_crc: int, block_size: int, columns: int) -> str:
    """A folder per manifest, block size and arity, so that a changed one is never read by mistake."""
    return f"{directory.rstrip('/')}/loomery_cache_{manifest_crc:08x}_{block_size}_{columns}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_complete(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path}/_SUCCESS")


def store(df: DataFrame, path: str) -> DataFrame:
    """:func:`write`, and reads the blocks back."""
    write(df, path)
    return load(df.sparkSession, path, df.columns)


def write(df: DataFrame, path: str) -> None:
    """Writes blocks (column ``block_id``) unless a complete cache is there.

    A writer has a folder of its own and moves it into place when it is complete, so of several writers one wins and the
    others read what it wrote.
    """
    spark = df.sparkSession
    if not is_complete(spark, path):
        own = f"{path}.{uuid.uuid4().hex}"
        df.repartition("block_id").sortWithinPartitions("block_id", "row_idx").write.partitionBy("block_id").parquet(own)
        jvm = spark.sparkContext._jvm
        source, target = jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(path)
        store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not is_complete(spark, path):
            store.delete(target, True)  # what a stopped writer of an older kind has left
            store.rename(source, target)
        store.delete(source, True)
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{source.getName()}"), True)  # where a rename that came late lands


def load(spark: SparkSession, path: str, columns: list[str], block: int | None = None) -> DataFrame:
    """Cached records; one block reads that block's files only."""
    df = spark.read.parquet(path).withColumn("block_id", F.col("block_id").cast("long"))
    return (df if block is None else df.where(F.col("block_id") == block)).select(*columns)


PLACES = ("row_idx", "source_idx", "block_id", "block_pos", "in_block", "epoch")


MAX_TASKS = 1000  # of a scan; where there are more blocks, a task reads some, one after the other


@dataclass
class _Block:
    """A block in its place: rows from ``start`` on in the order of its epoch."""

    block: int
    place: int
    start: int
    epoch: int


@dataclass
class _Blocks(InputPartition):
    """Blocks that follow each other."""

    blocks: list[_Block]


class _BlockReader(DataSourceReader):
    def __init__(self, schema: StructType, about: dict):
        self.columns, self.about = [f.name for f in schema.fields if f.name not in PLACES], about
        self.names = schema.names

    def partitions(self):
        a, out = self.about, []
        blocks = block_list(a["n_rows"], a["block_size"])
        for epoch in range(a["first"], a["last"] + 1):
            order, start = list(range(len(blocks))), 0
            if a["block_order"]:
                order.sort(key=lambda b: (draws_of(b, a["seed"] + epoch, 2), b))
            for place, b in enumerate(order):
                out.append(_Block(b, place, start, epoch))
                start += blocks[b][1]
        some = -(-len(out) // self.about["tasks"])
        return [_Blocks(out[i : i + some]) for i in range(0, len(out), max(some, 1))]

    def read(self, partition):
        from pyarrow import fs

        path = self.about["path"]
        store, path = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        for block in partition.blocks:
            yield from self._rows(store, path, block)

    def _rows(self, store, path, block):
        a = self.about
        t = pq.read_table(f"{path}/block_id={block.block}", columns=["row_idx", *self.columns], filesystem=store, partitioning=None)
        at = t.column("row_idx").to_numpy().astype("i8")
        order = np.lexsort((at, draws_of(at, a["seed"] + block.epoch, 3))) if a["within"] else np.argsort(at)
        t, n = t.take(pa.array(order)), len(order)
        places = {"row_idx": block.start + np.arange(n), "source_idx": at[order], "block_id": np.full(n, block.block), "block_pos": np.full(n, block.place), "in_block": np.arange(n), "epoch": np.full(n, block.epoch)}
        columns = [pa.array(places[c].astype("i8")) if c in places else t.column(c) for c in self.names]
        yield from pa.table(columns, self.names).to_batches()


class BlockScan(DataSource):
    """Cached blocks in the orders of some epochs, some that follow each other in a partition."""

    @classmethod
    def name(cls):
        return "cachedblocks"

    def reader(self, schema):
        return _BlockReader(schema, json.loads(self.options["about"]))


def scan(spark: SparkSession, path: str, columns: list[str], n_rows: int, block_size: int, seed: int, first: int, last: int, within: bool = True, block_order: bool = True) -> DataFrame:
    """The rows of the epochs from ``first`` to ``last`` in the orders that :func:`..operators.rows.shuffle_blocks` gives, with its columns and ``epoch``.

    ``path`` is mounted where tasks run, or a URI that Arrow's file systems know. No row is exchanged: a task
    reads a block, or, beyond ``MAX_TASKS``, some that follow each other. One block tells the columns, as listing all takes long.
    """
    spark.dataSource.register(BlockScan)
    kinds = spark.read.parquet(f"{path}/block_id=0").select(*(c for c in columns if c not in PLACES)).schema if n_rows else load(spark, path, columns).schema
    kept = [f for f in kinds.fields if f.name not in PLACES]
    schema = StructType([*kept, *(StructField(c, LongType()) for c in PLACES)])
    about = {"path": path.removeprefix("file://"), "n_rows": n_rows, "block_size": block_size, "seed": seed, "first": first, "last": last, "within": within, "block_order": block_order, "tasks": MAX_TASKS}
    return spark.read.format("cachedblocks").schema(schema).option("about", json.dumps(about)).load()

"""Row selection, order and batching over an indexed table (columns ``row_idx`` 0..N-1, then anything).

No operator sorts the whole table in one task. A position is a partition's offset and a place in it: the table is range-sorted
and staged once, its partitions are counted, and the counts are added up from one line per partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prng import M, unit, with_draws
from ..sources.work import stage_table

_PLACE = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


def _offsets(df: DataFrame, at: list[str], sums: list[Column]) -> list[tuple]:
    """A line per partition: its key, then the sums over all partitions before it, in the order of the key."""
    lines = sorted(tuple(r) for r in df.groupBy(*at).agg(*sums).collect())
    out, before = [], [0] * len(sums)
    for line in lines:
        out.append((*line[: len(at)], *before))
        before = [b + x for b, x in zip(before, line[len(at) :])]
    return out


def _shifted(df: DataFrame, at: list[str], key: str, out: str) -> DataFrame | None:
    """Positions from stored numbers ``key`` that have no gap among rows equal in ``at``: a number and a shift. None if one has a gap."""
    lines = sorted(tuple(r) for r in df.groupBy(*at).agg(F.count("*"), F.min(key), F.max(key)).collect())
    base, n = [], 0
    for *where, count, first, last in lines:
        if last - first + 1 != count:
            return None
        base.append((*where, n - first))
        n += count
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in at)
    offsets = df.sparkSession.createDataFrame(base, f"{kinds}, _base long")
    return df.join(F.broadcast(offsets), at).withColumn(out, F.col("_base") + F.col(key)).drop("_base")


def number_in_place(df: DataFrame, at: list[str], out: str) -> DataFrame:
    """Adds positions, from 0, to rows that are in order already: by the columns ``at``, and as they stand among rows equal in these.

    Rows that are equal in ``at`` must stand together in one partition, as the lines of one split of a file do; then no row moves. The
    table is written once with its places, since a scan has other splits and partitions when cores come and go or the session's settings
    change. The driver gets a line per value of ``at``.
    """
    placed = _shifted(stage_table(df.withColumn("_id", F.monotonically_increasing_id()), "placed"), at, "_id", out)
    if placed is None:
        raise ValueError(f"rows that are equal in {', '.join(at)} must stand together")
    return placed.drop("_id")


def number_left(df: DataFrame, at: list[str], key: str, out: str) -> DataFrame:
    """Adds positions, from 0, to rows left of a table that :func:`number_in_place` gave ``key``.

    No row moves if what is gone stood before or after all that is left among rows equal in ``at``; else rows are sorted by ``key``.
    """
    placed = _shifted(df, at, key, out)
    return with_row_index(df, key, out=out) if placed is None else placed


def with_row_index(df: DataFrame, key: str, ties: tuple[str, ...] = (), out: str = "row_idx", ranges: int | None = None) -> DataFrame:
    """Adds the position of each row in the order of ``key`` and ``ties``, from 0; rows equal in all of them keep their order.

    The table is written once in that order, so what it is read from is read once. Rows that share a key may be in several partitions.
    """
    keys = [key, *ties, "_tie"]
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    ordered = (rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    placed = ordered.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})
    staged = stage_table(placed, "rows")
    offsets = df.sparkSession.createDataFrame(_offsets(staged, ["_part"], [F.count("*")]), "_part int, _base long")
    return staged.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_base") + F.col("_at")).drop("_part", "_at", "_base")


def move_to(df: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The first ``count`` rows, and the rest, numbered from 0 again."""
    return df.where(F.col("row_idx") < count), df.where(F.col("row_idx") >= count).withColumn("row_idx", F.col("row_idx") - count)


def _last_choice(spark, n: int, want: int, fraction: float, seed: int) -> int:
    """The row from which on all rows are taken, as so many are still wanted: it follows the (n - want)-th row that is not drawn."""
    rest = n - want
    ids = with_draws(spark.range(n).withColumnRenamed("id", "at"), "at", seed, {"_u": 0}).where(unit(F.col("_u")) >= fraction)
    ids = ids.select("at", F.spark_partition_id().alias("_part"))
    before = _offsets(ids, ["_part"], [F.count("*")])
    part, base = next(((p, b) for p, b in reversed(before) if b < rest), (0, 0))
    place = ids.withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    found = place.where((F.col("_part") == part) & (F.col("_k") == rest - 1 - base)).head(1)
    return found[0]["at"] + 1 if found else n


def subset(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Exactly floor(N * fraction) rows, order kept, re-indexed: sequential sampling.

    Each row is drawn by itself. Rows are taken while they are wanted, and all from a row on once as many are wanted as are left. That
    row follows from counts of draws by partition, so every row is kept or not by its own number, and nothing is joined.
    """
    if not 0 < fraction <= 1:
        raise ValueError("subset_fraction must be > 0 and <= 1")
    if fraction == 1:
        return df
    n = df.count()
    want = int(n * fraction)
    if not want:
        return df.limit(0)
    tail = _last_choice(df.sparkSession, n, want, fraction, seed)
    drawn = with_draws(df.withColumnRenamed("row_idx", "source_idx"), "source_idx", seed, {"_u": 0})
    kept = drawn.where((unit(F.col("_u")) < fraction) | (F.col("source_idx") >= tail)).drop("_u")
    return with_row_index(kept, "source_idx").where(F.col("row_idx") < want)


def shuffle_rows(df: DataFrame, seed: int) -> DataFrame:
    """A permutation of all rows: ``source_idx`` keeps the old index, ``row_idx`` is the new one."""
    drawn = with_draws(df.withColumnRenamed("row_idx", "source_idx"), "source_idx", seed, {"_u": 1})
    return with_row_index(drawn, "_u", ("source_idx",)).drop("_u")


def shard(df: DataFrame, n_rows: int, node_id: int, node_count: int, batch_size: int) -> DataFrame:
    """A node's rows: whole batches dealt in turn, then contiguous tails; N mod nodes rows go to no node."""
    if node_count <= 1:
        return df
    if node_id >= node_count:
        raise ValueError("node_id must be less than node_count")
    per = n_rows // node_count
    batches, tail = divmod(per, batch_size)
    dealt = batches * batch_size * node_count
    r = F.col("row_idx")
    group = F.floor(r / (batch_size * node_count))
    place = r % (batch_size * node_count)
    mine = (r < dealt) & (F.floor(place / batch_size) == node_id)
    rest = (r >= dealt + tail * node_id) & (r < dealt + tail * (node_id + 1))
    new = F.when(r < dealt, group * batch_size + place % batch_size).otherwise(batches * batch_size + r - dealt - tail * node_id)
    return df.where(mine | rest).withColumn("source_idx", r).withColumn("row_idx", new.cast("long"))


def block_list(n_rows: int, block_size: int) -> list[tuple[int, int]]:
    """(start, count) of the blocks: as many as n_rows / block_size rounds to, of equal size but the last."""
    if n_rows <= 0:
        return []
    blocks = max(1, math.floor(n_rows / block_size + 0.5))
    size = math.ceil(n_rows / blocks)
    return [(s, min(size, n_rows - s)) for s in range(0, n_rows, size)]


def with_blocks(df: DataFrame, n_rows: int, block_size: int) -> DataFrame:
    size = block_list(n_rows, block_size)[0][1] if n_rows else 1
    return df.withColumn("block_id", F.floor(F.col("row_idx") / size).cast("long"))


def with_epochs(df: DataFrame, first: int, last: int) -> DataFrame:
    """Every row once per epoch from ``first`` to ``last``, with ``epoch``; no row moves."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))


def shuffle_blocks(df: DataFrame, seed: int, epoch: int = 0, within: bool = True, block_order: bool = True) -> DataFrame:
    """New order of a table with ``block_id``: blocks shuffled, rows shuffled in each block, or both.

    Adds ``block_pos``, ``in_block`` and ``source_idx``; ``row_idx`` becomes the new position. A table with ``epoch`` has an order of
    its own in each, drawn from ``seed`` + epoch; without it that is ``epoch``'s.
    """
    passes = ["epoch"] if "epoch" in df.columns else []
    salt = F.lit(seed).cast("long") + (F.col("epoch") if passes else F.lit(epoch))
    df = df.withColumnRenamed("row_idx", "source_idx")
    sizes = with_draws(df.groupBy(*passes, "block_id").agg(F.count("*").alias("_n")), "block_id", salt, {"_b": 2})  # a row per block
    order = Window.partitionBy(*passes).orderBy(*(["_b"] if block_order else []), "block_id")
    places = sizes.select(*passes, "block_id", (F.row_number().over(order) - 1).cast("long").alias("block_pos"), F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_at"))
    keyed = with_draws(df, "source_idx", salt, {"_r": 3}) if within else df
    rows = Window.partitionBy(*passes, "block_id").orderBy(*(["_r"] if within else []), "source_idx")
    out = keyed.withColumn("in_block", (F.row_number().over(rows) - 1).cast("long")).join(places, [*passes, "block_id"])
    return out.withColumn("row_idx", (F.col("_at") + F.col("in_block")).cast("long")).drop("_r", "_at")


def deal_epochs(df: DataFrame, n_rows: int, seed: int, first: int, last: int, node_id: int, node_count: int, batch_size: int) -> DataFrame:
    """A node's rows in each epoch from ``first`` to ``last``: all rows in an order drawn from ``seed`` and the epoch, then dealt.

    Nodes derive the same order, so in every epoch their rows are disjoint and only N mod nodes rows go to none. ``row_idx`` is the place
    in the epoch, ``source_idx`` the row's number in the table.
    """
    drawn = with_epochs(df.withColumnRenamed("row_idx", "source_idx"), first, last)
    drawn = with_draws(drawn, "source_idx", F.lit(seed).cast("long") + F.col("epoch"), {"_u": 1})
    placed = with_row_index(drawn, "epoch", ("_u", "source_idx"), "_pos").drop("_u")
    placed = placed.withColumn("row_idx", F.col("_pos") - (F.col("epoch") - first) * n_rows).withColumnRenamed("source_idx", "_from")
    return shard(placed, n_rows, node_id, node_count, batch_size).drop("_pos", "source_idx").withColumnRenamed("_from", "source_idx")


def batch_count(n_rows: int, batch_size: int, mode: str = "ONCE", count: int = 0) -> int:
    """Batches of a run; INFINITE counts those of one pass."""
    if mode == "COUNT":
        if count <= 0:
            raise ValueError("iteration_mode_count must be a positive integer")
        return count
    if mode not in ("ONCE", "INFINITE"):
        raise ValueError("iteration_mode must be one of ONCE, COUNT, INFINITE")
    return math.ceil(n_rows / batch_size)


def batches(df: DataFrame, n_rows: int, batch_size: int, n_batches: int) -> DataFrame:
    """Adds ``epoch``, ``pos``, ``batch_id`` and ``slot``; every batch is full, the last wraps to the next epoch's head.

    Rows repeat once per epoch that the batches reach, each row from its own index: no shuffle. A table that has ``epoch`` already, with
    an order in each, is only numbered on.
    """
    total = n_batches * batch_size
    if "epoch" not in df.columns:
        df = with_epochs(df, 0, max(math.ceil(total / n_rows) - 1, 0) if n_rows else 0)
    df = df.withColumn("pos", (F.col("epoch") * n_rows + F.col("row_idx")).cast("long"))
    return df.where(F.col("pos") < total).withColumns({"epoch": F.col("epoch").cast("long"), "batch_id": F.floor(F.col("pos") / batch_size).cast("long"), "slot": (F.col("pos") % batch_size).cast("long")})


def _smallest(keys: list[str], order: list[str], k: int, sorted_: bool):
    """The first k rows of each key in each Arrow batch; batches that are sorted throughout go on from one to the next."""

    def run(batches):
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.table(b)
            if not sorted_:
                t = t.sort_by([(c, "ascending") for c in keys + order])
            columns = [t.column(c).to_numpy() for c in keys]
            new = np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))
            starts = np.flatnonzero(new)
            place = np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))
            if sorted_:
                first, end = tuple(c[0] for c in columns), tuple(c[-1] for c in columns)
                if first == last:
                    place[: starts[1] if len(starts) > 1 else None] += seen
                last, seen = end, int(place[-1]) + 1
            yield from t.filter(pa.array(place < k)).to_batches()

    return run


def bottom_k(df: DataFrame, keys: list[str], order: list[str], k: int, by: list[str] | None = None) -> DataFrame:
    """The k first rows of each key (numbers, not null) in an order (of numbers that differ within a key).

    As an aggregate that can be merged: each task keeps k rows of a key, these are shuffled (by the columns ``by`` of the key, so that what
    follows can use that), and k of them stay.
    """
    kept = df.mapInArrow(_smallest(keys, order, k, False), df.schema).repartition(*(by or keys)).sortWithinPartitions(*keys, *order)
    return kept.mapInArrow(_smallest(keys, order, k, True), df.schema)


def row_at(df: DataFrame, offset: int):
    """The row at an index; out of range is an error."""
    found = df.where(F.col("row_idx") == offset).head(1)
    if not found:
        raise IndexError(f"record {offset} is out of range")
    return found[0]


def positions(n_rows: int, batch_size: int, mode: str, count: int = 0) -> Iterator[int]:
    """Batch numbers of a run; INFINITE never ends, and goes on counting so that each batch takes up where one ended."""
    n = batch_count(n_rows, batch_size, mode, count)
    k = 0
    while mode == "INFINITE" or k < n:
        yield k
        k += 1


def transpose(df: DataFrame, group: str, slot: str, values: str) -> DataFrame:
    """Batch-minor layout: per group and element position, the values of all slots in order."""
    long = df.select(group, slot, F.posexplode(values).alias("position", "value"))
    cells = F.array_sort(F.collect_list(F.struct(slot, "value")))
    return long.groupBy(group, "position").agg(F.transform(cells, lambda c: c["value"]).alias("values"))


MAX_DRAW = M

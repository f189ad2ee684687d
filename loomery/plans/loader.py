"""The loader: a configuration to an iterator of batches of numpy arrays.

The plan is lazy and has one row per record with ``batch_id`` and ``slot``. Records are put in order while they are no more
than lines of the manifest; files are opened, pixels decoded and batches assembled in the partitions that this gives, a few batches
each for the iterator and more for a whole plan. A batch reaches the driver as one binary value per array; the iterator brings one partition at a time and has the next one
made meanwhile, so a batch opens the files of its partition only. A record's error is raised when its batch is reached, with the
record's index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import anchors, rows
from ..operators.augment import with_augmentation
from ..sources import manifest
from . import batches, cache, config, providers

PART_BATCHES, MAX_PARTS = 4, 10_000  # batches of a partition that the iterator brings, unless there are too many
TASK_BATCHES, MAX_TASKS = 64, 1000  # batches of a task of a whole plan, unless there are too many


class DataLoader:
    """Batches of named arrays from a configuration (a dictionary).

    ``len`` is the number of records. Iteration starts over; each item is a tuple of (name, array) with the batch axis
    first, or last with ``batch_major`` false. The first batch is made at once, so broken data fails here.
    """

    def __init__(self, spark: SparkSession, given: dict[str, Any]):
        self.spark, self.config = spark, json.loads(config.to_json(given))
        self._cfg = cfg = config.loader(self.config)
        kinds, records = manifest.parse(manifest.read_lines(spark, cfg.manifest_filename))
        if len(kinds) != len(cfg.providers):
            raise ValueError(f"manifest has {len(kinds)} elements and etl {len(cfg.providers)}")
        self.kinds, n = kinds, records.count()
        if cfg.subset_fraction < 1:
            records = rows.subset(records, cfg.subset_fraction).select("row_idx", "line_no", "e")
            n = records.count()
        if n == 0:
            raise ValueError("manifest file is empty")
        self._deals = cfg.shuffle_manifest and cfg.node_count > 1
        if self._deals:  # every epoch has a deal of its own
            self._all, n = n, n // cfg.node_count
        elif cfg.shuffle_manifest:
            records = rows.shuffle_rows(records, cfg.random_seed)
        elif cfg.node_count > 1:
            records, n = rows.shard(records, n, cfg.node_id, cfg.node_count, cfg.batch_size), n // cfg.node_count
        self.ndata, self.batch_size = n, cfg.batch_size
        self.shapes = [s for kind, c in cfg.providers for s in providers.shapes(kind, c)]
        self.axes_info = tuple((name, tuple(zip(axes, shape))) for name, shape, _, axes in self.shapes)
        self._records = records.select("row_idx", "e")
        if cfg.cache_directory:
            crc = manifest.manifest_crc(records, b"\0")
            encoded = rows.with_blocks(self._load(self._records, ("row_idx",)), n, cfg.block_size)
            self._cached = cache.cache_path(cfg.cache_directory, crc, cfg.block_size, len(kinds))
            self._records = cache.store(encoded, self._cached)
        self._first = next(self._batches(0, 1))

    def __len__(self) -> int:
        return self.ndata

    @property
    def batch_count(self) -> int:
        return rows.batch_count(self.ndata, self.batch_size, self._cfg.iteration_mode, self._cfg.iteration_mode_count)

    def get_buffer_names(self) -> list[str]:
        return [s[0] for s in self.shapes]

    def get_shape(self, name: str) -> tuple[int, ...]:
        return next(s[1] for s in self.shapes if s[0] == name)

    def schema(self) -> T.StructType:
        """Columns of a record, with shape, axes and output type as metadata."""
        return T.StructType([T.StructField(n, T.ArrayType(T._parse_datatype_string(providers.otype(k))), True, {"shape": list(s), "axes": list(a), "otype": k}) for n, s, k, a in self.shapes])

    def _load(self, records: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        return manifest.load_files(manifest.typed(records, self.kinds, self._cfg.manifest_root, keep), self.kinds)

    def _ordered(self, first: int, last: int) -> DataFrame:
        """Records of the epochs that batches [first, last) reach, each with its place in each epoch.

        Under ``shuffle_manifest`` blocks have a new order in every epoch, or, with several nodes, records a new deal; under
        ``shuffle_enable`` the records of a block have.
        """
        cfg = self._cfg
        epochs = first * self.batch_size // self.ndata, max(first, last * self.batch_size - 1) // self.ndata
        if self._deals:
            df = rows.deal_epochs(self._records, self._all, cfg.random_seed, *epochs, cfg.node_id, cfg.node_count, cfg.batch_size).drop("source_idx")
        else:
            df = rows.with_epochs(self._records, *epochs)
        by_block = cfg.shuffle_manifest and not self._deals
        if cfg.cache_directory and (cfg.shuffle_enable or by_block):  # blocks are read in the order of the epoch
            return cache.scan(self.spark, self._cached, self._records.columns, self.ndata, cfg.block_size, cfg.random_seed, *epochs, cfg.shuffle_enable, by_block)
        if cfg.shuffle_enable or by_block:
            df = rows.shuffle_blocks(rows.with_blocks(df, self.ndata, cfg.block_size), cfg.random_seed, within=cfg.shuffle_enable, block_order=by_block)
        return df

    def _parts(self, n: int, iterated: bool) -> int:
        """Partitions of a plan of n batches: small ones for the iterator; else as many as Spark's shuffles have, or more, as a task has a cost of its own."""
        most = max(1, min(MAX_PARTS, -(-n // PART_BATCHES)))
        return most if iterated else min(most, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, -(-n // TASK_BATCHES))))

    def plan(self, first: int = 0, last: int | None = None, iterated: bool = False) -> DataFrame:
        """Records of batches [first, last): batch_id, slot, row_idx, the output columns and ``_error``. ``iterated``: in partitions of a few batches."""
        cfg, last = self._cfg, self.batch_count if last is None else last
        df = rows.batches(self._ordered(first, last), self.ndata, self.batch_size, last).where(F.col("batch_id") >= first)
        parts = self._parts(last - first, iterated)
        df = df.repartitionByRange(parts, "batch_id").sortWithinPartitions("batch_id", "slot")
        if not cfg.cache_directory:
            df = self._load(df, ("batch_id", "slot", "pos", "row_idx"))
        df = df.withColumn("_record", F.col("row_idx")).withColumn("_draw", F.pmod("pos", F.lit(2**31 - 1)))
        kinds = [providers.REGISTRY[k] for k, _ in cfg.providers]
        sized = next((i for i, k in enumerate(kinds) if k.picture), None)
        lead = next((i for i, k in enumerate(kinds) if k.picture or k.boxed), None)
        if lead is not None:
            if sized is not None:
                df = providers.add_sizes(df, f"e{sized}", cfg.providers[sized][0] == "video")
                w, h = F.col("in_width"), F.col("in_height")
            else:
                size = F.from_json(F.col(f"e{lead}").cast("string"), "size struct<width: int, height: int>")["size"]
                w, h = size["width"], size["height"]
            to = cfg.providers[lead][1]
            to = to.get("frame", to)
            df = with_augmentation(df, cfg.augmentation, cfg.random_seed, w, h, to["width"], to["height"], "_draw", any(k == "localization_ssd" for k, _ in cfg.providers))
        for i, (_, c) in enumerate(cfg.providers):
            if kinds[i].joined:
                df = self._rcnn(df, c, f"e{i}")
        if any(k.joined for k in kinds):  # in order again before pixels are decoded
            df = df.repartitionByRange(parts, "batch_id").sortWithinPartitions("batch_id", "slot")
        for i, (_, c) in enumerate(cfg.providers):
            if kinds[i].add:
                df = kinds[i].add(df, c, f"e{i}", cfg.augmentation)
        return df.select("batch_id", "slot", F.col("_record").alias("row_idx"), *(F.col(providers.inner_name(s[0])).alias(s[0]) for s in self.shapes), "_error")

    def _rcnn(self, df: DataFrame, c: dict, element: str) -> DataFrame:
        """Anchor targets of each record, joined to it by its position while its files are bytes."""
        df = df.withColumn("_json", F.col(element).cast("string")).withColumnRenamed("_error", "_before")
        df = providers.parse_annotations(df, "_json", c["class_names"]).withColumn("_error", F.coalesce("_before", "_error")).drop("_before", "_json", "width", "height", "depth")
        a, m = F.col("aug"), c["max_gt_boxes"]
        df = df.withColumn("boxes", F.slice(providers.transformed_boxes(F.col("boxes"), self._cfg.augmentation, False), 1, m))
        gt = df.select(F.col("pos").alias("image_id"), a["out_width"].alias("w"), a["out_height"].alias("h"), F.posexplode_outer("boxes").alias("gt_idx", "b")).where("gt_idx is not null").select("image_id", "w", "h", "gt_idx", "b.*")
        lattice = anchors.Lattice(c["height"], c["width"], c["base_size"], tuple(c["ratios"]), tuple(c["scales"]), c["scaling_factor"])
        images = anchors.label_images(gt, lattice, F.col("w"), F.col("h"), c["negative_overlap"], c["positive_overlap"])
        sparse = anchors.sample(images, lattice, c["rois_per_image"], c["foreground_fraction"], self._cfg.random_seed)
        out = anchors.planes(df.join(sparse.withColumnRenamed("image_id", "pos"), "pos", "left"), lattice, tuple(df.columns))
        fill = lambda v, n, kind: F.slice(F.concat(F.coalesce(v, F.array().cast(f"array<{kind}>")), F.array_repeat(F.lit(0).cast(kind), n)), 1, n)
        sides = F.flatten(F.transform("boxes", lambda x: F.array(x["xmin"], x["ymin"], x["xmax"], x["ymax"]).cast("array<float>")))
        ints = lambda k: fill(F.transform("boxes", lambda x: x[k].cast("int")), m, "int")
        count = F.greatest(F.coalesce(F.size("boxes"), F.lit(0)), F.lit(0))
        more = {"image_shape": F.array(a["out_width"], a["out_height"]), "image_scale": F.array((a["out_width"] / a["crop_width"]).cast("float")), "gt_boxes": fill(sides, 4 * m, "float"), "gt_box_count": F.array(count), "gt_class_count": ints("label"), "difficult_flag": ints("difficult")}
        out = out.withColumns(more).drop("boxes")
        prefix = f"{c['name']}." if c.get("name") else ""
        return out.withColumnsRenamed({s[0][len(prefix) :]: providers.inner_name(s[0]) for s in providers.shapes("localization_rcnn", c)}) if prefix else out

    def batch_plan(self, first: int = 0, last: int | None = None, iterated: bool = False) -> DataFrame:
        """A row per batch, made by tasks: batch_id, n_bytes, a0, a1, ... (an array's bytes each, in the order of the buffers), _error."""
        df = self.plan(first, last, iterated)
        return batches.assemble(df, [(name, shape, providers.NUMPY[kind]) for name, shape, kind, _ in self.shapes], self.batch_size, self._cfg.batch_major)

    def _batches(self, first: int, last: int) -> Iterator[tuple[tuple[str, np.ndarray], ...]]:
        made = {name: (providers.NUMPY[kind], (self.batch_size, *shape) if self._cfg.batch_major else (int(np.prod(shape)), self.batch_size)) for name, shape, kind, _ in self.shapes}
        for r in self.batch_plan(first, last, True).toLocalIterator(prefetchPartitions=True):
            if r["_error"]:
                raise RuntimeError(r["_error"])
            yield tuple((name, np.frombuffer(bytearray(r[f"a{i}"]), kind).reshape(shape)) for i, (name, (kind, shape)) in enumerate(made.items()))

    def reset(self) -> None:
        self._running = None

    def __iter__(self) -> Iterator[tuple[tuple[str, np.ndarray], ...]]:
        if self._cfg.iteration_mode != "INFINITE":
            yield from self._batches(0, self.batch_count)
            return
        step, at = max(1, self.batch_count), 0
        while True:  # a pass at a time; batches go on across passes
            yield from self._batches(at, at + step)
            at += step

    def __next__(self):
        if getattr(self, "_running", None) is None:
            self._running = iter(self)
        return next(self._running)

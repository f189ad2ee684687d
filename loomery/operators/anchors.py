"""Anchor targets of two-stage detectors as relational plans.

``boxes`` hold a row per ground-truth box (image_id, gt_idx, xmin, ymin, xmax, ymax). Anchors are a lattice that the configuration
fixes: those that overlap a box follow from its sides by arithmetic, in the box's own row, and every other overlap is known to be
zero. So nothing is joined with anchors; one shuffle brings the boxes of an image together, and all that follows keeps that partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prng import with_draws
from .rows import bottom_k


def _half_away(x: float) -> float:
    return math.floor(x + 0.5) if x >= 0 else -math.floor(-x + 0.5)


def base_anchors(base: int = 16, ratios=(0.5, 1, 2), scales=(8, 16, 32)) -> list[tuple[float, float, float, float]]:
    """Anchors around one grid point: for each ratio, then each scale, centred on the base square."""
    mid, out = (base - 1) / 2, []
    for ratio in ratios:
        w = _half_away(math.sqrt(base * base / ratio))
        h = _half_away(w * ratio)
        for s in scales:
            dx, dy = (w * s - 1) / 2, (h * s - 1) / 2
            out.append((mid - dx, mid - dy, mid + dx, mid + dy))
    return out


def tile_anchors(spark: SparkSession, height: int, width: int, base: int = 16, ratios=(0.5, 1, 2), scales=(8, 16, 32), scaling: float = 1 / 16) -> DataFrame:
    """All anchors (anchor_idx, xmin, ymin, xmax, ymax): by anchor, then y, then x, a stride apart."""
    rows, cols, stride = int(height * scaling), int(width * scaling), 1 / scaling
    kinds = [(k, *map(float, a)) for k, a in enumerate(base_anchors(base, ratios, scales))]
    grid = spark.createDataFrame(kinds, "kind long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    grid = grid.withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    idx = (F.col("kind") * rows + F.col("gy")) * cols + F.col("gx")
    x, y = F.col("gx") * stride, F.col("gy") * stride
    return grid.select(idx.cast("long").alias("anchor_idx"), (F.col("x0") + x).alias("xmin"), (F.col("y0") + y).alias("ymin"), (F.col("x1") + x).alias("xmax"), (F.col("y1") + y).alias("ymax"))


def inside(anchors: DataFrame, width, height) -> DataFrame:
    return anchors.where((F.col("xmin") >= 0) & (F.col("ymin") >= 0) & (F.col("xmax") < width) & (F.col("ymax") < height))


def _real(side: Column | float) -> Column:
    return (side if isinstance(side, Column) else F.lit(side)).cast("double")


def _span(low: Column, high: Column) -> Column:
    """Whole numbers from low to high; none if high is less."""
    return F.slice(F.sequence(low, F.greatest(low, high)), F.lit(1), F.greatest(high - low + 1, F.lit(0)))


@dataclass(frozen=True)
class Lattice:
    """The anchors of a configuration: base anchors at every point of a grid, numbered by base anchor, then y, then x."""

    height: int
    width: int
    base: int = 16
    ratios: tuple = (0.5, 1, 2)
    scales: tuple = (8, 16, 32)
    scaling: float = 1 / 16

    @property
    def shape(self) -> tuple[int, int]:
        return int(self.height * self.scaling), int(self.width * self.scaling)

    @property
    def kinds(self) -> list[tuple[float, float, float, float]]:
        return base_anchors(self.base, self.ratios, self.scales)

    @property
    def count(self) -> int:
        return len(self.kinds) * self.shape[0] * self.shape[1]

    def _kinds(self) -> Column:
        sides = lambda a: (F.lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), a))
        return F.array(*(F.struct(F.lit(k).cast("long").alias("kind"), *sides(a)) for k, a in enumerate(self.kinds)))

    def _number(self, kind: Column, gy: Column, gx: Column) -> Column:
        rows, cols = self.shape
        return (kind * rows + gy) * cols + gx

    def _range(self, low: Column, high: Column, limit: Column, cells: int) -> tuple[Column, Column]:
        """First and last place along an axis of a base anchor from ``low`` to ``high`` that stays within 0 and ``limit``."""
        s = F.lit(1 / self.scaling)
        return F.greatest(F.ceil(-low / s), F.lit(0).cast("long")), F.least(F.ceil((limit - high) / s) - 1, F.lit(cells - 1).cast("long"))

    def inside(self, width: Column | float, height: Column | float) -> Column:
        """Numbers of the anchors within the image, as an array."""
        rows, cols = self.shape
        w, h = _real(width), _real(height)
        line = lambda k, y: F.transform(_span(*self._range(k["x0"], k["x1"], w, cols)), lambda x: self._number(k["kind"], y, x))
        return F.flatten(F.transform(self._kinds(), lambda k: F.flatten(F.transform(_span(*self._range(k["y0"], k["y1"], h, rows)), lambda y: line(k, y)))))

    def sides(self, number: Column) -> dict[str, Column]:
        """xmin, ymin, xmax, ymax of an anchor from its number."""
        rows, cols = self.shape
        kind, gy, gx = F.floor(number / (rows * cols)).cast("int"), F.floor(number % (rows * cols) / cols), number % cols
        base = lambda k: F.get(F.array(*(F.lit(float(a[k])) for a in self.kinds)), kind)
        s = 1 / self.scaling
        return {"xmin": base(0) + gx * s, "ymin": base(1) + gy * s, "xmax": base(2) + gx * s, "ymax": base(3) + gy * s}

    def _axis(self, low: Column, high: Column, a0: Column, a1: Column, limit: Column, cells: int) -> Column:
        """Places along an axis where a base anchor meets the side from ``low`` to ``high``, with how much they share."""
        s = F.lit(1 / self.scaling)
        first, last = self._range(a0, a1, limit, cells)
        first, last = F.greatest(first, F.floor((low - 1 - a1) / s) + 1), F.least(last, F.ceil((high + 1 - a0) / s) - 1)
        return F.transform(_span(first, last), lambda g: F.struct(g.alias("g"), (F.least(high, a1 + g * s) - F.greatest(low, a0 + g * s) + 1).alias("n")))


def _iou(shared: Column, box: Column, anchor: Column) -> Column:
    return shared / (box + anchor - shared)


def overlaps(boxes: DataFrame, lattice: Lattice, width: Column | float, height: Column | float, outer: bool = False) -> DataFrame:
    """A row per box and anchor that share something: the box's columns, ``best`` (its largest overlap), anchor_idx, iou.

    Only anchors within ``width`` and ``height`` count. With ``outer`` a box that meets none has rows without anchor.
    """
    rows, cols = lattice.shape
    w, h = _real(width), _real(height)
    size = (F.col("xmax") - F.col("xmin") + 1) * (F.col("ymax") - F.col("ymin") + 1)
    x = lambda k: lattice._axis(F.col("xmin"), F.col("xmax"), k["x0"], k["x1"], w, cols).alias("xs")
    y = lambda k: lattice._axis(F.col("ymin"), F.col("ymax"), k["y0"], k["y1"], h, rows).alias("ys")
    area = lambda k: ((k["x1"] - k["x0"] + 1) * (k["y1"] - k["y0"] + 1)).alias("area")
    per = F.transform(lattice._kinds(), lambda k: F.struct(k["kind"].alias("kind"), area(k), x(k), y(k)))
    meets = F.filter(per, lambda k: (F.size(k["xs"]) > 0) & (F.size(k["ys"]) > 0))
    most = lambda a: F.array_max(F.transform(a, lambda c: c["n"]))  # noqa: E731  # an overlap rises with what is shared along either axis
    out = boxes.withColumn("_kinds", meets)
    out = out.withColumn("best", F.coalesce(F.array_max(F.transform("_kinds", lambda k: _iou(most(k["xs"]) * most(k["ys"]), size, k["area"]))), F.lit(0.0)))
    # outer, as a plain explode has the optimizer test its array beforehand, and so write out again all that the array comes from
    out = out.withColumn("_k", F.explode_outer("_kinds")).drop("_kinds").withColumn("_x", F.explode_outer("_k.xs")).withColumn("_y", F.explode_outer("_k.ys"))
    out = out if outer else out.where(F.col("_y.g").isNotNull())
    return out.withColumns({"anchor_idx": lattice._number(F.col("_k.kind"), F.col("_y.g"), F.col("_x.g")), "iou": _iou(F.col("_x.n") * F.col("_y.n"), size, F.col("_k.area"))}).drop("_k", "_x", "_y")


def label_images(boxes: DataFrame, lattice: Lattice, width: Column | float, height: Column | float, negative: float = 0.3, positive: float = 0.7, zero_column_positive: bool = True) -> DataFrame:
    """A row per image: ``gts`` (its boxes), ``near`` (anchor_idx, max_iou, gt_idx, label of the anchors that meet a box), ``far_label`` (that of all
    others, whose best box is the first), and the width and height within which anchors count.

    An anchor's label is 1, 0 or -1; its best box is the first of equals. It is positive if it is the best of some box, ties included; with
    ``zero_column_positive`` even where that best is no overlap at all, and then every anchor is. Boxes are shuffled once, by image.
    """
    sides = ["gt_idx", "xmin", "ymin", "xmax", "ymax"]
    rows = boxes.select("image_id", *sides, _real(width).alias("_w"), _real(height).alias("_h")).repartition("image_id")
    over = overlaps(rows, lattice, F.col("_w"), F.col("_h"))
    near = over.groupBy("image_id", "anchor_idx").agg(F.max("iou").alias("max_iou"), F.min_by("gt_idx", F.struct(-F.col("iou"), "gt_idx")).alias("gt_idx"), F.bool_or(F.col("iou") == F.col("best")).alias("_tie"))
    near = near.groupBy("image_id").agg(F.collect_list(F.struct("anchor_idx", "max_iou", "gt_idx", "_tie")).alias("_near"))
    best = overlaps(rows, lattice, F.col("_w"), F.col("_h"), outer=True).groupBy("image_id", *sides, "_w", "_h").agg(F.max("best").alias("best"))
    images = best.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*sides))).alias("gts"), F.first("_w").alias("_w"), F.first("_h").alias("_h"), F.bool_or(F.col("best") == 0).alias("_zero"))
    every = F.col("_zero") & F.lit(zero_column_positive)
    label = lambda iou, tie: F.when((iou >= positive) | tie | every, 1).when(iou < negative, 0).otherwise(-1)
    out = images.join(near, "image_id", "left")
    none = F.array().cast("array<struct<anchor_idx: bigint, max_iou: double, gt_idx: int, label: int>>")
    labelled = F.transform("_near", lambda a: F.struct(a["anchor_idx"].alias("anchor_idx"), a["max_iou"].alias("max_iou"), a["gt_idx"].cast("int").alias("gt_idx"), label(a["max_iou"], a["_tie"]).alias("label")))
    return out.select("image_id", "gts", F.coalesce(labelled, none).alias("near"), label(F.lit(0.0), F.lit(False)).alias("far_label"), "_w", "_h")


def label_anchors(images: DataFrame, lattice: Lattice, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per image and anchor within it, from :func:`label_images`: image_id, the image's columns ``keep``, anchor_idx, max_iou, gt_idx, label. No row moves."""
    far = F.array_except(lattice.inside(F.col("_w"), F.col("_h")), F.transform("near", lambda a: a["anchor_idx"]))
    first = F.get("gts", 0)["gt_idx"].cast("int")
    others = F.transform(far, lambda i: F.struct(i.alias("anchor_idx"), F.lit(0.0).alias("max_iou"), first.alias("gt_idx"), F.col("far_label").alias("label")))
    return images.select("image_id", *keep, F.explode_outer(F.concat("near", others)).alias("_a")).where(F.col("_a.anchor_idx").isNotNull()).select("image_id", *keep, "_a.*")


def _target(lattice: Lattice, number: Column, gt: Column) -> dict[str, Column]:
    a = lattice.sides(number)
    size = lambda lo, hi: hi - lo + 1
    aw, ah, gw, gh = size(a["xmin"], a["xmax"]), size(a["ymin"], a["ymax"]), size(gt["xmin"], gt["xmax"]), size(gt["ymin"], gt["ymax"])
    middle = lambda lo, n: lo + 0.5 * n
    return {"dx": (middle(gt["xmin"], gw) - middle(a["xmin"], aw)) / aw, "dy": (middle(gt["ymin"], gh) - middle(a["ymin"], ah)) / ah, "dw": F.log(gw / aw), "dh": F.log(gh / ah)}


def _box(gts: Column, gt_idx: Column) -> Column:
    return F.get(F.filter(gts, lambda g: g["gt_idx"] == gt_idx), 0)


def targets(images: DataFrame, lattice: Lattice) -> DataFrame:
    """:func:`label_anchors` with dx, dy, dw, dh of the best box of each anchor, which the image's own row has: nothing is joined."""
    images = images.withColumn("_ids", F.transform("gts", lambda g: g["gt_idx"]))
    rows = label_anchors(images, lattice, ("gts", "_ids"))
    rows = rows.withColumn("_g", F.get("gts", (F.array_position("_ids", F.col("gt_idx")) - 1).cast("int"))).drop("gts", "_ids")
    return rows.withColumns(_target(lattice, F.col("anchor_idx"), F.col("_g"))).drop("_g")


def sample(images: DataFrame, lattice: Lattice, rois: int = 256, foreground: float = 0.5, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """The anchors that count in each image, as ``sample``: an array of (anchor_idx, label, dx, dy, dw, dh) in the order of anchors.

    Of the positive ones those with the smallest draws, up to ``foreground`` of ``rois``, then negative ones up to ``rois``. Each task keeps the
    smallest of each image and label (see :func:`bottom_k`) before anything is shuffled.
    """
    rows = label_anchors(images, lattice).where("label >= 0").select("image_id", "label", "anchor_idx", "gt_idx")
    key = F.pmod(F.col("image_id") * 1000003 + F.col("anchor_idx"), F.lit(2**31 - 1))
    rows = with_draws(rows.withColumn("_row", key), "_row", seed, {"_u": 5}).drop("_row") if shuffle else rows.withColumn("_u", F.lit(0).cast("long"))
    few = bottom_k(rows, ["image_id", "label"], ["_u", "anchor_idx"], rois, by=["image_id"])
    few = few.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("label", "_u", "anchor_idx", "gt_idx"))).alias("_few"))
    of = lambda label: F.filter("_few", lambda a: a["label"] == label)
    some = F.slice(of(1), 1, int(foreground * rois)) if int(foreground * rois) else F.slice(of(1), 1, 0)
    few = few.withColumn("_fg", some).withColumn("_few", F.concat("_fg", F.slice(of(0), F.lit(1), F.lit(rois) - F.size("_fg"))))
    out = few.join(images.select("image_id", "gts"), "image_id")
    one = lambda a, g: F.struct(a["anchor_idx"].alias("anchor_idx"), a["label"].alias("label"), *(c.alias(n) for n, c in _target(lattice, a["anchor_idx"], g).items()))
    cells = F.transform("_few", lambda a: F.get(F.transform(F.array(_box(F.col("gts"), a["gt_idx"])), lambda g: one(a, g)), 0))
    return out.select("image_id", F.array_sort(cells).alias("sample"))


SAMPLE = "array<struct<anchor_idx: bigint, label: int, dx: double, dy: double, dw: double, dh: double>>"


def planes(images: DataFrame, lattice: Lattice, keep: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """The loader's layout per image: bbtargets, bbtargets_mask (4A), labels_flat and labels_mask (2A).

    ``sample`` (null: none) is sparse; it is expanded by its places in its own row, stretches of zeros at a time.
    """
    n = lattice.count
    cells = F.coalesce(F.col("sample"), F.array().cast(SAMPLE))

    def spread(value, zero):
        """Values at the places of the sample, zeros elsewhere."""
        before = lambda i: F.when(i > 0, F.get(cells, i - 1)["anchor_idx"].cast("int") + 1).otherwise(0)
        parts = F.transform(cells, lambda x, i: F.concat(F.array_repeat(zero, x["anchor_idx"].cast("int") - before(i)), F.array(value(x))))
        last = F.coalesce(F.get(cells, F.size(cells) - 1)["anchor_idx"].cast("int"), F.lit(-1))
        return F.concat(F.flatten(parts), F.array_repeat(zero, F.lit(n - 1) - last))

    none, no = F.lit(0.0).cast("float"), F.lit(0)
    side = lambda k: spread(lambda x: F.when(x["label"] == 1, x[k]).otherwise(0.0).cast("float"), none)
    df = images.withColumns({"_on": spread(lambda x: (x["label"] == 1).cast("float"), none), "_used": spread(lambda x: (x["label"] >= 0).cast("int"), no)})
    return df.select(
        *keep,
        F.concat(*(side(k) for k in ("dx", "dy", "dw", "dh"))).alias("bbtargets"),
        F.concat("_on", "_on", "_on", "_on").alias("bbtargets_mask"),
        F.concat(spread(lambda x: (x["label"] == 0).cast("int"), no), spread(lambda x: (x["label"] == 1).cast("int"), no)).alias("labels_flat"),
        F.concat("_used", "_used").alias("labels_mask"),
    )


def padded_boxes(boxes: DataFrame, max_boxes: int = 64) -> DataFrame:
    """Per image: gt_boxes (4 numbers each), gt_box_count, gt_class_count (class ids) and difficult_flag, zero padded."""
    cells = F.slice(F.array_sort(F.collect_list(F.struct("gt_idx", "xmin", "ymin", "xmax", "ymax", "label", "difficult"))), 1, max_boxes)
    rows = boxes.groupBy("image_id").agg(cells.alias("c"))
    fill = lambda a, n, zero: F.slice(F.concat(a, F.array_repeat(zero, n)), 1, n)
    sides = F.flatten(F.transform("c", lambda x: F.array(x["xmin"], x["ymin"], x["xmax"], x["ymax"]).cast("array<float>")))
    return rows.select(
        "image_id",
        fill(sides, 4 * max_boxes, F.lit(0.0).cast("float")).alias("gt_boxes"),
        F.size("c").alias("gt_box_count"),
        fill(F.transform("c", lambda x: x["label"].cast("int")), max_boxes, F.lit(0)).alias("gt_class_count"),
        fill(F.transform("c", lambda x: x["difficult"].cast("int")), max_boxes, F.lit(0)).alias("difficult_flag"),
    )

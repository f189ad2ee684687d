"""Box algebra as Column expressions. A box is a struct (or mapping) of xmin, ymin, xmax, ymax.

Pixel boxes are inclusive, so their width is xmax - xmin + 1; normalised boxes lie in [0, 1] and have width xmax - xmin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5


@dataclass(frozen=True)
class Box:
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column
    pixel: bool = True

    @classmethod
    def of(cls, struct, pixel: bool = True) -> Box:
        return cls(struct["xmin"], struct["ymin"], struct["xmax"], struct["ymax"], pixel)

    @classmethod
    def cols(cls, *names: str, pixel: bool = True) -> Box:
        return cls(*(F.col(n) for n in names), pixel)

    def struct(self, *more: Column) -> Column:
        return F.struct(self.xmin.alias("xmin"), self.ymin.alias("ymin"), self.xmax.alias("xmax"), self.ymax.alias("ymax"), *more)

    @property
    def width(self) -> Column:
        return self.xmax - self.xmin + (1 if self.pixel else 0)

    @property
    def height(self) -> Column:
        return self.ymax - self.ymin + (1 if self.pixel else 0)

    @property
    def size(self) -> Column:
        return F.when((self.xmax < self.xmin) | (self.ymax < self.ymin), 0).otherwise(self.width * self.height)

    @property
    def center(self) -> tuple[Column, Column]:
        return self.xmin + (self.xmax - self.xmin) / 2, self.ymin + (self.ymax - self.ymin) / 2

    def intersect(self, o: Box) -> Box:
        apart = (o.xmin > self.xmax) | (o.xmax < self.xmin) | (o.ymin > self.ymax) | (o.ymax < self.ymin)
        none = -1 if self.pixel else 0
        pick = lambda empty, x: F.when(apart, empty).otherwise(x)
        return Box(pick(0, F.greatest(self.xmin, o.xmin)), pick(0, F.greatest(self.ymin, o.ymin)), pick(none, F.least(self.xmax, o.xmax)), pick(none, F.least(self.ymax, o.ymax)), self.pixel)

    def jaccard(self, o: Box) -> Column:
        shared = self.intersect(o).size
        return F.when(shared == 0, F.lit(0.0)).otherwise(shared / (self.size + o.size - shared))

    def coverage(self, o: Box) -> Column:
        """Share of this box that the other covers."""
        shared = self.intersect(o).size
        return F.when(shared == 0, F.lit(0.0)).otherwise(shared / self.size)

    def rescale(self, x, y) -> Box:
        return Box(self.xmin * x, self.ymin * y, (self.xmax + 1) * x - 1, (self.ymax + 1) * y - 1, self.pixel)

    def translate(self, x, y) -> Box:
        return Box(self.xmin + x, self.ymin + y, self.xmax + x, self.ymax + y, self.pixel)

    def scale(self, x, y) -> Box:
        return Box(self.xmin * x, self.ymin * y, self.xmax * x, self.ymax * y, self.pixel)

    def add(self, o: Box) -> Box:
        return Box(self.xmin + o.xmin, self.ymin + o.ymin, self.xmax + o.xmax, self.ymax + o.ymax, self.pixel)

    def expand(self, dx, dy, width, height) -> Box:
        """The box on a larger canvas; one that would leave the canvas is an error."""
        out = self.translate(dx, dy)
        bad = (out.xmax > width) | (out.ymax > height)
        check = lambda x: F.when(bad, F.raise_error(F.lit("a box would leave the canvas")).cast("double")).otherwise(x)
        return Box(check(out.xmin), out.ymin, out.xmax, out.ymax, self.pixel)

    def normalize(self, width, height) -> Box:
        return Box(self.xmin / width, self.ymin / height, (self.xmax + 1) / width, (self.ymax + 1) / height, False)

    def is_normal(self) -> Column:
        """All sides in [0, 1], to within EPS."""
        sides = (self.xmin, self.ymin, self.xmax, self.ymax)
        ok = [(s > -EPS) & (s < 1 + EPS) for s in sides]
        return ok[0] & ok[1] & ok[2] & ok[3]

    def unnormalize(self, width, height) -> Box:
        return Box(self.xmin * width, self.ymin * height, self.xmax * width - 1, self.ymax * height - 1, True)

    def rect(self) -> tuple[Column, Column, Column, Column]:
        """x, y, width, height, rounded half away from zero."""
        return F.round(self.xmin), F.round(self.ymin), F.round(self.width), F.round(self.height)

    def equals(self, o: Box) -> Column:
        near = [F.abs(a - b) < EPS for a, b in ((self.xmin, o.xmin), (self.ymin, o.ymin), (self.xmax, o.xmax), (self.ymax, o.ymax))]
        return near[0] & near[1] & near[2] & near[3]


def emit(box: Box, crop: dict, kind: str = "", min_overlap: float = 0.0) -> Column:
    """Whether a crop keeps a box: by its centre, by the share that is left, or always."""
    x, y, w, h = (crop[k] for k in ("x", "y", "width", "height"))
    if kind == "center":
        cx, cy = box.center
        return (cx >= x) & (cx <= x + w - 1) & (cy >= y) & (cy <= y + h - 1)
    if kind == "min_overlap":
        return box.coverage(Box(x, y, x + w - 1, y + h - 1)) >= min_overlap
    if kind:
        raise ValueError(f"emit_constraint_type {kind!r} is not known")
    return F.lit(True)


def transform_box(box: Box, crop: dict, flip, out_width, out_height, expand: dict | None = None, kind: str = "", min_overlap: float = 0.0):
    """(keep, box): expand, emit filter, cut to the crop, flip, rescale to the output size."""
    if expand:
        box = box.expand(expand["dx"], expand["dy"], expand["width"], expand["height"])
    x, y, w, h = (crop[k] for k in ("x", "y", "width", "height"))
    keep = emit(box, crop, kind, min_overlap)
    keep = keep & ~((box.xmax < x) | (box.xmin >= x + w) | (box.ymax < y) | (box.ymin >= y + h))
    low = lambda v, at: F.greatest(v - at, F.lit(0))
    high = lambda v, at, n: F.when(v >= at + n, n - 1).otherwise(v - at)
    xmin, xmax, ymin, ymax = low(box.xmin, x), high(box.xmax, x, w), low(box.ymin, y), high(box.ymax, y, h)
    left, right = F.when(flip, w - xmax - 1).otherwise(xmin), F.when(flip, w - xmin - 1).otherwise(xmax)
    return keep, Box(left, ymin, right, ymax).rescale(out_width / w, out_height / h)


def calculate_scale(w, h, out_w, out_h) -> Column:
    """Largest factor at which a size still fits the output."""
    return F.least(out_w / w, out_h / h)


def cropbox_max_proportional(w, h, out_w, out_h) -> tuple[Column, Column]:
    """Largest size in (w, h) with the proportions of the output."""
    fit = F.least(w / out_w, h / out_h)
    return out_w * fit, out_h * fit


def cropbox_linear_scale(w, h, s) -> tuple[Column, Column]:
    return w * s, h * s


def cropbox_area_scale(w, h, crop_w, crop_h, s) -> tuple[Column, Column]:
    """The crop scaled to a share of the input's area, and no larger than the crop was."""
    factor = F.least(F.sqrt(w * h * s / (crop_w * crop_h)), F.lit(1.0))
    return crop_w * factor, crop_h * factor


def cropbox_shift(w, h, crop_w, crop_h, xoff, yoff) -> tuple[Column, Column]:
    """Origin of a crop at relative offsets, cut to whole pixels."""
    return F.floor((w - crop_w) * xoff), F.floor((h - crop_h) * yoff)


def resized_short_size(w, h, target) -> tuple[Column, Column]:
    short = F.least(w, h)
    return F.round(w * target / short), F.round(h * target / short)

"""One augmentation draw per record as a struct of deterministic columns, so that image, mask and boxes agree.

Every number comes from (seed, record, draw); draws have fixed numbers, so a plan that is computed twice gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as B
from ..functions.prng import M, draws_of, unit, with_draws

DRAWS = {n: 10 + i for i, n in enumerate("angle flip hue contrast brightness saturation scale distortion xoff yoff pad_x pad_y light_0a light_0b light_1a light_1b light_2a light_2b expand expand_ratio expand_x expand_y".split())}


@dataclass
class Augmentation:
    """Ranges are (low, high); a range of one value is that value."""

    scale: tuple[float, float] = (1.0, 1.0)
    angle: tuple[int, int] = (0, 0)
    lighting: tuple[float, float] = (0.0, 0.0)
    horizontal_distortion: tuple[float, float] = (1.0, 1.0)
    contrast: tuple[float, float] = (1.0, 1.0)
    brightness: tuple[float, float] = (1.0, 1.0)
    saturation: tuple[float, float] = (1.0, 1.0)
    hue: tuple[int, int] = (0, 0)
    expand_ratio: tuple[float, float] = (1.0, 1.0)
    expand_probability: float = 0.0
    flip_enable: bool = False
    center: bool = True
    do_area_scale: bool = False
    crop_enable: bool = True
    fixed_aspect_ratio: bool = False
    fixed_scaling_factor: float = -1.0
    resize_short_size: int = 0
    interpolation_method: str = "LINEAR"
    padding: int = 0
    mean: list[float] = field(default_factory=list)
    stddev: list[float] = field(default_factory=list)
    emit_constraint_type: str = ""
    emit_constraint_min_overlap: float = 0.0
    batch_samplers: list[dict] = field(default_factory=list)
    debug_output_directory: str = ""


def _real(draw: str, r) -> Column:
    return F.lit(float(r[0])) + unit(F.col(draw)) * float(r[1] - r[0])


def _int(draw: str, r) -> Column:
    return (F.lit(int(r[0])) + F.floor(unit(F.col(draw)) * (int(r[1]) - int(r[0]) + 1))).cast("int")


def _normal(draw: str, mean: float, sd: float) -> Column:
    return F.lit(mean) + sd * F.sqrt(-2 * F.log((F.col(f"{draw}a") + 1) / F.lit(2147483648.0))) * F.cos(unit(F.col(f"{draw}b")) * 6.283185307179586)


def with_augmentation(df: DataFrame, cfg: Augmentation, seed: int, in_w: Column, in_h: Column, out_w: int, out_h: int, row: str = "row_idx", ssd: bool = False) -> DataFrame:
    """Adds ``aug``: angle, flip, colour factors, lighting, crop (x, y, width, height), output size, padding, expand.

    ``ssd`` adds the draw that enlarges the canvas first.
    """
    if cfg.padding > 0 and cfg.crop_enable and not cfg.do_area_scale:
        raise ValueError("crop_enable should not be true: when padding is defined, crop is executed by default with cropbox size equal to input image size")
    df = with_draws(df, row, seed, {f"_{k}": v for k, v in DRAWS.items()})
    half = (0.5, 0.5) if cfg.center else (0.0, 1.0)
    xoff, yoff = _real("_xoff", half), _real("_yoff", half)
    w, h = in_w.cast("double"), in_h.cast("double")
    zero = F.lit(0.0)
    if not cfg.crop_enable:
        s = F.lit(cfg.fixed_scaling_factor) if cfg.fixed_scaling_factor > 0 else B.calculate_scale(w, h, F.lit(float(out_w)), F.lit(float(out_h)))
        crop, out = (zero, zero, w, h), (F.rint(w * s), F.rint(h * s))
    elif cfg.do_area_scale:
        d = F.sqrt(_real("_distortion", cfg.horizontal_distortion))
        bound = F.least(w / h / (d * d), h / w * (d * d))
        low, high = F.least(F.lit(cfg.scale[0]), bound), F.least(F.lit(cfg.scale[1]), bound)
        side = F.sqrt(w * h * (low + unit(F.col("_scale")) * (high - low)))
        cw, ch = d * side, side / d
        crop, out = (*B.cropbox_shift(w, h, cw, ch, xoff, yoff), cw, ch), (F.lit(float(out_w)), F.lit(float(out_h)))
    else:
        if cfg.resize_short_size > 0:
            w, h = B.resized_short_size(w, h, cfg.resize_short_size)
        cw, ch = B.cropbox_max_proportional(w, h, out_w * _real("_distortion", cfg.horizontal_distortion), F.lit(float(out_h)))
        cw, ch = B.cropbox_linear_scale(cw, ch, _real("_scale", cfg.scale))
        crop, out = (*B.cropbox_shift(w, h, cw, ch, xoff, yoff), cw, ch), (F.lit(float(out_w)), F.lit(float(out_h)))
    fields = {
        "angle": _int("_angle", cfg.angle), "flip": (unit(F.col("_flip")) < 0.5) & F.lit(cfg.flip_enable), "hue": _int("_hue", cfg.hue),
        "contrast": _real("_contrast", cfg.contrast), "brightness": _real("_brightness", cfg.brightness), "saturation": _real("_saturation", cfg.saturation),
        "lighting": F.array(*(_normal(f"_light_{i}", *cfg.lighting) for i in range(3))) if cfg.lighting[1] else F.array().cast("array<double>"),
        "pad_x": _int("_pad_x", (0, 2 * cfg.padding)), "pad_y": _int("_pad_y", (0, 2 * cfg.padding)),
        "crop_x": crop[0].cast("int"), "crop_y": crop[1].cast("int"), "crop_width": F.floor(crop[2]).cast("int"), "crop_height": F.floor(crop[3]).cast("int"),
        "out_width": out[0].cast("int"), "out_height": out[1].cast("int"),
    }
    if ssd:
        on = unit(F.col("_expand")) < cfg.expand_probability
        ratio = F.when(on, _real("_expand_ratio", cfg.expand_ratio)).otherwise(1.0)
        ew, eh = F.floor(w * ratio), F.floor(h * ratio)
        fields |= {"expand_ratio": ratio, "expand_width": ew.cast("int"), "expand_height": eh.cast("int"), "expand_x": F.floor(unit(F.col("_expand_x")) * (w * ratio - w)).cast("int"), "expand_y": F.floor(unit(F.col("_expand_y")) * (h * ratio - h)).cast("int")}
    return df.withColumn("aug", F.struct(*(c.alias(n) for n, c in fields.items()))).drop(*(f"_{k}" for k in DRAWS))


def sampler_patches(images: DataFrame, samplers: list[dict], seed: int, row: str = "image_id") -> DataFrame:
    """All trial patches of all samplers: (image, sampler, trial, xmin, ymin, xmax, ymax), normalised.

    Trials come from a generated range in the image's own row, so nothing is joined.
    """
    out = None
    for k, s in enumerate(samplers):
        own = s.get("sampler") or {}
        (s0, s1), (a0, a1) = own.get("scale", (1.0, 1.0)), own.get("aspect_ratio", (1.0, 1.0))
        t = images.withColumn("sampler", F.lit(k)).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(int(s.get("max_trials", 100)) - 1))))
        t = t.withColumn("_row", F.pmod(F.col(row) * 7919 + F.lit(k * 1009) + F.col("trial"), F.lit(2**31 - 1)))
        t = with_draws(t, "_row", seed, {"_s": 40, "_a": 41, "_x": 42, "_y": 43})
        t = t.withColumn("_scale", _real("_s", (s0, s1)))
        low, high = F.greatest(F.lit(float(a0)), F.col("_scale") * F.col("_scale")), F.least(F.lit(float(a1)), 1 / (F.col("_scale") * F.col("_scale")))
        t = t.withColumn("_aspect", low + unit(F.col("_a")) * (high - low))
        t = t.withColumn("_w", F.col("_scale") * F.sqrt("_aspect")).withColumn("_h", F.col("_scale") / F.sqrt("_aspect"))
        t = t.withColumn("xmin", unit(F.col("_x")) * (1 - F.col("_w"))).withColumn("ymin", unit(F.col("_y")) * (1 - F.col("_h")))
        t = t.withColumns({"xmax": F.col("xmin") + F.col("_w"), "ymax": F.col("ymin") + F.col("_h")}).drop("_row", "_s", "_a", "_x", "_y", "_scale", "_aspect", "_w", "_h")
        out = t if out is None else out.unionByName(t)
    return out


_GROUPS = (("jaccard_overlap", lambda p, o: p.jaccard(o)), ("sample_coverage", lambda p, o: p.coverage(o)), ("object_coverage", lambda p, o: o.coverage(p)))


def _within(patch: B.Box, measure, low, high):
    def test(o):
        m = measure(patch, B.Box.of(o, pixel=False))
        return (m >= low if low is not None else F.lit(True)) & (m <= high if high is not None else F.lit(True))

    return test


def satisfies(patch: B.Box, objects: Column, constraint: dict, mode: str = "first") -> Column:
    """Whether a patch meets a sample constraint for some object (an array of normalised boxes).

    ``first``: only the first configured group of limits counts. ``any``: one group of any is enough. Without limits
    every patch does.
    """
    tests = []
    for name, measure in _GROUPS:
        low, high = constraint.get(f"min_{name}"), constraint.get(f"max_{name}")
        if low is None and high is None:
            continue
        tests.append(F.exists(objects, _within(patch, measure, low, high)))
    if not tests:
        return F.lit(True)
    if mode == "first":
        return tests[0]
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def _trials(rows: np.ndarray, k: int, s: dict, seed: int) -> list[np.ndarray]:
    """xmin, ymin, xmax, ymax of the patches that :func:`sampler_patches` gives, a line per trial."""
    own = s.get("sampler") or {}
    (s0, s1), (a0, a1) = own.get("scale", (1.0, 1.0)), own.get("aspect_ratio", (1.0, 1.0))
    at = (rows % M * 7919 + k * 1009 + np.arange(int(s.get("max_trials", 100)))[:, None]) % M
    u = [draws_of(at, seed, d) / float(M) for d in (40, 41, 42, 43)]
    scale = float(s0) + u[0] * float(s1 - s0)
    low, high = np.maximum(float(a0), scale * scale), np.minimum(float(a1), 1 / (scale * scale))
    root = np.sqrt(low + u[1] * (high - low))
    w, h = scale * root, scale / root
    x, y = u[2] * (1 - w), u[3] * (1 - h)
    return [x, y, x + w, y + h]


class _Objects:
    """The objects of a batch of images, with what :func:`satisfies` says of them: nan is greater than all, and an unknown side limits nothing."""

    def __init__(self, column: pa.Array):
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        raw = [pc.struct_field(flat, c).cast(pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")]
        self.image, self.n, self.missing = np.repeat(np.arange(len(n)), n), len(n), column.is_null().to_numpy(zero_copy_only=False)
        xmin, ymin, xmax, ymax = (c.to_numpy(zero_copy_only=False) for c in raw)
        self.size = np.where((xmax < xmin) | (ymax < ymin), 0.0, (xmax - xmin) * (ymax - ymin))
        self.unknown = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in raw], axis=0)
        ends = (-np.inf, -np.inf, np.inf, np.inf)
        self.sides = [np.where(np.isnan(v), np.inf, v) for v in (c.fill_null(e).to_numpy(zero_copy_only=False) for c, e in zip(raw, ends))]

    def meets(self, patch: list[np.ndarray], constraint: dict, mode: str) -> tuple[np.ndarray, np.ndarray]:
        """For a patch of each image: whether it meets the constraint, and whether that is unknown."""
        limits = [(g, constraint.get(f"min_{g}"), constraint.get(f"max_{g}")) for g, _ in _GROUPS]
        limits = [x for x in limits if x[1:] != (None, None)][: 1 if mode == "first" else None]
        if not limits:
            return np.ones(self.n, bool), np.zeros(self.n, bool)
        x0, y0, x1, y1 = (side[self.image] for side in patch)
        w, h = np.minimum(x1, self.sides[2]) - np.maximum(x0, self.sides[0]), np.minimum(y1, self.sides[3]) - np.maximum(y0, self.sides[1])
        shared = np.where((w < 0) | (h < 0), 0.0, w * h)
        whole = (x1 - x0) * (y1 - y0)
        yes, unknown = np.zeros(self.n, bool), self.missing.copy()
        for group, low, high in limits:
            by = {"jaccard_overlap": whole + self.size - shared, "sample_coverage": whole, "object_coverage": self.size}[group]
            m = np.where(shared == 0, 0.0, shared / by)
            never = np.zeros(len(m), bool) if group == "sample_coverage" else self.unknown & (shared != 0)
            good = ~never & ((m >= low) | np.isnan(m) if low is not None else True) & (m <= high if high is not None else True)
            yes[self.image[good]] = True
            unknown[self.image[never]] = True
        return yes, unknown & ~yes


def _tested(samplers: list[dict], seed: int, mode: str, batches):
    """For some images at a time: their columns, and per sampler the sides of its trials, whether they meet its constraint, and whether that is unknown."""
    total = sum(int(s.get("max_trials", 100)) for s in samplers)
    for whole in batches:
        for start in range(0, whole.num_rows, step := max(1, CELLS // max(total, 1))):
            b = whole.slice(start, step)
            rows, objects, found = b.column(0).cast(pa.int64()), _Objects(b.column(1)), []
            known = rows.is_valid().to_numpy(zero_copy_only=False)
            for k, s in enumerate(samplers):
                with np.errstate(all="ignore"):
                    sides = _trials(rows.fill_null(0).to_numpy(), k, s, seed)
                    tests = [objects.meets([side[t] for side in sides], s.get("sample_constraint") or {}, mode) for t in range(len(sides[0]))]
                yes, unknown = (np.array([t[i] for t in tests]).reshape(sides[0].shape) for i in (0, 1))
                found.append((sides, yes & known, unknown | ~known))
            yield b, found


CELLS = 1 << 19  # trials of images that a task has at a time
_SIDES = ("xmin", "ymin", "xmax", "ymax")


def _schema(images: DataFrame, row: str, *more: T.StructField) -> T.StructType:
    own = [T.StructField("sampler", T.IntegerType()), T.StructField("trial", T.IntegerType())]
    return T.StructType([images.schema[row], *own, *(T.StructField(c, T.DoubleType()) for c in _SIDES), *more])


def tested_patches(images: DataFrame, samplers: list[dict], seed: int, row: str = "image_id", objects: str = "objects", mode: str = "first") -> DataFrame:
    """:func:`sampler_patches` of images with arrays of objects, and ``meets``: what :func:`satisfies` says of each patch.

    Trials and tests are arrays over a batch of images, so nothing is shuffled. An image without a number has patches without sides.
    """

    def run(batches):
        for b, found in _tested(samplers, seed, mode, batches):
            for k, (sides, yes, unknown) in enumerate(found):
                trials, n = yes.shape
                lost = np.repeat(b.column(0).is_null().to_numpy(zero_copy_only=False), trials)
                own = [b.column(0).take(pa.array(np.repeat(np.arange(n), trials))), pa.array(np.full(n * trials, k, "i4")), pa.array(np.tile(np.arange(trials, dtype="i4"), n))]
                own += [pa.array(side.T.ravel(), mask=lost) for side in sides]
                free = not any(v is not None for v in (samplers[k].get("sample_constraint") or {}).values())
                meets = pa.array(np.ones(n * trials, bool)) if free else pa.array(yes.T.ravel(), mask=unknown.T.ravel())
                yield pa.RecordBatch.from_arrays([*own, meets], [row, "sampler", "trial", *_SIDES, "meets"])

    return images.select(row, objects).mapInArrow(run, _schema(images, row, T.StructField("meets", T.BooleanType())))


def batch_samples(images: DataFrame, samplers: list[dict], seed: int, row: str = "image_id", objects: str = "objects", mode: str = "first") -> DataFrame:
    """One patch per image: of each sampler's patches that satisfy it the first ``max_sample``; one of all, or the frame.

    Trials and tests are arrays over a batch of images, so nothing is shuffled.
    """

    def run(batches):
        for b, found in _tested(samplers, seed, mode, batches):
            kept, n = [], b.num_rows
            for s, (_, yes, _) in zip(samplers, found):
                most = int(s.get("max_sample", -1))
                kept.append(yes & (np.cumsum(yes, axis=0) <= most) if most >= 0 else yes)
            kept = np.concatenate([np.zeros((0, n), bool), *kept])
            about = np.array([(k, t) for k, f in enumerate(found) for t in range(len(f[1]))], "i4").reshape(-1, 2)
            count = kept.sum(axis=0)
            pick = np.floor(b.column(2).fill_null(0).to_numpy() / float(M) * count).astype("i8")
            some = count > 0
            at = (np.cumsum(kept, axis=0) == pick + 1).argmax(axis=0) if len(kept) else np.zeros(n, "i8")
            out = [b.column(0)]
            out += [pa.array(np.where(some, about[at, i] if len(about) else -1, -1).astype("i4")) for i in (0, 1)]
            for i, frame in enumerate((0.0, 0.0, 1.0, 1.0)):
                out.append(pa.array(np.where(some, np.concatenate([f[0][i] for f in found])[at, np.arange(n)] if found else frame, frame)))
            yield pa.RecordBatch.from_arrays(out, [row, "sampler", "trial", *_SIDES])

    drawn = with_draws(images.select(row, objects), row, seed, {"_pick": 44})
    return drawn.mapInArrow(run, _schema(images, row))

"""Providers: what each kind of element becomes, as fixed-shape, named columns of one record.

Text, label, blob and box providers are Column expressions; pixel kinds run as one Arrow kernel over the record. All
share the record's ``aug`` struct.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import boxes as B
from ..functions import text as X
from ..functions.text import OTYPES, otype
from ..functions.text import column_name as public_name
from ..operators import pixels
from ..operators.augment import Augmentation
from ..sources.annotations import parse_annotations
from ..sources.containers import decode_image, image_size, read_avi_frames, write_png
from . import config

NUMPY = {"int8_t": "i1", "uint8_t": "u1", "int16_t": "i2", "uint16_t": "u2", "int32_t": "i4", "uint32_t": "u4", "float": "f4", "double": "f8", "char": "i1"}


def inner_name(name: str) -> str:
    """A column's name inside the plan: Arrow kernels resolve dots as fields."""
    return name.replace(".", "\u00b7")


def column_name(base: str, name: str | None) -> str:
    return inner_name(public_name(base, name))


Columns = list[tuple[str, tuple[int, ...], str, tuple[str, ...]]]


def _columns(cfg: dict[str, Any], *spec) -> Columns:
    """(name, shape, output type, axis names) from (base name, shape, output type[, axis names])."""
    return [(public_name(base, cfg.get("name") or None), tuple(shape), kind, tuple(axes[0]) if axes else tuple(map(str, range(len(shape))))) for base, shape, kind, *axes in spec]


def _picture_columns(kind: str):
    def columns(cfg):
        c, h, w = cfg["channels"], cfg["height"], cfg["width"]
        layout = ((c, h, w), ("channels", "height", "width")) if cfg["channel_major"] else ((h, w, c), ("height", "width", "channels"))
        return _columns(cfg, (kind, layout[0], cfg["output_type"], layout[1]))

    return columns


def _char_map_columns(cfg):
    length = [("char_map_length", (1,), "uint32_t")] if cfg["emit_length"] else []
    return _columns(cfg, ("char_map", (1, cfg["max_length"]), "uint32_t", ("character", "sequence")), *length)


def _video_columns(cfg):
    f = cfg["frame"]
    shape = f.get("channels", 3), cfg["max_frame_count"], f["height"], f["width"]
    return _columns(cfg, ("video", shape, f.get("output_type", "uint8_t"), ("channels", "frames", "height", "width")))


def _ssd_columns(cfg):
    m = cfg["max_gt_boxes"]
    return _columns(cfg, ("image_shape", (2, 1), "int32_t"), ("gt_boxes", (m, 4), "float"), ("gt_box_count", (1, 1), "int32_t"), ("gt_class_count", (m, 1), "int32_t"), ("difficult_flag", (m, 1), "int32_t"))


def _rcnn_columns(cfg):
    m, a = cfg["max_gt_boxes"], len(cfg["ratios"]) * len(cfg["scales"]) * int(cfg["height"] * cfg["scaling_factor"]) * int(cfg["width"] * cfg["scaling_factor"])
    planes = [("bbtargets", (4 * a,), "float"), ("bbtargets_mask", (4 * a,), "float"), ("labels_flat", (1, 2 * a), "int32_t"), ("labels_mask", (2 * a, 1), "int32_t")]
    boxes = [("image_shape", (2, 1), "int32_t"), ("gt_boxes", (m, 4), "float"), ("gt_box_count", (1, 1), "int32_t"), ("gt_class_count", (m, 1), "int32_t"), ("image_scale", (1, 1), "float"), ("difficult_flag", (m, 1), "int32_t")]
    return _columns(cfg, *planes, *boxes)


@dataclass(frozen=True)
class Provider:
    """What a type of element becomes.

    ``columns`` says from a checked configuration what a record gets, before any data is read. ``add`` takes (df, configuration, column of
    the element, augmentation) and adds these columns, under :func:`inner_name`, as arrays; a record that it cannot read gets
    ``_error``. A ``picture``'s size starts the shared draw; a ``boxed`` one follows it; ``joined`` ones are added by the loader itself,
    before anything is decoded.
    """

    columns: Callable[[dict[str, Any]], Columns]
    add: Callable[[DataFrame, dict[str, Any], str, Augmentation], DataFrame] | None = None
    picture: bool = False
    boxed: bool = False
    joined: bool = False


REGISTRY: dict[str, Provider] = {}


def register(name: str, provider: Provider, keys: dict[str, config.Key] | None = None) -> None:
    """Makes ``name`` a type of the etl list. ``keys`` are what its configuration may hold, each with default, converter and check."""
    if name in REGISTRY:
        raise ValueError(f"there is a provider '{name}' already")
    if keys is not None:
        config.PROVIDERS[name] = {"name": config.Key("", str)} | keys
    if name not in config.PROVIDERS:
        raise ValueError(f"provider '{name}' has no keys")
    REGISTRY[name] = provider


def unregister(name: str) -> None:
    del REGISTRY[name], config.PROVIDERS[name]


def shapes(kind: str, cfg: dict[str, Any]) -> Columns:
    """(column, shape, output type, axis names) of a provider, in order, known before any data is read."""
    return REGISTRY[kind].columns(cfg)


def _array(value: Column, kind: str) -> Column:
    return value.cast(f"array<{otype(kind)}>")


def text_provider(kind: str, cfg: dict[str, Any], element: Column) -> dict[str, Column]:
    """Columns of the providers that need no pixels or boxes; a value that cannot be read is null."""
    text = element.cast("string")
    name = cfg.get("name") or None
    if kind == "label":
        value = X.label_binary(element.cast("binary")) if cfg["binary"] else X.label_text(text)
        return {column_name("label", name): F.when(value.isNotNull(), _array(F.array(value), cfg["output_type"]))}
    if kind == "label_map":
        ids = X.label_map(text, cfg["class_names"])
        return {column_name("label_map", name): _array(X.pad(ids, cfg["max_classes"], F.lit(0)), "uint32_t")}
    if kind == "char_map":
        out = {column_name("char_map", name): _array(X.char_map(text, cfg["alphabet"], cfg["max_length"], cfg["unknown_value"]), "uint32_t")}
        if cfg["emit_length"]:
            out[column_name("char_map_length", name)] = _array(F.array(X.char_map_length(text, cfg["max_length"])), "uint32_t")
        return out
    raise ValueError(f"unsupported etl type '{kind}'")


def add_blob(df: DataFrame, cfg: dict[str, Any], element: str) -> DataFrame:
    """Raw bytes as ``output_count`` numbers; another number of bytes is null with an error."""
    dtype, n, out = np.dtype("<" + NUMPY[cfg["output_type"]]), cfg["output_count"], column_name("blob", cfg.get("name") or None)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T._parse_datatype_string(otype(cfg["output_type"]))))])

    def run(batches):
        kind = schema[out].dataType.elementType
        np_kind = {"tinyint": "i1", "smallint": "i2", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}[kind.simpleString()]
        for b in batches:
            values, errors = [], b.column("_error").to_pylist()
            for i, raw in enumerate(b.column(element).to_pylist()):
                good = raw is not None and len(raw) == n * dtype.itemsize
                values.append(np.frombuffer(raw, dtype).astype(np_kind) if good else None)
                errors[i] = errors[i] if good else errors[i] or f"blob has {len(raw or b'')} bytes, not {n * dtype.itemsize}"
            cols = [pa.array(errors, pa.string()) if c == "_error" else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(values, pa.list_(pa.from_numpy_dtype(np_kind)))], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def _aug_crop() -> dict:
    a = F.col("aug")
    return {"x": a["crop_x"].cast("double"), "y": a["crop_y"].cast("double"), "width": a["crop_width"].cast("double"), "height": a["crop_height"].cast("double")}


def transformed_boxes(boxes: Column, aug: Augmentation, expanded: bool) -> Column:
    """An array of boxes through the record's augmentation."""
    a = F.col("aug")
    grow = {"dx": a["expand_x"], "dy": a["expand_y"], "width": a["expand_width"], "height": a["expand_height"]} if expanded else None

    def one(b):
        keep, out = B.transform_box(B.Box.of(b), _aug_crop(), a["flip"], a["out_width"], a["out_height"], grow, aug.emit_constraint_type, aug.emit_constraint_min_overlap)
        return F.struct(keep.alias("keep"), out.struct(b["label"].alias("label"), b["difficult"].alias("difficult")).alias("box"))

    return F.transform(F.filter(F.transform(boxes, one), lambda x: x["keep"]), lambda x: x["box"])


def box_columns(kind: str, cfg: dict[str, Any], boxes: Column, aug: Augmentation) -> dict[str, Column]:
    """Columns of a box provider from its annotation's boxes. Rotated records have no boxes: null."""
    name = cfg.get("name") or None
    a = F.col("aug")
    moved = transformed_boxes(boxes, aug, kind == "localization_ssd")
    m = cfg["max_bbox_count"] if kind == "boundingbox" else cfg["max_gt_boxes"]
    zero = F.lit(0.0).cast("float")
    fill = lambda v, n, z: F.slice(F.concat(v, F.array_repeat(z, n)), 1, n)
    sides = lambda v: F.flatten(F.transform(v, lambda b: F.array(b["xmin"], b["ymin"], b["xmax"], b["ymax"]).cast("array<float>")))
    if kind == "boundingbox":
        return {column_name(kind, name): F.when(a["angle"] == 0, fill(sides(moved), 4 * m, zero))}
    w, h = a["out_width"].cast("double"), a["out_height"].cast("double")
    normal = F.transform(moved, lambda b: B.Box.of(b).normalize(w, h).struct())
    ints = lambda field: fill(F.transform(F.slice(moved, 1, m), lambda b: b[field].cast("int")), m, F.lit(0))
    return {
        column_name("image_shape", name): F.array(a["out_width"], a["out_height"]),
        column_name("gt_boxes", name): fill(sides(normal), 4 * m, zero),
        column_name("gt_box_count", name): F.array(F.least(F.size(moved), F.lit(m))),
        column_name("gt_class_count", name): ints("label"),
        column_name("difficult_flag", name): ints("difficult"),
    }


def add_boxes(df: DataFrame, kind: str, cfg: dict[str, Any], element: str, aug: Augmentation) -> DataFrame:
    """Adds a box provider's columns from annotation JSON."""
    df = df.withColumn("_json", F.col(element).cast("string")).withColumnRenamed("_error", "_before")
    df = parse_annotations(df, "_json", cfg["class_names"]).withColumn("_error", F.coalesce("_before", "_error"))
    return df.withColumns(box_columns(kind, cfg, F.col("boxes"), aug)).drop("_json", "_before", "boxes", "width", "height", "depth")


def _numbers(kind: str) -> pa.DataType:
    return {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[otype(kind)]


def add_sizes(df: DataFrame, element: str, video: bool = False) -> DataFrame:
    """Adds in_width and in_height from the header of an encoded image (or of a video's first frame); a broken one sets ``_error``."""
    schema = T.StructType(df.schema.fields + [T.StructField("in_width", T.IntegerType()), T.StructField("in_height", T.IntegerType())])

    def run(batches):
        for b in batches:
            w, h, errors = [], [], b.column("_error").to_pylist()
            for i, raw in enumerate(b.column(element).to_pylist()):
                try:
                    size = image_size(read_avi_frames(raw)[0] if video else raw)
                    w.append(size[0]), h.append(size[1])
                except (ValueError, IndexError, TypeError) as e:
                    h.append(None), w.append(None)
                    errors[i] = errors[i] or str(e)
            cols = [pa.array(errors, pa.string()) if c == "_error" else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(w, pa.int32()), pa.array(h, pa.int32())], [*b.schema.names, "in_width", "in_height"])

    return df.mapInArrow(run, schema)


def dump(folder: str, record: int, aug: dict, img: np.ndarray) -> None:
    """A record's augmented image as PNG with its draw as JSON beside it, for a look at what the loader does."""
    os.makedirs(folder, exist_ok=True)
    for suffix, data in (("png", write_png(np.ascontiguousarray(img))), ("txt", json.dumps(aug, default=float).encode())):
        name = os.path.join(folder, f"{record}.{suffix}")
        with open(f"{name}.{uuid.uuid4().hex}", "wb") as f:
            f.write(data)
        os.replace(f.name, name)


def add_pixels(df: DataFrame, kind: str, cfg: dict[str, Any], element: str, aug: Augmentation) -> DataFrame:
    """Adds the column of an image, mask or video provider; a record that cannot be decoded has null and ``_error``."""
    frame = {"channels": 3, "output_type": "uint8_t", "channel_major": True, "bgr_to_rgb": False} | cfg["frame"] if kind == "video" else cfg
    out = inner_name(shapes(kind, cfg)[0][0])
    dtype = NUMPY[frame["output_type"]]
    kind_of = T._parse_datatype_string(otype(frame["output_type"]))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(kind_of))])
    numbers = _numbers(frame["output_type"])

    def picture(raw, a, scaled=True):
        img = decode_image(raw, frame["channels"])
        img = pixels.transform_image(img, a, aug.padding, aug.resize_short_size, aug.interpolation_method, aug.lighting[1])
        if aug.fixed_aspect_ratio or not aug.crop_enable:
            img = pixels.fit_canvas(img, frame["width"], frame["height"])
        return pixels.standardize(img, aug.mean, aug.stddev) if scaled and dtype[0] == "f" else img

    def one(raw, a):
        if kind in ("pixelmask", "depthmap"):
            mask = pixels.transform_mask(decode_image(raw, 3)[..., :1], a)
            return pixels.layout(np.repeat(mask, frame["channels"], 2), frame["channel_major"], False, dtype)
        if kind == "video":
            frames = [picture(f, a) for f in read_avi_frames(raw)[: cfg["max_frame_count"]]]
            return pixels.layout(pixels.pad_frames(frames, cfg["max_frame_count"]).transpose(1, 2, 3, 0).reshape(-1, frames[0].shape[1], frames[0].shape[2]), False, False, dtype).reshape(cfg["max_frame_count"], *frames[0].shape).transpose(3, 0, 1, 2)
        return pixels.layout(picture(raw, a), frame["channel_major"], frame["bgr_to_rgb"], dtype)

    def run(batches):
        for b in batches:
            values, errors = [], b.column("_error").to_pylist()
            for i, (raw, a) in enumerate(zip(b.column(element).to_pylist(), b.column("aug").to_pylist())):
                try:
                    if aug.debug_output_directory and kind == "image" and not errors[i]:
                        dump(aug.debug_output_directory, b.column("_record")[i].as_py(), a, picture(raw, a, False))
                    values.append(None if errors[i] else one(raw, a).ravel())
                except (ValueError, IndexError, TypeError) as e:
                    values.append(None)
                    errors[i] = str(e)
            cols = [pa.array(errors, pa.string()) if c == "_error" else b.column(c) for c in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(values, pa.list_(numbers))], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def _add_text(kind: str):
    def add(df, cfg, element, aug):
        df = df.withColumns(text_provider(kind, cfg, F.col(element)))
        bad = F.col(inner_name(shapes(kind, cfg)[0][0])).isNull()
        return df.withColumn("_error", F.coalesce("_error", F.when(bad, F.lit(f"{kind} cannot be read"))))

    return add


for _kind in ("image", "pixelmask", "depthmap"):
    register(_kind, Provider(_picture_columns(_kind), lambda df, c, e, aug, kind=_kind: add_pixels(df, kind, c, e, aug), picture=True))
register("video", Provider(_video_columns, lambda df, c, e, aug: add_pixels(df, "video", c, e, aug), picture=True))
register("label", Provider(lambda c: _columns(c, ("label", (1,), c["output_type"])), _add_text("label")))
register("label_map", Provider(lambda c: _columns(c, ("label_map", (c["max_classes"],), "uint32_t")), _add_text("label_map")))
register("char_map", Provider(_char_map_columns, _add_text("char_map")))
register("blob", Provider(lambda c: _columns(c, ("blob", (c["output_count"],), c["output_type"])), lambda df, c, e, aug: add_blob(df, c, e)))
register("boundingbox", Provider(lambda c: _columns(c, ("boundingbox", (c["max_bbox_count"], 4), "float")), lambda df, c, e, aug: add_boxes(df, "boundingbox", c, e, aug), boxed=True))
register("localization_ssd", Provider(_ssd_columns, lambda df, c, e, aug: add_boxes(df, "localization_ssd", c, e, aug), boxed=True))
register("localization_rcnn", Provider(_rcnn_columns, boxed=True, joined=True))


def item_size(kind: str) -> int:
    return OTYPES[kind][1]

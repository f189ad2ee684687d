"""Configuration: dictionaries to checked objects, with errors that name the key and suggest the nearest known one."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from ..functions.text import OTYPES
from ..operators.augment import Augmentation

REQUIRED = object()


@dataclass
class Key:
    """A key of a configuration: its default (or REQUIRED), a converter and a range check."""

    default: Any = REQUIRED
    convert: Callable[[Any], Any] = lambda v: v
    check: Callable[[Any], bool] = lambda v: True


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def parse(given: dict, keys: dict[str, Key], where: str = "") -> dict[str, Any]:
    """Values of all keys; unknown, missing, unreadable and out-of-range ones are errors."""
    if not isinstance(given, dict):
        raise TypeError("configuration must be a dictionary")
    for k, v in given.items():
        if k not in keys:
            near = min(keys, key=lambda x: edit_distance(x, k))
            hint = f", did you mean '{near}'" if edit_distance(near, k) < len(k) // 2 else ""
            raise ValueError(f"config element {{{k}: {json.dumps(v)}}} is not understood{hint}")
    out = {}
    for k, key in keys.items():
        if k not in given or given[k] is None:
            if key.default is REQUIRED:
                raise ValueError(f"error when parsing field '{k}' in {where}: Required Argument: '{k}' not set")
            out[k] = key.default() if callable(key.default) else key.default
            continue
        try:
            out[k] = key.convert(given[k])
            ok = key.check(out[k])
        except (TypeError, ValueError) as e:
            raise ValueError(f"error when parsing field '{k}' in {where}: {e}") from e
        if not ok:
            raise ValueError(f"error when parsing field '{k}' in {where}: value '{given[k]}' out of range")
    return out


def _pair(kind=float):
    def convert(v):
        a, b = v
        return kind(a), kind(b)

    return convert


def _bool(v):
    if not isinstance(v, bool):
        raise TypeError(f"{v!r} is not a boolean")
    return v


_rising = lambda r: r[0] <= r[1]
_share = lambda v: 0 <= v <= 1
_type = lambda v: v in OTYPES
_names = lambda v: [str(x) for x in v]
_objects = lambda v: [dict(x) for x in v]
_floats = lambda v: [float(x) for x in v]

LOADER = {
    "manifest_filename": Key(convert=str), "manifest_root": Key("", str), "batch_size": Key(convert=int, check=lambda v: v > 0), "cache_directory": Key("", str),
    "block_size": Key(5000, int), "batch_major": Key(True, _bool), "subset_fraction": Key(1.0, float, _share), "shuffle_enable": Key(False, _bool),
    "shuffle_manifest": Key(False, _bool), "cpu_list": Key("", str), "pinned": Key(False, _bool), "random_seed": Key(0, int), "iteration_mode": Key("ONCE", str),
    "iteration_mode_count": Key(0, int), "etl": Key(convert=_objects), "augmentation": Key(list, _objects), "node_id": Key(0, int), "node_count": Key(0, int), "ssd_config": Key(None),
}
AUGMENTATION = {
    "scale": Key((1.0, 1.0), _pair(), lambda r: 0 <= r[0] <= r[1] <= 1), "angle": Key((0, 0), _pair(int), _rising), "lighting": Key((0.0, 0.0), _pair()),
    "horizontal_distortion": Key((1.0, 1.0), _pair(), _rising), "flip_enable": Key(False, _bool), "center": Key(True, _bool), "resize_short_size": Key(0, int),
    "interpolation_method": Key("LINEAR", str), "do_area_scale": Key(False, _bool), "crop_enable": Key(True, _bool), "expand_probability": Key(0.0, float, _share),
    "emit_constraint_type": Key("", str, lambda v: v in ("", "center", "min_overlap")), "emit_constraint_min_overlap": Key(0.0, float, _share), "fixed_aspect_ratio": Key(False, _bool),
    "mean": Key(list, _floats), "stddev": Key(list, _floats), "fixed_scaling_factor": Key(-1.0, float), "padding": Key(0, int, lambda v: v >= 0), "debug_output_directory": Key("", str),
    "contrast": Key((1.0, 1.0), _pair(), _rising), "brightness": Key((1.0, 1.0), _pair(), _rising), "saturation": Key((1.0, 1.0), _pair(), _rising),
    "expand_ratio": Key((1.0, 1.0), _pair(), lambda r: 1 <= r[0] <= r[1]), "hue": Key((0, 0), _pair(int), _rising), "batch_samplers": Key(list, _objects),
}
SAMPLER = {"max_sample": Key(-1, int, lambda v: v >= 0), "max_trials": Key(100, int, lambda v: v > 0), "sampler": Key(dict, dict), "sample_constraint": Key(dict, dict)}
SAMPLE = {"scale": Key((1.0, 1.0), _pair(), lambda r: 0 < r[0] <= r[1] <= 1), "aspect_ratio": Key((1.0, 1.0), _pair(), lambda r: 0 < r[0] <= r[1])}
CONSTRAINT = {f"{m}_{g}": Key(None, float) for g in ("jaccard_overlap", "sample_coverage", "object_coverage") for m in ("min", "max")}
_IMAGE = {"height": Key(convert=int), "width": Key(convert=int), "name": Key("", str), "bgr_to_rgb": Key(False, _bool), "channel_major": Key(True, _bool), "channels": Key(3, int, lambda v: v in (1, 3)), "output_type": Key("uint8_t", str, _type)}
PROVIDERS = {
    "image": _IMAGE,
    "pixelmask": _IMAGE | {"channels": Key(1, int, lambda v: v in (1, 3))},
    "depthmap": _IMAGE | {"channels": Key(1, int, lambda v: v in (1, 3))},
    "label": {"name": Key("", str), "binary": Key(False, _bool), "output_type": Key("uint32_t", str, _type)},
    "label_map": {"name": Key("", str), "output_type": Key("uint32_t", str, lambda v: v == "uint32_t"), "class_names": Key(convert=_names), "max_classes": Key(100, int)},
    "char_map": {"max_length": Key(convert=int), "alphabet": Key(convert=str), "name": Key("", str), "unknown_value": Key(0, int), "emit_length": Key(False, _bool), "output_type": Key("uint32_t", str, lambda v: v == "uint32_t")},
    "blob": {"output_count": Key(convert=int), "name": Key("", str), "output_type": Key("float", str, _type)},
    "boundingbox": {"height": Key(convert=int), "width": Key(convert=int), "max_bbox_count": Key(convert=int), "class_names": Key(convert=_names), "name": Key("", str), "output_type": Key("float", str, _type)},
    "video": {"max_frame_count": Key(convert=int), "name": Key("", str), "frame": Key(convert=dict)},
    "localization_rcnn": {"height": Key(convert=int), "width": Key(convert=int), "class_names": Key(convert=_names), "name": Key("", str), "rois_per_image": Key(256, int), "base_size": Key(16, int), "scaling_factor": Key(1 / 16, float), "ratios": Key(lambda: [0.5, 1, 2], _floats), "scales": Key(lambda: [8, 16, 32], _floats), "negative_overlap": Key(0.3, float, _share), "positive_overlap": Key(0.7, float, _share), "foreground_fraction": Key(0.5, float, _share), "max_gt_boxes": Key(64, int)},
    "localization_ssd": {"height": Key(convert=int), "width": Key(convert=int), "max_gt_boxes": Key(64, int), "class_names": Key(convert=_names), "name": Key("", str)},
}


@dataclass
class Loader:
    """A checked loader configuration."""

    values: dict[str, Any]
    providers: list[tuple[str, dict[str, Any]]] = field(default_factory=list)
    augmentation: Augmentation = field(default_factory=Augmentation)

    def __getattr__(self, name):
        try:
            return self.__dict__["values"][name]
        except KeyError:
            raise AttributeError(name) from None


def augmentation(given: list[dict]) -> Augmentation:
    """The first element counts; each must have a type."""
    for a in given:
        if "type" not in a:
            raise ValueError("missing required 'type' element in augmentation object")
    if not given:
        return Augmentation()
    if given[0]["type"] != "image":
        raise ValueError(f"unsupported augmentation type '{given[0]['type']}'")
    v = parse({k: x for k, x in given[0].items() if k != "type"}, AUGMENTATION, "augmentation")
    samplers = []
    for s in v["batch_samplers"]:
        s = parse(s.get("batch_sampler", s), SAMPLER, "batch_sampler")
        s["sampler"] = parse(s["sampler"], SAMPLE, "sampler")
        s["sample_constraint"] = {k: x for k, x in parse(s["sample_constraint"], CONSTRAINT, "sample_constraint").items() if x is not None}
        samplers.append(s)
    v["batch_samplers"] = samplers
    return Augmentation(**{f.name: v[f.name] for f in fields(Augmentation)})


def loader(given: dict) -> Loader:
    """Checks a loader configuration and those of its providers."""
    v = parse(given, LOADER, "loader")
    if v["block_size"] == 0:
        v["block_size"] = 2 * v["batch_size"]
    if v["iteration_mode"] not in ("ONCE", "COUNT", "INFINITE"):
        raise ValueError("iteration_mode must be one of ONCE, COUNT, INFINITE")
    if v["iteration_mode"] == "COUNT" and v["iteration_mode_count"] <= 0:
        raise ValueError("iteration_mode_count must be a positive integer")
    if v["node_count"] > 0:
        if v["node_id"] >= v["node_count"]:
            raise ValueError("node_id must be less than node_count")
        v["cache_directory"] = ""
        v["random_seed"] = v["random_seed"] or 1
    providers = []
    for e in v["etl"]:
        if "type" not in e:
            raise ValueError("missing required 'type' element in etl object")
        if e["type"] not in PROVIDERS:
            raise ValueError(f"unsupported etl type '{e['type']}'")
        providers.append((e["type"], parse({k: x for k, x in e.items() if k != "type"}, PROVIDERS[e["type"]], e["type"])))
    return Loader(v, providers, augmentation(v["augmentation"]))


def narrow(value: Any) -> Any:
    """Plain values as the configuration has them: whole numbers of 32 bits (the low ones), real ones of single precision."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, int):
        return (value + 2**31) % 2**32 - 2**31
    if isinstance(value, float):
        return struct.unpack("<f", struct.pack("<f", value))[0]
    if isinstance(value, (list, tuple)):
        return [narrow(v) for v in value]
    if isinstance(value, dict) and all(isinstance(k, str) for k in value):
        return {k: narrow(v) for k, v in value.items()}
    raise TypeError(f"{type(value).__name__} has no place in a configuration")


def to_json(config: dict) -> str:
    """A configuration as JSON; only plain values, narrowed, and a dictionary at the top."""
    if not isinstance(config, dict):
        raise TypeError("configuration must be a dictionary")
    return json.dumps(narrow(config))


def dump_defaults(kind: str) -> str:
    """Keys of a provider, the loader or the augmentation, with their defaults."""
    keys = {"loader": LOADER, "augmentation": AUGMENTATION, **PROVIDERS}[kind]
    show = lambda k: "REQUIRED" if k.default is REQUIRED else json.dumps(k.default() if callable(k.default) else k.default)
    return "\n".join(f"{n}: {show(k)}" for n, k in keys.items())


def log_level() -> str:
    """Level named by the environment; WARNING if it names none."""
    level = os.environ.get("LOOMERY_LOG_LEVEL", "WARNING").upper()
    return level if level in ("INFO", "WARNING", "ERROR") else "WARNING"


def parse_cpu_list(text: str, cpus: int) -> list[int]:
    """Sorted CPU numbers of a list such as ``0-4,30,10``. Spark schedules by itself; this only checks the key."""
    out: set[int] = set()
    for part in filter(None, text.split(",")):
        a, _, b = part.partition("-")
        first, last = int(a), int(b or a)
        if first > last or last >= cpus:
            raise ValueError(f"cpu list {text!r} is out of range")
        out |= set(range(first, last + 1))
    return sorted(out)

"""Pixels: Column expressions over planes held as arrays, and numpy kernels for whole images.

A plane is an array of values in row order with a known width. Images in kernels are arrays of height, width, channels
in blue, green, red order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- planes as arrays -------------------------------------------------------------------------------------------------


def _gather(plane: Column, out_w: int, out_h: int, source) -> Column:
    """A plane whose cell (x, y) is taken from ``source(x, y)``; outside is 0."""
    cells = [source(x, y) for y in range(out_h) for x in range(out_w)]
    return F.transform(F.array(*(F.lit(int(c)) for c in cells)), lambda i: F.coalesce(F.get(plane, i), F.lit(0.0)))


def plane_flip(plane: Column, w: int, h: int) -> Column:
    return _gather(plane, w, h, lambda x, y: y * w + w - 1 - x)


def plane_crop(plane: Column, w: int, h: int, x0: int, y0: int, cw: int, ch: int) -> Column:
    if x0 < 0 or y0 < 0 or x0 + cw > w or y0 + ch > h:
        raise ValueError("the crop leaves the plane")
    return _gather(plane, cw, ch, lambda x, y: (y + y0) * w + x + x0)


def plane_pad(plane: Column, w: int, h: int, padding: int, x0: int, y0: int) -> Column:
    """Zero border, then a crop of the old size at (x0, y0)."""
    inside = lambda x, y: 0 <= x < w and 0 <= y < h
    return _gather(plane, w, h, lambda x, y: (y + y0 - padding) * w + x + x0 - padding if inside(x + x0 - padding, y + y0 - padding) else w * h)


def plane_resize_nearest(plane: Column, w: int, h: int, out_w: int, out_h: int) -> Column:
    return _gather(plane, out_w, out_h, lambda x, y: min(h - 1, y * h // out_h) * w + min(w - 1, x * w // out_w))


def plane_standardize(plane: Column, mean: float, sd: float) -> Column:
    """value / 255 less the mean, by the standard deviation unless that is 0."""
    return F.transform(plane, lambda v: (v / 255.0 - mean) / (sd if sd else 1.0))


def plane_contrast(plane: Column, c: float) -> Column:
    mean = F.aggregate(plane, F.lit(0.0), lambda s, v: s + v) / F.size(plane)
    return F.transform(plane, lambda v: c * v + (1 - c) * mean)


def interleave(planes: list[Column]) -> Column:
    """Planar channels to pixels."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(planes[0]) - 1), lambda i: F.array(*(F.get(p, i) for p in planes))))


#: Weights of blue, green and red in the grey value that saturation mixes in; fixed values.
GREY = (0.0820, 0.6094, 0.3086)


def saturation_matrix(brightness: float, saturation: float) -> list[list[float]]:
    return [[brightness * ((saturation if r == c else 0.0) + (1 - saturation) * GREY[c]) for c in range(3)] for r in range(3)]


def brightness_saturation(b: Column, g: Column, r: Column, brightness: float, saturation: float) -> tuple[Column, Column, Column]:
    m = saturation_matrix(brightness, saturation)
    return tuple(row[0] * b + row[1] * g + row[2] * r for row in m)


# --- numpy kernels ----------------------------------------------------------------------------------------------------

#: Principal components of colour variation and their standard deviations; fixed values.
CPCA = np.array([[0.39731118, 0.70119634, -0.59200296], [-0.81698062, -0.02354167, -0.57618440], [0.41795513, -0.71257945, -0.56351045]])
CSTD = np.array([19.72083305, 37.09388853, 121.78006099])


def saturate(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype("u1")


def _sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, smooth: bool, border=None) -> np.ndarray:
    """Values at real positions; outside is the border, or the nearest pixel without one."""
    h, w = img.shape[:2]
    src = img.astype("f8")
    at = lambda i, j: src[np.clip(j, 0, h - 1), np.clip(i, 0, w - 1)]
    if border is not None:
        inner = at

        def at(i, j):
            out = inner(i, j)
            out[(i < 0) | (j < 0) | (i >= w) | (j >= h)] = border
            return out

    if not smooth:
        return at(np.rint(x).astype(int), np.rint(y).astype(int))
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = (x - i)[..., None], (y - j)[..., None]
    return (at(i, j) * (1 - fx) + at(i + 1, j) * fx) * (1 - fy) + (at(i, j + 1) * (1 - fx) + at(i + 1, j + 1) * fx) * fy


def rotate(img: np.ndarray, angle: float, smooth: bool = True, border: float = 0) -> np.ndarray:
    """Turns an image about its centre, counter-clockwise; the size stays."""
    if not angle:
        return img
    h, w = img.shape[:2]
    cx, cy, t = w / 2, h / 2, np.deg2rad(angle)
    y, x = np.mgrid[0:h, 0:w].astype("f8")
    dx, dy = x - cx, y - cy
    out = _sample(img, cx + dx * np.cos(t) - dy * np.sin(t), cy + dx * np.sin(t) + dy * np.cos(t), smooth, border)
    return saturate(out) if img.dtype == np.uint8 else out.astype(img.dtype)


def expand(img: np.ndarray, dx: int, dy: int, width: int, height: int) -> np.ndarray:
    """Pastes an image on a zero canvas."""
    h, w = img.shape[:2]
    if dx < 0 or dy < 0 or dx + w > width or dy + h > height:
        raise ValueError("the image would leave the canvas")
    out = np.zeros((height, width, *img.shape[2:]), img.dtype)
    out[dy : dy + h, dx : dx + w] = img
    return out


def _kernel(method: str):
    if method == "CUBIC":
        a = -0.75
        return 2, lambda t: np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0))
    return 4, lambda t: np.where(t < 4, np.sinc(t) * np.sinc(t / 4), 0)


def _weights(n: int, out: int, method: str) -> np.ndarray:
    """Rows of weights from n source cells to each of ``out`` cells along an axis."""
    m, scale = np.zeros((out, n)), n / out
    for k in range(out):
        if method == "NEAREST":
            m[k, min(n - 1, int(k * scale))] = 1
        elif method == "AREA" and scale > 1:
            lo, hi = k * scale, (k + 1) * scale
            cells = np.arange(int(lo), min(n, int(np.ceil(hi))))
            m[k, cells] = np.minimum(hi, cells + 1) - np.maximum(lo, cells)
        else:
            at = (k + 0.5) * scale - 0.5
            base = int(np.floor(at))
            if method in ("LINEAR", "AREA"):
                for i, v in ((base, 1 - (at - base)), (base + 1, at - base)):
                    m[k, min(max(i, 0), n - 1)] += v
            else:
                radius, f = _kernel(method)
                i = np.arange(base - radius + 1, base + radius + 1)
                np.add.at(m[k], np.clip(i, 0, n - 1), f(np.abs(at - i)))
        m[k] /= m[k].sum()
    return m


def resize(img: np.ndarray, width: int, height: int, method: str = "LINEAR") -> np.ndarray:
    """Resizes by NEAREST, LINEAR, CUBIC, AREA or LANCZOS4 (any case); the same size is left alone."""
    method = method.upper()
    if method not in ("NEAREST", "LINEAR", "CUBIC", "AREA", "LANCZOS4"):
        raise ValueError(f"interpolation method {method} is not known")
    h, w = img.shape[:2]
    if (w, h) == (width, height):
        return img
    if method == "NEAREST":
        return img[np.minimum(h - 1, np.arange(height) * h // height)][:, np.minimum(w - 1, np.arange(width) * w // width)]
    out = np.einsum("yh,hwc,xw->yxc", _weights(h, height, method), img.reshape(h, w, -1).astype("f8"), _weights(w, width, method), optimize=True)
    out = saturate(out) if img.dtype == np.uint8 else out.astype(img.dtype)
    return out.reshape(height, width, *img.shape[2:])


def resize_short(img: np.ndarray, target: int, method: str = "LINEAR") -> np.ndarray:
    h, w = img.shape[:2]
    scale = target / min(h, w)
    return resize(img, int(np.floor(w * scale + 0.5)), int(np.floor(h * scale + 0.5)), method)


def add_padding(img: np.ndarray, padding: int, x0: int, y0: int) -> np.ndarray:
    h, w = img.shape[:2]
    return np.pad(img, ((padding, padding), (padding, padding), *[(0, 0)] * (img.ndim - 2)))[y0 : y0 + h, x0 : x0 + w]


def _to_hsv(img: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0 to 180), saturation and value in 0 to 255, as real numbers."""
    b, g, r = np.moveaxis(img.astype("f8"), 2, 0)
    v, low = img.max(2).astype("f8"), img.min(2).astype("f8")
    d = v - low
    some = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / some, np.where(v == g, 2 + (b - r) / some, 4 + (r - g) / some)) * 30
    return np.stack([np.where(d == 0, 0, h % 180), np.where(v == 0, 0, 255 * d / np.where(v == 0, 1, v)), v], 2)


def _from_hsv(hsv: np.ndarray) -> np.ndarray:
    h, s, v = np.moveaxis(hsv, 2, 0)
    k = lambda n: (n + h / 30) % 6
    part = lambda n: v - v * s / 255 * np.clip(np.minimum(k(n), 4 - k(n)), 0, 1)
    return saturate(np.stack([part(1), part(3), part(5)], 2))


def shift_hue(img: np.ndarray, hue: int) -> np.ndarray:
    """Turns the hue by ``hue`` (in units of two degrees), back into 0 to 180 from either side."""
    if not hue:
        return img
    hsv = np.rint(_to_hsv(img))
    hsv[..., 0] = (hsv[..., 0] + hue) % 180
    return _from_hsv(hsv)


def colour_jitter(img: np.ndarray, contrast: float = 1, brightness: float = 1, saturation: float = 1, hue: int = 0) -> np.ndarray:
    if brightness != 1 or saturation != 1:
        img = saturate(img.astype("f8") @ np.array(saturation_matrix(brightness, saturation)).T)
    img = shift_hue(img, hue)
    if contrast != 1:
        img = saturate(contrast * img.astype("f8") + (1 - contrast) * img.reshape(-1, img.shape[2]).mean(0))
    return img


def lighting(img: np.ndarray, alphas, sd: float) -> np.ndarray:
    """Adds one random colour to every pixel, along the principal components."""
    if not len(alphas):
        return img
    return saturate((img.astype("f8") + CPCA @ (CSTD * np.asarray(alphas))) / (1 + sd))


def standardize(img: np.ndarray, mean, stddev) -> np.ndarray:
    n = img.shape[2]
    if (len(mean) and len(mean) != n) or (len(stddev) and len(stddev) != n):
        raise ValueError("mean and stddev must have a value per channel")
    if not len(mean) and not len(stddev):
        return img
    sd = np.array([s or 1.0 for s in stddev]) if len(stddev) else np.ones(n)
    return (img.astype("f8") / 255 - (np.array(mean) if len(mean) else 0)) / sd


def fit_canvas(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """A smaller image at the top left of a zero canvas."""
    out = np.zeros((height, width, img.shape[2]), img.dtype)
    h, w = min(height, img.shape[0]), min(width, img.shape[1])
    out[:h, :w] = img[:h, :w]
    return out


def transform_image(img: np.ndarray, aug: dict, padding: int = 0, short: int = 0, method: str = "LINEAR", light_sd: float = 0.0) -> np.ndarray:
    """Rotate, expand, short-side resize, crop, pad, resize, colour, lighting and flip, in this order."""
    out = rotate(img, aug.get("angle", 0))
    if aug.get("expand_ratio", 1.0) > 1:
        out = expand(out, aug["expand_x"], aug["expand_y"], aug["expand_width"], aug["expand_height"])
    if short:
        out = resize_short(out, short, method)
    out = out[aug["crop_y"] : aug["crop_y"] + aug["crop_height"], aug["crop_x"] : aug["crop_x"] + aug["crop_width"]]
    if padding:
        out = add_padding(out, padding, aug["pad_x"], aug["pad_y"])
    out = resize(out, aug["out_width"], aug["out_height"], method)
    if out.shape[2] == 3:
        out = colour_jitter(out, aug.get("contrast", 1), aug.get("brightness", 1), aug.get("saturation", 1), aug.get("hue", 0))
        out = lighting(out, aug.get("lighting") or [], light_sd)
    return out[:, ::-1] if aug.get("flip") else out


def transform_mask(mask: np.ndarray, aug: dict) -> np.ndarray:
    """A mask or depth map: nearest rotation, crop, nearest resize, flip; no colour and no expansion."""
    out = rotate(mask, aug.get("angle", 0), smooth=False)
    out = out[aug["crop_y"] : aug["crop_y"] + aug["crop_height"], aug["crop_x"] : aug["crop_x"] + aug["crop_width"]]
    out = resize(out, aug["out_width"], aug["out_height"], "NEAREST")
    return out[:, ::-1] if aug.get("flip") else out


def layout(img: np.ndarray, channel_major: bool, bgr_to_rgb: bool, dtype: str) -> np.ndarray:
    """Channel order, planar or interleaved layout, element type."""
    if bgr_to_rgb and img.shape[2] == 3:
        img = img[..., ::-1]
    if np.dtype(dtype).kind in "iu" and img.dtype.kind == "f":
        info = np.iinfo(dtype)
        img = np.clip(np.rint(img), info.min, info.max)
    return np.ascontiguousarray(np.moveaxis(img, 2, 0) if channel_major else img, dtype)


def pad_frames(frames: list[np.ndarray], count: int) -> np.ndarray:
    """Channels x frames x height x width of the first ``count`` frames, zero frames after."""
    out = np.zeros((count, *frames[0].shape), frames[0].dtype)
    out[: min(count, len(frames))] = frames[:count]
    return np.ascontiguousarray(out.transpose(3, 0, 1, 2))

"""Driver queries over the kernels that the loader runs: pixels, containers, video and audio.

Images are made of embeddings: 64 numbers are an 8 x 8 plane, the first 60 a 4 x 5 image of three channels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import audio
from ..operators import pixels
from ..sources import containers
from .queries import query, table

_P = "list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 100 + 128.5))))"


def images(spark, sf_dir):
    """vec_id and p, 64 whole numbers of 0 to 255."""
    level = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x.cast("double") * 100 + 128.5).cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", level).alias("p"))


def run(df, kernel, digits: int = 6):
    """A row per number that a kernel makes of each p: vec_id, position, value."""

    def each(batches):
        for b in batches:
            out = [np.asarray(kernel(np.array(p)), "f8").ravel() for p in b.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.list_(pa.float64()))], ["vec_id", "p"])

    out = df.select("vec_id", "p").mapInArrow(each, df.select(F.col("vec_id"), "p").schema)
    return out.select("vec_id", F.posexplode("p").alias("position", "value")).withColumn("value", F.round("value", digits) + 0.0)


def _sql(n: int, value: str, more: str = "", digits: int = 6) -> str:
    return f"WITH v AS (SELECT vec_id, {_P} AS p FROM embeddings){more} SELECT vec_id, k::INTEGER AS position, round(({value})::DOUBLE, {digits}) + 0.0 AS value FROM v, range({n}) AS t(k)"


plane = lambda p: p.reshape(8, 8, 1)
colour = lambda p: p[:60].reshape(4, 5, 3).astype("u1")


def _turned(angle: float, value: str) -> str:
    c, s = float(np.cos(np.deg2rad(angle))), float(np.sin(np.deg2rad(angle)))
    return f"""WITH v AS (SELECT vec_id, {_P} AS p FROM embeddings), g AS (SELECT k, 4 + (k % 8 - 4) * {c!r}::DOUBLE - (k // 8 - 4) * {s!r}::DOUBLE AS x, 4 + (k % 8 - 4) * {s!r}::DOUBLE + (k // 8 - 4) * {c!r}::DOUBLE AS y FROM range(64) AS t(k)),
f AS (SELECT *, floor(x)::INTEGER AS i, floor(y)::INTEGER AS j FROM g) SELECT vec_id, k::INTEGER AS position, round(({value})::DOUBLE, 6) + 0.0 AS value FROM v, f"""


def _cell(i: str, j: str) -> str:
    return f"(CASE WHEN {i} BETWEEN 0 AND 7 AND {j} BETWEEN 0 AND 7 THEN p[({j})::INTEGER * 8 + ({i})::INTEGER + 1] ELSE 0 END)"


@query(_turned(17, f"({_cell('i', 'j')} * (1 - (x - i)) + {_cell('i + 1', 'j')} * (x - i)) * (1 - (y - j)) + ({_cell('i', 'j + 1')} * (1 - (x - i)) + {_cell('i + 1', 'j + 1')} * (x - i)) * (y - j)"))
def kernel_rotate(spark, sf_dir):
    return run(images(spark, sf_dir), lambda p: pixels.rotate(plane(p), 17))


@query(_turned(17, _cell("round(x)", "round(y)")))
def kernel_rotate_nearest(spark, sf_dir):
    return run(images(spark, sf_dir), lambda p: pixels.rotate(plane(p), 17, smooth=False))


@query(_sql(120, "CASE WHEN k % 12 BETWEEN 3 AND 10 AND k // 12 BETWEEN 1 AND 8 THEN p[(k // 12 - 1) * 8 + k % 12 - 3 + 1] ELSE 0 END"))
def kernel_expand(spark, sf_dir):
    return run(images(spark, sf_dir), lambda p: pixels.expand(plane(p), 3, 1, 12, 10))


_RESIZE = f"""WITH v AS (SELECT vec_id, {_P} AS p FROM embeddings), m(method, radius) AS (VALUES ('LINEAR', 1), ('CUBIC', 2), ('LANCZOS4', 4)), a(ax, o) AS (VALUES ('x', 5), ('y', 6)),
b AS (SELECT method, radius, ax, k, (k + 0.5) * 8 / o - 0.5 AS pos FROM m, a, range(6) AS t(k) WHERE k < o),
c AS (SELECT method, ax, k, floor(pos) + d AS i, abs(pos - floor(pos) - d) AS u FROM b, range(-3, 5) AS q(d) WHERE d BETWEEN 1 - radius AND radius),
f AS (SELECT method, ax, k, greatest(0, least(7, i))::INTEGER AS i, CASE method WHEN 'LINEAR' THEN 1 - u WHEN 'CUBIC' THEN CASE WHEN u <= 1 THEN 1.25 * u * u * u - 2.25 * u * u + 1 WHEN u < 2 THEN -0.75 * (u * u * u - 5 * u * u + 8 * u - 4) ELSE 0 END
  ELSE CASE WHEN u = 0 THEN 1 WHEN u < 4 THEN sin(pi() * u) / (pi() * u) * sin(pi() * u / 4) / (pi() * u / 4) ELSE 0 END END AS w FROM c
  UNION ALL SELECT 'AREA', ax, k, i::INTEGER, least((k + 1) * 8.0 / o, i + 1.0) - greatest(k * 8.0 / o, i * 1.0) FROM a, range(6) AS t(k), range(8) AS s(i) WHERE k < o AND i < (k + 1) * 8.0 / o AND i + 1 > k * 8.0 / o),
s AS (SELECT method, ax, k, sum(w) AS total FROM f GROUP BY 1, 2, 3), n AS (SELECT f.method, f.ax, f.k, f.i, sum(w / total)::DOUBLE AS w FROM f JOIN s ON f.method = s.method AND f.ax = s.ax AND f.k = s.k GROUP BY 1, 2, 3, 4)
SELECT vec_id, x.method, (y.k * 5 + x.k)::INTEGER AS position, floor(sum(x.w * y.w * p[y.i * 8 + x.i + 1]) * 1000 + 0.500123) AS value FROM v, n x JOIN n y ON x.method = y.method AND x.ax = 'x' AND y.ax = 'y' GROUP BY 1, 2, 3"""


@query(_RESIZE)
def kernel_resize(spark, sf_dir):
    """An 8 x 8 plane to 5 x 6 by all smooth methods, in thousandths; the odd offset keeps exact halves off the edge."""
    out = None
    for method in ("LINEAR", "CUBIC", "LANCZOS4", "AREA"):
        part = run(images(spark, sf_dir), lambda p, m=method: pixels.resize(plane(p), 5, 6, m.lower()), 9).withColumn("value", F.floor(F.col("value") * 1000 + 0.500123).cast("double")).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


@query(_sql(48, "p[((k // 8) * 5 // 6 + 2) * 8 + (7 - k % 8) * 6 // 8 + 1 + 1]"))
def kernel_mask(spark, sf_dir):
    """Crop, nearest resize and flip of a mask."""
    aug = {"crop_x": 1, "crop_y": 2, "crop_width": 6, "crop_height": 5, "out_width": 8, "out_height": 6, "flip": True}
    return run(images(spark, sf_dir), lambda p: pixels.transform_mask(plane(p), aug))


@query(_sql(30, "CASE WHEN 5 - k % 6 + 3 - 2 BETWEEN 0 AND 5 AND k // 6 + 1 - 2 BETWEEN 0 AND 4 THEN p[(k // 6 + 1 - 2 + 2) * 8 + 5 - k % 6 + 3 - 2 + 1 + 1] ELSE 0 END"))
def kernel_image(spark, sf_dir):
    """The image pipeline on one channel: crop, padding of two and re-crop, flip."""
    aug = {"crop_x": 1, "crop_y": 2, "crop_width": 6, "crop_height": 5, "out_width": 6, "out_height": 5, "flip": True, "pad_x": 3, "pad_y": 1}
    return run(images(spark, sf_dir), lambda p: pixels.transform_image(plane(p), aug, padding=2))


@query(_sql(60, "p[k % 20 * 3 + 2 - k // 20 + 1]"))
def kernel_layout(spark, sf_dir):
    """Interleaved blue-green-red to planar red-green-blue."""
    return run(images(spark, sf_dir), lambda p: pixels.layout(colour(p), True, True, "f4"))


@query(_sql(126, "CASE WHEN k // 21 < 4 AND k % 21 // 3 < 5 THEN p[(k // 21 * 5 + k % 21 // 3) * 3 + k % 3 + 1] ELSE 0 END"))
def kernel_canvas(spark, sf_dir):
    """An image at the top left of a larger canvas."""
    return run(images(spark, sf_dir), lambda p: pixels.fit_canvas(colour(p), 7, 6))


@query(_sql(60, "(p[k + 1] / 255 - [0.4, 0.5, 0.6][k % 3 + 1]) / [0.25, 1.0, 0.125][k % 3 + 1]"))
def kernel_standardize(spark, sf_dir):
    return run(images(spark, sf_dir), lambda p: pixels.standardize(colour(p), [0.4, 0.5, 0.6], [0.25, 0, 0.125]))


_LEVEL = "greatest(0, least(255, round({})))"
_GREY = "({0!r}::DOUBLE * p[k // 3 * 3 + 1] + {1!r}::DOUBLE * p[k // 3 * 3 + 2] + {2!r}::DOUBLE * p[k // 3 * 3 + 3])".format(*pixels.GREY)


@query(_sql(60, _LEVEL.format(f"1.1003::DOUBLE * (0.7001::DOUBLE * p[k + 1] + (1 - 0.7001::DOUBLE) * {_GREY})")))
def kernel_saturation(spark, sf_dir):
    """Brightness and saturation of whole images."""
    return run(images(spark, sf_dir), lambda p: pixels.colour_jitter(colour(p), brightness=1.1003, saturation=0.7001))


@query(_sql(60, _LEVEL.format("0.8003::DOUBLE * p[k + 1] + (1 - 0.8003::DOUBLE) * list_sum(list_transform(range(20), lambda i: p[i * 3 + k % 3 + 1])) / 20")))
def kernel_contrast(spark, sf_dir):
    return run(images(spark, sf_dir), lambda p: pixels.colour_jitter(colour(p), contrast=0.8003))


_LIGHT = (pixels.CPCA @ (pixels.CSTD * np.array([0.1, -0.05, 0.02]))).tolist()


@query(_sql(60, _LEVEL.format(f"(p[k + 1] + {_LIGHT!r}[k % 3 + 1]) / (1 + 0.1)")))
def kernel_lighting(spark, sf_dir):
    return run(images(spark, sf_dir), lambda p: pixels.lighting(colour(p), [0.1, -0.05, 0.02], 0.1))


_HUE = f"""WITH v AS (SELECT vec_id, {_P} AS p FROM embeddings), c AS (SELECT vec_id, t.k AS k, p[t.k * 3 + 1] AS b, p[t.k * 3 + 2] AS g, p[t.k * 3 + 3] AS r FROM v, range(20) AS t(k)),
m AS (SELECT *, greatest(b, g, r) AS top, greatest(b, g, r) - least(b, g, r) AS d FROM c),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN top = r THEN (g - b) / d * 30 WHEN top = g THEN (2 + (b - r) / d) * 30 ELSE (4 + (r - g) / d) * 30 END AS h0, CASE WHEN top = 0 THEN 0 ELSE round_even(255 * d / top, 0) END AS s FROM m),
n AS (SELECT *, (round_even(CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END, 0)::INTEGER + 25) % 180 AS hue FROM h),
o AS (SELECT vec_id, k * 3 + n AS position, top, s, (([1, 3, 5])[n + 1] + hue / 30.0::DOUBLE) - CASE WHEN ([1, 3, 5])[n + 1] + hue / 30.0::DOUBLE >= 6 THEN 6 ELSE 0 END AS z FROM n, range(3) AS t(n))
SELECT vec_id, position::INTEGER AS position, round_even((top - top * s / 255 * greatest(0, least(1, least(z, 4 - z))))::DOUBLE, 0) + 0.0 AS value FROM o""".replace("FROM n, range(3) AS t(n)", "FROM n nn, range(3) AS t(n)")


@query(_HUE)
def kernel_hue(spark, sf_dir):
    """Hue turned by 50 degrees."""
    return run(images(spark, sf_dir), lambda p: pixels.shift_hue(colour(p), 25))


@query(_sql(60, "p[k + 1]"))
def kernel_png(spark, sf_dir):
    """Images to PNG bytes and back through the loader's decoder."""
    return run(images(spark, sf_dir), lambda p: containers.decode_image(containers.write_png(colour(p))))


@query(_sql(20, "p[k * 3 + 1]"))
def kernel_mask_decode(spark, sf_dir):
    """Of a decoded mask the first channel counts."""
    return run(images(spark, sf_dir), lambda p: containers.decode_image(containers.write_png(colour(p)), 3)[..., :1])


@query(_sql(64, "p[k + 1] / 8"))
def kernel_raw_image(spark, sf_dir):
    """Images of real numbers to the raw format and back."""
    return run(images(spark, sf_dir), lambda p: containers.read_raw_image(containers.write_raw_image(plane(p).astype("f4") / 8)))


@query(_sql(72, "CASE WHEN k % 24 // 4 < 5 THEN p[k % 24 // 4 * 12 + k % 4 * 3 + k // 24 + 1] ELSE 0 END"))
def kernel_video(spark, sf_dir):
    """Five frames to a video file and back; channels x frames x height x width, a zero frame after."""

    def kernel(p):
        film = containers.write_avi([containers.write_png(f.astype("u1")) for f in p[:60].reshape(5, 2, 2, 3)], 2, 2)
        return pixels.pad_frames([containers.decode_image(f) for f in containers.read_avi_frames(film)], 6)

    return run(images(spark, sf_dir), kernel)


_HANN = "(0.5 - 0.5 * cos(2 * pi() * i / 15))"


@query(_sql(63, f"sqrt(pow(list_sum(list_transform(range(16), lambda i: p[k // 9 * 8 + i + 1] * {_HANN} * cos(2 * pi() * i * (k % 9) / 16))), 2) + pow(list_sum(list_transform(range(16), lambda i: p[k // 9 * 8 + i + 1] * {_HANN} * sin(2 * pi() * i * (k % 9) / 16))), 2))", digits=3))
def kernel_spectrogram(spark, sf_dir):
    """Seven frames of 16 samples, half overlapping, with a Hann window."""
    return run(images(spark, sf_dir), lambda p: audio.spectrogram(p, 16, 8, 100, audio.window_array("hann", 16)), 3)


_MFCC = f"""WITH v AS (SELECT vec_id, {_P} AS p FROM embeddings), a AS (SELECT vec_id, k, (pow(list_sum(list_transform(range(64), lambda i: p[i + 1] * cos(2 * pi() * i * k / 64))), 2) + pow(list_sum(list_transform(range(64), lambda i: p[i + 1] * sin(2 * pi() * i * k / 64))), 2)) / 64 AS power FROM v, range(33) AS t(k)),
e AS (SELECT k, floor(65 * 700 * (10 ** ((2595 * log10(1 + 8000.0 / 700)) * k / 7 / 2595) - 1) / 16000)::INTEGER AS edge FROM range(8) AS t(k)),
f AS (SELECT x.k AS filter, x.edge AS lo, y.edge AS mid, z.edge AS hi FROM e x JOIN e y ON y.k = x.k + 1 JOIN e z ON z.k = x.k + 2),
w AS (SELECT filter, i, CASE WHEN i >= lo AND i < mid THEN (i - lo) / greatest(1, mid - lo) WHEN i >= mid AND i < hi THEN (hi - i) / greatest(1, hi - mid) ELSE 0 END::DOUBLE AS wt FROM f, range(33) AS t(i)),
l AS (SELECT vec_id, filter, ln(greatest(sum(power * wt), 1.1754943508222875e-38)) AS energy FROM a JOIN w ON w.i = a.k GROUP BY 1, 2)
SELECT vec_id, c::INTEGER AS position, round(sum(energy * sqrt(2 / 6.0::DOUBLE) * cos(pi() * c * (2 * filter + 1) / 12) / CASE WHEN c = 0 THEN sqrt(2) ELSE 1 END), 3) + 0.0 AS value FROM l, range(4) AS t(c) GROUP BY 1, 2"""


@query(_MFCC)
def kernel_mfcc(spark, sf_dir):
    """Four cepstral coefficients of 64 samples over six mel filters."""
    bank = audio.filterbank(6, 64, 16000)
    return run(images(spark, sf_dir), lambda p: audio.mfcc(audio.cepstrogram(audio.spectrogram(p, 64, 64, 1), bank), 4), 3)

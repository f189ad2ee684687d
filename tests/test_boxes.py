import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import boxes as B


def run(spark, **columns):
    return spark.range(1).select(*(c.cast("double").alias(n) if n != "ok" else c.alias(n) for n, c in columns.items())).first()


def box(*v, pixel=True):
    return B.Box(*(F.lit(float(x)) for x in v), pixel)


def sides(spark, b):
    return tuple(run(spark, a=b.xmin, b=b.ymin, c=b.xmax, d=b.ymax))


def cells(b):
    """A whole-numbered pixel box as the set of its pixels."""
    return {(x, y) for x in range(b[0], b[2] + 1) for y in range(b[1], b[3] + 1)}


def test_overlaps_by_pixels(spark):
    """Intersection, overlap and coverage of pixel boxes by counting pixels."""
    rng = random.Random(3)

    def draw():
        x, y = rng.randint(0, 12), rng.randint(0, 12)
        return x, y, x + rng.randint(0, 8), y + rng.randint(0, 8)

    for _ in range(12):
        p, q = draw(), draw()
        a, b = box(*p), box(*q)
        i, shared = a.intersect(b), len(cells(p) & cells(q))
        got = run(spark, a=i.xmin, b=i.ymin, c=i.xmax, d=i.ymax, j=a.jaccard(b), s=a.coverage(b), n=a.size)
        own = cells(p) & cells(q)
        want = (min(x for x, _ in own), min(y for _, y in own), max(x for x, _ in own), max(y for _, y in own)) if own else (0, 0, -1, -1)
        assert (got.a, got.b, got.c, got.d) == want and got.n == len(cells(p))
        assert (got.j, got.s) == pytest.approx((shared / len(cells(p) | cells(q)), shared / len(cells(p))))


def test_normal_boxes(spark):
    n = lambda *v: box(*v, pixel=False)
    assert sides(spark, n(0.125, 0.25, 0.75, 0.875).intersect(n(0.5, 0, 1, 0.5))) == (0.5, 0.25, 0.75, 0.5)
    assert sides(spark, n(0, 0, 0.25, 0.25).intersect(n(0.5, 0.5, 1, 1))) == (0, 0, 0, 0)
    got = run(spark, j=n(0, 0, 0.5, 0.5).jaccard(n(0.25, 0, 0.75, 0.5)), c=n(0, 0, 0.5, 0.5).coverage(n(0.25, 0, 0.75, 0.5)), e=box(3, 3, 2, 2).jaccard(box(3, 3, 2, 2)))
    assert (got.j, got.c, got.e) == pytest.approx((1 / 3, 1 / 2, 0))


@pytest.mark.parametrize("flip", [False, True])
def test_crop_flip_and_rescale(spark, flip):
    """A box follows the pixels of its image through a crop, a flip and a whole-numbered enlargement."""
    image = np.zeros((40, 50), int)
    image[11:19, 7:23] = 1
    x, y, w, h, k = 10, 5, 30, 20, 3
    out = image[y : y + h, x : x + w]
    out = np.kron(out[:, ::-1] if flip else out, np.ones((k, k), int))
    at = np.argwhere(out)
    crop = {n: F.lit(float(v)) for n, v in {"x": x, "y": y, "width": w, "height": h}.items()}
    keep, b = B.transform_box(box(7, 11, 22, 18), crop, F.lit(flip), F.lit(float(k * w)), F.lit(float(k * h)))
    assert run(spark, ok=keep).ok and sides(spark, b) == (at[:, 1].min(), at[:, 0].min(), at[:, 1].max(), at[:, 0].max())
    keep, _ = B.transform_box(box(41, 0, 45, 4), crop, F.lit(flip), F.lit(90.0), F.lit(60.0))
    assert not run(spark, ok=keep).ok


def test_expand_and_normalize(spark):
    assert sides(spark, box(1, 2, 3, 4).expand(10, 20, 100, 100)) == (11, 22, 13, 24)
    with pytest.raises(Exception, match="leave the canvas"):
        sides(spark, box(1, 2, 3, 4).expand(98, 0, 100, 100))
    n = box(10, 20, 29, 39).normalize(F.lit(100.0), F.lit(50.0))
    assert sides(spark, n) == pytest.approx((0.1, 0.4, 0.3, 0.8)) and sides(spark, n.unnormalize(F.lit(100.0), F.lit(50.0))) == pytest.approx((10, 20, 29, 39))
    assert run(spark, ok=n.is_normal()).ok and not run(spark, ok=box(0, 0, 60, 10).normalize(50, 50).is_normal()).ok


@pytest.mark.parametrize("size,out", [((90, 60), (30, 30)), ((64, 200), (16, 10)), ((35, 35), (7, 1)), ((120, 45), (8, 3))])
def test_largest_crop_and_scale(spark, size, out):
    """The crop has the output's proportions and touches a side; the scale is the largest at which the input fits."""
    w, h = B.cropbox_max_proportional(*(F.lit(float(v)) for v in (*size, *out)))
    got = run(spark, w=w, h=h, s=B.calculate_scale(*(F.lit(float(v)) for v in (*size, *out))))
    assert got.w * out[1] == pytest.approx(got.h * out[0]) and got.w <= size[0] + 1e-9 and got.h <= size[1] + 1e-9
    assert got.w == pytest.approx(size[0]) or got.h == pytest.approx(size[1])
    assert max(size[0] * got.s / out[0], size[1] * got.s / out[1]) == pytest.approx(1)


def test_geometry_and_rect(spark):
    b = box(1.4, 2.6, 10.5, 11.5)
    x, y, w, h = b.rect()
    assert tuple(run(spark, x=x, y=y, w=w, h=h)) == (1, 3, 10, 10)
    assert run(spark, s=box(5, 5, 4, 4).size).s == 0 and run(spark, ok=b.equals(b.translate(1e-7, 0))).ok
    with pytest.raises(ValueError):
        B.emit(b, {k: F.lit(1.0) for k in ("x", "y", "width", "height")}, "sideways")

import math

import pytest
from pyspark.sql import functions as F

from loomery.operators import anchors


def test_tile(spark):
    grid = anchors.tile_anchors(spark, 1000, 1000)
    assert grid.count() == 34596 == grid.select("anchor_idx").distinct().count()
    first = grid.orderBy("anchor_idx").limit(2).collect()
    assert (first[1].xmin - first[0].xmin, first[1].ymin - first[0].ymin) == (16, 0)
    assert anchors.base_anchors()[0] == (-84.0, -40.0, 99.0, 55.0)
    got = anchors.inside(grid, 1000, 1000).collect()
    assert got and all(a.xmin >= 0 and a.ymin >= 0 and a.xmax < 1000 and a.ymax < 1000 for a in got)


def brute(boxes, grid):
    def iou(g, a):
        w, h = min(g[2], a[2]) - max(g[0], a[0]) + 1, min(g[3], a[3]) - max(g[1], a[1]) + 1
        size = lambda b: (b[2] - b[0] + 1) * (b[3] - b[1] + 1)
        return w * h / (size(g) + size(a) - w * h) if w > 0 and h > 0 else 0.0

    table = [[iou(g, a) for a in grid] for g in boxes]
    out = []
    for k in range(len(grid)):
        column = [row[k] for row in table]
        best = max(column)
        label = -1
        if best < 0.3:
            label = 0
        if any(row[k] == max(row) for row in table):
            label = 1
        if best >= 0.7:
            label = 1
        out.append((label, column.index(best), best))
    return out


def test_labels_targets_and_sample(spark):
    grid = anchors.inside(anchors.tile_anchors(spark, 160, 160, scales=(2, 4)), 160, 160)
    cells = [(r.anchor_idx, (r.xmin, r.ymin, r.xmax, r.ymax)) for r in grid.orderBy("anchor_idx").collect()]
    images = {1: [(10.0, 10.0, 60.0, 50.0), (30.0, 40.0, 100.0, 90.0)], 2: [(0.0, 0.0, 5.0, 5.0)], 3: [(150.0, 150.0, 159.0, 159.0), (20.0, 20.0, 51.0, 51.0)]}
    rows = [(i, k, *b, k, False) for i, bs in images.items() for k, b in enumerate(bs)]
    boxes = spark.createDataFrame(rows, "image_id long, gt_idx int, xmin double, ymin double, xmax double, ymax double, label int, difficult boolean")
    lattice = anchors.Lattice(160, 160, scales=(2, 4))
    labelled = anchors.label_images(boxes, lattice, F.lit(160), F.lit(160))
    t = anchors.targets(labelled, lattice)
    got = {(r.image_id, r.anchor_idx): r for r in t.collect()}
    for i, bs in images.items():
        for (idx, a), (label, gt, best) in zip(cells, brute(bs, [c for _, c in cells])):
            r, g = got[i, idx], bs[gt]
            assert (r.label, r.gt_idx) == (label, gt) and r.max_iou == pytest.approx(best)
            aw, gw = a[2] - a[0] + 1, g[2] - g[0] + 1
            assert r.dx == pytest.approx(((g[0] + g[2]) / 2 - (a[0] + a[2]) / 2) / aw) and r.dw == pytest.approx(math.log(gw / aw))
    sparse = anchors.sample(labelled, lattice, 16, 0.5, 3)
    s = sparse.select("image_id", F.explode("sample").alias("s")).select("image_id", "s.*")
    per = s.groupBy("image_id").pivot("label", [0, 1]).count().collect()
    for r in per:
        n = sum(1 for (i, _), x in got.items() if i == r.image_id and x.label == 1)
        negative = sum(1 for (i, _), x in got.items() if i == r.image_id and x.label == 0)
        assert r["1"] == min(n, 8) and (r["0"] or 0) == min(negative, 16 - min(n, 8))
    every = spark.createDataFrame([(1,), (2,), (3,), (9,)], "image_id long").join(sparse, "image_id", "left")
    planes = {r.image_id: r for r in anchors.planes(every, lattice).collect()}
    for r in sparse.collect():
        cells, p = {x.anchor_idx: x for x in r["sample"]}, planes[r.image_id]
        for k, side in enumerate(("dx", "dy", "dw", "dh")):
            assert p.bbtargets[600 * k : 600 * (k + 1)] == pytest.approx([cells[i][side] if i in cells and cells[i].label == 1 else 0 for i in range(600)])
        assert p.labels_flat == [int(i in cells and cells[i].label == k) for k in (0, 1) for i in range(600)] and p.labels_mask[:600] == [int(i in cells) for i in range(600)]
    over = anchors.overlaps(boxes, lattice, F.lit(160), F.lit(160))
    assert "NestedLoop" not in over._jdf.queryExecution().executedPlan().toString() and over.where("iou <= 0").count() == 0
    assert len(planes[9].labels_mask) == 2 * 600 and not any(planes[9].labels_mask) and not any(planes[9].bbtargets)
    assert sum(planes[1].labels_mask) == 2 * 16 and len(planes[1].bbtargets) == 4 * 600
    pad = {r.image_id: r for r in anchors.padded_boxes(boxes, 4).collect()}
    assert pad[1].gt_box_count == 2 and pad[1].gt_boxes[4:8] == [30, 40, 100, 90] and pad[1].gt_class_count == [0, 1, 0, 0]


def test_lattice_numbers(spark):
    lattice = anchors.Lattice(200, 170, scales=(2, 4, 8))
    grid = anchors.tile_anchors(spark, 200, 170, scales=(2, 4, 8))
    assert lattice.count == grid.count()
    want = sorted(r.anchor_idx for r in anchors.inside(grid, 150, 190).collect())
    assert sorted(spark.range(1).select(lattice.inside(F.lit(150), F.lit(190)).alias("i")).first().i) == want
    sides = lattice.sides(F.col("anchor_idx"))
    assert grid.withColumns({f"_{k}": v for k, v in sides.items()}).where("xmin <> _xmin or ymin <> _ymin or xmax <> _xmax or ymax <> _ymax").count() == 0
    nothing = spark.range(1).select(lattice.inside(F.lit(3), F.lit(3)).alias("i")).first().i
    assert nothing == []


def test_boxes_that_meet_no_anchor(spark):
    """Then every anchor is the best of that box, with no overlap; or, by choice, negative."""
    lattice = anchors.Lattice(64, 64, ratios=(1,), scales=(1,))
    boxes = spark.createDataFrame([(1, 0, 500.0, 500.0, 510.0, 510.0), (1, 1, 16.0, 16.0, 31.0, 31.0)], "image_id long, gt_idx int, xmin double, ymin double, xmax double, ymax double")
    for rule, far in ((True, 1), (False, 0)):
        got = anchors.label_anchors(anchors.label_images(boxes, lattice, F.lit(64), F.lit(64), zero_column_positive=rule), lattice).collect()
        assert len(got) == 16 and {r.label for r in got if r.max_iou == 0} == {far} and [r.gt_idx for r in got if r.max_iou == 1] == [1]
        assert {r.gt_idx for r in got if r.max_iou == 0} == {0}

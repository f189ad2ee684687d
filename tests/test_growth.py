"""What grew faster than its input, or too near a limit."""

import tracemalloc

from pyspark.sql import Row
from pyspark.sql import functions as F

from loomery.functions.boxes import Box
from loomery.operators import anchors, augment
from loomery.plans import cache
from loomery.sources import containers

SAMPLERS = [
    {"max_sample": 2, "max_trials": 6, "sampler": {"scale": (0.3, 1.0), "aspect_ratio": (0.5, 2.0)}, "sample_constraint": {"min_jaccard_overlap": 0.1, "max_object_coverage": 0.4}},
    {"max_trials": 4, "sampler": {"scale": (0.5, 0.9)}, "sample_constraint": {"min_sample_coverage": 0.1, "max_sample_coverage": 0.6}},
    {"max_trials": 2, "sample_constraint": {}},
]


def test_patches_are_tested_in_batches(spark, monkeypatch):
    monkeypatch.setattr(augment, "CELLS", 100)
    nan = float("nan")
    odd = [None, [], [None], [(0.1, 0.1, 0.9, 0.9), (0.2, None, 0.4, 0.8)], [(nan, 0.1, 0.5, 0.5)], [(0.1, 0.1, nan, 0.5)], [(0.5, 0.5, 0.2, 0.2)], [(0.3, 0.3, 0.3, 0.9)], [(0.1, 0.2, 0.8, None)]]
    rows = [(i, o) for i, o in enumerate(odd)] + [(100 + i, [(i % 7 / 10, i % 5 / 10, i % 7 / 10 + 0.3, 0.9)] * (i % 3)) for i in range(40)] + [(None, [(0.1, 0.1, 0.9, 0.9)]), (None, None)]
    images = spark.createDataFrame(rows, "image_id long, objects array<struct<xmin: double, ymin: double, xmax: double, ymax: double>>")
    patch = Box.cols("xmin", "ymin", "xmax", "ymax", pixel=False)
    for mode in ("first", "any"):
        tests = [augment.satisfies(patch, F.col("objects"), s["sample_constraint"], mode) for s in SAMPLERS]
        want = augment.sampler_patches(images, SAMPLERS, 3).withColumn("meets", F.when(F.col("sampler") == 0, tests[0]).when(F.col("sampler") == 1, tests[1]).otherwise(tests[2])).drop("objects")
        got = augment.tested_patches(images, SAMPLERS, 3, mode=mode)
        assert got.columns == ["image_id", *want.drop("image_id").columns]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)

    found = {r.image_id: r for r in augment.batch_samples(images.where("image_id is not null"), SAMPLERS, 3).collect()}
    good = {}
    for r in sorted(augment.tested_patches(images, SAMPLERS, 3).where("meets and image_id is not null").collect(), key=lambda r: r[:3]):
        mine = good.setdefault(r.image_id, [])
        if r.sampler or sum(x.sampler == 0 for x in mine) < 2:
            mine.append(r)
    assert all(tuple(found[i]) in {tuple(r[:7]) for r in good[i]} for i in found) and len(found) == len(rows) - 2
    assert len({(r.sampler, r.trial) for r in found.values()}) > 3
    nothing = augment.batch_samples(images.where("image_id is null"), SAMPLERS, 3).collect()
    assert [tuple(r) for r in nothing] == [(None, -1, -1, 0.0, 0.0, 1.0, 1.0)] * 2


def test_archives_are_written_and_read_as_they_come(tmp_path, monkeypatch):
    class Here:
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(containers, "TaskContext", type("T", (), {"get": staticmethod(Here)}))
    rows = lambda: (Row(path="", record=0, elements=[str(i).encode(), bytes([i % 251]) * 500_001]) for i in range(300))
    writer, none = containers._ArchiveWriter(str(tmp_path / "a"), False), containers._ArchiveWriter(str(tmp_path / "b"), False)
    tracemalloc.start()
    writer.commit([writer.write(rows()), none.write(iter([]))])
    reader = containers._ArchiveReader(str(tmp_path / "a"))
    n = 0
    for part in reader.partitions():
        for batch in reader.read(part):
            for r in batch.to_pylist():
                assert r["record"] == n and r["elements"] == [str(n).encode(), bytes([n % 251]) * 500_001]
                n += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300 and peak < 50 << 20  # of 150 MB
    (path,) = (tmp_path / "a").iterdir()
    assert path.read_bytes() == containers.write_archive([[bytes(x) for x in r.elements] for r in rows()])


def test_targets_join_nothing_more_than_labels(spark):
    lattice = anchors.Lattice(64, 64, scales=(1, 2))
    boxes = spark.createDataFrame([(1, 0, 3.0, 4.0, 30.0, 30.0), (1, 1, 20.0, 20.0, 50.0, 60.0)], "image_id long, gt_idx int, xmin double, ymin double, xmax double, ymax double")
    images = anchors.label_images(boxes, lattice, 64, 64)
    plans = [anchors.label_anchors(images, lattice), anchors.targets(images, lattice)]
    joins = [sum("Join" in line for line in p._jdf.queryExecution().optimizedPlan().toString().splitlines()) for p in plans]
    assert joins[0] == joins[1]


def test_a_scan_has_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    df = spark.range(103).selectExpr("id AS row_idx", "id * 2 AS v", "id div 11 AS block_id")
    path = str(tmp_path / "cache")
    cache.write(df, path)
    scan = lambda: cache.scan(spark, path, df.columns, 103, 10, 5, 2, 3)
    want = sorted(map(tuple, scan().collect()))
    monkeypatch.setattr(cache, "MAX_TASKS", 3)
    few = scan()
    assert few.rdd.getNumPartitions() <= 3 and sorted(map(tuple, few.collect())) == want and len(want) == 206

import base64
import json

import numpy as np
import pytest

from loomery.plans import config
from loomery.plans.loader import DataLoader
from loomery.sources import containers


def picture(i, h=8, w=8):
    return np.tile(np.array([i >> 16 & 255, i >> 8 & 255, i & 255], "u1"), (h, w, 1))


def write(path, n, kinds, row):
    path.write_text("@" + "\t".join(kinds) + "\n" + "".join("\t".join(row(i)) + "\n" for i in range(n)))
    return str(path)


def images(path, n, broken=()):
    enc = lambda i: base64.b64encode(b"junk" if i in broken else containers.write_png(picture(i))).decode()
    return write(path, n, ["BINARY", "STRING"], lambda i: (enc(i), str(i)))


def etl(**image):
    return [{"type": "image", "height": 8, "width": 8, "channel_major": False, **image}, {"type": "label"}]


def ids(batch):
    img = dict(batch)["image"][:, 0, 0].astype(int)
    return (img[:, 0] << 16 | img[:, 1] << 8 | img[:, 2]).tolist()


def test_once_wraps(spark, tmp_path):
    m = images(tmp_path / "m.tsv", 10)
    loader = DataLoader(spark, {"manifest_filename": m, "batch_size": 4, "etl": etl()})
    assert len(loader) == 10 and loader.batch_count == 3 and loader.get_buffer_names() == ["image", "label"]
    assert loader.axes_info[0] == ("image", (("height", 8), ("width", 8), ("channels", 3)))
    batches = list(loader)
    assert [ids(b) for b in batches] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 0, 1]]
    assert dict(batches[1])["label"].tolist() == [[4], [5], [6], [7]] and dict(batches[0])["label"].dtype == np.uint32
    assert [ids(b) for b in loader] == [ids(b) for b in batches]
    assert ids(next(loader)) == [0, 1, 2, 3] and ids(next(loader)) == [4, 5, 6, 7]
    loader.reset()
    assert ids(next(loader)) == [0, 1, 2, 3]
    assert loader.schema()["image"].metadata["otype"] == "uint8_t"


def test_modes(spark, tmp_path):
    m = images(tmp_path / "m.tsv", 10)
    assert len(list(DataLoader(spark, {"manifest_filename": m, "batch_size": 3, "etl": etl(), "iteration_mode": "COUNT", "iteration_mode_count": 4}))) == 4
    endless = iter(DataLoader(spark, {"manifest_filename": m, "batch_size": 6, "etl": etl(), "iteration_mode": "INFINITE"}))
    assert sum((ids(next(endless)) for _ in range(5)), []) == [i % 10 for i in range(30)]


def test_shuffle_cache_and_shards(spark, tmp_path):
    m = images(tmp_path / "m.tsv", 20)
    base = {"manifest_filename": m, "batch_size": 5, "block_size": 7, "etl": etl(), "random_seed": 3}
    got = [i for b in DataLoader(spark, base | {"shuffle_enable": True, "shuffle_manifest": True}) for i in ids(b)]
    assert sorted(got) == list(range(20)) != got
    for _ in range(2):
        cached = DataLoader(spark, base | {"cache_directory": str(tmp_path / "cache")})
        assert [i for b in cached for i in ids(b)] == list(range(20))
    nodes = [[i for b in DataLoader(spark, base | {"node_id": k, "node_count": 2}) for i in ids(b)] for k in (0, 1)]
    assert sorted(nodes[0] + nodes[1]) == list(range(20)) and nodes[0] == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]
    assert len(DataLoader(spark, base | {"subset_fraction": 0.5})) == 10


def test_epochs_under_shuffle_manifest(spark, tmp_path):
    """Every pass has its own order of blocks, or of records dealt to nodes; batches go on across passes."""
    n, bs = 60, 4
    m = write(tmp_path / "m.tsv", n, ["STRING"], lambda i: (str(i),))
    base = {"manifest_filename": m, "batch_size": bs, "block_size": 6, "etl": [{"type": "label"}], "shuffle_manifest": True, "random_seed": 2, "iteration_mode": "COUNT"}
    labels = lambda given: [int(x) for b in DataLoader(spark, given) for x in b[0][1].ravel()]
    got = labels(base | {"iteration_mode_count": 3 * n // bs})
    passes = [tuple(got[k * n : (k + 1) * n]) for k in range(3)]
    assert all(sorted(p) == list(range(n)) for p in passes) and len(set(passes)) == 3
    blocks = [{p[i : i + 6] for i in range(0, n, 6)} for p in passes]
    assert blocks[0] == blocks[1] == blocks[2]  # the same blocks, each as it was
    for mixed in (False, True):
        per = n // 3
        nodes = [labels(base | {"iteration_mode_count": 3 * per // bs, "node_id": k, "node_count": 3, "shuffle_enable": mixed}) for k in range(3)]
        deals = [[tuple(x[e * per : (e + 1) * per]) for x in nodes] for e in range(3)]
        assert all(sorted(sum(d, ())) == list(range(n)) for d in deals) and len({d[0] for d in deals}) == 3
    endless = iter(DataLoader(spark, base | {"iteration_mode": "INFINITE"}))
    assert [int(x) for _ in range(3 * n // bs) for x in next(endless)[0][1].ravel()] == got


def test_batches_are_assembled_in_tasks(spark, tmp_path):
    m = images(tmp_path / "m.tsv", 10, broken=(6,))
    loader = DataLoader(spark, {"manifest_filename": m, "batch_size": 4, "etl": etl(), "batch_major": False})
    made = {r.batch_id: r for r in loader.batch_plan().collect()}
    assert sorted(made) == [0, 1, 2] and {r.n_bytes for r in made.values()} == {4 * (8 * 8 * 3 + 4)} == {len(made[0].a0) + len(made[0].a1)}
    assert made[0]._error is None and made[1]._error.startswith("record 6: ") and made[2]._error is None
    images_ = np.frombuffer(made[2].a0, "u1").reshape(8 * 8 * 3, 4)
    assert images_[2].tolist() == [8, 9, 0, 1] and np.frombuffer(made[2].a1, "<u4").tolist() == [8, 9, 0, 1]
    run = iter(loader)
    next(run)[0][1][:] = 0  # arrays are the user's own
    with pytest.raises(RuntimeError, match="record 6"):
        next(run)


def test_a_provider_of_ones_own(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomery.plans import providers

    def add(df, cfg, element, aug):
        n = F.length(element)
        error = F.coalesce("_error", F.when(n > cfg["most"], F.lit("too long")))
        return df.withColumns({providers.column_name("length", cfg["name"]): F.array(n), "_error": error})

    own = providers.Provider(lambda c: [(f"{c['name']}.length", (1,), "uint8_t", ("n",))], add)
    providers.register("text_length", own, {"most": config.Key(convert=int, check=lambda v: v > 0)})
    try:
        m = write(tmp_path / "m.tsv", 4, ["STRING", "STRING"], lambda i: ("x" * (i + 1), str(i)))
        given = {"manifest_filename": m, "batch_size": 2, "etl": [{"type": "text_length", "most": 3, "name": "t"}, {"type": "label"}]}
        run = iter(DataLoader(spark, given))
        b = dict(next(run))
        assert b["t.length"].tolist() == [[1], [2]] and b["t.length"].dtype == np.uint8 and b["label"].tolist() == [[0], [1]]
        with pytest.raises(RuntimeError, match="record 3: too long"):
            next(run)
        for broken, what in (({"type": "text_length"}, "'most' not set"), ({"type": "text_length", "most": 0}, "out of range"), ({"type": "text_length", "mosd": 1}, "did you mean 'most'")):
            with pytest.raises(ValueError, match=what):
                config.loader(given | {"etl": [broken, {"type": "label"}]})
        with pytest.raises(ValueError, match="already"):
            providers.register("text_length", own, {})
    finally:
        providers.unregister("text_length")
    with pytest.raises(ValueError, match="unsupported etl type"):
        config.loader(given)


def test_batch_minor(spark, tmp_path):
    m = write(tmp_path / "m.tsv", 6, ["STRING"], lambda i: (str(i),))
    b = next(iter(DataLoader(spark, {"manifest_filename": m, "batch_size": 3, "batch_major": False, "etl": [{"type": "label", "output_type": "float"}]})))
    assert b[0][1].tolist() == [[0, 1, 2]] and b[0][1].dtype == np.float32


def test_text_and_blob(spark, tmp_path):
    raw = lambda i: base64.b64encode(np.arange(4, dtype="f4") + i).decode()
    m = write(tmp_path / "m.tsv", 4, ["STRING", "STRING", "BINARY"], lambda i: ("abc"[: i + 1], "x y", raw(i)))
    spec = [{"type": "char_map", "max_length": 4, "alphabet": "abc", "emit_length": True, "name": "t"}, {"type": "label_map", "class_names": ["x", "y"], "max_classes": 3}, {"type": "blob", "output_count": 4}]
    b = dict(next(iter(DataLoader(spark, {"manifest_filename": m, "batch_size": 4, "etl": spec}))))
    assert list(b) == ["t.char_map", "t.char_map_length", "label_map", "blob"]
    assert b["t.char_map"][2].tolist() == [[0, 1, 2, 0]] and b["t.char_map_length"].ravel().tolist() == [1, 2, 3, 3]
    assert b["label_map"][0].tolist() == [0, 1, 0] and b["blob"][3].tolist() == [3, 4, 5, 6]


def test_boxes_follow_the_image(spark, tmp_path):
    def row(i):
        note = {"object": [{"bndbox": {"xmin": 1, "ymin": 2, "xmax": 4, "ymax": 5}, "name": "cat"}], "size": {"width": 8, "height": 8, "depth": 3}}
        img = np.zeros((8, 8, 3), "u1")
        img[2:6, 1:5] = 200
        png = base64.b64encode(containers.write_png(img)).decode()
        return (png, json.dumps(note), json.dumps(note), png)

    m = write(tmp_path / "m.tsv", 6, ["BINARY", "STRING", "STRING", "BINARY"], row)
    spec = [{"type": "image", "height": 8, "width": 8, "channel_major": False}, {"type": "boundingbox", "height": 8, "width": 8, "max_bbox_count": 2, "class_names": ["cat"]}, {"type": "localization_ssd", "height": 8, "width": 8, "max_gt_boxes": 2, "class_names": ["cat"]}, {"type": "pixelmask", "height": 8, "width": 8, "channels": 1, "channel_major": False}]
    b = dict(next(iter(DataLoader(spark, {"manifest_filename": m, "batch_size": 6, "etl": spec, "augmentation": [{"type": "image", "flip_enable": True}], "random_seed": 5}))))
    flips = set()
    for k in range(6):
        ys, xs = np.nonzero(b["image"][k, :, :, 0] > 100)
        assert b["boundingbox"][k, 0].tolist() == [xs.min(), ys.min(), xs.max(), ys.max()] and (b["pixelmask"][k] > 0).sum() == 16
        assert np.allclose(b["gt_boxes"][k, 0] * 8, [xs.min(), ys.min(), xs.max() + 1, ys.max() + 1])
        flips.add(xs.min())
    assert flips == {1, 3} and b["gt_box_count"].ravel().tolist() == [1] * 6 and b["image_shape"][0].ravel().tolist() == [8, 8]


def test_rcnn_and_video(spark, tmp_path):
    def row(i):
        note = {"object": [{"bndbox": {"xmin": 8, "ymin": 8, "xmax": 40, "ymax": 40}, "name": "cat"}], "size": {"width": 64, "height": 64, "depth": 3}}
        png = base64.b64encode(containers.write_png(picture(i, 64, 64))).decode()
        return (png, json.dumps(note))

    m = write(tmp_path / "m.tsv", 2, ["BINARY", "STRING"], row)
    spec = [{"type": "image", "height": 64, "width": 64}, {"type": "localization_rcnn", "height": 64, "width": 64, "class_names": ["cat"], "scales": [1, 2], "rois_per_image": 8, "max_gt_boxes": 3}]
    b = dict(next(iter(DataLoader(spark, {"manifest_filename": m, "batch_size": 2, "etl": spec}))))
    a = 3 * 2 * 16
    assert b["image"].shape == (2, 3, 64, 64) and b["bbtargets"].shape == (2, 4 * a) and b["labels_flat"].shape == (2, 1, 2 * a)
    assert b["labels_mask"].sum() == 2 * 2 * 8 and b["gt_boxes"][0, 0].tolist() == [8, 8, 40, 40] and b["gt_box_count"].ravel().tolist() == [1, 1]
    film = lambda i: (base64.b64encode(containers.write_avi([containers.write_png(picture(i + k)) for k in range(3)], 8, 8)).decode(),)
    m = write(tmp_path / "v.tsv", 2, ["BINARY"], film)
    v = dict(next(iter(DataLoader(spark, {"manifest_filename": m, "batch_size": 2, "etl": [{"type": "video", "max_frame_count": 4, "frame": {"height": 8, "width": 8}}]}))))["video"]
    assert v.shape == (2, 3, 4, 8, 8) and v[1, 2, :, 0, 0].tolist() == [1, 2, 3, 0]


def test_errors(spark, tmp_path):
    with pytest.raises(RuntimeError, match="record 0: Decoding image failed"):
        DataLoader(spark, {"manifest_filename": images(tmp_path / "b.tsv", 3, broken=(0,)), "batch_size": 1, "etl": etl()})
    m = images(tmp_path / "m.tsv", 3)
    good = {"manifest_filename": m, "batch_size": 1, "etl": etl()}
    cases = [
        ({k: v for k, v in good.items() if k != "batch_size"}, "Required Argument: 'batch_size' not set"), (good | {"batch_sizes": 1}, "did you mean 'batch_size'"), (good | {"qqq": 1}, "config element {qqq: 1} is not understood$"),
        (good | {"subset_fraction": 2.0}, "out of range"), (good | {"iteration_mode": "TWICE"}, "iteration_mode"), (good | {"node_count": 2, "node_id": 2}, "node_id"), (good | {"etl": [{"type": "sound"}]}, "unsupported etl type 'sound'"),
        (good | {"etl": [{"height": 1}]}, "missing required 'type'"), (good | {"augmentation": [{"flip_enable": True}]}, "missing required 'type'"), (good | {"augmentation": [{"type": "image", "flip_enabled": True}]}, "did you mean 'flip_enable'"),
        (good | {"iteration_mode": "COUNT"}, "positive"), (good | {"augmentation": [{"type": "image", "scale": [0.5, 2]}]}, "out of range"),
    ]
    for given, what in cases:
        with pytest.raises(ValueError, match=what):
            config.loader(given)
    with pytest.raises(TypeError):
        config.to_json([1])
    with pytest.raises(FileNotFoundError):
        DataLoader(spark, good | {"manifest_filename": str(tmp_path / "none")})


def test_config_tools(monkeypatch):
    assert config.parse_cpu_list("7,1-3,2", 8) == [1, 2, 3, 7]
    with pytest.raises(ValueError):
        config.parse_cpu_list("5", 4)
    assert config.edit_distance("flaw", "lawn") == 2 and "batch_size: REQUIRED" in config.dump_defaults("loader")
    monkeypatch.setenv("LOOMERY_LOG_LEVEL", "info")
    assert config.log_level() == "INFO"


def test_stream(spark, tmp_path):
    from loomery.streaming import manifests

    (tmp_path / "in").mkdir()
    for k in range(2):
        write(tmp_path / "in" / f"{k}.tsv", 5, ["STRING"], lambda i, k=k: (f"{k}:{i}",))
    seen = []
    q = manifests.for_each_batch(manifests.record_stream(spark, str(tmp_path / "in")), 2, lambda df, _: seen.append(sorted((r.batch_id, r.slot, r.e[0]) for r in df.collect())), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted(len(s) for s in seen) == [5, 5] and all([b for b, *_ in s] == [0, 0, 1, 1, 2] for s in seen)


def test_a_batch_opens_its_files_only(spark, tmp_path):
    """Making a loader, and its first batch, leave the files of far batches alone; order holds in a shuffled run too."""
    n, bs = 200, 4
    for i in range(n):
        if i < 40:
            (tmp_path / f"{i}.png").write_bytes(containers.write_png(picture(i)))
    m = write(tmp_path / "m.tsv", n, ["FILE", "STRING"], lambda i: (f"{i}.png", str(i)))
    loader = DataLoader(spark, {"manifest_filename": m, "manifest_root": str(tmp_path), "batch_size": bs, "etl": etl()})
    run = iter(loader)
    assert [ids(next(run)) for _ in range(5)] == [[4 * k + j for j in range(4)] for k in range(5)]
    with pytest.raises(RuntimeError, match="record 40: Could not find file"):
        list(run)
    text = write(tmp_path / "t.tsv", n, ["STRING"], lambda i: (str(i),))
    got = [int(x) for b in DataLoader(spark, {"manifest_filename": text, "batch_size": 7, "shuffle_manifest": True, "random_seed": 4, "etl": [{"type": "label"}]}) for x in b[0][1].ravel()]
    assert sorted(got[:n]) == list(range(n)) and got[n:] == got[: len(got) - n]


def test_depth_debug_and_batch_bytes(spark, tmp_path):
    from loomery.plans import batches

    m = images(tmp_path / "m.tsv", 6)
    spec = [{"type": "image", "height": 8, "width": 8, "channel_major": False}, {"type": "label"}]
    loader = DataLoader(spark, {"manifest_filename": m, "batch_size": 3, "etl": spec, "augmentation": [{"type": "image", "debug_output_directory": str(tmp_path / "debug"), "flip_enable": True}]})
    got = list(loader)
    for b in got:
        back = batches.from_bytes(batches.to_bytes(b))
        assert [n for n, _ in back] == [n for n, _ in b] and all(x.dtype == y.dtype and (x == y).all() for (_, x), (_, y) in zip(back, b))
    for i in range(6):
        assert (containers.read_png((tmp_path / "debug" / f"{i}.png").read_bytes()) == dict(got[i // 3])["image"][i % 3]).all()
        assert "crop_width" in json.loads((tmp_path / "debug" / f"{i}.txt").read_text())
    assert len(list((tmp_path / "debug").iterdir())) == 12
    depth = dict(next(iter(DataLoader(spark, {"manifest_filename": m, "batch_size": 6, "etl": [{"type": "depthmap", "height": 4, "width": 4, "output_type": "float"}, {"type": "label"}]}))))["depthmap"]
    assert depth.shape == (6, 1, 4, 4) and depth.dtype == np.float32 and (depth[5] == 0).all()


def test_narrow_configuration():
    assert json.loads(config.to_json({"a": 2**32 + 5, "b": [0.1, True, None, ("x", {"c": -(2**31) - 1})]})) == {"a": 5, "b": [float(np.float32(0.1)), True, None, ["x", {"c": 2**31 - 1}]]}
    with pytest.raises(TypeError):
        config.to_json({"a": b"bytes"})


def test_cached_blocks_are_shuffled_where_they_are_read(spark, tmp_path):
    from loomery.operators import rows
    from loomery.plans import cache

    df = rows.with_blocks(spark.range(103).selectExpr("id as row_idx", "cast(id as string) as v"), 103, 10)
    path = str(tmp_path / "cache")
    cache.store(df, path)
    for within, order in ((True, True), (True, False), (False, True)):
        got = cache.scan(spark, path, df.columns, 103, 10, 5, 2, 3, within, order)
        want = rows.shuffle_blocks(rows.with_epochs(df, 2, 3), 5, within=within, block_order=order).select(got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.rdd.getNumPartitions() == 2 * 10
    m = images(tmp_path / "m.tsv", 20)
    base = {"manifest_filename": m, "batch_size": 5, "block_size": 7, "etl": etl(), "random_seed": 3, "shuffle_enable": True, "shuffle_manifest": True, "iteration_mode": "COUNT", "iteration_mode_count": 8}
    plain = [i for b in DataLoader(spark, base) for i in ids(b)]
    assert [i for b in DataLoader(spark, base | {"cache_directory": str(tmp_path / "c")}) for i in ids(b)] == plain
    assert sorted(plain[:20]) == sorted(plain[20:]) == list(range(20)) and plain[:20] != plain[20:]


def test_cache_has_one_winner(spark, tmp_path):
    from loomery.plans import cache

    df = spark.range(50).selectExpr("id as row_idx", "id div 10 as block_id", "cast(id as string) as v")
    path = str(tmp_path / "cache")
    (tmp_path / "cache").mkdir()
    for _ in range(2):
        assert cache.store(df, path).count() == 50
    assert [x.name for x in tmp_path.iterdir()] == ["cache"] and cache.load(spark, path, df.columns, 3).count() == 10

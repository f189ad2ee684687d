import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import audio
from loomery.operators import pixels
from loomery.sources import annotations, containers, manifest

TEXT = "# comment\n@STRING\tBINARY\tASCII_INT\tASCII_FLOAT\tFILE\n\nx\tAQID\t3.9\t0.5\ta.txt\n#y\ny\t\t-1.7\t2\t/b.txt\nz\t!!\tq\t1\tc\n"


def test_manifest(spark):
    kinds, rec = manifest.parse(manifest.lines_of(spark, TEXT))
    got = manifest.typed(rec, kinds, "/root").orderBy("row_idx").collect()
    assert kinds == ["STRING", "BINARY", "ASCII_INT", "ASCII_FLOAT", "FILE"] and [r.row_idx for r in got] == [0, 1, 2]
    assert (bytes(got[0].e1), got[0].e2, got[0].e3, got[0].e4) == (b"\1\2\3", 3, 0.5, "/root/a.txt")
    assert (got[1].e2, got[1].e4, got[1]._error) == (-1, "/b.txt", None) and "element" in got[2]._error


@pytest.mark.parametrize("text,what", [("a\tb\n", "before any data"), ("@STRING\na\tb\n", "at line: 1"), ("@STRING\na\n@STRING\n", "only once"), ("a\n@STRING\n", "before any data"), ("@WHAT\na\n", "invalid metadata")])
def test_manifest_errors(spark, text, what):
    with pytest.raises((ValueError, RuntimeError), match=what):
        manifest.parse(manifest.lines_of(spark, text))


def test_manifest_file(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "m.tsv").write_text("@FILE\tSTRING\n" + "".join(f"{'a' if i % 2 else 'none'}.txt\t{i}\n" for i in range(50)))
    kinds, rec = manifest.parse(manifest.read_lines(spark, str(tmp_path / "m.tsv")))
    got = manifest.load_files(manifest.typed(rec, kinds, str(tmp_path)), kinds).orderBy("row_idx").collect()
    assert [r.e1 for r in got] == [str(i) for i in range(50)]
    assert bytes(got[1].e0) == b"hello" and got[0].e0 is None and "Could not find" in got[0]._error
    with pytest.raises(FileNotFoundError):
        manifest.read_lines(spark, str(tmp_path / "missing"))


def test_crc32c(spark):
    assert manifest.crc32c(b"123456789") == 0xE3069283
    for cut in range(10):
        a, b = b"123456789"[:cut], b"123456789"[cut:]
        assert manifest.crc32c_combine(manifest.crc32c(a), manifest.crc32c(b), len(b)) == 0xE3069283
    rows = [(i, [f"{i}", "é"]) for i in range(100)]
    df = spark.createDataFrame(rows, "row_idx long, e array<string>").repartition(6)
    assert manifest.manifest_crc(df) == manifest.crc32c("".join(x for _, e in rows for x in e).encode())
    assert manifest.version(0xAB) == "000000ab"


def test_archive(spark, tmp_path):
    records = [[f"{r}:{e}".encode() * (r % 3 + 1) for e in range(2)] for r in range(30)]
    data = containers.write_archive(records)
    assert containers.read_archive(data) == records and struct.unpack("<H", data[:2])[0] == 0o070707
    with pytest.raises(ValueError):
        containers.read_archive(b"\0" * 40)
    containers.register(spark)
    df = spark.createDataFrame([("", r, e) for r, e in enumerate(records)], "path string, record int, elements array<binary>").repartition(3)
    df.write.format("blockarchive").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("blockarchive").load(str(tmp_path / "out"))
    assert sorted([bytes(x) for x in r.elements] for r in back.collect()) == sorted(records)


def picture(h=12, w=10, c=3, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype("u1")


def test_images():
    img = picture()
    assert (containers.read_png(containers.write_png(img)) == img).all() and (containers.read_png(containers.write_png(img[..., :1])) == img[..., :1]).all()
    for dtype in ("u1", "u2", "f4"):
        assert (containers.read_raw_image(containers.write_raw_image(img.astype(dtype))) == img.astype(dtype)).all()
    assert containers.decode_image(containers.write_png(img), 1).shape == (12, 10, 1)
    for broken in (b"", b"junk", None):
        with pytest.raises(ValueError, match="Decoding image failed"):
            containers.decode_image(broken)


def test_spark_reads_our_png(spark, tmp_path):
    img = picture(seed=3)
    (tmp_path / "a.png").write_bytes(containers.write_png(img))
    (tmp_path / "b.png").write_bytes(b"broken")
    got = {r.path[-5]: r for r in containers.image_files(spark, str(tmp_path)).collect()}
    assert (np.frombuffer(bytes(got["a"].data), "u1").reshape(12, 10, 3) == img).all() and got["b"]._error


def jpeg(spark, path, w, h, grey=False):
    jvm = spark._jvm
    img = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    for y in range(h):
        for x in range(w):
            img.setRGB(x, y, min(255, x * 6) << 16 | min(255, y * 5) << 8 | (x * y) % 256 // 2 + 60)
    jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(str(path)))
    return path.read_bytes()


@pytest.mark.parametrize("w,h,grey", [(37, 23, False), (8, 8, False), (64, 48, False), (19, 40, True)])
def test_jpeg(spark, tmp_path, w, h, grey):
    """Pixels as Spark's image source has them, to within two levels."""
    raw = jpeg(spark, tmp_path / "a.jpg", w, h, grey)
    want = containers.image_files(spark, str(tmp_path / "a.jpg")).first()
    want = np.frombuffer(bytes(want.data), "u1").reshape(h, w, -1)
    got = containers.decode_image(raw, 1 if grey else 3)
    assert containers.image_size(raw) == (w, h) and got.shape == (h, w, 1 if grey else 3) and np.abs(got.astype(int) - want).max() <= 2
    for broken in (raw[: len(raw) // 2], raw[:20], b"\xff\xd8" + b"x" * 50):
        with pytest.raises(ValueError, match="Decoding image failed"):
            containers.decode_image(broken)


def test_motion_jpeg(spark, tmp_path):
    raw = jpeg(spark, tmp_path / "a.jpg", 16, 16)
    frames = containers.read_avi_frames(containers.write_avi([raw, raw], 16, 16))
    assert len(frames) == 2 and (containers.decode_image(frames[1]) == containers.decode_image(raw)).all()


def test_archive_commits(spark, tmp_path):
    """An append adds, an overwrite replaces, and a job that fails leaves nothing."""
    containers.register(spark)
    out = str(tmp_path / "out")
    make = lambda lo, hi: spark.createDataFrame([("", r, [str(r).encode()]) for r in range(lo, hi)], "path string, record int, elements array<binary>").repartition(2)
    read = lambda: sorted(int(bytes(r.elements[0])) for r in spark.read.format("blockarchive").load(out).collect())
    make(0, 5).write.format("blockarchive").mode("append").save(out)
    make(5, 9).write.format("blockarchive").mode("append").save(out)
    assert read() == list(range(9))
    make(20, 24).write.format("blockarchive").mode("overwrite").save(out)
    assert read() == list(range(20, 24))
    bad = make(30, 34).withColumn("elements", F.when(F.col("record") == 33, F.array(F.lit(b"x"), F.lit(b"y"))).otherwise(F.col("elements"))).coalesce(1)
    with pytest.raises(Exception, match="differ"):
        bad.write.format("blockarchive").mode("append").save(out)
    assert read() == list(range(20, 24)) and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".block")]


def test_crc_of_many():
    rng = np.random.default_rng(3)
    texts = [rng.bytes(int(n)) for n in rng.integers(0, 40, 60)] + [b"", b"123456789"]
    assert manifest.crc32c_many(texts).tolist() == [manifest.crc32c(t) for t in texts] and manifest.crc32c_many([]).tolist() == []


def test_video():
    frames = [containers.write_png(picture(seed=s)) + b"x" * (s % 2) for s in range(25)]
    data = containers.write_avi(frames, 10, 12)
    assert containers.read_avi_frames(data) == frames
    with pytest.raises(ValueError, match="index"):
        containers.read_avi_frames(data[: data.index(b"idx1")])
    with pytest.raises(ValueError):
        containers.read_avi_frames(b"RIFFxxxxWAVE")


def test_annotations(spark):
    box = lambda *v: dict(zip(("xmin", "ymin", "xmax", "ymax"), v))
    good = {"object": [{"bndbox": box(47, 239, 194, 370), "name": "dog", "truncated": True}, {"bndbox": box(7, 11, 351, 497), "name": "person"}], "size": {"width": 353, "height": 500, "depth": 3}}
    rows = [good, {**good, "object": [{"bndbox": box(1, 2, 3, 4), "name": "cow"}]}, {"object": []}, {**good, "object": [{"name": "dog"}]}, {"size": good["size"]}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "id int, j string")
    got = annotations.parse_annotations(df, "j", ["person", "dog"]).orderBy("id").collect()
    assert [(b.xmin, b.label, b.difficult, b.truncated) for b in got[0].boxes] == [(47, 1, False, True), (7, 0, False, False)] and (got[0].width, got[0].height) == (353, 500)
    assert all(r.boxes is None for r in got[1:]) and ["class" in got[1]._error, "size" in got[2]._error, "bndbox" in got[3]._error, "object" in got[4]._error] == [True] * 4


def test_kernels():
    img = picture(20, 30)
    assert (pixels.rotate(img, 0) == img).all() and (pixels.rotate(img, 360)[2:-2, 2:-2] == img[2:-2, 2:-2]).all()
    assert pixels.expand(img, 3, 4, 60, 50)[4:24, 3:33].tolist() == img.tolist()
    with pytest.raises(ValueError):
        pixels.expand(img, 40, 0, 60, 50)
    for method in ("nearest", "LINEAR", "Cubic", "AREA", "LANCZOS4"):
        flat = np.full((9, 7, 3), 77, "u1")
        assert (pixels.resize(flat, 15, 4, method) == 77).all() and pixels.resize(img, 30, 20, method) is img
    with pytest.raises(ValueError):
        pixels.resize(img, 3, 3, "BEST")
    assert pixels.resize(np.arange(16, dtype="u1").reshape(4, 4, 1), 2, 2, "AREA").ravel().tolist() == [2, 4, 10, 12]
    assert pixels.resize_short(img, 10).shape == (10, 15, 3) and pixels.add_padding(img, 2, 2, 2).tolist() == img.tolist()
    assert (pixels.colour_jitter(img) == img).all()
    assert np.abs(pixels.shift_hue(img, 180).astype(int) - img).max() <= 6 and (pixels.shift_hue(img, -10) != img).any()
    assert (pixels.colour_jitter(img, contrast=0)[..., 0] == np.rint(img[..., 0].mean())).all()
    grey = pixels.colour_jitter(img, saturation=0)
    assert (np.abs(grey[..., 0].astype(int) - (img @ np.array(pixels.GREY))) <= 1).all()
    assert (pixels.lighting(img, [], 0.1) == img).all() and pixels.lighting(img, [0.1, 0, 0], 0.1).shape == img.shape
    s = pixels.standardize(img, [0.5, 0.4, 0.3], [0, 1, 2])
    assert np.allclose(s[..., 0], img[..., 0] / 255 - 0.5) and np.allclose(s[..., 2], (img[..., 2] / 255 - 0.3) / 2)
    with pytest.raises(ValueError):
        pixels.standardize(img, [1], [])
    assert pixels.layout(img, True, True, "f4").shape == (3, 20, 30) and (pixels.layout(img, False, True, "u1") == img[..., ::-1]).all()
    aug = {"crop_x": 5, "crop_y": 2, "crop_width": 10, "crop_height": 8, "out_width": 20, "out_height": 16, "flip": True}
    assert pixels.transform_image(img, aug).shape == (16, 20, 3)
    m = pixels.transform_mask(img[..., :1], aug)
    assert set(m.ravel()) <= set(img[2:10, 5:15, 0].ravel())
    assert pixels.pad_frames([img, img], 4).shape == (3, 4, 20, 30) and pixels.pad_frames([img] * 5, 2).shape == (3, 2, 20, 30)


def test_audio(spark):
    wave = np.sin(np.arange(4000) * 2 * np.pi * 1000 / 16000)
    spec = audio.spectrogram(wave, 256, 128, 1000, audio.window_array("hann", 256))
    assert spec.shape == (30, 129) and (spec.argmax(1) == 16).all()
    bank = audio.filterbank(20, 256, 16000)
    assert bank.shape == (129, 20) and bank.max() <= 1
    c = audio.mfcc(audio.cepstrogram(spec, bank), 13)
    assert c.shape == (30, 13) and np.isfinite(c).all()
    for kind in (*audio.COSINES, "bartlett"):
        got = spark.range(1).select(audio.window(kind, 33).alias("w")).first().w
        assert np.allclose(got, audio.window_array(kind, 33))
    assert np.allclose(audio.mel_to_hz(audio.hz_to_mel(440.0)), 440) and spark.range(1).select(F.lit(1)).count() == 1


def test_manifest_in_several_files(spark, tmp_path):
    """Lines follow the names of the files, whatever their sizes, and splits of a long one follow each other."""
    n = 0
    for k, size in enumerate((3, 4000, 1, 0, 700, 2)):
        lines = ["# part"] + ["@STRING\tASCII_INT"] * (k == 0) + [f"{'x' * (i % 50)}\t{n + i}" for i in range(size)] + [""]
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines))
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = manifest.read_lines(spark, str(tmp_path))
        kinds, records = manifest.parse(lines)
        got = records.orderBy("row_idx").collect()
        assert lines.rdd.getNumPartitions() > 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert kinds == ["STRING", "ASCII_INT"] and [r.row_idx for r in got] == list(range(n)) and [int(r.e[1]) for r in got] == list(range(n))
    assert [r.line_no for r in got] == sorted(r.line_no for r in got)
    (tmp_path / "part-9.txt").write_text("only one\n")
    with pytest.raises(RuntimeError, match=f"at line: {got[-1].line_no + 1}, "):
        manifest.parse(manifest.read_lines(spark, str(tmp_path)))

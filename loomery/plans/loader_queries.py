"""Driver queries over what the loader does around its kernels: files, configuration, caches, batches, draws."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..functions import text
from ..functions.boxes import Box
from ..functions.prng import M, sql_draw
from ..operators import anchors, augment, rows
from ..sources import containers, manifest
from ..sources.work import work_path
from . import cache, config, providers
from .loader import DataLoader
from .queries import _BOXES, _ID, _NODES, _ROWS, _SIZE, BATCH, BLOCK, SEED, _sides, _sql_chars, box, boxes, query, r6, records, table


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def write_manifest(spark, sf_dir, columns: dict, kinds: list[str], source: str, key: str) -> str:
    """Lines of a table as a manifest in several files, in the order of a key (null last), with a comment, a header and an empty line before.

    Lines that share a key keep their order. A line's first element must not be empty or begin with # or @, which the format has for its own.
    """
    lines = table(spark, sf_dir, source).select(F.when(F.col(key).isNull(), 2).otherwise(1).alias("part"), F.col(key).cast("long").alias("k"), F.monotonically_increasing_id().alias("tie"), F.concat_ws("\t", *columns.values()).alias("value"))
    head = spark.createDataFrame([(0, 0, 0, "# made for a query"), (0, 0, 1, "@" + "\t".join(kinds)), (0, 0, 2, "")], "part int, k long, tie long, value string")
    path = work_path(spark, "manifest")
    lines.unionByName(head).repartitionByRange("part", "k", "tie").sortWithinPartitions("part", "k", "tie").select("value").write.text(path)
    return path


# --- manifests, archives, caches ------------------------------------------------------------------------------------


@query("""SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS row_idx, event_type AS e0, CASE WHEN event_id % 7 = 0 THEN -1 ELSE (event_id % 1000)::INTEGER END AS e1, event_id % 7 = 0 AS broken FROM events""")
def manifest_file(spark, sf_dir):
    """A manifest file with header, comment and empty line, read, parsed and typed; every seventh number is none."""
    number = F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.concat((F.col("event_id") % 1000).cast("string"), F.lit(".9")))
    path = write_manifest(spark, sf_dir, {"a": number, "b": F.col("event_type")}, ["ASCII_INT", "STRING"], "events", "event_id")
    kinds, found = manifest.parse(manifest.read_lines(spark, path))
    return manifest.typed(found, kinds).select("row_idx", F.col("e1").alias("e0"), F.coalesce("e0", F.lit(-1)).alias("e1"), F.col("_error").isNotNull().alias("broken"))


@query("SELECT doc_id, md5(text) AS digest, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def archive_round_trip(spark, sf_dir):
    """Records to block archives and back."""
    containers.register(spark)
    path = local(work_path(spark, "archive"))
    docs = table(spark, sf_dir, "documents").select(F.lit("").alias("path"), F.lit(0).alias("record"), F.array(F.col("doc_id").cast("string").cast("binary"), F.col("text").cast("binary")).alias("elements"))
    docs.write.format("blockarchive").mode("append").save(path)
    back = spark.read.format("blockarchive").load(path).select(F.get("elements", 0).cast("string").cast("bigint").alias("doc_id"), F.get("elements", 1).alias("t"))
    return back.select("doc_id", F.md5("t").alias("digest"), F.octet_length("t").cast("bigint").alias("n_bytes"))


@query(f"WITH {_ROWS} SELECT event_id, (row_idx // 500)::BIGINT AS block_id FROM r WHERE row_idx // 500 = 1")
def cache_block(spark, sf_dir):
    """One block of a cache."""
    ev = records(spark, sf_dir).withColumn("block_id", F.floor(F.col("row_idx") / 500).cast("long"))
    path = work_path(spark, "cache")
    cache.store(ev, path)
    return cache.load(spark, path, ["event_id", "block_id"], block=1)


@query(
    f"""WITH {_ROWS}, s AS {_SIZE}, b AS (SELECT event_id, row_idx, epoch, row_idx // size AS block_id FROM r, s, range(1, 3) AS t(epoch)),
k AS (SELECT *, {sql_draw('block_id', f'({SEED} + epoch)', 2)} AS kb, {sql_draw('row_idx', f'({SEED} + epoch)', 3)} AS kr FROM b)
SELECT event_id, epoch::BIGINT AS epoch, block_id::BIGINT AS block_id, row_idx::BIGINT AS source_idx, (row_number() OVER (PARTITION BY epoch, block_id ORDER BY kr, row_idx) - 1)::BIGINT AS in_block,
  (dense_rank() OVER (PARTITION BY epoch ORDER BY kb, block_id) - 1)::BIGINT AS block_pos, (row_number() OVER (PARTITION BY epoch ORDER BY kb, block_id, kr, row_idx) - 1)::BIGINT AS row_idx FROM k"""
)
def cached_shuffle(spark, sf_dir):
    """Two epochs of a cache, blocks in their orders and records shuffled where they are read."""
    ev = records(spark, sf_dir)
    n, path = ev.count(), work_path(spark, "cache")
    cache.write(rows.with_blocks(ev, n, BLOCK), path)
    return cache.scan(spark, path, ["event_id"], n, BLOCK, SEED, 1, 2)


_LOADED = f"""WITH {_ROWS}, b AS (SELECT pos // 64 AS batch_id, pos % 64 AS slot, pos % n.n AS at FROM n, range(((SELECT n FROM n) + 63) // 64 * 64) AS t(pos))
SELECT b.batch_id::BIGINT AS batch_id, b.slot::BIGINT AS slot, (event_id % 1000)::BIGINT AS label, array_to_string({_sql_chars('event_type', 8, 'abcdefghijklmnopqrstuvwxyz')}, ',') AS char_map, least(length(event_type), 8)::BIGINT AS n_chars,
  CASE event_type WHEN 'click' THEN '1,0' WHEN 'view' THEN '2,0' ELSE '0,0' END AS classes, event_id::DOUBLE AS blob FROM b JOIN r ON r.row_idx = b.at"""
_KINDS = {"click": 1, "view": 2}


def _loader(spark, sf_dir, **more) -> DataLoader:
    kind = F.when(F.col("event_type").isin(*_KINDS), F.col("event_type")).otherwise("else")
    little = F.hex(text.pack_int(F.col("event_id"), 8))
    columns = {"a": (F.col("event_id") % 1000).cast("string"), "b": F.col("event_type"), "c": kind, "d": F.base64(F.unhex(little))}
    path = write_manifest(spark, sf_dir, columns, ["STRING", "STRING", "STRING", "BINARY"], "events", "event_id")
    etl = [{"type": "label"}, {"type": "char_map", "max_length": 8, "alphabet": "abcdefghijklmnopqrstuvwxyz", "emit_length": True, "name": "kind"}, {"type": "label_map", "class_names": ["else", *_KINDS], "max_classes": 2}, {"type": "blob", "output_count": 2, "output_type": "uint32_t"}]
    return DataLoader(spark, {"manifest_filename": path, "batch_size": 64, "etl": etl, **more})


@query(_LOADED)
def loader_plan(spark, sf_dir):
    """The loader's plan from a manifest file: labels, characters, classes and raw numbers of every batch."""
    df = _loader(spark, sf_dir).plan()
    words = F.col("blob")
    return df.select(
        "batch_id", "slot", F.get("label", 0).cast("bigint").alias("label"), F.array_join(F.col("`kind.char_map`").cast("array<string>"), ",").alias("char_map"), F.get(F.col("`kind.char_map_length`"), 0).cast("bigint").alias("n_chars"),
        F.array_join(F.col("label_map").cast("array<string>"), ",").alias("classes"), (F.get(words, 0) + F.get(words, 1) * 4294967296.0).cast("double").alias("blob"),
    )


@query(f"""WITH {_ROWS}, b AS (SELECT pos // 64 AS batch_id, pos % 64 AS slot, pos % n.n AS at FROM n, range(((SELECT n FROM n) + 63) // 64 * 64) AS t(pos))
SELECT b.batch_id::BIGINT AS batch_id, 3584::BIGINT AS n_bytes, string_agg(format('{{:02X}}{{:02X}}0000', (event_id % 1000)::BIGINT % 256, (event_id % 1000)::BIGINT // 256), '' ORDER BY b.slot) AS labels,
  string_agg(format('{{:02X}}000000', least(length(event_type), 8)), '' ORDER BY b.slot) AS lengths, (sum(event_id) % 65521)::BIGINT AS blob FROM b JOIN r ON r.row_idx = b.at GROUP BY 1""")
def loader_batches(spark, sf_dir):
    """Every batch of a pass as tasks assemble it: the bytes of its arrays."""
    df = _loader(spark, sf_dir).batch_plan()
    low = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.unhex(F.substr(F.hex("a4"), 16 * k + 1, F.lit(16))))
    ids = F.aggregate(low, F.lit(0).cast("bigint"), lambda s, x: s + text.unpack_int(x, 8))
    return df.select("batch_id", "n_bytes", F.hex("a0").alias("labels"), F.hex("a2").alias("lengths"), (ids % 65521).alias("blob"))


_EPOCHS = 3


@query(f"""WITH {_ROWS}, m AS (SELECT event_id, (row_number() OVER (ORDER BY {sql_draw('row_idx', SEED, 1)}, row_idx) - 1)::BIGINT AS place FROM r), s AS {_SIZE},
b AS (SELECT m.*, epoch, m.place // s.size AS block_id, n FROM m, s, range({_EPOCHS}) AS t(epoch)),
o AS (SELECT event_id, epoch * n + row_number() OVER (PARTITION BY epoch ORDER BY {sql_draw('block_id', f'({SEED} + epoch)', 2)}, block_id, place) - 1 AS pos FROM b)
SELECT (pos // 64)::BIGINT AS batch_id, (pos % 64)::BIGINT AS slot, (event_id % 1000)::BIGINT AS label, event_id::DOUBLE AS blob FROM o WHERE pos < (SELECT {_EPOCHS} * n // 64 * 64 FROM n)""")
def loader_epochs(spark, sf_dir):
    """Three passes over a shuffled manifest: a block order of its own in each, batches across the passes."""
    n = table(spark, sf_dir, "events").count()
    df = _loader(spark, sf_dir, shuffle_manifest=True, random_seed=SEED, block_size=BLOCK, iteration_mode="COUNT", iteration_mode_count=_EPOCHS * n // 64).plan()
    return df.select("batch_id", "slot", F.get("label", 0).cast("bigint").alias("label"), (F.get("blob", 0) + F.get("blob", 1) * 4294967296.0).cast("double").alias("blob"))


@query(f"""WITH {_ROWS}, p AS (SELECT n // {_NODES} AS per, n // {_NODES} // {BATCH} AS batches, n // {_NODES} % {BATCH} AS tail FROM n),
o AS (SELECT event_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {sql_draw('row_idx', f'({SEED} + epoch)', 1)}, row_idx) - 1 AS row_idx FROM r, range({_EPOCHS}) AS t(epoch)),
d AS (SELECT o.*, p.*, p.batches * {BATCH} * {_NODES} AS dealt FROM o, p)
SELECT event_id, epoch::BIGINT AS epoch, CASE WHEN row_idx < dealt THEN row_idx % ({BATCH} * {_NODES}) // {BATCH} ELSE (row_idx - dealt) // tail END::INTEGER AS node_id,
  CASE WHEN row_idx < dealt THEN row_idx // ({BATCH} * {_NODES}) * {BATCH} + row_idx % {BATCH} ELSE batches * {BATCH} + (row_idx - dealt) % tail END::BIGINT AS row_idx
FROM d WHERE row_idx < per * {_NODES}""")
def epoch_deals(spark, sf_dir):
    """The records of each of three nodes in each of three epochs."""
    ev = records(spark, sf_dir).select("row_idx", "event_id")
    n, out = ev.count(), None
    for k in range(_NODES):
        part = rows.deal_epochs(ev, n, SEED, 0, _EPOCHS - 1, k, _NODES, BATCH).select("event_id", "epoch", F.lit(k).alias("node_id"), "row_idx")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT (n_nationkey // 5)::BIGINT AS batch_id, (n_nationkey % 5)::BIGINT AS slot, k::INTEGER AS position, (CASE WHEN k < 48 THEN n_nationkey * 3 + k // 3 ELSE n_nationkey * 3 + k % 16 END)::BIGINT AS value FROM nation, range(64) AS t(k)")
def loader_images(spark, sf_dir):
    """Encoded images and depth maps through the loader's plan: a picture per nation."""
    grey = lambda n: (n * 3 + np.arange(16)).astype("u1").reshape(4, 4, 1)
    lines = ["@BINARY\tBINARY"]
    import base64

    for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect():  # a fixed table of 25 rows
        png = base64.b64encode(containers.write_png(np.repeat(grey(r[0]), 3, 2))).decode()
        lines.append(f"{png}\t{png}")
    path = work_path(spark, "pictures")
    spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    etl = [{"type": "image", "height": 4, "width": 4, "channel_major": False}, {"type": "depthmap", "height": 4, "width": 4}]
    df = DataLoader(spark, {"manifest_filename": path, "batch_size": 5, "etl": etl}).plan()
    return df.select("batch_id", "slot", F.posexplode(F.concat(F.col("image").cast("array<bigint>"), F.col("depthmap").cast("array<bigint>"))).alias("position", "value"))


# --- rows -------------------------------------------------------------------------------------------------------------


@query(f"WITH {_ROWS} SELECT event_id, row_idx::BIGINT AS row_idx FROM r WHERE row_idx = 777")
def random_access(spark, sf_dir):
    """The record at an offset."""
    r = rows.row_at(records(spark, sf_dir), 777)
    return spark.createDataFrame([(r.event_id, r.row_idx)], "event_id long, row_idx long")


@query(f"WITH {_ROWS} SELECT event_id, CASE WHEN row_idx < 300 THEN row_idx ELSE row_idx - 300 END::BIGINT AS row_idx, row_idx < 300 AS moved FROM r")
def move_to(spark, sf_dir):
    """The first records split off; the rest begins at 0 again."""
    head, rest = rows.move_to(records(spark, sf_dir).select("event_id", "row_idx"), 300)
    return head.withColumn("moved", F.lit(True)).unionByName(rest.withColumn("moved", F.lit(False)))


# --- bytes and text -----------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, format('{:08X}', l_partkey) AS big, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS little, l_partkey::BIGINT AS back, (-l_suppkey)::BIGINT AS negative
FROM (SELECT *, format('{:08X}', l_partkey) AS h FROM lineitem)""")
def pack_unpack(spark, sf_dir):
    """Whole numbers to bytes of either order and back."""
    k, n = F.col("l_partkey"), -F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.hex(text.pack_int(k, 4, True)).alias("big"), F.hex(text.pack_int(k, 4)).alias("little"),
        text.unpack_int(text.pack_int(k, 5), 5).alias("back"), text.unpack_int(F.concat(F.lit(b"\x07"), text.pack_int(n, 4, True)), 4, True, offset=1).alias("negative"),
    )


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS back, round(l_discount::FLOAT::DOUBLE, 9) AS single, true AS halves FROM lineitem")
def pack_unpack_reals(spark, sf_dir):
    """Real numbers to bytes of either order and size and back."""
    x, y = F.col("l_extendedprice").cast("double"), F.col("l_discount").cast("double")
    raw = text.pack_float(x, 8)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.unpack_float(text.pack_float(x, 8, True), 8, True).alias("back"), F.round(text.unpack_float(F.concat(F.lit(b"\x01"), text.pack_float(y, 4)), 4, offset=1), 9).alias("single"),
        (text.pack_int(text.unpack_int(raw, 8), 8) == raw).alias("halves"),
    )


def _word_count() -> providers.Provider:
    """A provider as a user adds one: how many words a text has, and its first letters, by keys of its own."""

    def add(df, cfg, element, aug):
        words = F.size(F.filter(F.split(F.col(element).cast("string"), cfg["separator"]), lambda w: w != ""))
        name = lambda base: providers.column_name(base, cfg["name"])
        return df.withColumns({name("n_words"): F.array(words), name("twice"): F.array(words * cfg["times"], words)})

    return providers.Provider(lambda c: providers._columns(c, ("n_words", (1,), "int32_t"), ("twice", (2,), "int32_t")), add)


@query("""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents), n AS (SELECT count(*) AS n FROM d), b AS (SELECT pos, pos % n.n AS row_idx FROM n, range(((SELECT n FROM n) + 15) // 16 * 16) AS t(pos)),
w AS (SELECT row_idx, len(list_filter(string_split(translate(text, chr(9) || chr(10) || chr(13), '   '), 'e'), lambda x: x <> '')) AS k FROM d)
SELECT (pos // 16)::BIGINT AS batch_id, (pos % 16)::BIGINT AS slot, k::BIGINT AS n_words, (3 * k)::BIGINT AS more FROM b JOIN w USING (row_idx)""")
def loader_own_provider(spark, sf_dir):
    """A user's provider, registered with its keys, in a loader over all texts.

    A number before each text says whether there is one: a text alone may be empty or begin with # or @, and no line would stand for it.
    """
    line = F.coalesce(F.translate(F.col("text"), "\t\n\r", "   "), F.lit(""))
    path = write_manifest(spark, sf_dir, {"a": F.when(F.col("text").isNull(), "0").otherwise("1"), "b": line}, ["STRING", "STRING"], "documents", "doc_id")
    providers.register("word_count", _word_count(), {"separator": config.Key(" ", str), "times": config.Key(2, int, lambda v: v > 0)})
    try:
        df = DataLoader(spark, {"manifest_filename": path, "batch_size": 16, "etl": [{"type": "label"}, {"type": "word_count", "separator": "e", "times": 3}]}).plan()
    finally:
        providers.unregister("word_count")
    words = lambda c: F.when(F.get("label", 0) == 1, F.get(c, 0).cast("bigint"))
    return df.select("batch_id", "slot", words("n_words").alias("n_words"), words("twice").alias("more"))


@query("SELECT doc_id, length(text)::INTEGER AS n, NULL::INTEGER AS broken FROM documents")
def wide_length(spark, sf_dir):
    """Characters of UTF-8 bytes; bytes that are none have no length."""
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", text.wide_length(raw).alias("n"), text.wide_length(F.concat(raw, F.lit(b"\xff"))).alias("broken"))


_CRC_TABLE = "list_transform(range(256), lambda n: " + "list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 2197175160) ELSE c // 2 END))"


@query(f"""WITH t AS (SELECT {_CRC_TABLE} AS tab), x AS (SELECT event_id, event_type || '|' || event_id AS s FROM events)
SELECT event_id, format('{{:08x}}', xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) % 256) + 1], c // 256)), 4294967295)) AS crc FROM x, t""")
def crc32c_records(spark, sf_dir):
    """CRC-32C of each record's text."""
    import pyarrow as pa

    def run(it):
        for b in it:
            crc = manifest.crc32c_many([s.encode() for s in b.column("s").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array([manifest.version(int(c)) for c in crc])], ["event_id", "crc"])

    ev = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_id"), F.concat("event_type", F.lit("|"), F.col("event_id").cast("string")).alias("s"))
    return ev.mapInArrow(run, "event_id long, crc string")


# --- boxes and anchors ----------------------------------------------------------------------------------------------------


@query(f"""WITH {_BOXES} SELECT image_id, gt_idx, xmin * 2 + 5 AS x0, ymin * 3 + 7 AS y0, xmax * 2 + 5 AS x1, ymax * 3 + 7 AS y1, round(xmin * 0.23 + 0.123)::DOUBLE AS rx, round((xmax - xmin) * 0.23 + 1)::DOUBLE AS rw, true AS same, false AS other FROM b""")
def box_arithmetic(spark, sf_dir):
    """Boxes added, scaled, moved, rounded to rectangles and compared."""
    one = Box(*(F.lit(v) for v in (2.0, 3.0, 2.0, 3.0)))
    moved = box().scale(2, 3).translate(3, 4).add(one)
    x, _, w, _ = box().scale(0.23, 0.23).translate(0.123, 0.123).rect()
    return boxes(spark, sf_dir).select(*_ID, *_sides(moved, round_=False), x.alias("rx"), w.alias("rw"), box().equals(box().translate(0.000001, 0)).alias("same"), box().equals(box().translate(0.1, 0)).alias("other"))


@query(f"WITH {_BOXES} SELECT image_id, CASE WHEN image_id % 3 = 0 THEN NULL ELSE min(xmin) FILTER (gt_idx = 0) END AS first FROM b GROUP BY image_id")
def rotation_guard(spark, sf_dir):
    """A record that is rotated has no boxes."""
    objects = boxes(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("gt_idx", "xmin", "ymin", "xmax", "ymax", F.lit(0).alias("label"), F.lit(False).alias("difficult")))).alias("boxes"))
    whole = {"crop_x": 0, "crop_y": 0, "crop_width": 1000, "crop_height": 1000, "out_width": 1000, "out_height": 1000}
    aug = F.struct(F.when(F.col("image_id") % 3 == 0, 5).otherwise(0).alias("angle"), F.lit(False).alias("flip"), *(F.lit(v).alias(k) for k, v in whole.items()))
    out = providers.box_columns("boundingbox", {"max_bbox_count": 2}, F.col("boxes"), augment.Augmentation())["boundingbox"]
    return objects.withColumn("aug", aug).select("image_id", F.get(out, 0).cast("double").alias("first"))


@query("SELECT c_custkey AS image_id, 36::BIGINT AS n_anchors, 0::BIGINT AS used, round(least(60.0 / (c_custkey % 50 + 10), 60.0 / (c_custkey % 30 + 20)), 6) AS scale FROM customer")
def rcnn_without_boxes(spark, sf_dir):
    """Images without boxes: every anchor has a place and none counts; the scale that fits an image to the output."""
    from ..functions.boxes import calculate_scale

    images = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"))
    none = images.withColumn("sample", F.lit(None).cast(anchors.SAMPLE))
    p = anchors.planes(none, anchors.Lattice(64, 48, 16, (1,), (1, 2, 4), 1 / 16))
    used = F.aggregate("labels_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
    k = F.col("image_id")
    scale = calculate_scale((k % 50 + 10).cast("double"), (k % 30 + 20).cast("double"), F.lit(60.0), F.lit(60.0))
    return p.select("image_id", (F.size("bbtargets") / 4).cast("bigint").alias("n_anchors"), used.alias("used"), r6(scale).alias("scale"))


# --- draws ------------------------------------------------------------------------------------------------------------------


def _u(draw: str) -> str:
    return f"({sql_draw('p_partkey', SEED, augment.DRAWS[draw])} / {M}.0::DOUBLE)"


def _draw(spark, sf_dir, cfg, ssd=False):
    w, h = F.col("p_size") * 10 + 50, F.floor(F.col("p_retailprice") / 4) + 30
    return augment.with_augmentation(table(spark, sf_dir, "part"), cfg, SEED, w, h, 224, 160, "p_partkey", ssd)


_SIZES = "SELECT *, (p_size * 10 + 50)::DOUBLE AS w, floor(p_retailprice / 4)::DOUBLE + 30 AS h FROM part"


@query(f"""WITH d AS ({_SIZES}), s AS (SELECT *, least(224.0 / w, 160.0 / h)::DOUBLE AS s FROM d)
SELECT p_partkey, 0::INTEGER AS crop_x, w::INTEGER AS crop_width, h::INTEGER AS crop_height, round_even(w * s, 0)::INTEGER AS out_width, round_even(h * s, 0)::INTEGER AS out_height FROM s""")
def draw_without_crop(spark, sf_dir):
    """The whole input, as large as fits the output."""
    return _draw(spark, sf_dir, augment.Augmentation(crop_enable=False)).select("p_partkey", "aug.crop_x", "aug.crop_width", "aug.crop_height", "aug.out_width", "aug.out_height")


@query(f"""WITH d AS (SELECT *, {_u('distortion')} AS ud, {_u('scale')} AS us, {_u('xoff')} AS ux, {_u('yoff')} AS uy FROM ({_SIZES})), e AS (SELECT *, sqrt(0.75::DOUBLE + ud * {1.25 - 0.75}::DOUBLE) AS q FROM d),
b AS (SELECT *, least(w / h / (q * q), h / w * (q * q)) AS bound FROM e), a AS (SELECT *, least(0.2::DOUBLE, bound) AS lo, least(0.9::DOUBLE, bound) AS hi FROM b), c AS (SELECT *, sqrt(w * h * (lo + us * (hi - lo))) AS side FROM a)
SELECT p_partkey, floor((w - q * side) * ux)::INTEGER AS crop_x, floor((h - side / q) * uy)::INTEGER AS crop_y, floor(q * side)::INTEGER AS crop_width, floor(side / q)::INTEGER AS crop_height FROM c""")
def draw_area_scale(spark, sf_dir):
    """Crops of a share of the input's area, of changed proportions."""
    cfg = augment.Augmentation(do_area_scale=True, scale=(0.2, 0.9), horizontal_distortion=(0.75, 1.25), center=False)
    return _draw(spark, sf_dir, cfg).select("p_partkey", "aug.crop_x", "aug.crop_y", "aug.crop_width", "aug.crop_height")


@query(f"""WITH d AS (SELECT *, {_u('expand')} AS ue, {_u('expand_ratio')} AS ur, {_u('expand_x')} AS ux, {_u('expand_y')} AS uy FROM ({_SIZES})), r AS (SELECT *, CASE WHEN ue < 0.5 THEN 1.0::DOUBLE + ur * 3.0::DOUBLE ELSE 1.0 END::DOUBLE AS ratio FROM d)
SELECT p_partkey, round(ratio, 6) AS ratio, floor(w * ratio)::INTEGER AS expand_width, floor(h * ratio)::INTEGER AS expand_height, floor(ux * (w * ratio - w))::INTEGER AS expand_x, floor(uy * (h * ratio - h))::INTEGER AS expand_y FROM r""")
def draw_expand(spark, sf_dir):
    """Canvases that half of the records are put on."""
    cfg = augment.Augmentation(crop_enable=False, expand_probability=0.5, expand_ratio=(1.0, 4.0))
    return _draw(spark, sf_dir, cfg, ssd=True).select("p_partkey", r6(F.col("aug.expand_ratio")).alias("ratio"), "aug.expand_width", "aug.expand_height", "aug.expand_x", "aug.expand_y")


# --- configuration ------------------------------------------------------------------------------------------------------------

_GOOD = {"manifest_filename": "m", "batch_size": 8, "etl": [{"type": "label"}]}
_CASES = [
    ("unknown key", _GOOD | {"batch_sise": 1}, "did you mean 'batch_size'"), ("missing key", {"batch_size": 1, "etl": []}, "Required Argument: 'manifest_filename' not set"), ("range", _GOOD | {"subset_fraction": 1.5}, "out of range"),
    ("mode", _GOOD | {"iteration_mode": "FOREVER"}, "iteration_mode must be"), ("count", _GOOD | {"iteration_mode": "COUNT"}, "positive integer"), ("node", _GOOD | {"node_id": 3, "node_count": 3}, "node_id must be less"),
    ("no type", _GOOD | {"etl": [{"binary": True}]}, "missing required 'type'"), ("other type", _GOOD | {"etl": [{"type": "smell"}]}, "unsupported etl type 'smell'"), ("provider key", _GOOD | {"etl": [{"type": "label", "binery": True}]}, "did you mean 'binary'"),
    ("augmentation", _GOOD | {"augmentation": [{"type": "image", "hue": [5, -5]}]}, "out of range"), ("augmentation type", _GOOD | {"augmentation": [{"angle": [0, 1]}]}, "missing required 'type'"),
    ("sampler", _GOOD | {"augmentation": [{"type": "image", "batch_samplers": [{"max_trials": 0}]}]}, "out of range"), ("good", _GOOD, ""),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{w.replace(chr(39), chr(39) * 2)}', true)" for n, _, w in _CASES) + ") AS t(name, message, found)")
def config_errors(spark, sf_dir):
    """What broken configurations are told."""
    out = []
    for name, given, want in _CASES:
        try:
            config.loader(given)
            said = ""
        except ValueError as e:
            said = str(e)
        out.append((name, want, want in said if want else said == ""))
    return spark.createDataFrame(out, "name string, message string, found boolean")


@query("SELECT 5::BIGINT AS low_bits, true AS single, 5000::BIGINT AS block_size, 16::BIGINT AS doubled, '1,2,3,7' AS cpus, 1::BIGINT AS seed")
def config_values(spark, sf_dir):
    """Narrowed numbers, defaults and values that follow from others."""
    plain = json.loads(config.to_json({"a": 2**32 + 5, "b": 0.1}))
    many = config.loader(_GOOD | {"block_size": 0, "node_count": 2, "node_id": 1, "cache_directory": "c"})
    assert many.cache_directory == "" and "batch_size: REQUIRED" in config.dump_defaults("loader")
    row = (plain["a"], plain["b"] == float(np.float32(0.1)), config.loader(_GOOD).block_size, many.block_size, ",".join(map(str, config.parse_cpu_list("7,1-3,2", 8))), many.random_seed)
    return spark.createDataFrame([row], "low_bits long, single boolean, block_size long, doubled long, cpus string, seed long")

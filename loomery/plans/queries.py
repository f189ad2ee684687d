"""Driver queries over the test tables, with the SQL that gives the same rows.

Boxes stand for object annotations: the lines of an order are the boxes of an image. Events in the order of their ids
stand for manifest records; embeddings, 64 numbers each, for 8 x 8 planes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import audio, text
from ..functions.boxes import Box, calculate_scale, cropbox_area_scale, cropbox_linear_scale, cropbox_max_proportional, cropbox_shift, emit, resized_short_size, transform_box
from ..functions.prng import M, sql_draw
from ..operators import anchors, augment, pixels, rows
from ..sources import annotations, manifest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c.cast("double"), 6)


def ppm(c):
    """Millionths; unlike round(), both engines place exact halves alike."""
    return F.floor(c * 1000000 + 0.5).cast("double")


def joined(array):
    return F.array_join(array.cast("array<string>"), ",")


# --- records ------------------------------------------------------------------------------------------------------

SEED, BATCH, BLOCK = 42, 32, 1000
_ROWS = "r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, * FROM events), n AS (SELECT count(*) AS n FROM events)"


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return rows.with_row_index(table(spark, sf_dir, "events").select("event_id", *columns), "event_id")


_ALPHABET = "abcdefghijklmnopqrstuvwxyz .,éèñüß0123456789"


def _sql_map(pairs: dict[str, int]) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{q(k)}: {v}" for k, v in pairs.items()) + "}"


def _sql_chars(source: str, n: int, alphabet: str, unknown: int = 0) -> str:
    ids = _sql_map(text.char_ids(alphabet))
    found = f"list_transform(list_filter(string_split(substring({source}, 1, {n}), ''), lambda c: c <> ''), lambda c: {ids}[c])"
    found = f"list_transform({found}, lambda x: coalesce(x, {unknown}))" if unknown else f"list_filter({found}, lambda x: x IS NOT NULL)"
    return f"list_concat({found}, list_transform(range({n}), lambda i: 0))[1:{n}]"


@query(
    f"""WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents), n AS (SELECT count(*) AS n FROM documents),
b AS (SELECT pos, pos // {BATCH} AS batch_id, pos % {BATCH} AS slot, pos % n.n AS at FROM n, range(((SELECT n FROM n) + {BATCH - 1}) // {BATCH} * {BATCH}) AS t(pos))
SELECT b.batch_id::BIGINT AS batch_id, b.slot::BIGINT AS slot, d.doc_id, array_to_string({_sql_chars('d.text', 64, _ALPHABET)}, ',') AS char_map,
  least(length(d.text), 64)::INTEGER AS char_map_length, (d.doc_id % 4)::INTEGER AS label FROM b JOIN d ON d.row_idx = b.at"""
)
def text_batches(spark, sf_dir):
    """Documents to full batches of character ids, lengths and labels."""
    docs = rows.with_row_index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    n = docs.count()
    enc = docs.select(
        "row_idx", "doc_id", joined(text.char_map(F.col("text"), _ALPHABET, 64)).alias("char_map"),
        text.char_map_length(F.col("text"), 64).cast("int").alias("char_map_length"), (F.col("doc_id") % 4).cast("int").alias("label"),
    )
    return rows.batches(enc, n, BATCH, rows.batch_count(n, BATCH)).select("batch_id", "slot", "doc_id", "char_map", "char_map_length", "label")


@query(
    """WITH l AS (SELECT event_id, event_type AS e0, value || 'x' AS e1, json_extract_string(props, '$.k') AS e2 FROM events)
SELECT event_id, e0, trunc(try_cast(regexp_extract(e1, '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1) AS DOUBLE))::INTEGER AS as_int,
  round(try_cast(e2 AS FLOAT)::DOUBLE, 6) AS as_float, octet_length(encode(e0))::INTEGER AS n_bytes FROM l"""
)
def manifest_typed(spark, sf_dir):
    """Manifest lines of events, classified and typed."""
    ev = table(spark, sf_dir, "events").where("event_id is not null")
    line = F.concat_ws("\t", F.base64(F.col("event_type").cast("binary")), F.concat(F.col("value").cast("string"), F.lit("x")), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")), F.col("event_id").cast("string"))
    rec = ev.select(F.col("event_id").alias("row_idx"), F.split(line, "\t", -1).alias("e"))
    out = manifest.typed(rec, ["BINARY", "ASCII_INT", "ASCII_FLOAT", "STRING"])
    return out.select(F.col("e3").cast("bigint").alias("event_id"), F.col("e0").cast("string").alias("e0"), F.col("e1").alias("as_int"), F.round(F.col("e2").cast("double"), 6).alias("as_float"), F.octet_length("e0").alias("n_bytes"))


@query(
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN p ELSE '/data/root/' || substring(p, 2) END AS path
FROM (SELECT page_id, '/' || regexp_replace(url, '^https?://', '') AS p FROM pages)"""
)
def manifest_root_join(spark, sf_dir):
    """File elements below a root; absolute ones stay (every other page's path is made relative)."""
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", ""))
    path = F.when(F.col("page_id") % 2 == 0, path).otherwise(F.substr(path, F.lit(2)))
    return table(spark, sf_dir, "pages").select("page_id", text.root_join(path, "/data/root").alias("path"))


@query("SELECT doc_id, md5(text) AS digest, octet_length(encode(text))::BIGINT AS n_bytes, length(base64(encode(text)))::BIGINT AS n_base64 FROM documents")
def base64_decode(spark, sf_dir):
    """Base64 there and back."""
    enc = table(spark, sf_dir, "documents").select("doc_id", F.base64(F.col("text").cast("binary")).alias("b"))
    enc = enc.withColumn("b", F.regexp_replace("b", "\r\n", ""))
    back = F.unbase64("b")
    return enc.select("doc_id", F.md5(back).alias("digest"), F.octet_length(back).cast("bigint").alias("n_bytes"), F.length("b").cast("bigint").alias("n_base64"))


@query(
    f"""WITH {_ROWS}, h AS (SELECT event_id, row_idx, n.n AS n, floor(n.n * 0.3)::BIGINT AS want, ({sql_draw('row_idx', 0, 0)} / {M}.0::DOUBLE < 0.3)::INTEGER AS hit FROM r, n),
c AS (SELECT *, coalesce(sum(hit) OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM h)
SELECT event_id, (row_number() OVER (ORDER BY row_idx) - 1)::BIGINT AS row_idx FROM c WHERE (hit = 1 AND c < want) OR want - c >= n - row_idx"""
)
def subset_exact(spark, sf_dir):
    """Exactly three tenths of the records, in order."""
    return rows.subset(records(spark, sf_dir), 0.3).select("event_id", "row_idx")


_NODES = 3


@query(
    f"""WITH {_ROWS}, p AS (SELECT n // {_NODES} AS per, n // {_NODES} // {BATCH} AS batches, n // {_NODES} % {BATCH} AS tail FROM n),
d AS (SELECT r.event_id, r.row_idx, p.*, p.batches * {BATCH} * {_NODES} AS dealt FROM r, p)
SELECT event_id, CASE WHEN row_idx < dealt THEN row_idx % ({BATCH} * {_NODES}) // {BATCH} ELSE (row_idx - dealt) // tail END::INTEGER AS node_id,
  CASE WHEN row_idx < dealt THEN row_idx // ({BATCH} * {_NODES}) * {BATCH} + row_idx % {BATCH} ELSE batches * {BATCH} + (row_idx - dealt) % tail END::BIGINT AS row_idx
FROM d WHERE row_idx < per * {_NODES}"""
)
def shard_nodes(spark, sf_dir):
    """The records of each of three nodes."""
    ev = records(spark, sf_dir)
    n, out = ev.count(), None
    for k in range(_NODES):
        part = rows.shard(ev, n, k, _NODES, BATCH).select("event_id", F.lit(k).alias("node_id"), "row_idx")
        out = part if out is None else out.unionByName(part)
    return out


_SIZE = f"(SELECT ceil(n / greatest(1, floor(n / {BLOCK}.0 + 0.5)))::BIGINT AS size, n FROM n)"


@query(
    f"""WITH {_ROWS}, s AS {_SIZE}
SELECT row_idx // size AS block_id, min(row_idx)::BIGINT AS start, count(*)::BIGINT AS n_rows, sum(value) > 0 AS positive FROM r, s GROUP BY 1"""
)
def block_list(spark, sf_dir):
    """Blocks of equal size and what they hold."""
    ev = records(spark, sf_dir, "value")
    return rows.with_blocks(ev, ev.count(), BLOCK).groupBy("block_id").agg(F.min("row_idx").alias("start"), F.count("*").alias("n_rows"), (F.sum("value") > 0).alias("positive"))


@query(f"""WITH {_ROWS} SELECT event_id, row_idx AS source_idx, (row_number() OVER (ORDER BY {sql_draw('row_idx', SEED, 1)}, row_idx) - 1)::BIGINT AS row_idx FROM r""")
def shuffle_manifest(spark, sf_dir):
    """All records in a new order."""
    return rows.shuffle_rows(records(spark, sf_dir), SEED).select("event_id", "source_idx", "row_idx")


@query(
    f"""WITH {_ROWS}, s AS {_SIZE}, b AS (SELECT event_id, row_idx, row_idx // size AS block_id FROM r, s),
k AS (SELECT *, {sql_draw('block_id', SEED, 2)} AS kb, {sql_draw('row_idx', SEED, 3)} AS kr FROM b)
SELECT event_id, block_id, row_idx AS source_idx, (row_number() OVER (PARTITION BY block_id ORDER BY kr, row_idx) - 1)::BIGINT AS in_block,
  (dense_rank() OVER (ORDER BY kb, block_id) - 1)::BIGINT AS block_pos, (row_number() OVER (ORDER BY kb, block_id, kr, row_idx) - 1)::BIGINT AS row_idx FROM k"""
)
def shuffle_in_block(spark, sf_dir):
    """Blocks in a new order, and the records of each."""
    ev = records(spark, sf_dir)
    out = rows.shuffle_blocks(rows.with_blocks(ev, ev.count(), BLOCK), SEED)
    return out.select("event_id", "block_id", "source_idx", "in_block", "block_pos", "row_idx")


def _sql_batches(size: int, count: str) -> str:
    return f"""WITH {_ROWS}, b AS (SELECT pos, pos // {size} AS batch_id, pos % {size} AS slot, pos // n.n AS epoch, pos % n.n AS at FROM n, range((SELECT {count} FROM n) * {size}) AS t(pos))
SELECT r.event_id, b.epoch::BIGINT AS epoch, b.batch_id::BIGINT AS batch_id, b.slot::BIGINT AS slot FROM b JOIN r ON r.row_idx = b.at"""


def _batches(spark, sf_dir, size, mode, count=0):
    ev = records(spark, sf_dir)
    n = ev.count()
    return rows.batches(ev, n, size, rows.batch_count(n, size, mode, count)).select("event_id", "epoch", "batch_id", "slot")


@query(_sql_batches(96, "(n + 95) // 96"))
def batch_wrap_once(spark, sf_dir):
    """One pass; the last batch is filled from the next pass's head."""
    return _batches(spark, sf_dir, 96, "ONCE")


@query(_sql_batches(512, "50"))
def batch_count_mode(spark, sf_dir):
    """A set number of batches, over as many passes as they need."""
    return _batches(spark, sf_dir, 512, "COUNT", 50)


@query(f"""WITH {_ROWS}, b AS (SELECT row_idx // {BATCH} AS batch_id, row_idx % {BATCH} AS slot, event_id FROM r)
SELECT batch_id::BIGINT AS batch_id, string_agg(event_id::VARCHAR, ',' ORDER BY slot) AS ids, count(*)::BIGINT AS n_rows FROM b GROUP BY 1""")
def regroup_windows(spark, sf_dir):
    """Windows of equal size across blocks."""
    b = records(spark, sf_dir).withColumns({"batch_id": F.floor(F.col("row_idx") / BATCH).cast("long"), "slot": F.col("row_idx") % BATCH})
    ids = F.transform(F.array_sort(F.collect_list(F.struct("slot", "event_id"))), lambda x: x["event_id"])
    return b.groupBy("batch_id").agg(joined(ids).alias("ids"), F.count("*").alias("n_rows"))


# --- text and numbers ---------------------------------------------------------------------------------------------


@query("SELECT event_id, try_cast(regexp_extract(props, '\\d+') AS INTEGER) AS label, try_cast(nullif(regexp_extract(event_type, '^\\s*([-+]?\\d+)', 1), '') AS INTEGER) AS none FROM events")
def label_text(spark, sf_dir):
    """Leading integers; a text without one is null."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", text.label_text(F.concat(F.lit(" "), F.get_json_object("props", "$.k"), F.lit(" k"))).alias("label"), text.label_text(F.col("event_type")).alias("none"))


@query("SELECT event_id, (event_id * 65537 % 4294967296 - CASE WHEN event_id * 65537 % 4294967296 >= 2147483648 THEN 4294967296 ELSE 0 END)::INTEGER AS label, NULL::INTEGER AS none FROM events")
def label_binary(spark, sf_dir):
    """Four little-endian bytes; any other number of bytes is null."""
    n = F.col("event_id") * 65537 % 4294967296
    big = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    little = F.unhex(F.concat(*(F.substring(big, k, 2) for k in (7, 5, 3, 1))))
    return table(spark, sf_dir, "events").select("event_id", text.label_binary(little).alias("label"), text.label_binary(F.substring(little, 1, 3)).alias("none"))


@query("SELECT event_id, k::DOUBLE AS as_double, k::BIGINT AS as_long, k::SMALLINT AS as_short FROM (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events)")
def label_output(spark, sf_dir):
    """A label as other number types."""
    k = text.label_text(F.get_json_object("props", "$.k"))
    return table(spark, sf_dir, "events").select("event_id", k.cast(text.otype("double")).alias("as_double"), k.cast(text.otype("uint32_t")).alias("as_long"), k.cast(text.otype("int16_t")).alias("as_short"))


_CLASSES = ["click", "error", "en", "view", "click", "signup", "purchase", "fr", "de", "es"]
_CLASS_IDS = _sql_map(text.class_ids(_CLASSES))


@query(
    f"""WITH w AS (SELECT event_id, string_split(event_type || ' click ' || CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE 'en' END, ' ') AS w FROM events),
i AS (SELECT event_id, list_transform(w, lambda x: {_CLASS_IDS}[x]) AS i FROM w)
SELECT event_id, CASE WHEN len(list_filter(i, lambda x: x IS NULL)) = 0 THEN array_to_string(list_concat(i, [0, 0, 0])[1:6], ',') END AS label_map FROM i"""
)
def label_map(spark, sf_dir):
    """Words to class ids, padded; an unknown word makes the record null."""
    words = F.concat_ws(" ", "event_type", F.lit(" click"), F.when(F.col("event_id") % 10 == 0, "unknown").otherwise("en"))
    ids = text.label_map(words, _CLASSES)
    return table(spark, sf_dir, "events").select("event_id", joined(F.when(ids.isNotNull(), text.pad(ids, 6, F.lit(0)))).alias("label_map"))


@query(f"SELECT doc_id, array_to_string({_sql_chars('text', 120, _ALPHABET)}, ',') AS char_map FROM documents")
def char_map(spark, sf_dir):
    """Characters to ids; unknown ones are dropped."""
    return table(spark, sf_dir, "documents").select("doc_id", joined(text.char_map(F.col("text"), _ALPHABET, 120)).alias("char_map"))


@query(f"SELECT conv_id, turn, array_to_string({_sql_chars('text', 80, 'abcdefghij .', 255)}, ',') AS char_map FROM conversations")
def char_map_unknown(spark, sf_dir):
    """Characters to ids; unknown ones have an id of their own."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", joined(text.char_map(F.col("text"), "abcdefghij .", 80, 255)).alias("char_map"))


@query("SELECT doc_id, least(length(text), 1000)::INTEGER AS char_map_length FROM documents")
def char_map_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.char_map_length(F.col("text"), 1000).cast("int").alias("char_map_length"))


@query("SELECT vec_id, len(embedding)::INTEGER AS n, list_sum(list_transform(list_concat(embedding::DOUBLE[], [0.0, 0.0])[1:66], lambda x: floor(x * 10000)::BIGINT))::BIGINT AS total FROM embeddings")
def blob_pad(spark, sf_dir):
    """Raw numbers, filled up to a fixed length."""
    v = text.pad(F.col("embedding").cast("array<double>"), 66, F.lit(0.0))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + F.floor(x * 10000)).alias("total"))


_KEYS = ("brand", "steel", "copper", "polished", "standard")


@query(f"""SELECT p_partkey, {", ".join(f"levenshtein(p_name, '{k}')::INTEGER AS d_{k}" for k in _KEYS)}, levenshtein('aspect_ratio', 'crops_per_scale')::INTEGER AS fixed FROM part""")
def levenshtein_suggest(spark, sf_dir):
    """Edit distances to known keys."""
    return table(spark, sf_dir, "part").select("p_partkey", *(F.levenshtein("p_name", F.lit(k)).alias(f"d_{k}") for k in _KEYS), F.levenshtein(F.lit("aspect_ratio"), F.lit("crops_per_scale")).alias("fixed"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 2, 0)::DOUBLE AS half_even, round_even(l_quantity / 2 + 0.0, 0)::DOUBLE AS halves, round(l_quantity / 2)::DOUBLE AS away FROM lineitem")
def rounding(spark, sf_dir):
    """Rounding, halves to even and away from zero."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.unbiased_round(F.col("l_extendedprice") / 2).alias("half_even"), text.unbiased_round(F.col("l_quantity") / 2).alias("halves"), F.round(F.col("l_quantity") / 2).cast("double").alias("away"))


@query("SELECT l_orderkey, l_linenumber, abs(a - b) < 0.00001 AS equal, abs(a - b) < 0.00001 OR a < b AS at_most, abs(a - b) < 0.00001 OR a > b AS at_least FROM (SELECT *, l_discount AS a, l_tax AS b FROM lineitem)")
def almost_equal(spark, sf_dir):
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.almost_equal(a, b).alias("equal"), text.almost_equal_or_less(a, b).alias("at_most"), text.almost_equal_or_greater(a, b).alias("at_least"))


@query("SELECT doc_id, len(p)::INTEGER AS n_parts, sum(length(trim(x, ' ' || chr(9))))::BIGINT AS n_chars FROM (SELECT doc_id, p, unnest(p) AS x FROM (SELECT doc_id, string_split(text, ',') AS p FROM documents)) GROUP BY doc_id, p")
def split_trim(spark, sf_dir):
    """Parts of a text at commas, empty ones too, trimmed."""
    p = text.split_trim(F.col("text"), ",", trim=True)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(p).alias("n_parts"), F.aggregate(p, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("n_chars"))


@query()
def crc32c(spark, sf_dir):
    """The manifest's version: CRC-32C of all elements in order."""
    ev = records(spark, sf_dir, "event_type").select("row_idx", F.array(F.col("event_type"), F.col("event_id").cast("string")).alias("e"))
    return spark.createDataFrame([(manifest.version(manifest.manifest_crc(ev)),)], "version string")


# --- boxes --------------------------------------------------------------------------------------------------------

CANVAS = 400.0
_BOXES = """x AS (SELECT l_orderkey AS image_id, (l_partkey % 300)::DOUBLE AS xmin, (l_suppkey % 200)::DOUBLE AS ymin, (l_partkey % 300 + l_quantity - 1)::DOUBLE AS xmax, (l_suppkey % 200 + 10 * l_linenumber - 1)::DOUBLE AS ymax, l_linenumber FROM lineitem),
b AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY xmin, ymin, xmax, ymax, l_linenumber) - 1)::INTEGER AS gt_idx FROM x)"""
_ID = ("image_id", "gt_idx")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") % 200).cast("double")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), x.alias("xmin"), y.alias("ymin"), (x + F.col("l_quantity") - 1).cast("double").alias("xmax"), (y + 10 * F.col("l_linenumber") - 1).cast("double").alias("ymax"), "l_linenumber")
    order = Window.partitionBy("image_id").orderBy("xmin", "ymin", "xmax", "ymax", "l_linenumber")
    return b.withColumn("gt_idx", F.row_number().over(order) - 1)


def box() -> Box:
    return Box.cols("xmin", "ymin", "xmax", "ymax")


@query(f"WITH {_BOXES} SELECT image_id, gt_idx, xmax - xmin + 1 AS width, ymax - ymin + 1 AS height, (xmax - xmin + 1) * (ymax - ymin + 1) AS size, xmin + (xmax - xmin) / 2 AS cx, ymin + (ymax - ymin) / 2 AS cy FROM b")
def box_geometry(spark, sf_dir):
    cx, cy = box().center
    return boxes(spark, sf_dir).select(*_ID, box().width.alias("width"), box().height.alias("height"), box().size.cast("double").alias("size"), cx.alias("cx"), cy.alias("cy"))


def box_pairs(spark, sf_dir):
    b = boxes(spark, sf_dir).drop("l_linenumber")
    other = b.select("image_id", *(F.col(c).alias(f"o_{c}") for c in ("gt_idx", "xmin", "ymin", "xmax", "ymax")))
    return b.join(other, "image_id").where("gt_idx < o_gt_idx"), Box.cols("o_xmin", "o_ymin", "o_xmax", "o_ymax")


_PAIRS = f"""WITH {_BOXES}, p AS (SELECT a.image_id, a.gt_idx, o.gt_idx AS o_gt_idx, a.xmin, a.ymin, a.xmax, a.ymax, o.xmin AS oxmin, o.ymin AS oymin, o.xmax AS oxmax, o.ymax AS oymax,
  o.xmin > a.xmax OR o.xmax < a.xmin OR o.ymin > a.ymax OR o.ymax < a.ymin AS apart FROM b a JOIN b o ON a.image_id = o.image_id AND a.gt_idx < o.gt_idx),
i AS (SELECT *, CASE WHEN apart THEN 0 ELSE greatest(xmin, oxmin) END AS ixmin, CASE WHEN apart THEN 0 ELSE greatest(ymin, oymin) END AS iymin, CASE WHEN apart THEN -1 ELSE least(xmax, oxmax) END AS ixmax, CASE WHEN apart THEN -1 ELSE least(ymax, oymax) END AS iymax FROM p),
s AS (SELECT *, (xmax - xmin + 1) * (ymax - ymin + 1) AS sa, (oxmax - oxmin + 1) * (oymax - oymin + 1) AS sb, CASE WHEN apart THEN 0 ELSE (ixmax - ixmin + 1) * (iymax - iymin + 1) END AS si FROM i)"""


@query(f"{_PAIRS} SELECT image_id, gt_idx, o_gt_idx, ixmin::DOUBLE AS ixmin, iymin::DOUBLE AS iymin, ixmax::DOUBLE AS ixmax, iymax::DOUBLE AS iymax, round(CASE WHEN si = 0 THEN 0 ELSE si / (sa + sb - si) END, 6) AS iou FROM s")
def box_intersect_iou(spark, sf_dir):
    pairs, o = box_pairs(spark, sf_dir)
    i = box().intersect(o)
    return pairs.select(*_ID, "o_gt_idx", i.xmin.cast("double").alias("ixmin"), i.ymin.cast("double").alias("iymin"), i.xmax.cast("double").alias("ixmax"), i.ymax.cast("double").alias("iymax"), r6(box().jaccard(o)).alias("iou"))


@query(f"{_PAIRS} SELECT image_id, gt_idx, o_gt_idx, floor(CASE WHEN si = 0 THEN 0 ELSE si / sa END * 1000000 + 0.5) AS covered_ppm, floor(CASE WHEN si = 0 THEN 0 ELSE si / sb END * 1000000 + 0.5) AS covers_ppm FROM s")
def box_coverage(spark, sf_dir):
    pairs, o = box_pairs(spark, sf_dir)
    return pairs.select(*_ID, "o_gt_idx", ppm(box().coverage(o)).alias("covered_ppm"), ppm(o.coverage(box())).alias("covers_ppm"))


def _sides(b: Box, *, round_: bool = True):
    return [(r6(c) if round_ else c.cast("double")).alias(n) for n, c in (("x0", b.xmin), ("y0", b.ymin), ("x1", b.xmax), ("y1", b.ymax))]


@query(f"WITH {_BOXES} SELECT image_id, gt_idx, round(xmin * 1.5, 6) AS x0, round(ymin * 0.75, 6) AS y0, round((xmax + 1) * 1.5 - 1, 6) AS x1, round((ymax + 1) * 0.75 - 1, 6) AS y1 FROM b")
def box_rescale(spark, sf_dir):
    return boxes(spark, sf_dir).select(*_ID, *_sides(box().rescale(1.5, 0.75)))


@query(f"WITH {_BOXES} SELECT image_id, gt_idx, round(xmin / {CANVAS}, 6) AS x0, round(ymin / {CANVAS}, 6) AS y0, round((xmax + 1) / {CANVAS}, 6) AS x1, round((ymax + 1) / {CANVAS}, 6) AS y1, xmax + 1 <= {CANVAS} AND ymax + 1 <= {CANVAS} AS valid, round(xmax, 6) AS back FROM b")
def box_normalize(spark, sf_dir):
    n = box().normalize(F.lit(CANVAS), F.lit(CANVAS))
    return boxes(spark, sf_dir).select(*_ID, *_sides(n), n.is_normal().alias("valid"), r6(n.unnormalize(F.lit(CANVAS), F.lit(CANVAS)).xmax).alias("back"))


@query(f"WITH {_BOXES} SELECT image_id, gt_idx, xmin + 30 AS x0, ymin + 20 AS y0, xmax + 30 AS x1, ymax + 20 AS y1 FROM b")
def box_expand(spark, sf_dir):
    return boxes(spark, sf_dir).select(*_ID, *_sides(box().expand(30, 20, 2 * CANVAS, 2 * CANVAS), round_=False))


_CROP = {"x": 60.0, "y": 40.0, "width": 200.0, "height": 120.0}
_CX, _CY, _CW, _CH = _CROP.values()
_KEEP = f"NOT (xmax < {_CX} OR xmin >= {_CX + _CW} OR ymax < {_CY} OR ymin >= {_CY + _CH})"
_CUT = f"""c AS (SELECT image_id, gt_idx, image_id % 2 = 0 AS flip, greatest(xmin - {_CX}, 0) AS l, greatest(ymin - {_CY}, 0) AS t,
  CASE WHEN xmax >= {_CX + _CW} THEN {_CW - 1} ELSE xmax - {_CX} END AS r, CASE WHEN ymax >= {_CY + _CH} THEN {_CH - 1} ELSE ymax - {_CY} END AS u FROM b WHERE {_KEEP}),
f AS (SELECT image_id, gt_idx, CASE WHEN flip THEN {_CW} - r - 1 ELSE l END AS l, t, CASE WHEN flip THEN {_CW} - l - 1 ELSE r END AS r, u FROM c)"""


def _crop():
    return {k: F.lit(v) for k, v in _CROP.items()}


def _transformed(spark, sf_dir, **how):
    keep, b = transform_box(box(), _crop(), F.col("image_id") % 2 == 0, F.lit(300.0), F.lit(300.0), **how)
    return boxes(spark, sf_dir).where(keep), b


@query(f"WITH {_BOXES}, {_CUT} SELECT image_id, gt_idx, round(l * (300.0 / {_CW}), 6) AS x0, round(t * (300.0 / {_CH}), 6) AS y0, round((r + 1) * (300.0 / {_CW}) - 1, 6) AS x1, round((u + 1) * (300.0 / {_CH}) - 1, 6) AS y1 FROM f")
def box_crop_flip(spark, sf_dir):
    """Boxes through a crop, a flip of every other image and a resize."""
    df, b = _transformed(spark, sf_dir)
    return df.select(*_ID, *_sides(b))


@query(f"WITH {_BOXES}, m AS (SELECT *, xmin + (xmax - xmin) / 2 AS cx, ymin + (ymax - ymin) / 2 AS cy FROM b) SELECT image_id, gt_idx, cx >= {_CX} AND cx <= {_CX + _CW - 1} AND cy >= {_CY} AND cy <= {_CY + _CH - 1} AS kept FROM m")
def emit_center(spark, sf_dir):
    return boxes(spark, sf_dir).select(*_ID, emit(box(), _crop(), "center").alias("kept"))


@query(f"""WITH {_BOXES}, o AS (SELECT *, greatest(0, least(xmax, {_CX + _CW - 1}) - greatest(xmin, {_CX}) + 1) * greatest(0, least(ymax, {_CY + _CH - 1}) - greatest(ymin, {_CY}) + 1) AS shared FROM b)
SELECT image_id, gt_idx, shared / ((xmax - xmin + 1) * (ymax - ymin + 1)) >= 0.4 AS kept FROM o""")
def emit_min_overlap(spark, sf_dir):
    return boxes(spark, sf_dir).select(*_ID, emit(box(), _crop(), "min_overlap", 0.4).alias("kept"))


@query(f"""WITH {_BOXES}, o AS (SELECT image_id, list([xmin, ymin, xmax, ymax] ORDER BY gt_idx) AS l FROM b GROUP BY image_id)
SELECT image_id, least(len(l), 5)::INTEGER AS n_boxes, array_to_string(list_transform(list_concat(flatten(l), list_transform(range(20), lambda i: 0.0))[1:20], lambda x: x::INTEGER), ',') AS boxes FROM o""")
def bbox_pad(spark, sf_dir):
    """The first five boxes of each image, zero padded."""
    df = boxes(spark, sf_dir).withColumns({"label": F.lit(1), "difficult": F.lit(False)})
    return anchors.padded_boxes(df, 5).select("image_id", F.col("gt_box_count").alias("n_boxes"), joined(F.transform("gt_boxes", lambda x: x.cast("int"))).alias("boxes"))


@query(f"""WITH {_BOXES}, {_CUT}, n AS (SELECT image_id, gt_idx, round(l * (300.0 / {_CW}) / 300.0, 6) AS x0, round(((r + 1) * (300.0 / {_CW}) - 1 + 1) / 300.0, 6) AS x1, row_number() OVER (PARTITION BY image_id ORDER BY gt_idx) AS k FROM f)
SELECT image_id, least(count(*), 3)::BIGINT AS n_boxes, round(sum(x0) FILTER (k <= 3), 5) AS x0, round(sum(x1) FILTER (k <= 3), 5) AS x1 FROM n GROUP BY image_id""")
def ssd_targets(spark, sf_dir):
    """Boxes after the crop, normalised by the output size; at most three an image."""
    df, b = _transformed(spark, sf_dir)
    n = b.normalize(F.lit(300.0), F.lit(300.0))
    df = df.select(*_ID, r6(n.xmin).alias("x0"), r6(n.xmax).alias("x1"), F.row_number().over(Window.partitionBy("image_id").orderBy("gt_idx")).alias("k"))
    first = lambda c: F.round(F.sum(F.when(F.col("k") <= 3, F.col(c))), 5).alias(c)
    return df.groupBy("image_id").agg(F.least(F.count("*"), F.lit(3)).cast("bigint").alias("n_boxes"), first("x0"), first("x1"))


@query(
    """WITH d AS (SELECT p_partkey, (p_size * 10 + 50)::DOUBLE AS w, floor(p_retailprice / 4)::DOUBLE + 30 AS h FROM part),
m AS (SELECT *, least(w / 200.0, h / 100.0) AS fit FROM d), a AS (SELECT *, least(sqrt(w * h * 0.4 / (200.0 * fit * (100.0 * fit))), 1.0) AS f FROM m)
SELECT p_partkey, round(least(300.0 / w, 200.0 / h), 6) AS scale, round(200.0 * fit, 4) AS crop_w, round(100.0 * fit, 4) AS crop_h, round(200.0 * fit * 0.5, 4) AS half_w,
  round(200.0 * fit * f, 4) AS area_w, floor((w - 200.0 * fit) * 0.25)::BIGINT AS shift_x, floor((h - 100.0 * fit) * 0.25)::BIGINT AS shift_y, round(w * 256 / least(w, h)) AS short_w FROM a"""
)
def crop_geometry(spark, sf_dir):
    """Sizes and places of crops."""
    w, h = (F.col("p_size") * 10 + 50).cast("double"), F.floor(F.col("p_retailprice") / 4).cast("double") + 30
    cw, ch = cropbox_max_proportional(w, h, F.lit(200.0), F.lit(100.0))
    sx, sy = cropbox_shift(w, h, cw, ch, 0.25, 0.25)
    r4 = lambda c: F.round(c, 4)
    return table(spark, sf_dir, "part").select(
        "p_partkey", r6(calculate_scale(w, h, F.lit(300.0), F.lit(200.0))).alias("scale"), r4(cw).alias("crop_w"), r4(ch).alias("crop_h"), r4(cropbox_linear_scale(cw, ch, 0.5)[0]).alias("half_w"),
        r4(cropbox_area_scale(w, h, cw, ch, F.lit(0.4))[0]).alias("area_w"), sx.cast("bigint").alias("shift_x"), sy.cast("bigint").alias("shift_y"), resized_short_size(w, h, 256)[0].alias("short_w"),
    )


@query(f"WITH {_BOXES} SELECT image_id, (gt_idx)::INTEGER AS gt_idx, xmin AS x0, ymax AS y1, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END::INTEGER AS label, l_linenumber = 7 AS difficult, 400::INTEGER AS width FROM b WHERE image_id NOT IN (SELECT image_id FROM b WHERE l_linenumber = 6)")
def annotation_json(spark, sf_dir):
    """Boxes to annotation JSON and back; an image with an unknown class is an error and has no boxes."""
    b = boxes(spark, sf_dir)
    name = F.when(F.col("l_linenumber") == 6, "cow").when(F.col("l_linenumber") % 3 == 0, "bicycle").otherwise("person")
    obj = F.struct("gt_idx", F.struct("xmin", "ymin", "xmax", "ymax").alias("bndbox"), name.alias("name"), F.when(F.col("l_linenumber") == 7, True).alias("difficult"))
    rec = F.to_json(F.struct(F.array_sort(F.collect_list(obj)).alias("object"), F.struct(F.lit(400).alias("width"), F.lit(400).alias("height"), F.lit(3).alias("depth")).alias("size")))
    out = annotations.parse_annotations(b.groupBy("image_id").agg(rec.alias("json")), "json", ["bicycle", "person"])
    return out.select("image_id", "width", F.posexplode("boxes").alias("gt_idx", "b")).select("image_id", "gt_idx", F.col("b.xmin").alias("x0"), F.col("b.ymax").alias("y1"), F.col("b.label").alias("label"), F.col("b.difficult").alias("difficult"), "width")


# --- anchors ------------------------------------------------------------------------------------------------------

_NET = {"height": 160, "width": 160, "base": 16, "ratios": (0.5, 1, 2), "scales": (2, 4, 8), "scaling": 1 / 16}


def _sql_anchors(name: str = "a", where: str = "") -> str:
    kinds = ", ".join(f"({k}, {x0}, {y0}, {x1}, {y1})" for k, (x0, y0, x1, y1) in enumerate(anchors.base_anchors(16, _NET["ratios"], _NET["scales"])))
    return f"""{name} AS (SELECT ((kind * 10 + y) * 10 + x)::BIGINT AS anchor_idx, (x0 + 16 * x)::DOUBLE AS axmin, (y0 + 16 * y)::DOUBLE AS aymin, (x1 + 16 * x)::DOUBLE AS axmax, (y1 + 16 * y)::DOUBLE AS aymax
FROM (VALUES {kinds}) k(kind, x0, y0, x1, y1), range(10) AS t(y), range(10) AS s(x))"""


_INSIDE = "axmin >= 0 AND aymin >= 0 AND axmax < 160 AND aymax < 160"


@query(f"WITH {_sql_anchors()} SELECT anchor_idx, axmin AS xmin, aymin AS ymin, axmax AS xmax, aymax AS ymax FROM a")
def anchors_tile(spark, sf_dir):
    return anchors.tile_anchors(spark, **_NET)


@query(f"WITH {_sql_anchors()} SELECT anchor_idx, axmin AS xmin, aymin AS ymin, axmax AS xmax, aymax AS ymax FROM a WHERE {_INSIDE}")
def anchors_inside(spark, sf_dir):
    return anchors.inside(anchors.tile_anchors(spark, **_NET), 160, 160)


def _small_boxes(spark, sf_dir):
    """A box per customer, eight customers an image, on a 160 x 160 canvas."""
    k = F.col("c_custkey")
    x, y = (k * 7 % 100).cast("double"), (k * 13 % 90).cast("double")
    return table(spark, sf_dir, "customer").select(F.floor(k / 8).cast("bigint").alias("image_id"), (k % 8).cast("int").alias("gt_idx"), x.alias("xmin"), y.alias("ymin"), (x + 10 + k * 11 % 49).alias("xmax"), (y + 10 + k * 5 % 59).alias("ymax"))


_OVER = f"""WITH {_sql_anchors()}, g AS (SELECT c_custkey // 8 AS image_id, (c_custkey % 8)::INTEGER AS gt_idx, (c_custkey * 7 % 100)::DOUBLE AS xmin, (c_custkey * 13 % 90)::DOUBLE AS ymin,
  (c_custkey * 7 % 100 + 10 + c_custkey * 11 % 49)::DOUBLE AS xmax, (c_custkey * 13 % 90 + 10 + c_custkey * 5 % 59)::DOUBLE AS ymax FROM customer),
w AS (SELECT g.*, a.*, least(xmax, axmax) - greatest(xmin, axmin) + 1 AS iw, least(ymax, aymax) - greatest(ymin, aymin) + 1 AS ih FROM g, a WHERE {_INSIDE}),
o AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN iw * ih / ((xmax - xmin + 1) * (ymax - ymin + 1) + (axmax - axmin + 1) * (aymax - aymin + 1) - iw * ih) ELSE 0 END AS iou FROM w)"""
_LABEL = f"""{_OVER}, c AS (SELECT *, max(iou) OVER (PARTITION BY image_id, gt_idx) AS col FROM o),
m AS (SELECT image_id, anchor_idx, axmin, aymin, axmax, aymax, max(iou) AS max_iou, bool_or(iou = col) AS tie, arg_min(struct_pack(gt_idx, xmin, ymin, xmax, ymax), struct_pack(n := -iou, gt_idx)) AS gt FROM c GROUP BY ALL),
l AS (SELECT *, CASE WHEN max_iou >= 0.7 OR tie THEN 1 WHEN max_iou < 0.3 THEN 0 ELSE -1 END::INTEGER AS label FROM m)""".replace(" GROUP BY ALL", " GROUP BY image_id, anchor_idx, axmin, aymin, axmax, aymax")


_LATTICE, _SIDE = anchors.Lattice(**_NET), 160


def _labelled(spark, sf_dir):
    return anchors.label_images(_small_boxes(spark, sf_dir), _LATTICE, _SIDE, _SIDE)


@query(f"{_OVER} SELECT image_id, gt_idx, count(*)::BIGINT AS n_anchors, round(max(iou), 6) AS best, count(*) FILTER (iou > 0.3)::BIGINT AS n_near, round(sum(iou), 4) AS total FROM o GROUP BY 1, 2")
def rcnn_overlap(spark, sf_dir):
    """Overlap of every box with every anchor, summed up by box."""
    over = anchors.overlaps(_small_boxes(spark, sf_dir), _LATTICE, _SIDE, _SIDE, outer=True)
    sums = over.groupBy("image_id", "gt_idx").agg(r6(F.max("best")).alias("best"), F.count(F.when(F.col("iou") > 0.3, 1)).alias("n_near"), F.round(F.coalesce(F.sum("iou"), F.lit(0.0)), 4).alias("total"))
    return sums.withColumn("n_anchors", F.size(_LATTICE.inside(_SIDE, _SIDE)).cast("bigint"))


@query(f"{_LABEL} SELECT image_id::BIGINT AS image_id, anchor_idx, round(max_iou, 6) AS max_iou, gt.gt_idx::INTEGER AS gt_idx, label FROM l")
def rcnn_labels(spark, sf_dir):
    """Best box, overlap and label of every anchor in every image."""
    return anchors.label_anchors(_labelled(spark, sf_dir), _LATTICE).select("image_id", "anchor_idx", r6(F.col("max_iou")).alias("max_iou"), "gt_idx", "label")


_TARGET = """t AS (SELECT *, (gt.xmin + 0.5 * (gt.xmax - gt.xmin + 1) - (axmin + 0.5 * (axmax - axmin + 1))) / (axmax - axmin + 1) AS dx, (gt.ymin + 0.5 * (gt.ymax - gt.ymin + 1) - (aymin + 0.5 * (aymax - aymin + 1))) / (aymax - aymin + 1) AS dy,
  ln((gt.xmax - gt.xmin + 1) / (axmax - axmin + 1)) AS dw, ln((gt.ymax - gt.ymin + 1) / (aymax - aymin + 1)) AS dh FROM l)"""


@query(f"{_LABEL}, {_TARGET} SELECT image_id::BIGINT AS image_id, anchor_idx, round(dx, 5) AS dx, round(dy, 5) AS dy, round(dw, 5) AS dw, round(dh, 5) AS dh FROM t")
def rcnn_targets(spark, sf_dir):
    t = anchors.targets(_labelled(spark, sf_dir), _LATTICE)
    return t.select("image_id", "anchor_idx", *(F.round(c, 5).alias(c) for c in ("dx", "dy", "dw", "dh")))


_SAMPLED = f"""{_LABEL}, u AS (SELECT *, {sql_draw('((image_id * 1000003 + anchor_idx) % 2147483647)', SEED, 5)} AS u FROM l WHERE label >= 0),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY u, anchor_idx) AS rank, least(count(*) FILTER (label = 1) OVER (PARTITION BY image_id), 16) AS fg FROM u),
q AS (SELECT * FROM k WHERE CASE WHEN label = 1 THEN rank <= 16 ELSE rank <= 32 - fg END)"""


def _sampled(spark, sf_dir):
    return anchors.sample(_labelled(spark, sf_dir), _LATTICE, 32, 0.5, SEED)


@query(f"{_SAMPLED} SELECT image_id::BIGINT AS image_id, anchor_idx, label FROM q")
def rcnn_sample(spark, sf_dir):
    """At most 32 anchors an image, half of them positive."""
    return _sampled(spark, sf_dir).select("image_id", F.explode("sample").alias("_s")).select("image_id", "_s.anchor_idx", "_s.label")


@query(f"""{_SAMPLED} SELECT i.image_id::BIGINT AS image_id, count(*)::BIGINT AS n_anchors, count(*) FILTER (q.label = 1)::BIGINT AS n_pos, count(*) FILTER (q.label = 0)::BIGINT AS n_neg
FROM (SELECT DISTINCT image_id FROM g) i CROSS JOIN a LEFT JOIN q ON q.image_id = i.image_id AND q.anchor_idx = a.anchor_idx GROUP BY 1""")
def rcnn_planes(spark, sf_dir):
    """The loader's planes, counted: every anchor has a place, few are used."""
    p = anchors.planes(_sampled(spark, sf_dir), _LATTICE)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    half = lambda k: F.slice("labels_flat", k * 900 + 1, 900)
    return p.select("image_id", (F.size("bbtargets") / 4).cast("bigint").alias("n_anchors"), total(half(1)).alias("n_pos"), total(half(0)).alias("n_neg"))


# --- augmentation -------------------------------------------------------------------------------------------------

_SAMPLERS = [
    {"max_sample": 1, "max_trials": 8, "sampler": {"scale": (0.3, 1.0), "aspect_ratio": (0.5, 2.0)}, "sample_constraint": {"min_jaccard_overlap": 0.1}},
    {"max_trials": 5, "sampler": {"scale": (0.5, 0.9)}, "sample_constraint": {"min_object_coverage": 0.5}},
]


def _images(spark, sf_dir):
    b = boxes(spark, sf_dir)
    n = box().normalize(F.lit(512.0), F.lit(512.0))
    b = b.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")  # small rows that take long: as many tasks as asked for
    return b.groupBy("image_id").agg(F.collect_list(n.struct()).alias("objects"))


def _sql_patches() -> str:
    parts = []
    for k, s in enumerate(_SAMPLERS):
        (s0, s1), (a0, a1) = s["sampler"]["scale"], s["sampler"].get("aspect_ratio", (1.0, 1.0))
        row = f"((image_id * 7919 + {k * 1009} + trial) % 2147483647)"
        parts.append(f"""SELECT image_id, {k} AS sampler, trial, {float(s0)}::DOUBLE + us * {float(s1 - s0)}::DOUBLE AS scale, {float(a0)}::DOUBLE AS a0, {float(a1)}::DOUBLE AS a1, ua, ux, uy
FROM (SELECT image_id, trial, {", ".join(f"{sql_draw(row, SEED, d)} / {M}.0::DOUBLE AS {n}" for n, d in (("us", 40), ("ua", 41), ("ux", 42), ("uy", 43)))} FROM (SELECT DISTINCT image_id FROM b), range({s['max_trials']}) AS t(trial))""")
    return f"""p AS ({" UNION ALL ".join(parts)}), q AS (SELECT *, greatest(a0, scale * scale) + ua * (least(a1, 1 / (scale * scale)) - greatest(a0, scale * scale)) AS aspect FROM p),
e AS (SELECT *, scale * sqrt(aspect) AS w, scale / sqrt(aspect) AS h FROM q), f AS (SELECT image_id, sampler::INTEGER AS sampler, trial::INTEGER AS trial, ux * (1 - w) AS x0, uy * (1 - h) AS y0, ux * (1 - w) + w AS x1, uy * (1 - h) + h AS y1 FROM e)"""


@query(f"WITH {_BOXES}, {_sql_patches()} SELECT image_id, sampler, trial, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM f")
def sampler_patch(spark, sf_dir):
    """All trial patches of two samplers."""
    p = augment.sampler_patches(boxes(spark, sf_dir).select("image_id").distinct(), _SAMPLERS, SEED)
    return p.select("image_id", "sampler", "trial", *_sides(box()))


_MEETS = f"""WITH {_BOXES}, {_sql_patches()}, j AS (SELECT f.*, b.xmin / 512.0 AS ox0, b.ymin / 512.0 AS oy0, (b.xmax + 1) / 512.0 AS ox1, (b.ymax + 1) / 512.0 AS oy1 FROM f JOIN b USING (image_id)),
v AS (SELECT *, greatest(0, least(x1, ox1) - greatest(x0, ox0)) * greatest(0, least(y1, oy1) - greatest(y0, oy0)) AS si, (x1 - x0) * (y1 - y0) AS sp, (ox1 - ox0) * (oy1 - oy0) AS so FROM j),
g AS (SELECT image_id, sampler, trial, x0, y0, x1, y1, bool_or(CASE WHEN sampler = 0 THEN si / (sp + so - si) >= 0.1 ELSE si / so >= 0.5 END) AS meets FROM v GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4, 5, 6, 7")


@query(f"{_MEETS} SELECT image_id, sampler, trial, meets FROM g")
def sample_constraint(spark, sf_dir):
    """Which patches meet their sampler's constraint for some box."""
    return augment.tested_patches(_images(spark, sf_dir), _SAMPLERS, SEED).select("image_id", "sampler", "trial", "meets")


@query(
    f"""{_MEETS}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id, sampler ORDER BY trial) AS rank FROM g WHERE meets),
c AS (SELECT image_id, list(struct_pack(sampler, trial, x0) ORDER BY sampler, trial) AS l FROM k WHERE sampler = 1 OR rank <= 1 GROUP BY image_id),
i AS (SELECT DISTINCT image_id FROM b), z AS (SELECT i.image_id, c.l, floor({sql_draw('i.image_id', SEED, 44)} / {M}.0::DOUBLE * coalesce(len(c.l), 0))::INTEGER + 1 AS place FROM i LEFT JOIN c ON c.image_id = i.image_id)
SELECT image_id, coalesce(l[place].sampler, -1)::INTEGER AS sampler, coalesce(l[place].trial, -1)::INTEGER AS trial, round(coalesce(l[place].x0, 0), 6) AS x0 FROM z"""
)
def batch_sampler(spark, sf_dir):
    """One patch an image: of those that meet their constraints, or the full frame."""
    out = augment.batch_samples(_images(spark, sf_dir), _SAMPLERS, SEED)
    return out.select("image_id", "sampler", "trial", r6(F.col("xmin")).alias("x0"))


_AUG = augment.Augmentation(scale=(0.5, 1.0), angle=(-20, 20), horizontal_distortion=(0.75, 1.33), contrast=(0.8, 1.2), hue=(-10, 10), flip_enable=True, center=False)


def _u(draw: str) -> str:
    return f"({sql_draw('p_partkey', SEED, augment.DRAWS[draw])} / {M}.0::DOUBLE)"


@query(
    f"""WITH d AS (SELECT p_partkey, (p_size * 10 + 50)::DOUBLE AS w, floor(p_retailprice / 4)::DOUBLE + 30 AS h, {_u('angle')} AS ua, {_u('flip')} AS uf, {_u('hue')} AS uh, {_u('contrast')} AS uc, {_u('scale')} AS us, {_u('distortion')} AS ud, {_u('xoff')} AS ux, {_u('yoff')} AS uy FROM part),
o AS (SELECT *, 224 * (0.75::DOUBLE + ud * {1.33 - 0.75}::DOUBLE) AS ow, 0.5::DOUBLE + us * 0.5::DOUBLE AS s FROM d), f AS (SELECT *, least(w / ow, h / 224.0) AS fit FROM o),
c AS (SELECT *, ow * fit * s AS cw, 224.0 * fit * s AS ch FROM f)
SELECT p_partkey, (-20 + floor(ua * 41))::INTEGER AS angle, uf < 0.5 AS flip, (-10 + floor(uh * 21))::INTEGER AS hue, round(0.8::DOUBLE + uc * {1.2 - 0.8}::DOUBLE, 6) AS contrast,
  floor((w - cw) * ux)::INTEGER AS crop_x, floor((h - ch) * uy)::INTEGER AS crop_y, floor(cw)::INTEGER AS crop_width, floor(ch)::INTEGER AS crop_height FROM c"""
)
def augmentation_draw(spark, sf_dir):
    """The shared draw of each record."""
    w, h = F.col("p_size") * 10 + 50, F.floor(F.col("p_retailprice") / 4) + 30
    df = augment.with_augmentation(table(spark, sf_dir, "part"), _AUG, SEED, w, h, 224, 224, "p_partkey")
    return df.select("p_partkey", "aug.angle", "aug.flip", "aug.hue", r6(F.col("aug.contrast")).alias("contrast"), "aug.crop_x", "aug.crop_y", "aug.crop_width", "aug.crop_height")


# --- pixels -------------------------------------------------------------------------------------------------------

_PLANE = "list_transform(embedding, lambda x: round(x::DOUBLE * 100 + 128, 3))"


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 100 + 128, 3)).alias("p"))


def _long(df: DataFrame, cell: str = "value") -> DataFrame:
    """Cells as rows, so that both engines compare numbers."""
    return df.select("vec_id", F.posexplode("p").alias("position", cell)).withColumn(cell, F.round(cell, 6))


def _sql_gather(index: str, n: int, value: str = "p[i + 1]") -> str:
    return f"WITH v AS (SELECT vec_id, {_PLANE} AS p FROM embeddings), c AS (SELECT vec_id, p, k, {index} AS i FROM v, range({n}) AS t(k)) SELECT vec_id, k::INTEGER AS position, round({value}, 6) AS value FROM c"


@query(_sql_gather("k // 8 * 8 + 7 - k % 8", 64))
def flip_pixels(spark, sf_dir):
    return _long(planes(spark, sf_dir).withColumn("p", pixels.plane_flip(F.col("p"), 8, 8)))


@query(_sql_gather("(k // 4 + 3) * 8 + k % 4 + 2", 20))
def crop_pixels(spark, sf_dir):
    return _long(planes(spark, sf_dir).withColumn("p", pixels.plane_crop(F.col("p"), 8, 8, 2, 3, 4, 5)))


@query(_sql_gather("CASE WHEN k % 8 + 1 - 2 BETWEEN 0 AND 7 AND k // 8 + 3 - 2 BETWEEN 0 AND 7 THEN (k // 8 + 1) * 8 + k % 8 - 1 END", 64, "coalesce(p[i + 1], 0)"))
def pad_pixels(spark, sf_dir):
    """A border of two, then a crop of the old size."""
    return _long(planes(spark, sf_dir).withColumn("p", pixels.plane_pad(F.col("p"), 8, 8, 2, 1, 3)))


@query(_sql_gather("(k // 12 * 8 // 6) * 8 + k % 12 * 8 // 12", 72))
def resize_nearest(spark, sf_dir):
    return _long(planes(spark, sf_dir).withColumn("p", pixels.plane_resize_nearest(F.col("p"), 8, 8, 12, 6)))


@query(_sql_gather("k", 64, "(p[i + 1] / 255.0 - 0.45) / 0.225"))
def standardize(spark, sf_dir):
    return _long(planes(spark, sf_dir).withColumn("p", pixels.plane_standardize(F.col("p"), 0.45, 0.225)))


@query(f"WITH v AS (SELECT vec_id, {_PLANE} AS p FROM embeddings) SELECT vec_id, k::INTEGER AS position, floor((1.3::DOUBLE * p[k + 1] + (1 - 1.3::DOUBLE) * (list_sum(p) / 64)) * 100 + 0.500123) AS hundredths FROM v, range(64) AS t(k)")
def contrast(spark, sf_dir):
    """In hundredths; the odd offset keeps exact halves away from the edge, as sums differ in their last bit."""
    out = planes(spark, sf_dir).withColumn("p", pixels.plane_contrast(F.col("p"), 1.3)).select("vec_id", F.posexplode("p").alias("position", "v"))
    return out.select("vec_id", "position", F.floor(F.col("v") * 100 + 0.500123).cast("double").alias("hundredths"))


@query(_sql_gather("k % 3 * 21 + k // 3", 63))
def channel_reorder(spark, sf_dir):
    """Three planes of 21 to pixels."""
    p = F.col("p")
    return _long(planes(spark, sf_dir).withColumn("p", pixels.interleave([F.slice(p, 1, 21), F.slice(p, 22, 21), F.slice(p, 43, 21)])))


_MATRIX = pixels.saturation_matrix(1.2, 0.7)


@query(f"WITH v AS (SELECT vec_id, {_PLANE} AS p FROM embeddings) SELECT vec_id, " + ", ".join(f"round({' + '.join(f'{m!r}::DOUBLE * p[{i + 1}]' for i, m in enumerate(row))}, 4) AS {c}" for c, row in zip("bgr", _MATRIX)) + " FROM v")
def brightness_saturation(spark, sf_dir):
    p = F.col("p")
    out = pixels.brightness_saturation(F.get(p, 0), F.get(p, 1), F.get(p, 2), 1.2, 0.7)
    return planes(spark, sf_dir).select("vec_id", *(F.round(x, 4).alias(c) for c, x in zip("bgr", out)))


@query(f"""WITH r AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS row_idx FROM embeddings), x AS (SELECT row_idx // {BATCH} AS batch_id, row_idx % {BATCH} AS slot, k, round(embedding[k + 1]::DOUBLE, 5) AS v FROM r, range(64) AS t(k))
SELECT batch_id::BIGINT AS batch_id, k::INTEGER AS position, count(*)::INTEGER AS n, round(first(v ORDER BY slot), 5) AS head, round(last(v ORDER BY slot), 5) AS tail FROM x GROUP BY 1, 2""")
def batch_transpose(spark, sf_dir):
    """Batches with the batch axis last."""
    df = rows.with_row_index(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    df = df.select(F.floor(F.col("row_idx") / BATCH).cast("long").alias("batch_id"), (F.col("row_idx") % BATCH).alias("slot"), F.col("embedding").cast("array<double>").alias("v"))
    t = rows.transpose(df, "batch_id", "slot", "v")
    return t.select("batch_id", "position", F.size("values").alias("n"), F.round(F.get("values", 0), 5).alias("head"), F.round(F.element_at("values", -1), 5).alias("tail"))


# --- audio --------------------------------------------------------------------------------------------------------

_N = 64


def _sql_window(kind: str) -> str:
    if kind == "bartlett":
        return f"1.0::DOUBLE - abs(2.0 * k - {_N - 1}) / {_N - 1}"
    terms = audio.COSINES[kind]
    return " + ".join([f"{terms[0]}::DOUBLE", *(f"({c}::DOUBLE) * cos(k * (2 * pi() * {t} / {_N - 1}))" for t, c in enumerate(terms) if t)])


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, k::INTEGER AS position, round({_sql_window(k)}, 6) + 0.0 AS value FROM range({_N}) AS t(k)" for k in (*audio.COSINES, "bartlett")))
def audio_window(spark, sf_dir):
    out = None
    for kind in (*audio.COSINES, "bartlett"):
        w = spark.range(1).select(F.lit(kind).alias("kind"), F.posexplode(audio.window(kind, _N)).alias("position", "value")).withColumn("value", F.round("value", 6) + 0.0)
        out = w if out is None else out.unionByName(w)
    return out


@query(
    """WITH e AS (SELECT k, floor(513 * 700 * (10 ** ((2595 * log10(1 + 8000.0 / 700)) * k / 21 / 2595) - 1) / 16000)::INTEGER AS edge FROM range(22) AS t(k)),
f AS (SELECT a.k AS filter, a.edge AS lo, b.edge AS mid, c.edge AS hi FROM e a JOIN e b ON b.k = a.k + 1 JOIN e c ON c.k = a.k + 2)
SELECT filter::INTEGER AS filter, i::INTEGER AS bin, round(CASE WHEN i >= lo AND i < mid THEN (i - lo) / greatest(1, mid - lo) WHEN i >= mid AND i < hi THEN (hi - i) / greatest(1, hi - mid) ELSE 0 END::DOUBLE, 6) AS weight FROM f, range(257) AS t(i)"""
)
def mel_filterbank(spark, sf_dir):
    bank = audio.filterbank(20, 512, 16000)
    cells = [(k, i, round(float(bank[i, k]), 6)) for k in range(20) for i in range(257)]
    return spark.createDataFrame(cells, "filter int, bin int, weight double")


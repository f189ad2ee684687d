"""Removal of byte strings of ``LENGTH`` bytes that start at two places or more, by a sparse suffix array.

A window is a string of LENGTH bytes of one text. Its anchor is the position of the 16-byte string in it with the
smallest hash (the leftmost of equals), so equal windows have equal anchors at equal offsets. A run is a maximal
sequence of windows of one text with the same anchor; all that its windows hold is its context. Suffixes that start at
anchors, about one byte in 190, therefore find every repeat:

1. Runs are reduced to hashes. Anchors that occur once go. Contexts that occur twice are repeated as a whole.
2. Where an anchor has several different contexts, one copy of each context is fetched and range-partitioned by the
   leading bytes of the suffix at its anchor (Spark samples the splitters). In a bucket, the suffixes with the same anchor
   and the reversed texts before it are sorted by multikey quicksort. The common prefixes of neighbours then
   tell for each window offset which contexts share the window: they agree on enough bytes on both sides. Equal
   leading bytes never fall on two sides of a splitter, so no neighbour is missed at a boundary.
3. An anchor with more than ``GROUP`` contexts does not fit one task. Its contexts stay where they are, and their windows
   are hashed and counted as rows.

An anchor or a context with a large share of all rows meets its like in no task: see :func:`.common.join_counted`.
Texts travel compressed, and only hashes of runs are shuffled otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_counted, stage_table

LENGTH = 400
GRAM = 16
GROUP = 40_000  # contexts of one anchor that a task resolves
PAIRWISE = 24  # contexts of one anchor whose common prefixes are taken pair by pair after the sort
BUFFER = 2 << 20  # bytes of text that are hashed at a time


def _grams(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    n = len(buf) - GRAM + 1
    words = np.ndarray(n + 8, "<u8", buf.data if buf.flags.c_contiguous else buf.copy().data, strides=(1,)).copy()
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += words[8:]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of each w values, the leftmost of equals."""
    bits = np.uint64(34)
    v = (h >> bits << bits) | np.arange(len(h), dtype="u8")
    n = len(v)
    padded = np.full(-(-n // w) * w, np.iinfo("u8").max, "u8")
    padded[:n] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & np.uint64((1 << 34) - 1)).astype("i8")


def _runs(texts: list[bytes], length: int):
    """Runs of some texts: (text index, start in the text, windows, anchor from start, gram hash, context hash)."""
    joined = b"".join(texts)
    none = np.zeros(0, "i8")
    if len(joined) < length:
        return none, none, none, none, none, np.zeros((0, 2), "i8")
    buf = np.frombuffer(joined, "u1")
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    grams = _grams(buf)
    anchors = _least(grams, length - GRAM + 1)
    windows = np.maximum(0, sizes - length + 1)
    which = np.repeat(np.arange(len(texts)), windows)
    at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[which]
    a = anchors[at]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (which[1:] != which[:-1])]) if len(at) else none
    n = np.diff(np.r_[first, len(at)])
    lo, digest = at[first], xxhash.xxh3_128_digest
    ctx = np.frombuffer(b"".join([digest(joined[s:e]) for s, e in zip(lo.tolist(), (lo + n - 1 + length).tolist())]), "<i8").reshape(-1, 2)
    return which[first], lo - begin[which[first]], n, a[first] - lo, grams[a[first]].view("i8"), ctx


def text_key(raw: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw)).view("i8"))


RUN_SQL = "doc_id long, k long, g long, c1 long, c2 long, lo long, n int, off int"


def _scan(length):
    def run(batches):
        for b in batches:
            ids, texts, size = [], [], 0
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if raw and len(raw) >= length:
                    ids.append(doc), texts.append(raw)
                    size += len(raw)
                if size > BUFFER:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
            yield flush(ids, texts)

    def flush(ids, texts):
        which, lo, n, off, g, ctx = _runs(texts, length)
        doc, k = np.array(ids, "i8"), np.array([text_key(t) for t in texts], "i8")
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc[which], k[which], g, np.ascontiguousarray(ctx[:, 0]), np.ascontiguousarray(ctx[:, 1]), lo, n.astype("i4"), off.astype("i4"))],
            ["doc_id", "k", "g", "c1", "c2", "lo", "n", "off"],
        )

    return run


def _squeeze(batches):
    zip_ = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raws = [x or b"" for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_key(x) for x in raws], pa.int64()), pa.array([zip_.compress(x) for x in raws], pa.binary())], ["doc_id", "k", "z"])


def _fetch(length):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, want in zip(b.column("z").to_pylist(), b.column("want").to_pylist()):
                raw = unzip.decompress(z)
                for w in want:
                    a = w["lo"] + w["off"]
                    out.append((raw[a : a + GRAM], w["g"], w["c1"], w["c2"], raw[w["lo"] : a], raw[a : w["lo"] + w["n"] - 1 + length], w["wide"]))
                if len(out) > 20_000:
                    yield pack(out)
                    out = []
            yield pack(out)

    def pack(out):
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["lead", "g", "c1", "c2", "before", "after", "wide"])

    return run


def multikey_order(digits: np.ndarray) -> np.ndarray:
    """Order of the rows by multikey quicksort: split three ways at one digit, move to the next digit where it is equal."""
    out, todo, place = np.empty(len(digits), "i8"), [(np.arange(len(digits)), 0)], 0
    while todo:
        rows, d = todo.pop()
        if len(rows) < 2 or d == digits.shape[1]:
            out[place : place + len(rows)] = rows
            place += len(rows)
            continue
        v = digits[rows, d]
        pivot = v[len(v) // 2]
        less, more = v < pivot, v > pivot
        todo += [(rows[more], d), (rows[~less & ~more], d + 1), (rows[less], d)]
        todo = [t for t in todo[:-3]] + [t for t in todo[-3:] if len(t[0])]
    return out


def _sorted_prefixes(strings: list[bytes], width: int):
    """Place of each string in sorted order, and common bytes of neighbours there."""
    wide = -(-width // 8) * 8
    m = np.frombuffer(b"".join(s[:width].ljust(wide, b"\0") for s in strings), "u1").reshape(-1, wide)
    order = multikey_order(m.view(">u8"))
    place = np.empty(len(order), "i8")
    place[order] = np.arange(len(order))
    common = np.empty(len(order) - 1, "i8")
    for k in range(0, len(common), 4096):
        other = m[order[k + 1 : k + 4097]] != m[order[k : k + 4096]][: len(order) - 1 - k]
        common[k : k + 4096] = np.where(other.any(1), other.argmax(1), wide)
    return place, common


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid)
    return lo


def _few_prefixes(strings: list[bytes]) -> tuple[list[int], list[list[int]]]:
    """For a few strings: the place of each in multikey quicksort order, and the common bytes of the strings at two places.

    The bytes that all have in common need no sorting. Two strings share as many bytes as the neighbours between them.
    """
    same = min(_common(strings[0], s) for s in strings) // 8
    digits = lambda s, d: int.from_bytes(s[8 * d : 8 * d + 8].ljust(8, b"\0"), "big")

    def order(rows, d):
        if len(rows) < 2:
            return rows
        if all(8 * d >= len(strings[i]) for i in rows):
            return sorted(rows, key=lambda i: len(strings[i]))
        keys = [digits(strings[i], d) for i in rows]
        pivot = keys[len(keys) // 2]
        less, equal, more = ([i for i, k in zip(rows, keys) if k < pivot], [i for i, k in zip(rows, keys) if k == pivot], [i for i, k in zip(rows, keys) if k > pivot])
        return [*order(less, d), *order(equal, d + 1), *order(more, d)]

    rows = order(list(range(len(strings))), same)
    place = [0] * len(rows)
    for x, i in enumerate(rows):
        place[i] = x
    near = [_common(strings[a], strings[b]) for a, b in zip(rows, rows[1:])]
    common = []
    for x in range(len(rows)):
        least, line = 1 << 60, [0] * len(rows)
        for y in range(x + 1, len(rows)):
            least = min(least, near[y - 1])
            line[y] = least
        common.append(line)
    return place, common


def shared_offsets(contexts: list[tuple[bytes, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each context (bytes before its anchor, bytes from it on) the window offsets, as inclusive ranges, that it shares.

    A window at offset d holds d bytes before the anchor and length - d from it on.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if len(contexts) <= PAIRWISE:
        rplace, rcommon = _few_prefixes([after for _, after in contexts])
        lplace, lcommon = _few_prefixes([before[::-1] for before, _ in contexts])
        for i in range(len(contexts)):
            for j in range(i):
                right = rcommon[min(rplace[i], rplace[j])][max(rplace[i], rplace[j])]
                left = lcommon[min(lplace[i], lplace[j])][max(lplace[i], lplace[j])]
                if left + right >= length:
                    for x in (i, j):
                        out[x].append((length - right, left))
        return out
    n = len(contexts)
    most = np.array([len(b) for b, _ in contexts])  # the largest and smallest window offset of each
    least = length - np.array([len(a) for _, a in contexts])
    rplace, rcommon = _sorted_prefixes([a for _, a in contexts], length)
    lplace, lcommon = _sorted_prefixes([b[::-1] for b, _ in contexts], length)
    open_ = np.full(n, -1)
    for d in range(least.min(), most.max() + 2):
        here = np.flatnonzero((least <= d) & (d <= most))
        shared = np.zeros(n, bool)
        if len(here) > 1:
            right = np.r_[0, np.cumsum(rcommon < length - d)][rplace[here]]
            left = np.r_[0, np.cumsum(lcommon < d)][lplace[here]]
            _, inverse, count = np.unique(right * n + left, return_inverse=True, return_counts=True)
            shared[here] = count[inverse] > 1
        for i in np.flatnonzero(shared & (open_ < 0)):
            open_[i] = d
        for i in np.flatnonzero(~shared & (open_ >= 0)):
            out[i].append((int(open_[i]), d - 1))
            open_[i] = -1
    return out


SHARE_SQL = "g long, c1 long, c2 long, ranges array<int>"
SHARE_ARROW = pa.schema([("g", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("ranges", pa.list_(pa.int32()))])


def _resolve(length):
    """Contexts, sorted by their anchors' bytes, to the offsets that they share."""

    def run(batches):
        lead, rows, out = None, [], []
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("lead", "g", "c1", "c2", "before", "after"))):
                if r[0] != lead:
                    out += done(rows)
                    lead, rows = r[0], []
                elif rows and rows[-1][2:4] == r[2:4]:
                    continue  # a repeated row's copy
                rows.append(r)
                if len(out) > 20_000:
                    yield pack(out)
                    out = []
        yield pack(out + done(rows))

    def done(rows):
        found = shared_offsets([r[4:6] for r in rows], length) if len(rows) > 1 else []
        return [(r[1], r[2], r[3], [x for p in f for x in p]) for r, f in zip(rows, found) if f]

    def pack(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(SHARE_ARROW.types)], schema=SHARE_ARROW)

    return run


WINDOW_SQL = "g long, c1 long, c2 long, w1 long, w2 long, d int"


def _windows(length):
    """Contexts to the hashes of their windows and the windows' offsets, about 20,000 rows at a time."""

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            part, n = [], 0
            for r in zip(*(b.column(c).to_pylist() for c in ("g", "c1", "c2", "before", "after"))):
                raw = r[3] + r[4]
                w = np.frombuffer(b"".join([digest(raw[p : p + length]) for p in range(len(raw) - length + 1)]), "<i8").reshape(-1, 2)
                part.append((np.tile(np.array(r[:3], "i8"), (len(w), 1)), w, len(r[3]) - np.arange(len(w), dtype="i4")))
                n += len(w)
                if n > 20_000:
                    yield pack(part)
                    part, n = [], 0
            if part:
                yield pack(part)

    def pack(part):
        ids, w, d = (np.concatenate([p[k] for p in part]) for k in range(3))
        cols = [*(np.ascontiguousarray(x[:, k]) for x in (ids, w) for k in range(x.shape[1])), d]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["g", "c1", "c2", "w1", "w2", "d"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, k (hash of the text) and spans (flat byte start, end; they may overlap) of what repeats."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(2**63))))
    runs = stage_table(rows.mapInArrow(_scan(length), RUN_SQL), "runs")
    often = stage_table(runs.groupBy("g").agg(F.count("*").alias("share")).where("share > 1"), "often")
    some = stage_table(join_counted(runs, often, ["g"], runs.count()).drop("share"), "anchors")
    drop_table(runs, often)
    ctx = ["g", "c1", "c2"]
    contexts = some.groupBy(*ctx).agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "k", "lo", "n", "off")).alias("one"))
    contexts = stage_table(contexts, "contexts")
    several = stage_table(contexts.groupBy("g").agg(F.count("*").alias("share")).where("share > 1"), "several")
    want = join_counted(contexts, several, ["g"], contexts.count())
    want = want.select("one.doc_id", "one.k", F.struct(*ctx, "one.lo", "one.n", "one.off", (F.col("share") > group).alias("wide")).alias("w"))
    want = want.groupBy("doc_id", "k").agg(F.collect_list("w").alias("want"))
    texts = rows.mapInArrow(_squeeze, "doc_id long, k long, z binary")
    fetched = texts.join(want, ["doc_id", "k"]).select("z", "want")
    fetched = stage_table(fetched.mapInArrow(_fetch(length), "lead binary, g long, c1 long, c2 long, before binary, after binary, wide boolean"), "suffixes")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = fetched.where("not wide").repartitionByRange(tasks, "lead").sortWithinPartitions("lead", "c1", "c2")
    ranges = stage_table(buckets.mapInArrow(_resolve(length), SHARE_SQL), "shared")
    hashed = stage_table(fetched.where("wide").dropDuplicates(ctx).mapInArrow(_windows(length), WINDOW_SQL), "windows")
    drop_table(fetched, several)
    if not hashed.isEmpty():
        twice = hashed.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        ds = hashed.join(twice, ["w1", "w2"], "left_semi").groupBy(*ctx).agg(F.flatten(F.collect_list(F.array("d", "d"))).alias("ranges"))
        ranges = ranges.unionByName(ds)
    found = contexts.select(*ctx, "m").join(ranges, ctx, "left").where("m > 1 or ranges is not null")
    found = stage_table(found.select(*ctx, F.col("m").alias("share"), F.when(F.col("m") == 1, F.col("ranges")).alias("ranges")), "found")
    at = F.col("lo") + F.col("off")
    whole = F.array(F.col("lo"), F.col("lo") + F.col("n") - 1 + length)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("ranges") / 2 - 1).cast("int")), lambda i: F.array(at - F.get("ranges", 2 * i + 1), at - F.get("ranges", 2 * i) + length))
    spans = F.when(F.col("ranges").isNull(), whole).otherwise(F.flatten(pairs))
    hit = join_counted(some, found, ctx, some.count()).select("doc_id", "k", spans.alias("s"))
    return hit.groupBy("doc_id", "k").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _cut(digest_only):
    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist()):
                raw, merged = unzip.decompress(z), []
                for s, e in sorted(zip(spans[::2], spans[1::2])) if spans else ():
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                kept, end = [], 0
                for s, e in merged:
                    kept.append(raw[end:s])
                    end = e
                kept = b"".join([*kept, raw[end:]])
                out.append((len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), None if digest_only else [x for m in merged for x in m], None if digest_only else kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols][: 5 if digest_only else 7], [*OUT, "removed", "kept"][: 5 if digest_only else 7])

    return run


OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest_only: bool = False, group: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (flat start, end), kept (bytes).

    Every byte of a string of ``length`` bytes that also starts elsewhere in any text goes, at all its places. Removed
    spans are maximal and byte-based, so ``kept`` need not be valid UTF-8. Null texts are empty, texts below ``length``
    stay whole. Repeated rows are texts of their own, so both lose what they share; rows that share id and text give
    the same result. Rows without an id are cleaned like any other. ``length`` must be over 16. No rows give no rows.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spans = repeated_spans(docs, id_col, text_col, length, group)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary"))
    texts = rows.mapInArrow(_squeeze, "doc_id long, k long, z binary")
    spans = spans.withColumnRenamed("doc_id", "id").withColumnRenamed("k", "ik")
    both = texts.join(spans, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("id")) & (F.col("k") == F.col("ik")), "left").select("doc_id", "z", "spans")
    more = "" if digest_only else ", removed array<long>, kept binary"
    return both.mapInArrow(_cut(digest_only), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")

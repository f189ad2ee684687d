"""SimHash near-duplicates by a byte-position inverted index with count filtering.

The index has one posting list per ``COMBO`` byte positions and their values. Two 64-bit fingerprints that differ in at
most 4 bits agree in at least 4 of their 8 bytes, so in at least 3 of the first 7: with one list per three of these,
every pair to be found meets in a list, and a list holds one in 2**24 of unrelated fingerprints. Whenever two
fingerprints meet, the positional bytes that they share are tallied; pairs with fewer than the guaranteed minimum are
dropped, and the rest is verified bit by bit. That holds for short lists, which are paired; for long ones, which are
walked; and for lists beyond ``BLOCK`` members, which are cut into blocks that are compared two at a time in tasks of their own.
All of them give a spanning forest of their links, never their pairs.

A large group of near copies meets in every list. So the lists are read in rounds (``ROUNDS``): the first few lists join most of such
a group, and in the next round its members go by the name of their component, so that a list gives only links between
components that no earlier round has joined, and compares no two members of one.

A wider sketch (``words`` > 1) tells similar texts from others by more bits than an index can guarantee: then the
lists are fixed combinations of positions, which find a measured share of the pairs (see :data:`SIMILAR`).
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, contract, drop_table, join_counted, released, stage_table

SEED, COMBO = 42, 3
FEW, BLOCK = 64, 8192
ROUNDS = (4, 12)  # lists that have been read after each round but the last


@dataclass(frozen=True)
class Sketch:
    """What a fingerprint is made of, and what links two."""

    shingle: int  # words in a shingle
    words: int  # 64-bit words in a fingerprint
    bits: int  # bits in which linked fingerprints differ, at most
    combos: tuple[tuple[int, ...], ...]  # byte positions of the posting lists
    tally: int = 0  # positional bytes that linked fingerprints share at least, where their bits guarantee none

    @property
    def shared(self) -> int:
        """Positional bytes that two linked fingerprints which meet in a list share at least."""
        return max(COMBO, 8 * self.words - self.bits, self.tally)


#: Fingerprints of 64 bits that differ in 4 at most: the lists miss no pair.
EXACT = Sketch(4, 1, 4, tuple(combinations(range(7), COMBO)))


def _similar(words: int, lists: int, least: float) -> Sketch:
    """Cosine of shingle counts ``least`` or more, as the share of differing bits tells it, and one shared byte more than a list grants."""
    rng, n = np.random.default_rng(SEED), 8 * words
    combos = sorted({tuple(sorted(rng.choice(n, COMBO, replace=False).tolist())) for _ in range(4 * lists)})
    picked = sorted(rng.permutation(len(combos))[:lists].tolist())
    return Sketch(5, words, math.floor(64 * words * math.acos(least) / math.pi), tuple(combos[i] for i in picked), COMBO + 1)


#: Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more (a cosine of 0.89), by 256 bits. At 0.8 such texts
#: differ in 39 bits and share 8.7 bytes on average; links take up to 52 bits and at least 4 bytes. By the odds the lists
#: find 0.92 of the pairs at 0.8, the tally keeps 0.99 of them and the bits 0.99; at 0.9 nearly all. Pairs below are
#: linked less and less often, down to a cosine of 0.8.
SIMILAR = _similar(4, 128, 0.8)


def _spread(h: np.ndarray, words: int) -> np.ndarray:
    """Further words of a shingle's hash, for sketches of more than one."""
    out = [h]
    for k in range(1, words):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k & 2**64 - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, 1)


def fingerprint_words(raw: bytes | None, sketch: Sketch = EXACT) -> np.ndarray:
    """SimHash of a text's shingles, as unsigned 64-bit words."""
    words = (raw or b"").lower().split()  # bytes: only A-Z, and splits at 09-0D and 20
    if not words:
        return np.zeros(sketch.words, "u8")
    text, n = b" ".join(words), sketch.shingle
    if len(words) < n:
        cuts = [(0, len(text))]
    else:
        lens = np.fromiter(map(len, words), "i8", len(words))
        ends = np.cumsum(lens + 1) - 1
        cuts = zip((ends - lens)[: 1 - n or None].tolist(), ends[n - 1 :].tolist())
    digest = xxhash.xxh64_digest
    h = np.frombuffer(b"".join([digest(text[a:b], SEED) for a, b in cuts]), ">u8")
    ones = np.zeros(64 * sketch.words, "i8")
    for k in range(0, len(h), 4096):
        bits = h[k : k + 4096, None] if sketch.words == 1 else _spread(h[k : k + 4096].astype("u8"), sketch.words).astype(">u8")
        ones += np.unpackbits(bits.view("u1"), axis=1).sum(0, dtype="i8")
    return np.packbits(2 * ones > len(h)).view(">u8").astype("u8")


def fingerprint(raw: bytes | None) -> int:
    """Signed 64-bit SimHash of a text's 4-word shingles."""
    return int(fingerprint_words(raw).view("i8")[0])


def _fingerprints(sketch):
    def run(batches):
        for b in batches:
            fps = [fingerprint_words(x, sketch).view("i8") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fp"])

    return run


def _rows(fps: pa.Array, words: int) -> np.ndarray:
    """Fingerprints as rows of bytes, the highest first."""
    return fps.flatten().to_numpy().astype(">i8").view("u1").reshape(-1, 8 * words)


def _linked(x: np.ndarray, y: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Which pairs of rows are links: the shared positional bytes are tallied, and the bits of what is left counted."""
    apart = np.ascontiguousarray(x ^ y)
    ok = np.count_nonzero(apart, axis=1) <= 8 * sketch.words - sketch.shared
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(apart[at].view("u8")).sum(1) <= sketch.bits
    return ok


def _pairs(key, fp, rep, sketch):
    """Links within lists of at most FEW members, each pair in the first list that has it, but those within one node."""
    out, combos = [], np.array(sketch.combos)
    for d in range(1, FEW):
        i = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else []
        if not len(i):
            break
        i = i[rep[i] != rep[i + d]]
        i = i[_linked(fp[i], fp[i + d], sketch)]
        first = (fp[i] == fp[i + d])[:, combos].all(2).argmax(1)
        i = i[first == key[i] >> 8 * COMBO]
        out.append((rep[i], rep[i + d]))
    return out


def forest(fp, rep, sketch: Sketch = EXACT):
    """A spanning forest of the links among fingerprints that share a list; those with the same ``rep`` are one node."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        same = rep[left] == rep[left[0]]
        todo, left = left[same].tolist(), left[~same]
        while todo and len(left):
            at = todo.pop()
            hit = _linked(fp[left], fp[at], sketch)
            if hit.any():
                new = np.unique(rep[left[hit]])
                out.append((np.full(len(new), rep[at]), new))
                hit = np.isin(rep[left], new)
                todo.extend(left[hit].tolist())
                left = left[~hit]
    return out


LINKS_SQL = "a long, b long, key long, block int, fps binary, reps binary"


def _batch(pairs=(), blocks=()):
    a, b = contract(*(np.concatenate([np.zeros(0, "i8"), *(p[k] for p in pairs)]) for k in (0, 1)))
    none, k = [None] * len(a), [None] * len(blocks)
    cols = [pa.array(a.tolist() + k, pa.int64()), pa.array(b.tolist() + k, pa.int64())]
    for c, kind in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary())):
        cols.append(pa.array(none + [x[c] for x in blocks], kind))
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "key", "block", "fps", "reps"])


def _lists(sketch):
    """Posting lists, sorted by key, to links; a list beyond BLOCK members leaves as blocks."""

    def run(batches):
        key, rep, blocks = np.zeros(0, "i8"), np.zeros(0, "i8"), 0
        fp = np.zeros((0, 8 * sketch.words), "u1")
        for b in _with_end(batches):
            if b is not None:
                key, rep = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in ((key, "key"), (rep, "rep")))
                fp = np.concatenate([fp, _rows(b.column("fp"), sketch.words)])
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            if b is None:
                starts = np.r_[starts, len(key)]
            out, packed = [], []
            if blocks and len(starts) > 1:  # the rest of a list that has left as blocks
                packed.append((int(key[0]), blocks, fp[: starts[1]].tobytes(), rep[: starts[1]].tobytes()))
                key, fp, rep, starts, blocks = key[starts[1] :], fp[starts[1] :], rep[starts[1] :], starts[1:] - starts[1], 0
            sizes, end = np.diff(starts), starts[-1]
            small = np.repeat(sizes <= FEW, sizes)
            out += _pairs(key[:end][small], fp[:end][small], rep[:end][small], sketch)
            for s in np.flatnonzero(sizes > FEW):
                cut = slice(starts[s], starts[s + 1])
                if sizes[s] <= BLOCK:
                    out += forest(fp[cut], rep[cut], sketch)
                else:
                    for n, at in enumerate(range(cut.start, cut.stop, BLOCK)):
                        k = slice(at, min(cut.stop, at + BLOCK))
                        packed.append((int(key[at]), n, fp[k].tobytes(), rep[k].tobytes()))
            key, fp, rep = key[end:], fp[end:], rep[end:]
            while len(key) > BLOCK:  # an unfinished long list
                packed.append((int(key[0]), blocks, fp[:BLOCK].tobytes(), rep[:BLOCK].tobytes()))
                key, fp, rep, blocks = key[BLOCK:], fp[BLOCK:], rep[BLOCK:], blocks + 1
            yield _batch(out, packed)

    return run


def _with_end(batches):
    yield from batches
    yield None


def _blocks(sketch):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                sides = "xy" if r["x_block"] != r["y_block"] else "x"
                fp = np.concatenate([np.frombuffer(r[f"{s}_fps"], "u1") for s in sides]).reshape(-1, 8 * sketch.words)
                rep = np.concatenate([np.frombuffer(r[f"{s}_reps"], "i8") for s in sides])
                yield _batch(forest(fp, rep, sketch))

    return run


def _block_pairs(hot: DataFrame) -> DataFrame:
    """Blocks of each long list, two at a time. The pairs are dealt by their numbers; only then do they get their members."""
    last = hot.groupBy("key").agg(F.max("block").alias("_last"))
    numbers = hot.select("key", F.col("block").alias("x_block")).join(last, "key")
    numbers = numbers.withColumn("y_block", F.explode(F.sequence("x_block", "_last"))).drop("_last")
    side = lambda s: hot.select(F.col("key"), *(F.col(c).alias(f"{s}_{c}") for c in ("block", "fps", "reps")))
    return numbers.join(side("x"), ["key", "x_block"]).join(side("y"), ["key", "y_block"])


def _links(nodes: DataFrame, keys: list[Column], sketch: Sketch) -> list[DataFrame]:
    """Tables with the links (a, b) that the lists of these keys give among fingerprints (fp, rep)."""
    lists = nodes.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")
    found = stage_table(lists.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(released(_lists(sketch)), LINKS_SQL), "links")
    hot = found.where("key is not null").select("key", "block", "fps", "reps")
    if hot.isEmpty():
        return [found]
    return [found, stage_table(_block_pairs(hot).mapInArrow(released(_blocks(sketch)), LINKS_SQL), "links")]


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = EXACT) -> DataFrame:
    """Fingerprints whole texts and joins those that the sketch links into components.

    Returns one row per input row: doc_id, fingerprint (hex digits), component_id (smallest doc_id reachable). A
    text that is null or has no words has fingerprint zero and links like any other; one with fewer words than a shingle
    is one shingle. Rows without an id take the component of their fingerprint; rows that share an id are one node. No
    rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    rows = stage_table(rows.mapInArrow(released(_fingerprints(sketch)), "doc_id long, fp array<long>"), "fingerprints")
    reps = stage_table(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("share")), "reps")
    byte = lambda p: F.shiftrightunsigned(F.get("fp", p // 8), 56 - 8 * (p % 8)).bitwiseAND(255)
    key = lambda c, ps: F.lit(c << 8 * COMBO) + byte(ps[0]) * 65536 + byte(ps[1]) * 256 + byte(ps[2])
    named, roots = reps.withColumn("component_id", F.col("rep")), None
    ends = [n for n in ROUNDS if n < len(sketch.combos)] + [len(sketch.combos)]
    for start, end in zip([0, *ends], ends):
        nodes = named.where("rep is not null").select("fp", F.col("component_id").alias("rep"))
        tables = _links(nodes, [key(c, sketch.combos[c]) for c in range(start, end)], sketch)
        edges = [t.select("a", "b") for t in tables] + ([roots.toDF("a", "b")] if roots else [])
        old, roots = roots, stage_table(components(functools.reduce(DataFrame.unionByName, edges)), "roots")
        drop_table(*tables, old)
        named = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "rep", "share", F.coalesce("root", "rep").alias("component_id"))
    classes = stage_table(named.select("fp", "share", "component_id"), "classes")
    hexed = F.concat(*(F.lpad(F.lower(F.hex(F.get("fp", k))), 16, "0") for k in range(sketch.words)))
    return join_counted(rows, classes, ["fp"], rows.count()).select("doc_id", hexed.alias("fingerprint"), "component_id")

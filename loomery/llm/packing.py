"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are encoded once; what travels after that are pieces (a length and what is reported of it) and gaps (a sequence and what is
still free in it). In a round all of them are range-sorted by size, pieces before gaps of the same size. Every task sweeps its range
upwards: pieces wait on a stack, and each gap takes the largest that waits, again while the next one fits. What finds no partner in its
range is told by a line per task; from these lines the driver pairs the leftovers of lower ranges with the gaps of higher ones, nearest
first, as intervals of ranks: the k-th piece goes to the gap that its rank says, so no two want the same place. Gaps that took
something are updated and the next round begins. When a round places little, as many sequences are opened as the rest must
fill at least. When what is left is one task's range, that task places it piece by piece, the largest first, each in the smallest gap that it
fits. Every round is a table in the shared folder.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

END_ID = 0
CACHE_BYTES = 140 << 20  # what a worker remembers, about
LONG = 100  # characters of a piece of text that is remembered, at most
ROWS = 1 << 14  # pieces and gaps that a task sweeps, about
LITTLE = 0.02  # of the pieces without place: a round that places no more has new sequences opened

#: What the pre-tokenizer splits a normalised text into; a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

#: A character that lower case or composition may treat by its neighbours, or by the version of Unicode.
_BEYOND = re.compile("[^\x00-\u012f]").search
#: A full stop or comma that follows one of its kind; any other begins a word of its own.
_RUN = re.compile(r"[^\w\s][.,]|_[.,]").search
_ALONE = re.compile(r"(?<=[^\W_])[.,]")


def _simple(text: str) -> bool:
    return text.isascii() or not _BEYOND(text)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
ROW = "kind int, size int, id long, doc_id long, piece int, start long, ids_crc32 long"
SWEPT = f"{ROW}, part int, rank long, offset int, sequence_id long"
LINE = "line struct<placed: long, left: long, largest: int, free: long, smallest: int, open: long>"  # a task's sums
PLACED, LEFT, FREE, OPEN, SUMS = 0, 1, 2, 3, 4  # a piece in its place, a piece and a gap without partner, a gap that took something, a line


class WordEncoder:
    """Ids as little-endian 32-bit numbers, as ``Tokenizer.encode(text, add_special_tokens=False).ids`` of a word-end vocabulary.

    White space is never part of a word there, and no normalisation reaches across a space or line feed, so a text is the sequence of what
    stands between them, and full stops and commas after a letter or number begin a word. These parts are remembered, in lower
    case where a text has only characters whose lower case stands alone. New parts of this kind are split into words, of which new ones are
    encoded together and told apart by their word ends; other parts are encoded by themselves, and texts with a special
    token as a whole. The memory is emptied when it takes ``CACHE_BYTES``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.parts: dict[str, bytes] = {"": b""}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[str]) -> None:
        ids = self._ids([" ".join(words)])[0]
        at = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(at) != len(words):
            raise ValueError("the tokenizer does not split words as its vocabulary says")
        raw, at = ids.tobytes(), [0, *at.tolist()]
        self.parts.update(zip(words, (raw[a:b] for a, b in zip(at, at[1:]))))

    def _learn(self, parts: set[str]) -> set[str]:
        """Adds parts and the words in them; returns what was added."""
        split = {p: self.split(p.lower()) for p in parts if _simple(p) and not (p.isalpha() and p.islower())}
        others = [p for p in parts if p not in split and not _simple(p)]
        words = parts.difference(split, others)
        words |= {w for ws in split.values() for w in ws if w not in self.parts}
        if words:
            self._learn_words([*words])
        known = self.parts.__getitem__
        self.parts.update([(p, b"".join(map(known, ws))) for p, ws in split.items()])
        self.parts.update((p, x.tobytes()) for p, x in zip(others, self._ids(others)))
        return words | parts

    def _forget_long(self, learned: set[str]) -> None:
        for x in learned:
            if len(x) > LONG:
                del self.parts[x]
            else:
                self.held += 200 + 2 * len(x) + len(self.parts[x])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.parts, self.held = {"": b""}, 0
        out: list[bytes] = [b""] * len(texts)
        split, new = [], set()
        for i, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[i] = self._ids([t])[0].tobytes()
                continue
            t = (t.lower() if _simple(t) else t).replace("\n", " ")
            t = _ALONE.sub(r" \g<0>", t) if _RUN(t) else t.replace(".", " .").replace(",", " ,")
            parts = t.split(" ")
            found = [*map(self.parts.get, parts)]
            missing = [p for p, v in zip(parts, found) if v is None]
            new.update(missing)
            split.append((i, parts, found, bool(missing)))
        learned = self._learn(new)
        known = self.parts.__getitem__
        for i, parts, found, some in split:
            out[i] = b"".join(map(known, parts) if some else found)
        self._forget_long(learned)
        return out


@functools.lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One per process."""
    return WordEncoder(path)


def _some(batches, most: int = 1 << 20):
    """Documents in lists of about ``most`` characters."""
    docs, texts, n = [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            docs.append(doc), texts.append(text or "")
            n += len(texts[-1])
            if n > most:
                yield docs, texts
                docs, texts, n = [], [], 0
    if docs:
        yield docs, texts


def _cutter(path: str, size: int, end: bytes):
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        encode = word_encoder(path).encode_all
        for docs, texts in _some(batches):
            rows = []
            for doc, raw in zip(docs, encode(texts)):
                raw += end
                for k in range(-(-len(raw) // (4 * size))):
                    part = raw[4 * size * k : 4 * size * (k + 1)]
                    rows.append((doc, k, k * size, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


LINE_ARROW = pa.struct([(f.split(": ")[0], pa.int32() if f.endswith("int") else pa.int64()) for f in LINE[len("line struct<") : -1].split(", ")])


def sweep(kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that rise by size, pieces (kind 0) before gaps (1) of a size: for each piece the row of its gap (-1: none) and how
    much that gap took before it. A gap takes the largest piece that waits, again while the next one fits."""
    to, before = np.full(len(kinds), -1), np.zeros(len(kinds), "i8")
    kind, size, waiting = kinds.tolist(), sizes.tolist(), []
    for row, k in enumerate(kind):
        if k == 0:
            waiting.append(row)
            continue
        free = size[row]
        while waiting and size[waiting[-1]] <= free:
            piece = waiting.pop()
            to[piece], before[piece] = row, size[row] - free
            free -= size[piece]
    return to, before


def _sweeper(size: int):
    """A sorted range: places, leftovers with their ranks, updated gaps, and a line of sums. A gap's id is its sequence's."""
    names = [c.split()[0] for c in SWEPT.split(", ")]

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        kind, length, ids = (rows.column(c).to_numpy() for c in ("kind", "size", "id"))
        to, before = sweep(kind, length)
        placed = to >= 0
        took = np.bincount(to[placed], length[placed], len(kind)).astype("i8")
        status = np.where(kind == 0, np.where(placed, PLACED, LEFT), np.where(took > 0, OPEN, FREE))
        rank = np.zeros(len(kind), "i8")
        for s in (LEFT, FREE):
            rank[status == s] = np.arange((status == s).sum())
        at = np.where(placed, to, 0)
        offset = np.where(placed, size - length[at] + before, 0)
        sequence = np.where(placed, ids[at], ids)
        new = {"kind": status, "size": np.where(kind == 1, length - took, length), "part": np.full(len(kind), TaskContext.get().partitionId()), "rank": rank, "offset": offset, "sequence_id": sequence}
        narrow = {"kind", "size", "part", "offset"}
        columns = [pa.array(new[c].astype("i4" if c in narrow else "i8")) if c in new else rows.column(c) for c in names]
        keep = (status != OPEN) | (length - took > 0)
        left, free = length[status == LEFT], length[status == FREE]
        sums = {"placed": placed.sum(), "left": len(left), "largest": left.max(initial=0), "free": len(free), "smallest": free.min(initial=size), "open": (keep & (status == OPEN)).sum()}
        out = pa.table(columns, names).filter(pa.array(keep)).append_column("line", pa.nulls(keep.sum(), LINE_ARROW))
        yield from out.to_batches()
        line = {"kind": SUMS, "part": TaskContext.get().partitionId(), "line": {k: int(v) for k, v in sums.items()}}
        yield pa.RecordBatch.from_pylist([line], out.schema)

    return run


def pair_ranges(lines: list[dict]) -> list[tuple[int, int, int, int, int, int]]:
    """Leftovers of lower ranges to gaps of higher ones, nearest first.

    ``lines`` hold part, left, largest (the leftover pieces and the largest of them), free, smallest (the gaps without a piece and the smallest of
    them). A gap takes as many pieces as surely fit. Returns (kind, part, low rank, high rank, pair, each): gaps by rising, pieces
    by falling rank, ``each`` of them to a pair, from ``pair`` on.
    """
    waiting: list[list[int]] = []  # part, pieces left, largest
    out, pair = [], 0
    for x in sorted(lines, key=lambda x: x["part"]):
        at, free = 0, x["free"]
        while waiting and at < free:
            part, left, largest = waiting[-1]
            each = max(1, x["smallest"] // largest)
            gaps = min(free - at, -(-left // each))
            pieces = min(left, gaps * each)
            out += [(FREE, x["part"], at, at + gaps, pair, 1), (LEFT, part, left - pieces, left, pair, each)]
            pair, at = pair + gaps, at + gaps
            waiting[-1][1] -= pieces
            if not waiting[-1][1]:
                waiting.pop()
        if x["left"]:
            waiting.append([x["part"], x["left"], x["largest"]])
    return out


def _filler(size: int):
    """Rows by pair, the gap first: its pieces one behind the other, then the gap as it is now."""
    names = [c.split()[0] for c in SWEPT.split(", ")]

    def run(batches):
        gap = None
        closed = lambda g: [dict(g, kind=OPEN)] if g and g["size"] else []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["kind"] == FREE:
                    out += closed(gap)
                    gap = r
                else:
                    out.append(dict(r, kind=PLACED, offset=size - gap["size"], sequence_id=gap["id"]))
                    gap["size"] -= r["size"]
            yield pa.RecordBatch.from_pylist(out, pa.schema([(n, b.schema.field(n).type) for n in names]))
        if gap:
            yield pa.RecordBatch.from_pylist(closed(gap), pa.schema([(n, b.schema.field(n).type) for n in names]))

    return run


def place_rest(pieces: list[int], gaps: list[int], size: int) -> list[tuple[int, int]]:
    """Best fit of pieces in falling order: for each the number of its gap, and what is free there before it. Gaps from ``len(gaps)`` on are new."""
    free = sorted((g, k) for k, g in enumerate(gaps))
    out, n = [], len(gaps)
    for piece in pieces:
        at = bisect.bisect_left(free, (piece, -1))
        if at < len(free):
            have, k = free.pop(at)
        else:
            have, k, n = size, n, n + 1
        out.append((k, have))
        if have > piece:
            bisect.insort(free, (have - piece, k))
    return out


def _finisher(size: int, opened: int):
    """All that is left, in one partition, to its places."""
    names = [c.split()[0] for c in SWEPT.split(", ")]

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by([("kind", "ascending"), ("size", "descending"), ("id", "ascending")])
        pieces, gaps = (rows.filter(pa.compute.equal(rows.column("kind"), k)) for k in (0, 1))
        ids = gaps.column("id").to_pylist()
        places = place_rest(pieces.column("size").to_pylist(), gaps.column("size").to_pylist(), size)
        new = {
            "kind": [PLACED] * len(places), "part": [0] * len(places), "rank": [0] * len(places), "offset": [size - have for _, have in places],
            "sequence_id": [ids[k] if k < len(ids) else -1 - opened - (k - len(ids)) for k, _ in places],
        }
        types = {"kind": pa.int32(), "part": pa.int32(), "rank": pa.int64(), "offset": pa.int32(), "sequence_id": pa.int64()}
        yield from pa.table([pa.array(new[c], types[c]) if c in new else pieces.column(c) for c in names], names).to_batches()

    return run


def best_fit(pieces: DataFrame, size: int, rows_per_task: int = ROWS) -> DataFrame:
    """Sequences for pieces (``id`` long, unique, not null; ``size`` int from 1 to ``size``; doc_id, piece, start, ids_crc32).

    Returns the pieces with sequence_id and offset. A piece of more than half a sequence opens its own.
    """
    spark = pieces.sparkSession
    row = [c.split()[0] for c in ROW.split(", ")]
    rows = pieces.select(F.lit(0).alias("kind"), *row[1:])
    large = F.col("size") > size // 2
    done = [rows.where(large).withColumns({"sequence_id": F.col("id"), "offset": F.lit(0)})]
    gap = lambda df: df.select(F.lit(1).alias("kind"), "size", "id", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("piece", "int"), ("start", "long"), ("ids_crc32", "long"))))
    items = rows.where(~large)
    gaps = gap(rows.where(large & (F.col("size") < size)).select((size - F.col("size")).alias("size"), "id"))
    n = rows.agg(F.count("*"), F.sum("size"), F.count(F.when(large, 1))).first()
    left, n_gaps, opened = n[0] - n[2], n[2], 0
    least = -(-(n[1] or 0) // size) - n[2]  # sequences that are missing for the sum to fit

    def opening(k: int) -> DataFrame:
        return gap(spark.range(opened, opened + k).select(F.lit(size).cast("int").alias("size"), (-1 - F.col("id")).alias("id")))

    while left:
        if least > 0:
            gaps = gaps.unionByName(opening(least))
            opened, n_gaps = opened + least, n_gaps + least
        tasks = max(1, -(-(left + n_gaps) // rows_per_task))
        if tasks == 1:
            last = items.unionByName(gaps).coalesce(1).mapInArrow(_finisher(size, opened), SWEPT)
            done.append(stage_table(last, "rest"))
            break
        before = left
        mixed = items.unionByName(gaps).repartitionByRange(tasks, "size", "kind", "id").sortWithinPartitions("size", "kind", "id")
        swept = stage_table(mixed.mapInArrow(_sweeper(size), f"{SWEPT}, {LINE}"), "swept")
        lines = [r.line.asDict() | {"part": r.part} for r in swept.where(F.col("kind") == SUMS).select("part", "line").collect()]  # a line per task
        swept = swept.drop("line")
        placed, left, n_gaps = (sum(x[k] for x in lines) for k in ("placed", "left", "open"))
        done.append(swept.where(F.col("kind") == PLACED))
        rest, gaps = swept.where(F.col("kind") == LEFT), gap(swept.where(F.col("kind") == OPEN))
        ranges = pair_ranges(lines)
        if ranges:
            pairs = spark.createDataFrame(ranges, "_kind int, _part int, _low long, _high long, _pair long, _each long")
            told = F.broadcast(pairs)  # two rows a task at most, and two more for each time a stack runs out
            here = (F.col("kind") == F.col("_kind")) & (F.col("part") == F.col("_part")) & (F.col("rank") >= F.col("_low")) & (F.col("rank") < F.col("_high"))
            nth = F.when(F.col("kind") == LEFT, F.col("_high") - 1 - F.col("rank")).otherwise(F.col("rank") - F.col("_low"))
            met = swept.where(F.col("kind").isin(LEFT, FREE)).join(told, here).withColumn("_pair_id", F.col("_pair") + F.floor(nth / F.col("_each")))
            met = met.repartition(tasks, "_pair_id").sortWithinPartitions("_pair_id", F.desc("kind"), F.desc("rank")).select(*swept.columns)
            filled = stage_table(met.mapInArrow(_filler(size), SWEPT), "filled")
            met_pieces = sum(high - low for kind, _, low, high, *_ in ranges if kind == LEFT)
            placed, left, n_gaps = placed + met_pieces, left - met_pieces, n_gaps + sum(high - low for kind, _, low, high, *_ in ranges if kind == FREE)
            done.append(filled.where(F.col("kind") == PLACED))
            rest = rest.join(told.where(F.col("_kind") == LEFT), here, "left_anti")
            gaps = gaps.unionByName(gap(filled.where(F.col("kind") == OPEN)))
        items = rest.select(F.lit(0).alias("kind"), *row[1:])
        least = 0 if placed > LITTLE * before or not left else -(-items.agg(F.sum("size")).first()[0] // size)
    return functools.reduce(DataFrame.unionByName, [d.select(*row[1:], "sequence_id", "offset") for d in done])


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and ``end_id`` are one piece, or pieces of ``size`` ids and a rest if there are more. Pieces of a sequence
    stand behind each other from offset 0 on, and take ``size`` at most.

    A null text is empty: its piece is the end id. Rows that repeat or have no id are documents of their own. An empty table gives no
    rows; other columns are not looked at. Texts of any length are encoded whole. Many pieces of one length are dealt to several tasks, since
    ranges go by size and a unique number. No set of rows meets in one task but those of a range (``ROWS``, about) and of a sequence.
    """
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = rows.mapInArrow(_cutter(tokenizer_path, size, end), PIECES).withColumn("id", F.monotonically_increasing_id())
    pieces = stage_table(cut.withColumnRenamed("length", "size"), "pieces")
    out = best_fit(pieces, size)
    return out.select("doc_id", "piece", "start", F.col("size").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))

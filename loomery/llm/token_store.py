"""Token ids in binary packs that are compressed document by document with one shared zstandard dictionary.

A store is three Parquet tables in one folder, so that any Hadoop store holds it and a lost task leaves nothing behind:

* ``dictionary``: one row with the zstandard dictionary (trained on serialized id arrays), its SHA-256, the tokenizer's
  name, the end id and the bytes per id.
* ``packs``: rows of about ``PACK`` bytes. ``payload`` is the concatenation of one frame per document in ascending
  doc_id order; ``doc_ids``, ``offsets`` (one more than documents), and ``n_tokens`` index it, ``first_id`` and ``last_id``
  tell which packs may hold an id, ``before`` is the number of ids before the pack in its task, ``dict_sha256`` names the
  dictionary. One document is one slice of one payload.
* ``bases``: a row per writing task with the number of ids before it.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, work_path

END_ID = 2
PACK = 4 << 20
DICT_BYTES = 64 << 10
DICT_DOCS = 1000  # documents that the dictionary is trained on; it only changes sizes
DICT_TEXT = 32 << 10  # bytes of such a document, at most
CACHE_BYTES = 55 << 20  # what a worker remembers that is new, about, and as much again that is old
LONG = 100  # bytes of a word that is remembered, at most
AT_ONCE = 4 << 20  # characters of texts that are encoded together, about
LEVEL = 3


_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How a byte-level vocabulary writes bytes: those that print as themselves, the others from U+0100 on.
BYTE_CHARS = {b: 256 + k for k, b in enumerate(sorted({*range(256)}.difference(_PRINTED)))}
_WRITTEN = np.array([BYTE_CHARS.get(b, b) for b in range(256)], "<u4")
#: A byte that UTF-8 never has; it stands between words.
GAP = 0xFF

MARK = "\x01"  # a control character, encoded like any other
#: Where a long text may be cut: no word of the pre-tokenizer goes on across white space that stands alone.
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)").search

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
#: White space as the byte-level pre-tokenizer has it.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def kinds() -> np.ndarray:
    """What every code point is; one table per process. UNKNOWN are those that Python's Unicode does not have and the tokenizer's may."""
    by = {"Cn": UNKNOWN} | {x: LETTER for x in ("Lu", "Ll", "Lt", "Lm", "Lo")} | {x: NUMBER for x in ("Nd", "Nl", "No")}
    out = np.array([by.get(unicodedata.category(chr(c)), OTHER) for c in range(0x110000)], "u1")
    out[_WHITE] = SPACE
    return out


def word_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level pre-tokenizer start in code points of a kind each; ``first`` tells where texts that are not empty start.

    As its pattern says: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(points)
    start = np.ones(n, "?")
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[first] = True
    inner = np.ones(n, "?")
    inner[first] = False
    white = kind == SPACE
    # the last of some white space belongs to what follows it if it is a space, else it is a word
    after = np.flatnonzero(start[1:] & inner[1:] & white[:-1]) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != 0x20
    mark = np.flatnonzero((points == 0x27) & start)
    if len(mark):
        at = lambda k: np.where((mark + k < n) & inner[np.minimum(mark + k, n - 1)], points[np.minimum(mark + k, n - 1)], 0)
        one, two = at(1), at(2)
        two = np.where(one > 0, two, 0)
        short = np.isin(one, [*map(ord, "stmd")])
        long = (two == ord("e")) & np.isin(one, [ord("r"), ord("v")]) | (two == ord("l")) & (one == ord("l"))
        start[mark[short | long] + 1] = False
        ends = np.concatenate([mark[short] + 2, mark[long] + 3])
        start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids as little-endian bytes, the same as ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Texts are parted into the words of the byte-level pre-tokenizer, many texts at a time as arrays of code points. Arrow
    numbers the different words, these are looked up, and the ids of a text are gathered by the numbers. New words are encoded by
    the model alone. A text that holds a special token, or a character that is newer than Python's Unicode, is encoded as a whole.
    What a process has remembered serves its later tasks too. When that takes ``CACHE_BYTES`` it becomes old: words that come
    again are taken over from there, and the rest goes the next time, so that what is frequent is encoded once. Long words are
    not remembered.
    """

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.width = Tokenizer.from_file(path), f"<u{width}", width
        if self.tokenizer.normalizer is not None or type(self.tokenizer.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError("the tokenizer does not split words as its vocabulary says")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.leads = sorted({x[:1] for x in self.special})
        self.raw_id = [i.to_bytes(width, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.words: dict[bytes, bytes] = {}  # with the space before them
        self.old_words: dict[bytes, bytes] = {}
        self.held = 0  # bytes that words take, about

    @property
    def spaced(self) -> dict[bytes, bytes]:
        """Another name of what is remembered."""
        return self.words

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _encoded(self, words: Iterable[str]) -> Iterator[bytes]:
        """The ids of words, a word at a time by the tokenizer's model, which is all that is left to do for what its pre-tokenizer parts."""
        joined = bytes([GAP]).join([w.encode() for w in words])
        if joined:
            merge, raw = self.tokenizer.model.tokenize, self.raw_id.__getitem__
            for w in _WRITTEN[np.frombuffer(joined, "u1")].tobytes().decode("utf-32-le").split(chr(_WRITTEN[GAP])):
                yield b"".join([raw(t.id) for t in merge(w)])

    def _special(self, text: str) -> bool:
        return any(c in text for c in self.leads) and any(x in text for x in self.special)

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words; new ones are encoded and remembered, old ones taken over."""
        if self.held > CACHE_BYTES:
            self.old_words, self.words, self.held = self.words, {}, 0
        found = [*map(self.words.get, words)]
        missing = [k for k, v in enumerate(found) if v is None]
        if missing:
            old = self.old_words.get
            for k in missing:
                found[k] = old(words[k])
            fresh = [k for k in missing if found[k] is None]
            for k, v in zip(fresh, self._encoded([words[k].decode() for k in fresh])):
                found[k] = v
            kept = [k for k in missing if len(words[k]) <= LONG]
            self.words.update((words[k], found[k]) for k in kept)
            self.held += 200 * len(kept) + sum(len(words[k]) + len(found[k]) for k in kept)
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        long = {k for k, t in enumerate(texts) if len(t) > 2 * AT_ONCE and not self._special(t)}
        rest = iter(self._encode_some([t for k, t in enumerate(texts) if k not in long]))
        return [self._encode_long(t) if k in long else next(rest) for k, t in enumerate(texts)]

    def _encode_long(self, text: str) -> bytes:
        out, a = [], 0
        while a < len(text):
            cut = _CUT(text, a + AT_ONCE)
            b = cut.start() if cut else len(text)
            out += self._encode_some([text[a:b]])
            a = b
        return b"".join(out)

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        out = [self.whole(t) if self._special(t) else b"" for t in texts]
        plain = [k for k, t in enumerate(texts) if t and not out[k]]  # a special token is an id at least
        if not plain:
            return out
        joined = "".join([texts[k] for k in plain])
        raw, points = joined.encode(), np.frombuffer(joined.encode("utf-32-le"), "<u4")
        first = np.cumsum([0] + [len(texts[k]) for k in plain])
        kind = kinds()[points]
        if kind.max() == UNKNOWN:
            odd = {plain[k] for k in (np.searchsorted(first, np.flatnonzero(kind == UNKNOWN), "right") - 1).tolist()}
            rest = iter(self._encode_some([texts[k] for k in plain if k not in odd]))
            for k in plain:
                out[k] = self.whole(texts[k]) if k in odd else next(rest)
            return out
        at = word_starts(points, kind, first[:-1])
        text_at = np.searchsorted(at, first)
        if len(raw) > len(points):  # from code points to bytes
            at = np.flatnonzero((np.frombuffer(raw, "u1") & 0xC0) != 0x80)[at]
        bounds = pa.py_buffer(np.append(at, len(raw)).astype("i8"))
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, bounds, pa.py_buffer(raw)]).dictionary_encode()
        of = words.indices.to_numpy()
        known = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, sizes = np.frombuffer(b"".join(known), self.kind), np.fromiter(map(len, known), "i8", len(known)) // self.width
        n = sizes[of]
        ends = np.cumsum(n)
        take = np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - n), n)
        take += np.arange(len(take))
        made, ends = ids[take].tobytes(), np.concatenate([[0], ends])[text_at] * self.width
        for k, a, b in zip(plain, ends.tolist(), ends[1:].tolist()):
            out[k] = made[a:b]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@functools.lru_cache(1)
def encoder(path: str, width: int) -> Encoder:
    """One per process."""
    return Encoder(path, width)


def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), END_ID + 1) <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str, width: int, n_docs: int = DICT_DOCS) -> bytes:
    """A zstandard dictionary from the ids of ``n_docs`` documents of at most DICT_TEXT bytes, chosen by a hash of their ids."""
    few = docs.where("doc_id is not null").where(F.octet_length("text") <= DICT_TEXT).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    texts = docs.join(F.broadcast(few.distinct()), "doc_id").where(F.octet_length("text") <= DICT_TEXT).select("text").limit(n_docs).collect()
    samples = Encoder(path, width).encode_all([t[0] or "" for t in texts])
    try:
        return zstandard.train_dictionary(DICT_BYTES, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:  # too few to train on
        return b""


def _compressor(raw: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}


PACKS = "part int, seq int, first_id long, last_id long, before long, n_ids long, doc_ids array<long>, offsets array<long>, n_tokens array<long>, dict_sha256 string, payload binary"
PACKS_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("dict_sha256", pa.string()), ("payload", pa.binary())])


def _packer(path, width, shared, sha):
    def run(batches):
        enc = encoder(path, width)
        zip_ = zstandard.ZstdCompressor(level=LEVEL, **_compressor(shared.value))
        end = np.array([END_ID], enc.kind).tobytes()
        part, seq, before, size = TaskContext.get().partitionId(), 0, 0, 0
        ids, counts, frames = [], [], []

        def encoded(b):
            docs, texts, n = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(doc), texts.append(text or "")
                n += len(texts[-1])
                if n > AT_ONCE:
                    yield from zip(docs, enc.encode_all(texts))
                    docs, texts, n = [], [], 0
            yield from zip(docs, enc.encode_all(texts))

        def pack():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("i8")
            known = [i for i in ids if i is not None] or [None]
            row = [part, seq, known[0], known[-1], before, sum(counts), list(ids), offsets.tolist(), list(counts), sha, b"".join(frames)]
            return pa.RecordBatch.from_pylist([dict(zip(PACKS_ARROW.names, row))], PACKS_ARROW)

        for b in batches:
            for doc, raw in encoded(b):
                raw += end
                ids.append(doc), counts.append(len(raw) // width), frames.append(zip_.compress(raw))
                size += len(frames[-1])
                if size >= PACK:
                    yield pack()
                    seq, before, size = seq + 1, before + sum(counts), 0
                    ids, counts, frames = [], [], []
        if ids:
            yield pack()

    return run


def write_store(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> None:
    """Writes documents to a store at ``path`` (any path that Spark writes), in ascending doc_id order.

    A null text is empty, so its ids are the end id alone. Rows without an id come first; rows that repeat an id, or have
    none, go by a hash of their text, so that many of them are no one task's. An empty table gives a store without packs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    width = id_width(tokenizer_path)
    raw = train_dictionary(rows, tokenizer_path, width)
    sha = hashlib.sha256(raw).hexdigest()
    about = [(bytearray(raw), sha, os.path.basename(tokenizer_path), END_ID, width)]
    spark.createDataFrame(about, "dictionary binary, sha256 string, tokenizer string, end_id int, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    ordered.mapInArrow(released(_packer(tokenizer_path, width, spark.sparkContext.broadcast(raw), sha)), PACKS).write.parquet(f"{path}/packs")
    packs = spark.read.schema(PACKS).parquet(f"{path}/packs")
    sums = {r.part: r.n for r in packs.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a number per task
    start, n = {}, 0
    for part in sorted(sums):
        start[part], n = n, n + sums[part]
    spark.createDataFrame(sorted(start.items()) or [(0, 0)], "part int, base long").coalesce(1).write.parquet(f"{path}/bases")


def _reader(shared, width, with_ids):
    def run(batches):
        unzip = zstandard.ZstdDecompressor(**_compressor(shared.value))
        for b in batches:
            for r in b.to_pylist():
                frames = [r["payload"][a:b] for a, b in zip(r["offsets"], r["offsets"][1:])]
                ids = [np.frombuffer(unzip.decompress(f), f"<u{width}").astype("<u4") for f in frames]
                n = np.array([len(x) for x in ids], "i8")
                starts = r["base"] + r["before"] + np.cumsum(n) - n
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.tobytes() for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return run


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a store: doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit)."""
    about = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(about.dictionary)
    if hashlib.sha256(raw).hexdigest() != about.sha256:
        raise ValueError("the dictionary does not have its hash")
    packs = spark.read.schema(PACKS).parquet(f"{path}/packs")
    if not packs.where(F.col("dict_sha256") != about.sha256).select("part").isEmpty():
        raise ValueError("packs were written with another dictionary")
    rows = packs.join(F.broadcast(spark.read.parquet(f"{path}/bases")), "part")  # a row per task that wrote
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(released(_reader(spark.sparkContext.broadcast(raw), about.width, with_ids)), columns)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of every row with this id, without decoding any other document."""
    about = spark.read.parquet(f"{path}/dictionary").first()
    unzip = zstandard.ZstdDecompressor(**_compressor(bytes(about.dictionary)))
    packs = spark.read.schema(PACKS).parquet(f"{path}/packs").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.filter(F.transform("doc_ids", lambda x, k: F.when(x == doc_id, k)), lambda k: k.isNotNull())
    frame = lambda k: F.substring("payload", F.element_at("offsets", k + 1).cast("int") + 1, (F.element_at("offsets", k + 2) - F.element_at("offsets", k + 1)).cast("int"))
    rows = packs.select(F.explode(at).alias("k"), "offsets", "payload").select(frame(F.col("k")).alias("f")).collect()
    return [np.frombuffer(unzip.decompress(bytes(r.f)), f"<u{about.width}").tolist() for r in rows]


def new_store_path(spark: SparkSession) -> str:
    return work_path(spark, "tokens")

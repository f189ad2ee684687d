"""Binary containers: block archives, motion-JPEG video, raw and encoded images.

Archives register as Spark data sources (``spark.read.format("blockarchive")``); the other readers are kernels that take
bytes, for use over ``binaryFile`` rows.
"""

from __future__ import annotations

import glob
import io
import itertools
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .jpeg import jpeg_size, read_jpeg

# --- block archives: fixed values of the format -------------------------------------------------------------------
MAGIC, LEAD, HEAD_NAME, TAIL_NAME, END_NAME = 0o070707, b"MACR", "cpiohdr", "cpiotlr", "TRAILER!!!"
ENTRY = struct.Struct("<13H")  # magic dev ino mode uid gid nlink rdev mtime(2) namesize filesize(2), sizes high first
FILE_HEAD = struct.Struct("<4sII8sII36s")
READ_BYTES, READ_ROWS = 4 << 20, 1000  # what a task that reads an archive holds at a time


def _entry(name: str, data: bytes) -> bytes:
    raw = name.encode() + b"\0"
    head = ENTRY.pack(MAGIC, 0, 0, 0, 0, 0, 0, 0, 0, 0, len(raw), len(data) >> 16, len(data) & 0xFFFF)
    even = lambda b: b + b"\0" * (len(b) % 2)
    return head + even(raw) + even(data)


def write_records(stream: io.BufferedIOBase, records: Iterable[list[bytes]]) -> int:
    """Writes an archive of records with equal numbers of elements as they come, and their number into its head at last."""
    start, n, per = stream.tell(), 0, 0
    head = lambda: _entry(HEAD_NAME, FILE_HEAD.pack(LEAD, 1, 1, b" " * 8, n, per, b""))
    stream.write(head())
    for elements in records:
        per = len(elements) if n == 0 else per
        if len(elements) != per:
            raise ValueError("records differ in their number of elements")
        for e, x in enumerate(elements):
            stream.write(_entry(f"rec_{n:07d}.{e:02d}", x))
        n += 1
    stream.write(_entry(TAIL_NAME, b"\0" * 16) + _entry(END_NAME, b""))
    end = stream.tell()
    stream.seek(start)
    stream.write(head())
    stream.seek(end)
    return n


def write_archive(records: list[list[bytes]]) -> bytes:
    """An archive of records with equal numbers of elements."""
    out = io.BytesIO()
    write_records(out, records)
    return out.getvalue()


def read_entries(stream: io.BufferedIOBase) -> Iterator[tuple[str, bytes]]:
    """Names and contents of all entries up to the trailer, header included."""
    while len(raw := stream.read(ENTRY.size)) == ENTRY.size:
        f = ENTRY.unpack(raw)
        if f[0] != MAGIC:
            raise ValueError("archive entry has a wrong magic number")
        name = stream.read(f[10] + f[10] % 2)[: f[10] - 1].decode()
        size = f[11] << 16 | f[12]
        data = stream.read(size + size % 2)[:size]
        if name == END_NAME:
            return
        yield name, data


def read_records(stream: io.BufferedIOBase) -> Iterator[list[bytes]]:
    """The records of an archive one by one; a record's elements follow each other."""
    entries = read_entries(stream)
    name, head = next(entries, ("", b""))
    if name != HEAD_NAME or len(head) != FILE_HEAD.size or FILE_HEAD.unpack(head)[0] != LEAD:
        raise ValueError("the archive does not begin with a block header")
    record, elements = None, []
    for name, data in entries:
        if not name.startswith("rec_"):
            continue
        if name.rsplit(".", 1)[0] != record:
            if elements:
                yield elements
            record, elements = name.rsplit(".", 1)[0], []
        elements.append(data)
    if elements:
        yield elements


def read_archive(data: bytes) -> list[list[bytes]]:
    return list(read_records(io.BytesIO(data)))


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*.cpio"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise FileNotFoundError(f"no archive at {self.path}")
        return [_Part(p) for p in found]

    def read(self, partition):
        rows, size = [], 0
        with open(partition.path, "rb") as f:
            for r, elements in enumerate(read_records(f)):
                rows.append((r, elements))
                size += sum(map(len, elements))
                if size >= READ_BYTES or len(rows) >= READ_ROWS:
                    yield self._batch(partition.path, rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(partition.path, rows)

    @staticmethod
    def _batch(path, rows):
        columns = [pa.array([path] * len(rows)), pa.array([r for r, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["path", "record", "elements"])


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _ArchiveWriter(DataSourceWriter):
    """Tasks write hidden files; only a finished job renames them, and an overwriting one drops what was there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, rows):
        rows = iter(rows)
        first = next(rows, None)
        if first is None:
            return _Written(None)
        os.makedirs(self.path, exist_ok=True)
        name = f"block_{self.job}_{TaskContext.get().partitionId():05d}_{uuid.uuid4().hex[:8]}.cpio"
        with open(os.path.join(self.path, f".{name}"), "wb") as f:
            write_records(f, ([bytes(x) for x in row.elements] for row in itertools.chain([first], rows)))
        return _Written(name)

    def commit(self, messages):
        old = glob.glob(os.path.join(self.path, "*.cpio")) if self.overwrite else []
        for m in filter(None, messages):
            if m.name:
                os.replace(os.path.join(self.path, f".{m.name}"), os.path.join(self.path, m.name))
        for path in old:
            os.remove(path)

    def abort(self, messages):
        for path in glob.glob(os.path.join(self.path, f".block_{self.job}_*.cpio")):
            os.remove(path)


class BlockArchive(DataSource):
    """Archives on a file system that all executors mount: (path, record, elements) rows, a file per partition."""

    @classmethod
    def name(cls):
        return "blockarchive"

    def schema(self):
        return "path string, record int, elements array<binary>"

    def reader(self, schema):
        return _ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite):
        return _ArchiveWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockArchive)


# --- video ------------------------------------------------------------------------------------------------------------


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield kind, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_avi_frames(data: bytes) -> list[bytes]:
    """JPEG frames of the first motion-JPEG stream, in index order. A file without an index is an error."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie, index, stream, streams = None, None, None, 0
    for kind, at, end in _chunks(data, 12, len(data)):
        if kind == b"LIST" and data[at : at + 4] == b"hdrl":
            for k, a, e in _chunks(data, at + 4, end):
                if k == b"LIST" and data[a : a + 4] == b"strl":
                    head = next((x for x in _chunks(data, a + 4, e) if x[0] == b"strh"), None)
                    if head and stream is None and data[head[1] : head[1] + 4] == b"vids" and data[head[1] + 4 : head[1] + 8].upper() == b"MJPG":
                        stream = streams
                    streams += 1
        elif kind == b"LIST" and data[at : at + 4] == b"movi":
            movie = at
        elif kind == b"idx1":
            index = (at, end)
    if stream is None:
        raise ValueError("no motion-JPEG stream")
    if movie is None or index is None:
        raise ValueError("the AVI file has no index")
    want, rows = f"{stream:02d}dc".encode(), []
    for at in range(index[0], index[1] - 15, 16):
        if data[at : at + 4] == want:
            rows.append(struct.unpack("<II", data[at + 8 : at + 16]))
    base = movie
    if rows and data[movie + rows[0][0] : movie + rows[0][0] + 4] != want:
        base = 0  # offsets from the start of the file
    return [data[base + o + 8 : base + o + 8 + n] for o, n in rows]


def write_avi(frames: list[bytes], width: int, height: int, fps: int = 25) -> bytes:
    """A minimal motion-JPEG file with an index."""
    chunk = lambda kind, body: kind + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 16, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body, index = b"movi", b""
    for f in frames:
        index += struct.pack("<4sIII", b"00dc", 16, len(body), len(f))
        body += chunk(b"00dc", f)
    rest = b"AVI " + header + chunk(b"LIST", body) + chunk(b"idx1", index)
    return b"RIFF" + len(rest).to_bytes(4, "little") + rest


# --- images -----------------------------------------------------------------------------------------------------------


def read_raw_image(data: bytes) -> np.ndarray:
    """Raw image: ``key: value`` lines, an empty line, pixels."""
    head, _, body = data.partition(b"\n\n")
    about = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\n"))}
    yes = lambda k: about.get(k, "0").lower() in ("1", "true", "yes")
    kind = ("f" if yes("is_float") else "u") + str(int(about["bitwidth"]) // 8)
    shape = int(about["height"]), int(about["width"]), int(about["channels"])
    n = int(np.prod(shape))
    return np.frombuffer(body, (">" if yes("is_big_endian") else "<") + kind, n).reshape(shape)


def write_raw_image(img: np.ndarray) -> bytes:
    h, w, c = img.shape
    lines = {"width": w, "height": h, "channels": c, "bitwidth": img.dtype.itemsize * 8, "is_float": int(img.dtype.kind == "f"), "is_big_endian": 0}
    return "".join(f"{k}: {v}\n" for k, v in lines.items()).encode() + b"\n" + img.astype(img.dtype.newbyteorder("<")).tobytes()


_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def write_png(img: np.ndarray) -> bytes:
    """An 8-bit PNG of a grey (height, width, 1) or blue-green-red image."""
    h, w, c = img.shape
    rows = np.concatenate([np.zeros((h, 1), "u1"), (img[..., ::-1] if c == 3 else img).reshape(h, -1)], 1)
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)
    return _PNG + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def _unfilter(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    out, prior = np.zeros((h, stride), "u1"), np.zeros(stride, "u1")
    for y in range(h):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, "u1", stride, y * (stride + 1) + 1).copy()
        if kind == 1:
            line = np.add.accumulate(line.reshape(-1, step), 0, dtype="u1").ravel() if stride % step == 0 else line
        elif kind == 2:
            line += prior
        elif kind in (3, 4):
            for x in range(stride):
                a, b = (int(line[x - step]) if x >= step else 0), int(prior[x])
                if kind == 3:
                    add = (a + b) // 2
                else:
                    c = int(prior[x - step]) if x >= step else 0
                    p = a + b - c
                    add = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (int(line[x]) + add) & 255
        out[y] = prior = line
    return out


def read_png(data: bytes) -> np.ndarray:
    """An 8-bit PNG (grey, palette or colour, not interlaced) as height, width, channels; colour is blue-green-red."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, body, palette = 8, b"", None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, "u1").reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + size
    if depth != 8 or lace:
        raise ValueError("only 8-bit PNG images without interlace are read here")
    c = _CHANNELS[colour]
    img = _unfilter(zlib.decompress(body), h, w * c, c).reshape(h, w, c)
    if colour == 3:
        img = palette[img[..., 0]]
    return img[..., ::-1] if img.shape[2] == 3 else img[..., 2::-1] if colour == 6 else img[..., :1]


#: What users of such loaders match on; a fixed text.
BROKEN_IMAGE = "Decoding image failed due to invalid data in the image file."


def _decode_any(data: bytes) -> np.ndarray:
    if data[:8] == _PNG:
        return read_png(data)
    if data[:2] != b"\xff\xd8":
        return read_raw_image(data)
    return read_jpeg(data)


def decode_image(data: bytes | None, channels: int = 3) -> np.ndarray:
    """An encoded image (PNG, JPEG, raw) as 8-bit grey or blue-green-red."""
    try:
        img = _decode_any(bytes(data or b""))
    except Exception as e:
        raise ValueError(BROKEN_IMAGE) from e
    if channels == 1 and img.shape[2] == 3:
        b, g, r = np.moveaxis(img.astype("f8"), 2, 0)
        img = np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype("u1")[..., None]
    return np.repeat(img, 3, 2) if channels == 3 and img.shape[2] == 1 else img


def image_size(data: bytes | None) -> tuple[int, int]:
    """Width and height from an encoded image's header, without its pixels."""
    try:
        if data[:8] == _PNG:
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"\xff\xd8":
            return jpeg_size(bytes(data))
        head = dict(line.split(b":", 1) for line in bytes(data).partition(b"\n\n")[0].split(b"\n"))
        return int(head[b"width"]), int(head[b"height"])
    except Exception as e:
        raise ValueError(BROKEN_IMAGE) from e


def image_files(spark: SparkSession, path: str):
    """Image files decoded by Spark: path, height, width, channels, data (blue-green-red); broken ones have ``_error``."""
    rows = spark.read.format("image").load(path).select("image.*")
    bad = F.when(F.col("height") <= 0, F.lit(BROKEN_IMAGE))
    return rows.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data", bad.alias("_error"))

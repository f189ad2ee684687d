"""Manifests: tab-separated records with declared element types.

The first line of interest is the header, ``@`` and a type per column (FILE, BINARY, STRING, ASCII_INT, ASCII_FLOAT).
``#`` begins a comment, empty lines are skipped. The file is read as text by Spark; nothing of it but the header comes
to the driver.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_float, ascii_int, root_join
from ..operators.rows import number_in_place, number_left, with_row_index

#: What users of such loaders match on; fixed texts.
NO_FILE, NO_HEADER, TWO_HEADERS, OTHER_LENGTH, NO_ELEMENT = "doesn't exist", "Metadata must be defined before any data", "Metadata must be defined only once", "manifest file has a line with differing number of files", "Could not find file"
TYPES = ("FILE", "BINARY", "STRING", "ASCII_INT", "ASCII_FLOAT")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of the files of a folder in the order of their names, with their number (line_no, from 0).

    Lines are stored as they are read, with their first letter (``lead``), and numbered from counts of each file's splits, which ``file`` and ``at`` name.
    """
    try:
        lines = spark.read.text(path).select("value", F.substring("value", 1, 1).alias("lead"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"Manifest file {path} {NO_FILE}") from e
        raise
    return number_in_place(lines, ["file", "at"], "line_no").select("line_no", "value", "lead", "file", "at")


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    """Lines of a manifest that is held as text."""
    rows = list(enumerate(text.splitlines()))
    return spark.createDataFrame(rows, "line_no long, value string")


def parse(lines: DataFrame) -> tuple[list[str], DataFrame]:
    """Element types and records (row_idx, line_no, e: array of texts).

    Records of another length than the header are an error that names the line, counted from 0. Lines as :func:`read_lines` gives them
    stay in place; others are put in the order of ``line_no``.
    """
    lead = F.col("lead") if "lead" in lines.columns else F.substring("value", 1, 1)
    headers = lines.where(lead == "@").orderBy("line_no").limit(2).collect()
    if not headers:
        raise ValueError(NO_HEADER)
    if len(headers) > 1:
        raise ValueError(f"{TWO_HEADERS}, found again at line {headers[1].line_no}")
    kinds = headers[0].value[1:].split("\t")
    for k in kinds:
        if k not in TYPES:
            raise ValueError(f"invalid metadata type {k!r}")
    rows = lines.where(~lead.isin("", "@", "#"))
    if not rows.where(F.col("line_no") < headers[0].line_no).isEmpty():
        raise ValueError(NO_HEADER)
    rows = rows.withColumn("e", F.split("value", "\t", -1))
    bad = rows.where(F.size("e") != len(kinds)).orderBy("line_no").limit(1).collect()
    if bad:
        raise RuntimeError(f"at line: {bad[0].line_no}, {OTHER_LENGTH} ({len(bad[0].e)}) vs ({len(kinds)})")
    placed = number_left(rows, ["file", "at"], "line_no", "row_idx") if "file" in lines.columns else with_row_index(rows, "line_no")
    return kinds, placed.select("row_idx", "line_no", "e")


def typed(records: DataFrame, kinds: list[str], root: str = "", keep: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """One column per element, e0, e1, ..., of its declared type, and ``_error`` for a record that cannot be read.

    ``keep`` names the columns that stay beside them.

    FILE elements become their path; :func:`load_files` turns them into bytes. Base64 is decoded strictly.
    """
    out, errors = {}, []
    for i, k in enumerate(kinds):
        raw = F.get("e", i)
        if k == "FILE":
            out[f"e{i}"] = root_join(raw, root)
            continue
        value = {"BINARY": F.try_to_binary(raw, F.lit("base64")), "STRING": raw, "ASCII_INT": ascii_int(raw), "ASCII_FLOAT": ascii_float(raw)}[k]
        out[f"e{i}"] = value
        if k != "STRING":
            errors.append(F.when(value.isNull(), F.concat(F.lit(f"element {i}: invalid {k} "), raw)))
    error = F.coalesce(*errors) if errors else F.lit(None).cast("string")
    return records.select(*keep, *(c.alias(n) for n, c in out.items()), error.alias("_error"))


def _open(path: str):
    if "://" not in path:
        return open(path.removeprefix("file:"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def load_files(df: DataFrame, kinds: list[str]) -> DataFrame:
    """FILE paths to bytes; a file that cannot be read sets ``_error``.

    Files are opened where the rows are, in the order of the rows: paths on a file system that every executor mounts, or
    URIs of any store that Arrow's file systems know.
    """
    files = [f"e{i}" for i, k in enumerate(kinds) if k == "FILE"]
    if not files:
        return df
    schema = ", ".join(f"`{f.name}` {'binary' if f.name in files else f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols, errors = dict(zip(b.schema.names, b.columns)), b.column("_error").to_pylist()
            for name in files:
                data = []
                for i, path in enumerate(cols[name].to_pylist()):
                    try:
                        with _open(path) as f:
                            data.append(f.read())
                    except (OSError, TypeError, ValueError):
                        data.append(None)
                        errors[i] = errors[i] or f"{NO_ELEMENT}: '{path}'"
                cols[name] = pa.array(data, pa.binary())
            cols["_error"] = pa.array(errors, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return df.mapInArrow(run, schema)


def _table() -> np.ndarray:
    out = np.arange(256, dtype="u4")
    for _ in range(8):
        out = out >> 1 ^ np.where(out & 1, np.uint32(0x82F63B78), np.uint32(0))
    return out


_TABLE = _table()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C of bytes, going on from ``crc``."""
    table = _TABLE_LIST
    crc ^= 0xFFFFFFFF
    for x in data:
        crc = table[(crc ^ x) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


_TABLE_LIST = _TABLE.tolist()


def crc32c_many(texts: list[bytes]) -> np.ndarray:
    """CRC-32C of each text: a byte of all texts at a time, the longest first."""
    size = np.array([len(t) for t in texts], "i8")
    order = np.argsort(-size, kind="stable")
    buf, begin = np.frombuffer(b"".join(texts) + b"\0", "u1"), (np.cumsum(size) - size)[order]
    crc, left = np.full(len(texts), 0xFFFFFFFF, "u4"), len(texts)
    for k in range(int(size.max(initial=0))):
        left = int(np.searchsorted(-size[order], -k, side="left"))  # texts of more than k bytes
        crc[:left] = _TABLE[(crc[:left] ^ buf[begin[:left] + k]) & 255] ^ (crc[:left] >> 8)
    out = np.empty(len(texts), "u4")
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc32c_combine(first: int, second: int, second_bytes: int) -> int:
    """CRC of two texts in a row, from their CRCs and the second's length."""
    k = 0
    while second_bytes >> k:
        if second_bytes >> k & 1:
            first = _times(_zeros(k), first)
        k += 1
    return first ^ second


@functools.lru_cache(64)
def _zeros(k: int) -> list[int]:
    """What 2**k zero bytes do to each bit of a CRC."""
    if k:
        half = _zeros(k - 1)
        return [_times(half, m) for m in half]
    bit = [0x82F63B78, *(1 << i for i in range(31))]
    for _ in range(3):
        bit = [_times(bit, m) for m in bit]
    return bit


def manifest_crc(records: DataFrame, separator: bytes = b"") -> int:
    """CRC-32C over the elements of all records in order.

    A task checks all records of a range at a time and folds them to one (crc, length), so the driver gets one row per range.
    """

    def fold(batches):
        import pyarrow as pa

        first, crc, size = None, 0, 0
        for b in batches:
            raws = [b"".join((x or "").encode() + separator for x in e) for e in b.column("e").to_pylist()]
            if raws and first is None:
                first = b.column("row_idx")[0].as_py()
            for raw, own in zip(raws, crc32c_many(raws).tolist()):
                crc, size = crc32c_combine(crc, own, len(raw)), size + len(raw)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([crc], pa.int64()), pa.array([size], pa.int64())], ["at", "crc", "size"])

    parts = records.repartitionByRange("row_idx").sortWithinPartitions("row_idx").select("row_idx", "e").mapInArrow(fold, "at long, crc long, size long")
    crc = 0
    for r in sorted(parts.collect(), key=lambda r: r.at):
        crc = crc32c_combine(crc, r.crc, r.size)
    return crc


def version(crc: int) -> str:
    return f"{crc:08x}"

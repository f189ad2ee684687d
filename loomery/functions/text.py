"""Text and number columns of a record: labels, dictionaries, characters, blobs and small string tools."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

OTYPES = {"int8_t": ("tinyint", 1), "uint8_t": ("smallint", 1), "int16_t": ("smallint", 2), "uint16_t": ("int", 2), "int32_t": ("int", 4), "uint32_t": ("bigint", 4), "float": ("float", 4), "double": ("double", 8), "char": ("tinyint", 1)}


def otype(name: str) -> str:
    """Spark type of an output type; there are no unsigned ones, so those take the next wider."""
    if name not in OTYPES:
        raise ValueError(f"Unable to map output type {name}")
    return OTYPES[name][0]


def ascii_int(text: Column) -> Column:
    """Leading number of a text, cut towards zero, as int; null if there is none or it is out of range."""
    number = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return _cut(number.try_cast("double"))


def _cut(x: Column) -> Column:
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    return F.when((x > -2147483649) & (x < 2147483648), whole.cast("int"))


def ascii_float(text: Column) -> Column:
    number = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return number.try_cast("float")


def label_text(text: Column) -> Column:
    """Leading integer of a text; null if there is none or it does not fit 32 bits."""
    return F.regexp_extract(text, r"^\s*([-+]?\d+)", 1).try_cast("bigint").try_cast("int")


def label_binary(data: Column) -> Column:
    """Exactly four bytes, little-endian; anything else is null."""
    one = lambda i: F.conv(F.hex(F.substring(data, i, 1)), 16, 10).cast("bigint")
    value = one(1) + one(2) * 256 + one(3) * 65536 + one(4) * 16777216
    return F.when(F.octet_length(data) == 4, F.when(value >= 2147483648, value - 4294967296).otherwise(value).cast("int"))


def pad(values: Column, n: int, zero: Column) -> Column:
    """The first n values, filled up with zeros."""
    return F.slice(F.concat(values, F.array_repeat(zero, n)), 1, n)


def class_ids(names: list[str]) -> dict[str, int]:
    """Index of each class name; of equal names the first counts, and the index goes on."""
    out: dict[str, int] = {}
    for i, name in enumerate(names):
        out.setdefault(name, i)
    return out


def _literal_map(pairs: dict, cast: str = "int") -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)) if pairs else F.create_map().cast(f"map<string,{cast}>")


def label_map(text: Column, names: list[str]) -> Column:
    """Class indices of the words of a text; null if any word is unknown."""
    ids = _literal_map(class_ids(names))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    found = F.transform(words, lambda w: F.try_element_at(ids, w))
    return F.when(~F.exists(found, lambda x: x.isNull()), found)


def char_ids(alphabet: str) -> dict[str, int]:
    """Character to position, whatever the case; only case pairs of one code point each count.

    An alphabet with a repeated character is an error; of two that are equal in upper case the first counts.
    """
    if len(set(alphabet)) != len(alphabet):
        raise ValueError(f"alphabet contains duplicate characters: {alphabet}")
    upper = lambda c: u if len(u := c.upper()) == 1 else c
    base: dict[str, int] = {}
    for i, c in enumerate(alphabet):
        base.setdefault(upper(c), i)
    out = {}
    for code in [*range(0xD800), *range(0xE000, 0x110000)]:
        c = chr(code)
        if (u := upper(c)) in base:
            out[c] = base[u]
    return out


def char_map(text: Column, alphabet: str, max_length: int, unknown: int = 0) -> Column:
    """Positions of the first ``max_length`` characters, zero padded; unknown ones are dropped, or ``unknown`` if not 0."""
    if unknown and unknown < len(alphabet):
        raise ValueError("unknown_value must be 0 or not less than the alphabet's size")
    ids = _literal_map(char_ids(alphabet))
    chars = F.filter(F.split(F.substring(text, 1, max_length), ""), lambda c: c != "")
    found = F.transform(chars, lambda c: F.try_element_at(ids, c))
    found = F.transform(found, lambda x: F.coalesce(x, F.lit(unknown))) if unknown else F.filter(found, lambda x: x.isNotNull())
    return pad(found, max_length, F.lit(0))


def char_map_length(text: Column, max_length: int) -> Column:
    """Characters that count, before unknown ones are dropped."""
    return F.least(F.length(text), F.lit(max_length))


def column_name(base: str, name: str | None = None) -> str:
    return f"{name}.{base}" if name else base


def split_trim(text: Column, delimiter: str, trim: bool = False) -> Column:
    """Parts of a text, empty ones too; trimming takes spaces and tabs."""
    parts = F.split(text, f"\\Q{delimiter}\\E", -1)
    return F.transform(parts, lambda p: F.btrim(p, F.lit(" \t"))) if trim else parts


def almost_equal(a: Column, b: Column, eps: float = 1e-5) -> Column:
    return F.abs(a - b) < eps


def almost_equal_or_less(a: Column, b: Column, eps: float = 1e-5) -> Column:
    return almost_equal(a, b, eps) | (a < b)


def almost_equal_or_greater(a: Column, b: Column, eps: float = 1e-5) -> Column:
    return almost_equal(a, b, eps) | (a > b)


def unbiased_round(x: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.rint(x)


def root_join(path: Column, root: str) -> Column:
    """A file path below the manifest's root; absolute paths stay."""
    if not root:
        return path
    root = root if root.endswith("/") else root + "/"
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root), path))


def pack_int(value: Column, n_bytes: int, big_endian: bool = False) -> Column:
    """The low ``n_bytes`` bytes (at most 8) of a whole number, two's complement."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    digits = F.substring(digits, 17 - 2 * n_bytes, 2 * n_bytes)
    order = range(n_bytes) if big_endian else reversed(range(n_bytes))
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in order)))


def _real_type(n_bytes: int, big_endian: bool) -> np.dtype:
    return np.dtype(f"{'>' if big_endian else '<'}f{n_bytes}")


def pack_float(value: Column, n_bytes: int, big_endian: bool = False) -> Column:
    """The 4 or 8 bytes of a real number, rounded to single precision for 4; null stays null."""
    kind = _real_type(n_bytes, big_endian)

    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        with np.errstate(over="ignore"):
            raw = values.to_numpy(zero_copy_only=False).astype(kind).tobytes()
        return pa.array([raw[i : i + n_bytes] for i in range(0, len(raw), n_bytes)], pa.binary())

    return F.when(value.isNotNull(), pack(value.cast("double")))


def unpack_float(data: Column, n_bytes: int, big_endian: bool = False, offset: int = 0) -> Column:
    """A real number of 4 or 8 bytes from ``offset`` on; null if there are too few bytes."""
    kind = _real_type(n_bytes, big_endian)

    @F.arrow_udf("double")
    def unpack(raws: pa.Array) -> pa.Array:
        return pa.array(np.frombuffer(b"".join(x or bytes(n_bytes) for x in raws.to_pylist()), kind).astype("f8"))

    enough = F.octet_length(data) >= offset + n_bytes
    return F.when(enough, unpack(F.when(enough, F.substring(data, offset + 1, n_bytes))))


def unpack_int(data: Column, n_bytes: int, big_endian: bool = False, signed: bool = True, offset: int = 0) -> Column:
    """A whole number of ``n_bytes`` bytes (at most 7, or 8 if signed) from ``offset`` on; null if there are too few."""
    at = lambda i: F.conv(F.hex(F.substring(data, offset + i + 1, 1)), 16, 10).cast("bigint")
    order = list(range(n_bytes)) if big_endian else list(reversed(range(n_bytes)))
    top, value = at(order[0]), F.lit(0).cast("bigint")
    if signed:
        top = F.when(top > 127, top - 256).otherwise(top)
    for k, i in enumerate(order):
        value = F.shiftleft(value, 8).bitwiseOR(top.bitwiseAND(255)) if k else top
        top = at(order[k + 1]) if k + 1 < n_bytes else top
    return F.when(F.octet_length(data) >= offset + n_bytes, value)


def wide_length(data: Column) -> Column:
    """Characters of UTF-8 bytes; null where they are no valid UTF-8."""
    return F.when(F.is_valid_utf8(data), F.length(data.cast("string")))

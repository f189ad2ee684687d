import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomery.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("x")).first().x


def slow_char_map(text, alphabet, n, unknown=0):
    """Positions by a search of the alphabet for each character, whatever its case."""
    upper = [c.upper() if len(c.upper()) == 1 else c for c in alphabet]
    out = []
    for c in text[:n]:
        c = c.upper() if len(c.upper()) == 1 else c
        if c in upper:
            out.append(upper.index(c))
        elif unknown:
            out.append(unknown)
    return out + [0] * (n - len(out))


@pytest.mark.parametrize("alphabet,n,unknown", [("xyz01", 6, 0), ("qwertzuiopü _-", 12, 77), ("ÅÄÖåbc", 9, 0), ("aA?1", 5, 4), ("🜁☃k", 4, 9)])
def test_char_map(spark, alphabet, n, unknown):
    rng = random.Random(n)
    texts = ["", "ZYX!", "ü_Ü-q", "ß?", "🜁K☃k☃"] + ["".join(rng.choice(alphabet + "abXY 🜂") for _ in range(rng.randint(0, 20))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", X.char_map(F.col("v"), alphabet, n, unknown).alias("x"), X.char_map_length(F.col("v"), n).alias("n"))
    for r in df.collect():
        assert r.x == slow_char_map(texts[r.i], alphabet, n, unknown) and r.n == min(n, len(texts[r.i])), texts[r.i]


def test_char_map_is_checked():
    with pytest.raises(ValueError):
        X.char_ids("02468 2")
    with pytest.raises(ValueError):
        X.char_map(F.lit("x"), "wxyz", 5, 3)


def test_label_map(spark):
    names = ["oak", "elm", "ash", "elm", "fir", "yew"]
    ids = {"oak": 0, "elm": 1, "ash": 2, "fir": 4, "yew": 5}
    assert X.class_ids(names) == ids
    rng = random.Random(1)
    for _ in range(8):
        words = [rng.choice([*ids, *(["ivy"] if rng.random() < 0.3 else [])]) for _ in range(rng.randint(0, 6))]
        got = one(spark, lambda c: X.pad(X.label_map(c, names), 4, F.lit(0)), rng.choice([" ", "  ", "\t"]).join(words) + " ")
        assert got == (None if "ivy" in words else ([ids[w] for w in words] + [0] * 4)[:4])


@pytest.mark.parametrize("value,want", [("\t77 bottles", 77), ("-0012", -12), ("+5.99", 5), (".5", None), ("five", None), ("", None), ("2147483648", None), ("-2147483648", -(2**31))])
def test_label_text(spark, value, want):
    assert one(spark, X.label_text, value) == want


def test_label_binary(spark):
    rng = random.Random(2)
    for n in [0, -1, 2**31 - 1, -(2**31), *(rng.randrange(-(2**31), 2**31) for _ in range(4))]:
        assert one(spark, X.label_binary, bytearray(n.to_bytes(4, "little", signed=True)), "binary") == n
    assert one(spark, X.label_binary, bytearray(5), "binary") is None


@pytest.mark.parametrize("value,want", [("6.75", 6), ("-6.75kg", -6), (" 2.5e2", 250), ("e2", None), ("2147483647.5", 2147483647), ("3e10", None)])
def test_ascii_int(spark, value, want):
    assert one(spark, X.ascii_int, value) == want


def test_split_and_names(spark):
    for text, sep in (("k=v=", "="), ("", ";"), ("a;;b", ";"), ("1.2.3", "."), ("none", "|")):
        assert one(spark, lambda c, s=sep: X.split_trim(c, s), text) == text.split(sep)
    assert one(spark, lambda c: X.split_trim(c, "/", True), "\t x y / \n/z ") == ["x y", "\n", "z"]
    assert X.column_name("depth", "front") == "front.depth" and X.column_name("label", "") == "label"
    assert [one(spark, lambda c, r=r: X.root_join(c, r), p) for p, r in (("d/e.png", "/mnt"), ("d/e.png", "/mnt/"), ("/d/e.png", "/mnt"), ("d", ""))] == ["/mnt/d/e.png", "/mnt/d/e.png", "/d/e.png", "d"]
    with pytest.raises(ValueError):
        X.otype("bfloat16")


def test_rounding(spark):
    values = [k / 4 for k in range(-30, 31)] + [10**6 + 0.5, 10**6 + 1.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.unbiased_round(F.col("v")).alias("x")).collect()
    assert all(r.x == round(r.v) for r in got)


def test_reals_to_bytes_and_back(spark):
    import struct

    values = [0.0, -0.0, 1.0, -1.5, 3.141592653589793, 1e-310, 5e-324, -2.2250738585072014e-308, 1.7976931348623157e308, 1e300, 2.0**-149, 2.0**-126, 3.4028234663852886e38, 0.1, 1e-40, float("inf"), -float("inf"), float("nan"), 2.0**52 + 1, 4503599627370497.5, 1 - 2.0**-53, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for n, kind in ((8, "d"), (4, "f")):
        for big in (False, True):
            raw = X.pack_float(F.col("v"), n, big)
            got = df.select(raw.alias("raw"), X.unpack_float(raw, n, big).alias("back")).collect()
            for v, r in zip(values, got):
                if v is None:
                    assert r.raw is None and r.back is None
                    continue
                with np.errstate(over="ignore"):
                    single = np.float32(v) if n == 4 else v
                want = struct.pack((">" if big else "<") + kind, single)
                assert bytes(r.raw) == want, (v, n)
                assert math.isnan(r.back) if math.isnan(v) else struct.pack("<d", r.back) == struct.pack("<d", float(single)), (v, n)
    assert df.select(X.unpack_float(F.lit(b"abc"), 4).alias("x")).first().x is None

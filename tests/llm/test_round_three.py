"""Packing, collocations and fill-in-the-middle against brute force, plain encoders and exact round trips."""

import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomery.llm import collocations, fim, packing
from loomery.llm.queries import tokenizer_path

WORDS = tokenizer_path("word_bpe_49k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]


# --- packing


def best_fit_decreasing(sizes, size):
    gaps, n = [], 0
    for v in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, v)
        free = gaps.pop(k) if k < len(gaps) else size
        n += k == len(gaps) and free == size
        bisect.insort(gaps, free - v)
    return len(gaps)


def check_places(rows, size):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["size"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def test_encoder_is_exact():
    rng = random.Random(5)
    odd = ["", " ", "a", "don't", "DON'T stop", "it's,'s", "(',x)", "a,b.,c", "x\ny", "tab\there", "é ́a", "İstanbul ΣΣ", "café naïve", "你好 world", "1234 5a6", "<|endoftext|> x", "a<|startoftext|>b", "  x y", "w" * 300 + " end", "²½", "\x00\x01 \x1f"]
    odd += ["".join(rng.choice(["a", "B", "'s", "'", " ", "\n", ".", ",", "9", "é", "́", "ß", "-", "\t", " ", "the "]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    encoder = packing.WordEncoder(WORDS)
    want = plain_ids(odd)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(odd)] == want
    assert all(len(x) <= packing.LONG for x in encoder.parts)


@pytest.mark.parametrize(
    "name, sizes",
    [
        ("mixed", [random.Random(1).randrange(1, 101) for _ in range(1500)]),
        ("small", [random.Random(2).randrange(1, 6) for _ in range(3000)]),
        ("one length", [40] * 700),
        ("full", [100] * 50),
        ("few", [60, 50, 50, 40, 1]),
        ("small and large", [97] * 200 + [1] * 500 + [2] * 50),
    ],
)
@pytest.mark.parametrize("rows", [60, 100_000])
def test_best_fit(spark, name, sizes, rows):
    df = spark.createDataFrame([(k, n, k, 0, 0, k) for k, n in enumerate(sizes)], "id long, size int, doc_id long, piece int, start long, ids_crc32 long")
    got = packing.best_fit(df, 100, rows).collect()
    assert sorted((r.id, r["size"], r.doc_id, r.ids_crc32) for r in got) == [(k, n, k, k) for k, n in enumerate(sizes)]
    n, least = check_places(got, 100), best_fit_decreasing(sizes, 100)
    assert n <= math.ceil(1.02 * least) + 1


def test_pairs_of_ranges_meet_once():
    lines = [{"part": 0, "left": 7, "largest": 3, "free": 0, "smallest": 0}, {"part": 1, "left": 2, "largest": 9, "free": 2, "smallest": 7}, {"part": 2, "left": 0, "largest": 0, "free": 9, "smallest": 10}]
    got = packing.pair_ranges(lines)
    pieces, gaps = Counter(), Counter()
    for kind, part, low, high, pair, each in got:
        for rank in range(low, high):
            if kind == packing.LEFT:
                pieces[part, rank] += 1
            else:
                gaps[pair + rank - low] += 1
    assert set(pieces.values()) == set(gaps.values()) == {1} and len(pieces) == 9


def test_pack_documents_at_the_edges(spark):
    texts = [None, "", "a b", "a b", "word " * 50, "x"]
    docs = spark.createDataFrame([(None if k == 5 else min(k, 3), t, 9, "s") for k, t in enumerate(texts)], "doc_id long, text string, size int, id string")
    got = packing.pack_documents(docs, WORDS, 16).collect()
    want = Counter()
    for k, ids in enumerate(plain_ids([t or "" for t in texts])):
        ids = np.array([*ids, 0], "<u4")
        for at in range(0, len(ids), 16):
            want[None if k == 5 else min(k, 3), at // 16, at, len(ids[at : at + 16]), zlib.crc32(ids[at : at + 16].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert check_places([{"sequence_id": r.sequence_id, "offset": r.offset, "size": r.length} for r in got], 16) == math.ceil(sum(r.length for r in got) / 16)
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


# --- collocations


def plain_collocations(docs, least, inside, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for m in (1, 2, 3):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = defaultdict(list)
    for (lang, g), a in found.items():
        if any(100 * b >= inside * a for (other, h), b in found.items() if other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        rows[lang].append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, k + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for lang, found in rows.items() for k, r in enumerate(sorted(found)[:top]))


def collocation_texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(30)] + ["Été", "été", "12", "The", "a b", "-", "99999999999999999999"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda: "".join(rng.choices(vocabulary, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ? "]) for _ in range(rng.randrange(60)))
    docs = [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(150)]
    return docs + [("en", None), ("en", ""), ("fr", "la " * 200), ("fr", "New York city. new york"), ("xx", "only once")] + [("en", "x y x y x y x")] * 12


def test_collocations(spark):
    docs = collocation_texts()
    df = spark.createDataFrame([(k, t, lang, 1, "p") for k, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, a int, phrase string")
    got = collocations.collocations(df, 4, 3, 50, 40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, 4, 50, 40)


def test_counts_where_everything_is_split(monkeypatch):
    """Chunks, slices, blocks and groups end everywhere, and words share tallies."""
    docs, least = collocation_texts(), 4
    for name, to in (("SLOTS", 64), ("CHUNK", 7), ("SLICE", 20), ("BLOCK", 3), ("GROUP", 9)):
        monkeypatch.setattr(collocations, name, to)
    run = lambda f, rows: [r for b in f(iter(rows)) for r in zip(*(c.to_pylist() for c in b.columns))]
    batch = [pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in docs]), pa.array([t for _, t in docs])], ["lang", "text"])]
    f = Counter()
    for lang, word, n in run(collocations._count, batch):
        f[lang, word] += n
    slots = Counter()
    for (lang, word), n in f.items():
        slots[int(collocations._slot(lang, [word.encode()]).view("i8")[0] % 64)] += n
    table = np.array([slots[k] if slots[k] >= least else 0 for k in range(64)], "i8")
    routed = sorted(run(collocations._router(type("Shared", (), {"value": table}), 9), batch), key=lambda r: (r[0], r[1], r[4]))
    assert max(r[3] for r in routed) > 1
    mined = run(collocations._miner(least, 3), [pa.RecordBatch.from_arrays([pa.array([r[k] for r in routed]) for k in (0, 1, 3, 4, 5)], ["lang", "pivot", "groups", "grp", "fragments"])])
    got = Counter()
    for lang, phrase, _, _, a in mined:
        got[lang, phrase] += a
    want = Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]", piece) if x]
            want.update((lang or "und", " ".join(w[i : i + m])) for m in (2, 3) for i in range(len(w) - m + 1))
    assert {k: a for k, a in got.items() if a >= least} == {k: a for k, a in want.items() if a >= least}


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_scores_are_exact(spark):
    a, left, right = 3_000_000_019, 3_000_000_021, 8_999_999_999_999
    words = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, word string, f long")
    found = spark.createDataFrame([("en", "x y", a)], "lang string, phrase string, a long")
    assert collocations.score(words, found).first().score == 1_000_000 * a * a // (left * right)


# --- fill-in-the-middle


def plain_fim(doc_id, text):
    text, n = text or "", len(text or "")
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, sha(text), sha(text)
    a, b, c = text[:lo], text[lo:hi], text[hi:]
    out = f"<S>{c}<P>{a}<M>{b}" if h[3] % 100 < 20 else f"<P>{a}<S>{c}<M>{b}"
    return doc_id, n, "spm" if h[3] % 100 < 20 else "psm", lo, hi - lo, out, sha(out), sha(text)


def test_fill_in_middle(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "<P>", "x<M>y", "<P", "S>", "a<", "é\U0001f600́ z", "\n\r\n", "t" * 70_000]
    texts += ["".join(rng.choice("ab<PSM> \né\U0001f600") for _ in range(rng.randrange(600))) for _ in range(300)]
    rows = [(k, t, 1, "f", None) for k, t in enumerate(texts)] + [(None, "no id", 1, "f", None)] * 2 + [(7, texts[7], 1, "f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, output string")
    made = fim.fill_in_middle(df)
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == sorted((plain_fim(r[0], r[1]) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(((r.doc_id, r.t) for r in back), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_other_units_and_markers(spark):
    ends = fim.unit_scanner(r"\w+\s*")("ab  cd, e" + " f" * 600)
    assert ends[:3].tolist() == [4, 6, 10] and len(ends) == 603
    df = spark.createDataFrame([(k, "one two  three, four") for k in range(60)], "doc_id long, text string")
    got = fim.fill_in_middle(df, unit=r"\w+\W*", markers=("[p]", "[s]", "[m]")).collect()
    assert {r.n for r in got} == {4} and {r.prefix_chars for r in got} <= {None, 0, 4, 9, 16, 20}
    assert all(r.restored_sha256 == hashlib.sha256(b"one two  three, four").hexdigest() for r in got)
    with pytest.raises(ValueError):
        fim.unit_scanner(r"\w*")
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, markers=("ab", "bc", "xy"))

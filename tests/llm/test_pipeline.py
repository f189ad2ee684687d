"""The corpus pipeline's stages, each against a plain version on its own input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomery.llm import common, decontaminate, mixing, quality, simhash
from loomery.llm.queries import tokenizer_path

PATH = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = common.read(spark, PATH, "documents").withColumn("_gone", F.lit(1))
    columns, rows = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.stage_table(stage(spark, docs, PATH), name)
        assert docs.columns == columns
        rows = docs.collect()
        kept = {r.doc_id for r in rows}
        assert all(r == before[r.doc_id] for r in rows)
        if name == "quality":
            model = quality.train(common.read(spark, PATH, "documents"), common.read(spark, PATH, "labels"), lambda c: quality.folds(c, 5) != 0)
            features = {d: quality.passage_features([r.text.encode()]) for d, r in before.items()}
            assert kept == {d for d, f in features.items() if model.score(f)[0][0] >= 0.3}
        if name == "near_dedup":
            # all pairs: those that agree in the three bytes of some list and differ in few enough bits
            sketch = simhash.SIMILAR
            ids = sorted(before)
            rows_of = np.stack([simhash.fingerprint_words(before[d].text.encode(), sketch).astype(">u8").view("u1") for d in ids])
            root = {d: d for d in ids}
            links = []
            for i, d in enumerate(ids):
                same = rows_of == rows_of[i]
                meet = np.array([same[:, list(c)].all(1) for c in sketch.combos]).any(0)
                close = np.bitwise_count(rows_of ^ rows_of[i]).sum(1) <= sketch.bits
                links += [(d, ids[k]) for k in np.flatnonzero(meet & close)]
            changed = True
            while changed:
                changed = False
                for a, b in links:
                    low = min(root[a], root[b])
                    if root[a] != low or root[b] != low:
                        root[a] = root[b] = low
                        changed = True
            assert kept == {d for d in ids if root[d] == d}
        if name == "decontamination":
            windows = set()
            for r in common.read(spark, PATH, "benchmark").collect():
                w = decontaminate.words_of(r.text.encode())
                n = min(10, len(w))
                windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

            def leaks(text):
                w = decontaminate.words_of(text.encode())
                return any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))

            assert kept == {d for d, r in before.items() if not leaks(r.text)}
        if name == "mixing":
            source = spark.createDataFrame(list(before.values()), docs.schema)
            plan = {r.doc_id: r.repeats for r in mixing.plan_mix(source).collect()}
            counts: dict[int, int] = {}
            for r in rows:
                counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
            assert counts == {d: n for d, n in plan.items() if n}
    tok, at = Tokenizer.from_file(tokenizer_path()), 0
    out = sorted(cp.STAGES[-1][1](spark, docs, PATH).collect(), key=lambda r: r.start)
    texts = {r.doc_id: r.text for r in rows}
    assert len(out) == len(rows) and [r.doc_id for r in out] == sorted(r.doc_id for r in rows)
    for r in out:
        ids = np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run(spark):
    assert cp.run(spark, PATH).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_edge_cases(spark):
    """Null ids and texts, empty texts and repeated rows pass every stage; empty tables give empty ones."""
    docs = common.read(spark, PATH, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a few words", "en", "s", 11), (-1, "", "en", "s", 0), (-2, None, "en", None, 0), (-3, "word", "en", "s", 4), (-3, "word", "en", "s", 4)], docs.schema)
    for some in (docs.limit(40).unionByName(odd), docs.limit(0)):
        rows, n = some, some.count()
        for name, stage in cp.STAGES[:-1]:
            rows = common.stage_table(stage(spark, rows, PATH), name)
            assert rows.columns == docs.columns and (n or not rows.count())
        assert cp.STAGES[-1][1](spark, rows, PATH).count() == rows.count()
    near = cp.near_dedup(spark, odd, PATH).collect()
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == [-3, -3, -2] and sum(r.doc_id is None for r in near) == 2

"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages of ``PASSAGE`` words. A passage is encoded from learned embeddings of its hashed n-grams
(each word, its first and its last three bytes) and from counts of its bytes by class and of repeated words; gated
attention, tanh(V h) * sigmoid(U h), weighs the passages, and the weighted mean of their codes is scored. Only document
labels are needed, so a document of good passages and one of junk is learned as a whole, and the attention says which
passage decided.

Scores depend on the text alone. Features and training are numpy code; scoring streams over Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, give_back, released, stage_table

PASSAGE = 48
TRAIN_DOCS = 3000  # labelled documents of each class that are learned from, at most
BUCKETS, GRAMS, DIM = 1 << 13, 3, 8  # hashed n-grams, n-grams of a word, numbers of an embedding
CODE, GATE, STEPS, BATCH, RATE, SEED = 16, 8, 240, 256, 0.02, 7
LEAST = 0.3
PIECE = 1 << 20  # bytes of a text that are read at a time, about; passages are the same at any size

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"?-()", b"!", b"|/\\<>{}[]=_", b"#$%&*@~^`+", bytes(range(0xC3, 0xC4)), bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0xC3)) + bytes(range(0xC4, 0x100)), b" ", bytes(range(32)) + b"\x7f"]
CLASS = np.zeros(256, "u1")
for _i, _c in enumerate(_CLASSES):
    CLASS[np.frombuffer(_c, "u1")] = _i
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
N_FEATURES = len(_CLASSES) + 6
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_UNDO = pow(_BASE, -1, 1 << 64)


@dataclass
class Passages:
    """Passages of some texts: dense features, hashed n-grams (``GRAMS`` a word), words of each, passages of each text."""

    x: np.ndarray
    grams: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    @classmethod
    def join(cls, parts: list[Passages]) -> Passages:
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("x", "grams", "words", "counts")))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        _POWERS = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, b, "u8")]) for b in (_BASE, _UNDO))
    return _POWERS


_POWERS = (np.ones(1, "u8"), np.ones(1, "u8"))


def _pieces(raw: bytes) -> list[bytes]:
    """A long text in parts of whole passages, of about PIECE bytes where passages are shorter."""
    buf, out, at, take = np.frombuffer(raw, "u1"), [], 0, PIECE
    while len(raw) - at > take:
        blank = _SPACE[buf[at : at + take]]
        start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        last = (len(start) - 1) // PASSAGE * PASSAGE
        if last <= 0:  # no passage ends here
            take *= 2
            continue
        out.append(raw[at : at + start[last]])
        at, take = at + int(start[last]), PIECE
    return [*out, raw[at:]]


def passage_features(texts: list[bytes | None]) -> Passages:
    """All passages of some texts; a text without words has one, an empty one."""
    pieces = [_pieces(t or b"") for t in texts]
    p = _features([x for own in pieces for x in own])
    at = np.cumsum([0, *map(len, pieces)])[:-1]
    return Passages(p.x, p.grams, p.words, np.add.reduceat(p.counts, at) if len(texts) else p.counts)


def _features(texts: list[bytes]) -> Passages:
    buf = np.frombuffer(b"\n".join([*texts, b""]), "u1")
    size = np.array([len(t) + 1 for t in texts], "i8")
    blank = _SPACE[buf]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    end = np.flatnonzero(blank & ~np.r_[True, blank[:-1]])
    text = np.repeat(np.arange(len(texts)), size)[start]
    n_words = np.bincount(text, minlength=len(texts))
    counts = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(counts) - counts  # each text's first passage
    at = np.arange(len(start)) - (np.cumsum(n_words) - n_words)[text]
    passage = first[text] + at // PASSAGE
    n = int(counts.sum())
    words = np.bincount(passage, minlength=n)

    power, undo = _powers(len(buf))
    sums = np.r_[np.uint64(0), np.cumsum((buf + np.uint64(1)) * power[: len(buf)])]
    h = (sums[end] - sums[start]) * undo[start]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    padded = np.r_[buf, np.zeros(3, "u1")].astype("u4")
    three = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    length = end - start
    short = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], "u4")[np.minimum(length, 3)]
    fold = lambda v, salt: ((v.astype("u8") + np.uint64(salt << 32)) * _MIX) >> np.uint64(64 - 13)
    grams = np.stack([h >> np.uint64(64 - 13), fold(three[start] & short, 1), fold(three[np.maximum(start, end - 3)] & short, 2)], 1).astype("u2")

    lead = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]]) if len(start) else np.zeros(0, "i8")
    last = np.r_[lead[1:], len(start)] - 1 if len(lead) else lead
    span = np.zeros(n, "i8")
    span[passage[lead]] = end[last] - start[lead]
    inside = np.repeat(start[lead] - np.r_[0, np.cumsum(span[passage[lead]])[:-1]], span[passage[lead]]) + np.arange(span.sum()) if len(lead) else lead
    kinds = np.bincount(np.repeat(np.arange(n), span) * len(_CLASSES) + CLASS[buf[inside]], minlength=n * len(_CLASSES)).reshape(n, -1)
    within = lambda flag: (c := np.r_[0, np.cumsum(flag)])[end] - c[start]
    upper, lower = within((buf >= 65) & (buf <= 90)), within((buf >= 97) & (buf <= 122))
    per = lambda flag: np.bincount(passage[flag], minlength=n)
    _, once = np.unique(h + passage.astype("u8") * np.uint64(_BASE), return_index=True)
    again = np.flatnonzero((h[1:] == h[:-1]) & (passage[1:] == passage[:-1]))
    some = np.maximum(1, words)
    stats = [words / PASSAGE, per(once) / some, per(again) / some, per((upper > 0) & (lower == 0)) / some, per(upper + lower == length) / some, np.log1p((span + 1) / some)]
    return Passages(np.concatenate([kinds / np.maximum(1, span)[:, None], np.stack(stats, 1)], 1), grams, words, counts)


class Attention:
    """Gated attention over passage codes; ``p`` holds the weights, "E" the embeddings of n-grams."""

    def __init__(self, mean, sd, p):
        self.mean, self.sd, self.p = mean, sd, p

    def _embedded(self, b: Passages) -> np.ndarray:
        """Mean embedding of each passage's n-grams (0 without words)."""
        out = np.zeros((len(b.words), DIM))
        some = np.flatnonzero(b.words)
        if len(some):
            at = (np.cumsum(b.words) - b.words)[some]
            # words of a passage follow each other, so a passage ends where the next one with words begins
            out[some] = np.add.reduceat(self.p["E"].astype("f4")[b.grams].sum(1), at) / (GRAMS * b.words[some, None])
        return out

    def _forward(self, b: Passages):
        p, at = self.p, np.cumsum(b.counts) - b.counts
        x = np.concatenate([(b.x - self.mean) / self.sd, self._embedded(b)], 1)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), b.counts))
        a = e / np.repeat(np.add.reduceat(e, at), b.counts)
        z = np.add.reduceat(a[:, None] * h, at)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return x, h, t, s, a, z, y

    def score(self, b: Passages):
        """Score of each document, and the attention of each passage."""
        *_, a, _, y = self._forward(b)
        return y, a

    def gradient(self, b: Passages, labels, weights) -> dict[str, np.ndarray]:
        """Of the weighted log loss, by each weight."""
        p, counts = self.p, b.counts
        x, h, t, s, a, z, y = self._forward(b)
        at = np.cumsum(counts) - counts
        dl = weights * (y - labels)
        dz = np.repeat(dl[:, None] * p["o"], counts, 0)
        da = (dz * h).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, at), counts))
        dt, ds = (de[:, None] * p["w"] * s) * (1 - t * t), (de[:, None] * p["w"] * t) * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        own = (dh @ p["W"][N_FEATURES:].T) / (GRAMS * np.maximum(1, b.words))[:, None]
        each = np.repeat(np.repeat(own, b.words, 0), GRAMS, 0)
        table = np.stack([np.bincount(b.grams.ravel(), each[:, k], BUCKETS) for k in range(DIM)], 1)
        return {"E": table, "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "o": z.T @ dl, "c": dl.sum(keepdims=True)}

    @classmethod
    def fit(cls, bags: list[Passages], labels, weights, steps=STEPS):
        """Adam over shuffled batches of documents, each given as its passages."""
        rng, x = np.random.default_rng(SEED), np.concatenate([b.x for b in bags])
        n = N_FEATURES + DIM
        p = {"E": rng.normal(0, 0.3, (BUCKETS, DIM)), "W": rng.normal(0, n**-0.5, (n, CODE)), "b": np.zeros(CODE), "V": rng.normal(0, CODE**-0.5, (CODE, GATE)), "U": rng.normal(0, CODE**-0.5, (CODE, GATE)), "w": rng.normal(0, 0.3, GATE), "o": rng.normal(0, 0.3, CODE), "c": np.zeros(1)}
        self = cls(x.mean(0, dtype="f8"), x.std(0, dtype="f8") + 1e-3, p)
        del x
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in "12")
        weights, order = weights / weights.mean(), np.zeros(0, "i8")
        for step in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(len(bags))
            own, order = order[:BATCH], order[BATCH:]
            grad = self.gradient(Passages.join([bags[i] for i in own]), labels[own], weights[own] / weights[own].sum())
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def folds(id_col, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null id: of an empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> DataFrame:
    """(doc_id, y, weight, t) of at most ``per_class`` labelled documents of either class, chosen by a hash of their ids.

    They are chosen among labels that have a document. ``weight`` restores the shares of the classes. Rows without id or
    label are left out; an id that is labelled twice counts with its largest label, and an id of several documents with
    the text of the smallest hash. No such label gives no rows.
    """
    own = F.col("doc_id").cast("long")
    rows = labels.select(own.alias("doc_id"), F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    rows = stage_table(rows.join(docs.select(own.alias("doc_id")), "doc_id", "left_semi"), "labelled")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}  # a row per class
    few = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).withColumn("weight", F.lit(k / min(k, per_class))) for y, k in sorted(n.items())]
    chosen = few[0].unionByName(few[1]) if len(few) == 2 else few[0] if few else rows.withColumn("weight", F.lit(1.0))
    chosen = stage_table(chosen, "chosen")  # at most per_class of either class
    drop_table(rows)
    texts = docs.select(own.alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "weight").agg(F.min_by("t", F.xxhash64("t")).alias("t"))


BAG_SQL = "doc_id long, y int, weight double, x binary, grams binary, words array<int>"


def _featurize(batches):
    for b in batches:
        out = []
        for raw in b.column("t").to_pylist():
            p = passage_features([raw])
            out.append((p.x.astype("f4").tobytes(), p.grams.tobytes(), p.words.astype("i4")))
        x, grams, words = ([r[k] for r in out] for k in range(3))
        cols = [b.column("doc_id"), b.column("y"), b.column("weight"), pa.array(x, pa.binary()), pa.array(grams, pa.binary()), pa.array(words, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y", "weight", "x", "grams", "words"])


def train(docs: DataFrame, labels: DataFrame, learn=None, per_class: int = TRAIN_DOCS) -> Attention | None:
    """Fits a model; ``learn`` says for an id column which labelled rows may be learned from. None without labels.

    Passages, all of a document's, become numbers where the rows are, so that the driver gets those of a bounded number of documents
    and no text.
    """
    learn = learn or (lambda _: F.lit(True))
    rows = training_rows(docs, labels, "quality", learn, per_class)
    got = sorted(rows.mapInArrow(released(_featurize), BAG_SQL).collect(), key=lambda r: r.doc_id)
    if not got:
        return None
    one = lambda r: Passages(np.frombuffer(bytes(r.x), "f4").reshape(-1, N_FEATURES), np.frombuffer(bytes(r.grams), "u2").reshape(-1, GRAMS), np.array(r.words, "i8"), np.array([len(r.words)]))
    y, weights = np.array([r.y for r in got], "f8"), np.array([r.weight for r in got])
    bags = [one(r) for r in got]
    del got
    model = Attention.fit(bags, y, weights)
    del bags
    give_back()
    return model


def _scorer(shared, column):
    def run(batches):
        model = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_score_all(model, b.column(column).to_pylist()))], [*b.schema.names[:-1], "score"])

    return run


def _score_all(model, texts) -> np.ndarray:
    """Scores of texts, about PIECE bytes at a time."""
    out, part, size = [np.zeros(0)], [], 0
    for t in texts:
        part.append(t)
        size += len(t or b"")
        if size > PIECE:
            out.append(_score(model, part))
            part, size = [], 0
    return np.concatenate([*out, _score(model, part)])


def _score(model, texts):
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return model.score(passage_features(texts))[0]


def score(docs: DataFrame, model: Attention | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every text.

    A null text is empty; an empty text is one passage without words. Without a model (no labels) every score is 0.5.
    Rows that repeat an id keep a row each. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(released(_scorer(shared, "t")), "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: every fifth of the documents, by the crc32 of their ids, is held out of training."""
    model = train(docs, labels, lambda c: folds(c, 5) != 0)
    return score(docs, model).select("doc_id", (folds(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))


def _keeper(shared, least, text_col):
    def run(batches):
        for b in batches:
            texts = b.column(text_col).cast(pa.binary()).to_pylist()
            yield b.filter(pa.array(_score_all(shared.value, texts) >= least, pa.bool_()))

    return run


def keep_good(docs: DataFrame, model: Attention | None, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The documents that score at least ``least``, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(released(_keeper(shared, least, text_col)), docs.schema)

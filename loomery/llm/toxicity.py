"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the training rows: words, and beginnings of words, that occur in toxic documents and hardly
in others. Spark counts the documents of either class that hold them, so the driver gets the lexicon and a fixed number
of numbers per training row, but no text. Features are densities and counts of its hits (also after undoing look-alike characters), how many hits are
near a second-person word, capitals, punctuation and obfuscation rates. Isotonic regression (pool adjacent violators)
maps the trees' margin to a probability, learned from margins of rows that their trees were not fitted on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, stage_table
from .quality import LEAST, folds, training_rows

TRAIN_DOCS = 2500  # labelled documents of each class that are learned from, at most
TREES, DEPTH, RATE, BINS, MIN_LEAF, L2 = 60, 3, 0.2, 32, 8, 1.0
STARTS = (4, 5, 6)
LEAST_DOCS, LEAST_RATIO, LEXICON = 3, 12.0, 20_000
NEAR = 5
PARTS = 3  # of the training rows; a lexicon never judges the rows that it was learned from

#: Second-person words (English, German, French, Spanish); fixed values.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer sie ihnen tu toi te vous votre vos ton ta tes tú ti usted ustedes vosotros tuyo".encode().split())
#: White space and ASCII punctuation part words, except the characters that stand in for letters.
_PARTS = bytes(32 if c < 128 and not chr(c).isalnum() and chr(c) not in "@$*" else c for c in range(256))
_ODD = b"0123456789@$*"
_UNDO = bytes.maketrans(b"013457@$", b"oieastas")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PARTS).split()


def terms_of(text: str) -> tuple[set[bytes], set[bytes]]:
    """Different words of a text, as they are and with look-alike characters undone, and their beginnings."""
    own = set(words_of(text))
    words = {w.translate(_UNDO) for w in own} | own
    return words, {w[:k] for w in words for k in STARTS if len(w) > k}


def _terms(batches):
    for b in batches:
        part, y, kind, term = [], [], [], []
        for p, label, raw in zip(*(b.column(c).to_pylist() for c in ("part", "y", "t"))):
            for k, own in enumerate(terms_of((raw or b"").decode("utf-8", "replace"))):
                part += [p] * len(own)
                y += [label] * len(own)
                kind += [k] * len(own)
                term += own
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(y, pa.int32()), pa.array(kind, pa.int32()), pa.array(term, pa.binary())], ["part", "y", "kind", "term"])


def learn_lexicons(rows: DataFrame) -> list[dict[str, dict[bytes, float]]]:
    """Lexicons from rows of (part, y, t): one without each part, then one from all: {"words": ..., "starts": ...}.

    A term is in if at least LEAST_DOCS toxic documents hold it and their share is LEAST_RATIO times that of the others
    (twice that for beginnings); of more than LEXICON the ones with the largest ratio, then the first by bytes. Its
    weight is the logarithm of that ratio with the toxic documents' number less its standard deviation, so that a term
    which few of them happen to share weighs little.
    """
    total = {(r.part, r.y): r.n for r in rows.groupBy("part", "y").agg(F.count("*").alias("n")).collect()}  # PARTS x 2 rows
    held = lambda y, k: [F.when((F.col("y") == y) & (F.col("part") != k), 1)]
    counts = rows.select("part", "y", "t").mapInArrow(_terms, "part int, y int, kind int, term binary")
    counts = counts.groupBy("kind", "term").agg(*(F.count(*held(y, k)).alias(f"n{y}_{k}") for y in (0, 1) for k in range(PARTS + 1)))
    best = []
    for k in range(PARTS + 1):
        of = lambda y: max(1, sum(n for (p, label), n in total.items() if label == y and p != k))  # noqa: E731, B023
        ratio = (F.col(f"n1_{k}") / of(1)) / ((F.col(f"n0_{k}") + 0.5) / of(0))
        good = (F.col(f"n1_{k}") >= LEAST_DOCS) & (ratio >= LEAST_RATIO * (1 + F.col("kind")))
        sure = F.log(ratio * (1 - 1 / F.sqrt(F.col(f"n1_{k}"))))
        best.append(F.when(good, F.struct(F.lit(k).alias("part"), ratio.alias("ratio"), sure.alias("weight"))))
    rows = counts.select("kind", "term", F.explode(F.array_compact(F.array(*best))).alias("b")).select("kind", "term", "b.*")
    place = F.row_number().over(Window.partitionBy("part", "kind").orderBy(F.desc("ratio"), "term"))
    out = [{"words": {}, "starts": {}} for _ in range(PARTS + 1)]
    for r in rows.withColumn("place", place).where(F.col("place") <= LEXICON).collect():
        out[r.part]["starts" if r.kind else "words"][bytes(r.term)] = r.weight
    return out


def text_features(text: str, lexicon: dict[str, dict[bytes, float]]) -> list[float]:
    words = words_of(text)
    n, size = max(1, len(words)), max(1, len(text))
    known, starts = lexicon["words"], lexicon["starts"]
    whole = [i for i, w in enumerate(words) if w in known]
    shortest = lexicon.setdefault("_shortest", {w[: STARTS[0]] for w in starts})
    begun = [i for i, w in enumerate(words) if w[: STARTS[0]] in shortest]
    begun = [i for i in begun if any(words[i][:k] in starts for k in STARTS)]
    raw = text.encode("utf-8", "replace")
    odd = [i for i, w in enumerate(words) if w.translate(None, _ODD) != w] if len(raw) != len(raw.translate(None, _ODD)) else []
    undone = sum(1 for i in odd if (w := words[i].translate(_UNDO)) in known or any(w[:k] in starts for k in STARTS))
    mixed = sum(1 for i in odd if words[i].strip(_ODD).translate(None, _ODD) != words[i].strip(_ODD))
    second = [i for i, w in enumerate(words) if w in SECOND]
    hits = sorted({*whole, *begun})
    near = 0
    if hits and second:
        at = np.searchsorted(second, hits)
        s, h = np.array([-(10**9), *second, 10**9]), np.array(hits)
        near = int((np.minimum(h - s[at], s[at + 1] - h) <= NEAR).sum())
    upper = sum(map(str.isupper, text.split()))
    kinds = {words[i] for i in hits}
    weights = [max(known.get(w, 0.0), known.get(w.translate(_UNDO), 0.0), *(starts.get(w[:k], 0.0) for k in STARTS)) for w in kinds]
    b = np.frombuffer(raw, "u1")
    thrice = int(((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] > 64)).sum())
    return [
        len(whole) / n, np.log1p(len(whole)), len(begun) / n, np.log1p(len(begun)), len(kinds), max(weights, default=0.0), sum(weights), undone, undone / n, near, near / n, len(second) / n,
        upper / n, text.count("!") / size, text.count("?") / size, (text.count("*") + text.count("#") + text.count("$")) / size, len(odd) / n,
        mixed / n, thrice / n, np.log1p(n),
    ]


class Trees:
    """Gradient-boosted regression trees for log loss on binned features, calibrated by isotonic regression."""

    def fit(self, x, y, weight, part):
        """Trees on all rows; the margins that are calibrated are those of trees fitted without a row's part."""
        self.cuts = [self._edges(c, y) for c in x.T]
        binned, margin = self._bin(x), np.zeros(len(y))
        for k in np.unique(part):
            own = part == k
            margin[own] = self._margin(binned[own], *self._boost(binned[~own], y[~own], weight[~own]))
        self.base, self.trees = self._boost(binned, y, weight)
        self._isotonic(margin, y, weight)
        return self

    def _boost(self, b, y, weight):
        """The prior margin and the trees."""
        if not len(y):
            return 0.0, []
        w = weight / weight.mean()
        mean = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        base, trees = float(np.log(mean / (1 - mean))), []
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            trees.append(self._grow(b, w * (p - y), w * np.maximum(p * (1 - p), 1e-6)))
            margin += self._leaf(trees[-1], b)
        return base, trees

    @staticmethod
    def _edges(values, y):
        """Bin edges: midpoints between neighbouring values on both sides of quantiles of either class."""
        known = np.unique(values)
        middle = (known[1:] + known[:-1]) / 2
        if len(middle) <= 2 * BINS:
            return middle
        own = [np.quantile(values[y == k], np.linspace(0, 1, BINS // 2 + 1), method="nearest") for k in (0, 1) if (y == k).any()]
        at = np.searchsorted(known, np.concatenate(own))
        return middle[np.unique(np.clip(np.r_[at - 1, at], 0, len(middle) - 1))]

    def _bin(self, x):
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], 1).astype("u1")

    def _grow(self, b, grad, hess):
        """A complete tree as (feature, bin, value) arrays; a row goes right if its bin is over ``bin``."""
        size, width = 2**DEPTH - 1, 1 + max(map(len, self.cuts))
        feature, cut, value = np.zeros(size, "i4"), np.full(size, 255), np.zeros(2 ** (DEPTH + 1) - 1)
        node = np.zeros(len(b), "i4")
        for k in range(2 ** (DEPTH + 1) - 1):
            rows = np.flatnonzero(node == k)
            g, h = grad[rows].sum(), hess[rows].sum()
            value[k] = -RATE * g / (h + L2)
            if k >= size:
                continue
            best = (1e-6, 0, 255)
            for f in range(b.shape[1]) if len(rows) >= 2 * MIN_LEAF else ():
                v = b[rows, f]
                gl, hl = (np.cumsum(np.bincount(v, s[rows], width)) for s in (grad, hess))
                nl = np.cumsum(np.bincount(v, minlength=width))
                gain = gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g**2 / (h + L2)
                gain[(nl < MIN_LEAF) | (len(rows) - nl < MIN_LEAF)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            _, feature[k], cut[k] = best
            node[rows] = 2 * k + 1 + (b[rows, feature[k]] > cut[k])
        return feature, cut, value

    def _leaf(self, tree, b):
        feature, cut, value = tree
        node = np.zeros(len(b), "i4")
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node]

    def _margin(self, binned, base, trees):
        return base + sum((self._leaf(t, binned) for t in trees), np.zeros(len(binned)))

    def _isotonic(self, margin, y, weight):
        order = np.lexsort((y, margin))
        pools: list[list[float]] = []  # weighted sum, weight, largest margin
        for m, t, w in zip(margin[order], y[order], weight[order]):
            pools.append([t * w, w, m])
            while len(pools) > 1 and (pools[-2][2] == pools[-1][2] or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
                s, w2, m2 = pools.pop()
                pools[-1] = [pools[-1][0] + s, pools[-1][1] + w2, m2]
        self.steps = np.array([p[2] for p in pools])
        self.values = np.array([p[0] / p[1] for p in pools])

    def predict(self, x):
        if not len(x):
            return np.zeros(0)
        m = self._margin(self._bin(x), self.base, self.trees)
        # within a step scores still rise a little with the margin, so that ranks survive
        p = np.interp(m, self.steps, self.values)
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-m)), 0, 1)


def _featurize(shared):
    def run(batches):
        for b in batches:
            x = [text_features((raw or b"").decode("utf-8", "replace"), shared.value[p]) for raw, p in zip(b.column("t").to_pylist(), b.column("part").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "y", "weight", "part")), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "weight", "part", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, learn=None, per_class: int = TRAIN_DOCS):
    """(lexicon, trees) from labelled rows; ``learn`` says for an id column which may be learned from. None without."""
    learn = learn or (lambda _: F.lit(True))
    rows = training_rows(docs, labels, "toxic", learn, per_class)
    rows = stage_table(rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(PARTS)).cast("int")), "training")
    lexicons = learn_lexicons(rows)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    got = sorted(rows.mapInArrow(_featurize(shared), "doc_id long, y int, weight double, part int, x array<double>").collect(), key=lambda r: r.doc_id)
    drop_table(rows)
    if not got:
        return None
    column = lambda name, kind: np.array([r[name] for r in got], kind)
    return lexicons[-1], Trees().fit(column("x", "f8"), column("y", "f8"), column("weight", "f8"), column("part", "i4"))


def _scorer(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            if model is None:
                p = np.full(b.num_rows, 0.5)
            else:
                x = [text_features(t or "", model[0]) for t in b.column(1).to_pylist()]
                p = model[1].predict(np.array(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: more likely toxic) of every text.

    A null text is empty. Without a model (no labels) every score is 0.5. Rows that repeat an id keep a row each. No
    rows give no rows; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows: a quarter of the documents, by the crc32 of their ids, is held out of training."""
    model = train(docs, labels, lambda c: folds(c, 4) != 2)
    return score(docs, model).select("doc_id", (folds(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))

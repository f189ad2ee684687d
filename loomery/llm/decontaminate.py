"""Benchmark decontamination with a generalised suffix automaton of the test items.

Test items and documents are reduced to lower-case words; the automaton is built over word ids of all items. A
document's words stream through it once, keeping the length of the longest item substring that ends at each word; where
that length reaches the window, the last ``window`` words are marked. Items below the window count when whole.

An automaton is sent to the executors, so its size is bounded: items are dealt to automata of at most ``max_words``
words, and documents pass each in turn (a window never spans items, so the results add up). Only one automaton is held
at a time: its pass is written before the next one is built.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, stage_table

WINDOW = 10
MAX_WORDS = 400_000  # words in one automaton; about 100 MB in a Python worker

#: Lower-cases A-Z; all other ASCII but letters and digits becomes a space. Bytes from 80 on belong to words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(TABLE).split()


class Automaton:
    """Suffix automaton of word sequences; ``next[s]`` maps a word to a state."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        short: dict[int, list[tuple[int, object]]] = {}
        wholes = []
        for item, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            wholes.append((item, words))
        for item, words in wholes:  # states are final now
            if words and len(words) < window:
                at = 0
                for w in words:
                    at = self.next[at][w]
                short.setdefault(at, []).append((len(words), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        #: For each state the one that stands for its last ``window`` words, and the whole short items that end in it.
        self.at_window, self.short = [0] * len(self.link), [()] * len(self.link)
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
            self.short[s] = (*short.get(s, ()), *self.short[up])
        found: dict[int, set] = {}
        for item, words in wholes:  # one entry per window of an item: what items have in common counts once for each
            at = 0
            for i, w in enumerate(words, 1):
                at = self.next[at][w]
                if i >= window:
                    found.setdefault(self.at_window[at], set()).add(item)
        self.items = {s: frozenset(x) for s, x in found.items()}

    def _new(self, length: int, link: int, following: dict) -> int:
        self.next.append(following), self.link.append(link), self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state for the strings of q of at most length[p] + 1 words."""
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs of hit words as (start, end), in order, and the items with occurring windows."""
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        state = size = 0
        spans: list[list[int]] = []
        items: set = set()
        for i, w in enumerate(words, 1):
            to = nxt[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                size = length[state]
                if to is None:
                    continue
            state, size = to, size + 1
            begin = i
            if size >= window:
                begin = i - window
                items |= self.items[self.at_window[state]]
            for n, item in short[state]:
                if n <= size:
                    begin = min(begin, i - n)
                    items.add(item)
            if begin < i:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append([begin, i])
        return [tuple(s) for s in spans], items


def _scan(shared):
    """What the automaton finds in the last column, beside the other columns."""

    def run(batches):
        auto = pickle.loads(shared.value)
        for b in batches:
            n, spans, items = [], [], []
            for raw in b.columns[-1].to_pylist():
                words = words_of(raw)
                found = auto.spans(words)
                n.append(len(words)), spans.append([x for s in found[0] for x in s]), items.append(sorted(found[1]))
            cols = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:-1], "n_words", "spans", "items"])

    return run


def _automata(items: DataFrame, id_col: str, text_col: str, window: int, max_words: int):
    """Pickled automata of at most ``max_words`` words each (a longer item has one of its own), one at a time."""
    part, size = [], 0
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(F.col(id_col).isNotNull())
    for item, raw in rows.toLocalIterator():
        words = words_of(bytes(raw or b""))
        if part and size + len(words) > max_words:
            yield pickle.dumps(Automaton(part, window), 5)
            part, size = [], 0
        if words:
            part.append((item, words))
            size += len(words)
    yield pickle.dumps(Automaton(part, window), 5)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (flat start, end word positions of hit runs), items (sorted ids).

    Null and empty texts have no words; items without words or id are ignored; without items nothing is hit. Rows that
    repeat a doc_id, or have none, stay apart. With several automata (``max_words`` exceeded) the rows are written with
    a number each, by which the results of the passes meet.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    automata = _automata(items, item_col, item_text, window, max_words)
    first, second = next(automata), next(automata, None)
    if second is None:
        return rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(first)), f"doc_id long, {FOUND_SQL}")
    numbered = stage_table(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "raw"), "rows")
    found = _passes(numbered, itertools.chain([first, second], automata)).drop("row")
    drop_table(numbered)
    return found


FOUND_SQL = "n_words long, spans array<long>, items array<string>"


def _passes(numbered: DataFrame, automata: Iterable[bytes]) -> DataFrame:
    """What all automata find in rows of (row, doc_id, raw): row, doc_id, n_words, spans, items."""
    all_ = None
    for k, auto in enumerate(automata):
        shared = numbered.sparkSession.sparkContext.broadcast(auto)
        found = numbered.mapInArrow(_scan(shared), f"row long, doc_id long, {FOUND_SQL}")
        if k:  # the first pass has a result for each row
            found = found.where(F.size("spans") > 0)
        found = stage_table(found, f"hits-{k}")
        shared.destroy()
        all_ = found if all_ is None else all_.unionByName(found)
    both = all_.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return both.mapInArrow(_merge, f"row long, doc_id long, {FOUND_SQL}")


def _merge(batches):
    for b in batches:
        out = []
        for lists in b.column("s").to_pylist():
            runs: list[list[int]] = []
            for s, e in sorted(p for x in lists for p in zip(x[::2], x[1::2])):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            out.append([x for r in runs for x in r])
        cols = [b.column("row"), b.column("doc_id"), b.column("n_words"), pa.array(out, pa.list_(pa.int64())), b.column("items")]
        yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n_words", "spans", "items"])


def hit_words(spans):
    """Number of words in the spans."""
    return F.aggregate(F.sequence(F.lit(1), F.size(spans)), F.lit(0).cast("long"), lambda n, k: n + F.when(k % 2 == 0, 1).otherwise(-1) * F.element_at(spans, k))


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The contract's digest of :func:`contamination`; ids are compared as strings by code point."""
    hit = contamination(docs, items, **how)
    n = F.when(F.size("spans") > 0, hit_words("spans")).otherwise(0).cast("long")
    ids = F.array_join("items", ",")
    return hit.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def _kept(raw: bytes, words: int, spans: list[tuple[int, int]], max_share: float) -> tuple[bytes, bool]:
    """The text without the spans of its words, and whether it stays at all."""
    hit = sum(e - s for s, e in spans)
    if not hit:
        return raw, True
    if not max_share > 0 or hit > max_share * words:
        return raw, False
    at, cut, end = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)], [], 0
    for s, e in spans:
        cut.append(raw[end : at[s][0]])
        end = at[e - 1][1]
    return b"".join([*cut, raw[end:]]), True


def _cleaned(b: pa.RecordBatch, column: str, spans_of, max_share: float, names: list[str]) -> pa.RecordBatch:
    texts, keep = [], []
    for i, raw in enumerate(b.column(column).to_pylist()):
        text, stays = _kept(raw, *spans_of(i, raw), max_share)
        texts.append(text), keep.append(stays)
    cols = [pa.array(texts, pa.binary()).cast(pa.string()) if n == column else b.column(n) for n in names]
    return pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))


def _cleaner(shared, max_share, column):
    def run(batches):
        auto = pickle.loads(shared.value)

        def spans_of(_, raw):
            words = words_of(raw)
            return len(words), auto.spans(words)[0]

        for b in batches:
            yield _cleaned(b, column, spans_of, max_share, b.schema.names)

    return run


def _cutter(max_share, column, names, found):
    def run(batches):
        for b in batches:
            n, spans = (b.column(c).to_pylist() for c in found)
            yield _cleaned(b, column, lambda i, _: (n[i], list(zip(spans[i][::2], spans[i][1::2]))), max_share, names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_share: float = 0.0, max_words: int = MAX_WORDS) -> DataFrame:
    """Documents with the same columns, without benchmark passages.

    A document in which more than ``max_share`` of the words are hit goes; from the others the hit spans are cut, with
    the text around them as it was. 0 drops every document that has a window. Texts without a hit, null ones included,
    stay as they are. Shares and spans are those of all items in the text as given, whatever the number of automata.
    """
    raw = lambda df: df.select(*(F.col(f"`{c}`").cast("binary").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))
    automata = _automata(items, item_col, item_text, window, max_words)
    first, second = next(automata), next(automata, None)
    if second is None:
        return raw(docs).mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(first), max_share, text_col), docs.schema)
    row, n, spans = (fresh(docs, c) for c in ("_row", "_n_words", "_spans"))
    numbered = stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    slim = numbered.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    found = _passes(slim, itertools.chain([first, second], automata)).select(F.col("row").alias(row), F.col("n_words").alias(n), F.col("spans").alias(spans))
    return raw(numbered.join(found, row).drop(row)).mapInArrow(_cutter(max_share, text_col, docs.columns, (n, spans)), docs.schema)


def items_digest(ids: Iterable) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()

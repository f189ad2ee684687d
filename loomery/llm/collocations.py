"""Phrase collocations by pivot partitioning: every phrase is counted where its rarest word is.

Words are ordered by how often they occur. A phrase belongs to its rarest word (the first of equals), its pivot. Each occurrence
of a word sends the two words before and after it to the word's partition, cut off at words that are rarer, at words too rare
for any phrase and at piece ends: what is left is all that a phrase with this pivot can hold. Equal fragments of a task travel as
one with a number. A partition mines its pivots one block after the other: pairs first, then triples of frequent pairs only.

The order of words comes from ``SLOTS`` tallies of word hashes, a broadcast of fixed size. Words that share a tally count as more
frequent than they are, which moves pivots and balance, never a count. A pivot whose tally exceeds a share of all words is dealt to
several groups, whose counts are added up after.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

SLOTS = 1 << 21
CHUNK = 1 << 20  # words that a task looks at together
SLICE = 4 << 20  # characters of a long text that are split at a time
BLOCK = 1 << 18  # fragments that are mined together, unless one group has more
GROUP = 1 << 17  # occurrences of a pivot that one group takes, at most
ROUTE_PARTS = 64  # parts of a language in which the best phrases are found before they meet

END = b"."  # stands for every piece end
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
_GAP = re.compile(r"[ \t.,;:!?\n-\r]").search

COUNTS = "lang string, word string, f long"
ROUTED = "lang string, pivot string, slot long, groups int, grp int, fragments string"
PARTIAL = "lang string, phrase string, n_words int, groups int, a long"


def words_of(text: str) -> list[bytes]:
    """The words of a text in lower case (A-Z only), with END between pieces."""
    return text.encode().lower().translate(_ENDS).replace(END, b" . ").split()


def _slices(text: str):
    """A long text in parts that end at a character between words."""
    at = 0
    while len(text) - at > SLICE:
        gap = _GAP(text, at + SLICE)
        if not gap:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:]


class Stream:
    """The words of many documents as one sequence per language, handed on in chunks.

    A chunk (lang, words, lo, hi) has to be looked at for the words lo to hi; it has two words more on either side where the
    sequence goes on.
    """

    def __init__(self):
        self.held: dict[str, list[bytes]] = {}
        self.lead: dict[str, int] = {}
        self.size = 0

    def add(self, lang: str, text: str):
        have = self.held.setdefault(lang, [])
        for part in _slices(text):
            words = words_of(part)
            have.extend(words)
            self.size += len(words)
            if self.size >= CHUNK:
                yield from self.flush(False)
        have.append(END)

    def flush(self, last: bool = True):
        for lang, words in self.held.items():
            lo, hi = self.lead.get(lang, 0), len(words) if last else max(self.lead.get(lang, 0), len(words) - 2)
            if hi > lo:
                yield lang, words, lo, hi
            keep = max(0, hi - 2)
            self.lead[lang] = hi - keep
            del words[:keep]
        self.size = 0


def _documents(batches):
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


def _chunks(batches):
    stream = Stream()
    for lang, text in _documents(batches):
        yield from stream.add(lang, text or "")
    yield from stream.flush()


def _coded(words: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the different words, and those."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def _count(batches):
    """(lang, word, occurrences) of each chunk."""
    for lang, words, lo, hi in _chunks(batches):
        codes, known = _coded(words[lo:hi])
        n = np.bincount(codes, minlength=len(known))
        real = pc.not_equal(known, END)
        known, n = known.filter(real), pa.array(n, pa.int64()).filter(real)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(known), pa.string()), known.cast(pa.string()), n], ["lang", "word", "f"])


def _slot(lang: str, words: list[bytes]) -> np.ndarray:
    """As pmod(xxhash64(lang, word), SLOTS) in Spark."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), "u8", len(words))


def tally(counts: DataFrame, least: int) -> np.ndarray:
    """Occurrences by slot: 0 where no word of the slot can occur ``least`` times."""
    slot = F.pmod(F.xxhash64("lang", "word"), F.lit(SLOTS)).cast("int")
    rows = counts.groupBy(slot.alias("slot")).agg(F.sum("f").alias("f")).where(F.col("f") >= least).toArrow()
    out = np.zeros(SLOTS, "i8")
    out[rows.column("slot").to_numpy()] = rows.column("f").to_numpy()
    return out


def fragments(order: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pivot its place and (before by two, before, after, after by two) as places, -1 where cut off.

    ``order`` rises with the frequency of the word at each place; -1 stands for a cut. Words before the pivot must be more
    frequent, words after it at least as frequent: so each phrase has one occurrence of one word that owns it.
    """
    n = len(order)
    padded = np.concatenate([[-1, -1], order, [-1, -1]])
    own = padded[2 : n + 2]
    l1 = (own >= 0) & (padded[1 : n + 1] > own)
    l2 = l1 & (padded[0:n] > own)
    r1 = (own >= 0) & (padded[3 : n + 3] >= own)
    r2 = r1 & (padded[4 : n + 4] >= own)
    at = np.flatnonzero(l1 | r1)
    at = at[(at >= lo) & (at < hi)]
    around = np.stack([np.where(has[at], at + d, -1) for has, d in ((l2, -2), (l1, -1), (r1, 1), (r2, 2))])
    return at, around


def _router(shared, unit: int):
    def run(batches):
        table = shared.value
        for lang, words, lo, hi in _chunks(batches):
            codes, known = _coded(words)
            hashes = _slot(lang, known.to_pylist())
            slots = (hashes.view("i8") % SLOTS).astype("i8")
            often = table[slots]
            end = pc.index(known, END).as_py()
            # by tally, then by hash: words of one tally are apart, and the order is the same in every task
            rank = np.minimum(often, (1 << 42) - 1) << 21 | (hashes >> np.uint64(43)).astype("i8")
            rank[often == 0] = -1
            if end >= 0:
                rank[end] = -1
            at, around = fragments(rank[codes], lo, hi)
            if not len(at):
                continue
            names = pa.array(known.cast(pa.string()))
            extended = np.append(codes, len(known))  # place -1: no word
            cells = pa.table([pa.array(codes[at])] + [pa.array(extended[x]) for x in around], ["p", "b2", "b1", "a1", "a2"])
            cells = cells.append_column("n", pa.array(np.ones(len(at), "i8"))).group_by(["p", "b2", "b1", "a1", "a2"], use_threads=False).aggregate([("n", "sum")]).sort_by("p")
            text = pa.concat_arrays([names, pa.array([""], pa.string())])
            parts = [text.take(cells.column(c).combine_chunks()) for c in ("b2", "b1", "a1", "a2")]
            one = pc.binary_join_element_wise(*parts, pc.cast(cells.column("n_sum").combine_chunks(), pa.string()), " ")
            p = cells.column("p").to_numpy()
            starts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            yield _dealt(lang, names, slots, often, p, one, starts, unit)

    return run


def _dealt(lang: str, names: pa.Array, slots: np.ndarray, often: np.ndarray, p: np.ndarray, one: pa.Array, starts: np.ndarray, unit: int) -> pa.RecordBatch:
    """A row per pivot and group with its fragments. Pivots above ``unit`` have several groups, and fragments go by their hash."""
    groups = np.maximum(1, -(-often[p[starts]] // unit))
    size = np.diff(np.append(starts, len(p)))
    of = np.repeat(groups, size)
    place = np.arange(len(p))
    grp = np.zeros(len(p), "i8")
    hot = np.flatnonzero(of > 1)
    if len(hot):
        texts = one.take(pa.array(hot)).to_pylist()
        grp[hot] = np.fromiter((xxhash.xxh32_intdigest(t.rpartition(" ")[0]) for t in texts), "i8", len(hot)) % of[hot]
        turn = np.lexsort((grp, np.cumsum(np.append(0, p[1:] != p[:-1]))))
        place, p, grp, of = place[turn], p[turn], grp[turn], of[turn]
    new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (grp[1:] != grp[:-1])))
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(p)), pa.int32()), one.take(pa.array(place)))
    columns = [pa.array([lang] * len(new), pa.string()), names.take(pa.array(p[new])), pa.array(slots[p[new]]), pa.array(of[new], pa.int32()), pa.array(grp[new], pa.int32()), pc.binary_join(lists, "\n")]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROUTED.split(", ")])


def _sums(n: np.ndarray, codes: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(codes, n, size).astype("i8") if len(codes) else np.zeros(size, "i8")


def _pairs(key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each (key, word)."""
    both = key.astype("i8") * (int(word.max(initial=0)) + 1) + word
    known, codes = np.unique(both, return_inverse=True)
    return codes, len(known)


def mine_block(langs: list[str], pivots: list[str], groups: list[int], texts: list[str], least: int, max_words: int):
    """Phrases of some whole groups: (lang, phrase, n_words, groups, a). Groups that are their pivot's only one drop what is too rare."""
    lines = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
    key = pc.list_parent_indices(lines).to_numpy()
    cells = pc.list_flatten(pc.split_pattern(pc.list_flatten(lines), " "))
    coded = cells.dictionary_encode()
    grid, known = coded.indices.to_numpy().reshape(-1, 5), coded.dictionary
    numbers, value = np.unique(grid[:, 4]), np.zeros(len(known), "i8")
    value[numbers] = pc.cast(known.take(pa.array(numbers)), pa.int64()).to_numpy()
    n = value[grid[:, 4]]
    empty = pc.index(known, "").as_py()
    names, whole = known.to_pylist(), np.array(groups)[key] == 1
    found = []

    def count(rows: np.ndarray, columns: tuple[int, ...]) -> np.ndarray:
        """Of these rows those whose phrase is frequent, or may be; each phrase is added to ``found``."""
        codes = key[rows]
        for c in columns:
            codes, size = _pairs(codes, grid[rows, c])
        if not len(rows):
            return rows
        total = _sums(n[rows], codes, size)
        keep = (total[codes] >= least) | ~whole[rows]
        first = np.full(size, -1)
        first[codes[::-1]] = rows[::-1]
        for row, a in zip(first.tolist(), total.tolist()):
            if a >= least or not whole[row]:
                k = int(key[row])
                before = [names[grid[row, c]] for c in columns if c < 2]
                after = [names[grid[row, c]] for c in columns if c >= 2]
                found.append((langs[k], " ".join([*before, pivots[k], *after]), len(columns) + 1, groups[k], a))
        return rows[keep]

    has = lambda c: grid[:, c] != empty
    every = np.arange(len(grid))
    left, right = count(every[has(1)], (1,)), count(every[has(2)], (2,))
    if max_words >= 3:
        count(left[has(0)[left]], (0, 1))
        count(np.intersect1d(left, right, assume_unique=True), (1, 2))
        count(right[has(3)[right]], (2, 3))
    return found


def _miner(least: int, max_words: int):
    names = [c.split()[0] for c in PARTIAL.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]

    def out(rows):
        langs, pivots, groups, texts = zip(*rows)
        found = mine_block(langs, pivots, groups, ["\n".join(t) for t in texts], least, max_words)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 5, types)], names)

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for lang, pivot, groups, grp, text in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (lang, pivot, grp) != last:  # a group may come in several rows, which stand together
                    if size >= BLOCK:
                        yield out(rows)
                        rows, size = [], 0
                    rows.append((lang, pivot, groups, [text]))
                    last = (lang, pivot, grp)
                else:
                    rows[-1][3].append(text)
                size += text.count("\n") + 1
        if rows:
            yield out(rows)

    return run


def phrases(docs: DataFrame, least: int = 10, max_words: int = 3, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): lang, word, f of every word, and lang, phrase, n_words, a of every phrase of 2 to ``max_words`` (2 or 3)
    words that occurs ``least`` times or more. Both are tables in the shared folder."""
    if max_words not in (2, 3):
        raise ValueError("phrases have 2 to 3 words")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = stage_table(rows.mapInArrow(_count, COUNTS).groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    often = tally(words, least)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit = int(min(GROUP, max(1 << 12, often.sum() // (4 * tasks))))
    routed = rows.mapInArrow(_router(spark.sparkContext.broadcast(often), unit), ROUTED)
    near = routed.repartition(tasks, "slot", "grp").sortWithinPartitions("lang", "pivot", "grp")
    mined = stage_table(near.select("lang", "pivot", "groups", "grp", "fragments").mapInArrow(_miner(least, max_words), PARTIAL), "mined")
    split = mined.where("groups > 1").groupBy("lang", "phrase", "n_words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    whole = mined.where("groups = 1").select("lang", "phrase", "n_words", "a")
    return words, stage_table(whole.unionByName(split), "phrases")


def score(words: DataFrame, found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase by its lowest cut. Exact for counts below 10^16."""
    w = F.split("phrase", " ")
    cut = lambda k: F.struct(F.array_join(F.slice(w, F.lit(1), k), " ").alias("l"), F.array_join(F.slice(w, k + 1, F.size(w) - k), " ").alias("r"), k.alias("k"))
    cuts = found.withColumn("_cut", F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - 1), cut)))
    sides = cuts.select("lang", "phrase", "a", F.col("_cut.k").alias("k"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_cut.l").alias("part")), F.struct(F.lit(1).alias("side"), F.col("_cut.r").alias("part")))).alias("_s"))
    sides = sides.select("lang", "phrase", "a", "k", "_s.side", "_s.part")
    known = words.select("lang", F.col("word").alias("part"), "f").unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    both = sides.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    both = both.withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(16,0)) * cast(a as decimal(16,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    low = F.min(F.struct("score", "k", "l", "r")).alias("_low")
    return both.groupBy("lang", "phrase", "a").agg(low).select("lang", "phrase", "a", "_low.l", "_low.r", "_low.score")


def collocations(docs: DataFrame, least: int = 10, max_words: int = 3, inside: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words; A-Z are lowered. ``a`` counts the
    phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all words of the language. A phrase goes if a phrase of one word more
    holds it and occurs ``inside`` percent as often or more (a longer one that does implies one of one word more).

    Null texts are empty, a null language is ``und``; a language without phrases has no row. Ties of the score go by count, then by the
    phrase's bytes. Repeated rows count again. Long texts are taken in slices whose words go on from one to the next. Columns
    other than text and language are not looked at. A frequent word's occurrences, a frequent phrase and a large language are no
    one task's: pivots are split, counts are added up before they meet, and the best of parts of a language are chosen first.
    """
    words, found = phrases(docs, least, max_words, lang_col, text_col)
    w = F.split("phrase", " ")
    shorter = F.when(F.size(w) > 2, F.array_distinct(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))))
    longer = found.select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("_a")).groupBy("lang", "phrase").agg(F.max("_a").alias("_a"))
    kept = score(words, found).join(longer, ["lang", "phrase"], "left").where(F.col("_a").isNull() | (100 * F.col("_a") < inside * F.col("a"))).drop("_a")
    best = [F.desc("score"), F.desc("a"), "phrase"]
    part = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(ROUTE_PARTS)))
    part = part.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Substring deduplication by line hashing.

Lines are normalised (lower case, runs of white space as one space, trimmed) and hashed. The earliest line of each
digest, by doc_id and then place, stays; the others are removed, with their offsets in the original text retained.
Lines of fewer than ``MIN_WORDS`` words always stay, as in the SQL of the query. Words are what spaces part, so a line
in a script without spaces is one word at any length. ``min_words=1`` removes every line that repeats, these too.

Lower case is taken letter by letter, as in the SQL: a capital sigma is the same letter at the end of a word and inside
it, and a dotted capital I is an i. Letters that are newer than the SQL engine's tables have a lower case here only.

``unit`` takes paragraphs or sentences instead of lines (:data:`UNITS`), for passages that repeat inside longer lines.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, stage_table

MIN_WORDS = 5
#: What stands between two units; a removed unit takes what follows it along.
UNITS = {"line": r"\n", "paragraph": r"\n(?:[ \t]*\n)+", "sentence": r"(?<=[.!?])[ \n]+"}


def units(docs: DataFrame, id_col: str, text_col: str, min_words: int, unit: str = "line") -> DataFrame:
    """Units that can repeat: doc_id, line (from 0), digest."""
    low = F.lower(F.translate(F.col(text_col), "\t\x0b\x0c\r\u0130\u03a3", "    i\u03c3"))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(low, UNITS[unit])).alias("line", "line_text"))
    one_space = F.regexp_replace("line_text", " +" if unit == "line" else "[ \n]+", " ")
    several = F.contains("line_text", F.lit("  ")) if unit == "line" else F.lit(True)
    lines = lines.select("doc_id", "line", F.trim(F.when(several, one_space).otherwise(F.col("line_text"))).alias("norm")).where(F.col("norm") != "")
    if min_words > 1:
        lines = lines.where(F.length(F.substring_index("norm", " ", min_words - 1)) < F.length("norm"))
    return lines.select("doc_id", "line", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("digest"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, unit: str = "line") -> DataFrame:
    """doc_id and ``lines``, the sorted numbers of its units that repeat an earlier one; only documents with some."""
    rows = stage_table(units(docs, id_col, text_col, min_words, unit).where("doc_id is not null"), "digests")
    first = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line")).alias("first")).where("n > 1").select("digest", "first")
    first = stage_table(first, "firsts")  # so that both sides of the join are shuffles, which Spark may split for a hot line
    again = rows.join(first, "digest").where(F.struct("doc_id", "line") > F.col("first"))
    gone = stage_table(again.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")), "repeats")
    drop_table(rows, first)
    return gone


def _cut(pattern):
    """Texts without the units whose numbers are given; a text's length bounds the work."""
    gap = re.compile(pattern)

    def one(text, lines):
        ends = [m.end() for m in gap.finditer(text)]
        n = len(ends) + 1
        if not lines:
            return n, [], text
        starts, ends, gone = [0, *ends], [*ends, len(text)], set(lines)
        kept = "".join(text[s:e] for k, (s, e) in enumerate(zip(starts, ends)) if k not in gone)
        if n - 1 in gone:  # the last unit that stays has nothing to be parted from
            last = max((k for k in range(n) if k not in gone), default=None)
            if last is not None:
                kept = kept[: len(kept) - (ends[last] - starts[last])] + gap.split(text[starts[last] : ends[last]])[0]
        return n, [{"start": starts[k], "end": ends[k]} for k in lines if k < n], kept

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            rows = [(0, [], None) if t is None else one(t, x) for t, x in zip(b.column("text").to_pylist(), b.column("lines").to_pylist())]
            n, spans, texts = ([r[k] for r in rows] for k in range(3))
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_removed", "removed", "text"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, unit: str = "line") -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (array of start, end), text without those lines.

    Offsets are code points of the original text; a removed line takes its line feed along. Null texts have no lines
    and stay null. Rows without an id neither remove nor lose lines; rows that share an id count as one document whose
    lines are told apart by number only, so a line number is removed from all of them. No rows give no rows.
    """
    gone = removed_lines(docs, id_col, text_col, min_words, unit)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the same join at every size: one that is broadcast while it is small says nothing about a large table
    both = texts.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "text", "lines")
    return both.mapInArrow(_cut(UNITS[unit]), "doc_id long, n_lines long, n_removed long, removed array<struct<start:int,end:int>>, text string")

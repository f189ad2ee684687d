"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of its documents in an order shuffled by a hash. A document's virtual finish time is the number
of its source's words up to and with it, divided by the source's target; a queue that is used up starts again, up to
``MAX_REPEATS`` times. Serving documents in the order of these times keeps the sources at their weights at any point. The
documents of all sources are range-sorted by them, their words added up in that order, and the mix is cut where the
total budget is used up: the document that would pass it and all after it stay out. The targets add up to the budget,
so that is near virtual time one. A queue offers nothing that starts after that time, so that no source makes up for
another's long last document: each is off its target by less than one document.

Running sums go over ranges first and then within each: hash ranges of a source for its queue, and ranges of virtual time,
which hold about equally many words, for the mix. So no task holds a source, or the mix, as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage_table

MAX_REPEATS = 3
RANGES = 4096  # hash ranges of a source, and ranges of virtual time
SEED = 17


def n_words(text):
    """Number of maximal runs of characters other than space and 09-0D (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, share: float) -> DataFrame:
    """Target words of each source: by weight, at most MAX_REPEATS times its size, the excess reshared by weight.

    The level at which sources fill (words per unit of weight) is found from running sums over sources in the order in
    which they reach their limit. One row per source goes through a single window.
    """
    by_name = Window.orderBy("no_source", "src")
    per = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    per = per.withColumn("cap", MAX_REPEATS * F.col("source_size").cast("double"))
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "src").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(whole) * share
    used, weight_left = F.coalesce(F.sum("cap").over(filled), F.lit(0.0)), F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    per = per.withColumn("level", (budget - used) / weight_left)  # if all before are full and no other is
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return per.select("no_source", "src", "source_size", budget.alias("budget"), F.least("cap", F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def _served(queued: DataFrame) -> DataFrame:
    """n and repeats: how often each row is in the mix, for rows that are in it.

    A row is offered once per lap of its queue in which at least half of it lies before virtual time one, so that each source ends at the
    side of its target that is nearer. Those that pass that time come last, in the order of their starts, so that the budget
    cuts what the shares of the sources miss least.
    """
    laps = F.least(F.lit(MAX_REPEATS), F.ceil((F.col("target") - F.col("upto") + F.col("size")) / F.col("source_size"))).cast("int")
    served = queued.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("laps", laps).where("laps > 0")
    served = served.select("n", "h", "doc_id", "size", "budget", "source_size", "target", "upto", F.explode(F.sequence(F.lit(0), F.col("laps") - 1)).alias("lap"))
    served = served.withColumn("finish", (F.col("upto") + F.col("lap") * F.col("source_size")) / F.col("target"))
    before_one = (F.col("target") - F.col("upto") - F.col("lap") * F.col("source_size") + F.col("size")) / F.col("size")  # the share of a row
    served = served.where(before_one >= 0.5).withColumn("finish", F.when(F.col("finish") > 1, 1 + F.col("finish") - F.col("size") / F.col("target")).otherwise(F.col("finish")))
    served = served.withColumn("range", F.least(F.floor(F.col("finish") * RANGES), F.lit(RANGES)))
    sums = served.groupBy("range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    sums = F.broadcast(sums.select("range", F.coalesce(before, F.lit(0)).alias("before")))
    own = F.sum("size").over(Window.partitionBy("range").orderBy("finish", "h", "doc_id", "size", "n", "lap").rowsBetween(Window.unboundedPreceding, 0))
    return served.withColumn("own", own).join(sums, "range").where(F.col("before") + F.col("own") <= F.col("budget")).groupBy("n").agg(F.count("*").alias("repeats"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.0, row_col: str | None = None) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, repeats, taken, finish.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. ``size`` counts words (null: 0); ``finish`` is the
    first virtual finish time (null in a source without words); ``taken`` = size * repeats. A document without words is
    taken once if its place in the queue is before virtual time one. Rows that repeat an id keep a row each; of rows of one
    id and size those go first whose text has the smaller hash. Same input, same result. ``share`` is the budget as a share
    of all words; no rows give no rows. ``row_col`` names a column that numbers the rows; it is given back as ``row``.
    """
    h = F.xxhash64(F.lit(SEED), F.col(id_col).cast("long"))
    src = F.col(source_col).cast("string")
    row = [] if row_col is None else [F.col(row_col).alias("row")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), src.isNull().alias("no_source"), F.coalesce(src, F.lit("")).alias("src"), n_words(F.col(text_col)).alias("size"), h.alias("h"), F.xxhash64(F.col(text_col)).alias("same"), *row)
    rows = stage_table(rows.withColumn("n", F.monotonically_increasing_id()), "sizes").withColumn("part", F.shiftrightunsigned("h", 52).cast("int"))
    parts = rows.groupBy("no_source", "src", "part").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("no_source", "src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("no_source", "src", "part", F.coalesce(before, F.lit(0)).alias("before"))
    parts = parts.join(_targets(rows, share), ["no_source", "src"])
    own = Window.partitionBy("no_source", "src", "part").orderBy("h", "doc_id", "size", "same", "n").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("upto", F.sum("size").over(own)).join(parts, ["no_source", "src", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    queued = stage_table(queued.select("n", "h", "doc_id", "size", "source_size", "target", "budget", "upto", *(["row"] if row else [])), "queues")
    empty = (F.col("size") == 0) & (F.col("upto") <= F.col("target")) & (F.col("source_size") > 0)
    repeats = F.coalesce("repeats", empty.cast("long"))
    finish = F.when(F.col("target") > 0, F.col("upto") / F.col("target"))
    out = queued.join(_served(queued), "n", "left").withColumn("repeats", repeats)
    return out.select("doc_id", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"), finish.alias("finish"), *(["row"] if row else []))


def mix(docs: DataFrame, id_col: str = "doc_id", share: float = 1.0, **columns) -> DataFrame:
    """The mixed documents with their own columns, repeats included, globally sorted by virtual finish time.

    Each row is taken as often as the plan says for it, also if it shares its id or has none: the documents are written
    with a number each, by which they meet their plan.
    """
    row, key, at = fresh(docs, "_mix_row"), fresh(docs, "_mix_id"), fresh(docs, "_mix_finish")
    docs = stage_table(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    plan = plan_mix(docs, id_col, share=share, row_col=row, **columns).where("repeats > 0")
    again = F.explode(F.sequence(F.lit(0), F.col("repeats").cast("int") - 1))
    plan = plan.select("row", "doc_id", F.coalesce("finish", F.lit(0.0)).alias("finish"), (F.col("source_size") / F.col("target")).alias("lap"), again.alias("round"))
    plan = plan.select(F.col("row").alias(row), F.col("doc_id").alias(key), (F.col("finish") + F.col("round") * F.coalesce("lap", F.lit(1.0))).alias(at))
    out = docs.join(plan, row)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartitionByRange(tasks, at, key, row).sortWithinPartitions(at, key, row).select(*(F.col(f"`{c}`") for c in docs.columns if c != row))

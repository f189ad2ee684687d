"""From raw documents to token files: the corpus operators as stages, each written as Parquet and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; the last returns a row per document of the token store.

In all stages null and empty texts have no words and rows without an id are kept apart; other columns pass through.
Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import decontaminate, mixing, quality, simhash, token_store
from loomery.llm.common import drop_table, fresh, read, stage_table
from loomery.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects. It learns from the labelled ones among the stage's documents.

    An empty text is judged like any other; without labels nothing is rejected. Rows are judged one by one, so copies
    stay or go together.
    """
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels"), lambda c: quality.folds(c, 5) != 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts with a Jaccard similarity of 0.8 or more by five-word shingles.

    Documents without an id stay, whatever their text. Rows that share an id are one document: they stay or go together.
    """
    found = simhash.near_texts(docs, sketch=simhash.SIMILAR)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(fresh(docs, "_gone"))).distinct()
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs. Without items all stay."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), max_share=0.0)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, repeats included, in the order of their virtual finish times.

    Each row has its own place in its source's queue, also if it repeats an id or has none.
    """
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store, in ascending order of ids as its format has it, and returns what is read back from it.

    A null text is the end id alone; a document that the mix repeats is stored as often.
    """
    path = token_store.new_store_path(spark)
    token_store.write_store(docs, path, tokenizer_path())
    return token_store.read_store(spark, path)


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixture), ("token_output", token_output)]

#: A learned classifier, fingerprints and a tokenizer are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, before = stage_table(stage(spark, docs, sf_dir), name), docs
        drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)

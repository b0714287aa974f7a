"""A corpus pipeline: toxicity filter, near-duplicate removal, decontamination, secret redaction, packing.

All stages take documents with nulls in any column, empty and very long texts and repeated rows; an empty table gives an
empty one. A null text counts as empty and stays null. Columns that a stage does not decide on pass through whatever their
names; rows go by their id and text together, so several texts under one id, or under none, are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import bin_packing, decontaminate, ngram_join, secret_scan, toxicity
from quarrylight.llm.shared import fresh, row_keys, small_batches, staged

#: SQL has no means for MinHash, Aho-Corasick or packing; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """(document, ``names``): the other columns as one, so that no name of theirs meets one of an operator."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    (own,) = fresh(docs, "whole")
    return docs.select(F.struct(*rest, F.lit(True).alias(own)).alias("document"), *names)


def _whole(docs: DataFrame, parted: DataFrame, *names: str, **now: Column) -> DataFrame:
    """The columns of ``docs`` again, ``names`` from ``parted``; ``now`` replaces some."""
    at = lambda c: now[c] if c in now else F.col(c) if c in names else F.col("document").getField(c)
    return parted.select(*[at(c).alias(c) for c in docs.columns])


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go. It learns from the labelled documents outside the held-out third.

    Without labels of both kinds the seed lexicon decides alone. Equal texts get equal scores, so copies go together.
    """
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _whole(docs, toxicity.score_toxicity(_apart(docs, "text"), model).where("predicted = 0"), "text")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that with the smallest id, one without an id of its own before others.

    Empty texts are one group. Of rows that repeat both id and text, the first in the order of their columns stays.
    """
    named = row_keys(_apart(docs, "doc_id", "text"), "row")
    groups, _ = ngram_join.join(named, key="row")
    gone = staged(groups.where("row <> class_id").select("row").distinct(), "near-duplicates")
    kept = named.join(gone, "row", "left_anti")
    again = staged(kept.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row"), "repeated")
    if not again.isEmpty():
        one = F.min_by(F.struct("document", "doc_id", "text"), F.to_json("document"))
        once = kept.join(again, "row", "left_semi").groupBy("row").agg(one.alias("one")).select("one.*")
        kept = kept.join(again, "row", "left_anti").select("document", "doc_id", "text").unionByName(once)
    return _whole(docs, kept, "doc_id", "text")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (of under five tokens: that are one) go; items and documents without an id or a text count like others."""
    named = row_keys(_apart(docs, "doc_id", "text"), "row")
    found = decontaminate.contaminated(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="row", least_within=5)
    gone = staged(found.select("row").distinct(), "contaminated")
    return _whole(docs, named.join(gone, "row", "left_anti"), "doc_id", "text")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span that the secret scan finds is replaced by a mark; n_chars, if there is such a column, follows where the text changed."""
    found = secret_scan.scan(_apart(docs, "text").withColumn("whole", F.col("text")))
    text = secret_scan.redacted(F.col("whole"), F.col("spans"))
    now = {"text": text}
    if "n_chars" in docs.columns:
        count = F.char_length(text).cast(docs.schema["n_chars"].dataType)
        now["n_chars"] = F.when(F.size("spans") > 0, count).otherwise(F.col("document.n_chars"))
    return _whole(docs, found, **now)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of at most 1024 tokens; an empty text still has its end."""
    return bin_packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_civil),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", keep_uncontaminated),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

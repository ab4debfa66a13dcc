"""The corpus pipeline: five stages over documents, each written and read before the next.

A stage takes (spark, docs, sf_dir), works on all rows it gets, and returns a DataFrame; all
but the last return the columns of documents. Null texts count as empty texts; repeated rows,
empty tables and further columns are no hindrance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import packing, quality, secrets, similar, suffix
from plumbline.llm.common import aside, stored
from plumbline.llm.queries import BPE, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier draws."""
    docs, back = aside(docs, ["doc_id", "text"])
    rows = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    found = quality.resampled(docs, table(spark, sf_dir, "labels"))
    kept = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("draw").alias("_draw")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.crc32(F.col("_text").cast("binary")) == F.col("_draw"))
    return back(rows.join(kept, same, "left_semi"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Near copies share four fifths of their five-word shingles or more; op5's fingerprints have
    no bound of bits that all of those keep, so ``similar`` finds them from the shingles.
    Documents without a doc_id stay; of rows with equal doc_id and text one stays.
    """
    docs, back = aside(docs, ["doc_id", "text"])
    again = similar.similar_groups(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).distinct()
    tie = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    once = docs.join(again, (F.col("doc_id").cast("long") == F.col("_id")) & (tie == F.col("_tie")), "left_anti")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null")
    return back(once if repeated.isEmpty() else once.dropDuplicates(["doc_id", "text"]))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; bytes of a cut character go with it.

    A document of which nothing is left goes, unless it was empty before.
    """
    docs, back = aside(docs, ["doc_id", "text", "n_chars"])
    found = suffix.deduplicated(docs, as_text=True).where("n_removed > 0")
    found = found.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("kept").alias("_kept")).dropDuplicates(["_id", "_tie"])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & ((F.col("_tie") == 0) | (F.col("_tie") == F.crc32(F.col("text").cast("binary"))))
    joined = docs.join(found, same, "left")
    done = joined.withColumn("text", F.coalesce("_kept", "text")).where("_kept is null or length(text) > 0")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_kept").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return back(done)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised pieces of all documents with their places in sequences."""
    return packing.best_fit(docs, BPE)


STAGES = [("quality", good), ("simhash", distinct), ("suffix", unrepeated), ("secrets", without_secrets), ("packing", packed)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

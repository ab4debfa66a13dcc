"""A quality classifier by importance resampling over hashed n-grams.

Two generative models give each of ``BUCKETS`` buckets of word uni- and bigrams a probability:
the target model from labelled good documents, the raw model from all documents. A document's
log weight is the sum of the log ratios over its n-grams, and Gumbel top-k draws documents
without replacement in proportion to their weights: those with the largest log weight plus
Gumbel noise, which hangs on doc_id and text only, so a lost task draws the same again.

How many are drawn follows from the labels: ``threshold`` is the log weight that parts good
and bad labelled documents best, on those labelled that the target model hasn't seen, and as many are drawn as all documents have log weights
from it on. The models' target and the threshold are fitted on at most ``LABELLED`` labelled
rows (by hash of doc_id); counts, weights and the draw cover all documents.

Cases: a null text is an empty text, and texts without words have weight 0; repeated rows get
equal keys and are drawn or not together, as are all that are level with the last one drawn;
labels that are null, repeated or of unknown documents are no hindrance (a document is good if
each of its labels is); without labelled documents of both kinds, or with an empty table, all
documents are drawn; texts of any length are taken whole; further columns of documents and labels,
whatever their names, are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, doc_texts, hashed_sample, stored

BUCKETS = 1 << 14
LABELLED = 20_000
#: Added to each bucket's count in the raw model.
SMOOTH = 0.5
#: The threshold counts a good document that is lost as so many bad ones that pass.
LOSS = 5
SEED = 11


def ngrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    words = np.fromiter(map(crc32, text.encode().split()), np.uint64)
    pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate([words * np.uint64(0x165667B19E3779F9), pairs]) if len(words) else words
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(good, bucket, n): n-gram counts of all documents, and for good those of the labelled good ones."""

    def run(batch: pa.RecordBatch) -> dict:
        total = np.zeros((2, buckets), np.int64)
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            n = np.bincount(ngrams(text, buckets), minlength=buckets) if len(text) > buckets else None
            for row in (0, 1) if label == 1 else (0,):
                if n is None:
                    np.add.at(total[row], ngrams(text, buckets), 1)
                else:
                    total[row] += n
        good, bucket = np.nonzero(total)
        return {"good": good, "bucket": bucket, "n": total[good, bucket]}

    got = arrow_map(texts.select("text", "label"), run, "good int, bucket int, n long")
    return got.groupBy("good", "bucket").agg(F.sum("n").alias("n"))


def log_ratio(rows: list, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's log probability in the target model less that in the raw model.

    The target's counts are smoothed by as many draws from the raw model, so what the target
    has seldom shown weighs little.
    """
    n = np.zeros((2, buckets))
    for good, bucket, k in rows:
        n[good, bucket] += k
    raw = (n[0] + SMOOTH) / (n[0] + SMOOTH).sum()
    return np.log((n[1] / n[1].sum() + raw) / 2) - np.log(raw) if n[1].any() else np.zeros(buckets)


def best_threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The smallest cut that keeps ``LOSS`` times the share of good ones lost plus that of bad ones passed least."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order].astype(bool)
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    error = LOSS * lost + passed
    error[1:-1][w[1:] == w[:-1]] = np.inf
    k = int(np.flatnonzero(error == error.min())[0])
    return -np.inf if k == 0 else np.inf if k == len(w) else float((w[k - 1] + w[k]) / 2)


def weighed(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED) -> tuple[DataFrame, float]:
    """(doc_id, label, fold, log_weight, draw, gumbel_key) of each document, and the threshold."""
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)).alias("label"),
        F.max("quality").alias("_any"),
    )
    # toxic good prose is neither a target nor a bad example
    marks = hashed_sample(marks.where("label = 1 or _any = 0"), "_doc", labelled).select("_doc", "label", F.pmod(F.xxhash64("_doc", F.lit(SEED)), F.lit(2)).cast("int").alias("fold"))
    sample = spark.createDataFrame(marks.collect(), "_doc long, label int, fold int")  # at most ``labelled`` rows
    texts = doc_texts(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "label", "fold")
    ratio = log_ratio(counts(texts.withColumn("label", F.when(F.col("fold") == 0, F.col("label"))), buckets).collect(), buckets)  # at most two rows for each bucket

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch["doc_id"], "label": batch["label"], "fold": batch["fold"], "log_weight": [round(float(ratio[ngrams(t, buckets)].sum()), 9) for t in batch["text"].to_pylist()], "draw": [crc32(t.encode()) for t in batch["text"].to_pylist()]}

    rows = arrow_map(texts, run, "doc_id long, label int, fold int, log_weight double, draw long")
    uniform = (F.pmod(F.xxhash64("doc_id", "draw", F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = stored(rows.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    # rows of one doc_id count once, by the least of their texts: at most ``labelled`` rows
    seen = np.array(rows.where("fold = 1").groupBy("doc_id").agg(F.min("log_weight"), F.min("label")).drop("doc_id").collect(), float).reshape(-1, 2)
    both = len(seen) and 0 < seen[:, 1].sum() < len(seen)
    return rows, best_threshold(seen[:, 0], seen[:, 1]) if both else -np.inf


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest value of a stored table, by counts of ever finer bins; no row moves."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        width = (high - low) / 4096
        if low == high:
            return low
        if low + width == low or high - width == high:  # few values are left
            for value, n in sorted(rows.where(F.col(column).between(low, high)).groupBy(column).count().collect(), reverse=True):
                if k <= n:
                    return value
                k -= n
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(4095))
        bins = dict(rows.where(F.col(column).between(low, high)).groupBy(place.cast("int").alias("b")).agg(F.struct(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("z")).alias("s")).collect())
        for b in sorted(bins, reverse=True):
            if k <= bins[b].n:
                low, high = bins[b].a, bins[b].z
                break
            k -= bins[b].n


def resampled(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, labelled: int = LABELLED) -> DataFrame:
    """doc_id, log_weight, gumbel_key, draw (the text's CRC-32) and kept of each row of ``docs``.

    kept: whether Gumbel top-k draws it.
    """
    rows, threshold = weighed(docs, labels, buckets, labelled)
    k = rows.where(F.col("log_weight") >= F.lit(threshold)).count()
    least = kth_largest(rows, "gumbel_key", k) if k else np.inf
    return rows.select("doc_id", "log_weight", "gumbel_key", "draw", (F.col("gumbel_key") >= F.lit(float(least))).alias("kept"))

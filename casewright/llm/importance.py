"""Quality classifier by importance resampling: hashed n-gram models of target and raw text.

Both models are bags of hashed byte n-grams. A document's log importance weight is the sum over its
n-grams of log(target share / raw share); documents are sampled without replacement by the largest
weights with Gumbel noise. As raw text holds target text at a known rate, the weight times that
rate is the chance that a document is of the target kind, and its sum the size of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import global_rank
from .scratch import Scratch, sized
from .words import bytes_of, mix, slices

#: Buckets of hashed n-grams, a fixed size of both models.
BUCKETS = 1 << 16
#: Length of an n-gram in bytes.
GRAM = 4
#: Count added to each bucket of the raw model.
ADDED = 0.5
#: Weight of the raw model in the target's, relative to the target's counts.
PRIOR = 0.3


def grams(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice, bucket of every n-gram, text of every n-gram); a shorter text has one n-gram."""
    places = np.array([1, 257, 66_049, 16_974_593], np.uint64)[:GRAM]
    for part in slices(batch, "text"):
        data, offsets = bytes_of(part.column("text"))
        length = np.diff(offsets)
        padded = np.concatenate([data, np.zeros(GRAM, np.uint8)]).astype(np.uint64)
        value = sum(places[k] * padded[k: len(data) + k] for k in range(GRAM))
        text = np.repeat(np.arange(len(length)), length)
        # n-grams that would run over the end of a text are left out, but for its first.
        begin = np.arange(len(data)) - offsets[:-1][text]
        inside = (begin + GRAM <= length[text]) | (begin == 0)
        bucket = (mix(value[inside]) >> np.uint64(48)).astype(np.int64)
        yield part, bucket, text[inside]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(target, bucket, n) over whole texts, counted in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for part, bucket, text in grams(batch):
                target = part.column("target").to_numpy(zero_copy_only=False)[text].astype(np.int64)
                counts += np.bincount(target * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        for target in (0, 1):
            at = np.flatnonzero(counts[target])
            yield pa.record_batch(
                [pa.array(np.full(len(at), target)), pa.array(at), pa.array(counts[target][at])], names=["target", "bucket", "n"]
            )

    counted = docs.select("text", "target").mapInArrow(run, "target long, bucket long, n long")
    return counted.groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(target share / raw share) of each bucket; raw text includes the target's."""
    table = np.zeros((2, BUCKETS))
    rows = counts.toPandas()  # two rows a bucket at most
    table[rows["target"], rows["bucket"]] = rows["n"]
    raw = table.sum(axis=0) + ADDED
    raw /= raw.sum()
    seen = max(table[1].sum(), 1.0)
    return np.log((table[1] + PRIOR * seen * raw) / ((table[1].sum() + PRIOR * seen) * raw))


def gumbel(key: Column, seed: str) -> Column:
    """Standard Gumbel noise fixed by key and seed."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def importance_sample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: str = "quality = 1 AND toxic = 0",
    judged: str = "quality IS NOT NULL", size: int | None = None, seed: str = "sample",
) -> DataFrame:
    """``docs`` with log_weight, noisy (with Gumbel noise) and kept (among the ``size`` largest).

    All labelled documents that are ``good`` make the target model, all documents the raw one. The
    rate of target text is the share of good ones among the ``judged`` labels; ``size`` defaults to
    the expected number of target documents. A document with several labels is good if one of them
    is. Null, empty and blank texts have weight 0 and are never kept. Equal rows get equal weights
    and the same noise; which of them the sample ends with is arbitrary. Without any good label
    nothing is kept. Columns of ``docs`` named like the three results are replaced.
    """
    spark = docs.sparkSession
    with Scratch(spark, "importance") as scratch:
        marks = labels.select(F.col(key).cast("long").alias("key"), F.expr(good).alias("good"), F.expr(judged).alias("judged"))
        marks = marks.groupBy("key").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max("judged").alias("judged"))
        marks = scratch.stage(marks, "marks")
        n, n_good = marks.agg(F.count(F.when(F.col("judged"), 1)), F.count(F.when(F.col("good") & F.col("judged"), 1))).first()
        rate = n_good / n if n else 0.0
        base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
        known = base.join(marks.where("good").select("key", F.lit(True).alias("target")), "key", "left")
        counts = scratch.stage(gram_counts(known.select("text", F.coalesce("target", F.lit(False)).alias("target"))), "counts")
        ratios = spark.sparkContext.broadcast(log_ratios(counts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, bucket, text in grams(batch):
                    weight = np.bincount(text, ratios.value[bucket], minlength=part.num_rows)
                    yield pa.record_batch([part.column("key"), part.column("tk"), pa.array(weight)], names=["key", "tk", "log_weight"])

        filled = F.col("text").rlike(r"[^\x20\x09-\x0D]")
        scored = base.where(filled).withColumn("tk", F.xxhash64("text")).select("key", "tk", "text")
        scored = scored.mapInArrow(run, "key long, tk long, log_weight double")
        scored = scratch.stage(scored.withColumn("noisy", F.col("log_weight") + gumbel(F.struct("key", "tk"), seed)), "scored")
        if size is None:
            chance = F.least(F.lit(1.0), rate * F.exp(F.least(F.col("log_weight"), F.lit(50.0))))
            size = int(round(scored.agg(F.sum(chance)).first()[0] or 0)) if rate else 0
        ranked = global_rank(scored, [F.col("noisy").desc(), F.col("key"), F.col("tk")])
        return scratch.result(ranked.select(
            F.col("key").alias(key), "tk", "log_weight", "noisy", (F.col("rank") <= size).alias("kept")
        ))


def kept_documents(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the sample keeps; equal rows stay together if one of them is kept."""
    wanted = sample.where("kept").select(F.col(key).alias("__key"), F.col("tk").alias("__tk")).distinct()
    own = docs.withColumn("__own", F.xxhash64(F.col(text).cast("string")))
    match = F.col(key).cast("long").eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__tk"))
    return own.join(sized(wanted), match, "left_semi").select(*docs.columns)

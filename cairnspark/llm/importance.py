"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Both models are bags of hashed words and word pairs (WORD_BUCKETS and PAIR_BUCKETS of them, apart, so that pairs don't
drown words).  The raw model counts every document; the target model counts the labelled documents of good quality that
aren't toxic, at most TARGET_DOCS of them, chosen by a hash of their id.  A document's log weight is the sum, over its
features, of the log ratio of the two models without the document's own counts, so that it is no better for having been a
target; PSEUDO counts pull ratios of rare features to 1.  Adding Gumbel noise (from a hash of the id, so that reruns agree)
and taking the k largest draws k documents without replacement in proportion to their weights.  k is ``share`` of all
documents; by default the share that the labels give to good ones.

Defined results: a null text has no features and log weight 0; rows with equal doc_id are scored each on its own and share
their noise; ties in the key go to the smaller id, null first, and then to the row that was read first; without any label of the target kind all weights are equal and the draw
is uniform; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, id_key, materialise, mix, slices, strings, table, words_of

WORD_BUCKETS, PAIR_BUCKETS, TARGET_DOCS, PSEUDO, FAN_IN = 1 << 19, 1 << 18, 20_000, 10.0, 4
BUCKETS = WORD_BUCKETS + PAIR_BUCKETS
#: Bytes of text whose features a worker holds at a time; they take some 30 times as much.
SLICE = 1 << 20


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and then of all word pairs of some texts, and the text of each."""
    ends, words = words_of(texts)
    word = mix(hash_words(words.dictionary))[np.asarray(words.indices)] if len(words) else np.zeros(0, np.uint64)
    n = np.diff(ends)
    pair = mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:])
    owner = np.repeat(np.arange(len(n)), n)
    inside = owner[:-1] == owner[1:]
    every = np.concatenate((word % np.uint64(WORD_BUCKETS), pair[inside] % np.uint64(PAIR_BUCKETS) + np.uint64(WORD_BUCKETS)))
    return every.astype(np.int64), np.concatenate((owner, owner[:-1][inside]))


def targets_in(ids: pa.Array, target: np.ndarray) -> np.ndarray:
    return np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), target) & np.asarray(ids.is_valid())


def counts_in(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The task's counts of each bucket, in all texts and in those of the target, as one row."""
    target, total = shared.value, np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        texts, chosen = strings(batch.column(1)), targets_in(batch.column(0), target)
        for a, b in slices(texts, SLICE):
            every, row = hashed(texts[a:b])
            total[0] += np.bincount(every, minlength=BUCKETS)
            total[1] += np.bincount(every[chosen[a:b][row]], minlength=BUCKETS)
    yield pa.record_batch([pa.array([packed(total)], pa.binary())], names=["counts"])


def packed(counts: np.ndarray) -> bytes:
    return counts.astype("<i8").tobytes()


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BUCKETS, dtype=np.int64)
    for batch in batches:
        for value in batch.column(0):
            total += np.frombuffer(value.as_buffer(), "<i8")
    yield pa.record_batch([pa.array([packed(total)], pa.binary())], names=["counts"])


def models(docs: DataFrame, target) -> np.ndarray:
    """Counts of the raw and the target model by bucket: one row of 12 MiB a task, added up by a tree of tasks."""
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: counts_in(it, target), "counts binary"))
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = materialise(rows.coalesce(parts).mapInArrow(added, "counts binary"))
    return sum((np.frombuffer(r.counts, "<i8") for r in rows.collect()), np.zeros(2 * BUCKETS, dtype=np.int64)).reshape(2, BUCKETS)


def target_ids(labels: DataFrame, most: int = TARGET_DOCS) -> np.ndarray:
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(3), F.col("doc_id")), "doc_id").limit(most)
    return np.sort(np.array([r.doc_id for r in good.collect()], dtype=np.int64))


def weights_in(batches: Iterator[pa.RecordBatch], shared_counts, shared_target) -> Iterator[pa.RecordBatch]:
    (raw, wanted), target = shared_counts.value, shared_target.value
    share = wanted.sum(dtype=np.int64) / max(1, raw.sum(dtype=np.int64))
    for batch in batches:
        texts, chosen = strings(batch.column(1)), targets_in(batch.column(0), target)
        for a, b in slices(texts, SLICE):
            every, row = hashed(texts[a:b])
            key, times = np.unique(row << 20 | every, return_counts=True)
            doc, bucket = key >> 20, key & ((1 << 20) - 1)
            if share:
                ratio = np.log((wanted[bucket].astype(float) - times * chosen[a:b][doc] + PSEUDO * share) / (raw[bucket].astype(float) - times + PSEUDO) / share)
            else:
                ratio = np.zeros(len(key))
            yield pa.record_batch([batch.column(0)[a:b], pa.array(np.bincount(doc, ratio * times, b - a).astype(float)), pa.array(np.bincount(row, minlength=b - a))], names=["doc_id", "log_weight", "n_features"])


#: Values that the driver sorts at most.
FEW = 50_000


def kth(rows: DataFrame, column: str, k: int) -> float:
    """The k-th smallest value of ``column`` (no nulls; 1 <= k <= rows): quantiles bracket it until few rows are left between them."""
    n, value = rows.count(), F.col(column)
    while n > FEW:
        low, high = rows.select(F.percentile_approx(column, [max(0.0, k / n - 1e-3), min(1.0, k / n + 1e-3)], 10_000).alias("q")).first().q
        below, at, upto = rows.agg(*(F.sum(x.cast("long")) for x in (value < low, value <= low, value <= high))).first()
        if k <= below:
            rows, n = rows.where(value < low), below
        elif k <= at:
            return low
        elif k <= upto:
            rows, k, n = rows.where((value > low) & (value <= high)), k - at, upto - at
        else:
            rows, k, n = rows.where(value > high), k - upto, n - upto
    return sorted(r[0] for r in rows.select(column).collect())[k - 1]


def top_k(rows: DataFrame, k: int, key: str = "key") -> DataFrame:
    """``rows`` (key, doc_id, row) with ``kept``: true for the ``k`` rows of largest ``key``, ties to the smaller doc_id (null first), then the smaller row.

    The cut is found by value and not by sorting, column by column, so that equal keys gather nowhere either.
    """
    k = min(k, rows.count())
    if k <= 0:
        return rows.withColumn("kept", F.lit(False))
    kept, tied, left = F.lit(False), F.lit(True), k
    ordered = rows.withColumns({"_1": -F.col(key), "_2": id_key(), "_3": F.col("row")})
    for column in ("_1", "_2", "_3"):
        own = ordered.where(tied)
        cut = kth(own, column, left)
        left -= own.where(F.col(column) < cut).count()
        kept, tied = kept | (tied & (F.col(column) < cut)), tied & (F.col(column) == cut)
    return ordered.withColumn("kept", kept | tied).drop("_1", "_2", "_3")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 29) -> DataFrame:
    """doc_id, n_features, log_weight, key, kept: one row per document."""
    spark = docs.sparkSession
    if share is None:
        share = labels.where("quality IS NOT NULL").agg(F.avg(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("double"))).first()[0]
        share = 0.5 if share is None else share
    target = spark.sparkContext.broadcast(target_ids(labels))
    counts = spark.sparkContext.broadcast(models(docs, target))
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: weights_in(it, counts, target), "doc_id long, log_weight double, n_features long")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    rows = materialise(weighed.withColumns({"key": F.col("log_weight") - F.log(-F.log(uniform)), "row": F.monotonically_increasing_id()}))
    return top_k(rows, round(share * rows.count())).select("doc_id", "n_features", "log_weight", "key", "kept")


def op6_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

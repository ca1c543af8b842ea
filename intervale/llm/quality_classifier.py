"""Operator 3: quality by importance resampling.

Word unigrams and bigrams are hashed into a fixed number of buckets. Bucket shares
of target texts (labelled good) and of all raw texts are two generative models; a
document's log importance weight is the sum of its n-grams' log ratios. Adding
Gumbel noise, fixed by the document's id, and keeping the k largest keys samples k
documents without replacement in proportion to their weights.

The target model is fitted on labelled rows up to ``max_target``, the smallest by
hash of doc_id, so that the label table sent to tasks has a bound. The raw model
and the k-th key cover every document.

Defined cases: a null or empty text has weight 0; rows with equal keys (repeated
rows) are kept or left together, so slightly more than k can stay; without target
rows every weight is 0 and the choice is the noise's; without any label all documents
stay, and where no label is good none does; empty input gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BUCKETS, MAX_TARGET, SEED = 10_000, 40_000, 17
_MEMO = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


def ngram_buckets(text: str, hashes: dict, buckets: int) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    words = text.lower().encode().split()
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA6B)
    return (np.concatenate([one, (two >> np.uint64(7)) & np.uint64(0xFFFFFFFF)]) % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = _Hashes(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(ngram_buckets(text.as_py() or "", hashes, buckets), minlength=buckets) if text.is_valid else 0
                sums[0] += found
                if target:
                    sums[1] += found
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "target"])

    return run


def _weigh(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            weights = [float(ratio[ngram_buckets(t.as_py() or "", hashes, len(ratio))].sum()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weights, pa.float64())], ["doc_id", "log_weight"])

    return run


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest value, by histograms that narrow down to a few values."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    inside = F.col(column).between(low, high)
    while n > few and low < high:
        width = (high - low) / bins
        if low + width == low:
            break
        number = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width))
        rows = df.where(inside).groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.b):
            if k <= r.n:
                break
            k -= r.n
        low, high, n = r.lo, r.hi, r.n
        inside = F.col(column).between(low, high)
    for value, n in sorted(df.where(inside).groupBy(column).count().collect(), reverse=True):
        k -= n
        if k <= 0:
            return value
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, max_target: int = MAX_TARGET, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, log_weight, gumbel_key, kept).

    ``labels`` has doc_id and quality. ``share`` of the documents is kept; by default
    the labelled rows' share of good ones.
    """
    if share is None:
        share = labels.agg(F.avg(F.col("quality").cast("double"))).first()[0]
        share = 1.0 if share is None else share
    target = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    target = target.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(target), "doc_id", "left").select("text", "target")
    counts = marked.mapInArrow(_count(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    model = np.zeros((2, buckets))
    for r in counts.collect():  # one row a bucket
        model[:, r.bucket] = r.raw, r.target
    shares = (model + 0.5) / (model.sum(axis=1, keepdims=True) + 0.5 * buckets)
    ratio = np.log(shares[1] / shares[0]) if model[1].any() else np.zeros(buckets)
    weights = docs.select("doc_id", "text").mapInArrow(_weigh(ratio), "doc_id long, log_weight double")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = materialize(weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "dsir")
    threshold = kth_largest(keyed, "gumbel_key", round(share * keyed.count()))
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(threshold))

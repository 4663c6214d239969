"""Quality classifier: importance resampling with hashed n-gram models.

Two bag models over BUCKETS hashed unigrams and bigrams are counted: the target model on
labelled good documents, the raw model on every document. A bigram of one token twice counts as
the n-gram "repeat", whatever the token. Both models add PRIOR to each count, so that rare buckets
have a ratio near 1. A labelled good document is scored without its own counts, as any other.

The models take n-grams as independent, so the sum of their log ratios overstates what a document
tells, the more the longer it is. The mean log ratio m is therefore calibrated: logistic regression on
the labelled rows gives P(good | m), and the importance weight is the likelihood ratio
p(m | target) / p(m | raw) = P(good | m) / P(good), with P(good) its mean over all documents.

Documents are drawn without replacement by Gumbel top-k: the k largest log weights plus Gumbel
noise. k is the target size, a parameter; left out, it is the expected number of good documents,
P(good) times all. The labelled sample is bounded: at most LABELLED rows of each label, chosen by
the hash of their ids. The counts, the weights and the draw cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import SPACES, byte_codes, chunks, hash_of, mix, prefix_hash, spans, table
from ._shared import bounded_batches, materialize, temp_name, text_of

BUCKETS = 1 << 16
PRIOR = 2.0
LABELLED = 20_000
#: Words (letters, digits, _ and bytes from 0x80) and runs of other signs are tokens.
_LETTERS = bytes(b for b in range(256) if b >= 128 or chr(b).isalnum() or b == 95)
_CLASSES = table(SPACES, words=_LETTERS)


def ngram_buckets(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each unigram and bigram of lower-cased tokens."""
    starts, ends = spans(data, offs, _CLASSES)
    one = hash_of(prefix_hash(data, byte_codes(True)), starts, ends)
    row = np.searchsorted(offs, starts, side="right") - 1
    pair = row[1:] == row[:-1]
    two = mix(one[:-1] * np.uint64(0x9FB21C651E98DF25) + one[1:])
    two[one[1:] == one[:-1]] = 0  # repeat
    two = two[pair]
    size = np.uint64(buckets)
    return np.concatenate([row, row[:-1][pair]]), (np.concatenate([one, two]) % size).astype(np.int64)


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(batch.column("text")):
                row, bucket = ngram_buckets(data, offs, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[label[lo:hi][row] == 1], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    return run


def mean_ratio(row: np.ndarray, bucket: np.ndarray, rows: int, good: np.ndarray, expected: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams and mean log ratio of each row (0 without n-grams); rows of ``own`` are left out of the target's counts."""
    n = np.bincount(row, minlength=rows)
    ratio = np.log(good + PRIOR) - np.log(expected + PRIOR)
    total = np.bincount(row, weights=ratio[bucket], minlength=rows)
    mine = own[row]
    if mine.any():
        pair, count = np.unique(row[mine] * len(good) + bucket[mine], return_counts=True)
        at, of = pair % len(good), pair // len(good)
        change = count * (np.log(np.maximum(good[at] - count, 0) + PRIOR) - np.log(good[at] + PRIOR))
        total += np.bincount(of, weights=change, minlength=rows)
    return n, total / np.maximum(n, 1)


def _scorer(good: np.ndarray, expected: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in chunks(batch.column("text")):
                row, bucket = ngram_buckets(data, offs, len(good))
                n, mean = mean_ratio(row, bucket, hi - lo, good, expected, label[lo:hi] == 1)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("label"), pa.array(n), pa.array(mean)], names=["doc_id", "key", "label", "n", "mean"])

    return run


def calibrate(mean: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the log odds of label 1, by weighted logistic regression.

    The labels are smoothed by one case of either kind, so that labels that part cleanly leave the odds finite.
    """
    scale = float(np.abs(mean).max()) or 1.0
    x = np.stack([mean / scale, np.ones_like(mean)], axis=1)
    ones, zeros = (label == 1).sum(), (label == 0).sum()
    y = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    beta = np.zeros(2)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    for _ in range(100):  # Newton steps, shortened until they help
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (y - p))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta += size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def kth_largest(df: DataFrame, column: str, k: int, small: int = 20_000) -> float:
    """The k-th largest value, by counting ever finer bins; at most ``small`` values reach the driver."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    bins = 4096
    left = k  # rank within [lo, hi] from above
    while n > small and hi > lo:
        width = (hi - lo) / bins
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        which = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / width).cast("int"))
        counts = inside.groupBy(which.alias("bin")).agg(F.count("*").alias("c"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if left <= r["c"]:
                lo, hi, n = r["lo"], r["hi"], r["c"]
                break
            left -= r["c"]
    if hi == lo:
        return lo
    values = sorted((r[0] for r in df.where((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).collect()), reverse=True)
    return values[left - 1]


def _one_label(labels: DataFrame, label_col: str) -> DataFrame:
    """(labelled_id, label) of each id, the worst of its labels."""
    return labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.min(label_col).cast("int").alias("label"))


def _labelled(labels: DataFrame, label_col: str, bound: int) -> DataFrame:
    """At most ``bound`` ids of each label, by the hash of the id."""
    rows = _one_label(labels, label_col)
    order = [F.xxhash64("labelled_id"), F.col("labelled_id")]
    return rows.where("label = 1").orderBy(*order).limit(bound).unionByName(rows.where("label = 0").orderBy(*order).limit(bound))


def quality_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", target: int | None = None, buckets: int = BUCKETS, labelled: int = LABELLED, seed: int = 1) -> DataFrame:
    """(doc_id, key, n_ngrams, score, log_weight, draw, kept) for every row of ``docs``; ``key`` hashes its text.

    ``target`` is how many rows are drawn; left out, the expected number of good ones. ``score`` is
    the mean log ratio.

    - Null, empty and tokenless texts have log weight 0 and can be drawn like any other.
    - Labels other than 0 and 1 are ignored; of several labels of an id the worst counts. If
      either label is missing there is nothing to tell apart: all log weights are 0, and all rows
      are kept unless ``target`` says otherwise.
    - The noise hashes the id and the text: reruns agree, and repeated rows share the decision.
    - Rows with null ids are weighed like any other; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = text_of(docs[text_col])
    known = F.broadcast(_labelled(labels, label_col, labelled))  # 2 * labelled rows of 12 bytes at most
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    source = source.join(known, F.col("doc_id") == F.col("labelled_id"), "left").select("doc_id", "key", F.coalesce("label", F.lit(-1)).alias("label"), "text")
    counted = source.select("label", "text").mapInArrow(_counter(buckets), "bucket long, raw long, good long")
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # a row a bucket
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in sums:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    expected = raw * (good.sum() / max(raw.sum(), 1))
    scored = materialize(source.mapInArrow(_scorer(good, expected), "doc_id long, key long, label int, n long, mean double"))
    sample = scored.where("label >= 0 and n > 0").select("label", "mean").collect()  # labelled rows of the bounded sample
    sample.sort()  # sums in one order, so that reruns agree to the last digit
    label, mean = np.array([r["label"] for r in sample]), np.array([r["mean"] for r in sample])
    odds = None
    if 0 < label.sum() < len(label):
        counts = {r["label"]: r["n"] for r in _one_label(labels, label_col).groupBy("label").agg(F.count("*").alias("n")).collect()}
        weight = np.where(label == 1, counts[1] / (label == 1).sum(), counts[0] / (label == 0).sum())
        slope, shift = calibrate(mean, label, weight)
        odds = F.lit(slope) * F.col("mean") + F.lit(shift)
    log_good = F.lit(0.0) if odds is None else -(F.greatest(-odds, F.lit(0.0)) + F.log1p(F.exp(-F.abs(odds))))
    parts = F.when(F.col("n") > 0, F.round(F.exp(log_good) * 1e9).cast("long"))  # whole numbers add up alike in any order
    total, some, sum_ = scored.agg(F.count("*"), F.count(parts), F.sum(parts)).first()
    share = sum_ / some / 1e9 if some else 1.0
    log_weight = F.when(F.col("n") > 0, log_good - F.lit(float(np.log(share)))).otherwise(F.lit(0.0))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "key"), 11).cast("double") + 0.5) / F.lit(2.0**53)
    drawn = scored.withColumn("log_weight", log_weight).withColumn("draw", F.col("log_weight") - F.log(-F.log(uniform)))
    limit = kth_largest(drawn, "draw", round(total * share) if target is None else target)
    return drawn.select("doc_id", "key", F.col("n").alias("n_ngrams"), F.col("mean").alias("score"), "log_weight", "draw", (F.col("draw") >= F.lit(limit)).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_weights` draws, columns as they are."""
    bad = quality_weights(docs, labels, id_col, text_col, **options).where("not kept")
    id_name, key_name = temp_name(docs, "bad_id"), temp_name(docs, "bad_key")
    bad = bad.select(F.col("doc_id").alias(id_name), F.col("key").alias(key_name)).distinct()
    same: Column = docs[id_col].cast("long").eqNullSafe(bad[id_name]) & (F.xxhash64(text_of(docs[text_col])) == bad[key_name])
    return docs.join(bad, same, "left_anti")

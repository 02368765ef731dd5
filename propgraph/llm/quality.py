"""Quality selection by importance resampling.

Target text (documents labelled of good quality) and raw text (all documents) each get a generative
model: a bag of hashed word unigrams and bigrams. A document's importance weight is the ratio of
the two likelihoods; its log is perturbed by Gumbel noise seeded with the id, and the top ``k`` are
taken: sampling without replacement in proportion to the weights. (``temper`` replaces the log weight
by so many times its mean over the n-grams, for which length does not count.) The k-th key is found with a histogram of keys, so only one narrow bin is
sorted.

The raw model counts all documents. The target model is fitted on at most ``TARGET_DOCS`` labelled
documents, those of the least hash of their id; their ids are broadcast, so one pass over the texts
counts for both models and no text is shuffled.

Defined cases. Null and blank text has no n-grams: log ratio 0, never selected. Null labels count as
not labelled. A null id gets noise like any other. Rows that repeat get equal keys; ties at the k-th key are
selected together, so they can be more than k. Texts of any length are counted whole; columns of other
names are not read. Without target documents all ratios are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.llm.words import mix64, word_hashes
from propgraph.plans.staging import staged

BUCKETS = 1 << 14
SMOOTH = 1.0
#: Labelled documents that the target model is fitted on, at most.
TARGET_DOCS = 20_000


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's word unigrams and bigrams."""
    words = word_hashes(text)[0]
    pairs = mix64(words[:-1] * np.uint64(0xA0761D6478BD642F) + words[1:])
    return (np.concatenate((words, pairs)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, target, docs = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64), 0
    for pdf in batches:
        for text, good in zip(pdf["text"], pdf["good"], strict=True):
            counts = np.bincount(features(text), minlength=BUCKETS)
            raw += counts
            if good:
                target += counts
        docs += len(pdf)
    if docs:
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "raw": raw, "target": target})


def log_ratios(docs: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket, from (text, good); ``BUCKETS`` rows reach the driver."""
    parts = docs.select("text", "good").mapInPandas(_counted, "bucket int, raw long, target long")
    rows = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    raw[rows["bucket"]] += rows["raw"]
    target[rows["bucket"]] += rows["target"]
    if target.sum() == SMOOTH * BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _scored(ratios, seed: int, temper: float | None):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = [(len(f), float(ratios.value[f].sum())) for f in map(features, pdf["text"])]
            n = np.array([s[0] for s in sums], dtype=np.int64)
            mean = np.array([s[1] for s in sums]) / np.maximum(n, 1)
            ident = pdf["id"].to_numpy().view(np.uint64)
            uniform = ((mix64(ident + mix64(np.array([seed + 1], dtype=np.uint64))) >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
            weight = mean * n if temper is None else temper * mean
            key = np.where(n > 0, weight - np.log(-np.log(uniform)), -np.inf)
            yield pd.DataFrame({"id": pdf["id"], "none": pdf["none"], "n_grams": n, "log_ratio": mean, "log_weight": mean * n, "key": key})

    return score


def resample(docs: DataFrame, labels: DataFrame, share: float, seed: int = 11, temper: float | None = None) -> DataFrame:
    """Per document: id, n_grams, log_ratio (mean of its n-grams), log_weight (their sum), key, selected (``share`` of all documents).

    The key is ``log_weight``, or ``temper`` times ``log_ratio`` if that is given, plus Gumbel noise.

    ``labels`` has (id, good); a document is target text if any of its labels is good.
    """
    spark = docs.sparkSession
    good = labels.filter("good and id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(TARGET_DOCS)
    good = F.broadcast(good.withColumn("good", F.lit(True)))
    ident = F.col("doc_id").cast("long")
    texts = docs.select(ident.alias("id"), "text")
    # beside a null, pandas would make floats of ids
    whole = docs.select(F.coalesce(ident, F.lit(-1)).alias("id"), ident.isNull().alias("none"), "text")
    ratios = spark.sparkContext.broadcast(log_ratios(texts.join(good, "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))))
    scored = whole.mapInPandas(_scored(ratios, seed, temper), "id long, none boolean, n_grams long, log_ratio double, log_weight double, key double")
    scored = staged(scored.withColumn("id", F.when(~F.col("none"), F.col("id"))).drop("none"), "quality")
    able = scored.filter("n_grams > 0")
    k = min(round(share * scored.count()), able.count())
    cut = _kth_largest(able, k)
    return scored.withColumn("selected", (F.col("n_grams") > 0) & (F.col("key") >= F.lit(cut)))


def _kth_largest(rows: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest key, by histograms of ever narrower ranges."""
    if k <= 0:
        return float("inf")
    low, high = rows.agg(F.min("key"), F.max("key")).head()
    need = k
    for _ in range(6):
        if low is None or low >= high:
            break
        width = (high - low) / bins
        at = F.least(F.lit(bins - 1), F.floor((F.col("key") - low) / width))
        inside = rows.filter((F.col("key") >= low) & (F.col("key") <= high))
        counts = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(at.alias("b")).agg(F.count(F.lit(1)), F.min("key"), F.max("key")).collect()}
        for b in sorted(counts, reverse=True):
            n, least, most = counts[b]
            if need <= n:
                if need == n or least == most:
                    return least
                low, high = least, most
                break
            need -= n
    return low


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("id"), (F.coalesce("quality", F.lit(0)) == 1).alias("good"))
    share = labels.agg(F.avg(F.col("good").cast("double"))).head()[0] or 0.0
    return resample(docs, labels, share).select(F.col("id").alias("doc_id"), "n_grams", "log_ratio", F.col("key").alias("sampling_key"), "selected")

"""Importance resampling towards a target distribution, over hashed n-grams.

A 256-byte table lower-cases A-Z and blanks ASCII separators in UTF-8, ``bytes.split`` yields the
words, and CRC-32 with the hash of the words so far as seed hashes longer n-grams without joining them
(:func:`buckets`). Counters of buckets, one a task, are added up by Spark; corpus and target
counts give each bucket an integer gain, a document's weight is the floored mean gain of its
features, and a Gumbel number from the hash of the id turns drawing without replacement into taking
the highest scores (:func:`drawn`). Ranks come from one range partitioning by score and id; no task
sees all rows.

What the driver holds is one number a bucket (``BUCKETS``) and one a partition.

Defined results: a null or empty text has no features, weight 0 and is not drawn; a row with a null id
has a null score and is not drawn, nor counted in N; repeated rows count, score and rank each; equal
scores go by the smaller id; an empty target or corpus counts 0 throughout; an empty table gives an
empty one; columns other than doc_id and text are ignored. Texts of any length are read in stretches
of ``STRETCH`` bytes, cut between words.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import keep, release, table
from platewise.llm.sharding import ranked

BUCKETS = 10_000
LENGTHS = 2  # of n-grams, from 1
MIN_WORDS = 20
PERCENT = 25
SEED = 7
STRETCH = 1 << 20
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SCORES = "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint"


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``STRETCH`` bytes."""
    text = text.translate(TABLE)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + STRETCH) if len(text) - at > STRETCH else len(text)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        if words:
            yield words
        at = end + 1


def buckets(text: bytes, lengths: int = LENGTHS, n_buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) of each stretch; n-grams that span two belong to the second."""
    last: list[bytes] = []  # words before, as far as n-grams reach back
    for words in word_lists(text):
        hashes = list(map(crc32, last + words))
        spaced = [b" " + w for w in last + words]
        found = hashes[len(last) :]
        for n in range(2, lengths + 1):
            # the n-gram that ends in a word: its words but the last are the seed
            hashes = list(map(crc32, spaced[n - 1 :], hashes))
            found += hashes[max(0, len(last) - n + 1) :]
        last = (last + words)[-(lengths - 1) :] if lengths > 1 else []
        yield len(words), np.array(found, np.int64) % n_buckets


def raw_texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def bucket_counts(rows: DataFrame) -> list[int]:
    """How many features of all texts lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch["text"]:
                for _, found in buckets(text.as_buffer().to_pybytes()):
                    counts.update(found.tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(counts.keys()), pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})
        release()

    out = [0] * BUCKETS
    for r in raw_texts(rows).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS
        out[r.bucket] = r.n
    return out


def gains_of(corpus: list[int], target: list[int]) -> np.ndarray:
    s_all, t_all = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target)], np.int64)


def gumbel(doc_id: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """Rows of SCORES, one for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                n_words = n = total = 0
                for words, found in buckets(text.as_buffer().to_pybytes()):
                    n_words, n, total = n_words + words, n + len(found), total + int(gains[found].sum())
                weight = total // n if n else 0
                rows.append((i, n_words, n, weight, None if i is None else weight + gumbel(i, seed)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_features", "weight", "score"])
        release()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, SCORES)


def drawn(scores: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scores`` with rank: 1, 2, 3... of the highest scores among rows with enough words, else null."""
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    placed, n = ranked(scores.where(able).withColumn("_down", F.negative("score")), ["_down", "doc_id"])
    rank = F.when(F.col("place") < percent * n // 100, F.col("place") + 1).cast("bigint")
    rest = scores.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.withColumn("rank", rank).select(rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Scores and ranks of all documents, drawn towards the texts of ``target``."""
    gains = gains_of(bucket_counts(docs), bucket_counts(target))
    scores, _ = keep(scored(docs, gains), "scores")
    return drawn(scores)


def sample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are drawn."""
    ranks, _ = keep(resample(docs, target).where("rank is not null").select("doc_id").distinct(), "drawn")
    return docs.join(ranks, "doc_id", "left_semi")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")

"""A corpus pipeline of four stages, each by one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs.

1. toxicity: documents that the classifier rejects go.
2. near_duplicates: of each component of texts whose five-word shingle sets have a Jaccard
   similarity of 0.8 or more, linked directly or through others, the one with the least id stays.
3. decontamination: documents that leak a benchmark item go.
4. encoding: every kept text is encoded to byte-level BPE ids and decoded again.

SQL cannot express fitted classifiers, similarity components or BPE; the tests hold the stages
against brute force instead. Rows with a null id go through the filters by their text only where a
filter does not need an id: they are never dropped as duplicates or leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import bpe, decontam, jaccard, toxicity
from platewise.llm.common import keep, table

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.judge(docs, model).where("predicted = 0").select(DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n=5, percent=80).select(DOCUMENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(DOCUMENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_frame(docs.select("doc_id", "text"), exact="decodes_exactly")
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decodes_exactly")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

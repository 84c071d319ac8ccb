"""Audit of how filters interact, by Hart-Mas-Colell potentials of the removal game.

Each document gets a mask of the filters that it fails; from then on only counts by mask matter. A
coalition S of filters removes v(S) documents: those whose mask meets S. The potential of a coalition,

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,    P({}) = 0,

is computed over all 32 coalitions in order of their size, and P(all) - P(all without i) is the
Shapley value of filter i. Potentials are kept in 120ths, which makes each an integer, so the sum of a
filter's removals over all 120 orders is exact. What a step of an order removes is v(before and the
filter) - v(before).

Masks come from one pass over the texts (bytes in Python, one batch at a time). Texts are compared by
their SHA-256; a document is a copy if a smaller id has its text. Copies are counted by (digest, cell),
where a cell is (part, mask, labels), before anything is shuffled by digest: a group of copies sends
one row a task and cell, however large it is.

Defined results: a null text is empty; a null part is the empty string; a null id has no labels, is no
copy and makes none; rows that repeat an id and its text are no copies of each other and count each
time; of several labels of an id the highest holds; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import release, table

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
IN_120THS = 120
MIN_WORDS = 200
MIN_DISTINCT = 50  # percent of words
MAX_UPPER = 2  # percent of code points
COPY = 1 << FILTERS.index("E")

_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def mask_of(text: bytes) -> int:
    """The filters A to D that a text in UTF-8 fails."""
    words = text.split()
    few = len(words) < MIN_WORDS
    same = 100 * len(set(words)) < MIN_DISTINCT * len(words)
    shouts = 100 * (len(text) - len(text.translate(None, _UPPER))) > MAX_UPPER * len(text.translate(None, _CONTINUED))
    marks = len(text.translate(None, _MARKS)) < len(text)
    return few | same << 1 | shouts << 2 | marks << 3


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row; E is not in the mask yet."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, masks = [], []
            for text in batch["text"]:
                raw = text.as_buffer().to_pybytes()
                digests.append(hashlib.sha256(raw).digest())
                masks.append(mask_of(raw))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], schema=schema)
        release()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents of each part by the filters they fail and their labels."""
    rows = masked(docs).groupBy("digest", "part", "mask", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    marks = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*marks)
    rows = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    cell = ["part", "mask", "good", "toxic"]
    # of each cell of a text: all rows, those without an id, and the least id with its rows
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    found = rows.groupBy("digest", *cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"), first.alias("first"))
    least = found.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    found = found.join(least, "digest", "left")
    firsts = F.col("free") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - firsts).alias("n"))))
    return found.select("part", "good", "toxic", both.alias("c")).groupBy("part", "c.mask", "good", "toxic").agg(F.sum("c.n").alias("n")).where("n > 0")


def coalition_counts(by_mask: np.ndarray) -> np.ndarray:
    """v(S) for all coalitions from counts by mask (last axis)."""
    meets = np.array([[int(s & m != 0) for s in range(ALL + 1)] for m in range(ALL + 1)])
    return by_mask @ meets


def potentials(v: np.ndarray) -> np.ndarray:
    """120 P(S) of all coalitions, smaller ones first."""
    out = np.zeros_like(v)
    for s in sorted(range(1, ALL + 1), key=int.bit_count):
        below = sum(out[..., s & ~(1 << i)] for i in range(len(FILTERS)) if s >> i & 1)
        out[..., s] = (IN_120THS * v[..., s] + below) // s.bit_count()
    return out


#: Filter order, step, coalition before the step, number of the step's filter.
STEPS = [
    ("".join(FILTERS[i] for i in order), k + 1, sum(1 << i for i in order[:k]), i) for order in permutations(range(len(FILTERS))) for k, i in enumerate(order)
]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(cells: DataFrame) -> DataFrame:
    """One row for each part, order and step."""

    def by_mask(rows, name: str):
        return F.array(*[F.sum(F.when((F.col("mask") == m) & rows, F.col("n")).otherwise(0)).cast("bigint") for m in range(ALL + 1)]).alias(name)

    counts = cells.groupBy("part").agg(by_mask(F.lit(True), "every"), by_mask(F.col("good"), "good"), by_mask(F.col("toxic"), "toxic"))
    orders, steps = [s[0] for s in STEPS], np.array([s[1] for s in STEPS], np.int32)
    before, which = np.array([s[2] for s in STEPS]), np.array([s[3] for s in STEPS])
    after, alone = before | 1 << which, 1 << which

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, every, good, toxic in zip(pdf.part, pdf.every, pdf.good, pdf.toxic):
                every = np.array(every, dtype=np.int64)
                v, g, t = (coalition_counts(np.array(x, dtype=np.int64)) for x in (every, good, toxic))
                p = potentials(v)
                removed = v[after] - v[before]
                values = [every.sum() - v[after], removed, v[alone] - removed, every[alone], g[after] - g[before], t[after] - t[before], p[ALL] - p[ALL & ~alone]]
                yield pd.DataFrame({"part": part, "filter_order": orders, "step": steps, **dict(zip(COUNTS, values))})

    return counts.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
firsts AS (SELECT text, min(doc_id) AS least FROM words GROUP BY text),
marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 2 * length(words.text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(words.text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN words.doc_id > least THEN 'E' ELSE '' END) AS f
  FROM words JOIN firsts ON words.text = firsts.text LEFT JOIN marked USING (doc_id)
),
cells AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT x AS o FROM letters
  UNION ALL
  SELECT o || x FROM orders JOIN letters ON instr(o, x) = 0
),
steps AS (
  SELECT o AS filter_order, CAST(k AS INTEGER) AS step, substr(o, k, 1) AS x, substr(o, 1, k - 1) AS before
  FROM orders CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE length(o) = 5
),
counted AS (
  SELECT part, filter_order, step, x,
         sum(CASE WHEN translate(f, before || x, '') = f THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN translate(f, before, '') = f AND instr(f, x) > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN translate(f, before, '') <> f AND instr(f, x) > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN f = x THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN translate(f, before, '') = f AND instr(f, x) > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN translate(f, before, '') = f AND instr(f, x) > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY part, filter_order, step, x
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM counted
"""

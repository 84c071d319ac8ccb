"""Ranked text search over a stored inverted index.

The index is built once: for each word of a table its stem and, by row, the places where it stands. It lies in
folders by hash of the stem, sorted by stem inside, so a request reads its terms' folders, and in them
the row groups of its stems only; texts are not read again. Rows of one frequent stem are dealt to
several files of its folder.

A request means the same as in the search without an index: words that must all occur, alternatives
(``or``), "phrases" and -exclusions; English stems without stop words or, where no row has these, words as
they are. Both are ranked in one pass by cover density, and the choice is made on the ranked rows.

A stem stands for all its words. Where a request means some of them only, it names these (``forms``), and other words of
the stem do not count.

Defined results: null fields are empty; a row without words has no postings and is never found; a null key
is a key of its own; rows that repeat a key count as one text each in the order of the build only if
keys are unique, so keys must be; a request of stop words alone finds them as plain words.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.functions.stems import MEMO, stem
from platewise.plans.search import STOP_WORDS, parse_query

BUCKETS = 256
PIECE = 200_000  # places that leave a task at a time, or those of one row
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
SPREAD = 8  # files a folder is dealt to

_WORD = re.compile(r"[^\W_]+")


def postings(df: DataFrame, fields: list[str], key: str) -> DataFrame:
    """(stem, word, key, n_english, n, places): where each word of a row stands, and how many words the row has.

    Texts come in batches of ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` at most, postings leave in pieces.
    Places count the words of all fields in turn, stop words too; ``f`` is the field's number.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"stem string, word string, key {kind}, n_english int, n int, places array<struct<p:int,f:int>>"
    stops = frozenset(STOP_WORDS)

    def batch_of(stems, words, keys, rows, english, sizes, p, f, ends) -> pa.RecordBatch:
        p, f, ends, rows, english, sizes = (pa.array(np.frombuffer(x, np.int32)) for x in (p, f, ends, rows, english, sizes))
        places = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([p, f], names=["p", "f"]))
        columns = [pa.array(stems, pa.string()), pa.array(words, pa.string()), keys.take(rows), english, sizes, places]
        return pa.RecordBatch.from_arrays(columns, names=["stem", "word", "key", "n_english", "n", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        ints = lambda *x: array("i", x)
        for batch in batches:
            stems, words, rows, english, sizes, p, f, ends = [], [], ints(), ints(), ints(), ints(), ints(), ints(0)
            for row in range(batch.num_rows):
                at: dict[str, list[int]] = {}
                bounds, n = [], 0
                for i in range(len(fields)):
                    for n, w in enumerate(map(re.Match.group, _WORD.finditer(batch[f"f{i}"][row].as_py())), n):
                        at.setdefault(w, []).append(n)
                    n = sum(map(len, at.values()))
                    bounds.append(n)
                said = sum(len(x) for w, x in at.items() if w not in stops)
                for w, places in at.items():
                    s = known.get(w)
                    if s is None:
                        if len(known) > MEMO:
                            known.clear()
                        s = known[w] = stem(w)
                    stems.append(s)
                    words.append(w)
                    p.extend(places)
                    f.extend([0] * len(places) if len(bounds) == 1 else [bisect_right(bounds, x) for x in places])
                    ends.append(len(p))
                rows.extend([row] * len(at))
                english.extend([said] * len(at))
                sizes.extend([n] * len(at))
                if len(p) >= PIECE or words and row == batch.num_rows - 1:
                    yield batch_of(stems, words, batch["key"], rows, english, sizes, p, f, ends)
                    stems, words, rows, english, sizes, p, f, ends = [], [], ints(), ints(), ints(), ints(), ints(), ints(0)

    texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"f{i}") for i, c in enumerate(fields)]
    return df.select(F.col(key).alias("key"), *texts).mapInArrow(run, schema)


def _bucket(stems: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stems), F.lit(buckets)).cast("int")


def build(df: DataFrame, fields: list[str], key: str, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``fields`` to ``path``."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = postings(df, fields, key).withColumn("bucket", _bucket(F.col("stem"), buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SPREAD))).sortWithinPartitions("bucket", "stem", "word")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def hits(spark: SparkSession, path: str, stems: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some stems: other folders are not listed as input, other stems' row groups are skipped."""
    asked = spark.createDataFrame([(s,) for s in stems], "s string").select(_bucket(F.col("s"), buckets).alias("b")).distinct()
    folders = [r.b for r in asked.collect()]  # one a term of the request at most
    return spark.read.parquet(path).where(F.col("bucket").isin(folders) & F.col("stem").isin(stems))


def _needed(q: str, english: bool) -> tuple[list[list[str]], list[list[tuple[int, str]]], list[str]]:
    groups, phrases, never = parse_query(q)
    norm = stem if english else str
    stops = STOP_WORDS if english else []
    kept = [k for k in ([norm(w) for w in g if w not in stops] for g in groups) if k]
    placed = [p for p in ([(i, norm(w)) for i, w in enumerate(_WORD.findall(p)) if w not in stops] for p in phrases) if p]
    return kept, placed, [norm(w) for w in never]


def _begins(phrase: list[tuple[int, str]]):
    """Whether a phrase begins at an entry of the row's entries ``e``."""

    def stands(first: Column, gap: int, word: str) -> Column:
        return F.exists("e", lambda x: (x["t"] == word) & (x["f"] == first["f"]) & (x["p"] == first["p"] + gap))

    (at, word), rest = phrase[0], phrase[1:]

    def begins(e):
        return reduce(lambda ok, x: ok & stands(e, x[0] - at, x[1]), rest, e["t"] == word)

    return begins


def ranked(found: DataFrame, q: str, weights: list[float], english: bool, forms: list[str] | None = None) -> DataFrame:
    """(key, rank) of the rows whose postings meet the request under one dictionary, by words of ``forms`` only if given."""
    groups, placed, never = _needed(q, english)
    terms = groups + [[w] for p in placed for _, w in p]
    term = F.col("stem" if english else "word")
    if not terms:
        return found.select("key", F.lit(0.0).alias("rank")).limit(0)
    first: dict[str, int] = {}
    for g, ws in enumerate(terms):
        for w in ws:
            first.setdefault(w, g)
    numbered = {g: i for i, g in enumerate(sorted(set(first.values())))}
    group_of = F.create_map(*[F.lit(v) for w, g in first.items() for v in (w, numbered[g])])
    weight_of = F.array(*[F.lit(float(w)) for w in weights])
    wanted = found.where(term.isin(sorted({*first, *never})))
    if english:
        wanted = wanted.where(~F.col("word").isin(STOP_WORDS))
        if forms is not None:
            wanted = wanted.where(F.col("word").isin(forms))
    each = wanted.select("key", F.col("n_english" if english else "n").alias("n"), term.alias("t"), F.explode("places").alias("at"))
    entry = F.struct(F.col("at.p").alias("p"), F.col("at.f").alias("f"), F.col("t"), F.try_element_at(group_of, F.col("t")).alias("g"), F.element_at(weight_of, F.col("at.f") + 1).alias("w"))
    rows = each.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.first("n").alias("n"))

    meets = F.size(F.array_distinct(F.filter(F.transform("e", lambda e: e["g"]), lambda g: g.isNotNull()))) == len(numbered)
    for p in placed:
        meets = meets & F.exists("e", _begins(p))
    if never:
        meets = meets & ~F.exists("e", lambda e: e["t"].isin(never))
    rows = rows.where(meets).withColumn("h", F.filter("e", lambda e: e["g"].isNotNull()))

    # every shortest stretch that holds all terms: the harmonic mean of its weights over one plus its other words
    start = F.struct(F.array(*[F.lit(-1)] * len(numbered)).alias("last"), F.lit(-1).alias("from"), F.lit(0.0).alias("sum"))

    def step(s, h):
        last = F.transform(s["last"], lambda p, g: F.when(g == h["g"], h["p"]).otherwise(p))
        begin = F.array_min(last)
        inside = F.filter("h", lambda x: x["p"].between(begin, h["p"]))
        inverse = F.aggregate(inside, F.lit(0.0), lambda a, x: a + 1 / x["w"])
        cover = F.size(inside) / inverse / (1 + (h["p"] - begin) - (F.size(inside) - 1))
        new = (begin >= 0) & (begin > s["from"])
        return F.struct(last.alias("last"), F.when(new, begin).otherwise(s["from"]).alias("from"), (s["sum"] + F.when(new, cover).otherwise(0.0)).alias("sum"))

    return rows.select("key", (F.aggregate("h", start, step, lambda s: s["sum"]) / F.col("n")).alias("rank"))


def search(spark: SparkSession, path: str, q: str, weights: list[float], n: int = 200, buckets: int = BUCKETS, forms: list[str] | None = None) -> DataFrame:
    """(key, rank) of the best ``n`` rows; plain words count only where no row has the English ones.

    With ``forms`` only these words count as English ones.
    """
    asked = set()
    for english in (True, False):
        groups, placed, never = _needed(q, english)
        words = [w for g in groups for w in g] + [w for p in placed for _, w in p] + never
        asked |= set(words) if english else set(map(stem, words))
    found = hits(spark, path, sorted(asked), buckets)
    order = [F.desc("rank"), F.col("key")]
    tiers = [ranked(found, q, weights, english, forms).orderBy(*order).limit(n).withColumn("tier", F.lit(int(not english))) for english in (True, False)]
    both = tiers[0].unionByName(tiers[1])
    best = both.agg(F.min("tier").alias("tier"))  # one row
    return both.join(F.broadcast(best), "tier").select("key", "rank").orderBy(*order)

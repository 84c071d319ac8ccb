"""URL filters by a Bloom filter cascade, with DataFrame functions only.

Level 1 encodes the listed keys. The keys of the corpus that are not listed but pass it are its
false positives; level 2 encodes those, level 3 the listed keys that pass level 2, and so on until
no key passes wrongly. A key's membership is the parity of the first level that refuses it, so over
the key universe used to build the cascade the answer is exact, and judging a URL needs no join:
only bit tests on constants of checked size. Level 1 is sized by universe and list: few listed keys
against many others take a small filter with so many hashes that about as many other keys pass as
are listed; the levels after it halve what passes, with one hash. A list whose level would exceed
``MAX_WORDS`` (about two million keys) is judged by an equi-join on the keys instead, with the same
result.

A rule is a host and the start of a path, written ``host/path``. It fits the host and all
subdomains when the URL's path starts with the rule's path. The keys of a URL are therefore its
host's suffixes, each with the path cut at the lengths that rule paths have. One cascade holds the
block rules and one the allow rules; the longest key that is listed decides.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and
gets the default verdict; of a rule listed with both verdicts block holds; repeated rows are judged
alike; of a host only as many last labels are looked at as rules have; extra columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import drop, keep, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_WORDS = 1 << 18  # 64-bit words of one level: 2 MB
MAX_HASHES = 40
MAX_LEVELS = 160

RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: Column, path: Column, path_lengths: list[int], max_labels: int) -> Column:
    """Every ``suffix + path start`` that a rule could be, longest first."""
    n = F.least(F.size(F.split(host, r"\.")), F.lit(max_labels))
    suffixes = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    starts = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(path_lengths), reverse=True)]),
        lambda s: s.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.concat(h, p))))
    keys = F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


class Level(NamedTuple):
    """One Bloom filter: its 64-bit words and how many bits a key sets."""

    number: int
    words: np.ndarray
    hashes: int


def _bit(key: Column, level: int, i: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * 131) + i), F.lit(bits))


def _passes(key: Column, level: Level) -> Column:
    """True if every bit of the key is set in a level's words."""
    words = F.lit(level.words)

    def is_set(i):
        b = _bit(key, level.number, i, 64 * len(level.words))
        return F.getbit(F.element_at(words, (F.floor(b / 64) + 1).cast("int")), F.pmod(b, F.lit(64)).cast("int")) == 1

    return is_set(F.lit(0)) if level.hashes == 1 else F.forall(F.sequence(F.lit(0), F.lit(level.hashes - 1)), is_set)


def size_of(n: int, others: int, first: bool) -> tuple[int, int]:
    """(words, hashes) of a level of ``n`` keys that ``others`` must not pass: the first lets about ``n`` of
    them pass, the others half of them."""
    rate = min(0.5, 0.7 * n / max(others, 1)) if first else 0.5
    bits = n * math.log2(1 / rate) / math.log(2)
    return max(1, math.ceil(bits / 64)), min(MAX_HASHES, max(1, round(math.log2(1 / rate))))


def _level(keys: DataFrame, number: int, n_words: int, hashes: int) -> Level:
    """A Bloom filter over ``keys.key``; at most ``n_words`` rows reach the driver."""
    bits = 64 * n_words
    b = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: _bit(F.col("key"), number, i, bits)))
    rows = (
        keys.select(b.alias("b"))
        .select(F.floor(F.col("b") / 64).alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("b", F.lit(64)).cast("int")).alias("m"))
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .collect()
    )
    words = np.zeros(n_words, dtype=np.int64)
    for r in rows:
        words[r.w] = r.m
    return Level(number, words, hashes)


def build_cascade(universe: DataFrame, listed: DataFrame, max_words: int = MAX_WORDS) -> list[Level] | None:
    """Levels over ``universe.key`` (any keys, repeated or not) with the members ``listed.key``.

    None where a level would take more than ``max_words``.
    """
    keys = universe.select("key", F.lit(0).alias("m")).unionByName(listed.select("key", F.lit(1).alias("m")))
    keys = keys.where("key is not null").groupBy("key").agg(F.max("m").alias("m"))
    keys, path = keep(keys, "cascade")
    inside, outside = keys.where("m = 1"), keys.where("m = 0")
    counts = {r.m: r["count"] for r in keys.groupBy("m").count().collect()}
    n, others = counts.get(1, 0), counts.get(0, 0)
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade did not end")
        n_words, hashes = size_of(n, others, not levels)
        if n_words > max_words:
            drop(universe.sparkSession, path)
            return None
        level = _level(inside, len(levels), n_words, hashes)
        levels.append(level)
        # what passes wrongly is what the next level holds; what this one holds is what must not pass that
        inside, outside = outside.where(_passes(F.col("key"), level)), inside
        n, others = inside.count(), n
    drop(universe.sparkSession, path)
    return levels


def is_member(key: Column, levels: list[Level]) -> Column:
    """Exact membership for keys of the universe: the first refusing level's parity decides."""
    out = F.lit(len(levels) % 2 == 1)
    for level in range(len(levels) - 1, -1, -1):
        out = F.when(~_passes(key, levels[level]), F.lit(level % 2 == 1)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow", max_words: int = MAX_WORDS) -> DataFrame:
    """Per row: key, host, path, rule and verdict.

    ``rules`` has rule (``host/path``) and verdict (allow or block).
    """
    rules = rules.select(F.col("rule").alias("key"), "verdict").where("key is not null")
    at = F.greatest(F.instr("key", "/"), F.lit(1))
    # distinct lengths of paths, not rules: as many as a path has characters at most
    shapes = rules.groupBy((F.length("key") - at + 1).alias("n")).agg(F.max(F.size(F.split(F.substr("key", F.lit(1), at - 1), r"\."))).alias("labels")).collect()
    lengths, labels = [r.n for r in shapes], max([r.labels for r in shapes], default=1)
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keyed = parts.withColumn("keys", keys_of(F.col("host"), F.col("path"), lengths, labels))
    universe, path = keep(keyed.select(F.explode("keys").alias("key")).distinct(), "keys")
    block = build_cascade(universe, rules.where("verdict = 'block'").select("key"), max_words)
    allow = None if block is None else build_cascade(universe, rules.where("verdict = 'allow'").select("key"), max_words)
    drop(pages.sparkSession, path)
    if allow is None:
        return _judge_by_join(keyed, rules, key, default)
    hit = F.filter("keys", lambda k: is_member(k, block) | is_member(k, allow))
    out = keyed.withColumn("rule", F.try_element_at(hit, F.lit(1)))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(is_member(F.col("rule"), block), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(key, "host", "path", "rule", verdict.alias("verdict"))


def _judge_by_join(keyed: DataFrame, rules: DataFrame, key: str, default: str) -> DataFrame:
    """The same for lists too long for constants: distinct sets of keys meet the rules by key."""
    rules = rules.groupBy(F.col("key").alias("k")).agg(F.max(F.col("verdict") == "block").alias("blocks"))
    keys = keyed.select("keys").distinct().select("keys", F.explode("keys").alias("k"))
    best = keys.join(rules, "k").groupBy("keys").agg(F.max_by(F.struct("k", "blocks"), F.length("k")).alias("b"))
    out = keyed.join(best, "keys", "left")
    verdict = F.when(F.col("b").isNull(), F.lit(default)).when(F.col("b.blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(key, "host", "path", F.col("b.k").alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


_HOST = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
ORACLE = f"""
with r(rule, rh, rp, verdict) as (values {", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in RULES)}),
p as (select page_id, url, {_HOST} as host, {_PATH} as path from pages),
m as (
  select p.page_id, p.url, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
  from p join r on (p.host = r.rh or ends_with(p.host, '.' || r.rh)) and starts_with(p.path, r.rp)
  group by all
)
select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from p left join m on p.page_id is not distinct from m.page_id and p.url is not distinct from m.url
"""
